"""Periodic runs against trying every period, and the query against the rule it is given."""

import hashlib
import random
import re
import zlib

import pytest

from panelkit.llm import runs
from panelkit.llm.queries import QUERIES
from panelkit.session import load

from .test_operators import DOCS, ODD


def brute(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            own = words[i:j + q]
            if j > i and len(own) >= max(least, times * q) and not any(own[:-p] == own[p:] for p in range(1, q)):
                out.append((i, len(own), q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("symbols", [1, 2, 3, 6, 40])
def test_runs_against_every_period(symbols):
    rng = random.Random(symbols)
    for _ in range(300):
        n = rng.randrange(130)
        words = [rng.randrange(symbols) for _ in range(n)]
        for _ in range(rng.randrange(3)):  # repeat blocks, also inside others
            if n > 10:
                a, b = sorted(rng.sample(range(n), 2))
                p = 1 + (b - a) // rng.randrange(2, 9)
                words = [w if not a <= i < b else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert runs.runs_of(words) == brute(words)
        assert runs.runs_of(words, 5, 3) == brute(words, 5, 3)


def test_words_of_few_letters():
    a, b = "a", "ab"
    while len(b) < 3000:
        a, b = b, b + a
    for word in [b[:3000], "ab" * 700 + "b" + "ab" * 700, "a" * 2000, "".join(format(i, "b") for i in range(400))]:
        assert runs.runs_of(list(word)) == brute(list(word))


def test_extensions():
    rng = random.Random(2)
    words = [rng.randrange(1, 4) for _ in range(200)]
    extend = runs.Extension(words, 4)
    for _ in range(500):
        i, j = rng.sample(range(200), 2)
        n = 0
        while max(i, j) + n < 200 and words[i + n] == words[j + n]:
            n += 1
        assert int(extend(runs.np.array([i]), runs.np.array([j]))[0]) == n
    order = sorted(range(200), key=lambda i: words[i:])
    assert sorted(range(200), key=extend.place.__getitem__) == order


def digest(lines):
    return hashlib.sha256(lines.encode()).hexdigest()


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    dropped = {i for s, m, q in found for i in range(s + q, s + m)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(found), *(best[:3] if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))


def test_query(spark):
    sf_dir = "/root/testdata/sf0.001"
    want = [expected(r.doc_id, r.text) for r in load(spark, sf_dir, "documents").collect()]
    got = QUERIES["op12_periodic_runs"](spark, sf_dir).drop("n_words").collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and sum(w[1] > 0 for w in want) > 5


def test_odd_rows(spark):
    df = spark.createDataFrame([*ODD, (7, "x " * 9, "en", "a", "x", 1, 1, "c"), (None, "a\x0bb\ta b\na\rb a  b", "en", "a", "x", 1, 1, "c")], DOCS)
    got = {(r.doc_id, r.n_words): r for r in runs.find(df).collect()}
    assert len(runs.find(df).collect()) == len(ODD) + 2
    assert [tuple(x) for x in got[7, 9].runs] == [(0, 9, 1)] and got[7, 9].collapsed == "x"
    assert [tuple(x) for x in got[3, 30_000].runs] == [(0, 30_000, 1)]
    assert [tuple(x) for x in got[None, 8].runs] == [(0, 8, 2)] and got[None, 8].collapsed == "a b"
    assert got[1, 0].collapsed == got[2, 0].collapsed == "" and got[4, 3].collapsed == "one two three"
    assert runs.find(df.limit(0)).count() == 0
