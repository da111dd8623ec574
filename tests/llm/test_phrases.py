"""Phrases against counting every phrase, the sort against counting, and odd inputs."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from panelkit.llm import phrases

from .test_operators import DOCS, ODD


def brute(rows, least=10, top=2000, shadowed=50):
    count, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in (1, 2, 3):
                count[lang].update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in count.items():
        own = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {q for p, a in own.items() if len(p) == 3 for q in (p[:2], p[1:]) if 100 * a >= shadowed * f[q]}
        found = []
        for p, a in own.items():
            if p not in hidden:
                score, k = min((Fraction(10**6 * a * a, f[p[:k]] * f[p[k:]]).__floor__(), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def corpus(seed, n=200):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(25)] + ["The", "the", "éa", "ÉA", "\U0001f600", "a\x00b", "w1-w2"]
    weight = [1 / (i + 1) for i in range(len(names))]
    text = lambda: "".join(w + rng.choice([" ", " ", " ", "  ", "\t", "\n", ". ", ",", ";x "]) for w in rng.choices(names, weight, k=rng.randrange(60)))
    return [(rng.choice(["en", "en", "de", None, "und", ""]), rng.choice([None, "", "... \n"]) if i % 20 == 0 else text()) for i in range(n)]


@pytest.mark.parametrize("route, bits, hash_bytes", [(2_000_000, 26, 8), (300, 10, 8), (40, 6, 8), (700, 16, 2)])
def test_against_counting(spark, route, bits, hash_bytes):
    rows = corpus(route)
    df = spark.createDataFrame([(i % 7, lang, text, "z") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, phrase string")
    got = rows_of(phrases.collocations(df, route=route, bits=bits, hash_bytes=hash_bytes))
    assert got == brute(rows) and len(got) > 50
    assert rows_of(phrases.collocations(df.repartition(5), least=3, top=20, shadowed=90, route=route, bits=bits)) == brute(rows, 3, 20, 90)


def test_hot_phrase_over_many_routes(spark):
    # Half of all places start one pair, more than a route holds; its count is put together again.
    rng = random.Random(4)
    rows = [("en", " ".join(f"of the x{rng.randrange(40)}" for _ in range(100))) for _ in range(60)]
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), route=200))
    assert got == brute(rows) and any(r[2] == "of the" and r[3] == 6000 for r in got)


@pytest.mark.parametrize("small", [1, 4, 1024])
def test_three_way_counts(small):
    rng = np.random.default_rng(small)
    for _ in range(30):
        n = int(rng.integers(1, 400))
        words = [rng.integers(1, 6, n).astype(np.uint64) * 7, rng.integers(1, 9, n).astype(np.uint64), rng.integers(0, 9, n).astype(np.uint64)]
        weight = rng.integers(1, 4, n)
        got = Counter()
        for parts, total in phrases.three_way(words, weight, 10, small):
            for *key, t in zip(*parts, total, strict=True):
                key = tuple(int(x) for x in key)
                assert key not in got
                got[key] = int(t)
        want, keys = Counter(), sorted(zip(*(w.tolist() for w in words), strict=True))
        for *key, t in zip(*words, weight, strict=True):
            key = tuple(int(x) for x in key)
            want[key[:2]] += int(t)
            if key[2]:
                want[key] += int(t)
        ends = {keys[0][:2], keys[0], keys[-1][:2], keys[-1]}
        assert all(want[k] == t for k, t in got.items())
        assert {k for k, t in want.items() if t >= 10} <= set(got) <= {k for k, t in want.items() if t >= 10 or k in ends}


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD * 4, DOCS)
    assert rows_of(phrases.collocations(df)) == brute([(r[2], r[1]) for r in ODD * 4])
    assert rows_of(phrases.collocations(df.limit(0))) == []
    # One text of very many different words, without an end of a piece.
    long = " ".join(f"n{i} twice told" for i in range(300_000))
    assert rows_of(phrases.collocations(spark.createDataFrame([("en", long)], "lang string, text string"))) == brute([("en", long)])
