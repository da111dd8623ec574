"""Each operator against brute force on small tables, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelkit.llm import chat, jaccard, kneser, mixing, pieces, quality, suffixes, surrogates, topk, toxicity
from panelkit.llm.components import components
from panelkit.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, id string, n long, d long, cell string"
LONG = "word " * 30_000
ODD = [
    (1, None, None, None, "x", None, 1, "c"),
    (2, "", "en", "a", "x", 1, 1, "c"),
    (3, LONG, "en", "a", "x", 1, 1, "c"),
    (4, "one two three", "en", None, "x", 1, 1, "c"),
    (5, "one two three", "en", "a", "x", 1, 1, "c"),
    (5, "one two three", "en", "a", "x", 1, 1, "c"),
    (6, "Straße   日本 \U0001f600 á \x00 end", "de", "b", None, 1, 1, "c"),
]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# -- 1 ---------------------------------------------------------------------------------

def test_base_counts(spark, odd):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["a", "b", "ab", " ", " ", "\n", "#", "é"]) for _ in range(rng.randrange(300))), "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.id: r for r in quality.base_statistics(df).collect()}
    for i, text, *_ in rows:
        w = words(text)
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        twice, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if twice[g] > 1:
                covered.update(range(k, k + 5))
        lines = [x for x in text.split("\n") if words(x)]
        assert (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)) == (
            got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words)


def test_outliers_against_numpy(spark, odd, none):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(4000)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(80, 160), replace=False)) for _ in range(300)]
    junk = [" ".join(w + "###" for w in rng.choice(vocabulary, 100, replace=False)) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts + junk)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.verdicts(df).collect()}
    assert sum(got[i].kept for i in range(300)) >= 290 and not any(got[i].kept for i in range(300, 320))
    # The fit of the clean rows: distances as numpy has them for the same standardisation.
    x = np.array([[got[i].n_words, got[i].word_chars, got[i].n_symbols] for i in range(320)], float)
    inner = [i for i in range(300) if got[i].distance <= 1]
    assert np.abs(np.log(x[inner, 0]) - np.median(np.log(x[:300, 0]))).max() < 0.7
    kept = {r.doc_id: r for r in quality.verdicts(odd).collect()}
    assert kept[1].base_failed and kept[2].base_failed and kept[3].n_words == 30_000 and len(kept) == 6
    assert quality.verdicts(none).count() == 0


def test_concentration_matches_numpy(spark):
    rng = np.random.default_rng(1)
    z = np.vstack([rng.normal(size=(400, 5)), rng.normal(6, 0.2, size=(60, 5))])
    steps = np.round(z * quality.GRID).astype(int)
    df = spark.createDataFrame([(i, "g", *map(int, r)) for i, r in enumerate(steps)], "id long, g string, z0 long, z1 long, z2 long, z3 long, z4 long")
    far = {r.id: r.d2 for r in quality._distances(df, quality.fit_groups(df)).collect()}
    v = steps / quality.GRID
    m, c = np.zeros(5), np.eye(5)
    for _ in range(50):
        d = np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)
        near = d <= np.sort(d)[int(math.ceil(0.75 * len(d))) - 1]
        m, c = v[near].mean(0), np.cov(v[near].T, bias=True) * quality.CONSISTENCY
        np.fill_diagonal(c, np.maximum(c.diagonal(), 1))
    d = np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(c), v - m)
    assert min(far[i] for i in range(400, 460)) > 5 * quality.CHI2_999 / 2
    assert np.corrcoef([far[i] for i in range(400)], d[:400])[0, 1] > 0.98


# -- 2 ---------------------------------------------------------------------------------

def repeated(rows, length=100):
    seen, out = set(), {}
    for d, t in sorted(rows):
        data = (t or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p:p + length]
            if w in seen:
                mark[p:p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, m in zip(data, mark) if not m)
        spans = sum(1 for i in range(len(mark)) if mark[i] and (i == 0 or not mark[i - 1]))
        out[d] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_repeated_bytes(spark, odd, none):
    rng = random.Random(2)
    base = "".join(rng.choice("ab cé") for _ in range(3000))
    rows = [(0, ""), (1, None), (2, "a" * 500), (3, "ab" * 300), (4, "a" * 99), (5, "a" * 100), (6, "a" * 100)]
    for i in range(7, 90):
        a, n = rng.randrange(2500), rng.randrange(400)
        s, q = base[a:a + n], rng.randrange(n + 1)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(rng.randrange(90))) + s[:q] + rng.choice(["", "Q"]) + s[q:]))
    rng.shuffle(rows)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == repeated(rows)
    kept = suffixes.cleaned(odd, keep_bytes=True).orderBy("doc_id").collect()
    assert len(kept) == 7 and kept[2].n_bytes == 150_000 and len(kept[2].kept) == 150_000 - kept[2].n_removed
    assert suffixes.cleaned(none).count() == 0


# -- 3 ---------------------------------------------------------------------------------

def test_nearest_is_exact():
    rng = random.Random(4)
    terms = [f"t{i:03d}" for i in range(40)]
    counts = [{t: rng.randrange(1, 5) for t in rng.sample(range(40), rng.randrange(0, 6))} for _ in range(500)]
    index = toxicity.Index(terms, counts, [rng.randrange(2) for _ in counts], list(range(500)), (900, 100))
    dense = np.zeros((len(index.ids), 40))
    for e, i in enumerate(index.ids):
        t, w = index.vector(counts[i])
        dense[e, t] = w
    for _ in range(60):
        t, w = index.vector({x: rng.randrange(1, 4) for x in rng.sample(range(40), 3)})
        query = np.zeros(40)
        query[t] = w
        near = index.nearest(t, w)
        want = np.sort(dense @ query)[::-1][:len(near)]
        assert np.allclose([s for s, _ in near], want) and len(near) == min(15, int((dense @ query > 0).sum()))


def test_toxicity(spark, odd, none):
    rng = random.Random(6)
    plain = ["".join(rng.choice("aeioubcdfg") for _ in range(6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        own = rng.sample(plain, 40) + (["horrid", "nasty"] if bad else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_frame(docs, index).collect()}
    test = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i].score >= 0.5) == bool(y) for i, y in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and any(r.evidence for r in got.values())
    blank = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_frame(odd, toxicity.fit(odd, blank)).collect()} == {0.0}
    assert toxicity.score_frame(none, toxicity.fit(none, blank)).count() == 0
    assert toxicity.clean_rows(odd, index).columns == odd.columns


# -- 4 ---------------------------------------------------------------------------------

def test_chat(spark):
    rng = random.Random(7)
    bits = ["[INST]", "[/INST]", "<s>", "</s>", "\\", "[", "x", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]", "\n", "é", "<", "/s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool [/ROLE] <s>", None]),
             rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])) for c in range(30) for t in range(rng.randrange(1, 7))]
    rows += [(99, 0, "user", "hi"), (99, 1, "assistant", "yo"), (98, 0, "assistant", "yo")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS loss")
    got = {r.conv_id: r for r in chat.digest_frame(df).collect()}
    by_conv = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        by_conv[c].append((r or "", x or ""))
    for c, turns in by_conv.items():
        every = hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        learned = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), every, len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[99].in_order and not got[98].in_order
    parts = chat.segments_frame(df).where("conv_id = 99").orderBy("segment").collect()
    assert [(p.content, p.loss) for p in parts] == [("[INST]", False), ("hi", False), ("[/INST]", False), ("<s>", False), ("yo", True), ("</s>", False)]
    assert chat.digest_frame(df.limit(0)).count() == 0 and chat.segments_frame(df.limit(0)).count() == 0


# -- 5 ---------------------------------------------------------------------------------

def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def classes_of(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    label = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    near = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {d: (len(sets[d]), label[d]) for d in ids}


@pytest.mark.parametrize("leaf", [1, 16])
def test_jaccard_join(spark, monkeypatch, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rng = random.Random(leaf)
    vocabulary = [f"w{i}" for i in range(500)]
    shared = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(160):
        kind = rng.randrange(4)
        if kind == 0 or not rows:
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 80))]
        elif kind == 1:
            own = shared[:rng.randrange(20, 60)] + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        else:
            own = rng.choice(rows)[1].split()
            for _ in range(rng.randrange(0, 3)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(df).collect()}
    assert got == classes_of(rows)


def test_jaccard_edges(spark, odd, none):
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(odd).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (5, 1, 4), (5, 1, 4), (6, 4, 6)]
    assert sorted(r.doc_id for r in jaccard.one_of_each(odd).collect()) == [1, 2, 3, 4, 6]
    assert jaccard.join(none).count() == 0


def test_components_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[103] == 100


# -- 6 ---------------------------------------------------------------------------------

def test_surrogates(spark, odd, none):
    texts = ["Mail ann.7@mail3.example.com, ANN.7@MAIL3.EXAMPLE.COM.", "Mrs. Anna Smith met Mr Smith; госпожа Анна Иванова.",
             "call +1 (017) 555-7713 or +1 (017)### 555-7713$$$", "4111 1111 1111 1111 or 4111111111111111 from 10.0.0.1",
             'key "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "In 1999 chapter 3.4 was 12.5 long.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS kinds", "3 AS late")
    out = surrogates.pseudonymise(df)
    assert out.columns == [*df.columns, "n_entities", "entity_kinds"]
    got = [r.text for r in out.orderBy("doc_id").collect()]
    low = re.findall(r"\S+@\S+\.com", got[0], re.I)
    assert low[0].upper() == low[1] and "ann" not in got[0].lower() and got[0].endswith(".")
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr (\w+); госпожа (\w+) (\w+)\.", got[1])
    assert m[2] == m[3] and m[1][-1] == "a" and surrogates.script(m[4]) == "cyrillic" and m[4][-1] in "ая"
    phones = re.findall(r"\d+", got[2])
    assert phones[:4] == phones[4:] and phones[0] == "1"
    numbers = re.match(r"([\d ]{19}) or (\d{16}) from", got[3])
    assert numbers[1].replace(" ", "") == numbers[2] and surrogates.luhn(numbers[2]) % 10 == 0
    assert re.search(r'"[0-9a-f]{40}"', got[4]) and got[5] == texts[5] and got[6] is None and got[7] == ""
    assert [r.text for r in surrogates.pseudonymise(odd).orderBy("doc_id").collect()] == [r[1] for r in ODD]
    assert surrogates.pseudonymise(none).count() == 0


@pytest.mark.parametrize("sent", [50_000, 3])
def test_surrogate_collisions(spark, monkeypatch, sent):
    """With a domain of a few values, distinct entities still get distinct surrogates."""
    monkeypatch.setattr(surrogates, "ENTITIES_SENT", sent)
    hosts = [f"1.2.{a}.{b}" for a in range(1, 4) for b in range(1, 8)]
    real = surrogates.surrogate
    # Draws from 60 addresses, some of which are entities themselves.
    small = lambda key, kind, entity, attempt=0: (
        f"1.2.{1 + (n := surrogates.Stream(key, entity, str(attempt)).below(60)) // 10}.{1 + n % 10}" if kind == "ip" else real(key, kind, entity, attempt))
    monkeypatch.setattr(surrogates, "surrogate", small)
    found = spark.createDataFrame([("ip", h) for h in hosts], "kind string, entity string").repartition(1)
    late = {r.entity: r.attempt for r in _driver_attempts(found, small)}
    new = [small(b"k", "ip", h, late.get(h, 0)) for h in hosts]
    assert len(set(new)) == len(hosts) and not set(new) & set(hosts)


def _driver_attempts(found, draw):
    """The rounds of later_attempts with a draw function that tests set."""
    import panelkit.llm.surrogates as module
    from pyspark.sql import functions as F

    rows = [(r.kind, r.entity) for r in found.collect()]
    table = [(k, e, a, draw(b"k", k, e, a)) for k, e in rows for a in range(60)]
    drawn = found.sparkSession.createDataFrame(table, "kind string, entity string, attempt int, new string")
    return module.settled(found, lambda waiting: waiting.join(F.broadcast(drawn), ["kind", "entity", "attempt"]).select("kind", "entity", "attempt", "new")).collect()


# -- 7 ---------------------------------------------------------------------------------

def test_mixing_edges(spark, odd, none):
    got = mixing.mix_sizes(mixing.sized(odd)).collect()
    assert len(got) == 7 and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix_sizes(mixing.sized(none)).count() == 0
    assert mixing.mixed_rows(odd).columns == odd.columns


def test_highest_quotients(spark):
    rng = random.Random(8)
    votes = {f"s{i:02d}": rng.randrange(0, 1000) for i in range(15)} | {None: 333}
    rows = [(s, float(v), 77) for s, v in votes.items()]
    got = {r.source: r.quota for r in mixing.apportion(spark.createDataFrame(rows, "source string, target double, seats long"), [], "target", "seats", ["source"]).collect()}
    seats = dict.fromkeys(votes, 0)
    for _ in range(77):
        best = max(votes, key=lambda s: (votes[s] / (2 * seats[s] + 1), s is not None, [-ord(c) for c in s or ""]))
        seats[best] += 1
    assert got == seats


# -- 8 ---------------------------------------------------------------------------------

@pytest.mark.parametrize("order", [2, 3])
def test_ngram_model(spark, order):
    rng = random.Random(order)
    vocabulary = [f"v{i}" for i in range(40)]
    texts = [" ".join(rng.choices(vocabulary, weights=range(40, 0, -1), k=rng.randrange(0, 40))) for _ in range(80)] + [None, "", "NEW v1 V2"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learned = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    tokens = lambda t: [*(t or "").lower().split(), "</s>"]
    level, counts = {order: Counter()}, Counter()
    for t in learned:
        counts.update(tokens(t))
        x = ["<s>"] * (order - 1) + tokens(t)
        level[order].update(tuple(x[i:i + order]) for i in range(len(x) - order + 1))
    for k in range(order - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    less, contexts = {}, {}
    for k, grams in level.items():
        n = Counter(grams.values())
        less[k], contexts[k] = kneser.discounts_of((n[1], n[2], n[3], n[4])), defaultdict(lambda: [0, 0, 0, 0])
        for g, c in grams.items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][min(c, 3)] += 1
    total, types = sum(counts.values()), len(counts)

    def chance(h, w, k):
        if k == 0:
            return 1 / (types + 1)
        low = chance(h[1:], w, k - 1)
        if h not in contexts[k]:
            return low
        c, (all_, *ones), d = level[k].get((*h, w), 0), contexts[k][h], less[k]
        return max(c - (d[min(c, 3) - 1] if c else 0), 0) / all_ + sum(x * y for x, y in zip(d, ones)) / all_ * low

    # All words of a context together have chance 1.
    assert math.isclose(sum(chance(("v1",) * (order - 1), w, order) for w in [*counts, "?"]), 1, rel_tol=1e-9)
    model = kneser.train(df.where(~kneser.held_out(df["doc_id"])).select("text"), order)
    assert (model.tokens, model.types) == (total, types)
    got = {r.doc_id: r for r in kneser.score_frame(df, model).collect()}
    for i, t in rows:
        x = tokens(t)
        h = ["<s>"] * (order - 1) + x
        assert got[i].n_tokens == len(x) and got[i].n_known == sum(w in counts for w in x)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in x), rel_tol=1e-9)
        assert math.isclose(got[i].score, sum(math.log10(chance(tuple(h[k:k + order - 1]), x[k], order)) for k in range(len(x))), rel_tol=1e-9)


def test_ngram_edges(spark, odd, none):
    model = kneser.train(none.select("text"))
    got = kneser.score_frame(odd, model).collect()
    assert len(got) == 7 and all(r.score == 0 and r.n_known == 0 for r in got)
    assert kneser.score_frame(none, model).count() == 0
    assert kneser.score_frame(odd, kneser.train(odd.select("text"))).count() == 7


# -- 9 ---------------------------------------------------------------------------------

def test_topk(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6) / 64]) for i in range(400)]
    rows += [(50, rows[50][1]), (1000, None), (1001, [None] * 6), (1050, [float("nan")] * 6), (1100, [float("inf")] + [0.0] * 5),
             (1150, [1.0, 2.0]), (1151, [3.0, 1.0]), (None, rows[0][1]), (1200, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS uid", "3 AS v")
    usable = [(k, i, [math.floor(256 * x) for x in v]) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for k, i, v in usable:
        if i is not None and i % 50 == 0:
            hits = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for m, j, w in usable if m != k and len(w) == len(v))[:5]
            want.update((i, r + 1, None if h[1] else h[2], -h[0]) for r, h in enumerate(hits))
    for chunk in (topk.CHUNK, 3):
        got = Counter(tuple(r) for r in topk.search(df, chunk=chunk).select("query_id", "rank", "vec_id", "score").collect())
        assert got == want
    assert topk.search(df.limit(0)).count() == 0


# -- 10 --------------------------------------------------------------------------------

def test_pieces_equal_the_library(spark, odd, none):
    import sentencepiece

    path = tokenizer_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    own, rng = pieces.load(path), random.Random(10)
    bits = ["a", "e", "th", "er", "in", "  ", " ", "\n", "\t", "é", "ß", "日", "ा", "1", "==", "--", "▁", "x", "ing", " ", "<s>", "\x00", "\U0001f600"]
    texts = ["", " ", "  a  ", "a" * 700, "=-" * 60, "</s><unk>"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(70))) for _ in range(1500)]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True) and own.decode(ids) == library.decode(ids.tolist())
    for _ in range(300):
        ids = np.array([rng.randrange(32_000 if rng.random() < 0.5 else 300) for _ in range(rng.randrange(1, 12))], "<u4")
        assert own.decode(ids) == library.decode(ids.tolist())
    got = {r.doc_id: r for r in pieces.encode_frame(odd, path).collect()}
    assert got[1].ids == [1, 2] and got[3].decoded == LONG
    assert pieces.digest_frame(none, path).count() == 0
