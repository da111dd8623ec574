"""The registered queries: each operator on its whole table, and its SQL if SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import load
from . import chat, jaccard, kneser, mixing, multiindex, phrases, pieces, quality, runs, suffixes, surrogates, topk, toxicity
from .registry import ORACLE, QUERIES, query  # noqa: F401
from .words import bind, words_of

TOKENIZER = "piece_bpe_32k.model"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_chat_formatting", "conversations")
def op4(rows: DataFrame, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    added = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    own = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digest_frame(own.unionByName(added))


MIX_SQL = r"""
WITH d AS (SELECT doc_id AS id, source,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
             source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS pool FROM src),
lv AS (SELECT *, (pool - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
tg AS (SELECT source, source_size, least(cap, coalesce(weight * max(level) OVER (), cap)) AS target FROM lv),
ss AS (SELECT *, greatest(1, least(100000, ceil(source_size / 1000000.0)))::BIGINT AS shards,
             round(sum(target) OVER () / 16)::BIGINT AS seats, sum(target) OVER () AS votes FROM tg),
q1 AS (SELECT source, k, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS r, seats
       FROM (SELECT *, unnest(range((2 * target / 16)::BIGINT + 10)) AS k FROM ss WHERE target > 0)),
sq AS (SELECT ss.*, (SELECT count(*) FROM q1 WHERE q1.source IS NOT DISTINCT FROM ss.source AND r <= q1.seats) AS source_quota FROM ss),
dd AS (SELECT d.*, source_size, target,
              ('0x' || substr(md5('mix-shard|' || coalesce(id::VARCHAR, '')), 1, 12))::BIGINT % shards AS shard
       FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
sh AS (SELECT dd.source, shard, sum(size)::BIGINT AS tokens, any_value(source_quota) AS source_quota
       FROM dd JOIN sq ON dd.source IS NOT DISTINCT FROM sq.source GROUP BY ALL),
q2 AS (SELECT source, shard, source_quota, row_number() OVER (PARTITION BY source ORDER BY tokens / (2 * k + 1) DESC, shard) AS r
       FROM (SELECT *, unnest(range((4 * tokens / 16)::BIGINT + 10)) AS k FROM sh WHERE tokens > 0)),
shq AS (SELECT sh.*, greatest(1, ceil(tokens / 16))::BIGINT AS blocks,
              (SELECT count(*) FROM q2 WHERE q2.source IS NOT DISTINCT FROM sh.source AND q2.shard = sh.shard AND r <= q2.source_quota) AS won FROM sh),
pl AS (SELECT *, least(won, blocks * 2)::BIGINT AS quota,
             ('0x' || substr(md5('mix-start|' || coalesce('s' || source, 'null') || '|' || shard), 1, 12))::BIGINT % blocks AS st FROM shq),
cs AS (SELECT dd.*, pl.blocks, pl.quota, pl.st, (quota % blocks)::BIGINT AS rest,
              sum(size) OVER (PARTITION BY dd.source, dd.shard
                ORDER BY ('0x' || substr(md5('mix-order|' || coalesce(id::VARCHAR, '')), 1, 12))::BIGINT, id NULLS LAST, size
                ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
       FROM dd JOIN pl ON dd.source IS NOT DISTINCT FROM pl.source AND dd.shard = pl.shard),
ed AS (SELECT *, upto - size AS x0, (upto - size) // 16 AS b0, upto // 16 AS b1 FROM cs)
SELECT id AS doc_id, size, source_size, target,
  CASE WHEN size > 0 THEN (quota // blocks) * size
    + 16 * ((b1 + st) * rest // blocks - (b0 + st) * rest // blocks)
    + ((b1 + 1 + st) * rest // blocks - (b1 + st) * rest // blocks) * (upto - 16 * b1)
    - ((b0 + 1 + st) * rest // blocks - (b0 + st) * rest // blocks) * (x0 - 16 * b0) ELSE 0 END::BIGINT AS taken
FROM ed
"""


@query("op7_mix_sources", "documents", MIX_SQL)
def op7(docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sizes(mixing.sized(docs))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op10_piece_encoding", "documents")
def op10(docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digest_frame(docs, tokenizer_path())


@query("op1_quality_outliers", "documents")
def op1(docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.verdicts(docs)


@query("op3_toxicity", "documents")
def op3(docs: DataFrame, sf_dir: str) -> DataFrame:
    index = toxicity.fit(docs, load(docs.sparkSession, sf_dir, "labels"))
    return toxicity.score_frame(docs, index).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "likeness")


TOPK_SQL = """
WITH v AS (SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query("op9_exact_topk", "embeddings", TOPK_SQL)
def op9(rows: DataFrame, sf_dir: str) -> DataFrame:
    return topk.search(rows)


JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
                     FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.d WHERE r.c < l.b)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(c) FROM r WHERE d = documents.doc_id) AS component_id
FROM documents LEFT JOIN n USING (doc_id)
"""


@query("op5_jaccard_join", "documents", JACCARD_SQL)
def op5(docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.join(docs, k=4, percent=85)


@query("op2_repeated_bytes", "documents")
def op2(docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.cleaned(docs)


@query("op6_surrogates", "documents")
def op6(docs: DataFrame, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymise(docs).select("doc_id", "text", "n_entities", "entity_kinds")


@query("op8_ngram_model", "documents")
def op8(docs: DataFrame, sf_dir: str) -> DataFrame:
    out = kneser.held_out(F.col("doc_id"))
    model = kneser.train(docs.where(~out).select("text"), order=3)
    return kneser.score_frame(docs, model).select(
        "doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query("op13_inverted_multi_index", "embeddings")
def op13(rows: DataFrame, sf_dir: str) -> DataFrame:
    return multiindex.search(rows)


PHRASE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM t),
g AS (SELECT lang, m, w[i:i + m - 1] AS p FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w CROSS JOIN (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, p, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.p, k.a, k.k, x.a AS l, y.a AS r, (1000000::HUGEINT * k.a * k.a // (x.a::HUGEINT * y.a))::BIGINT AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.p = k.p[:k.k] JOIN f y ON y.lang = k.lang AND y.p = k.p[k.k + 1:]
      QUALIFY row_number() OVER (PARTITION BY k.lang, k.p ORDER BY score, k.k) = 1),
o AS (SELECT lang, p, max(a) AS over FROM (SELECT lang, a, p[:2] AS p FROM c WHERE m = 3 UNION ALL SELECT lang, a, p[2:] FROM c WHERE m = 3) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, array_to_string(s.p, ' ')) AS rank, array_to_string(s.p, ' ') AS phrase,
       s.a, s.l, s.r, n.n, score
FROM s JOIN n ON n.lang = s.lang LEFT JOIN o ON o.lang = s.lang AND o.p = s.p WHERE over IS NULL OR 100 * over < 50 * s.a
QUALIFY rank <= 2000
"""


@query("op11_phrases", "documents", PHRASE_SQL)
def op11(docs: DataFrame, sf_dir: str) -> DataFrame:
    return phrases.collocations(docs)


def _made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id, text; in about a tenth of the texts the words from one on repeat a block."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rewrite(words):
        n = F.size(words)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + F.pmod(i, p)))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " "))

    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, bind(words_of(F.col("text")), rewrite)).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs", "documents")
def op12(docs: DataFrame, sf_dir: str) -> DataFrame:
    found = runs.find(_made_periodic(docs))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.withColumn("first", F.when(F.size("runs") > 0, first)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("first.start").alias("start"), (-F.col("first.less")).alias("length"),
        F.col("first.period").alias("period"), F.expr("(-1000 * first.less) div first.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
