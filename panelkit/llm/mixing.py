"""Mixing sources to target weights by Sainte-Laguë apportionment of token blocks.

1. A document's size is its number of words. Sources in code point order (null last)
   get the weights in turn and share ``share`` times all sizes; a target stops at
   ``most`` times its source's size and what is over is shared anew by weight. The end
   of that sharing is a level: target = min(cap, weight * level), found from one
   running sum over the sources in order of cap / weight.
2. The blocks of the mix go to sources, and those of a source to its shards, by highest
   quotients target / (2 * seats + 1). Rounding target / block at the common divisor is
   right but for as many seats as the sum is off, so only quotients near it are ranked.
3. A source is dealt by keyed hash into shards of about ``shard_tokens`` tokens, ordered
   by keyed hash and cut into blocks of equal tokens, the last of a shard perhaps shorter. Each shard takes its quota of
   blocks, evenly spaced from a seeded start, again from the beginning when the quota is
   above their number. What a document gives is its overlap with taken blocks, in closed
   form from its place in the shard, so no row per block exists.

DataFrame functions only. Windows run over sources or within a shard, whose size is
bounded by ``shard_tokens`` and one document.

Defined results: a null or empty text has size 0 and is never taken; a null source is a
source; equal ids or repeated rows each count and are told apart by a hash of id and
text, ties by size; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .words import count_words

WEIGHTS = (5.0, 2.0, 1.0)
# Beyond this many shards of a source, its shards grow instead.
MOST_SHARDS = 100_000


def sized(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(docs[id].alias("id"), docs[source].alias("source"), count_words(docs[text]).alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, target. A source is one row here, so
    the windows over all of them see as many rows as there are sources."""
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    by_cap = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = total.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1),
        "cap": F.col("source_size") * most,
        "pool": F.sum("source_size").over(every) * share,
    })
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # With all before at their cap, the level that spends the pool on the rest.
    level = (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = weighed.withColumn("level", level)
    # It rises while sources are found to be over their cap, then falls: the highest holds.
    holds = F.max("level").over(every)
    return levels.withColumn("target", F.least("cap", F.coalesce(F.col("weight") * holds, F.col("cap")))).select(
        "source", "source_size", "target")


def apportion(parties: DataFrame, group: list[str], votes: str, seats: str, order: list[str]) -> DataFrame:
    """Add ``quota``: the seats of each party by highest quotients votes / (2k + 1),
    within each group; ``seats`` names the column with the group's seats, ``order``
    the columns that settle equal quotients."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.col(votes) / F.col("_votes")
    base = parties.withColumns({"_votes": F.sum(votes).over(whole), "_parties": F.count(F.lit(1)).over(whole)})
    near = F.round(share * F.col(seats)).cast("long")
    # Away from the common divisor by at most this many seats of the party.
    reach = (F.lit(2) + F.ceil(F.lit(1.5) * share * F.col("_parties"))).cast("long")
    some = (F.col("_votes") > 0) & (F.col(votes) > 0)
    near, reach = F.when(some, near).otherwise(F.lit(0)), F.when(some, reach).otherwise(F.lit(0))
    sure = base.withColumn("_sure", F.greatest(near - reach, F.lit(0)).cast("long")).withColumns({
        "_try": F.when(some, reach * 2).otherwise(F.lit(0)), "_given": F.sum("_sure").over(whole)})
    tries = sure.where("_try > 0").select(
        *group, *[c for c in order if c not in group], votes, F.col(seats).alias("_seats"),
        "_given", F.explode(F.sequence(F.col("_sure"), F.col("_sure") + F.col("_try"))).alias("_seat"))
    ranked = whole.orderBy((F.col(votes) / (2 * F.col("_seat") + 1)).desc(), *[F.col(c).asc_nulls_last() for c in order])
    keys = list(dict.fromkeys([*group, *order]))
    won = tries.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.col("_seats") - F.col("_given")).groupBy(
        *keys).agg(F.count(F.lit(1)).alias("_won"))
    left, right = sure.alias("l"), won.alias("r")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same, "left").select(
        *[F.col(f"l.{c}") for c in parties.columns], (F.col("l._sure") + F.coalesce(F.col("r._won"), F.lit(0))).alias("quota"))


def _hash01(*parts: Column) -> Column:
    """A number from 0 to 2^48 from a keyed digest, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12), 16, 10).cast("long")


def mix_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0,
              block_tokens: int = 16, shard_tokens: int = 1_000_000, seed: str = "mix") -> DataFrame:
    """Take from rows id, source, size: id, source, size, source_size, target, taken."""
    sizes = cut(sizes)
    sources = cut(targets(sizes, weights, share, most).withColumn(
        "shards", F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_tokens))).cast("long")))
    all_sources = Window.partitionBy(F.lit(0))
    quotas = cut(apportion(
        sources.withColumn("_blocks", F.round(F.sum("target").over(all_sources) / block_tokens).cast("long")),
        [], "target", "_blocks", ["source"]).withColumnRenamed("quota", "source_quota").drop("_blocks"))

    rows = sizes.alias("d").join(F.broadcast(quotas).alias("s") if _few(quotas) else quotas.alias("s"),
                                 F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.shards")
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = rows.withColumn("shard", _hash01(F.lit(f"{seed}-shard"), key) % F.col("shards"))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("tokens")).alias("t").join(
        quotas.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "s.source_quota")
    dealt = apportion(shards, ["source"], "tokens", "source_quota", ["shard"]).withColumns({
        "blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / block_tokens)).cast("long"),
    }).withColumns({
        "quota": F.least(F.col("quota"), F.floor(F.col("blocks") * most)).cast("long"),
        "start": _hash01(F.lit(f"{seed}-start"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")), F.col("shard").cast("string")) % F.col("blocks"),
    }).select("source", "shard", "tokens", "blocks", "quota", "start")
    dealt = cut(dealt)
    within = Window.partitionBy("source", "shard").orderBy(
        _hash01(F.lit(f"{seed}-order"), key), F.col("id").asc_nulls_last(), F.col("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("to", F.sum("size").over(within))
    joined = placed.alias("p").join(F.broadcast(dealt).alias("q") if _few(dealt) else dealt.alias("q"),
                                    F.col("p.source").eqNullSafe(F.col("q.source")) & (F.col("p.shard") == F.col("q.shard")))
    taken = F.when(F.col("p.size") > 0, taken_before(F.col("p.to"), block_tokens) - taken_before(F.col("p.to") - F.col("p.size"), block_tokens)).otherwise(F.lit(0))
    return joined.select("p.id", "p.source", "p.size", "p.source_size", "p.target", taken.cast("long").alias("taken"))


def taken_before(x: Column, block_tokens: int) -> Column:
    """Tokens taken from the first ``x`` tokens of a shard: full passes, then of the
    rest r the blocks in which the multiples of r / blocks pass a whole number."""
    blocks, quota, start = (F.col(f"q.{c}") for c in ("blocks", "quota", "start"))
    rest = F.pmod(quota, blocks)
    begun = F.floor(x / block_tokens)
    picks = lambda i: F.floor((i + start) * rest / blocks) - F.floor(start * rest / blocks)
    into = (picks(begun + 1) - picks(begun)) * (x - begun * block_tokens)
    return F.floor(quota / blocks) * x + picks(begun) * block_tokens + into


def _few(df: DataFrame, rows: int = 20_000) -> bool:
    """Whether a table of short rows is small enough to send to every task."""
    return df.limit(rows + 1).count() <= rows


def mixed_rows(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
               seed: str = "mix", rows_sent: int = 400_000, shard_tokens: int = 1_000_000, **options) -> DataFrame:
    """The rows of the mix, with all their columns: a row stays as often as its tokens are
    taken. Whole passes are whole copies. Parts of a pass become copies by rounding their
    running sum over the documents of a shard in order of size, so that each shard (a source
    of up to ``shard_tokens`` words has one) meets its tokens within its largest document.
    Rows of one id, source and size count as one document. Null texts, and texts without
    words, are not in the mix; an empty table gives an empty mix."""
    columns = docs.columns
    taken = mix_sizes(sized(docs, id, text, source), seed=seed, shard_tokens=shard_tokens, **options).where("size > 0").groupBy(
        "id", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"), F.max("source_size").alias("source_size"))
    key = F.concat_ws("|", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("size").cast("string"))
    times = F.col("taken") / F.col("n") / F.col("size")
    shards = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARDS), F.ceil(F.col("source_size") / shard_tokens))).cast("long")
    # Billionths, so that sums do not depend on their order.
    split = taken.withColumns({"whole": F.floor(times), "part": F.round((times - F.floor(times)) * 1e9).cast("long"),
                               "shard": _hash01(F.lit(f"{seed}-copy-shard"), key) % shards})
    by_size = Window.partitionBy("source", "shard").orderBy(
        F.col("n") * F.col("size"), _hash01(F.lit(f"{seed}-copy"), key), F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = lambda x: F.floor((x + 500_000_000) / 1_000_000_000)
    copies = split.withColumn("sum", F.sum("part").over(by_size)).select(
        "id", "source", "size", (F.col("whole") + nearest(F.col("sum")) - nearest(F.col("sum") - F.col("part"))).alias("copies")).where("copies > 0")
    copies = cut(copies)
    few = F.broadcast(copies) if _few(copies, rows_sent) else copies
    rows = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    own = {c: F.col(f"c{columns.index(c)}") for c in (id, text, source)}
    joined = rows.withColumn("_size", count_words(own[text])).join(
        few, own[id].eqNullSafe(F.col("id")) & own[source].eqNullSafe(F.col("source")) & (F.col("_size") == F.col("size")))
    return joined.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("col").toDF(*columns)
