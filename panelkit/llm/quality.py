"""Quality rules: robust multivariate outliers by minimum covariance determinants.

Statistics of each text become five transformed numbers (``FEATURES``). Per language
and source, the location and covariance of the ``core`` share of rows with the
smallest determinant are approached from coordinatewise medians by concentration
steps: distances of all rows, the nearest share of them, their mean and covariance,
until little changes or ten steps are done. One reweighting follows. Rows farther than the ``limit``
quantile of chi-square are rejected. Sources with fewer than ``min_rows`` rows join
the rest of their language, small rests the rest of all; with fewer still, no verdict
is given and rows are kept.

DataFrame functions only. Every step is an aggregation with map-side combination:
quantiles come from counts per bin, moments from exact decimal sums (so results do not
depend on partitioning), and what is joined back has one row per group.

Defined results: a null or empty text has zero for every count and fails the base
rules; null languages and sources are groups like others; a feature that hardly varies
in a group has the floor of its scale as standard deviation; repeated rows each count;
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .stored import small, stored
from .words import SPACES, bind, words_of

SYMBOLS = "#*$%&|<>"
# Name, and the least standard deviation that counts as variation.
FEATURES = {"x_words": 0.3, "x_length": 0.08, "x_symbols": 0.07, "x_lines": 0.25, "x_repeats": 0.15}
D = len(FEATURES)
GRID = 64  # bins of a feature's scale floor, and steps of a standardised value
CHI2_975, CHI2_999 = 12.833, 20.515  # quantiles of chi-square, 5 degrees of freedom
CORE = 0.75
GROUPS_SENT = 20_000  # tables with a row per group are broadcast up to this many
# Makes the covariance of the nearest 75 % of a normal sample that of the sample:
# 0.75 / P(chi2_7 <= q), q the 75 % quantile of chi2_5.
CONSISTENCY = 1.4121


def _repeat_words(words: Column, window: int = 5) -> Column:
    """Words covered by a window of words that is found twice or more in the text."""
    def windows(hashes):
        last = F.size(hashes) - window
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[hashes[i + k] for k in range(window)]))

    def covered(grams):
        def starts(pairs):
            n = F.size(pairs)
            again = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (
                F.when(i > 0, pairs[F.greatest(i - 1, F.lit(0))]["g"] == pairs[i]["g"]).otherwise(False)
                | F.when(i < n - 1, pairs[F.least(i + 1, n - 1)]["g"] == pairs[i]["g"]).otherwise(False)))
            return F.sort_array(F.transform(again, lambda i: pairs[i]["i"]))

        def reach(at):
            n = F.size(at)
            return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda s, i: s + F.when(
                i < n - 1, F.least(F.lit(window), at[F.least(i + 1, n - 1)] - at[i])).otherwise(window))

        pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(
            bind(bind(pairs, starts), reach))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= window, 0).otherwise(bind(bind(hashes, windows), covered))


def base_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text",
                    lang: str = "lang", source: str = "source") -> DataFrame:
    """id, lang, source and the counts of each text."""
    t = F.coalesce(docs[text], F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        docs[id].alias("id"), docs[lang].alias("lang"), docs[source].alias("source"),
        bind(words_of(docs[text]), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate(t, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("u"))).alias("l"),
    ).select(
        "id", "lang", "source", F.col("w.n").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n") - F.col("l.u")).cast("long").alias("n_dup_lines"),
        F.col("w.r").cast("long").alias("n_repeat_words"), F.col("l.n").cast("long").alias("n_lines"))


def _features() -> dict[str, Column]:
    c = F.col
    return {
        "x_words": F.ln(c("n_words")), "x_length": F.ln(c("word_chars") / c("n_words")),
        "x_symbols": F.sqrt(c("n_symbols") / c("word_chars")),
        "x_lines": F.sqrt(c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))),
        "x_repeats": F.sqrt(c("n_repeat_words") / c("n_words")),
    }


def _grouped(rows: DataFrame, min_rows: int) -> DataFrame:
    """Add ``g``: language and source, or the rest that small groups fall to."""
    label = lambda *c: F.to_json(F.struct(*c))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    over = lambda *c: Window.partitionBy(*c)
    few = F.col("n") < min_rows
    rest = sizes.withColumn("rest", F.sum(F.when(few, F.col("n")).otherwise(0)).over(over("lang")))
    g = F.when(~few, label(F.lit("source").alias("by"), "lang", "source")).when(
        F.col("rest") >= min_rows, label(F.lit("lang").alias("by"), "lang")).otherwise(F.lit("{}"))
    known = small(stored(rest.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), g.alias("g"))))
    return rows.join(known, rows["lang"].eqNullSafe(known["_l"]) & rows["source"].eqNullSafe(known["_s"])).drop("_l", "_s")


def _bin_quantiles(counts: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """From rows by.., bin, n: the first bin at which each share of the rows is reached."""
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(whole)})
    return run.groupBy(*by).agg(*[
        F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * s), F.col("bin"))).alias(f"q{k}") for k, s in enumerate(shares)])


NAMES = list(FEATURES)
Z = [f"z{i}" for i in range(D)]
PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]


def _standardised(rows: DataFrame) -> DataFrame:
    """z0..: features less the group's median over its quartile range (not below the floor)."""
    bins = F.array(*[F.struct(F.lit(k).alias("k"), F.floor(F.col(n) / (f / GRID)).alias("bin")) for k, (n, f) in enumerate(FEATURES.items())])
    counts = rows.select("g", F.explode(bins).alias("b")).groupBy("g", "b.k", "b.bin").agg(F.count(F.lit(1)).alias("n"))
    q = _bin_quantiles(counts, ["g", "k"], [0.25, 0.5, 0.75])
    pick = lambda c, k: F.max(F.when(F.col("k") == k, c))
    scale = (F.col("q2") - F.col("q0")) / GRID / 1.349
    found = small(stored(q.groupBy("g").agg(*[
        e for k, f in enumerate(FEATURES.values()) for e in (
            pick((F.col("q1") + 0.5) * (f / GRID), k).alias(f"med{k}"),
            pick(F.greatest(scale, F.lit(1.0)) * f, k).alias(f"sd{k}"))])))
    step = lambda k: F.round((F.col(NAMES[k]) - F.col(f"med{k}")) / F.col(f"sd{k}") * GRID).cast("long")
    return rows.join(found, "g").select("id", "g", *[step(k).alias(Z[k]) for k in range(D)])


def _factor(moments: DataFrame) -> DataFrame:
    """Mean and Cholesky factor from n, sums s.. and cross products p.. of z in steps.

    A variance below 1 (in units of the scale floor or quartile range) is raised to 1."""
    n = F.col("n").cast("double")
    means = moments.withColumns({f"m{i}": F.col(f"s{i}").cast("double") / n for i in range(D)})
    raw = lambda i, j: (F.col(f"p{i}{j}").cast("double") / n - F.col(f"m{i}") * F.col(f"m{j}")) * F.col("inflate") / GRID**2
    out = means.withColumns({f"c{i}{j}": F.greatest(raw(i, j), F.lit(1.0)) if i == j else raw(i, j) for i, j in PAIRS})
    for i in range(D):
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.select("g", "n", *[(F.col(f"m{i}") / GRID).alias(f"m{i}") for i in range(D)], *[f"l{i}{j}" for i, j in PAIRS])


def _distances(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Add d2, the squared distance of z from the fit of its group."""
    out = rows.join(fit.drop("n"), "g")
    for i in range(D):
        y = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"y{k}"), range(i), F.col(Z[i]) / GRID - F.col(f"m{i}"))
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    return out.withColumn("d2", sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(D)), F.lit(0.0))).select("id", "g", *Z, "d2")


def _moments(rows: DataFrame, inflate: float) -> DataFrame:
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    return rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("n"), *[exact(F.col(Z[i])).alias(f"s{i}") for i in range(D)],
        *[exact(F.col(Z[i]) * F.col(Z[j])).alias(f"p{i}{j}") for i, j in PAIRS]).withColumn("inflate", F.lit(inflate))


def fit_groups(z: DataFrame, core: float = CORE, still: float = 0.05, most_steps: int = 10) -> DataFrame:
    """Reweighted minimum-covariance-determinant fits, one row per group of z rows.

    Steps end when no mean or factor moved by more than ``still`` (in units of z)."""
    start = stored(z.groupBy("g").agg(F.count(F.lit(1)).alias("n")))
    # One row per group in every table joined below, so one count settles them all.
    near = F.broadcast if start.limit(GROUPS_SENT + 1).count() <= GROUPS_SENT else lambda side: side
    fit = start.select("g", "n", *[F.lit(0.0).alias(f"m{i}") for i in range(D)],
                       *[F.lit(float(i == j)).alias(f"l{i}{j}") for i, j in PAIRS])
    bin_of = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * 64)
    names = [f"m{i}" for i in range(D)] + [f"l{i}{j}" for i, j in PAIRS]
    gap = reduce(F.greatest, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in names])
    for _ in range(most_steps):
        far = _distances(z, near(fit)).withColumn("bin", bin_of)
        counts = far.groupBy("g", "bin").agg(F.count(F.lit(1)).alias("n"))
        edge = _bin_quantiles(counts, ["g"], [core])
        new = stored(_factor(_moments(far.join(near(edge), "g").where("bin <= q0"), CONSISTENCY)))
        moved = new.alias("a").join(near(fit).alias("b"), "g").agg(F.max(gap)).first()[0]
        fit = new
        if moved is None or moved <= still:
            break
    return stored(_factor(_moments(_distances(z, near(fit)).where(F.col("d2") <= CHI2_975), 1.0)))


def outliers(stats: DataFrame, min_rows: int = 50, limit: float = CHI2_999) -> DataFrame:
    """id, distance (squared, null without a fit) and inlier for rows of base statistics
    that hold at least one word."""
    rows = _grouped(stats.where("n_words > 0").withColumns(_features()), min_rows)
    z = cut(_standardised(rows))
    enough = z.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows).select("g")
    fits = fit_groups(z.join(small(stored(enough)), "g", "left_semi"))
    far = stored(_distances(z, small(fits)).select("id", F.col("d2").alias("distance")))
    unfit = z.join(small(fits.select("g")), "g", "left_anti").select("id", F.lit(None).cast("double").alias("distance"))
    return far.unionByName(unfit).withColumn("inlier", F.col("distance").isNull() | (F.col("distance") <= limit))


def verdicts(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source", min_rows: int = 50, limit: float = CHI2_999) -> DataFrame:
    """One row per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, distance, kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = cut(base_statistics(docs, id, text, lang, source).withColumn("base_failed", failed)
                .withColumn("row", F.monotonically_increasing_id()))
    # Rows that fail the base rules do not shape the estimates.
    judged = outliers(stats.where("not base_failed").withColumn("id", F.col("row")), min_rows, limit).withColumnRenamed("id", "row")
    joined = stats.join(judged, "row", "left")
    return joined.select(
        F.col("id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "distance", (~F.col("base_failed") & F.coalesce("inlier", F.lit(True))).alias("kept"))
