"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Rates r of documents minimise sum(r ln r - r) subject to one token constraint per
source, sum(size r) = target, and r <= 3. The dual is convex in one multiplier per
source, r = min(3, exp(m size / mean)), and is solved by Newton steps kept inside a
bracket. Each step aggregates a table that was pre-aggregated once to (source, size,
documents), so a hot source is never in one task and steps don't read the corpus.
Orders over all sources are range-partitioned running sums, so sources may be many.
Rates are rounded to whole copies: floor(r), and one more for the documents with the
least u / fraction, u a hash of the row, up to the token target. The cut is found by
histograms of that value, refined twice.

Defined results: null text has size 0 and is taken 0 times; a null source is a source
of its own, last in order; a source without words has target 0; with no words at all
every target is 0; rows that repeat share their number of copies; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bytes_of, running, text_of, word_count, written

WEIGHTS = (5, 2, 1)
MOST = 3
BINS = 1024
STEPS = 12
#: Decimal digits of a multiplier.
DIGITS = 9


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(_source, source_size, target) from (_source, source_size): weights in order of code point, null last.

    A source whose weighted share exceeds `most` times its size stops there. By the
    water-filling rule the stopped ones are a prefix in order of size / weight, so one
    pass of running sums finds the level.
    """
    place = [F.col("_source").isNull(), "_source"]
    ranked = running(totals.select("_source", "source_size"), "sources", place, {"_rank": F.lit(1).cast("long")})
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("_rank", F.lit(len(weights))) + 1).cast("int"))
    rows = ranked.withColumn("_w", weight.cast("double")).withColumn("_cap", F.col("source_size") * most / F.col("_w")).drop("_rank")
    rows = running(rows, "caps", ["_cap", *place], {"_size_before": F.col("source_size"), "_w_before": F.col("_w")})
    size, w = rows.agg(F.sum("source_size"), F.sum("_w")).first()
    rows = rows.withColumn("_level", F.try_divide(F.lit(size) - most * F.col("_size_before"), F.lit(w) - F.col("_w_before")))
    # Running up, the first source that its level does not fill sets the level of all that follow.
    free = rows.filter(F.col("source_size") * most >= F.col("_level") * F.col("_w"))
    level = free.agg(F.min(F.struct("_cap", "_level"))["_level"]).first()[0]
    capped = (F.col("source_size") * most).cast("double")
    return rows.select("_source", "source_size", F.least(capped, F.coalesce(F.lit(level).cast("double") * F.col("_w"), capped)).alias("target"))


def _rate(multiplier: Column, size: Column, mean: Column, most: int) -> Column:
    return F.least(F.lit(float(most)), F.exp(F.least(F.coalesce(F.try_divide(multiplier * size, mean), F.lit(0.0)), F.lit(50.0))))


def solve_multipliers(histogram: DataFrame, targets: DataFrame, most: int = MOST, steps: int = STEPS) -> DataFrame:
    """_multiplier per source, by safeguarded Newton steps on the dual.

    histogram: (_key, size, n). The residual grows with the multiplier, so each step also
    shrinks the bracket; a Newton step that leaves it is replaced by its middle. The state
    has a row per source and is broadcast while it is small.
    """
    few = bytes_of(targets) <= BROADCAST_BYTES
    state = targets.select("_key", "target", "_mean", F.lit(0.0).alias("m"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"))
    for step in range(steps):
        rate = _rate(F.col("m"), F.col("size"), F.col("_mean"), most)
        words = F.col("size") * F.col("n")
        slope = F.when(rate < most, F.coalesce(F.try_divide(words * rate * F.col("size"), F.col("_mean")), F.lit(0.0))).otherwise(0.0)
        keep = [F.first(c).alias(c) for c in ("target", "_mean", "m", "lo", "hi")]
        state = histogram.join(F.broadcast(state) if few else state, "_key").groupBy("_key").agg(F.sum(words * rate).alias("_got"), F.sum(slope).alias("_slope"), *keep)
        state = state.withColumn("_over", F.col("_got") - F.col("target"))
        state = state.withColumns({"hi": F.when(F.col("_over") > 0, F.col("m")).otherwise(F.col("hi")), "lo": F.when(F.col("_over") <= 0, F.col("m")).otherwise(F.col("lo"))})
        newton = F.col("m") - F.try_divide(F.col("_over"), F.col("_slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi"))
        state = state.select("_key", "target", "_mean", F.when(inside, newton).otherwise((F.col("lo") + F.col("hi")) / 2).alias("m"), "lo", "hi")
        if step % 4 == 3:
            state = written(state, "multipliers")
    # Sums of doubles may differ in their last digits from run to run; the rates must not.
    return state.select("_key", "_mean", F.round("m", DIGITS).alias("_multiplier"))


def mix(df: DataFrame, *, weights: Sequence[int] = WEIGHTS, most: int = MOST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row's key and copies: _id, _source, _hash, size, source_size, target, rate and copies."""
    text = text_of(text_col)
    key = F.concat(F.when(F.col("_source").isNull(), "0").otherwise("1"), F.coalesce("_source", F.lit("")))
    rows = written(
        df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(text).alias("size"), F.xxhash64(F.lit(17), F.col(id_col).cast("string"), text).alias("_hash"))
        .withColumn("_key", key),
        "sizes",
    )
    histogram = written(rows.groupBy("_key", "_source", "size").agg(F.count("*").alias("n")), "histogram")
    totals = histogram.groupBy("_key", "_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("_docs"))
    targets = source_targets(totals, weights, most).select("source_size", "target", key.alias("_key"))
    targets = written(targets.join(totals.select("_key", F.try_divide(F.col("source_size"), F.col("_docs")).alias("_mean")), "_key"), "targets")
    tilt = written(solve_multipliers(histogram.select("_key", "size", "n"), targets, most), "tilt")
    sources = written(targets.drop("_mean").join(tilt, "_key"), "tilted")
    hint = F.broadcast if bytes_of(sources) <= BROADCAST_BYTES else lambda side: side

    full = F.col("target") >= F.col("source_size") * most
    rate = F.when(full, F.lit(float(most))).otherwise(_rate(F.col("_multiplier"), F.col("size"), F.col("_mean"), most))
    base = F.floor("rate").cast("long")
    u = (F.pmod(F.col("_hash"), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)
    # The order in which rows get one more copy; rows at `most` copies, or without words, get none.
    turn = F.when((F.col("rate") < most) & (F.col("size") > 0), F.try_divide(u, F.col("rate") - base))
    rated = rows.join(hint(sources), "_key").withColumn("rate", rate).withColumn("base", base).withColumn("_turn", F.log2(F.lit(1.0) + turn))
    rated = written(rated.select("_id", "_source", "_key", "_hash", "size", "source_size", "target", "rate", "base", "_turn"), "rates")
    missing = rated.groupBy("_key").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("_left"))
    cut = _cut(rated.filter(F.col("_turn").isNotNull()).select("_key", "_turn", "size"), written(missing, "missing"), hint)
    more = F.col("_turn").isNotNull() & (F.col("_turn") < F.coalesce("_cut", F.lit(0.0)))
    return rated.join(hint(cut), "_key", "left").withColumn("copies", F.col("base") + F.when(more, 1).otherwise(0)).select(
        F.col("_id"), "_source", "_hash", "size", "source_size", "target", "rate", "copies"
    )


def _cut(rows: DataFrame, missing: DataFrame, hint, bins: int = BINS, levels: int = 3) -> DataFrame:
    """(_key, _cut): rows below _cut hold the words that a source still misses, to within the row nearest to it."""
    state = missing.select("_key", F.col("_left"), F.lit(0.0).alias("_from"), F.lit(64.0).alias("_width"))
    for _ in range(levels):
        place = F.floor((F.col("_turn") - F.col("_from")) / F.col("_width") * bins)
        inside = rows.join(hint(state), "_key").filter((F.col("_turn") >= F.col("_from")) & (F.col("_turn") < F.col("_from") + F.col("_width")))
        counts = inside.groupBy("_key", place.alias("_bin")).agg(F.sum("size").alias("_words"))
        run = Window.partitionBy("_key").orderBy("_bin")
        sums = counts.withColumn("_up_to", F.sum("_words").over(run)).join(hint(state), "_key")
        crossing = sums.filter((F.col("_up_to") > F.col("_left"))).groupBy("_key").agg(F.min(F.struct("_bin", "_up_to", "_words")).alias("c"))
        state = state.join(crossing, "_key", "left").select(
            "_key",
            F.when(F.col("c").isNull(), F.col("_left")).otherwise(F.col("_left") - F.col("c._up_to") + F.col("c._words")).alias("_left"),
            F.when(F.col("c").isNull(), F.col("_from") + F.col("_width")).otherwise(F.col("_from") + F.col("c._bin") * F.col("_width") / bins).alias("_from"),
            F.when(F.col("c").isNull(), F.lit(0.0)).otherwise(F.col("_width") / bins).alias("_width"),
            F.coalesce("c._words", F.lit(0)).alias("_next"),
        )
        state = written(state, "cut")
    # The row (or tie) at the cut is taken if that comes nearer to the target.
    return state.select("_key", F.when(F.col("_next") <= 2 * F.col("_left"), F.col("_from") + F.col("_width")).otherwise(F.col("_from")).alias("_cut"))


def take(df: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every row of df as many times as it has copies, with its columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    copies = mix(df, **options).filter("copies > 0").groupBy("_id", "_hash").agg(F.max("copies").alias("_copies")).withColumnRenamed("_id", "_mid").withColumnRenamed("_hash", "_mhash")
    keyed = df.withColumn("_mkey", F.xxhash64(F.lit(17), F.col(id_col).cast("string"), text_of(text_col)))
    joined = keyed.join(copies, keyed[id_col].eqNullSafe(F.col("_mid")) & (F.col("_mkey") == F.col("_mhash")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(*df.columns)
