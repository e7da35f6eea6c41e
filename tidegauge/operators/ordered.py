"""Work along an order that no single task could hold.

A window over one key, or over a whole table, runs in one task. These operators cut such an order into
slices first: rows are range-partitioned, each slice is summed on its own, and a small table of slice
totals carries the sums across. Every step is bounded by the slice size, whatever the key distribution.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.session import settle

SLICE, SLOT = "_slice", "_slot"
ROWS_PER_SLICE_BITS = 33


def sliced(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition and sort by ``order``; number the slices and the rows inside them.

    The range bounds come from a sample, so the result is written out once: a recomputed task
    must not see other bounds.
    """
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    identified = settle(ordered.withColumn("_id", F.monotonically_increasing_id()))
    return identified.select(
        *df.columns,
        F.shiftright("_id", ROWS_PER_SLICE_BITS).cast("int").alias(SLICE),
        F.col("_id").bitwiseAND((1 << ROWS_PER_SLICE_BITS) - 1).alias(SLOT),
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    measures: Mapping[str, Column],
    totals: bool = False,
) -> DataFrame:
    """Add inclusive running sums of ``measures`` along ``order`` within ``keys``.

    ``order`` should be total within a key; ties are summed in an arbitrary but fixed sequence. With
    ``totals`` the key's whole sum is added as ``<name>_total``; it comes from the slice totals.
    """
    parts = sliced(
        df.select("*", *[column.alias(f"_m_{name}") for name, column in measures.items()]),
        [*keys, *order],
    )
    inside = Window.partitionBy(SLICE, *keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    local = parts.select("*", *[F.sum(f"_m_{name}").over(inside).alias(f"_l_{name}") for name in measures])
    carry = (
        parts.groupBy(SLICE, *keys)
        .agg(*[F.sum(f"_m_{name}").alias(f"_t_{name}") for name in measures])
        .select(
            F.col(SLICE).alias("_s"),
            *[F.col(k).alias(f"_k_{k}") for k in keys],
            *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_c_{name}") for name in measures],
            *[F.sum(f"_t_{name}").over(whole).alias(f"{name}_total") for name in measures if totals],
        )
    )
    matched = F.col(SLICE) == F.col("_s")
    for key in keys:
        matched = matched & F.col(key).eqNullSafe(F.col(f"_k_{key}"))
    return local.join(carry, matched).select(
        *df.columns, *[(F.col(f"_l_{name}") + F.col(f"_c_{name}")).alias(name) for name in measures],
        *[F.col(f"{name}_total") for name in measures if totals],
    )


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Add the 1-based position along ``order`` within ``keys``, for keys of any length."""
    return running_totals(df, keys, order, {name: F.lit(1).cast("long")})


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per entry of ``probabilities``.

    Equal values are counted before the shuffle, so memory never holds a group; keys may be empty.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    joined = running_totals(counts, keys, [value], {"_through": F.col("_n")}, totals=True)
    first, picks = F.col("_through") - F.col("_n"), []
    for name, p in probabilities.items():
        place = (F.col("_through_total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            covers = (first <= rank) & (rank < F.col("_through"))
            picks.append(F.max(F.when(covers, F.col(value))).alias(f"_{side}_{name}"))
        picks.append(F.max(place - F.floor(place)).alias(f"_w_{name}"))
    found = joined.groupBy(*keys).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in probabilities
        ],
    )


def over_series(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    build: Callable[[WindowSpec], Mapping[str, Column]],
    *,
    back: int = 0,
    ahead: int = 0,
    max_rows: int | None = None,
) -> DataFrame:
    """Add window columns whose frames look at most ``back`` rows back and ``ahead`` rows ahead.

    ``max_rows`` is the longest series one task may hold. Leave it out where the row count per key is
    bounded by construction, as in a panel with one row per key and day. Longer keys are cut into chunks
    by position; each chunk also receives the rows of its neighbours that its frames can see, so the
    result is the same as with one window.
    """
    plain = Window.partitionBy(*keys).orderBy(*order)

    def with_columns(part: DataFrame, spec: WindowSpec) -> DataFrame:
        return part.select("*", *[column.alias(name) for name, column in build(spec).items()])

    if max_rows is None:
        return with_columns(df, plain)
    long_keys = df.groupBy(*keys).count().filter(F.col("count") > max_rows)
    long_keys = settle(long_keys.select(*[F.col(k).alias(f"_long_{k}") for k in keys]))
    if long_keys.isEmpty():
        return with_columns(df, plain)
    same = None
    for key in keys:
        test = F.col(key).eqNullSafe(F.col(f"_long_{key}"))
        same = test if same is None else same & test
    short = with_columns(df.join(long_keys, same, "left_anti"), plain)

    size = max(max_rows, back, ahead)
    numbered = row_numbers(df.join(long_keys, same, "left_semi"), keys, order, "_pos")
    home = F.floor((F.col("_pos") - 1) / size).cast("long")
    inside = F.pmod(F.col("_pos") - 1, F.lit(size))
    wanted = F.array(
        home,
        F.when(inside >= size - back, home + 1),
        F.when((inside < ahead) & (home > 0), home - 1),
    )
    copies = numbered.withColumn("_home", home).withColumn("_chunk", F.explode(F.array_compact(wanted)))
    chunked = with_columns(copies, Window.partitionBy(*keys, "_chunk").orderBy(*order))
    own = chunked.filter(F.col("_chunk") == F.col("_home")).drop("_home", "_chunk", "_pos")
    return short.unionByName(own)


AGE = 300.0  # a block of an exponential mean: what is older than a whole block weighs less than exp(-300)


def exponential_mean(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str,
    span: int = 9, max_rows: int | None = None,
) -> DataFrame:
    """Causal exponentially weighted mean (first value seeds it) without walking a series row by row.

    Weights decay by position, so a value behind missing ones counts for more; a row whose value is missing repeats the
    mean before it, and rows before the first value have none. ``order`` should be total within a key.

    Each value takes the mean to (d m + alpha x) / (d + alpha) with d = (1 - alpha)^gap. That is linear, so along the
    running sum of the decays' logarithms (the age) a block of it is a weighted prefix sum plus what the block before
    passes on; anything older is below one part in 1e130. Blocks hold at most AGE / -log(1 - alpha) values, whatever the
    key. With ``max_rows`` the keys may have any length, else one key's rows are sorted in one task.
    """
    alpha = 2.0 / (span + 1)
    known = F.col(value).isNotNull()
    ones, seen = F.lit(1).cast("long"), F.when(known, 1).otherwise(0).cast("long")
    if max_rows is None:
        return _mean_in_key(df, keys, order, value, name, alpha)
    placed = settle(running_totals(df, keys, order, {"_pos": ones, "_seen": seen}))
    holes = placed.filter(~known).groupBy(*keys, (F.col("_seen") + 1).alias("_next")).agg(F.count("*").alias("_holes"))
    present = _null_safe_left(placed.filter(known), holes, [*keys, "_seen"], [*keys, "_next"])
    present = present.withColumn("_gap", F.when(F.col("_seen") > 1, 1 + F.coalesce("_holes", F.lit(0)))).drop("_holes")

    share, fading = _share_and_fading(F.col(value), F.col("_gap"), alpha)
    present = present.select(*keys, "_seen", share.alias("_share"), fading.alias("_fading"))
    aged = running_totals(present, keys, ["_seen"], {"_age": F.col("_fading")})
    blocks = aged.withColumn("_block", F.floor(F.col("_age") / AGE)).withColumn("_rest", F.col("_age") - F.col("_block") * AGE)
    inside = Window.partitionBy(*keys, "_block").orderBy("_seen").rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("_local", F.sum(F.col("_share") * F.exp("_rest")).over(inside) * F.exp(-F.col("_rest")))
    tails = blocks.groupBy(*keys, (F.col("_block") + 1).alias("_next")).agg(F.sum(F.col("_share") * F.exp(F.col("_rest") - AGE)).alias("_carry"))
    means = _null_safe_left(local, tails, [*keys, "_block"], [*keys, "_next"]).select(
        *keys, "_seen", (F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * F.exp(-F.col("_rest"))).alias(name))
    return _null_safe_left(placed, means, [*keys, "_seen"], [*keys, "_seen"]).select(*df.columns, name)


def _share_and_fading(value: Column, gap: Column, alpha: float) -> tuple[Column, Column]:
    """What a value adds to the mean, and minus the logarithm of what it leaves of the mean before; ``gap`` is NULL for the first."""
    decay = F.exp(gap * F.lit(math.log(1.0 - alpha)))
    share = F.when(gap.isNull(), value).otherwise(F.lit(alpha) * value / (decay + F.lit(alpha)))
    return share, F.when(gap.isNull(), F.lit(0.0)).otherwise(F.log(decay + F.lit(alpha)) - gap * F.lit(math.log(1.0 - alpha)))


def _mean_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str, alpha: float) -> DataFrame:
    """The exponential mean where a key's rows are in one task anyway: windows only, so rows are dealt out once.

    A row without a value adds nothing and lets nothing fade, which repeats the mean before it.
    """
    known, before = F.col(value).isNotNull(), Window.unboundedPreceding
    placed = df.withColumn("_pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    along = Window.partitionBy(*keys).orderBy("_pos")
    last = F.max(F.when(known, F.col("_pos"))).over(along.rowsBetween(before, -1))
    seen = placed.withColumns({"_gap": F.when(known, F.col("_pos") - last), "_any": F.max(known).over(along.rowsBetween(before, 0))})
    share, fading = (F.when(known, x).otherwise(0.0) for x in _share_and_fading(F.col(value), F.col("_gap"), alpha))
    aged = seen.withColumn("_share", share).withColumn("_age", F.sum(fading).over(along.rowsBetween(before, 0)))
    blocks = aged.withColumn("_block", F.floor(F.col("_age") / AGE)).withColumn("_rest", F.col("_age") - F.col("_block") * AGE)
    block = Window.partitionBy(*keys, "_block")
    sums = blocks.withColumns({
        "_local": F.sum(F.col("_share") * F.exp("_rest")).over(block.orderBy("_pos").rowsBetween(before, 0)) * F.exp(-F.col("_rest")),
        "_whole": F.sum(F.col("_share") * F.exp(F.col("_rest") - AGE)).over(block.orderBy("_pos").rowsBetween(before, Window.unboundedFollowing)),
    })
    # the first row of a block meets the block before it, if that is the one just below
    carry = F.when(F.lag("_block").over(along) == F.col("_block") - 1, F.lag("_whole").over(along))
    met = sums.withColumn("_carry", carry).withColumn("_carry", F.max("_carry").over(block))
    mean = F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * F.exp(-F.col("_rest"))
    return met.select(*df.columns, F.when(F.col("_any"), mean).alias(name))


def _null_safe_left(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """Left join in which NULL keys are equal; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(right_keys)], *[c for c in right.columns if c not in right_keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(left_keys)])
    return left.join(renamed, same, "left").drop(*[f"_r{i}" for i in range(len(right_keys))])
