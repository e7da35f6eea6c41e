"""Audits of a raw measurement table and the aggregates behind its exploratory charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.columns import log_bucket, ratio, reaches_or_zero
from tidegauge.operators.ordered import exact_quantiles, over_series, running_totals
from tidegauge.session import settle

# Default edges of the gap buckets in days, left-open.
GAP_EDGES = (0, 2, 4, 8, 14, 31, 100000)
EXCEEDANCE_THRESHOLDS = (1000, 10000, 100000, 1000000)


def known(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Rows whose key the master lists."""
    return df.join(master.select(key).distinct(), key, "left_semi")


def unknown(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Keys the master does not list, with their row counts; a NULL key is not a code."""
    codes = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("row_count"))
    return codes.join(master.select(key), key, "left_anti")


def with_attributes(df: DataFrame, master: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Left-join master attributes; no broadcast hint, Spark picks the join from the measured size."""
    return df.join(master.select(key, *columns), key, "left")


def gap_days(panel: DataFrame, key: str, day: str, max_rows: int | None = None) -> DataFrame:
    """Days between consecutive measurements of a key."""

    def build(w: WindowSpec) -> Mapping[str, Column]:
        return {"gap_days": F.datediff(F.col(day), F.lag(day).over(w))}

    return over_series(panel.select(key, day), [key], [day], build, back=1, max_rows=max_rows).filter(
        "gap_days is not null"
    )


def gap_statistics(gaps: DataFrame, edges: Sequence[float] = GAP_EDGES) -> DataFrame:
    """Median, mean and the share of each left-open bucket, one row per bucket.

    Gaps are whole days, so equal ones are counted first and the median needs no list of rows.
    """
    counts = gaps.groupBy("gap_days").agg(F.count("*").alias("n"))
    shares = [
        F.coalesce(F.sum(F.when((F.col("gap_days") > lo) & (F.col("gap_days") <= hi), F.col("n"))), F.lit(0)).alias(f"_b{i}")
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    ]
    total = counts.agg(
        (F.sum(F.col("gap_days") * F.col("n")) / F.sum("n")).alias("gap_mean"),
        F.expr("percentile(gap_days, 0.5, n)").alias("gap_median"),
        *shares,
    )
    buckets = [
        F.struct(F.lit(i).alias("bucket"), F.lit(float(lo)).alias("above"), F.lit(float(hi)).alias("up_to"),
                 F.col(f"_b{i}").alias("n"))
        for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))
    ]
    counted = " + ".join(f"_b{i}" for i in range(len(edges) - 1))
    return total.select("gap_mean", "gap_median", F.expr(counted).alias("_all"), F.explode(F.array(*buckets)).alias("b")).select(
        "b.bucket", "b.above", "b.up_to", "b.n", ratio(F.col("b.n"), F.col("_all")).alias("share"), "gap_mean", "gap_median"
    )


def exceedance(df: DataFrame, value: str, thresholds: Sequence[float] = EXCEEDANCE_THRESHOLDS) -> DataFrame:
    """Rate and count at or above each threshold among measured rows; one scan for all thresholds."""
    counted = df.agg(F.count(value).alias("_n"), *[
        F.count_if(F.col(value) >= t).alias(f"_t{i}") for i, t in enumerate(thresholds)
    ])
    rows = [F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_t{i}").alias("n")) for i, t in enumerate(thresholds)]
    return counted.select("_n", F.explode(F.array(*rows)).alias("r")).select(
        "r.threshold", "r.n", ratio(F.col("r.n"), F.col("_n")).alias("rate")
    )


def monthly_exceedance(df: DataFrame, day: str, value: str, threshold: float = 1000) -> DataFrame:
    """Measurements per month and the share at or above the threshold among measured rows."""
    return df.groupBy(F.month(day).alias("month")).agg(
        F.count("*").alias("measurements"),
        F.avg((F.col(value) >= threshold).cast("int")).alias("exceed_rate"),
    )


def coverage(master: DataFrame, df: DataFrame, key: str, kind: str) -> DataFrame:
    """Keys with data and all keys, by kind."""
    seen = df.select(key).distinct().withColumn("_seen", F.lit(1))
    return master.join(seen, key, "left").groupBy(kind).agg(
        F.count("_seen").alias("with_data"), F.count("*").alias("all_keys")
    )


def describe(values: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation and quartiles of one column."""
    values = settle(values.select(column))
    basics = values.agg(
        F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )
    quartiles = exact_quantiles(values, [], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basics.join(quartiles, F.lit(True), "left")  # one row each


def rows_per_key(df: DataFrame, key: str) -> DataFrame:
    return describe(df.groupBy(key).agg(F.count("*").alias("row_count")), "row_count")


def completeness(df: DataFrame, key: str, day: str, value: str, measures: Sequence[str]) -> DataFrame:
    """One row: size, span, duplicate keys, missing share, rows without any measure."""
    per_key_day = df.groupBy(key, day).agg(
        F.count("*").alias("n"),
        F.count_if(F.col(value).isNull()).alias("missing"),
        F.count_if(F.coalesce(*measures).isNull()).alias("empty"),
        F.max(value).alias("top"),
    )
    per_key = per_key_day.groupBy(key).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("copies"), F.sum("missing").alias("missing"),
        F.sum("empty").alias("empty"), F.max("top").alias("top"), F.min(day).alias("first"), F.max(day).alias("last"),
    )
    return per_key.agg(
        F.sum("n").alias("row_count"),
        F.count(key).alias("key_count"),
        F.min("first").alias("date_min"),
        F.max("last").alias("date_max"),
        F.sum("copies").alias("duplicate_rows"),
        (F.sum("missing") / F.sum("n")).alias("missing_rate"),
        F.sum("empty").alias("empty_rows"),
        F.max("top").alias("value_max"),
    )


def positive_share(df: DataFrame, kind: str, value: str) -> DataFrame:
    return df.groupBy(kind).agg(F.avg((F.col(value) > 0).cast("int")).alias("positive_share"))


def group_rates(df: DataFrame, group: Column | str, value: str, threshold: float = 1000) -> DataFrame:
    """Exceedance rate per group, a missing value counting as "not exceeded", and the group size."""
    return df.groupBy(group).agg(
        F.avg(reaches_or_zero(F.col(value), threshold)).alias("rate"), F.count("*").alias("n")
    )


def group_medians(df: DataFrame, group: str, value: str) -> DataFrame:
    return exact_quantiles(df, [group], value, {"median": 0.5})


def log_histogram(df: DataFrame, value: str, width: float) -> DataFrame:
    """Rows per bin of log10(value + 1)."""
    return df.filter(F.col(value).isNotNull()).groupBy(log_bucket(F.col(value), width).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col(value) == 0).alias("zeros")
    )


def top_groups(df: DataFrame, key: str, name: str, value: str, threshold: float = 1000,
               min_rows: int = 100, k: int = 12) -> DataFrame:
    """The k keys with the highest exceedance rate among those with enough rows; ties by key."""
    rates = df.groupBy(key).agg(
        F.min(name).alias(name), F.avg(reaches_or_zero(F.col(value), threshold)).alias("rate"), F.count("*").alias("n")
    )
    return rates.filter(F.col("n") >= min_rows).orderBy(F.desc("rate"), key).limit(k)


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, mean, deviation and quartiles of several columns, one row per column."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    basics = long.groupBy("column_name").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    return basics.join(
        exact_quantiles(long, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}), "column_name", "left"
    )


def clip_normalised(df: DataFrame, columns: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Each column scaled to [0, 1] between two of its quantiles."""
    cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    bounds = settle(exact_quantiles(long, ["column_name"], "value", {"lo": low, "hi": high}))
    out = df
    for c in columns:
        lo, hi = (bounds.filter(F.col("column_name") == c).select(b).scalar() for b in ("lo", "hi"))
        scaled = (F.col(c) - lo) / (hi - lo + F.lit(1e-9))
        out = out.withColumn(f"{c}_scaled", F.when(F.col(c).isNotNull(), F.greatest(F.least(scaled, F.lit(1.0)), F.lit(0.0))))
    return out


def spearman(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Rank correlation of column pairs over the rows where both are present, average ranks on ties.

    Pairs that are complete in the same rows share their ranks, so a column is ranked once for each such set of rows, from
    counts of its distinct values, and a row is read once with the ranks of all its columns beside it: all pairs are
    sums of one aggregate. Which columns are missing together takes at most two to the number of columns counts.
    """
    columns = sorted({c for pair in pairs.values() for c in pair})
    place = {c: i for i, c in enumerate(columns)}
    values = df.select(*[F.col(c).cast("double").alias(f"_v{i}") for c, i in place.items()])
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"_v{i}").isNotNull(), 1 << i).otherwise(0) for i in place.values()])
    rows = settle(values.withColumn("_mask", mask))
    sizes = {r["_mask"]: r["n"] for r in rows.groupBy("_mask").agg(F.count("*").alias("n")).collect()}

    complete = {name: tuple(sorted(m for m in sizes if m >> place[x] & 1 and m >> place[y] & 1)) for name, (x, y) in pairs.items()}
    complete = {name: masks for name, masks in complete.items() if masks}
    if not complete:
        return df.sparkSession.createDataFrame([], "pair string, n long, rho double")
    sets = {masks: i for i, masks in enumerate(sorted(set(complete.values())))}
    wanted = sorted({(place[c], sets[masks]) for name, masks in complete.items() for c in pairs[name]})
    masks_of = {i: list(masks) for masks, i in sets.items()}

    cells = F.array(*[F.struct(F.lit(i).alias("column"), F.col(f"_v{i}").alias("value"), F.col("_mask").alias("mask")) for i in place.values()])
    counts = rows.select(F.explode(cells).alias("c")).select("c.*").filter("value is not null").groupBy("column", "mask", "value").agg(F.count("*").alias("n"))
    serves = F.array_compact(F.array(*[F.when((F.col("column") == i) & F.col("mask").isin(masks_of[s]), F.lit(s)) for i, s in wanted]))
    by_set = counts.select("column", "value", "n", F.explode(serves).alias("set")).groupBy("column", "set", "value").agg(F.sum("n").alias("n"))
    ranked = settle(running_totals(by_set, ["column", "set"], ["value"], {"through": F.col("n")}).select(
        "column", "set", "value", (F.col("through") - (F.col("n") - 1) / 2).alias("rank")))
    for i in place.values():
        own = [s for column, s in wanted if column == i]
        if not own:
            continue
        ranks = ranked.filter(F.col("column") == i).groupBy(F.col("value").alias(f"_k{i}")).agg(
            *[F.max(F.when(F.col("set") == s, F.col("rank"))).alias(f"_r{i}_{s}") for s in own])
        rows = rows.join(ranks, F.col(f"_v{i}") == F.col(f"_k{i}"), "left")

    sums = []
    for at, (name, masks) in enumerate(complete.items()):
        s, (i, j) = sets[masks], (place[c] for c in pairs[name])
        middle, inside = (sum(sizes[m] for m in masks) + 1) / 2, F.col("_mask").isin(list(masks))
        a, b = (F.when(inside, F.col(f"_r{c}_{s}") - middle) for c in (i, j))
        sums += [F.sum(a * b).alias(f"_ab{at}"), F.sum(a * a).alias(f"_aa{at}"), F.sum(b * b).alias(f"_bb{at}")]
    out = F.array(*[
        F.struct(F.lit(name).alias("pair"), F.lit(sum(sizes[m] for m in masks)).cast("long").alias("n"),
                 ratio(F.col(f"_ab{at}"), F.sqrt(F.col(f"_aa{at}") * F.col(f"_bb{at}"))).alias("rho"))
        for at, (name, masks) in enumerate(complete.items())])
    return rows.agg(*sums).select(F.explode(out).alias("o")).select("o.*")


def lag_pairs(panel: DataFrame, key: str, day: str, value: str, lags: Sequence[int] = (1, 2, 3, 4, 5),
              max_rows: int | None = None) -> DataFrame:
    """The value beside its own past values, ready for ``spearman``."""
    return over_series(
        panel.select(key, day, value), [key], [day],
        lambda w: {f"lag{k}": F.lag(value, k).over(w) for k in lags}, back=max(lags), max_rows=max_rows,
    )
