"""Splits that never let a model see the future or the group it is tested on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.columns import ratio
from tidegauge.operators.ordered import row_numbers, running_totals
from tidegauge.session import settle


def _usable(per_year: DataFrame, start: int, min_test: int) -> DataFrame:
    """(fold, test_rows) from a small table (year, n)."""
    first = F.min("year").over(Window.partitionBy())  # one row a year
    return per_year.withColumn("_first", first).filter(
        (F.col("year") >= start) & (F.col("n") >= min_test) & (F.col("year") > F.col("_first"))
    ).select(F.col("year").alias("fold"), F.col("n").alias("test_rows"))


def year_folds(dataset: DataFrame, day: str, start: int = 2022, min_test: int = 100) -> DataFrame:
    """One row per usable test year: from ``start`` on, with enough rows and some earlier year to learn from."""
    return _usable(dataset.groupBy(F.year(day).alias("year")).agg(F.count("*").alias("n")), start, min_test)


def year_splits(dataset: DataFrame, day: str, start: int = 2022, min_test: int = 100) -> DataFrame:
    """Expanding-window folds as a long table: every row once per fold it serves, as train or test.

    There are as many folds as years, so they travel as one array instead of a range join. Statistics of the train rows
    need no such table: see ``seasonal_scores_by_year``.
    """
    folds = year_folds(dataset, day, start, min_test).agg(F.collect_list("fold")).scalar()
    own = F.year(day)
    return dataset.withColumn("fold", F.explode(folds)).filter(F.col("fold") >= own).withColumn(
        "role", F.when(own < F.col("fold"), "train").otherwise("test")
    )


Fold = tuple[int, Column, Column]


def year_conditions(dataset: DataFrame, day: str, start: int = 2022, min_test: int = 100) -> list[Fold]:
    """(fold, train rows, test rows) per test year, for loops that fit one model per fold on one table."""
    years = year_folds(dataset, day, start, min_test).orderBy("fold").collect()  # one row per year
    return [(y["fold"], F.year(day) < y["fold"], F.year(day) == y["fold"]) for y in years]


def group_conditions(n_folds: int = 5, column: str = "fold") -> list[Fold]:
    """The same for a table that carries each row's group fold."""
    return [(i, F.col(column) != i, F.col(column) == i) for i in range(1, n_folds + 1)]


def assignment_schedule(histogram: list[tuple[int, int]], n_folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Largest group first, always to the lightest fold, for whole batches of equal-sized groups.

    ``histogram`` lists (size, number of groups) from the largest size down. Within a batch the choice is
    periodic, so each stretch is (size, first rank, end rank, folds taken in turn).
    """
    weights = [0] * n_folds
    schedule = []
    for size, groups in histogram:
        rank = 0
        while rank < groups:
            low = min(weights)
            turn = sorted((f for f in range(n_folds) if weights[f] < low + size), key=lambda f: (weights[f], f))
            waiting = [weights[f] for f in range(n_folds) if f not in turn]
            left = groups - rank
            rounds = (min(waiting) - low) // size if waiting else left
            taken = min(left, rounds * len(turn))
            schedule.append((size, rank, rank + taken, turn))
            whole, extra = divmod(taken, len(turn))
            for place, fold in enumerate(turn):
                weights[fold] += size * (whole + (place < extra))
            rank += taken
    return schedule


def group_folds(dataset: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """(group, fold): groups spread over folds by size, each group in one fold; ties go by group key.

    The greedy choice depends only on how many groups have each size. Only that histogram reaches the
    driver: it has at most sqrt(2 * rows) entries however many groups there are.
    """
    spark = dataset.sparkSession
    sizes = settle(dataset.groupBy(group).agg(F.count("*").alias("n")))
    histogram = [(r["n"], r["groups"]) for r in
                 sizes.groupBy("n").agg(F.count("*").alias("groups")).orderBy(F.desc("n")).collect()]
    schema = T.StructType([
        T.StructField("n", T.LongType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("turn", T.ArrayType(T.IntegerType())),
    ])
    schedule = spark.createDataFrame(assignment_schedule(histogram, n_folds), schema)
    placed = row_numbers(sizes, ["n"], [group], "_rank").withColumn("_rank", F.col("_rank") - 1)
    slot = F.pmod(F.col("_rank") - F.col("first"), F.size("turn")).cast("int")
    inside = (F.col("_rank") >= F.col("first")) & (F.col("_rank") < F.col("end"))
    return placed.join(schedule, "n").filter(inside).select(
        group, F.col("n").alias("rows"), (F.get("turn", slot) + 1).alias("fold")
    )


def site_splits(dataset: DataFrame, group: str, n_folds: int = 5) -> DataFrame:
    """Every row once per fold: test in its group's fold, train in the others."""
    folds = group_folds(dataset, group, n_folds).select(group, F.col("fold").alias("_own"))
    every = F.array(*[F.lit(i + 1) for i in range(n_folds)])
    return dataset.join(folds, group).withColumn("fold", F.explode(every)).withColumn(
        "role", F.when(F.col("fold") == F.col("_own"), "test").otherwise("train")
    ).drop("_own")


def inner_time_validation(train: DataFrame, day: str, ties: list[str], share: float = 0.2) -> DataFrame:
    """Oldest rows as train, newest ``share`` as validation, at least one train row; ties in order of ``ties``.

    Counts per day place the cut, so only the rows of the one day it falls in are ranked.
    """
    counts = train.groupBy(day).agg(F.count("*").alias("_n"))
    days = running_totals(counts, [], [day], {"_through": F.col("_n")}, totals=True)
    cut = F.greatest(F.lit(1), F.floor(F.col("_through_total") * F.lit(1 - share)))
    placed = settle(days.select(
        F.col(day).alias("_day"), (cut - (F.col("_through") - F.col("_n"))).alias("_room"),
        F.when(F.col("_through") <= cut, "train").when(F.col("_through") - F.col("_n") >= cut, "validation").otherwise("split").alias("_side"),
    ))
    joined = train.join(placed, F.col(day).eqNullSafe(F.col("_day")))
    whole = joined.filter("_side <> 'split'").withColumn("is_validation", F.col("_side") == "validation")
    shared = row_numbers(joined.filter("_side = 'split'"), [], ties, "_rank").withColumn(
        "is_validation", F.col("_rank") > F.col("_room")
    )
    return whole.unionByName(shared.drop("_rank")).drop("_day", "_room", "_side")


def seasonal_score(train: DataFrame, test: DataFrame, day: str, target: str) -> DataFrame:
    """Train rate of the test row's month, the global train rate for unseen months."""
    rates = train.groupBy(F.month(day).alias("_month")).agg(F.avg(target).alias("_rate"))
    overall = train.agg(F.avg(target)).scalar()
    return test.join(rates, F.month(day) == F.col("_month"), "left").withColumn(
        "seasonal", F.coalesce(F.col("_rate"), overall)
    ).drop("_month", "_rate")


def seasonal_scores_by_year(dataset: DataFrame, day: str, target: str, start: int = 2022, min_test: int = 100) -> DataFrame:
    """Test rows of all usable years with ``fold`` and their seasonal score: the rate of their month in all earlier years.

    Sums per (year, month) are added up over the years before, so no train row is copied into a fold and the dataset is
    read once for the sums and once for the test rows.
    """
    cells = settle(dataset.groupBy(F.year(day).alias("year"), F.month(day).alias("_month")).agg(
        F.sum(target).alias("_sum"), F.count("*").alias("n")))
    earlier = Window.partitionBy("_month").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    years = cells.groupBy("year").agg(F.sum("_sum").alias("_sum"), F.sum("n").alias("n"))
    before = Window.partitionBy().orderBy("year").rangeBetween(Window.unboundedPreceding, -1)  # one row a year
    overall = years.select(F.col("year").alias("fold"), (F.sum("_sum").over(before) / F.sum("n").over(before)).alias("_all"))
    rates = cells.select(F.col("year").alias("fold"), "_month", (F.sum("_sum").over(earlier) / F.sum("n").over(earlier)).alias("_rate"))
    known = rates.join(overall, "fold").join(_usable(years, start, min_test).select("fold"), "fold", "left_semi")
    tests = dataset.withColumns({"fold": F.year(day), "_month": F.month(day)})
    return tests.join(known, ["fold", "_month"]).withColumn("seasonal", F.coalesce("_rate", "_all")).drop("_month", "_rate", "_all")


def seasonal_scores_by_group(dataset: DataFrame, day: str, target: str, fold: str = "fold") -> DataFrame:
    """The same for group folds: every row with its month's rate in the other folds, which is all rows less its own fold's."""
    cells = settle(dataset.groupBy(fold, F.month(day).alias("_month")).agg(F.sum(target).alias("_sum"), F.count("*").alias("_n")))
    own, month, every = Window.partitionBy(fold), Window.partitionBy("_month"), Window.partitionBy()  # over folds x 12 rows

    def other(name: str, whole: WindowSpec, part: Column) -> Column:
        return F.sum(name).over(whole) - part

    rate = ratio(other("_sum", month, F.col("_sum")), other("_n", month, F.col("_n")))
    overall = ratio(other("_sum", every, F.sum("_sum").over(own)), other("_n", every, F.sum("_n").over(own)))
    rates = cells.select(fold, "_month", F.coalesce(rate, overall).alias("seasonal"))
    return dataset.withColumn("_month", F.month(day)).join(rates, [fold, "_month"]).drop("_month")
