"""Panels of irregular measurements: one row per key and day, features up to a day, the label after it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidegauge.functions.columns import calendar, reaches
from tidegauge.operators.ordered import over_series

LABEL_COLUMNS = ["label_date", "horizon_days", "label_value", "target"]


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns feed which features."""

    key: str
    day: str
    current: Sequence[str]
    lagged: Sequence[str] = ()
    lags: Sequence[int] = (1, 2, 3, 4)
    rolled: Sequence[str] = ()
    windows: Sequence[int] = (3, 5)
    deltas: Sequence[str] = ()
    static: Sequence[str] = field(default_factory=tuple)

    @property
    def reach(self) -> int:
        return max([*self.lags, *self.windows, 1])


def first_per_key(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Keep one row per key, the one with the lowest ``order`` (which must not repeat within a key).

    An aggregate, not a window: copies of a hot key meet on the map side and never reach one task together.
    """
    complete = df.dropna(subset=list(keys))
    return complete.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns])


def target_columns(spec: WindowSpec, day: str, value: str, threshold: float) -> dict[str, Column]:
    """Label from the next row of the series, whether or not its value is present."""
    label_date = F.lead(day).over(spec)
    label = F.lead(value).over(spec)
    return {
        "label_date": label_date,
        "horizon_days": F.datediff(label_date, day),
        "label_value": label,
        "target": reaches(label, threshold),
    }


def valid_horizon(min_gap: int, max_gap: int) -> Column:
    return F.col("label_value").isNotNull() & F.col("horizon_days").between(min_gap, max_gap)


def build_targets(
    panel: DataFrame, key: str, day: str, value: str,
    threshold: float = 1000, min_gap: int = 4, max_gap: int = 10, max_rows: int | None = None,
) -> DataFrame:
    """(key, day) with the next measurement as label, kept if it lies within the horizon window."""
    labelled = over_series(
        panel.select(key, day, value), [key], [day],
        lambda w: target_columns(w, day, value, threshold), ahead=1, max_rows=max_rows,
    )
    return labelled.filter(valid_horizon(min_gap, max_gap)).select(key, day, *LABEL_COLUMNS)


def lag_features(w: WindowSpec, column: str, lags: Sequence[int]) -> dict[str, Column]:
    return {f"{column}_lag{k}": F.lag(column, k).over(w) for k in lags}


def past_rolling(w: WindowSpec, column: str, windows: Sequence[int]) -> dict[str, Column]:
    """Mean, maximum and standard deviation over past rows only; the deviation needs two values."""
    out: dict[str, Column] = {}
    for size in windows:
        past = w.rowsBetween(-size, -1)
        out[f"{column}_rollmean{size}"] = F.avg(column).over(past)
        out[f"{column}_rollmax{size}"] = F.max(column).over(past)
        out[f"{column}_rollstd{size}"] = F.stddev_samp(column).over(past)
    return out


def feature_columns_for(w: WindowSpec, spec: FeatureSpec) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for column in spec.lagged:
        out.update(lag_features(w, column, spec.lags))
    for column in spec.rolled:
        out.update(past_rolling(w, column, spec.windows))
    for column in spec.deltas:
        out[f"{column}_delta1"] = F.col(column) - F.lag(column).over(w)
    out["days_since_prev"] = F.datediff(F.col(spec.day), F.lag(spec.day).over(w))
    return out


def _feature_projection(spec: FeatureSpec, windowed: Sequence[str]) -> list[Column]:
    return [
        *[F.col(c).alias(f"cur_{c}") for c in spec.current],
        *[F.col(c) for c in windowed if c != "days_since_prev"],
        *[column.alias(name) for name, column in calendar(F.col(spec.day)).items()],
        F.col("days_since_prev"),
        *[F.col(c) for c in spec.static],
    ]


def build_features(panel: DataFrame, spec: FeatureSpec, max_rows: int | None = None) -> DataFrame:
    """Features of every (key, day) from that day and earlier rows; one shuffle serves all windows."""
    before = set(panel.columns)
    wide = over_series(
        panel, [spec.key], [spec.day], lambda w: feature_columns_for(w, spec), back=spec.reach, max_rows=max_rows
    )
    windowed = [c for c in wide.columns if c not in before]
    return wide.select(spec.key, spec.day, *_feature_projection(spec, windowed))


def assemble_dataset(
    panel: DataFrame, spec: FeatureSpec, value: str,
    threshold: float = 1000, min_gap: int = 4, max_gap: int = 10, max_rows: int | None = None,
) -> DataFrame:
    """Features joined to labels on (key, day).

    Both come from the same series, so they are computed over one shuffle and the join is a filter.
    """
    before = set(panel.columns)
    wide = over_series(
        panel, [spec.key], [spec.day],
        lambda w: {**feature_columns_for(w, spec), **target_columns(w, spec.day, value, threshold)},
        back=spec.reach, ahead=1, max_rows=max_rows,
    )
    windowed = [c for c in wide.columns if c not in before and c not in LABEL_COLUMNS]
    return wide.filter(valid_horizon(min_gap, max_gap)).select(
        spec.key, spec.day, "target", "label_date", "horizon_days", "label_value",
        *_feature_projection(spec, windowed),
    )


def model_inputs(dataset: DataFrame, key: str, day: str) -> list[str]:
    """Every column a model may see: no key, no target, nothing about how the label came to be."""
    hidden = {key, day, *LABEL_COLUMNS}
    return [c for c in dataset.columns if c not in hidden]


def trailing_weather(
    daily: DataFrame, station: str, day: str, windows: Sequence[int] = (7, 14),
    measures: Mapping[str, tuple[str, str]] | None = None, max_rows: int | None = None,
) -> DataFrame:
    """Aggregates over the last n rows up to and including each day.

    ``measures`` maps an output stem to (column, one of mean/max/sum); missing precipitation counts as 0.
    """
    measures = measures or {
        "temp_avg": ("temp_avg", "mean"), "temp_max": ("temp_max", "max"),
        "precip": ("precip", "sum"), "sunshine": ("sunshine_hours", "sum"),
    }
    functions = {"mean": F.avg, "max": F.max, "sum": F.sum}

    def build(w: WindowSpec) -> dict[str, Column]:
        return {
            f"wx_{stem}_{n}": functions[kind](
                F.coalesce(F.col(column), F.lit(0.0)) if stem == "precip" else F.col(column)
            ).over(w.rowsBetween(-(n - 1), 0))
            for n in windows for stem, (column, kind) in measures.items()
        }

    out = over_series(daily, [station], [day], build, back=max(windows) - 1, max_rows=max_rows)
    names = [f"wx_{stem}_{n}" for n in windows for stem in measures]
    return out.select(station, day, *names)


def add_weather(
    dataset: DataFrame, mapping: DataFrame, weather: DataFrame, key: str, day: str, station: str
) -> DataFrame:
    """Attach trailing weather of the mapped station for exactly the same day; no match leaves NULL."""
    return dataset.join(mapping.select(key, station), key, "left").join(weather, [station, day], "left").drop(station)


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The last ``n`` rows per key; Spark limits each key to ``n`` rows before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o.desc() for o in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")
