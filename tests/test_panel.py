import datetime as dt
import random
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import audit as A
from tidegauge.operators import panel as P
from tidegauge.operators.checks import leaked_rows


def day(text):
    return dt.date.fromisoformat(text)


def panel(spark, rows):
    return spark.createDataFrame([(s, day(d), v) for s, d, v in rows], "site string, day date, v double")


SPEC = P.FeatureSpec(key="site", day="day", current=("v",), lagged=("v",), rolled=("v",), windows=(2, 3), deltas=("v",))


def irregular(seed=0, sites=4, visits=40):
    """Own cases: visits at random distances, some without a value, some exactly at the threshold."""
    rng = random.Random(seed)
    rows = []
    for s in range(sites):
        at = dt.date(2031, 1 + s, 3)
        for _ in range(visits):
            rows.append((f"p{s}", at.isoformat(), rng.choice([None, 640.0, 1000.0, 999.5, rng.uniform(0, 2600)])))
            at += dt.timedelta(days=rng.choice([1, 3, 4, 5, 9, 10, 11, 40]))
    rng.shuffle(rows)
    return rows


def labels_by_hand(rows, threshold=1000, low=4, high=10):
    out = {}
    for s in {r[0] for r in rows}:
        own = sorted((day(d), v) for t, d, v in rows if t == s)
        for (d, _), (d2, v2) in zip(own, own[1:]):
            if v2 is not None and low <= (d2 - d).days <= high:
                out[s, d] = (d2, v2, int(v2 >= threshold))
    return out


def test_labels_equal_those_made_by_hand(spark):
    rows = irregular()
    want = labels_by_hand(rows)
    got = {(r["site"], r["day"]): (r["label_date"], r["label_value"], r["target"]) for r in P.build_targets(panel(spark, rows), "site", "day", "v").collect()}
    assert got == want and any(v == 1000.0 and t == 1 for _, v, t in want.values()) and any(v == 999.5 and t == 0 for _, v, t in want.values())
    assert {(d2 - d).days for (_, d), (d2, _, _) in want.items()} == {4, 5, 9, 10}


def test_missing_next_value_is_not_skipped(spark):
    df = panel(spark, [("X", "2023-08-01", 1.0), ("X", "2023-08-08", None), ("X", "2023-08-12", 5000.0)])
    got = P.build_targets(df, "site", "day", "v").collect()
    assert [(r["day"], r["label_value"]) for r in got] == [(day("2023-08-08"), 5000.0)]


def test_unknown_code_is_removed(spark):
    df = panel(spark, [("5555A44", "2023-08-01", 1.0), ("X", "2023-08-01", 1.0)])
    master = spark.createDataFrame([("X",)], "site string")
    assert A.known(df, master, "site").count() == 1
    assert A.unknown(df, master, "site").first().asDict() == {"site": "5555A44", "row_count": 1}


def test_features_equal_those_made_by_hand(spark):
    rows = irregular(seed=3)
    got = {(r["site"], r["day"]): r for r in P.build_features(panel(spark, rows), SPEC).collect()}
    assert len(got) == len(rows)
    for s in {r[0] for r in rows}:
        own = sorted((day(d), v) for t, d, v in rows if t == s)
        for i, (d, v) in enumerate(own):
            row = got[s, d]
            past = [x for _, x in own[:i]]
            assert row["v_lag1"] == (past[-1] if past else None)
            assert row["days_since_prev"] == ((d - own[i - 1][0]).days if i else None)
            assert row["v_delta1"] == (None if not past or past[-1] is None or v is None else v - past[-1])
            for n in (2, 3):
                known = [x for x in past[-n:] if x is not None]
                assert row[f"v_rollmean{n}"] == (pytest.approx(statistics.mean(known)) if known else None)
                assert row[f"v_rollstd{n}"] == (pytest.approx(statistics.stdev(known)) if len(known) > 1 else None)


def test_future_rows_do_not_change_features(spark):
    rows = [(s, f"2023-08-{i:02d}", float(i * 7 % 11)) for s in "XY" for i in range(1, 21)]
    before = panel(spark, rows)
    after = panel(spark, [(s, d, v * 100 if d > "2023-08-12" else v) for s, d, v in rows])
    cutoff = F.lit("2023-08-12").cast("date")
    features = [P.build_features(p, SPEC, max_rows=m) for p, m in ((before, None), (after, 6))]
    assert leaked_rows(*features, "day", cutoff).count() == 0
    assert leaked_rows(*features, "day", F.lit("2023-08-20").cast("date")).count() > 0


def test_assembled_dataset_equals_join(spark):
    rows = [(s, f"2023-{m:02d}-{d:02d}", float((m * d) % 13 * 200)) for s in "XY" for m in (5, 6) for d in range(1, 28, 6)]
    df = panel(spark, rows)
    joined = P.build_targets(df, "site", "day", "v").join(P.build_features(df, SPEC), ["site", "day"])
    direct = P.assemble_dataset(df, SPEC, "v").select(joined.columns)
    assert direct.count() == joined.count() > 0
    assert direct.exceptAll(joined).count() == 0
    assert "horizon_days" not in P.model_inputs(direct, "site", "day")


def test_first_per_key_keeps_lowest_order_even_if_missing(spark):
    df = spark.createDataFrame([("X", day("2023-01-01"), 2, 5.0), ("X", day("2023-01-01"), 1, None), (None, day("2023-01-01"), 3, 1.0)],
                               "site string, day date, o int, v double")
    got = P.first_per_key(df, ["site", "day"], "o", ["v"]).collect()
    assert len(got) == 1 and got[0]["v"] is None


def test_trailing_weather_counts_rows_not_days(spark):
    df = spark.createDataFrame(
        [("S", day("2023-01-01"), 1.0, 2.0, None, 3.0), ("S", day("2023-03-01"), 3.0, 8.0, 4.0, 5.0)],
        "station string, day date, temp_avg double, temp_max double, precip double, sunshine_hours double")
    last = P.trailing_weather(df, "station", "day", windows=(7,)).orderBy(F.desc("day")).first()
    assert (last["wx_temp_avg_7"], last["wx_temp_max_7"], last["wx_precip_7"], last["wx_sunshine_7"]) == (2.0, 8.0, 4.0, 8.0)


def test_gap_buckets_are_left_open(spark):
    gaps = spark.createDataFrame([(0,), (2,), (3,), (7,), (40,)], "gap_days int")
    got = {r["up_to"]: r["n"] for r in A.gap_statistics(gaps).collect()}
    assert got == {2.0: 1, 4.0: 1, 8.0: 1, 14.0: 0, 31.0: 0, 100000.0: 1}


def test_spearman_matches_average_ranks(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 8, 300).astype(float), "b": rng.normal(size=300)})
    frame["c"] = frame["a"] + rng.integers(0, 3, 300)
    frame.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(frame).select("a", "b", F.when(~F.isnan("c"), F.col("c")).alias("c"))
    got = {r["pair"]: r["rho"] for r in A.spearman(df, {"ab": ("a", "b"), "ac": ("a", "c"), "aa": ("a", "a")}).collect()}

    def rho(x, y):
        both = frame[[x, y]].dropna() if x != y else frame[[x]].dropna()
        return both[x].rank().corr(both[y].rank())

    assert got["ab"] == pytest.approx(rho("a", "b"))
    assert got["ac"] == pytest.approx(rho("a", "c"))
    assert got["aa"] == pytest.approx(1.0)
