"""Long series and whole-table orders must give what one window or one sort would give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; others are short, and one key is NULL."""
    rng = np.random.default_rng(3)
    keys = [1] * 400 + [2] * 7 + [3] * 60 + [None] * 90
    rows = [(k, i, float(rng.integers(0, 40))) for i, k in enumerate(keys)]
    order = rng.permutation(len(rows))
    return spark.createDataFrame([rows[i] for i in order], "k long, t long, v double")


def build(w):
    return {
        "lag3": F.lag("v", 3).over(w), "next2": F.lead("v", 2).over(w), "mean5": F.avg("v").over(w.rowsBetween(-5, -1)),
        "std4": F.stddev_samp("v").over(w.rowsBetween(-4, -1)), "ahead": F.sum("v").over(w.rowsBetween(0, 2)),
    }


@pytest.mark.parametrize("max_rows", [5, 17, 50, 1000])
def test_chunked_windows_equal_plain_windows(skewed, max_rows):
    plain = O.over_series(skewed, ["k"], ["t"], build).toPandas().sort_values("t").reset_index(drop=True)
    chunked = O.over_series(skewed, ["k"], ["t"], build, back=5, ahead=2, max_rows=max_rows)
    chunked = chunked.toPandas().sort_values("t").reset_index(drop=True)[plain.columns]
    pd.testing.assert_frame_equal(plain, chunked)


def test_chunks_bound_the_rows_per_group(skewed):
    numbered = O.row_numbers(skewed, ["k"], ["t"], "pos")
    got = numbered.toPandas().sort_values("t")
    for _, part in got.groupby("k", dropna=False):
        assert part["pos"].tolist() == list(range(1, len(part) + 1))


def test_running_totals_with_descending_order(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("s"), F.lit(1).alias("n")).groupBy("s").agg(F.sum("n").alias("n"))
    got = O.running_totals(df, [], [F.desc("s")], {"through": F.col("n")}).toPandas().sort_values("s", ascending=False)
    assert got["through"].tolist() == got["n"].cumsum().tolist()


def test_exact_quantiles_match_linear_interpolation(skewed):
    wanted = {"lo": 0.05, "q25": 0.25, "mid": 0.5, "hi": 0.95, "top": 1.0}
    got = O.exact_quantiles(skewed, ["k"], "v", wanted).toPandas().set_index("k")
    data = skewed.toPandas()
    for key, part in data.groupby("k", dropna=False):
        for name, p in wanted.items():
            row = got[got.index.isna()].iloc[0] if pd.isna(key) else got.loc[key]
            assert row[name] == pytest.approx(part["v"].quantile(p))
    whole = O.exact_quantiles(skewed, [], "v", wanted).first()
    for name, p in wanted.items():
        assert whole[name] == pytest.approx(data["v"].quantile(p))


@pytest.mark.parametrize("span", [2, 9, 400])
@pytest.mark.parametrize("max_rows", [None, 100])
def test_exponential_mean_matches_recurrence(spark, span, max_rows):
    n = 5000
    rng = np.random.default_rng(span)
    frame = pd.DataFrame({"k": 1, "t": np.arange(n), "v": rng.normal(50, 20, n)})
    got = O.exponential_mean(spark.createDataFrame(frame), ["k"], ["t"], "v", "e", span=span, max_rows=max_rows)
    got = got.toPandas().sort_values("t")["e"].to_numpy()
    np.testing.assert_allclose(got, frame["v"].ewm(span=span, adjust=False).mean().to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("max_rows", [None, 100])
def test_exponential_mean_decays_over_missing_values(spark, max_rows):
    rng = np.random.default_rng(9)
    frames = [pd.DataFrame({"k": "short", "t": range(3), "v": [1.0, np.nan, 2.0]}), pd.DataFrame({"k": "none", "t": range(4), "v": np.nan})]
    long = rng.normal(50, 20, 6000)
    long[:5] = np.nan
    long[rng.random(6000) < 0.4] = np.nan
    long[2000:4500] = np.nan  # longer than any block
    frames.append(pd.DataFrame({"k": "long", "t": np.arange(6000), "v": long}))
    frames.append(pd.DataFrame({"k": None, "t": range(6), "v": [np.nan, 3.0, np.nan, np.nan, 1.0, 2.0]}))
    data = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(data).withColumn("v", F.nanvl("v", F.lit(None)))
    for span in (2, 9, 50):
        got = O.exponential_mean(df, ["k"], ["t"], "v", "e", span=span, max_rows=max_rows).toPandas()
        assert len(got) == len(data)
        for part in frames:
            key = part["k"].iloc[0]
            mine = got[got["k"].isna() if key is None else got["k"] == key].sort_values("t")["e"].to_numpy(dtype=float)
            np.testing.assert_allclose(mine, part["v"].ewm(span=span, adjust=False).mean().to_numpy(), rtol=1e-9)
            if key == "short" and span == 9:
                np.testing.assert_allclose(mine, [1, 1, 1.04 / 0.84])


def test_spearman_of_pairs_with_different_missing_rows(spark):
    from tidegauge.operators.audit import spearman

    rng = np.random.default_rng(4)
    data = pd.DataFrame(rng.integers(0, 9, (400, 4)).astype(float), columns=list("abcd"))
    for c, share in (("a", 0.2), ("c", 0.5)):
        data.loc[rng.random(400) < share, c] = np.nan
    data["e"] = np.nan
    df = spark.createDataFrame(data).select(*[F.nanvl(c, F.lit(None)).alias(c) for c in data])
    pairs = {x + y: (x, y) for x in "abcde" for y in "abcde" if x <= y}
    got = {r["pair"]: r for r in spearman(df, pairs).collect()}
    assert set(got) == {p for p in pairs if "e" not in p}
    for p, row in got.items():
        both = data[list(p)].dropna() if p[0] != p[1] else data[[p[0]]].dropna()
        x, y = both[p[0]].rank(), both[p[1]].rank()
        assert row["n"] == len(both) and row["rho"] == pytest.approx(np.corrcoef(x, y)[0, 1])


def test_plain_window_needs_one_shuffle(spark, skewed):
    plan = O.over_series(skewed, ["k"], ["t"], build)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_exponential_mean_of_whole_keys_deals_rows_out_once(spark):
    rng = np.random.default_rng(8)
    rows = [(k, i, None if rng.random() < 0.2 else float(rng.normal())) for k in ("a", None) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    plain = O.exponential_mean(df, ["k"], ["i"], "v", "m", span=9)
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.k, r.i): r.m for r in plain.collect()}
    cut = {(r.k, r.i): r.m for r in O.exponential_mean(df, ["k"], ["i"], "v", "m", span=9, max_rows=700).collect()}
    assert len(got) == len(cut) == len(rows)
    for k in ("a", None):
        mean, lost = None, 1.0
        for key, i, v in rows:
            if key != k:
                continue
            lost *= 0.8
            if v is not None:
                mean, lost = v if mean is None else (lost * mean + 0.2 * v) / (lost + 0.2), 1.0
            assert got[k, i] == cut[k, i] == mean is None or abs(got[k, i] - mean) < 1e-9 and abs(cut[k, i] - mean) < 1e-9
