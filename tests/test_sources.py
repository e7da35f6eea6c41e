import json

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import readers as R
from tidegauge.sources import schemas as S
from tidegauge.sources.sinks import difference, read_both, write_both


def test_measurements_from_json_arrays(spark, tmp_path):
    records = [
        {"SWMN_CODE": "0012A07", "CHCK_DE": "2023.08.08", "IEM_BGALAGE_CELL_CO": "0", "IEM_GEOSM": "정량한계미만"},
        {"SWMN_CODE": "0012A07", "CHCK_DE": "2023.08.01", "IEM_BGALAGE_CELL_CO": "1500", "IEM_WTRTP": "", "OTHER": "x"},
    ]
    (tmp_path / "a.json").write_text(json.dumps(records[:1]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(records[1:]), encoding="utf-8")
    df = R.read_measurements(spark, f"{tmp_path}/*.json").orderBy("site_code", "date")
    got = df.collect()
    assert df.columns == [*S.MEASUREMENT_KEYS, "date", *S.MEASURES]
    assert [r["cyano_cells"] for r in got] == [1500.0, 0.0]
    assert got[1]["geosmin"] is None and got[0]["water_temp"] is None and got[0]["site_code"] == "0012A07"


def test_missing_files_raise(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        R.read_measurements(spark, f"{tmp_path}/none/*.json").count()


def test_weather_empty_precipitation_is_missing(spark, tmp_path):
    (tmp_path / "asos_1.json").write_text(json.dumps([{"stnId": "90", "tm": "2023-08-01", "avgTa": "29.9", "sumRn": ""}]))
    row = R.read_weather(spark, f"{tmp_path}/asos_*.json").first()
    assert row["precip"] is None and row["temp_avg"] == 29.9 and str(row["date"]) == "2023-08-01"


def test_number_text_forms(spark):
    from tidegauge.functions.columns import number

    texts = ["1500", " 12.5 ", "1e3", "-.5", "", "NaN", "12d", "below limit", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [1500.0, 12.5, 1000.0, -0.5, None, None, None, None, None]


def test_positional_export_drops_titles_and_isomers(spark, tmp_path):
    row = ["하천", "세종보", "상", "2023.08.01"] + [str(i) for i in range(19)]
    lines = [",".join(["title"] + [""] * 22), ",".join(["구분"] + ["h"] * 22), ",".join(row)]
    (tmp_path / "x.csv").write_text("\n".join(lines), encoding="utf-8")
    got = R.read_export(spark, f"{tmp_path}/x.csv").collect()
    assert len(got) == 1
    assert got[0]["site_code"] is None and got[0]["site_name"] == "세종보" and got[0]["microcystin_lr"] == 13.0
    assert "mc_rr" not in got[0].asDict()


def test_site_codes_keep_leading_zeros(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(S.SITE_COLUMNS) + "\nriver,0012,A,B,C,D,E,F\n")
    assert R.read_sites(spark, f"{tmp_path}/s.csv").first()["site_code"] == "0012"


def test_cycler_files(spark, tmp_path):
    header = ",".join([*S.CYCLER_CHANNELS, "Extra"])
    (tmp_path / "CS2_35_10_15_10.csv").write_text(header + "\n" + ",".join(["1"] * 10) + "\n")
    row = R.read_cycler(spark, str(tmp_path)).first()
    assert row["source_file"] == "CS2_35_10_15_10.csv" and str(row["file_date"]) == "2010-10-15" and row["Data_Point"] == 1
    assert "Extra" not in row.asDict()
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "CS2_35_1_2_11.csv").write_text("Data_Point\n1\n")
    with pytest.raises(R.MissingColumnsError):
        R.read_cycler(spark, str(bad))
    audit = R.audit_headers(spark, str(bad), ["Data_Point", "Voltage(V)"]).first()
    assert audit["missing_columns"] == "Voltage(V)" and str(audit["file_date"]) == "2011-01-02"


def test_forecast_items(spark):
    items = [("20250708", "TMN", "23"), ("20250708", "TMX", "30"), ("20250708", "POP", "60"), ("20250708", "POP", "20"),
             ("20250708", "SKY", "4"), ("20250707", "TMX", "31"), ("20250707", "TMN", "-")]
    got = R.forecast_summary(spark.createDataFrame(items, "fcstDate string, category string, fcstValue string")).orderBy("day").collect()
    assert [r["day"] for r in got] == ["07/07", "07/08"]
    assert (got[1]["temp_min"], got[1]["temp_max"], got[1]["precip_probability"]) == (23.0, 30.0, 60.0)
    assert got[0]["temp_min"] is None


def test_required_columns(spark):
    with pytest.raises(R.MissingColumnsError, match="soh"):
        R.modelling_series(spark.createDataFrame([(1,)], "cycle int"))


def test_sinks_agree_and_differences_show(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0.1, None), (1, "a", 0.1, None), (2, None, 1e-9, True)], "i int, s string, d double, b boolean")
    write_both(df, f"{tmp_path}/c", f"{tmp_path}/p")
    csv, parquet = read_both(spark, f"{tmp_path}/c", f"{tmp_path}/p")
    assert difference(csv, parquet).count() == 0
    assert [r["surplus"] for r in difference(df, df.distinct()).collect()] == [1]


def test_geojson_network(spark, tmp_path):
    from tidegauge.operators import stations as N

    def feature(code, name, y):
        return {"properties": {"ptNo": code, "ptNm": name, "X": 127.0, "Y": y}}

    (tmp_path / "a.geojson").write_text(json.dumps({"features": [feature("1", "세종보1(금남댐)", 36.0), feature("2", "세종보2", 37.0)]}), encoding="utf-8")
    (tmp_path / "b.geojson").write_text(json.dumps({"features": [feature("1", "other", 1.0)]}), encoding="utf-8")
    lookups = N.network_lookups(R.read_network(spark, f"{tmp_path}/*.geojson"))
    codes = {r["key"]: r["spot"]["lat"] for r in lookups["code"].collect()}
    keys = {r["key"]: r["spot"]["lat"] for r in lookups["key"].collect()}
    assert codes == {"1": 36.0, "2": 37.0}
    assert keys["세종"] == 36.0 and keys["금남댐"] == 36.0 and keys["금남"] == 36.0


def cycler_lines(names, *rows):
    return "\n".join([",".join(names), *(",".join(str(r.get(c, "")) for c in names) for r in rows)]) + "\n"


def test_every_file_is_read_by_its_own_header(spark, tmp_path):
    usual = list(S.CYCLER_CHANNELS)
    row = dict.fromkeys(usual, 1) | {"Data_Point": 5, "Current(A)": 0.5, "Voltage(V)": 3.5}
    (tmp_path / "CS2_1_2_3_10.csv").write_text(cycler_lines(usual, row, row | {"Current(A)": "NaN"}))
    (tmp_path / "in").mkdir()
    quoted = cycler_lines([*reversed(usual)], row)
    head, _, rest = quoted.partition("\n")
    (tmp_path / "in" / "b.csv").write_text('"Note, free",' + ",".join(f' "{c}"' for c in head.split(",")) + "\n" + "x," + rest)
    (tmp_path / "in" / "c.csv").write_text("\ufeff" + cycler_lines(usual, row), encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    got = R.read_cycler(spark, str(tmp_path)).orderBy("source_file", F.col("`Current(A)`").asc_nulls_last()).collect()
    assert [r["source_file"] for r in got] == ["CS2_1_2_3_10.csv"] * 2 + ["b.csv", "c.csv"]
    assert [r["Current(A)"] for r in got] == [0.5, None, 0.5, 0.5] and {r["Voltage(V)"] for r in got} == {3.5} and {r["Data_Point"] for r in got} == {5}
    audit = {r["source_file"]: r for r in R.audit_headers(spark, str(tmp_path)).collect()}
    assert len(audit) == 4 and [n for n, r in audit.items() if r["missing_columns"]] == ["empty.csv"]
    assert not audit["empty.csv"]["has_header"] and audit["empty.csv"]["missing_columns"] == ",".join(sorted(usual))
    assert audit["CS2_1_2_3_10.csv"]["file_order"] == 1 and audit["b.csv"]["file_order"] == 2


def test_the_manifest_opens_only_new_and_changed_files(spark, tmp_path):
    from tidegauge.sources import manifest as M

    landing, kept = tmp_path / "landing", str(tmp_path / "manifest")
    landing.mkdir()
    (landing / "a.csv").write_text("x,y\n1,2\n")
    (landing / "b.csv").write_text("")
    assert M.update_manifest(spark, str(landing), kept) == 2 and M.update_manifest(spark, str(landing), kept) == 0
    (landing / "c.csv").write_text('" p ","q""r"\n')
    (landing / "a.csv").write_text("y,x,z\n1,2,3\n")
    assert M.update_manifest(spark, str(landing), kept) == 2
    (landing / "b.csv").unlink()
    got = {r["source_file"]: r["header"] for r in M.landed_files(spark, str(landing), kept).collect()}
    assert got == {"a.csv": ["y", "x", "z"], "c.csv": ["p", 'q"r']}


def test_header_audit_reads_quotes_and_marks_like_the_reader(spark):
    files = [("/l/a.csv", '\ufeff"Data_Point" , "Voltage(V)"\r\n1,2'), ("/l/b.csv", "Data_Point"), ("/l/c.csv", ""), ("/l/d.csv", None)]
    audit = R.header_audit(spark.createDataFrame(files, "path string, value string"), ["Data_Point", "Voltage(V)"])
    got = {r["source_file"]: (r["has_header"], r["missing_columns"]) for r in audit.collect()}
    assert got == {"a.csv": (True, ""), "b.csv": (True, "Voltage(V)"), "c.csv": (False, "Data_Point,Voltage(V)"), "d.csv": (False, "Data_Point,Voltage(V)")}
