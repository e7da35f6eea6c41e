"""Station matching: network lookups, name matching, filling from basins, nearest station, grid cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegauge.functions.geo import grid_cell, grid_constants
from tidegauge.operators import stations as S
from tidegauge.plans import tables as B
from tidegauge.plans.registry import query
from tidegauge.plans.tables import r
from tidegauge.sources.readers import network_points


def _spread(key: str, salt: int):
    """Coordinates that scatter keys over a 7 by 6 degree region."""
    k = F.col(key)
    lat = F.lit(33.0) + F.pmod(k * (7919 + salt), F.lit(100003)) / 100003.0 * 6
    lon = F.lit(125.0) + F.pmod(k * (104729 + salt), F.lit(100019)) / 100019.0 * 7
    return lat, lon


def _spread_sql(key: str, salt: int) -> tuple[str, str]:
    return (f"33.0::DOUBLE + ({key} * {7919 + salt}) % 100003 / 100003.0::DOUBLE * 6",
            f"125.0::DOUBLE + ({key} * {104729 + salt}) % 100019 / 100019.0::DOUBLE * 7")


def _points(spark, sf_dir):
    lat, lon = _spread("c_custkey", 0)
    return B.table(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


def _stations(spark, sf_dir):
    lat, lon = _spread("s_suppkey", 12)
    return B.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name", "s_acctbal", lat.alias("lat"), lon.alias("lon"))


SQL_POINTS = "points AS (SELECT c_custkey, {} AS lat, {} AS lon FROM customer)".format(*_spread_sql("c_custkey", 0))
SQL_STATIONS = "stations AS (SELECT *, {} AS lat, {} AS lon FROM supplier)".format(*_spread_sql("s_suppkey", 12))
KM = ("2 * 6371.0::DOUBLE * asin(sqrt(sin(radians(s.lat - p.lat) / 2) ** 2 + cos(radians(p.lat)) * cos(radians(s.lat)) "
      "* sin(radians(s.lon - p.lon) / 2) ** 2))")
SQL_NEAREST = f"""{SQL_POINTS}, {SQL_STATIONS},
nearest AS (
  SELECT c_custkey, arg_min(s_suppkey, (km, s_suppkey)) AS s_suppkey, min(km) AS dist_km
  FROM (SELECT c_custkey, s_suppkey, {KM} AS km FROM points p, stations s) GROUP BY 1)"""


@query("nearest_station", f"WITH {SQL_NEAREST} SELECT c_custkey, s_suppkey, {r('dist_km', 4)} AS dist_km FROM nearest")
def nearest_station(spark, sf_dir):
    found = S.nearest_station(_points(spark, sf_dir), _stations(spark, sf_dir), "s_suppkey", "s_suppkey")
    return found.select("c_custkey", "s_suppkey", F.round("dist_km", 4).alias("dist_km"))


@query("station_distance_summary", f"""WITH {SQL_NEAREST}
SELECT count(*) AS points, count(DISTINCT s_suppkey) AS stations_used, {r('max(dist_km)', 4)} AS dist_max, {r('median(dist_km)', 4)} AS dist_median FROM nearest""")
def station_distance_summary(spark, sf_dir):
    found = S.nearest_station(_points(spark, sf_dir), _stations(spark, sf_dir), "s_suppkey", "s_suppkey")
    return B.rounded(S.distance_summary(found, "s_suppkey"), 4)


def _hierarchy(spark, sf_dir):
    """Suppliers below half the top balance have no coordinates of their own."""
    nation = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("mid_basin"), F.col("n_regionkey").alias("major_basin"))
    known = F.col("s_acctbal") >= 6500
    sites = _stations(spark, sf_dir).select(
        "s_suppkey", F.col("s_nationkey").alias("mid_basin"), F.when(known, F.col("lat")).alias("lat"),
        F.when(known, F.col("lon")).alias("lon"), F.when(known, "precise").alias("coord_source"),
    )
    return sites.join(nation, "mid_basin", "left")


SQL_FILLED = f"""{SQL_STATIONS},
h0 AS (
  SELECT s_suppkey, s_nationkey AS mid_basin, n_regionkey AS major_basin, CASE WHEN s_acctbal >= 6500 THEN lat END AS lat,
         CASE WHEN s_acctbal >= 6500 THEN lon END AS lon, CASE WHEN s_acctbal >= 6500 THEN 'precise' END AS coord_source
  FROM stations LEFT JOIN nation ON n_nationkey = s_nationkey),
m1 AS (SELECT mid_basin, avg(lat) AS la, avg(lon) AS lo FROM h0 WHERE lat IS NOT NULL GROUP BY 1),
h1 AS (SELECT s_suppkey, mid_basin, major_basin, coalesce(lat, la) AS lat, CASE WHEN lat IS NULL AND la IS NOT NULL THEN lo ELSE lon END AS lon,
       CASE WHEN lat IS NULL AND la IS NOT NULL THEN 'inherited' ELSE coord_source END AS coord_source FROM h0 LEFT JOIN m1 USING (mid_basin)),
m2 AS (SELECT major_basin, avg(lat) AS la, avg(lon) AS lo FROM h1 WHERE lat IS NOT NULL GROUP BY 1),
h2 AS (SELECT s_suppkey, mid_basin, major_basin, coalesce(lat, la) AS lat, CASE WHEN lat IS NULL AND la IS NOT NULL THEN lo ELSE lon END AS lon,
       CASE WHEN lat IS NULL AND la IS NOT NULL THEN 'coarse' ELSE coord_source END AS coord_source FROM h1 LEFT JOIN m2 USING (major_basin))"""


@query("inherited_coordinates", f"WITH {SQL_FILLED} SELECT s_suppkey, mid_basin, major_basin, {r('lat')} AS lat, {r('lon')} AS lon, coord_source FROM h2")
def inherited_coordinates(spark, sf_dir):
    return B.rounded(S.inherit_missing(_hierarchy(spark, sf_dir)))


@query("coordinate_sources", f"WITH {SQL_FILLED} SELECT coord_source, count(*) AS n FROM h2 GROUP BY 1")
def coordinate_sources(spark, sf_dir):
    return S.inherit_missing(_hierarchy(spark, sf_dir)).groupBy("coord_source").agg(F.count("*").alias("n"))


def _grid_sql() -> str:
    cone, scale, origin = grid_constants()
    radius = f"({scale!r}::DOUBLE / pow(tan(pi() / 4 + radians(lat) / 2), {cone!r}::DOUBLE))"
    turn = "radians(lon - 126.0)"
    theta = f"((({turn} + pi()) - 2 * pi() * floor(({turn} + pi()) / (2 * pi()))) - pi()) * {cone!r}::DOUBLE"
    return (f"CAST(trunc({radius} * sin({theta}) + 43.5) AS INT) AS nx, "
            f"CAST(trunc({origin!r}::DOUBLE - {radius} * cos({theta}) + 136.5) AS INT) AS ny")


@query("grid_cells", f"WITH {SQL_POINTS} SELECT c_custkey, {_grid_sql()} FROM points")
def grid_cells(spark, sf_dir):
    nx, ny = grid_cell(F.col("lat"), F.col("lon"))
    return _points(spark, sf_dir).select("c_custkey", nx.alias("nx"), ny.alias("ny"))


FEATURES_PER_FILE = 50


def _network(spark, sf_dir):
    """Suppliers as nested feature collections, fifty features to a file."""
    supplier = B.table(spark, sf_dir, "supplier").join(
        B.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    lat, lon = _spread("s_suppkey", 12)
    feature = F.struct(F.struct(
        F.concat(F.lit("P"), F.col("s_suppkey") * 3).alias("ptNo"),
        F.concat("n_name", F.lit(" 7("), "s_name", F.lit(")")).alias("ptNm"), lon.alias("X"), lat.alias("Y"),
    ).alias("properties"))
    files = supplier.groupBy(F.floor(F.col("s_suppkey") / FEATURES_PER_FILE).alias("file")).agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", feature.alias("feature")))).alias("_sorted")
    )
    return files.select("file", F.transform("_sorted", lambda x: x["feature"]).alias("features"))


SQL_NETWORK = f"""{SQL_STATIONS},
network AS (
  SELECT s_suppkey AS seen, 'P' || s_suppkey * 3 AS code, n_name || ' 7(' || s_name || ')' AS name, lat, lon
  FROM stations JOIN nation ON n_nationkey = s_nationkey)"""
CORE = "trim(regexp_replace(regexp_replace(regexp_replace({}, '\\(.*?\\)', '', 'g'), '[0-9]', '', 'g'), 'TION|#', '', 'g'))"
WORDS = ("TION", "#")
SQL_KEYS = SQL_NETWORK + f""",
inner_names AS (SELECT *, unnest(regexp_extract_all(name, '\\((.*?)\\)', 1)) AS part FROM network),
keyed AS (
  SELECT seen, lat, lon, {CORE.format('name')} AS key FROM network UNION
  SELECT seen, lat, lon, part FROM inner_names UNION SELECT seen, lat, lon, {CORE.format('part')} FROM inner_names),
by_key AS (SELECT key, arg_min(lat, seen) AS lat, arg_min(lon, seen) AS lon FROM keyed WHERE key <> '' GROUP BY 1)"""


def _lookups(spark, sf_dir):
    return S.network_lookups(network_points(_network(spark, sf_dir)), WORDS)


@query("network_lookup", f"WITH {SQL_KEYS} SELECT key, {r('lat')} AS lat, {r('lon')} AS lon FROM by_key")
def network_lookup(spark, sf_dir):
    return B.rounded(_lookups(spark, sf_dir)["key"].select("key", "spot.lat", "spot.lon"))


def _site_names(spark, sf_dir):
    key, kind = F.col("c_custkey"), F.col("c_mktsegment")
    named = F.format_string("Supplier#%09d", (key / 4).cast("long"))
    nation = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = B.table(spark, sf_dir, "customer").join(nation, "c_nationkey")
    return customer.select(
        F.concat(F.lit("P"), key).alias("site_code"),
        F.when(kind == "BUILDING", named).when(kind == "FURNITURE", F.concat("n_name", F.lit("99"))).otherwise("RIVER").alias("site_name"),
        F.when(kind == "MACHINERY", F.concat("n_name", F.lit(" 7("), named, F.lit(")"))).otherwise("nowhere").alias("survey_location"),
    )


@query("matched_coordinates", f"""WITH {SQL_KEYS},
site_names AS (
  SELECT 'P' || c_custkey AS site_code, n_name, c_mktsegment,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Supplier#' || lpad(CAST(c_custkey // 4 AS VARCHAR), 9, '0')
              WHEN 'FURNITURE' THEN n_name || '99' ELSE 'RIVER' END AS site_name,
         CASE c_mktsegment WHEN 'MACHINERY' THEN n_name || ' 7(Supplier#' || lpad(CAST(c_custkey // 4 AS VARCHAR), 9, '0') || ')' ELSE 'nowhere' END AS survey_location
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
named AS (SELECT *, {CORE.format('site_name')} AS core FROM site_names)
SELECT s.site_code, s.site_name, s.survey_location, {r('coalesce(c.lat, v.lat, f.lat, k.lat)')} AS lat, {r('coalesce(c.lon, v.lon, f.lon, k.lon)')} AS lon,
       CASE WHEN coalesce(c.lat, v.lat, f.lat, k.lat) IS NOT NULL THEN 'precise' END AS coord_source
FROM named s LEFT JOIN network c ON c.code = s.site_code LEFT JOIN network v ON v.name = s.survey_location
LEFT JOIN by_key f ON f.key = s.site_name AND s.site_name <> 'RIVER' LEFT JOIN by_key k ON k.key = s.core AND s.site_name <> 'RIVER'""")
def matched_coordinates(spark, sf_dir):
    return B.rounded(S.match_precise(_site_names(spark, sf_dir), _lookups(spark, sf_dir), broad=("RIVER",), words=WORDS))
