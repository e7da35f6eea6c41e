"""Coordinates of sites: matching by code and name, filling from the basin, and the nearest station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.geo import great_circle_km, unit_vector
from tidegauge.operators.ordered import exact_quantiles
from tidegauge.session import settle

# Facility words that are dropped from a name, and river names too broad to match on.
FACILITY_WORDS = ("댐", "호", "지", "제", "보", "취수장", "광역", "시범", "표층", "혼합", "상류", "하류", "중류")
BROAD_NAMES = ("한강", "낙동강", "금강", "영산강")

GRID_BITS = 24
LEVEL_BITS = 2
LEAF_STATIONS = 64
SLACK = 1e-9
SPOTS_PER_TASK = 4000  # each meets up to 64 cells at the first level


def core_name(name: Column, words: Sequence[str] = FACILITY_WORDS) -> Column:
    """A name without bracketed parts, digits and facility words."""
    bare = F.regexp_replace(F.regexp_replace(name, r"\(.*?\)", ""), "[0-9]", "")
    return F.trim(F.regexp_replace(bare, "|".join(words), ""))


def name_keys(name: Column, words: Sequence[str] = FACILITY_WORDS) -> Column:
    """Every key a point can be found under: its core name, each bracketed part, and that part's core."""
    brackets = F.regexp_extract_all(name, F.lit(r"\((.*?)\)"), 1)
    cores = F.transform(brackets, lambda part: core_name(part, words))
    keys = F.array_distinct(F.concat(F.array(core_name(name, words)), brackets, cores))
    return F.filter(keys, lambda key: key != "")


def lookup(points: DataFrame, key: Column) -> DataFrame:
    """First coordinate per key, in file order and then in order within the file."""
    spot = F.struct("lat", "lon", "name")
    return points.select(key.alias("key"), F.struct("file", "place").alias("seen"), spot.alias("spot")).groupBy("key").agg(
        F.min_by("spot", "seen").alias("spot")
    )


def network_lookups(points: DataFrame, words: Sequence[str] = FACILITY_WORDS) -> dict[str, DataFrame]:
    by_key = points.withColumn("key", F.explode(name_keys(F.col("name"), words)))
    return {
        "code": lookup(points, F.col("code")),
        "name": lookup(points, F.col("name")),
        "key": lookup(by_key, F.col("key")),
    }


def match_precise(
    sites: DataFrame, lookups: dict[str, DataFrame], broad: Sequence[str] = BROAD_NAMES,
    words: Sequence[str] = FACILITY_WORDS,
) -> DataFrame:
    """Coordinates by code, else by survey location, else by site name or its core name."""

    def hit(kind: str, alias: str) -> DataFrame:
        return lookups[kind].select(F.col("key").alias(f"_{alias}"), F.col("spot").alias(f"_{alias}_spot"))

    usable = F.when(~F.col("site_name").isin(*broad), F.col("site_name"))
    keyed = sites.withColumn("_full", usable).withColumn("_core", core_name(usable, words))
    joined = (
        keyed.join(hit("code", "c"), F.col("site_code") == F.col("_c"), "left")
        .join(hit("name", "s"), F.col("survey_location") == F.col("_s"), "left")
        .join(hit("key", "f"), F.col("_full") == F.col("_f"), "left")
        .join(hit("key", "k"), F.col("_core") == F.col("_k"), "left")
    )
    spot = F.coalesce("_c_spot", "_s_spot", "_f_spot", "_k_spot")
    return joined.select(
        *[F.col(c) for c in sites.columns],
        spot["lat"].alias("lat"), spot["lon"].alias("lon"),
        F.when(spot.isNotNull(), "precise").alias("coord_source"),
    )


def inherit_missing(
    sites: DataFrame, levels: Sequence[tuple[str, str]] = (("mid_basin", "inherited"), ("major_basin", "coarse"))
) -> DataFrame:
    """Fill missing coordinates with the mean of the group, level by level; filled rows count at the next level."""
    out = sites
    for level, tag in levels:
        means = out.filter("lat is not null").groupBy(level).agg(F.avg("lat").alias("_lat"), F.avg("lon").alias("_lon"))
        fills = F.col("lat").isNull() & F.col("_lat").isNotNull()
        out = out.join(means, level, "left").select(
            *[c for c in out.columns if c not in ("lat", "lon", "coord_source")],
            F.coalesce("lat", "_lat").alias("lat"),
            F.when(fills, F.col("_lon")).otherwise(F.col("lon")).alias("lon"),
            F.when(fills, F.lit(tag)).otherwise(F.col("coord_source")).alias("coord_source"),
        )
    return out


def _codes(places: DataFrame) -> DataFrame:
    """Integer positions of the stations along each axis of the cube around all of them."""
    axes = ("ux", "uy", "uz")
    span = places.agg(F.struct(*[F.min(a).alias(a) for a in axes]).alias("low"),
                      F.greatest(*[F.max(a) - F.min(a) for a in axes], F.lit(1e-12)).alias("size"))
    framed = places.withColumn("_cube", span.select(F.struct("*")).scalar())
    top = (1 << GRID_BITS) - 1
    return framed.select(*places.columns, *[
        F.least(F.floor((F.col(a) - F.col(f"_cube.low.{a}")) / F.col("_cube.size") * (1 << GRID_BITS)), F.lit(top)).cast("long").alias(f"_{a[1]}")
        for a in axes
    ])


def _cell(codes: Sequence[Column], depth: int) -> Column:
    """Cell of a space-halving grid after ``depth`` halvings of each axis, as one number."""
    drop = GRID_BITS - depth
    x, y, z = (F.shiftright(c, drop) for c in codes)
    return F.shiftleft(x, 42).bitwiseOR(F.shiftleft(y, 21)).bitwiseOR(z)


def _leaf_depth(stations: DataFrame) -> int:
    """Fewest halvings after which no cell holds more than ``LEAF_STATIONS`` stations."""
    depths = list(range(LEVEL_BITS, 21, LEVEL_BITS))
    cells = stations.select(F.explode(F.array(*[
        F.struct(F.lit(d).alias("depth"), _cell([F.col("_x"), F.col("_y"), F.col("_z")], d).alias("cell")) for d in depths
    ])).alias("c")).select("c.*")
    fullest = cells.groupBy("depth", "cell").count().groupBy("depth").agg(F.max("count").alias("most"))
    fits = fullest.filter(F.col("most") <= LEAF_STATIONS).agg(F.min("depth")).first()[0]
    return fits or depths[-1]


def _boxes(stations: DataFrame, depth: int) -> DataFrame:
    """Tight bounding box of the stations in each cell."""
    codes = [F.col("_x"), F.col("_y"), F.col("_z")]
    return stations.groupBy(
        _cell(codes, depth - LEVEL_BITS).alias("parent"), _cell(codes, depth).alias("cell")
    ).agg(*[f(a).alias(f"{a}_{s}") for a in ("ux", "uy", "uz") for f, s in ((F.min, "lo"), (F.max, "hi"))])


def _bounds(box: Column) -> tuple[Column, Column]:
    """Squared straight-line distance from the point (px, py, pz) to the nearest and farthest spot of a box."""
    near, far = F.lit(0.0), F.lit(0.0)
    for point, axis in (("px", "ux"), ("py", "uy"), ("pz", "uz")):
        lo, hi = box[f"{axis}_lo"], box[f"{axis}_hi"]
        gap = F.greatest(lo - F.col(point), F.col(point) - hi, F.lit(0.0))
        reach = F.greatest(F.abs(F.col(point) - lo), F.abs(F.col(point) - hi))
        near, far = near + gap * gap, far + reach * reach
    return near, far


def nearest_station(
    points: DataFrame, stations: DataFrame, station_id: str, order: str, lat: str = "lat", lon: str = "lon"
) -> DataFrame:
    """Add the nearest station's id and distance to every point; equal distances go to the lowest ``order``.

    Stations are summarised as nested cells. Each point walks down from the coarsest cells, keeping only
    those that can still hold its nearest station, so a point meets a handful of cells per level and at
    most ``LEAF_STATIONS`` stations in each cell left at the end. Pairs are never enumerated.
    """
    ux, uy, uz = unit_vector(F.col("_slat"), F.col("_slon"))
    places = stations.groupBy(F.col(lat).alias("_slat"), F.col(lon).alias("_slon")).agg(
        F.min(order).alias("_order"), F.min_by(station_id, order).alias("_station")
    ).dropna()
    places = settle(places.select("*", ux.alias("ux"), uy.alias("uy"), uz.alias("uz")))
    places = settle(_codes(places))
    depth = _leaf_depth(places)

    px, py, pz = unit_vector(F.col("_plat"), F.col("_plon"))
    spots = settle(points.select(F.col(lat).alias("_plat"), F.col(lon).alias("_plon")).dropna().distinct().withColumn("_spot", F.monotonically_increasing_id()))
    # sized by their few bytes, some tasks would get all spots and sort all their pairs with cells and stations
    tasks = max(1, -(-spots.count() // SPOTS_PER_TASK))
    spots = spots.repartition(tasks, "_spot")
    spots = spots.select("*", px.alias("px"), py.alias("py"), pz.alias("pz"))
    # at most 64 cells exist at the first level, whatever the station count
    roots = _boxes(places, LEVEL_BITS).agg(F.collect_list(F.struct("*"))).scalar()
    candidates = spots.withColumn("box", F.explode(roots))
    point = ["_spot", "_plat", "_plon", "px", "py", "pz"]
    best = Window.partitionBy("_spot")
    for level in range(LEVEL_BITS, depth + 1, LEVEL_BITS):
        if level > LEVEL_BITS:
            children = _boxes(places, level)
            children = children.select(F.col("parent").alias("_parent"), F.struct("*").alias("box"))
            candidates = candidates.join(children, "_parent").select(*point, "box")
        near, far = _bounds(F.col("box"))
        candidates = (
            candidates.select(*point, "box", near.alias("near"), far.alias("far"))
            .withColumn("limit", F.min("far").over(best))
            .filter(F.col("near") <= F.col("limit") * (1 + SLACK) + F.lit(1e-15))
            .select(*point, F.col("box.cell").alias("_parent"))
        )
    leaves = places.select(
        _cell([F.col("_x"), F.col("_y"), F.col("_z")], depth).alias("_parent"), "_slat", "_slon", "_order", "_station"
    )
    distance = great_circle_km(F.col("_plat"), F.col("_plon"), F.col("_slat"), F.col("_slon"))
    found = candidates.repartition(tasks, "_parent").join(leaves.repartition(tasks, "_parent"), "_parent").groupBy("_spot", "_plat", "_plon").agg(
        F.min_by(F.struct("_station", distance.alias("_km")), F.struct(distance.alias("d"), F.col("_order"))).alias("_hit")
    )
    return points.join(found, (F.col(lat) == F.col("_plat")) & (F.col(lon) == F.col("_plon")), "left").select(
        *points.columns, F.col("_hit._station").alias(station_id), F.col("_hit._km").alias("dist_km")
    )


def distance_summary(mapping: DataFrame, station_id: str) -> DataFrame:
    middle = exact_quantiles(mapping, [], "dist_km", {"median": 0.5})
    return mapping.agg(
        F.count("*").alias("points"), F.countDistinct(station_id).alias("stations_used"), F.max("dist_km").alias("dist_max")
    ).withColumn("dist_median", middle.scalar())
