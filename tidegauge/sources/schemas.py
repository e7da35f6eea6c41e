"""Fixed schemas of the supported inputs."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names of the measurement service and the standard column each one fills.
MEASUREMENT_FIELDS = {
    "SWMN_CODE": "site_code",
    "SWMN_NM": "site_name",
    "SWMN_DETAIL_NM": "site_detail_name",
    "RIVER_LKMH_SE": "water_body_type",
    "DETAIL_ADRES": "detail_address",
    "CHCK_DE": "date",
    "IEM_WTRTP": "water_temp",
    "IEM_PH": "ph",
    "IEM_DOC": "dissolved_oxygen",
    "IEM_TRP": "transparency",
    "IEM_TUR": "turbidity",
    "IEM_CHLA": "chlorophyll_a",
    "IEM_BGALAGE_CELL_CO": "cyano_cells",
    "IEM_BGALAGE_MICROSTS": "cyano_microcystis",
    "IEM_BGALAGE_ANBA": "cyano_anabaena",
    "IEM_BGALAGE_OSRTRIA": "cyano_oscillatoria",
    "IEM_BGALAGE_APZO": "cyano_aphanizomenon",
    "IEM_GEOSM": "geosmin",
    "IEM_MIB2": "mib_2",
    "IEM_MICROSTLR": "microcystin_lr",
}

# Field names of the daily weather service.
WEATHER_FIELDS = {
    "stnId": "station_id",
    "stnNm": "station_name",
    "tm": "date",
    "avgTa": "temp_avg",
    "minTa": "temp_min",
    "maxTa": "temp_max",
    "sumRn": "precip",
    "avgWs": "wind_avg",
    "maxWs": "wind_max",
    "avgRhm": "humidity_avg",
    "sumSsHr": "sunshine_hours",
    "sumGsr": "solar_radiation",
    "avgTca": "cloud_avg",
    "avgTs": "surface_temp_avg",
}

MEASUREMENT_KEYS = ["site_code", "site_name", "site_detail_name", "water_body_type", "detail_address"]
WEATHER_KEYS = ["station_id", "station_name"]
MEASURES = [c for c in MEASUREMENT_FIELDS.values() if c not in MEASUREMENT_KEYS and c != "date"]
WEATHER_MEASURES = [c for c in WEATHER_FIELDS.values() if c not in WEATHER_KEYS and c != "date"]

# Column order of the headerless export; the last five columns are not kept.
EXPORT_COLUMNS = [
    "water_body_type", "site_name", "site_detail_name", "date", *MEASURES,
    "mc_rr", "mc_la", "mc_yr", "mc_lf", "mc_ly",
]
# The two water body types of the export, river and lake.
WATER_BODY_TYPES = ["하천", "호소"]

# Column order of the site master file.
SITE_COLUMNS = [
    "station_type", "site_code", "site_name", "survey_location",
    "address", "agency", "major_basin", "mid_basin",
]

# Channels a cycler file must have, and their types.
CYCLER_CHANNELS = {
    "Data_Point": T.LongType(),
    "Test_Time(s)": T.DoubleType(),
    "Step_Time(s)": T.DoubleType(),
    "Step_Index": T.IntegerType(),
    "Cycle_Index": T.IntegerType(),
    "Current(A)": T.DoubleType(),
    "Voltage(V)": T.DoubleType(),
    "Charge_Capacity(Ah)": T.DoubleType(),
    "Discharge_Capacity(Ah)": T.DoubleType(),
}

# Columns of the labelled series and of the scenario table.
SERIES_COLUMNS = [
    "cell_id", "cycle", "capacity_ah", "initial_capacity", "soh",
    "eol_threshold", "eol_confirmation_cycles", "eol_cycle", "is_modeling_cycle",
]
SCENARIO_COLUMNS = [
    "scenario_id", "scenario_type", "forecast_origin", "horizon", "true_eol_cycle", "true_rul", "includes_eol",
]


def text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])
