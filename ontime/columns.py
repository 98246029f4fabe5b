"""Names and codes of the flight and weather tables: defaults of the operators' arguments."""

# --- fixed values: columns, packed fields and codes as the data providers define them ---

FLIGHT_COLUMNS = """
ACTUAL_ELAPSED_TIME AIR_TIME ARR_DEL15 ARR_DELAY ARR_DELAY_GROUP ARR_DELAY_NEW ARR_TIME ARR_TIME_BLK
CARRIER_DELAY CRS_ARR_TIME CRS_DEP_TIME CRS_ELAPSED_TIME DAY_OF_MONTH DAY_OF_WEEK DEP_DEL15 DEP_DELAY
DEP_DELAY_GROUP DEP_DELAY_NEW DEP_TIME DEP_TIME_BLK DEST DEST_AIRPORT_ID DEST_AIRPORT_SEQ_ID
DEST_CITY_MARKET_ID DEST_CITY_NAME DEST_STATE_ABR DEST_STATE_FIPS DEST_STATE_NM DEST_WAC DISTANCE
DISTANCE_GROUP FL_DATE MONTH NAS_DELAY OP_CARRIER OP_CARRIER_AIRLINE_ID OP_CARRIER_FL_NUM OP_UNIQUE_CARRIER
ORIGIN ORIGIN_AIRPORT_ID ORIGIN_AIRPORT_SEQ_ID ORIGIN_CITY_MARKET_ID ORIGIN_CITY_NAME ORIGIN_STATE_ABR
ORIGIN_STATE_FIPS ORIGIN_STATE_NM ORIGIN_WAC QUARTER SECURITY_DELAY TAIL_NUM YEAR
""".split()
FLIGHT_TEXT_COLUMNS = """
DEST_CITY_MARKET_ID OP_CARRIER_AIRLINE_ID OP_CARRIER_FL_NUM ORIGIN_AIRPORT_SEQ_ID DEST_AIRPORT_ID ARR_DELAY_GROUP
DEP_DELAY_GROUP MONTH DISTANCE_GROUP DEST_AIRPORT_SEQ_ID ORIGIN_CITY_MARKET_ID QUARTER YEAR
""".split()
FLIGHT_KEYS = ["FL_DATE", "CRS_DEP_TIME", "DEST_AIRPORT_ID", "ORIGIN_AIRPORT_ID"]
DELAY_CAUSES = ["NAS_DELAY", "SECURITY_DELAY", "CARRIER_DELAY"]

WEATHER_COLUMNS = "STATION DATE SOURCE LATITUDE LONGITUDE ELEVATION NAME REPORT_TYPE CALL_SIGN QUALITY_CONTROL".split()
WEATHER_KEYS = ["STATION", "DATE", "SOURCE", "REPORT_TYPE"]
STATION_COLUMNS = "station_id lat lon neighbor_id neighbor_name neighbor_state neighbor_call distance_to_neighbor".split()
AIRPORT_COLUMNS = ["ident", "elevation_ft", "iata_code", "coordinates"]

#: Packed sensor fields: subfields in order, `:int` marks numbers, the rest is text.
PACKED_FIELDS = {
    "WND": "DirectionAngle:int DirectionQuality Type Speed:int SpeedQuality",
    "CIG": "CeilingHeightDim:int CeilingQuality CeilingDetermination CeilingAndVisibilityOK",
    "VIS": "Horizontal:int DistanceQuality Variability VariabilityQuality",
    "TMP": "Value:int Quality",
    "DEW": "Value:int Quality",
    "SLP": "Value:int Quality",
    "AA": "RainDuration:int RainDepth:int RainCondition RainQuality",
    "AJ": "SnowDepth:int SnowDepthCondition SnowDepthQuality SnowEqWaterDepth:int SnowEqWaterDepthCondition SnowEqWaterDepthQuality",
    "AL": "SnowAccumDuration:int SnowAccumDepth:int SnowAccumCondition SnowAccumQuality",
    "AW": "PresentWeatherCond:int PresentWeatherQuality",
}
#: How often the packed fields with numbered columns repeat.
REPEATED_FIELDS = {"AA": 4, "AJ": 1, "AL": 3, "AW": 4}

#: Quality subfield: the value subfields it vouches for.
QUALITY_OF = {
    "WND": {"DirectionQuality": ["DirectionAngle"], "SpeedQuality": ["Speed"]},
    "CIG": {"CeilingQuality": ["CeilingHeightDim"]},
    "VIS": {"DistanceQuality": ["Horizontal"], "VariabilityQuality": ["Variability"]},
    "TMP": {"Quality": ["Value"]},
    "DEW": {"Quality": ["Value"]},
    "SLP": {"Quality": ["Value"]},
    "AA": {"RainQuality": ["RainDuration", "RainDepth"]},
    "AJ": {"SnowDepthQuality": ["SnowDepth"], "SnowEqWaterDepthQuality": ["SnowEqWaterDepth"]},
    "AL": {"SnowAccumQuality": ["SnowAccumDuration", "SnowAccumDepth"]},
    "AW": {"PresentWeatherQuality": ["PresentWeatherCond"]},
}
BAD_QUALITY = ["2", "3", "6", "7"]

#: Subfield: the code that stands for a missing value.
MISSING_CODES = {
    "WND": {"DirectionAngle": 999, "Type": "9", "Speed": 9999},
    "CIG": {"CeilingHeightDim": 99999, "CeilingDetermination": "9", "CeilingAndVisibilityOK": "9"},
    "VIS": {"Horizontal": 999999, "Variability": "9"},
    "TMP": {"Value": 9999},
    "DEW": {"Value": 9999},
    "SLP": {"Value": 99999},
    "AA": {"RainDuration": 99, "RainDepth": 9999},
    "AJ": {"SnowDepth": 9999, "SnowEqWaterDepth": 999999},
    "AL": {"SnowAccumDuration": 99, "SnowAccumDepth": 999},
}

#: Columns that tell the outcome, repeat others, or were constant or nearly empty in the data.
LEAKING = """
ACTUAL_ELAPSED_TIME AIR_TIME ARR_DEL15 ARR_DELAY ARR_DELAY_GROUP ARR_DELAY_NEW ARR_TIME CRS_ELAPSED_TIME
DEP_DELAY DEP_DELAY_GROUP DEP_DELAY_NEW DEP_TIME DEP_TIME_BLK
NAS_DELAY OP_CARRIER SECURITY_DELAY CARRIER_DELAY
""".split()
DATE_COLUMNS = ["FL_DATE", "WEATHER_WINDOW_START", "WEATHER_WINDOW_END"]
REDUNDANT = """
DEST_AIRPORT_ID DEST_AIRPORT_SEQ_ID DEST_CITY_NAME DEST_STATE_FIPS DEST_STATE_NM DEST_WAC OP_CARRIER_AIRLINE_ID
OP_UNIQUE_CARRIER ORIGIN_AIRPORT_ID ORIGIN_AIRPORT_SEQ_ID ORIGIN_STATE_FIPS ORIGIN_STATE_NM ORIGIN_WAC ident
ORIGIN_CITY_NAME
""".split()
CONSTANT = ["CARRIER_DELAY"]
NEARLY_EMPTY = """
WND_SpeedQuality AL1_SnowAccumQuality AA4_RainQuality AL2_SnowAccumQuality AL3_SnowAccumDuration AL3_SnowAccumDepth
AW4_PresentWeatherQuality AL2_SnowAccumCondition AA4_RainCondition AJ1_SnowEqWaterDepthCondition
AJ1_SnowDepthCondition CIG_CeilingAndVisibilityOK AL3_SnowAccumCondition CIG_CeilingDetermination
AA1_RainCondition AA3_RainCondition AA2_RainCondition AL1_SnowAccumCondition
""".split()

#: How the features of a flight are shaped.
ZERO_WHEN_MISSING = ["AL_SnowAccumDepth", "AJ1_SnowEqWaterDepth", "AA_RainDuration", "VIS_Variability", "AA_RainDepth"]
MEAN_WHEN_MISSING = ["WND_Speed", "SLP_Value", "AL_SnowAccumDuration", "AJ1_SnowDepth"]
MEDIAN_WHEN_MISSING = ["CIG_CeilingHeightDim", "VIS_Horizontal", "WND_DirectionAngle", "DEW_Value"]
GROUP_OF_FLIGHT = ["OP_CARRIER_FL_NUM", "TAIL_NUM"]
AVERAGED_READINGS = """
TMP_Value DEW_Value VIS_Horizontal SLP_Value AA_RainDepth AA_RainDuration AL_SnowAccumDuration AL_SnowAccumDepth
AJ1_SnowDepth AJ1_SnowEqWaterDepth WND_Speed WND_DirectionAngle CIG_CeilingHeightDim
""".split()
MODE_READINGS = """
AW1_PresentWeatherCond AW2_PresentWeatherCond AW3_PresentWeatherCond AW4_PresentWeatherCond VIS_Variability WND_Type
""".split()
#: Borders of the parts of a day in hhmm.
DAY_PARTS = [0, 900, 1200, 1600, 2000, 2359]

# --- end of fixed values ---


def packed_columns() -> dict[str, str]:
    """Column name -> family of the packed field, numbered columns written out."""
    out = {}
    for family in PACKED_FIELDS:
        n = REPEATED_FIELDS.get(family, 0)
        out |= {f"{family}{i}": family for i in range(1, n + 1)} or {family: family}
    return out


def by_column(spec: dict[str, dict]) -> dict[str, object]:
    """A per-family dictionary of subfields, written out as column_subfield -> value."""
    return {f"{c}_{sub}": v for c, family in packed_columns().items() for sub, v in spec.get(family, {}).items()}


def quality_columns() -> dict[str, list[str]]:
    """Quality column -> the value columns it vouches for."""
    return {f"{c}_{flag}": [f"{c}_{v}" for v in values] for c, family in packed_columns().items() for flag, values in QUALITY_OF[family].items()}
