"""Constants shared by all operators. They must stay as they are."""

# Fixed values.
REGION_BBOX = (-17.0, 27.0, -1.0, 36.0)  # lon_min, lat_min, lon_max, lat_max
ZONE_1_NM = 12
ZONE_2_NM = 200
NM_PER_DEGREE = 60.0
TILE_SIZE = 512
TILE_OVERLAP = 0.5
TILE_STRIDE = max(1, int(TILE_SIZE * (1 - TILE_OVERLAP)))
HALO = 16
LEE_KERNEL = 5
DB_MIN, DB_MAX = -30.0, 0.0
MODEL_INPUT = 640
PRIORITY_LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
PROCESSING_CODES = {
    "A": "raw",
    "B": "sigma0",
    "C": "sigma0_lee",
    "D": "sigma0_lee_log",
    "E": "sigma0_lee_log_mvssd",
}
TLE_TTL_HOURS = 24
EMPTY_TILES_PER_SCENE = 80
TILES_PER_SCENE_CAP = 600
DENSITY_CELL_DEG = 0.5
DENSITY_LOOKBACK_DAYS = 30
TARGET_ZONES = 5
NODATA_LIMIT = 0.30
AIS_LOOKBACK_DAYS = 3
MIN_SCENE_AGE_DAYS = 3
SEARCH_WINDOW_DAYS = 90
DETECTOR_CONFIDENCE, DETECTOR_NMS_IOU = 0.25, 0.45
BENCHMARK_CONFIDENCE, BENCHMARK_NMS_IOU, MATCH_IOU = 0.25, 0.5, 0.5
LABEL_CLASSES = {"AIS_confirmed": 0, "visual_only": 1, "dark_vessel_candidate": 2}
SEED_SOURCE = "ais_presence_amorce"
GAP_SOURCE = "ais_off_candidate"
FALLBACK_PROTOCOL = "seasonal_criteria_fallback"
DENSITY_PROTOCOL = "PH0-CORR-002_density_targeted"
PRODUCT_TYPE = "IW_GRDH_1S"
FIRST_TILE_MARGIN_DEG = 0.0005
GROUND_TRUTH_MARGIN_PX = 5.0
EVENT_LIST_CAP = 1000
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_195.0  # one degree of arc on that sphere, rounded up

# Keyword groups and their length range in metres (first group that matches wins).
VESSEL_LENGTHS = (
    (("tanker", "cargo", "container"), 100.0, 350.0),
    (("fishing", "trawler", "longliner"), 10.0, 40.0),
    (("passenger", "pleasure", "yacht"), 30.0, 150.0),
    (("tug", "supply", "offshore"), 20.0, 80.0),
)
OTHER_VESSEL_LENGTH = (10.0, 300.0)
# Share of each length range when the vessel type is unknown.
UNTYPED_LENGTHS = ((0.60, 10.0, 40.0), (0.90, 40.0, 120.0), (1.0, 120.0, 350.0))
BLOOM_RANGE, JITTER_RANGE, ASPECT_RANGE = (1.8, 3.5), (0.8, 1.2), (3.0, 6.0)
PIXEL_METRES = 10.0
