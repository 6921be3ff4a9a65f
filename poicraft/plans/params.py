"""Parameters of the registered queries (bound to the benchmark tables)."""

STREET_KEYWORDS = ["ring", "economy"]          # street keyword(s) + federal entity
BLANK_STREET_KEYWORDS = ["", "economy"]        # blank street keyword, reference mode
ANY_KEYWORDS = ["ring", "bolt", "promo"]
ADDRESS_KEYWORDS = ["the"]
BRANDS = ["Brand#1", "Brand#2", "Brand#3"]
TOP_N = 5
NAME_MAP = {"ring": "RNG", "bolt": "BLT", "red": "RED"}
AS_OF = "2019-05-23 12:00:00"
AS_OF_TEXT = "2019-05-23T12:00:00.000000Z"
MESH_X, MESH_Y = 60, 70
MESH_RESUME = 3144
SWEEP_SW, SWEEP_NE, SWEEP_CAP = (-1.0, -1.0), (1.0, 1.0), 3
BOX_SW, BOX_NE = (0.0, 0.0), (0.1, 0.1)
BOX_CATEGORY = "2"
CENTER, RADIUS_M, RADIUS_QUERY = (0.0, 0.0), 10_000.0, "vec3"
SEARCH_LIMIT = 20
SLICE_N, TAIL_FROM = 300, 14_000
VENUE_KEYS = ["cat1", "cat2", "cat3"]
RETAIL_KEYWORDS = ["#0000001", "nation_1"]
MAP_KEYWORDS = ["", "nation_1"]
RETAIL_NAME_MAP = {"NATION_1": "n1", "NATION_2": "n2", "de NATION": "otra"}
RETAIL_CATEGORY, RETAIL_KIND = "comercioPorMenor", "unidadEconomica"
LEGEND_N = 10
VENUE_TOP_N = 2
VENUE_KEYWORDS = ["in"]
COLORED_N = 2
BATCH_ENTITIES = 50
