"""Dimension tables: aspect taxonomy, thresholds, reliability priors, spec keys.

Everything here is tiny (9 tops, 29 subs, 32 bridge pairs, ~50 spec keys), so the
DataFrames are built from literals and joined with ``broadcast``; their size is fixed
by the taxonomy, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical results)
# ---------------------------------------------------------------------------

TOP_LABELS = [
    "battery & charging",
    "build quality & design",
    "camera",
    "customer experience",
    "device features & functionality",
    "device performance",
    "display",
    "price & value",
    "software & ux",
]

SUB_LABELS = [
    "ai assistants & smart features",
    "audio & speakers",
    "battery & charging comparisons",
    "battery capacity",
    "battery charging speed",
    "battery life & health",
    "build quality, design, durability & ergonomics",
    "camera features",
    "camera quality",
    "connectivity & wireless standards",
    "customer service & warranty",
    "customization & ui",
    "display aesthetics",
    "display defects",
    "display quality",
    "display visual performance",
    "essentials & expansion",
    "general features",
    "processor performance",
    "product perception",
    "repair & replacement costs",
    "software experience, features & system settings",
    "software issues & bugs",
    "software updates & support longevity",
    "stylus & input accessories",
    "technical performance & storage specs",
    "thermals",
    "user experience",
    "value for money & deals",
]

SUB_RELIABILITY = [
    0.8928571428571428, 0.8651162790697675, 0.36113549897570973, 0.6940559440559441,
    0.6666666666666667, 0.7956043956043957, 0.6553846153846155, 0.8131609870740306,
    0.7065546218487395, 0.7850045167118338, 0.788888888888889, 0.8235294117647058,
    0.5662285136501517, 0.4878048780487805, 0.6631016042780749, 0.7664219838132882,
    0.7384510869565217, 0.6359975594874924, 0.7638773819386909, 0.7453310696095077,
    0.9561904761904761, 0.7852925389157273, 0.46938775510204084, 0.8106591865357644,
    0.6607142857142857, 0.747520629873571, 0.8133848133848134, 0.753880266075388,
    0.6421311139914045,
]

TOP_THRESHOLDS = [
    0.1969960277715784, 0.22856181358436206, 0.18800807278012546, 0.42076735866421744,
    0.188429153663433, 0.24591746689126756, 0.20983471186315358, 0.4365670657497739,
    0.28280920588737424,
]

SUB_THRESHOLDS = [
    0.21957855014040917, 0.19366260893855475, 0.3255171298899038, 0.33183340156273944,
    0.4857037846005992, 0.15174583400932873, 0.46007111169795345, 0.2251651060265043,
    0.19376815494901492, 0.37150065067605836, 0.18189744496786836, 0.24164270074532695,
    0.19298219650317167, 0.37682619636156556, 0.33005044535839734, 0.21131058711565034,
    0.36170617432524893, 0.15047266734171708, 0.22541301215386067, 0.1947837737010123,
    0.4699332847555047, 0.310423688681474, 0.36948024421953063, 0.16785958723525482,
    0.39575850055892337, 0.24538317976204244, 0.4431052867303466, 0.19942697545930543,
    0.47837218061864795,
]

TOP_TO_SPECS = {
    0: ["Battery_Charging", "Battery_Type", "Our_Tests_Battery", "Our_Tests_Battery_(old)"],
    1: ["Body_Dimensions", "Body_Build", "Body_Weight", "Misc_Colors", "Misc_Models"],
    2: ["Main_Camera_Single", "Main_Camera_Dual", "Main_Camera_Triple", "Main_Camera_Quad",
        "Main_Camera_Video", "Main_Camera_Features", "Selfie_camera_Single", "Selfie_camera_Dual",
        "Selfie_camera_Video", "Selfie_camera_Features", "Our_Tests_Camera"],
    3: ["Launch_Announced"],
    4: ["Features_Sensors", "Sound_3.5mm_jack", "Comms_Infrared_port", "Memory_Card_slot",
        "Sound_Loudspeaker", "Our_Tests_Loudspeaker", "Network_Technology", "Network_GPRS",
        "Network_EDGE"],
    5: ["Platform_CPU", "Platform_GPU", "Memory_Internal", "Our_Tests_Performance"],
    6: ["Display_Type", "Display_Size", "Display_Resolution", "Display_Protection", "Our_Tests_Display"],
    7: [],
    8: ["Platform_OS"],
}

DROP_SPEC_KEYS = [
    "Network_2G_bands", "Network_3G_bands", "Network_4G_bands", "Network_5G_bands",
    "Network_Speed", "Launch_Status", "Body_SIM", "Platform_Chipset", "Comms_WLAN",
    "Comms_Bluetooth", "Comms_Positioning", "Comms_NFC", "Comms_Radio", "Comms_USB",
    "Misc_Price", "EU_LABEL_Energy", "EU_LABEL_Battery", "EU_LABEL_Free_fall",
    "EU_LABEL_Repairability", "Misc_SAR", "Misc_SAR_EU",
]

# Scalar parameters of the pipeline.
COMPARISON_THRESHOLD = 0.7
CONFIDENCE_ALPHA = 0.8
CONFIDENCE_BETA = 0.6
CONFIDENCE_GAMMA = 24.0
CONFIDENCE_PHI = 1.0
SENTIMENT_TEMPERATURE = 1.2
RELEVANCE_THRESHOLD = 0.7
USEFULNESS_GATE = 7.0
REVIEW_USEFULNESS_THRESHOLD = 8.0
MIN_EVIDENCE = 10          # a product needs MORE than this many gated reviews
TOP_REVIEWS_COUNT = 5
SUB_ASPECT_REVIEWS_COUNT = 3
MAX_POSTS = 50
MAX_COMMENTS_PER_POST = 20
RELIABILITY_FLOOR = 0.65
RELIABILITY_EXPONENT = 0.8

# Taxonomy (top -> subs). The reference loads it from an asset that is not shipped;
# this is our stated assumption (README groups for battery, camera, performance and
# display; the rest assigned so that all 29 subs have a parent).
TAXONOMY = {
    0: [2, 3, 4, 5],
    1: [6, 19],
    2: [7, 8],
    3: [10, 20, 27, 28],
    4: [0, 1, 9, 16, 17, 24],
    5: [18, 25, 26],
    6: [12, 13, 14, 15],
    7: [20, 28],
    8: [11, 21, 22, 23, 27],
}

N_TOP = len(TOP_LABELS)
N_SUB = len(SUB_LABELS)


def _check() -> None:
    """Shape and range checks of the fixed values (import-time table constraints)."""
    assert N_TOP == 9 and N_SUB == 29
    assert len(TOP_THRESHOLDS) == N_TOP and len(SUB_THRESHOLDS) == N_SUB
    assert len(SUB_RELIABILITY) == N_SUB
    assert set(TOP_TO_SPECS) == set(range(N_TOP))
    for v in TOP_THRESHOLDS + SUB_THRESHOLDS + SUB_RELIABILITY:
        assert 0.0 <= v <= 1.0
    for t, subs in TAXONOMY.items():
        assert 0 <= t < N_TOP and all(0 <= s < N_SUB for s in subs)


_check()


def taxonomy_pairs(taxonomy: dict[int, list[int]] | None = None) -> list[tuple[int, int]]:
    tx = TAXONOMY if taxonomy is None else taxonomy
    return sorted((t, s) for t, subs in tx.items() for s in subs)


def parents_of(taxonomy: dict[int, list[int]] | None = None) -> list[list[int]]:
    """parents[s] = sorted top indices that own sub s."""
    par: list[list[int]] = [[] for _ in range(N_SUB)]
    for t, s in taxonomy_pairs(taxonomy):
        par[s].append(t)
    return par


# ---------------------------------------------------------------------------
# Dimension DataFrames (all broadcast-sized by construction)
# ---------------------------------------------------------------------------

def dim_top(spark: SparkSession) -> DataFrame:
    rows = [(i, TOP_LABELS[i], float(TOP_THRESHOLDS[i])) for i in range(N_TOP)]
    return spark.createDataFrame(rows, "top_idx INT, top_name STRING, top_thr DOUBLE")


def dim_sub(spark: SparkSession) -> DataFrame:
    rows = [(i, SUB_LABELS[i], float(SUB_THRESHOLDS[i]), float(SUB_RELIABILITY[i])) for i in range(N_SUB)]
    return spark.createDataFrame(rows, "sub_idx INT, sub_name STRING, sub_thr DOUBLE, reliability DOUBLE")


def dim_taxonomy(spark: SparkSession, taxonomy: dict[int, list[int]] | None = None) -> DataFrame:
    return spark.createDataFrame(taxonomy_pairs(taxonomy), "top_idx INT, sub_idx INT")


def dim_spec(spark: SparkSession) -> DataFrame:
    rows = [(t, k, o) for t, keys in TOP_TO_SPECS.items() for o, k in enumerate(keys)]
    return spark.createDataFrame(rows, "top_idx INT, spec_key STRING, ord INT")


def dim_drop_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k,) for k in DROP_SPEC_KEYS], "spec_key STRING")


# Literal array columns: used inside row expressions so the hierarchy mask needs no join.

def lit_doubles(values) -> F.Column:
    return F.array(*[F.lit(float(v)).cast("double") for v in values])


def top_thr_col() -> F.Column:
    return lit_doubles(TOP_THRESHOLDS)


def sub_thr_col() -> F.Column:
    return lit_doubles(SUB_THRESHOLDS)


def parents_col(taxonomy: dict[int, list[int]] | None = None) -> F.Column:
    return F.array(*[F.array(*[F.lit(t) for t in ps]).cast("array<int>") for ps in parents_of(taxonomy)])


SCORED_SCHEMA = T.StructType([
    T.StructField("review_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("relevance", T.DoubleType()),
    T.StructField("usefulness", T.DoubleType()),
    T.StructField("top", T.ArrayType(T.DoubleType())),
    T.StructField("sub", T.ArrayType(T.DoubleType())),
    T.StructField("comp", T.ArrayType(T.DoubleType())),
    T.StructField("sent", T.ArrayType(T.StructType([
        T.StructField("neg", T.DoubleType()), T.StructField("pos", T.DoubleType())]))),
])
