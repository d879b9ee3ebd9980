"""Canonical event schema and the fixed values every job shares."""

from pyspark.sql import types as T

MINUTE_MS = 60_000
HOUR_MS = 60 * MINUTE_MS
DAY_MS = 24 * HOUR_MS

# Fixed values of the feature definitions and the evaluation protocol.
SESSION_GAP_MS = 30 * MINUTE_MS
LAST_EVENT_CAP_MS = DAY_MS
HISTORY_LEN = 50
HORIZON_MS = 30 * MINUTE_MS
EVENT_TYPES = ("view", "addtocart", "transaction")
EVENT_WEIGHTS = {"view": 1.0, "addtocart": 3.0, "transaction": 5.0}
ANN_K = 500
N_RECENT = 50
EVAL_KS = (10, 50)
SEEN_HEADROOM = 50
POPULAR_LIMIT = 1000
POPULARITY_WINDOWS = (3, 7, 14, 30, None)
PRUNE_MIN_GAIN = 0.005
MAX_VALID_NDCG_DROP = 0.002
CHECK_OFFSETS_MS = (1, 2 * MINUTE_MS, 10 * MINUTE_MS, SESSION_GAP_MS + 1, 2 * HOUR_MS, DAY_MS)
PAD_INDEX, OOV_INDEX, FIRST_ITEM_INDEX = 0, 1, 2

EVENT_COLUMNS = ["ts_ms", "user_id", "item_id", "event", "transaction_id"]

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("ts_ms", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("transaction_id", T.LongType()),
    ]
)

RAW_CSV_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.LongType()),
        T.StructField("visitorid", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("itemid", T.LongType()),
        T.StructField("transactionid", T.LongType()),
    ]
)

RAW_TO_CANONICAL = {
    "timestamp": "ts_ms",
    "visitorid": "user_id",
    "itemid": "item_id",
    "transactionid": "transaction_id",
}
