"""Column contracts and fixed parameters.

The values in the "fixed values" block must equal the ones the original
pipeline uses, otherwise features, splits and thresholds come out different.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values (must match the original pipeline) ---------------------
LOG_COLUMNS = [
    "timestamp",
    "client_ip",
    "endpoint_uri",
    "http_method",
    "response_time_ms",
    "status_code",
    "bytes_sent",
]
LABEL_COLUMNS = ["is_anomaly", "anomaly_type"]
COLUMN_ALIASES = {"response_time": "response_time_ms"}
FEATURE_COLUMNS = [
    "response_time_log1p",
    "status_class",
    "is_5xx",
    "is_4xx",
    "request_rate",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
    "endpoint_freq",
    "method_code",
    "bytes_sent_log1p",
    "ip_error_rate",
    "ip_avg_latency",
]
METHOD_CODES = {"GET": 0, "POST": 1, "PUT": 2, "DELETE": 3, "PATCH": 4, "HEAD": 5, "OPTIONS": 6}
UNKNOWN_METHOD_CODE = -1
RANDOM_STATE = 42
TRAIN_RATIO = 0.70
VAL_RATIO = 0.15
RATE_WINDOW_SECONDS = 60
N_ESTIMATORS = 300
CONTAMINATION = 0.08
MAX_SAMPLES = 256
THRESHOLD_STEPS = 200
HISTORY_DEFAULT_LIMIT = 200
HISTORY_IP_MAX_LEN = 45
HISTORY_ENDPOINT_MAX_LEN = 512
DEFAULT_ANOMALY_TYPE = "normal"
# text the original writes for a missing string value (pandas str() of NaN)
MISSING_TEXT = "nan"
# ---- end of fixed values --------------------------------------------------

STATUS_MIN = 100
STATUS_MAX_EXCLUSIVE = 600

# Raw logs are always read as text and parsed explicitly (never inferred).
RAW_LOG_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), True) for c in LOG_COLUMNS + LABEL_COLUMNS]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("timestamp", T.TimestampNTZType(), False),
        T.StructField("client_ip", T.StringType(), False),
        T.StructField("endpoint_uri", T.StringType(), False),
        T.StructField("response_time_ms", T.DoubleType(), False),
        T.StructField("status_code", T.IntegerType(), False),
        T.StructField("anomaly_score", T.DoubleType(), False),
        T.StructField("is_anomaly", T.BooleanType(), False),
        T.StructField("predicted_at", T.TimestampType(), False),
    ]
)
HISTORY_COLUMNS = [f.name for f in HISTORY_SCHEMA.fields]

# What a result table shows, in this order, and what each column is called there.
RESULT_CAPTIONS = [
    ("timestamp", "Requested at"), ("client_ip", "Client"), ("endpoint_uri", "Path"), ("http_method", "Verb"),
    ("response_time_ms", "Took (ms)"), ("status_code", "Status"), ("bytes_sent", "Size (bytes)"),
    ("anomaly_score", "Score"), ("is_anomaly_pred", "Flagged"),
]
