"""Canonical column types."""

from pyspark.sql import types as T

TEXT_FIELDS = (
    "question", "input", "prompt", "text", "answer", "output", "response", "target", "source", "split", "type",
    "context", "subject", "explanation", "instruction", "specialty", "severity_level", "language",
)
RAW_ROW = T.StructType(
    [T.StructField(f, T.StringType()) for f in TEXT_FIELDS] + [T.StructField("options", T.ArrayType(T.StringType()))]
)
# a file is an array of rows, an object that holds the rows in one of three lists, or one row
ENVELOPE = T.StructType(
    [*RAW_ROW.fields, *[T.StructField(f, T.ArrayType(RAW_ROW)) for f in ("data", "entries", "questions")]]
)
PREDICTION_LOG = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType())),
    ]
)
AUDIT_LOG = "user_id string, question string, answer string, sources string, processing_time double, created_at timestamp"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
