"""The event table: columns, stages, actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ["message.before", "params.before", "tool.before", "tool.after"]
# From mildest to strictest; an action's place is its priority.
ACTIONS = ["allow", "detect", "redact", "block"]
PRIORITY = {a: i for i, a in enumerate(ACTIONS)}

EVENT = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("stage", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("message_text", T.StringType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("tool_args", T.StringType()),  # a JSON object
        T.StructField("tool_result", T.StringType()),
        T.StructField("tool_result_is_string", T.BooleanType()),
        T.StructField("model", T.StringType()),
    ]
)

RESULT = "struct<evaluator:string,eval_type:string,ord:int,action:string,confidence:double,reason:string,redacted:string,rule_id:string,title:string,description:string,match:string,keyword:string>"


def as_events(df: DataFrame) -> DataFrame:
    """``df`` with all event columns: missing ones added, empty strings for null keys; other columns stay."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT.fields]
    out = df.select(*cols, *[c for c in df.columns if c not in EVENT.names])
    filled = {c: F.coalesce(F.col(c), F.lit("")) for c in ("session_id", "channel", "user_id")}
    return out.withColumns(filled | {"tool_result_is_string": F.coalesce("tool_result_is_string", F.col("tool_result").isNotNull())})


def ts_us(col: str = "timestamp") -> Column:
    """Seconds as a double -> whole microseconds, which windows order by."""
    return F.round(F.col(col) * 1_000_000).cast("long")
