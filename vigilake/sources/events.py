"""Event logs and hook logs, and tables of other things seen as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.schema import EVENT, STAGES, as_events

_CORRUPT = "_corrupt_record"
# In logs, arguments and results are JSON of any shape; read as text.
_LOG = T.StructType([T.StructField(f.name, T.StringType() if f.name in ("tool_args", "tool_result") else f.dataType) for f in EVENT.fields if f.name != "tool_result_is_string"] + [T.StructField("params", T.StringType()), T.StructField("raw", T.StringType()), T.StructField(_CORRUPT, T.StringType())])


def _parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines of JSON -> (events, rejects): rejects don't parse or name no known stage."""
    # streams have no row numbers: a number drawn for the row stands in
    place = F.xxhash64("value", "_file", F.uuid() if lines.isStreaming else F.monotonically_increasing_id())
    read = lines.select("value", "_arrived", place.alias("_place"), F.from_json("value", _LOG, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("e"))
    whole = F.try_parse_json("value")
    result = F.try_variant_get(whole, "$.tool_result", "variant")
    kind = F.schema_of_variant(result)
    text = F.when(kind == "STRING", F.try_variant_get(whole, "$.tool_result", "string")).when(kind != "VOID", F.to_json(result))
    rows = read.select("value", "_arrived", "_place", "e.*", text.alias("_result"), F.coalesce(kind == "STRING", F.lit(False)).alias("tool_result_is_string"))
    rows = rows.withColumns({"tool_result": F.col("_result"), "event_id": F.coalesce("event_id", "_place"), "timestamp": F.coalesce("timestamp", "_arrived")}).drop("_result", "_place", "_arrived")
    fine = F.col(_CORRUPT).isNull() & F.coalesce(F.col("stage").isin(STAGES), F.lit(False))
    return as_events(rows.filter(fine).drop(_CORRUPT, "value")), rows.filter(~fine).select("value")


def _seconds(when: Column) -> Column:
    return F.unix_micros(when) / 1_000_000.0


def parse_events(lines: DataFrame, arrived: Column | float | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON lines in a column ``value``.

    A line without a ``timestamp`` has the time at which it ``arrived``, in seconds: a column of ``lines``, a number, or now.
    A line without an ``event_id`` gets one from what it says and where it stands, so that equal lines are events of their
    own; the same in every run over the same partitions.  Columns ``params`` and ``raw`` of the events are JSON text.
    """
    when = _seconds(F.current_timestamp()) if arrived is None else arrived if isinstance(arrived, Column) else F.lit(float(arrived))
    return _parsed(lines.select("value", when.cast("double").alias("_arrived"), F.lit("").alias("_file")))


def _of_files(lines: DataFrame, arrived: float | None) -> DataFrame:
    when = _seconds(F.col("_metadata.file_modification_time")) if arrived is None else F.lit(float(arrived))
    return lines.select("value", when.alias("_arrived"), F.concat("_metadata.file_path", F.lit(":"), F.col("_metadata.file_block_start")).alias("_file"))


def read_events(spark: SparkSession, path: str, arrived: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a log of JSON lines.  Nothing is dropped: what is no event is a reject.

    Lines without a ``timestamp`` have ``arrived`` (seconds) or else the time of their file; ids as in :func:`parse_events`.
    """
    return _parsed(_of_files(spark.read.text(path), arrived))


def read_events_stream(spark: SparkSession, path: str, arrived: float | None = None) -> DataFrame:
    """A stream of the events of JSON lines in new files of ``path``, with ``event_time`` to watermark on.

    Lines without an ``event_id`` get one that is drawn for them: a batch that is run again after a failure draws anew.
    """
    return with_event_time(_parsed(_of_files(spark.readStream.text(path), arrived))[0])


def with_event_time(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("long")))


def events_from_hooks(hooks: DataFrame) -> DataFrame:
    """Lifecycle hooks (hook, sessionId, toolName, params, result, text, content, channel, userId, ts_ms) as events.

    A call before a tool, one after it with its result, and a received message, whose text falls back on its
    content; other hooks are left out.  Results that aren't strings are JSON text.
    """
    hook = F.col("hook")
    stage = F.when(hook == "before_tool_call", "tool.before").when(hook == "after_tool_call", "tool.after").when(hook == "message_received", "message.before")
    tool = hook != "message_received"
    rows = hooks.withColumn("stage", stage).filter("stage is not null")
    return as_events(
        rows.select(
            F.col("event_id"),
            "stage",
            F.col("sessionId").alias("session_id"),
            "channel",
            F.col("userId").alias("user_id"),
            (F.col("ts_ms") / 1000.0).alias("timestamp"),
            F.when(~tool, F.coalesce("text", "content")).alias("message_text"),
            F.when(tool, F.col("toolName")).alias("tool_name"),
            F.when(tool, F.col("params")).alias("tool_args"),
            F.when(hook == "after_tool_call", F.col("result")).alias("tool_result"),
        )
    )


def documents_as_results(documents: DataFrame) -> DataFrame:
    """Each document as the result of reading a file."""
    return as_events(documents.select(F.col("doc_id").alias("event_id"), F.lit("tool.after").alias("stage"), F.col("source").alias("session_id"), F.lit("read_file").alias("tool_name"), F.col("text").alias("tool_result")))


def conversations_as_messages(conversations: DataFrame) -> DataFrame:
    """Users' turns as messages, others' as results of a tool without a name."""
    user = F.col("role") == "user"
    return as_events(conversations.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("event_id"), F.when(user, "message.before").otherwise("tool.after").alias("stage"), F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("double").alias("timestamp"), F.when(user, F.col("text")).alias("message_text"), F.when(~user, F.col("text")).alias("tool_result")))


def pages_as_fetches(pages: DataFrame) -> DataFrame:
    """Each page as the result of fetching it."""
    return as_events(pages.select(F.col("page_id").alias("event_id"), F.lit("tool.after").alias("stage"), F.lit("fetch").alias("tool_name"), F.to_json(F.struct("url")).alias("tool_args"), F.col("html").alias("tool_result")))
