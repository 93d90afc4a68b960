"""Events from logs of language-model requests and responses, and what decisions do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.schema import as_events

_BLOCK = "struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string>"
_MESSAGE = "struct<role:string,content:string>"
_REQUEST = f"struct<metadata:struct<session_id:string>,messages:array<{_MESSAGE}>>"
_RESPONSE = "struct<content:array<string>>"
DEFAULT_REASON = "Blocked by security policy"


def _blocks(content: Column) -> Column:
    """Content blocks of a message; a plain string is one text block."""
    return F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.from_json(content, f"array<{_BLOCK}>")).otherwise(F.array(F.struct(F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")])).cast(f"array<{_BLOCK}>"))


def _texts(blocks: Column) -> Column:
    return F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])


def _requests(req: DataFrame) -> DataFrame:
    """(request_id, session_id, messages, last): ``last`` is the last user message's blocks."""
    parsed = req.select("request_id", F.from_json("body", _REQUEST).alias("b"), *_time(req))
    last = F.try_element_at(F.filter("messages", lambda m: m["role"] == "user"), F.lit(-1))["content"]
    rows = parsed.select("request_id", F.coalesce("b.metadata.session_id", F.lit("")).alias("session_id"), F.col("b.messages").alias("messages"), *_time(parsed))
    return rows.withColumn("last", _blocks(last))


def _time(records: DataFrame) -> list[str]:
    """Records of a stream have an ``event_time``, which their events keep."""
    return [c for c in records.columns if c == "event_time"]


def _plain(content: Column) -> Column:
    """What a tool result says: its text blocks, or the text that it is."""
    return F.when(F.substring(F.ltrim(content), 1, 1) == "[", F.array_join(F.filter(_texts(F.from_json(content, f"array<{_BLOCK}>")), lambda t: t != ""), " ")).otherwise(content)


def own_events(req: DataFrame) -> DataFrame:
    """(request_id, own): how many events a request makes itself, before there is a response."""
    rows = _requests(req)
    said = F.coalesce((F.array_join(_texts(F.col("last")), "\n") != "").cast("int"), F.lit(0))
    results = F.filter("last", lambda b: (b["type"] == "tool_result") & (_plain(b["content"]) != ""))
    return rows.select("request_id", (said + F.coalesce(F.size(results), F.lit(0))).alias("own"), *_time(rows)).withColumn("own", F.greatest("own", F.lit(0)))


def user_message_events(req: DataFrame) -> DataFrame:
    """(request_id, ...event): the last user message of each request (body JSON), text blocks a line each; none without text."""
    rows = _requests(req).withColumn("message_text", F.array_join(_texts(F.col("last")), "\n")).filter("message_text <> ''")
    return as_events(rows.select("request_id", "session_id", F.lit("message.before").alias("stage"), "message_text", *_time(rows)))


def tool_result_events(req: DataFrame) -> DataFrame:
    """(request_id, pos, ...event): results in the last user message, named by the calls that they answer.

    A result whose call isn't in the request is named by the call's id; of equal ids the last call counts.
    """
    rows = _requests(req)
    calls = F.flatten(F.transform(F.filter("messages", lambda m: m["role"] == "assistant"), lambda m: F.filter(_blocks(m["content"]), lambda b: b["type"] == "tool_use")))
    each = rows.select("request_id", "session_id", *_time(rows), calls.alias("calls"), F.posexplode(F.filter("last", lambda b: b["type"] == "tool_result")).alias("pos", "r"))
    call = F.try_element_at(F.filter("calls", lambda c: c["id"] == F.col("r.tool_use_id")), F.lit(-1))
    named = each.select("request_id", "pos", "session_id", F.lit("tool.after").alias("stage"), F.coalesce(call["name"], F.col("r.tool_use_id")).alias("tool_name"), _plain(F.col("r.content")).alias("tool_result"), *_time(each))
    return as_events(named.filter("tool_result <> ''"))


def resolve_tool_names(results: DataFrame, calls: DataFrame) -> DataFrame:
    """``results`` (request_id, tool_use_id, ...) with tool_name from ``calls`` (request_id, tool_use_id, pos, name) in tables of their own."""
    last = calls.groupBy("request_id", "tool_use_id").agg(F.max_by("name", "pos").alias("_name"))
    return results.join(last, ["request_id", "tool_use_id"], "left").withColumn("tool_name", F.coalesce("_name", "tool_use_id")).drop("_name")


def _object_or_none(text: Column) -> Column:
    return F.when(F.substring(F.ltrim(text), 1, 1) == "{", text).otherwise(F.lit("{}"))


def tool_use_events(resp: DataFrame) -> DataFrame:
    """(response_id, pos, ...event): a call for each tool_use block of a response (body JSON); ``pos`` is the block's place."""
    rows = resp.select("response_id", *_time(resp), F.posexplode(F.from_json("body", _RESPONSE)["content"]).alias("pos", "raw")).withColumn("b", F.from_json("raw", _BLOCK)).filter("b.type = 'tool_use'")
    return as_events(rows.select("response_id", "pos", F.lit("tool.before").alias("stage"), F.coalesce("b.name", F.lit("")).alias("tool_name"), _object_or_none(F.coalesce(F.col("b.input"), F.lit("{}"))).alias("tool_args"), *_time(rows)))


_CHUNK = "struct<type:string,index:int,content_block:struct<type:string,name:string>,delta:struct<type:string,partial_json:string>>"


def _calls_of_records(chunks: DataFrame) -> DataFrame:
    """Records (stream_id, seq, data) parsed as ``d``, with ``_after``, which tells calls of a stream apart, and ``_in``: part of a call."""
    d = chunks.withColumn("d", F.from_json("data", _CHUNK))
    start = (F.col("d.type") == "content_block_start") & (F.col("d.content_block.type") == "tool_use")
    marked = d.withColumns({"_start": F.coalesce(start, F.lit(False)), "_stop": F.coalesce(F.col("d.type") == "content_block_stop", F.lit(False))})
    before = Window.partitionBy("stream_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # a start inside an open call is part of it: only the first start after a stop opens one
    marked = marked.withColumn("_after", F.coalesce(F.sum(F.col("_stop").cast("int")).over(before), F.lit(0)))
    span = Window.partitionBy("stream_id", "_after").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("_in", F.max(F.col("_start")).over(span))


def assemble_tool_calls(chunks: DataFrame) -> DataFrame:
    """(stream_id, block, ...event): tool calls put together from the records (stream_id, seq, data) of streamed responses.

    A call starts with its block's start, takes the parts of its input in order, and ends with its stop; calls
    without an end are dropped, input that isn't an object is empty.
    """
    done = _assembled(_calls_of_records(chunks)).withColumn("block", (F.row_number().over(Window.partitionBy("stream_id").orderBy("seq")) - 1).cast("int"))
    return as_events(done.select("stream_id", "block", F.lit("tool.before").alias("stage"), "tool_name", "tool_args"))


def _assembled(marked: DataFrame) -> DataFrame:
    """(stream_id, _after, seq, index, tool_name, tool_args) of the calls that end."""
    calls = marked.filter("_in").groupBy("stream_id", "_after").agg(
        F.min_by("d.content_block.name", F.when(F.col("_start"), F.col("seq"))).alias("name"),
        F.min_by("d.index", F.when(F.col("_start"), F.col("seq"))).alias("index"),
        F.max("_stop").alias("ended"),
        F.array_sort(F.collect_list(F.when(F.col("d.delta.type") == "input_json_delta", F.struct("seq", F.col("d.delta.partial_json").alias("part"))))).alias("parts"),
        F.min("seq").alias("seq"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    args = F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text).otherwise(F.lit("{}"))
    return calls.filter("ended").select("stream_id", "_after", "seq", "index", F.coalesce("name", F.lit("")).alias("tool_name"), args.alias("tool_args"))


def rewrite_records(records: DataFrame, evaluators: list) -> tuple[DataFrame, DataFrame]:
    """((stream_id, seq, nth, data), (stream_id, seq, data)): records to pass on, and those of calls that haven't ended.

    A blocked call's records give way to three that say so, in the place of its first; everything else stays as it is.
    """
    from vigilake.operators.chain import evaluate

    marked = _calls_of_records(records)
    found = _assembled(marked)
    decided = evaluate(as_events(found.withColumn("stage", F.lit("tool.before")).withColumn("event_id", F.xxhash64("stream_id", "_after"))), evaluators)
    verdicts = decided.select(F.col("stream_id").alias("_stream"), F.col("_after").alias("_call"), F.col("seq").alias("_first"), "index", "tool_name", "blocked", "reasons")
    rows = marked.select("stream_id", "seq", "data", "_after", "_in").join(verdicts, F.col("_in") & (F.col("stream_id") == F.col("_stream")) & (F.col("_after") == F.col("_call")), "left")
    waiting = rows.filter(F.col("_in") & F.col("blocked").isNull()).select("stream_id", "seq", "data")
    kept = rows.filter(~F.col("_in") | ~F.col("blocked")).select("stream_id", "seq", F.lit(0).alias("nth"), "data")
    bad = verdicts.filter("blocked").select(F.col("_stream").alias("stream_id"), F.col("_first").alias("block"), "index", "tool_name", "blocked", "reasons")
    made = replaced_records(bad).select("stream_id", F.col("block").alias("seq"), "nth", "data")
    return kept.unionByName(made), waiting


def traffic_events(req: DataFrame, resp: DataFrame) -> DataFrame:
    """All events of requests and their responses (response_id is the request's), ``step`` in the order of evaluation."""
    messages = user_message_events(req).withColumns({"pos": F.lit(0), "step": F.lit(0)})
    results = tool_result_events(req).withColumn("step", F.lit(1))
    uses = tool_use_events(resp).withColumnRenamed("response_id", "request_id").withColumn("step", F.lit(2))
    return messages.unionByName(results).unionByName(uses)


def gate_traffic(decisions: DataFrame) -> DataFrame:
    """Decisions that come to pass: none of a step after one with a block, none after the first blocked result of step 1.

    Blocked calls (step 2) don't hide each other.
    """
    stops = decisions.filter("blocked and step < 2").groupBy("request_id").agg(F.min(F.struct("step", "pos")).alias("_stop"))
    rows = decisions.join(stops, "request_id", "left")
    return rows.filter(F.col("_stop").isNull() | (F.struct("step", "pos") <= F.col("_stop"))).drop("_stop")


def forwarded(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """Requests none of whose own events (steps 0 and 1) is blocked."""
    return requests.join(decisions.filter("blocked and step < 2").select("request_id"), "request_id", "left_anti")


def _why() -> Column:
    return F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")).otherwise(F.lit(DEFAULT_REASON))


def rewrite_responses(resp: DataFrame, decisions: DataFrame) -> DataFrame:
    """(response_id, body): blocked calls become texts; a response left without calls ends the turn.

    ``decisions``: (response_id, pos, tool_name, blocked, reasons) of the calls.  Responses without a blocked call stay as
    they are, to the letter; the others keep all fields but ``content``, and ``stop_reason`` where the turn ends.
    """
    text = F.concat(F.lit("[SECURITY] Tool call '"), "tool_name", F.lit("' was blocked: "), _why())
    bad = decisions.filter("blocked").select("response_id", F.struct("pos", F.to_json(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("made")).alias("p"))
    rows = resp.join(bad.groupBy("response_id").agg(F.map_from_entries(F.collect_list("p")).alias("_bad")), "response_id", "left")
    variant = F.try_parse_json("body")
    fields = F.try_variant_get(variant, "$", "map<string,variant>")
    blocks = F.try_variant_get(variant, "$.content", "array<variant>")
    new = F.transform(blocks, lambda b, i: F.coalesce(F.try_element_at("_bad", i), F.to_json(b), F.lit("null")))
    calls = F.exists(F.transform(blocks, lambda b, i: F.when(F.try_element_at("_bad", i).isNull(), F.try_variant_get(b, "$.type", "string"))), lambda t: F.coalesce(t == "tool_use", F.lit(False)))
    ends = ~calls & F.coalesce(F.try_variant_get(variant, "$.stop_reason", "string") == "tool_use", F.lit(False))
    kept = F.transform(
        F.map_entries(fields),
        lambda e: F.concat(
            _quoted(e["key"]), F.lit(":"),
            F.when(e["key"] == "content", F.concat(F.lit("["), F.array_join(new, ","), F.lit("]"))).when((e["key"] == "stop_reason") & ends, F.lit('"end_turn"')).otherwise(F.coalesce(F.to_json(e["value"]), F.lit("null"))),
        ),
    )
    made = F.concat(F.lit("{"), F.array_join(kept, ","), F.lit("}"))
    return rows.select("response_id", F.when(F.col("_bad").isNotNull() & blocks.isNotNull(), made).otherwise(F.col("body")).alias("body"))


def _quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def replaced_records(calls: DataFrame) -> DataFrame:
    """(stream_id, block, nth, data): the records that take the place of a blocked call's in a streamed response.

    ``calls``: (stream_id, block, index, tool_name, blocked, reasons); ``index`` is the block's own in the stream.
    """
    at = F.coalesce(F.col("index").cast("string"), F.lit("0"))
    text = _quoted(F.concat(F.lit("[SECURITY] Tool '"), "tool_name", F.lit("' blocked: "), _why()))
    each = [
        F.concat(F.lit('{"type":"content_block_start","index":'), at, F.lit(',"content_block":{"type":"text","text":""}}')),
        F.concat(F.lit('{"type":"content_block_delta","index":'), at, F.lit(',"delta":{"type":"text_delta","text":'), text, F.lit("}}")),
        F.concat(F.lit('{"type":"content_block_stop","index":'), at, F.lit("}")),
    ]
    return calls.filter("blocked").select("stream_id", "block", F.posexplode(F.array(*each)).alias("nth", "data"))


def blocked_responses(decisions: DataFrame) -> DataFrame:
    """(request_id, text): what takes a blocked request's place."""
    return decisions.filter("blocked").select("request_id", F.concat(F.lit("[SECURITY BLOCK -- "), "stage", F.lit("] "), _why()).alias("text"))
