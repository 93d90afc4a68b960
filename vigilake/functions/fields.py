"""Fields of an event as string columns, and its searchable text."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALWAYS = ["stage", "session_id", "channel", "user_id"]
OPTIONAL = ["message_text", "tool_name", "tool_result", "model"]


_hoisted: ContextVar[set[str] | None] = ContextVar("hoisted", default=None)


@contextmanager
def hoisted() -> Iterator[set[str]]:
    """Within, arguments are read from columns of their own (:func:`with_arguments`); the set has the names of those read."""
    names: set[str] = set()
    token = _hoisted.set(names)
    try:
        yield names
    finally:
        _hoisted.reset(token)


def with_arguments(df: DataFrame, names: set[str]) -> DataFrame:
    """A prepared table with a column for each argument: looked up once, not by every rule."""
    return df.withColumns({f"_arg_{n}": _argument(n) for n in sorted(names)}) if names else df


def _argument(name: str) -> Column:
    return F.when(F.col("tool_name").isNotNull(), F.try_element_at(F.col("_args"), F.lit(name)))


def prepare(events: DataFrame) -> DataFrame:
    """``events`` with what rules read: ``_args`` (arguments as text), ``_text``, ``_lower``, ``_ts``; parsed once.

    ``_fold`` (lower case, with letters that stand for ASCII ones in expressions without case), ``_len`` and ``_digits``
    (digits side by side) tell texts that an expression can't match.

    ``_args`` holds strings as they are and other values as compact JSON with sorted keys, JSON null as "null".
    ``_strings`` holds those that are strings.  Arguments that aren't a JSON object count as none.
    """
    parsed = events.withColumn("_var", F.try_variant_get(F.try_parse_json("tool_args"), "$", "map<string,variant>"))
    is_string = lambda v: F.schema_of_variant(v) == "STRING"
    as_text = lambda v: F.when(is_string(v), v.cast("string")).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
    strings = F.transform_values(F.map_filter("_var", lambda k, v: is_string(v)), lambda k, v: v.cast("string"))
    out = parsed.withColumns({"_args": F.transform_values("_var", lambda k, v: as_text(v)), "_strings": strings}).drop("_var")
    out = out.withColumn("_text", searchable_text())
    out = out.withColumns({"_lower": F.lower("_text"), "_ts": timestamp_text(), "_len": F.length("_text"), "_digits": F.col("_text").rlike(r"(?U)\d\d")})
    return out.withColumn("_fold", F.translate("_lower", "\u017f\u212a\u0307", "sk"))


def searchable_text() -> Column:
    """Message, string arguments by key, and the result if it is a string, a line each."""
    entries = F.array_sort(F.map_entries(F.coalesce("_strings", F.create_map().cast("map<string,string>"))))
    return F.array_join(F.array_compact(F.concat(F.array("message_text"), F.transform(entries, lambda e: e["value"]), F.array(F.when(F.col("tool_result_is_string"), F.col("tool_result"))))), "\n")


def timestamp_text() -> Column:
    """Seconds as text: whole ones without a fraction, none with an exponent."""
    t = F.col("timestamp")
    text = F.regexp_replace(t.cast("decimal(38,9)").cast("string"), r"\.?0+$", "")
    return F.when(t == F.floor(t), t.cast("long").cast("string")).otherwise(text)


def field(name: str) -> Column:
    """The flat field ``name`` of a prepared event; null where the event hasn't it."""
    if name == "timestamp":
        return F.col("_ts")
    if name in ALWAYS or name in OPTIONAL:
        return F.col(name)
    if name.startswith("tool_args."):
        arg, names = name.removeprefix("tool_args."), _hoisted.get()
        if names is None:
            return _argument(arg)
        names.add(arg)
        return F.col(f"`_arg_{arg.replace('`', '``')}`")
    return F.lit(None).cast("string")


def activation(name: str) -> Column:
    """The field that an identifier stands for: dots are written as underscores."""
    if name in ("timestamp", *ALWAYS, *OPTIONAL):
        return field(name)
    if name.startswith("tool_args_"):
        wanted = name.removeprefix("tool_args_")
        direct = field(f"tool_args.{wanted}")
        if "_" not in wanted:
            return direct
        dotted = F.map_filter("_args", lambda k, v: F.replace(k, F.lit("."), F.lit("_")) == wanted)
        return F.coalesce(direct, F.when(F.col("tool_name").isNotNull(), F.get(F.map_values(dotted), 0)))
    return F.lit(None).cast("string")


def flat_fields() -> Column:
    """All flat fields of a prepared event as a map."""
    fixed = F.map_from_arrays(F.array(*map(F.lit, [*ALWAYS, "timestamp"])), F.array(*map(F.col, ALWAYS), F.col("_ts")))
    own = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, OPTIONAL)), F.array(*map(F.col, OPTIONAL))), lambda k, v: v.isNotNull())
    args = F.when(F.col("tool_name").isNotNull() & F.col("_args").isNotNull(), F.transform_keys("_args", lambda k, v: F.concat(F.lit("tool_args."), k)))
    return F.map_concat(fixed, own, F.coalesce(args, F.create_map().cast("map<string,string>")))


def activation_map() -> Column:
    return F.transform_keys(flat_fields(), lambda k, v: F.replace(k, F.lit("."), F.lit("_")))
