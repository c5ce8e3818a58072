"""The message record: schema, constructors, text helpers, equality and JSON."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = T.StructType(
    [
        T.StructField("Type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("image_url", T.StructType([T.StructField("url", T.StringType()), T.StructField("detail", T.StringType())])),
    ]
)
CALL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("function", T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())])),
    ]
)
#: Metadata is JSON text in a record and an object in a payload; ``canonical`` makes equal trees equal text.
MESSAGE = T.StructType(
    [
        T.StructField("Role", T.StringType()),
        T.StructField("Content", T.ArrayType(PART)),
        T.StructField("Name", T.StringType()),
        T.StructField("ToolCalls", T.ArrayType(CALL)),
        T.StructField("ToolCallID", T.StringType()),
        T.StructField("Metadata", T.StringType()),
    ]
)


def _col(value: Column | str | None, kind: str = "string") -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(kind)


def text_part(text: Column | str) -> Column:
    return F.struct(F.lit("text").alias("Type"), _col(text).alias("text"), F.lit(None).cast(PART["image_url"].dataType).alias("image_url"))


def image_part(url: Column | str, detail: Column | str | None = None) -> Column:
    image = F.struct(_col(url).alias("url"), _col(detail).alias("detail"))
    return F.struct(F.lit("image_url").alias("Type"), F.lit(None).cast("string").alias("text"), image.alias("image_url"))


def tool_call(call_id: Column | str, name: Column | str, arguments: Column | str) -> Column:
    function = F.struct(_col(name).alias("name"), _col(arguments).alias("arguments"))
    return F.struct(_col(call_id).alias("id"), F.lit("function").alias("type"), function.alias("function"))


def multipart_message(
    role: Column | str,
    parts: Column,
    name: Column | str | None = "",
    tool_calls: Column | None = None,
    tool_call_id: Column | str | None = "",
    metadata: Column | str | None = None,
) -> Column:
    """A message of an array of parts; a cast gives every field its place and type."""
    calls = F.lit(None) if tool_calls is None else tool_calls
    made = F.struct(
        _col(role).alias("Role"), parts.cast(T.ArrayType(PART)).alias("Content"), _col(name).alias("Name"),
        calls.cast(T.ArrayType(CALL)).alias("ToolCalls"), _col(tool_call_id).alias("ToolCallID"), _col(metadata).alias("Metadata"),
    )
    return made.cast(MESSAGE)


def text_message(role: Column | str, text: Column | str, **fields) -> Column:
    """A message of one text part."""
    return multipart_message(role, F.array(text_part(text)), **fields)


def first_text(message: Column) -> Column:
    return F.get(F.filter(message["Content"], lambda p: p["Type"] == "text"), F.lit(0))["text"]


def all_text(message: Column) -> Column:
    texts = F.transform(F.filter(message["Content"], lambda p: p["Type"] == "text"), lambda p: p["text"])
    return F.array_join(texts, "")


def truncated(text: Column, size: int) -> Column:
    """At most ``size`` characters, with ``...`` after a cut."""
    return F.when(F.char_length(text) > size, F.concat(F.left(text, F.lit(size)), F.lit("..."))).otherwise(text)


def canonical(metadata: Column) -> Column:
    """Metadata text such that equal trees have equal text: sorted keys, no white space, 1.0 as 1.

    A number in scientific notation is a double and equals doubles only. Text that is no JSON, or has a key
    twice, stays as it is.
    """
    return F.coalesce(F.to_json(F.try_parse_json(metadata)), metadata)


def normalised(message: Column) -> Column:
    """A message whose missing strings and lists are empty and whose metadata are canonical; an absent image stays absent."""
    blank = F.lit("")
    parts = F.transform(
        F.coalesce(message["Content"], F.array().cast(T.ArrayType(PART))),
        lambda p: F.struct(
            F.coalesce(p["Type"], blank).alias("Type"),
            F.coalesce(p["text"], blank).alias("text"),
            F.when(
                p["image_url"].isNotNull(),
                F.struct(F.coalesce(p["image_url"]["url"], blank).alias("url"), F.coalesce(p["image_url"]["detail"], blank).alias("detail")),
            ).alias("image_url"),
        ),
    )
    calls = F.coalesce(message["ToolCalls"], F.array().cast(T.ArrayType(CALL)))
    metadata = F.coalesce(F.nullif(canonical(message["Metadata"]), F.lit("{}")), blank)
    return F.struct(
        F.coalesce(message["Role"], blank).alias("Role"), parts.alias("Content"), F.coalesce(message["Name"], blank).alias("Name"),
        calls.alias("ToolCalls"), F.coalesce(message["ToolCallID"], blank).alias("ToolCallID"), metadata.alias("Metadata"),
    )


def messages_equal(a: Column, b: Column) -> Column:
    return normalised(a).eqNullSafe(normalised(b))


def histories_equal(a: Column, b: Column) -> Column:
    """Equality of two arrays of messages; null and empty arrays are equal."""
    none = F.array().cast(T.ArrayType(MESSAGE))
    left, right = (F.transform(F.coalesce(x, none), normalised) for x in (a, b))
    return left.eqNullSafe(right)


def canonical_json(value: object) -> str:
    """JSON text of a metadata tree such that equal trees have equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def to_payload(message: Column) -> Column:
    """JSON text of a message, with metadata as an object (text that is no JSON as a string)."""
    metadata = message["Metadata"]
    tree = F.coalesce(F.try_parse_json(metadata), metadata.cast("variant"))
    return F.when(message.isNotNull(), F.to_json(message.withField("Metadata", tree)))


def from_payload(payload: Column) -> Column:
    """The message of a JSON text, with canonical metadata, which may be an object or quoted; text that is no object fails the query."""
    checked = F.when(
        payload.isNotNull() & ~F.startswith(F.ltrim(payload), F.lit("{")),
        F.raise_error(F.concat(F.lit("decode: not a message: "), payload)),
    ).otherwise(payload)
    held = F.from_json(checked, MESSAGE, {"mode": "FAILFAST"})
    return F.when(held.isNotNull(), held.withField("Metadata", canonical(held["Metadata"])))
