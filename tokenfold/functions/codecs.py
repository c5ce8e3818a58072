"""Payload codecs: pairs of an encoder and a decoder, with a version that is kept beside each payload.

A payload of the plain JSON codec has no tag, as it begins with a brace. Any other is ``~name.version:``
and the encoded text, so a log may hold payloads of several codecs and versions and loads as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenfold.functions.messages import from_payload, to_payload


@dataclass(frozen=True)
class Codec:
    """``encode`` makes text of a message, ``decode`` a message of that text; pandas UDFs will do."""

    name: str
    version: int
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]

    def __post_init__(self):
        if not self.name.isalnum() or self.version < 1:
            raise ValueError("a codec needs a name of letters and digits, and a version from 1")

    @property
    def tag(self) -> str:
        return f"~{self.name}.{self.version}:"

    def pack(self, message: Column) -> Column:
        return F.concat(F.lit(self.tag), self.encode(message))


class JsonCodec(Codec):
    """JSON objects, whose metadata are objects too; untagged."""

    def __init__(self):
        super().__init__("json", 1, to_payload, from_payload)

    def pack(self, message: Column) -> Column:
        return to_payload(message)


JSON = JsonCodec()
#: JSON in base64, for stores that take letters and digits only.
BASE64 = Codec("base64", 1, lambda m: F.base64(F.encode(to_payload(m), "UTF-8")), lambda t: from_payload(F.decode(F.unbase64(t), "UTF-8")))


def unpack(payload: Column, codecs: Iterable[Codec] = (JSON, BASE64)) -> Column:
    """The message of a payload of any of ``codecs``; a tag of none of them fails the query. Null stays null."""
    unknown = F.raise_error(F.concat(F.lit("decode: unknown codec: "), F.substring(payload, 1, 40)))
    out = from_payload(F.when(F.startswith(payload, F.lit("~")), unknown).otherwise(payload))
    for codec in codecs:
        if not isinstance(codec, JsonCodec):
            own = F.startswith(payload, F.lit(codec.tag))
            out = F.when(own, codec.decode(F.when(own, F.substring(payload, F.lit(len(codec.tag) + 1), F.length(payload))))).otherwise(out)
    return out
