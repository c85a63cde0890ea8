"""HMAC-SHA256 and base64url as native column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC as lower-case hex. The key is required; an empty one is refused."""
    if not key:
        raise ValueError("a signing key is required")
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(first)), 256)


def base64url(data: Column) -> Column:
    """Unpadded base64 with the URL alphabet."""
    return F.rtrim(F.translate(F.regexp_replace(F.base64(data), r"[\r\n]", ""), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    """Text behind unpadded base64url; NULL when it is malformed."""
    good = F.rlike(text, F.lit(r"\A[A-Za-z0-9_-]+\z")) & (F.char_length(text) % 4 != 1)
    return F.when(good, F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64")).cast("string"))
