"""Keyed pseudonyms and content ids, from built-in hash functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SHAPE = r"\A[0-9a-f]{24}\z"


def pads(key: bytes) -> tuple[bytes, bytes]:
    """HMAC's inner and outer key blocks."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def pseudonym(value: Column, key: bytes, namespace: str) -> Column:
    """The first 24 hex digits of HMAC-SHA256(key, namespace NUL value). The key's blocks are literals of the plan."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(key))
    payload = F.concat(F.lit(namespace + "\0"), value.cast("string")).cast("binary")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, payload), 256))), 256), 1, 24)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def session_id(chat: Column, start_ns: Column, end_ns: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", chat, start_ns.cast("string"), end_ns.cast("string"), text), 256), 1, 24)


def hash_shaped(*ids: Column) -> Column:
    ok = F.lit(True)
    for c in ids:
        ok = ok & F.coalesce(c.rlike(HASH_SHAPE), F.lit(False))
    return ok
