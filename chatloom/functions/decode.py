"""Text of binary message bodies."""

from __future__ import annotations

import plistlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ARCHIVE = b"\x04\x0bstreamtyped"
#: Strings that name classes and attributes of an archive, not text.
METADATA = frozenset(("NSMutableAttributedString", "NSAttributedString", "NSMutableString", "NSString", "NSDictionary", "NSObject", "NSFont", "NSColor", "streamtyped"))
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]+")
_EDGE = "\0\1\2\3\4\5\6\7\b\t\n\r "


def is_metadata(s: str) -> bool:
    s = s.strip()
    return s in METADATA or s.startswith("__kIM") or s.startswith("kIM") and s.endswith("AttributeName")


def best(candidates: Iterable[str]) -> str | None:
    """The candidate with the most lower-case letters and spaces, then the longest, then with the fewest underscores; the first of equals."""
    top: tuple | None = None
    for c in candidates:
        c = c.strip(_EDGE)
        if c and not is_metadata(c) and any(x.isprintable() or x.isspace() for x in c):
            s = c.strip()
            rank = (sum(x.islower() or x.isspace() for x in s), len(s), -s.count("_"))
            if top is None or rank > top[0]:
                top = (rank, c)
    return top and top[1]


def mapping_strings(value: object) -> Iterator[str]:
    """Strings of a property list: its dictionaries' keys and values, not the members of its lists."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            stack.extend(x for pair in reversed(list(v.items())) for x in reversed(pair))


def archive_strings(raw: bytes) -> Iterator[str]:
    """Length-prefixed strings (marker '+', then a byte, or 0x81 and two bytes, or 0x82 and four) of a typed stream."""
    at = raw.find(b"+")
    while at >= 0 and at + 1 < len(raw):
        n, start = raw[at + 1], at + 2
        if n in (0x81, 0x82):
            width = 2 if n == 0x81 else 4
            n, start = int.from_bytes(raw[start : start + width], "little"), start + width
        piece = raw[start : start + n]
        text = None
        if n and len(piece) == n:
            try:
                text = piece.decode("utf-8")
            except UnicodeDecodeError:
                text = None
        if text is not None:
            yield text
        at = raw.find(b"+", start + n if text is not None else at + 1)


def decode_body(value: object) -> str | None:
    if isinstance(value, str):
        return value.strip() or None
    if not isinstance(value, (bytes, bytearray, memoryview)) or not len(value):
        return None
    raw = bytes(value)
    try:
        found = best(mapping_strings(plistlib.loads(raw)))
    except Exception:  # plistlib raises many kinds on what is no property list
        found = None
    if found:
        return found
    if raw.startswith(ARCHIVE):
        strings = list(archive_strings(raw))
        if strings:
            # The visible text is the archive's first string; attribute names follow it.
            return best(strings[:1]) or best(strings)
    return best(_CONTROL.split(raw.decode("utf-8", errors="ignore")))


@F.pandas_udf(StringType())
def decode_bodies(bodies: pd.Series) -> pd.Series:
    return bodies.map(decode_body).astype(object).where(lambda s: s.notna(), None)
