"""Text columns: normalisation, redaction of obvious identifiers, serialization."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import BOS, CONVERSATION, EMAIL, ME, OTHER, PHONE, TURN_END, URL

#: The patterns of obvious identifiers, applied in this order.
URL_PATTERN = r"(?iU)\b(?:https?://|www\.)\S+"
EMAIL_PATTERN = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE_PATTERN = r"(?U)(?<!\w)(?:\+?\d[\d ().-]{7,}\d)(?!\w)"
#: The code points that Unicode stripping removes.
STRIPPED = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC; there is no built-in for it."""
    return text.str.normalize("NFC")


def normalize(text: Column, compose: bool = True) -> Column:
    """NFC, LF line ends, no NUL or U+FFFC, one space for a run of blanks, stripped lines, at most three newlines in a row, stripped. Pure ASCII
    needs no composing, so only other texts take the way through Python."""
    t = F.when(text.rlike(r"[^\x00-\x7F]"), nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text) if compose else text
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.translate(t, "\x00\ufffc", "")
    t = F.regexp_replace(t, r"[\t\f\x0B ]+", " ")
    t = F.array_join(F.transform(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(STRIPPED))), "\n")
    return F.btrim(F.regexp_replace(t, r"\n{4,}", "\n\n\n"), F.lit(STRIPPED))


def redact(text: Column, urls: bool = True, emails: bool = True, phones: bool = True) -> Column:
    """URLs, then e-mail addresses, then phone shapes become control tokens; each class can be switched off."""
    for on, pattern, token in ((urls, URL_PATTERN, URL), (emails, EMAIL_PATTERN, EMAIL), (phones, PHONE_PATTERN, PHONE)):
        if on:
            text = F.regexp_replace(text, pattern, token)
    return text


def has_pii(text: Column) -> Column:
    return text.rlike(URL_PATTERN) | text.rlike(EMAIL_PATTERN) | text.rlike(PHONE_PATTERN)


def turn_line(role: Column, text: Column) -> Column:
    return F.concat(F.when(role == "me", ME).otherwise(OTHER), text, F.lit(TURN_END))


def delta(shown: Column, text: Column) -> Column:
    """What a text adds to the one shown before: the whole of it where it does not begin with that, or nothing was shown."""
    return F.when(F.startswith(text, shown), F.substr(text, F.length(shown) + 1)).otherwise(text)


def reply_prompt(history: Column, message: Column) -> Column:
    """The text a reply is generated after. history: array of (role, text), oldest first; null for none."""
    lines = F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,text:string>>")), lambda h: turn_line(h["role"], h["text"]))
    return F.array_join(F.concat(F.array(F.lit(BOS + CONVERSATION)), lines, F.array(turn_line(F.lit("other"), message), F.lit(ME))), "\n")
