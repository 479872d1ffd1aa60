"""Token ids by a ready tokenizer file, whose path is a parameter. Vocabularies are never trained here.

The control tokens that a file lacks are added behind its ids. The driver reads the file and sends its text (a few MB) along; an executor's worker parses it once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONTROL_TOKENS

#: Characters of texts that are encoded at a time, at least one text: the library holds over a hundred bytes for each token of what it encodes in one call.
ENCODED_CHARS = 1 << 20


@lru_cache(maxsize=4)
def _parsed(text: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.add_special_tokens([c for c in CONTROL_TOKENS if t.token_to_id(c) is None])
    if len({t.token_to_id(c) for c in CONTROL_TOKENS}) < len(CONTROL_TOKENS):
        raise ValueError("control tokens share an id")
    return t


def source(path: str | Path) -> str:
    """The file's text; a folder is asked for its tokenizer.json."""
    path = Path(path)
    return (path / "tokenizer.json" if path.is_dir() else path).read_text(encoding="utf-8")


def load(path: str | Path):
    """The tokenizer with the control tokens, for use on the driver."""
    return _parsed(source(path))


def save(path: str | Path, place: str | Path) -> Path:
    """Writes the tokenizer with the control tokens as place/tokenizer.json."""
    from ..sources.files import private_dir, write_text

    return write_text(private_dir(place) / "tokenizer.json", load(path).to_str())


def _slices(texts: list[str | None], chars: int) -> Iterator[list[str | None]]:
    """texts in their order, cut before the text with which a slice would have more than `chars` characters."""
    first, n = 0, 0
    for i, x in enumerate(texts):
        k = len(x or "")
        if i > first and n + k > chars:
            yield texts[first:i]
            first, n = i, 0
        n += k
    if first < len(texts):
        yield texts[first:]


def encoded(text: Column, path: str | Path) -> Column:
    """Ids of a text, an array of int: control tokens that stand in it are their ids, none are added. A null has null. Texts are encoded and handed on by slices of ENCODED_CHARS, and in
    the task's own thread, so that neither a batch's rows nor the machine's cores decide what a worker holds."""
    held = source(path)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        t = _parsed(held)
        for b in batches:
            for part in _slices(b.tolist(), ENCODED_CHARS):
                got = iter([np.array(e.ids, np.int32) for e in t.encode_batch_fast([x for x in part if x is not None], add_special_tokens=False)])
                yield pd.Series([None if x is None else next(got) for x in part], dtype=object)

    return ids(text)


def decoded(ids: Column, path: str | Path, skip_control: bool = True) -> Column:
    """The text of ids, without control tokens by default."""
    held = source(path)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _parsed(held)
        for b in batches:
            yield pd.Series([None if x is None else t.decode([int(i) for i in x], skip_special_tokens=skip_control) for x in b], dtype=object)

    return text(ids)


def vocabulary(spark: SparkSession, path: str | Path) -> DataFrame:
    """(token, id), control tokens included."""
    return spark.createDataFrame(sorted(load(path).get_vocab(with_added_tokens=True).items(), key=lambda x: x[1]), "token string, id int")


def vocab_size(path: str | Path) -> int:
    return load(path).get_vocab_size(with_added_tokens=True)


def control_ids(path: str | Path) -> dict[str, int | None]:
    t = load(path)
    return {c: t.token_to_id(c) for c in CONTROL_TOKENS}


def encode_splits(sessions: DataFrame, path: str | Path, text: str = "text") -> DataFrame:
    """sessions with ids; all splits in one pass. stats.token_report gives the counts by split."""
    return sessions.withColumn("ids", F.coalesce(encoded(F.col(text), path), F.array().cast("array<int>")))


def training_report(path: str | Path) -> dict:
    """What a report on a tokenizer holds; that it was not trained here is part of it."""
    vocab = json.loads(source(path))["model"]["vocab"]
    return {"vocab_size": vocab_size(path), "base_vocab_size": len(vocab), "control_tokens": list(CONTROL_TOKENS), "training_source": "ready-made file, not trained here"}
