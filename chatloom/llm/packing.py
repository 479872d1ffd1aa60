"""Cost-balanced packing of token sequences, in one pass over the documents and without a shuffle.

A document's cost is linear plus quadratic in its tokens (attention). Documents are cut into full sequences, and
their tails are packed block by block: a block's sequences are exactly as many as its tokens fill, the last tokens in sequences whose
capacities are powers of two, so that nothing is padded. Tails go, in descending cost, to the cheapest sequence that
still holds them; one that fits nowhere is cut to fill the roomiest. A block is a run of documents of one input partition.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, table

CAPACITY, BLOCK, CACHE = 2048, 4096, 200_000
LINEAR, QUADRATIC = 1.0, 1 / 1024
END = (1).to_bytes(4, "little")
TWO_SPACES = re.compile(r"\s\s")


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, dtype="<u4").tobytes()


class _Encoder:
    """Ids of texts as little-endian uint32 bytes, by the vocabulary of a byte-level BPE file.

    The pre-tokeniser always cuts before a single space between two characters that are not white space, so a text's ids are
    those of its space-separated pieces, and a piece's ids depend on nothing around it. Frequent pieces are looked up; the
    other pieces of a text are encoded together, and the lengths of the tokens tell where a piece ends. A text with two
    white-space characters in a row in that joined string is encoded as it is. The strings of the file's special tokens cut a text first, wherever
    they stand, and become their ids. Of two libraries that give equal ids, this takes the faster one (a test holds them together).
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken

        file = json.load(open(path, encoding="utf-8"))
        model, added = file["model"], file.get("added_tokens", [])
        if any(t[k] for t in added for k in ("lstrip", "rstrip", "single_word", "normalized")):
            raise ValueError("special tokens that take their surroundings in are not supported")
        self.special = {t["content"]: _bytes([t["id"]]) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if added else None
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(chars[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special and all(c in chars for c in t)}
        self.encode = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for t, i in ranks.items():
            self.width[i] = len(t)
        self.pieces: dict[str, bytes] = {}
        self.hits = self.misses = 0

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut and self.cut.search(text):
            return b"".join(self.special.get(part) or self.plain(part) for part in self.cut.split(text) if part)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        got = list(map(self.pieces.get, rest))
        if None in got:
            missing = [i for i, g in enumerate(got) if g is None]
            names = [rest[i] for i in missing]
            joined = " " + " ".join(names)
            if not first or first[-1].isspace() or joined[-1].isspace() or TWO_SPACES.search(joined):
                return _bytes(self.encode(text))
            ids = np.array(self.encode(joined), dtype="<u4")
            wide = np.fromiter((len(n.encode("utf-8", "surrogatepass")) for n in names), dtype=np.int64, count=len(names)) + 1
            ends = (np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(wide)) + 1) * 4
            raw, at = ids.tobytes(), 0
            for i, end in zip(missing, ends.tolist(), strict=True):
                got[i], at = raw[at:end], end
            if len(self.pieces) < CACHE:
                self.pieces.update(zip(names, map(got.__getitem__, missing), strict=True))
            self.misses += len(missing)
            self.hits += len(got) - len(missing)
            if self.misses > self.hits + 10 * CACHE:
                self.pieces.clear()
                self.hits = self.misses = 0
        elif not first or first[-1].isspace():
            return _bytes(self.encode(text))
        return _bytes(self.encode(first)) + b"".join(got)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def token_bytes(text: str | None, path: str) -> bytes:
    """The ids of a text, as the tokenizers library gives them without adding special tokens: those whose strings stand in the text are themselves."""
    return _encoder(path)(text)


def plan_block(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, sequence, offset) for items shorter than capacity, and the number of sequences."""
    total = sum(lengths)
    room = np.array([capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1], dtype=np.int64)
    cost, used, out = np.zeros(len(room)), np.zeros(len(room), dtype=np.int64), []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            s = int(np.where(fits, cost, np.inf).argmin()) if fits.any() else int(room.argmax())
            n = min(left, int(room[s]))
            out.append((item, start, n, s, int(used[s])))
            room[s] -= n
            used[s] += n
            cost[s] += LINEAR * n + QUADRATIC * n * n
            start, left = start + n, left - n
    return out, len(room)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece. Null and empty texts are one token, the end. Equal ids and null ids are documents of their own. Texts of any length are cut, never
    shortened. Other columns take no part, whatever their names. No rows give none.

    Sequence ids follow from the input partition and the place in it, so that a task that runs again gives the same ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sequence = TaskContext.get().partitionId() << 36
        tails: list[tuple] = []
        full: list[tuple] = []

        def flush() -> pd.DataFrame:
            nonlocal sequence, tails, full
            rows, full = full, []
            pieces, n = plan_block([len(t[2]) // 4 for t in tails], capacity)
            for i, start, length, s, at in pieces:
                doc, before, ids, tokens = tails[i]
                rows.append((doc, before + start, length, crc32(ids[4 * start : 4 * (start + length)]), tokens, sequence + s, at))
            sequence, tails = sequence + n, []
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            return frame.astype({"doc_id": "Int64"})

        for b in batches:
            for doc, text in zip(b["doc"].astype("Int64"), b["text"], strict=True):
                ids = token_bytes(text, tokenizer) + END
                tokens = len(ids) // 4
                cut = tokens // capacity * capacity
                for start in range(0, cut, capacity):
                    full.append((doc, start, capacity, crc32(ids[4 * start : 4 * (start + capacity)]), tokens, sequence, 0))
                    sequence += 1
                if cut < tokens:
                    tails.append((doc, cut, ids[4 * cut :], tokens))
                if len(tails) >= BLOCK or len(full) >= BLOCK:
                    yield flush()
        yield flush()

    return docs.select(quoted(id_col).cast("long").alias("doc"), quoted(text_col).alias("text")).mapInPandas(run, SCHEMA)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
