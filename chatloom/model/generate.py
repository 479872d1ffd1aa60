"""Replies, one token after another."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np

from .decoder import Params, Shape, forward


@dataclass(frozen=True)
class Sampling:
    """How the next token is drawn; a temperature of 0 takes the likeliest."""

    max_new_tokens: int = 64
    temperature: float = 0.8
    top_p: float = 0.9
    repetition_penalty: float = 1.1
    seed: int = 42

    def seeded(self, more: int) -> Sampling:
        return replace(self, seed=self.seed + more)


def draw(logits: np.ndarray, before: list[int], how: Sampling, rng: np.random.Generator) -> int:
    """One token: scores of tokens generated before are weakened, then temperature, then the likeliest tokens up to the first at which their sum reaches top_p."""
    s = logits.astype(np.float64)
    if before and how.repetition_penalty != 1:
        seen = np.unique(before)
        s[seen] = np.where(s[seen] > 0, s[seen] / how.repetition_penalty, s[seen] * how.repetition_penalty)
    if how.temperature <= 0:
        return int(s.argmax())
    p = np.exp((s - s.max()) / how.temperature)
    p /= p.sum()
    if how.top_p < 1:
        order = np.argsort(-p, kind="stable")
        n = int(np.searchsorted(np.cumsum(p[order]), how.top_p)) + 1
        p[order[max(1, n) :]] = 0
        p /= p.sum()
    return int(rng.choice(len(p), p=p))


def stream_ids(shape: Shape, p: Params, prompt: list[int], stop: set[int], how: Sampling = Sampling()) -> Iterator[int]:
    """Tokens after the prompt, until one of `stop` is drawn. The model sees as many of the last tokens as it can take."""
    rng, ids, own = np.random.default_rng(how.seed), list(prompt), []
    for _ in range(how.max_new_tokens):
        logits, _ = forward(shape, p, np.array([ids[-shape.max_sequence_length :]]))
        token = draw(logits[0, -1], own, how, rng)
        if token in stop:
            return
        ids.append(token)
        own.append(token)
        yield token


def reply_ids(shape: Shape, p: Params, prompt: list[int], stop: set[int], how: Sampling = Sampling()) -> list[int]:
    return list(stream_ids(shape, p, prompt, stop, how))


def deltas(texts: Iterator[str]) -> Iterator[str]:
    """What each text adds to the one before; the whole text where it does not begin with that."""
    shown = ""
    for t in texts:
        new = t[len(shown) :] if t.startswith(shown) else t
        shown = t
        if new:
            yield new


def stream_reply(shape: Shape, p: Params, tokenizer, prompt: str, how: Sampling = Sampling()) -> Iterator[str]:
    """A reply's text as it grows. tokenizer: one of functions.tokens.load."""
    stop = {i for t in ("<|turn_end|>", "<|eos|>") if (i := tokenizer.token_to_id(t)) is not None}
    own: list[int] = []

    def texts() -> Iterator[str]:
        for i in stream_ids(shape, p, tokenizer.encode(prompt, add_special_tokens=False).ids, stop, how):
            own.append(i)
            yield tokenizer.decode(own, skip_special_tokens=True)

    return deltas(texts())
