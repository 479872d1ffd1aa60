"""Configurations, token arrays, checkpoints and exports, as private local files. Each folder is made whole beside its place and then moved there."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame

from ..sources.files import private_dir, sha256_file, write_json, write_text
from .decoder import AdamW, Params, Shape

#: Defaults of generation.
GENERATION = {"max_new_tokens": 64, "temperature": 0.8, "top_p": 0.9, "repetition_penalty": 1.1, "stop_tokens": ["<|turn_end|>", "<|eos|>"]}
#: What an export must hold, and what it must not.
REQUIRED, EXCLUDED = {"model.npz", "model-config.json", "generation-config.json", "metrics.json", "data-manifest.json", "README.md", "tokenizer"}, {"optimizer.npz"}


def load_config(path: str | Path) -> dict:
    """A YAML mapping; an empty file is an empty one."""
    import yaml

    value = yaml.safe_load(Path(path).expanduser().read_text(encoding="utf-8"))
    if not isinstance(value := {} if value is None else value, dict):
        raise ValueError(f"{path} must hold a mapping")
    return value


def save_tokens(stream: DataFrame, path: str | Path, token: str = "token", pos: str = "pos") -> int:
    """A token stream (pos, token) as one .npy file of uint32, in the order of pos; gives the count. Rows reach the driver sorted and a partition at a time, straight into the mapped file."""
    path, n = Path(path), stream.count()
    private_dir(path.parent)
    tmp = path.with_name(f".{path.name}.tmp")
    if n:
        out, at = np.lib.format.open_memmap(tmp, mode="w+", dtype=np.uint32, shape=(n,)), 0
        for r in stream.orderBy(pos).select(token).toLocalIterator(prefetchPartitions=True):
            out[at], at = r[0], at + 1
        out.flush()
    else:
        with open(tmp, "wb") as f:
            np.save(f, np.zeros(0, np.uint32), allow_pickle=False)
    tmp.chmod(0o600)
    os.replace(tmp, path)
    return n


def load_tokens(path: str | Path, mmap: bool = True) -> np.ndarray:
    return np.load(path, mmap_mode="r" if mmap else None, allow_pickle=False)


@contextmanager
def _whole_folder(place: str | Path) -> Iterator[Path]:
    place = Path(place)
    private_dir(place.parent)
    tmp = Path(tempfile.mkdtemp(prefix=f".{place.name}.", dir=place.parent))
    try:
        yield tmp
        for f in tmp.rglob("*"):
            f.chmod(0o700 if f.is_dir() else 0o600)
        shutil.rmtree(place, ignore_errors=True)
        os.replace(tmp, place)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def save_checkpoint(place: str | Path, shape: Shape, p: Params, optimizer: AdamW, rng: np.random.Generator, state: dict, config: dict, tokenizer: str | Path) -> None:
    """Weights, optimizer, random state, both configurations, the trainer's state and a copy of the tokenizer."""
    import yaml

    with _whole_folder(place) as tmp:
        np.savez(tmp / "model.npz", **p)
        np.savez(tmp / "optimizer.npz", **{f"m.{k}": a for k, a in optimizer.m.items()}, **{f"v.{k}": a for k, a in optimizer.v.items()})
        write_json(tmp / "random-state.json", rng.bit_generator.state)
        write_json(tmp / "model-config.json", shape.as_dict())
        write_json(tmp / "trainer-state.json", state)
        write_text(tmp / "training-config.yaml", yaml.safe_dump(config))
        (tmp / "tokenizer").mkdir()
        shutil.copyfile(tokenizer_file(tokenizer), tmp / "tokenizer" / "tokenizer.json")


def tokenizer_file(path: str | Path) -> Path:
    """The file itself, or the one in that folder."""
    return Path(path) / "tokenizer.json" if Path(path).is_dir() else Path(path)


def load_model(place: str | Path) -> tuple[Shape, Params]:
    shape = Shape.of(json.loads((Path(place) / "model-config.json").read_text(encoding="utf-8")))
    with np.load(Path(place) / "model.npz", allow_pickle=False) as f:
        return shape, {k: f[k] for k in f.files}


def restore(place: str | Path, p: Params, optimizer: AdamW, rng: np.random.Generator) -> dict:
    """Sets weights, optimizer and random state to those of a checkpoint, and gives the trainer's state."""
    p.clear()
    p |= load_model(place)[1]
    with np.load(Path(place) / "optimizer.npz", allow_pickle=False) as f:
        for k in f.files:
            getattr(optimizer, k[0])[k[2:]] = f[k]
    rng.bit_generator.state = json.loads((Path(place) / "random-state.json").read_text(encoding="utf-8"))
    return json.loads((Path(place) / "trainer-state.json").read_text(encoding="utf-8"))


def export(checkpoint: str | Path, place: str | Path, metrics: str | Path | None = None, split_report: str | Path | None = None, splits: str | Path | None = None) -> dict:
    """The checkpoint without what only training needs, with metrics and a manifest of hashes. Absent reports are left out."""
    checkpoint = Path(checkpoint)
    read = lambda f: json.loads(Path(f).read_text(encoding="utf-8")) if f and Path(f).exists() else None
    with _whole_folder(place) as tmp:
        for name in ("model.npz", "model-config.json"):
            shutil.copyfile(checkpoint / name, tmp / name)
        shutil.copytree(checkpoint / "tokenizer", tmp / "tokenizer")
        write_json(tmp / "generation-config.json", GENERATION)
        write_json(tmp / "metrics.json", read(metrics) or {})
        manifest = {"model_sha256": sha256_file(tmp / "model.npz"), "private_local_artifact": True, "pretrained_weights_used": False, "pretrained_tokenizer_used": True}
        if (report := read(split_report)) is not None:
            manifest["split_report"] = report
        if splits:
            manifest["split_hashes"] = {n: {f.name: sha256_file(f) for f in sorted((Path(splits) / f"{n}.jsonl").glob("part-*"))} for n in ("train", "validation", "test")}
        write_json(tmp / "data-manifest.json", manifest)
        write_text(tmp / "README.md", "# Private model\n\nTrained from random weights on private text. Keep it on this machine.\n")
    return manifest


def complete(names: set[str]) -> bool:
    """Whether an export's file names hold all that is required and nothing that is excluded."""
    return REQUIRED <= names and not EXCLUDED & names
