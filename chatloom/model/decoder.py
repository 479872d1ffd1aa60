"""A small decoder-only language model in numpy: forward pass, loss and gradients.

Pre-norm blocks of causal attention with rotary positions and a gated feed-forward layer, RMS norms, no biases. Parameters are a flat dict of float32 arrays, so
that a broadcast, a checkpoint and an optimizer step are loops over one dict. Executors run the forward pass over batches of windows; see scoring.py.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

import numpy as np

Params = dict[str, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """Sizes of a model; the field names are those of configuration files."""

    vocab_size: int
    hidden_size: int
    num_layers: int
    num_heads: int
    intermediate_size: int
    max_sequence_length: int
    dropout: float = 0.0
    tie_embeddings: bool = True
    rope_base: float = 10_000.0
    rms_norm_epsilon: float = 1e-5

    def __post_init__(self) -> None:
        if min(self.vocab_size, self.hidden_size, self.num_layers, self.num_heads, self.intermediate_size, self.max_sequence_length) <= 0:
            raise ValueError("model dimensions must be positive")
        if self.hidden_size % self.num_heads or self.hidden_size // self.num_heads % 2:
            raise ValueError("the hidden size must divide into heads of an even size")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout must be in [0, 1)")

    @classmethod
    def of(cls, config: dict) -> Shape:
        return cls(**{f.name: config[f.name] for f in fields(cls) if f.name in config})

    def as_dict(self) -> dict:
        return asdict(self)


def fresh(shape: Shape, seed: int = 42) -> Params:
    """Random parameters: uniform by fan-in, embeddings normal, norms one."""
    rng, h, m = np.random.default_rng(seed), shape.hidden_size, shape.intermediate_size
    linear = lambda out, inp: rng.uniform(-1, 1, (out, inp)).astype(np.float32) / np.float32(np.sqrt(inp))
    p: Params = {"embed": (rng.standard_normal((shape.vocab_size, h)) / np.sqrt(h)).astype(np.float32), "norm": np.ones(h, np.float32)}
    for i in range(shape.num_layers):
        p |= {f"{i}.{n}": linear(h, h) for n in ("q", "k", "v", "o")} | {f"{i}.gate": linear(m, h), f"{i}.up": linear(m, h), f"{i}.down": linear(h, m)}
        p |= {f"{i}.norm_a": np.ones(h, np.float32), f"{i}.norm_m": np.ones(h, np.float32)}
    if not shape.tie_embeddings:
        p["head"] = linear(shape.vocab_size, h)
    return p


def n_parameters(p: Params) -> int:
    return sum(a.size for a in p.values())


def _norm(x: np.ndarray, w: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    r = 1 / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps)
    return x * r * w, r


def _norm_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g = dy * w
    return r * g - x * r**3 * (g * x).mean(axis=-1, keepdims=True), (dy * x * r).reshape(-1, x.shape[-1]).sum(axis=0)


def _turn(x: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Rotates pairs of the first and the second half of a head by their position's angle."""
    a, b = np.split(x, 2, axis=-1)
    return np.concatenate([a * cos - b * sin, a * sin + b * cos], axis=-1)


def _linear_back(dy: np.ndarray, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return dy @ w, dy.reshape(-1, dy.shape[-1]).T @ x.reshape(-1, x.shape[-1])


def forward(shape: Shape, p: Params, ids: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, list]:
    """Logits for ids (batch, length), and what the backward pass needs. With rng, dropout is on."""
    if ids.ndim != 2 or ids.shape[1] > shape.max_sequence_length:
        raise ValueError(f"ids must be (batch, at most {shape.max_sequence_length}), not {ids.shape}")
    (n, length), heads = ids.shape, shape.num_heads
    size, eps = shape.hidden_size // heads, shape.rms_norm_epsilon
    angle = np.arange(length)[:, None] * shape.rope_base ** (-np.arange(0, size, 2) / size)
    cos, sin = np.cos(angle).astype(np.float32), np.sin(angle).astype(np.float32)
    later = np.triu(np.full((length, length), -np.inf, np.float32), 1)
    split = lambda y: y.reshape(n, length, heads, size).transpose(0, 2, 1, 3)
    drop = lambda y: ((rng.random(y.shape) >= shape.dropout) / (1 - shape.dropout)).astype(np.float32) if rng is not None and shape.dropout else None
    kept = lambda y, d: y if d is None else y * d
    x = p["embed"][ids]
    d0 = drop(x)
    x, saved = kept(x, d0), [ids, d0, cos, sin]
    for i in range(shape.num_layers):
        a, ra = _norm(x, p[f"{i}.norm_a"], eps)
        q, k, v = _turn(split(a @ p[f"{i}.q"].T), cos, sin), _turn(split(a @ p[f"{i}.k"].T), cos, sin), split(a @ p[f"{i}.v"].T)
        s = q @ k.transpose(0, 1, 3, 2) / np.float32(np.sqrt(size)) + later
        s = np.exp(s - s.max(axis=-1, keepdims=True))
        s /= s.sum(axis=-1, keepdims=True)
        mixed = (s @ v).transpose(0, 2, 1, 3).reshape(n, length, -1)
        y = mixed @ p[f"{i}.o"].T
        da = drop(y)
        x1 = x + kept(y, da)
        b, rb = _norm(x1, p[f"{i}.norm_m"], eps)
        g, u = b @ p[f"{i}.gate"].T, b @ p[f"{i}.up"].T
        sig = 1 / (1 + np.exp(-g))
        z = g * sig * u
        y = z @ p[f"{i}.down"].T
        dm = drop(y)
        saved.append((x, a, ra, q, k, v, s, mixed, da, x1, b, rb, g, u, sig, z, dm))
        x = x1 + kept(y, dm)
    last, r = _norm(x, p["norm"], eps)
    saved.append((x, last, r))
    return last @ p["embed" if shape.tie_embeddings else "head"].T, saved


def token_losses(logits: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """-log probability of each target."""
    top = logits.max(axis=-1, keepdims=True)
    total = top[..., 0] + np.log(np.exp(logits - top).sum(axis=-1))
    return total - np.take_along_axis(logits, targets[..., None], axis=-1)[..., 0]


def gradients(shape: Shape, p: Params, inputs: np.ndarray, targets: np.ndarray, rng: np.random.Generator | None = None) -> tuple[float, Params]:
    """Mean loss of next tokens, and its gradient by every parameter."""
    logits, saved = forward(shape, p, inputs, rng)
    loss = float(token_losses(logits, targets).mean())
    (n, length), heads = inputs.shape, shape.num_heads
    size = shape.hidden_size // heads
    dlogits = np.exp(logits - logits.max(axis=-1, keepdims=True))
    dlogits /= dlogits.sum(axis=-1, keepdims=True)
    np.put_along_axis(dlogits, targets[..., None], np.take_along_axis(dlogits, targets[..., None], axis=-1) - 1, axis=-1)
    dlogits = (dlogits / targets.size).astype(np.float32)
    grad: Params = {}
    x, last, r = saved[-1]
    head = "embed" if shape.tie_embeddings else "head"
    dlast, grad[head] = _linear_back(dlogits, last, p[head])
    dx, grad["norm"] = _norm_back(dlast, x, p["norm"], r)
    ids, d0, cos, sin = saved[:4]
    kept = lambda y, d: y if d is None else y * d
    split = lambda y: y.reshape(n, length, heads, size).transpose(0, 2, 1, 3)
    whole = lambda y: y.transpose(0, 2, 1, 3).reshape(n, length, -1)
    for i in reversed(range(shape.num_layers)):
        x, a, ra, q, k, v, s, mixed, da, x1, b, rb, g, u, sig, z, dm = saved[4 + i]
        dz, grad[f"{i}.down"] = _linear_back(kept(dx, dm), z, p[f"{i}.down"])
        db_u, grad[f"{i}.up"] = _linear_back(dz * g * sig, b, p[f"{i}.up"])
        db_g, grad[f"{i}.gate"] = _linear_back(dz * u * (sig + g * sig * (1 - sig)), b, p[f"{i}.gate"])
        dn, grad[f"{i}.norm_m"] = _norm_back(db_u + db_g, x1, p[f"{i}.norm_m"], rb)
        dx = dx + dn
        dmixed, grad[f"{i}.o"] = _linear_back(kept(dx, da), mixed, p[f"{i}.o"])
        dmixed = split(dmixed)
        ds = dmixed @ v.transpose(0, 1, 3, 2)
        ds = s * (ds - (ds * s).sum(axis=-1, keepdims=True)) / np.float32(np.sqrt(size))
        parts = {"q": whole(_turn(ds @ k, cos, -sin)), "k": whole(_turn(ds.transpose(0, 1, 3, 2) @ q, cos, -sin)), "v": whole(s.transpose(0, 1, 3, 2) @ dmixed)}
        total = np.zeros_like(a)
        for name, d in parts.items():
            back, grad[f"{i}.{name}"] = _linear_back(d, a, p[f"{i}.{name}"])
            total += back
        dn, grad[f"{i}.norm_a"] = _norm_back(total, x, p[f"{i}.norm_a"], ra)
        dx = dx + dn
    table = grad.setdefault("embed", np.zeros_like(p["embed"]))
    np.add.at(table, ids, kept(dx, d0))
    return loss, grad


class AdamW:
    """Adam without bias correction, decoupled weight decay, after a clip of the global norm. Its state is plain arrays, for checkpoints."""

    def __init__(self, p: Params, weight_decay: float = 0.1, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8) -> None:
        self.weight_decay, self.clip, self.betas, self.eps = weight_decay, clip, betas, eps
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))

    def step(self, p: Params, grad: Params, rate: float) -> float:
        """Changes p in place; gives the norm before the clip."""
        norm = float(np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grad.values())))
        scale, (b1, b2) = min(1.0, self.clip / (norm + 1e-6)), self.betas
        for k, g in grad.items():
            g = g * np.float32(scale)
            self.m[k] = b1 * self.m[k] + (1 - b1) * g
            self.v[k] = b2 * self.v[k] + (1 - b2) * g * g
            p[k] = (p[k] * (1 - rate * self.weight_decay) - rate * self.m[k] / (np.sqrt(self.v[k]) + self.eps)).astype(np.float32)
        return norm
