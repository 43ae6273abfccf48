"""Text embedders: the protocol, a deterministic hashing embedder, and an int8 transformer encoder in numpy."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from quillspark.functions.unigram import Unigram


class Embedder(Protocol):
    name: str
    dim: int

    def embed_query(self, text: str) -> np.ndarray: ...

    def embed_passage(self, text: str) -> np.ndarray: ...


def normalized(v: np.ndarray) -> np.ndarray:
    n = math.sqrt(float((v.astype(float) ** 2).sum()))
    return v if n == 0 else (v / n).astype(np.float32)


class HashEmbedder:
    """Signed hashing of words and their trigrams to a unit vector; needs no weights."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash-{dim}", dim

    def embed_passage(self, text: str) -> np.ndarray:
        v = np.zeros(self.dim, np.float32)
        for word in re.findall(r"\w+", text.lower()):
            for part in {word, *(word[i : i + 3] for i in range(len(word) - 2))}:
                h = xxhash.xxh64_intdigest(part)
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
        return normalized(v)

    embed_query = embed_passage


@dataclass
class Quantized:
    """Rows of int8 with one scale each."""

    data: np.ndarray
    scale: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> "Quantized":
        x = np.asarray(x, np.float32)
        scale = (np.abs(x).max(axis=1, initial=0) / np.float32(127)).astype(np.float32)
        inverse = np.divide(np.float32(1), scale, out=np.zeros_like(scale), where=scale != 0)
        y = x * inverse[:, None]
        return cls(np.clip(np.trunc(y + np.copysign(np.float32(0.5), y)), -127, 127).astype(np.int8), scale)

    def floats(self) -> np.ndarray:
        return self.data.astype(np.float32) * self.scale[:, None]


def linear(x: np.ndarray, w: Quantized, bias: np.ndarray | None) -> np.ndarray:
    """``x @ w.T + bias`` with activations quantised per token."""
    q = Quantized.of(x)
    # float64 products of int8 are exact, and BLAS has no integer kernels
    acc = q.data.astype(np.float64) @ w.data.astype(np.float64).T
    out = (acc * q.scale[:, None] * w.scale[None, :]).astype(np.float32)
    return out if bias is None else out + bias


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray, eps: float) -> np.ndarray:
    y = x.astype(np.float64)
    y = (y - y.mean(1, keepdims=True)) / np.sqrt(y.var(1, keepdims=True) + eps)
    return (y * gain + bias).astype(np.float32)


_ERF = np.frompyfunc(math.erf, 1, 1)


def gelu(x: np.ndarray) -> np.ndarray:
    return (0.5 * x * (1 + _ERF(x / math.sqrt(2)).astype(np.float64))).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Encoder:
    """Transformer encoder with int8 weights; attention products stay in float.

    ``tensors``: ``words, positions, types`` and per layer ``k`` the matrices ``k.query, k.key, k.value, k.out, k.up,
    k.down`` as float arrays (quantised here) or quantised ones with ``.bias``, norms ``emb, k.attn, k.ffn`` with ``.gain`` and ``.bias``.
    """

    def __init__(self, tensors: dict[str, np.ndarray], vocabulary: Unigram, layers: int, heads: int, name: str = "encoder",
                 dim: int | None = None, eps: float = 1e-12, longest: int = 512, prefixes: tuple[str, str] = ("query: ", "passage: ")):
        self.t = {k: v if isinstance(v, Quantized) else Quantized.of(v) if v.ndim == 2 else np.asarray(v, np.float32) for k, v in tensors.items()}
        self.vocabulary, self.layers, self.heads, self.eps = vocabulary, layers, heads, eps
        self.hidden = self.t["words"].data.shape[1]
        self.longest = min(longest, len(self.t["positions"].data))
        self.name, self.dim, self.prefixes = name, dim or self.hidden, prefixes

    def _norm(self, x: np.ndarray, key: str) -> np.ndarray:
        return layer_norm(x, self.t[f"{key}.gain"], self.t[f"{key}.bias"], self.eps)

    def _linear(self, x: np.ndarray, key: str) -> np.ndarray:
        return linear(x, self.t[key], self.t.get(f"{key}.bias"))

    def forward(self, ids: list[int]) -> np.ndarray:
        words = self.t["words"]
        at = np.array([i if 0 <= i < len(words.data) else self.vocabulary.unk for i in ids])
        n, size = len(at), self.hidden // self.heads
        row = lambda q, i: q.data[i].astype(np.float32) * q.scale[i][..., None]
        h = row(words, at) + row(self.t["positions"], np.arange(n)) + row(self.t["types"], np.zeros(n, int))
        h = self._norm(h, "emb")
        split = lambda x: x.reshape(n, self.heads, size).transpose(1, 0, 2)
        for k in range(self.layers):
            q, key, v = (split(self._linear(h, f"{k}.{m}")) for m in ("query", "key", "value"))
            seen = softmax(q @ key.transpose(0, 2, 1) / np.float32(math.sqrt(size))) @ v
            h = self._norm(h + self._linear(seen.transpose(1, 0, 2).reshape(n, -1), f"{k}.out"), f"{k}.attn")
            h = self._norm(h + self._linear(gelu(self._linear(h, f"{k}.up")), f"{k}.down"), f"{k}.ffn")
        return normalized(h.mean(0)[: self.dim])

    def embed_query(self, text: str) -> np.ndarray:
        return self.forward(self.vocabulary.encode(self.prefixes[0] + text, self.longest))

    def embed_passage(self, text: str) -> np.ndarray:
        return self.forward(self.vocabulary.encode(self.prefixes[1] + text, self.longest))


def embed_chunks(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunk_id, dim, scale, vec, model`` of ``chunk_id, heading, text``: one Arrow pass; the model travels once per task."""

    def run(batches):
        for pdf in batches:
            q = [Quantized.of(embedder.embed_passage("\n".join(x for x in (h, t) if x))[None, :]) for h, t in zip(pdf["heading"], pdf["text"])]
            yield pd.DataFrame(
                {
                    "chunk_id": pdf["chunk_id"], "dim": embedder.dim, "scale": [float(x.scale[0]) for x in q],
                    "vec": [x.data[0].tobytes() for x in q], "model": embedder.name,
                }
            )

    return chunks.select("chunk_id", "heading", "text").mapInPandas(run, "chunk_id long, dim int, scale float, vec binary, model string")
