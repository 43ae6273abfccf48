"""Checkpoints of public encoder models to weight files, and encoders from weight files; on the driver, once per model."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from quillspark.functions.encoder import Encoder, Quantized
from quillspark.functions.unigram import Unigram
from quillspark.sources.dump import read_blob, read_safetensors, write_blob

# Tensor names of BERT checkpoints, ours by theirs; {k} is the layer.
WORDS = "embeddings.word_embeddings.weight"
MATRICES = {
    "words": WORDS, "positions": "embeddings.position_embeddings.weight", "types": "embeddings.token_type_embeddings.weight",
}
LAYER = {
    "query": "attention.self.query", "key": "attention.self.key", "value": "attention.self.value", "out": "attention.output.dense",
    "up": "intermediate.dense", "down": "output.dense",
}
NORMS = {"attn": "attention.output.LayerNorm", "ffn": "output.LayerNorm"}


def load_vocabulary(path: str) -> tuple[list[tuple[str, float]], dict]:
    """(pieces with scores by id, ``unk, bos, eos, added``) of a tokenizer file with a unigram model."""
    whole = json.loads(Path(path).read_text(encoding="utf-8"))
    model = whole.get("model") or {}
    if model.get("type", "Unigram") != "Unigram" or not model.get("vocab"):
        raise ValueError("the tokenizer has no unigram model")
    pieces = [(p, float(s)) for p, s in model["vocab"]]
    added = {t["content"]: t["id"] for t in whole.get("added_tokens") or []}
    named = {p: i for i, (p, _) in enumerate(pieces)} | added
    unk = model.get("unk_id")
    ids = {"unk": named.get("<unk>", 0) if unk is None else unk, "bos": named.get("<s>", named.get("[CLS]", 0)), "eos": named.get("</s>", named.get("[SEP]", 0))}
    return pieces, ids | {"added": added}


def vocabulary_tensors(pieces: list[tuple[str, float]]) -> dict[str, np.ndarray]:
    texts = [p.encode() for p, _ in pieces]
    return {
        "vocab.bytes": np.frombuffer(b"".join(texts), np.uint8), "vocab.ends": np.cumsum([len(t) for t in texts], dtype=np.int64),
        "vocab.scores": np.array([s for _, s in pieces], np.float64),
    }


def vocabulary_from(tensors: dict[str, np.ndarray], ids: dict) -> Unigram:
    data, ends = tensors["vocab.bytes"].tobytes(), tensors["vocab.ends"].tolist()
    texts = [data[a:b].decode() for a, b in zip([0, *ends], ends)]
    special = set(ids["added"])
    return Unigram({t: (i, float(s)) for i, (t, s) in enumerate(zip(texts, tensors["vocab.scores"])) if t and t not in special}, ids["unk"], ids["bos"], ids["eos"], ids["added"])


def convert(folder: str, out: str, name: str) -> Encoder:
    """Weight file ``out`` of the checkpoint in ``folder`` (``config.json, tokenizer.json, model.safetensors``); returns its encoder.

    Only BERT encoders with gelu are understood. Matrices are quantised row by row. The written file is read again and has to
    embed a text to a vector of length one.
    """
    config = json.loads(Path(folder, "config.json").read_text())
    if config.get("model_type") != "bert" or config.get("hidden_act", "gelu") != "gelu":
        raise ValueError("only BERT encoders with gelu can be converted")
    t = read_safetensors(str(Path(folder, "model.safetensors")))
    prefix = next((k.removesuffix(WORDS) for k in t if k.endswith(WORDS)), None)
    if prefix is None:
        raise ValueError("the checkpoint has no word embeddings")
    layers = int(config["num_hidden_layers"])
    rows = {ours: t[prefix + theirs] for ours, theirs in MATRICES.items()}
    rest = {f"emb.{a}": t[f"{prefix}embeddings.LayerNorm.{b}"] for a, b in (("gain", "weight"), ("bias", "bias"))}
    for k in range(layers):
        at = f"{prefix}encoder.layer.{k}."
        for ours, theirs in LAYER.items():
            rows[f"{k}.{ours}"], rest[f"{k}.{ours}.bias"] = t[f"{at}{theirs}.weight"], t[f"{at}{theirs}.bias"]
        for ours, theirs in NORMS.items():
            rest |= {f"{k}.{ours}.gain": t[f"{at}{theirs}.weight"], f"{k}.{ours}.bias": t[f"{at}{theirs}.bias"]}
    pieces, ids = load_vocabulary(str(Path(folder, "tokenizer.json")))
    tensors = vocabulary_tensors(pieces) | {k: v.astype(np.float32) for k, v in rest.items()}
    for k, v in rows.items():
        q = Quantized.of(v)
        tensors |= {k: q.data, f"{k}.scale": q.scale}
    meta = {"name": name, "layers": layers, "heads": int(config["num_attention_heads"]), "eps": config.get("layer_norm_eps", 1e-12), "longest": int(config.get("max_position_embeddings", 512)), "ids": ids}
    write_blob(out, meta, tensors)
    made = load(out)
    length = float(np.linalg.norm(made.embed_passage("a b c")))
    if not abs(length - 1) < 1e-3:
        raise ValueError(f"the converted model embeds to length {length}")
    return made


def load(path: str) -> Encoder:
    """Encoder of a weight file; the matrices stay mapped from it."""
    meta, t = read_blob(path)
    tensors = {k: Quantized(v, t[f"{k}.scale"]) if f"{k}.scale" in t else v for k, v in t.items() if not k.endswith(".scale") and not k.startswith("vocab.")}
    return Encoder(tensors, vocabulary_from(t, meta["ids"]), meta["layers"], meta["heads"], meta["name"], eps=meta["eps"], longest=meta["longest"])
