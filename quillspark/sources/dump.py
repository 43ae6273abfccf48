"""Sources and sinks: saved API listings, JSON files, safetensors and weight files, JSON output."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECT = "id string, object string, created_time string, last_edited_time string, archived boolean, in_trash boolean, url string, parent string, properties string, raw string"


def as_row(o: dict) -> tuple:
    """An API object in the columns of OBJECT."""
    return (
        o.get("id"), o.get("object"), o.get("created_time"), o.get("last_edited_time"), bool(o.get("archived")), bool(o.get("in_trash")),
        o.get("url"), json.dumps(o.get("parent")), json.dumps(o.get("properties") or {}, ensure_ascii=False), json.dumps(o, ensure_ascii=False),
    )


def listing(spark: SparkSession, path: str, since: str = "", object: str = "") -> DataFrame:
    """A folder of saved list envelopes ``{results, has_more, next_cursor}``, one JSON file each, as rows of OBJECT.

    ``since`` keeps objects edited at or after an instant (inclusive, as strings), ``object`` one kind. Files are read by Spark from
    whatever file system ``path`` names, in parallel; unreadable ones give no rows.
    """
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    raw = files.select(F.explode(F.from_json("value", "struct<results:array<string>>")["results"]).alias("raw"))
    at = lambda k: F.get_json_object("raw", f"$.{k}")
    rows = raw.select(
        at("id").alias("id"), at("object").alias("object"), at("created_time").alias("created_time"), at("last_edited_time").alias("last_edited_time"),
        *[F.coalesce(at(k) == "true", F.lit(False)).alias(k) for k in ("archived", "in_trash")],
        at("url").alias("url"), at("parent").alias("parent"), F.coalesce(at("properties"), F.lit("{}")).alias("properties"), "raw",
    )
    rows = rows.filter(F.coalesce("last_edited_time", F.lit("")) >= since) if since else rows
    return rows.filter(F.col("object") == object) if object else rows


def objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema, e.g. users or blocks."""
    return spark.read.schema(schema).json(path)


def to_json(df: DataFrame, indent: int = 2) -> str:
    """Rows as an indented JSON array; for results that were capped before."""
    return json.dumps([json.loads(x) for x in df.toJSON().collect()], ensure_ascii=False, indent=indent)


_DTYPES = {"F32": np.dtype("<f4"), "F16": np.dtype("<f2")}


def read_safetensors(path: str) -> dict[str, np.ndarray]:
    """Tensors of a safetensors file as float32 (F32, F16, BF16)."""
    data = np.memmap(path, np.uint8, "r")
    size = int.from_bytes(data[:8].tobytes(), "little")
    header = json.loads(data[8 : 8 + size].tobytes())
    out = {}
    for name, t in header.items():
        if name == "__metadata__":
            continue
        lo, hi = t["data_offsets"]
        raw = data[8 + size + lo : 8 + size + hi].tobytes()
        if t["dtype"] == "BF16":
            x = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        elif t["dtype"] in _DTYPES:
            x = np.frombuffer(raw, _DTYPES[t["dtype"]]).astype(np.float32)
        else:
            raise ValueError(f"{name}: unsupported type {t['dtype']}")
        out[name] = x.reshape(t["shape"])
    return out


MAGIC, ALIGN = b"NPSE0002", 64


def write_blob(path: str, meta: dict, tensors: dict[str, np.ndarray]) -> None:
    """Weight file: magic, length and JSON header, then tensors at aligned offsets (the header's own size counts)."""
    entries, offset = {}, 0
    for name, t in tensors.items():
        entries[name] = {"dtype": t.dtype.str, "shape": list(t.shape), "offset": offset, "bytes": t.nbytes}
        offset += -(-t.nbytes // ALIGN) * ALIGN
    header = json.dumps({"meta": meta, "tensors": entries}).encode()
    start = -(-(len(MAGIC) + 4 + len(header)) // ALIGN) * ALIGN
    with open(path, "wb") as f:
        f.write(MAGIC + struct.pack("<I", len(header)) + header)
        for name, t in tensors.items():
            f.seek(start + entries[name]["offset"])
            f.write(np.ascontiguousarray(t).tobytes())
        f.truncate(start + offset)


def read_blob(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """(meta, tensors mapped from the file)."""
    data = np.memmap(path, np.uint8, "r")
    if data[: len(MAGIC)].tobytes() != MAGIC:
        raise ValueError("not a weight file")
    at = len(MAGIC) + 4
    size = struct.unpack("<I", data[len(MAGIC) : at].tobytes())[0]
    header = json.loads(data[at : at + size].tobytes())
    start = -(-(at + size) // ALIGN) * ALIGN
    out = {}
    for name, e in header["tensors"].items():
        lo = start + e["offset"]
        out[name] = data[lo : lo + e["bytes"]].view(np.dtype(e["dtype"])).reshape(e["shape"])
    return header["meta"], out
