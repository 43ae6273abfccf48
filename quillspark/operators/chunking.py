"""Retrieval units: Markdown sections cut to size, with the page's title and property digest in front."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scalars import chunk_hash, digest_value, display_column, opaque

# Sizes in code points and the separator of a heading path.
TARGET, MOST, PATH = 500, 800, " › "
_HEADING = re.compile(r"[ \t]*(#{1,6}) (.*)", re.S)


def sections(markdown: str) -> list[tuple[str, str]]:
    """(heading path, body) of each section with a body.

    A heading deeper than the path extends it by one, whatever its level; any other replaces the
    path from its level on. Fences are not looked at.
    """
    out: list[tuple[str, str]] = []
    path: list[str] = []
    body: list[str] = []
    for line in [*markdown.split("\n"), None]:
        m = _HEADING.fullmatch(line) if line is not None else None
        if line is not None and m is None:
            body.append(line)
            continue
        text = "".join(x + "\n" for x in body)
        if text.strip():
            out.append((PATH.join(path), text))
        body = []
        if m:
            path = path[: len(m[1]) - 1] + [m[2].strip()]
    return out


def by_size(body: str) -> list[str]:
    """A body of up to 800 code points whole; longer ones packed from paragraphs up to 500, long paragraphs cut every 500."""
    if len(body) <= MOST:
        return [body]
    out, takes = [""], True  # whether the last piece takes another paragraph
    for p in body.split("\n\n"):
        if len(p) > MOST:
            out += [p[i : i + TARGET] for i in range(0, len(p), TARGET)]
            takes = False
        elif takes and not out[-1]:
            out[-1] = p
        elif takes and len(out[-1]) + len(p) <= TARGET:
            out[-1] = f"{out[-1]}\n\n{p}"
        else:
            out.append(p)
            takes = True
    return [x for x in out if x]


def units(title: str | None, digest: str | None, markdown: str | None) -> list[tuple[str, str]]:
    """(heading, text) of the chunks of a page; title and digest go before the first section, or alone."""
    header = "\n".join(x for x in ((title or "").strip(), digest or "") if x)
    out = []
    for i, (heading, body) in enumerate(sections(markdown or "")):
        for piece in by_size(f"{header}\n\n{body}" if i == 0 and header else body):
            if piece.strip():
                out.append((heading, piece.strip()))
    return out or ([("", header.strip())] if header.strip() else [])


def chunk_pages(pages: DataFrame) -> DataFrame:
    """``page_id, ord, heading, text`` of ``page_id, title, digest, markdown`` rows; null texts count as empty."""

    def run(batches):
        for pdf in batches:
            rows = [
                (pid, n, h, t)
                for pid, title, digest, md in zip(pdf["page_id"], pdf["title"], pdf["digest"], pdf["markdown"])
                for n, (h, t) in enumerate(units(title, digest, md))
            ]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "heading", "text"])

    return pages.select("page_id", "title", "digest", "markdown").mapInPandas(run, "page_id string, ord int, heading string, text string")


def digests(props: DataFrame, titles: DataFrame) -> DataFrame:
    """``page_id, digest``: ``Name: value`` lines in byte order of the column.

    ``props``: ``page_id, col, value_str, value_num``; skipped are empty values, the title, lists of ids and
    date flags. ``titles``: ``page_id, title``.
    """
    shown = props.join(titles, "page_id", "left").withColumn("shown", digest_value("value_str", F.col("value_num")))
    kept = shown.filter(
        (F.col("shown") != "") & ~F.col("shown").eqNullSafe(F.col("title")) & ~opaque("shown") & ~F.col("col").rlike("^date:.*:is_datetime$")
    )
    line = F.struct("col", F.concat(display_column("col"), F.lit(": "), F.col("shown")).alias("line"))
    return kept.groupBy("page_id").agg(F.array_sort(F.collect_list(line)).alias("lines")).select(
        "page_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("digest")
    )


def with_hash(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("hash", chunk_hash("heading", "text"))


def reuse(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pair new chunks with old ones of the same page and hash, the k-th copy with the k-th copy.

    ``old``: ``chunk_id, page_id, ord, hash``; ``new``: ``page_id, ord, hash, ..``. The result has the old
    ``chunk_id`` where one is left, else a new id from (page, hash, k), and ``reused``.
    """
    k = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("page_id", "hash").orderBy("ord")))
    had = k(old).select("page_id", "hash", "k", F.col("chunk_id").alias("old_id"))
    return k(new).join(had, ["page_id", "hash", "k"], "left").select(
        F.coalesce("old_id", F.abs(F.xxhash64("page_id", "hash", "k"))).alias("chunk_id"),
        *new.columns, F.col("old_id").isNotNull().alias("reused"),
    )
