"""Block trees to Markdown, one page at a time."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

# Block types by how they are written.
MEDIA = {"image", "video", "file", "pdf", "audio"}
LINKS = {"bookmark", "embed", "link_preview"}
SILENT = {"table_of_contents", "breadcrumb", "unsupported"}
BARE = {"column_list", "column", "synced_block"}


def span(s: dict) -> str:
    """One rich text span in Markdown; outer blanks stay outside the markers."""
    formula = (s.get("equation") or {}).get("expression") or ""
    if s.get("type") == "equation" and formula:
        return f"${formula}$"
    text, on = s.get("plain_text") or "", s.get("annotations") or {}
    if text and on.get("code"):
        return f"`{text}`"
    core = text.strip(" \t")
    if not core:
        return text
    at = text.index(core)
    out = core
    for key, mark in (("bold", "**"), ("italic", "_"), ("strikethrough", "~~")):
        out = f"{mark}{out}{mark}" if on.get(key) else out
    return text[:at] + (f"[{out}]({s['href']})" if s.get("href") else out) + text[at + len(core) :]


def spans(value) -> str:
    return "".join(span(s) for s in value or [] if isinstance(s, dict))


class Writer:
    """Lines of a page; ``children`` maps a block id to its blocks in order."""

    def __init__(self, children: dict[str, list[dict]]):
        self.children, self.lines = children, []

    def line(self, indent: str, text: str) -> None:
        self.lines += [indent + x for x in text.split("\n")]

    def block(self, indent: str, text: str) -> None:
        self.line(indent, text)
        self.lines.append("")

    def below(self, b: dict) -> list[dict]:
        return self.children.get(b["block_id"], [])

    def write(self, blocks: list[dict], indent: str) -> None:
        number = 0
        for b in blocks:
            number = number + 1 if b["type"] == "numbered_list_item" else 0
            self.one(b, indent, number)

    def one(self, b: dict, indent: str, number: int) -> None:
        kind, raw = b["type"], b["raw"]
        body = raw.get(kind) if isinstance(raw.get(kind), dict) else {}
        text = spans(body.get("rich_text") or body.get("caption"))
        kids = self.below(b)
        deeper = indent + "\t"
        simple = {
            "bulleted_list_item": "- " + text,
            "numbered_list_item": f"{number}. {text}",
            "to_do": f"- [{'x' if body.get('checked') is True else ' '}] {text}",
        }
        whole = {
            "code": f"```{_text(body, 'language')}\n{text}\n```",
            "divider": "---",
            "equation": f"$${_text(body, 'expression')}$$",
            "child_page": f'<page id="{b["block_id"]}">{_text(body, "title")}</page>',
            "child_database": f'<database id="{b["block_id"]}">{_text(body, "title")}</database>',
        }
        if kind in simple:
            self.line(indent, simple[kind])
            self.write(kids, deeper)
        elif kind in whole:
            self.block(indent, whole[kind])
        elif kind in ("heading_1", "heading_2", "heading_3"):
            self.block(indent, "#" * int(kind[-1]) + " " + text)
            self.write(kids, indent)
        elif kind == "toggle":
            self.block(indent, f"<details>\n<summary>{text}</summary>")
            self.write(kids, indent)
            self.block(indent, "</details>")
        elif kind in ("quote", "callout"):
            icon = body.get("icon") if kind == "callout" else None
            emoji = icon.get("emoji") if isinstance(icon, dict) else None
            self.block(indent, "> " + (f"{emoji} " if emoji else "") + text.replace("\n", "\n> "))
            self.write(kids, indent)
        elif kind in MEDIA:
            url = next((u for k in ("external", "file") if isinstance(body.get(k), dict) and (u := body[k].get("url"))), "")
            self.block(indent, f"{'!' * (kind == 'image')}[{text or kind}]({url})")
        elif kind in LINKS:
            self.block(indent, "[{0}]({0})".format(_text(body, "url")))
        elif kind == "table":
            self.table(kids, body.get("has_column_header") is True, indent)
        elif kind in BARE:
            self.write(kids, indent)
        elif kind not in SILENT:
            if text.strip():
                self.block(indent, text)
            self.write(kids, deeper if kind == "paragraph" else indent)

    def table(self, kids: list[dict], header: bool, indent: str) -> None:
        rows = [[spans(c).replace("|", "\\|") for c in (k["raw"].get("table_row") or {}).get("cells") or []] for k in kids if k["type"] == "table_row"]
        if rows:
            width = max(map(len, rows))
            out = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
            self.block(indent, "\n".join(out[:1] + ["|" + " --- |" * width] * header + out[1:]))


def _text(body: dict, key: str) -> str:
    return body[key] if isinstance(body.get(key), str) else ""


def render(blocks: list[dict]) -> str:
    """Markdown of the blocks of one page: ``block_id, parent_id, ord, type, raw``; a null or empty parent is the page."""
    children: dict[str, list[dict]] = {}
    for b in sorted(blocks, key=lambda b: b["ord"]):
        children.setdefault(b["parent_id"] or "", []).append(b)
    w = Writer(children)
    w.write(children.get("", []), "")
    return "\n".join(w.lines).rstrip("\n") + "\n"


def _object(raw: str | None) -> dict:
    try:
        out = json.loads(raw or "{}")
    except ValueError:
        return {}
    return out if isinstance(out, dict) else {}


def render_pages(blocks: DataFrame) -> DataFrame:
    """``page_id, markdown`` of ``page_id, block_id, parent_id, ord, type, raw`` rows; a page's blocks are few (see the tree limits)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r, raw=_object(r["raw"]), type=r["type"] or "") for r in pdf.to_dict("records")]
        return pd.DataFrame({"page_id": [pdf["page_id"].iloc[0]], "markdown": [render(rows)]})

    return blocks.select("page_id", "block_id", "parent_id", "ord", "type", "raw").groupBy("page_id").applyInPandas(run, "page_id string, markdown string")
