"""Markup residue in text documents (p7).

Method: site template removal. Each document is parsed into a tree of sections, blocks and
items, each subtree is hashed, the hashes are counted per host in Spark, and subtrees
that recur on many pages of a host are deleted; the rest is written as clean text that keeps
headings, lists, code and formulas. The parser also reports the families of markup it met in each item.

A heading counts only together with its whole section, and code and formulas only within one, so none of
them is torn out of a page for recurring alone. Pages are parsed where they are read; only numbers
(hashes, positions, families) are shuffled to choose versions and to count.

Output conventions of the clean text: headings as ``# ..``, list items as ``- ..`` (indented by
two blanks per level), quotes as ``> ..``, table rows as cells joined by `` | ``, code blocks
between ````` fences, inline code in backticks, formulas as ``$..$`` and ``$$..$$``.
"""

from __future__ import annotations

import hashlib
import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import Scratch
from quillspark.tables import instant_us, page_key, read

FAMILIES = ("html", "latex", "markdown", "wiki")
HTML, LATEX, MARKDOWN, WIKI = (1, 2, 4, 8)
#: A subtree is a template if it is on more pages than 2 and this share of the host's pages besides.
MIN_SHARE = 0.01

_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")
_FENCE = re.compile(r"^[ \t]*(`{3,}|~{3,})([^\n]*)$")
_PRE = re.compile(r"<(pre|code)\b[^<>]*>(.*?)</\1\s*>", re.I | re.S)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", re.S)
_SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:[^`\n]|(?<=[^`])`+(?=[^`]))*?[^`\n])\1(?!`)")
_DISPLAY = re.compile(
    r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\begin\{((?:equation|align|gather|multline|eqnarray|displaymath|math)\*?)\}(.*?)\\end\{\3\}", re.S
)
_INLINE_MATH = re.compile(r"\\\(([^\n]+?)\\\)|(?<![\w$\\])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\w$])")
_COMMENT = re.compile(r"<!--.*?-->|<!DOCTYPE[^>]*>|<\?.*?\?>", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:\s+[^<>]*)?)\s*/?>")
_AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_ENTITY = re.compile(r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TEMPLATE = re.compile(r"\{\{(?![{}])([^{}]*)\}\}")
_WIKI_LINK = re.compile(r"\[\[([^\[\]\n]+)\]\]")
_WIKI_EXTERNAL = re.compile(r"(?<![\]\w])\[((?:https?|ftp|mailto):[^\s\[\]]+)(?:[ \t]+([^\[\]\n]+))?\](?![(\[:])")
_WIKI_EMPHASIS = re.compile(r"('{2,5})(?=[^'\s])([^\n]*?[^'\s])\1(?!')")
_WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$")
_ENV = re.compile(r"\\(begin|end)\{([A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?")
_TEX_HEADING = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}\n]*)\}")
_TEX_DROPPED = re.compile(r"[~ ]?\\(?:label|cite[tp]?|ref|eqref|pageref|index|vspace|hspace|usepackage|documentclass|bibliography|bibliographystyle)\*?(?:\[[^\]\n]*\])*\{[^{}\n]*\}")
_TEX_WRAP = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
_TEX_BARE = re.compile(r"(?<![\\\w:])\\([A-Za-z]{2,})\b\*?[ ]?")
_ATX = re.compile(r"^ {0,3}(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?(.*)$")
_BULLET = re.compile(r"^([ \t]*)[-*+][ \t]+(?:\[[ xX]\][ \t]+)?(\S.*)$")
_NUMBERED = re.compile(r"^([ \t]*)\d{1,9}[.)][ \t]+(\S.*)$")
_TABLE_RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*(\S+)[^\n]*$", re.M)
_IMAGE = re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)")
_LINK = re.compile(r"(?<!\!)\[([^\[\]\n]+)\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)")
_REFERENCE = re.compile(r"\[([^\[\]\n]+)\]\[([^\[\]\n]*)\]")
_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^\n]*?[^\s~])~~(?!~)")
_STARS = re.compile(r"(?<![\w*\\])(\*{1,3})(?=[^\s*])([^\n*]*?[^\s*])\1(?![\w*])")
_BARS = re.compile(r"(?<![\w_\\])(_{1,3})(?=[^\s_])([^\n]*?[^\s_])\1(?![\w_])")
_BREAKING = {"br", "p", "div", "li", "ul", "ol", "tr", "table", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "details", "summary", "blockquote", "section", "article", "header", "footer", "pre"}
_LEVELS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_HELD = re.compile("\x00(\\d+)\x01")


class _Page:
    """One document on its way from markup to elements."""

    def __init__(self, text: str):
        self.families = 0
        self.held: list[tuple[str, int]] = []
        self.elements: list[tuple[str, list[tuple[str, int]]]] = []
        self.definitions: set[str] = set()
        self._blocks(_CONTROL.sub("", text.replace("\r\n", "\n").replace("\r", "\n")))

    def hold(self, text: str, family: int) -> str:
        """A placeholder that no later pattern touches."""
        self.held.append((text, family))
        return f"\x00{len(self.held) - 1}\x01"

    def shown(self, text: str, families: int) -> tuple[str, int]:
        def put(m: re.Match) -> str:
            nonlocal families
            held, family = self.held[int(m[1])]
            families |= family
            return held

        while "\x00" in text:
            text = _HELD.sub(put, text)
        return text, families

    def own(self, family: int, make) -> tuple[str, int]:
        """What ``make`` returns, with the families met in it."""
        before, self.families = self.families, family
        text = make()
        found, self.families = self.families, before | self.families
        return text, found

    # -- code and formulas are set aside first ------------------------------------------------

    def _fences(self, text: str) -> str:
        if "```" not in text and "~~~" not in text:
            return text
        out, mark, code = [], "", []
        for line in text.split("\n"):
            m = _FENCE.match(line)
            if mark:
                if m and m[1].startswith(mark) and not m[2].strip():
                    out += ["", self.hold("```" + info + "\n" + "\n".join(code) + "\n```", MARKDOWN), ""]
                    mark, code = "", []
                else:
                    code.append(line)
            elif m and not (m[1][0] == "`" and "`" in m[2]):
                mark, info = m[1], m[2].strip()
                self.families |= MARKDOWN
            else:
                out.append(line)
        if mark:  # an open fence runs to the end
            out += ["", self.hold("```" + info + "\n" + "\n".join(code) + "\n```", MARKDOWN), ""]
        return "\n".join(out)

    def _set(self, family: int, text: str) -> str:
        self.families |= family
        return self.hold(text, family)

    def _aside(self, text: str) -> str:
        text = self._fences(text)
        if "<" in text:
            text = _PRE.sub(
                lambda m: self._set(HTML, f"```\n{html.unescape(m[2]).strip(chr(10))}\n```" if "\n" in m[2] or m[1].lower() == "pre" else f"`{html.unescape(m[2])}`"), text
            )
        if "\\begin{" in text:
            text = _VERBATIM.sub(lambda m: "\n\n" + self._set(LATEX, "```\n" + m[2].strip("\n") + "\n```") + "\n\n", text)
        if "`" in text:
            text = _SPAN.sub(lambda m: self._set(MARKDOWN, f"{m[1]}{m[2]}{m[1]}"), text)
        if "$$" in text or "\\[" in text or "\\begin{" in text:
            text = _DISPLAY.sub(
                lambda m: self._set(LATEX, "$$" + " ".join((m[1] or m[2] or _TEX_DROPPED.sub("", m[4] or "")).split()) + "$$"), text
            )
        if "$" in text or "\\(" in text:
            text = _INLINE_MATH.sub(lambda m: self._set(LATEX, "$" + (m[1] or m[2]).strip() + "$"), text)
        return text

    # -- inline markup ------------------------------------------------------------------------

    def _tag(self, m: re.Match) -> str:
        self.families |= HTML
        close, name = m[1], m[2].lower()
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return "\n" if close else "\n" + "\x02" * int(name[1])
        if name == "li":
            return "" if close else "\n\x03"
        if name in ("td", "th"):
            return "\x04" if close else ""
        return "\n" if name in _BREAKING else ""

    def _inline_early(self, text: str) -> str:
        """Markup that may span lines: comments, tags, templates."""
        if "<" in text:
            if "<!" in text or "<?" in text:
                text, n = _COMMENT.subn("", text)
                self.families |= HTML * bool(n)
            text, n = _AUTOLINK.subn(r"\1", text)
            self.families |= MARKDOWN * bool(n)
            text = _TAG.sub(self._tag, text)
        if "{{" in text:
            while True:
                text, n = _TEMPLATE.subn("", text)
                if not n:
                    break
                self.families |= WIKI
        if "]:" in text:
            found = _DEFINITION.findall(text)
            if found:
                self.families |= MARKDOWN
                self.definitions = {name.strip().lower() for name, _ in found}
                text = _DEFINITION.sub("", text)
        return text

    def _reference(self, m: re.Match) -> str:
        if (m[2] or m[1]).strip().lower() not in self.definitions:
            return m[0]
        self.families |= MARKDOWN
        return m[1]

    def _sub(self, family: int, pattern: re.Pattern, to, text: str) -> str:
        text, n = pattern.subn(to, text)
        if n:
            self.families |= family
        return text

    def inline(self, text: str) -> str:
        if "[" in text:
            if "[[" in text:
                text = self._sub(WIKI, _WIKI_LINK, lambda m: "" if re.match(r"(?i)\s*(category|file|image)\s*:", m[1]) else m[1].rpartition("|")[2].strip(), text)
            if "](" in text:
                text = self._sub(MARKDOWN, _IMAGE, r"\1", text)
                text = self._sub(MARKDOWN, _LINK, r"\1", text)
            if "][" in text and self.definitions:
                text = _REFERENCE.sub(self._reference, text)
            if "://" in text or "[mailto:" in text:
                text = self._sub(WIKI, _WIKI_EXTERNAL, lambda m: m[2] or m[1], text)
        if "''" in text:
            while (hit := _WIKI_EMPHASIS.subn(r"\2", text))[1]:  # every pass is shorter
                text = hit[0]
                self.families |= WIKI
        if "\\" in text:
            text = self._sub(LATEX, _TEX_DROPPED, "", text)
            while (hit := _TEX_WRAP.subn(r"\1", text))[1]:
                text = hit[0]
                self.families |= LATEX
            text = self._sub(LATEX, _TEX_BARE, "", text)
        if "~~" in text:
            text = self._sub(MARKDOWN, _STRIKE, r"\1", text)
        for mark, pattern in (("*", _STARS), ("_", _BARS)):
            if mark in text:
                while (hit := pattern.subn(r"\2", text))[1]:
                    text = hit[0]
                    self.families |= MARKDOWN
        if "&" in text:
            text = _ENTITY.sub(self._entity, text)
        return " ".join(text.split())

    def _entity(self, m: re.Match) -> str:
        if m[1][0] != "#" and m[1] + ";" not in html5:
            return m[0]
        self.families |= HTML
        return html.unescape(m[0])

    # -- blocks -------------------------------------------------------------------------------

    def _add(self, kind: str, items: list[tuple[str, int]]) -> None:
        items = [x for x in items if x[0].strip()]
        if items:
            self.elements.append((kind, items))

    def _environment(self, m: re.Match) -> str:
        self.families |= LATEX
        return "\n\n"

    def _blocks(self, text: str) -> None:
        text = self._inline_early(self._aside(text))
        if "\\" in text:
            text = _ENV.sub(self._environment, text)
            text = self._sub(LATEX, _TEX_HEADING, lambda m: "\n" + "\x02" * _LEVELS[m[1]] + m[2] + "\n", text)
            text = self._sub(LATEX, re.compile(r"(?m)^[ \t]*\\item\b[ \t]*(?:\[[^\]\n]*\])?"), "\x03", text)
        kind, items, para = "", [], []

        def close():
            nonlocal kind, items, para
            if para:
                self._add("text", [self.own(0, lambda: self.inline("\n".join(para)))])
            if items:
                self._add(kind, items)
            kind, items, para = "", [], []

        def item(k: str, x: tuple[str, int]):
            nonlocal kind
            if para or kind != k:
                close()
                kind = k
            items.append(x)

        def heading(family: int, level: int, title: str):
            close()
            self._add("heading", [self.own(family, lambda: "#" * level + " " + self.inline(title))])

        lines = text.split("\n")
        for at, line in enumerate(lines):
            bare = line.strip()
            if not bare:
                close()
                continue
            c = bare[0]
            if c == "\x02":
                heading(0, len(bare) - len(bare.lstrip("\x02")), bare.strip("\x02"))
            elif c == "\x03":
                item("list", self.own(0, lambda: "- " + self.inline(bare[1:])))
            elif "\x04" in bare:
                item("table", self.own(0, lambda: " | ".join(self.inline(x) for x in bare.split("\x04") if x.strip())))
            elif c == "=" and (m := _WIKI_HEADING.match(line)):
                heading(WIKI, len(m[1]), m[2])
            elif c in "=-" and para and (m := _SETEXT.match(line)):
                last = para.pop()
                heading(MARKDOWN, 1 if m[1][0] == "=" else 2, last)
            elif c == "#" and (m := _ATX.match(line)):
                heading(MARKDOWN, len(m[1]), m[2])
            elif c in "-*_" and _RULE.match(line):
                self.families |= MARKDOWN
                close()
            elif c == ">" and (m := _QUOTE.match(line)):
                item("quote", self.own(MARKDOWN, lambda: "> " + self.inline(m[1])))
            elif c in "-*+" and (m := _BULLET.match(line)) or c.isdigit() and (m := _NUMBERED.match(line)):
                indent = "  " * len(m[1].replace("    ", "\t").replace("  ", "\t"))
                item("list", self.own(MARKDOWN, lambda: indent + "- " + self.inline(m[2])))
            elif c == "|" and bare.count("|") > 1 and (kind == "table" or at + 1 < len(lines) and _TABLE_RULE.match(lines[at + 1])):
                self.families |= MARKDOWN
                if _TABLE_RULE.match(line):
                    continue
                item("table", self.own(MARKDOWN, lambda: " | ".join(self.inline(x) for x in bare.strip("|").split("|"))))
            else:
                if kind:
                    close()
                para.append(line)
        close()
        self.elements = [(k, [self.shown(*x) for x in xs]) for k, xs in self.elements]


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def level_of(item: str) -> int:
    return len(item) - len(item.lstrip("#"))


def indent_of(item: str) -> int:
    return len(item) - len(item.lstrip(" "))


def subtrees(elements: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[int, int, int]]:
    """(hash, first item, item after the last) of every subtree that can be a template.

    Sections: a heading with all up to the next heading that isn't deeper. Blocks, but for headings, code and
    formulas. Items of lists with what is nested below them, rows of tables, lines of quotes.
    """
    out: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int, list[str]]] = []  # level, first item, parts

    def close(level: int, end: int) -> None:
        while open_ and open_[-1][0] >= level:
            _, first, parts = open_.pop()
            out.append((digest("section\x00" + "\x00".join(parts)), first, end))

    at = 0
    for kind, items in elements:
        texts = [x for x, _ in items]
        if kind == "heading":
            close(level_of(texts[0]), at)
            open_.append((level_of(texts[0]), at, []))
        whole = kind + "\x00" + "\x00".join(texts)
        for _, _, parts in open_:
            parts.append(whole)
        if kind != "heading" and not (len(texts) == 1 and texts[0].startswith(("```", "$$"))):
            out.append((digest(whole), at, at + len(texts)))
            if len(texts) > 1:
                ends: list[int] = [len(texts)] * len(texts)
                above: list[int] = []
                for i, x in enumerate(texts):
                    while above and (kind != "list" or indent_of(texts[above[-1]]) >= indent_of(x)):
                        ends[above.pop()] = i
                    above.append(i)
                out += [(digest("item\x00" + "\x00".join(texts[i : ends[i]])), at + i, at + ends[i]) for i in range(len(texts)) if ends[i] - i < len(texts)]
        at += len(texts)
    close(0, at)
    return out


def parse(text: str | None) -> tuple[int, list[str], list[int], list[int], list[tuple[int, int, int]]]:
    """(families of no item, item texts, number of the element of each item, families of each item, subtrees) of a text.

    Families are bits. What belongs to no item (a comment, a tag between blocks, a rule) is the page's own.
    """
    if not text:
        return 0, [], [], [], []
    page = _Page(text)
    items = [x for _, xs in page.elements for x, _ in xs]
    element = [n for n, (_, xs) in enumerate(page.elements) for _ in xs]
    families = [f for _, xs in page.elements for _, f in xs]
    rest = page.families
    for f in families:
        rest &= ~f
    return rest, items, element, families, subtrees(page.elements)


def families_of(text: str | None) -> int:
    """All families of a text, as bits."""
    rest, _, _, each, _ = parse(text)
    for f in each:
        rest |= f
    return rest


_PARSED = "rest int, items array<string>, element array<int>, families array<int>, hash array<long>, first array<int>, after array<int>"


def elements(documents: DataFrame) -> DataFrame:
    """``text`` parsed where the rows are; the other columns are kept."""

    def run(batches):
        for pdf in batches:
            parsed = [parse(t) for t in pdf["text"]]
            out = pdf.drop(columns="text")
            for i, name in enumerate(("rest", "items", "element", "families")):
                out[name] = [p[i] for p in parsed]
            for i, name in enumerate(("hash", "first", "after")):
                out[name] = [[x[i] for x in p[4]] for p in parsed]
            yield out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")
    return documents.mapInPandas(run, f"{schema}, {_PARSED}")


def templates(parsed: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``host, hash`` of the subtrees that recur on more than 2 + ``min_share`` x pages of their host.

    A page counts once per hash. Both counts combine before the shuffle, and the keys are
    (host, hash), so one large host spreads over all tasks.
    """
    seen = parsed.select("host", F.explode(F.array_distinct("hash")).alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))
    pages = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return seen.filter("n > 2").join(pages, "host").filter(F.col("n") > 2 + F.col("pages") * min_share).select("host", "hash")


def removal(documents: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, host, version, text`` to the current version of each page, parsed, with the items to be removed as ``gone``.

    ``version`` is whatever orders the versions of a page; the greatest counts, of equal ones one of the greatest text.
    Output: ``page_id, rest, items, element, families, gone``. Pages are parsed where they are read and written once; the current
    version is chosen by number, and whether an item's text is read at all is left to what is selected from the result.
    The templates of a host number at most (subtrees per page) / ``min_share``; they are written and joined by
    (host, hash), broadcast only if Spark finds the file small.
    """
    scratch = Scratch(documents.sparkSession)
    numbered = documents.select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), "version", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"), F.monotonically_increasing_id().alias("uid"), "text"
    )
    parsed = scratch.put(elements(numbered))
    chosen = parsed.groupBy("page_id").agg(F.max(F.struct("version", "tie", "uid")).alias("v")).select(F.col("v.uid").alias("uid"))
    live = parsed.join(chosen, "uid", "left_semi")
    hit = scratch.put(templates(live, min_share))
    spans = live.select("uid", "host", F.explode(F.arrays_zip("hash", "first", "after")).alias("s")).select("uid", "host", "s.*")
    drops = spans.join(hit, ["host", "hash"]).groupBy("uid").agg(F.collect_set(F.struct("first", "after")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["after"] - 1))))
    return live.join(drops, "uid", "left").select(
        "page_id", "rest", "items", "element", "families", F.coalesce(gone, F.array().cast("array<int>")).alias("gone")
    )


def clean(documents: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, host, text[, version]`` to ``page_id, families, clean_text, n_items, n_removed``, one row per page.

    Null and empty texts give an empty clean text without families; a null host is a host of its
    own, ''. Items of one element are joined by line breaks, elements by blank lines. The whole
    text is parsed, however long. Of repeated pages the greatest version counts.
    """
    rows = documents if "version" in documents.columns else documents.withColumn("version", F.lit(0))
    found = removal(rows.select("page_id", "host", "version", "text"), min_share)
    kept = F.filter(
        F.transform(F.arrays_zip("items", "element"), lambda x, i: F.struct(x["items"].alias("t"), x["element"].alias("e"), i.alias("i"))),
        lambda x: ~F.array_contains("gone", x["i"]),
    )
    joined = F.aggregate(
        kept,
        F.struct(F.lit("").alias("t"), F.lit(-1).alias("e")),
        lambda acc, x: F.struct(
            F.concat(acc["t"], F.when(acc["e"] == -1, "").when(acc["e"] == x["e"], "\n").otherwise("\n\n"), x["t"]).alias("t"),
            x["e"].alias("e"),
        ),
        lambda acc: acc["t"],
    )
    return found.select("page_id", union_of("families", "rest").alias("families"), joined.alias("clean_text"), F.size("items").alias("n_items"), F.size("gone").alias("n_removed"))


def union_of(families: str, start: str | Column) -> Column:
    start = F.col(start) if isinstance(start, str) else start
    return F.aggregate(families, start, lambda a, x: a.bitwiseOR(x))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All versions of all pages; a page's host is that of its address."""
    when = lambda c: F.coalesce(instant_us(c), F.lit(-(2**62))) + F.lit(2**62)
    version = F.format_string("%020d%020d", when("last_edited_time"), when("synced_at"))  # orders as both numbers do
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z]+://([^/:?#]+)", 1))
    rows = read(spark, sf_dir, "pages").select(page_key("id").alias("page_id"), host.alias("host"), version.alias("version"), F.col("content_markdown").alias("text"))
    return rows.filter("page_id <> ''")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of markup met outside of code, one row per page and family.

    The families of a page are those of its whole content: of the items that stay after template removal, of the items
    removed as templates, and of what belongs to no item.
    """
    found = removal(page_texts(spark, sf_dir))
    part = lambda gone: F.filter(F.transform("families", lambda f, i: F.when(F.array_contains("gone", i) == gone, f)), lambda f: f.isNotNull())
    split = found.select("page_id", "rest", part(False).alias("stay"), part(True).alias("removed"))
    bits = split.select("page_id", union_of("removed", union_of("stay", "rest")).alias("bits"))
    names = F.array(*[F.when(F.col("bits").bitwiseAND(1 << k) != 0, f) for k, f in enumerate(("html", "latex", "markdown", "wiki"))])
    return bits.select("page_id", F.explode(F.array_compact(names)).alias("family"))


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean text of every page."""
    return clean(page_texts(spark, sf_dir)).select("page_id", "clean_text", "n_items", "n_removed")
