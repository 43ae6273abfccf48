"""Scalar functions as native Column expressions; plain Python only where a function runs once per query."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of the keyword branch and the shape of a page id.
KEYWORD_WEIGHT, LITERAL_WEIGHT = 0.20, 1.0
PAGE_ID = "[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}"
# Marks cut from both ends of a word before its shape is judged.
WORD_EDGES = "«».,()?!:;\"'"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii() and base.isalpha():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


LATIN, LATIN_BASE = _latin()


def fold(c: Column | str) -> Column:
    """Lower case without Latin accents; other scripts keep their letters."""
    return F.lower(F.regexp_replace(F.translate(col(c), LATIN, LATIN_BASE), "[\u0300-\u036f]", ""))


def terms(c: Column | str) -> Column:
    """Index terms of a text: runs of letters and digits, folded."""
    return F.filter(F.split(fold(F.coalesce(col(c), F.lit(""))), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


def content_hash(c: Column | str) -> Column:
    """First 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, 16)


def chunk_hash(heading: Column | str, text: Column | str) -> Column:
    return content_hash(F.concat(F.coalesce(col(heading), F.lit("")), F.lit("\x00"), F.coalesce(col(text), F.lit(""))))


def rune_count(c: Column | str) -> Column:
    return F.char_length(col(c))


def canonical_page_id(c: Column | str) -> Column:
    """The last page id in a text as 32 lower-case hex digits, '' if there is none."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(PAGE_ID), F.lit(0))
    return F.coalesce(F.lower(F.translate(F.try_element_at(found, F.lit(-1)), "-", "")), F.lit(""))


def clean_id(c: Column | str) -> Column:
    """Id of an id or address: the last path part, then without query, then a 32-hex tail without its slug."""
    s = F.trim(col(c))
    tail = F.substring_index(F.substring_index(s, "/", -1), "?", 1)
    return _hex_tail(tail)


def normalize_id(c: Column | str) -> Column:
    """Like :func:`clean_id`, but the query is cut before the path, so a ``/`` in the query does no harm."""
    s = F.trim(col(c))
    return _hex_tail(F.substring_index(F.substring_index(s, "?", 1), "/", -1))


def _hex_tail(tail: Column) -> Column:
    last = F.regexp_extract(tail, "(?:^|-)([0-9a-fA-F]{32})$", 1)
    return F.when(last != "", last).otherwise(tail)


def column_name(c: Column | str) -> Column:
    """Column of a property: names that collide with id or url are escaped."""
    return F.when(F.lower(col(c)).isin("id", "url"), F.concat(F.lit("userDefined:"), col(c))).otherwise(col(c))


def display_column(c: Column | str) -> Column:
    c = col(c)
    return (
        F.when(c.rlike("^date:.*:start$"), F.regexp_replace(c, "^date:(.*):start$", "$1"))
        .when(c.rlike("^date:.*:end$"), F.regexp_replace(c, "^date:(.*):end$", "$1 (до)"))
        .when(c.startswith("userDefined:"), F.substring(c, 13, 1 << 30))
        .otherwise(c)
    )


def format_number(v: Column) -> Column:
    """Four decimals, trailing zeros and dot cut."""
    return F.regexp_replace(F.format_string("%.4f", v), r"\.?0+$", "")


def digest_value(text: Column | str, number: Column | None = None) -> Column:
    """Display form of a property value; '' for what says nothing."""
    t = col(text)
    shown = F.when(t == "__YES__", "да").when(t.isin("__NO__", "[]", "{}"), "").otherwise(F.coalesce(t, F.lit("")))
    return shown if number is None else F.when(number.isNotNull(), format_number(number)).otherwise(shown)


def is_id_list(c: Column | str) -> Column:
    """A JSON array whose elements are all as long as ids."""
    body = F.regexp_replace(col(c), r"^[\[\]]+|[\[\]]+$", "")
    parts = F.transform(F.split(body, ","), lambda p: F.octet_length(F.regexp_replace(F.trim(p), '^"+|"+$', "")))
    return (body != "") & F.forall(parts, lambda n: n.isin(32, 36))


def opaque(c: Column | str) -> Column:
    """Values that are edges, not text: lists of ids."""
    c = col(c)
    return c.startswith('["') & c.contains("-") & is_id_list(c)


def heading_level(line: Column) -> Column:
    return F.length(F.regexp_extract(line, r"^[ \t]*(#{1,6}) ", 1))


def heading_text(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, r"^[ \t]*#{1,6} (.*)$", 1))


SPAN = (
    "array<struct<type:string,plain_text:string,href:string,"
    "annotations:struct<bold:boolean,italic:boolean,strikethrough:boolean,code:boolean>,equation:struct<expression:string>>>"
)


def plain_text(spans: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(spans, lambda s: F.coalesce(s["plain_text"], F.lit(""))), ""), F.lit(""))


def rich_markdown(spans: Column) -> Column:
    """Inline Markdown of rich text spans, markers next to the words they mark."""

    def one(s: Column) -> Column:
        text = F.coalesce(s["plain_text"], F.lit(""))
        on = lambda k: F.coalesce(s["annotations"][k], F.lit(False))
        lead = F.regexp_extract(text, r"^([ \t]*)", 1)
        core = F.regexp_replace(text, r"^[ \t]+|[ \t]+$", "")
        trail = F.regexp_extract(text, r"([ \t]*)$", 1)
        out = core
        for key, mark in (("bold", "**"), ("italic", "_"), ("strikethrough", "~~")):
            out = F.when(on(key), F.concat(F.lit(mark), out, F.lit(mark))).otherwise(out)
        href = F.coalesce(s["href"], F.lit(""))
        out = F.when(href != "", F.concat(F.lit("["), out, F.lit("]("), href, F.lit(")"))).otherwise(out)
        formula = F.coalesce(s["equation"]["expression"], F.lit(""))
        return (
            F.when((s["type"] == "equation") & (formula != ""), F.concat(F.lit("$"), formula, F.lit("$")))
            .when(text == "", "")
            .when(on("code"), F.concat(F.lit("`"), text, F.lit("`")))
            .when(core == "", text)
            .otherwise(F.concat(lead, out, trail))
        )

    return F.coalesce(F.array_join(F.transform(spans, one), ""), F.lit(""))


def json_text(c: Column) -> Column:
    """JSON text with ``&``, ``<`` and ``>`` escaped as the mirror stores it."""
    out = c
    for mark, code in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return out


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def minus_slack(c: Column | str, seconds: int = 120) -> Column:
    """A watermark moved back, in whole seconds of UTC; unreadable ones stay as they are."""
    us = F.unix_micros(col(c).try_cast("timestamp"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((us / 1_000_000 - seconds) / 86400).cast("int"))
    rest = F.pmod(F.floor(us / 1_000_000).cast("long") - seconds, F.lit(86400))
    clock = F.format_string("T%02d:%02d:%02dZ", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    return F.coalesce(F.concat(F.date_format(day, "yyyy-MM-dd"), clock), col(c))


def percent(part: Column, whole: Column) -> Column:
    """Whole percent, half up; 0 of nothing."""
    return F.when(whole == 0, 0).otherwise(F.floor(part / whole * 100 + 0.5)).cast("int")


def count_line(**counts: Column) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in counts.items()])


# -- vectors ----------------------------------------------------------------------------------


def nearest(x: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return F.round(x).cast("int")


def l2_normalize(v: Column) -> Column:
    """Unit vector, summed in double; the zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x.cast("double") / n).cast("float")))


def quantize(v: Column) -> Column:
    """Struct ``(scale float, q array<int>)``: symmetric int8, scale = max|x| / 127, zero vector with scale 0."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("float"))))
    scale = (top.cast("double") / F.lit(127.0)).cast("float")
    inverse = F.when(scale == 0, F.lit(0.0).cast("float")).otherwise((F.lit(1.0) / scale.cast("double")).cast("float"))
    q = F.transform(v, lambda x: F.least(F.greatest(nearest((x.cast("double") * inverse.cast("double")).cast("float")), F.lit(-127)), F.lit(127)))
    return F.struct(F.coalesce(scale, F.lit(0.0).cast("float")).alias("scale"), q.alias("q"))


def dot_quantized(a: Column, b: Column) -> Column:
    """Integer dot product times both scales; 0 where the lengths differ."""
    dot = F.aggregate(F.zip_with(a["q"], b["q"], lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a["q"]) != F.size(b["q"]), 0.0).otherwise(dot.cast("double") * a["scale"].cast("double") * b["scale"].cast("double"))


def unpack_int8(c: Column | str, dim: int) -> Column:
    """Signed components of a packed vector, natively from its hex digits."""
    h = F.hex(col(c))

    def at(i: Column) -> Column:
        n = F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("int")
        return F.when(n > 127, n - 256).otherwise(n)

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)


# -- query texts: once per query, on the driver -------------------------------------------------


def match_terms(text: str, most: int = 32) -> list[tuple[str, bool]]:
    """Query terms (word, prefix?): at least two characters, prefix search from four, the first 32."""
    words = ["".join(g) for g in _runs(text)]
    return [(w.lower(), len(w.lower()) >= 4) for w in words if len(w.lower()) >= 2][:most]


def _runs(text: str):
    run: list[str] = []
    for c in text:
        if c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd":
            run.append(c)
        elif run:
            yield run
            run = []
    if run:
        yield run


def match_expression(text: str) -> str:
    return " OR ".join(f'"{w}"' + "*" * p for w, p in match_terms(text))


def carries_literal(text: str) -> bool:
    """Whether a query holds an exact identifier rather than words, judged by shape and Latin script only."""
    for raw in text.split():
        word = raw.strip(WORD_EDGES)
        if len(word) < 3:
            continue
        if re.search("[_@]", word):
            return True
        letters = re.findall("[A-Za-z]", word)
        if not letters:
            continue
        shouted = all(x.isupper() for x in letters) and len(word) >= 4
        if shouted or any(unicodedata.category(x) == "Nd" for x in word) or "." in word.removesuffix("."):
            return True
    return False


def keyword_weight(text: str) -> float:
    return LITERAL_WEIGHT if carries_literal(text) else KEYWORD_WEIGHT


def literal_weight(c: Column | str) -> Column:
    """:func:`keyword_weight` of a column of query texts, natively; a null text weighs as one without literals."""
    edges = "[" + re.escape(WORD_EDGES) + "]+"
    words = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"[\s\p{Z}]+"), lambda w: F.regexp_replace(w, f"^{edges}|{edges}$", ""))

    def literal(w: Column) -> Column:
        shouted = ~w.rlike("[a-z]") & (F.char_length(w) >= 4)
        shape = w.rlike("[A-Za-z]") & (shouted | w.rlike(r"\p{Nd}") | w.contains("."))
        return (F.char_length(w) >= 3) & (w.rlike("[_@]") | shape)

    return F.when(F.exists(words, literal), LITERAL_WEIGHT).otherwise(KEYWORD_WEIGHT)
