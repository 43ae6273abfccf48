"""Visually identical text with different characters (p10).

Method: transitive look-alike classes over code points and short strings by union-find; the
most frequent member of a class in the corpus represents it; texts are rewritten greedily,
longest match first, by a multi-pattern automaton.

A text is rewritten in two steps, neither of which is repeated. First every character is brought to the key of its
class: invisible ones are dropped, the rest is decomposed canonically, letters take the key letter of their class, and
the result is composed again. Two texts look the same exactly if these keys are equal. Then the automaton
replaces the keys by the representatives, the members that are most frequent in the corpus.

The classes come from rules over the alphabet, so their number does not grow with the data;
only the frequencies of their members are counted, over all documents. Texts without any character that the rewriting
touches are told by one native pattern and never leave the JVM.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.shared import Scratch, heavy_keys, spread_join
from quillspark.tables import read

# Letters of the same shape.
CYRILLIC = "аеорсухіѕјһԁԛԝАВЕКМНОРСТХІЅЈԌԚԜ"
CYRILLIC_AS = "aeopcyxisjhdqwABEKMHOPCTXISJGQW"
GREEK = "οΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "oABEZHIKMNOPTYX"
# Default-ignorable characters besides format characters, first and last of each run.
IGNORABLE = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))

LETTERS = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))


class UnionFind:
    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = x
        while self.up.setdefault(root, root) != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, x: str, y: str) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        groups: dict[str, list[str]] = {}
        for x in sorted(self.up):
            groups.setdefault(self.find(x), []).append(x)
        return [g for g in groups.values() if len(g) > 1]


def _ruled() -> list[str]:
    """All characters but ideographs, Hangul syllables, surrogates, empty planes and private use, which no rule touches."""
    blank = ((0x3400, 0x9FFF), (0xAC00, 0xDFFF), (0x20000, 0xDFFFF), (0xF0000, sys.maxunicode))
    at, out = 0, []
    for a, b in blank:
        out += map(chr, range(at, a))
        at = b + 1
    return out


@functools.cache
def alphabet() -> tuple[frozenset[str], dict[str, str], dict[str, tuple[str, str]]]:
    """(invisible characters; character -> ordinary one; composed character -> base and mark).

    Ordinary forms are told by the kind of decomposition: wide forms and spaces that only forbid a break.
    """
    unseen, plain, composed = set(), dict(LETTERS), {}
    ignorable = {chr(c) for a, b in IGNORABLE for c in range(a, b + 1)}
    for c in _ruled():
        if unicodedata.category(c) == "Cf" or c in ignorable:
            unseen.add(c)
            continue
        kind, _, parts = unicodedata.decomposition(c).rpartition("> ")
        codes = [chr(int(x, 16)) for x in parts.split()]
        if kind == "<wide" or kind == "<noBreak" and codes == [" "]:
            plain[c] = plain.get(codes[0], codes[0])
        elif not kind and len(codes) == 2:
            composed[c] = (codes[0], codes[1])
    return frozenset(unseen), plain, composed


def key_of(t: str) -> str:
    """The text in the keys of its characters' classes; equal exactly for texts that look the same."""
    unseen, plain, _ = alphabet()
    bare = "".join(c for c in t if c not in unseen)
    return unicodedata.normalize("NFC", "".join(plain.get(c, c) for c in unicodedata.normalize("NFD", bare)))


@functools.cache
def look_alikes() -> list[list[str]]:
    """All classes of strings that look the same; the empty string is the look of an invisible character."""
    uf = UnionFind()
    unseen, plain, composed = alphabet()
    for c in unseen:
        uf.union(c, "")
    for a, b in plain.items():
        uf.union(a, b)
    alike = {x: group for group in uf.classes() for x in group if "" not in group}
    # shorter decompositions first, so that a base that is composed itself has its class by then
    for c, (base, mark) in sorted(composed.items(), key=lambda x: len(unicodedata.normalize("NFD", x[0]))):
        group = [c, unicodedata.normalize("NFD", c), *(other + mark for other in alike.get(base, [base]))]
        for other in group:
            uf.union(c, other)
        alike[c] = group
    return uf.classes()


@functools.cache
def members() -> tuple[np.ndarray, object, np.ndarray]:
    """(code points that are members; automaton over longer members; whether a code point is a mark of one)."""
    own = [m for group in look_alikes() for m in group]
    longer = ahocorasick.Automaton()
    for m in own:
        if len(m) > 1:
            longer.add_word(m, m)
    longer.make_automaton()
    marks = np.zeros(sys.maxunicode + 1, bool)
    marks[[ord(c) for m in own for c in m[1:]]] = True
    return np.array(sorted(ord(m) for m in own if len(m) == 1)), longer, marks


def count_members(texts) -> Counter:
    """Occurrences of class members, longest match first, over whole texts; also of every other character beyond ASCII.

    Characters are counted as an array of code points; longer members are looked for where there are marks only. A
    character that occurs inside longer members only is there with 0.
    """
    single, longer, marks = members()
    joined = "\n".join(t for t in texts if t)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(codes, minlength=int(single.max()) + 1)
    n[0xD800:0xE000] = 0
    own = np.zeros(len(n), bool)
    own[single] = own[128:] = True
    seen: Counter = Counter({chr(code): int(n[code]) for code in np.flatnonzero(own & (n > 0))})
    at = np.flatnonzero(marks[codes])
    starts = at[np.r_[True, at[1:] != at[:-1] + 1]] if len(at) else at
    ends = at[np.r_[at[1:] != at[:-1] + 1, True]] if len(at) else at
    for a, b in zip(starts, ends):  # a character with the marks that follow it
        for _, m in longer.iter_long(joined[max(a - 1, 0) : b + 1]):
            seen[m] += 1
            seen.subtract(c for c in m if c in seen)
    return seen


def representatives(frequency: dict[str, int]) -> dict[str, str]:
    """key -> representative where they differ: the most frequent member; on a tie the key, then the shortest and smallest.

    Invisible characters always give way to nothing.
    """
    out = {}
    for group in look_alikes():
        if "" not in group:
            key = key_of(group[0])
            best = min(group, key=lambda m: (-frequency.get(m, 0), m != key, len(m), m))
            if best != key:
                out[key] = best
    return out


def rewriter(frequency: dict[str, int]):
    """Function that brings a text to its one form; applying it twice changes nothing more."""
    reps = representatives(frequency)
    unseen, plain, _ = alphabet()
    letters = str.maketrans(plain | dict.fromkeys(unseen))
    shown = ahocorasick.Automaton()
    parts = re.compile("|".join(map(re.escape, reps)) or "(?!)")
    for group in look_alikes():
        key = key_of(group[0])
        if key in reps or parts.search(key):  # a key that stays is a pattern too where a part of it would be replaced
            shown.add_word(key, (len(key), reps.get(key, key)))
    shown.make_automaton()

    def rewrite(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFC", unicodedata.normalize("NFD", t).translate(letters))
        if not reps:
            return t
        out, at = [], 0
        for end, (n, r) in shown.iter_long(t):
            out += (t[at : end + 1 - n], r)
            at = end + 1
        return "".join([*out, t[at:]])

    return rewrite


def touched(frequency: dict[str, int]) -> str:
    """Pattern (of Java) of the characters that rewriting may change, alone or with their neighbours.

    These are, among the characters that occur, those that aren't their own key, those that compose with the one before,
    and the last ones of keys with another representative. A text without any of them is its own form. The many ranges beyond
    ASCII are tried for characters beyond ASCII only.
    """
    unseen, plain, composed = alphabet()
    hit = set(unseen) | set(plain) | {key[-1] for key in representatives(frequency)} | {mark for _, mark in composed.values()}
    for c in [*_ruled(), *map(chr, range(0xF900, 0xFB00)), *map(chr, range(0x2F800, 0x2FA20))]:
        jamo = 0x1100 <= ord(c) <= 0x11FF
        if unicodedata.combining(c) or jamo or unicodedata.decomposition(c)[:1] not in ("", "<") and key_of(c) != c:
            hit.add(c)
    runs: list[list[int]] = []
    for code in sorted(ord(c) for c in hit if c < "\x80" or c in frequency):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    ranges = lambda low: "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in runs if (x < 128) == low)
    plain_ones, others = ranges(True), ranges(False)
    return "|".join([f"[{plain_ones}]"] * bool(plain_ones) + [f"[\\x{{80}}-\\x{{10FFFF}}&&[{others}]]"] * bool(others)) or "(?!)"


def unify(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, text`` rows with the canonical form as ``form``.

    A null text has a null form, an empty one an empty form; repeated rows stay; other columns
    are dropped. Member frequencies are counted per batch and summed, so at most one row per
    member of the alphabet and task is shuffled. The number of members is fixed by Unicode.
    """
    keyed = documents.select(F.col(key), F.col(text).alias("text"))

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            seen.update(count_members(pdf["text"]))
        yield pd.DataFrame(sorted(seen.items()), columns=["member", "n"])

    counted = keyed.select("text").mapInPandas(count, "member string, n long").groupBy("member").agg(F.sum("n").alias("n"))
    frequency = {r["member"]: r["n"] for r in counted.collect()}
    made = {}

    def rewrite(batches):
        if not made:
            made["f"] = rewriter(frequency)
        f = made["f"]
        for pdf in batches:
            pdf["form"] = [f(t) for t in pdf["text"]]
            yield pdf

    changes = F.coalesce(F.col("text").rlike(touched(frequency)), F.lit(False))
    same = keyed.filter(~changes).select(key, "text", F.col("text").alias("form"))
    kind = keyed.schema[key].dataType.simpleString()
    return same.unionByName(keyed.filter(changes).mapInPandas(rewrite, f"`{key}` {kind}, text string, form string"))


def looks(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """(``doc_id, look, exact``: digests of form and text, distinct; their number); written, so that texts are rewritten once."""
    rows = unify(documents, key, text).filter("form IS NOT NULL").select(
        F.col(key).alias("doc_id"), F.unhex(F.md5("form")).alias("look"), F.unhex(F.md5("text")).alias("exact")
    )
    return Scratch(documents.sparkSession).put_counted(rows.dropDuplicates())


def look_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its class (least id of equal form), the representative of its exact text, and the class's number of texts.

    Null texts are left out; repeated ids count once. A text that many documents share is one row of the classes, and
    its documents are cut into parts.
    """
    hashed, total = looks(documents, key, text)
    reps = hashed.groupBy("look", "exact").agg(F.min("doc_id").alias("rep"))
    classes = reps.groupBy("look").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n_texts"))
    known = spread_join(reps, classes, "look", heavy_keys(reps, "look", total)).select("exact", "rep", "class_id", "n_texts")
    return spread_join(hashed.select("exact", "doc_id"), known, "exact", heavy_keys(hashed, "exact", total)).select("doc_id", "class_id", "rep", "n_texts")


def look_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs ``doc_id_a < doc_id_b`` of documents with equal form and different text.

    Every document is paired with the representative (least id) of every other text of its class,
    so all pairs of different texts come out, and copies are joined to each of them without
    being expanded against each other. Only classes of several texts are joined, and their documents in parts, so that
    a class of many documents isn't one task.
    """
    hashed, total = looks(documents, key, text)
    reps = hashed.groupBy("look", "exact").agg(F.min("doc_id").alias("rep"))
    mixed = reps.groupBy("look").agg(F.min("exact").alias("lo"), F.max("exact").alias("hi")).filter("lo <> hi").select("look")
    texts = reps.join(mixed, "look")
    docs = spread_join(hashed.select("exact", "doc_id"), texts.select("exact", "look", F.col("rep").alias("own")), "exact", heavy_keys(hashed, "exact", total))
    parts = 16
    other = texts.select(F.col("look").alias("o_look"), F.col("exact").alias("o_exact"), "rep", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o_part"))
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    pairs = docs.join(other, (F.col("look") == F.col("o_look")) & (F.col("part") == F.col("o_part")) & (F.col("exact") != F.col("o_exact")))
    return pairs.filter("doc_id <> own OR doc_id < rep").select(
        F.least("doc_id", "rep").alias("doc_id_a"), F.greatest("doc_id", "rep").alias("doc_id_b")
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_pairs(read(spark, sf_dir, "documents")).distinct()


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document by look."""
    return look_classes(read(spark, sf_dir, "documents"))


def _shown_sql(c: str) -> str:
    """The look of a text in SQL, by its own reading of the task: DuckDB composes but can't decompose, so composed letters are listed by rule."""
    single, several = dict(LETTERS), {}
    for code in range(0x370, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in LETTERS:
            latin = unicodedata.normalize("NFC", LETTERS[parts[0]] + parts[1:])
            (single if len(latin) == 1 else several)[unicodedata.normalize("NFC", chr(code))] = latin
    wide = [chr(x) for x in (*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), 0x3000)]
    narrow = [unicodedata.normalize("NFKC", x) if x != "\uffe3" else "\u00af" for x in wide]
    quote = lambda x: x.replace("'", "''")
    out = f"translate({c}, '{''.join(wide)}\u00a0\u2007\u202f', '{quote(''.join(narrow))}   ')"
    unseen = "\\p{Cf}" + "".join(f"\\x{{{x:x}}}-\\x{{{y:x}}}" for x, y in ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)))
    out = f"translate(nfc_normalize(regexp_replace({out}, '[{unseen}]', '', 'g')), '{''.join(single)}', '{''.join(single.values())}')"
    for x, y in several.items():
        out = f"replace({out}, '{x}', '{y}')"
    return f"nfc_normalize({out})"


_SHOWN = f"WITH shown AS (SELECT doc_id, text, {_shown_sql('text')} AS look FROM documents)"
P10_SQL = f"""{_SHOWN},
classes AS (SELECT look, text, min(doc_id) AS rep FROM shown GROUP BY look, text)
SELECT DISTINCT least(s.doc_id, c.rep) AS doc_id_a, greatest(s.doc_id, c.rep) AS doc_id_b
FROM shown s JOIN classes c ON c.look = s.look AND c.text <> s.text"""
P10_CLASSES_SQL = f"""{_SHOWN},
n AS (SELECT look, count(DISTINCT text) AS n_texts, min(doc_id) AS class_id FROM shown WHERE text IS NOT NULL GROUP BY look)
SELECT DISTINCT doc_id, class_id, min(doc_id) OVER (PARTITION BY shown.look, text) AS rep, n_texts FROM shown JOIN n ON n.look = shown.look"""
