"""Read-only SQL over the views: guard, parameters, cap, dialect helpers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CAP = 500
#: SQL functions of the mirror's dialect that Spark lacks, as temporary SQL functions.
SHIMS = {
    "strftime": "(f STRING, t STRING) RETURNS STRING RETURN date_format(cast(t AS TIMESTAMP), replace(replace(replace(replace(replace(replace(replace(f, 'T', '\\'T\\''), '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))",
    "json_extract": "(j STRING, p STRING) RETURNS STRING RETURN get_json_object(j, p)",
    "unicode": "(s STRING) RETURNS INT RETURN ascii(s)",
    "glob": "(p STRING, s STRING) RETURNS BOOLEAN RETURN s RLIKE concat('^', replace(replace(regexp_replace(p, '([.+(){}|^$\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')",
    "julianday": "(t STRING) RETURNS DOUBLE RETURN unix_micros(cast(t AS TIMESTAMP)) / 86400000000D + 2440587.5D",
    "unixepoch": "(t STRING) RETURNS BIGINT RETURN unix_seconds(cast(t AS TIMESTAMP))",
    "datetime": "(t STRING) RETURNS STRING RETURN date_format(cast(t AS TIMESTAMP), 'yyyy-MM-dd HH:mm:ss')",
    "json_each": "(j STRING) RETURNS TABLE (value STRING) RETURN SELECT x FROM explode(from_json(j, 'array<string>')) AS t(x)",
}


#: Functions whose call is written anew, as no SQL function can take any type or aggregate: name -> text of the call's arguments.
REWRITES = {
    "iif": lambda a: f"if({', '.join(a)})",
    "total": lambda a: f"coalesce(sum({a[0]}), 0D)",
    "group_concat": lambda a: f"listagg({a[0]}, {a[1] if len(a) > 1 else chr(39) + ',' + chr(39)})",
    "json_group_array": lambda a: f"to_json(collect_list({a[0]}))",
}


def _arguments(sql: str, at: int) -> tuple[list[str], int] | None:
    """(arguments of the call whose parenthesis opens at ``at``, position after it); None if it never closes."""
    depth, start, out, quote = 0, at + 1, [], ""
    for i in range(at, len(sql)):
        c = sql[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return [*out, sql[start:i].strip()], i + 1
        elif c == "," and depth == 1:
            out.append(sql[start:i].strip())
            start = i + 1
    return None


def translate(sql: str) -> str:
    """The statement with the calls of REWRITES written anew, nested ones too; literals and quoted names stay as they are."""
    out, at = [], 0
    for m in re.finditer(r"'[^']*'|\"[^\"]*\"|`[^`]*`|\b([A-Za-z_]+)\s*\(", sql):
        if m.start() < at or not m[1] or m[1].lower() not in REWRITES:
            continue
        found = _arguments(sql, m.end() - 1)
        if found:
            out += [sql[at : m.start()], REWRITES[m[1].lower()]([translate(a) for a in found[0]])]
            at = found[1]
    return "".join([*out, sql[at:]])


class NotReadOnly(ValueError):
    """The statement is not a single SELECT."""


def check_text(sql: str) -> str:
    """The statement without a trailing semicolon; it must start with select or with and hold no other statement.

    Text after the first semicolon is refused even inside a literal.
    """
    head = sql.lstrip("( \t\r\n").lower()
    if not head.startswith(("select", "with")):
        raise NotReadOnly("only SELECT or WITH statements are allowed")
    first, _, rest = sql.partition(";")
    if rest.strip():
        raise NotReadOnly("only one statement is allowed")
    return first


def check_plan(spark: SparkSession, sql: str) -> None:
    """Refuse a statement whose parsed plan has a writing node anywhere: ``WITH .. INSERT`` parses like a query."""
    jvm = spark.sparkContext._jvm
    sessions = jvm.org.apache.spark.sql.classic.SparkSession
    active = sessions.getActiveSession()
    sessions.setActiveSession(spark._jsparkSession)  # the parser reads the active session's settings
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    finally:
        if active.isDefined():
            sessions.setActiveSession(active.get())
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command").isInstance(node) or name.startswith(("Insert", "Create", "Drop", "Replace", "Delete", "Update", "Merge")):
            raise NotReadOnly(f"the statement writes: {name}")
        for group in (node.children(), node.innerChildren()):
            todo += [x for i in range(group.size()) if hasattr((x := group.apply(i)), "children")]


def run(spark: SparkSession, sql: str, params: list | None = None, limit: int = CAP) -> tuple[DataFrame, int]:
    """(lazy result of at most limit + 1 rows, limit); positional ``?`` parameters. A limit out of 1..500 is 500."""
    text = translate(check_text(sql))
    check_plan(spark, text)
    cap = limit if 0 < limit <= CAP else CAP
    return spark.sql(text, args=params or None).limit(cap + 1), cap


def fetch(spark: SparkSession, sql: str, params: list | None = None, limit: int = CAP) -> dict:
    """``columns, rows, truncated`` of a query; byte values come as strings."""
    df, cap = run(spark, sql, params, limit)
    rows = df.collect()
    show = lambda v: bytes(v).decode("utf-8", "replace") if isinstance(v, (bytes, bytearray)) else v
    return {"columns": df.columns, "rows": [[show(v) for v in r] for r in rows[:cap]], "truncated": len(rows) > cap}


def register_shims(spark: SparkSession) -> list[str]:
    """Create the dialect functions in the session; returns the names."""
    for name, body in SHIMS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(SHIMS)
