"""Read-only guard: on the text, and on the plan that Spark parses from it."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

# How a read-only statement may begin, and words that it may not hold, in literals neither.
PREFIXES = ("WITH", "SELECT", "SHOW", "EXPLAIN", "DESCRIBE", "PRAGMA")
FORBIDDEN = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "REPLACE", "GRANT", "REVOKE", "MERGE", "CALL")
_prefix = re.compile(rf"(?:{'|'.join(PREFIXES)})\b", re.IGNORECASE)
_forbidden = re.compile(rf"\b(?:{'|'.join(FORBIDDEN)})\b", re.IGNORECASE)
_lexeme = re.compile(r"'(?:[^']|'')*(?:'|\Z)|\"(?:[^\"]|\"\")*(?:\"|\Z)|--[^\n]*|/\*")
_comment = re.compile(r"/\*|\*/|\n")
#: Functions that reach outside the engine.
UNSAFE = frozenset(("java_method", "reflect", "try_reflect"))


def without_comments(sql: str | None) -> str:
    """sql without line comments and (nested) block comments; line ends and quoted text stay."""
    sql, out, at = sql or "", [], 0
    while m := _lexeme.search(sql, at):
        out.append(sql[at : m.start()])
        at = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (c := _comment.search(sql, at)):
                depth += {"/*": 1, "*/": -1}.get(c[0], 0)
                out.append("\n" if c[0] == "\n" else "")
                at = c.end()
            if depth:
                at = len(sql)
        elif not m[0].startswith("--"):
            out.append(m[0])
    return "".join([*out, sql[at:]])


def read_only_text(sql: str | None) -> str:
    """The trimmed statement without comments if the text rules allow it, else ValueError."""
    text = without_comments(sql).strip()
    if not text:
        raise ValueError("the statement is empty")
    if not _prefix.match(text):
        raise ValueError(f"only {', '.join(PREFIXES)} may begin a statement")
    if found := _forbidden.search(text):
        raise ValueError(f"{found[0].upper()} is not allowed in a read-only statement")
    return text


def _classes(plan) -> list[str]:
    """Simple names of a JVM plan's class and of all it extends."""
    out, todo = [], [plan.getClass()]
    while todo:
        c = todo.pop()
        if c is not None and c.getSimpleName() not in out:
            out.append(c.getSimpleName())
            todo += [c.getSuperclass(), *c.getInterfaces()]
    return out


def _children(plan) -> list:
    found = [plan.children().apply(i) for i in range(plan.children().size())]
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        relations = plan.cteRelations()
        found += [relations.apply(i)._2() for i in range(relations.size())]
    return found


def read_only_plan(spark: SparkSession, sql: str) -> str:
    """sql if Spark parses it to a query, or to a statement that shows, describes or explains; else ValueError.

    A statement is judged by its parse tree, so words in literals and names harm nothing, and a write in a common table
    expression is found.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise ValueError(f"the statement does not parse: {str(e).strip().splitlines()[0]}") from e
    if re.match(r"Show|Describe|Explain", plan.getClass().getSimpleName()):
        return sql
    todo = [plan]
    while todo:
        node = todo.pop()
        names = _classes(node)
        if "Command" in names or {"InsertIntoStatement", "Call", "ScriptTransformation", "MergeIntoTable", "DeleteFromTable", "UpdateTable", "ParsedStatement"} & set(names):
            raise ValueError(f"{names[0]} is not a read-only statement")
        todo += _children(node)
    for name in UNSAFE:
        if re.search(rf"\b{name}\s*\(", sql, re.IGNORECASE):
            raise ValueError(f"{name} is not allowed")
    return sql


def read_only(spark: SparkSession, sql: str | None, strict_text: bool = False) -> str:
    """The statement, without comments and final semicolons, if it only reads.

    strict_text also applies the text rules, which reject forbidden words in literals too.
    """
    text = read_only_text(sql) if strict_text else without_comments(sql).strip()
    text = text.rstrip("; \t\r\n")
    if not text:
        raise ValueError("the statement is empty")
    return read_only_plan(spark, text)
