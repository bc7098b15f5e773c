"""From a question to reviewed SQL: plan, evidence, build and run, review, in a bounded number of rounds.

Each role is an interface; the ones here are rules. What a role says about execution is never taken on trust: the draft is
executed again by the guarded executor, and its real status decides.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from typing import Protocol

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.sqltext import literal, looks_like_sql, quoted, render
from ..operators.execute import Result, execute_readonly

# Evidence steps in their default order and their other names; iterations of each role and whether its tools
# may run in parallel; tools of each role.
STEPS = ("db_context", "knowledge")
ALIASES = {"db_context": "db_context", "dbcontext": "db_context", "db": "db_context", "knowledge": "knowledge", "knowledge_agent": "knowledge", "kb": "knowledge"}
ROLES = {"orchestrator": (8, False), "db_context": (8, True), "knowledge": (8, True), "sql_builder": (10, False), "sql_reviewer": (6, False)}
TOOLS = {"orchestrator": (), "db_context": ("introspect", "estimate_rows", "top_distinct", "execute", "explain"), "knowledge": ("search", "pages"), "sql_builder": ("introspect", "estimate_rows", "top_distinct", "execute", "explain"), "sql_reviewer": ()}
MOST_ROUNDS, DEFAULT_LIMIT = 3, 100


def step_order(plan: dict | None) -> list[str]:
    """Steps in the order a plan asks for (fanout_order, else execution_order), then those it does not name."""
    plan = plan or {}
    asked = plan.get("fanout_order")
    asked = plan.get("execution_order") if asked is None else asked
    named = [ALIASES.get(str(x or "").strip().lower()) for x in asked] if isinstance(asked, list) else []
    return list(dict.fromkeys([*filter(None, named), *STEPS]))


@dataclass
class Layer:
    """A table that questions may be about: its key, name, category and point columns."""

    table: str
    key: str
    name: str
    x: str
    y: str
    category: str | None = None


@dataclass
class Draft:
    sql: str = ""
    params: dict = field(default_factory=dict)
    kind: str = ""


@dataclass
class Review:
    verdict: str
    issues: list[str] = field(default_factory=list)


@dataclass
class Round:
    round_id: int
    plan: dict
    evidence: dict
    draft: Draft
    status: str
    row_count: int
    latency_ms: int
    error: str | None
    verdict: str
    issues: list[str]


@dataclass
class Answer:
    sql: str | None
    text: str
    rounds: list[Round]
    result: Result | None = None


class Planner(Protocol):
    def __call__(self, question: str, context: dict, rounds: list[Round]) -> dict: ...


class Builder(Protocol):
    def __call__(self, question: str, plan: dict, evidence: dict, rounds: list[Round]) -> Draft: ...


class Reviewer(Protocol):
    def __call__(self, question: str, draft: Draft, result: Result, evidence: dict) -> Review: ...


def features(spark: SparkSession, question: str, context: dict | None = None) -> dict:
    """The default evidence and knowledge request of a question."""
    c = context or {}
    q = F.lit(question)
    listed = lambda name: F.array(*map(F.lit, c.get(name) or [])).cast("array<string>")
    row = spark.range(1).select(X.default_evidence(q, F.lit(c.get("schema_name")), listed("table_list"), listed("view_list")).alias("f"), X.default_topics(q).alias("topics"), X.asks_nearest(q).alias("nearest")).first()
    return row["f"].asDict() | {"topics": list(row["topics"]), "nearest": row["nearest"]}


def rule_planner(spark: SparkSession) -> Planner:
    def plan(question: str, context: dict, rounds: list[Round]) -> dict:
        found = features(spark, question, context)
        number = re.search(r"\b(?:within|less than)\s+(\d+(?:\.\d+)?)\s*(km|kilomet\w+|m|met\w+|degrees?)?", question, re.IGNORECASE)
        kind = "within" if number else "nearest" if found["nearest"] else "count" if re.match(r"\s*how many\b", question, re.IGNORECASE) else "list"
        distance = None if not number else float(number[1]) * (1000 if (number[2] or "").lower().startswith("k") else 1)
        return {"kind": kind, "distance": distance, "unit": (number[2] or "") if number else "", "fanout_order": list(STEPS), "features": found, "error_text": rounds[-1].error if rounds else None}

    return plan


def rule_evidence(spark: SparkSession, layers: list[Layer], search: Callable[[str, int], list[str]] | None = None) -> dict[str, Callable[[str, dict], dict]]:
    """Evidence steps: rows that the question's entities name, the layer that has its category; and documents on its topics."""

    def database(question: str, plan: dict) -> dict:
        anchors, target, value = [], None, None
        for layer in layers:
            t = spark.table(layer.table)
            for e in plan["features"]["entity_candidates"]:
                for r in t.filter(F.lower(F.col(layer.name)) == e.lower()).select(layer.key, layer.x, layer.y).orderBy(layer.key).limit(2).collect():
                    anchors.append({"table": layer.table, "entity": e, "key": r[0], "x": r[1], "y": r[2]})
            for c in plan["features"]["target_categories"] if layer.category and target is None else []:
                hit = t.filter(F.lower(F.col(layer.category)).isin(c, c + "s")).select(layer.category).limit(1).collect()
                if hit:
                    target, value = layer, hit[0][0]
        return {"anchors": anchors, "target": target, "category": value}

    def knowledge(question: str, plan: dict) -> dict:
        topics = plan["features"]["topics"]
        return {"topics": topics, "documents": [d for t in topics for d in search(t, 2)] if search else []}

    return {"db_context": database, "knowledge": knowledge}


def rule_builder(layers: list[Layer]) -> Builder:
    def build(question: str, plan: dict, evidence: dict, rounds: list[Round]) -> Draft:
        db = evidence.get("db_context", {})
        target = db.get("target") or (layers[0] if len(layers) == 1 else None)
        if target is None:
            return Draft()
        t = target
        where = f" WHERE t.{quoted(t.category)} = :category" if db.get("category") is not None else ""
        params = {"category": db["category"]} if where else {}
        if plan["kind"] == "count":
            return Draft(f"SELECT count(*) AS total FROM {quoted(t.table)} t{where}", params, "count")
        if plan["kind"] == "list":
            return Draft(f"SELECT t.{quoted(t.key)} AS id, t.{quoted(t.name)} AS name FROM {quoted(t.table)} t{where} ORDER BY 1 LIMIT {DEFAULT_LIMIT}", params, "list")
        if not db.get("anchors"):
            return Draft()
        a = db["anchors"][0]
        d = f"sqrt(power(t.{quoted(t.x)} - :x, 2) + power(t.{quoted(t.y)} - :y, 2))"
        near = f"SELECT t.{quoted(t.key)} AS id, t.{quoted(t.name)} AS name, {d} AS distance FROM {quoted(t.table)} t{where}"
        params |= {"x": a["x"], "y": a["y"]}
        if plan["kind"] == "within":
            box = f"t.{quoted(t.x)} BETWEEN :x - :d AND :x + :d AND t.{quoted(t.y)} BETWEEN :y - :d AND :y + :d AND {d} <= :d"
            return Draft(f"{near}{' AND' if where else ' WHERE'} {box} ORDER BY distance, id LIMIT {DEFAULT_LIMIT}", params | {"d": plan["distance"]}, "within")
        return Draft(f"{near} ORDER BY distance, id LIMIT {1 if not re.search(r's\b', db.get('category') or '') else 10}", params, "nearest")

    return build


def rule_reviewer(question: str, draft: Draft, result: Result, evidence: dict) -> Review:
    """Checks of form, of the columns that the question asks for, and of the rows."""
    issues = []
    if not looks_like_sql(draft.sql):
        issues.append("no SQL was drafted")
    elif result.status != "OK":
        issues.append(f"execution failed: {result.error}")
    else:
        if draft.kind in ("nearest", "within") and "distance" not in result.columns:
            issues.append("the distance is not returned")
        if draft.kind == "nearest" and not result.row_count:
            issues.append("nothing is near")
        if draft.kind in ("nearest", "within") and any((r["distance"] or 0) < 0 for r in result.rows):
            issues.append("a distance is negative")
        if draft.kind != "count" and not re.search(r"\blimit\b", draft.sql, re.IGNORECASE):
            issues.append("the rows are not limited")
    return Review("FAIL" if issues else "PASS", issues)


def clarification(question: str, rounds: list[Round]) -> str:
    asked = rounds[-1].plan.get("features", {}) if rounds else {}
    missing = [what for what, have in (("which place to start from", asked.get("entity_candidates")), ("what kind of place to look for", asked.get("target_categories"))) if not have]
    problems = "; ".join(dict.fromkeys(i for r in rounds for i in r.issues)) or "no query could be drafted"
    return f"No query was accepted ({problems}). Please say {' and '.join(missing) or 'more precisely what you look for'}."


def answer(spark: SparkSession, question: str, planner: Planner, evidence: dict[str, Callable], builder: Builder, reviewer: Reviewer = rule_reviewer, context: dict | None = None, max_rounds: int = MOST_ROUNDS, emit: Callable[[str, dict], None] | None = None) -> Answer:
    """Rounds until a draft passes review and really runs; then its SQL with binds rendered, else a question back."""
    if not (question or "").strip():
        raise ValueError("the question is empty")
    say = emit or (lambda kind, payload: None)
    request = uuid.uuid4().hex
    rounds: list[Round] = []
    say("start", {"request_id": request})
    try:
        for n in range(1, max(1, max_rounds) + 1):
            plan = planner(question, context or {}, rounds)
            say("progress", {"request_id": request, "round": n, "stage": "plan"})
            found = {}
            for step in step_order(plan):
                found[step] = evidence[step](question, plan)
                say("progress", {"request_id": request, "round": n, "stage": step})
            draft = builder(question, plan, found, rounds)
            ran = execute_readonly(spark, draft.sql, draft.params) if draft.sql else Result("ERROR", error="no draft")
            review = reviewer(question, draft, ran, found)
            say("progress", {"request_id": request, "round": n, "stage": "review", "verdict": review.verdict})
            rounds.append(Round(n, plan, {k: str(v) for k, v in found.items()}, draft, ran.status, ran.row_count, ran.latency_ms, ran.error, review.verdict, review.issues))
            if review.verdict == "PASS" and ran.status == "OK":
                sql = render(draft.sql, draft.params)
                say("end", {"request_id": request, "status": "completed"})
                return Answer(sql, sql, rounds, ran)
        say("end", {"request_id": request, "status": "completed"})
        return Answer(None, clarification(question, rounds), rounds)
    except Exception as e:
        say("error", {"request_id": request, "error": str(e)})
        say("end", {"request_id": request, "status": "failed"})
        raise


def traces(spark: SparkSession, rounds: list[Round]):
    """The rounds as rows."""
    rows = [(r.round_id, r.plan.get("kind"), r.draft.sql, literal(sorted(r.draft.params)), r.status, r.row_count, r.latency_ms, r.error, r.verdict, r.issues, str(asdict(r)["plan"])) for r in rounds]
    return spark.createDataFrame(rows, "round_id int, kind string, sql string, params string, status string, row_count long, latency_ms long, error string, verdict string, issues array<string>, plan string")
