"""Entities in append-only Parquet logs: each change is a row, the latest version of a key counts.

Writers check values, references and ownership; a deletion is a version too, and cascades. Every write is one atomic job.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the entities.
ROLES, STATES, OUTCOMES, MARKS = ("user", "admin"), ("active", "disabled"), ("success", "failure"), ("like", "dislike")
SPEAKERS, DATABASES = ("user", "assistant"), ("Spatialite", "Postgis", "Sedona", "MySQL")


def _text(value: object, name: str) -> str:
    out = str(value if value is not None else "").strip()
    if not out:
        raise ValueError(f"{name} is empty")
    return out


def _one_of(value: object, name: str, options: tuple[str, ...]) -> str:
    by_lower = {o.lower(): o for o in options}
    out = by_lower.get(_text(value, name).lower())
    if out is None:
        raise ValueError(f"{name} is none of {', '.join(options)}")
    return out


def _count(value: object, name: str) -> int:
    if int(value) < 0:
        raise ValueError(f"{name} is negative")
    return int(value)


def positive_id(value: object) -> int:
    """A positive whole number, also as text; else ValueError."""
    try:
        out = int(str(value).strip())
    except ValueError:
        out = 0
    if out < 1:
        raise ValueError(f"not an id: {value!r}")
    return out


def _jdbc(value: object, name: str) -> str:
    out = _text(value, name)
    if not out.lower().startswith("jdbc:"):
        raise ValueError(f"{name} does not begin with jdbc:")
    return out


@dataclass
class Entity:
    """Columns with their types, checks of values, and references (column: (entity, on delete: cascade or null))."""

    name: str
    columns: str
    checks: dict[str, Callable[[object, str], object]] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    refers: dict[str, tuple[str, str]] = field(default_factory=dict)
    unique: str | None = None
    private: tuple[str, ...] = ()


def _among(options: tuple[str, ...]) -> Callable[[object, str], object]:
    return lambda value, name: _one_of(value, name, options)


_ALL = (
    Entity(
        "users",
        "username string, password string, role string, status string, last_login timestamp_ntz",
        checks={"username": _text, "password": _text, "role": _among(ROLES), "status": _among(STATES)},
        optional=frozenset(("last_login",)),
        unique="username",
        private=("password",),
    ),
    Entity(
        "database_links",
        "user_id long, name string, type string, url string, db_username string, db_password string, schemas array<string>",
        checks={"name": _text, "type": _among(DATABASES), "url": _jdbc},
        optional=frozenset(("db_username", "db_password", "schemas")),
        refers={"user_id": ("users", "cascade")},
        private=("db_username", "db_password"),
    ),
    Entity("chat_sessions", "user_id long", refers={"user_id": ("users", "cascade")}),
    Entity(
        "chat_history",
        "chat_id long, request_id long, role string, agent_name string, content string, context_json string, feedback string",
        checks={"role": _among(SPEAKERS), "content": _text, "feedback": _among(MARKS)},
        optional=frozenset(("request_id", "agent_name", "context_json", "feedback")),
        refers={"chat_id": ("chat_sessions", "cascade")},
    ),
    Entity(
        "sql_execution_logs",
        "user_id long, chat_id long, database_id long, execute_status string, sql_text string, execution_time_ms long, row_count long",
        checks={"execute_status": _among(OUTCOMES), "sql_text": _text, "execution_time_ms": _count, "row_count": _count},
        optional=frozenset(("chat_id", "database_id")),
        refers={"user_id": ("users", "cascade"), "chat_id": ("chat_sessions", "null"), "database_id": ("database_links", "null")},
    ),
)
ENTITIES = {e.name: e for e in _ALL}


class Store:
    """Tables of entities under a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _schema(self, name: str) -> T.StructType:
        own = T.StructType.fromDDL(f"id long, {ENTITIES[name].columns}, insert_time timestamp_ntz, update_time timestamp_ntz")
        return T.StructType([*own.fields, T.StructField("_version", T.LongType()), T.StructField("_deleted", T.BooleanType())])

    def _log(self, name: str) -> DataFrame:
        schema = self._schema(name)
        path = f"{self.folder}/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def table(self, name: str) -> DataFrame:
        """The latest versions of all rows that are not deleted; only the newest of a key meets in a task."""
        schema = self._schema(name)
        last = self._log(name).groupBy("id").agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "_version").alias("r")).select("r.*")
        return last.filter(~F.col("_deleted")).drop("_version", "_deleted")

    def public(self, name: str) -> DataFrame:
        return self.table(name).drop(*ENTITIES[name].private)

    def get(self, name: str, key: int, owner: int | None = None) -> dict | None:
        """The row with an id (of an owner), or None."""
        rows = self.table(name).filter(F.col("id") == positive_id(key))
        if owner is not None:
            rows = rows.filter(F.col("user_id") == owner)
        got = rows.limit(1).collect()
        return got[0].asDict() if got else None

    def _append(self, name: str, rows: list[dict], deleted: bool = False) -> None:
        schema = self._schema(name)
        version = (self._log(name).agg(F.max("_version")).first()[0] or 0) + 1
        data = [tuple((r | {"_version": version, "_deleted": deleted}).get(f.name) for f in schema.fields) for r in rows]
        self.spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/{name}")

    def _append_frame(self, name: str, rows: DataFrame, deleted: bool) -> None:
        """New versions of rows, written where they are; nothing without any."""
        version = (self._log(name).agg(F.max("_version")).first()[0] or 0) + 1
        made = rows.withColumn("_version", F.lit(version).cast("long")).withColumn("_deleted", F.lit(deleted))
        if not rows.isEmpty():
            made.write.mode("append").parquet(f"{self.folder}/{name}")

    def _checked(self, name: str, values: dict, refer: bool = True) -> dict:
        entity, out = ENTITIES[name], {}
        known = set(T.StructType.fromDDL(entity.columns).names)
        if unknown := set(values) - known:
            raise ValueError(f"{name} has no {', '.join(sorted(unknown))}")
        for column, value in values.items():
            if value is None and column in entity.optional:
                out[column] = None
            else:
                out[column] = entity.checks[column](value, column) if column in entity.checks else value
        for column, (other, _) in entity.refers.items() if refer else ():
            if out.get(column) is not None and self.get(other, out[column]) is None:
                raise LookupError(f"{other} has no {out[column]}")
        return out

    def insert(self, name: str, /, **values: object) -> int:
        """Inserts a row and returns its id; every column that is not optional must be given."""
        return self.insert_many(name, [values])[0]

    def insert_many(self, name: str, rows: list[dict]) -> list[int]:
        """insert() of several rows as one write: values, references and unique keys are checked for all at once."""
        entity, known = ENTITIES[name], T.StructType.fromDDL(ENTITIES[name].columns).names
        needed = [c for c in known if c not in entity.optional]
        for values in rows:
            if missing := [c for c in needed if c not in values]:
                raise ValueError(f"{name} needs {', '.join(missing)}")
        made = [self._checked(name, values, refer=False) for values in rows]
        for column, (other, _) in entity.refers.items():
            wanted = {r[column] for r in made if r.get(column) is not None}
            have = {r["id"] for r in self.table(other).filter(F.col("id").isin(sorted(wanted))).select("id").collect()} if wanted else set()
            if lost := wanted - have:
                raise LookupError(f"{other} has no {min(lost)}")
        if entity.unique:
            keys = [r[entity.unique] for r in made]
            if len(set(keys)) < len(keys) or not self.table(name).filter(F.col(entity.unique).isin(keys)).isEmpty():
                raise ValueError(f"{name} has this {entity.unique} already")
        first = (self._log(name).agg(F.max("id")).first()[0] or 0) + 1
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None)
        for key, row in enumerate(made, first):
            if name == "chat_history" and row["role"] == "user" and row.get("request_id") is None:
                row["request_id"] = key  # a question is its own request
            row |= {"id": key, "insert_time": now, "update_time": now}
        if made:
            self._append(name, made)
        return [r["id"] for r in made]

    def insert_missing(self, name: str, key_column: str, rows: list[dict]) -> int:
        """Inserts the rows whose key column has no equal yet; returns how many."""
        keys = [r[key_column] for r in rows]
        have = {r[0] for r in self.table(name).filter(F.col(key_column).isin(keys)).select(key_column).collect()}
        return len(self.insert_many(name, [r for r in rows if r[key_column] not in have]))

    def compact(self, name: str) -> None:
        """Rewrites a log to the latest versions of its rows, deleted ones included, as one set of files.

        Ids stay taken. Call it while nobody writes: the new log takes the old one's place after it is whole.
        """
        schema = self._schema(name)
        last = self._log(name).groupBy("id").agg(F.max_by(F.struct(*[f.name for f in schema.fields]), "_version").alias("r")).select("r.*")
        path, fresh = f"{self.folder}/{name}", f"{self.folder}/_{name}_compacted"
        last.write.mode("overwrite").parquet(fresh)
        jvm = self.spark._jvm.org.apache.hadoop.fs
        fs = jvm.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(jvm.Path(path), True)
        fs.rename(jvm.Path(fresh), jvm.Path(path))

    def update(self, name: str, key: int, owner: int | None = None, /, **values: object) -> dict:
        """Writes a new version with the given columns changed (at least one); LookupError if there is no such row."""
        if not values:
            raise ValueError("nothing to update")
        row = self.get(name, key, owner)
        if row is None:
            raise LookupError(f"{name} has no {key}")
        row |= self._checked(name, values) | {"update_time": dt.datetime.now(dt.UTC).replace(tzinfo=None)}
        self._append(name, [row])
        return row

    def delete(self, name: str, key: int, owner: int | None = None) -> None:
        """Deletes a row; rows that refer to it go too, or lose the reference, as their entity says."""
        row = self.get(name, key, owner)
        if row is None:
            raise LookupError(f"{name} has no {key}")
        self._append(name, [row], deleted=True)
        for other in ENTITIES.values():
            for column, (target, rule) in other.refers.items():
                if target != name:
                    continue
                rows = self.table(other.name).filter(F.col(column) == key)
                if rule == "null":
                    self._append_frame(other.name, rows.withColumn(column, F.lit(None).cast("long")), False)
                elif any(t == other.name for e in ENTITIES.values() for t, _ in e.refers.values()):
                    for r in rows.select("id").collect():  # one owner's rows, each with rows of its own
                        self.delete(other.name, r["id"])
                else:
                    self._append_frame(other.name, rows, True)

    def login(self, username: str, password: str) -> dict | None:
        """The public row of an active user with this password, whose last login is set; else None."""
        got = self.table("users").filter((F.col("username") == username.strip()) & (F.col("password") == password) & (F.col("status") == "active")).limit(1).collect()
        if not got:
            return None
        row = self.update("users", got[0]["id"], last_login=dt.datetime.now(dt.UTC).replace(tzinfo=None))
        return {k: v for k, v in row.items() if k not in ENTITIES["users"].private}

    def log_execution(self, **values: object) -> int | None:
        """A row of the execution log; a failure to write it is not the caller's."""
        try:
            return self.insert("sql_execution_logs", **values)
        except Exception:
            return None


def users_with_links(users: DataFrame, links: DataFrame) -> DataFrame:
    """Users with a list of their links, by name; empty without any."""
    per = links.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("name", "type", F.col("id").alias("link_id")))).alias("links"))
    return users.join(per, users["id"] == per["user_id"], "left").drop("user_id").withColumn("links", F.coalesce("links", F.array()))


def orphans(rows: DataFrame, column: str, others: DataFrame, key: str) -> DataFrame:
    """Rows whose reference finds nothing; null refers to nothing and is no orphan."""
    return rows.filter(F.col(column).isNotNull()).join(others, rows[column] == others[key], "left_anti")
