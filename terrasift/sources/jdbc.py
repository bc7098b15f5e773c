"""JDBC addresses: parsing, credentials, and reader options."""

from __future__ import annotations

from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote_plus, urlencode, urlsplit

from pyspark.sql import DataFrame, SparkSession

# Spellings of kinds, their client drivers, and kinds whose credentials may be added.
KINDS = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mysql", "sqlserver": "sqlserver", "sqlite": "sqlite"}
CLIENTS = {"postgresql": "postgresql+psycopg2", "mysql": "mysql+pymysql", "sqlserver": "mssql+pyodbc"}
PATCHED = ("postgis", "sedona", "mysql")


@dataclass
class Address:
    kind: str
    host: str = ""
    port: int | None = None
    database: str = ""
    user: str | None = None
    password: str | None = None
    options: dict[str, str] = field(default_factory=dict)

    def client_url(self) -> str:
        """The address as client libraries write it, credentials before the host."""
        if self.kind == "sqlite":
            return "sqlite://" if self.database == ":memory:" else f"sqlite:///{self.database}"
        who = "" if self.user is None else quote_plus(self.user) + ("" if self.password is None else ":" + quote_plus(self.password)) + "@"
        port = f":{self.port}" if self.port else ""
        query = f"?{urlencode(self.options)}" if self.options else ""
        return f"{CLIENTS.get(self.kind, self.kind)}://{who}{self.host}{port}/{self.database}{query}"

    def reader_options(self) -> dict[str, str]:
        """Options of Spark's jdbc source; credentials are options, never part of the address."""
        port = f":{self.port}" if self.port else ""
        query = f"?{urlencode(self.options)}" if self.options else ""
        url = f"jdbc:sqlite:{self.database}" if self.kind == "sqlite" else f"jdbc:{self.kind}://{self.host}{port}/{self.database}{query}"
        return {"url": url} | ({"user": self.user} if self.user else {}) | ({"password": self.password} if self.password else {})

    def redacted(self) -> str:
        return Address(self.kind, self.host, self.port, self.database, self.user and "***", self.password and "***", self.options).client_url()


def parse(url: str) -> Address:
    """Reads jdbc:kind://host:port/database?options and jdbc:sqlite:path; an unknown kind stays as it is."""
    text = (url or "").strip()
    if not text.lower().startswith("jdbc:"):
        raise ValueError("a JDBC address begins with jdbc:")
    rest = text[5:]
    name = rest.split(":", 1)[0].lower()
    kind = KINDS.get(name, name)
    if kind == "sqlite":
        return Address("sqlite", database=rest.split(":", 1)[1].removeprefix("//") or ":memory:")
    if "://" not in rest:
        raise ValueError("the address has no //")
    parts = urlsplit(rest if kind != "sqlserver" else rest.replace(";", "?", 1).replace(";", "&"))
    options = dict(parse_qsl(parts.query, keep_blank_values=True))
    user = parts.username or options.pop("user", None)
    password = parts.password or options.pop("password", None)
    database = parts.path.lstrip("/") or options.pop("databaseName", "")
    return Address(kind, parts.hostname or "localhost", parts.port, database, user, password, options)


def with_credentials(url: str, database_type: str, user: str | None, password: str | None) -> str:
    """The address with credentials in its query, for the kinds that take them there, unless it has any or user is blank."""
    if database_type.lower() not in PATCHED or not (user or "").strip():
        return url
    options = dict(parse_qsl(url.partition("?")[2], keep_blank_values=True))
    if "user" in options or "password" in options:
        return url
    return url + ("&" if "?" in url else "?") + urlencode({"user": user.strip()} | ({"password": password} if password else {}))


def build(kind: str, host: str, port: int, database: str, user: str, password: str) -> str:
    return f"jdbc:{kind}://{host}:{port}/{database}?{urlencode({'user': user, 'password': password})}"


def read(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database; partitionColumn, lowerBound, upperBound and numPartitions make the scan parallel."""
    return spark.read.format("jdbc").options(**parse(url).reader_options(), dbtable=table, **options).load()
