"""Text functions on columns: tokens, document texts, and the features of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that questions are searched for, the patterns of tokens and entities, the texts of default
# requests, and the limits; results depend on them.
NEAREST_WORDS = ["nearest", "closest", "closest to", "nearest to", "near"]
SPATIAL_WORDS = ["within", "distance", "near", "intersects", "buffer", "area", "length", "dwithin", "closest", "nearest"]
CATEGORIES = ["restaurant", "cafe", "bar", "hotel", "hospital", "school", "bank", "pharmacy", "station", "park", "museum", "supermarket"]
QUESTION_WORDS = ["Find", "List", "Show", "Give", "Get", "Where", "What", "Which", "Who", "When", "How"]
TOKEN = "[a-zA-Z_][a-zA-Z0-9_]*"
QUOTED = r"['\"“”]([^'\"“”]{2,120})['\"“”]"
CAPITALISED = r"\b([A-Z][\w&'/-]*(?:\s+[A-Z][\w&'/-]*){0,5})\b"
MOST_ENTITIES, MOST_KEYWORDS, MOST_OBJECTS, MOST_TABLES, MOST_COLUMNS = 5, 10, 6, 8, 12
NEAR_OUTPUTS, CATEGORY_FILTERS = ["id", "name", "distance"], ["fclass", "category", "type"]
TOPICS = ["SRID alignment", "geometry vs geography", "distance units"]
NEAR_TOPICS = ["ST_Distance", "nearest-neighbor ordering", "anchor geometry resolution"]
OTHER_TOPICS = ["ST_DWithin", "ST_Transform"]
CUT_NOTE = "\n...[stream truncated]"
#: What the evidence step is told to probe, by what a question names.
ENTITY_HINTS = ["Look the entities up in name columns with small read-only queries.", "Say for each the table, the name and geometry columns, and how sure the match is."]
CATEGORY_HINT = "Confirm the categories' values in the likely filter columns by their most frequent values."
CHUNK, MOST_CHARACTERS, MOST_CHUNKS = 200, 12_000, 200


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case identifier-like tokens of at least least characters, in order, repeats included; null gives none."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= max(1, least))


def document_text(doc: Column) -> Column:
    """Text of a function document (struct): its non-empty parts, a line each, in reading order."""
    none = F.array().cast("array<string>")
    functions = F.flatten(F.transform(F.coalesce(doc["function_definitions"], F.array()), lambda d: F.array(d["function_name"], d["signature_str"])))
    examples = F.flatten(F.transform(F.coalesce(doc["examples"], F.array()), lambda e: F.concat(F.array(e["name"]), F.flatten(F.transform(F.coalesce(e["steps"], F.array()), lambda s: F.array(s["question"], s["sql"]))))))
    parts = F.concat(F.array(doc["function_id"], doc["chapter_info"], doc["description"]), F.coalesce(functions, none), F.coalesce(examples, none))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def distinct_words(values: Column) -> Column:
    """Trimmed values without blanks; of values equal but for case the first spelling stays."""
    trimmed = F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(F.coalesce(v, F.lit("")))), lambda v: v != "")
    lowered = F.transform(trimmed, F.lower)
    return F.filter(trimmed, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


def string_list(values: Column) -> Column:
    """Trimmed values without blanks and nulls."""
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(v)), lambda v: F.coalesce(v, F.lit("")) != "")


def spatial_words(question: Column) -> Column:
    """Spatial words that the question holds, as substrings, in their fixed order."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.filter(F.array(*map(F.lit, SPATIAL_WORDS)), lambda w: F.contains(q, w))


def asks_nearest(question: Column) -> Column:
    """Whether a word for nearness is a substring of the question ("linear" has "near")."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.exists(F.array(*map(F.lit, NEAREST_WORDS)), lambda w: F.contains(q, w))


def categories(question: Column) -> Column:
    """Target categories that the question names as whole words, singular or plural, in their fixed order."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return F.filter(F.array(*map(F.lit, CATEGORIES)), lambda c: F.regexp_like(q, F.concat(F.lit(r"(?:^|[^a-z0-9_])"), c, F.lit(r"s?(?:$|[^a-z0-9_])"))))


def entities(question: Column) -> Column:
    """Entity candidates: quoted spans, then capitalised runs that no question word begins; at most five."""
    q = F.trim(F.coalesce(question, F.lit("")))
    quoted = F.transform(F.regexp_extract_all(q, F.lit(QUOTED), F.lit(1)), lambda v: F.trim(v))
    runs = F.regexp_extract_all(q, F.lit(CAPITALISED), F.lit(1))
    named = F.filter(runs, lambda r: ~F.regexp_extract(r, r"^(\S+)", 1).isin(QUESTION_WORDS))
    return F.slice(distinct_words(F.concat(quoted, named)), 1, MOST_ENTITIES)


def default_evidence(question: Column, schema: Column | None = None, tables: Column | None = None, views: Column | None = None) -> Column:
    """The evidence request for a question, as a struct: keywords, expected outputs, filters, signals and limits."""
    none = F.array().cast("array<string>")
    q = F.coalesce(question, F.lit(""))
    near, cats = asks_nearest(q), categories(q)
    some = F.size(cats) > 0
    words = F.slice(F.filter(F.split(q, r"\s+"), lambda w: w != ""), 1, MOST_KEYWORDS)
    return F.struct(
        q.alias("question"),
        F.concat(words, F.slice(F.coalesce(tables, none) if tables is not None else none, 1, MOST_OBJECTS), F.slice(F.coalesce(views, none) if views is not None else none, 1, MOST_OBJECTS)).alias("keywords"),
        F.concat(F.when(near, F.array(*map(F.lit, NEAR_OUTPUTS))).otherwise(none), F.when(some, F.array(F.lit("category"))).otherwise(none)).alias("expected_outputs"),
        F.when(some, F.array(*map(F.lit, CATEGORY_FILTERS))).otherwise(none).alias("likely_filters"),
        spatial_words(q).alias("spatial_signals"),
        entities(q).alias("entity_candidates"),
        cats.alias("target_categories"),
        F.array(F.coalesce(F.nullif(F.trim(schema), F.lit("")), F.lit("public")) if schema is not None else F.lit("public")).alias("schema_whitelist"),
        F.lit(MOST_TABLES).alias("max_tables"),
        F.lit(MOST_COLUMNS).alias("max_columns_per_table"),
        F.concat(F.when(F.size(entities(q)) > 0, F.array(*map(F.lit, ENTITY_HINTS))).otherwise(none), F.when(some, F.array(F.lit(CATEGORY_HINT))).otherwise(none)).alias("probe_hints"),
        F.struct(
            (F.nullif(F.trim(schema), F.lit("")) if schema is not None else F.lit(None).cast("string")).alias("schema_name"),
            (string_list(tables) if tables is not None else none).alias("table_list"),
            (string_list(views) if views is not None else none).alias("view_list"),
        ).alias("runtime_context"),
    )


def default_knowledge(question: Column, error_text: Column | None = None) -> Column:
    """The knowledge request for a question, as a struct; a web search is wanted if there is an error to explain."""
    error = error_text if error_text is not None else F.lit(None).cast("string")
    wanted = F.coalesce(error, F.lit("")) != ""
    return F.struct(question.alias("question"), default_topics(question).alias("topics"), wanted.alias("need_websearch"), error.alias("error_text"))


def default_topics(question: Column) -> Column:
    """Topics of the knowledge request."""
    return F.when(asks_nearest(question), F.array(*map(F.lit, TOPICS + NEAR_TOPICS))).otherwise(F.array(*map(F.lit, TOPICS + OTHER_TOPICS)))


def truthy(value: Column) -> Column:
    """1, true, yes, y and on, in either case, are true; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y", "on"), F.lit(False))


def preview(value: Column, most: int = 240) -> Column:
    return F.substring(value, 1, most)


def chunks(text: Column, size: int = CHUNK, most_chars: int = MOST_CHARACTERS, most_chunks: int = MOST_CHUNKS) -> Column:
    """The text in pieces of size characters: cut to most_chars with a note, and to most_chunks pieces."""
    t = F.coalesce(text, F.lit(""))
    cut = F.when(F.length(t) > most_chars, F.concat(F.substring(t, 1, most_chars), F.lit(CUT_NOTE))).otherwise(t)
    count = F.least(F.ceil(F.length(cut) / size), F.lit(most_chunks)).cast("int")
    return F.when(F.trim(t) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(cut, i * size + 1, F.lit(size))))


def context(raw: Column) -> Column:
    """A context struct from JSON text; invalid JSON and missing keys give the defaults, blank geometry gives null."""
    schema = "chat_id BIGINT, database_id BIGINT, schema_name STRING, table_list ARRAY<STRING>, view_list ARRAY<STRING>, geometry STRING"
    c = F.from_json(raw, schema)
    none = F.array().cast("array<string>")
    return F.struct(
        c["chat_id"].alias("chat_id"),
        c["database_id"].alias("database_id"),
        F.nullif(F.trim(c["schema_name"]), F.lit("")).alias("schema_name"),
        F.coalesce(string_list(c["table_list"]), none).alias("table_list"),
        F.coalesce(string_list(c["view_list"]), none).alias("view_list"),
        F.nullif(F.trim(c["geometry"]), F.lit("")).alias("geometry"),
    )


def merged_context(old: Column, new: Column, present: Column) -> Column:
    """old with the fields of new: ids and schema if not null, lists and geometry if their key is in present (array)."""
    scalar = [F.coalesce(new[f], old[f]).alias(f) for f in ("chat_id", "database_id", "schema_name")]
    listed = [F.when(F.array_contains(present, f), new[f]).otherwise(old[f]).alias(f) for f in ("table_list", "view_list", "geometry")]
    return F.struct(*scalar, *listed)


def feedback(value: Column) -> Column:
    """like, dislike, or null for blank, none and null; anything else raises."""
    v = F.lower(F.trim(value))
    return F.when(v.isNull() | v.isin("", "none", "null"), F.lit(None).cast("string")).when(v.isin("like", "dislike"), v).otherwise(F.raise_error(F.concat(F.lit("not a feedback: "), v)).cast("string"))


def database_type(value: Column) -> Column:
    """The spelling of a database type, whatever its case; an unknown one raises."""
    names = {n.lower(): n for n in ("Spatialite", "Postgis", "Sedona", "MySQL")}
    v = F.lower(F.trim(value))
    out = F.when(v.isNull(), F.lit(None).cast("string"))
    for low, name in names.items():
        out = out.when(v == low, name)
    return out.otherwise(F.raise_error(F.concat(F.lit("not a database type: "), v)).cast("string"))


def schema_names(value: Column) -> Column:
    """Schemas from a JSON array or a comma-separated list: trimmed, without blanks and repeats."""
    return F.array_distinct(string_list(F.coalesce(F.from_json(value, "ARRAY<STRING>"), F.split(value, ","))))


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def message_text(blocks: Column) -> Column:
    """Text blocks (structs of type and text) of a message, a line each."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")
