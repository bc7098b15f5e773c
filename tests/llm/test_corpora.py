"""Operators that compare rows with one another, and the pipeline."""

import base64
import collections
import hashlib
import itertools
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from terrasift.llm import decontaminate, queries, secret_scan, sharding, similar, simhash, warc
from terrasift.llm.common import components, shared_folder, written

SMALL = "/root/testdata/sf0.001"
EDGES = [(1, "one two three four", 0), (2, None, 1), (3, "", 2), (None, "no id here at all", 3), (1, "one two three four", 0), (4, "long words, and lines\n" * 5000, 4), (5, " \n\t ", 5), (None, "", 6), (6, "é日本🎉 and more words", 7)]
EDGE_SCHEMA = "doc_id long, text string, {} int"


def edges(spark, extra):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA.format(extra))


# Components.


def roots_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "none"])
def test_components(spark, kind):
    r = random.Random(2)
    pairs = {"random": [(r.randrange(120), r.randrange(120)) for _ in range(90)], "chain": [(i, i + 1) for i in range(-40, 40)], "star": [(7, i) for i in range(60)], "none": []}[kind]
    df = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {x["node"]: x["root"] for x in components(df).collect()}
    want = {k: v for k, v in roots_of([p for p in pairs if p[0] != p[1]]).items()}
    assert got == want


# SimHash.


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2]
    root = roots_of([*near, *((a, a) for a in fps)])
    return {a: {b for b in fps if root[b] == root[a]} for a in fps}


def test_pivot_tables():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 63, 400, np.uint64)
    y = x ^ np.uint64(1 << 17) ^ np.uint64(1 << 50)
    assert len({tuple(t) for t in simhash.DISTANCES.tolist()}) == 256  # the pivots of a group tell all its patterns apart
    pivots = [w << 8 * g for g in range(8) for w in simhash.WALSH]
    assert simhash.table(x).tolist() == [[bin(int(v) ^ p).count("1") for p in pivots] for v in x]
    assert np.abs(simhash.table(x) - simhash.table(y)).max() <= 2
    assert all(set(a) & set(b) for a, b in zip(simhash.keys(x).tolist(), simhash.keys(y).tolist(), strict=True))
    assert not set(simhash.keys(x[:1])[0].tolist()) & set(simhash.keys(x[1:2])[0].tolist())


@pytest.mark.parametrize("size", [40, 900])
def test_links_of_a_key(size):
    """Both ways of linking a key's fingerprints, against all pairs."""
    r = random.Random(size)
    base = r.getrandbits(64) & ~0xFF00FF
    fps = np.array(sorted({base | r.getrandbits(8) | r.getrandbits(8) << 16 for _ in range(size)}), np.uint64)
    got = roots_of([(int(fps[a]), int(fps[b])) for a, b in simhash.linked(fps, (0, 2))] + [(int(f), int(f)) for f in fps])
    want = plain_components([int(f) for f in fps])
    assert all(got[a] == min(want[a]) for a in want)


def test_simhash_links(spark):
    r = random.Random(9)
    fps = {r.getrandbits(64) for _ in range(60)} | {0}
    for f in list(fps)[:40]:
        for _ in range(r.randrange(4)):
            f ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            fps.add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    roots = components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()
    got = {x["node"] % (1 << 64): x["root"] for x in roots}
    want = plain_components(list(fps))
    assert all((got[a] == got[b]) for a in got for b in want[a]) and all((f in got) == (len(want[f]) > 1) for f in fps)
    assert len(set(got.values())) == len({frozenset(want[a]) for a in got})


def test_simhash_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    fps = {i: plain_fingerprint(t) for i, t in docs}
    groups = plain_components(list(set(fps.values())))
    least = {f: min(i for i in fps if fps[i] in g) for f, g in groups.items()}
    got = queries.QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(i, f"{f:016x}", least[f]) for i, f in fps.items()} and len(got) == len(docs)


@pytest.mark.parametrize("extra", ["_fp", "_id", "n"])
def test_simhash_edges(spark, extra):
    df = edges(spark, extra)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(EDGES) and sorted(r["component_id"] for r in got if r["fp"] == 0) == [2, 2, 2, 2]
    kept = similar.deduplicated(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 2, 4, 6, None]
    assert similar.deduplicated(df.filter("false")).count() == 0 == simhash.near_duplicates(df.filter("false")).count()


def plain_similarities(texts):
    """Jaccard similarity of the distinct five-word shingles of every two texts that share one."""
    sets, holders = {}, collections.defaultdict(list)
    for i, t in texts.items():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[i]:
            holders[s].append(i)
    pairs = {tuple(sorted(p)) for h in holders.values() if len(h) < 200 for p in itertools.combinations(h, 2)}
    return {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i, j in pairs}


def test_similar_groups(spark):
    r = random.Random(5)
    bank, weights = [f"w{i}" for i in range(3000)], [1 / (i + 1) for i in range(3000)]
    texts = {}
    for _ in range(80):
        words = r.choices(bank, weights, k=r.choice([20, 60, 200, 800]))
        for _ in range(1 + r.randrange(4)):
            copy = list(words)
            for p in r.sample(range(len(copy)), int(len(copy) * r.choice([0, 0.005, 0.01, 0.02]))):
                copy[p] = r.choice(bank)
            texts[len(texts)] = " ".join(copy)
    rows = written(similar.sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "similar-test")
    root = {x["id"]: x["root"] for x in rows.select("id", "node").join(similar.groups(rows), "node").collect()}
    near = plain_similarities(texts)
    wanted = [p for p, s in near.items() if s >= 0.8]
    assert len(wanted) > 50 and sum(root[i] == root[j] for i, j in wanted) >= 0.95 * len(wanted)
    related = roots_of([*((p) for p, s in near.items() if s >= 0.6), *((i, i) for i in texts)])
    assert all(related[i] == related[j] for i in texts for j in texts if root[i] == root[j])


# Decontamination.


def plain_matches(text, items):
    """All diagonals and all stretches of each item."""
    w, out = decontaminate.words(text or ""), {}
    for key, item in items:
        v = decontaminate.words(item or "")
        need = min(13, -(-4 * len(v) // 5))
        for shift in range(-len(v), len(w)) if v else []:
            same = [0 <= i + shift < len(w) and w[i + shift] == v[i] for i in range(len(v))]
            for a in range(len(v)):
                for b in range(a + need, len(v) + 1):
                    if a + shift >= 0 and b + shift <= len(w) and same[a] and same[b - 1] and 5 * sum(same[a:b]) >= 4 * (b - a) and b - a > out.get(key, 0):
                        out[key] = b - a
    return out


def test_decontamination_against_all_alignments():
    r = random.Random(8)
    bank = [f"w{i}" for i in range(40)]
    items = [(k, " ".join(r.choices(bank, k=n))) for k, n in enumerate([3, 6, 9, 14, 20, 30, 0])]
    index = decontaminate.Index(items)
    found = missed = 0
    for _ in range(120):
        k = r.randrange(6)
        copy = items[k][1].split()
        for p in r.sample(range(len(copy)), round(r.choice([0, 0.1, 0.2]) * len(copy))):
            copy[p] = r.choice(bank)
        text = " ".join(r.choices(bank, k=30) + copy + r.choices(bank, k=20))
        alone = index.search(text)
        assert index.search_many(["", text, items[5][1], text])[1::2] == [alone, alone]
        got, want = {m[0]: m[2] for m in alone}, plain_matches(text, items)
        assert all(want.get(key, 0) >= n for key, n in got.items())  # never more than there is
        found += len(got)
        missed += len(set(want) - set(got))
    assert missed <= 0.03 * (found + missed)


@pytest.mark.parametrize("hits", [1 << 20, 7])
def test_decontamination_of_items_of_one_template(monkeypatch, hits):
    """Items that share a template, and texts that hold it often: each item's best copy, as by all alignments."""
    monkeypatch.setattr(decontaminate, "HITS", hits)
    monkeypatch.setattr(decontaminate, "ALIGNED", 50 * hits)
    r = random.Random(3)
    template = [f"t{i}" for i in range(9)]
    items = [(k, " ".join([*template, *(f"i{r.randrange(60)}" for _ in range(6))])) for k in range(60)]
    index = decontaminate.Index(items)
    texts = [" ".join([*template, "x", *template, *(f"i{r.randrange(60)}" for _ in range(6)), items[k][1], "y", *template[:7]]) for k in (3, 40)] + ["", " ".join(template)]
    for text, got in zip(texts, index.search_many(texts), strict=True):
        assert {m[0]: m[2] for m in got} == plain_matches(text, items)


def test_decontamination_of_many_items_of_one_template():
    template = "what is the right answer to the following question about"
    index = decontaminate.Index([(k, f"{template} subject{k} case{k % 97} part{k % 89} year{k}") for k in range(20_000)])
    text = " ".join([template, "none of them", template, "subject77 case77 part77 year77", *(f"w{i}" for i in range(150))])
    began = time.perf_counter()
    got = index.search(text)
    assert time.perf_counter() - began < 3 and 77 in {m[0] for m in got}


def test_stretch():
    same = np.array([1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 1], bool)
    assert decontaminate.stretch(same, 5) == (0, 10) and decontaminate.stretch(same, 11) is None and decontaminate.stretch(same[:0], 1) is None
    r = np.random.default_rng(3)
    for _ in range(300):
        x = r.random(25) < r.choice([0.5, 0.7, 0.9])
        best = max((b - a for a in range(25) for b in range(a + 1, 26) if x[a] and x[b - 1] and 5 * x[a:b].sum() >= 4 * (b - a)), default=0)
        s = decontaminate.stretch(x, 1)
        assert s is None and best == 0 or s is not None and x[s[0]] and x[s[1] - 1] and 5 * x[s[0] : s[1]].sum() >= 4 * (s[1] - s[0]) and s[1] - s[0] == best


def test_decontamination_query(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op5_benchmark_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet").collect() for t in ("documents", "benchmark"))
    flat = lambda t: f" {' '.join(decontaminate.words(t))} "
    whole = {(d["doc_id"], b["item_id"]) for d in docs for b in items if flat(b["text"]) in flat(d["text"])}
    assert whole and whole <= got and len(got - whole) <= 0.05 * len(whole)


@pytest.mark.parametrize("characters", [3_000_000, 20])
def test_decontamination_edges(spark, monkeypatch, characters):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARACTERS", characters)  # 20: several blocks
    df = edges(spark, "item_id")
    bench = spark.createDataFrame([(1, "One, two; three FOUR!", 0), (1, "One, two; three FOUR!", 1), (2, None, 0), (3, " ", 0), (None, "and more words", 0)], "item_id long, text string, doc_id int")
    got = sorted(map(tuple, decontaminate.matches(df, bench).select("doc_id", "item_id", "n_aligned").collect()), key=str)
    assert got == [(1, 1, 4), (1, 1, 4), (6, None, 3)]
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == len(EDGES) - 3
    assert decontaminate.clean(df, bench.filter("false")).count() == len(EDGES) and decontaminate.matches(df.filter("false"), bench).count() == 0


# Shards.


def check_shards(rows, docs, shards=8):
    size = lambda t: len((t or "").encode()) + 1
    total = sum(size(t) for _, t in docs)
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in docs)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    largest = max((size(t) for _, t in docs), default=0)
    for s in by:
        assert 0 <= s < shards and sorted(r["slot"] for r in by[s]) == list(range(len(by[s])))
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= largest + total / shards * 1e-3 + 1
    return by


def test_shards_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rows = queries.QUERIES["op6_sampled_splitters"](spark, "/root/testdata/sf0.01").collect()
    check_shards(rows, docs)
    homes = collections.defaultdict(set)
    text = dict(docs)
    for r in rows:
        homes[text[r["doc_id"]]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())  # copies stay together


def test_shards_of_hot_groups(spark, tmp_path):
    """One text holds two fifths of all bytes, another a tenth."""
    r = random.Random(1)
    docs = [(i, "hot " * 20) for i in range(1200)] + [(5000 + i, "warm " * 10) for i in range(500)] + [(10_000 + i, "x" * r.randrange(80)) for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard(df).collect()
    by = check_shards(rows, docs)
    where = collections.Counter(s for s in by for x in by[s] if 5000 <= x["doc_id"] < 10_000)
    assert len(where) == 1  # a group that fits a shard is whole
    sharding.write_shards(df.withColumn("shard", F.lit("old")).withColumn("_id", F.lit(1)), str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(docs)


def test_shards_subdivide(spark, monkeypatch):
    monkeypatch.setattr(sharding, "KEYS_PER_RANGE", 1)  # poor samples leave overfull ranges
    docs = [(i, f"{i} " + "t" * (i % 50)) for i in range(2000)]
    check_shards(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_shards_of_many_light_rows(spark, monkeypatch):
    """A fifth of the rows are empty: few bytes, but no task gets them all."""
    r = random.Random(4)
    docs = [(i, "") for i in range(2000)] + [(10_000 + i, "x" * 30 + "".join(r.choices("abcdef ", k=r.randrange(200)))) for i in range(8000)]
    seen = []
    monkeypatch.setattr(sharding, "_pack", lambda groups, *a, own=sharding._pack: seen.append(groups) or own(groups, *a))
    by = check_shards(sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)
    assert any(size == 2000 for _, _, size in seen[0])  # listed as heavy
    assert sum(any(x["size"] == 1 for x in by[s]) for s in by) == 1


def test_shards_of_one_giant_text(spark):
    docs = [(i, f"{i}") for i in range(3000)] + [(9999, "x" * 100_000)]
    rows = sharding.shard(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 3001 and sorted(r["doc_id"] for r in rows) == sorted(d for d, _ in docs)


def test_shards_edges(spark):
    docs = [(i, t) for i, t, _ in EDGES]
    check_shards(sharding.shard(edges(spark, "size")).collect(), docs)
    assert sharding.shard(edges(spark, "slot").filter("false")).count() == 0


# WARC.


def test_warc_query(spark):
    db = duckdb.connect()
    db.sql(f"create view pages as select * from '{SMALL}/pages.parquet'")
    want = db.sql(f"select page_id, payload_bytes, payload_digest, record_type, refers_to from ({queries.ORACLES['op7_warc_transactions']})").fetchall()
    got = queries.QUERIES["op7_warc_transactions"](spark, SMALL).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_warc_edges(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n\n\r\n\r\n"
    pages = [(3, "http://h/a", tricky, 0), (2, None, tricky, 1), (5, "http://h/é?x#y", None, 2), (6, "bad\r\nWARC-X: 1", "", 3), (None, "u", tricky, 4), (7, "http://h", "é日本" * 9000, 5), (7, "http://h", "é日本" * 9000, 5), (8, "http://only", "x" * 200_000, 6), (9, None, "same", 7), (9, "", "same", 8), (9, None, "same", 9), (1, "z", "same", 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int")
    folder = shared_folder(spark, "warc-test")
    warc.write(df, folder)
    found = written(warc.read(spark, folder), "warc-test-records")
    assert found.count() == 3 * len(pages) and found.select("record_id").distinct().count() == 3 * len(pages)
    nested = written(warc.assemble(found), "warc-test-captures")
    assert nested.count() == len(pages) and nested.filter("n_requests = 1 and n_metadata = 1").count() == len(pages)
    payloads = {bytes(r["main"]["payload"]).decode() for r in nested.collect() if r["main"]["record_type"] == "response"}
    assert payloads == {tricky, "", "é日本" * 9000, "x" * 200_000, "same"}
    got = sorted((tuple(r) for r in warc.captures(nested, df.schema["page_id"].dataType).collect()), key=str)
    want = []
    for i, _, html, _ in pages:
        first = min((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None))
        want.append([i, len((html or "").encode()), b32(html), "response" if i == first else "revisit", None if i == first else first])
    want[6][3:] = ["revisit", 7]  # of repeated rows one is the response
    assert got == sorted(map(tuple, want), key=str)
    empty = shared_folder(spark, "warc-empty")
    warc.write(df.filter("false"), empty)
    assert os.path.isdir(empty.removeprefix("file://"))


def test_warc_links_in_either_direction(spark):
    rows = [("<r>", "response", [], None), ("<q>", "request", ["<r>"], None), ("<s>", "response", ["<p>"], None), ("<p>", "request", [], None), ("<m>", "metadata", ["<p>"], {"a": "1"}), ("<lost>", "metadata", ["<none>"], None), (None, "response", [], None)]
    df = spark.createDataFrame([(i, k, c, None, None, None, None, f) for i, k, c, f in rows], warc.RECORD)
    one = {r["capture"]: r for r in warc.assemble(df).collect()}
    two = {r["capture"]: r for r in warc.assemble(df, hops=2).collect()}
    assert set(one) == {"<r>", "<s>"} and one["<r>"]["request"]["record_id"] == "<q>" and one["<s>"]["request"]["record_id"] == "<p>"
    assert one["<s>"]["metadata"] is None and two["<s>"]["metadata"]["fields"] == {"a": "1"}


def test_warc_archives():
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Type: text/plain;\r\n more\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (record * 2, gzip.compress(record) + gzip.compress(record)):
        got = list(warc.records(data))
        assert [(r["record_id"], r["payload_bytes"], p) for r, p in got] == [("<a>", 3, b"abc")] * 2
    for bad in (record[:-6], b"no\r\n"):
        with pytest.raises(ValueError):
            list(warc.records(bad))


# The pipeline.


def test_pipeline(spark):
    """Each stage on its own input, against what it should keep."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = written(stage(spark, docs, sf), name)
        seen[name] = ({r["doc_id"]: r.asDict() for r in before.collect()}, {r["doc_id"]: r.asDict() for r in docs.collect()})
        assert name == "byte_bpe" or docs.columns == before.columns
    a, b = seen["quality_classifier"]
    judged = [i for i in labels if i in a]
    assert sum((i in b) == bool(labels[i]) for i in judged) / len(judged) > 0.95
    a, b = seen["near_dedup"]
    fps = {i: plain_fingerprint(r["text"]) for i, r in a.items()}
    for g in plain_components(list(set(fps.values()))).values():
        assert sum(fps[i] in g for i in b) <= 1
    near = plain_similarities({i: r["text"] for i, r in a.items()})
    assert sum(i in b and j in b for (i, j), s in near.items() if s >= 0.8) <= 0.1 * sum(s >= 0.8 for s in near.values())
    related = roots_of([*((i, j) for (i, j), s in near.items() if s >= 0.65), *((i, i) for i in a)])
    left = {related[i] for i in b}
    assert all(related[i] in left for i in a)  # what went had a similar one that stayed
    a, b = seen["decontamination"]
    flat = lambda t: f" {' '.join(decontaminate.words(t))} "
    items = [flat(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaked = {i for i, r in a.items() if any(x in flat(r["text"]) for x in items)}
    assert leaked and not leaked & set(b) and len(set(a) - set(b) - leaked) <= 2
    a, b = seen["secret_scans"]
    assert set(a) == set(b) and all(not secret_scan.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in b.values())
    assert all(r["text"] == a[i]["text"] for i, r in b.items() if not secret_scan.base_spans(a[i]["text"]))
    a, b = seen["byte_bpe"]
    assert set(a) == set(b) and all(r["decoded_sha256"] == hashlib.sha256(a[i]["text"].encode()).hexdigest() for i, r in b.items())


def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_dedup", "decontamination", "secret_scans", "byte_bpe"]
    assert 0 < corpus_pipeline.run(spark, SMALL).count() < 200


def test_guard():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def grouped(spark, texts):
    rows = written(similar.sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "similar-test")
    return {x["id"]: x["root"] for x in rows.select("id", "node").join(similar.groups(rows), "node").collect()}


def fresh(r, n):
    return [f"{r.getrandbits(40):x}" for _ in range(n)]


def test_similar_blocks(spark):
    """Copies that differ by whole blocks of new, removed or moved words meet."""
    r = random.Random(11)
    texts = {}
    for k in range(60):
        words = fresh(r, r.choice([60, 200, 600]))
        n = len(words)
        block = fresh(r, n // 5 - 1)
        at = r.randrange(n)
        copy = [[*words, *block], [*words[:at], *block, *words[at:]], words[: n - n // 6], [*words[n // 2 :], *words[: n // 2]]][k % 4]
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join(copy)
    root, near = grouped(spark, texts), plain_similarities(texts)
    wanted = [p for p, s in near.items() if s >= 0.8]
    assert len(wanted) >= 50 and all(root[i] == root[j] for i, j in wanted)
    left = {x["doc_id"] for x in similar.deduplicated(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert left == {i for i in texts if i % 2 == 0 or root[i - 1] != root[i]}


def test_similar_large_buckets(spark):
    """Copies meet among many texts of one vocabulary, and among many that share most of their shingles."""
    r = random.Random(12)
    words, passage, texts = fresh(r, 200), fresh(r, 100), {}
    for k in range(40):
        order = r.sample(words, 200)
        texts[2 * k], texts[2 * k + 1] = " ".join(order), " ".join([*order[150:], *order[:150]])
    for k in range(40, 80):
        own = fresh(r, 14)
        texts[2 * k], texts[2 * k + 1] = " ".join([*passage, *own]), " ".join([*passage, *own[:12], *fresh(r, 2)])
    root, near = grouped(spark, texts), plain_similarities(texts)
    want = roots_of([*(p for p, s in near.items() if s >= 0.8), *((i, i) for i in texts)])
    assert len(set(want.values())) == 80 and all(root[2 * k] == root[2 * k + 1] for k in range(80))
    nodes = written(similar.sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "similar-test")
    ids = {x["node"]: x["id"] for x in nodes.collect()}
    none = spark.createDataFrame([], "a long, b long")
    _, made = similar.similar_roots(nodes, nodes, 0.8, lambda n: nodes.select("node", "shingles").dropDuplicates(["node"]), none)
    edges = [tuple(sorted((ids[x["a"]], ids[x["b"]]))) for table in made for x in table.collect()]
    assert edges and all(near[e] >= 0.8 for e in edges)  # fingerprints of 64 bits link some more in groups()


def test_similar_is_exact(spark):
    """Texts are linked at a similarity of 0.8 or more and never below."""
    r = random.Random(13)
    texts = {}
    for k in range(120):
        words = fresh(r, 304)
        texts[2 * k], texts[2 * k + 1] = " ".join(words), " ".join([*words, *fresh(r, r.choice([60, 74, 75, 76, 77, 90, 110]))])
    near = plain_similarities(texts)
    root = grouped(spark, texts)
    assert {s >= 0.8 for s in near.values()} == {True, False} and 0.8 in near.values()
    assert all((root[i] == root[j]) == (s >= 0.8) for (i, j), s in near.items())


def test_parity_sketches(spark):
    """Sketches of sets of like sizes differ in no more bits than the sets in members, folded or not, in both forms."""
    r = np.random.default_rng(7)
    sets = []
    for n in (0, 1, 60, 64, 65, 120, 130, 500, 520, 1000, 1100):
        base = r.integers(-(1 << 62), 1 << 62, n)
        sets += [np.unique(base), np.unique(np.concatenate([base[n // 8 :], r.integers(-(1 << 62), 1 << 62, n // 6)]))]
    lanes, bits = similar._matrices(pa.array([similar.parities(s).tolist() for s in sets], pa.list_(pa.int64())))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if max(lanes[i], lanes[j]) <= 2 * min(lanes[i], lanes[j])]
    rows = [(i, j, similar.parities(sets[i]).tolist(), similar.parities(sets[j]).tolist()) for i, j in pairs]
    df = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>")
    jvm = {(x["i"], x["j"]): x["d"] for x in df.select("i", "j", similar._differing(F.col("a"), F.col("b")).alias("d")).collect()}
    tight = 0
    for i, j in pairs:
        place, matrix = bits[int(min(lanes[i], lanes[j]))]
        d = int(np.bitwise_count(matrix[place[i]] ^ matrix[place[j]]).sum())
        apart = len(set(sets[i].tolist()) ^ set(sets[j].tolist()))
        assert d == jvm[i, j] <= apart
        tight += d > apart / 3
    assert tight > len(pairs) / 2


def test_shingle_hashes():
    """Equal runs of five words have equal hashes, others don't."""
    r = random.Random(3)
    words = [f"w{r.randrange(4)}".encode() for _ in range(3000)]
    runs = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    assert len(similar.shingles(words)) == len(runs) and not len(similar.shingles([]))
    assert len({int(similar.shingles(words[:n])[0]) for n in (1, 2, 3, 4)}) == 4
    assert set(similar.shingles(words[7:12]).tolist()) <= set(similar.shingles(words).tolist())


@pytest.mark.parametrize("extra", ["_h", "_stay", "node"])
def test_one_row_of_a_group_with_repeated_ids(spark, extra):
    """Ids 1, 1, 2; texts of one id, of one id and text, and of one fingerprint but different shingles."""
    base = " ".join(f"a{i}" for i in range(300))
    rows = [(1, base, 0), (1, base + " b", 1), (2, base, 2), (3, "x y z", 3), (3, "x y z", 4), (None, "q r s", 5), (None, "q r s", 6), (3, "other words here", 7)]
    kept = similar.deduplicated(spark.createDataFrame(rows, f"doc_id long, text string, {extra} int"))
    got = kept.select("doc_id", "text").collect()
    assert kept.columns == ["doc_id", "text", extra]
    assert sorted(((r[0], r[1] if r[0] != 1 else "") for r in got), key=str) == sorted([(1, ""), (3, "x y z"), (None, "q r s"), (3, "other words here")], key=str)


def test_hot_buckets_are_dealt(spark, monkeypatch):
    """With cells of few texts every bucket of the largest groups is hot; the groups stay those of all pairs."""
    monkeypatch.setattr(similar, "CELL", 12)
    monkeypatch.setattr(similar, "SHARE", 1e-9)
    r = random.Random(21)
    texts, bank = {}, fresh(r, 400)
    for k in range(4):  # a large group of near copies, and three that share much with it
        words = [*bank[: 40 * k], *fresh(r, 240 - 40 * k)]
        for _ in range(90 if k == 0 else 25):
            copy = list(words)
            for at in r.sample(range(240), r.randrange(5)):
                copy[at] = fresh(r, 1)[0]
            texts[len(texts)] = " ".join(copy)
    rows = written(similar.sketches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "similar-test")
    assert max(similar.hot_keys(rows).values()) > 3
    nodes = {x["id"]: x["node"] for x in rows.collect()}
    sets = lambda n: rows.select("node", "shingles").join(n.select("node"), "node", "left_semi").dropDuplicates(["node"])
    distinct = rows.select("node", "h", "n", "bits").dropDuplicates(["node"])
    roots, _ = similar.similar_roots(rows, distinct, 0.8, sets, spark.createDataFrame([], "a long, b long"))
    got = {n: n for n in nodes.values()} | {x["node"]: x["root"] for x in roots.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    want = roots_of([*((i, j) for i, j in itertools.combinations(texts, 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])), *((i, i) for i in texts)])
    assert all((got[nodes[i]] == got[nodes[j]]) == (want[i] == want[j]) for i, j in itertools.combinations(texts, 2)) and len(set(want.values())) == 4


def test_components_of_a_hub(spark, monkeypatch):
    from terrasift.llm import common

    monkeypatch.setattr(common, "HUBS", 10)  # a star's centre is a hub
    pairs = [(0, i) for i in range(1, 300)] + [(i, i + 1000) for i in range(1, 300, 7)] + [(5000, 5001)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == roots_of(pairs)
