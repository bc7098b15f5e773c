"""Operators that read one text at a time, against plain versions."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib
from html import escape

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from terrasift.llm import bpe, html_text, queries, quality, repetition, secret_scan, toxicity, transducer

PATH = P.path("byte_bpe_50k.tiktoken")
SMALL = "/root/testdata/sf0.001"
LONG = "long words, and lines\n" * 20_000 + "0123456789abcdef0123"
EDGES = [(1, "one two", 0, "x"), (2, None, 1, None), (3, "", 2, "x"), (None, "no id here", 3, "x"), (1, "one two", 0, "x"), (4, LONG, 5, "x"), (5, " \n\t ", 5, "x"), (6, "é日本🎉 \x1c\x85  ſecret", 6, None)]
EDGE_SCHEMA = "doc_id long, text string, n_words int, score string"


@pytest.fixture(scope="module")
def codec():
    with open(PATH, "rb") as f:
        return bpe.ByteCodec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA)


def same_rows(df):
    """Every row of EDGES gave one row."""
    rows = df.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r[0] for r in EDGES), key=str)
    return rows


# Byte-level BPE.


@given(st.text(max_size=80))
@settings(max_examples=300, deadline=None)
def test_bpe_as_tiktoken(codec, tik, text):
    assert codec.encode(text).tolist() == tik.encode_ordinary(text)
    assert codec.decode_bytes(codec.encode(text)) == text.encode("utf-8", "replace")


def test_bpe_every_character(codec, tik):
    text = "".join(f"a{chr(c)}b {chr(c)}1" for c in range(1, 0x2FFF))
    assert codec.encode(text).tolist() == tik.encode_ordinary(text)
    assert codec.encode("z" * 50_000).tolist() == tik.encode_ordinary("z" * 50_000)


@given(st.text(max_size=60), st.integers(1, 5))
@settings(max_examples=100, deadline=None)
def test_bpe_offsets_and_parts(codec, text, n):
    ids = codec.encode(text)
    starts, ends, split = codec.offsets(text, ids)
    assert "".join(codec.decode_stream([ids[i : i + n] for i in range(0, len(ids), n)])) == text
    for i, a, b, s in zip(ids, starts, ends, split, strict=True):
        token = codec.token_bytes[i]
        assert token in text[a:b].encode() and (s or text[a:b].encode() == token)


def test_bpe_forgets_when_full(codec, tik, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 3)
    for t in ("a b c d e", "a f g", "f f a b " + "q" * 100):
        assert codec.encode(t).tolist() == tik.encode_ordinary(t)


def test_bpe_query(spark, edges, tik):
    rows = same_rows(bpe.round_trip(edges, PATH, P.PATTERN))
    for r, (_, text, *_) in zip(rows, EDGES, strict=True):
        ids = tik.encode_ordinary(text or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert queries.QUERIES["op1_byte_bpe"](spark, SMALL).count() == 200
    back = bpe.decode(bpe.encode(edges.filter("doc_id is not null"), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert [r["text"] for r in back] == [t or "" for i, t, *_ in EDGES if i is not None]
    assert bpe.round_trip(edges.filter("false"), PATH, P.PATTERN).count() == 0


# Secrets.


def plain_spans(text):
    """The contract's patterns as they are written, then the filter."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


parts = st.sampled_from(["password", "PassWd", "ſecret", "secret", "api_key", "APIKEY", "token", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "abc", "日本", "short", "-", "\n", "K"])


@given(st.lists(parts, max_size=14).map("".join))
@settings(max_examples=500, deadline=None)
def test_secret_patterns(text):
    assert secret_scan.base_spans(text) == plain_spans(text)


def test_markov_model_on_held_out_samples():
    model = secret_scan.Chains(secret_scan.labelled_samples())
    held = secret_scan.labelled_samples(2000, seed=1234)
    assert sum(model.is_random(t) == y for t, y in held) / len(held) > 0.995
    add = "use ghp_16C7e42F292c6912E7710c838347Ae178B4a with getUserAccountSettingsByIdentifier2 at 550e8400-e29b-41d4-a716-446655440000"
    assert [add[a:b] for a, k, b in secret_scan.markov_spans(add, [], model)] == ["ghp_16C7e42F292c6912E7710c838347Ae178B4a"]
    assert secret_scan.markov_spans(add, [(0, 0, len(add))], model) == []


def test_markov_model_within_runs():
    """Secrets behind names, paths and other secrets are found; joined identifiers and UUIDs are not."""
    model, r = secret_scan.chains(), random.Random(5)
    for before in ("service/account/project/config/value=", "my_long_snake_case_variable_name_of_it=", "/usr/local/share/application/config/", "long_name-", "550e8400-e29b-41d4-a716-446655440000/"):
        found = 0
        for _ in range(300):
            value = "".join(r.choices(secret_scan.ALPHABET[:62], k=r.randint(16, 40)))
            found += any(a <= len(before) and b == len(before + value) for a, _, b in secret_scan.markov_spans(before + value, [], model))
        assert found >= 0.97 * 300
    text = "sha=0123456789abcdef0/Zk3xQ9vT7bWm2RpL8sYd"
    assert [text[a:b] for a, _, b in secret_scan.markov_spans(text, secret_scan.base_spans(text), model)] == ["/Zk3xQ9vT7bWm2RpL8sYd"]
    names = [t for t, y in secret_scan.labelled_samples(1000, seed=99) if not y]
    assert sum(bool(secret_scan.markov_spans(f"{a}/{b}={c}", [], model)) for a, b, c in zip(names, names[1:], names[2:], strict=False)) <= 5


def test_markov_scores_against_plain_sums():
    """The ratio as the sum over transitions, the best stretch as the best of all; states counted one by one."""
    samples = [("ab-ab", False), ("abab", False), ("zq9z", True), ("q9zq", True)]
    model = secret_scan.Chains(samples)
    states, size = {c: k + 1 for k, c in enumerate(secret_scan.ALPHABET)}, len(secret_scan.ALPHABET) + 2
    seen = {y: collections.Counter() for y in (False, True)}
    for text, y in samples:
        path = [0, *(states.get(c, size - 1) for c in text)]
        seen[y].update(zip(path, path[1:], strict=False))

    def chance(y, a, b):
        return (seen[y][a, b] + 0.5) / (sum(n for (x, _), n in seen[y].items() if x == a) + 0.5 * size)

    for text in ("ab", "q9zq", "ab-zq9z-ab", "x.z"):
        path = [0, *(states.get(c, size - 1) for c in text)]
        steps = [np.log(chance(True, a, b) / chance(False, a, b)) for a, b in zip(path, path[1:], strict=False)]
        assert np.isclose(model.score(text), sum(steps))
        best = max([0.0, *(sum(steps[i:j]) for i in range(len(steps)) for j in range(i + 1, len(steps) + 1))])
        a, b, total = model.best(text)
        assert np.isclose(total, best) and np.isclose(sum(steps[a:b]), best)


@pytest.mark.parametrize("before", ["", "\u00e4", "\u00df ", "\u65e5", "key:", "("])
def test_markov_model_by_ratio_alone(before):
    """Keys of letters alone, and after any character; long words and rules of one character are none."""
    model, r = secret_scan.chains(), random.Random(8)
    for chars in (secret_scan.ALPHABET[:52], secret_scan.ALPHABET[26:52], secret_scan.ALPHABET[:64]):
        keys = ["".join(r.choices(chars, k=r.randint(18, 48))) for _ in range(300)]
        assert sum(any(b - a >= 0.9 * len(k) for a, _, b in secret_scan.markov_spans(f"{before}{k} end", [], model)) for k in keys) >= 297
    for text in ("Rindfleischetikettierungs\u00fcberwachungsaufgaben\u00fcbertragungsgesetz", "-" * 70, "=" * 30 + "title" + "=" * 30, "internationalization/counterrevolutionaries", "2024-01-31-23-59-59"):
        assert not secret_scan.markov_spans(before + text, [], model)


def test_secret_query(spark, edges):
    rows = same_rows(secret_scan.scan(edges))
    for r, (_, text, *_) in zip(rows, EDGES, strict=True):
        want = plain_spans(text or "")
        assert r["n_hex"] == sum(k == 2 for _, k, _ in want) and r["base_sha256"] == hashlib.sha256(secret_scan.joined(want).encode()).hexdigest()
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_secret_scan"](spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    assert all(got[d["doc_id"]]["base_sha256"] == hashlib.sha256(secret_scan.joined(plain_spans(d["text"])).encode()).hexdigest() for d in docs)
    clean = {r["doc_id"]: r for r in secret_scan.redact(edges).collect()}
    assert clean[2]["text"] is None and clean[4]["text"].endswith("lines\n<hex>") and clean[4]["n_words"] == 5
    assert secret_scan.redacted("a token=0123456789abcdef z", [(2, 0, 24), (8, 2, 24)]) == "a <assign> z"
    assert secret_scan.scan(edges.filter("false")).count() == 0


# Quality rules.


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    hit = {j + d for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@given(st.lists(st.sampled_from(["a", "b", "cc", "é日", "#", "*|", " ", "\n", "\n\n", " ", "\x0b", "\x85", "\x1c"]), max_size=60).map(" ".join))
@settings(max_examples=300, deadline=None)
def test_repetition_measures(text):
    got = repetition.measure(text.encode())
    assert got[:5] == plain_measures(text)
    assert got[5] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (got[5] and got[6])


def test_repetition_coverage():
    r = random.Random(3)
    ids = np.array([r.randrange(6) for _ in range(300)])
    for n in (3, 5, 7):
        grams = [tuple(ids[i : i + n]) for i in range(len(ids) - n + 1)]
        count = collections.Counter(grams)
        every = {i + d for i, g in enumerate(grams) if count[g] > 1 for d in range(n)}
        h = repetition.rolling(ids, [n])[n]
        assert set(np.flatnonzero(repetition.covered(h, n, 300))) == every
    assert repetition.covered(np.array([1, 2, 3]), 3, 5) is None
    words = [f"w{i}" for i in range(60)]
    assert repetition.measure(" ".join(words).encode())[6] is True
    again = lambda k: repetition.measure(" ".join(words + words[:k]).encode())[5:7]
    assert again(29) == (True, False) and again(18) == (False, False) and again(12) == (False, True)  # a passage that comes twice
    ids = np.array([5, 1, 2, 3, 1, 2, 3, 1 << 21, 1 << 21, 1, 2])
    triples = list(zip(ids, ids[1:], ids[2:]))  # noqa: B905
    assert [[a == b for b in repetition.trigrams(ids)] for a in repetition.trigrams(ids)] == [[a == b for b in triples] for a in triples]


def test_repetition_query(spark, edges):
    rows = same_rows(repetition.rules(edges))
    for r, (_, text, *_) in zip(rows, EDGES, strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(text or "")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in queries.QUERIES["op8_repetition_rules"](spark, SMALL).collect()}
    assert all((r := got[d["doc_id"]]) and (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(d["text"]) for d in docs)


# Pages.

PARA = "A long paragraph, with commas, and text that goes on for quite a while, so that it scores well."


def test_html_templates():
    p = f"<p>{PARA}</p>"
    side = "<nav><a href=x>Menu</a></nav><header>Site</header><div class='sidebar'>" + p * 3 + "</div><div id='cookie-notice'>" + p + "</div>"
    for head, tail in (("<article>", "</article>"), ("<main>", "</main>"), ("<div class='post-content has-sidebar'>", "</div>"), ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>")):
        page = f"<html><head><title>T</title><style>p{{}}</style></head><body>{side}{head}<h1>Head &amp; line</h1>{p}<p>b<b>o</b>ld\n  x</p><script>var a='<p>no</p>'</script><form><p>no</p></form>{tail}<div class='comments'>{p * 4}</div><footer>no</footer></body></html>"
        assert html_text.extract(page) == f"Head & line {PARA} bold x", head


@pytest.mark.parametrize("name", ["sidebar", "topAd", "ads", "cookie_notice", "comment-list", "commentsArea", "main-nav", "site-footer", "newsletterSignup", "promo2", "ad 3", "side"])
def test_html_names_of_no_article(name):
    assert html_text.unlikely(name)


@pytest.mark.parametrize("name", ["content", "post has-sidebar", "entry-header", "article with-comments", "lead", "padding", "threads", "mainContent", "advice", "inside", "content no-nav", ""])
def test_html_names_of_articles(name):
    assert not html_text.unlikely(name)


def test_html_broken():
    assert html_text.extract("") == "" and html_text.extract("<p>hi") == "hi" and html_text.extract("a < b <p>c") == "a < b c"
    assert html_text.extract("<article><p><b>one<br><p>two</p></article><footer>no") == "one two"
    assert html_text.extract("<script>never closed <p>x") == "" and html_text.extract("<!-- open <p>x") == ""
    assert html_text.extract("<div>" * 30_000 + PARA) == PARA and html_text.extract("&lt;p&gt; &am &amp") == "<p> &am &"
    assert html_text.extract(f"<div class='ad'>{PARA}</div>") == ""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a</p><svg/><p>b</p>", "a b"),
        ("<p>a</p><iframe src='x'/><p>b</p>", "a b"),
        ("<p>a</p><a name='x'/><p>b", "a b"),
        ("<p>a</p><svg><title>no</title><g><svg>no</svg></g></svg><p>b</p>", "a b"),
        ("<p>a</p><svg><p>b", "a b"),
        ("<p>\u0130</p><script>no</SCRIPT><p>b</p>", "\u0130 b"),
        ("<p>a</p><script>no</\u017fcript>no</script ><p>b</p>", "a b"),
        ("<p title=don't>a</p><p>b</p>", "a b"),
        ('<p title="never closed>a</p><p>b</p>', "a b"),
        ("<p title='>' =x / data-a=b/>a</p>", "a"),
        ("<p title=\"class='ad'\">a</p>", "a"),
        ("<p>&am<b>p; c</b></p>", "&amp; c"),
        ("<!--><p>a</p><!-- no --!><p>b</p>", "a b"),
        (f"<form action=x><nav>no</nav><div>{PARA}</div></form>", PARA),
        (f"<form>no</form><div>{PARA}</div>", PARA),
        ("<div>" * 1000 + f"<nav>no</nav><div class=sidebar>no</div><p>{PARA}", PARA),
    ],
)
def test_html_keeps_texts(page, text):
    assert html_text.extract(page) == text


def test_html_points_and_links_decide(monkeypatch):
    """Neither marks nor names tell article from boilerplate: points and link density do."""
    links = "".join(f"<li><a href=/{k}>entry {k}, of a menu, with commas, and a long name that scores</a></li>" for k in range(9))
    short = "<p>Sign in now.</p><p>Your basket is empty.</p>"
    page = f"<body><div><ul>{links}</ul></div><div>{short}</div><section><div><p>{PARA}</p><p>{PARA}</p><ul>{links}</ul><p>{PARA}</p></div></section><div>{short}</div></body>"
    assert html_text.extract(page) == " ".join([PARA] * 3)
    monkeypatch.setattr(html_text, "points_of", lambda block: 0.0)
    assert html_text.extract(page) != " ".join([PARA] * 3)
    monkeypatch.undo()
    teasers = "".join(f"<article><p>teaser {k}</p></article>" for k in range(4))
    story = f"<div>{''.join(f'<p>{PARA} {k}</p>' for k in range(30))}</div>"
    assert html_text.extract(f"<div>{teasers}</div>{story}") == " ".join(f"{PARA} {k}" for k in range(30))  # a mark is no verdict
    own = html_text.points_of
    monkeypatch.setattr(html_text, "points_of", lambda block: own(block) / 100)
    assert html_text.extract(f"<div>{teasers}</div>{story}") != " ".join(f"{PARA} {k}" for k in range(30))


def plain_extract(tree):
    """The rules as they are stated, over a tree (tag, children) of texts, each said to be a link or not."""
    parents, every = {}, []

    def visit(node, parent):
        parents[id(node)] = parent
        every.append(node)
        for c in node[1]:
            if isinstance(c[1], list):
                visit(c, node)

    visit(tree, None)
    inside = lambda n: [c for c in n[1] if not isinstance(c[1], list)] + [t for c in n[1] if isinstance(c[1], list) for t in inside(c)]
    texts = lambda n: [c for c in n[1] if not isinstance(c[1], list)]
    size = lambda ts: sum(len(t) for t, _ in ts)
    density = lambda ts: size([t for t in ts if t[1]]) / max(1, size(ts))
    worth = lambda ts: 0.0 if size(ts) < 10 else (1 + sum(t.count(",") for t, _ in ts) + min(3, size(ts) / 100)) * (1 - density(ts))
    marked = lambda n: n is not None and (n[0] == "article" or marked(parents[id(n)]))
    points = dict.fromkeys(map(id, every), 0.0)
    for n in every:
        if texts(n) and n[0] != "h2":
            up = parents[id(n)] if n[0] == "p" else n
            w, near_one = worth(texts(n)), up
            while near_one is not None and near_one[0] != "article":
                near_one = parents[id(near_one)]
            while near_one is not None:  # marked articles get all
                if near_one[0] == "article":
                    points[id(near_one)] += w
                near_one = parents[id(near_one)]
            for share in (1, 1 / 2, 1 / 6, 1 / 9, 1 / 12):
                if up is None:
                    break
                if up[0] != "article":
                    points[id(up)] += share * w
                up = parents[id(up)]
    prior = {"article": 40, "section": 3, "div": 3}
    of = [n for n in every if n[0] not in ("p", "h2") and inside(n)]
    best = max(of, key=lambda n: round((prior.get(n[0], 0) + points[id(n)]) * (1 - density(inside(n))), 9), default=tree)
    keep = [best]
    score = lambda n: points[id(n)] * (1 - density(inside(n)))
    for other in parents[id(best)][1] if parents[id(best)] else []:
        if isinstance(other[1], list) and other is not best and inside(other):
            link, long = density(inside(other)), size(inside(other)) > 80
            alike = points[id(other)] > 0 and score(other) >= 0.2 * score(best)
            if alike and (other[0] == best[0] or best[0] != "article") or best[0] != "article" and (other[0] == "h2" or other[0] == "p" and (link < 0.25 if long else link == 0)):
                keep.append(other)

    def out(n, kept):
        links = sum(1 for t in inside(n) if t[1])
        kept = any(n is k for k in keep) or kept and not (n[0] in ("div", "section") and links > 1 and size([t for t in inside(n) if t[1]]) > 0.6 * size(inside(n)))
        own = [" ".join(t for t, _ in texts(n))] if kept and texts(n) else []
        return own + [x for c in n[1] if isinstance(c[1], list) for x in out(c, kept)]

    return " ".join(out(tree, False))


def test_html_scoring_against_plain_rules():
    r = random.Random(4)

    def grown(depth):
        tag = r.choice(["div", "div", "section", "article"]) if depth < 4 else "p"
        if depth >= 2 and r.random() < 0.7:
            tag = r.choice(["p", "p", "p", "h2"])
        if tag in ("p", "h2"):
            first = r.random() < 0.3  # links and other texts take turns
            return (tag, [(" ".join(r.choices(["lorem,", "ipsum", "dolor", "sit,", "amet"], k=r.randint(1, 30))), (k % 2 == 0) == first) for k in range(r.choice([1, 1, 1, 2, 3]))])
        return (tag, [grown(depth + 1) for _ in range(r.randint(1, 4))])

    def html(n):
        if not isinstance(n[1], list):
            return f"<a href=x>{n[0]}</a>" if n[1] else n[0]
        inner = (" " if n[0] in ("p", "h2") else "").join(map(html, n[1]))
        return inner if n[0] == "#root" else f"<{n[0]}>{inner}</{n[0]}>"

    different = set()
    for _ in range(400):
        tree = ("#root", [grown(0) for _ in range(r.randint(1, 4))])
        got = html_text.extract(html(tree))
        assert got == plain_extract(tree), html(tree)
        different.add(got)
    assert len(different) > 350


@given(st.text(alphabet="<>/p div\"'=&;!-a\n", max_size=80))
@settings(max_examples=300, deadline=None)
def test_html_never_raises(page):
    assert isinstance(html_text.extract(page), str)


def test_html_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.QUERIES["op3_html_extraction"](spark, "/root/testdata/sf0.01").collect()}
    from html import unescape

    for page in pages:  # these pages mark their article: its blocks are known
        inner = re.search(r"<article>(.*?)</article>", page["html"], re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", inner))
        assert got[page["page_id"]]["text"] == " ".join(filter(None, blocks))
    odd = spark.createDataFrame([(1, None, None, 1), (1, None, None, 1), (None, "u", f"<p>{escape(PARA)}</p>", 2)], "page_id long, url string, html string, n_chars int")
    assert sorted((r["n_chars"] for r in html_text.main_text(odd).collect())) == [0, 0, len(PARA)]
    assert html_text.main_text(odd.filter("false")).count() == 0
    long = f"<div><p>{PARA}</p>" * 20_000
    clash = spark.createDataFrame([(1, long, long, "x")], "page_id long, url string, html string, text string")
    assert html_text.main_text(clash).first()["text"] == " ".join([PARA] * 20_000)


# Models.


def test_machine_is_the_sum_over_pairs():
    m = quality.Machine(0.3, np.random.default_rng(1).normal(size=quality.SIZE), np.random.default_rng(2).normal(size=(quality.SIZE, quality.FACTORS)))
    i, x = np.array([3, 9, 50, 9]), np.array([0.5, 1.0, -2.0, 0.25])
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(4) for b in range(a + 1, 4))
    assert np.isclose(m.margin(i, x), 0.3 + m.weights[i] @ x + pairs)


def held_out(spark, sf, name, label):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert docs.count() >= len(rows)
    held = [r for r in rows if r["held_out"]]
    return sum(r["predicted"] == r[label] for r in held) / len(held), sum(r["predicted"] for r in held if r[label]) / sum(r[label] for r in held)


def test_quality_on_held_out_rows(spark):
    accuracy, recall = held_out(spark, "/root/testdata/sf0.01", "op9_quality_machine", "quality")
    assert accuracy > 0.93 and recall > 0.93


def test_toxicity_on_held_out_rows(spark):
    accuracy, recall = held_out(spark, "/root/testdata/sf0.1", "op4_toxicity_grammar", "toxic")
    assert accuracy > 0.97 and recall > 0.85


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_models_on_odd_tables(spark, edges, label):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 1, 1), (2, None, 1), (3, 0, 1)], "doc_id long, quality int, toxic int")
    for use in (labels, labels.filter("false")):
        df = quality.scored(edges, quality.train(edges, use)) if label == "quality" else toxicity.scored(edges, toxicity.train(edges, use))
        assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in same_rows(df))
    empty = edges.filter("false")
    assert (quality.scored(empty, None) if label == "quality" else toxicity.scored(empty, toxicity.Model({}, {}))).count() == 0
    assert quality.accepted(edges, None).count() == len(EDGES)


def random_machine(r, symbols):
    states = range(r.randint(1, 4))
    steps = {(s, x): [(r.choice(symbols), r.randint(-3, 5), r.choice(states)) for _ in range(r.randrange(3))] for s in states for x in symbols}
    ends = {s: r.choice([0, 2, transducer.LOST]) for s in states}
    return transducer.Transducer.of(0, symbols, lambda s, x: steps[s, x], lambda s: ends[s])


def test_composition_against_all_pairs():
    """What a composed machine weighs is the heaviest sum over all that the first may write and the second read."""
    r = random.Random(6)
    written = 0
    for _ in range(200):
        a, b = random_machine(r, [0, 1, 2]), random_machine(r, [0, 1, 2])
        both = a.then(b)
        for _ in range(4):
            x = [r.randrange(3) for _ in range(r.randrange(5))]
            want = {}
            for y, w in a.weights(x).items():
                for z, v in b.weights(y).items():
                    want[z] = max(want.get(z, transducer.LOST), w + v)
            assert both.weights(x) == want
            assert transducer.Reader(both, memory=3).best(x) == max(want.values(), default=transducer.LOST)
            written += len(want)
    assert written > 300


def plain_clause(x):
    """A clause's score by the rules, word by word."""
    total = 0
    for i, s in enumerate(x):
        if s == toxicity.THREAT and toxicity.TARGET in x:
            s = toxicity.INSULT + 9
        if s < toxicity.INSULT:
            continue
        levels = s - toxicity.INSULT
        step = lambda by: max(0, min(17, levels + by))  # noqa: B023, E731
        if toxicity.NEGATION in x[max(0, i - 4) : i]:
            levels = step(-2)
        if toxicity.REPORT in x[:i] or toxicity.QUOTE in x[:i]:
            levels = step(-2)
        if toxicity.TARGET in x[max(0, i - 4) : i + 5]:
            levels = step(2)
        total += round(0.1 * 1.25**levels / 1e-6)
    return total


def test_grammar_against_plain_rules():
    r = random.Random(2)
    reader = transducer.Reader(toxicity.machine())
    symbols = [toxicity.NONE] * 6 + list(range(1, 6)) * 2 + [toxicity.INSULT, toxicity.INSULT + 5, toxicity.INSULT + 11, toxicity.INSULT + 17]
    scores = set()
    for _ in range(4000):
        x = r.choices(symbols, k=r.randrange(1, 14))
        assert reader.best(x) == plain_clause(x), x
        scores.add(plain_clause(x))
    assert len(scores) > 500
    for x in (r.choices(symbols, k=6) for _ in range(40)):  # and path by path
        assert max(toxicity.machine().weights(x).values()) == plain_clause(x)
    long = [toxicity.INSULT + 3] * 50_000
    assert reader.best(long) == plain_clause(long[:1]) * 50_000


def test_grammar():
    g = toxicity.Grammar({"lowei": 1.5}, {"loweiab": 0.0})
    score = lambda t: g.figures(t)[0]
    assert score("you are an idiot") > score("an idiot") > score("not an idiot") > 0 and score("the boss said an idiot came") < score("an idiot came")
    assert score("I will kill you") > 0 and score("I will kill time") == 0 and score("a nice day") == 0
    assert score("some loweixx here") > 0 and score("some loweiab here") == 0 and g.figures("")[4] == 0.0
    assert score('"an idiot"') < score("an idiot") and score('"fine"\nan idiot') == score("an idiot")
    # roots are told from copies of one text, which explain each other
    entries = [("lowe", 4, 0), ("rare", 4, 1), ("copy", 3, 0)]
    assert toxicity.choose(entries, [[0, 2], [0, 2], [0, 2], [0], [1]], 40, 3.0) == [0]


def test_clause_context_changes_predictions(spark):
    """The same words, in other clauses: who is meant, denied or quoted decides."""
    rest = " ".join(f"w{i}" for i in range(60))
    texts = ["Here comes an idiot", "They wrote that no idiot came", "We will kill you", "We will kill time", "We will kill time. You", "not an idiot, wrote the judge"]
    df = spark.createDataFrame([(i, f"{t}. {rest}") for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(df, toxicity.Model({}, {})).collect()}
    assert [got[i] for i in range(6)] == [1, 0, 1, 0, 0, 0]
