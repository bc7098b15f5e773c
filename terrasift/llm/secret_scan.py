"""Secrets: fixed patterns, and long tokens that a Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_rows, strings

# The kinds in their order, the patterns and their least lengths.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 12, 18, 16, 16
#: A run of at least the least length is the run that the unbounded pattern finds: shorter ones would be dropped.
ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}")
HEX = re.compile(rf"[0-9a-f]{{{HEX_LEAST},}}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Where names and values within a run meet.
EDGE = re.compile("[=/_-]")
#: Characters that the chains know; all others share one state.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# Words that ordinary identifiers are made of.
PARTS = """account action active address array async auth base batch block buffer build byte cache call cancel channel
check child class clean client close code collection column command commit config connect content context control
convert copy count create current data date debug default delete device document element enable encode entry error
event example execute export factory field file filter find flag format function group handler hash header height
home image import index info init input instance interface internal item iterator key label language length level
library line list load local location lock manager mapping match memory message method model module name network
node number object offset open option order output package page parameter parent parse path pattern pointer position
process project property provider query queue read record reference register remove render replace report request
resource response result return root rule schema scope search section select sequence server service session setting
size source stack start state static status storage stream string style submit switch system table target task
template test thread time timeout tree type update upload user utility value vector version view widget window
work write""".split()
# Syllables and endings that words of English, German, French and Spanish are made of.
SYLLABLES = """al an ar ation be ber ble ca ce ch chen cher cion co com con cy da de del der des di dis do dor ed ein el en ent er
ere es est et eur eux ez fa fi for ful ga ge ger gh ght gra ha he heit her hin ho ia ie ier ig il in ing ion is ist it ity ja
ka keit ki ko la le lich ling lle lo ly ma man me men ment mi mo mp na nd ne ness ng ni no nt nte o oi on or os ou oux pa pf
ph po pre pro qu que ra re ri ro rr sa sch schaft se sh si so sp ss st sta ste str su ta te tel ter th the ti tion to tra tre
tung tz ue un ung ur va ver vi vo von wa we wh wi wo ya z za zen zu""".split()


def _identifier(r: random.Random) -> str:
    words = r.choices(PARTS, k=r.randint(2, 6))
    caps = [w.capitalize() for w in words]
    number = str(r.randint(0, 2030))
    long = "".join(r.choices(SYLLABLES, k=r.randint(5, 14)))
    date = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    return r.choice(
        [
            "_".join(words),
            "-".join(words),
            words[0] + "".join(caps[1:]),
            "_".join(words).upper(),
            "/".join(words),
            "".join(caps) + number,
            "_".join(words) + "_" + number,
            r.choice([long, long.capitalize(), long.upper()]),
            "/".join([*words, "-".join(words[:2]) + "-" + "-".join(str(r.randint(0, 30)) for _ in range(3))]),
            words[0].upper()[:4] + "".join(caps) + r.choice(["ID", "URL", "API", "HTTP", "UTF-8", "SHA256", "V2"]),
            f"{date}/{'-'.join(words)}",
            f"{words[0]}={words[1]}/{long}",
            r.choice("-=_/+") * r.randint(16, 60),
            r.choice("-=_/+") * r.randint(3, 20) + "_".join(words) + r.choice("-=_/+") * r.randint(3, 20),
            f"{date}-{r.randint(0, 23):02d}-{r.randint(0, 59):02d}-{r.randint(0, 59):02d}",
            "-".join("".join(r.choices(SYLLABLES, k=r.randint(2, 5))) for _ in range(r.randint(2, 4))),
        ]
    )


def labelled_samples(n: int = 8000, seed: int = 7) -> list[tuple[str, bool]]:
    """n random strings (True) and n ordinary identifiers (False), from a seeded generator.

    Random ones: hexadecimal, base 32, base 62 and base 64, letters of one and of both cases, of 16 to 64 characters.
    Identifiers: words in snake, kebab, camel and constant case, with numbers, dates, versions and acronyms, paths, names
    with values, long words of syllables of four languages, and rules drawn with one character.
    """
    r = random.Random(seed)
    alphabets = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:52], ALPHABET[:26], ALPHABET[26:52]]
    out = [("".join(r.choices(r.choice(alphabets), k=r.randint(16, 64))), True) for _ in range(n)]
    return out + [(_identifier(r), False) for _ in range(n)]


class Chains:
    """Two first-order character chains; a text's score is its log-likelihood ratio, random strings over identifiers.

    A text is random if the ratio exceeds prior, what all but one in a thousand of the identifiers stay below; a stretch of
    a longer run if it exceeds least_sum, the same for the best stretches of two joined identifiers. Longer texts give
    more evidence, whichever characters they have.
    """

    def __init__(self, samples: list[tuple[str, bool]], smoothing: float = 0.5):
        self.state = np.full(256, len(ALPHABET) + 1, np.int64)
        self.state[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(1, len(ALPHABET) + 1)
        size = len(ALPHABET) + 2
        seen = np.full((2, size, size), smoothing)
        for text, is_random in samples:
            s = self._states(text)
            np.add.at(seen[int(is_random)], (s[:-1], s[1:]), 1)
        chains = np.log(seen / seen.sum(axis=2, keepdims=True))
        self.ratio = chains[1] - chains[0]
        names = [t for t, y in samples if not y]
        pairs = [f"{a}{'=/-_'[k % 4]}{b}" for k, (a, b) in enumerate(zip(names, names[1:], strict=False))]
        rare = lambda x: max(0.0, float(np.quantile(x, 0.999))) if x else 0.0
        self.prior = rare([self.score(t) for t in names])
        self.least_sum = rare([self.best(t)[2] for t in pairs])

    def _states(self, text: str) -> np.ndarray:
        return np.append(0, self.state[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)])

    def score(self, text: str) -> float:
        s = self._states(text)
        return float(self.ratio[s[:-1], s[1:]].sum())

    def is_random(self, text: str) -> bool:
        return self.score(text) > self.prior

    def best(self, text: str) -> tuple[int, int, float]:
        """Start, end and sum of the stretch with the largest sum of ratios."""
        s = self._states(text)
        total = np.append(0.0, np.cumsum(self.ratio[s[:-1], s[1:]]))
        rise = total - np.minimum.accumulate(total)
        end = int(np.argmax(rise))
        return int(np.argmin(total[: end + 1])), end, float(rise[end])


_chains: list[Chains] = []


def chains() -> Chains:
    """The chains of the built-in samples, trained once a worker (deterministic)."""
    if not _chains:
        _chains.append(Chains(labelled_samples()))
    return _chains[0]


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if hexes:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _stretches(s: str, model: Chains) -> Iterator[tuple[int, int]]:
    """Spans within a run that model takes for random: all of it, or stretches between names, up to the next edges if that is random too."""
    if len(s) < TOKEN_LEAST:
        return
    a, b, total = model.best(s)
    if total <= model.least_sum:
        if model.is_random(s):
            yield 0, len(s)
        return
    edge = EDGE.search(s, b)
    wide = max((m.end() for m in EDGE.finditer(s, 0, a)), default=0), edge.start() if edge else len(s)
    if model.is_random(s):
        wide = 0, len(s)
    if model.is_random(s[slice(*wide)]):
        a, b = wide
    yield from _stretches(s[:a], model)
    if b - a >= TOKEN_LEAST:
        yield a, b
    for x, y in _stretches(s[b:], model):
        yield b + x, b + y


def markov_spans(text: str, taken: list[tuple[int, int, int]], model: Chains) -> list[tuple[int, int, int]]:
    """Long tokens, or stretches of them, that model takes for random and that touch no span of taken.

    An UUID is an identifier. Both cut a run, and what lies around them counts. Characters outside ASCII end a run.
    """
    out = []
    for m in TOKEN.finditer(text):
        cuts = sorted([(max(a, m.start()), min(b, m.end())) for a, _, b in taken if a < m.end() and m.start() < b] + [x.span() for x in UUID.finditer(text, m.start(), m.end())])
        at = m.start()
        for a, b in [*cuts, (m.end(), m.end())]:
            out += [(at + x, 3, at + y) for x, y in _stretches(text[at:a], model)] if a > at else []
            at = max(at, b)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _found(column: pa.Array, model: Chains) -> tuple[list[str], list, list]:
    """Texts, base spans and all spans of a batch; a scan over the batch says which texts have long runs at all."""
    texts = strings(column)
    try:
        hexes, tokens = (pc.match_substring_regex(column, f"{chars}{{{least}}}").to_pylist() for chars, least in (("[0-9a-f]", HEX_LEAST), ("[A-Za-z0-9+/_=-]", TOKEN_LEAST)))
    except (pa.ArrowInvalid, UnicodeDecodeError):
        hexes = tokens = [True] * len(texts)
    base = [base_spans(t, bool(h)) for t, h in zip(texts, hexes, strict=True)]
    every = [sorted([*b, *markov_spans(t, b, model)]) if k else b for t, b, k in zip(texts, base, tokens, strict=True)]
    return texts, base, every


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: counts of each fixed kind, their digest, all spans, and the count of those the model added.

    Spans are in code points, end exclusive. Null and empty texts have none. Every row of df gives one row; other
    columns are ignored.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_markov", T.LongType())])

    def start():
        model = chains()

        def f(batch: pa.RecordBatch) -> list:
            _, base, every = _found(batch.column(1), model)
            counts = [[sum(k == kind for _, k, _ in s) for s in every] for kind in range(4)]
            return [batch.column(0), *counts[:3], [hashlib.sha256(joined(s).encode()).hexdigest() for s in base], [joined(s) for s in every], counts[3]]

        return f

    return map_rows(df.select(id_col, text_col), schema, start)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each stretch of touching spans replaced by the name of its first kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the secrets of text_col replaced; all other columns and the number of rows stay. Null stays null."""
    at = df.columns.index(text_col)

    def start():
        model = chains()

        def f(batch: pa.RecordBatch) -> list:
            column = batch.column(at)
            texts, _, every = _found(column, model)
            new = [None if not v else redacted(t, s) for t, s, v in zip(texts, every, column.is_valid().to_pylist(), strict=True)]
            return [new if i == at else batch.column(i) for i in range(batch.num_columns)]

        return f

    return map_rows(df, df.schema, start)
