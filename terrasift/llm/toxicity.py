"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols: insults by their weight, threats, targets, negation, reported speech and quotation. Five transducers
are composed to one machine: a threat that has a target becomes an insult; negation and reported speech lower the insults in
their scopes; a target near an insult raises it; the last adds up what is left. A clause scores the weight of its best path,
a document by a logistic model of its matched clauses. Insults of any language are learned: word beginnings that training
rows marked toxic hold far more often than chance allows, and how much each word that begins so tells by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, strings, train_row, written
from .learning import sample
from .transducer import LOST, Reader, Step, Transducer

#: Labelled rows that lexicon and weights are learned from at most (hash order of their ids); all else that is learned is
#: bounded by them.
TRAIN_ROWS = 12_000
TOXIC = 0.3
#: Characters of the word beginnings that may be learned.
SHORTEST, LONGEST = 3, 8
#: Texts that a beginning's share counts as, in the share of a word that begins so; natural logarithms that weigh 1; the
#: least that a fixed insult weighs.
BACKING, UNIT, FIXED = 3.0, 4.0, 1.5
# The grammar's words.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash pathetic worthless disgusting clown clowns imbecile cretin vermin scumbag filth bastard bitch asshole retard whore".split()
THREATS = "kill hurt destroy punish beat attack shoot stab hang burn murder strangle crush hunt".split()
TARGETS = "you your yours yourself u ya he she they them their him her his people those these everyone".split()
NEGATIONS = "not never no nor isn aren wasn weren don doesn didn won cannot neither without hardly nicht kein keine nie pas jamais nunca jamás ni".split()
REPORTS = "said says say called calls wrote writes quoted quotes alleged claimed claims reported reportedly according allegedly told sagte schrieb dit écrit dijo escribió".split()
#: Symbols; from INSULT on those of insults, each weighs RATIO times the one before. The lightest weighs LIGHTEST.
NONE, TARGET, NEGATION, REPORT, QUOTE, THREAT, INSULT = range(7)
LIGHTEST, RATIO, LEVELS = 0.1, 1.25, 18
#: Weights in the machine are whole numbers of this part.
PART = 1e-6
SYMBOLS = range(INSULT + LEVELS)
#: How many words a scope or a target reaches; levels by which negation and reported speech lower an insult and a target
#: raises it; the level of an aimed threat.
REACH, NEGATED, REPORTED, TARGETED, AIMED = 4, 2, 2, 2, 9
PARTS = re.compile(r"\w+|[.!?;:\n\"“”„«»]+")
QUOTES = frozenset("\"“”„«»")
#: Words that a worker remembers the symbol of.
MEMORY = 400_000


def level(weight: float) -> int:
    """The insult's symbol of a weight; NONE below the lightest."""
    k = round(math.log(weight / LIGHTEST, RATIO)) if weight > 0 else -1
    return INSULT + min(k, LEVELS - 1) if k >= 0 else NONE


def shifted(symbol: int, by: int) -> int:
    """An insult's symbol, by levels higher; others as they are."""
    return min(max(symbol + by, INSULT), INSULT + LEVELS - 1) if symbol >= INSULT else symbol


def threats() -> Transducer:
    """Threats become insults if the clause has a target, before or after, and nothing if not.

    States: a target was seen; one is owed, for a threat that was taken to have one.
    """

    def steps(state: str, x: int) -> Iterable[Step]:
        if x == TARGET:
            yield x, 0, "seen"
        elif x != THREAT:
            yield x, 0, state
        else:
            yield INSULT + AIMED, 0, "owed" if state == "none" else state
            if state == "none":
                yield NONE, 0, "without"  # no target may follow

    def guarded(state: str, x: int) -> Iterable[Step]:
        if state != "without":
            yield from steps(state, x)
        elif x != TARGET:
            yield NONE if x == THREAT else x, 0, state

    return Transducer.of("none", SYMBOLS, guarded, lambda s: LOST if s == "owed" else 0)


def negations() -> Transducer:
    """Insults up to REACH words after a negation are lower. States: words that the scope still reaches."""
    return Transducer.of(0, SYMBOLS, lambda left, x: [(x, 0, REACH) if x == NEGATION else (shifted(x, -NEGATED) if left else x, 0, max(0, left - 1))], lambda s: 0)


def reports() -> Transducer:
    """Insults after a word of reported speech, or within a quotation, are lower to the end of the clause."""
    return Transducer.of(False, SYMBOLS, lambda on, x: [(shifted(x, -REPORTED) if on else x, 0, on or x in (REPORT, QUOTE))], lambda s: 0)


def targets() -> Transducer:
    """Insults with a target within REACH words, before or after, are higher.

    States: words that the last target still reaches, and words within which one is owed, for an insult that was taken to
    have one.
    """

    def steps(state: tuple[int, int], x: int) -> Iterable[Step]:
        reach, owed = state
        if x == TARGET:
            yield x, 0, (REACH, 0)
            return
        if owed == 1:
            return
        after = max(0, reach - 1), max(0, owed - 1)
        if x < INSULT or reach:
            yield shifted(x, TARGETED if reach else 0), 0, after
            return
        yield x, 0, after
        yield shifted(x, TARGETED), 0, (0, owed - 1 if owed else REACH)

    return Transducer.of((0, 0), SYMBOLS, steps, lambda s: LOST if s[1] else 0)


def sums() -> Transducer:
    """Adds up the weights of insults."""
    return Transducer.of(0, SYMBOLS, lambda s, x: [(x, round(LIGHTEST * RATIO ** (x - INSULT) / PART) if x >= INSULT else 0, 0)], lambda s: 0)


@lru_cache(1)
def machine() -> Transducer:
    """All five, composed."""
    return threats().then(negations()).then(reports()).then(targets()).then(sums())


@dataclass
class Grammar:
    """Word classes, and the machine that reads clauses of them."""

    #: Weights of learned beginnings, and of words that begin so.
    stems: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.fixed: dict[str, int] = {}
        for words, symbol in ((REPORTS, REPORT), (NEGATIONS, NEGATION), (TARGETS, TARGET), (THREATS, THREAT), (INSULTS, level(FIXED))):
            self.fixed |= dict.fromkeys(words, symbol)
        self.memory: dict[str, int] = {}
        self.reader = Reader(machine())

    def classify(self, word: str) -> int:
        """The symbol of a lower-case word: by its own weight, or else that of the heaviest of its beginnings."""
        got = self.memory.get(word)
        if got is None:
            got = self.fixed.get(word, NONE)
            if got in (NONE, THREAT) or got >= INSULT:
                w = self.words.get(word)
                if w is None:
                    w = max((self.stems.get(x, 0.0) for x in starts(word)), default=0.0)
                learned = level(w)
                if learned > max(got, THREAT):
                    got = learned
            if len(self.memory) > MEMORY:
                self.memory.clear()
            self.memory[word] = got
        return got

    def figures(self, text: str) -> list[float]:
        """Of a text's clauses: the best score, the sum of scores, matched clauses, the sum of scores a hundred words (all
        three compressed), whether any matched; and the text's words (compressed)."""
        scores: list[float] = []
        n = 0
        clause: list[int] = []
        hot = quoted = False
        memory, classify = self.memory, self.classify
        for part in [*PARTS.findall(text.lower()), "."]:
            if part[0].isalnum() or part[0] == "_":
                n += 1
                symbol = memory.get(part)
                if symbol is None:
                    symbol = classify(part)
                clause.append(symbol)
                hot = hot or symbol >= THREAT
                continue
            if hot:
                score = PART * self.reader.best([QUOTE, *clause] if quoted else clause)
                if score > 0:
                    scores.append(score)
            clause, hot = [], False
            if part[0] in QUOTES or part[-1] in QUOTES:
                quoted = not quoted
            elif "\n" in part:
                quoted = False
        total = sum(scores)
        density = math.log1p(100 * total / max(1, n))
        return [min(3.0, max(scores, default=0.0)), math.log1p(total), math.log1p(len(scores)), density, float(bool(scores)), math.log1p(n) / 10]


#: Weights of the figures, then the bias, before anything is learned; learning is drawn towards them.
PRIOR = (1.0, 0.5, 0.2, 0.5, 1.0, -1.0, -3.5)


@dataclass
class Model:
    stems: dict[str, float]
    words: dict[str, float]
    weights: tuple[float, ...] = PRIOR

    def score(self, figures: list[float]) -> float:
        m = self.weights[-1] + sum(w * x for w, x in zip(self.weights, figures))  # noqa: B905  the bias is extra
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))


def starts(word: str) -> list[str]:
    """A word's beginnings of SHORTEST to LONGEST characters."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] if word[0].isalpha() else []


def words_of(text: str) -> set[str]:
    return {w for w in PARTS.findall(text.lower()) if w[0].isalnum() or w[0] == "_"}


def counted(few: DataFrame, of) -> DataFrame:
    """Rows (entry, yes, no): toxic and other texts of few that hold each of what of() makes of a text; summed first in
    the tasks, then between them."""
    schema = T.StructType([T.StructField("entry", T.StringType()), T.StructField("yes", T.LongType()), T.StructField("no", T.LongType())])

    def start():
        def f(batch: pa.RecordBatch) -> list:
            yes, no = Counter(), Counter()
            for text, label in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                (yes if label == 1 else no).update(of(text))
            entries = sorted(yes.keys() | no.keys())
            return [entries, [yes[e] for e in entries], [no[e] for e in entries]]

        return f

    return map_rows(few, schema, start, 1024).groupBy("entry").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))


def lexicon(few: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of insulting beginnings, and of the words of few that begin so.

    A weight is the logarithm of how much likelier a toxic text holds the entry, in units of UNIT; a word's is drawn
    towards its beginning's. Counts are made on the executors; entries of several toxic texts come back.
    """
    few = few.dropDuplicates(["text", "label"])
    sizes = {r["label"]: r["count"] for r in few.groupBy("label").count().collect()}
    toxic, others = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not others:
        return {}, {}
    counts = written(counted(few, lambda text: {s for w in words_of(text) for s in starts(w)}), "toxic-beginnings")
    share = F.col("yes") / (F.col("yes") + F.col("no"))
    likely = counts.filter((F.col("yes") >= 2) & (share > 2 * toxic / (toxic + others)))
    entries = [(r["entry"], r["yes"], r["no"]) for r in likely.orderBy("entry").collect()]
    number = {e: k for k, (e, _, _) in enumerate(entries)}
    fixed = frozenset(INSULTS)

    def held():
        def f(batch: pa.RecordBatch) -> list:
            made = [words_of(t) for t in strings(batch.column(0))]
            return [[sorted({number[s] for w in words for s in starts(w) if s in number}) for words in made], [bool(words & fixed) for words in made]]

        return f

    schema = T.StructType([T.StructField("of", T.ArrayType(T.IntegerType())), T.StructField("explained", T.BooleanType())])
    texts = [(list(r["of"]), r["explained"]) for r in map_rows(few.filter("label = 1").select("text"), schema, held).collect()]
    least = math.log(max(2, counts.count())) - 1  # so of all beginnings chance makes two or three
    chosen = choose(entries, [x for x, explained in texts if not explained], others, least)
    for k in choose(entries, [x for x, _ in texts], others, least, pure=True, without=chosen):
        chosen.append(k)
    if not chosen:
        return {}, {}
    ratio = {entries[k][0]: math.log((entries[k][1] + 0.5) / (toxic + 1)) - math.log((entries[k][2] + 0.5) / (others + 1)) for k in chosen}
    roots = frozenset(ratio)
    seen = counted(few, lambda text: {w for w in words_of(text) if any(s in roots for s in starts(w))})

    def weight(word: str, yes: int, no: int) -> float:
        root = math.exp(max(ratio[s] for s in starts(word) if s in ratio) / 2)
        return max(0.0, math.log((yes / toxic * others + BACKING * root) / (no + BACKING / root)) / UNIT)

    words = {r["entry"]: weight(*r) for r in seen.collect()}
    return {s: max(0.0, x / UNIT) for s, x in ratio.items()}, words


def choose(entries: list[tuple[str, int, int]], toxic: list[list[int]], others: int, least: float, pure: bool = False, without: list[int] | None = None) -> list[int]:
    """Entries that explain toxic texts (lists of entries), one by one: that of the largest surprise, of equal ones the
    longest. A text counts until an entry of it is chosen, so copies add no entries beside the one that explains them.

    An entry's surprise is minus the logarithm of the chance that so many of its texts are toxic. entries: each with its
    numbers of toxic and other texts. pure: only entries with few other texts. without: neither these nor their kin.
    """
    kin = [entries[k][0] for k in without or []]
    out = {k for k, (e, yes, no) in enumerate(entries) if pure and no > 0.1 * yes or any(e.startswith(x) or x.startswith(e) for x in kin)}
    left = [s for x in toxic if (s := set(x) - out)]
    count = Counter(k for x in left for k in x)
    chosen: list[int] = []
    while count:
        rate = len(left) / (len(left) + others)

        def surprise(k: int, rate: float = rate) -> float:
            yes, no = count[k], entries[k][2]
            q = yes / (yes + no)
            return yes * math.log(q / rate) + (no * math.log((1 - q) / (1 - rate)) if no else 0.0) if q > rate else 0.0

        best = max(count, key=lambda k: (round(surprise(k), 6), len(entries[k][0]), entries[k][0]))
        if surprise(best) < least:
            break
        chosen.append(best)
        for x in left:
            if best in x:
                count.subtract(x)
        left = [x for x in left if best not in x]
        count = +count
    return chosen


def weigh(rows: list[tuple[list[float], int]], rounds: int = 1500, pull: float = 2e-3) -> tuple[float, ...]:
    """Logistic weights of the figures by gradient descent, drawn towards PRIOR."""
    prior = np.array(PRIOR)
    if not rows:
        return PRIOR
    x = np.array([[*f, 1.0] for f, _ in rows])
    y = np.array([label for _, label in rows], np.float64)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (p - y) / len(y) + pull * (w - prior))
    return tuple(map(float, w))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Lexicon and weights from labels.toxic of training rows; without any, the fixed words and weights."""
    few = sample(df, labels, "toxic", rows, id_col, text_col)
    stems, words = lexicon(few)
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])

    def start():
        grammar = Grammar(stems, words)
        return lambda batch: [[grammar.figures(t) for t in strings(batch.column(0))], batch.column(1)]

    got = sorted((list(r["x"]), r["label"]) for r in map_rows(few, schema, start).collect())
    return Model(stems, words, weigh(got))


def scored(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, held_out, score, predicted, n_clauses). Null and empty texts have no clause, so the least score.

    Every row of df gives one row; other columns are ignored. A null id is not held out.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("n_clauses", T.LongType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # words of TRAIN_ROWS texts

    def start():
        m = shared.value
        grammar = Grammar(m.stems, m.words)

        def f(batch: pa.RecordBatch) -> list:
            figures = [grammar.figures(t) for t in strings(batch.column(2))]
            return [batch.column(0), batch.column(1), [m.score(x) for x in figures], [round(math.expm1(x[2])) for x in figures]]

        return f

    held = F.coalesce(~train_row(F.col(id_col)), F.lit(False)).alias("held_out")
    found = map_rows(df.select(id_col, held, text_col), schema, start)
    return found.select(id_col, "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "n_clauses")
