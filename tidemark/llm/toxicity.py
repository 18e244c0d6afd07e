"""Toxicity by a weighted finite-state pattern grammar.

Small deterministic transducers are composed into one table. The lexical transducer maps words to
insult, threat, target, negation and report symbols; the context transducers annotate insults and
threats with what stands before them in the clause: a target, a negation within ``SCOPE`` words, a verb
of reported speech; the clause transducer reads those and writes, at the end of the clause, the one pattern
that the clause as a whole matches, its gravest, with a note whether a target comes after it.

Scored are clauses, not words: a clause without a pattern is worth nothing. A matched clause has the weight
of its pattern, so a negated or reported insult counts as the labels say, and the summed log-odds of its
insults and threats. A document's score is the logistic function of what its matched clauses add up to: per
pattern whether and how often it occurs, the gravest clause, the sum over clauses, the share of clauses
that match and the number of clauses.

The lexicon is learned from the labels: the log-odds of a word, or of a 4 to 6 letter stem
with an ending of up to ``ENDING`` letters, between toxic
and other training documents, added to a few fixed words of common speech. An entry is a threat if in half
of its toxic documents or more a target follows it within two words, else an insult. The weights
are fitted on the same rows in ``FOLDS`` parts, each read with a lexicon of the others, so that an entry that
occurs in a few toxic documents by chance weighs no more than it is worth. Training rows are those with crc32(doc_id) mod 4 other than 2, at
most ``MAX_LABELS`` of them (a bounded sample by id hash; its ids are broadcast, its counts are combined
in the tasks and the driver gets ``MAX_ENTRIES`` lexicon entries, the model's size, and one short row per
sampled document). All documents are scored, whole, in one pass without a shuffle.

Nulls: null and empty texts score as texts without a match; a null doc_id is held out false and never a
training row; null labels don't train. Without usable labels every pattern weighs 1. Rows that repeat an id
get equal scores for equal texts. An empty table gives no rows. Labels, language, source and id don't
enter a score; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import read_table, stage_table

MAX_LABELS = 20_000
MAX_ENTRIES = 4_000
LEAST_DOCS = 4
LEAST_ODDS = 2.0
#: Least likelihood ratio (G) of an entry, so that a few chance occurrences in toxic texts don't make one.
LEAST_G = 15.0
STEMS = (4, 5, 6)
#: Letters that an inflected word has after its stem at most.
ENDING = 4
SCOPE = 3
THRESHOLD = 0.3
#: Parts of the training rows; near copies are in one part.
FOLDS = 2
KEYS_HELD = 400_000

# Fixed word lists: the closed classes of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself he she they them him her du dich dir ihr euch sie er tu toi te vous votre il elle ils elles usted ustedes vosotros ellos ellas".split()
NEGATIONS = "not no never none nor isn aren wasn don doesn nicht kein keine keinen nie niemals pas jamais aucun aucune non nunca ningún ninguna tampoco".split()
REPORTS = "said says say wrote writes quoted quotes quote claimed called calls reported sagte sagt schrieb behauptete nannte dit disait écrit appelé dijo dice escribió llamó".split()
THREATS = "kill hurt murder stab shoot beat töten umbringen schlagen tuer frapper matar golpear".split()
INSULTS = "idiot moron stupid loser scum".split()
#: Words within which a target that follows makes a threat.
FOLLOWS = 2
ENDS = frozenset(".;:!?\n")

_TOKEN = re.compile(r"[^\W\d_]+|[.;:!?\n]")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- transducers
#
# A transducer is (start, arcs): arcs[state, symbol] = (next state, output symbol). A symbol is a tuple:
# its first field is the class, later fields are notes that transducers have added.

Transducer = tuple[tuple, dict]
CLASSES = ("insult", "threat", "target", "negation", "report", "word", "end")


def noting(inputs: list[tuple], opens: str, life: int | None) -> Transducer:
    """Notes on insults and threats whether ``opens`` came up to ``life`` words before in the clause."""
    full = life if life is not None else 1
    arcs = {}
    for state in range(full + 1):
        for symbol in inputs:
            kind = symbol[0]
            if kind == "end":
                following = 0
            elif kind == opens:
                following = full
            else:
                following = state if life is None else max(0, state - 1)
            arcs[(state,), symbol] = ((following,), (*symbol, state > 0) if kind in ("insult", "threat") else symbol)
    return (0,), arcs


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that feeds the output of ``first`` to ``second``, over the states they reach."""
    start = first[0] + second[0]
    cut = len(first[0])
    inputs = {symbol for _, symbol in first[1]}
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for symbol in inputs:
            a, middle = first[1][state[:cut], symbol]
            b, out = second[1][state[cut:], middle]
            arcs[state, symbol] = (a + b, out)
            if a + b not in seen:
                seen.add(a + b)
                todo.append(a + b)
    return start, arcs


def gravity(symbol: tuple) -> tuple:
    """Order of annotated insults and threats: neither negated nor reported first, then with a target, then threats."""
    kind, target, negated, reported = symbol[:4]
    return (not (negated or reported), target, kind == "threat", not negated, not reported)


def clauses(inputs: list[tuple]) -> Transducer:
    """At the end of a clause its gravest annotated symbol, with a note whether a target came after it."""
    marked = sorted({s for s in inputs if s[0] in ("insult", "threat")}, key=gravity)
    states = [(None, False), *[(m, t) for m in marked for t in (False, True)]]
    arcs = {}
    for held, after in states:
        for symbol in inputs:
            following, out = (held, after), ("none",)
            if symbol[0] == "end":
                following, out = (None, False), ("clause", *held, after) if held else ("none",)
            elif symbol in marked and (held is None or gravity(symbol) > gravity(held)):
                following = (symbol, False)
            elif symbol[0] == "target" and held:
                following = (held, True)
            arcs[((held, after),), symbol] = ((following,), out)
    return ((None, False),), arcs


def grammar() -> tuple[list[list[int]], list[list[int]], list[tuple]]:
    """The composed grammar as tables: next state and clause pattern by (state, class); -1: none."""
    symbols = [(c,) for c in CLASSES]
    machine = noting(symbols, "target", None)
    for opens, life in (("negation", SCOPE), ("report", None)):
        machine = compose(machine, noting(_outputs(machine), opens, life))
    machine = compose(machine, clauses(_outputs(machine)))
    start, arcs = machine
    states = list(dict.fromkeys([start, *(s for s, _ in arcs)]))
    number = {s: k for k, s in enumerate(states)}
    patterns = sorted({out for _, out in arcs.values() if out[0] == "clause"})
    step = [[number[arcs[s, c][0]] for c in symbols] for s in states]
    emit = [[patterns.index(out) if (out := arcs[s, c][1]) in patterns else -1 for c in symbols] for s in states]
    return step, emit, patterns


def _outputs(machine: Transducer) -> list[tuple]:
    return list(dict.fromkeys(out for _, out in machine[1].values()))


class Scorer:
    """The compiled grammar with its lexicon and weights; travels to the tasks."""

    def __init__(self, lexicon: dict[str, tuple[float, str]], weights: list[float] | None = None):
        """lexicon: log-odds and class (insult or threat) by word, or by stem with ^ before it."""
        self.words = {k: v for k, v in lexicon.items() if not k.startswith("^")}
        self.stems = {k[1:]: v for k, v in lexicon.items() if k.startswith("^")}
        self.step, self.emit, self.patterns = grammar()
        self.weights = weights
        self.closed = {w: 4 for w in REPORTS} | {w: 3 for w in NEGATIONS} | {w: 2 for w in TARGETS} | {e: 6 for e in ENDS}
        self.seen: dict[str, tuple[int, float]] = {}
        self.size = 2 * len(self.patterns) + 5

    def _classify(self, word: str) -> tuple[int, float]:
        """Class number and log-odds of a word."""
        if len(self.seen) > KEYS_HELD:
            self.seen.clear()
        found = [self.words[word]] if word in self.words else []
        found += [self.stems[word[:n]] for n in STEMS if n < len(word) <= n + ENDING and word[:n] in self.stems]
        if found:
            odds, kind = max(found)
            out = (CLASSES.index(kind), odds)
        else:
            out = (self.closed.get(word, 5), 0.0)
        self.seen[word] = out
        return out

    def matches(self, text: str | None) -> tuple[list[tuple[int, float]], int]:
        """(pattern, summed odds) of each matched clause, and the number of clauses."""
        seen, known = self.seen, self._classify
        read = [seen[w] if w in seen else known(w) for w in _TOKEN.findall((text or "").lower())]
        if not any(odds for _, odds in read):
            return [], 0
        out: list[tuple[int, float]] = []
        state, held, n, open_ = 0, 0.0, 0, False
        for kind, odds in [*read, (6, 0.0)]:
            if kind == 6:
                if (pattern := self.emit[state][6]) >= 0:
                    out.append((pattern, held))
                n += open_
                held, open_ = 0.0, False
            else:
                held, open_ = held + odds, True
            state = self.step[state][kind]
        return out, n

    def features(self, text: str | None) -> list[float]:
        """Of the matched clauses: presence and log count of each pattern, odds of the gravest, log sum of odds, log share and log number of clauses (of many, some match by chance); then 1."""
        out = [0.0] * self.size
        out[-1] = 1.0
        found, n = self.matches(text)
        if not found:
            return out
        kinds = len(self.patterns)
        for pattern, times in Counter(p for p, _ in found).items():
            out[pattern], out[kinds + pattern] = 1.0, math.log1p(times)
        out[-5:-1] = [max(o for _, o in found), math.log1p(sum(o for _, o in found)), math.log1p(1000 * len(found) / n), math.log1p(n)]
        return out

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(text), strict=True) if x)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


# ---------------------------------------------------------------- learning


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELS) -> DataFrame:
    """text and toxic of at most ``most`` labelled training rows, chosen by a hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumnRenamed("doc_id", "_id")
    # At most MAX_LABELS rows of two numbers: under half a megabyte.
    return docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic")


def _entries(word: str) -> list[str]:
    return [word, *[f"^{word[:n]}" for n in STEMS if n < len(word) <= n + ENDING]]


def lexicon_counts(train: DataFrame) -> DataFrame:
    """(entry, toxic, n, followed): documents with each word and stem, toxic ones, and toxic ones in which a target follows; combined in the tasks first."""
    targets = frozenset(TARGETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        toxic: Counter = Counter()
        followed: Counter = Counter()

        def out() -> pa.RecordBatch:
            keys = list(total)
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (toxic, total, followed)]], ["entry", "toxic", "n", "followed"])
            for c in (total, toxic, followed):
                c.clear()
            return batch

        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _TOKEN.findall((text or "").lower())
                entries = {e for w in set(words) - ENDS for e in _entries(w)}
                total.update(entries)
                if label:
                    toxic.update(entries)
                    at = [k for k, w in enumerate(words) if w in targets]
                    before = {words[j] for k in at for j in range(max(0, k - FOLLOWS), k)} - ENDS - targets
                    followed.update({e for w in before for e in _entries(w)})
                if len(total) > KEYS_HELD:
                    yield out()
        if total:
            yield out()

    return train.mapInArrow(run, "entry string, toxic long, n long, followed long").groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("toxic", "n", "followed")])


def marked(train: DataFrame) -> DataFrame:
    """The rows with the least hash of their 3-word shingles, which near copies share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for text in b.column(0).to_pylist():
                words = (text or "").encode().lower().split()
                marks.append(min((xxh64_intdigest(b" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) - (1 << 63))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(marks, pa.int64())], ["text", "toxic", "mark"])

    return train.mapInArrow(run, "text string, toxic int, mark long")


def one_of_copies(train: DataFrame) -> DataFrame:
    """One row for the texts of one mark: near copies repeat every rare word."""
    return train.groupBy("mark", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def learn_lexicon(train: DataFrame, n_toxic: int, n_other: int) -> dict[str, tuple[float, str]]:
    """Entries (stems start with ^), their log-odds and class; the strongest MAX_ENTRIES."""
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / F.lit(n_other + 1.0))
    share = n_toxic / max(1, n_toxic + n_other)
    part = lambda k, p: F.when(k > 0, k * F.log(k / (F.col("n") * F.lit(max(p, 1e-9))))).otherwise(0.0)
    g = 2 * (part(F.col("toxic"), share) + part(F.col("n") - F.col("toxic"), 1 - share))
    counted = lexicon_counts(one_of_copies(train)).where(F.col("toxic") >= LEAST_DOCS)
    strong = counted.withColumns({"odds": odds, "g": g}).where((F.col("odds") >= LEAST_ODDS) & (F.col("g") >= LEAST_G))
    rows = strong.orderBy(F.desc("g"), "entry").limit(MAX_ENTRIES).select("entry", "odds", (F.col("followed") * 2 >= F.col("toxic")).alias("threat")).collect()
    fixed = {w: (LEAST_ODDS, "insult") for w in INSULTS} | {w: (LEAST_ODDS, "threat") for w in THREATS}
    return fixed | {r["entry"]: (r["odds"], "threat" if r["threat"] else "insult") for r in rows}


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by gradient steps with momentum; deterministic."""
    w = np.zeros(x.shape[1])
    w[-1] = -2.0
    speed = np.zeros_like(w)
    scale = np.maximum(1.0, np.abs(x).max(axis=0)) if len(x) else np.ones_like(w)
    xs = x / scale
    for _ in range(rounds if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -50, 50)))
        slope = xs.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        speed = 0.9 * speed - 2.0 * slope
        w += speed
    return w / scale


def feature_rows(train: DataFrame, scorer: Scorer) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the rows; most match nothing and are equal, so the driver gets each distinct row with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scorer.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    rows = train.select("text", "toxic").mapInArrow(run, "x array<double>, toxic int").groupBy("x", "toxic").count().orderBy("x", "toxic").collect()
    times = [r["count"] for r in rows]
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), scorer.size)
    return np.repeat(x, times, axis=0), np.repeat(np.array([r["toxic"] != 0 for r in rows], float), times)


def class_counts(train: DataFrame) -> tuple[int, int]:
    """Rows that are toxic, and others."""
    toxic = F.col("toxic") != 0
    n, bad = train.agg(F.count(F.lit(1)), F.coalesce(F.sum(toxic.cast("long")), F.lit(0))).first()
    return bad, n - bad


def train_scorer(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> Scorer:
    """The lexicon of all training rows, with weights fitted on rows that had no part in the lexicon that read them."""
    train = stage_table(marked(training_rows(docs, labels)), "toxic-train")
    toxic, other = class_counts(train)
    scorer = Scorer(learn_lexicon(train, toxic, other))
    if not toxic + other:
        scorer.weights = [1.0] * len(scorer.patterns) + [0.0] * (scorer.size - len(scorer.patterns) - 1) + [-2.0]
        return scorer
    fold = F.pmod(F.xxhash64("mark"), F.lit(folds))
    parts = []
    for k in range(folds):
        rest = train.where(fold != k)
        parts.append(feature_rows(train.where(fold == k), Scorer(learn_lexicon(rest, *class_counts(rest)))))
    scorer.weights = fit_weights(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts])).tolist()
    return scorer


def score_documents(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([scorer.score(t) for t in part.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    return score_documents(docs, train_scorer(docs, read_table(spark, folder, "labels")))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
