"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses of word classes. The classes of insults, with weights, are learned from
labelled documents; threats, targets, negations and words of reported speech are fixed. Small
transducers are composed into one machine. On its way through a clause it passes on an insult or a
threat with a factor, less after a negation or between quotes; at the end of the clause it says
whether the clause matches: an insult needs a target, before or after it, or a sentence around it,
a threat needs a target, and reported speech weighs little. What counts of a clause is its heaviest
insult and its heaviest threat, so that neither lone words nor repeated ones add up. A document's
score is a logistic function of what its clauses weigh.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, discard, documents, map_slices, materialize

FOLDS, HELD_OUT_FOLD = 3, 1
TOXIC_FROM = 0.7
#: The grammar and its weights are fitted on about so many labelled documents at most.
TRAINING_DOCUMENTS = 12_000
#: An insult occurs in so many toxic documents of these, and its log odds and the likelihood ratio of its being more frequent there are so high.
LEAST_DOCUMENTS, LEAST_LOG_ODDS, LEAST_RATIO = 3, 2.0, 24.0
#: Occurrences that count of one document: what it repeats says little about others.
COUNTED_EACH = 5
#: A clause that no mark ends has so many words at most; an insult without a target needs so many other words around it, and a mark ends
#: a clause after more words than these only: a call like "Idiot!" belongs to what it is called out with.
CLAUSE_WORDS, COMPANY = 24, 2
#: Letters of the beginnings of words that are learned besides whole words; 0 is the whole word.
STEMS = (0, 3, 4, 5, 6, 7, 8)
KNOWN_LETTERS = 1_000_000

# Fixed word lists of the grammar, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat stab shoot burn crush punch strangle töten schlagen vernichten umbringen tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours he him his she her they them their these those people everyone du dich dein ihr euch sie er tu toi vous votre ils elles tú usted ustedes ellos ellas".split()
NEGATIONS = "not no never none neither nor isn aren wasn don doesn didn nicht kein keine nie niemals pas jamais aucun ni nunca jamás ningún".split()
REPORTS = "said says say wrote writes reported quoted quotes claimed claims called sagte schrieb behauptete dit écrit affirme dijo escribió afirmó".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, BREAK = range(8)
CLASSES = 8


@dataclass
class Transducer:
    """Deterministic. arcs[state, class] is (next state, factor for what is read there); a class without an arc keeps the state and has factor 1.

    final[state] is what a clause that ends there counts: (its insults, its threats), 1 and 1 without an entry.
    """

    states: int
    arcs: dict[tuple[int, int], tuple[int, float]] = field(default_factory=dict)
    final: dict[int, tuple[float, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol), (state, 1.0))

    def end(self, state: int) -> tuple[float, float]:
        return self.final.get(state, (1.0, 1.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both at once: pairs of states, products of factors."""
        arcs, final = {}, {}
        for a in range(self.states):
            for b in range(other.states):
                at = a * other.states + b
                for symbol in range(CLASSES):
                    (x, f), (y, g) = self.step(a, symbol), other.step(b, symbol)
                    arcs[at, symbol] = (x * other.states + y, f * g)
                final[at] = tuple(f * g for f, g in zip(self.end(a), other.end(b), strict=True))
        return Transducer(self.states * other.states, arcs, final)

    def table(self) -> tuple[list[list[int]], list[list[float]], list[tuple[float, float]]]:
        steps = [[self.step(s, c) for c in range(CLASSES)] for s in range(self.states)]
        return [[x for x, _ in row] for row in steps], [[f for _, f in row] for row in steps], [self.end(s) for s in range(self.states)]


def insult_clause(company: int = COMPANY) -> Transducer:
    """Insults count in a clause with a target, before or after them, or with so many other words; a lone insult doesn't."""
    arcs, met = {}, company + 1  # states: other words so far; the last is that a target was met
    for s in range(company + 1):
        arcs |= {(s, c): (min(s + 1, company), 1.0) for c in (OTHER, THREAT, NEGATION, REPORT)} | {(s, TARGET): (met, 1.0)}
    return Transducer(company + 2, arcs, {s: (0.0, 1.0) for s in range(company)} | {met: (1.5, 1.0)})


def threat_clause() -> Transducer:
    """Threats count in a clause that names a target, before or after them."""
    return Transducer(2, {(0, TARGET): (1, 1.0)}, {0: (1.0, 0.0)})


def reported_clause(factor: float) -> Transducer:
    """A clause with a word of reporting counts less."""
    return Transducer(2, {(0, REPORT): (1, 1.0)}, {1: (factor, factor)})


def within(trigger: int, words: int, factor: float) -> Transducer:
    """Insults and threats within so many words after `trigger` in a clause have the factor."""
    t = Transducer(words + 1)
    for s in range(words + 1):
        for symbol in range(CLASSES):
            left = max(0, s - 1)
            t.arcs[s, symbol] = (left, factor if s and symbol in (INSULT, THREAT) else 1.0)
        t.arcs[s, trigger] = (words, 1.0)
    return t


def between_quotes(factor: float) -> Transducer:
    return Transducer(2, {(0, QUOTE): (1, 1.0), (1, QUOTE): (0, 1.0)} | {(1, c): (1, factor) for c in (INSULT, THREAT)})


def grammar() -> Transducer:
    """The composition of all."""
    machine = insult_clause()
    for part in (threat_clause(), within(NEGATION, 3, 0.3), reported_clause(0.4), between_quotes(0.4)):
        machine = machine.compose(part)
    return machine


#: What a text is read as: runs of letters, and the marks that end clauses or quote.
READ = re.compile(r"[^\W\d_]+|[.!?;:,\n]|[\"“”«»]")
_FIXED = {w: c for c, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_FIXED |= dict.fromkeys('"“”«»', QUOTE) | dict.fromkeys(".!?;:,\n", BREAK)
THREAT_WEIGHT = 2.0


def entries_of(word: str) -> list[str]:
    """The lexicon's keys for a word: itself, and its beginnings with a mark."""
    return [word if k == 0 else word[:k] + "*" for k in STEMS if k == 0 or len(word) > k]


@dataclass
class Model:
    insults: dict[str, float]
    weights: np.ndarray  # of features(), the last is the constant


_MACHINE = grammar().table()


class Reader:
    """Weighs texts by the grammar and a lexicon; remembers the class and weight of the words that it has met."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.next, self.factor, self.final = _MACHINE
        self.known: dict[str, tuple[int, float]] = {}
        self.letters = 0

    def classify(self, token: str) -> tuple[int, float]:
        if token in _FIXED:
            return _FIXED[token], THREAT_WEIGHT if _FIXED[token] == THREAT else 0.0
        weight = max((self.insults[e] for e in entries_of(token) if e in self.insults), default=0.0)
        return (INSULT, weight) if weight else (OTHER, 0.0)

    def clauses(self, text: str) -> tuple[list[float], int]:
        """The weight of each clause that has one, and the number of tokens."""
        tokens = READ.findall(text.lower())
        known = self.known
        if self.letters > KNOWN_LETTERS:
            known.clear()
            self.letters = 0
        for w in set(tokens):
            if w not in known:
                known[w] = self.classify(w)
                self.letters += len(w)
        read = list(map(known.__getitem__, tokens))
        if not any(w for _, w in read):
            return [], len(tokens)
        state, insult, threat, words, found = 0, 0.0, 0.0, 0, []

        def end() -> None:
            if insult or threat:
                of_insult, of_threat = self.final[state]
                if weight := insult * of_insult + threat * of_threat:
                    found.append(weight)

        for symbol, weight in read:
            if words > COMPANY if symbol == BREAK else words == CLAUSE_WORDS:
                end()
                state, insult, threat, words = 0, 0.0, 0.0, 0
            if symbol == BREAK:
                continue
            words += 1
            if weight:
                weight *= self.factor[state][symbol]
                if symbol == INSULT:
                    insult = max(insult, weight)
                else:
                    threat = max(threat, weight)
            state = self.next[state][symbol]
        end()
        return found, len(tokens)

    def features(self, text: str) -> list[float]:
        """What all clauses weigh, the heaviest, how many there are, and their share of the text; then the constant."""
        weights, n = self.clauses(text)
        total = sum(weights)
        return [math.log1p(total), math.log1p(max(weights, default=0.0)), math.log1p(len(weights)), 10 * total / (n + 20), 1.0]


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method, held to zero by a ridge. Toxic documents are few, so each weighs the root of the clean ones for each of them."""
    toxic = labels.sum()
    each = np.where((labels == 1) & (0 < toxic < len(labels)), np.sqrt((len(labels) - toxic) / max(toxic, 1)), 1.0)
    w = np.zeros(features.shape[1])
    hold = np.full(len(w), ridge)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        h = (features * (each * p * (1 - p))[:, None]).T @ features + np.diag(hold)
        move = np.linalg.solve(h, features.T @ (each * (p - labels)) + hold * w)
        w = w - move
        if np.abs(move).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """text and toxic of about `most` labelled documents of the training folds, chosen by a hash of doc_id; each text once.

    The chosen labels, two numbers each, are bounded by `most` and so are broadcast; of the texts,
    only the chosen ones are shuffled and written.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = rows.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < math.ceil(min(1.0, most / max(n, 1)) * 1_000_000)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chosen = texts.join(F.broadcast(rows.where(share)), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return materialize(chosen, "toxic-sample")


#: Of an entry, the toxic and the clean documents with it, and its occurrences there.
COUNTS = ("toxic_docs", "clean_docs", "toxic_words", "clean_words")


def count_entries(texts: list[str], toxic: list[int]) -> dict[str, list[int]]:
    """The COUNTS of each entry in some texts."""
    held: dict[str, list[int]] = {}
    for text, label in zip(texts, toxic, strict=True):
        of_text: Counter = Counter()
        for word, n in Counter(READ.findall(text.lower())).items():
            if word not in _FIXED:
                for entry in entries_of(word):
                    of_text[entry] += n
        at = 0 if label == 1 else 1
        for entry, n in of_text.items():
            counts = held.setdefault(entry, [0, 0, 0, 0])
            counts[at] += 1
            counts[2 + at] += min(n, COUNTED_EACH)
    return held


def insults_of(counts: dict[str, list[int]], toxic: int, clean: int) -> dict[str, float]:
    """Of counts from so many toxic and clean documents, the entries that are surely more frequent in toxic ones, with their log odds."""
    found = {}
    if toxic and clean:
        for entry, (docs, _, t, c) in counts.items():
            odds = math.log((t + 0.5) / toxic) - math.log((c + 0.5) / clean)
            if docs >= LEAST_DOCUMENTS and odds >= LEAST_LOG_ODDS:
                each = (t + c) / (toxic + clean)
                ratio = 2 * sum(n * math.log(n / (size * each)) for n, size in ((t, toxic), (c, clean)) if n)
                if ratio >= LEAST_RATIO:
                    found[entry] = odds
    return found


def counts_of(rows: DataFrame) -> tuple[dict[str, list[int]], int, int]:
    """The COUNTS of entries with LEAST_DOCUMENTS toxic documents, and the numbers of toxic and of clean ones. Tasks count; what comes to the driver is bounded as the sample is."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(entry, *n) for entry, n in count_entries(*(c.to_pylist() for c in batch.columns)).items()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64() if k else pa.string()) for k in range(5)], ["entry", *COUNTS])

    sizes = {r["toxic"] == 1: r["n"] for r in rows.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    counted = rows.mapInArrow(map_slices(count, 2048), "entry string, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("entry").agg(*[F.sum(c).alias(c) for c in COUNTS])
    held = {r["entry"]: [r[c] for c in COUNTS] for r in counted.where(F.col("toxic_docs") >= LEAST_DOCUMENTS).collect()}
    return held, sizes.get(True, 0), sizes.get(False, 0)


def unseen(counts: dict[str, list[int]], toxic: int, clean: int, text: str, label: int) -> dict[str, float]:
    """The insults of a text's own words as all other documents tell them."""
    own = {entry: [a - b for a, b in zip(counts[entry], n, strict=True)] for entry, n in count_entries([text], [label]).items() if entry in counts}
    return insults_of(own, toxic - (label == 1), clean - (label != 1))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS) -> Model:
    """Without labels of both kinds nothing is an insult and all scores are the share of toxic labels.

    A document's clauses are weighed for the fit by what the other documents tell, as those of a
    document that isn't among them are.
    """
    rows = training_rows(docs, labels, most)
    counts, toxic, clean = counts_of(rows)

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Reader(unseen(counts, toxic, clean, text, label)).features(text) for text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["features", "toxic"])

    seen = rows.mapInArrow(map_slices(read, 2048), "features array<double>, toxic int").collect()
    discard(rows)
    table = np.array([r["features"] for r in seen]).reshape(-1, 5)
    return Model(insults_of(counts, toxic, clean), logistic(table, np.array([r["toxic"] == 1 for r in seen], np.float64)))


def scores(model: Model, texts: list[str], reader: Reader | None = None) -> np.ndarray:
    reader = reader or Reader(model.insults)
    table = np.array([reader.features(t) for t in texts]).reshape(-1, 5)
    return 1 / (1 + np.exp(-np.clip(table @ model.weights, -30, 30)))


_readers: dict[int, tuple[Model, Reader]] = {}


def reader_of(model: Model) -> Reader:
    """One for each worker's copy of the model."""
    if id(model) not in _readers:
        _readers.clear()
        _readers[id(model)] = (model, Reader(model.insults))
    return _readers[id(model)][1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score, the probability of label 1."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scores(model, [t or "" for t in batch.column(1).to_pylist()], reader_of(model))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run), "doc_id long, score double")


def op10_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document.

    A null or empty text has no clauses and the score of such; of a very long text every clause
    counts; a score of just TOXIC_FROM is predicted 1; of repeated label rows, and of equal texts
    with several labels, the largest label counts; repeated documents each have their row; an empty
    table gives none; other columns of the input are not read.
    """
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))
