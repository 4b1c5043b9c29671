"""Language identification: script ranges, per-word scores, and Viterbi over words.

A word's letters lie in scripts; the languages that are never written in its script are out. For
the others, the word's score is the log-likelihood of its character n-grams, which is learned from
labelled documents. Viterbi's best path over the words, with a penalty for each switch, labels
spans of a text; its language is the one whose spans hold the most letters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, documents, map_slices

FOLDS, HELD_OUT_FOLD = 4, 2
UNKNOWN = "und"
#: The model is fitted on about so many labelled documents at most.
TRAINING_DOCUMENTS = 20_000
GRAM_SIZES = (1, 2, 3)
GRAM_BITS = 15
SWITCH_PENALTY = 12.0
#: A language is written in a script if so large a share of its training letters is.
SCRIPT_SHARE = 0.001
#: Letters of the words that a worker remembers.
KNOWN_LETTERS = 1_000_000

#: First code points of script ranges, in order, and their names: fixed values of the Unicode blocks.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "asian"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7FC, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
    (0xFF21, "latin"), (0xFF5B, "other"), (0xFF66, "kana"), (0xFFA0, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([s for s, _ in SCRIPTS], np.int64)
_SCRIPT_AT = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


def words_of(text: str) -> list[str]:
    """The runs of letters, in lower case."""
    import regex

    global _find
    if _find is None:
        _find = regex.compile(r"\p{L}+").findall
    return _find(text.lower())


_find = None


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, its word), (script of each letter, its word). A word has a blank at either end."""
    points = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = points == 32
    word = np.cumsum(blank) - 1  # a blank is the start of the next word
    buckets, owners = [], []
    for n in GRAM_SIZES:
        if len(points) < n:
            continue
        mixed = np.full(len(points) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ points[k : len(points) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        inner = ~blank[: len(mixed)] if n == 1 else np.ones(len(mixed), bool)
        for k in range(1, n - 1):  # no n-gram goes over the blank between words
            inner &= ~blank[k : k + len(mixed)]
        owner = word[: len(mixed)]
        buckets.append((mixed & np.uint64((1 << GRAM_BITS) - 1)).astype(np.int64)[inner])
        owners.append(owner[inner])
    letter = ~blank
    script = _SCRIPT_AT[np.maximum(np.searchsorted(_STARTS, points[letter].astype(np.int64), "right") - 1, 0)]
    return np.concatenate(buckets), np.concatenate(owners), script, word[letter]


@dataclass
class Model:
    """log-likelihoods by bucket and language, and the languages (columns) that each script (row) is for."""

    langs: list[str]
    likelihood: np.ndarray
    script_langs: np.ndarray

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word; minus infinity where its script rules a language out. A script that no language has says nothing."""
        out = np.zeros((len(words), len(self.langs)))
        if not words:
            return out
        bucket, owner, script, letter_of = grams(words)
        for k, column in enumerate(self.likelihood.T):
            out[:, k] = np.bincount(owner, column[bucket], len(words))
        each = np.bincount(letter_of * len(SCRIPT_NAMES) + script, minlength=len(words) * len(SCRIPT_NAMES)).reshape(len(words), -1)
        allowed = self.script_langs[each.argmax(axis=1)]
        none = ~allowed.any(axis=1)
        out[none] = 0
        return np.where(allowed | none[:, None], out, -1e4)


def fit(docs: DataFrame, most: int = TRAINING_DOCUMENTS) -> Model | None:
    """Counts of n-grams and scripts by language over labelled documents of the training folds; about `most` of them, chosen by a hash of doc_id.

    Tasks count whole documents; what comes to the driver is a row for each bucket that a language
    of the sample has, which the sample bounds, however many languages there are.
    """
    rows = docs.where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT_FOLD))
    n = rows.count()
    if not n:
        return None
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < math.ceil(min(1.0, most / n) * 1_000_000)
    size = 1 << GRAM_BITS

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held = counts.setdefault(lang, np.zeros(size + len(SCRIPT_NAMES), np.int64))
            if words := words_of(text or ""):
                bucket, _, script, _ = grams(words)
                held += np.concatenate((np.bincount(bucket, minlength=size), np.bincount(script, minlength=len(SCRIPT_NAMES))))
        found = [(lang, np.flatnonzero(c), c) for lang, c in counts.items()]
        return pa.RecordBatch.from_arrays(
            [pa.array([lang for lang, at, _ in found for _ in at], pa.string()), pa.array(np.concatenate([at for _, at, _ in found])), pa.array(np.concatenate([c[at] for _, at, c in found]))], ["lang", "bucket", "n"]
        )

    counted = rows.where(share).select("lang", F.col("text").cast("string")).mapInArrow(map_slices(count, 2048), "lang string, bucket long, n long")
    held: dict[str, np.ndarray] = {}
    for r in counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        held.setdefault(r["lang"], np.zeros(size + len(SCRIPT_NAMES)))[r["bucket"]] = r["n"]
    langs = sorted(held)
    if not langs:
        return None
    table = np.array([held[x] for x in langs])
    seen = table[:, :size] + 0.5
    scripts = table[:, size:]
    used = scripts > SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.asfortranarray(np.log(seen / seen.sum(axis=1, keepdims=True)).T), used.T.copy())


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best path over rows of scores, where a change of column costs `penalty`."""
    total = scores.sum(axis=0)
    best = int(total.argmax())
    # The best single column is the best path if no run of rows gains more than half a switch in any other column: a path without it may have two such runs for one switch.
    ahead = np.concatenate((np.zeros((1, scores.shape[1])), np.cumsum(scores - scores[:, [best]], axis=0)))
    if 2 * (ahead - np.minimum.accumulate(ahead, axis=0)).max() <= penalty:
        return np.full(len(scores), best)
    rows = scores.tolist()  # plain numbers are faster than arrays of a few
    at, back = rows[0], []
    for row in rows[1:]:
        least = max(at) - penalty
        back.append(at)
        at = [(a if a >= least else least) + s for a, s in zip(at, row, strict=True)]
    path = [at.index(max(at))]
    for at in reversed(back):
        here, top = at[path[-1]], max(at)
        path.append(path[-1] if here >= top - penalty else at.index(top))
    return np.array(path[::-1])


class Labeller:
    """Labels texts; remembers the words that it has scored."""

    def __init__(self, model: Model, penalty: float = SWITCH_PENALTY):
        self.model, self.penalty = model, penalty
        self.known: dict[str, int] = {}
        self.letters = 0
        self.table = np.zeros((0, len(model.langs)))

    def rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Scores of each text's words."""
        if self.letters > KNOWN_LETTERS:
            self.known, self.table, self.letters = {}, self.table[:0], 0
        known = self.known
        if new := list({w for words in texts for w in words if w not in known}):
            self.table = np.concatenate((self.table, self.model.score_words(new)))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.letters += sum(map(len, new))
        return [self.table[np.fromiter(map(known.__getitem__, words), np.int64, len(words))] for words in texts]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(first word, word after the last, language) of each span of a text."""
        words = words_of(text)
        if not words:
            return []
        path = viterbi(self.rows([words])[0], self.penalty)
        edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
        return [(a, b, self.model.langs[path[a]]) for a, b in zip(edges, edges[1:], strict=False)]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The language with the most letters in its spans, and the share of the letters that they hold times its odds there."""
        split = [words_of(t) for t in texts]
        return [self._label(words, scores) if words else (UNKNOWN, 0.0) for words, scores in zip(split, self.rows(split), strict=True)]

    def _label(self, words: list[str], scores: np.ndarray) -> tuple[str, float]:
        path = viterbi(scores, self.penalty)
        letters = np.fromiter(map(len, words), np.int64, len(words))
        held = np.bincount(path, letters, len(self.model.langs))
        best = int(held.argmax())
        total = scores[path == best].sum(axis=0)
        odds = 1 / np.exp(np.minimum(total - total[best], 500)).sum()
        return self.model.langs[best], float(min(1.0, held[best] / letters.sum() * odds))


_labellers: dict[int, Labeller] = {}


def labeller(model: Model) -> Labeller:
    """One for each task's copy of the model."""
    if id(model) not in _labellers:
        _labellers.clear()
        _labellers[id(model)] = Labeller(model)
    return _labellers[id(model)]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score. Without a model all is unknown."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = labeller(model).predict(texts) if model else [(UNKNOWN, 0.0)] * len(texts)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run), "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The documents whose language is known with a score of `least` or more, with their columns. Without a model, those that have a letter."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(names.index("text")).to_pylist()]
        if model is None:
            return batch.filter(pa.array([bool(words_of(t)) for t in texts], pa.bool_()))
        return batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in labeller(model).predict(texts)], pa.bool_()))

    return docs.mapInArrow(map_slices(run), docs.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document.

    A text that is null or has no letter is `und` with score 0; of a very long text all words count;
    of languages with equal scores the first by name is taken, and a path stays where it is rather
    than switch for nothing; rows without lang are not learned from; repeated rows each have their
    row; an empty table gives none; other columns of the input are not read.
    """
    docs = documents(spark, sf_dir)
    model = fit(docs)
    held_out = crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT_FOLD
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
