"""Quality rules under weak supervision, with DataFrame functions only.

Each rule looks at counts of a text and votes good or bad, or abstains. Expectation-maximisation
estimates how each rule votes on good and on bad documents, without labels, from how often each
combination of votes occurs - at most 3 ** rules rows, whatever the corpus. A document is kept if
the posterior probability that it is good is high enough, not if it passes every rule.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, materialize

SPACE = r"[\x20\x09-\x0D]+"
WINDOW_WORDS = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
KEEP_FROM = 0.5
ROUNDS = 100
LEAST_ODDS = 3.0

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad where `value` is below bad[0] or above bad[1], good where it is within good, and else abstains.

    Most rules know one fault and abstain where they don't see it: a text without repeats may be
    bad for another reason, and its good votes would outweigh the one rule that sees it.
    """

    name: str
    value: str
    bad: tuple[float, float]
    good: tuple[float, float] | None = None

    def vote(self) -> Column:
        v = F.expr(self.value)
        fault = F.when((v < self.bad[0]) | (v > self.bad[1]), -1)
        return (fault.when(v.between(*self.good), 1) if self.good else fault).otherwise(0)


NEVER = float("inf")
RULES = (
    Rule("repetition", "n_repeat_words / greatest(n_words, 1)", (-NEVER, 0.2)),
    Rule("same_lines", "n_dup_lines / greatest(n_lines, 1)", (-NEVER, 0.4)),
    Rule("few_words", "n_distinct / greatest(n_words, 1)", (0.4, NEVER)),  # within windows: over a whole text the share falls with the length
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", (-NEVER, 0.3)),
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", (-NEVER, 0.05)),
    Rule("word_length", "word_chars / greatest(n_words, 1)", (3.2, 6.1)),
    Rule("plain_words", "n_plain / greatest(n_words, 1)", (0.7, NEVER), (0.9, 1)),
)
#: Words of a window in which distinct words are counted.
DISTINCT_WINDOW = 500
#: A plain word: letters, maybe one mark at the end.
PLAIN_WORD = r"^[\p{L}]+[.,;:!?]?\z"


def repeated_words(words: Column, window: int = WINDOW_WORDS) -> Column:
    """Words in windows that occur twice or more in `words`.

    Windows are told apart by 64-bit hashes. Texts where all differ, nearly all of them, end with one
    look at a hash set; for the others the hashes are sorted with their places, and the places of
    repeated windows are walked in order.
    """
    places = F.sequence(F.lit(1), F.size(words) - window + 1)

    def of_repeats(hashes: Column) -> Column:
        sorted_ = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def walk(s: Column) -> Column:
            same = lambda x, i, step: F.get(s, i + step)["h"] == x["h"]
            repeats = F.filter(s, lambda x, i: F.coalesce(same(x, i, -1), F.lit(False)) | F.coalesce(same(x, i, 1), F.lit(False)))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
            return F.aggregate(F.array_sort(F.transform(repeats, lambda x: x["i"])), start, step)["n"]

        return let(sorted_, walk)

    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, window)))
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(of_repeats(h)))
    return F.when(F.size(words) <= window, 0).otherwise(found)


def window_distinct(words: Column, window: int = DISTINCT_WINDOW) -> Column:
    """The distinct words of each window of `words`, windows following one another, summed up."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(window))
    return F.aggregate(starts, F.lit(0), lambda n, i: n + F.size(F.array_distinct(F.slice(words, i, window))))


def counted(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """`keep`, then the counts that the contract names and those that rules use besides. A null text is empty."""
    text = F.coalesce(F.col("_text"), F.lit(""))
    gone = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [f"_keep{k}" for k in range(len(keep))]
    named = docs.select(*[c.alias(n) for c, n in zip(keep, kept, strict=True)], F.col("text").cast("string").alias("_text"))
    parts = named.select(*kept, gone(r"[#*$%&|<>]+").alias("n_symbols"), gone(r"\p{Lu}+").alias("n_capitals"), lines.alias("_lines"), words.alias("_words"))
    return parts.select(
        *kept,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.col("n_capitals").cast("long").alias("n_capitals"),
        F.size("_lines").cast("long").alias("n_lines"),
        window_distinct(F.col("_words")).cast("long").alias("n_distinct"),
        F.size(F.filter("_words", lambda w: w.rlike(PLAIN_WORD))).cast("long").alias("n_plain"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def votes(counts: DataFrame) -> DataFrame:
    """Counts with `votes`, the rules' votes in order."""
    return counts.withColumn("votes", F.array(*[r.vote().cast("int") for r in RULES]))


@dataclass
class Model:
    """Of bad (0) and good (1) documents: their share, and each rule's chances to vote bad, abstain and vote good."""

    share: tuple[float, float]
    chances: list[tuple[list[float], list[float]]]

    def accuracy(self, rule: int) -> float:
        """The chance that a vote of the rule, if it doesn't abstain, is right."""
        right = sum(self.share[c] * self.chances[rule][c][2 * c] for c in (0, 1))
        wrong = sum(self.share[c] * self.chances[rule][c][2 - 2 * c] for c in (0, 1))
        return right / (right + wrong) if right + wrong else 0.5

    def good(self, pattern: tuple[int, ...]) -> float:
        odds = math.log(self.share[1] / self.share[0]) + sum(self.weight(k, v) for k, v in enumerate(pattern))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    def weight(self, rule: int, vote: int) -> float:
        bad, good = self.chances[rule]
        return math.log(good[vote + 1] / bad[vote + 1])

    def posterior(self, voted: Column) -> Column:
        odds = F.lit(math.log(self.share[1] / self.share[0]))
        for k in range(len(self.chances)):
            odds = odds + F.element_at(F.array(*[F.lit(self.weight(k, v)) for v in (-1, 0, 1)]), F.get(voted, F.lit(k)) + 2)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: dict[tuple[int, ...], int], rules: int = len(RULES), rounds: int = ROUNDS) -> Model:
    """Expectation-maximisation over the counts of vote combinations.

    It starts from rules that are right in most cases, which says which class is good, and holds
    each rule to be better than chance: a vote is LEAST_ODDS times as likely, at least, in the
    class that it names. So a fault that only few documents have can't come to speak for them.
    """
    model = Model((0.2, 0.8), [([0.3, 0.6, 0.1], [0.02, 0.28, 0.7]) for _ in range(rules)])
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        mass, seen = [0.0, 0.0], [([0.5, 0.5, 0.5], [0.5, 0.5, 0.5]) for _ in range(rules)]  # half a count more of each: no chance is 0
        for pattern, n in patterns.items():
            p = model.good(pattern)
            for c, part in ((0, n * (1 - p)), (1, n * p)):
                mass[c] += part
                for k, v in enumerate(pattern):
                    seen[k][c][v + 1] += part
        new = Model(((mass[0] + 1) / (total + 2), (mass[1] + 1) / (total + 2)), [_better_than_chance(*([x / sum(row) for x in row] for row in rule)) for rule in seen])
        moved = abs(new.share[0] - model.share[0])
        model = new
        if moved < 1e-9:
            break
    return model


def _better_than_chance(bad: list[float], good: list[float]) -> tuple[list[float], list[float]]:
    """Chances of (bad vote, none, good vote) in each class; what is too much for the wrong class counts as abstaining."""
    wrong_bad, wrong_good = min(good[0], bad[0] / LEAST_ODDS), min(bad[2], good[2] / LEAST_ODDS)
    return [bad[0], bad[1] + bad[2] - wrong_good, wrong_good], [wrong_bad, good[1] + good[0] - wrong_bad, good[2]]


def fit(voted: DataFrame) -> Model:
    """The model of rows with `votes`. Combinations are counted where the rows are."""
    return estimate({tuple(r["votes"]): r["count"] for r in sorted(voted.groupBy("votes").count().collect(), key=lambda r: r["votes"])})


def judge(voted: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """Adds base_failed, kept and the posterior."""
    good = model.posterior(F.col("votes"))
    return voted.withColumn("base_failed", base_failed()).withColumn("posterior", good).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))


def keep_good(docs: DataFrame, keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that are kept, with their columns. Each is counted once and written with its votes, which the model is fitted on; then they are judged."""
    voted = votes(counted(docs, [F.struct(*[docs[c] for c in docs.columns])]))
    held = materialize(voted.select("_keep0", base_failed().alias("base_failed"), "votes"), "voted")
    return held.where(~F.col("base_failed") & (fit(held).posterior(F.col("votes")) >= keep_from)).select("_keep0.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document.

    A null or empty text has no words and fails; a very long text is counted whole, its distinct
    words by windows, so that no rule goes by its length; a value at a rule's bound is good; repeated
    rows each have their row and vote each; an empty table gives no rows; other columns of the input
    are not read.
    """
    voted = materialize(votes(counted(documents(spark, sf_dir), [F.col("doc_id").cast("long")])), "votes")
    judged = judge(voted, fit(voted))
    return judged.select(F.col("_keep0").alias("doc_id"), *BASE, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def _oracle() -> str:
    """The same in SQL: the model is a row, and a round of a recursive query makes the next one."""
    places = [(k, c, v) for k in range(len(RULES)) for c in (0, 1) for v in (-1, 0, 1)]
    name = lambda k, c, v: f"c{k}_{c}_{v + 1}"
    vote = lambda r: (
        "CASE WHEN " + " OR ".join(f"{r.value} {sign} {x}" for sign, x in (("<", r.bad[0]), (">", r.bad[1])) if abs(x) != NEVER) + " THEN -1" + (f" WHEN {r.value} BETWEEN {r.good[0]} AND {r.good[1]} THEN 1" if r.good else "") + " ELSE 0 END"
    )
    weight = lambda k: f"CASE v[{k + 1}] " + " ".join(f"WHEN {v} THEN ln({name(k, 1, v)} / {name(k, 0, v)})" for v in (-1, 0, 1)) + " END"
    good = f"1 / (1 + exp(-greatest(-500, least(500, ln(s1 / s0) + {' + '.join(weight(k) for k in range(len(RULES)))}))))"
    part = ("n * (1 - good)", "n * good")
    seen = ", ".join(f"(0.5e0 + coalesce(sum({part[c]}) FILTER (v[{k + 1}] = {v}), 0)) / (1.5e0 + sum({part[c]})) AS {name(k, c, v)}" for k, c, v in places)
    held = []
    for k in range(len(RULES)):
        wrong_bad, wrong_good = f"least({name(k, 1, -1)}, {name(k, 0, -1)} / {LEAST_ODDS})", f"least({name(k, 0, 1)}, {name(k, 1, 1)} / {LEAST_ODDS})"
        held += [name(k, 0, -1), f"{name(k, 0, 0)} + {name(k, 0, 1)} - {wrong_good}", wrong_good, wrong_bad, f"{name(k, 1, 0)} + {name(k, 1, -1)} - {wrong_bad}", name(k, 1, 1)]
    start = [*[0.3, 0.6, 0.1, 0.02, 0.28, 0.7] * len(RULES)]
    return rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (SELECT rid, i, array_to_string(words[i:i + {WINDOW_WORDS - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW_WORDS - 2})) AS i FROM parts)),
repeats AS (SELECT rid, i FROM windows WHERE (rid, w) IN (SELECT (rid, w) FROM windows GROUP BY rid, w HAVING count(*) > 1)),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM repeats, range({WINDOW_WORDS}) t(k) GROUP BY rid),
counts AS (SELECT rid, doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals, len(lines) AS n_lines, coalesce(list_sum(list_transform(range(0, len(words), {DISTINCT_WINDOW}), lambda i: len(list_distinct(words[i + 1:i + {DISTINCT_WINDOW}])))), 0)::BIGINT AS n_distinct, len(list_filter(words, lambda w: regexp_full_match(w, '[\p{{L}}]+[.,;:!?]?'))) AS n_plain
  FROM parts LEFT JOIN covered USING (rid)),
voted AS (SELECT *, [{", ".join(map(vote, RULES))}] AS v FROM counts),
patterns AS (SELECT v, count(*)::DOUBLE AS n FROM voted GROUP BY v),
model AS (
  SELECT 0 AS round, 1e0 AS moved, 0.2e0 AS s0, 0.8e0 AS s1, {", ".join(f"{x}e0 AS {name(*at)}" for x, at in zip(start, places, strict=True))}
  UNION ALL
  SELECT round, abs(s0 - s_before), s0, s1, {", ".join(held)} FROM (
    SELECT round + 1 AS round, any_value(s0) AS s_before, (sum({part[0]}) + 1) / (sum(n) + 2) AS s0, (sum({part[1]}) + 1) / (sum(n) + 2) AS s1, {seen}
    FROM (SELECT *, {good} AS good FROM model, patterns WHERE round < {ROUNDS} AND moved >= 1e-9) GROUP BY round)),
last AS (SELECT * FROM model ORDER BY round DESC LIMIT 1),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed, {good} AS good FROM voted, last)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND good >= {KEEP_FROM} AS kept, round(good, 6) AS posterior FROM judged"""


ORACLE = _oracle()
