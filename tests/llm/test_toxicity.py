"""The grammar against a plain reading of its rules, and the score on held-out documents."""

from __future__ import annotations

import os
import random

import duckdb
import pytest

from sparsemill.llm import toxicity as T

INSULTS = {"idiot": 4.0, "morons*": 3.0, "fool": 2.0}


def plain(text: str) -> list[float]:
    """Clauses cut by hand, then each weighed by the rules as they are told."""
    reader, clauses, here = T.Reader(INSULTS), [], []
    for token in T.READ.findall(text.lower()):
        kind, weight = reader.classify(token)
        if kind == T.BREAK:
            if len(here) > T.COMPANY:
                clauses.append(here)
                here = []
            continue
        if len(here) == T.CLAUSE_WORDS:
            clauses.append(here)
            here = []
        here.append((kind, weight))
    found = []
    for clause in [*clauses, here]:
        kinds = [k for k, _ in clause]
        others = sum(k in (T.OTHER, T.THREAT, T.NEGATION, T.REPORT) for k in kinds)
        weigh = {T.INSULT: 0.0, T.THREAT: 0.0}
        for at, (kind, weight) in enumerate(clause):
            if kind in weigh:
                negated = T.NEGATION in kinds[max(0, at - 3) : at]
                quoted = kinds[:at].count(T.QUOTE) % 2
                weigh[kind] = max(weigh[kind], weight * (0.3 if negated else 1) * (0.4 if quoted else 1))
        target = T.TARGET in kinds
        total = weigh[T.INSULT] * (1.5 if target else 1 if others >= T.COMPANY else 0) + weigh[T.THREAT] * target
        total *= 0.4 if T.REPORT in kinds else 1
        if total:
            found.append(total)
    return found


def test_clauses_are_those_of_the_rules():
    r = random.Random(4)
    words = ["idiot", "moronsly", "fool", "kill", "you", "ihr", "not", "said", '"', ".", ",", "!", "a", "b", "c", "the", "12"]
    for _ in range(3000):
        text = " ".join(r.choice(words) for _ in range(r.randint(0, 60)))
        assert T.Reader(INSULTS).clauses(text)[0] == pytest.approx(plain(text)), text


def test_grammar_weighs_clauses_not_words():
    weight = lambda t: sum(T.Reader(INSULTS).clauses(t)[0])
    assert weight("idiot") == weight("an idiot") == weight("idiot " * 100) == weight("") == 0  # lone words
    assert weight("you idiot") == weight("idiots, idiot like you") > weight("such an awful idiot") > weight("this is not an idiot") > 0
    assert weight("she said what an idiot") < weight("she met what an idiot") and weight('he saw "idiot" there') < weight("he saw idiot there")
    assert weight("i will kill") == 0 and weight("you i will kill") == weight("i will kill you") > 0
    assert weight("you idiot idiot idiot") == weight("you idiot")  # what is repeated doesn't add up
    assert weight("such awful moronsly sayings") == 3 and weight("such awful moron sayings") == 0


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.88), ("sf0.1", 0.9)])
def test_recall_on_held_out_documents(spark, sf, least):
    """Of the labelled documents that the grammar hasn't seen. Of the toxic ones of sf0.01 one of 18 has no insult, of sf0.1 eight of 144."""
    from sparsemill.llm.queries import QUERIES

    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    toxic = dict(duckdb.sql(f"SELECT doc_id, max(toxic) FROM '{folder}/labels.parquet' GROUP BY doc_id").fetchall())
    found = [(toxic[r["doc_id"]], r["predicted"]) for r in QUERIES["op10_toxicity_grammar"](spark, folder).where("held_out").collect() if toxic.get(r["doc_id"]) is not None]
    caught, all_ = sum(p for t, p in found if t), sum(t for t, _ in found)
    alarms, clean = sum(p for t, p in found if not t), sum(not t for t, _ in found)
    assert caught >= least * all_ and alarms <= 0.005 * clean, (caught, all_, alarms, clean)
