"""Texts of millions of characters and of very many spans, through the queries themselves."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import write
from tokenizers import Tokenizer

from sparsemill.llm.queries import QUERIES

MILLION = 10**6


def rows(texts):
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def runs(tmp_path_factory):
    """A million blanks, line ends, letters, digits, marks and mixed white space; ten million blanks and letters; ten million characters of words."""
    texts = [c * MILLION for c in " \n\tx1!é"] + [" \n" * (MILLION // 2) + "end", "a" + " " * MILLION + "b", "no break" + "\u00a0 " * 5000]
    texts += [" " * (10 * MILLION), "word, 12 'll " * (10 * MILLION // 13)]
    return texts, write(rows(texts), tmp_path_factory.mktemp("runs"))


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_op4_has_the_librarys_ids(spark, runs):
    texts, folder = runs
    t = library("byte_bpe_50k.json")
    found = {}
    for r in QUERIES["op4_best_fit_packing"](spark, folder).collect():
        found.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for k, text in enumerate(texts):
        ids = np.array([*t.encode_batch_fast([text], add_special_tokens=False)[0].ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        ends = [first, *range(first + 1024, len(ids) + 1, 1024)]
        assert sorted(found[k]) == [(s, e - s, zlib.crc32(ids[s:e].tobytes())) for s, e in zip([0, *ends], ends, strict=False)], k


def test_op1_has_the_librarys_ids(spark, runs):
    texts, folder = runs
    t = library("word_bpe_49k.json")
    found = {r["doc_id"]: r for r in QUERIES["op1_bpe_tree"](spark, folder).collect()}
    for k, text in enumerate(texts):
        ids = t.encode_batch_fast([text], add_special_tokens=False)[0].ids
        assert found[k]["n_tokens"] == len(ids) and found[k]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), k


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(("op1_", "op4"))))
def test_others_go_through(spark, runs, name):
    texts, folder = runs
    began = time.perf_counter()
    assert len(QUERIES[name](spark, folder).collect()) == len(texts)
    assert time.perf_counter() - began < 120


HITS = {
    "op7_pii": lambda n: " ".join(f"u{k}@mail.example.com 10.0.{k % 256}.7" for k in range(n // 2)),
    "op9_secret_scan": lambda n: " ".join(f"password=abc{k:08d}" if k % 2 else f"key{k}/{'a1B2' * 6}" for k in range(n)),
}


@pytest.mark.parametrize("name", sorted(HITS))
def test_time_follows_the_hits(spark, tmp_path, name):
    """Eight times the spans in one text take no more than some sixteen times the time; a square would take 64."""
    seconds = []
    for n in (1_000, 12_500, 100_000):
        folder = tmp_path / str(n)
        folder.mkdir()
        write(rows([HITS[name](n)]), folder, labels=[])
        began = time.perf_counter()
        (row,) = QUERIES[name](spark, str(folder)).collect()
        seconds.append(time.perf_counter() - began)
        assert row["spans"].count(",") + 1 >= n // 2
    assert seconds[2] < 16 * seconds[1] + 5
