"""BPE encoding and decoding by tree concatenation.

A text longer than a leaf is halved until its parts are leaves, the leaves are encoded side by
side, and the ids of two halves are joined by encoding a window around the cut: the window counts
once one of its tokens is also a token of the left half, at the same place, and a later one is
also a token of the right half; until then the window doubles, up to both halves whole.

Why that is exact: a sequence of tokens is the BPE encoding of a word if each adjacent pair is the
encoding of its own text. Each pair of the joined sequence stands in the encoding of the left half,
of the window or of the right half, and the cut between words depends on what lies next to it only.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_slices

LEAF_CHARS = 4096
WINDOW_CHARS = 64
#: Bytes next to a window's edge or a cut where a contraction ('re, 've, 'll) may have begun outside: agreement there doesn't count.
MARGIN = 16
WORD_END = "</w>"
#: Words that a worker remembers.
KNOWN_WORDS = 400_000
#: ASCII and Latin letters, without those that change length in lower case.
PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-ɏ]*")
#: The split of this kind of tokenizer, a fixed value, and what finds the same in such texts faster.
CLIP_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PLAIN_FIND = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[!-/:-@\[-`{-~]+")
SPACES = re.compile(r"[\t-\r ]+")

_coders: dict[tuple[str, int, int], TreeCoder] = {}


class TreeCoder:
    """Encodes as tokenizers does with add_special_tokens=False, and decodes with skip_special_tokens=False."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            bare = json.load(file)
        #: For text that has been normalised, between special tokens. Without a normaliser a text may be cut anywhere.
        self.bare = Tokenizer.from_str(json.dumps(bare | {"normalizer": None, "added_tokens": [], "truncation": None, "padding": None}))
        self.leaf, self.window = leaf, window
        #: Bytes of text that each token covers; a token has one letter for each byte, and the mark of a word's end.
        self.width = [0] * self.tokenizer.get_vocab_size()
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token.removesuffix(WORD_END))
        self._prepare_words(bare)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = added
        self.split = re.compile("|".join(map(re.escape, added))) if added else None

    def _prepare_words(self, bare: dict) -> None:
        """Where the tokenizer keeps the matches of one pattern and encodes each alone, words are encoded once and remembered.

        That holds for texts of the letters and marks in PLAIN, which both libraries' patterns
        split alike, which NFC leaves alone, and whose white space no token shows.
        """
        import regex

        kind = lambda x: (x or {}).get("type")
        steps = (bare["pre_tokenizer"] or {}).get("pretokenizers", [])
        by_pattern = [kind(x) for x in steps] == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and "Regex" in steps[0]["pattern"]
        bytes_only = by_pattern and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and bare["post_processor"] is None
        marked = bytes_only and bare["model"]["end_of_word_suffix"] == WORD_END
        self.words: dict[str, bytes] | None = {} if marked else None  # little-endian ids
        self.find = None
        if marked:
            pattern = steps[0]["pattern"]["Regex"]
            self.find = PLAIN_FIND.findall if pattern == CLIP_SPLIT else regex.compile(pattern).findall
            self.final = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.final[[i for t, i in self.bare.get_vocab().items() if t.endswith(WORD_END)]] = True
        normal = (bare["normalizer"] or {}).get("normalizers", [])
        self.lower_only = bytes_only and [kind(x) for x in normal] == ["NFC", "Replace", "Lowercase"] and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "

    def normal(self, text: str) -> str:
        """The text as the tokenizer's normaliser has it, but for the kind of its white space where that shows in no token."""
        if self.lower_only and PLAIN.fullmatch(text):
            return text.lower()
        return self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that have been normalised."""
        if self.words is None:
            return self._library(texts)
        found = [self.find(t) if PLAIN.fullmatch(t) else None for t in texts]
        rest = iter(self._library([t for t, f in zip(texts, found, strict=True) if f is None]))
        known = self.words
        if len(known) > KNOWN_WORDS:
            known.clear()
        if new := list({w for words in found if words for w in words if w not in known}):
            # in one text, as each of them is told apart there too, and ends with a token that says so
            ids = np.array(self._library([" ".join(new)])[0], "<u4")
            ends = ((np.flatnonzero(self.final[ids]) + 1) * 4).tolist()
            raw = ids.tobytes()
            known.update(zip(new, (raw[a:b] for a, b in zip([0, *ends], ends, strict=False)), strict=True))
        return [next(rest) if words is None else np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4").tolist() for words in found]

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch_fast(texts, add_special_tokens=False)]

    def decode(self, batch: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(batch, skip_special_tokens=False)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of whole texts. Level by level, the leaves and windows of all texts are encoded at once: those of PLAIN by the words that the worker knows, the others by the library, which takes them in parallel."""
        trees: list[list[int | str]] = []  # of a text, its spans' places in `work`, and special tokens between them
        work: list[str] = []
        for text in texts:
            trees.append(spans := [])
            for part, special in self._around_special(text):
                spans.append(len(work))
                work.append(self.normal(part))
                if special:
                    spans.append(special)
        done = self._tree(work)
        found = [[self.added[s]] if isinstance(s, str) else done[s] for spans in trees for s in spans]
        out, at = [], 0
        for spans in trees:
            out.append(found[at] if len(spans) == 1 else [i for ids in found[at : at + len(spans)] for i in ids])
            at += len(spans)
        return out

    def _around_special(self, text: str):
        at = 0
        for m in self.split.finditer(text) if any(x in text for x in self.added) else ():
            yield text[at : m.start()], m[0]
            at = m.end()
        yield text[at:], None

    def _tree(self, texts: list[str]) -> list[list[int]]:
        leaves: list[str] = []
        nodes: list[list[tuple[int, int, int]]] = []  # of each text, (start, end, leaf)
        for text in texts:
            spans = [(0, len(text))]
            while any(e - s > self.leaf for s, e in spans):
                spans = [x for s, e in spans for x in (((s, (s + e) // 2), ((s + e) // 2, e)) if e - s > self.leaf else ((s, e),))]
            nodes.append([(s, e, len(leaves) + k) for k, (s, e) in enumerate(spans)])
            leaves += [text[s:e] for s, e in spans]
        ids = self._ids(leaves)
        level = [[(s, e, ids[k]) for s, e, k in spans] for spans in nodes]
        while any(len(x) > 1 for x in level):
            joins = [(t, k) for t, spans in enumerate(level) for k in range(0, len(spans) - 1, 2)]
            made = dict(zip(joins, self._join([(texts[t], *level[t][k], *level[t][k + 1][1:]) for t, k in joins]), strict=True))
            level = [[(spans[k][0], spans[k + 1][1], made[t, k]) if k + 1 < len(spans) else spans[k] for k in range(0, len(spans), 2)] for t, spans in enumerate(level)]
        return [spans[0][2] for spans in level]

    def _join(self, pairs: list[tuple[str, int, int, list[int], int, list[int]]]) -> list[list[int]]:
        """Each pair: text, start, cut, ids of the left half, end, ids of the right half."""
        out: list[list[int] | None] = [None] * len(pairs)
        wait, reach = list(range(len(pairs))), self.window
        while wait:
            windows = [pairs[k][0][max(pairs[k][1], pairs[k][2] - reach) : min(pairs[k][4], pairs[k][2] + reach)] for k in wait]
            for k, ids in zip(wait, self._ids(windows), strict=True):
                text, start, cut, left, end, right = pairs[k]
                if cut - reach <= start and cut + reach >= end:
                    out[k] = ids  # the window is both halves
                else:
                    out[k] = self._agree(text, start, cut, left, end, right, ids, reach)
            wait, reach = [k for k in wait if out[k] is None], reach * 2
        return out

    def _agree(self, text: str, start: int, cut: int, left: list[int], end: int, right: list[int], ids: list[int], reach: int) -> list[int] | None:
        """The joined ids if the window agrees with both halves. Places are in bytes of what isn't white space, from the cut."""
        width = self.width
        low, high = max(start, cut - reach), min(end, cut + reach)
        begins = -len(SPACES.sub("", text[low:cut]).encode())
        places, at = [], begins
        for i in ids:
            places.append(at)
            at += width[i]
        if low == start:  # the window holds the left half
            head, first = [], 0
        else:
            ends, k, there = {}, len(left), 0
            while k and there > begins + MARGIN:
                k -= 1
                there -= width[left[k]]
                ends[there] = k
            for first, (p, i) in enumerate(zip(places, ids, strict=True)):
                if p >= begins + MARGIN and p < 0 and p in ends and left[ends[p]] == i:
                    head = left[: ends[p]]
                    break
            else:
                return None
        if high == end:
            return head + ids[first:]
        starts, there, most = {}, 0, at
        for k, i in enumerate(right):
            if there >= most:
                break
            starts[there] = k
            there += width[i]
        for last in range(len(ids) - 1, max(first, bisect_left(places, MARGIN)) - 1, -1):
            p = places[last]
            if p >= MARGIN and p in starts and right[starts[p]] == ids[last]:
                return head + ids[first:last] + right[starts[p] :]
        return None


def coder(path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> TreeCoder:
    key = (path, leaf, window)
    if key not in _coders:
        _coders[key] = TreeCoder(*key)
    return _coders[key]


def encode(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> DataFrame:
    """doc_id, ids array<int> of each whole text; a null text is empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = coder(tokenizer_path, leaf, window).encode([t or "" for t in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run, 128), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of rows with `ids`; null ids are none."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = coder(tokenizer_path).decode([x or [] for x in batch.column(1).to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(map_slices(run, 128), "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str, leaf: int = LEAF_CHARS, window: int = WINDOW_CHARS) -> DataFrame:
    """n_tokens and digests of what encode() and decode() give, without carrying the ids out of the task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = coder(tokenizer_path, leaf, window)
        names = names_of(own)
        ids = own.encode([t or "" for t in batch.column(1).to_pylist()])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array([sha(" ".join([names[i] for i in x])) for x in ids], pa.string()), pa.array(map(sha, own.decode(ids)), pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run, 128), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def names_of(own: TreeCoder) -> list[str]:
    if not hasattr(own, "names"):
        own.names = [str(i) for i in range(len(own.width))]
    return own.names


def op1_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and of the text they decode to.

    A null or empty text has no tokens; a very long text is encoded whole, by halves; there are no
    ties, as the merges have an order; repeated rows each have their row; an empty table gives none;
    other columns of the input are not read.
    """
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
