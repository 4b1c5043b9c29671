"""Best-fit packing of tokenised documents by exact-complement hashing.

The plan is made on the histogram of piece lengths, which has at most `capacity` entries however
large the corpus is. Sums of one, two and three lengths are indexed once (`Sums`); the combination
that exactly fills the gap of the longest waiting piece is looked up there and consumed as often as
its lengths are available, and what no combination fills is placed best-fit. The plan says, for the
r-th piece of each length, which sequence and offset it takes; pieces learn their rank from counts
by bucket and length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_slices, materialize

CAPACITY = 1024
END_ID = 2
#: Pieces in a bucket of the ranking, on average.
BUCKET_ROWS = 20_000
LEAST_BUCKETS = 256

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

#: Characters of a text that are encoded at once, where its words allow it; a word is never cut.
PART_CHARS = 1 << 20

_encoders: dict[str, object] = {}


class ByteBpe:
    """Ids of whole texts as the tokenizers library gives them for a byte-level BPE file.

    Texts of the letters and marks in PLAIN go through tiktoken with the same vocabulary, which is
    faster; both libraries split those alike. Any other text goes through tokenizers itself, and so
    does white space so long that tiktoken's pattern gives up on it. A long text goes in parts that
    end where a letter or digit comes before a blank: no word goes over such a place.
    """

    #: ASCII, Latin letters and common punctuation, where both libraries' Unicode tables agree.
    PLAIN = r"[\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧€]*"
    SPECIAL = "<|endoftext|>"
    LONG_SPACE = r"\s{2000}"
    BREAK = r"(?<=[^\W_]) "

    def __init__(self, path: str):
        import json
        import re

        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in byte_letters().items()}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token != self.SPECIAL}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # the split of byte-level BPE, a fixed value
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        self.plain, self.long_space, self.break_ = map(re.compile, (self.PLAIN, self.LONG_SPACE, self.BREAK))

    @cached_property
    def slow(self):
        """The tokenizers library's, loaded when a text needs it: many workers never do."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.no_truncation()
        found.no_padding()
        return found

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= PART_CHARS:
            return self._part(text)
        return np.concatenate([self._part(p) for p in self.parts(text)])

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PART_CHARS and (found := self.break_.search(text, at + PART_CHARS)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def _part(self, text: str) -> np.ndarray:
        if self.SPECIAL not in text and self.plain.fullmatch(text) and not self.long_space.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self.slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others for 256, 257, ..."""
    own = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> ByteBpe:
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all of `capacity` but the first, which has the rest."""
    first = (n - 1) % capacity + 1 if n else 0
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: its ids' place, number and checksum. A null text is empty: one piece, the end id."""

    def slice_pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe, cols = encoder(tokenizer_path), ([], [], [], [], [])
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(bpe.ids(text or ""), np.uint32(END_ID)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(ids), capacity)):
                for col, v in zip(cols, (doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                    col.append(v)
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(slice_pieces), PIECES)


@dataclass
class Plan:
    """Where the pieces of each length go. A group is `copies` sequences with the same lengths, as (length, repeats) in order."""

    capacity: int
    groups: list[tuple[int, list[tuple[int, int]]]] = field(default_factory=list)

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.groups)

    def slots(self) -> dict[str, np.ndarray]:
        """For each (group, length): from rank `first` on, `repeats` pieces in a row share a sequence. Sorted by length, then rank."""
        used, base, rows = [0] * (self.capacity + 1), 0, []
        for copies, lengths in self.groups:
            offset = 0
            for length, repeats in lengths:
                rows.append((length, used[length], base, offset, repeats))
                used[length] += copies * repeats
                offset += length * repeats
            base += copies
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return dict(zip(("length", "first", "base", "offset", "repeats"), table.T, strict=True))


class Sums:
    """Which lengths make each sum: pairs[s] has the smaller of two lengths with the sum s, triples[s] the greatest of three.

    Made once of all lengths that occur; whether they are still there is looked up in the counts.
    """

    def __init__(self, have: np.ndarray, capacity: int):
        there = np.zeros(capacity + 1, bool)
        there[have] = True
        self.pairs = [have[(2 * have <= s) & there[np.maximum(s - have, 0)]] for s in range(capacity + 1)]
        paired = np.array([p.size > 0 for p in self.pairs])
        self.triples = [have[(have < s) & paired[np.maximum(s - have, 0)]][::-1] for s in range(capacity + 1)]

    def pair(self, total: int, avail: np.ndarray, even: bool) -> list[int] | None:
        """Two available lengths: the most alike if `even`, else the least."""
        low = self.pairs[total]
        good = low[(avail[low] > 0) & (avail[total - low] > 0) & ((low * 2 != total) | (avail[low] > 1))]
        if not good.size:
            return None
        chosen = int(good[-1] if even else good[0])
        return [total - chosen, chosen]

    def complement(self, gap: int, avail: np.ndarray, most: int = 3, even: bool = True) -> list[int] | None:
        """Up to `most` (one, two or three) available lengths whose sum is `gap`."""
        if gap < 1:
            return None
        if avail[gap]:
            return [gap]
        if most < 2:
            return None
        if found := self.pair(gap, avail, even):
            return found
        for a in self.triples[gap] if most > 2 else ():
            if avail[a]:
                avail[a] -= 1
                found = self.pair(int(gap - a), avail, even)
                avail[a] += 1
                if found:
                    return [int(a), *found]
        return None


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for counts[length] pieces of each length: single complements, then pairs, then triples, longest openers first, and best fit for the rest.

    Complements of many short lengths use up what would fill other gaps, which tells where there
    are few pieces. So the plan is made with complements of up to one, two and three lengths, like
    or unlike, and the one with the fewest sequences counts; each takes milliseconds.
    """
    for length in counts:
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit into {capacity}")
    sums = Sums(np.array(sorted(length for length, n in counts.items() if n), np.int64), capacity)
    plans = (_pack(counts, capacity, sums, most, even) for most, even in ((1, True), (2, True), (2, False), (3, True), (3, False)))
    return min(plans, key=lambda p: p.sequences)


def _pack(counts: dict[int, int], capacity: int, sums: Sums, most: int, even: bool) -> Plan:
    avail = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        avail[length] += n
    plan = Plan(capacity)
    if avail[capacity]:
        plan.groups.append((int(avail[capacity]), [(capacity, 1)]))
        avail[capacity] = 0
    for up_to in range(1, most + 1):
        for opener in range(capacity - 1, 0, -1):
            while avail[opener]:
                avail[opener] -= 1
                found = sums.complement(capacity - opener, avail, up_to, even)
                avail[opener] += 1
                if not found:
                    break
                need = dict(zip(*np.unique([opener, *found], return_counts=True), strict=True))
                copies = int(min(avail[a] // k for a, k in need.items()))
                for a, k in need.items():
                    avail[a] -= copies * k
                plan.groups.append((copies, [(int(a), int(k)) for a, k in sorted(need.items(), reverse=True)]))
    _best_fit(avail, plan)
    return plan


def _best_fit(avail: np.ndarray, plan: Plan) -> None:
    """Place what is left, longest first, each piece where the least room stays. Open sequences of equal content are one group."""
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(plan.capacity, 0, -1):
        left = int(avail[length])
        while left:
            gap = min((g for g in room if g >= length), default=None)
            if gap is None:
                each = min(left, plan.capacity // length)
                copies = left // each
                room.setdefault(plan.capacity - each * length, []).append((copies, [(length, each)]))
                left -= copies * each
                continue
            copies, held = room[gap].pop()
            if not room[gap]:
                del room[gap]
            each = min(left, gap // length)
            take = min(copies, left // each)
            if take < copies:
                room.setdefault(gap, []).append((copies - take, held))
            room.setdefault(gap - each * length, []).append((take, [*held, (length, each)]))
            left -= take * each
    plan.groups += [group for gap in sorted(room) for group in room[gap]]


def place(ranked: DataFrame, plan: Plan) -> DataFrame:
    """sequence_id and offset of pieces with a `rank` within their length. What goes to the tasks is the plan: a few thousand slots."""
    slots = plan.slots()
    edges = np.searchsorted(slots["length"], np.arange(plan.capacity + 2))
    span = int(slots["first"].max(initial=0)) + 1
    key = slots["length"] * span + slots["first"]
    out = [f.name for f in ranked.schema if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"

    def slice_place(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
        at = np.searchsorted(key, length * span + np.minimum(rank, span - 1), "right") - 1
        at = np.clip(at, edges[length], edges[length + 1] - 1)
        step = rank - slots["first"][at]
        repeats = slots["repeats"][at]
        new = [pa.array(slots["base"][at] + step // repeats), pa.array(slots["offset"][at] + length * (step % repeats))]
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in out] + new, [*out, "sequence_id", "offset"])

    return ranked.mapInArrow(map_slices(slice_place, 100_000), schema)


def pack_pieces(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack rows with a `length`, (doc_id, piece) and a checksum into sequences; returns them with sequence_id and offset.

    Ranks within a length come from the counts of (bucket, length), a bucket being a hash of the
    place at which the piece was written: no task sees all the pieces of one length, however
    frequent it is, and be they copies of one row. Only the histogram of lengths, at most `capacity`
    rows, comes to the driver.
    """
    held = materialize(cut_pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(LEAST_BUCKETS, sum(counts.values()) // BUCKET_ROWS)
    held = held.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("bucket", "length").agg(F.count("*").alias("n")).select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    local = F.row_number().over(Window.partitionBy("bucket", "length").orderBy("place"))
    ranked = held.withColumn("local", local).join(offsets, ["bucket", "length"]).withColumn("rank", F.col("earlier") + F.col("local") - 1)
    return place(ranked.select(*[f.name for f in cut_pieces.schema], "rank"), pack(counts, capacity))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, a row for each piece.

    A null or empty text is one piece with the end id alone; a very long text is encoded whole, in
    parts of about a million characters that end between words, and cut into pieces from its end;
    pieces of equal length take their places in the order in which they were written; repeated rows
    are packed each; an empty table gives no rows; other columns of the input are not read.
    """
    import public_tokenizers

    return pack_pieces(pieces(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
