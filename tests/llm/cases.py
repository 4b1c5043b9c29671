"""Documents that are awkward, and tables of them."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq

#: Columns besides those of documents, with names that operators use themselves.
CLASHES = ("_part", "_row", "_text", "_votes", "_words", "base", "bucket", "fingerprint", "kept", "key", "length", "lang_pred", "n", "n_words", "piece", "print", "score", "shard", "size", "spans", "votes")
NAMES = ("doc_id", "text", "lang", "source", "n_chars")


def prose(words: int, seed: int, stems=("the", "and", "re", "ti", "on", "er", "ha", "st", "en", "ing")) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(stems) for _ in range(r.randint(1, 4))) for _ in range(words))


def german(words: int, seed: int) -> str:
    return prose(words, seed, ("sch", "ung", "keit", "der", "ä", "über", "ein", "lich", "ß", "ge"))


def documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): prose, copies, nulls, empty and very long texts, repeated rows and a row without an id."""
    texts: list[str | None] = [None, "", " \n\t ", "12 34 !!", "x" * 60_000, "ab1" * 20_000, prose(30_000, 1), "word " * 5_000, "🎉 中文 é İ ß Σς <|endoftext|> 'll", "one two three", "line\n" * 300]
    texts += [prose(120, k) for k in range(2, 30)] + [german(120, k) for k in range(2, 16)]
    texts += [texts[12]] * 3 + [texts[12] + " end", "y " + texts[12]]
    texts += [f"Contact a.b@mail.example.com or +1 (319) 555-5132, card 4111 1111 1111 1111, host 10.0.0.{k}, password=hunter2hunter2 AKIA{'A1B2' * 4} {'0af9' * 9} " + prose(40, k) for k in range(3)]
    rows = [(k, t, ("de" if t and "ung" in t else "en") if k % 5 else None, f"src{k % 3}" if k % 4 else None, len(t) if t else None) for k, t in enumerate(texts)]
    return [*rows, rows[13], rows[13], (None, texts[14], "en", None, None)]


def write(rows: list[tuple], folder, clashes: bool = True, labels: list[tuple] | None = None) -> str:
    """The tables as Parquet below `folder`, which is returned."""
    extra = CLASHES if clashes else ()
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    data = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)] + [pa.array(["?"] * len(rows), pa.string()) for _ in extra]
    pq.write_table(pa.table(data, names=[*NAMES, *extra]), f"{folder}/documents.parquet", row_group_size=20)
    labels = labels if labels is not None else [(r[0], 1, int(k % 7 == 0)) for k, r in enumerate(rows) if k % 2] + [(None, None, None)]
    pq.write_table(pa.table([pa.array([x[k] for x in labels], pa.int64()) for k in range(3)], names=["doc_id", "quality", "toxic"]), f"{folder}/labels.parquet")
    return str(folder)
