"""Personal data in texts, with DataFrame functions only.

A regular expression for each kind proposes spans, a validator confirms each - Luhn's sum for
cards, the remainder of 97 for bank accounts, the range of each part for addresses - and words
nearby raise its score. The kinds that the base rules name stay whatever their score; the kinds
that are added here stay if their score is high enough.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let

#: Code points before a span in which a context word counts, what it adds, and the score that an added kind needs.
CONTEXT_CHARS = 40
CONTEXT_ADDS = 0.25
KEEP_FROM = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # as other engines have it too
    check: Callable[[Column], Column]
    certainty: float
    context: str
    only_if: str  # a text without a match of this has none of the pattern
    base: bool = True
    java: str = ""  # a form that takes linear time and finds the same


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def letters_of(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def luhn(number: Column) -> Column:
    """Whether the last digit of a string of digits is right: from the right, each second digit counts double, less 9 if over 9."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(letters_of(F.reverse(number)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number leaves 1 after division by 97, its first four characters last and A as 10."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    step = lambda r, c: F.when(c.between("0", "9"), r * 10 + F.ascii(c) - 48).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(letters_of(turned), F.lit(0), step) == 1


def card(hit: Column) -> Column:
    number = digits_of(hit)
    return F.length(number).between(12, 19) & let(number, luhn)


def bank_account(hit: Column) -> Column:
    return let(F.regexp_replace(hit, " ", ""), mod97)


# The lengths of international bank account numbers and the countries that use them.
ACCOUNT_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: As many characters as the country's accounts have, whatever follows.
ACCOUNT = "|".join(f"({c.replace(' ', '|')})[0-9][0-9](\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in ACCOUNT_LENGTHS.items())


KINDS = (
    Kind(
        "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda _: F.lit(True), 0.9, "mail|contact|write", "@",
        java=r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    ),
    Kind(
        "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: h.rlike(r"^(0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(\.|$)){4}$"), 0.6, "address|host|server|ip", r"[0-9]\.[0-9]",
        java=r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    ),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", card, 0.8, "card|visa|credit|payment", "[0-9]", java=r"[0-9](?:[\x20-]?[0-9])++"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: F.length(digits_of(h)).between(9, 15), 0.7, "phone|tel|call|mobile|fax", r"\+[0-9]"),
    Kind("iban", ACCOUNT, bank_account, 0.8, "iban|account|bank|konto|compte|cuenta", r"[A-Z][A-Z][0-9][0-9]", base=False),
    Kind("ssn", r"[0-9]+-[0-9]+-[0-9]+", lambda h: h.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), 0.3, "ssn|social security", "[0-9]-[0-9]", base=False, java=r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++"),
)


#: Elements that are summed in one fold, which copies what it has so far, and how often blocks are made of the blocks' sums.
FOLDED, LEVELS = 64, 2


def running(values: Column, levels: int = LEVELS) -> Column:
    """The sum of the integers before each one: within blocks, to which the running sum of the blocks' sums is added."""
    start = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    fold = lambda block, at: F.aggregate(block, start(at), lambda a, x: F.struct((a["at"] + x).cast("int").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    if levels == 0:
        return fold(values, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / FOLDED).cast("int")), lambda k: F.slice(values, k * FOLDED + 1, FOLDED))
    totals = lambda b: F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda s, v: s + v))
    return let(blocks, lambda b: F.flatten(F.zip_with(b, let(totals(b), lambda t: running(t, levels - 1)), fold)))


SPANS = "array<struct<start:int,kind:int,end:int,hit:string,before:string>>"
#: A match has this many characters at least, so that so many matches and what lies between them hold a whole context.
LEAST_HIT = 2


def proposed(text: Column, which: int, kind: Kind) -> Column:
    """The valid spans of one kind, in code points, and the characters before each.

    Places come from the lengths of the matches and of what lies between them, and so does the
    context: a text is gone through once, however many matches it has.
    """
    pattern = kind.java or kind.pattern
    none = F.array().cast(SPANS)
    last = lambda x: F.substring(x, -CONTEXT_CHARS, CONTEXT_CHARS)

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), F.lit(1), F.size(hits))
        # what comes before a match is the end of the gap, and the ends of the matches and gaps before it where the gap is short
        parts = F.zip_with(hits, gaps, lambda h, g: F.struct(h.alias("hit"), F.length(g).alias("gap"), F.length(h).alias("len"), last(g).alias("lead"), last(F.concat(last(g), h)).alias("tail")))

        def spans(p: Column) -> Column:
            ends = let(F.transform(p, lambda x: x["gap"] + x["len"]), lambda v: running(v))
            at = lambda x, b: (b + x["gap"]).cast("int")
            put = F.zip_with(p, ends, lambda x, b: F.struct(at(x, b).alias("start"), (at(x, b) + x["len"]).cast("int").alias("end"), x["hit"].alias("hit"), x["lead"].alias("lead")))
            numbered = F.filter(F.transform(put, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: kind.check(y["x"]["hit"]))
            back = lambda i: F.slice(p, F.greatest(i - CONTEXT_CHARS // LEAST_HIT, F.lit(0)) + 1, F.least(i, F.lit(CONTEXT_CHARS // LEAST_HIT)))
            context = lambda y: F.when(F.length(y["x"]["lead"]) == CONTEXT_CHARS, y["x"]["lead"]).otherwise(last(F.concat(F.array_join(F.transform(back(y["i"]), lambda z: z["tail"]), ""), y["x"]["lead"])))
            return F.transform(numbered, lambda y: F.struct(y["x"]["start"].alias("start"), F.lit(which).alias("kind"), y["x"]["end"].alias("end"), y["x"]["hit"].alias("hit"), context(y).alias("before")))

        return let(parts, spans)

    hits = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda h: F.when(F.size(h) == 0, none).otherwise(placed(h)))
    return F.when(text.rlike(kind.only_if), hits).otherwise(none)


def score(span: Column) -> Column:
    """The kind's certainty, more with a context word shortly before the span; at most 1."""
    before = F.lower(span["before"])
    of_kind = lambda value: F.element_at(F.array(*[F.lit(value(k)) for k in KINDS]), span["kind"] + 1)
    near = F.coalesce(*[F.when((span["kind"] == k) & before.rlike(kind.context), CONTEXT_ADDS) for k, kind in enumerate(KINDS)], F.lit(0.0))
    return F.least(F.lit(1.0), F.round(of_kind(lambda k: k.certainty) + near, 2))


def find(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `spans`: (start, kind, end, hit, score) of all spans that stay, by start, kind and end."""
    text = F.col("_text")
    named = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kinds = named.select(*keep, *[proposed(text, k, kind).alias(f"_kind{k}") for k, kind in enumerate(KINDS)])
    every = F.array_sort(F.concat(*[F.col(f"_kind{k}") for k in range(len(KINDS))]))
    scored = F.transform(every, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "kind", "end", "hit")], score(s).alias("score")))
    base = [k for k, kind in enumerate(KINDS) if kind.base]
    return kinds.select(*keep, F.filter(scored, lambda s: s["kind"].isin(base) | (s["score"] >= KEEP_FROM)).alias("spans"))


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document.

    A null or empty text has none; a very long text is read whole, in time that follows its length
    and its spans; spans of several kinds that begin at one place go in the order of the kinds;
    repeated rows each have their row; an empty table gives none; other columns of the input are not
    read. `n_spans` counts all spans, those of the added kinds too.
    """
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k].name}")
    base = F.filter(spans, lambda s: s["kind"] < sum(k.base for k in KINDS))
    return find(documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]).select(
        "doc_id", *map(count, range(4)), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), F.size(spans).cast("long").alias("n_spans"), F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    )


def _oracle() -> str:
    found = " UNION ALL ".join(
        f"SELECT rid, text, {k} AS kind, '{kind.name}' AS name, unnest(generate_series(1, len(hits))) AS i, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, {kind.certainty}::DOUBLE AS certainty, '{kind.context}' AS context"
        f" FROM (SELECT rid, text, regexp_extract_all(text, '{kind.pattern}') AS hits, regexp_split_to_array(text, '{kind.pattern}') AS gaps FROM docs WHERE regexp_matches(text, '{kind.only_if}'))"
        for k, kind in enumerate(KINDS)
    )
    digits = "regexp_replace(hit, '[^0-9]', '', 'g')"
    account = "replace(hit, ' ', '')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({found}),
placed AS (SELECT *, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM found),
checked AS (
  SELECT *, stop - length(hit) AS start FROM placed WHERE CASE name
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(hit, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INTEGER), 0) <= 255))
    WHEN 'card' THEN length({digits}) BETWEEN 12 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INTEGER WHEN c::INTEGER > 4 THEN 2 * c::INTEGER - 9 ELSE 2 * c::INTEGER END)) % 10 = 0
    WHEN 'phone' THEN length({digits}) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split({account}[5:] || {account}[:4], ''), lambda c: ascii(c))), lambda r, c: CASE WHEN c < 58 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1
    ELSE regexp_full_match(hit, '[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]') END),
scored AS (SELECT *, least(1.0, round(certainty + CASE WHEN regexp_matches(lower(text[greatest(start - {CONTEXT_CHARS}, 0) + 1:start]), context) THEN {CONTEXT_ADDS} ELSE 0 END, 2))::DOUBLE AS score FROM checked),
kept AS (SELECT *, concat_ws(':', name, start, stop) AS span FROM scored WHERE kind < 4 OR score >= {KEEP_FROM}),
listed AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k].name}" for k in range(4))},
    string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 4) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans, count(*) AS n_spans, string_agg(printf('%.2f', score), ',' ORDER BY start, kind) AS scores FROM kept GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k].name}, 0) AS n_{KINDS[k].name}" for k in range(4))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN listed USING (rid)"""


ORACLE = _oracle()
