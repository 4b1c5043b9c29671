"""The methods on their own: exactness, growth and hot groups."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from cases import german, prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparsemill.llm import bpe, chunks, components, language, packing, quality, secrets, sharding, simhash, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
AWKWARD = ["a", "b", "the", "'re", "'s", "'", "ll", "é", "é", "İ", " ", "\n", "\x1c", "12", "!", "中文", "<|endoftext|>", "ing", "Σς", "​", "🎉", "ß", "x" * 9]
awkward_text = st.lists(st.sampled_from(AWKWARD), max_size=120).map("".join)


@pytest.fixture(scope="module")
def whole():
    return bpe.TreeCoder(WORDS, leaf=10**9)


@settings(max_examples=300, deadline=None)
@given(awkward_text, st.sampled_from([(8, 1), (16, 2), (33, 4), (64, 8)]))
def test_tree_is_exact(whole, text, sizes):
    assert bpe.coder(WORDS, *sizes).encode([text])[0] == whole.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_tree_is_exact_for_any_text(whole, text):
    assert bpe.coder(WORDS, 16, 2).encode([text])[0] == whole.tokenizer.encode(text, add_special_tokens=False).ids


def test_tree_of_unsplit_text(whole):
    r = random.Random(5)
    for letters in ("ab", "abcdefgh", "thequickbrown", "é中"):
        text = "".join(r.choice(letters) for _ in range(5000))
        assert bpe.coder(WORDS, 256, 8).encode([text])[0] == whole.tokenizer.encode(text, add_special_tokens=False).ids


def test_encode_and_decode_frames(spark, whole):
    texts = ["a cat", None, "", "Ünï <|endoftext|> 'll"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode(df, WORDS)
    ids = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert [ids[k] for k in range(4)] == [whole.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, WORDS).collect()}
    assert [back[k] for k in range(4)] == [whole.tokenizer.decode(ids[k], skip_special_tokens=False) for k in range(4)]


@settings(max_examples=300, deadline=None)
@given(awkward_text)
def test_byte_bpe_is_the_librarys(text):
    own = packing.encoder(BYTES)
    assert own.ids(text).tolist() == own.slow.encode(text, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 500), max_size=40))
@settings(max_examples=200, deadline=None)
def test_plan_places_all(counts):
    plan = packing.pack(counts, 64)
    held = {}
    for copies, lengths in plan.groups:
        assert copies > 0 and sum(n * k for n, k in lengths) <= 64
        for n, k in lengths:
            held[n] = held.get(n, 0) + copies * k
    assert held == {n: c for n, c in counts.items() if c}
    total = sum(n * c for n, c in counts.items())
    assert plan.sequences >= -(-total // 64) and plan.sequences <= 2 * total / 64 + 1


def test_plan_is_tight_and_bounded():
    r = random.Random(1)
    counts = {n: r.randint(0, 10**6) for n in range(1, 600)}
    plan = packing.pack(counts)
    assert plan.sequences <= sum(n * c for n, c in counts.items()) / 1024 * 1.001 + 1
    assert len(plan.groups) < 5000 and len(plan.slots()["length"]) < 50_000
    with pytest.raises(ValueError, match="doesn't fit"):
        packing.pack({2000: 1})


@pytest.mark.parametrize("gap", [1, 2, 7, 12, 30])
def test_complements(gap):
    r = random.Random(gap)
    for _ in range(200):
        avail = np.array([0, *[r.choice([0, 0, 1, 2]) for _ in range(gap)]])
        found = packing.Sums(np.flatnonzero(avail), gap).complement(gap, avail)
        some = any(
            x == gap or any(x + y == gap or any(x + y + z == gap for z in left2) for y, left2 in _each(left1)) for x, left1 in _each([n for n in range(1, gap + 1) for _ in range(avail[n])])
        )
        assert bool(found) == some
        if found:
            assert sum(found) == gap and all(avail[x] >= found.count(x) for x in found)


def _each(items):
    return [(x, items[:k] + items[k + 1 :]) for k, x in enumerate(items)]


def test_local_components():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        a, b = rng.integers(0, n, (2, n // 2))
        label = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b, strict=True):
                label[x] = label[y] = min(label[x], label[y])
        assert components.local_components(n, a, b).tolist() == label


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(3)
    ids = r.sample(range(-(10**12), 10**12), 60)
    edges = {"path": list(zip(ids, ids[1:], strict=False)), "star": [(ids[7], x) for x in ids], "random": [tuple(r.sample(ids, 2)) for _ in range(40)], "none": []}[shape]
    label = {x: x for x in ids}
    for _ in ids:
        for x, y in edges:
            label[x] = label[y] = min(label[x], label[y])
    got = {row["node"]: row["root"] for row in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: y for x, y in label.items() if x != y}


def near(prints, radius):
    return np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius)


def test_bk_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(0, 60, 7)] + [base]))
    shard = rng.integers(0, 3, len(prints))
    forest = simhash.BkForest(prints, shard)
    a, b = forest.search(prints, forest.root[np.unique(shard, return_inverse=True)[1]], 4)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((x, y) for x, y in near(prints, 4).tolist() if shard[x] == shard[y])


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
def test_blocks_lose_no_link(blocks):
    r = random.Random(blocks)
    masks = simhash.masks(blocks)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(flips & m & (2**64 - 1) == 0 for m in masks)


def test_more_blocks_for_more_prints():
    found = [simhash.blocks_for(n) for n in (0, 10**4, 10**6, 10**9, 3 * 10**10)]
    assert found == sorted(found) and found[0] == 5
    for n, b in zip((10**4, 10**6, 10**9, 3 * 10**10), found[1:], strict=True):
        assert n / 2 ** (64 * (b - 4) / b) <= simhash.SHARD_MEAN


def test_links_of_a_dense_group(spark, monkeypatch):
    """A group that is larger than a tree is dealt to several trees and stays whole."""
    monkeypatch.setattr(simhash, "TREE_MOST", 16)
    rng = np.random.default_rng(2)
    centre = 0x0123456789ABCDEF
    prints = sorted({centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (300, 2))} | {int(x) for x in rng.integers(0, 2**63, 50)})
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "print long")
    held = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    arr = np.array(prints, np.uint64)
    x, y = near(arr, 4).T
    order = arr.view(np.int64)
    rank = np.argsort(np.argsort(order))
    label = components.local_components(len(arr), rank[x], rank[y])
    want = {int(order[np.flatnonzero(rank == k)[0]]): int(order[np.flatnonzero(rank == v)[0]]) for k, v in enumerate(label) if k != v}
    assert held == want


def test_gear_hash_is_the_rolling_one():
    data = prose(200, 1).encode()
    h, want = 0, []
    table = chunks.gear_table()
    for b in data:
        h = (2 * h + int(table[b])) % 2**32
        want.append(h)
    assert chunks.gear_hashes(data).tolist() == want


@given(st.binary(max_size=3000))
@settings(max_examples=100, deadline=None)
def test_chunks_cover_the_text(data):
    ends = chunks.boundaries(data)
    sizes = np.diff([0, *ends])
    assert sum(sizes) == len(data) and (sizes <= chunks.MOST).all() and (sizes[:-1] >= chunks.LEAST).all()


def test_chunks_resist_shifts():
    text = prose(3000, 2)
    own = lambda t: chunks.chunk_set(chunks.fingerprint(t.encode()))
    assert chunks.containment(own(text), own("some words before " + text)) > 0.97
    assert chunks.containment(own(text), own(text[:5000] + " inserted " + text[5000:])) > 0.97
    assert chunks.containment(own(text), own(prose(3000, 3))) < 0.05
    assert chunks.containment(set(), set()) == 1 and chunks.containment(own(text), set()) == 0


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(0)
    weigh = lambda s, q, p: sum(s[k][x] for k, x in enumerate(q)) - p * sum(a != b for a, b in zip(q, q[1:], strict=False))
    for _ in range(200):
        s = rng.normal(size=(int(rng.integers(1, 7)), 3)) * 3
        assert np.isclose(weigh(s, language.viterbi(s, 2.0).tolist(), 2.0), max(weigh(s, q, 2.0) for q in product(range(3), repeat=len(s))))


def test_language_spans(spark):
    rows = [(k, (german if k % 2 else prose)(80, k), "de" if k % 2 else "en") for k in range(120)] + [(500 + k, "быть или не быть вот " * 9, "ru") for k in range(9)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    lab = language.Labeller(model)
    a, b = prose(60, 901), german(60, 902)
    spans = lab.spans(f"{a} {b}")
    assert [x for *_, x in spans] == ["en", "de"] and abs(spans[0][1] - 60) <= 2
    assert lab.predict(["быть", "12 !", "漢字"])[0][0] == "ru" and lab.predict(["12 !"])[0] == ("und", 0.0)
    right = [lab.predict([(german if k % 2 else prose)(80, 1000 + k)])[0][0] == ("de" if k % 2 else "en") for k in range(60)]
    assert sum(right) >= 59


def test_quality_needs_no_labels():
    """Faults that seldom come together are all told from good texts."""
    r = random.Random(0)
    patterns, truth = {}, {}
    for _ in range(5000):
        bad = r.random() < 0.15
        fault = r.randrange(3)
        votes = [0] * len(quality.RULES)
        if bad:
            votes[fault], votes[fault + 3], votes[6] = -1, -1, r.choice([-1, 0])
        else:
            votes[6] = 1
            if r.random() < 0.03:
                votes[r.randrange(6)] = -1
        patterns[tuple(votes)] = patterns.get(tuple(votes), 0) + 1
        truth.setdefault(tuple(votes), []).append(bad)
    model = quality.estimate(patterns)
    wrong = sum(sum(x == (model.good(p) >= 0.5) for x in truth[p]) for p in patterns)
    assert wrong <= 25 and abs(model.share[0] - 0.15) < 0.03 and all(model.accuracy(k) > 0.5 for k in range(7))
    assert quality.estimate({}).share == (0.2, 0.8)


def test_quality_main_path_is_native(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = quality.judge(quality.votes(quality.counted(df, [F.col("doc_id")])), quality.estimate({}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_assignment_is_even():
    r = random.Random(4)
    held = {k: (r.randint(50, 150), r.randint(1, 9)) for k in range(1024)}
    placed = sharding.assign(held, 16)
    loads = [sum(held[k][0] for k, (s, _) in placed.items() if s == shard) for shard in range(16)]
    assert max(loads) / min(loads) < 1.02
    for shard in range(16):
        slots = sorted((first, held[k][1]) for k, (s, first) in placed.items() if s == shard)
        assert [f for f, _ in slots] == np.cumsum([0, *[n for _, n in slots][:-1]]).tolist()


def test_hot_text_is_cut(spark):
    """A third of all rows have one text, another third is empty: both are cut by doc_id, other copies stay together."""
    texts = ["hot " * 50] * 3000 + [""] * 3000 + [f"text {k // 2} " * 50 for k in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.materialize(sharding.sized(docs), "sized")
    splitters, held = sharding.ranges(rows, 256)
    total, n = sum(s for s, _ in held.values()), sum(k for _, k in held.values())
    assert max(s for s, _ in held.values()) < 5 * total / 256 and max(k for _, k in held.values()) < 5 * n / 256
    got = sharding.shard(docs).collect()
    sizes = {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert max(sizes.values()) / min(sizes.values()) < 1.05
    of_text = {}
    for r in got:
        of_text.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in of_text.items() if t.startswith("text")) and len(of_text[texts[0]]) > 1


def test_network_gradients():
    net = secrets.Network()
    found = secrets.findings(30)
    codes = np.array([secrets.encode(secrets.codes_of(f.text), f.start, f.end) for f in found])
    labels = np.array([f.secret for f in found], float)
    loss = lambda: np.mean(np.log1p(np.exp(-np.where(labels == 1, 1, -1) * net.logits(codes))))
    for name, g in net._gradients(codes, labels).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        held, ends = net.p[name][at], []
        for d in (1e-5, -1e-5):
            net.p[name][at] = held + d
            ends.append(loss())
        net.p[name][at] = held
        assert np.isclose((ends[0] - ends[1]) / 2e-5, g[at], rtol=1e-3, atol=1e-8)


def test_network_on_findings_it_has_not_seen():
    net = secrets.trained()
    found = secrets.findings(2000, seed=99)
    p = net.probability(np.array([secrets.encode(secrets.codes_of(f.text), f.start, f.end) for f in found])) >= net.threshold
    labels = np.array([f.secret for f in found])
    assert p[labels].mean() >= 0.95 and p[~labels].mean() <= 0.05


def test_secrets_beyond_the_base():
    net = secrets.trained()
    key = "ghp_" + "a8Kd93jfLw0Zx7Qm2Vb5Tn1Yc4Re6Us"
    texts = [f"the key is {key} here", "https://example.com/some/long/path/to/a/page/2024", "postgres://admin:s3cr3tpw99@host/db", "nothing at all"]
    got = [[(secrets.KINDS[k], t[s:e]) for s, k, e, _ in spans] for t, spans in zip(texts, secrets.scan(texts, net), strict=True)]
    assert got[0] == [("token", key)] and got[1] == [] and got[3] == []
    assert secrets.masked("a SECRET b SECRET2", [(2, 0, 8, 1.0), (4, 1, 7, 1.0), (11, 0, 18, 1.0)]) == "a [secret] b [secret]"


def test_composition_is_the_product():
    a, b = toxicity.within(toxicity.NEGATION, 2, 0.5), toxicity.between_quotes(0.1)
    both = a.compose(b)
    r = random.Random(0)
    x = y = z = 0
    for _ in range(500):
        c = r.randrange(toxicity.CLASSES)
        (x, f), (y, g), (z, h) = a.step(x, c), b.step(y, c), both.step(z, c)
        assert z == x * b.states + y and np.isclose(h, f * g)


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(0)
    docs, labels = [], []
    for k in range(900):
        words, toxic = prose(60, k).split(), k % 5 == 0
        for _ in range(4 if toxic else 0):
            words.insert(r.randrange(60), r.choice(["zzidiot", "zzscum", "qqstem" + r.choice("abc")]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    found = {x["doc_id"]: x["score"] for x in toxicity.score(df, model).where(toxicity.crc_mod(F.col("doc_id"), 3) == 1).collect()}
    assert all((s >= 0.7) == (k % 5 == 0) for k, s in found.items()) and len(found) > 200


def test_personal_data_in_random_texts(spark):
    import re

    from sparsemill.llm import pii

    r = random.Random(3)
    parts = ["a@b.c", "@", ".", "..", "1", "22", "255", "256", "0001", "+", "+1", " ", "-", "(", ")", "x%y@z-1.q", "é", "🎉", "4111111111111111", "4111 1111 1111 1111", "+1 (319) 555-5132", "10.0.0.1", "a.b@c.d@e.f", "\n", "A", "DE89370400440532013000", "ssn 123-45-6789"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    valid = {
        "email": lambda m: True, "ip": lambda m: all(int(x) < 256 for x in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[ -]", "", m)) <= 19 and luhn(d), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(df, ["doc_id"]).collect():
        text = texts[row["doc_id"]]
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS[:4]) for m in re.finditer(kind.pattern, text, re.ASCII) if valid[kind.name](m[0]))
        assert [(s["start"], s["kind"], s["end"]) for s in row["spans"] if s["kind"] < 4] == want, text
        assert all(text[s["start"] : s["end"]] == s["hit"] and 0 < s["score"] <= 1 for s in row["spans"])


def test_bank_accounts_and_context(spark):
    from sparsemill.llm import pii

    texts = ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789", "part 123-45-6789"]
    texts += ["DE89370400440532013000 Danke", "DE89 3704 0044 0532 0130 00 Bitte 7 EUR", "DE89370400440532013000 BICCODE12", "ssn " + "1-2-3 " * 6 + "123-45-6789", "ssn " + "1-2-3 " * 7 + "123-45-6789"]
    found = {r["doc_id"]: [(pii.KINDS[s["kind"]].name, s["hit"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ["doc_id"]).collect()}
    assert found == {0: [("iban", texts[0])], 1: [], 2: [("ssn", "123-45-6789")], 3: []} | {k: [("iban", t[: 27 if " 3704" in t else 22])] for k, t in enumerate(texts[4:7], 4)} | {7: [("ssn", "123-45-6789")], 8: []}


def test_running_sums(spark):
    from sparsemill.llm import pii

    lists = [[1], [3, 4, 5], list(range(1, 50)), [7] * 1000]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    for r in df.select("x", pii.running(F.col("x")).alias("s")).collect():
        assert r["s"] == np.cumsum([0, *r["x"][:-1]]).tolist()


def test_repeated_words_in_random_texts(spark):
    r = random.Random(9)
    texts = [[r.choice("abcdefgh"[: r.randint(1, 8)]) for _ in range(r.randint(0, 60))] for _ in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, w array<string>")
    for row in df.select("k", quality.repeated_words(F.col("w")).alias("n")).collect():
        words, at = texts[row["k"]], {}
        for i in range(len(words) - 7):
            at.setdefault(tuple(words[i : i + 8]), []).append(i)
        assert row["n"] == len({i + j for x in at.values() if len(x) > 1 for i in x for j in range(8)}), words


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWord", "api_key", "apikey", "token", "secret", "=", ":", " ", '"', "'", "a", "Z9", "deadbeef", "0af9" * 8, "AKIA", "ABCDEF123456", "ſecret", ".", "é", "\n", "-----BEGIN", "://u:pw1234@"]), max_size=25).map("".join))
def test_base_secrets_in_random_texts(text):
    import re

    plain = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    plain += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    plain += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    assert secrets.base_spans(text) == plain
    for start, kind, end in secrets.added_candidates(text, plain):
        assert kind > 2 and not any(s < end and start < e for s, _, e in plain)
