"""SimHash near-duplicates with BK-trees.

Equal fingerprints are one node. Two fingerprints that differ in at most `radius` of 64 bits agree
on all bits of some of the blocks that the bits are cut into, so each choice of blocks makes
shards - the fingerprints that agree there - and any link lies within a shard. Each shard is a
BK-tree: a node's children are keyed by their Hamming distance to it, and a search follows the
edges within the radius only. More blocks are taken as the corpus grows, which keeps shards small.
The trees of a task are built and searched level by level in arrays.

A shard that is large all the same, as for near copies of one text, is cut by the blocks of another
division of the bits, on one of which any link in it agrees, and so once more. What is still large is
dealt to trees that share the fingerprints nearest to the shard's centre, which link most of it;
then only fingerprints that aren't linked to the most of the shard go through all its trees. So a
tree has a bounded size, its searches are dealt to tasks in bounded numbers, and no link is lost.

The trees go to the tasks with the searches, by a shuffle on the shard, and not by broadcast: all
trees together are the fingerprints of all documents, which must not come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, map_slices, materialize
from .components import components, local_components, with_least

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints of a shard on average, at most, and of a tree, and those that trees of one shard share.
SHARD_MEAN = 64
TREE_MOST = 1024
HUBS = 1024
#: Searches of a tree in one task, and how often large shards are cut by further bits.
SEEKERS = 4096
CUTS = 2
#: A list of large shards with so many rows at most is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 100_000
#: Rows whose trees a task holds at once, searches that run together, and nodes that these visit together.
ROWS_AT_ONCE, SEARCHES_AT_ONCE, VISITS_AT_ONCE = 50_000, 1024, 100_000


def fingerprint(raw: bytes, words_each: int = SHINGLE_WORDS) -> int:
    """The majority of each bit over the hashes of all shingles of a UTF-8 text; zero without words."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split()  # of bytes: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    each = min(words_each, len(words))
    spans = zip(starts[: len(words) - each + 1].tolist(), ends[each - 1 :].tolist(), strict=True)
    hashes = np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, print long (the fingerprint's 64 bits). A null text has no words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t or b"", words_each) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "print"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run), "doc_id long, print long")


class BkForest:
    """A BK-tree for each shard. Node k is prints[k]; child[k, d] is the node below it at distance d, or -1."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray):
        self.prints = prints
        self.child = np.full((len(prints), 65), -1, np.int32)
        _, first, which = np.unique(shard, return_index=True, return_inverse=True)
        self.root = first  # by the shard's place in order
        at = first[which].astype(np.int32)
        rest = np.flatnonzero(at != np.arange(len(prints))).astype(np.int32)
        flat = self.child.reshape(-1)
        while rest.size:
            key = at[rest].astype(np.int64) * 65 + np.bitwise_count(prints[rest] ^ prints[at[rest]])
            free = flat[key] < 0
            taken, who = np.unique(key[free], return_index=True)
            flat[taken] = rest[free][who]
            at[rest] = flat[key]
            rest = rest[at[rest] != rest]

    def search(self, prints: np.ndarray, root: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in `prints`, node) within the radius, each searched from its root.

        Searches go level by level; a level of too many is halved, and one half waits, so that
        memory doesn't follow the density of the trees.
        """
        near, around = ([], []), np.arange(-radius, radius + 1)
        waiting = [(np.arange(len(prints)), root)]
        while waiting:
            who, node = waiting.pop()
            if len(who) > VISITS_AT_ONCE:
                half = len(who) // 2
                waiting += [(who[half:], node[half:]), (who[:half], node[:half])]
                continue
            d = np.bitwise_count(prints[who] ^ self.prints[node]).astype(np.int64)
            near[0].append(who[d <= radius])
            near[1].append(node[d <= radius])
            edge = d[:, None] + around
            below = np.where((edge >= 0) & (edge <= 64), self.child[node[:, None], np.clip(edge, 0, 64)], -1)
            row, col = np.nonzero(below >= 0)
            if row.size:
                waiting.append((who[row], below[row, col]))
        return tuple(np.concatenate(x) for x in near)


def blocks_for(n: int, radius: int = RADIUS) -> int:
    """Blocks to cut 64 bits into, so that the shards of n fingerprints hold SHARD_MEAN on average at most."""
    blocks = radius + 1
    while blocks < 4 * (radius + 1) and n / 2 ** (64 * (blocks - radius) / blocks) > SHARD_MEAN:
        blocks += 1
    return blocks


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """For each choice of blocks - radius blocks, the mask of their bits, as signed longs."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    bits = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    found = [sum(bits[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def division(level: int, radius: int = RADIUS) -> list[int]:
    """The masks of radius + 1 blocks of another division of the 64 bits for each level."""
    order = np.random.default_rng([SEED, level]).permutation(64)
    found = [sum(1 << int(b) for b in block) for block in np.array_split(order, radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


#: What a row is to its tree: one of its nodes, a search, or both.
NODE, SEEKER, BOTH = 1, 2, 3


def _linked(radius: int, rows: int = ROWS_AT_ONCE):
    """For rows (shard, print, role) that are sorted by shard: a star of links for each component within a shard's tree."""

    def links(shard: np.ndarray, prints: np.ndarray, role: np.ndarray) -> pa.RecordBatch:
        nodes = np.flatnonzero(role & NODE)
        if not nodes.size:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"])
        forest = BkForest(prints[nodes], shard[nodes])
        roots = shard[nodes][forest.root]
        own = np.minimum(np.searchsorted(roots, shard), len(roots) - 1)
        seeks = (role & SEEKER > 0) & (roots[own] == shard)
        label = np.arange(len(shard))
        for k in range(0, len(shard), SEARCHES_AT_ONCE):  # what is found joins components at once, as a dense tree finds very many pairs
            who = k + np.flatnonzero(seeks[k : k + SEARCHES_AT_ONCE])
            x, y = forest.search(prints[who], forest.root[own[who]], radius)
            a, b = label[who[x]], label[nodes[y]]
            if (a != b).any():
                label = local_components(len(shard), a, b)[label]
        far = np.flatnonzero(label != np.arange(len(shard)))
        return pa.RecordBatch.from_arrays([pa.array(prints[far].view(np.int64)), pa.array(prints[label[far]].view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)))
            if sum(len(x[0]) for x in held) >= rows:
                shard, prints, role = (np.concatenate(x) for x in zip(*held, strict=True))
                if full := int(np.searchsorted(shard, shard[-1])):  # the last shard may go on
                    yield links(shard[:full], prints[:full].view(np.uint64), role[:full])
                held = [(shard[full:], prints[full:], role[full:])]
        if held:
            shard, prints, role = (np.concatenate(x) for x in zip(*held, strict=True))
            yield links(shard, prints.view(np.uint64), role)

    return run


def _trees(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v) within the trees of `rows` (shard, print, role)."""
    # sorted by print too: a task that is run again makes the same stars
    return rows.select("shard", "print", F.col("role").cast("int")).repartition("shard").sortWithinPartitions("shard", "print").mapInArrow(_linked(radius), "u long, v long")


def _small(rows: DataFrame) -> DataFrame:
    """`rows` (a written table) to be broadcast if its size, which is looked up, allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _shards(prints: DataFrame, masks_: list[int], *within: str) -> DataFrame:
    """A row of each fingerprint for each mask: the shard of those that agree there (and in the columns `within`)."""
    bits = F.array(*[F.struct(F.lit(k).alias("t"), F.col("print").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks_)])
    return prints.select(*within, "print", F.explode(bits).alias("c")).select(F.xxhash64(*within, "c.t", "c.bits").alias("shard"), "print")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column print) within the radius of each other: at most one a row, tree and shard."""
    placed = _shards(nodes, masks(blocks_for(nodes.count(), radius), radius))
    found = None
    for level in range(CUTS + 1):
        large = materialize(placed.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > TREE_MOST), "large")
        none = large.isEmpty()
        rest = placed if none else placed.join(_small(large.select("shard")), "shard", "left_anti")
        made = _trees(rest.withColumn("role", F.lit(BOTH)), radius)
        found = made if found is None else found.unionByName(made)
        if none:
            return found
        placed = placed.join(_small(large), "shard")
        if level < CUTS:
            placed = materialize(_shards(placed, division(level, radius), "shard"), "cut")
    return _large_links(materialize(placed, "large-shards"), materialize(found, "links"), radius)


def _large_links(placed: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """`found` and the links within large shards (shard, print, n)."""
    placed = placed.withColumn("trees", F.ceil(F.col("n") / TREE_MOST).cast("int"))
    own = F.pmod(F.xxhash64("print", F.lit(1)), F.col("trees")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    keyed = lambda rows, role, *at: rows.select(F.xxhash64("shard", *at).alias("shard"), "print", F.lit(role).alias("role") if isinstance(role, int) else role)

    dealt = placed.withColumn("tree", own)
    hubs = _hubs(placed).withColumn("tree", F.explode(every("trees"))).where(F.col("tree") != own)
    near = materialize(_trees(keyed(dealt, BOTH, "tree").unionByName(keyed(hubs, NODE, "tree")), radius), "near-links")
    found = found.unionByName(near)

    labels = components(found).withColumnRenamed("node", "print")
    labelled = materialize(dealt.join(labels, "print", "left").withColumn("label", F.coalesce("root", "print")).drop("root"), "labelled")
    counts = labelled.groupBy("shard", "label").agg(F.count("*").alias("m"))
    main = counts.groupBy("shard").agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("all")).select("shard", F.col("main.label").alias("main"), (F.col("all") - F.col("main.m")).alias("few")).where("few > 0")
    main = materialize(main, "main")
    if main.isEmpty():
        return found
    apart = materialize(labelled.join(_small(main.withColumn("parts", F.ceil(F.col("few") / SEEKERS).cast("int"))), "shard"), "apart")
    nodes = apart.withColumn("part", F.explode(every("parts")))
    few = apart.where("label <> main").withColumn("part", F.pmod(F.xxhash64("print", F.lit(2)), F.col("parts")).cast("int")).withColumn("tree", F.explode(every("trees")))
    return found.unionByName(_trees(keyed(nodes, NODE, "tree", "part").unionByName(keyed(few, SEEKER, "tree", "part")), radius))


def _hubs(placed: DataFrame) -> DataFrame:
    """About HUBS fingerprints of each large shard that are nearest to its centre, the majority of each bit. They only save searches: no link depends on them."""
    bit = lambda k: F.shiftrightunsigned("print", k).bitwiseAND(F.lit(1))
    ones = placed.groupBy("shard").agg(F.count("*").alias("all"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(64)])
    centre = F.lit(0).cast("long")
    for k in range(64):
        centre = centre.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("all"), F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    far = placed.join(_small(materialize(ones.select("shard", centre.alias("centre")), "centres")), "shard").withColumn("far", F.bit_count(F.col("print").bitwiseXOR(F.col("centre"))))
    rings = far.groupBy("shard", "far").agg(F.count("*").alias("m"))
    nearer = Window.partitionBy("shard").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)  # 65 rows a shard at most
    shares = rings.select("shard", "far", ((HUBS - F.coalesce(F.sum("m").over(nearer), F.lit(0))) / F.col("m")).alias("share")).where("share > 0")
    chance = F.shiftrightunsigned(F.xxhash64("print", F.lit(3)), 11) / float(2**53)
    return far.join(_small(materialize(shares, "shares")), ["shard", "far"]).where(chance < F.col("share")).select(*placed.columns)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id that links lead to. One row a row of `docs`."""
    held = materialize(fingerprints(docs, words_each), "prints")
    nodes = materialize(held.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    of_print = with_least(nodes, components(links(nodes, radius)), "print")
    return held.join(of_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words_each: int = SHINGLE_WORDS) -> DataFrame:
    """Of each component the document with the smallest doc_id, one row of it if it is repeated. Rows without a doc_id can't be told apart and stay.

    The ids that stay grow with the corpus, so they are hashed by partition and not broadcast; the
    documents pass by them without a sort.
    """
    found = near_duplicates(docs.where("doc_id IS NOT NULL"), radius, words_each).where("doc_id = component_id")
    chosen = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")), "chosen")
    kept = docs.join(chosen.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select(docs.columns)
    if not chosen.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id IS NULL"))


def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null and empty texts have fingerprint zero and are linked like any other; texts of under four
    words have one shingle; a bit that is set in just half the hashes is 0; of a very long text all
    shingles count; a row without doc_id links others but is no component's smallest; repeated rows
    each have their row; an empty table gives none; other columns of the input are not read.
    """
    return near_duplicates(documents(spark, sf_dir))
