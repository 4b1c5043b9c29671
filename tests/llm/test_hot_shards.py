"""Large groups of near fingerprints, and components that hold most nodes, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from sparsemill.llm import components, simhash

CENTRE = np.uint64(0x0123456789ABCDEF)


def around(n: int, most: int, seed: int, centre: np.uint64 = CENTRE) -> np.ndarray:
    """Distinct fingerprints with up to `most` bits of the centre flipped."""
    rng = np.random.default_rng(seed)
    flips, found = rng.integers(1, most + 1, n), np.full(n, centre)
    for k in range(most):
        found = np.where(k < flips, found ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), found)
    return np.unique(found)


def signed_components(prints: np.ndarray, radius: int = 4) -> dict[int, int]:
    """Each fingerprint that isn't the smallest of its component, as signed numbers, and that one: all pairs are compared."""
    prints = np.sort(prints.view(np.int64)).view(np.uint64)
    label = np.arange(len(prints))
    for k in range(0, len(prints), 256):
        a, b = np.nonzero(np.bitwise_count(prints[k : k + 256, None] ^ prints[None, :]) <= radius)
        label = components.local_components(len(prints), label[a + k], label[b])[label]
    ids = prints.view(np.int64)
    return {int(ids[k]): int(ids[v]) for k, v in enumerate(label) if k != v}


def linked(spark, prints: np.ndarray) -> dict[int, int]:
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    return {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}


@pytest.mark.parametrize(("tree", "hubs", "cuts"), [(16, 16, 2), (16, 4, 0), (64, 1, 1), (8, 0, 0)])
def test_every_way_is_exact(spark, monkeypatch, tree, hubs, cuts):
    """Two dense groups, one of which is in parts, and fingerprints that are like no other."""
    for name, value in (("TREE_MOST", tree), ("HUBS", hubs), ("CUTS", cuts), ("SEEKERS", 32), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(simhash, name, value)
    lone = np.random.default_rng(3).integers(0, 2**63, 60, np.uint64)
    prints = np.unique(np.concatenate([around(250, 8, 1), around(250, 12, 2, ~CENTRE), lone]))
    want = signed_components(prints)
    assert linked(spark, prints) == want and len(set(want.values())) > 1


def test_fifty_thousand_near_copies(spark):
    prints = around(50_000, 6, 5)
    assert len(prints) > 30_000
    assert linked(spark, prints) == signed_components(prints)


@pytest.mark.parametrize("level", range(4))
def test_divisions_lose_no_link(level):
    rng = np.random.default_rng(level)
    masks = simhash.division(level)
    assert sum(m & (2**64 - 1) for m in masks) == 2**64 - 1
    for _ in range(200):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(flips & m & (2**64 - 1) == 0 for m in masks)


def test_least_of_a_large_component(spark):
    nodes = spark.createDataFrame([(k, None if k == 7 else 1000 - k) for k in range(500)], "print long, least long")
    found = spark.createDataFrame([(k, 0) for k in range(1, 400)] + [(450, 449)], "node long, root long")
    got = {r["print"]: r["component_id"] for r in components.with_least(nodes, found, "print").collect()}
    assert got == {k: 601 if k < 400 else 550 if k in (449, 450) else 1000 - k for k in range(500)}
