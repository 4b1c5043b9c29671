"""Secrets in the middle of candidates that are longer than what the network sees at once."""

from __future__ import annotations

import random
import string

import pytest

from sparsemill.llm import secrets

FOLDERS = ["srv", "app", "releases", "config", "current", "settings", "modules", "static", "public", "build"]


def path(r: random.Random) -> str:
    return "".join("/" + r.choice(FOLDERS) for _ in range(r.randint(3, 6)))


def test_keys_within_paths_are_found():
    r = random.Random(11)
    keys = [lead + "".join(r.choice(string.ascii_letters + string.digits) for _ in range(36)) for lead in ("ghp_", "sk_live_", "glpat-") for _ in range(40)]
    texts = [f"see {path(r)}/2024/{key}{path(r)} there" for key in keys] + [f"/srv/app/releases/2024/{keys[0]}/config/current/settings"]
    found = secrets.scan(texts, secrets.trained())
    held = [any(key in secrets.masked(t, spans) for key in keys) for t, spans in zip(texts, found, strict=True)]
    assert sum(held) <= 2 and not held[-1]
    plain = [f"see {path(r)}/2024{path(r)}{path(r)} there" for _ in range(100)]
    assert sum(map(bool, secrets.scan(plain, secrets.trained()))) <= 5


@pytest.mark.parametrize("length", [20, 40, 41, 50, 51, 399])
def test_windows_cover_the_whole(length):
    text = "".join(chr(33 + k % 94) for k in range(length))
    codes = secrets.codes_of(text)
    seen = [[c for c in v[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] if c] for v in map(list, secrets.views(codes, 0, length))]
    runs = seen[1:] or seen
    assert {x + k for v in runs for x in range(length) if codes[x : x + len(v)].tolist() == v for k in range(len(v))} == set(range(length))
