"""Settings of a job, from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class JobConfig:
    """Unknown keys are errors; `output` may name several outputs."""

    input: str = ""
    output: str | dict[str, str] = ""
    nserver: int = 1
    nworker: int = 1
    k: int = 10
    alpha: float = 0.001
    beta: float = 0.01
    rounds: int = 3
    limit_s: int = 0
    #: Ratings after which factors are synchronised within a round; 0 is once a round.
    sync_every: int = 0

    @classmethod
    def parse(cls, text: str) -> JobConfig:
        held = json.loads(text)
        if unknown := set(held) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**held)

    @classmethod
    def load(cls, path: str) -> JobConfig:
        with open(path, encoding="utf-8") as file:
            return cls.parse(file.read())
