"""Rounds of an iterative computation, with lineage cut between them."""

from __future__ import annotations

from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

from ..shared import materialize

State = TypeVar("State")


def rounds(state: State, step: Callable[[State, int], State], n: int, done: Callable[[State, State], bool] | None = None) -> State:
    """step() n times, or until done(before, after). Each round is one barrier: the shuffle of its aggregation."""
    for k in range(n):
        after = step(state, k)
        if done is not None and done(state, after):
            return after
        state = after
    return state


def stale_rounds(state: State, step: Callable[[State, State, int], State], n: int, staleness: int = 0) -> State:
    """n rounds of bounded staleness: round t learns from the state of round t - staleness, or the first, and changes the newest one.

    step(seen, newest, k) gives the next state. That is the latest that the bound allows every
    worker to be, and so the same on every run; without staleness it is rounds().
    """
    held = [state]
    for k in range(n):
        held.append(step(held[0], held[-1], k))
        if len(held) > staleness + 1:
            held.pop(0)
    return held[-1]


def cut(tables: dict[str, DataFrame], k: int, every: int = 1) -> dict[str, DataFrame]:
    """The tables, written to the shared folder and read again in every `every`-th round."""
    return {name: materialize(t, f"{name}-{k}") for name, t in tables.items()} if (k + 1) % every == 0 else tables


class Algorithm:
    """What a job runs: subclasses say how to make the state, advance it by a round, and tell that it has converged."""

    def start(self):
        raise NotImplementedError

    def step(self, state, k: int):
        raise NotImplementedError

    def converged(self, before, after) -> bool:
        return False

    def solve(self, n: int):
        return rounds(self.start(), self.step, n, self.converged)
