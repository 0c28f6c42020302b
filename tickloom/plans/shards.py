"""Greedy shard plans.

The greedy rule is sequential, so it runs in one place: over shard rows, which planning bounds, not over the
samples in them.
"""

from __future__ import annotations

import hashlib
import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame

from tickloom.workers import ship


def least_loaded(shards: list[tuple[str, int]], slots: int, seed: int = 0, epoch: int = 0) -> list[list[tuple[str, int]]]:
    """Shards in hashed order, each to the slot with the least load; the lowest slot on a tie."""
    order = sorted(shards, key=lambda s: hashlib.md5(f"{seed}|{epoch}|{s[0]}".encode()).hexdigest())
    heap = [(0, k) for k in range(slots)]
    plan: list[list[tuple[str, int]]] = [[] for _ in range(slots)]
    for name, size in order:
        load, k = heapq.heappop(heap)
        plan[k].append((name, size))
        heapq.heappush(heap, (load + size, k))
    return plan


def aligned(most: int, batch: int, workers: int) -> int:
    """The least load from ``most`` on that all workers can reach in whole batches."""
    unit = batch // math.gcd(batch, workers)
    return -(-most // unit) * unit


def padded_samples(plan: list[list[tuple[str, int]]], batch: int, workers: int) -> tuple[int, int]:
    """The aligned load, and how many samples are read again to reach it in every slot."""
    loads = [sum(n for _, n in slot) for slot in plan]
    goal = aligned(max(loads, default=0), batch, workers)
    return goal, sum(goal - n for n in loads)


def planned(shards: DataFrame, name: str, size: str, slots: int, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``slot, place`` for each shard, by one task over the shard rows."""

    ship(shards.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        plan = least_loaded([(str(n), int(s)) for n, s in zip(pdf[name], pdf[size])], slots, seed, epoch)
        rows = [(n, s, k, i) for k, slot in enumerate(plan) for i, (n, s) in enumerate(slot)]
        return pd.DataFrame(rows, columns=["shard", "size", "slot", "place"])

    return shards.select(name, size).groupBy().applyInPandas(run, "shard string, size long, slot int, place int")
