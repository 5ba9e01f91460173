"""Filling containers of fixed capacity with items, with the sum-of-squares rule (problem 7).

Items come one by one in an order that looks random. Each goes where it makes the sum over fill levels of the squared
number of windows at that level smallest: into the window of some level, or into a new one. Only an array with the
number of windows per level decides, so a placement costs one pass over it. At the end of a shard the windows still
partly filled are dissolved and their items placed again, largest first into the tightest gap, if that takes fewer.

Shards are equal parts of the items by a hash of their key, about SHARD_ITEMS each, packed in parallel and without
regard to each other: a task holds the sizes of one shard, never a text. What a shard loses is a few windows, a share
that falls with its size.

Defined results: an item larger than the capacity is split into full containers and a rest, which is placed like other
items; no other item is split. An item of size 0 (null or empty text) goes to the first container of its shard. A
null size counts as 0. A budget without a positive capacity packs nothing.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items of a shard, on average.
SHARD_ITEMS = 100_000
PACKED_SCHEMA = "budget_id int, packet_no bigint, key {key}, part_no int, n_tokens int"


def sum_of_squares(sizes: Sequence[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window of each item, fill of each window) for items of 1 to capacity, in the given order.

    Moving a window from level h to h+s changes the sum by 2(N[h+s] - N[h]) + 2, closing it (h+s = capacity) by
    1 - 2 N[h], opening one at s by 2 N[s] + 1. Ties: closing first, then the fullest level, then a new window.
    """
    # by gap (capacity - level); held is count where there are windows, else so small that its level is never chosen
    none = -(1 << 30)
    count = np.zeros(capacity + 1, np.int32)
    held = np.full(capacity + 1, none, np.int32)
    change = np.empty(capacity, np.int32)
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    window = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    for n, s in enumerate(sizes):
        w = -1
        if s < capacity:
            # half of the change, less one: the first of the least is the smallest gap
            moves = np.subtract(count[: capacity - s], held[s:capacity], out=change[: capacity - s])
            k = int(moves.argmin())
            least, new = int(moves[k]), int(count[capacity - s])
            if least < new or k == 0 and least == new:
                gap = k + s
                w = at_gap[gap].pop()
                count[gap] -= 1
                held[gap] = count[gap] or none
        if w < 0:
            w = len(fill)
            fill.append(0)
        fill[w] += s
        window[n] = w
        gap = capacity - fill[w]
        if gap:
            at_gap[gap].append(w)
            count[gap] += 1
            held[gap] = count[gap]
    return window, np.array(fill, np.int64)


def tightest_gap(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """(window of each item, number of windows): largest first, each into the fullest window that has room."""
    gaps: list[tuple[int, int]] = []
    window, windows = np.empty(len(sizes), np.int64), 0
    for n in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[n])
        at = bisect.bisect_left(gaps, (s, -1))
        gap, w = gaps.pop(at) if at < len(gaps) else (capacity, windows)
        windows += w == windows
        window[n] = w
        if gap > s:
            bisect.insort(gaps, (gap - s, w))
    return window, windows


def pack(sizes: np.ndarray, capacity: int, repair: bool = True) -> np.ndarray:
    """Window of each item of 1 to capacity, numbered from 0 without gaps; repair: place the partly filled ones' items again."""
    window, fill = sum_of_squares(sizes.tolist(), capacity)
    if not repair:
        return window
    partly = fill[window] < capacity
    again, n = tightest_gap(sizes[partly], capacity)
    if n < (fill < capacity).sum():
        full = np.flatnonzero(fill == capacity)
        number = np.full(len(fill), -1, np.int64)
        number[full] = np.arange(len(full))
        window = np.where(partly, 0, number[window])
        window[partly] = len(full) + again
    return window


def pack_shard(hashes: np.ndarray, sizes: np.ndarray, capacity: int, repair: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the item, container, part, size) of every part of a shard's items; hashes set the order."""
    whole = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - whole * capacity
    order = np.flatnonzero(rest > 0)
    order = order[np.lexsort((rest[order], hashes[order]))]
    window = pack(rest[order], capacity, repair) if len(order) else np.zeros(0, np.int64)
    used = int(window.max()) + 1 if len(window) else 0
    cut = np.repeat(np.arange(len(sizes)), whole)
    part = np.arange(len(cut)) - np.repeat(np.cumsum(whole) - whole, whole)
    empty = np.flatnonzero(sizes == 0)
    return (
        np.concatenate([order, cut, empty]),
        np.concatenate([window, used + np.arange(len(cut)), np.zeros(len(empty), np.int64)]),
        np.concatenate([whole[order], part, np.zeros(len(empty), np.int64)]),
        np.concatenate([rest[order], np.full(len(cut), capacity), np.zeros(len(empty), np.int64)]),
    )


def packets(sizes: DataFrame, key: str, budgets: list[tuple[int, str, int]], n_items: int, shard_items: int = SHARD_ITEMS, repair: bool = True) -> DataFrame:
    """(budget_id, packet_no, key, part_no, n_tokens): every item's place for every budget.

    sizes: key (bigint, unique) and a column of sizes per tokenizer. budgets: (budget_id, tokenizer, capacity), a fixed
    short list: each item stands once per budget. n_items sets the number of shards. repair: see pack.
    """
    capacity = {b: c for b, _, c in budgets if c and c > 0}
    shards = max(1, -(-n_items // shard_items))
    key_type = sizes.schema[key].dataType.simpleString()
    each = F.array(*[F.struct(F.lit(b).cast("int").alias("budget_id"), F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("int").alias("size")) for b, t, c in budgets if b in capacity])
    order = F.xxhash64(key)
    rows = sizes.select(F.col(key).alias("key"), order.alias("order"), F.pmod(order, F.lit(shards)).cast("int").alias("shard"), F.explode(each).alias("x")).select("key", "order", "shard", "x.*")

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.combine_chunks()
        budget, number = shard.column("budget_id")[0].as_py(), shard.column("shard")[0].as_py()
        item, container, part, size = pack_shard(shard.column("order").to_numpy(), shard.column("size").to_numpy().astype(np.int64), capacity[budget], repair)
        return pa.table({
            "budget_id": pa.array(np.full(len(item), budget, np.int32)),
            "packet_no": pa.array((np.int64(number) << 32) + container),
            "key": shard.column("key").take(pa.array(item)),
            "part_no": pa.array(part.astype(np.int32)),
            "n_tokens": pa.array(size.astype(np.int32)),
        })

    return rows.groupBy("budget_id", "shard").applyInArrow(run, PACKED_SCHEMA.format(key=key_type)).withColumnRenamed("key", key)
