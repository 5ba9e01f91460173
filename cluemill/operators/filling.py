"""Search for grid fills: letters and words of a grid narrow each other down; where that ends, one slot is guessed.

A slot's words are rows of a matrix of letters. ``Grid.narrow`` keeps for each cell the letters that the words of both its
slots allow and drops the words with another letter, until nothing changes. A guess takes the slot with the fewest words
left; a dead end takes back its guess. Several restarts of a seed deal other chances to the words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FILL_SCHEMA = "seed int, fill string, least int, total int, nodes int"
MIN_ENTRY = 3
#: How far chance may move a word's score when words are tried in order.
CHANCE = 20.0
LETTERS = 26


def slots(pattern: Sequence[str]) -> list[list[tuple[int, int]]]:
    """Maximal runs of at least MIN_ENTRY open cells, across and down."""
    rows, cols = len(pattern), len(pattern[0])
    lines = [[(r, c) for c in range(cols)] for r in range(rows)] + [[(r, c) for r in range(rows)] for c in range(cols)]
    out = []
    for line in lines:
        run: list[tuple[int, int]] = []
        for cell in [*line, None]:
            if cell is not None and pattern[cell[0]][cell[1]] != "#":
                run.append(cell)
            else:
                if len(run) >= MIN_ENTRY:
                    out.append(run)
                run = []
    return out


class Grid:
    """A pattern with the lexicon's words by length as matrices of letters (0 for a)."""

    def __init__(self, pattern: Sequence[str], words: dict[str, int], veto: Callable[[str], bool] | None = None) -> None:
        self.slots = slots(pattern)
        cells = {cell: n for n, cell in enumerate(dict.fromkeys(c for slot in self.slots for c in slot))}
        self.cells = [np.array([cells[c] for c in slot]) for slot in self.slots]
        self.n_cells = len(cells)
        by_length: dict[int, list[str]] = {len(slot): [] for slot in self.slots}
        for word in words:
            if len(word) in by_length and word.isascii() and word.isalpha() and word.islower() and not (veto and veto(word)):
                by_length[len(word)].append(word)
        self.words = {n: np.array(sorted(w)) for n, w in by_length.items()}
        self.letters = {n: np.frombuffer("".join(w).encode(), np.uint8).reshape(-1, n) - 97 if len(w) else np.zeros((0, n), np.uint8) for n, w in self.words.items()}
        self.scores = {n: np.array([words[w] for w in group], float) for n, group in self.words.items()}

    def narrow(self, left: list[np.ndarray], changed: Iterable[int] | None = None) -> bool:
        """Drop words that no crossing word allows, beginning at the changed slots, else at all; False where a slot has none left."""
        allowed = np.ones((self.n_cells, LETTERS), bool)
        for slot, words in enumerate(left):
            self._allow(allowed, slot, words)
        todo = set(range(len(left))) if changed is None else set(changed)
        crossing = self._crossing()
        todo |= {other for slot in todo for other in crossing[slot]}
        while todo:
            slot = todo.pop()
            cells, words = self.cells[slot], left[slot]
            kept = words[allowed[cells, self.letters[len(cells)][words]].all(axis=1)]
            if not len(kept):
                return False
            if len(kept) < len(words):
                left[slot] = kept
                self._allow(allowed, slot, kept)
                todo |= crossing[slot]
        return True

    def _allow(self, allowed: np.ndarray, slot: int, words: np.ndarray) -> None:
        cells = self.cells[slot]
        letters = self.letters[len(cells)][words]
        for at, cell in enumerate(cells):
            own = np.zeros(LETTERS, bool)
            own[letters[:, at]] = True
            allowed[cell] &= own

    def _crossing(self) -> list[set[int]]:
        if not hasattr(self, "_crossings"):
            at: dict[int, set[int]] = {}
            for slot, cells in enumerate(self.cells):
                for cell in cells:
                    at.setdefault(int(cell), set()).add(slot)
            self._crossings = [set().union(*(at[int(c)] for c in cells)) - {slot} for slot, cells in enumerate(self.cells)]
        return self._crossings

    def fill(self, rng: np.random.Generator, max_nodes: int) -> tuple[list[str] | None, int]:
        """(words of the slots, nodes): different words for all slots, or None within max_nodes guesses."""
        order = {n: np.argsort(-(s + rng.random(len(s)) * CHANCE), kind="stable") for n, s in self.scores.items()}
        rank = {n: np.argsort(o) for n, o in order.items()}
        left = [np.arange(len(self.words[len(c)])) for c in self.cells]
        nodes = 0
        if not all(len(x) for x in left) or not self.narrow(left):
            return None, nodes
        # each level: the state before its guess, its slot and the words still to try
        stack: list[tuple[list[np.ndarray], int, list[int]]] = []
        while True:
            taken = {(len(self.cells[s]), int(x[0])) for s, x in enumerate(left) if len(x) == 1}
            singles = sum(len(x) == 1 for x in left)
            if len(taken) == singles:  # no word stands twice
                open_ = [s for s, x in enumerate(left) if len(x) > 1]
                if not open_:
                    return [str(self.words[len(c)][x[0]]) for c, x in zip(self.cells, left)], nodes
                slot = min(open_, key=lambda s: (len(left[s]), s))
                size = len(self.cells[slot])
                tries = [int(w) for w in left[slot][np.argsort(rank[size][left[slot]])] if (size, int(w)) not in taken]
                stack.append((left, slot, tries[::-1]))
            while True:
                while stack and not stack[-1][2]:
                    stack.pop()
                if not stack:
                    return None, nodes
                nodes += 1
                if nodes > max_nodes:
                    return None, nodes
                before, slot, tries = stack[-1]
                left = list(before)
                left[slot] = np.array([tries.pop()])
                if self.narrow(left, [slot]):
                    break


def search(pattern: Sequence[str], words: dict[str, int], seed: int, max_nodes: int, restarts: int = 1, veto: Callable[[str], bool] | None = None) -> tuple[list[str] | None, int]:
    """The fill of the first restart that finds one, each within its share of the nodes; and the nodes of all."""
    grid, nodes = Grid(pattern, words, veto), 0
    for restart in range(restarts):
        found, used = grid.fill(np.random.default_rng([seed, restart]), max_nodes // restarts)
        nodes += used
        if found is not None:
            return found, nodes
    return None, nodes


def fills(spark: SparkSession, pattern: Sequence[str], words: dict[str, int], seeds: int, max_nodes: int = 120_000, restarts: int = 25, veto: Callable[[str], bool] | None = None) -> DataFrame:
    """One row per seed that found a fill: its words in slot order, least and total score. words: a lexicon of bounded size.

    A seed's search ends by its nodes alone, so its row does not depend on the machine or its load.
    """
    shared = spark.sparkContext.broadcast((list(pattern), words))

    def run(batches):
        grid, scores = shared.value
        for pdf in batches:
            out = []
            for seed in pdf["seed"]:
                found, nodes = search(grid, scores, int(seed), max_nodes, restarts, veto)
                if found is not None:
                    own = [scores[w] for w in found]
                    out.append((int(seed), " ".join(found), min(own), sum(own), nodes))
            yield pd.DataFrame(out, columns=["seed", "fill", "least", "total", "nodes"])

    return spark.range(seeds).selectExpr("CAST(id AS INT) AS seed").repartition(min(seeds, 64)).mapInPandas(run, FILL_SCHEMA)
