"""Learning the parameters of the line model of ``quality`` from texts without labels (Baum-Welch).

The parameters in ``quality`` are the result of ``fit`` over a bounded sample of texts (SAMPLE documents at most). The
start values say what the states mean; as a prior they weigh as much as PRIOR documents of each state, so that a state
keeps its meaning and a value that the sample lacks keeps a probability. A document weighs as the square
root of the number of its lines, between one weight for all documents and one for all lines.

    python -m cluemill.llm.fitting documents.parquet common_word.parquet
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence

import numpy as np

from cluemill.llm import quality

#: Most documents that are fitted on.
SAMPLE = 20_000
#: Documents that the start values of a state weigh as much as.
PRIOR = 500.0
#: The sample is of one corpus: no probability may fall below this share of its start value, none of leaving a state below the other.
FLOOR, FLOOR_LEAVE = 0.3, 0.5
ROUNDS = 25

Parameters = dict[str, np.ndarray]


def current() -> Parameters:
    return {name: getattr(quality, name) for name in ("START", "STAY", *quality.TABLES)}


def observe(texts: Iterable[str], common_words: Iterable[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(observations of all lines, lines of each text) of the texts that have lines."""
    documents = [x for x in map(quality.split_lines, texts) if x]
    sizes = np.array([len(x) for x in documents])
    lines = [line for own in documents for line in own]
    return quality.observations(lines, sizes, quality._line_statistics(lines, model, quality.word_hash(set(common_words)))), sizes


def posteriors(parameters: Parameters, observed: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(share of each state in each line, expected steps from state to state, log likelihood), by forward and backward sums;
    shares and steps of a text are divided by the square root of the number of its lines.

    All sequences advance together, longest first; every line's sums are scaled to 1.
    """
    emit = quality.likelihood(observed, parameters)
    top = emit.max(axis=1, keepdims=True)
    emit = np.exp(emit - top)
    step = quality.transitions(parameters["STAY"])
    order = np.argsort(-sizes, kind="stable")
    starts, length = (np.cumsum(sizes) - sizes)[order], sizes[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    weight = length**-0.5
    forward, scale = np.zeros_like(emit), np.zeros(len(emit))
    for t in range(length[0]):
        at = starts[: alive[t]] + t
        now = emit[at] * (forward[at - 1] @ step if t else parameters["START"])
        scale[at] = now.sum(axis=1)
        forward[at] = now / scale[at, None]
    backward = np.ones_like(emit)
    steps = np.zeros_like(step)
    for t in range(length[0] - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        after = emit[at + 1] * backward[at + 1] / scale[at + 1, None]
        backward[at] = after @ step.T
        steps += (forward[at] * weight[: alive[t + 1], None]).T @ after * step
    return forward * backward / np.repeat(sizes, sizes)[:, None] ** 0.5, steps, float(np.log(scale).sum() + top.sum())


def _floored(table: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows of table as probabilities of at least FLOOR times the start values."""
    return (1 - FLOOR) * table / table.sum(axis=1, keepdims=True) + FLOOR * start


def fit(observed: np.ndarray, sizes: np.ndarray, start: Parameters, rounds: int = ROUNDS, prior: float = PRIOR) -> tuple[Parameters, list[float]]:
    """(parameters, log likelihood before each round)."""
    now, seen = dict(start), []
    first = np.cumsum(sizes) - sizes
    for _ in range(rounds):
        share, steps, value = posteriors(now, observed, sizes)
        seen.append(value)
        began = (share[first] * sizes[:, None] ** 0.5).sum(axis=0) + prior * start["START"]
        new = {"START": began / began.sum()}
        stayed = (np.diag(steps) + prior * start["STAY"]) / (steps.sum(axis=1) + prior)
        new["STAY"] = np.minimum(stayed, 1 - FLOOR_LEAVE * (1 - start["STAY"]))
        for n, name in enumerate(quality.TABLES):
            table = prior * start[name]
            for value_ in range(table.shape[1]):
                table[:, value_] += share[observed[:, n] == value_].sum(axis=0)
            new[name] = _floored(table, start[name])
        now = new
    return now, seen


def main(arguments: Sequence[str]) -> None:
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(arguments[0], columns=["text"]).column(0).to_pylist() if t][:SAMPLE]
    words = [w for w in pq.read_table(arguments[1], columns=["word"]).column(0).to_pylist() if w]
    with open(quality.tokenizer_path(quality.VOCABULARY), "rb") as file:
        model = quality.letter_model(file.read())
    found, seen = fit(*observe(texts, words, model), current())
    print(f"log likelihood {seen[0]:.0f} -> {seen[-1]:.0f}", file=sys.stderr)
    for name, table in found.items():
        print(name, np.array2string(table, separator=", ", precision=5, suppress_small=True, max_line_width=200))


if __name__ == "__main__":
    main(sys.argv[1:])
