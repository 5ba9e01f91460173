"""Arrow batches of texts, cut by size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: Characters of a slice held at once as Python text; a longer text is a slice of its own.
BATCH_CHARS = 2_000_000


def text_slices(batches: Iterable[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Each batch in slices of bounded size, with the texts of the given column. No row is left out."""
    for batch in batches:
        lengths = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for n, length in enumerate(lengths):
            if total and total + length > BATCH_CHARS:
                yield batch.slice(start, n - start), batch.column(column).slice(start, n - start).to_pylist()
                start, total = n, 0
            total += length + 1
        if start < batch.num_rows:
            yield batch.slice(start), batch.column(column).slice(start).to_pylist()
