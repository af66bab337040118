"""Arrow batches of bounded text volume, for functions that run in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a slice of its own.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, in slices whose column number ``text`` holds about ``most`` bytes.

    Behind the last one, what Arrow holds and no longer uses goes back to the system: workers outlive their tasks, and
    would keep the most that any of them took.
    """
    start, held = 0, 0
    for k, value in enumerate(batch.column(text)):
        size = value.as_buffer().size if value.is_valid else 0
        if k > start and held + size > most:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()
