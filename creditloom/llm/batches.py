"""Arrow batches in pieces of bounded size, for functions that turn texts into something larger."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of text in a piece; a single longer text is a piece of its own.
PIECE_BYTES = 4 << 20


def pieces(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, with up to ``limit`` bytes in the text column each; no empty slice."""
    for batch in batches:
        start = held = 0
        for i, text in enumerate(batch.column(column)):
            size = len(text.as_buffer() or b"") if text.is_valid else 0
            if i > start and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)
