"""Rows of one key, whole, out of Arrow batches that are sorted by the key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import common as C


def by_key(batches, *keys: str) -> Iterator[pa.RecordBatch]:
    """Input: record batches of a partition sorted by the keys (long; "key" if none is named). Yields one batch or table per key; groups may span batches. In the end free memory goes back to the system."""
    keys = keys or ("key",)
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, key = batch.slice(a, b - a), tuple(int(c[a]) for c in columns)
            if held and key != held_key:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(part)
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held)
    C.give_back()
