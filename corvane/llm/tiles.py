"""Tiles: parts of a group too large for one task, each written once as a file in the shared folder, and work on pairs of them.

A pair of tiles is a row of two paths, so what the tiles hold is shuffled once, and read where a pair needs it. Names and contents
follow from the rows alone and a file appears under its name when it is whole: a repeated task leaves the same files.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The partners of a tile go to this many tasks.
SLICES = 16
#: Bytes of partners that a task keeps at hand.
HELD = 32 << 20


def save(folder: str, name: str, **arrays: np.ndarray) -> str:
    from pyarrow import fs

    whole = io.BytesIO()
    np.savez(whole, **arrays)
    at_fs, at = fs.FileSystem.from_uri(folder)
    at_fs.create_dir(at, recursive=True)
    own = f"{at}/.{name}.{uuid.uuid4().hex}"
    with at_fs.open_output_stream(own, compression=None) as out:
        out.write(whole.getbuffer())
    at_fs.move(own, f"{at}/{name}")
    return f"{folder}/{name}"


def load(path: str) -> dict[str, np.ndarray]:
    from pyarrow import fs

    at_fs, at = fs.FileSystem.from_uri(path)
    with at_fs.open_input_stream(at, compression=None) as stream, np.load(io.BytesIO(stream.read())) as z:
        return {k: z[k] for k in z.files}


class _Shelf:
    """The tiles read last, up to HELD bytes of them (one at least)."""

    def __init__(self):
        self.held: dict[str, dict[str, np.ndarray]] = {}
        self.bytes = 0

    def __call__(self, path: str) -> dict[str, np.ndarray]:
        got = self.held.pop(path, None)
        if got is None:
            got = load(path)
            size = sum(a.nbytes for a in got.values())
            while self.held and self.bytes + size > HELD:
                self.bytes -= sum(a.nbytes for a in self.held.pop(next(iter(self.held))).values())
            self.bytes += size
        self.held[path] = got
        return got


def compared(pairs: DataFrame, compare: Callable[[dict, dict, bool], Iterator], schema: str) -> DataFrame:
    """compare(tile, other, same) for each row of pairs (path_a, path_b). A tile's partners meet it in a few tasks, one after the other."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.select("path_a", "path_b", F.pmod(F.xxhash64("path_b"), F.lit(SLICES)).alias("slice"))
    dealt = dealt.repartition(n, "path_a", "slice").sortWithinPartitions("path_a", "path_b").drop("slice")

    def run(batches):
        shelf, at, tile = _Shelf(), None, None
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if a != at:
                    at, tile = a, load(a)
                yield from compare(tile, tile if a == b else shelf(b), a == b)

    return dealt.mapInArrow(run, schema)
