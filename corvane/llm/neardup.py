"""Embedding near-duplicates by PCA-ordered tiled comparison: all pairs of one label with cosine 0.98 or more, in double precision.

1. A rotation to principal axes, fitted on a bounded sample (SAMPLE rows by the order of a hash), puts most of the length into
   the leading coordinates. It changes no cosine, so the sample touches only the speed.
2. Vectors are sorted over the cluster by label and by the cells of their leading coordinates, cells as wide as two linked unit
   vectors can lie apart, one coordinate after the other: the denser a region, the more coordinates tell its vectors apart. Runs of
   TILE vectors of that order are tiles (tiles.py), each with a bounding box for each of its labels. Equal vectors stand side by
   side and go on as one entry with their number.
3. Only tiles of a label in equal or adjacent cells of the first coordinate whose boxes come near enough meet.
4. In a pair of tiles, products over the leading coordinates come first. What the rest can add is at most the product of the
   suffix norms: where that can't reach the threshold the pair is done. Pairs that stay to the end are checked on the original
   components. A task keeps counts and the links' components, not the links.

Cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, links with nothing;
vectors of different length do not link; rows without vec_id link with nothing and are kept; rows that share a vec_id are rows of
their own, each with the links of its vector (equal ones count as copies of each other), and a component is named by its least
vec_id; empty table: empty result; other columns are ignored. The threshold must be below 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import tiles
from .components import connected, linked_roots

THRESHOLD = 0.98
TILE = 1024
SAMPLE = 4096
BOX = 8  # leading coordinates in a tile's bounding box and in the order of vectors
STEPS = (8, 16, 32)
SLACK = 1e-9
CHUNK = 256


def _vector(x, kind) -> np.ndarray | None:
    """A vector that may link, or None."""
    v = x.as_py()
    if not v or None in v:
        return None
    a = np.array(v, kind) + kind(0)  # no negative zeros
    b = a.astype(np.float64)
    with np.errstate(all="ignore"):
        return a if np.isfinite(b).all() and 0 < float(b @ b) < np.inf else None


def bases(vectors: DataFrame, size: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes by vector length, greatest first; of at most `size` rows."""
    rows = vectors.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    by: dict[int, list[np.ndarray]] = {}
    for x in rows.column("embedding"):
        v = _vector(x, np.float64)
        if v is not None:
            by.setdefault(len(v), []).append(v)
    out = {}
    for dim, found in by.items():
        m = np.array(found)
        m = m / np.abs(m).max(axis=1, keepdims=True)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        out[dim] = np.ascontiguousarray(np.linalg.eigh(m.T @ m)[1][:, ::-1])
    return out


def rotated(m: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors in principal coordinates."""
    m = m / np.abs(m).max(axis=1, keepdims=True)  # else squares may overflow or vanish
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return m @ axes[m.shape[1]] if m.shape[1] in axes else m


def reachable(a: np.ndarray, b: np.ndarray, threshold: float, asked: np.ndarray | None = None) -> np.ndarray:
    """Boolean matrix: pairs (of those asked for) whose products over the coordinates may reach the threshold; sums stop where they can't."""
    dim = a.shape[1]
    cuts = [s for s in STEPS if s < dim]
    total, done, need = np.zeros((len(a), len(b))), 0, threshold - SLACK
    alive = np.ones(total.shape, bool) if asked is None else asked.copy()
    for cut in [*cuts, dim]:
        x, y = a[:, done:cut], b[:, done:cut]
        rest = np.linalg.norm(a[:, cut:], axis=1)[:, None] * np.linalg.norm(b[:, cut:], axis=1)[None]
        few = np.count_nonzero(alive)
        if few == 0:
            break
        if few * 20 < alive.size:  # the pairs left, one by one
            i, j = np.nonzero(alive)
            total[i, j] += np.einsum("ij,ij->i", x[i], y[j])
            alive[i, j] = total[i, j] + rest[i, j] >= need
        else:
            total += x @ y.T
            alive &= total + rest >= need
        done = cut
    return alive


def _linked(raw_a, raw_b, a, b, label_a, label_b, threshold: float) -> np.ndarray:
    out = np.zeros((len(a), len(b)), bool)
    na, nb = np.sqrt(np.einsum("ij,ij->i", raw_a, raw_a)), np.sqrt(np.einsum("ij,ij->i", raw_b, raw_b))
    for k in range(0, len(a), CHUNK):
        i, j = np.nonzero(reachable(a[k : k + CHUNK], b, threshold, label_a[k : k + CHUNK, None] == label_b[None]))
        for s in range(0, len(i), 65536):
            p, q = i[s : s + 65536] + k, j[s : s + 65536]
            with np.errstate(all="ignore"):
                cos = np.einsum("ij,ij->i", raw_a[p], raw_b[q]) / (na[p] * nb[q])
            odd = ~np.isfinite(cos)
            if odd.any():  # components so large or small that their squares leave the range
                x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (raw_a[p[odd]], raw_b[q[odd]]))
                cos[odd] = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            out[p, q] = cos >= threshold
    return out


def _placed(vectors: DataFrame, axes: dict[int, np.ndarray], wide: float) -> tuple[DataFrame, type]:
    """vec_id, label, dim (0: links with nothing), place (a byte for the cell of each leading coordinate), digest, vec."""
    kind = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    def run(batches):
        for batch in batches:
            out = []
            sure = zip(batch.column(0).is_valid().to_pylist(), batch.column(1).is_valid().to_pylist(), strict=True)
            for (known, labelled), x in zip(sure, batch.column(2), strict=True):
                v = _vector(x, kind) if known and labelled else None
                if v is None:
                    out.append((0, b"", 0, None))
                    continue
                raw = v.tobytes()
                cell = np.zeros(BOX)
                lead = rotated(v.astype(np.float64)[None], axes)[0, :BOX]
                cell[: len(lead)] = np.floor(lead / wide)
                out.append((len(v), np.clip(cell + 128, 0, 255).astype(np.uint8).tobytes(), int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True), raw))
            cols = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)]], ["vec_id", "label", "dim", "place", "digest", "vec"])

    rows = vectors.selectExpr("cast(vec_id as long) vec_id", "cast(label as string) label", "embedding" if kind is np.float32 else "cast(embedding as array<double>) embedding")
    return C.cut(rows.mapInArrow(run, "vec_id long, label string, dim long, place binary, digest long, vec binary"), "vectors"), kind


_MADE = [("path", pa.string()), ("label", pa.string()), ("dim", pa.int64()), ("from_x", pa.int64()), ("to_x", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("vec_id", pa.int64()), ("id", pa.int64()), ("weight", pa.int64()), ("least", pa.int64())]


def _batch(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _MADE], [c for c, _ in _MADE])


def _tiled(placed: DataFrame, kind, axes: dict[int, np.ndarray]) -> DataFrame:
    """Rows with a path: a label of a tile, its cells of the first coordinate and its box. Rows with a vec_id: the entry (id) it went into, with the entry's weight and least vec_id."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folder = C.fresh_path(placed.sparkSession, "vector-tiles")
    order = ["label", "dim", "place", "digest", "vec_id"]
    sorted_ = placed.where("dim > 0").repartitionByRange(n, *order).sortWithinPartitions(*order)

    def run(batches):
        part, tile, entries, count = TaskContext.get().partitionId(), 0, [], 0  # an entry: label, dim, place, vec, its vec_ids

        def flush():
            nonlocal tile, count
            ids = (part << 33) + count + np.arange(len(entries))
            dim, weights, least = entries[0][1], np.array([len(e[4]) for e in entries]), np.array([min(e[4]) for e in entries])
            labels, codes = np.unique(np.array([e[0] for e in entries]), return_inverse=True)
            raw = np.frombuffer(b"".join(e[3] for e in entries), kind).reshape(-1, dim)
            path = tiles.save(folder, f"{part:06d}-{tile:06d}.npz", ids=ids, least=least, weights=weights, labels=labels, codes=codes, raw=raw)
            lead, xs = rotated(raw.astype(np.float64), axes)[:, :BOX], np.array([e[2][0] for e in entries])
            rows = [np.flatnonzero(codes == c) for c in range(len(labels))]
            yield _batch(path=[path] * len(labels), label=labels.tolist(), dim=[dim] * len(labels), from_x=[int(xs[r].min()) for r in rows], to_x=[int(xs[r].max()) for r in rows], lo=[lead[r].min(axis=0).tolist() for r in rows], hi=[lead[r].max(axis=0).tolist() for r in rows])
            yield _batch(vec_id=[v for e in entries for v in e[4]], id=np.repeat(ids, weights), weight=np.repeat(weights, weights), least=np.repeat(least, weights))
            tile, count = tile + 1, count + len(entries)
            entries.clear()

        for batch in batches:
            for vec_id, *what in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                if entries and entries[-1][:4] == tuple(what):
                    entries[-1][4].append(vec_id)
                    continue
                if entries and (len(entries) >= TILE or entries[-1][1] != what[1]):
                    yield from flush()
                entries.append((*what, [vec_id]))
        if entries:
            yield from flush()

    schema = "path string, label string, dim long, from_x long, to_x long, lo array<double>, hi array<double>, vec_id long, id long, weight long, least long"
    return C.cut(sorted_.select("vec_id", "label", "dim", "place", "vec").mapInArrow(run, schema), "vector-entries")


def duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    wide = float(np.sqrt(2 * (1 - threshold))) + 1e-9
    axes = bases(vectors)
    placed, kind = _placed(vectors, axes, wide)
    made = _tiled(placed, kind, axes)
    members = made.where("path is null").select("vec_id", "id", "weight", "least")

    def compare(x: dict, y: dict, same: bool):
        if x["raw"].shape[1] != y["raw"].shape[1]:
            return
        names = np.unique(np.concatenate([x["labels"], y["labels"]]))
        label_x, label_y = (np.searchsorted(names, t["labels"])[t["codes"]] for t in (x, y))
        raw_x, raw_y = (t["raw"].astype(np.float64) for t in (x, y))
        linked = _linked(raw_x, raw_y, rotated(raw_x, axes), rotated(raw_y, axes), label_x, label_y, threshold)
        if same:
            np.fill_diagonal(linked, False)
            linked |= linked.T
            yield from _found(x["ids"], x["least"], linked @ x["weights"], linked)
        elif linked.any():
            m, n = linked.shape
            whole = np.block([[np.zeros((m, m), bool), linked], [linked.T, np.zeros((n, n), bool)]])
            yield from _found(*(np.concatenate([x[c], y[c]]) for c in ("ids", "least")), np.concatenate([linked @ y["weights"], linked.T @ x["weights"]]), whole)

    pairs = _pairs(made.where("path is not null"), wide)
    links = C.cut(tiles.compared(pairs, compare, "id long, least long, links long, root long"), "vector-links")
    reach = connected(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = C.cut(links.groupBy("id").agg(F.sum("links").alias("links"), F.min("least").alias("own")).join(reach, "id"), "vector-reach")
    found = found.join(found.groupBy("component").agg(F.min("own").alias("head")), "component").select("id", "links", "head")
    n_links = (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links")
    out = members.join(found, "id", "left").select("vec_id", n_links, F.coalesce("head", "least").alias("component_id"))
    out = out.unionByName(placed.where("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _found(ids: np.ndarray, least: np.ndarray, links: np.ndarray, linked: np.ndarray):
    at = np.flatnonzero(links)
    if len(at):
        root = linked_roots(linked[np.ix_(at, at)])
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(least[at]), pa.array(links[at]), pa.array(ids[at][root])], ["id", "least", "links", "root"])


def _pairs(parts: DataFrame, wide: float) -> DataFrame:
    """path_a <= path_b, once each: tiles with a label in equal or adjacent cells whose boxes come within reach. Rows of a few numbers."""
    side = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("path", "lo", "hi")]
    xs = F.explode(F.sequence("from_x", "to_x")).alias("x")
    left = parts.select("label", "dim", xs, *side("a")).withColumn("step", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.col("x") + F.col("step"))
    right = parts.select("label", "dim", xs, *side("b"))
    gap = lambda lo, hi: F.zip_with(lo, hi, lambda a, b: F.greatest(F.lit(0.0), a - b))
    square = lambda g: F.aggregate(g, F.lit(0.0), lambda s, v: s + v * v)
    apart = square(gap(F.col("lo_a"), F.col("hi_b"))) + square(gap(F.col("lo_b"), F.col("hi_a")))
    met = left.join(right, ["label", "dim", "x"]).where("step = 1 or path_a <= path_b").where(apart <= wide * wide)
    return met.select(F.least("path_a", "path_b").alias("path_a"), F.greatest("path_a", "path_b").alias("path_b")).distinct()
