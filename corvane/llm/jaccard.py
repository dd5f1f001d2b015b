"""N-gram Jaccard join by chosen paths: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Each text becomes a set of shingle hashes, a digest of the set, and a signature of T minhash tokens. Rows with equal sets go on
   as one set, under a number of its own.
2. Chosen paths: a run splits the sets by the value of a sampled token, and every bucket of more than LIMIT sets again by a
   token sampled for that bucket, DEPTH times at most. A bucket samples one token or two, 1/0.8 on average, so that a pair at
   the threshold is expected in one child. Runs are repeated until the chance of missing such a pair is below 1 - RECALL.
3. Small buckets, and larger ones of the last level in pairs of tiles, are compared signature by signature; pairs that may
   reach the threshold join their sets into candidate groups.
4. Candidate groups are checked on the whole shingle sets, so that the links of different texts are whole; counts and the links'
   components are kept, the pairs are not. A large group is dealt into tiles of like set size, each written once (tiles.py). In a
   pair of tiles that sizes allow, signatures come first, and only the sets of pairs that agree in SURE of them are intersected.

Cases: null, empty or blank text: no shingles, linked with nothing; fewer than five words: one shingle of them all; null
doc_id: own row, no class, no links; rows that share doc_id and text: each gets the row of its class, and they count as copies;
rows that share doc_id but not the text: each is in the class of its text, and one_of_each() keeps one row of each class;
empty table: empty result; other columns are ignored by classes() and kept by one_of_each().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common as C
from . import tiles
from .components import connected, linked_roots
from .groups import by_key

N = 5  # words of a shingle
T = 64  # tokens of a signature
DEPTH = 3
LIMIT = 96
TILE = 384
RECALL = 0.9999
MAYBE = 0.6  # share of equal tokens from which a pair is a candidate: four standard deviations below 0.8
SURE = 0.5  # share below which a pair of a large group is not looked at: six of them
HOT = 1024

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, N, dtype=np.uint64) * _U(2) + _U(1)
_FLIP = _rng.integers(0, 2**32, T, dtype=np.uint32)
_MULT = _rng.integers(0, 2**31, T, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        m = max(n, 2 * len(_powers[0]), 1 << 16)
        inverse = _U(pow(int(_BASE), -1, 2**64))
        for k, b in enumerate((_BASE, inverse)):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. Words are hashed by prefix sums over all bytes at once."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    inside = ~_BLANK[raw]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _power(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up, dtype=np.uint64)])
    words = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    if len(words) < N:
        return _mix(np.array([(words * _STEP[: len(words)]).sum(dtype=np.uint64) + _U(len(words))]))
    m = len(words) - N + 1
    h = words[:m] * _STEP[0]
    for k in range(1, N):
        h += words[k : k + m] * _STEP[k]
    return np.unique(_mix(h))


def signature(h: np.ndarray) -> np.ndarray:
    """T minhash tokens of a set that is not empty."""
    low = (h >> _U(32)).astype(np.uint32)
    out = np.full(T, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(out, ((low[k : k + 1024, None] ^ _FLIP) * _MULT).min(axis=0), out=out)
    return out


def runs_for(recall: float, threshold: float = 0.8, depth: int = DEPTH) -> int:
    """Runs after which a pair at the threshold has been in one leaf with that chance, if all leaves are at the last level."""
    lost, two = 0.0, 1 / threshold - 1
    for _ in range(depth):
        one = 1 - threshold + threshold * lost
        lost = (1 - two) * one + two * one * one
    return math.ceil(math.log(1 - recall) / math.log(lost))


RUNS = runs_for(RECALL)


def _chosen(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For nodes (uint64): which rows sample a token, and which token; a second one for the share 1/0.8 - 1 of the nodes."""
    h = _mix(node + _U(0xA5A5A5A5))
    first = (h % _U(T)).astype(np.int64)
    second = ((h >> _U(20)) % _U(T - 1)).astype(np.int64)
    second += second >= first
    every = np.arange(len(node))
    twice = np.flatnonzero((h >> _U(40)) % _U(1000) < _U(250))
    return [(every, first), (twice, second[twice])]


def _children(node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of the children that rows of sig, each at its node, go to."""
    rows, keys = [], []
    for at, token in _chosen(node):
        rows.append(at)
        keys.append(_mix(_mix(node[at] * _U(T) + token.astype(np.uint64)) + sig[at, token].astype(np.uint64)))
    return np.concatenate(rows), np.concatenate(keys)


def marks(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, d1, d2 (digest of the set), sig (T tokens of 4 bytes; null without shingles)."""

    def run(batches):
        C.forget()
        for batch in C.portions(batches, 2):
            n, d1, d2, sig = [], [], [], []
            for x in batch.column(2):
                h = shingles(x.as_py())
                n.append(len(h))
                m = _mix(h + _U(7))
                d1.append(int(h.sum(dtype=np.uint64).astype(np.int64)))
                d2.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                sig.append(signature(h).tobytes() if len(h) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "n_shingles", "d1", "d2", "sig"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sig binary")


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T)


def _leaves(sets: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """key, id: each set in each leaf it reaches, but for leaves of more than LIMIT sets; those with n, their size. sets: id, sig."""

    def roots(batches):
        for batch in batches:
            if batch.num_rows:
                sig, ids = _tokens(batch.column(1)), batch.column(0).to_numpy()
                for r in range(runs):
                    rows, keys = _children(np.full(len(sig), _mix(np.array([r + 1], np.uint64))[0]), sig)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(ids[rows])], ["key", "id"])

    def deeper(batches):
        for batch in batches:
            if batch.num_rows:
                sig, ids = _tokens(batch.column(2)), batch.column(1).to_numpy()
                rows, keys = _children(batch.column(0).to_numpy().astype(np.uint64), sig)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(ids[rows])], ["key", "id"])

    at, leaves = C.cut(sets.mapInArrow(roots, "key long, id long"), "paths"), []
    for depth in range(1, DEPTH + 1):
        sized = C.cut(at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "path-sizes")
        # large buckets are few, so their sizes are sent to the rows where they are small enough, and the other join has no large key
        crowded = sized.where(F.col("n") > LIMIT)
        leaves.append(at.join(crowded, "key", "left_anti").join(sized.where(F.col("n") <= LIMIT), "key", "left_semi"))
        large = at.join(crowded, "key")
        if depth < DEPTH:
            at = C.cut(large.select("key", "id").join(sets, "id").select("key", "id", "sig").mapInArrow(deeper, "key long, id long"), "paths")
    return leaves[0].unionByName(leaves[1]).unionByName(leaves[2]), C.cut(large, "paths-large")


def _tile_of(n: Column) -> Column:
    """The tile of the set `id` in a group of n."""
    return F.pmod(F.xxhash64("id", F.lit(3)), F.ceil(n / TILE).cast("long"))


def _agree(a: np.ndarray, b: np.ndarray, share: float) -> np.ndarray:
    """Boolean matrix: sketches with that share of equal tokens or more."""
    return np.concatenate([(a[k : k + 32, None] == b[None]).sum(axis=2) >= share * T for k in range(0, len(a), 32)])


def _stars(ids: np.ndarray, close: np.ndarray) -> Iterator[pa.RecordBatch]:
    root = linked_roots(close)
    far = np.flatnonzero(root != np.arange(len(ids)))
    if len(far):
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[root[far]])], ["a", "b"])


def _across(block: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a block between two tiles."""
    m, n = block.shape
    return np.block([[np.zeros((m, m), bool), block], [block.T, np.zeros((n, n), bool)]])


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, T)


def _alike(batches):
    """Star edges of the sets of a leaf that may be similar."""
    for g in by_key(batches):
        ids = np.asarray(g.column("id"))
        if len(ids) < 2:
            continue
        low = _sketches(g.column("sketch"))
        close = _agree(low, low, MAYBE)
        if close.sum() > len(ids):
            yield from _stars(ids, close)


def _alike_tiles(x: dict, y: dict, same: bool):
    close = _agree(x["sketches"], y["sketches"], MAYBE)
    if same:
        yield from _stars(x["ids"], close)
    elif close.any():
        yield from _stars(np.concatenate([x["ids"], y["ids"]]), _across(close))


def _tiles(rows: DataFrame, folder: str, pack, extra: str = "") -> DataFrame:
    """group, tile, path and what pack adds: rows (group, tile, ...) as tile files. pack(rows of a tile) gives the arrays and the added values."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["group", "tile", "path", *[c.split()[0] for c in extra.split(", ") if c]]

    def run(batches):
        for g in by_key(batches, "group", "tile"):
            group, tile = g.column("group")[0].as_py(), g.column("tile")[0].as_py()
            arrays, added = pack(g)
            path = tiles.save(folder, f"{group & 0xFFFFFFFFFFFFFFFF:016x}-{tile:012d}.npz", **arrays)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (group, tile, path, *added)], names)

    dealt = rows.repartition(n, "group", "tile").sortWithinPartitions("group", "tile", "id")
    return C.cut(dealt.mapInArrow(run, "group long, tile long, path string" + (", " + extra if extra else "")), "tiles")


def _pairs_of(tiled: DataFrame, within=None) -> DataFrame:
    """path_a, path_b: pairs of tiles of one group, each with itself too; within(a, b): a condition on what pack added."""
    a, b = (tiled.select("group", *[F.col(c).alias(f"{c}_{s}") for c in tiled.columns if c != "group"]) for s in "ab")
    met = a.join(b, "group").where("tile_a <= tile_b")
    return (met.where(within) if within is not None else met).select("path_a", "path_b")


def _checked(batches):
    """Exact check of the pairs of a candidate group: id, links, root."""
    for g in by_key(batches):
        ids, first = np.unique(np.asarray(g.column("id")), return_index=True)
        if len(ids) < 2:
            continue
        texts, weight = g.column("text"), np.asarray(g.column("weight"))[first]
        sets = [shingles(texts[int(k)].as_py()) for k in first]
        size = np.array([len(s) for s in sets])
        common = _intersections(sets)
        linked = 10 * common >= 8 * (size[:, None] + size[None, :] - common)
        np.fill_diagonal(linked, False)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ weight), pa.array(ids[linked_roots(linked)])], ["id", "links", "root"])


def _pack_sets(g):
    """A tile's shingle sets, one after the other, and the least and greatest size."""
    ids, first = np.unique(np.asarray(g.column("id")), return_index=True)
    texts, at = g.column("text"), pa.array(first)
    sets = [shingles(texts[int(k)].as_py()) for k in first]
    ends = np.cumsum([0, *map(len, sets)])
    arrays = {"ids": ids, "weights": np.asarray(g.column("weight"))[first], "sketches": _sketches(g.column("sketch").take(at)), "ends": ends, "hashes": np.concatenate(sets)}
    sizes = np.diff(ends)
    return arrays, (int(sizes.min()), int(sizes.max()))


def _pack_sketches(g):
    ids, first = np.unique(np.asarray(g.column("id")), return_index=True)
    return {"ids": ids, "sketches": _sketches(g.column("sketch").take(pa.array(first)))}, ()


def _checked_tiles(x: dict, y: dict, same: bool):
    """Exact check of the pairs of two tiles, or of one with itself. Only sets with a partner of SURE equal tokens are looked at."""
    close = _agree(x["sketches"], y["sketches"], SURE)
    if same:
        np.fill_diagonal(close, False)
    i, j = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(i):
        return
    sets_of = lambda t, at: [t["hashes"][t["ends"][k] : t["ends"][k + 1]] for k in at]
    sx, sy = sets_of(x, i), sets_of(y, j)
    common = _common(sx, sy)
    linked = 10 * common >= 8 * (np.array([len(s) for s in sx])[:, None] + np.array([len(s) for s in sy])[None] - common)
    if same:
        np.fill_diagonal(linked, False)
        ids, links = x["ids"][i], linked @ x["weights"][i]
    else:
        ids, links = np.concatenate([x["ids"][i], y["ids"][j]]), np.concatenate([linked @ y["weights"][j], linked.T @ x["weights"][i]])
        linked = _across(linked)
    if linked.any():
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(ids[linked_roots(linked)])], ["id", "links", "root"])


def _common(one: list[np.ndarray], other: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of `one` with each of `other`: products of 0/1 matrices, some hashes at a time."""
    left, right = np.concatenate(one), np.concatenate(other)
    shared = np.intersect1d(left, right)
    sides = []
    for flat, sets in ((left, one), (right, other)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(shared, flat)
        column[column == len(shared)] = 0
        use = shared[column] == flat if len(shared) else np.zeros(len(flat), bool)
        owner, column = owner[use], column[use]
        order = np.argsort(column, kind="stable")
        sides.append((owner[order], column[order], len(sets)))
    total, width = np.zeros((len(one), len(other)), np.float64), 4096

    def part(side, a: int) -> np.ndarray:
        owner, column, n = side
        x, y = np.searchsorted(column, (a, a + width))
        m = np.zeros((n, width), np.float32)
        m[owner[x:y], column[x:y] - a] = 1
        return m

    for a in range(0, len(shared), width):
        total += part(sides[0], a) @ part(sides[1], a).T
    return np.rint(total).astype(np.int64)


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the hashes that two sets or more hold, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(sets) == 2:
        both = np.concatenate(sets)
        both.sort()
        k = int((both[1:] == both[:-1]).sum())
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total, width = np.zeros((len(sets), len(sets)), np.float64), 4096
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        x, y = np.searchsorted(column, (a, a + width))
        m = np.zeros((len(sets), width), np.float32)
        m[owner[x:y], column[x:y] - a] = 1
        total += m @ m.T
    return np.rint(total).astype(np.int64)


def _links_of_large(large: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """id, links, root of groups that are checked in tiles. Sets of like size share a tile, since a set meets none below 0.8 of its size."""
    large = C.cut(large.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / math.log(1.25))), "jaccard-crowd")
    bands = C.cut(large.groupBy("group", "band").agg(F.count(F.lit(1)).alias("m")), "jaccard-bands")
    tile = F.col("band") * 2**32 + _tile_of(F.col("m"))
    large = large.join(bands, ["group", "band"]).select("group", tile.cast("long").alias("tile"), "id", "weight", "doc_id", "text_hash")
    large = large.join(sketches, "id").join(texts, ["doc_id", "text_hash"]).select("group", "tile", "id", "weight", "sketch", "text")
    crowd = _tiles(large, C.fresh_path(large.sparkSession, "set-tiles"), _pack_sets, "least long, most long")
    within = (10 * F.col("most_a") >= 8 * F.col("least_b")) & (10 * F.col("most_b") >= 8 * F.col("least_a"))
    return tiles.compared(_pairs_of(crowd, within), _checked_tiles, "id long, links long, root long")


def _classed(docs: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """The marks of all rows; and per distinct set: d1, d2, weight (rows with it), doc_id, text_hash (its least row), class_id, class_hash (its class's least row), n_links."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = C.cut(marks(docs), "jaccard-marks")
    # rows with equal sets are one; the number of a set has nothing to do with doc_ids, which may recur
    same = marked.where("doc_id is not null and n_shingles > 0").groupBy("d1", "d2")
    same = same.agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count(F.lit(1)).alias("weight"), F.first("n_shingles").alias("size"), F.first("sig").alias("sig"))
    same = C.cut(same.select(F.monotonically_increasing_id().alias("id"), "d1", "d2", "least.*", "weight", "size", "sig"), "jaccard-sets")
    sets = same.select("id", "sig")
    sketches = sets.mapInArrow(_sketched, "id long, sketch binary")

    leaves, crowded = _leaves(sets, runs)
    edges = leaves.join(sketches, "id").repartition(n, "key").sortWithinPartitions("key", "id").select("key", "id", "sketch").mapInArrow(_alike, "a long, b long")
    if not crowded.isEmpty():
        crowded = crowded.select(F.col("key").alias("group"), "id", _tile_of(F.col("n")).alias("tile")).join(sketches, "id").select("group", "tile", "id", "sketch")
        tiled = _tiles(crowded, C.fresh_path(spark, "leaf-tiles"), _pack_sketches)
        edges = edges.unionByName(tiles.compared(_pairs_of(tiled), _alike_tiles, "a long, b long"))
    maybe = C.cut(connected(edges), "jaccard-maybe")

    sized = C.cut(maybe.groupBy(F.col("component").alias("group")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * TILE), "jaccard-large")
    rows = maybe.withColumnRenamed("component", "group")
    who = same.select("id", "doc_id", "text_hash", "weight")
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) text_hash", "text")
    small = rows.join(sized, "group", "left_anti").join(who, "id").join(texts, ["doc_id", "text_hash"])
    small = small.select(F.col("group").alias("key"), "id", "weight", "text").repartition(n, "key").sortWithinPartitions("key", "id")
    links = small.mapInArrow(_checked, "id long, links long, root long")
    if not sized.isEmpty():
        links = links.unionByName(_links_of_large(rows.join(sized, "group").join(same.select("id", "doc_id", "text_hash", "weight", "size"), "id"), sketches, texts))
    links = C.cut(links, "jaccard-links")

    reach = C.cut(connected(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).join(who, "id").select("id", "component", F.struct("doc_id", "text_hash").alias("own")), "jaccard-reach")
    heads = reach.groupBy("component").agg(F.min("own").alias("head"))
    found = reach.join(heads, "component").select("id", "head").join(links.groupBy("id").agg(F.sum("links").alias("links")), "id", "left")
    out = same.drop("sig", "size").join(found, "id", "left")
    head = F.coalesce("head", F.struct("doc_id", "text_hash"))
    return marked, out.select("d1", "d2", "weight", "doc_id", "text_hash", head["doc_id"].alias("class_id"), head["text_hash"].alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def classes(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """doc_id, class_id (least doc_id that links lead to, itself included), n_links (other documents linked), n_shingles: one row per document."""
    marked, per_set = _classed(docs, runs)
    per_set = C.cut(per_set.select("d1", "d2", "weight", "class_id", "n_links"), "jaccard-found")
    linked = marked.where("doc_id is not null and n_shingles > 0").select("doc_id", "n_shingles", "d1", "d2")
    alone = marked.where("doc_id is null or n_shingles = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles")
    # a set that more than one row in HOT has: there are fewer than HOT of them, whatever the table's size
    hot = F.col("weight") > max(1, marked.count() // HOT)
    often = F.broadcast(per_set.where(hot).drop("weight"))
    columns = ["doc_id", "class_id", "n_links", "n_shingles"]
    out = linked.join(often, ["d1", "d2"]).select(*columns)
    rest = linked.join(often.select("d1", "d2"), ["d1", "d2"], "left_anti").join(per_set.where(~hot).drop("weight"), ["d1", "d2"]).select(*columns)
    return out.unionByName(rest).unionByName(alone)


def _sketched(batches):
    """The lowest byte of each token."""
    for batch in batches:
        if batch.num_rows:
            low = np.ascontiguousarray(_tokens(batch.column(1)).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "sketch"])


def one_of_each(docs: DataFrame, runs: int = RUNS) -> DataFrame:
    """The documents that stand for their class, with the columns they came with: of each class the one with the least doc_id, and
    of texts that share it the one with the least hash. Texts without shingles and rows without doc_id stay."""
    marked, per_set = _classed(docs, runs)
    kept = per_set.where("doc_id = class_id and text_hash = class_hash").select("doc_id", "text_hash")
    kept = kept.unionByName(marked.where("doc_id is not null and n_shingles = 0").select("doc_id", "text_hash").distinct())
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any names pass, dots too
    at = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    rows = plain.select(F.col(at["doc_id"]).cast("long").alias("i"), F.xxhash64(at["text"]).alias("h"), F.struct(*plain.columns).alias("held"))
    # of rows that share doc_id and text one stays: which one, a hash of all columns says
    order = F.xxhash64(*[f"held.{f.name}" for f in plain.schema if not isinstance(f.dataType, MapType)])
    met = rows.where("i is not null").join(kept.toDF("i", "h"), ["i", "h"])
    one = met.groupBy("i", "h").agg(F.min_by("held", order).alias("held"))
    return one.select("held").unionByName(rows.where("i is null").select("held")).select("held.*").toDF(*docs.columns)
