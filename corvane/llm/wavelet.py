"""Token ids in wavelet matrices: one compressed file per shard, with access, rank, select, counting and whole reading.

A shard holds the ids of consecutive documents. Level k of its matrix holds bit k (from the top) of every id, in the order
left by the levels above: ids with a 0 there first, then those with a 1, each in their old order. The bits of a level are
stored in blocks of BLOCK_BITS, each compressed by itself; a directory has each block's place and the number of ones before
it, so that a lookup reads one block per level.

Writing: documents are dealt by ranges of doc_id and sorted within them; each task writes its shards under names that follow
from its range, so a repeated task writes the same files again. Reading back needs the files alone.

Cases: null or empty text: no ids but the end id; rows without doc_id come first; rows that share a doc_id are ordered by
text; empty table: no files, empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

MAGIC = b"WVMTX01\n"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 22
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
MEMO = 500_000
PORTION = 12 << 20


# ---- the file format


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def build(ids: np.ndarray, lengths: np.ndarray, doc_ids: np.ndarray, known: np.ndarray, vocab_bits: int = 16) -> bytes:
    """A shard file: ids of all documents in order, ids per document, doc_id per document and whether it is not null."""
    n, kind = len(ids), np.uint16 if vocab_bits <= 16 else np.uint32
    seq, zeros, parts, offsets, ranks, at = ids.astype(kind), [], [], [], [], 0
    deflate = zstandard.ZstdCompressor(level=1)
    for level in range(vocab_bits):
        mask, ones, low, high = kind(1 << (vocab_bits - 1 - level)), 0, [], []
        for k in range(0, n, BLOCK_BITS):  # a block at a time: what is shuffled stays in the cache
            part = seq[k : k + BLOCK_BITS]
            chosen = (part & mask) != 0
            raw = np.packbits(chosen)
            data = deflate.compress(raw.tobytes())
            offsets.append(at)
            ranks.append(ones)
            parts.append(data)
            at += len(data)
            up = np.flatnonzero(chosen)
            ones += len(up)
            high.append(part.take(up))
            low.append(part.take(np.flatnonzero(~chosen)))
        offsets.append(at)
        ranks.append(ones)
        zeros.append(n - ones)
        seq = np.concatenate([*low, *high]) if n else seq
    tables = [_pack(np.diff(doc_ids.astype("<i8"), prepend=0)), _pack(known.astype(np.uint8)), _pack(lengths.astype("<u4")), _pack(np.array(offsets, "<u8")), _pack(np.array(ranks, "<u8"))]
    head = json.dumps({"n": n, "bits": vocab_bits, "block_bits": BLOCK_BITS, "docs": len(lengths), "zeros": zeros, "tables": [len(t) for t in tables]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *tables, *parts])


class Shard:
    """Reads one file; blocks are inflated as lookups need them."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<I", data, 8)
        head = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.block, self.zeros = head["n"], head["bits"], head["block_bits"], head["zeros"]
        at, tables = 12 + size, []
        inflate = zstandard.ZstdDecompressor()
        for k, kind in zip(head["tables"], ("<i8", "u1", "<u4", "<u8", "<u8"), strict=True):
            tables.append(np.frombuffer(inflate.decompress(data[at : at + k]), kind))
            at += k
        self.doc_ids, self.known, self.lengths = np.cumsum(tables[0]), tables[1].astype(bool), tables[2].astype(np.int64)
        per_level = -(-self.n // self.block) + 1
        self.offsets, self.ranks = tables[3].reshape(self.bits, -1) if self.n else None, tables[4].reshape(self.bits, per_level) if self.n else None
        self.data, self.start, self.inflate = data, at, inflate
        self._blocks: dict[tuple[int, int], np.ndarray] = {}

    def _raw(self, level: int, k: int) -> np.ndarray:
        a, b = (int(x) for x in self.offsets[level, k : k + 2])
        return np.frombuffer(self.inflate.decompress(self.data[self.start + a : self.start + b]), np.uint8)

    def _bits(self, level: int, k: int) -> np.ndarray:
        """Bits of a block, as running counts of ones before each position and after the last."""
        key = (level, k)
        if key not in self._blocks:
            if len(self._blocks) >= 64:
                self._blocks.pop(next(iter(self._blocks)))
            bits = np.unpackbits(self._raw(level, k))[: min(self.block, self.n - k * self.block)]
            self._blocks[key] = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])
        return self._blocks[key]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a level."""
        k = min(i // self.block, self.ranks.shape[1] - 2)
        return int(self.ranks[level, k]) + int(self._bits(level, k)[i - k * self.block])

    def _find(self, level: int, bit: int, j: int) -> int:
        """Position of the j-th (from 0) bit of that kind."""
        before = self.ranks[level] if bit else np.minimum(np.arange(self.ranks.shape[1]) * self.block, self.n) - self.ranks[level].astype(np.int64)
        k = int(np.searchsorted(before, j, side="right")) - 1
        ones = self._bits(level, k)
        counts = ones if bit else np.arange(len(ones)) - ones
        return k * self.block + int(np.searchsorted(counts, j - int(before[k]), side="right")) - 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            value = value << 1 | bit
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i ids."""
        return self._range(symbol, 0, i)[1]

    def count(self, symbol: int, start: int = 0, stop: int | None = None) -> int:
        return self._range(symbol, start, self.n if stop is None else stop)[1]

    def _range(self, symbol: int, a: int, b: int) -> tuple[int, int]:
        if symbol >> self.bits or not self.n:
            return 0, 0
        for level in range(self.bits):
            x, y = self._ones(level, a), self._ones(level, b)
            a, b = (self.zeros[level] + x, self.zeros[level] + y) if symbol >> (self.bits - 1 - level) & 1 else (a - x, b - y)
        return a, b - a

    def select(self, symbol: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of symbol."""
        a, total = self._range(symbol, 0, self.n)
        if not 0 <= j < total:
            raise IndexError(j)
        at = a + j
        for level in reversed(range(self.bits)):
            bit = symbol >> (self.bits - 1 - level) & 1
            at = self._find(level, bit, at - self.zeros[level] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the last level up: each level's bits say which of the halves below is next."""
        seq = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            up, bit = np.empty_like(seq), seq.dtype.type(1 << (self.bits - 1 - level))
            low, high = 0, self.zeros[level]
            for k in range(self.ranks.shape[1] - 1 if self.n else 0):
                part = up[k * self.block : (k + 1) * self.block]
                chosen = np.unpackbits(self._raw(level, k))[: len(part)].view(bool)
                ones, zeros = np.flatnonzero(chosen), np.flatnonzero(~chosen)
                part[zeros] = seq[low : low + len(zeros)]
                part[ones] = seq[high : high + len(ones)] | bit
                low, high = low + len(zeros), high + len(ones)
            seq = up
        return seq


# ---- ids of texts

_TAIL = ".,;:!?"
#: Letters up to U+024F but for those whose lower case is not one letter or not one of them, then a tail.
_LATIN = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0239\u023c\u023f-\u0241]+[{_TAIL}]*$"


class Ids:
    """Ids of whole texts. The tokenizer drops white space and joins nothing across it, so words are encoded once and remembered.

    A word of Latin letters with a tail of .,;:!? falls apart between them, and its letters count as lower case: such words share
    what is remembered. The letters alone are one unit of the tokenizer, whose last id carries the mark of a word's end: many of
    them are encoded as one text and told apart by that mark.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bits = max(1, (self.t.get_vocab_size(with_added_tokens=True) - 1).bit_length())
        self.kind = "<u2" if self.bits <= 16 else "<u4"
        self.last = np.zeros(1 << self.bits, bool)
        self.last[[i for p, i in self.t.get_vocab(with_added_tokens=False).items() if p.endswith("</w>")]] = True

    def _encode(self, letters: list[str], others: list[str]) -> list[bytes]:
        out = []
        if letters:
            ids = np.array(self.t.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(letters) or ends[-1] != len(ids):  # a vocabulary without such marks
                others, letters = letters + others, []
            else:
                raw, width = ids.tobytes(), ids.itemsize
                ends = (ends * width).tolist()
                out = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out + [np.array(e.ids, self.kind).tobytes() for e in self.t.encode_batch_fast(others, add_special_tokens=False)]

    def _found(self, units: pa.Array, letters: bool) -> list[bytes]:
        """Ids of units, from memory or else encoded: letters alone, or anything."""
        names = units.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.memo.get, names))
        if None in found:
            new = []
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.older.get(names[k])
                    if found[k] is None:
                        new.append(k)
            fresh = [names[k] for k in new]
            for k, ids in zip(new, self._encode(fresh, []) if letters else self._encode([], fresh), strict=True):
                found[k] = ids
            if len(self.memo) >= MEMO:  # what was met since the last time stays at hand
                self.older, self.memo = self.memo, {}
            self.memo.update(zip(names, found, strict=True))
        return found

    def of(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and their numbers by text. Every distinct unit is looked up once."""
        lists = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        latin = pc.match_substring_regex(words.dictionary, _LATIN)
        whole = words.dictionary.filter(latin)
        cores = pc.utf8_lower(pc.utf8_rtrim(whole, _TAIL)).dictionary_encode()
        tails = pc.replace_substring_regex(whole, f"^[^{_TAIL}]+", "").dictionary_encode()
        others = words.dictionary.filter(pc.invert(latin))
        found = [*self._found(cores.dictionary, True), *self._found(tails.dictionary, False), *self._found(others, False), b""]
        # a word is two units of the pool: letters and tail, or itself and nothing
        n_cores, n_tails, is_latin = len(cores.dictionary), len(tails.dictionary), latin.to_numpy(zero_copy_only=False)
        units = np.full((len(is_latin), 2), len(found) - 1, np.int64)
        units[is_latin, 0], units[is_latin, 1] = cores.indices.to_numpy(), n_cores + tails.indices.to_numpy()
        units[~is_latin, 0] = n_cores + n_tails + np.arange(len(others))
        pool = np.frombuffer(b"".join(found), self.kind)
        size = np.array(list(map(len, found)), np.int64) // np.dtype(self.kind).itemsize
        begin = np.cumsum(size) - size
        which = units[words.indices.to_numpy()].ravel()
        lens = size[which]
        stop = np.cumsum(lens)
        ids = pool[np.repeat(begin[which] - stop + lens, lens) + np.arange(stop[-1] if len(stop) else 0)]
        ends = np.concatenate([[0], stop[1::2]])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        return np.insert(ids, ends, end), np.diff(ends, prepend=0) + 1


_ids: dict[str, Ids] = {}


def ids_of(path: str | None) -> Ids:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _ids:
        _ids[path] = Ids(path)
    return _ids[path]


# ---- tables


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _portions(batch: pa.RecordBatch):
    """Rows of about PORTION bytes of text together."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy())
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + PORTION, side="right")))
        yield batch.slice(a, b - a)
        a = b


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write shard files into folder (a URI that all executors reach); returns the manifest: task, part, path, n_tokens, n_docs."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())

    def run(batches):
        enc = ids_of(tokenizer_path)
        task, part = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def flush():
            nonlocal held, size, part
            ids, lengths, docs_held = (np.concatenate(x) for x in zip(*((i, n, d.fill_null(0).to_numpy()) for i, n, d in held), strict=True))
            known = np.concatenate([d.is_valid().to_numpy(zero_copy_only=False) for _, _, d in held])
            data = build(ids, lengths, docs_held, known, enc.bits)
            name = f"shard-{task:06d}-{part:06d}.wvm"
            fs, at = _fs(folder)
            fs.create_dir(at, recursive=True)
            own = f"{at}/.{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(own) as out:
                out.write(data)
            fs.move(own, f"{at}/{name}")  # whole or not at all
            row = pa.RecordBatch.from_arrays([pa.array([task]), pa.array([part]), pa.array([f"{folder}/{name}"]), pa.array([int(lengths.sum())]), pa.array([len(lengths)])], ["task", "part", "path", "n_tokens", "n_docs"])
            held, size, part = [], 0, part + 1
            return row

        for batch in batches:
            for piece in _portions(batch):
                ids, lengths = enc.of(piece.column(1), end_id)
                held.append((ids, lengths, piece.column(0)))
                size += len(ids)
                if size >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    return C.cut(dealt.mapInArrow(run, "task long, part long, path string, n_tokens long, n_docs long"), "wavelet-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    # one number per writing task comes to the driver
    total, bases = 0, []
    for task, n in manifest.groupBy("task").agg(F.sum("n_tokens")).orderBy("task").collect():
        bases.append((task, total))
        total += n
    earlier = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("within", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    files = files.join(F.broadcast(spark.createDataFrame(bases, "task long, base long")), "task")
    files = files.select("path", (F.col("base") + F.col("within")).alias("start")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = _fs(path)
                with fs.open_input_stream(at) as f:
                    shard = Shard(f.read())
                ids = shard.decode().astype("<u4")
                ends = np.cumsum(shard.lengths)
                begins = ends - shard.lengths
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=~shard.known), pa.array(begins + start), pa.array(shard.lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write the documents' ids into a new folder of the shared one and read them back."""
    return read(write(docs, C.fresh_path(docs.sparkSession, "wavelet"), tokenizer_path))
