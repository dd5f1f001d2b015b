"""Encoding and decoding with a SentencePiece vocabulary by a streaming Viterbi search.

The best segmentation has the greatest sum of piece scores; of two equal ones the one whose last differing piece is longer.
The search keeps only the positions that a piece may still reach (a window bounded by the longest piece) with their
backpointers, and commits ids as soon as the backpointer paths of all of them pass through one boundary.

A vocabulary none of whose pieces has a blank mark after another character forces such a boundary before every blank, so
equal stretches between blanks have equal ids. encode() hands every stretch to the streaming search, and remembers the ids it
committed for stretches of up to LONGEST_MEMO characters, up to twice MEMO of them in each worker.

A text starts with one blank mark of its own; characters without a piece, and the blank mark itself where a text holds it,
become one byte piece per UTF-8 byte. decode(encode(x)) == x for every x.

Cases: null or empty text has no ids; repeated rows and rows without doc_id are encoded one by one; empty table: empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as C

BLANK = "▁"
#: Stands for a blank mark that the text itself holds; lone surrogates occur in no text.
OWN_BLANK = "\ud800"
MODEL = "piece_bpe_32k.model"
MEMO = 300_000
#: Characters that the search is handed at a time, and the longest stretch that is remembered (longer ones seldom recur).
PORTION = 4096
LONGEST_MEMO = 48
_STRETCH = re.compile(f"{BLANK}+[^{BLANK}]*")
#: The same before blanks are marked.
_PLAIN_STRETCH = re.compile(" +[^ ]*")
_NEG = float("-inf")


class Vocabulary:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.vocab_size()
        self.byte_id, self.arcs, self.out = [0] * 256, {}, [b""] * self.size
        scores = []
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_id[b], self.out[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.arcs[piece] = (model.get_score(i), i)
                self.out[i] = piece.replace(BLANK, " ").encode()
                scores.append(model.get_score(i))
        self.longest = max(map(len, self.arcs), default=1)
        self.fallback = min((s for s in scores if s > -1e8), default=0.0) - 10  # a character spelt in bytes
        self.tree: dict = {}  # by the next character: [score or None, id, tree of what may follow]
        for piece, (score, i) in self.arcs.items():
            level = self.tree
            for c in piece[:-1]:
                level = level.setdefault(c, [None, -1, {}])[2]
            node = level.setdefault(piece[-1], [None, -1, {}])
            node[:2] = score, i
        self.splits_at_blanks = not any(BLANK in p.lstrip(BLANK) for p in self.arcs)

    def spell(self, char: str) -> list[int]:
        return [self.byte_id[b] for b in (BLANK if char == OWN_BLANK else char).encode()]


class Stream:
    """push() text, get ids as they become certain; finish() takes the last of it, gives the rest and makes ready for another text.

    Between two calls only the text after the last committed boundary is held, with a score and a backpointer per position. The
    positions that a path may still end at lie between `at` and `reach`, at most the longest piece apart.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.widest = 0  # most characters held when the paths were traced to their meeting point
        self._reset()

    def _reset(self) -> None:
        self.text = ""
        self.best: list[float] = [0.0]
        self.back: list[tuple[int, int]] = [(0, -1)]  # where the best last piece starts, and its id (-1: spelt in bytes)
        self.at = 0  # the next position to leave from
        self.reach = 0  # the furthest position that a piece reaches

    def push(self, text: str) -> list[int]:
        self.text += text
        out: list[int] = []
        done = self._run(len(self.text) - self.v.longest, out)
        if done:
            self.text, self.best = self.text[done:], self.best[done:]
            self.back = [(max(k - done, 0), i) for k, i in self.back[done:]]
            self.at, self.reach = self.at - done, self.reach - done
        return out

    def finish(self, last: str = "") -> list[int]:
        self.text += last
        out: list[int] = []
        done = self._run(len(self.text), out)
        self._commit(done, len(self.text), out)
        self._reset()
        return out

    def _run(self, until: int, out: list[int]) -> int:
        """Leave every position before `until`; the last committed boundary."""
        text, best, back, size = self.text, self.best, self.back, len(self.text)
        tree, fallback, patience = self.v.tree, self.v.fallback, 4 * self.v.longest
        new = size + 1 - len(best)
        best += [_NEG] * new
        back += [(0, -1)] * new
        i, reach, done = self.at, self.reach, 0
        traced = i
        while i < until:
            if i == reach:  # every path passes here
                if i > done:
                    self._commit(done, i, out)
                    done = traced = i
                best[i] = 0.0  # what lies behind weighs on all paths alike
            elif i - traced >= patience:
                meet = self._meeting(i, reach)
                self.widest = max(self.widest, reach - done)
                self._commit(done, max(meet, done), out)
                done, traced = max(meet, done), i
            base = best[i]
            node = tree.get(text[i])
            j = i + 1
            if node is None or node[0] is None:
                if j > reach:
                    reach = j
                if base + fallback > best[j]:
                    best[j], back[j] = base + fallback, (i, -1)
            while node is not None:
                if node[0] is not None:
                    if j > reach:
                        reach = j
                    score = base + node[0]
                    if score > best[j]:
                        best[j], back[j] = score, (i, node[1])
                if j == size:
                    break
                node = node[2].get(text[j])
                j += 1
            i += 1
        self.at, self.reach = i, reach
        return done

    def _meeting(self, at: int, reach: int) -> int:
        """The last boundary that the paths of all positions still alive share."""
        alive = {k for k in range(at, reach + 1) if self.best[k] > _NEG}
        while len(alive) > 1:
            k = max(alive)
            alive.remove(k)
            alive.add(self.back[k][0])
        return alive.pop() if alive else 0

    def _commit(self, since: int, to: int, out: list[int]) -> None:
        path: list[int] = []
        while to > since:
            start, i = self.back[to]
            if i >= 0:
                path.append(i)
            else:
                path.extend(reversed(self.v.spell(self.text[start])))
            to = start
        out.extend(reversed(path))


def marked(text: str) -> str:
    return BLANK + text.replace(BLANK, OWN_BLANK).replace(" ", BLANK)


def encode_stream(vocab: Vocabulary, pieces_of_text: Iterable[str]) -> Iterator[int]:
    """Ids of a text that comes in pieces."""
    stream, first = Stream(vocab), True
    for x in pieces_of_text:
        if x:
            yield from stream.push(marked(x) if first else marked(x)[1:])
            first = False
    yield from stream.finish()


class Encoder:
    def __init__(self, path: str):
        self.path = path
        self.v = Vocabulary(path)
        self.stream = Stream(self.v)
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        """The streaming search over a text in portions, the last of which finish() takes."""
        s, k = self.stream, 0
        out: list[int] = []
        while len(text) - k > PORTION:
            out += s.push(text[k : k + PORTION])
            k += PORTION
        out += s.finish(text[k:])
        return struct.pack(f"<{len(out)}I", *out)

    def _fresh(self, stretch: str) -> bytes:
        """stretch: with plain blanks, since a string with a blank mark takes two bytes a character."""
        ids = self.older.get(stretch) or self._ids(stretch.replace(" ", BLANK))
        if len(stretch) <= LONGEST_MEMO:
            if len(self.memo) >= MEMO:  # the stretches met since the last time stay at hand
                self.older, self.memo = self.memo, {}
            self.memo[stretch] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.v.splits_at_blanks:
            return self._ids(marked(text))
        memo, out = self.memo.get, []
        for s in _PLAIN_STRETCH.findall(" " + text.replace(BLANK, OWN_BLANK)):
            ids = memo(s)
            if ids is None:
                ids = self._fresh(s)
                memo = self.memo.get  # another one if the memory was turned over
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out = self.v.out
        return b"".join([out[i] for i in np.frombuffer(ids, "<u4").tolist()])[1:].decode()


def encoder(path: str | None = None) -> Encoder:
    """This worker's encoder; path: of the model file, by default the public 32,000-piece vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return C.kept(("viterbi", path), lambda: Encoder(path))


def encoded(docs: DataFrame, model_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip; with_ids: ids array<int> too."""

    def run(batches):
        enc = encoder(model_path)
        for batch in C.portions(batches, 1):
            found = [enc.encode(x.as_py()) for x in batch.column(1)]
            back = [enc.decode(b) == (x.as_py() or "") for b, x in zip(found, batch.column(1), strict=True)]
            cols = [batch.column(0), pa.array([len(b) // 4 for b in found], pa.int64()), pa.array([zlib.crc32(b) for b in found], pa.int64()), pa.array(back)]
            names = ["doc_id", "n_ids", "ids_crc32", "round_trip"]
            if with_ids:
                ends = np.cumsum([0, *[len(b) // 4 for b in found]])
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)
