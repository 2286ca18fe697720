"""Problem 7: encoding a corpus with a public byte-level BPE vocabulary.

Method: length-bucketed padded numpy matrices. The distinct pieces of an Arrow batch become rows of byte ids, padded
to the bucket's width; every round looks all adjacent pairs up in an open-addressing hash table, merges the leftmost
pair of least rank in each row and compacts the rows. Rows that have no pair left leave the matrix. Pieces above
``LONG`` bytes merge all non-overlapping occurrences of their least pair a round, so a very long piece costs rounds by
distinct pairs, not by length. That gives the same ids if a pair with a merged token always ranks after the merge that makes the token, which is
checked when a vocabulary is read; for one without this property all pieces go the first way.

Defined cases: null and empty texts give an empty list; names of special tokens are plain text; a text of any length is
encoded whole; a column that already has the result's name is replaced. The vocabulary's path is a path of
the driver; its content (a few MB, whatever the corpus) goes to the workers as a broadcast value.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Fixed value: how byte-level BPE of this family cuts a text into pieces.
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
LONG = 256
NONE = np.int32(2**31 - 1)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files: itself if printable, else the next letter from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    for i, b in enumerate(x for x in range(256) if x not in set(shown)):
        letters[chr(256 + i)] = b
    return letters


class PairTable:
    """Open-addressing hash table from a pair of ids to (rank, merged id)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(left) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NONE, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot, todo = self._slot(key), np.arange(len(key))
        while len(todo):  # each round places one key per free slot; the rest probe on
            free = self.keys[slot[todo]] < 0
            tried = todo[free]
            _, one = np.unique(slot[tried], return_index=True)
            won = tried[one]
            self.keys[slot[won]], self.rank[slot[won]], self.merged[slot[won]] = key[won], won, merged[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            taken = self.keys[slot[todo]] != key[todo]
            slot[todo[taken]] = (slot[todo[taken]] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """Slot of every key, or -1."""
        slot = self._slot(key)
        out = np.full(key.shape, -1, np.int64)
        todo = np.arange(key.size)
        k, s, o = key.ravel(), slot.ravel(), out.ravel()
        while len(todo):
            at = self.keys[s[todo]]
            hit = at == k[todo]
            o[todo[hit]] = s[todo[hit]]
            todo = todo[~hit & (at >= 0)]
            s[todo] = (s[todo] + 1) & ((1 << self.bits) - 1)
        return o.reshape(key.shape)


class Encoder:
    def __init__(self, content: bytes):
        spec = json.loads(content)["model"]
        vocab = spec["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = PairTable(left, right, merged)
        made = np.full(max(vocab.values()) + 1, -1, np.int64)  # the merge that makes a token
        made[merged] = np.arange(len(merged))
        rank = np.arange(len(pairs))
        self.ordered = len(np.unique(merged)) == len(merged) and bool(((made[left] < rank) & (made[right] < rank)).all())
        letters = _byte_letters()
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        self.known: dict[str, np.ndarray] = {}

    def _ranks(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = m[:, :-1].astype(np.int64), m[:, 1:].astype(np.int64)
        rank = np.full(a.shape, NONE, np.int32)
        slot = np.full(a.shape, -1, np.int64)
        there = b >= 0
        found = self.table.find((a[there] << 32) | b[there])
        slot[there] = found
        rank[there] = np.where(found >= 0, self.table.rank[found], NONE)
        return rank, slot

    def merge_rows(self, m: np.ndarray) -> list[np.ndarray]:
        """Ids of every row of a matrix of byte ids padded with -1."""
        n = len(m)
        done: list[np.ndarray | None] = [None] * n
        rows = np.arange(n)
        while len(rows):
            if m.shape[1] < 2:
                rank = np.full((len(rows), 1), NONE, np.int32)
                slot = np.full((len(rows), 1), -1, np.int64)
            else:
                rank, slot = self._ranks(m)
            at = rank.argmin(axis=1)
            pick = np.arange(len(rows))
            go = rank[pick, at] < NONE
            for i in np.flatnonzero(~go):
                r = m[i]
                done[rows[i]] = r[r >= 0]
            m, rows, at, slot = m[go], rows[go], at[go], slot[go]
            if not len(rows):
                break
            pick = np.arange(len(rows))
            m[pick, at] = self.table.merged[slot[pick, at]]
            cols = np.arange(m.shape[1] - 1)[None, :]
            m = np.take_along_axis(m, cols + (cols > at[:, None]), axis=1)  # compaction: the right half of the pair goes
        return done  # type: ignore[return-value]

    def merge_long(self, x: np.ndarray) -> np.ndarray:
        while len(x) > 1:
            rank, slot = self._ranks(x[None, :])
            rank, slot = rank[0], slot[0]
            low = rank.min()
            if low == NONE:
                break
            hit = np.flatnonzero(rank == low)
            # of touching occurrences (a a a), every second one from the left
            new = np.r_[True, np.diff(hit) > 1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            x[hit] = self.table.merged[slot[hit[0]]]
            keep = np.ones(len(x), bool)
            keep[hit + 1] = False
            x = x[keep]
        return x

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of all pieces into ``known``."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.array([len(r) for r in raw])
        width = 1 << np.maximum(0, np.ceil(np.log2(np.maximum(length, 1))).astype(int))
        for w in np.unique(width):
            where = np.flatnonzero(width == w)
            if w > LONG and self.ordered:
                for i in where:
                    self.known[pieces[i]] = self.merge_long(self.byte_id[np.frombuffer(raw[i], np.uint8)].copy())
                continue
            step = max(1, (1 << 21) // int(w))
            for c in range(0, len(where), step):
                part = where[c : c + step]
                m = np.full((len(part), int(w)), -1, np.int32)
                n = length[part]
                flat = self.byte_id[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                m[np.arange(int(w))[None, :] < n[:, None]] = flat
                for i, ids in zip(part, self.merge_rows(m)):
                    self.known[pieces[i]] = ids

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts joined, end offset of each)."""
        if len(self.known) > 500_000:
            self.known.clear()
        cut = [PIECES.findall(t) if t else [] for t in texts]
        fresh = {p for c in cut for p in c}.difference(self.known)
        if fresh:
            self.encode_pieces(list(fresh))
        known = self.known
        parts = [known[p] for c in cut for p in c]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        per = np.fromiter((len(c) for c in cut), np.int64, len(cut))
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(per)] if len(cut) else np.zeros(0, np.int64)
        return ids, ends


@functools.lru_cache(maxsize=2)
def encoder(content: bytes) -> Encoder:
    return Encoder(content)


def _shared(df: DataFrame, path: str | None):
    """The content of a vocabulary file as a broadcast value."""
    with open(path or default_vocabulary(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most about ``chars`` bytes of text, at least a row each, so that memory doesn't follow the batch."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encode_texts(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with an array<int> column of token ids in place of ``text``; all other columns stay as they are."""
    vocabulary = _shared(df, path)
    kept = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for whole in batches:
            for b in _slices(whole, text):
                flat, ends = enc.encode(b.column(text).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), lists], names=[*kept, ids])

    schema = StructType([*(df.schema[c] for c in kept), StructField(ids, ArrayType(IntegerType(), False))])
    return df.select(*kept, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str = "text", n: str = "n_tokens", path: str | None = None) -> DataFrame:
    """``df`` with a bigint column of token counts in place of ``text``; the ids stay in the worker."""
    vocabulary = _shared(df, path)
    kept = [c for c in df.columns if c not in (text, n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary.value)
        for whole in batches:
            for b in _slices(whole, text):
                _, ends = enc.encode(b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(np.diff(np.r_[0, ends]).astype(np.int64))], names=[*kept, n])

    return df.select(*kept, text).mapInArrow(run, StructType([*(df.schema[c] for c in kept), StructField(n, LongType(), False)]))


