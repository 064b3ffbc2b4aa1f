"""Problem 8: token ids of a public byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are
tokens as a whole. A miss is cut where no token of the vocabulary holds the two
neighbouring bytes, which no merge can cross, and each piece is merged by rank with
a heap over linked bytes. The vocabulary is a file of fixed size, read on the driver
and broadcast; workers keep a bounded memory of pre-tokens.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the public pre-token pattern of these vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMO = 300_000


class PerfectHash:
    """Minimal perfect hash by hash and displace: one slot per key, the keys' ranks in slot order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        keys = list(ranks)
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        self.hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(self.hashes):
            groups[h % self.buckets].append(i)
        shift = np.zeros(self.buckets, np.int64)
        taken = bytearray(n)
        slot_of = [0] * n
        free = None
        for g in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            members = groups[g]
            if not members:
                break
            if len(members) == 1:  # the last keys take what is left, by place
                if free is None:
                    free = iter([s for s in range(n) if not taken[s]])
                s = next(free)
                slot_of[members[0]], shift[g] = s, -s - 1
                continue
            d = 0
            while True:
                slots = [self._slot(self.hashes[i], d) for i in members]
                if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                    break
                d += 1
            shift[g] = d
            for i, s in zip(members, slots):
                taken[s], slot_of[i] = 1, s
        self.shift = shift.tolist()
        self.keys: list[bytes] = [b""] * n
        self.ids = [0] * n
        for i, s in enumerate(slot_of):
            self.keys[s], self.ids[s] = keys[i], ranks[keys[i]]
        del self.hashes

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * 0x9E3779B97F4A7C15)) * 0xFF51AFD7ED558CCD) >> 32) & 0xFFFFFFFF) % self.n

    def get(self, key: bytes) -> int:
        """The key's rank, or -1."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else -1


class BytePairEncoder:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.table = PerfectHash(ranks)
        joined = np.zeros((256, 256), bool)
        for t in ranks:
            for x, y in zip(t, t[1:]):
                joined[x, y] = True
        self.joined = [bytes(r.astype(np.uint8)) for r in joined]
        self._open()

    def _open(self) -> None:
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {"table": self.table, "joined": self.joined}

    def __setstate__(self, s: dict) -> None:
        self.__dict__.update(s)
        self._open()

    def _merge(self, b: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost of equals: a heap of candidate pairs over a linked list of parts."""
        get = self.table.get
        n = len(b)
        end = list(range(1, n + 1))  # part i covers b[i:end[i]]
        prev, alive = list(range(-1, n - 1)), [True] * n
        heap = []
        for i in range(n - 1):
            r = get(b[i : i + 2])
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n:
                continue
            j = end[i]
            if end[j] != stop or get(b[i:stop]) != r:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                prev[stop] = i
                q = get(b[i : end[stop]])
                if q >= 0:
                    heapq.heappush(heap, (q, i, end[stop]))
            if prev[i] >= 0:
                q = get(b[prev[i] : stop])
                if q >= 0:
                    heapq.heappush(heap, (q, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(get(b[i : end[i]]))
            i = end[i]
        return tuple(out)

    def _piece(self, b: bytes) -> tuple[int, ...]:
        got = self.pieces.get(b)
        if got is None:
            r = self.table.get(b)
            got = (r,) if r >= 0 else self._merge(b)
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            self.pieces[b] = got
        return got

    def _pre_token(self, t: str) -> tuple[int, ...]:
        b = t.encode("utf-8", "replace")
        r = self.table.get(b)
        if r >= 0:
            return (r,)
        joined, out, at = self.joined, [], 0
        for i in range(1, len(b)):
            if not joined[b[i - 1]][b[i]]:
                out += self._piece(b[at:i])
                at = i
        out += self._piece(b[at:])
        return tuple(out)

    def encode(self, text: str, out: array) -> None:
        """Appends the ids of a text; strings that look like special tokens are ordinary text."""
        memo = self.memo
        for t in self.pattern.findall(text):
            ids = memo.get(t)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = self._pre_token(t)
                if len(t) <= 64:
                    memo[t] = ids
            out.extend(ids)


_here: dict[str, BytePairEncoder] = {}


def encoder(df: DataFrame, name: str, folder: str = TOKENIZER_DIR):
    """A broadcast encoder of a vocabulary file; its size is the file's."""
    path = f"{folder}/{name}.tiktoken"
    if path not in _here:
        _here[path] = BytePairEncoder(path)
    return df.sparkSession.sparkContext.broadcast(_here[path])


def encode(df: DataFrame, id_col: str, text_col: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids): one row per row; an empty text gives an empty array, a null text null."""
    shared = encoder(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            flat, offsets, null = array("i"), [0], []
            for x in b.column(1).to_pylist():
                if x:
                    enc.encode(x, flat)
                offsets.append(len(flat))
                null.append(x is None)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)), mask=pa.array(null))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, name: str, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokens): a null or empty text has none."""
    shared = encoder(df, name, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = shared.value
        for b in batches:
            n = []
            for x in b.column(1).to_pylist():
                flat = array("i")
                if x:
                    enc.encode(x, flat)
                n.append(len(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "tokens"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, tokens long")
