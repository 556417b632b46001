"""Byte-level BPE encoding and decoding over length-bucketed padded matrices.

A text is cut by the tokenizer's pattern; every distinct piece becomes a row of token ids. Rows of
similar length form a padded matrix in which, each round, every row merges its leftmost pair of least
rank: pair ranks come from a hashed lookup table (open addressing, built from all two-part splits of
the vocabulary), the merged column is closed by compaction, and finished rows leave the matrix. A
piece that is itself a token is that token, as in the library whose files are read. Rows longer than
``LONG`` ids merge with a heap of (rank, position) instead: the same order of merges without a round
per merge over a wide matrix.

Encoded pieces are kept in a bounded per-worker cache that is emptied when full; results do not
depend on it. The vocabulary file's path is a parameter; it must exist on every worker.

Defined cases: null texts are empty and give no tokens; every text round-trips to its UTF-8 bytes;
special-token strings are ordinary text. Extra columns are ignored; repeated rows stay.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from itertools import islice

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featuremart.llm.common import U64, map_batches, mix, read_table

LONG = 192            # ids in a row of a matrix
CACHE = 400_000       # pieces kept per worker
ROWS = 8192           # rows of a matrix
GROUP = 2_000_000     # characters encoded together
SLICE = 512           # texts taken at a time
NONE = np.int32(np.iinfo(np.int32).max)


class Codec:
    """Ranks, the hashed pair table and the byte strings of a vocabulary file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.find = self.pattern.findall
        self.byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        left, right, made = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        self._build(np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(made, dtype=np.int32))
        self.cache: dict[str, bytes] = {}

    # -- hashed pair lookup
    def _build(self, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(2, 3 * len(a))))))
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.vals = np.full(1 << bits, NONE, dtype=np.int32)
        key = a << 32 | b
        at = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):  # linear probing, all keys at once: the first of a slot takes it
            free = self.keys[at[todo]] < 0
            _, first = np.unique(at[todo][free], return_index=True)
            won = todo[free][first]
            self.keys[at[won]] = key[won]
            self.vals[at[won]] = rank[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = at[todo] + 1 & self.mask
        self.pairs = dict(zip(key.tolist(), rank.tolist()))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(U64)) & U64(self.mask)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where the pair does not merge."""
        key = a.astype(np.int64) << 32 | b
        at = self._slot(key)
        seen = self.keys[at]
        out = np.where(seen == key, self.vals[at], NONE)
        todo = np.flatnonzero((seen != key) & (seen >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & self.mask
            seen = self.keys[at[todo]]
            hit = seen == key[todo]
            out[todo[hit]] = self.vals[at[todo[hit]]]
            todo = todo[~hit & (seen >= 0)]
        return out

    # -- merging
    def merge_matrix(self, rows: list[bytes]) -> list[bytes]:
        """Encode rows of similar length; ids as little-endian 32-bit bytes."""
        n = np.array([len(r) for r in rows])
        width = int(n.max())
        ids = np.full((len(rows), width), -1, dtype=np.int32)
        inside = np.arange(width) < n[:, None]
        ids[inside] = self.byte[np.frombuffer(b"".join(rows), dtype=np.uint8)]
        rank = np.full((len(rows), max(1, width - 1)), NONE, dtype=np.int32)
        if width > 1:
            both = inside[:, 1:]
            rank[both] = self.lookup(ids[:, :-1][both], ids[:, 1:][both])
        out: list = [None] * len(rows)
        who = np.arange(len(rows))
        while len(who):
            at = rank.argmin(axis=1)  # leftmost pair of least rank
            lane = np.arange(len(who))
            best = rank[lane, at]
            over = best == NONE
            for i in np.flatnonzero(over):
                out[who[i]] = ids[i, :n[who[i]]].astype("<u4").tobytes()
            go = ~over
            if not go.any():
                break
            who, ids, rank, at, best = who[go], ids[go], rank[go], at[go], best[go]
            lane = np.arange(len(who))
            n[who] -= 1
            width = int(n[who].max())
            # compaction: the column right of the merged one goes, all behind it move left
            cols = np.arange(width)
            take = cols + (cols > at[:, None])
            ids = np.take_along_axis(ids, np.minimum(take, ids.shape[1] - 1), axis=1)
            ids[lane, at] = best
            ids[cols >= n[who][:, None]] = -1
            cols = np.arange(max(1, width - 1))
            take = cols + (cols >= at[:, None])
            rank = np.take_along_axis(rank, np.minimum(take, rank.shape[1] - 1), axis=1)
            rank[cols >= n[who][:, None] - 1] = NONE
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < n[who])
            if len(left):
                rank[left, at[left] - 1] = self.lookup(ids[left, at[left] - 1], ids[left, at[left]])
            if len(right):
                rank[right, at[right]] = self.lookup(ids[right, at[right]], ids[right, at[right] + 1])
        return out

    def merge_long(self, piece: bytes) -> bytes:
        """The same merges for one long row: a heap of (rank, position) over a linked list."""
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue  # one side has merged since
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i))
            h = before[i]
            if h >= 0 and (s := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    # -- texts
    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian 32-bit bytes. Texts are taken in groups of at most
        ``GROUP`` characters, longer ones piece block by piece block, so memory stays bounded."""
        out, group, size = [], [], 0
        for t in texts:
            if group and size + len(t) > GROUP:
                out += self._encode([self.find(x) for x in group])
                group, size = [], 0
            if len(t) > GROUP:
                found = (m[0] for m in self.pattern.finditer(t))
                out.append(b"".join(self._encode([block])[0] for block in iter(lambda: list(islice(found, GROUP // 8)), [])))
            else:
                group.append(t)
                size += len(t)
        return out + self._encode([self.find(x) for x in group])

    def _encode(self, cut: list[list[str]]) -> list[bytes]:
        cache = self.cache
        if len(cache) > CACHE:
            cache.clear()
        fresh = set().union(*cut).difference(cache)
        buckets: dict[int, list[str]] = defaultdict(list)
        for piece in fresh:
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                cache[piece] = self.merge_long(raw)
            else:
                n = len(raw)  # padding of an eighth at most up to 80 ids
                buckets[n if n <= 16 else 16 + (n - 16) // 8 if n <= 80 else 24 + (n - 80) // 32].append(piece)
        for pieces in buckets.values():
            for at in range(0, len(pieces), ROWS):
                part = pieces[at:at + ROWS]
                for piece, ids in zip(part, self.merge_matrix([p.encode("utf-8", "surrogatepass") for p in part])):
                    cache[piece] = ids
        return [b"".join(map(cache.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>) of every whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(ids, texts):
        c = codec(path, pattern)
        return ids, [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in c.encode_all([t or "" for t in texts])]

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                       f"doc_id {kind}, ids array<int>", SLICE)


def decode(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (doc_id, bytes) of encoded rows (null ids: empty)."""
    kind = dict(rows.dtypes)[id_col]

    def run(keys, ids):
        c = codec(path, pattern)
        return keys, [c.decode(np.array(x or [], dtype="<u4").tobytes()) for x in ids]

    return map_batches(rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), run,
                       f"doc_id {kind}, bytes binary", SLICE)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; digests of both, so that ids need not leave the task."""
    kind = dict(docs.dtypes)[id_col]

    def run(keys, texts):
        c = codec(path, pattern)
        ids = c.encode_all([t or "" for t in texts])
        sha = hashlib.sha256
        return (keys, [len(x) // 4 for x in ids], [sha(x).hexdigest() for x in ids],
                [sha(c.decode(x)).hexdigest() for x in ids])

    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run,
                       f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", SLICE)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN)
