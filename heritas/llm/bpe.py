"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1: a minimal perfect hash over the vocabulary (hash and displace: one
displacement a bucket, as many slots as entries) resolves a whole pre-token by
one probe and one comparison.  Tier 2, for pre-tokens outside the vocabulary:
a heap of candidate merges over a linked list of bytes, O(n log n) for a piece
of n bytes, lowest rank first and leftmost among equals.

Documents are independent, so the plan is a single narrow stage.  A worker
keeps the ids of short chunks it has seen (CACHE_BYTES, emptied when full).

Null texts count as empty; empty texts have no ids; copies and repeated
doc_ids stay separate rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import batches_by_size, prepare, space_chunks

#: Bytes (estimated) that a worker's cache may hold, and what an entry takes
#: besides its characters and ids; longer chunks aren't kept.
CACHE_BYTES, ENTRY_BYTES, CACHED_CHUNK = 128 << 20, 200, 64
#: Characters of text that are encoded at once (memory bound).
AT_ONCE = 4 << 20
#: The pattern for which letters and a mark behind a space are two pre-tokens.
GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MARKS = frozenset(",.;:!?")
_M = 0xFFFFFFFF
_CODECS: dict = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """Minimal perfect hash from byte strings to 0..n-1, with exact rejection."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 2)
        groups: dict[int, list[tuple[int, int, bytes]]] = {}
        for k in keys:
            b, x, y = self._three(k)
            groups.setdefault(b, []).append((x, y, k))
        self.shift = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        left = (i for i in range(n) if self.keys[i] is None)
        for b, own in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(own) == 1:  # any free slot will do: name it
                d = -1 - next(left)
                at = [-1 - d]
            else:
                d, at = self._displace(own)
            self.shift[b] = d
            for i, (_, _, k) in zip(at, own):
                self.keys[i] = k

    def _displace(self, own: list[tuple[int, int, bytes]]) -> tuple[int, list[int]]:
        for d in range(50 * self.n + 1000):
            at = [self._slot(x, y, d) for x, y, _ in own]
            if all(self.keys[i] is None for i in at) and len(set(at)) == len(at):
                return d, at
        raise ValueError("no displacement; are the keys distinct?")

    def _slot(self, x: int, y: int, d: int) -> int:
        return ((x ^ d * 0x9E3779B1) * y >> 7) % self.n

    def _three(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & _M) % self.buckets, (h >> 32) & _M, ((h >> 64) & _M) | 1

    def find(self, key: bytes) -> int:
        """The key's slot, or -1 if it isn't one of the keys."""
        b, x, y = self._three(key)
        d = self.shift[b]
        i = -1 - d if d < 0 else self._slot(x, y, d)
        return i if self.keys[i] == key else -1


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Of each two neighbouring entries whose bytes together are an entry
    (left rank << 24 | right rank): the rank of the whole."""
    out, get = {}, ranks.get
    for whole, r in ranks.items():
        for cut in range(1, len(whole)):
            left = get(whole[:cut])
            right = None if left is None else get(whole[cut:])
            if right is not None:
                out[left << 24 | right] = r
    return out


def merge(ids: list[int], pairs: dict[int, int]) -> list[int]:
    """Merge the ids of single bytes: a heap over linked bytes."""
    n, get, push, pop = len(ids), pairs.get, heapq.heappush, heapq.heappop
    rank = [get(a << 24 | b, -1) for a, b in zip(ids, ids[1:])]
    heap = [r << 40 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    heapq.heapify(heap)
    rank.append(-1)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        x = pop(heap)
        i = x & 0xFFFFFFFFFF
        r = x >> 40
        if rank[i] != r:
            continue
        j = after[i]
        k = after[i] = after[j]
        ids[i], ids[j], rank[j] = r, -1, -1
        if k < n:
            before[k] = i
            s = rank[i] = get(r << 24 | ids[k], -1)
            if s >= 0:
                push(heap, s << 40 | i)
        else:
            rank[i] = -1
        h = before[i]
        if h >= 0:
            s = rank[h] = get(ids[h] << 24 | r, -1)
            if s >= 0:
                push(heap, s << 40 | h)
    return [x for x in ids if x >= 0]


class Codec:
    def __init__(self, path: str, pattern: str):
        ranks = self.ranks = read_ranks(path)
        self.hash = PerfectHash(list(ranks))
        self.slot_id = [ranks[k] for k in self.hash.keys]
        self.pairs = pair_table(ranks)
        self.byte_id = [ranks[bytes([i])] for i in range(256)]
        self.find_pieces = regex.compile(pattern).findall
        self.plain = pattern == GPT_PATTERN
        top = max(ranks.values()) + 1
        entry = [b""] * top
        for k, i in ranks.items():
            entry[i] = k
        self.size = np.array([len(k) for k in entry], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(entry), np.uint8)
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.held = 0

    def piece(self, text: str) -> bytes:
        """Ids of a pre-token: tier 1, then tier 2."""
        raw = text.encode()
        at = self.hash.find(raw)
        if at >= 0:
            return self.slot_id[at].to_bytes(4, "little")
        one = self.byte_id
        return array("I", merge([one[x] for x in raw], self.pairs)).tobytes()

    def _chunk(self, x: str, lead: str) -> bytes:
        if self.plain and lead:
            # Letters with at most a mark behind them: the pre-tokens are known.
            if x.isalpha():
                return self.piece(" " + x)
            word = x[:-1]
            if x[-1:] in _MARKS and word.isalpha():
                ids = self.rest.get(word)
                if ids is None:
                    ids = self.rest[word] = self.piece(" " + word)
                return ids + self.piece(x[-1])
        return b"".join([self.piece(p) for p in self.find_pieces(lead + x)])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian uint32, a byte string a text."""
        if self.held > CACHE_BYTES:
            self.first.clear()
            self.rest.clear()
            self.held = 0
        cut = [space_chunks(x) for x in texts]
        words: set[str] = set()
        for x in cut:
            words.update(x[1:])
        first, rest = self.first, self.rest
        passing = [*self._learn(first, {x[0] for x in cut}, ""), *self._learn(rest, words, " ")]
        get = rest.__getitem__
        out = [first[x[0]] + b"".join(map(get, x[1:])) for x in cut]
        for known, x in passing:
            del known[x]
        return out

    def _learn(self, known: dict[str, bytes], chunks: set[str], lead: str) -> list[tuple[dict[str, bytes], str]]:
        """Add the chunks' ids; returns the long ones, which aren't to stay."""
        passing = []
        for x in chunks.difference(known):
            ids = known[x] = self._chunk(x, lead)
            if len(x) <= CACHED_CHUNK:
                self.held += ENTRY_BYTES + len(x) + len(ids)
            else:
                passing.append((known, x))
        return passing

    def decode(self, many: list[bytes]) -> list[bytes]:
        """Bytes of each list of ids: one gather from the vocabulary's bytes."""
        ids = np.frombuffer(b"".join(many), "<u4")
        size = self.size[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        out = self.flat[np.repeat(self.begin[ids] - (end - size), size) + np.arange(total)].tobytes()
        stop = np.cumsum([len(x) // 4 for x in many])
        stop = np.concatenate([[0], end])[stop] if len(many) else stop
        start = np.concatenate([[0], stop[:-1]])
        return [out[a:b] for a, b in zip(start.tolist(), stop.tolist())]


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_decode(docs: DataFrame, path: str, pattern: str, content: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with content, ids
    (little-endian uint32) and decoded (bytes)."""
    prepare(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for doc, texts in batches_by_size(batches, AT_ONCE):
            ids = c.encode(texts)
            back = c.decode(ids)
            columns = {
                "doc_id": doc,
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
            }
            if content:
                columns |= {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(back, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded binary" * content
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
