"""Token-ID output: frequency-ranked ids in byte-aligned variable-length codes.

File format.  A token file is a Parquet data set of blocks in ascending doc_id
order (shard = range partition, block = number in its shard).  A block holds up
to BLOCK_TOKENS ids (a longer document has a block of its own) as

    control   2 bits an id, four ids a byte, low bits first: bytes - 1
    data      the rank's bytes, low byte first, without leading zero bytes
    doc_ids, lengths   its documents and how many ids each has
    n_ids, crc   ids in the block, crc32 of control + data

An id is stored as its rank by corpus frequency (ties: smaller id first), so
the 256 most frequent ids take one byte.  The table `ranks` (rank -> id) lies
beside the blocks.  Control bytes lie apart from data bytes, so a reader finds
all lengths by one table lookup a byte, and all offsets by one cumulative sum.

Plan: one narrow pass of tokenization (written once), a count whose partial
results have at most one row an id and task, one range shuffle of packed ids,
then narrow passes.  Only the frequency table (bounded by the vocabulary) and
nothing else comes to the driver.

Strings of the tokenizer's added tokens in a text become their ids, as the
library has it by itself.  Null or empty texts hold the end id alone; repeated
or null doc_ids stay separate rows, in order of length and then a hash of their
ids; an empty table gives an empty result; further columns of the input are
ignored; a long text is worked on in pieces of WORDS_AT_ONCE chunks.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heritas.llm.common import batches_by_size, drop_stored, prepare, space_chunks, stored

BLOCK_TOKENS = 1 << 20
#: Bytes (estimated) that a worker's chunk cache may hold, and what an entry
#: takes besides its characters and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 150
#: Longer chunks are encoded anew each time, so that none fills the cache.
CACHED_CHUNK = 64
#: Characters of text, and chunks, that are worked on at once (memory bound).
AT_ONCE, WORDS_AT_ONCE = 4 << 20, 1 << 19
END_ID = 0

_TOKENIZER: dict = {}
#: White space of the pre-tokens' pattern, for RE2.
_WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
#: Texts that aren't cut by Arrow: two white-space characters side by side.
_ODD = rf"[{_WS}][{_WS}]|\x00"
#: A letter or digit before a mark: there one pre-token ends, another begins.
_MARK = r"([\p{L}\p{N}])([^\s\x00\p{L}\p{N}])"


class ChunkTable:
    """Chunks and their ids: a slot a chunk, all ids in one growing array."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.start, self.size, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.n = self.n_ids = self.chars = 0

    def add(self, chunks: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, m = self.n + len(chunks), self.n_ids + len(ids)
        for name in ("start", "size", "used"):
            if n > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * n))
        if m > len(self.ids):
            self.ids = np.resize(self.ids, 2 * m)
        self.start[self.n : n] = self.n_ids + np.cumsum(sizes) - sizes
        self.size[self.n : n] = sizes
        self.used[self.n : n] = 0
        self.ids[self.n_ids : m] = ids
        self.slot.update(zip(chunks, range(self.n, n)))
        self.n, self.n_ids, self.chars = n, m, self.chars + sum(map(len, chunks))

    def bytes(self) -> int:
        return self.n * ENTRY_BYTES + self.chars + 4 * self.n_ids

    def drop(self, n: int, n_ids: int, chunks: list[str]) -> None:
        """Forget the last chunks, down to n chunks and n_ids ids."""
        for x in chunks:
            del self.slot[x]
        self.n, self.n_ids, self.chars = n, n_ids, self.chars - sum(map(len, chunks))

    def shrink(self) -> None:
        """Keep the chunks met more than once since the last time; if they are
        most of the table, none."""
        keep = [(x, i) for x, i in self.slot.items() if self.used[i] > 1]
        old_start, old_size, old_ids, n = self.start, self.size, self.ids, self.n
        self.clear()
        if keep and 2 * len(keep) <= n:
            at = np.array([i for _, i in keep])
            self.add([x for x, _ in keep], old_ids[_ranges(old_start[at], old_size[at])], old_size[at])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(int(end[-1]) if len(end) else 0)


class ChunkEncoder:
    """Texts to ids with a tokenizers file.  Arrow cuts texts where one pre-token
    ends and another begins (before a space, around a line break, between a
    letter or digit and a mark) and numbers a batch's distinct chunks; each goes
    through the library once while it stays in the table."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Letters behind at most a space are one pre-token: they need the
        # library's byte alphabet and model only.
        self.model = self.tokenizer.model
        self.byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.space = self.byte_level(" ")[0][0]
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.known = ChunkTable()

    def _learn(self, chunks: list[str]) -> None:
        letters, other, ids = [], [], []
        space, level, tokenize = self.space, self.byte_level, self.model.tokenize
        for x in chunks:
            word = x[1:] if x[:1] == " " else x
            if word.isalpha():
                letters.append(x)
                if not word.isascii():
                    word = level(word)[0][0]
                ids.append([t.id for t in tokenize(space + word if x[0] == " " else word)])
            else:
                other.append(x)
        for at in range(0, len(other), 5_000):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(other[at : at + 5_000], add_special_tokens=False)]
        self.known.add(letters + other, np.fromiter(itertools.chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _slots(self, chunks: list[str]) -> tuple[np.ndarray, list[str]]:
        """Slots of distinct chunks; and those among them that aren't to stay."""
        slot = self.known.slot
        new = [x for x in chunks if x not in slot]
        self._learn([x for x in new if len(x) <= CACHED_CHUNK])
        long = [x for x in new if len(x) > CACHED_CHUNK]
        self._learn(long)
        return np.fromiter(map(slot.__getitem__, chunks), np.int64, len(chunks)), long

    def _chunks(self, texts: list[str]) -> pa.LargeListArray:
        array = pa.array(texts, pa.large_string())
        odd = np.flatnonzero(pc.match_substring_regex(array, _ODD).to_numpy(zero_copy_only=False)).tolist()
        cut = pc.replace_substring_regex(pc.replace_substring(array, "\n", "\0\n\0"), _MARK, "\\1\0\\2")
        lists = pc.split_pattern(pc.replace_substring(cut, " ", "\0 "), "\0")
        if not odd:
            return lists
        parts, done = [], 0
        for i in odd:
            first, *rest = space_chunks(texts[i])
            parts += [lists.slice(done, i - done), pa.array([[first, *[" " + x for x in rest]]], lists.type)]
            done = i + 1
        return pa.concat_arrays([*parts, lists.slice(done)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and how many each has."""
        known = self.known
        if known.bytes() > CACHE_BYTES:
            known.shrink()
        # Added tokens in a text stand for themselves and cut it.
        special = [i for i, t in enumerate(texts) for x in self.added if x in t]
        if special:
            return self._with_added(texts, set(special))
        lists = self._chunks(texts)
        coded = lists.flatten().dictionary_encode()
        slots, long = self._slots(coded.dictionary.to_pylist())
        codes, out, sizes = coded.indices.to_numpy(), [], []
        for at in range(0, len(codes), WORDS_AT_ONCE):
            own = slots[codes[at : at + WORDS_AT_ONCE]]
            known.used[: known.n] += np.bincount(own, minlength=known.n)
            sizes.append(known.size[own])
            out.append(known.ids[_ranges(known.start[own], sizes[-1])])
        if long:  # they were added last
            known.drop(known.n - len(long), int(known.start[known.n - len(long)]), long)
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])
        first = lists.offsets.to_numpy()
        return np.concatenate([*out, np.zeros(0, np.uint32)]), np.diff(total[first - first[0]])

    def _with_added(self, texts: list[str], special: set[int]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.parts.split(t) if i in special else [t] for i, t in enumerate(texts)]
        ids, sizes = self.encode([x for p in parts for x in p[::2]])
        stop, out, n, at = np.cumsum(sizes), [], [], 0
        for p in parts:
            own = []
            for j, x in enumerate(p):
                if j % 2:
                    own.append(np.array([self.added[x]], np.uint32))
                else:
                    own.append(ids[stop[at] - sizes[at] : stop[at]])
                    at += 1
            out += own
            n.append(sum(map(len, own)))
        return np.concatenate(out), np.array(n, np.int64)


def encoder(path: str) -> ChunkEncoder:
    if path not in _TOKENIZER:
        _TOKENIZER[path] = ChunkEncoder(path)
    return _TOKENIZER[path]


# ---- the code -------------------------------------------------------------

_BYTE = np.arange(256, dtype=np.uint8)
#: Of each control byte: the four code lengths.
LENGTHS = np.stack([((_BYTE >> (2 * i)) & 3) + 1 for i in range(4)], axis=1).astype(np.int64)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """uint32 values to (control, data)."""
    v = np.ascontiguousarray(values, dtype="<u4")
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    four = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    four[: len(v)] = extra
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """(control, data) to n uint32 values."""
    length = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(length)
    if n and end[-1] != len(data):
        raise ValueError("data bytes don't fit the control bytes")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    at = end - length
    out = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(length > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


# ---- the operator ---------------------------------------------------------


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (uint16 where the vocabulary allows, else uint32).
    The last row of a task has its ids' frequencies in `counts`, and no ids."""
    vocabulary = _vocabulary(path)
    wide = vocabulary > 0xFFFF

    kind, names = "<u4" if wide else "<u2", ["doc_id", "n_tokens", "ids", "counts"]

    def run(batches):
        enc, total = encoder(path), np.zeros(vocabulary, np.int64)
        for doc, texts in batches_by_size(batches, AT_ONCE):
            ids, size = enc.encode(texts)
            ids = np.insert(ids, np.cumsum(size), END_ID).astype(kind)
            size += 1
            total += np.bincount(ids, minlength=vocabulary)
            yield pa.RecordBatch.from_arrays([doc, pa.array(size), _binary(ids, size), pa.nulls(len(size), pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, counts binary")


def _binary(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary value of each range of sizes `size` of an array."""
    stop = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)]) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(stop), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _vocabulary(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)


def frequency_ranks(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """rank -> id over all documents.  At most `vocabulary` rows reach the driver."""

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], names=["id", "n"])

    rows = tokens.select("counts").where("counts IS NOT NULL").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(vocabulary, np.int64)
    total[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return np.argsort(-total, kind="stable").astype(np.uint32)


def write_blocks(tokens: DataFrame, ids_by_rank: np.ndarray) -> DataFrame:
    """The blocks of a token file, in ascending doc_id order."""
    vocabulary = len(ids_by_rank)
    kind = "<u4" if vocabulary > 0xFFFF else "<u2"
    rank = np.empty(vocabulary, np.uint32)
    rank[ids_by_rank] = np.arange(vocabulary, dtype=np.uint32)
    shown = "shard int, block int, n_ids long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary, crc long"
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()), ("crc", pa.int64())])

    def run(batches):
        shard, block, docs, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal block, docs, parts, held
            ids = np.concatenate(parts)
            control, data = pack(rank[ids])
            row = [[shard], [block], [len(ids)], [docs], [[len(x) for x in parts]], [control], [data], [zlib.crc32(data, zlib.crc32(control))]]
            block, docs, parts, held = block + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for b in batches:
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.frombuffer(x.as_buffer(), kind)
                if parts and held + len(ids) > BLOCK_TOKENS:
                    yield flush()
                docs.append(doc)
                parts.append(ids)
                held += len(ids)
        if parts:
            yield flush()

    spark = tokens.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Beyond the doc_id, so that rows that repeat one spread over ranges.
    order = ["doc_id", "n_tokens", "sum"]
    rows = tokens.where("ids IS NOT NULL").withColumn("sum", F.xxhash64("ids"))
    return rows.repartitionByRange(shards, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids").mapInArrow(run, shown)


def read_blocks(blocks: DataFrame, ids_by_rank: np.ndarray) -> DataFrame:
    """Decode a token file: doc_id, start, n_tokens, ids_crc32, ids (uint32)."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                if zlib.crc32(r["data"], zlib.crc32(r["control"])) != r["crc"]:
                    raise ValueError(f"block {r['shard']}/{r['block']} is damaged")
                ids = np.ascontiguousarray(ids_by_rank[unpack(r["control"], r["data"], r["n_ids"])], "<u4")
                size = np.array(r["lengths"], np.int64)
                at = np.cumsum(size) - size
                raw = [ids[a : a + n].tobytes() for a, n in zip(at, size)]
                n = len(size)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, r["shard"], np.int32)), pa.array(np.full(n, r["block"], np.int32)), pa.array(r["doc_ids"], pa.int64()), pa.array(at), pa.array(size), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                )

    rows = blocks.mapInArrow(run, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long, ids binary")
    # Ids before a block: a prefix sum inside each shard, and one over the shards
    # (as many rows as partitions were written).
    sizes = blocks.select("shard", "block", "n_ids")
    inside = sizes.withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids"))
    whole = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = whole.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    starts = inside.join(base, "shard").select("shard", "block", (F.col("before") + F.col("base")).alias("first"))
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def write_token_file(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, np.ndarray]:
    """Encode docs and write the token file; returns its blocks as read from
    the shared folder, and the table rank -> id."""
    prepare(docs.sparkSession)
    tokens = stored(tokenize(docs, tokenizer), "tokens")
    ranks = frequency_ranks(tokens, _vocabulary(tokenizer))
    blocks = stored(write_blocks(tokens, ranks), "token-blocks")
    drop_stored(tokens)
    return blocks, ranks


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encode, write, read back."""
    blocks, ranks = write_token_file(docs, tokenizer)
    return read_blocks(blocks, ranks)
