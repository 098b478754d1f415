"""Repeated passages by sparse suffix arrays.

A text is its sequence of words (runs without white space, A-Z lower-cased).
Of all suffixes those are kept that begin at a minimiser: among the GRAM-word
grams of every LENGTH-word window, the last one of smallest hash.  So each
window of LENGTH words has a kept suffix, chosen by its content alone, that
begins in its first LENGTH - GRAM + 1 words, and the same passage has the same
kept suffixes in every document.

1. A pass counts the grams at kept suffixes; a bit map (at most MAP_BITS bits,
   whatever the corpus's size) remembers those of two documents or more.
2. A second pass emits the kept suffixes whose gram is in the map, with hashes
   of each possible extension to the right (up to LENGTH words from the
   suffix's start) and to the left (up to LENGTH - GRAM words).
3. The suffixes are sorted over the cluster, by gram, right and left extension,
   and once more by gram, left and right extension.  Neighbours (of other
   documents: suffixes of one document in a row are passed over) are compared
   and the match extended to both sides; of LENGTH words or more together, it
   marks that passage.  A range sort splits the suffixes of a very common
   passage over tasks; neighbours across a border meet in a table of each
   task's first and last document's suffixes.
4. The neighbour in the first order has the longest match to the right that any
   suffix has, in the second the longest to the left.  Where both are parts of
   marked passages, no other suffix of the group adds words.  Where one isn't
   and the two add up to LENGTH words or more, a suffix between them may match
   LENGTH words: the group is open, and the LENGTH-word windows around all its
   suffixes are counted; those of two documents or more are marked.
5. Marked passages of a document that overlap or touch are one.

So the marked words are those of all LENGTH-word windows that two documents
have.  Passages that repeat within one document alone aren't marked.

Null texts and texts under LENGTH words have no passages; rows that repeat a
doc_id are one document; rows without one aren't looked at; exact copies are
marked whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, prepare, scope, stored

LENGTH, GRAM = 50, 33
#: How far a kept suffix's start can lie behind a window's, and so as many
#: extensions to either side are compared.
REACH = LENGTH - GRAM
MAP_BITS = 1 << 26
#: Suffixes whose extensions are hashed at once (memory bound for long texts).
AT_ONCE = 1 << 16

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Text:
    """A text's hashed words, with hashes of all its word ranges."""

    def __init__(self, text: str | None):
        words = (text or "").encode().lower().split()
        self.n = len(words)
        if self.n >= LENGTH:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, self.n)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, self.n), dtype=np.uint64)])
            self.back = _powers(_BACK, self.n + 1)

    def range_hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stop] - self.sums[start]) * self.back[start])

    def kept(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of kept suffixes, and the hashes of their grams."""
        if self.n < LENGTH:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        start = np.arange(self.n - GRAM + 1)
        gram = self.range_hash(start, start + GRAM)
        view = np.lib.stride_tricks.sliding_window_view(gram[::-1], REACH + 1)
        # Backwards, so that argmin takes the last of equal grams.
        first = np.arange(len(view)) + view.argmin(1)
        at = np.unique(len(gram) - 1 - first)
        return at, gram[at]

    def extensions(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit hashes of the words from a suffix's start to GRAM + 1, ...,
        LENGTH words right of it, and of 1, ..., REACH words left of it.  A
        side's end counts as a word that nothing equals."""
        right = np.empty((len(at), REACH), np.uint16)
        left = np.empty((len(at), REACH), np.uint16)
        step = np.arange(1, REACH + 1)
        for i in range(0, len(at), AT_ONCE):
            here = at[i : i + AT_ONCE, None]
            stop, start = here + GRAM + step, here - step
            same = np.broadcast_to(here, stop.shape)
            right[i : i + AT_ONCE] = np.where(stop > self.n, 0, self.range_hash(same, np.minimum(stop, self.n)) >> np.uint64(48))
            left[i : i + AT_ONCE] = np.where(start < 0, 0, self.range_hash(np.maximum(start, 0), same) >> np.uint64(48))
        return right.astype(">u2"), left.astype(">u2")

    def room(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the extensions exist."""
        return np.minimum(self.n - at - GRAM, REACH), np.minimum(at, REACH)


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                gram = np.unique(Text(text).kept()[1])
                if len(gram):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), doc, np.int64)), pa.array(gram.view(np.int64))], names=["doc_id", "gram"])

    return docs.mapInArrow(_merged(run), "doc_id long, gram long")


def _merged(run, rows: int = 50_000):
    """Join small batches of a mapInArrow function to larger ones."""

    def out(batches):
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def repeated_map(docs: DataFrame) -> np.ndarray:
    """Bit map (its size a power of two) of grams that two documents have."""
    found = _grams(docs).groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("gram")
    found = stored(found, "repeated-grams")
    n = found.count()
    bits = 64
    while bits < min(16 * n, MAP_BITS):
        bits *= 2
    place = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(bits - 1))
    words = found.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST((shiftrightunsigned(gram, 8) & {bits - 1}L) & 63L AS int)))").alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy(np.int64).view(np.uint64)
    drop_stored(found)
    return out


def _has(table: np.ndarray, gram: np.ndarray) -> np.ndarray:
    at = (gram >> np.uint64(8)) & np.uint64(len(table) * 64 - 1)
    return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


_SUFFIX = "gram long, near binary, far binary, doc_id long, pos int, room_right int, room_left int"


def _suffixes(docs: DataFrame, table: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                t = Text(text)
                at, gram = t.kept()
                keep = _has(shared.value, gram)
                at, gram = at[keep], gram[keep]
                if len(at):
                    right, left = t.extensions(at)
                    room_right, room_left = t.room(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram.view(np.int64)), _binary(right), _binary(left), pa.array(np.full(len(at), doc, np.int64)), pa.array(at.astype(np.int32)), pa.array(room_right.astype(np.int32)), pa.array(room_left.astype(np.int32))],
                        names=["gram", "near", "far", "doc_id", "pos", "room_right", "room_left"],
                    )

    return docs.mapInArrow(_merged(run), _SUFFIX)


def _binary(rows: np.ndarray) -> pa.Array:
    raw, width = np.ascontiguousarray(rows).tobytes(), 2 * REACH
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


class _Rows:
    """Suffixes in sorted order, as arrays."""

    def __init__(self, b: pa.RecordBatch):
        c = {n: b.column(n) for n in ("gram", "near", "far", "doc_id", "pos", "room_right", "room_left")}
        self.gram, self.doc, self.pos, self.rr, self.rl = (c[n].to_numpy(zero_copy_only=False) for n in ("gram", "doc_id", "pos", "room_right", "room_left"))
        self.right, self.left = (np.frombuffer(b"".join(c[n].to_pylist()), ">u2").reshape(-1, REACH) for n in ("near", "far"))

    def runs(self) -> np.ndarray:
        """Where runs of one gram and document begin."""
        new = (self.gram[1:] != self.gram[:-1]) | (self.doc[1:] != self.doc[:-1])
        return np.flatnonzero(np.append(True, new))

    def marks(self, by_right: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(doc, start, stop) of matches with the next suffixes, to both sides,
        that another document has; both places of each match.  And how many
        extensions to the sorted side agree with a neighbour's (-1: none has the
        gram), and whether such a match is marked."""
        n, begin = len(self.gram), self.runs()
        size = np.diff(np.append(begin, n))
        here, before, behind = np.arange(n), np.repeat(begin - 1, size), np.repeat(begin + size, size)
        a, b = np.concatenate([here, here]), np.concatenate([before, behind])
        inside = (b >= 0) & (b < n)
        a, b = a[inside], b[inside]
        same = self.gram[a] == self.gram[b]
        a, b = a[same], b[same]
        r = _alike(self.right[a], self.right[b], np.minimum(self.rr[a], self.rr[b])) + GRAM
        l = _alike(self.left[a], self.left[b], np.minimum(self.rl[a], self.rl[b]))
        good = l + r >= LENGTH
        side, reach, marked = r - GRAM if by_right else l, np.full(n, -1), np.zeros(n, bool)
        np.maximum.at(reach, a, side)
        marked[a[good & (side == reach[a])]] = True
        a, b, l, r = a[good], b[good], l[good], r[good]
        return [np.stack([self.doc[x], self.pos[x] - l, self.pos[x] + r]) for x in (a, b)], reach, marked


def _alike(x: np.ndarray, y: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many extensions agree, up to the room that both have."""
    differ = x != y
    first = np.where(differ.any(1), differ.argmax(1), REACH)
    return np.minimum(first, room)


_MARKS = "edge int, reach int, doc_id long, start int, stop int, " + _SUFFIX.replace("doc_id long, ", "")


def _neighbours(suffixes: DataFrame, order: list[str]) -> DataFrame:
    """doc_id, start, stop of neighbours' matches in this order; and the suffixes
    whose longest match isn't marked, with its extensions (reach)."""
    by_right = order[1] == "near"

    def compare(batches, edges: bool):
        names = [x.split()[0] for x in _MARKS.split(", ")]
        kinds = {"edge": pa.int32(), "reach": pa.int32(), "doc_id": pa.int64(), "start": pa.int32(), "stop": pa.int32(), "gram": pa.int64(), "near": pa.binary(), "far": pa.binary(), "pos": pa.int32(), "room_right": pa.int32(), "room_left": pa.int32()}

        def marked(found):
            n = found.shape[1]
            have = {"doc_id": found[0], "start": found[1].astype(np.int32), "stop": found[2].astype(np.int32)}
            return pa.RecordBatch.from_arrays([pa.array(have[c], kinds[c]) if c in have else pa.nulls(n, kinds[c]) for c in names], names=names)

        def edge(rows, place):
            n = rows.num_rows
            have = {c: rows.column(c) for c in rows.schema.names}
            return pa.RecordBatch.from_arrays([pa.array([place] * n, pa.int32()) if c == "edge" else have[c] if c in have else pa.nulls(n, kinds[c]) for c in names], names=names)

        def short(raw, reach):
            have = {c: raw.column(c) for c in raw.schema.names} | {"reach": pa.array(reach, pa.int32())}
            return pa.RecordBatch.from_arrays([have[c] if c in have else pa.nulls(raw.num_rows, kinds[c]) for c in names], names=names)

        judged = 0
        held, part, first = None, TaskContext.get().partitionId(), True
        for b in batches:
            if not b.num_rows:
                continue
            both = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            rows = _Rows(both)
            begin = rows.runs()
            if edges and first and len(begin) > 1:
                yield edge(both.slice(0, int(begin[1])), 2 * part)
                first, judged = False, int(begin[1])
            both_places, reach, whole = rows.marks(by_right)
            for found in both_places:
                if found.shape[1]:
                    yield marked(found)
            # Suffixes whose neighbours are both here: neither those of the last
            # run, nor those judged with the batch before, nor the task's edges.
            if edges and not first:
                at = judged + np.flatnonzero((reach >= 0)[judged : begin[-1]] & ~whole[judged : begin[-1]])
                if len(at):
                    yield short(both.take(pa.array(at)), reach[at])
            # The last run may go on: keep it, and the suffix before it.
            held = both.slice(max(0, int(begin[-1]) - 1))
            judged = min(1, int(begin[-1]))
        if edges and held is not None:
            yield edge(held.slice(int(_Rows(held).runs()[-1])), 2 * part + 1)

    spark = suffixes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = suffixes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = stored(placed.mapInArrow(_merged(lambda x: compare(x, True)), _MARKS), "marks")
    # The suffixes of the first and the last document of every task, in order.
    border = found.where("edge IS NOT NULL").coalesce(1).sortWithinPartitions("edge", *order).select("gram", "near", "far", "doc_id", "pos", "room_right", "room_left")
    across = border.mapInArrow(_merged(lambda x: compare(x, False)), _MARKS)
    marks = found.where("edge IS NULL AND reach IS NULL").select("doc_id", "start", "stop").union(across.select("doc_id", "start", "stop"))
    # At an edge the longest match isn't known: at most all that the text has.
    most = F.least(F.lit(REACH), "room_right" if by_right else "room_left")
    shorts = found.where("edge IS NOT NULL OR reach IS NOT NULL").select("gram", "near", "far", "doc_id", "pos", "room_right", "room_left", F.coalesce("reach", most).alias("reach"))
    return marks, shorts


def _open_windows(suffixes: DataFrame, by_right: DataFrame, by_left: DataFrame) -> DataFrame:
    """doc_id, start, stop of repeated LENGTH-word windows in open groups."""
    key = ["gram", "near", "far", "doc_id", "pos", "room_right", "room_left"]
    none = F.lit(None).cast("int")
    both = by_right.withColumn("left", none).withColumnRenamed("reach", "right").select(*key, "right", "left").union(by_left.withColumn("right", none).withColumnRenamed("reach", "left").select(*key, "right", "left"))
    # A side without a row is marked as far as it matches: at most all it has.
    sides = both.groupBy(*key).agg(F.coalesce(F.max("right"), F.least(F.lit(REACH), "room_right")).alias("right"), F.coalesce(F.max("left"), F.least(F.lit(REACH), "room_left")).alias("left"))
    grams = stored(sides.where(F.col("right") + F.col("left") >= REACH).select("gram").distinct(), "open-grams")
    around = suffixes.join(grams, "gram", "left_semi").withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(REACH)))).where(f"l <= room_left AND {REACH} - l <= room_right")
    # The hashes that _alike compares: all extensions within the window.
    window = around.select("doc_id", (F.col("pos") - F.col("l")).alias("start"), "gram", "l", F.expr("substring(far, 1, 2 * l)").alias("far"), F.expr(f"substring(near, 1, 2 * ({REACH} - l))").alias("near"))
    same = window.groupBy("gram", "l", "far", "near")
    repeated = same.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low <> high").select("gram", "l", "far", "near")
    return window.join(repeated, ["gram", "l", "far", "near"], "left_semi").select("doc_id", "start", (F.col("start") + LENGTH).alias("stop"))


def _united(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > reach[:-1])
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, stop (words, end exclusive), n_words: the passages of at
    least LENGTH words that another document has too."""
    prepare(docs.sparkSession)
    with scope() as keep:
        out = stored(_passages(docs), "passages")
        keep(out)
    return out


def _passages(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    table = repeated_map(docs)
    suffixes = stored(_suffixes(docs, table), "suffixes")
    first, by_right = _neighbours(suffixes, ["gram", "near", "far", "doc_id", "pos"])
    second, by_left = _neighbours(suffixes, ["gram", "far", "near", "doc_id", "pos"])
    between = _open_windows(suffixes, by_right, by_left)
    spans = first.union(second).union(between).groupBy("doc_id").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def unite(batches):
        for b in batches:
            for doc, spans in zip(b.column(0).to_pylist(), b.column(1)):
                flat = spans.values
                start, stop = _united(flat.field("start").to_numpy(), flat.field("stop").to_numpy())
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(np.full(len(start), doc, np.int64)), "start": pa.array(start.astype(np.int32)), "stop": pa.array(stop.astype(np.int32)), "n_words": pa.array((stop - start).astype(np.int32))})

    return spans.mapInArrow(_merged(unite), "doc_id long, start int, stop int, n_words int")
