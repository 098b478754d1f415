"""MinHash near-duplicate detection with odd sketches.

1. One narrow pass turns each whole text into its set of word shingles, PERMS
   MinHash values, BANDS band keys of ROWS values, and an odd sketch: each
   (place, value) flips one of SKETCH_BITS bits, so that the XOR of two
   sketches counts the values in which they differ.
2. Rows with equal sets meet by the set's 128-bit hash and are one class, which
   gets a number when the table of classes is written.
3. Classes that share a band key are candidates.  A bucket never gives all its
   pairs: every class is paired with a pivot of its buckets (the class that
   shares most buckets, so as a rule the text that others were copied from),
   links are confirmed, and classes of one component aren't compared again.
   A further turn takes other pivots; at last, for all pairs that share a bucket
   but no component, sketches are compared block by block, each pair of blocks a
   row of its own, and a pair becomes a row only if its sketches are near, and
   once, in the first bucket that it shares; so no link between components is
   left out.
4. The sketches' XOR population count drops pairs that are clearly less similar
   (by more than four standard deviations); the full sets confirm the rest.  A
   class of many pairs has its set dealt to as many places as PAIRS_AT_ONCE asks.
5. Connected components give the groups.

With 20 bands of 4 values, a pair of similarity 0.85 is missed by all bands
with probability 4e-7 (0.8: 3e-5).

Null or blank texts and null ids have no links; texts with fewer words than a
shingle are one shingle; rows that repeat a doc_id are one document, whatever
their texts: the links of each text are the document's; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import arrow_rows, drop_stored, prepare, scope, stored
from heritas.llm.components import components

PERMS, BANDS, ROWS = 256, 20, 4
SKETCH_BITS = 1024
#: Turns with pivots before the rest is compared pair by pair.
PIVOT_TURNS = 2
#: Classes of a bucket that meet in one comparison of sketches.
BLOCK = 256
#: Rows of two blocks in an Arrow batch: a block is 80 kB when full.
BLOCK_ROWS = 16
#: Pairs of one class that meet its set in one place.
PAIRS_AT_ONCE = 256
#: Shingles hashed at once: memory bound for long texts.
PIECE = 1 << 16

_RNG = np.random.default_rng(20240917)
_MULT = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_PLACE = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (wrapping arithmetic)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles: A-Z lower-cased,
    words parted by space and bytes 9 to 13."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    take = min(n, size)
    out = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - take + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """PERMS MinHash values of a set that isn't empty."""
    out = np.full(PERMS, ~np.uint64(0), np.uint64)
    for at in range(0, len(s), PIECE):
        part = s[at : at + PIECE]
        for i in range(0, PERMS, 16):
            h = part * _MULT[i : i + 16, None] + _ADD[i : i + 16, None]
            out[i : i + 16] = np.minimum(out[i : i + 16], h.min(1))
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """Odd sketches (rows of SKETCH_BITS / 64 words) of rows of MinHash values."""
    place = (_mix(sig ^ _PLACE) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS
    bits = np.zeros((len(sig), SKETCH_BITS), np.uint8)
    np.add.at(bits, (np.arange(len(sig))[:, None], place), 1)
    return np.packbits(bits & 1, axis=1).view("<i8")


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key.view(np.int64)


def most_differing(threshold: float) -> int:
    """XOR population count that a pair of this similarity exceeds with a
    probability under 1e-4: four standard deviations above the mean of the
    differing values, and the bits that they leave odd."""
    differ = PERMS * (1 - threshold) + 4 * math.sqrt(PERMS * threshold * (1 - threshold))
    odd = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * min(differ, PERMS)))
    return math.ceil(odd + 5)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (hash of the set), bands, sketch."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(1).to_pylist()]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = np.stack([signature(sets[i]) for i in full]) if full else np.zeros((0, PERMS), np.uint64)
            bands: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            for i, k, o in zip(full, band_keys(sig), sketches(sig) if full else []):
                bands[i], sketch[i] = k, o
            set_a, set_b = _digests(sets)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": b.column(0),
                    "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                    "set_a": set_a,
                    "set_b": set_b,
                    "bands": pa.array(bands, pa.list_(pa.int64())),
                    "sketch": pa.array(sketch, pa.list_(pa.int64())),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, bands array<bigint>, sketch array<bigint>")


def _digests(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """The two halves of each set's 128-bit hash."""
    whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
    return tuple(pa.array([int.from_bytes(x[i : i + 8], "big", signed=True) for x in whole], pa.int64()) for i in (0, 8))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """set_a, set_b, shingles of each text."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, size) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*_digests(sets), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["set_a", "set_b", "shingles"])

    return texts.mapInArrow(run, "set_a long, set_b long, shingles array<bigint>")


def _near(percent: int, sa: str, sb: str, na: str, nb: str) -> Column:
    """Condition: two sketches and set sizes allow the similarity."""
    differ = sum((F.bit_count(F.col(sa)[i].bitwiseXOR(F.col(sb)[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (differ <= most_differing(percent / 100)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs a, b those whose full sets are similar enough."""

    def side(key: str, out: str) -> tuple[DataFrame, DataFrame]:
        # A class of many pairs gets its set in several places.  Few classes are,
        # so the written table of them is small and needs no shuffle of pairs.
        many = stored(near.groupBy(key).agg(F.ceil(F.count("*") / PAIRS_AT_ONCE).cast("int").alias("places")), "places")
        spread = stored(many.where("places > 1"), "places")
        own = sets.join(many, sets["cls"] == many[key]).select(F.col("cls").alias(key), F.col("shingles").alias(out), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place_" + key))
        return own, spread

    (ta, many_a), (tb, many_b) = side("a", "ta"), side("b", "tb")
    rows = near.join(many_a.withColumnRenamed("places", "pa"), "a", "left").join(many_b.withColumnRenamed("places", "pb"), "b", "left")
    rows = rows.select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("pa", F.lit(1))).cast("int").alias("place_a"), F.pmod(F.xxhash64("a"), F.coalesce("pb", F.lit(1))).cast("int").alias("place_b"))
    both = F.size(F.array_intersect("ta", "tb"))
    return rows.join(ta, ["a", "place_a"]).join(tb, ["b", "place_b"]).where(100 * both >= percent * (F.size("ta") + F.size("tb") - both)).select("a", "b")


def _near_pairs(placed: DataFrame, percent: int) -> DataFrame:
    """Pairs a, b of different components that share a bucket and whose sketches
    are near: blocks of a bucket's classes against blocks."""
    limit = most_differing(percent / 100)
    open_ = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("many")).where("low <> high").select("band", F.ceil(F.col("many") / BLOCK).cast("int").alias("n_blocks"))
    rows = placed.join(open_, "band")
    block = F.pmod(F.xxhash64("cls", F.lit(99)), F.col("n_blocks")).cast("int")
    blocks = stored(rows.groupBy("band", "n_blocks", block.alias("block")).agg(F.collect_list(F.struct("cls", "component", "n", "sketch", "bands")).alias("x")), "blocks")
    left = blocks.select("band", "block", F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("other"), "x")
    right = blocks.select("band", F.explode(F.sequence(F.lit(0), "block")).alias("block"), F.col("block").alias("other"), F.col("x").alias("y"))
    both = left.join(right, ["band", "block", "other"])

    def run(batches):
        for b in batches:
            for band, same, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                (ra, ca, na, sa, ba), (rb, cb, nb, sb, bb) = (_arrays(v.values) for v in (x, y))
                near = (np.bitwise_count(sa[:, None] ^ sb[None]).sum(2, dtype=np.int64) <= limit) & (ca[:, None] != cb[None])
                near &= 100 * np.minimum(na[:, None], nb[None]) >= percent * np.maximum(na[:, None], nb[None])
                if same:
                    near &= ra[:, None] < rb[None]
                i, j = np.nonzero(near)
                alike = ba[i] == bb[j]
                first = bb[j, alike.argmax(1)] == band
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ra[i], rb[j])), pa.array(np.maximum(ra[i], rb[j]))], names=["a", "b"])

    with arrow_rows(placed.sparkSession, BLOCK_ROWS):
        out = stored(both.select("band", F.col("block") == F.col("other"), "x", "y").mapInArrow(run, "a long, b long"), "near")
    drop_stored(blocks)
    return out


def _arrays(rows: pa.StructArray) -> list[np.ndarray]:
    rep, component, n, sketch, bands = rows.flatten()
    flat = [x.to_numpy(zero_copy_only=False) for x in (rep, component, n)]
    return [*flat, *(x.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1) for x in (sketch, bands))]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over
    links of 100 * intersection >= percent * union), kept."""
    prepare(docs.sparkSession)
    with scope() as keep:
        signed, named = _named(docs, size, percent)
        keep(signed, named)
    out = signed.join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures; and of each set that may have links its component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stored(signatures(docs, size), "signatures")
    key = ["set_a", "set_b"]
    linkable = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Numbers are given where the table is written, so they stay.
    grouped = linkable.groupBy(*key).agg(F.min("doc_id").alias("low"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = stored(grouped.withColumn("cls", F.monotonically_increasing_id()), "classes")

    buckets = classes.select("cls", F.explode(F.array_distinct("bands")).alias("band"))
    crowd = buckets.groupBy("band").agg(F.count("*").alias("many")).where("many > 1")
    shared = stored(buckets.join(crowd, "band"), "buckets")
    standing = shared.groupBy("cls").agg(F.sum("many").alias("standing"))
    involved = stored(classes.join(standing, "cls"), "involved")
    members = stored(shared.select("band", "cls").join(involved.select("cls", "standing", "n", "bands", "sketch"), "cls"), "members")
    drop_stored(shared)

    # The class's smallest doc_id has its text, and maybe other texts.
    texts = docs.join(involved.select(F.col("low").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    sets = stored(_sets(texts, size).join(involved.select(*key, "cls"), key).select("cls", "shingles").dropDuplicates(["cls"]), "sets")

    # Rows of one doc_id with several texts are one document: link their classes.
    texted = linkable.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id")
    several = linkable.select("doc_id", *key).join(texted, "doc_id", "left_semi").distinct().join(classes.select(*key, "cls"), key)
    same = several.join(several.groupBy("doc_id").agg(F.min("cls").alias("a")), "doc_id").where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    links = stored(same, "found")
    group = parts = None
    for turn in range(PIVOT_TURNS + 1):
        placed = members.withColumn("component", F.col("cls")) if group is None else members.join(group, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        if turn < PIVOT_TURNS:
            # The pivot of a bucket: its first by standing, later turns by a hash.
            order = F.struct("standing", -F.col("cls")) if turn == 0 else F.struct(F.xxhash64("cls", F.lit(turn)), F.col("cls"))
            pivot = F.struct("cls", "component", "standing", "n", "sketch")
            pivots = placed.groupBy("band").agg(F.max_by(pivot, order).alias("p"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
            pairs = placed.join(pivots, "band").where((F.col("cls") != F.col("p.cls")) & (F.col("component") != F.col("p.component"))).where(_near(percent, "sketch", "p.sketch", "n", "p.n"))
            if turn == 0:  # one pivot a class is enough to begin with
                pairs = pairs.groupBy("cls").agg(F.max_by("p.cls", F.struct("p.standing", -F.col("p.cls"))).alias("pivot"))
            else:
                pairs = pairs.select("cls", F.col("p.cls").alias("pivot")).distinct()
            pairs = stored(pairs.select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct(), "near")
        else:
            pairs = _near_pairs(placed, percent)
        found = stored(links.union(_confirmed(pairs, sets, percent)), "found")
        drop_stored(pairs, links, parts)
        links = found
        parts = components(links)
        group = parts.select(F.col("node").alias("cls"), "component")
    drop_stored(sets, members, links)
    whole = classes.select(*key, "cls", "low").join(group, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    lowest = whole.groupBy("component").agg(F.min("low").alias("component_id"))
    return signed, stored(whole.join(lowest, "component").select(*key, "component_id"), "named")
