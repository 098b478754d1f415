"""Benchmark decontamination: SimHash over item-sized windows.

Words are runs without white space, lower-cased, without punctuation (runs of
punctuation alone don't count).  A window has as many words as an item.

1. A window of similarity `threshold` or more shares at least
   threshold / (1 + threshold) of both sides' shingles with its item, so it has
   that many of the benchmark's shingles.  One pass over whole texts looks their
   shingles up and leaves just the windows that can reach the threshold, whatever
   item they may be near to.  (A fingerprint of each window of every text and
   item size would take 64 sums a word and size, some 2,000 CPU seconds a GB in
   native functions.)
2. These windows, each content once, get a SimHash of BITS bits: the votes of
   their words, added up in 16-bit lanes, four a number.  Fingerprints are cut
   into 16-bit blocks, and the items' blocks are indexed with up to FLIPS bits
   flipped, so every pair of fingerprints within RADIUS = BITS / 16 * (FLIPS + 1)
   - 1 bits is found (pigeonhole): one of their blocks differs by FLIPS bits at
   most.  Farther pairs are found where any block does.  A window at the threshold
   whose words occur once has a tenth of its words changed, which flips 37 of 256
   bits on average; that no block of it is within FLIPS bits has a probability
   under 1e-6.  Pairs beyond LIMIT bits are dropped.
3. The pairs are verified by the exact weighted similarity of their shingles
   (weight: how often a shingle occurs; sum of minima over sum of maxima).

Everything is DataFrame functions.  The documents' side of step 1 isn't shuffled
while the items' shingles (whose size is known, being stored) are under Spark's
broadcast threshold; beyond it Spark shuffles both, behind its own Bloom filter
where the settings allow one.  The texts of hit documents come back by the row's
key; hits are a small part.

Null and empty texts have no windows; a text shorter than an item is one window;
items without words match nothing, items under five words are one shingle; of
equally similar windows the first counts; repeated rows give one result; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, prepare, scope, stored

SHINGLE = 5
THRESHOLD = 0.8
BITS, FLIPS = 256, 2
BLOCKS = BITS // 16
RADIUS = BLOCKS * (FLIPS + 1) - 1
LIMIT = 90
#: One in each of four 16-bit lanes.
LANES = 0x0001000100010001
WORDS = r"filter(split(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _shingles(words: str, size: str) -> str:
    """SQL: hashes of a word array's shingles, in order."""
    return f"IF(size({words}) < {size}, CAST(array() AS array<bigint>), transform(sequence(1, size({words}) - {size} + 1), i -> xxhash64(slice({words}, i, {size}))))"


def _simhash(words: str) -> str:
    """SQL: SimHash of an array of words (array of BITS / 64 numbers), each
    occurrence counting once.  Lane l of the j-th sum counts the words with bit
    16 l + j; a bit is set where more than half of them have it.  Lanes hold for
    up to 32,766 words."""
    votes = f"aggregate(hashes, 0L, (s, h) -> s + (shiftrightunsigned(h, j) & {LANES}L))"
    half = f"(16383L - CAST(size(hashes) DIV 2 AS long)) * {LANES}L"
    bits = f"aggregate(sequence(0, 15), 0L, (f, j) -> f | shiftleft(shiftrightunsigned({votes} + {half}, 14) & {LANES}L, j))"
    seeds = ", ".join(f"transform({words}, w -> xxhash64(w, {k}))" for k in range(BITS // 64))
    return f"transform(array({seeds}), hashes -> {bits})"


def _numbered(shingles: str) -> str:
    """SQL: a list's members with a number for each repetition, so that lists
    can be compared as sets."""
    again = f"transform({shingles}, (x, i) -> xxhash64(x, size(filter(slice({shingles}, 1, i), y -> y = x))))"
    return f"IF(size(array_distinct({shingles})) = size({shingles}), transform({shingles}, x -> xxhash64(x, 0)), {again})"


def _blocks(print_: str) -> str:
    """SQL: the 16-bit blocks of a fingerprint."""
    return f"transform(sequence(0, {BLOCKS - 1}), k -> struct(k AS block, shiftrightunsigned({print_}[k DIV 4], 16 * (k % 4)) & 65535L AS value))"


def items_table(benchmark: DataFrame) -> DataFrame:
    """item_id, n (words), size (of a shingle), shingles, numbered, fingerprint."""
    words = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select("item_id", F.expr(WORDS).alias("words")).where("size(words) > 0")
    sized = words.withColumn("n", F.size("words")).withColumn("size", F.least("n", F.lit(SHINGLE)))
    sized = sized.withColumn("shingles", F.expr(_shingles("words", "size")))
    return sized.select("item_id", "n", "size", "shingles", F.expr(_numbered("shingles")).alias("numbered"), F.expr(_simhash("words")).alias("fingerprint"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key_a__", F.xxhash64("doc_id", "text")).withColumn("row_key_b__", F.xxhash64("text", "doc_id", F.lit(7)))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """row_key_a__, row_key_b__, doc_id, item_id, start, n_words, similarity: of each
    document and item its most similar window (the first of equal ones)."""
    prepare(docs.sparkSession)
    with scope() as keep:
        out = stored(_best(docs, benchmark, threshold), "contaminated")
        keep(out)
    return out


def _best(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    # Rows of one item_id with other texts are items of their own.
    items = stored(items_table(benchmark).withColumn("item_key", F.xxhash64("item_id", "shingles")).dropDuplicates(["item_key"]), "items")
    places = stored(items.select("size", "n", "item_key", F.size("shingles").alias("m"), F.explode("shingles").alias("shingle")).distinct(), "item-shingles")
    texts = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).where("text IS NOT NULL")
    split = texts.select("row_key_a__", "row_key_b__", F.expr(WORDS).alias("words"))
    row = ["row_key_a__", "row_key_b__"]
    hits = None
    for (size,) in items.select("size").distinct().collect():  # 1 to 5, as a rule 5 alone
        own = split.select(*row, F.size("words").alias("length"), F.posexplode(F.expr(_shingles("words", str(size)))).alias("pos", "shingle"))
        found = own.join(places.where(F.col("size") == size).select("shingle", "item_key", "n", "m"), "shingle").select(*row, "length", "pos", "item_key", F.lit(size).alias("size"), "n", "m")
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = split.select(*row, *[F.lit(0).alias(c) for c in ("length", "pos")], F.lit(0).cast("long").alias("item_key"), *[F.lit(0).alias(c) for c in ("size", "n", "m")]).limit(0)
    hits = hits.groupBy(*row, "length", "item_key", "size", "n", "m").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    # Shingles of a window, and how many of them the item must have.
    hits = hits.withColumn("own", F.least("n", "length") - F.col("size") + 1)
    hits = hits.withColumn("least", F.greatest(F.lit(1), F.ceil(F.lit(threshold) * (F.col("own") + F.col("m")) / (1 + F.lit(threshold)) - 1e-9).cast("int"))).where("size(at) >= least")
    # A window has so many hits if it holds one hit and the (least - 1)th behind it.
    starts = """array_distinct(flatten(transform(sequence(0, size(at) - least), i -> IF(at[i + least - 1] - own + 1 <= at[i] AND at[i + least - 1] - own + 1 <= length - least(n, length),
        sequence(greatest(0, at[i + least - 1] - own + 1), least(at[i], length - least(n, length))), CAST(array() AS array<int>)))))"""
    wanted = hits.select(*row, "size", "n", F.explode(F.expr(starts)).alias("start")).groupBy(*row).agg(F.collect_set(F.struct("start", "size", "n")).alias("wanted"))
    wanted = stored(wanted, "windows-wanted")
    drop_stored(places)
    rows = texts.join(wanted, row).select(*row, "doc_id", F.expr(WORDS).alias("words"), "wanted").dropDuplicates(row)
    windows = rows.select(*row, "doc_id", F.explode(F.expr("transform(wanted, x -> struct(x.start AS start, x.size AS size, x.n AS n, slice(words, x.start + 1, x.n) AS words))")).alias("w")).select(*row, "doc_id", "w.*")
    # Windows of one size and equal words are one content.
    content = ["content_a", "content_b"]
    windows = windows.withColumn("content_a", F.xxhash64("words", "size", "n")).withColumn("content_b", F.xxhash64("n", "size", "words"))
    windows = stored(windows.withColumn("n_words", F.size("words")), "windows")
    contents = windows.groupBy(*content).agg(F.any_value("words").alias("words"), F.any_value("size").alias("size"), F.any_value("n").alias("n"))
    contents = contents.select(*content, "n", F.expr(_shingles("words", "size")).alias("theirs"), F.expr(_simhash("words")).alias("print"))
    contents = stored(contents.select(*content, "n", F.expr(_numbered("theirs")).alias("theirs"), "print"), "contents")
    drop_stored(wanted)

    index = items.select("item_key", F.explode(F.expr(_blocks("fingerprint"))).alias("b"))
    index = index.withColumn("mask", F.explode(F.expr(f"filter(sequence(0L, 65535L), m -> bit_count(m) <= {FLIPS})")))
    index = stored(index.select(F.col("b.block").alias("block"), F.col("b.value").bitwiseXOR(F.col("mask")).alias("value"), "item_key"), "index")
    probes = contents.select(*content, F.explode(F.expr(_blocks("print"))).alias("b")).select(*content, "b.*")
    near = probes.join(index, ["block", "value"]).select(*content, "item_key").distinct()
    differ = sum((F.bit_count(F.col("print")[k].bitwiseXOR(F.col("fingerprint")[k])) for k in range(BITS // 64)), F.lit(0))
    pairs = near.join(items.select("item_key", "item_id", F.col("n").alias("item_n"), "numbered", "fingerprint"), "item_key").join(contents, content).where((F.col("n") == F.col("item_n")) & (differ <= LIMIT))
    both = F.size(F.array_intersect("theirs", "numbered"))
    scored = pairs.withColumn("both", both).withColumn("similarity", F.col("both") / F.greatest(F.lit(1), F.size("theirs") + F.size("numbered") - F.col("both")))
    scored = scored.where(F.col("similarity") >= threshold).groupBy(*content, "item_id").agg(F.max("similarity").alias("similarity"))
    met = windows.drop("words").join(scored, content)
    best = met.groupBy(*row, "item_id").agg(F.max_by(F.struct("doc_id", "start", "n_words", "similarity"), F.struct("similarity", -F.col("start"), "n_words")).alias("w"))
    return best.select(*row, "w.doc_id", "item_id", "w.start", "w.n_words", "w.similarity")
