"""URL filters: rules by host and path, and an exact Bloom filter cascade.

The cascade represents a list of keys within a universe (all keys of the
corpus).  Level 1 is a Bloom filter of the listed keys; level 2 one of the
universe's other keys that level 1 takes for listed; level 3 one of the listed
keys that level 2 takes for others; and so on until no key is mistaken.  A key
is listed if the first level that denies it has an even number, or, if none
denies it, if the number of levels is odd.  For keys of the universe this is
exact.

Bits are computed with DataFrame functions alone: keys to bit places, places to
64-bit words by bit_or with partial results.  A level has BITS_A_KEY bits for each
of its keys, all levels together at most about 1.2 times the first.  Keys are dealt
by hash to shards, each with a cascade of its own of at most about SHARD_WORDS words
a level, so that its arrays are built side by side.  Judging is a narrow pass
without joins whatever the list's length: the levels of up to GROUP shards come in
as one row of a scalar subquery (GROUP * SHARD_WORDS * 8 bytes, 64 MiB, and 1.2
times that with all levels), and a key finds its shard's by position.  A list of
more than GROUP shards (some 67 million keys) takes a pass for each GROUP shards,
written in between, so that no pass holds more.

Null urls and urls without `://` have an empty host and path and are judged by
the cascade like any other host; repeated urls get equal verdicts; an empty
table gives an empty result; an empty list allows all; columns named host, path,
rule or verdict are replaced, all others stay.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import ascii_lower, prepare, scope, stored

HASHES = 5
BITS_A_KEY = 8
#: 64-bit words of a shard's level (2 MiB), about, and shards of one broadcast row.
SHARD_WORDS, GROUP = 1 << 18, 32

#: The contract's rules (fixed values): host, path, verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def with_host_path(pages: DataFrame) -> DataFrame:
    """pages with host and path of their urls."""
    url = F.col("url").cast("string")
    rest = F.when(url.contains("://"), F.expr("substring(CAST(url AS string), locate('://', CAST(url AS string)) + 3)"))
    bare = F.regexp_extract(rest, r"^([^?#]*+)", 1)
    host = ascii_lower(F.regexp_extract(bare, r"^([^/]*+)", 1))
    path = F.regexp_extract(bare, r"(?s)^[^/]*+(.*)$", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


class Cascade:
    """tables: of each level, rows (shard, level, n_bits, words)."""

    def __init__(self, tables: list[DataFrame], shards: int):
        self.tables, self.shards, self.depth = tables, shards, len(tables)
        self.levels = functools.reduce(DataFrame.union, tables) if tables else None

    def listed(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """df with a boolean column: is the key one of the listed ones?"""
        df = df.withColumn(out, F.lit(False))
        for first in range(0, self.shards if self.depth else 0, GROUP):
            if first:  # one group's levels at a time
                df = stored(df, "judged")
            rows = self.levels.where(F.col("shard").between(first, first + GROUP - 1))
            cascades = rows.groupBy("shard").agg(F.expr("transform(array_sort(collect_list(struct(level, n_bits, words))), x -> struct(x.n_bits AS n_bits, x.words AS words)) AS levels"))
            own = df.withColumn("_shard__", shard_of(F.col(key), self.shards) - first).withColumn("_levels__", F.get(_by_shard(cascades, first, "levels").scalar(), "_shard__"))
            verdict = F.when(~F.col("_shard__").between(0, GROUP - 1), F.col(out)).when(F.col("_levels__").isNull(), F.lit(False))
            for i in range(self.depth):
                level = F.col("_levels__")[i]
                verdict = verdict.when(F.size("_levels__") == i, F.lit(i % 2 == 1)).when(~holds(F.col(key), level["n_bits"], level["words"], i), F.lit(i % 2 == 1))
            df = own.withColumn(out, verdict.otherwise(F.lit(self.depth % 2 == 1))).drop("_levels__", "_shard__")
        return df


def _by_shard(rows: DataFrame, first: int, value: str) -> DataFrame:
    """One row: an array with the value of each shard of a group, or null."""
    held = rows.select((F.col("shard") - first).alias("place"), F.col(value).alias("value"))
    all_ = held.unionByName(rows.sparkSession.range(GROUP).select(F.col("id").cast("int").alias("place")), allowMissingColumns=True)
    one = all_.groupBy("place").agg(F.max_by("value", F.col("value").isNotNull()).alias("value"))
    return one.agg(F.expr("transform(array_sort(collect_list(struct(place, value))), x -> x.value)").alias("values"))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards)).cast("int")


def places(key: Column, n_bits: Column, level: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), n_bits) for i in range(HASHES)]


def holds(key: Column, n_bits: Column, words: Column, level: int) -> Column:
    """Does a level's filter take the key?"""
    out = F.lit(True)
    for at in places(key, n_bits, level):
        word = F.get(words, F.floor(at / 64).cast("int"))
        out = out & (F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return out


def _filter(keys: DataFrame, level: int, shards: int) -> DataFrame:
    """shard, level, n_bits, words of each shard's keys."""
    sizes = keys.groupBy("shard").agg((F.ceil(F.count("*") * BITS_A_KEY / 64).cast("int")).alias("n_words"))
    sizes = stored(sizes, "bloom-sizes")
    bits = None
    for first in range(0, shards, GROUP):
        own = keys.where(F.col("shard").between(first, first + GROUP - 1))
        own = own.withColumn("n_words", F.get(_by_shard(sizes.where(F.col("shard").between(first, first + GROUP - 1)), first, "n_words").scalar(), F.col("shard") - first))
        bits = own if bits is None else bits.union(own)
    at = F.explode(F.array(*places(F.col("key"), F.col("n_words").cast("long") * 64, level)))
    words = bits.select("shard", at.alias("at")).select("shard", F.floor(F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, CAST(pmod(at, 64) AS int))").alias("bits"))
    # All words of a shard, so that none is missing.
    none = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("w"), F.lit(0).cast("long").alias("bits"))
    words = words.union(none).groupBy("shard", "w").agg(F.expr("bit_or(bits)").alias("bits"))
    packed = words.groupBy("shard").agg(F.expr("transform(array_sort(collect_list(struct(w, bits))), x -> x.bits)").alias("words"))
    return packed.select("shard", F.lit(level).alias("level"), (F.size("words").cast("long") * 64).alias("n_bits"), "words")


def build(universe: DataFrame, listed: DataFrame) -> Cascade:
    """universe: key (distinct, without nulls), all keys that will be asked;
    listed: key, the listed ones among them."""
    prepare(universe.sparkSession)
    marked = universe.join(listed.select("key", F.lit(True).alias("listed")).distinct(), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    marked = stored(marked, "universe")
    n = marked.where("listed").count()
    if not n:
        return Cascade([], 1)
    shards = -(-n * BITS_A_KEY // (64 * SHARD_WORDS))
    marked = marked.withColumn("shard", shard_of(F.col("key"), shards))
    inside, outside = marked.where("listed").select("shard", "key"), marked.where("NOT listed").select("shard", "key")
    levels, level = [], 0
    while True:
        row = stored(_filter(inside, level, shards), "bloom")
        levels.append(row)
        taken = None
        for first in range(0, shards, GROUP):
            held = row.where(F.col("shard").between(first, first + GROUP - 1)).select("shard", F.struct("n_bits", "words").alias("level"))
            own = outside.where(F.col("shard").between(first, first + GROUP - 1)).withColumn("own", F.get(_by_shard(held, first, "level").scalar(), F.col("shard") - first))
            own = own.where(holds(F.col("key"), F.col("own.n_bits"), F.col("own.words"), level)).select("shard", "key")
            taken = own if taken is None else taken.union(own)
        taken = stored(taken, "mistaken")
        level += 1
        if not taken.limit(1).count():
            return Cascade(levels, shards)
        inside, outside = taken, inside


def judge(pages: DataFrame, blocked_hosts: DataFrame, rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict; hosts that no rule covers are
    blocked if they are among blocked_hosts (key)."""
    with scope() as keep:
        known = stored(with_host_path(pages.select("url")).select(F.col("host").alias("key")).distinct(), "hosts")
        cascade = build(known, blocked_hosts)
        keep(*cascade.tables)
    ruled = with_host_path(pages)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    found = cascade.listed(ruled, "host", "_listed__")
    return found.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("_listed__"), "block").otherwise("allow"))).drop("_listed__")
