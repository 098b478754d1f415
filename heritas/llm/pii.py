"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches per
kind with their checks.  They seed the extraction of further identifiers:

* an instance is a base match, or a token with a digit outside all base matches
  (without the marks around it);
* seeds are base matches and tokens in the form of a key: KEY_LENGTH or more of
  letters, digits and `_+/=-`, with KEY_RUNS or more runs of letters and KEY_DIGITS
  or more digits;
* a pattern is the word before an instance, the two words before it, the word
  behind it, or the instance's own shape (digits as 9, letters as a; of letters
  and digits in turn, the length);
* Spark scores the graph of patterns and instances in ROUNDS turns: a pattern's
  score is the confidence that its instances have, added up, over how often the
  pattern occurs in the whole corpus; an instance's confidence is the noisy-or of
  its patterns' scores (seeds keep 1).  Each round admits the patterns that the
  last one's instances reach, so contexts up to ROUNDS patterns from a seed are
  found.  Patterns with instances at under FLOOR of their occurrences, such as
  common words, score 0;
* tokens with a pattern of at least MIN_SCORE and MIN_SUPPORT different instances
  are reported as kind `id`.

Everything is DataFrame functions.  Texts are scanned in pieces of PIECE or more
characters, cut between white space and a letter, where no base match and no token
goes on; so the work grows with a text's length and not with its square.  The pass
keeps spans and contexts only; word counts are pre-aggregated and restricted to
the patterns' words; edges are one row a pattern and value before any join.

Null texts count as empty and have no spans.  Very long texts are scanned
whole; the patterns can't backtrack over more than one run of characters.
Copies, repeated ids and null ids get their own rows, equal texts of one id equal
spans; of equal scores all are reported; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, prepare, scope, stored

KINDS = ("email", "ip", "card", "phone", "id")
#: The contract's patterns.  Possessive parts and look-behinds change no match:
#: a run's characters can't begin a match unless the run's first can, or the
#: last match ended there (\G).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
ROUNDS = 3
MIN_SCORE = 0.5
MIN_SUPPORT = 5
FLOOR = 0.05
KEY_LENGTH, KEY_RUNS, KEY_DIGITS = 20, 3, 4
PIECE = 1024
#: A piece of a text (see above), or what is left of it.
PIECES = rf"(?s).{{{PIECE},}}?(?:[\x20\x09-\x0D](?=\p{{L}})|\z)|.+"
WHITE = r"[\x20\x09-\x0D]+"
SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _located(text: str, pattern: str) -> str:
    """SQL: array of (start, value) of a pattern's matches in a column."""
    p = "r'" + pattern.replace("'", "\\x27") + "'"
    return (
        f"aggregate(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, v) -> named_struct('gap', g, 'value', v)), "
        "named_struct('at', 0, 'all', CAST(array() AS array<struct<start:int,value:string>>)), "
        "(acc, x) -> IF(x.value IS NULL, acc, named_struct('at', acc.at + length(x.gap) + length(x.value), "
        "'all', array_append(acc.all, named_struct('start', acc.at + length(x.gap), 'value', x.value)))), acc -> acc.all)"
    )


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


_CHECKS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> length(ltrim('0', p)) <= 3 AND CAST(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
    "card": f"length({_digits('x.value')}) BETWEEN 12 AND 19 AND luhn_check({_digits('x.value')})",
    "phone": f"length({_digits('x.value')}) BETWEEN 9 AND 15",
}


def _quoted(pattern: str) -> str:
    """SQL: a pattern as a raw string."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _base(text: str) -> str:
    """SQL: base spans of a text."""
    spans = []
    for k, (kind, pattern, has) in enumerate((("email", EMAIL, "contains({t}, '@')"), ("ip", IP, "contains({t}, '.') AND {t} RLIKE '[0-9][.][0-9]'"), ("card", CARD, "{t} RLIKE '[0-9]'"), ("phone", PHONE, "contains({t}, '+')"))):
        found = f"transform(filter({_located(text, pattern)}, x -> {_CHECKS[kind]}), x -> named_struct('start', x.start, 'kind', {k}, 'stop', x.start + length(x.value)))"
        spans.append(f"IF({has.format(t=text)}, {found}, CAST(array() AS {SPAN}))")
    return f"array_sort(concat({', '.join(spans)}))"


def _in_pieces(docs: DataFrame, text: str) -> DataFrame:
    """docs with the pieces__ of a text, and at__: what lies before each."""
    cut = f"CASE WHEN {text} IS NULL THEN CAST(array() AS array<string>) WHEN length({text}) <= {2 * PIECE} THEN array({text}) ELSE regexp_extract_all({text}, {_quoted(PIECES)}, 0) END"
    docs = docs.withColumn("pieces__", F.expr(cut)).withColumn("at__", F.expr("transform(pieces__, x -> length(x))"))
    return docs.withColumn("at__", F.expr("transform(at__, (x, i) -> aggregate(slice(at__, 1, i), 0, (s, n) -> s + n))"))


def with_base_spans(docs: DataFrame, text: str = "text", out: str = "base") -> DataFrame:
    """docs and a column of base spans, sorted by start, then kind."""
    own = "transform(pieces__, (piece, i) -> transform(" + _base("piece") + ", s -> named_struct('start', s.start + at__[i], 'kind', s.kind, 'stop', s.stop + at__[i])))"
    return _in_pieces(docs, text).withColumn(out, F.expr(f"flatten({own})")).drop("pieces__", "at__")


def keyed(docs: DataFrame) -> DataFrame:
    """A key of the row's content, for rows whose id is null or repeated."""
    return docs.withColumn("row_key_a__", F.xxhash64("doc_id", "text")).withColumn("row_key_b__", F.xxhash64("text", "doc_id", F.lit(7)))


#: A token's part from its first letter or digit to its last; what may stand
#: before the first; marks that end a text; and the rest of a token.
CORE, LEAD = r"^[^\p{L}\p{N}]*+((?s:.*)[\p{L}\p{N}])", r"^[^\p{L}\p{N}]*+"
OPEN, REST = r"[^\x20\x09-\x0D\p{L}\p{N}]+$", r"^[^\x20\x09-\x0D]++"
KEY = rf"^[A-Za-z0-9_+/=-]{{{KEY_LENGTH},}}$"
#: Sides of a pattern: the word before, the two words before, the word behind,
#: and the shape.
BEFORE, TWO, BEHIND, SHAPE = "L", "LL", "R", "S"


def _words(text: str) -> str:
    """SQL: the words of a text, lower-cased."""
    return f"filter(split(lower({text}), {_quoted(WHITE)}), w -> w <> '')"


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, row key, base spans and instances (kind, start, stop, value, and
    the words before and behind)."""
    texts = _in_pieces(keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))), "text")
    loose = f"IF(piece RLIKE '[0-9]', {_located('piece', TOKEN)}, CAST(array() AS array<struct<start:int,value:string>>))"
    loose = f"transform({loose}, x -> named_struct('start', x.start + length(regexp_extract(x.value, {_quoted(LEAD)}, 0)), 'value', regexp_extract(x.value, {_quoted(CORE)}, 1)))"
    loose = f"filter({loose}, x -> NOT exists(bases, b -> b.start < x.start + length(x.value) AND x.start < b.stop))"
    spans = f"concat(bases, transform({loose}, x -> named_struct('start', x.start, 'kind', 4, 'stop', x.start + length(x.value))))"
    # Words beside a piece's first and last token may lie in the next pieces.
    before = _words(f"regexp_replace(concat(IF(i > 0, pieces__[i - 1], ''), substring(piece, 1, z.start)), {_quoted(OPEN)}, '')")
    behind = _words(f"regexp_replace(concat(substring(piece, z.stop + 1), IF(i + 1 < size(pieces__), pieces__[i + 1], '')), {_quoted(REST)}, '')")
    found = f"""transform({spans}, z -> named_struct('start', z.start + at__[i], 'kind', z.kind, 'stop', z.stop + at__[i],
        'value', substring(piece, z.start + 1, z.stop - z.start), 'before', slice(reverse({before}), 1, 2), 'behind', get({behind}, 0)))"""
    each = f"transform(pieces__, (piece, i) -> element_at(transform(array({_base('piece')}), bases -> {found}), 1))"
    out = texts.withColumn("instances", F.expr(f"flatten({each})"))
    base = "transform(filter(instances, z -> z.kind < 4), z -> named_struct('start', z.start, 'kind', z.kind, 'stop', z.stop))"
    return out.select("doc_id", "row_key_a__", "row_key_b__", F.array_sort(F.expr(base)).alias("base"), "instances")


def _shape(value: str) -> str:
    """SQL: the form of a value."""
    letters, plain = _quoted(r"\p{L}+"), _quoted(r"^[\p{L}\p{N}_+/=-]+$")
    runs = f"size(regexp_extract_all({value}, {letters}, 0))"
    return f"IF({runs} >= {KEY_RUNS} AND {value} RLIKE {plain}, concat('mixed ', length({value})), regexp_replace(regexp_replace({value}, {letters}, 'a'), '[0-9]', '9'))"


def discovered(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans of kind `id` by row key: row_key_a__, row_key_b__, more."""
    with scope() as keep:
        out = stored(_discovered(scanned, docs), "found")
        keep(out)
    return out


def _discovered(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    row = ["row_key_a__", "row_key_b__"]
    one = scanned.select(*row, F.explode("instances").alias("i")).select(*row, "i.*")
    is_key = f"value RLIKE {_quoted(KEY)} AND size(regexp_extract_all(value, '[A-Za-z]+', 0)) >= {KEY_RUNS} AND length({_digits('value')}) >= {KEY_DIGITS}"
    one = one.withColumn("seed", F.expr(f"kind < 4 OR ({is_key})"))
    sides = ((BEFORE, "get(before, 0)"), (TWO, "concat(get(before, 1), ' ', get(before, 0))"), (BEHIND, "behind"), (SHAPE, _shape("value")))
    contexts = F.explode(F.expr("array(" + ", ".join(f"named_struct('side', '{s}', 'word', {w})" for s, w in sides) + ")")).alias("c")
    met = one.select("seed", "value", contexts).select("seed", "value", "c.*").where("word <> ''")
    edges = stored(met.groupBy("side", "word", "value").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "edges")
    # Patterns of a few instances can't reach MIN_SUPPORT.  All others stay, as a
    # round can admit patterns that no seed touches.
    support = edges.groupBy("side", "word").agg(F.count("*").alias("support"), F.sum("n").alias("met")).where(F.col("support") >= MIN_SUPPORT)
    support = stored(support, "support")
    words = docs.select(F.expr(_words("CAST(text AS string)")).alias("w"))
    pairs = "IF(size(w) > 1, zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> concat(a, ' ', b)), CAST(array() AS array<string>))"
    known = support.where(F.col("side") != SHAPE).select("word").distinct()
    often = words.select(F.explode(F.expr(f"concat(w, {pairs})")).alias("word")).join(known, "word", "left_semi").groupBy("word").agg(F.count("*").alias("often"))
    counted = support.join(often, "word", "left").withColumn("often", F.when(F.col("side") == SHAPE, F.col("met")).otherwise(F.greatest("often", "met")))
    patterns = stored(counted.where(F.col("met") >= FLOOR * F.col("often")).select("side", "word", "often"), "patterns")
    graph = stored(edges.join(patterns, ["side", "word"]), "graph")
    drop_stored(edges, support)
    # Values without confidence, which add nothing, have no row.
    trust = graph.where("seed").select("value").distinct().withColumn("trust", F.lit(1.0))
    scored = None
    for _ in range(ROUNDS):
        scored = graph.join(trust, "value").groupBy("side", "word").agg(F.least(F.lit(0.999), F.sum(F.col("n") * F.col("trust")) / F.max("often")).alias("score"))
        scored = stored(scored, "scores")
        trust = graph.join(scored, ["side", "word"]).groupBy("value").agg(F.greatest(F.max(F.col("seed").cast("double")), 1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("trust"))
        trust = stored(trust, "trust")
    good = scored.where(F.col("score") >= MIN_SCORE).select("side", "word")
    loose = one.where("kind = 4").select(*row, "start", "stop", contexts).select(*row, "start", "stop", "c.*")
    hit = loose.join(good, ["side", "word"], "left_semi")
    return hit.groupBy(*row).agg(F.collect_set(F.struct(F.col("start"), F.lit(4).alias("kind"), F.col("stop"))).alias("more"))


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(name[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["stop"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, stop; kinds as in KINDS)."""
    prepare(docs.sparkSession)
    scanned = stored(_scanned(docs), "pii")
    more = discovered(scanned, docs)
    both = scanned.select("doc_id", "row_key_a__", "row_key_b__", "base").join(more, ["row_key_a__", "row_key_b__"], "left")
    return both.select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("more", F.expr(f"CAST(array() AS {SPAN})")))).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind and of all spans, and the spans as text."""
    count = [F.expr(f"CAST(size(filter(base, s -> s.kind = {k})) AS long) AS n_{kind}") for k, kind in enumerate(KINDS[:4])]
    count.append(F.expr("CAST(size(filter(spans, s -> s.kind = 4)) AS long) AS n_id"))
    return found.select("doc_id", *count, F.size("spans").cast("long").alias("n_spans"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by <kind> (overlapping spans by
    the first one's kind)."""
    prepare(docs.sparkSession)
    scanned = stored(_scanned(docs), "pii")
    more = discovered(scanned, docs).withColumnRenamed("more", "more__")
    rows = keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("row__")))
    whole = with_base_spans(rows, out="base__").join(more, ["row_key_a__", "row_key_b__"], "left")
    spans = f"array_sort(concat(base__, coalesce(more__, CAST(array() AS {SPAN}))))"
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    text = (
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (acc, s) -> IF(s.start >= acc.at, "
        f"named_struct('at', s.stop, 'out', concat(acc.out, substring(text, acc.at + 1, s.start - acc.at), element_at(array({names}), s.kind + 1))), "
        "named_struct('at', greatest(acc.at, s.stop), 'out', acc.out)), acc -> concat(acc.out, substring(text, acc.at + 1)))"
    )
    new = F.when(F.col("text").isNull(), F.col("text")).when((F.size("base__") == 0) & F.col("more__").isNull(), F.col("text")).otherwise(F.expr(text))
    return whole.select(*[new.alias("text") if c == "text" else F.col("row__")[c].alias(c) for c in docs.columns])
