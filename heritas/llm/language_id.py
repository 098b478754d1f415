"""Language identification by error-correcting output codes.

Every language has a binary codeword.  One linear classifier per bit, over
hashed byte 2- and 3-grams of the lower-cased text, predicts its bit; decoding
adds each bit's logistic loss against every codeword and takes the nearest.
Two codewords that are nearly as near make the answer ambiguous.

Fitting: at most TRAIN_PER_LANG labelled documents a language (those whose
hash of the text falls under a threshold that its count sets, so that the
sample is uniform and needs no sort) give n-gram counts, added up by Spark and
reduced to one row a language and bucket; the classifiers' weights are smoothed
log-odds of the bit's two sides.  The model's size depends on the number of
languages and BUCKETS alone.  Prediction is a narrow pass over whole texts.

A null text or one without a letter is `und` with score 0; a text in letters of no
learned language gets the nearest one and is ambiguous if another is nearly as near;
of codewords equally near the first language by name counts; very long texts are
read in pieces whose sums add up; copies get equal answers; without any labelled
row every answer is `und`; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import prepare

TRAIN_PER_LANG = 2000
BUCKETS = 1 << 15
SMOOTH = 0.5
#: n-grams scored at once.
PIECE = 1 << 18
#: Answers whose two best losses differ by less, per bit, are ambiguous.
AMBIGUOUS = 0.05


def _grams(text: str) -> np.ndarray:
    """Buckets of the 2-grams, then of the 3-grams, of a text's bytes."""
    b = np.frombuffer((" " + text.lower() + " ").encode(), np.uint8).astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    h = np.concatenate([two | np.uint32(1 << 24), three]) * np.uint32(2654435761)
    return (h >> np.uint32(17)).astype(np.int64)


def code_words(n: int) -> np.ndarray:
    """n codewords of -1 and 1.  Up to seven classes: all splits into two
    sides, which is the exhaustive code.  More: columns of fixed pseudo-random
    balanced splits, eight times the bits that n needs."""
    if n <= 7:
        cols = [[1 if (s >> i) & 1 else -1 for i in range(n)] for s in range(1, 1 << max(n - 1, 0))]
        return np.array(cols or [[1] * n], np.int8).T
    rng = np.random.default_rng(n)
    base = np.array([1, -1] * n, np.int8)[:n]
    return np.stack([rng.permutation(base) for _ in range(8 * int(np.ceil(np.log2(n))))], axis=1)


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, code_words(len(langs))
        weights = []
        for bit in self.code.T:
            if len(langs) < 2:
                weights.append(np.zeros(BUCKETS, np.float32))
                continue
            side = [np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS)) for c in (_even(counts[bit > 0]), _even(counts[bit < 0]))]
            weights.append((side[0] - side[1]).astype(np.float32))
        self.weights = np.stack(weights, axis=1)

    def margins(self, text: str) -> np.ndarray:
        """A classifier's mean log-odds of each bit."""
        g, total = _grams(text), np.zeros(self.weights.shape[1])
        for i in range(0, len(g), PIECE):
            total += self.weights[g[i : i + PIECE]].sum(0)
        return total / max(1, len(g))

    def predict(self, text: str | None) -> tuple[str, float, bool, int]:
        """(language, score, ambiguous, letters)."""
        letters = sum(map(str.isalpha, text)) if text else 0
        if not letters or not self.langs:
            return "und", 0.0, True, letters
        m = self.margins(text)
        # A longer text gives surer bits; 16 letters count as much as 16,000.
        loss = np.log1p(np.exp(-np.clip(self.code * m * 16, -500, 500))).sum(1)
        order = np.argsort(loss, kind="stable")
        best = order[0]
        p = np.exp(loss[best] - loss)
        gap = (loss[order[1]] - loss[best]) / len(m) if len(loss) > 1 else np.inf
        return self.langs[best], float(1 / p.sum()), bool(gap < AMBIGUOUS), letters


def _even(rows: np.ndarray) -> np.ndarray:
    """Counts of a side, each of its languages with the same weight."""
    each = rows.sum(1, keepdims=True)
    return (rows / np.maximum(each, 1) * each.mean()).sum(0)


def fit(labelled: DataFrame, per_lang: int = TRAIN_PER_LANG) -> Model:
    """labelled: text, lang (rows without either don't count)."""
    prepare(labelled.sparkSession)
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_lang / sizes[k]))])
    fraction = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    place = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), BUCKETS), np.int64)
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[place[lang]] += np.bincount(_grams(text), minlength=BUCKETS)
        row, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(row.astype(np.int32)), "bucket": pa.array(bucket.astype(np.int32)), "n": pa.array(total[row, bucket])})

    sample = rows.where(fraction < share[F.col("lang")])
    found = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(langs), BUCKETS))
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, letters."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            lang, score, unsure, letters = zip(*got) if got else ((), (), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "ambiguous": pa.array(unsure, pa.bool_()), "letters": pa.array(letters, pa.int64())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean, letters long")


def flags(docs: DataFrame, model: Model) -> Column:
    """Predictions as a column beside all others: struct lang_pred, score, ambiguous, letters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean, letters long")
    def judge(text):
        import pandas as pd

        m = shared.value
        return pd.DataFrame([m.predict(t) for t in text], columns=["lang_pred", "score", "ambiguous", "letters"])

    return judge(F.col("text").cast("string"))
