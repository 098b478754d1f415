"""Toxicity scores: misspelled lexicon terms in their context.

Lexicon: words that labelled toxic documents use far more than clean ones.
Matching: the trie of the lexicon intersected with the Levenshtein automaton of
one edit, made deterministic state by state as words visit it.  Words that
labelled clean documents use are never taken for misspellings.
Context: a hit within quotation marks, or next to a word that reports speech,
counts as quotation; others count as abuse.  A logistic function of the two
kinds of weight and their density, fitted on labelled rows, gives the score.

Fitting looks at no more than FIT_DOCS labelled documents with different texts
(a uniform sample by hash of the text, so copies don't vote; a text with both
labels counts as toxic); word counts are added up by Spark, every word that passes
LEAST_ODDS and LEAST_SURETY is a term, and the driver gets those words and four
numbers a sampled document.  Scoring is one narrow pass over whole texts.

Null and empty texts, and all texts where nothing could be learned, get the
score of a text without hits; labelled rows without a text or a label aren't learned
from; of terms within one edit of a word the nearest counts, then the heaviest, then
the first by letters; very long texts are scanned whole; copies get equal scores; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heritas.llm.common import drop_stored, prepare, stored

FIT_DOCS = 20_000
#: Shorter terms must be met exactly.
FUZZY_FROM = 5
LEAST_ODDS = 2.5
LEAST_SURETY = 9.0
WINDOW = 6
QUOTED_SHARE = 0.25
FUZZY_SHARE = 0.6
WORD = re.compile(r"\w+")
_MARK = re.compile("[\"“”„«»‘‹›]")
#: Words that report speech, in the corpus's languages (fixed values).
REPORTING = frozenset("said says quote quoted quotes wrote called calling term word sagte zitat zitierte schrieb dijo cita escribió palabra dit citation écrit mot".split())


class FuzzyLexicon:
    """Deterministic automaton of all strings within one edit of a term."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in sorted(terms):
            at = 0
            for c in t:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                at = self.child[at][c]
            self.term[at] = t
        self.sets: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, now: set[tuple[int, int]]) -> int:
        # A letter that the word lacks: a step in the trie alone.
        now = now | {(n, 1) for at, e in now if not e for n in self.child[at].values()}
        key = frozenset(x for x in now if x[1] == 0 or (x[0], 0) not in now)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            best = None
            for at, e in key:
                t = self.term[at]
                if t is not None and (e == 0 or len(t) >= FUZZY_FROM):
                    rank = (e, -self.terms[t], t)
                    best = min(best, rank) if best else rank
            self.accepts.append((best[2], best[0]) if best else None)
        return self.known[key]

    def _step(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for at, e in self.sets[state]:
            nxt = self.child[at].get(c)
            if nxt is not None:
                out.add((nxt, e))
            if e == 0:
                out.add((at, 1))  # a letter too many
                out.update((n, 1) for n in self.child[at].values())  # another letter
        to = self._state(out) if out else -1
        self.steps[state][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within one edit."""
        at, steps = self.start, self.steps
        for c in word:
            to = steps[at].get(c)
            if to is None:
                to = self._step(at, c)
            if to < 0:
                return None
            at = to
        return self.accepts[at]


class Model:
    def __init__(self, terms: dict[str, float], clean: set[str]):
        self.lexicon = FuzzyLexicon(terms)
        self.clean = clean
        self.coef = np.zeros(4)
        self.bias = -3.0

    def hits(self, words: set[str]) -> dict[str, float]:
        """Weight of each of the words that is a term or like one."""
        found = {}
        for w in words:
            got = self.lexicon.find(w)
            if got is not None and (got[1] == 0 or w not in self.clean):
                found[w] = self.lexicon.terms[got[0]] * (FUZZY_SHARE if got[1] else 1.0)
        return found

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Weights of abuse and of quotation, abuse per 100 words, a hit or none."""
        low = (text or "").lower()
        words = WORD.findall(low)
        hit = self.hits(set(words))
        if not hit:
            return 0.0, 0.0, 0.0, 0.0
        abuse = quoted = 0.0
        spans = [m.span() for m in WORD.finditer(low)]
        for i, w in enumerate(words):
            weight = hit.get(w)
            if weight is None:
                continue
            a, b = spans[max(0, i - WINDOW)][0], spans[min(len(spans) - 1, i + WINDOW)][1]
            before, behind = len(_MARK.findall(low, a, spans[i][0])), len(_MARK.findall(low, spans[i][1], b))
            near = words[max(0, i - WINDOW) : i + WINDOW + 1]
            if (before % 2 and behind % 2) or not REPORTING.isdisjoint(near):
                quoted += weight * QUOTED_SHARE
            else:
                abuse += weight
        return float(np.log1p(abuse)), float(np.log1p(quoted)), float(np.log1p(100 * abuse / len(words))), float(abuse > 0)

    def score(self, x) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.asarray(x, float).reshape(-1, 4) @ self.coef + self.bias, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps; weights stay >= 0, so
        that a hit never lowers a score."""
        keep = np.ones(4, bool)
        prior = min(max(float(y.mean()), 1e-3), 0.5) if len(y) else 0.05
        self.bias = float(np.log(prior / (1 - prior)))
        while keep.any() and len(y) and 0 < y.sum() < len(y):
            a = np.column_stack([x[:, keep], np.ones(len(x))])
            w = np.zeros(a.shape[1])
            ridge = np.append(np.full(keep.sum(), 1.0), 1e-3)
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
                w += step
                if np.abs(step).max() < 1e-8:
                    break
            if (w[:-1] >= 0).all():
                self.coef = np.zeros(4)
                self.coef[keep], self.bias = w[:-1], float(w[-1])
                break
            at = np.flatnonzero(keep)
            keep[at[w[:-1] < 0]] = False


def fit(labelled: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """labelled: text, toxic (0/1; rows without a label don't count)."""
    prepare(labelled.sparkSession)
    rows = labelled.where(F.col("toxic").isNotNull() & F.col("text").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic"))
    n = rows.count()
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    sample = rows.where(place < int(min(1.0, fit_docs / max(1, n)) * (1 << 30))).groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = stored(sample, "labelled-sample")
    total = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    good = total["n"] - total["bad"]
    words = sample.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (F.lit(total["bad"]) + 1.0)) - F.log((F.col("good") + 0.5) / (F.lit(good) + 1.0))
    # How surely a word leans to toxic documents: its log-likelihood ratio, so
    # that rare words don't enter by chance.
    share = min(max(total["bad"], 1) / max(total["n"], 1), 0.9)
    seen = F.col("bad") + F.col("good")
    surety = F.col("bad") * F.log(F.col("bad") / (seen * share)) + F.col("good") * F.log((F.col("good") + 1e-9) / (seen * (1 - share)))
    picked = counts.where("bad >= 3").select("word", odds.alias("odds"), surety.alias("surety")).where((F.col("odds") >= LEAST_ODDS) & (F.col("surety") >= LEAST_SURETY)).collect()
    model = Model({r["word"]: float(r["odds"]) for r in picked}, set())
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def near(batches):
        for b in batches:
            own = [w for w in b.column(0).to_pylist() if (shared.value.lexicon.find(w) or ("", 0))[1]]
            yield pa.RecordBatch.from_pydict({"word": pa.array(own, pa.string())})

    # Clean words like a term: a few of the bounded sample's words.
    model.clean = {r["word"] for r in counts.where("good > 0").select("word").mapInArrow(near, "word string").collect()}
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def look(batches):
        for b in batches:
            x = [shared.value.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"toxic": b.column(1), "x": pa.array(x, pa.list_(pa.float64()))})

    seen = sample.select("text", "toxic").mapInArrow(look, "toxic int, x array<double>").toPandas()
    drop_stored(sample)
    if len(seen):
        model.fit(np.array(seen["x"].tolist(), float), seen["toxic"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, abuse, quotation (log weights)."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            x = np.array([m.features(t) for t in b.column(1).to_pylist()], float).reshape(-1, 4)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(m.score(x)), "abuse": pa.array(x[:, 0]), "quotation": pa.array(x[:, 1])})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, abuse double, quotation double")
