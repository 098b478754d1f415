"""Operators on the driver's small tables: held-out labels, all pairs, planted keys."""

import os
from collections import Counter

import pytest

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_language_of_held_out_documents(spark):
    from heritas.llm import queries

    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op8_language_id(spark, SF).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert len(got) > 150 and sum(r["lang_pred"] == lang[r["doc_id"]] for r in got) >= 0.98 * len(got)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test data")
def test_toxicity_of_held_out_documents(spark):
    """On the table with some 500 toxic documents; the smaller one has too few to
    learn from (9 of 14 held-out ones found, none of 80 clean ones marked)."""
    from heritas.llm import queries

    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    got = [(r["predicted"], toxic[r["doc_id"]]) for r in queries.op6_toxicity(spark, LARGER).collect() if r["held_out"] and r["doc_id"] in toxic]
    found, clean = [p for p, t in got if t == 1], [p for p, t in got if t == 0]
    assert sum(found) >= 0.8 * len(found) and sum(clean) <= 0.03 * len(clean)


def test_near_duplicates_of_all_pairs(spark):
    """Components over the links of all pairs of documents."""
    from heritas.llm import queries

    sets = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)} if w else set()
    where: dict = {}
    for d, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    links = 0
    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in where[x] if e < d).items():
            if 100 * both >= 85 * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
                links += 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op5_near_dedup(spark, SF).collect()}
    assert links > 50 and got == {d: (len(s), find(d)) for d, s in sets.items()}


def test_planted_keys(spark):
    from heritas.llm import queries

    planted = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lower(text) LIKE '%token = \"%'").collect()}
    got = {r["doc_id"]: r["n_id"] for r in queries.op7_pii(spark, SF).collect()}
    assert len(planted) > 5 and all(got[d] for d in planted)
