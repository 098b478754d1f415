"""Near-duplicates, repeated passages, decontamination, PII, URLs, pipeline."""

import hashlib
import random
import re
from collections import Counter

import pytest

from heritas.llm import components, decontamination, near_dedup, pii, suffix_dedup, url_filter


def _words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages and odd rows."""
    rng = random.Random(7)
    base, passage = _words(rng, 150), _words(rng, 70)
    rows = [(i, " ".join(_words(rng, 120))) for i in range(10, 40)]
    rows += [(40 + i, " ".join(base)) for i in range(25)]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(1, 9)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        rows.append((70 + i, " ".join(w)))
    for i in range(6):
        w = _words(rng, 100)
        at = rng.randrange(100)
        rows.append((120 + i, " ".join(w[:at] + passage + w[at:])))
    rows += [(1, None), (2, ""), (3, "one"), (4, "One"), (5, "two words"), (6, " \n\t "), (7, "Two  WORDS"), (8, "loop " * 300), (9, "loop " * 200)]
    return spark.createDataFrame([(i, t, "e", i) for i, t in rows], "doc_id long, text string, bands string, rep long").repartition(5)


def _sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = frozenset(zip(*[w[k:] for k in range(size)])) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()
    return out


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_near_duplicates(corpus, size, percent):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    s = _sets(rows, size)
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(corpus, size, percent).collect()}
    assert got == {i: (len(s[i]), find(i), find(i) == i) for i in ids}
    assert near_dedup.near_duplicates(corpus.where("doc_id < 0"), size, percent).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    """Two texts of one id: links of either are the document's, in any row order.
    A hub of many near copies, and rows without an id."""
    rng = random.Random(3)
    a, b = _words(rng, 80), _words(rng, 90)
    hub = _words(rng, 200)
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], "x1"])), (3, " ".join([*b[:-1], "x2"])), (None, " ".join(a)), (None, None), (4, " ".join(_words(rng, 70)))]
    rows += [(100 + i, " ".join([*hub[:-2], f"p{i}", f"q{i}"])) for i in range(600)] + [(99, " ".join(hub))]
    for order in (rows, rows[::-1]):
        got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 3, 85).collect()]
        want = [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (99, 99, True), (None, None, True), (None, None, True)]
        assert sorted(got, key=str) == sorted(want + [(100 + i, 99, False) for i in range(600)], key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent


def test_repeated_passages(spark, corpus):
    rows = [(r["doc_id"], (r["text"] or "").lower().split()) for r in corpus.collect()]
    where: dict = {}
    for d, w in rows:
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), set()).add(d)
    want = set()
    for d, w in rows:
        hit = [i for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1]
        for i in hit:
            if i - 1 in hit:
                continue
            j = i
            while j + 1 in hit:
                j += 1
            want.add((d, i, j + 50))
    merged = set()
    for d in {x[0] for x in want}:
        cur = None
        for _, a, b in sorted(x for x in want if x[0] == d):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
            else:
                if cur:
                    merged.add((d, *cur))
                cur = [a, b]
        merged.add((d, *cur))
    got = {(r["doc_id"], r["start"], r["stop"]) for r in suffix_dedup.repeated_passages(corpus).collect()}
    assert got == merged
    assert suffix_dedup.repeated_passages(corpus.where("doc_id < 0")).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    items = [(k, " ".join(_words(rng, n))) for k, n in enumerate((20, 34, 50, 60, 3))] + [(90, None), (91, ""), (92, "...")]
    rows = [(i, " ".join(_words(rng, 80))) for i in range(20)]
    for i, (k, t) in enumerate(items[:5]):
        w = _words(rng, 60)
        rows.append((100 + i, " ".join(w[:17] + t.split() + w[17:])))
        rows.append((200 + i, (" ".join(w[:5]) + " " + t.upper() + ". " + " ".join(w[5:]))))
    edited = items[3][1].split()
    edited[30] = "changed"
    rows.append((300, " ".join(_words(rng, 30) + edited)))
    rows += [(1, None), (2, ""), (3, items[2][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, words string").where("NOT (doc_id IN (1, 2, 3) AND words IS NULL)")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontamination.contaminated(docs, bench).collect()}
    want = {(100 + k, k) for k in range(5)} | {(200 + k, k) for k in range(5)} | {(300, 3), (3, 2)}
    assert set(got) == want and got[100, 0] == 1.0 and got[300, 3] == pytest.approx(51 / 61)
    assert decontamination.contaminated(docs.where("doc_id < 0"), bench).count() == 0
    assert decontamination.contaminated(docs, bench.where("item_id < 0")).count() == 0


def test_repeated_passages_from_50_words(spark):
    """Passages of 50 to 66 words of which other texts share a longer right or
    left part that is shorter than 50 words."""
    rng = random.Random(31)
    rows, want = [], {}
    for k in range(60):
        n = 50 + k % 17
        p = _words(rng, n)
        cut = rng.randint(1, min(16, n - 34))
        texts = [_words(rng, 20) + p + _words(rng, 20) for _ in range(2)]
        # One of the texts goes on as the other two do, on one side each.
        texts += [_words(rng, 20) + (p + texts[0][20 + n :])[n - 49 + cut : n + cut] + _words(rng, 20), _words(rng, 20) + (texts[0][:20] + p)[20 - cut : 69 - cut] + _words(rng, 20)]
        rows += [(10 * k + i, " ".join(t)) for i, t in enumerate(texts)]
    where: dict = {}
    for d, t in rows:
        w = t.split()
        for i in range(len(w) - 49):
            where.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    for places in where.values():
        if len({d for d, _ in places}) > 1:
            for d, i in places:
                want.setdefault(d, set()).update(range(i, i + 50))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got: dict = {}
    for r in suffix_dedup.repeated_passages(df).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start"], r["stop"]))
    assert len(want) >= 120 and got == want


def _best_windows(spark, docs, items):
    """What the operator finds, and brute force over all windows: (similarity,
    start) by document and item."""
    def bag(w):
        return Counter(zip(*[w[j:] for j in range(5)]))

    want = {}
    for d, w in docs.items():
        for k, t in items.items():
            mine, n = bag(t), min(len(t), len(w))
            for at in range(len(w) - n + 1):
                theirs = bag(w[at : at + n])
                both = (mine & theirs).total()
                score = both / (mine.total() + theirs.total() - both)
                if score >= 0.8 and score > want.get((d, k), (0, 0))[0]:
                    want[d, k] = (score, at)
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start"]) for r in decontamination.contaminated(df, bench).collect()}
    return got, want


def test_decontamination_ties_and_repeats(spark):
    """Equal windows: the first; repeated rows once; two texts of an id; many
    documents with one passage."""
    rng = random.Random(29)
    item = _words(rng, 30)
    twice = " ".join([*item, "gap", *item])
    rows = [(1, twice), (1, twice), (1, " ".join(["lead", *item])), (None, twice), (2, " ".join(_words(rng, 50)))] + [(10 + i, " ".join(_words(rng, i) + item)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["start"], r["similarity"]) for r in decontamination.contaminated(df, spark.createDataFrame([(5, " ".join(item)), (5, " ".join(item))], "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1.0), (1, 1, 1.0), (None, 0, 1.0)] + [(10 + i, i, 1.0) for i in range(40)], key=str)


def test_simhash_index_guarantee():
    """Fingerprints within RADIUS bits share a block up to FLIPS bits."""
    rng = random.Random(5)
    for _ in range(2000):
        flips = rng.sample(range(decontamination.BITS), decontamination.RADIUS)
        assert min(sum(b // 16 == k for b in flips) for k in range(decontamination.BLOCKS)) <= decontamination.FLIPS


def test_decontamination_swapped_parts(spark):
    rng = random.Random(19)
    items = {0: _words(rng, 60), 1: _words(rng, 60), 2: _words(rng, 50), 3: ["a0", "b0"] * 10}
    docs = {0: _words(rng, 20) + items[0][30:] + items[0][:30] + _words(rng, 20), 1: items[1][20:] + items[1][:20], 2: items[2][:45], 3: ["a0", "b0"] * 25}
    got, want = _best_windows(spark, docs, items)
    assert want[0, 0] == (52 / 60, 20) and set(want) == {(k, k) for k in range(4)}
    assert got == want


def test_decontamination_changed_ends(spark):
    """Words changed at one end flip more bits than words inside."""
    rng = random.Random(23)
    items = {k: _words(rng, 50) for k in range(20)}
    docs = {}
    for i in range(300):
        t, new = items[i % 20], _words(rng, 5)
        docs[i] = _words(rng, 3) + (t[:-5] + new if i % 3 else new + t[5:]) + _words(rng, 3)
    got, want = _best_windows(spark, docs, items)
    assert len(want) == 300 and got == want


KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(t):
    out = []
    for k, (kind, p) in enumerate(KINDS):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and _luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_personal_data(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1 9.@+-()_%é\U0001f600\n0") for _ in range(60)) for _ in range(1500)]
    texts += ["a@b.c_d@e.f x@y.z.w.", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4 99999999999999999999.1.1.1", "4111 1111-1111 1111 +1 (415) 555-2671", None, "", "9" * 20000, "a" * 20000 + "@b.c"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(df)).collect()}
    for i, t in enumerate(texts):
        b = _base(t)
        line = ",".join(f"{KINDS[k][0]}:{a}:{e}" for a, k, e in b)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), (i, t[:80], line, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k, _ in KINDS] == [sum(x[1] == n for x in b) for n in range(4)]
    assert pii.personal_data(df.where("doc_id < 0")).count() == 0


def test_spans_of_long_texts(spark):
    """Pieces of a long text: the same spans as of the whole; repeated and null ids."""
    rng = random.Random(14)
    parts = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (415) 555-2671", "word", "éa", "x9", "1", "-", "+", " ", "\n", "\t", "2.5", "__", "und"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(n)) for n in (900, 3000, 3000, 20000)] + ["x" * 5000 + " y" * 3000 + " a@b.c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[2]), (None, texts[1]), (None, texts[1]), (None, None)]
    got = {}
    for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect():
        got.setdefault(r["doc_id"], []).append(r["base_sha256"])
    want = {}
    for i, t in rows:
        line = ",".join(f"{KINDS[k][0]}:{a}:{e}" for a, k, e in _base(t))
        want.setdefault(i, []).append(hashlib.sha256(line.encode()).hexdigest())
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_identifiers_by_form(spark):
    """Keys seed the pattern of two words that finds a secret of another form;
    numbers of a form that mostly passes a base kind's checks."""
    rng = random.Random(21)

    def tail():
        return " ".join(f"{c}{''.join(rng.choice('klmnopqr') for _ in range(12))}" for c in "xyz")

    keys = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(8)]
    cards = ["4111111111111111", "5500005555555559", "4012888888881881", "5105105105105100", "4222222222222220"]
    rows = [(i, f'{tail()} token = "{k}" {tail()}') for i, k in enumerate(keys)]
    rows += [(20, f'{tail()} token = "hunter-2" {tail()}'), (21, f"{tail()} version 3.0 {tail()}"), (22, f"{tail()} = 17 {tail()}")]
    rows += [(30 + i, f"{tail()} {c} {tail()}") for i, c in enumerate(cards)] + [(40, f"{tail()} 4111111111111112 {tail()}")]
    got = {r["doc_id"]: r for r in pii.digest(pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[i]["n_id"] == 1 and f"id:{rows[i][1].index(k)}:{rows[i][1].index(k) + 40}" == got[i]["spans"] for i, k in enumerate(keys))
    assert got[20]["n_id"] == 1 and got[40]["n_id"] == 1 and got[21]["n_spans"] == 0
    assert all(got[30 + i]["n_card"] == 1 and got[30 + i]["n_id"] == 0 for i in range(5))


def test_discovered_identifiers(spark):
    rng = random.Random(6)
    rows = [(i, f"text {_words(rng, 1)[0][0]} contact: user{i}@mail.example.org thanks") for i in range(30)]
    rows += [(50 + i, f"some contact: AB-77{i}X thanks a lot") for i in range(3)] + [(90, "version 2x is out")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.personal_data(df)).collect()}
    assert all(got[50 + i] == "id:14:21" for i in range(3)) and got[90] == "" and got[3].startswith("email:")
    m = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert m[50] == "some contact: <id> thanks a lot" and m[90] == rows[-1][1] and "<email>" in m[0] and "@" not in m[0]


def test_identifiers_two_patterns_away(spark):
    rng = random.Random(12)

    def tail():
        return " ".join(f"{c}{''.join(rng.choice('klmnopqr') for _ in range(12))}" for c in "xyz")

    rows = [(i, f"{tail()} contact: user{i}@mail.example.org {tail()}") for i in range(30)]
    rows += [(50 + i, f"{tail()} contact: AB-{i}00 {tail()}") for i in range(8)]
    rows += [(60 + i, f"{tail()} member: AB-{i}00 {tail()}") for i in range(8)]
    rows += [(80, f"{tail()} member: ZX-98765 {tail()}"), (81, f"{tail()} number: ZX-98764 {tail()}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    m = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert all("contact: <id>" in m[50 + i] and "member: <id>" in m[60 + i] for i in range(8))
    assert "member: <id>" in m[80] and m[81] == rows[-1][1]


def test_url_cascade(spark, monkeypatch):
    rng = random.Random(8)
    keys = [f"host{i}.example" for i in range(3000)]
    listed = set(rng.sample(keys, 300))
    universe, those = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame([(k,) for k in listed], "key string")
    # One shard; many shards in one broadcast row; a pass for each two shards.
    for words, group in ((1 << 18, 32), (8, 32), (8, 2)):
        monkeypatch.setattr(url_filter, "SHARD_WORDS", words)
        monkeypatch.setattr(url_filter, "GROUP", group)
        c = url_filter.build(universe, those)
        assert (c.shards > 1) == (words == 8) and c.depth >= 2
        judged = c.listed(universe, "key", "hit")
        assert {r["key"] for r in judged.where("hit").collect()} == listed
        assert "Join" not in judged._jdf.queryExecution().executedPlan().toString()
    none = url_filter.build(universe, those.where("key = ''"))
    assert none.listed(universe, "key", "hit").where("hit").count() == 0


def test_url_rules(spark):
    urls = {1: "HTTP://A.Example.ORG/es/x?y#z", 2: "https://example.org/en/12", 3: "x://example.org/en/2", 4: "http://notexample.org/es/", 5: "http://b.com/fr/", 6: "http://b.com/de/?q", 7: "http://b.com", 8: None, 9: "no scheme", 10: "http://spam.net/a://b", 11: "://org", 12: "http://q.org?x/"}
    df = spark.createDataFrame([(k, u) for k, u in urls.items()], "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, spark.createDataFrame([("spam.net",)], "key string")).collect()}
    assert got == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"), 4: ("notexample.org", "/es/", "org/", "allow"),
        5: ("b.com", "/fr/", "com/fr/", "allow"), 6: ("b.com", "/de/", "com/de/", "block"), 7: ("b.com", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("", "", None, "allow"), 10: ("spam.net", "/a://b", None, "block"), 11: ("org", "", None, "allow"), 12: ("q.org", "", None, "allow"),
    }


def test_url_edges(spark):
    """Clashing columns, repeated urls, an empty table."""
    schema = "page_id long, url string, host string, rule int, _listed boolean, _levels string, shard int, key string"
    df = spark.createDataFrame([(k, u, "other", 1, True, "x", 5, "y") for k, u in ((1, "http://spam.net/a"), (2, "http://spam.net/a"), (2, "http://ham.net/"))], schema)
    bad = spark.createDataFrame([("spam.net",), ("spam.net",), (None,), ("elsewhere.net",)], "key string")
    got = url_filter.judge(df, bad)
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], r["_listed"], r["_levels"], r["shard"], r["key"]) for r in got.collect()) == [
        (1, "spam.net", "/a", None, "block", True, "x", 5, "y"), (2, "ham.net", "/", None, "allow", True, "x", 5, "y"), (2, "spam.net", "/a", None, "block", True, "x", 5, "y")]
    assert url_filter.judge(df.where("page_id < 0"), bad).count() == 0


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, repeated and null ids, null texts, clashing columns: every
    stage keeps the columns, and clean rows as they are."""
    import corpus_pipeline

    rng = random.Random(8)
    item = " ".join(_words(rng, 30))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = " ".join(_words(rng, 60))
    rows = [(1, clean, "en", "x", 5), (1, clean, "en", "x", 5), (1, " ".join(_words(rng, 50)), "en", "x", 5), (None, " ".join(_words(rng, 40)), None, "x", None), (None, None, None, None, None), (2, "", "en", "x", 0), (3, item, "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row string, row_key_a__ long")
    kept = {"language_id": rows[:4] + rows[6:], "near_dedup": rows, "decontamination": rows[:6], "personal_data": rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and sorted(map(tuple, got.collect()), key=str) == sorted(kept[name], key=str), name
        assert stage(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0
    assert corpus_pipeline.bpe(spark, docs, str(tmp_path)).count() == len(rows) and corpus_pipeline.bpe(spark, docs.where("doc_id < 0"), str(tmp_path)).count() == 0


def test_passages_of_odd_rows(spark):
    """Rows without an id aren't looked at; rows of one id are one document."""
    rng = random.Random(17)
    p = _words(rng, 60)
    rows = [(None, " ".join(p)), (1, " ".join(p)), (1, " ".join([*_words(rng, 5), *p])), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert suffix_dedup.repeated_passages(df).count() == 0
    both = df.union(spark.createDataFrame([(9, " ".join(["w", *p]))], df.schema))
    assert {(r["doc_id"], r["n_words"]) for r in suffix_dedup.repeated_passages(both).collect()} >= {(9, 60)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    item = " ".join(_words(rng, 40))
    prose = [" ".join(_words(rng, 60)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(20, prose[0], "en", "s", 1), (21, prose[1] + " " + item, "en", "s", 1), (22, "12345 %%%", None, "s", 1), (23, None, "en", "s", 1), (24, prose[2][:120] + " mail me@x.example.org " + " ".join(_words(rng, 60)), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(12)) | {24} and all(got.values())
    masked = corpus_pipeline.personal_data(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    r = masked.where("doc_id = 24").first()
    assert "<email>" in r["text"] and r["n_chars"] == len(r["text"]) and masked.columns == ["doc_id", "text", "lang", "source", "n_chars"]
