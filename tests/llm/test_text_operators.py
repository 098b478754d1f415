"""Token files, BPE, FLAC, language ID, toxicity: round trips, brute force, edge cases."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from heritas.llm import bpe, flac, language_id, token_output, toxicity

TEXTS = [None, "", " ", "\n", "a", "Hello, world.", "two  spaces and\ttabs \n\n end ", "it's we'll 123 4,5 <|endoftext|>", "é ñ ß 漢字 \U0001f600 \x1c x", "same text", "same text", "word " * 5000, "x" * 30000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b \n<|endoftext|>", "un<|endoftext|>der"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash", 1, b"x") for i, t in enumerate(TEXTS)] + [(3, "repeated id", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int, media binary")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("doc_id < 0")


def test_variable_length_code():
    v = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(v) + 1):
        assert np.array_equal(token_output.unpack(*token_output.pack(v[:n]), n), v[:n])
    with pytest.raises(ValueError):
        token_output.unpack(b"\0", b"12", 1)


def test_token_file(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = token_output.token_output(docs, path).orderBy("start").collect()
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], t.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in rows]
    assert [r["doc_id"] for r in got] == sorted(d for d, _ in want)
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted(want)
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]
    assert token_output.token_output(empty, path).count() == 0


def test_chunks_against_the_library(monkeypatch):
    """Texts of odd white space, marks and added tokens; a table that is emptied
    again and again; pieces of a few chunks."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    parts = ["a", "Zz", "é", "漢", "7", " ", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\0", ".", ",", "!", "'s", "'", "_", "<|endoftext|>", "x" * 70]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    for size, pieces in ((96 << 20, 1 << 19), (1 << 12, 7)):
        monkeypatch.setattr(token_output, "CACHE_BYTES", size)
        monkeypatch.setattr(token_output, "WORDS_AT_ONCE", pieces)
        encoder = token_output.ChunkEncoder(P.path("byte_bpe_50k.json"))
        for at in range(0, len(texts), 250):
            own = texts[at : at + 250]
            ids, n = encoder.encode(own)
            assert np.split(ids, np.cumsum(n)[:-1]) and [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [e.ids for e in t.encode_batch(own, add_special_tokens=False)]
        assert max(map(len, encoder.known.slot)) <= token_output.CACHED_CHUNK


def test_repeated_ids_in_a_token_file(spark):
    """Rows of one id, and of none, keep an order of their own and all ranges."""
    rows = [(7, f"text {i % 5} " * (i % 9)) for i in range(300)] + [(None, "none"), (None, None), (1, "one")]
    got = token_output.token_output(spark.createDataFrame(rows, "doc_id long, text string"), P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1] + [7] * 300
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


def test_bpe(docs, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    codec = bpe.codec(path, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for r in bpe.encode_decode(docs, path, P.PATTERN).collect():
        text = "repeated id" if bytes(r["decoded"]) == b"repeated id" else TEXTS[r["doc_id"]] or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == own.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(r["ids"]).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])
    assert bpe.encode_decode(empty, path, P.PATTERN).count() == 0
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\t1.,!'s\x1cé_") for _ in range(40)) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [own.encode_ordinary(t) for t in texts]
    assert all(codec.hash.find(k) >= 0 for k in list(codec.ranks)[::97]) and codec.hash.find(b"no such entry at all") == -1


def test_flac_streams():
    rng = np.random.default_rng(1)
    some = [flac.payload(t) for t in TEXTS] + [bytes(576), rng.integers(0, 256, 576 * 3, "u1").tobytes(), bytes((i // 3) % 256 for i in range(1152)), bytes(int(128 + 90 * np.sin(i / 9)) for i in range(5760))]
    media = flac.encode(some)
    assert flac.decode(media) == some
    assert len(media[-1]) < len(some[-1])  # predictors pay off
    bad = bytearray(media[5])
    bad[-5] ^= 1
    with pytest.raises(ValueError):
        flac.decode([bytes(bad)])


def _bits(*fields):
    raw = "".join(format(v & ((1 << n) - 1), f"0{n}b") for v, n in fields)
    raw += "0" * (-len(raw) % 8)
    return int(raw, 2).to_bytes(len(raw) // 8, "big")


def test_flac_foreign_frames():
    """A hand-made LPC frame with two Rice partitions, one of them escaped."""
    x = [10, 12, 13, 15, 18, 20, 21, 25, 26, 30, 29, 31, 33, 36, 35, 37]
    res = [x[i] - ((3 * x[i - 1] - 1 * x[i - 2]) >> 1) for i in range(2, 16)]
    head = b"\xff\xf8\x60\x02\x00\x0f"
    head += bytes([flac.CRC8.rows(np.frombuffer(head, np.uint8), np.array([0]), np.array([6]))[0]])
    fields = [(0, 1), (33, 6), (0, 1), (x[0], 8), (x[1], 8), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (1, 4), (1, 4)]
    for r in res[:6]:
        u = r << 1 if r >= 0 else (-r << 1) - 1
        fields += [(1, (u >> 1) + 1), (u & 1, 1)]
    fields += [(15, 4), (7, 5), *[(r, 7) for r in res[6:]]]
    body = head + _bits(*fields)
    crc = int(flac.CRC16.rows(np.frombuffer(body, np.uint8), np.array([0]), np.array([len(body)]))[0])
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + (8000 << 44 | 7 << 36 | 16).to_bytes(8, "big") + bytes(16)
    stream = b"fLaC\x80" + (34).to_bytes(3, "big") + info + body + crc.to_bytes(2, "big")
    assert flac.decode([stream]) == [bytes(v + 128 for v in x)]


def test_media_columns(docs, empty):
    media = flac.encode_media(docs)
    for r in flac.decode_media(media).collect():
        p = flac.payload(TEXTS[r["doc_id"]])
        if r["n_bytes"] == len("repeated id"):
            continue
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
    same = {(r["media_sha256"], r["feature"]) for r in flac.decode_media(media.where("doc_id IN (9, 10)")).collect()}
    assert len(same) == 1
    blocks = flac.pcm_blocks(media.where("doc_id = 11"), 5760).orderBy("first_sample").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.payload(TEXTS[11]) and [b["first_sample"] for b in blocks] == [i * 5760 for i in range(len(blocks))]
    assert flac.decode_media(flac.encode_media(empty)).count() == 0


def test_seeking_and_long_streams(monkeypatch):
    """Ranges of samples by the seek table, which decode their own frames only;
    streams worked on a few frames at a time; linear predictors are in use."""
    rng = np.random.default_rng(4)
    wave = np.clip(np.cumsum(rng.normal(0, 3, 576 * 40)) % 160 + 40, 0, 255).astype("u1").tobytes()
    tone = np.zeros(576 * 12)
    for i in range(4, len(tone)):
        tone[i] = 1.6 * tone[i - 1] - 1.3 * tone[i - 2] + 0.4 * tone[i - 3] - 0.2 * tone[i - 4] + rng.normal(0, 4)
    tone = np.clip(np.rint(tone) + 128, 0, 255).astype("u1").tobytes()
    text = flac.payload("some text of words " * 3000)
    whole = flac.encode([wave, tone, text])
    assert any(whole[1][flac._parse(whole[1])[2] + int(o) + 6] >> 1 >= 32 for o in flac._parse(whole[1])[3][:100])
    monkeypatch.setattr(flac, "AT_ONCE", 576 * 5)
    assert flac.encode([wave, tone, text]) == whole and flac.decode(whole) == [wave, tone, text]
    frames = []
    real = flac._decode_frames
    monkeypatch.setattr(flac, "_decode_frames", lambda flat, start: frames.append(len(start)) or real(flat, start))
    for first, n in ((0, 1), (575, 2), (576, 576), (5000, 3000), (576 * 40 - 1, 10), (576 * 40, 5)):
        frames.clear()
        assert flac.read_pcm(whole[0], first, n) == wave[first : first + n]
        assert sum(frames) <= n // 576 + 2


def _prose(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_id(spark, docs, empty):
    rng = random.Random(3)
    kinds = {"aa": "tion the ing and er".split(), "bb": "chen und sch ein ung".split(), "cc": "ment eau les que oui".split()}
    rows = [(i, _prose(rng, kinds[k], 60), k) for i, k in enumerate(sorted(kinds) * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id < 90"))
    got = {r["doc_id"]: r for r in language_id.predict(df.where("doc_id >= 90"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == k for i, _, k in rows[90:]]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect() if r["doc_id"] < 4}
    assert odd[0] == odd[1] == odd[2] == "und"
    none = language_id.fit(df.where("doc_id < 0"))
    assert {r["lang_pred"] for r in language_id.predict(docs, none).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0
    code = language_id.code_words(20)
    assert min((code[i] != code[j]).sum() for i in range(20) for j in range(i)) >= 8  # corrects errors


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        words = _prose(rng, "tion the ing and er re st ou".split(), 40).split()
        bad = i % 4 == 0
        if bad:
            for t in rng.sample(["blarghet", "snorkel", "vexomat"], 2):
                words.insert(rng.randrange(len(words)), t)
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.where("doc_id < 300"))
    assert set(model.lexicon.terms) >= {"blarghet", "snorkel", "vexomat"}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.where("doc_id >= 300"), model).collect()}
    assert all((got[i] >= 0.3) == bool(t) for i, _, t in rows[300:])
    cases = spark.createDataFrame([(0, "you blarghet and snorkal here"), (1, 'they said "blarghet" once'), (2, "plain words"), (3, ""), (4, None)], "doc_id long, text string")
    s = {r["doc_id"]: r["score"] for r in toxicity.score(cases, model).collect()}
    assert s[0] > s[1] >= s[2] and s[0] >= 0.3 and s[2] == s[3] == s[4] < 0.3
    assert toxicity.score(docs, model).count() == len(TEXTS) + 1 and toxicity.score(empty, model).count() == 0
    untaught = toxicity.fit(df.where("doc_id < 0"))
    assert len({r["score"] for r in toxicity.score(df, untaught).collect()}) == 1


def test_levenshtein_automaton():
    lex = toxicity.FuzzyLexicon({"scoundrel": 2.0, "cad": 1.0, "scour": 1.0})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(2)
    for _ in range(3000):
        w = list(rng.choice(["scoundrel", "cad", "scour"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "s", "x"])
        w = "".join(w)
        want = [t for t in lex.terms if distance(w, t) <= (1 if len(t) >= 5 else 0)]
        found = lex.find(w)
        assert (found is not None) == bool(want) and (found is None or (found[0] in want and found[1] == distance(w, found[0])))
