import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from llm import bpe, language, licenses, packing, quality
from llm.queries import VOCABULARY

ODD = [
    None, "", " ", "a  b", "a \n b", " 's't'stop 're''ve'll", "'s", "''s'd", "x's!'t", " 　 a", "a\u0085b", "ß1²½Ⅷ漢字", "\x1c\x1d a", "\t\t x", "a" * 6000 + " " * 5000 + "!" * 700,
    "\t" * 9000 + "a", " \t\u3000\n" * 3000, "\n\n\na", "a   ", "𝒳😀 😀😀'm", "<|endoftext|> text", "word " * 20000,
]
SCHEMA = "doc_id long, text string, id string, score string, ids string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", None) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.Encoder(VOCABULARY).ranks
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_library(spark, reference):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab 'stmdrevl\n\t1é!") for _ in range(300)) for _ in range(50)]
    rows = {r.doc_id: r for r in bpe.round_trip(frame(spark, texts), VOCABULARY).collect()}
    full = {r.doc_id: r for r in bpe.encode(frame(spark, texts), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = reference.encode_ordinary(t or "")
        assert rows[i].n_tokens == len(ids) and rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert full[i].ids == ids and len(full[i].offsets) == len(ids)
    assert bpe.round_trip(frame(spark, []), VOCABULARY).collect() == []


def test_long_pieces_merge_alike(reference):
    own = bpe.Encoder(VOCABULARY)
    rng = random.Random(2)
    for _ in range(20):
        piece = "".join(rng.choice("abcde") for _ in range(400))
        assert next(own.encode_batch([piece]))[0] == reference.encode_ordinary(piece)


def test_packing(spark):
    texts = ODD + ["some words of text " * n for n in range(1, 200)]
    rows = packing.packed_sequences(frame(spark, texts).repartition(2), VOCABULARY).collect()
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    got, filled = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
        filled.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) and r.length == len(r.ids)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(got[i], key=lambda r: r.start)
        assert sum((p.ids for p in pieces), []) == ids and all(p.doc_tokens == len(ids) for p in pieces)
    padding = 0
    for parts in filled.values():
        at = 0
        for p in sorted(parts, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        padding += 1024 - at if at & (at - 1) else 0
    assert padding < 0.05 * sum(r.length for r in rows)
    assert packing.pack_documents(frame(spark, []), VOCABULARY).collect() == []


def test_differencing_is_near_equal():
    rng = random.Random(4)
    sizes = [rng.randint(1, 512) for _ in range(500)]
    for ways in (1, 3, 100):
        parts = packing.differencing(sizes, ways)
        assert sorted(i for p in parts for i in p) == list(range(500))
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 60
    assert all(sum(sizes[i] for i in p) <= 1024 for p in packing.pack(sizes))
    assert packing.pack([]) == []


def test_language(spark):
    rng = random.Random(5)
    words = {"xx": ["alba", "terno", "mira", "solto"], "yy": ["krag", "wurst", "schlaf", "dicht"]}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(5, 60)))
    learn = [(i, make(lang), lang) for i, lang in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx"), (901, "alba", None), (902, "", "yy")]
    model = language.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "yy"]
    test = [make(("xx", "yy")[i % 2]) for i in range(40)] + [None, "", "123 !?", "ALBA terno " * 20000]
    rows = {r.doc_id: r for r in language.identify(frame(spark, test), model).collect()}
    assert all(rows[i].lang_pred == ("xx", "yy")[i % 2] and 0.5 < rows[i].score <= 1 for i in range(40))
    assert [rows[i].lang_pred for i in (40, 41, 42, 43)] == ["und", "und", "und", "xx"] and rows[40].score == 0
    assert language.keep_identified(frame(spark, test), model).count() == 41
    none = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(frame(spark, test), none).collect()} == {"und"}
    assert language.keep_identified(frame(spark, test), none).count() == 41 and language.identify(frame(spark, []), model).collect() == []


def test_language_scripts_and_many_labels(spark):
    """Scripts of thousands of letters, more than 64 labels, and a text of none of them."""
    rng = random.Random(15)
    letters = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) for j in range(40)] for k in range(70)}
    make = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(60))
    learn = [(i, make(lang), lang) for i, lang in enumerate(sorted(letters) * 20)]
    model = language.train(spark.createDataFrame(learn, "doc_id long, text string, lang string"))
    assert model.languages == sorted(letters)
    test = [make(lang) for lang in sorted(letters)]
    names, scores = model.predict(test)
    assert names == sorted(letters) and all(0 < s <= 1 for s in scores)
    assert model.claimed(test + ["\u0434\u043e\u043c \u0438 \u0441\u0430\u0434", "123", None, ""]).tolist() == [True] * 70 + [False] * 4


def brute_language(learn, test):
    """Presence kernels of code points, one to three in a row, in plain sets; ridge regression on the same landmarks."""
    import itertools

    def grams(text):
        s = ["*" if not c.isalpha() else c for c in text.lower()]
        return {tuple(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}

    names = sorted({lang for _, lang in learn})
    marks = [grams(t) for t, _ in itertools.chain.from_iterable(itertools.islice(((t, lang) for t, lang in learn if lang == n), 24) for n in names)]
    kernel = lambda a, b: len(a & b) / max(1, len(a) * len(b)) ** 0.5
    rows = np.array([[kernel(grams(t), m) for m in marks] for t, _ in learn])
    target = np.array([[1.0 if lang == n else -1.0 for n in names] for _, lang in learn])
    inner = np.array([[kernel(a, b) for a in marks] for b in marks])
    weights = np.linalg.lstsq(rows.T @ rows + language.RIDGE * inner, rows.T @ target, rcond=1e-9)[0]
    return [names[k] for k in (np.array([[kernel(grams(t), m) for m in marks] for t in test]) @ weights).argmax(axis=1)]


def test_language_against_brute_force(spark):
    rng = random.Random(16)
    words = {"aa": ["solana", "mira", "tolo"], "bb": ["solane", "mire", "tolu"], "cc": ["krast", "volm", "strupf"]}
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 20)))
    learn = [(make(lang), lang) for lang in sorted(words) for _ in range(24)]
    model = language.fit(*map(list, zip(*learn)))
    test = [make(lang) for lang in sorted(words) for _ in range(30)] + ["solan", "krast mire", "xyz xyz"]
    assert model.predict(test)[0] == brute_language(learn, test)


def test_sampling_takes_every_label(spark):
    from llm import sampling

    rows = spark.createDataFrame([(i, f"label {i % 100}", f"text {i}") for i in range(400)] + [(None, "label 0", "hot")] * 3000, "id long, label string, text string")
    sample, counts, quota = sampling.labelled(rows, "label", ("id", "text"), 300)
    found = [r.label for r in sample.collect()]
    assert len(counts) == 100 and counts["label 0"] == 3004 and set(found) >= {f"label {k}" for k in range(1, 100)} and quota == 240
    assert len(found) <= 400 and sampling.share_of(300, 10**6) == sampling.LEAST


def test_quality_odd_tables(spark):
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(40)) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(40))
    rows = [(i, good() if i % 2 else bad(), "clash", "clash", i, 0.5) for i in range(200)] * 2
    rows += [(3, bad(), "clash", "clash", 0, 0.5), (None, good(), None, None, None, None), (500, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, _id string, quality int, score double")
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(200)] * 2 + [(None, 1, "x"), (4, 1, "x"), (6, 7, "x")], "doc_id long, quality int, text string")
    model = quality.train(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows) and sum(r.predicted == r.doc_id % 2 for r in found if r.doc_id is not None and r.doc_id < 200) >= 380
    assert quality.keep_good(docs, model).columns == docs.columns
    empty = quality.train(docs, labels.limit(0))
    assert not empty.learned and quality.keep_good(docs, empty).count() == len(rows)
    assert quality.score(docs.limit(0), model).collect() == [] and quality.train(docs.limit(0), labels).learned is False


def test_quality_against_brute_force():
    """The measures and the logistic score, by hand."""
    import zstandard

    rng = random.Random(18)
    texts = ["".join(rng.choice("abc \u00e9") for _ in range(rng.randint(0, 3000))) for _ in range(80)]
    model = quality.fit(texts, [i % 2 for i in range(80)])
    for text in [*texts[:10], "", None]:
        data = (text or "").encode()
        sizes = []
        for held in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(held), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[a : a + quality.PIECE])) for a in range(0, max(1, len(data)), quality.PIECE)))
        d, r = (sizes[1] - sizes[0]) / sum(sizes), sum(sizes) / 2 / (len(data) + 20)
        z = (np.array([d, r, d * r, r * r]) - model.centre) / model.scale
        assert abs(model.score([text])[0] - 1 / (1 + np.exp(-(z @ model.weights[:4] + model.weights[4])))) < 1e-9


def test_quality(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("etaoinsh") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(80)) + "."
    bad = lambda: " ".join(word().upper() + rng.choice(("!!", "$$$", "***")) for _ in range(80))
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(1000, 1), (5000, 0), (7, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    test = [good() if i % 2 else bad() for i in range(100)] + [None, "", " ".join(good() for _ in range(300))]
    found = {r.doc_id: r for r in quality.score(frame(spark, test), model).collect()}
    assert sum(found[i].predicted == i % 2 for i in range(100)) >= 95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values()) and found[102].predicted == 1
    for some in ([], [(1, 1)], [(0, 0)]):
        alone = quality.train(docs, spark.createDataFrame(some, "doc_id long, quality int"))
        assert quality.score(frame(spark, test), alone).count() == len(test)


def test_licenses_against_brute_force(spark):
    template = "Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"
    nearly = " ".join(template.split()[:-2])
    texts = [
        None, "", "Released under the MIT License.", "x under\nthe, mit-license under the mit license", "Licensed under CC BY-NC 4.0. cc by nc", "Apache License, Version 2", "the the license software", "cc by nc " * 20000,
        f"before\n{nearly}\nafter", f"{' '.join(template.split()[:8])}", template * 300, "É" + "under the mit license", "under the mit licenseé",
    ]
    rows = {r.doc_id: r for r in licenses.digest(licenses.scan(frame(spark, texts))).collect()}
    import re

    for i, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
        at = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        blocks = {label for line in low.split("\n") for label, ts in licenses.TEMPLATES.items() for x in ts if _held(x, line) >= licenses.CONTAINMENT - 1e-9}
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(words), len(at))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and r.labels == ",".join(sorted({label for _, label in at} | blocks))
    assert rows[8].labels == "isc" and rows[9].labels == ""
    assert licenses.scan(frame(spark, [])).collect() == []


def _held(template, line):
    tokens, own = set(licenses.words(template.encode())), set(licenses.words(line.encode()))
    return len(tokens & own) / len(tokens)
