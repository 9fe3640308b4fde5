import math
import os
import random
from collections import Counter, defaultdict

import pytest

from llm import lm

SCHEMA = "doc_id long, text string, id string, score string, chunk string"


def brute(train, texts, order):
    tok = lambda t: (t or "").encode().lower().split() + [None]
    starts = ["<s>"] * (order - 1)
    grams = lambda ws: [tuple((starts + ws)[k : k + order]) for k in range(len(ws))]
    uni, counts = Counter(), [Counter() for _ in range(order)]
    for t in train:
        ws = tok(t)
        uni.update(ws)
        counts[-1].update(grams(ws))
    for k in range(order - 1, 0, -1):  # lower orders count the distinct words before
        for g in counts[k]:
            counts[k - 1][g[1:]] += 1
    contexts = [defaultdict(lambda: [0, 0, 0, 0]) for _ in range(order)]
    for k in range(1, order):
        for g, c in counts[k].items():
            contexts[k][g[:-1]][0] += c
            contexts[k][g[:-1]][min(c, 3)] += 1
    n, v, types = sum(uni.values()), len(uni), len(counts[1])
    d = [lm._discounts([Counter(x.values())[k] for k in (1, 2, 3, 4)]) for x in counts]
    mass = sum(d[0][min(c, 3)] for c in counts[0].values()) / max(1, types) if types else 1.0
    for t in texts:
        ws, base, score = tok(t), 0.0, 0.0
        for g in grams(ws):
            base += math.log10((uni[g[-1]] + 1) / (n + v + 1))
            c = counts[0][g[-1:]]
            p = mass / (v + 1) + max(c - d[0][min(c, 3)], 0) / max(1, types)
            for k in range(1, order):
                x, c = contexts[k].get(g[order - 1 - k : -1]), counts[k][g[order - 1 - k :]]
                if x:
                    p = max(c - d[k][min(c, 3)], 0) / x[0] + sum(d[k][j] * x[j] for j in (1, 2, 3)) / x[0] * p
            score += math.log10(p)
        yield len(ws), sum(uni[w] > 0 for w in ws), n, base, score


def check(spark, train, texts, order=3):
    frame = lambda rows: spark.createDataFrame([(i, t, "clash", None, None) for i, t in enumerate(rows)], SCHEMA)
    model = lm.train(frame(train).repartition(3), order=order)
    rows = {r.doc_id: r for r in lm.score(frame(texts).repartition(2), model).collect()}
    assert len(rows) == len(texts)
    for i, (n, known, total, base, score) in enumerate(brute(train, texts, order)):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-9)
    return model


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("common", [20, 10**6])
def test_against_brute_force(spark, monkeypatch, order, common):
    rng = random.Random(7)
    make = lambda n: " ".join(rng.choice(["the", "The", "of", *[f"w{int(rng.expovariate(0.05))}" for _ in range(4)]]) for _ in range(n))
    train = [make(rng.randint(0, 120)) for _ in range(80)] + [None, "", " \t", "the " * 5000]
    texts = train[:10] + [make(50) for _ in range(20)] + [None, "", "unknown words here", "THE the\x0bof", "\u00c9 \u00e9 \u00fcnknown"]
    monkeypatch.setattr(lm, "CHUNK", 2000)
    monkeypatch.setattr(lm, "COMMON", common)  # n-grams of common words are dealt over all shards
    model = check(spark, train, texts, order)
    assert (common < 100) == bool(model.common_written.any()) or order == 2


def test_a_shard_looks_up_the_ngrams_of_all_chunks_together(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(100)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    with monkeypatch.context() as m:
        m.setattr(lm, "SHARD_TOKENS", 100)
        model = lm.train(docs)
    monkeypatch.setattr(lm, "SHARE_BITS", 3, raising=False)
    shards, written, log = 1 << model.bits, model.written, f"{tmp_path}/calls"

    class Counted:
        def __getitem__(self, shard):
            with open(log, "a") as out:
                out.write(f"{shard}\n")
            return written[shard]

    model.written = Counted()
    rows = {r.doc_id: r.score for r in lm.score(docs, model).collect()}
    with open(log) as calls:
        found = calls.read().split()
    assert shards == 64 and 32 < len(found) == len(set(found)) <= shards  # each shard once, whatever the number of chunks
    assert all(math.isclose(rows[i], want[-1], rel_tol=1e-9) for i, want in enumerate(brute(texts, texts, 3)))


def test_missing_files_are_errors(spark):
    docs = spark.createDataFrame([(i, f"some words {i} of text") for i in range(50)], "doc_id long, text string")
    model = lm.train(docs)
    assert model.written.any()
    folder = model.folder.split(":", 1)[1]
    for name in os.listdir("/" + folder.lstrip("/")):
        if name.startswith("ngrams-"):
            os.remove(f"/{folder.lstrip('/')}/{name}")
    with pytest.raises(Exception, match="FileNotFound|No such file"):
        lm.score(docs, model).collect()


def test_a_tree_of_merges_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    docs = spark.createDataFrame([(None if i % 3 else i, f"w{i % 5} w{i % 7} w{i % 2}") for i in range(40)], "doc_id long, text string").repartition(9)
    model = lm.train(docs)
    assert model.tokens == 160 and lm.score(docs, model).count() == 40
    with pytest.raises(ValueError):
        lm.train(docs, order=4)


def test_paths_of_stores():
    assert lm._store("file:/tmp/x")[1] == lm._store("file:///tmp/x")[1] == "/tmp/x" and lm._store("dbfs:/a/b")[1] == "/dbfs/a/b"
    with pytest.raises(Exception):
        lm._store("viewfs://cluster/x")


def test_small_and_empty(spark):
    check(spark, [], ["some text", None])
    check(spark, ["one"], ["one", "two one", ""])
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty, lm.train(empty)).collect() == []
