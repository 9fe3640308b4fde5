import numpy as np
import pytest
import xxhash

from llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, row string"


def brute(texts):
    fps = []
    for t in texts:
        words = [w for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return fps


def classes(ids, fps, differ=2):
    comp = list(range(len(ids)))
    for _ in ids:
        before = list(comp)
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= differ:
                    comp[i] = comp[j] = min(comp[i], comp[j])
        if comp == before:
            break
    low = {}
    for i, c in zip(ids, comp):
        low[c] = i if low.get(c) is None else low[c] if i is None else min(low[c], i)
    return [low[c] for c in comp]


def test_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and then runs far away from all of the other dogs in town"
    rows = [(5, base), (3, base.upper()), (9, base + " again"), (7, None), (8, ""), (2, " \t\n"), (11, "one two"), (12, "One  TWO"), (3, base.upper())]
    rows += [(None, "a nameless text of some words"), (None, "a nameless text of some words"), (20, "x " * 5000), (21, "café ÀÉ über straße 漢字 words here")]
    df = spark.createDataFrame([(i, t, None, "clash", "clash") for i, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    fps = brute([t for _, t in rows])
    want = sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], fps))), key=str)
    assert got == want
    kept = simhash.keep_first(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == sorted({c for _, _, c in want}, key=str)
    assert kept[0].asDict().keys() == {"doc_id", "text", "lang", "fp", "row"}


def test_one_row_of_each_class_whatever_the_ids(spark):
    x, y, z = ("one text of a few words here", "quite another text that is unlike it", "a third one with nothing of the others")
    rows = [(5, x), (5, y), (None, z), (None, z), (9, x), (5, x), (None, "a fourth that is alone and has no name"), (4, ""), (None, None)]
    kept = simhash.keep_first(spark.createDataFrame([(i, t, "l", "clash", None) for i, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, x), (5, y), (None, z), rows[6], (4, "")], key=str)
    fps = [f"{f:016x}" for f in brute([t for _, t in rows])]
    assert len(kept) == len(set(fps))  # none of these are near


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).collect() == []
    assert simhash.keep_first(df).collect() == []


@pytest.mark.parametrize("dense", [1, 1000])
@pytest.mark.parametrize("total", [300, 10**9])
def test_links_lose_nothing(spark, monkeypatch, dense, total):
    monkeypatch.setattr(simhash, "DENSE", dense)
    whole = simhash.plan
    monkeypatch.setattr(simhash, "plan", lambda s, n, d: whole(s, total, d))
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**63, 60, dtype=np.uint64)}
    for x in list(fps)[:20]:  # chains and stars
        for _ in range(8):
            x ^= 1 << int(rng.integers(64)) ^ (1 << int(rng.integers(64)))
            fps.add(x & (2**64 - 1))
    fps = sorted(fps)
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    edges, chosen = simhash.link(spark.createDataFrame(signed, "fp long"))
    assert sum(chosen.radii) == 2 - len(chosen.groups) + 1
    up = {f: f for f, in signed}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges.collect():
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
        up[find(a)] = find(b)
    want = classes(list(range(len(fps))), fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (find(signed[i][0]) == find(signed[j][0])) == (want[i] == want[j])
