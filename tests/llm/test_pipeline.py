import random
import zlib

import pytest

import corpus_pipeline
from llm import queries
from llm.bpe import Encoder
from llm.common import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage leaves, by name; the first is the input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        found[name] = docs
    return found


def test_columns_and_order(stages):
    names = list(stages)
    assert names == ["input", "language_id", "quality_classifier", "simhash_dedup", "substring_dedup", "packing"]
    for name in names[:-1]:
        assert stages[name].dtypes == stages["input"].dtypes


def test_each_stage_against_its_operator(spark, stages):
    docs = {n: {r.doc_id: r.text for r in d.select("doc_id", "text").collect()} for n, d in stages.items() if n != "packing"}
    model = queries.language_model(spark, SF)
    ids, texts = zip(*docs["input"].items())
    assert set(docs["language_id"]) == {i for i, claimed in zip(ids, model.claimed(list(texts))) if claimed}
    scored = {r.doc_id: r.predicted for r in queries.op5_quality(spark, SF).collect()}
    if set(docs["language_id"]) == set(docs["input"]):
        assert set(docs["quality_classifier"]) == {i for i, p in scored.items() if p}
    classes = {r.doc_id: r.component_id for r in queries.simhash.near_duplicates(stages["quality_classifier"]).collect()}
    assert set(docs["simhash_dedup"]) == set(classes.values())
    removed = {}
    for r in queries.substring.repeats(stages["simhash_dedup"]).where("removed").collect():
        removed.setdefault(r.doc_id, []).append((r.start, r.end))
    want = {i: queries.substring.without(t, removed[i]) if i in removed else t for i, t in docs["simhash_dedup"].items()}
    assert docs["substring_dedup"] == {i: t for i, t in want.items() if i not in removed or t.split()}
    own = Encoder(queries.VOCABULARY)
    ids = {i: next(own.encode_batch([t]))[0] + [0] for i, t in docs["substring_dedup"].items()}
    pieces = {}
    for r in stages["packing"].collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, own_ids in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own_ids)


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").distinct().count() == stages["packing"].count()


def write(spark, folder, documents, labels):
    kinds = "doc_id long, text string, lang string, source string, n_chars int, label string, row string"
    spark.createDataFrame(documents, kinds).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_odd_rows(spark, tmp_path):
    """Nulls anywhere, empty and long texts, repeated rows and ids, columns of clashing names; checked by hand."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    row = lambda i, t, lang="xx": (i, t, lang, None, None, "clash", "clash")
    passage, copy = prose(60), prose(80)
    rows = [row(i, prose(rng.randint(30, 60))) for i in range(120)]
    rows += [row(200, copy), row(201, copy), row(201, copy), row(None, copy), row(202, f"{prose(40)} {passage}"), row(203, f"{passage} {prose(50)}"), row(203, prose(45)), row(None, prose(33)), row(300, " ".join([prose(50)] + [word() for _ in range(20000)]))]
    rows += [row(400, None), row(401, ""), row(402, "  \n"), row(403, "123 456"), row(None, None, None)]
    write(spark, tmp_path, rows, [])  # without labels nothing can be told apart, and all stays
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, str(tmp_path)), name)
        kept[name] = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] if "text" in docs.columns else docs.collect()
    assert {i for i, _ in kept["language_id"]} >= {*range(120), 200, 201, 202, 203, 300} and not {i for i, _ in kept["language_id"]} & {400, 401, 402, 403}
    assert sorted(kept["quality_classifier"], key=str) == sorted(kept["language_id"], key=str)
    left = kept["simhash_dedup"]
    assert sum(t == copy for _, t in left) == 1 and (200, copy) in left and len([i for i, _ in left if i == 203]) == 2 and len(left) == 120 + 1 + 3 + 1 + 1
    texts = [t for _, t in kept["substring_dedup"]]
    assert sum(passage in t for t in texts) == 1 and len(texts) == len(left)
    assert {r.doc_id for r in kept["packing"]} == {i for i, _ in kept["substring_dedup"]}


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
