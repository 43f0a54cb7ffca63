"""The corpus pipeline as a whole, on awkward rows and empty tables."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tideline.llm import decontaminate, jaccard, mixing, repetition
from tideline.llm.queries import MIX, domains, tokenizer_file

DOCS = "doc_id long, text string, _row string, _copies long, keep boolean"


def rows():
    rng = random.Random(12)
    noise = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    items = [(i, noise(15) + "\n" + noise(4)) for i in range(6)] + [(90, None), (91, ""), (92, "a short one")]
    clean = [(i, noise(rng.randint(30, 120))) for i in range(60)]
    near = [(100 + i, clean[i][1] + " end") for i in range(10)]
    leaks = [(200 + i, noise(40) + " " + items[i][1] + " " + noise(40)) for i in range(6)] + [(206, f"{noise(30)} A short one {noise(30)}")]
    rejected = [(300, "same line again\n" * 50), (301, ""), (302, None), (303, "too few words")]
    long = [(400, noise(150_000))]
    docs = [*clean, *near, *leaks, *rejected, *long, clean[3], (None, noise(50)), (401, clean[4][1])]
    kept = [*clean, *long]
    return [(i, t, "r", 1, False) for i, t in docs], items, kept


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, items, _ = rows()
    path = str(tmp_path_factory.mktemp("corpus"))
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i, *_ in docs if i is not None] + [(None, 1, 1), (5, None, None), (9999, 0, 0)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_keeps_clean_documents_and_writes_their_tokens(spark, folder):
    docs, _, kept = rows()
    out = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    assert {r["doc_id"] for r in out if r["doc_id"] is not None} == {i for i, _ in kept}
    assert any(r["doc_id"] is None for r in out)
    encode = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json")).encode
    texts = {i: t for i, t, *_ in docs}
    at = 0
    for r in out:
        assert r["start"] == at and r["n_tokens"] == len(encode(texts[r["doc_id"]], add_special_tokens=False).ids) + 1
        at += r["n_tokens"]
    assert [r["doc_id"] for r in out if r["doc_id"] is not None] == sorted(r["doc_id"] for r in out if r["doc_id"] is not None)


def test_each_stage_keeps_the_columns_and_what_its_operator_keeps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        if name == "quality rules":
            assert ids(out) == ids(repetition.repetition_rules(docs).where("kept"))
        elif name == "near duplicates":
            assert len(ids(out)) == jaccard.jaccard_components(docs, 5, 80).where("n_shingles > 0").select("component_id").distinct().count()
        elif name == "benchmark decontamination":
            hit = decontaminate.contaminated_pairs(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).select("doc_id").distinct()
            assert ids(out) == ids(docs.join(hit, "doc_id", "left_anti"))
        else:
            assert set(ids(out)) == set(ids(docs))
        docs = spark.createDataFrame(out.collect(), out.schema)


def test_empty_tables(spark, folder, tmp_path):
    for i, name in enumerate(("documents", "benchmark", "labels")):
        path = str(tmp_path / name)
        for other in ("documents", "benchmark", "labels"):
            df = spark.read.parquet(f"{folder}/{other}.parquet")
            (df.where("false") if other == name else df).write.parquet(f"{path}/{other}.parquet")
        assert (corpus_pipeline.run(spark, path).count() == 0) == (i == 0)


def test_mixture_learns_from_labelled_rows_that_are_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = domains(spark.read.parquet(f"{folder}/labels.parquet"))
    names, _ = mixing.fit_domains(docs.where("doc_id = 3"), labels)
    assert names == ["low"] and mixing.fit_domains(docs.where("doc_id < 60"), labels)[0] == ["good", "low", "toxic"]
    shares = mixing.mixing_rates(docs, labels, MIX).first()
    assert [shares[f"target_{n}"] for n in MIX] == pytest.approx(list(MIX.values()))
    assert [shares[f"reached_{n}"] for n in MIX] == pytest.approx(list(MIX.values()), rel=0.01)
