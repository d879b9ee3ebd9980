"""Each stage on its own input, and the whole on a folder of tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from asofkit.llm import near_dedup
from asofkit.llm.catalog import ORACLES, QUERIES
from tests.llm.conftest import DOCUMENTS, prose


def test_all_dealt_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def tables(spark, tmp_path, rows, items):
    docs = spark.createDataFrame([(d, t, lang, "s", len(t) if t is not None else None) for d, t, lang in rows], DOCUMENTS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs, str(tmp_path)


def test_stages_take_effect(spark, corpus, tmp_path):
    rng = random.Random(9)
    leaked = prose(rng, "en", 60)
    rows = [(d, t, lang) for d, t, lang in corpus if d < 404 or d == 407]
    rows += [(500, leaked + " tail", "en"), (501, prose(rng, "en", 80) + ' token = "abcdefabcdef1234"', "en"), (502, "Ж щ Ю я ф", None)]
    docs, folder = tables(spark, tmp_path, rows + rows[:1], [(1, leaked)])
    out, before = docs, None
    ids = {}
    for name, stage in corpus_pipeline.STAGES:
        before, out = out, corpus_pipeline.materialised(stage(spark, out, folder), name)
        if name != "packing":
            assert out.columns == docs.columns
            ids[name] = sorted(r.doc_id for r in out.select("doc_id").collect())
    start = sorted([*(d for d, _, _ in rows), rows[0][0]])
    gone = set(start) - set(ids["language"])
    assert gone == {400, 401, 402, 403, 502}
    assert set(ids["language"]) - set(ids["near_dedup"]) == {*range(200, 205), *range(300, 310)}
    assert len(ids["near_dedup"]) == len(set(ids["near_dedup"]))
    assert set(ids["near_dedup"]) - set(ids["decontamination"]) == {500}
    assert ids["secrets"] == ids["decontamination"]
    secret = before.filter("doc_id = 501").first()
    assert secret.text.endswith(" [SECRET]\"") and secret.n_chars == len(secret.text)
    assert {r.doc_id for r in out.collect()} == set(ids["secrets"])
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(whole.agg(F.sum("length"), F.count("*")).first()) == sorted(out.agg(F.sum("length"), F.count("*")).first())


def test_near_duplicates_share_five_words(spark, tmp_path):
    """Three spread changes in 100 words: 93 of 105 two-word shingles in common, but 81 of 111 of five words."""
    words = [f"w{i}" for i in range(100)]
    spread = [f"v{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)]
    once = [f"u{i}" if i == 50 else w for i, w in enumerate(words)]
    docs, folder = tables(spark, tmp_path, [(i, " ".join(w), "en") for i, w in enumerate((words, spread, once))], [(1, "x")])
    assert {r.doc_id for r in near_dedup.near_duplicates(docs).collect() if not r.kept} == {1, 2}
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, folder).collect()) == [0, 1]


def test_empty_tables_pass(spark, tmp_path):
    _, folder = tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_texts_of_one_id_are_judged_apart_and_names_may_clash(spark, tmp_path):
    rng = random.Random(2)
    leaked, clean, other, key = (prose(rng, "en", 60) for _ in range(4))
    key += ' token = "abcdefabcdef1234"'
    learned = [(i, prose(rng, "en", 120), "en") for i in range(10, 40)]
    rows = [*learned, (1, leaked, "en"), (1, clean, "en"), (2, other, "en"), (2, clean + " more", "en"), (2, "12 34", "en"), (3, key, "en"), (3, key, "en"), (3, "Ж щ", None)]
    _, folder = tables(spark, tmp_path, [(9, "x", "en")], [(1, leaked)])
    extra = ("all_spans", "hit_id", "hit_key", "row_key", "doc", "decided", "block", "component", "class_id", "kept", "words", "a.b")
    schema = DOCUMENTS + ", " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(d, t, lang, "s", len(t), *extra) for d, t, lang in rows], schema)
    kept = {}
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.materialised(stage(spark, out, folder), name)
        assert out.columns == docs.columns
        kept[name] = sorted((r.doc_id, r.text) for r in out.filter("doc_id < 10").collect())
    assert kept["language"] == sorted((d, t) for d, t, _ in rows if d < 10 and t not in ("12 34", "Ж щ"))
    twins = {(1, clean), (2, clean + " more")}
    assert len(kept["near_dedup"]) == 4 and len(twins & set(kept["near_dedup"])) == 1
    assert set(kept["near_dedup"]) - twins == {(1, leaked), (2, other), (3, key)}
    assert set(kept["near_dedup"]) - set(kept["decontamination"]) == {(1, leaked)}
    assert {t for _, t in kept["secrets"]} >= {other} and sum("[SECRET]" in t for _, t in kept["secrets"]) == 1
    assert all(r["a.b"] == "a.b" and r.hit_id == "hit_id" for r in out.select("`a.b`", "hit_id").collect())
