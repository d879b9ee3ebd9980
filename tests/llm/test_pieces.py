"""Encoding and decoding by distinct chunks against the library on whole texts."""

from __future__ import annotations

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from asofkit.llm import pieces

AWKWARD = [
    None, "", " ", "   ", "▁", "a▁b ▁ c", "▁▁x  y   z ", "tab\tand\nlines\n\n  deep", "\x00 nul", "<s> </s> <unk> <0x41>",
    "①②③ ﬁ é é ퟿ \U0001f600\U0001f680", "日本語 テキスト　全角", "ünï cödé", "x" * 5000, "  " * 300 + "end", "same same same",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alphabet = "abc  ▁é①\n\tß漢🙂 "
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    long = " ".join(rng.choice(("alpha", "beta ", " gamma", "δέλτα", "①①")) for _ in range(60_000))
    return [*AWKWARD, *mixed, long]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_ids_and_text_equal_the_library_in_every_place(spark, library, texts, monkeypatch):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, kind int, block string")
    found = {r.doc_id: r for r in pieces.encoded(frame.repartition(3)).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_eos=True)
        assert found[i].ids == ids, text
        assert found[i].decoded == library.decode(ids), text


def test_decoding_ids_gives_back_the_library_text(spark, library, texts):
    encoded = [(i, library.encode(t or "", add_eos=True)) for i, t in enumerate(texts)] + [(9001, None), (9002, [])]
    found = dict(map(tuple, pieces.decoded(spark.createDataFrame(encoded, "doc_id long, ids array<int>").repartition(3)).collect()))
    assert found.pop(9001) == "" and found.pop(9002) == ""
    assert found == {i: library.decode(ids) for i, ids in encoded[:-2]}


def test_blocks_of_one_document_change_nothing(spark, documents, monkeypatch):
    whole = rows_of(pieces.encoded(documents))
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 1)
    monkeypatch.setattr(pieces, "RANGE_ENTRIES", 5)
    assert rows_of(pieces.encoded(documents)) == whole


def test_null_ids_repeats_and_an_empty_table(spark, nothing):
    frame = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")
    assert [len(r.ids) for r in pieces.encoded(frame).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [3, 3, 1]
    assert pieces.encoded(nothing).collect() == []
    assert pieces.decoded(nothing.select("doc_id", F.array().cast("array<int>").alias("ids"))).collect() == []


def test_every_distinct_word_is_segmented_once(spark):
    frame = spark.createDataFrame([(i, "one two one three" + " two" * i) for i in range(40)], "doc_id long, text string").repartition(4)
    blocks = pieces.folded(frame, "text", pieces.text_chunks)
    seen = spark.sparkContext.accumulator(0)

    def count(words):
        seen.add(len(words))
        return [(b"", None)] * len(words)

    found = pieces.chunk_values(blocks, count).collect()
    assert sum(r.kinds for r in found) == 4 * 3  # one, two, three in every block
    assert seen.value == 3
