import hashlib
import random
import re

import pytest

from asofkit.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, items):
    own, hit, names = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(own) - n + 1):
            if tuple(own[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(own), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("broadcast_prints", [1 << 20, 0])
def test_hits_equal_brute_force(spark, corpus, documents, broadcast_prints):
    rng = random.Random(5)
    source = [t.split() for _, t, _ in corpus[:20]]
    items = [(10 + i, " ".join(source[i][5:30])) for i in range(8)]
    items += [(9, items[0][1]), (2, " ".join(source[9][:7])), (3, "Word"), (4, ""), (5, None), (6, " ".join(source[10][:13]))]
    rng.shuffle(items)
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    found = decontaminate.contamination(documents, benchmark, broadcast_prints).collect()
    assert len(found) == documents.count()
    texts = {d: t for d, t, _ in corpus}
    for r in found:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == expected(texts[r.doc_id], items), r.doc_id


def test_empty_tables(spark, documents, nothing):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(nothing, benchmark).count() == 0
    clean = decontaminate.contamination(documents, benchmark)
    assert clean.filter("contaminated or n_hit > 0 or n_items > 0").count() == 0 and clean.count() == documents.count()


def test_rows_of_one_id_are_judged_apart(spark):
    text = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text), (1, "other words"), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.n_hit) for r in decontaminate.contamination(docs, bench).collect())
    assert found == [(0, 20), (1, 0), (1, 20)]
