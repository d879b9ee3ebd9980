import random

from asofkit.llm import near_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def grouped(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_groups_equal_brute_force(corpus, documents):
    want = grouped([(d, t) for d, t, _ in corpus])
    found = near_dedup.near_duplicates(documents).collect()
    assert len(found) == documents.count()
    for r in found:
        assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id), r.doc_id


def test_stragglers_of_a_large_group_find_their_links(spark, monkeypatch):
    """Versions of one text with few to many changes: chains of links, and texts that only link to some of them."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "CLUSTER_ROWS", 16)
    rng = random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(0, 22)):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(words)))
    want = grouped(rows)
    assert len({c for _, c in want.values()}) > 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == want


def test_a_template_whose_texts_are_half_alike_writes_no_pairs(spark, monkeypatch):
    """A source at 0.5 to 0.8 similarity, where hardly anything links: what is written stays as long as the group."""
    monkeypatch.setattr(near_dedup, "BLOCK", 64)
    monkeypatch.setattr(near_dedup, "CLUSTER_ROWS", 64)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(300):
        words = list(base)
        for at in range(i % 7, 120, rng.choice((14, 17, 20, 60))):
            words[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    written = {}
    kept = near_dedup.materialised

    def counted(df, name):
        out = kept(df, name)
        written[name] = max(written.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "materialised", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    want = grouped(rows)
    assert found == want and len({c for _, c in want.values()}) > 100
    assert all(n <= 300 * near_dedup.COORDINATES for n in written.values())
    assert written["bridges"] <= 33 * 300 and written["edges"] <= 33 * 300 and written["open-clusters"] <= 300


def test_empty_table_and_missing_ids(spark, nothing):
    assert near_dedup.near_duplicates(nothing).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "A b\tC"), (3, None), (4, "")], "doc_id long, text string")
    found = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {(None, None, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)}
