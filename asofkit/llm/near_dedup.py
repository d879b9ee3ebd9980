"""MinHash near-duplicate groups by an inverted join of signature coordinates.

Texts with equal shingle sets form a class at once. Class representatives are posted under their
(coordinate, value) pairs. Two signatures that agree in ``MATCHES`` of ``COORDINATES`` places share one of the
first ``COORDINATES - MATCHES + 1`` in any common order; ordering from rare to frequent leaves the frequent
pairs unposted (prefix), and pairs that only one text has cannot match and are not posted either.

Lists are merged without expanding their pairs. Every text is compared by signature with the smallest id of each of
its lists; pairs that agree put both texts into one cluster, and those that hold on full sets are links. Lists whose
texts lie in one cluster are skipped. In the rest, the texts outside the first one's cluster are compared with the others by
signature, in blocks, which give only as many pairs as join clusters. So all links lie inside clusters. A cluster whose
texts are all linked with its smallest id is done; in the others, the texts that are not are compared with all on full
sets, block by block through an inverted list of the block's shingles, and a block gives only links that join
something. The work on a group is its size plus the number of its stragglers times its size; what it writes, its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches, byte_words, materialised

COORDINATES = 64
MATCHES = 32
PERCENT = 80
BLOCK = 512
CLUSTER_ROWS, CLUSTER_BYTES = 4096, 16 << 20  # texts and bytes of shingles that a task holds of a cluster
FILTER_BITS = 1 << 26
CACHED_WORDS = 200_000

_random = np.random.default_rng(20_240_607)
FACTORS = _random.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
OFFSETS = _random.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Shingler:
    """Sorted distinct 64-bit hashes of two-word shingles; a text of one word is one shingle."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, words: list[bytes], size: int = 2) -> np.ndarray:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        n = max(min(len(h), 1), len(h) - size + 1)
        if not n:
            return h
        s = np.full(n, min(len(h), size), np.uint64)
        for k in range(min(size, len(h))):
            s = mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        return np.unique(s)


def signature(shingles: np.ndarray) -> np.ndarray:
    """32 bits of the smallest of the permuted hashes per coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = mixed(shingles[at : at + 4096, None] * FACTORS + OFFSETS)
        np.minimum(least, part.min(axis=0), out=least)
    return (mixed(least) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(documents: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, values) per row; a text without words has only the first two.

    Values that differ share their 32 bits with a chance of 2e-10, so collisions are never counted too few.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sizes, digests, values = [], [], []
            for words in byte_words(batch.column(1)):
                s = shingler(words, size)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                values.append(signature(s) if len(s) else None)
            columns = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(values, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_key", "values"])

    slim = documents.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(sketch, "doc_id long, n_shingles long, set_key binary, values array<int>")


def postings(texts: DataFrame) -> DataFrame:
    """(key, doc): the prefix of each signature, rare pairs first, without pairs that occur once."""
    posted = texts.select("doc", F.posexplode_outer("values").alias("at", "value"))
    low = F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    posted = posted.select("doc", F.shiftleft(F.col("at").cast("long"), 32).bitwiseOR(low).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    ordered = F.array_sort(F.collect_list(F.struct("n", "key")))
    spare = COORDINATES - MATCHES - 1  # this many of the most frequent pairs stay unposted
    return (
        posted.join(shared, "key")
        .groupBy("doc")
        .agg(ordered.alias("own"))
        .filter(F.size("own") > spare)
        .select("doc", F.explode_outer(F.slice("own", 1, F.size("own") - spare)).alias("x"))
        .select(F.col("x.key").alias("key"), "doc")
    )


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size; it only spares shingling texts that are in no list."""
    places = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    words = (
        ids.select(F.floor(places / 64).alias("word"), F.pmod(places, F.lit(64)).cast("int").alias("bit"))
        .select("word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("value"))
        .groupBy("word")
        .agg(F.bit_or("value").alias("value"))
        .toPandas()
    )
    bitmap = np.zeros(FILTER_BITS // 64, np.int64)
    bitmap[words["word"].to_numpy(np.int64)] = words["value"].to_numpy()
    return bitmap.view(np.uint8)


def full_sets(documents: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc, shingles) of the listed documents, one row per id, and of some others that the caller's join drops."""
    wanted = documents.sparkSession.sparkContext.broadcast(id_filter(ids))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bits = Shingler(), wanted.value
        for batch in batches:
            place = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0))
            sets = [shingler(w, size).tobytes() for w in byte_words(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["doc", "shingles"])

    slim = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), "text")
    slim = slim.withColumn("place", F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS)))
    return slim.mapInArrow(shingle, "doc long, shingles binary").dropDuplicates(["doc"])


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as dictionaries, one at a time; sets of shingles stay where they are."""
    for batch in batches:
        columns = list(zip(batch.schema.names, batch.columns, strict=True))
        for at in range(batch.num_rows):
            yield {n: c[at].as_buffer() if n == "shingles" else c[at].as_py() for n, c in columns}


def linked(x: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets have at least ``percent`` per cent of their union with x in common."""
    sizes = np.array([len(o) for o in others])
    owner = np.repeat(np.arange(len(others)), sizes)
    together = np.concatenate(others)
    at = np.minimum(np.searchsorted(x, together), len(x) - 1)
    common = np.bincount(owner[x[at] == together], minlength=len(others))
    return 100 * common >= percent * (len(x) + sizes - common)


def confirmed(stars: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """The (x, y) of ``stars`` that hold on full sets; a star's texts are dealt over blocks, each with its head y."""
    many = stars.groupBy("y").agg(F.ceil(F.count(F.lit(1)) / (8 * BLOCK)).alias("parts"))
    block = F.xxhash64("y", F.pmod(F.xxhash64("x"), F.col("parts"))).alias("block")
    rows = materialised(stars.join(many, "y").select(block, "x", "y"), "star-blocks")
    heads = rows.select("block", F.lit(0).alias("side"), F.col("y").alias("doc"), "y").distinct()
    roles = heads.unionByName(rows.select("block", F.lit(1).alias("side"), F.col("x").alias("doc"), "y"))
    sides = roles.join(full_sets(documents, roles.select("doc").distinct(), size), "doc")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, head = None, None
        for batch in batches:
            links = []
            for row in runs([batch]):
                own = np.frombuffer(row["shingles"], np.uint64)
                if not row["side"]:
                    block, head = row["block"], own.copy()
                elif row["block"] == block and percent * max(len(head), len(own)) <= 100 * min(len(head), len(own)):
                    if linked(own, [head], percent)[0]:
                        links.append((row["doc"], row["y"]))
            yield pairs_of(links)

    return sides.repartition("block").sortWithinPartitions("block", "side").mapInArrow(compare, "x long, y long")


def pairs_of(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    columns = zip(*pairs, strict=True) if pairs else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every linked document: alternating large and small stars until nothing moves."""
    edges = materialised(links.filter("x <> y").select("x", "y").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct()
        least = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.toDF("x", "y"))
        edges = materialised(small.filter("x <> y").distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    hubs = edges.select(F.col("y").alias("doc"), F.col("y").alias("component")).distinct()
    return edges.toDF("doc", "component").unionByName(hubs)


def alike(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """The (x, y) pairs whose signatures agree in ``MATCHES`` places."""
    both = pairs.join(values.toDF("x", "own"), "x").join(values.toDF("y", "other"), "y")
    agree = F.aggregate(F.zip_with("own", "other", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, k: n + k)
    return both.withColumn("agree", agree).filter(F.col("agree") >= MATCHES).select("x", "y")


class Classes:
    """Which of a block's rows belong together: labels that are joined as pairs are found."""

    def __init__(self, labels: np.ndarray) -> None:
        self.labels = labels
        self.renamed: dict[int, int] = {}

    def of(self, label: int) -> int:
        while label in self.renamed:
            label = self.renamed[label]
        return label

    def join(self, label: int, others: np.ndarray) -> None:
        for other in others.tolist():
            self.renamed[other] = label
        self.labels[np.isin(self.labels, others)] = label


def bridges(lists: DataFrame, values: DataFrame) -> DataFrame:
    """(x, y): pairs that agree by signature, as many as join the clusters of a list.

    ``lists`` has (key, doc, cluster, home); ``home`` is the cluster of the list's smallest id. Texts outside it are compared
    with all others in blocks of at most ``BLOCK`` by ``BLOCK``.
    """
    sizes = lists.groupBy("key", "home").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") != F.col("home")).alias("outside")
    )
    mixed_lists = sizes.filter(F.col("outside") > 0).select(
        "key",
        F.ceil(F.col("n") / BLOCK).cast("int").alias("member_blocks"),
        F.ceil(F.col("outside") / BLOCK).cast("int").alias("probe_blocks"),
    )
    rows = lists.join(mixed_lists, "key").join(values, "doc")
    dealt = F.xxhash64("doc")
    member_block = F.pmod(dealt, F.col("member_blocks")).cast("int")
    probe_block = F.pmod(dealt, F.col("probe_blocks")).cast("int")
    as_member = rows.withColumn("side", F.lit(0)).withColumn("m", member_block).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.col("probe_blocks") - 1))
    )
    as_probe = rows.filter(F.col("cluster") != F.col("home")).withColumn("side", F.lit(1)).withColumn("p", probe_block)
    as_probe = as_probe.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("member_blocks") - 1)))
    columns = ["key", "m", "p", "side", "doc", "cluster", "home", "values"]
    sides = as_member.select(columns).unionByName(as_probe.select(columns))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, table = None, [], None
        for batch in batches:
            found = []
            for row in runs([batch]):
                if (row["key"], row["m"], row["p"]) != block:
                    block, held, table = (row["key"], row["m"], row["p"]), [], None
                if not row["side"]:
                    held.append((row["doc"], row["cluster"], row["values"]))
                    continue
                if table is None and held:
                    ids, own = (np.array([h[k] for h in held]) for k in (0, 1))
                    table = ids, own == row["home"], Classes(own.copy()), np.array([h[2] for h in held], np.int32)
                if table is None:
                    continue
                ids, home, classes, signatures = table
                mine = classes.of(row["cluster"])
                # Two stragglers meet once: from the larger id, unless the other is at home and meets no other way.
                open_pairs = np.flatnonzero((classes.labels != mine) & (home | (ids < row["doc"])))
                if not len(open_pairs):
                    continue
                agree = (signatures[open_pairs] == np.array(row["values"], np.int32)).sum(axis=1) >= MATCHES
                labels, first = np.unique(classes.labels[open_pairs[agree]], return_index=True)
                if len(labels):
                    found += [(row["doc"], int(y)) for y in ids[open_pairs[agree][first]]]
                    classes.join(mine, labels)
            yield pairs_of(found)

    dealt_out = sides.repartition("key", "m", "p").sortWithinPartitions("key", "m", "p", "side")
    return dealt_out.mapInArrow(match, "x long, y long")


def cluster_links(clusters: DataFrame, links: DataFrame, documents: DataFrame, size: int, percent: int) -> DataFrame:
    """(x, y): further links inside clusters, as many as join something in a block.

    ``clusters`` has (doc, cluster, weight); ``links`` are those of texts with heads, at most one per list of x. Texts that are linked
    with their cluster's smallest id are at home; the others are compared with all of the cluster.
    """
    heads = links.groupBy("x").agg(F.collect_set("y").alias("heads"))
    placed = clusters.join(heads, F.col("doc") == F.col("x"), "left").select(
        "doc",
        "cluster",
        "weight",
        F.coalesce("heads", F.array().cast("array<long>")).alias("heads"),
        (F.coalesce(F.array_contains("heads", F.col("cluster")), F.lit(False)) | (F.col("doc") == F.col("cluster"))).alias("home"),
    )
    placed = materialised(placed, "clusters")

    def parts(rows, weight):
        return F.greatest(F.ceil(rows / CLUSTER_ROWS), F.ceil(weight / CLUSTER_BYTES), F.lit(1)).cast("int")

    away = ~F.col("home")
    open_clusters = (
        placed.groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("weight").alias("bytes"),
            F.count_if(away).alias("outside"), F.sum(F.when(away, F.col("weight"))).alias("away_bytes"),
        )
        .filter("outside > 0")
        .select("cluster", parts(F.col("n"), F.col("bytes")).alias("ms"), parts(F.col("outside"), F.col("away_bytes")).alias("ps"))
    )
    rows = materialised(placed.join(open_clusters, "cluster"), "open-clusters")
    dealt = F.xxhash64("doc")
    as_member = rows.withColumn("side", F.lit(0)).withColumn("m", F.pmod(dealt, F.col("ms")).cast("int")).withColumn(
        "p", F.explode(F.sequence(F.lit(0), F.col("ps") - 1))
    )
    as_probe = rows.filter(away).withColumn("side", F.lit(1)).withColumn("p", F.pmod(dealt, F.col("ps")).cast("int"))
    as_probe = as_probe.withColumn("m", F.explode(F.sequence(F.lit(0), F.col("ms") - 1)))
    columns = ["cluster", "m", "p", "side", "doc", "home", "heads"]
    roles = as_member.select(columns).unionByName(as_probe.select(columns))
    sides = roles.join(full_sets(documents, rows.select("doc"), size), "doc")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, table = None, [], None
        for batch in batches:
            links = []
            for row in runs([batch]):
                if (row["cluster"], row["m"], row["p"]) != block:
                    block, held, table = (row["cluster"], row["m"], row["p"]), [], None
                own = np.frombuffer(row["shingles"], np.uint64)
                if not row["side"]:
                    held.append((row["doc"], row["home"], row["heads"], own.copy()))
                    continue
                table = table or (indexed(held) if held else None)
                if table is not None:
                    links += table.links(row["doc"], row["heads"], own, percent)
            yield pairs_of(links)

    return sides.repartition("cluster", "m", "p").sortWithinPartitions("cluster", "m", "p", "side").mapInArrow(settle, "x long, y long")


class indexed:
    """Members of a cluster block with an inverted list of their shingles, and what is known to belong together."""

    def __init__(self, held: list[tuple]) -> None:
        self.ids = np.array([h[0] for h in held])
        self.home = np.array([h[1] for h in held])
        self.sizes = np.array([len(h[3]) for h in held])
        shingles = np.concatenate([h[3] for h in held])
        order = np.argsort(shingles, kind="stable")
        self.shingles = shingles[order]
        self.owners = np.repeat(np.arange(len(held)), self.sizes)[order]
        self.known: dict[int, int] = {}
        labels = [self.label(doc, heads) for doc, _, heads, _ in held]
        self.classes = Classes(np.array([self.found(x) for x in labels]))

    def found(self, doc: int) -> int:
        while (up := self.known.get(doc, doc)) != doc:
            doc = up
        return doc

    def label(self, doc: int, heads: list[int]) -> int:
        """Texts that are linked with one head belong together."""
        own = self.found(doc)
        for head in heads:
            other = self.found(head)
            if other != own:
                self.known[own] = other
                own = other
        return own

    def links(self, doc: int, heads: list[int], own: np.ndarray, percent: int) -> list[tuple[int, int]]:
        """Links of the probe, one per class that it joins; two stragglers meet once, from the larger id."""
        before = {self.classes.of(self.found(x)) for x in (doc, *heads)}
        mine = self.classes.of(self.found(doc))
        if len(before) > 1:
            self.classes.join(mine, np.array(sorted(before - {mine})))
        smaller, larger = np.minimum(self.sizes, len(own)), np.maximum(self.sizes, len(own))
        able = (self.classes.labels != mine) & (self.home | (self.ids < doc)) & (percent * larger <= 100 * smaller)
        if not able.any():
            return []
        start, end = np.searchsorted(self.shingles, own), np.searchsorted(self.shingles, own, "right")
        sizes = end - start
        at = np.repeat(end - sizes.cumsum(), sizes) + np.arange(sizes.sum())
        common = np.bincount(self.owners[at], minlength=len(self.ids))
        hits = np.flatnonzero(able & (100 * common >= percent * (len(own) + self.sizes - common)))
        labels, first = np.unique(self.classes.labels[hits], return_index=True)
        if not len(labels):
            return []
        self.classes.join(mine, labels)
        return [(doc, int(y)) for y in self.ids[hits[first]]]


def near_duplicates(documents: DataFrame, percent: int = PERCENT, size: int = 2) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept, and class_id (the smallest id with the same set).

    Links need ``percent`` per cent of the union in common, confirmed on full sets; ``percent`` must be at least
    80, for which the match threshold was chosen: a pair at exactly 80 is missed with probability 2e-7. A null or
    empty text has no shingles, is linked with nothing and kept. A null id stays alone. Texts of any length are taken
    whole. Rows are expected to have distinct ids; of repeated ids, rows with equal texts get equal results. Other columns
    are not looked at.
    """
    bounded_batches(documents.sparkSession)
    sketch = materialised(sketches(documents, size), "sketches")
    filled = sketch.filter(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialised(filled.groupBy("set_key").agg(F.min("doc_id").alias("class_id")), "classes")
    first = classes.select(F.col("class_id").alias("doc"), F.col("set_key").alias("own_key"))
    texts = filled.join(first, (F.col("doc_id") == F.col("doc")) & (F.col("set_key") == F.col("own_key")))
    texts = materialised(texts.select("doc", "values", (8 * F.col("n_shingles")).alias("weight")).dropDuplicates(["doc"]), "texts")
    values = texts.select("doc", "values")
    posted = materialised(postings(values), "postings")
    heads = posted.groupBy("key").agg(F.min("doc").alias("head"), F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    lists = posted.join(heads, "key").select("key", "doc", "head")
    pairs = lists.filter("doc <> head").select(F.col("doc").alias("x"), F.col("head").alias("y")).distinct()
    stars = materialised(alike(pairs, values), "stars")
    links = materialised(confirmed(stars, documents, size, percent), "links")
    clusters = components(stars)

    known = F.coalesce("component", "doc")
    placed = lists.join(clusters, "doc", "left").select("key", "doc", "head", known.alias("cluster"))
    homes = placed.filter("doc = head").select("key", F.col("cluster").alias("home"))
    placed = placed.join(homes, "key").select("key", "doc", "cluster", "home")
    joining = materialised(bridges(placed, values), "bridges")
    if not joining.isEmpty():
        clusters = components(stars.unionByName(joining))
    members = clusters.join(texts, "doc").select("doc", F.col("component").alias("cluster"), "weight")
    more = cluster_links(members, links, documents, size, percent)
    final = components(links.unionByName(more))

    by_class = classes.join(final, F.col("class_id") == F.col("doc"), "left").select(
        "set_key", "class_id", F.coalesce("component", "class_id").alias("component_id")
    )
    rows = sketch.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    alone = F.col("doc_id").isNull()
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(~alone, F.coalesce("component_id", "doc_id")).alias("component_id"),
        (alone | F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))).alias("kept"),
        F.when(~alone, F.coalesce("class_id", "doc_id")).alias("class_id"),
    )
