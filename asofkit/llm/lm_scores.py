"""Language-model scores from a log-frequency Bloom filter of word n-grams, and an exact unigram base beside them.

Tokens are words and ends; the model knows every 1-, 2- and 3-gram of the training texts. Single tokens are counted
exactly, as the base needs it. For longer n-grams a filter holds one key per step of the quantised log2 count, and a count is
read back by probing step after step until one is missing. A token's probability mixes its relative frequency after two,
one and no words before it; a history that occurred ``c`` times has the weight ``c / (c + 1)`` against the shorter one.

The filter grows with the corpus, so it is not broadcast but dealt in shards by key. Documents are folded into blocks; a
block sends each shard its distinct n-grams once, with how often its training documents use them, the shard builds its
part of the filter from all of them and probes it for each block, and the answers come back to the blocks, which have
stayed where they are. Keys of 48 bits and counts travel compressed, about three bytes for a distinct n-gram of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asofkit.llm.blocks import bucketed, squeezed, squeezed_keys, unsqueezed, unsqueezed_keys
from asofkit.llm.common import byte_words, materialised
from asofkit.llm.near_dedup import mixed
from asofkit.llm.vectors import fresh

FOLD = 5
HELD_OUT = 1
ORDER = 3
BLOCK_BYTES = 8 << 20
SHARD_ENTRIES = 2_000_000  # n-grams of blocks per shard, on average at most
KEY_BITS = 12  # bits of the filter per key
HASHES = 8
START = np.uint64(0x243F6A8885A308D3)  # stands before the first token
BLOCK = (
    "block long, doc_id array<bigint>, held array<boolean>, n_tokens array<bigint>, places binary, words binary,"
    " tokens long, train_tokens long, train_docs long"
)
ENTRY = "shard int, block long, size int, n int, keys binary, uses binary"
ANSWER = "shard int, block long, size int, n long, answer binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD_OUT, F.lit(False))


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def folded(documents: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK_BYTES`` of text: the hashes of their distinct tokens and the places of all tokens among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, sizes, flat, size = [], [], [], [], 0
        for batch in batches:
            keys, flags = (batch.column(c).to_pylist() for c in (0, 1))
            for key, flag, words in zip(keys, flags, byte_words(batch.column(2)), strict=True):
                ids.append(key)
                held.append(flag)
                sizes.append(len(words) + 1)
                flat += words
                flat.append(b"")  # the end; no word is empty
                size += sum(map(len, words)) + len(words)
                if size >= BLOCK_BYTES:
                    yield block(ids, held, sizes, flat)
                    ids, held, sizes, flat, size = [], [], [], [], 0
        if ids:
            yield block(ids, held, sizes, flat)

    def block(ids: list, held: list, sizes: list, flat: list) -> pa.RecordBatch:
        coded = pa.array(flat, pa.large_binary()).dictionary_encode()
        words = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        trained = [n for n, h in zip(sizes, held, strict=True) if not h]
        columns = [
            pa.array([fresh()]),
            pa.array([ids], pa.list_(pa.int64())),
            pa.array([held], pa.list_(pa.bool_())),
            pa.array([sizes], pa.list_(pa.int64())),
            pa.array([squeezed(coded.indices.to_numpy())], pa.binary()),
            pa.array([words.tobytes()], pa.binary()),
            *(pa.array([n], pa.int64()) for n in (sum(sizes), sum(trained), len(trained))),
        ]
        return pa.RecordBatch.from_arrays(columns, names(BLOCK))

    slim = documents.select(F.col("doc_id").cast("long"), held_out().alias("held"), "text")
    return bucketed(slim.mapInArrow(run, BLOCK), "block")


def before(values: np.ndarray, starts: np.ndarray, first) -> np.ndarray:
    """The value one place earlier; ``first`` where a text starts."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = first
    return out


def gram_keys(tokens: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Keys of the n-gram that ends at each token, per order: the token's hash, then 48 bits for longer ones."""
    one = before(tokens, starts, START)
    two = before(one, starts, START)
    pairs = mixed(one * np.uint64(0x9E3779B97F4A7C15) + tokens)
    triples = mixed(mixed(two * np.uint64(0xC2B2AE3D27D4EB4F) + one) * np.uint64(0x9E3779B97F4A7C15) + tokens)
    return [mixed(tokens), pairs >> np.uint64(16), mixed(triples) >> np.uint64(16)]


def block_tokens(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, where texts start, their sizes) of a block."""
    words = np.frombuffer(batch.column("words")[at].as_py(), np.uint64)
    sizes = batch.column("n_tokens")[at].values.to_numpy()
    return words[unsqueezed(batch.column("places")[at].as_py())], sizes.cumsum() - sizes, sizes


def shard_cuts(keys: np.ndarray, size: int, shards: int) -> np.ndarray:
    """Where each shard's slice of the rising ``keys`` begins, and their number at the end."""
    bits = np.uint64(32 if size == 1 else 16)
    shard = ((keys >> bits) * np.uint64(shards)) >> np.uint64(32)
    return np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))


def entries(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, size, n, keys, uses): the distinct n-grams of every block with their uses in its training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tokens, starts, sizes = block_tokens(batch, at)
                trained = np.repeat(~np.array(batch.column("held")[at].as_py()), sizes)
                for size, keys in enumerate(gram_keys(tokens, starts), start=1):
                    found, place = np.unique(keys, return_inverse=True)
                    uses = np.bincount(place, trained, len(found)).astype(np.int32)
                    cuts = shard_cuts(found, size, shards)
                    used = np.flatnonzero(np.diff(cuts))
                    spans = [slice(cuts[k], cuts[k + 1]) for k in used]
                    columns = [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), batch.column("block")[at].as_py())),
                        pa.array(np.full(len(used), size, np.int32)),
                        pa.array(np.diff(cuts)[used].astype(np.int32)),
                        pa.array([squeezed_keys(found[s]) for s in spans], pa.binary()),
                        pa.array([squeezed(uses[s]) for s in spans], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names(ENTRY))

    return blocks.select("block", "held", "n_tokens", "places", "words").mapInArrow(run, ENTRY)


# --- the filter ----------------------------------------------------------------------------------


def steps(counts: np.ndarray) -> np.ndarray:
    """Quantised log2 counts: 0 for 0, 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts)[1]


def expected(step: np.ndarray) -> np.ndarray:
    """The middle of the counts of a step."""
    return np.where(step > 0, 0.75 * 2.0**step - 0.5, 0.0)


class LogFilter:
    """A Bloom filter of (key, step) for every step up to the key's quantised count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, key_bits: int = KEY_BITS) -> None:
        last = steps(counts)
        self.bits = np.uint64(max(64, key_bits * int(last.sum())))
        self.table = np.zeros(int(self.bits) // 8 + 1, np.uint8)
        for step in range(1, int(last.max(initial=0)) + 1):
            for place in self.places(keys[last >= step], step):
                np.bitwise_or.at(self.table, place >> np.uint64(3), self.mask(place))

    @staticmethod
    def mask(place: np.ndarray) -> np.ndarray:
        return np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)

    def places(self, keys: np.ndarray, step: int) -> Iterator[np.ndarray]:
        one = mixed(keys + np.uint64(step * 0x9E3779B97F4A7C15 % (1 << 64)))
        two = mixed(one) | np.uint64(1)
        for _ in range(HASHES):
            yield one % self.bits
            one = one + two

    def probed(self, keys: np.ndarray) -> np.ndarray:
        """The number of steps that are there, one after the other."""
        found = np.zeros(len(keys), np.uint8)
        alive = np.arange(len(keys))
        step = 1
        while len(alive):
            own, there = keys[alive], np.ones(len(alive), bool)
            for place in self.places(own, step):
                there &= (self.table[place >> np.uint64(3)] & self.mask(place)) > 0
            alive = alive[there]
            found[alive] = step
            step += 1
        return found


def answered(rows: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """(shard, block, size, n, answer): counts of tokens, probed steps of longer n-grams; kinds of tokens in rows without a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard and waiting:
                    yield shard_answers(shard, waiting)
                    waiting = []
                shard = row["shard"]
                waiting.append((row["block"], row["size"], unsqueezed_keys(row["keys"]), unsqueezed(row["uses"])))
        if waiting:
            yield shard_answers(shard, waiting)

    def shard_answers(shard: int, waiting: list[tuple]) -> pa.RecordBatch:
        kinds, out, longer = 0, [], []
        for size in range(1, ORDER + 1):
            own = [w for w in waiting if w[1] == size]
            if not own:
                continue
            keys, place = np.unique(np.concatenate([w[2] for w in own]), return_inverse=True)
            total = np.bincount(place, np.concatenate([w[3] for w in own]), len(keys)).astype(np.int64)
            ends = np.cumsum([len(w[2]) for w in own])[:-1]
            if size == 1:
                kinds = int((total > 0).sum())
                out += [(w[0], 1, part.tobytes()) for w, part in zip(own, np.split(total[place], ends), strict=True)]
            else:
                longer.append((size, own, tagged(keys, size), total, place, ends))
        if longer:
            keys, total = (np.concatenate([x[k] for x in longer]) for k in (2, 3))
            shared = LogFilter(keys[total > 0], total[total > 0], key_bits)
            for size, own, keys, _, place, ends in longer:
                parts = np.split(shared.probed(keys)[place], ends)
                out += [(w[0], size, part.tobytes()) for w, part in zip(own, parts, strict=True)]
        n = [len(x[2]) // (8 if x[1] == 1 else 1) for x in out] + [kinds]
        columns = [
            pa.array([shard] * len(n), pa.int32()),
            pa.array([x[0] for x in out] + [None], pa.int64()),
            pa.array([x[1] for x in out] + [0], pa.int32()),
            pa.array(n, pa.int64()),
            pa.array([pa.compress(x[2], codec="zstd", asbytes=True) for x in out] + [None], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names(ANSWER))

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, ANSWER)


def tagged(keys: np.ndarray, size: int) -> np.ndarray:
    return keys | np.uint64(size << 48)


# --- scores --------------------------------------------------------------------------------------


def after_history(count: np.ndarray, history: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The relative frequency after a history, mixed with the probability after the shorter one."""
    weight = history / (history + 1)
    return np.where(history > 0, weight * np.minimum(count, history) / np.maximum(history, 1), 0) + (1 - weight) * shorter


def scores(documents: DataFrame, key_bits: int = KEY_BITS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone; texts of any length are scored whole. ``score`` is the log10 probability of the
    lower-cased words and the end, each after the words before it; with nothing to learn from it is the base. A null id counts
    as training. Every input row gives one row, repeated or not; other columns are not looked at; an empty table
    gives no rows. Tokens are told apart by 64 bits of a hash.
    """
    blocks = folded(documents)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "train_tokens", "train_docs")]
    size = blocks.agg(*sums).first()
    shards = max(1, -(-ORDER * size.tokens // SHARD_ENTRIES))
    answers = materialised(answered(entries(blocks, shards), key_bits), "answers")
    kinds = answers.filter(F.col("block").isNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    floor = size.train_tokens + 0.5 * (kinds + 1)
    # one row per n-gram length and shard that a block asks
    back = answers.filter(F.col("block").isNotNull()).groupBy("block").agg(
        F.collect_list(F.struct("size", "shard", "n", "answer")).alias("found")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                tokens, starts, sizes = block_tokens(batch, at)
                found = sorted(batch.column("found")[at].as_py(), key=lambda f: (f["size"], f["shard"]))
                counts = []
                for order, keys in enumerate(gram_keys(tokens, starts), start=1):
                    width = 8 if order == 1 else 1
                    raw = b"".join(pa.decompress(f["answer"], f["n"] * width, codec="zstd", asbytes=True) for f in found if f["size"] == order)
                    answer = np.frombuffer(raw, np.int64).astype(float) if order == 1 else expected(np.frombuffer(raw, np.uint8).astype(int))
                    counts.append(answer[np.unique(keys, return_inverse=True)[1]])
                base = (counts[0] + 0.5) / floor
                p = after_history(counts[1], before(counts[0], starts, size.train_docs), base)
                p = after_history(counts[2], before(counts[1], starts, size.train_docs), p)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                total = lambda x: pa.array(np.bincount(owner, x, len(sizes)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[at].values,
                        batch.column("held")[at].values,
                        pa.array(sizes),
                        total(counts[0] > 0).cast(pa.int64()),
                        total(np.log10(base)),
                        total(np.log10(p)),
                    ],
                    names(RESULT),
                )

    asked = blocks.select("block", "doc_id", "held", "n_tokens", "places", "words")
    return asked.join(back, "block").drop("block").mapInArrow(score, RESULT).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(size.train_tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )
