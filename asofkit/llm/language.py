"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text knows all its substrings. A text is parsed greedily into
longest phrases that the sample contains; the language with the fewest phrases, normalised by
log2(sample length) / text length, wins. The parse starts anew every ``BLOCK`` symbols, so that numpy can
advance thousands of blocks together; that adds at most one phrase per block, alike for all languages.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import bounded_batches

SAMPLE_DOCS = 64
SAMPLE_CHARS = 1_000
TOTAL_CHARS = 1_000_000
DENSE = 96
BLOCK = 256
BATCH_CHARS = 500_000
FOLD = 4
HELD_OUT = 2
REJECT_RATE = 0.6
UNKNOWN = "und"


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLD == HELD_OUT


def sample(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Of at most ``docs`` texts per language, the smallest in hash order, a stretch of at most ``chars`` characters.

    This bounds what is fitted on; ids and sources only choose the sample. A stretch lies at a hashed place, so that
    what many texts open with is not all that is learned.
    """
    labelled = documents.filter(~F.coalesce(held_out(), F.lit(False)) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64("doc_id", "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # A share of the hash range holds about four times the documents wanted, whatever the language's size.
    span = 1 << 20
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(span, 4 * docs * span / n + 1)))]), F.col("lang")) if sizes else F.lit(0)
    begin = 1 + F.pmod(F.xxhash64("text", "doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    rows = (
        labelled.filter(F.pmod(order, F.lit(span)) < share)
        .select("lang", order.alias("order"), F.substring("text", begin.cast("int"), F.lit(chars)).alias("text"))
        .groupBy("lang")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("order", "text"))), 1, docs).alias("picked"))
        .collect()
    )
    return {r.lang: [p.text for p in r.picked] for r in sorted(rows, key=lambda r: r.lang)}


def alphabet(texts: list[str]) -> np.ndarray:
    """Symbol of every code point: 0 for all but letters, 1 for letters that the sample lacks, then all its letters."""
    counts = Counter(c for t in texts for c in t.lower() if c.isalpha())
    codes = np.zeros(0x110000, np.uint8 if len(counts) < 250 else np.int32)
    codes[[c for c in range(0x110000) if chr(c).isalpha()]] = 1
    for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))):
        codes[ord(c)] = k + 2
    return codes


def symbols(text: str, codes: np.ndarray) -> np.ndarray:
    """Lower-cased letters as symbols; every run of other characters is one 0."""
    s = codes[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def automaton(sequence: np.ndarray) -> list[dict[int, int]]:
    """The suffix automaton of the sequence: per state the state after each symbol."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence.tolist():
        new = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return follow


def restarts(follow: list[dict[int, int]], width: int) -> np.ndarray:
    """What a symbol that does not continue a phrase gives: a new phrase with it, or one more phrase if it is unknown."""
    start = np.full(width, 2, np.int32)
    for c, state in follow[0].items():
        start[c] = 4 * state + 1
    return start


def parser(sequence: np.ndarray, width: int) -> np.ndarray:
    """The suffix automaton of the sequence as a flat table: 4 * next state + phrases ended.

    A symbol that no phrase of the sample contains ends the phrase before it and is one itself. Column ``width - 1`` is padding and changes nothing.
    """
    follow = automaton(sequence)
    start = restarts(follow, width)
    table = np.tile(start, (len(follow), 1))
    for state, edges in enumerate(follow):
        if edges:
            table[state, list(edges)] = 4 * np.fromiter(edges.values(), np.int32, len(edges))
    unknown = np.setdiff1d(np.arange(width - 1), list(follow[0]))
    table[0, unknown] = 1
    table[:, width - 1] = 4 * np.arange(len(follow))
    return table.ravel()


class Sparse:
    """The same as ``parser``'s table for large alphabets: sorted edges, at most three per symbol of the sequence."""

    def __init__(self, sequence: np.ndarray, width: int) -> None:
        follow = automaton(sequence)
        self.width, self.start = width, restarts(follow, width)
        edges = np.array([(state * width + c, 4 * to) for state, own in enumerate(follow) for c, to in own.items()], np.int64)
        edges = edges.reshape(-1, 2)[np.argsort(edges.reshape(-1, 2)[:, 0])]
        self.keys, self.values = edges[:, 0].copy(), edges[:, 1].astype(np.int32)

    def __call__(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + column
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        value = np.where(self.keys[at] == key, self.values[at], self.start[column])
        value[(state == 0) & (value == 2)] = 1
        return np.where(column == self.width - 1, 4 * state, value)


class Own:
    """A language's table over its own letters only; all others are unknown to it, whatever they are."""

    def __init__(self, sequence: np.ndarray, width: int) -> None:
        letters = np.setdiff1d(sequence, [0, 1])
        self.width = len(letters) + 3
        self.local = np.ones(width, np.int32)
        self.local[0], self.local[width - 1] = 0, self.width - 1
        self.local[letters] = np.arange(2, self.width - 1)
        build = parser if self.width <= DENSE else Sparse
        self.table = build(self.local[sequence], self.width)


def fit(documents: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict:
    """The tables of all languages. ``TOTAL_CHARS`` bounds them, however many languages there are."""
    texts = sample(documents, docs, chars)
    codes = alphabet([t for own in texts.values() for t in own])
    width = int(codes.max()) + 2
    each = min(docs * chars, TOTAL_CHARS // max(len(texts), 1))
    joined = {k: symbols("\n".join(own), codes)[:each] for k, own in texts.items()}
    joined = {k: s for k, s in joined.items() if (s > 0).any()}
    return {
        "codes": codes,
        "width": width,
        "languages": list(joined),
        "tables": [Own(s, width) for s in joined.values()],
        "bits": np.array([np.log2(len(s) + 1) for s in joined.values()]),
    }


def phrase_counts(texts: list[np.ndarray], model: dict) -> np.ndarray:
    """Phrases of each symbol array in each language."""
    width = model["width"]
    blocks = np.array([-(-len(s) // BLOCK) for s in texts])
    lanes = np.full((int(blocks.sum()), BLOCK), width - 1, np.int32)
    at = 0
    for s, n in zip(texts, blocks.tolist(), strict=True):
        lanes[at : at + n].reshape(-1)[: len(s)] = s
        at += n
    lanes = np.ascontiguousarray(lanes.T)
    owner = np.repeat(np.arange(len(texts)), blocks)
    result = np.zeros((len(texts), len(model["tables"])))
    for k, table in enumerate(model["tables"]):
        state, count = np.zeros(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
        local = table.local[lanes] if isinstance(table, Own) else lanes
        wide, table = (table.width, table.table) if isinstance(table, Own) else (width, table)
        for column in local:
            value = table(state, column) if isinstance(table, Sparse) else table[state * wide + column]
            count += value & 3
            state = value >> 2
        result[:, k] = np.bincount(owner, count + (state != 0), len(texts))
    return result


RESULT = "doc_id long, held_out boolean, lang_pred string, score double, phrase_rate double"


def judged(keys: list, held: list, texts: list[str | None], model: dict) -> tuple[list, ...]:
    coded = [symbols(t or "", model["codes"]) for t in texts]
    counts, languages = phrase_counts(coded, model), model["languages"]
    rates = counts * model["bits"] / np.maximum([len(s) for s in coded], 1)[:, None]
    labels, scores, plain = [], [], []
    for s, r, c in zip(coded, rates, counts, strict=True):
        if not languages or not s.any():
            labels.append(UNKNOWN), scores.append(0.0), plain.append(1.0)
            continue
        best = int(r.argmin())  # ties: the first language in alphabetical order
        others = np.delete(r, best)
        labels.append(languages[best])
        scores.append(float(1 - r[best] / others.min()) if len(others) else 1.0)
        plain.append(float(c[best] / len(s)))
    return keys, held, labels, scores, plain


def languages(documents: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and phrase_rate.

    ``score`` is one minus the ratio of the best to the second-best normalised phrase count: 0 for a tie.
    A text without a letter, a null one, and any text when nothing was learned are ``und`` with score 0.
    Every input row gives one row, repeated or not. ``learn_from`` needs text, lang and doc_id.
    """
    bounded_batches(documents.sparkSession)
    model = fit(documents if learn_from is None else learn_from)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(2)), 0).to_pylist()
            at = 0
            while at < len(sizes):
                end, size = at, 0
                while end < len(sizes) and (end == at or size + sizes[end] <= BATCH_CHARS):
                    size += sizes[end]
                    end += 1
                columns = judged(*(c.to_pylist() for c in batch.slice(at, end - at).columns), shared.value)
                types = (pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                    ["doc_id", "held_out", "lang_pred", "score", "phrase_rate"],
                )
                at = end

    slim = documents.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return slim.mapInArrow(label, RESULT)


def rejected():
    """Documents to drop: no language, or a parse hardly longer than single symbols in the best one."""
    return (F.col("lang_pred") == UNKNOWN) | (F.col("phrase_rate") > REJECT_RATE)
