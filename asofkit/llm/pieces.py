"""SentencePiece encoding and decoding by a table of distinct chunks.

White space becomes the marker U+2581, and where no piece holds a marker behind another character, no merge crosses the
place before a marker that follows one: each marked word is segmented by itself. Documents are folded into blocks: the
block's distinct words in order, and for each document the places of its words among them. Words of all blocks are
dealt out by ranges of the alphabet, so that every distinct word of the corpus is segmented once, and its ids come
back to the blocks, where places turn into the ids of whole texts. Decoding works the same way on runs of ids that
start with a marked piece. Words and places travel compressed, about a tenth and a third of the text's size.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.blocks import bucketed, squeezed, unsqueezed
from asofkit.llm.vectors import fresh

MARK = "▁"
BLOCK_BYTES = 8 << 20
GATHERED = 100_000  # chunks whose values are laid out at a time
ROWS_BYTES = 2 << 20  # text of the rows that leave a task together
RANGE_ENTRIES = 200_000  # words of blocks per range of the alphabet, and so its distinct words at most
SAMPLE = 100_000  # about so many words, every n-th of each block, set the ranges' bounds
BLOCK = "block long, doc_id array<bigint>, n_chunks array<int>, places binary, kinds int, chunks binary"
PART = "range int, block long, kinds int, chunks binary"
VALUE = "range int, block long, kinds int, ids binary, text binary"
ENCODED = "doc_id long, ids array<int>, decoded string"
Chunks = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]
Meanings = Callable[[list[bytes]], list[tuple[bytes, bytes | None]]]


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(model: str) -> sentencepiece.SentencePieceProcessor:
    """The model, once it is known that its words can be segmented one by one."""
    found = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [found.id_to_piece(i) for i in range(found.get_piece_size())]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError(f"{model} has pieces that cross a marker")
    probe = " a  \t①ﬁéé "
    if found.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"{model} rewrites texts before it cuts them")
    return found


def packed(items: pa.Array) -> bytes:
    """A binary array without nulls, compressed."""
    sizes = pc.binary_length(items).to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    return zstandard.ZstdCompressor().compress(sizes + b"".join(items.to_pylist()))


def unpacked(raw: bytes, n: int) -> pa.Array:
    whole = zstandard.ZstdDecompressor().decompress(raw)
    offsets = np.concatenate([[0], np.frombuffer(whole, "<i4", n).cumsum()]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(whole[4 * n :])])


def text_chunks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(chunks, number per text): a chunk is a word with the spaces before it but the first, which its marker stands for.

    A text's first word is marked although no space is before it, and spaces at the end are a chunk of their own.
    """
    texts = pc.replace_substring(texts.cast(pa.string()).fill_null(""), MARK, " ")
    lists = pc.split_pattern(pc.filter(texts, pc.greater(pc.binary_length(texts), 0)), " ")
    sizes = np.zeros(len(texts), np.int64)
    sizes[pc.binary_length(texts).to_numpy() > 0] = pc.list_value_length(lists).to_numpy()
    words = lists.flatten()
    empty = pc.binary_length(words).to_numpy() == 0
    if not empty.any():
        return words.cast(pa.binary()), sizes
    last = np.zeros(len(words), bool)
    last[(sizes.cumsum() - 1)[sizes > 0]] = True
    ends = np.flatnonzero(~empty | last)
    spaces = np.diff(ends, prepend=-1) - 1
    found = words.take(pa.array(ends))
    with_spaces = pc.binary_join_element_wise(pc.binary_repeat(pa.scalar(" "), pa.array(spaces)), found, "")
    owner = np.repeat(np.arange(len(texts)), sizes)[ends]
    return with_spaces.cast(pa.binary()), np.bincount(owner, minlength=len(texts))


def folded(documents: DataFrame, payload: str, chunks: Chunks) -> DataFrame:
    """Blocks of about ``BLOCK_BYTES`` of text: places of each document's chunks among the block's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            ends = pc.fill_null(pc.binary_length(batch.column("payload")), 0).to_numpy(zero_copy_only=False).cumsum()
            at = 0
            while at < batch.num_rows:
                until = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES - size)) + 1
                waiting.append(batch.slice(at, until - at))
                size += int(ends[min(until, len(ends)) - 1] - (ends[at - 1] if at else 0))
                at = until
                if size >= BLOCK_BYTES:
                    yield block(waiting)
                    waiting, size = [], 0
        if waiting:
            yield block(waiting)

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()
        ids, texts = rows[0].column("doc_id"), rows[0].column("payload")
        found, counts = chunks(texts)
        coded = found.dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        arrays = [
            pa.array([fresh()]),
            pa.ListArray.from_arrays([0, len(ids)], ids),
            pa.array([counts], pa.list_(pa.int32())),
            pa.array([squeezed(place[coded.indices.to_numpy()])], pa.binary()),
            pa.array([len(order)], pa.int32()),
            pa.array([packed(coded.dictionary.take(pa.array(order)))], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in BLOCK.split(", ")])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(b for b in batches if b.num_rows)

    slim = documents.select("doc_id", F.col(payload).alias("payload"))
    return bucketed(slim.mapInArrow(slices, BLOCK), "block")


def range_bounds(blocks: DataFrame) -> list[bytes]:
    """Words that cut the alphabet into ranges of about ``RANGE_ENTRIES`` words of blocks each."""
    entries = blocks.agg(F.sum("kinds")).first()[0] or 0
    step = max(1, entries // SAMPLE)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kinds, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "kinds", "chunks")), strict=True):
                yield pa.RecordBatch.from_arrays([unpacked(raw, kinds)[block % step :: step]], ["chunk"])

    ranges = -(-entries // RANGE_ENTRIES)
    if ranges < 2:
        return []
    seen = sorted(r.chunk for r in blocks.select("block", "kinds", "chunks").mapInArrow(sample, "chunk binary").collect())
    return sorted({bytes(seen[len(seen) * k // ranges]) for k in range(1, ranges)}) if seen else []


def chunk_values(blocks: DataFrame, meanings: Meanings) -> DataFrame:
    """(range, block, kinds, ids, text): what the chunks of a block stand for, each distinct chunk worked out once.

    A chunk occurs once per block at most, and blocks of a range are met one after the other, so a task holds the
    distinct chunks of one range, however common they are.
    """
    bounds = range_bounds(blocks)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, kinds, raw in zip(*(batch.column(c).to_pylist() for c in ("block", "kinds", "chunks")), strict=True):
                chunks = unpacked(raw, kinds)
                words = chunks.to_pylist()
                cuts = [0, *(bisect_left(words, b) for b in bounds), kinds]
                used = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
                columns = [
                    pa.array(used, pa.int32()),
                    pa.array([block] * len(used), pa.int64()),
                    pa.array([cuts[k + 1] - cuts[k] for k in used], pa.int32()),
                    pa.array([packed(chunks[cuts[k] : cuts[k + 1]]) for k in used], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PART.split(", ")])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, known = None, {}
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("range", "block", "kinds", "chunks")), strict=True)
            for number, block, kinds, raw in rows:
                if number != current:
                    current, known = number, {}
                words = unpacked(raw, kinds).to_pylist()
                new = [w for w in words if w not in known]
                known.update(zip(new, meanings(new), strict=True))
                values = [known[w] for w in words]
                ids = np.frombuffer(b"".join(v[0] for v in values), np.int32)
                sizes = np.array([len(v[0]) // 4 for v in values])
                other = [v[1] for v in values]
                text = None if all(t is None for t in other) else packed(pa.array([b"" if t is None else b"=" + t for t in other], pa.binary()))
                columns = [
                    pa.array([number], pa.int32()), pa.array([block]), pa.array([kinds], pa.int32()),
                    pa.array([squeezed(np.concatenate([sizes, ids]))], pa.binary()), pa.array([text], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in VALUE.split(", ")])

    rows = blocks.select("block", "kinds", "chunks").where(F.col("kinds") > 0).mapInArrow(dealt, PART)
    return rows.repartition(F.col("range")).sortWithinPartitions("range").mapInArrow(look_up, VALUE)


def gathered(sizes: np.ndarray, flat: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, items) of the variable-length values at ``places``."""
    starts = sizes.cumsum() - sizes
    found = sizes[places]
    out = np.empty(found.sum(), flat.dtype)
    end = 0
    for at in range(0, len(places), GATHERED):
        own = found[at : at + GATHERED]
        ends = own.cumsum()
        rows = np.arange(ends[-1]) + np.repeat(starts[places[at : at + GATHERED]] - (ends - own), own)
        out[end : end + len(rows)] = flat[rows]
        end += len(rows)
    return found, out


def per_document(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Offsets of the documents' items, from the sizes of their chunks."""
    ends = np.concatenate([[0], sizes.cumsum()])
    return ends[np.concatenate([[0], counts.cumsum()])].astype(np.int32)


def unfolded(blocks: DataFrame, values: DataFrame, assemble: Callable[..., list[pa.Array]], schema: str) -> DataFrame:
    """Joins chunk values back to their blocks and places; ``assemble`` makes a block's result columns."""
    back = values.groupBy("block").agg(F.collect_list(F.struct("range", "kinds", "ids", "text")).alias("found"))  # a block's chunks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in ("places", "kinds", "chunks", "found")}
                sizes, ids, text = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], []
                for part in sorted(row["found"] or [], key=lambda f: f["range"]):
                    numbers = unsqueezed(part["ids"])
                    sizes.append(numbers[: part["kinds"]])
                    ids.append(numbers[part["kinds"] :])
                    text += [b""] * part["kinds"] if part["text"] is None else unpacked(part["text"], part["kinds"]).to_pylist()
                counts = batch.column("n_chunks")[at].values.to_numpy()
                chunks = unpacked(row["chunks"], row["kinds"])
                arrays = assemble(counts, unsqueezed(row["places"]), chunks, np.concatenate(sizes), np.concatenate(ids), text)
                whole = pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[at].values, *arrays], [c.split()[0] for c in schema.split(", ")]
                )
                lengths = pc.binary_length(whole.column(whole.num_columns - 1)).to_numpy()
                cuts = np.flatnonzero(np.diff(lengths.cumsum() // ROWS_BYTES, prepend=0))
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), whole.num_rows], strict=True):
                    yield whole.slice(a, b - a)

    return blocks.join(back, "block", "left").drop("block").mapInArrow(run, schema)


def joined_texts(texts: list[bytes], places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the documents' texts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    sizes, flat = gathered(sizes, np.frombuffer(b"".join(texts), np.uint8), places)
    return per_document(sizes, counts), flat


def encoded(documents: DataFrame, model: str | None = None) -> DataFrame:
    """Per row of ``documents``: doc_id, ids (with the end id), decoded (what the library's decode gives for them).

    Ids are exactly those of the sentencepiece library for the whole text; a null or empty text has the end id alone and decodes
    to the empty text. Texts of any length are taken whole. Null ids and repeated rows give a row each; columns other
    than doc_id and text are not looked at; an empty table gives no rows. Models that rewrite texts or have pieces that
    cross markers are refused.
    """
    path = model or default_model()

    def meanings(words: list[bytes]) -> list[tuple[bytes, bytes | None]]:
        pieces = processor(path)
        texts = [w.decode() for w in words]  # the library puts the first marker before them
        ids = pieces.encode(texts, num_threads=1)
        ids = [i or [pieces.piece_to_id(MARK)] for i in ids]  # a marker alone, which is no empty text here
        back = pieces.decode(ids, num_threads=1)  # without its first marker
        return [
            (np.array(i, np.int32).tobytes(), None if b == t else b.encode()) for i, b, t in zip(ids, back, texts, strict=True)
        ]

    def assemble(counts: np.ndarray, places: np.ndarray, chunks: pa.Array, sizes: np.ndarray, ids: np.ndarray, text: list[bytes]) -> list[pa.Array]:
        sizes, flat = gathered(sizes, ids, places)
        starts = per_document(sizes, counts)
        flat = np.insert(flat, starts[1:], processor(path).eos_id())
        ids = pa.ListArray.from_arrays(pa.array(starts + np.arange(len(starts), dtype=np.int32)), pa.array(flat.astype(np.int32)))
        # a chunk decodes to itself unless the table says otherwise
        words = [b" " + (t[1:] or w) for w, t in zip(chunks.to_pylist(), text, strict=True)]
        starts, flat = joined_texts(words, places, counts)
        filled = counts > 0
        flat = np.delete(flat, starts[:-1][filled])  # decoding drops the leading marker
        starts = starts - np.concatenate([[0], filled.cumsum()]).astype(np.int32)
        decoded = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(flat)])
        return [ids, decoded]

    blocks = folded(documents, "text", text_chunks)
    return unfolded(blocks, chunk_values(blocks, meanings), assemble, ENCODED)


def decoded(encoded_rows: DataFrame, model: str | None = None) -> DataFrame:
    """Per row of (doc_id, ids array<int>): doc_id and the text that the library's decode gives for the ids.

    ``ids`` are those of ``encoded``: null or empty ids give the empty text. Runs of ids from one marked piece to the next are decoded
    once each.
    """
    path = model or default_model()

    def chunks(payload: pa.Array) -> tuple[pa.Array, np.ndarray]:
        rows = [np.frombuffer(x, np.int32) for x in payload.to_pylist()]
        sizes = np.array([len(x) for x in rows], np.int64)
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        begins = marked(path)[ids]
        begins[(sizes.cumsum() - sizes)[sizes > 0]] = True
        owner = np.repeat(np.arange(len(rows)), sizes)[begins]
        offsets = np.append(np.flatnonzero(begins), len(ids)).astype(np.int32) * 4
        found = pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
        return found, np.bincount(owner, minlength=len(rows))

    def meanings(runs: list[bytes]) -> list[tuple[bytes, bytes | None]]:
        ids = [np.frombuffer(r, np.int32).tolist() for r in runs]
        texts = processor(path).decode(ids, num_threads=1)
        return [(b"", (" " * bool(marked(path)[i[0]]) + t).encode()) for i, t in zip(ids, texts, strict=True)]

    def assemble(counts: np.ndarray, places: np.ndarray, _chunks: pa.Array, _sizes: np.ndarray, _ids: np.ndarray, text: list[bytes]) -> list[pa.Array]:
        starts, flat = joined_texts([t[1:] for t in text], places, counts)
        whole = pa.Array.from_buffers(pa.string(), len(counts), [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(flat))])
        return [pa.array([t.removeprefix(" ") for t in whole.to_pylist()], pa.string())]

    def as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(x or [], np.int32).tobytes() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    rows = encoded_rows.select("doc_id", "ids").mapInArrow(as_bytes, "doc_id long, raw binary")
    blocks = folded(rows, "raw", chunks)
    return unfolded(blocks, chunk_values(blocks, meanings), assemble, "doc_id long, text string")


@lru_cache(maxsize=2)
def marked(model: str) -> np.ndarray:
    """Which ids are pieces that start with a marker."""
    pieces = processor(model)
    return np.array([pieces.id_to_piece(i).startswith(MARK) for i in range(pieces.get_piece_size())])
