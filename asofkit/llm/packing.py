"""Best-fit packing of tokenised documents by linear grouping.

Pieces are dealt to shards at random, so any shard sees the length distribution of the corpus and only its
last sequences can be part empty. In a shard, large lengths are sorted, cut into groups of equal cardinality
and rounded up to the group's largest; the few rounded sizes are combined into configurations that fill a
sequence best, each used as often as the demand allows; the actual documents take the places of their
group; small ones then go where they fit best.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import materialised

CAPACITY = 4096
END_ID = 1
SHARD_PIECES = 20_000
GROUPS = 256
LARGE = 1 / 8
CACHED_WORDS = 800_000
MARK = "\x01"
MARKS = ".,!?;:*#$%&|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Little-endian ids of a text, from the ids of its words.

    The tokenizer's pre-tokens never contain white space, so the ids of a text are those of its parts between
    spaces and line feeds. A part that ends in a letter or digit and then marks splits there as well, and ASCII
    parts are lower-cased as the tokenizer would. Parts seen before come from a cache of at most
    ``CACHED_WORDS`` entries; new ones are encoded together, with a mark between them whose id occurs in no part.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        (self.mark,) = self.ids(MARK)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, parts: set[str]) -> None:
        """Puts the ids of the parts into the cache."""
        split = {}
        for part in parts:
            head = part.rstrip(MARKS)
            if not head or not (head[-1].isascii() and head[-1].isalnum()):
                head = part
            split[part] = (head.lower() if head.isascii() else head, part[len(head) :])
        new = list({x for pair in split.values() for x in pair if x not in self.cache and MARK not in x})
        for at in range(0, len(new), 20_000):
            own = new[at : at + 20_000]
            ids = np.asarray(self.ids(f" {MARK} ".join([*own, ""])), "<u4")
            raw, begin = ids.tobytes(), 0
            for word, end in zip(own, (4 * np.flatnonzero(ids == self.mark)).tolist(), strict=True):
                self.cache[word] = raw[begin:end]
                begin = end + 4
        for part, (head, tail) in split.items():
            if MARK in part:
                self.cache[part] = np.asarray(self.ids(part), "<u4").tobytes()
            else:
                self.cache[part] = self.cache[head] + self.cache[tail]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        known = self.cache
        for at in range(0, len(texts), 512):
            split = [(text or "").replace("\n", " ").split(" ") for text in texts[at : at + 512]]
            if len(known) > CACHED_WORDS:
                known.clear()
            self.learn({part for parts in split for part in parts if part not in known})
            for parts in split:
                yield b"".join([known[part] for part in parts])


encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder per worker process, so that its cache outlives a task."""
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The documents cut into pieces of at most ``capacity`` tokens, the end id included; ids only on request."""
    schema = PIECE + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.asarray([END_ID], "<u4").tobytes()
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((key, piece, at // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


def best_configuration(sizes: list[int], left: dict[int, int], capacity: int) -> list[int]:
    """Rounded sizes that fill a sequence best, the largest one left included: a subset sum over bit sets."""
    first = next(s for s in sizes if left[s])
    room = capacity - first
    within = (1 << (room + 1)) - 1
    reach, steps = [1], []
    for s in sizes:
        for _ in range(min(left[s] - (s == first), room // s)):
            reach.append((reach[-1] | reach[-1] << s) & within)
            steps.append(s)
    fill, chosen = reach[-1].bit_length() - 1, [first]
    for k in range(len(steps), 0, -1):
        if not reach[k - 1] >> fill & 1:
            chosen.append(steps[k - 1])
            fill -= steps[k - 1]
    return chosen


def packed(lengths: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """The sequence number of each piece."""
    order = np.argsort(-lengths, kind="stable")
    n_large = int((lengths > large * capacity).sum())
    sequence = np.empty(len(lengths), np.int64)
    room: list[int] = []
    members: dict[int, list[int]] = {}  # by rounded size
    for part in np.array_split(order[:n_large], min(groups, max(n_large, 1))):
        if len(part):
            members.setdefault(int(lengths[part[0]]), []).extend(part.tolist())
    sizes = sorted(members, reverse=True)
    left = {s: len(members[s]) for s in sizes}
    while any(left.values()):
        chosen = best_configuration(sizes, left, capacity)
        for _ in range(min(left[s] // chosen.count(s) for s in chosen)):
            taken = [members[s].pop() for s in chosen]
            sequence[taken] = len(room)
            room.append(capacity - int(lengths[taken].sum()))
        left = {s: len(members[s]) for s in sizes}
    # Best fit: bit r of ``open_rooms`` says that some sequence has exactly r tokens left.
    by_room: dict[int, list[int]] = {}
    for k, r in enumerate(room):
        by_room.setdefault(r, []).append(k)
    open_rooms = sum(1 << r for r in by_room)
    for i in order[n_large:].tolist():
        size = int(lengths[i])
        fitting = open_rooms >> size
        if fitting:
            r = size + (fitting & -fitting).bit_length() - 1
            k = by_room[r].pop()
            if not by_room[r]:
                open_rooms ^= 1 << r
        else:
            r, k = capacity, len(room)
            room.append(capacity)
        sequence[i] = k
        by_room.setdefault(r - size, []).append(k)
        open_rooms |= 1 << (r - size)
    return sequence


def pack(
    documents: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and its gapless offset there.

    A null or empty text is the end id alone. Repeated rows and ids are packed as often as they occur; columns
    other than doc_id and text are not looked at; an empty table gives no sequence.
    """
    cut = materialised(pieces(documents, tokenizer or default_tokenizer(), capacity), "pieces")
    shards = max(1, -(-cut.count() // shard_pieces))
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", ignore_index=True)
        own = packed(group["length"].to_numpy(np.int64), capacity)
        group["sequence_id"] = group["shard"].to_numpy(np.int64) * (1 << 40) + own
        group["offset"] = group.groupby("sequence_id")["length"].cumsum() - group["length"]
        return group.drop(columns="shard")

    return cut.withColumn("shard", shard).groupBy("shard").applyInPandas(place, f"{PIECE}, sequence_id long, offset long")
