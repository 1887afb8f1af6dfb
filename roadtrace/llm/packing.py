"""Token sequences for training: hierarchical packing into several context sizes.

Documents become token ids and are cut into pieces of at most the longest context.  Pieces are routed to tiers: the
smallest context that holds them.  Tiers are packed from the longest down.  A piece opens a sequence of its tier; the
gap behind it is filled with the longest pieces of the same and of shorter tiers that fit, and if more than a few
tokens are still free, one more piece is cut to fill them.  Sequences of the shorter tiers are filled to the last
token, because only lengths that are powers of two go without padding.  Whole sequences of a tier are dealt to step
groups that hold the same number of tokens in every tier.

Documents are tokenised where they are.  Pieces are dealt to packs by a hash of document and place, as many packs as
the text takes at ``PACK_BYTES`` each; a pack is packed in one task, and packs do not know of each other.  Each pack ends
with at most one sequence that is padded for want of pieces.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TIERS = (256, 512, 1024, 2048)
END_OF_TEXT = 1
# Up to so many free tokens of a longest sequence are padded rather than filled by cutting a document.
LEFT_FREE = 16
# Sequences of the longest tier in a step group, or as many tokens of another one.
STEP = 8
PACK_BYTES = 8_000_000
# Tokens that leave the tokeniser together.
PASS = 1_000_000

# The split into words of byte-level vocabularies: fixed values.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@cache
def _encoding(path: str) -> tiktoken.Encoding:
    """The byte-level vocabulary at ``path``, for the encoder that needs least time for it.

    Its ids are those of ``tokenizers`` (tests compare them): a token's id is its rank among the merges.  In the file
    printable bytes stand for themselves and the others, in order, for the characters from 256 on.
    """
    tokenizer = _tokenizer(path)
    special = {i: token.content for i, token in tokenizer.get_added_tokens_decoder().items()}
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in tokenizer.get_vocab().items() if i not in special}
    return tiktoken.Encoding("vocabulary", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={t: i for i, t in special.items()})


def token_ids(text: str | None, path: str) -> np.ndarray:
    """Ids of a whole text by the vocabulary at ``path``; those of a null text are none.

    None is added, but strings of special tokens in the text become their ids.
    """
    try:
        return np.asarray(_encoding(path).encode_to_numpy(text or "", allowed_special="all"), np.uint32)
    except ValueError:
        # Runs of about a million blanks exceed the stack of its regular expressions.
        return np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)


def _tokenised(path: str, packs: int, seed: int):
    """Pieces of at most the longest context, with ids, and the pack each one goes to."""
    longest = TIERS[-1]

    def made(batch: pa.RecordBatch, keys: np.ndarray, rows, starts, pieces, totals) -> pa.RecordBatch:
        start = np.array(starts, np.int64)
        with np.errstate(over="ignore"):
            mixed = (keys[rows].view(np.uint64) + start.view(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        pack = ((mixed >> np.uint64(32)) % np.uint64(packs)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(pack), batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(keys[rows]),
             pa.array(start), pa.array(totals, pa.int64()), pa.array(pieces, pa.binary())],
            ["pack", "doc_id", "key", "start", "doc_tokens", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key").to_numpy()
            rows, starts, pieces, totals, held = [], [], [], [], 0
            for i in range(len(batch)):
                own = np.append(token_ids(texts[i].as_py(), path), np.uint32(END_OF_TEXT))
                held += len(own)
                for start in range(0, len(own), longest):
                    rows.append(i)
                    starts.append(start)
                    pieces.append(own[start : start + longest].tobytes())
                    totals.append(len(own))
                if held >= PASS or i + 1 == len(batch):
                    yield made(batch, keys, rows, starts, pieces, totals)
                    rows, starts, pieces, totals, held = [], [], [], [], 0

    return run


def pack_pieces(lengths: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences of the given pieces: (tier, [(piece, from, length), ...]); every token lies in exactly one.

    The last sequence may fall short of its tier.
    """
    longest = TIERS[-1]
    sequences: list[tuple[int, list[tuple[int, int, int]]]] = []
    # Per tier the pieces (length, piece, from) in ascending order; the longest are taken first.
    waiting: dict[int, list[tuple[int, int, int]]] = {tier: [] for tier in TIERS}
    for piece, length in enumerate(lengths):
        waiting[next(t for t in TIERS if length <= t)].append((length, piece, 0))
    for tier in TIERS:
        waiting[tier].sort()

    def best(room: int) -> tuple[int, int, int] | None:
        """The longest waiting piece that fits, from the tier of the room downwards."""
        for t in reversed(TIERS):
            held = waiting[t]
            if held and held[0][0] <= room:
                return held.pop(bisect.bisect_right(held, (room, len(lengths), 0)) - 1)
        return None

    def shortest_above(room: int) -> tuple[int, int, int] | None:
        """A waiting piece to cut: the shortest one that is longer than the room."""
        for t in TIERS:
            held = waiting[t]
            place = bisect.bisect_right(held, (room, len(lengths), longest))
            if place < len(held):
                return held.pop(place)
        return None

    for tier in reversed(TIERS):
        while waiting[tier]:
            length, piece, start = waiting[tier].pop()
            content, room = [(piece, start, length)], tier - length
            while room and (found := best(room)):
                content.append((found[1], found[2], found[0]))
                room -= found[0]
            if room and (tier < longest or room > LEFT_FREE) and (found := shortest_above(room)):
                content.append((found[1], found[2], room))
                rest = found[0] - room
                bisect.insort(waiting[next(t for t in TIERS if rest <= t)], (rest, found[1], found[2] + room))
            sequences.append((tier, content))
    return sequences


def _packed(packs: int):
    """Packs of a stream that is sorted by pack."""
    names = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "tokens",
             "padding", "step_group"]

    def one(rows: pa.Table) -> pa.RecordBatch:
        ids = [np.frombuffer(b, np.uint32) for b in rows.column("ids").to_pylist()]
        starts, pack = rows.column("start").to_numpy(), rows.column("pack")[0].as_py()
        totals = rows.column("doc_tokens").to_numpy()
        sequences = pack_pieces([len(x) for x in ids])
        taken, out = [], [[] for _ in names[1:]]
        dealt = dict.fromkeys(TIERS, 0)
        for number, (tier, content) in enumerate(sequences):
            tokens = sum(length for _, _, length in content)
            whole = tokens & (tokens - 1) == 0
            # As many tokens in every step group, whatever its tier.
            group = dealt[tier] // (STEP * TIERS[-1] // tier)
            dealt[tier] += 1
            offset = 0
            for piece, start, length in content:
                part = ids[piece][start : start + length].tobytes()
                taken.append(piece)
                values = (
                    int(starts[piece]) + start, length, part, zlib.crc32(part), int(totals[piece]),
                    number * packs + pack, offset, tier, tokens, 0 if whole else TIERS[-1] - tokens, group * packs + pack,
                )
                for column, value in zip(out, values):
                    column.append(value)
                offset += length
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(),
                 pa.int64(), pa.int64(), pa.int64()]
        doc_ids = rows.column("doc_id").combine_chunks().take(pa.array(taken, pa.int64()))
        return pa.RecordBatch.from_arrays([doc_ids, *[pa.array(c, k) for c, k in zip(out, kinds)]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            number = held.column("pack").to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(number[1:] != number[:-1]) + 1])
            for start, end in zip(starts[:-1], starts[1:]):
                yield one(held.slice(start, end - start))
            held = held.slice(starts[-1])
        if held is not None:
            yield one(held)

    return run


def pack(docs: DataFrame, vocabulary: str, pack_bytes: int = PACK_BYTES, seed: int = 1) -> DataFrame:
    """Packed pieces of all documents: one row per piece.

    ``docs`` has ``doc_id`` and ``text``; other columns are left out.  A null text is empty: its document is the end
    token alone.  Repeated rows are packed as often as they occur.  ``vocabulary`` is the path of a byte-level
    tokenizer file that all executors have.

    Columns: ``doc_id``, ``start`` (tokens of its document before it), ``length``, ``ids`` (little-endian unsigned
    32-bit), ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` (in the sequence), ``tier``, ``tokens`` and
    ``padding`` (of the sequence) and ``step_group`` (per tier).
    """
    text = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    held = docs.agg(F.sum(F.octet_length("text") + 1), F.count("*")).first()
    packs = max(1, -(-((held[0] or 0) + held[1]) // pack_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = text.mapInArrow(
        _tokenised(vocabulary, packs, seed),
        f"pack long, doc_id {kind}, key long, start long, doc_tokens long, ids binary",
    )
    # Sorted to the last column, so that a pack looks the same whichever executor sends its rows first.
    dealt = pieces.repartition("pack").sortWithinPartitions("pack", "key", "start", "ids")
    return dealt.mapInArrow(
        _packed(packs),
        f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, "
        "offset long, tier int, tokens long, padding long, step_group long",
    )
