"""Packing: every token once, full sequences, ids as the tokenizer gives them."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roadtrace.llm.packing import END_OF_TEXT, LEFT_FREE, STEP, TIERS, pack, pack_pieces, token_ids
from roadtrace.llm.queries import vocabulary

TOKENIZER = Tokenizer.from_file(vocabulary())
SCHEMA = "doc_id long, text string, pack string, key long"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "  ", "\n", "'s", "don't", "Ünïcode", "²", "١٢", " ", "漢字", "!?", "_", "12", "'", "\x1c", "é", "×"])).map("".join))
def test_ids_are_the_tokenizers(text):
    assert token_ids(text, vocabulary()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "a", " ", "\n", "12", "é", "<"])).map("".join))
def test_ids_of_special_strings_are_the_tokenizers(text):
    assert token_ids(text, vocabulary()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 1_000_000, "\n" * 1_000_000, " \t\n" * 400_000])
@pytest.mark.parametrize("text", ["{}", "a b{}c d", "a<|endoftext|>{}b <|endoftext|>"])
def test_ids_of_long_runs_of_blanks_are_the_tokenizers(run, text):
    text = text.format(run)
    assert token_ids(text, vocabulary()).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_special_strings_and_long_runs_are_packed(spark):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "a" + " " * 1_000_001 + "b"]
    rows = pack(spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA), vocabulary()).collect()
    for i, text in enumerate(texts):
        expected = [*TOKENIZER.encode(text, add_special_tokens=False).ids, END_OF_TEXT]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert {r.doc_tokens for r in own} == {len(expected)}
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == expected


@given(st.lists(st.integers(1, 2048), max_size=120))
def test_pieces_are_cut_and_packed_without_loss(lengths):
    sequences = pack_pieces(lengths)
    parts = defaultdict(list)
    short = 0
    for tier, content in sequences:
        total = sum(length for *_, length in content)
        assert 0 < total <= tier
        short += total < tier - (LEFT_FREE if tier == TIERS[-1] else 0)
        for piece, start, length in content:
            parts[piece].append((start, length))
    assert short <= 1
    for piece, length in enumerate(lengths):
        at = 0
        for start, size in sorted(parts[piece]):
            assert start == at and size > 0
            at += size
        assert at == length


def _docs():
    r = random.Random(6)
    words = "the of and reading thenter über été 12 3.5 — don't".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice((1, 20, 300, 900, 4000)))), "clash", 1) for i in range(60)]
    return docs + [(100, None, None, None), (101, "", None, None), (None, "x y", None, None), (102, "same", "", 1), (102, "same", "", 1)]


@pytest.mark.parametrize("pack_bytes", [8_000_000, 40_000])
def test_every_token_lies_in_one_piece(spark, pack_bytes):
    docs = _docs()
    rows = pack(spark.createDataFrame(docs, SCHEMA), vocabulary(), pack_bytes).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    padding = 0
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == members[0].tokens <= 2048
        padding += members[0].padding
        assert members[0].padding == (0 if at & (at - 1) == 0 else 2048 - at)
    texts = {doc_id: text for doc_id, text, *_ in docs}
    for doc_id, text in texts.items():
        expected = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, END_OF_TEXT]
        copies = 2 if doc_id == 102 else 1
        assert sum(r.length for r in pieces[doc_id]) == copies * len(expected)
        assert {r.doc_tokens for r in pieces[doc_id]} == {len(expected)}
        if copies == 1:
            joined = b"".join(r.ids for r in sorted(pieces[doc_id], key=lambda r: r.start))
            assert np.frombuffer(joined, "<u4").tolist() == expected
    packs = 1 if pack_bytes > 1_000_000 else len({r.sequence_id % 40 for r in rows})
    assert padding <= packs * 2048 + LEFT_FREE * len(sequences)


def test_step_groups_hold_as_many_tokens(spark):
    rows = pack(spark.createDataFrame(_docs() * 6, SCHEMA), vocabulary()).collect()
    seen = {(r.tier, r.step_group, r.sequence_id) for r in rows}
    for tier in TIERS:
        groups = defaultdict(int)
        for t, group, _ in seen:
            if t == tier:
                groups[group] += 1
        full = STEP * TIERS[-1] // tier
        assert all(n <= full for n in groups.values()) and sum(n < full for n in groups.values()) <= 1


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0
