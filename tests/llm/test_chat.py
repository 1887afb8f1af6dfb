"""Chat formatting: exact round trips."""

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from roadtrace.llm.chat import (
    CONTROL,
    PARTS,
    PLACEHOLDER,
    Flattener,
    conversation_digests,
    escape,
    format_conversations,
    format_message,
    read_message,
    unescape,
)
from pyspark.sql import functions as F
from pyspark.sql import types as T

pieces = st.lists(st.sampled_from(["<", "[", "\\", "|", "s>", "/s>", "INST]", "/INST]", "<|end|>", "a", "\n", "é"])).map("".join)


@given(pieces)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    made = escape(text)
    assert unescape(made) == text
    assert all(m[2] for m in CONTROL.finditer(made))
    assert not PLACEHOLDER.search(made)


@given(pieces, pieces)
def test_message_reads_back(role, text):
    formatted, low, high = format_message(role, [{"kind": "text", "text": text}], Flattener())
    assert read_message(formatted) == (role, text)
    assert unescape(formatted[low:high]) == text


def test_parts_become_placeholders_in_order(spark):
    parts = [
        {"kind": "image", "uri": "i.png", "width": 57, "height": 28},
        {"kind": "text", "text": " then <|image:0|> "},
        {"kind": "audio", "uri": "a.wav", "seconds": 1.5},
        {"kind": "document", "uri": "d.pdf", "pages": 2},
        {"kind": "other", "text": "end"},
        None,
    ]
    schema = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                           T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
                           T.StructField("parts", PARTS), T.StructField("start", T.StringType())])
    row = format_conversations(spark.createDataFrame([(1, 0, "assistant", "see ", parts, "clash")], schema)).first()
    content = row.formatted[row.loss_start : row.loss_end]
    assert content == "see <|image:0|> then <\\|image:0|> <|audio:1|><|document:2|>end"
    assert [(a.number, a.kind, a.uri, a.tokens) for a in row.attachments] == [
        (0, "image", "i.png", 3), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 2048)]
    for a in row.attachments:
        assert content[a.start :].startswith(f"<|{a.kind}:{a.number}|>")
    assert row.attachment_tokens == 3 + 38 + 2048


def test_digests_against_plain_hashing(spark):
    rows = [
        (1, 1, "assistant", "b"), (1, 0, "user", "</s>[INST] a [/INST]"), (1, 1, "assistant", "b"), (1, None, None, None),
        (2, 0, "assistant", None), (None, 0, "user", "x"), (None, 1, "assistant", "y" * 300_000), (3, 0, "user", ""),
    ]
    found = {r.conv_id: r for r in conversation_digests(format_conversations(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit(1)))).collect()}
    assert set(found) == {1, 2, 3, None}
    for conv in found:
        said = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in said)
        loss = "".join(r[3] or "" for r in said if r[2] == "assistant")
        row = found[conv]
        assert row.n_turns == len(said) and row.loss_chars == len(loss)
        assert row.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_digests(format_conversations(empty)).count() == 0
