"""Chat formatting: reversible escapes, exact masks, whole turns read back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import chat
from brindle.llm.queries import CONTROL_TEXT, tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TURNS = "conv_id long, turn int, role string, text string"
text = st.text(st.sampled_from("a\\<>s/[]INST|endoftx é\n😀"), max_size=40)


@given(st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "x", " ", "s>"]), max_size=12).map("".join) | text)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_hides_controls(raw):
    hidden = chat.escape(raw)
    assert chat.unescape(hidden) == raw
    assert not any(c in hidden for c in chat.CONTROLS)


@given(st.lists(st.tuples(text, text), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_turns_are_parsed_back(turns):
    rendered = chat.BOS + "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert chat.parse(rendered) == turns


@given(st.lists(st.integers(0, 6), max_size=12), st.lists(st.integers(0, 30), max_size=6))
def test_loss_mask_is_overlap(lengths, cuts):
    ends, at = [], 0
    for n in lengths:
        ends.append((at, at + n))
        at += n
    cuts = sorted(set(cuts))
    spans = list(zip(cuts[::2], cuts[1::2], strict=False))
    want = [int(any(max(a, x) < min(b, y) for x, y in spans)) for a, b in ends]
    assert [m for m, (a, b) in zip(chat.loss_mask(spans, ends), ends, strict=True) if a < b] == [w for w, (a, b) in zip(want, ends, strict=True) if a < b]


def brute(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        turns = "".join(f"{r}\n{t}\n" for r, t in own)
        loss = "".join(t for r, t in own if r == "assistant")
        chars = len(chat.BOS) + sum(len(chat.render_turn(r, t)[0]) for r, t in own)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(own), sha(turns), len(loss), sha(loss), chars)
    return out


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello é 😀"), (2, 1, "assistant", None), (2, 0, None, "x"), (3, 0, "assistant", "</s>"), (3, 0, "assistant", "</s>"), (3, 1, "assistant", "\\"),
    (None, 0, "user", "lost"), (None, None, "assistant", "first"), (4, 0, "assistant", ""), (5, 0, "user", CONTROL_TEXT), (5, 1, "assistant", CONTROL_TEXT), (6, 0, "assistant", "�\u0000‍👩‍👧 \r\n end"), (7, 0, "assistant", "<|endoftext|><s>[INST"), (7, 1, "assistant", "]"),
]


def _read(spark, rows, extra=False):
    turns = spark.createDataFrame(rows, TURNS)
    if extra:
        for name in ("chunk", "last", "formatted", "ids", "loss_mask", "key"):
            turns = turns.selectExpr("*", f"'x' AS {name}")
    back = chat.read_back(chat.format_conversations(turns, PATH), PATH).collect()
    assert len(back) == len({r.conv_id for r in back})
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in back}


def test_conversations_equal_brute_force(spark):
    assert _read(spark, ROWS, extra=True) == brute(ROWS)


def test_long_conversation_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 100)
    rows = ROWS + [(8, k, ("user", "assistant")[k % 2], f"turn {k} " * 9) for k in range(60)]
    chunks = chat.format_conversations(spark.createDataFrame(rows, TURNS), PATH)
    assert chunks.filter("conv_id = 8").count() > 10
    assert _read(spark, rows) == brute(rows)


def test_mask_covers_whole_tokens(spark):
    """Decoding all ids gives the rendered text, and the masked ids the assistant's part."""
    chunk = chat.format_conversations(spark.createDataFrame(ROWS[:2], TURNS), PATH).first()
    encoder = chat._tokenizer(PATH)
    assert encoder.decode(chunk.ids, skip_special_tokens=False) == chunk.formatted
    assert encoder.decode([i for i, m in zip(chunk.ids, chunk.loss_mask, strict=True) if m]) == "hello é 😀"


@pytest.mark.parametrize("rows", [[], [(1, 0, None, None)]])
def test_small_tables(spark, rows):
    assert _read(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1, 30, 200])
def test_chunks_have_the_ids_and_mask_of_one_encoding(spark, monkeypatch, size):
    """A long conversation in chunks of whole turns, against rendering and encoding it once; one turn is longer than a chunk."""
    monkeypatch.setattr(chat, "CHUNK_CHARS", size)
    texts = ["Hello  there", "<s> is [INST] text", "", "é 😀" * 9, "a long turn " * 100, "\\ end", "1\n2\n\n3", " lead", "trail "] * 3
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)]
    chunks = sorted(chat.format_conversations(spark.createDataFrame(rows, TURNS), PATH).collect(), key=lambda r: r.chunk)
    assert [r.last for r in chunks] == [False] * (len(chunks) - 1) + [True] and len(chunks) > 1
    rendered, spans = chat.BOS, []
    for _, _, role, t in rows:
        own, a, b = chat.render_turn(role, t)
        if role == "assistant":
            spans.append((len(rendered) + a, len(rendered) + b))
        rendered += own
    whole = chat._tokenizer(PATH).encode(rendered, add_special_tokens=False)
    assert "".join(r.formatted for r in chunks) == rendered
    assert [i for r in chunks for i in r.ids] == whole.ids
    assert [m for r in chunks for m in r.loss_mask] == chat.loss_mask(spans, whole.offsets)
