"""Chat formatting with loss masks aligned by token offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted
spans of its trained turns are intersected with the sorted token spans by
binary search. The template's control strings are special tokens, so no token
crosses the border of a turn; that also lets a very long conversation be
encoded in chunks of whole turns, which gives the same tokens as encoding it in
one piece while memory holds one chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import per_process

#: The template: BOS, then for each turn ROLE role TEXT text END.
BOS, ROLE, TEXT, END = "<s>", "[INST]", "[/INST]", "</s>"
#: Strings that a text may not bring into a rendered conversation. None is part of another or begins inside one.
CONTROLS = (BOS, END, ROLE, TEXT, "<|endoftext|>")
_CONTROL = re.compile("|".join(f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROLS))
#: Characters of rendered text from which a conversation goes on in another chunk.
CHUNK_CHARS = 1_000_000


def escape(text: str) -> str:
    """Backslashes doubled, and a backslash after the first character of every control string."""
    return _CONTROL.sub(r"\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)|\\$", lambda m: "\\" if m[1] == "\\" else m[1] or "", text, flags=re.S)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as it stands in the conversation, and where its text begins and ends there."""
    head, body = ROLE + escape(role) + TEXT, escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The (role, text) of every turn in a rendered chunk."""
    turns = rendered.removeprefix(BOS).split(END)[:-1]
    return [tuple(map(unescape, turn.removeprefix(ROLE).split(TEXT, 1))) for turn in turns]


def loss_mask(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> list[int]:
    """For each token 1 if it overlaps one of the sorted spans, else 0."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    mask = [0] * len(offsets)
    for a, b in spans:
        if a < b:
            low, high = bisect_right(ends, a), bisect_left(starts, b)
            mask[low:high] = [1] * (high - low)
    return mask


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return made


CHUNK_SCHEMA = "conv_id long, chunk long, last boolean, formatted string, ids array<int>, loss_mask array<tinyint>"
_CHUNK_ARROW = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("last", pa.bool_()), ("formatted", pa.large_string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8()))])


def format_conversations(turns: DataFrame, tokenizer: str, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversations rendered, encoded and masked, from rows (conv_id, turn, role, text).

    Returns one row for each chunk of a conversation, in order within its
    partition: conv_id, chunk, last, formatted, ids, loss_mask; all but very
    long conversations have one chunk. Turns go by turn number; rows with equal
    numbers by role and text. A null turn number comes first; null roles and
    texts are empty; rows with a null conv_id are one conversation. Repeated
    rows are turns of their own. An empty table gives no rows. Other columns
    aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("chat", tokenizer), lambda: _tokenizer(tokenizer))
        rows: list[tuple] = []
        key, chunk, parts, spans, size = None, 0, [], [], 0

        def close(last: bool) -> None:
            nonlocal chunk, parts, spans, size
            rendered = "".join(parts)
            coded = encoder.encode(rendered, add_special_tokens=False)
            rows.append((key[0], chunk, last, rendered, coded.ids, loss_mask(spans, coded.offsets)))
            chunk, parts, spans, size = chunk + 1, [], [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _CHUNK_ARROW, strict=True)], schema=_CHUNK_ARROW)
            rows.clear()
            return out

        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if key != (conv_id,):
                    if key:
                        close(True)
                    key, chunk, parts, size = (conv_id,), 0, [BOS], len(BOS)
                elif size >= CHUNK_CHARS:
                    close(False)
                    if sum(len(r[3]) for r in rows) >= CHUNK_CHARS:
                        yield flush()
                rendered, a, b = render_turn(role, text)
                if role in trained:
                    spans.append((size + a, size + b))
                parts.append(rendered)
                size += len(rendered)
            if len(rows) >= 200:
                yield flush()
        if key:
            close(True)
        if rows:
            yield flush()

    blank = F.lit("")
    ordered = (
        turns.select(F.col("conv_id").cast("long"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), F.col("turn"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.select("conv_id", "role", "text").mapInArrow(run, CHUNK_SCHEMA)


def read_back(chunks: DataFrame, tokenizer: str) -> DataFrame:
    """What formatted conversations say, one row for each, from the chunks as they come.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens, n_loss_tokens. The turns are parsed from the rendered text, the
    trained text is decoded from the ids under the mask.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("chat", tokenizer), lambda: _tokenizer(tokenizer))
        state = None
        for batch in batches:
            rows = []
            for conv_id, chunk, last, formatted, ids, mask in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                at = 0
                while at < len(mask):
                    stop = at
                    while stop < len(mask) and mask[stop]:
                        stop += 1
                    if stop > at:
                        text = unescape(encoder.decode(ids[at:stop], skip_special_tokens=False))
                        state[2] += len(text)
                        state[3].update(text.encode())
                    at = stop + 1
                state[4] += len(formatted)
                state[5] += len(ids)
                state[6] += sum(mask)
                if last:
                    rows.append((conv_id, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return chunks.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long")
