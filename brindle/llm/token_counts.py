"""Token counts of whole texts.

Texts are encoded in batches inside Arrow functions, and only lengths leave
them. A batch holds about the same number of bytes, whatever the number of its
texts; a long text is split where no token can span the cut, so that neither
one text nor one batch needs much memory, and its parts' counts are added up.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import per_process, slices, split_words

#: Bytes that are encoded together.
BATCH_BYTES = 1_000_000
#: Bytes of texts whose distinct parts are collected at once.
SLICE_BYTES = 4_000_000
#: Characters after which a text is split at the next safe boundary.
PART_CHARS = 200_000


def safe_boundary(tokenizer) -> re.Pattern | None:
    """Where a text may be split without changing its tokens, or None if that isn't known for this tokenizer.

    That is before white space and before an ASCII digit, if the
    pre-tokenizer's pattern drops white space and takes digits one by one, as
    the vocabulary of word pieces does: every pre-token ends there, neither
    normalisation nor lower-casing reaches across, and no special string has
    either in it.
    """
    import json

    spec = json.loads(tokenizer.to_str())
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    split = steps[0] if steps and steps[0].get("type") == "Split" else {}
    pattern = (split.get("pattern") or {}).get("Regex", "")
    drops_space = split.get("behavior") == "Removed" and split.get("invert") and r"[^\s\p{L}\p{N}]+" in pattern and r"|[\p{N}]|" in pattern
    normalizer = spec.get("normalizer") or {}
    known = {n.get("type") for n in normalizer.get("normalizers", [normalizer])} <= {"NFC", "Replace", "Lowercase", None}
    plain = not any(re.search(r"[\s0-9]", t["content"]) or t["single_word"] for t in spec.get("added_tokens", []))
    return re.compile(r"(?=[ \t-\r0-9])") if drops_space and known and plain else None


def parts(text: str, boundary: re.Pattern | None, chars: int = PART_CHARS) -> Iterator[str]:
    """A text in parts of `chars` characters or more, each up to the next safe boundary; whole if there is none."""
    at = 0
    while boundary is not None and len(text) - at > chars:
        found = boundary.search(text, at + chars)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Counter:
    """Counts of tokens by the tokenizer file's own library: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.boundary: re.Pattern | None = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode: Callable[[list[str]], list] = lambda texts: model.encode(texts, num_threads=1)
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.boundary = safe_boundary(tokenizer)
            self.encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        else:
            raise ValueError(f"not a tokenizer file: {path}")

    def lengths(self, texts: pa.Array, batch_bytes: int = BATCH_BYTES, chars: int = PART_CHARS) -> np.ndarray:
        """The number of tokens of each text, encoded in batches of about `batch_bytes`."""
        out, waiting, rows, size = np.zeros(len(texts), np.int64), [], [], 0

        def flush() -> None:
            nonlocal size
            if waiting:
                np.add.at(out, rows, np.fromiter(map(len, self.encode(waiting)), np.int64, len(waiting)))
            waiting.clear()
            rows.clear()
            size = 0

        for row, text in enumerate(texts):  # one value at a time becomes a Python string
            text = text.as_py()
            if not text:
                continue
            for part in parts(text, self.boundary, chars):
                waiting.append(part)
                rows.append(row)
                size += len(part) if part.isascii() else len(part.encode())
                if size >= batch_bytes:
                    flush()
        flush()
        return out

    def counts(self, texts: pa.Array, batch_bytes: int = BATCH_BYTES, chars: int = PART_CHARS) -> np.ndarray:
        """The number of tokens of each text; a null is empty.

        Where white space is a safe boundary, texts are split at all of it,
        each distinct part is encoded once, and its length is added up wherever it occurs.
        """
        if self.boundary is None:
            return self.lengths(texts, batch_bytes, chars)
        numbers, distinct, bounds = split_words(texts)
        sums = np.concatenate([[0], np.cumsum(self.lengths(distinct, batch_bytes, chars)[numbers])])
        return np.diff(sums[bounds])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, batch_bytes: int = BATCH_BYTES, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens) of every row.

    No token is added at the begin or end, and nothing is cut off or filled up.
    Special strings inside a text are what the library makes of them by
    default. Null and empty texts have no tokens; a null id stays null,
    repeated rows are counted each, an empty table gives no rows, and other
    columns are left out. A stretch without a safe boundary is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("Counter", tokenizer), lambda: Counter(tokenizer))
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            texts = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            n = counter.counts(texts, batch_bytes, part_chars)
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
