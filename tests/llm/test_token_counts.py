"""Token counts against the tokenizers' own on whole texts."""

import random

import pytest

from brindle.llm import token_counts
from brindle.llm.queries import tokenizer_path
from tests.llm.helpers import AWKWARD, documents, rows_of

PIECES = ["word", "It's", "we'll", "Ümläut", "naïve", "東京。", "12", "3a4", "<|endoftext|>", "<|startoftext|>", "é", "İ", "ΣΑΣ", "…", "'s", "' s", " ", " ", "🙂", "http://x.y/z?q=1&r=22"]


def texts(n=60, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(200))) for _ in range(n)]


def own_counts(name, rows):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        return [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in rows]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [len(tokenizer.encode(t or "", add_special_tokens=False)) for t in rows]


@pytest.mark.parametrize(("name", "chars"), [("word_bpe_49k.json", 200_000), ("word_bpe_49k.json", 7), ("byte_bpe_50k.json", 7), ("piece_bpe_32k.model", 7)])
def test_equals_the_library_on_whole_texts(spark, name, chars):
    rows = [*enumerate(texts()), *AWKWARD, (905, "x" * 5000), (906, "<|endoftext|>"), (907, "a<|endoftext|>" * 40)]
    got = token_counts.count_tokens(documents(spark, rows, clashing=True).repartition(3), tokenizer_path(name), limit=100, batch_bytes=300, part_chars=chars)
    want = [(i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(rows, own_counts(name, [t for _, t in rows]), strict=True)]
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=lambda r: [(v is not None, v) for v in r])


def test_only_known_tokenizers_are_split():
    assert token_counts.Counter(tokenizer_path("word_bpe_49k.json")).boundary is not None
    assert token_counts.Counter(tokenizer_path("byte_bpe_50k.json")).boundary is None
    with pytest.raises(ValueError, match="not a tokenizer"):
        token_counts.Counter("x.txt")


def test_long_text_without_a_boundary_is_one_part():
    boundary = token_counts.Counter(tokenizer_path("word_bpe_49k.json")).boundary
    assert list(token_counts.parts("x" * 100, boundary, 7)) == ["x" * 100]
    cut = list(token_counts.parts("ab cd 12 e", boundary, 4))
    assert "".join(cut) == "ab cd 12 e" and len(cut) > 1


def test_empty_table(spark):
    assert token_counts.count_tokens(documents(spark, []).limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0
