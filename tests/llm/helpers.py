"""Small tables for the tests of the operators."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns of other tables, under names that operators use inside.
CLASHING = ("key", "anchor", "words", "fp", "norm", "token", "score", "rank", "bucket", "part", "text_sha256", "component", "domain", "length", "host", "_row", "may", "row", "id", "n", "_n", "_sha", "_chars", "_used", "_all", "_keep", "sha", "chars", "keep", "at", "salt", "sid", "mark", "mask", "digest")


def documents(spark, rows, clashing=False):
    """A table of documents from (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(*r, "en", "src0")[:4] if len(r) < 4 else r for r in rows]
    full = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in full]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    if clashing:
        full = [(*r, *["x"] * len(CLASHING)) for r in full]
        names += "".join(f", {c} string" for c in CLASHING)
    return spark.createDataFrame(full, names)


def words(text):
    return WORD.findall(text or "")


def residue(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def sentence(rng: random.Random, n: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Nulls in the text and the id, empty and blank texts, and a text of rare characters.
AWKWARD = [(None, "a row without an id"), (None, None), (900, None), (901, ""), (902, " \t\n\x0b\x0c\r"), (903, " x y\u0085z"), (904, "one")]


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.select(*columns).collect()), key=lambda r: [(v is not None, v) for v in r])
