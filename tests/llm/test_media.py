"""Lossless WebP: every transform and coding path round-trips."""

import hashlib
import itertools
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import media, webp
from tests.llm.helpers import AWKWARD, documents


def picture(seed, height, width, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        return rng.integers(0, 256, (colours, 4), np.uint8)[rng.integers(0, colours, (height, width))]
    smooth = np.add.outer(np.arange(height), 2 * np.arange(width))[..., None] + rng.integers(0, 9, (height, width, 4))
    return smooth.astype(np.uint8)


def modes(height, width, block, kind):
    rows, columns = -(-height >> block) or 1, -(-width >> block) or 1
    rows, columns = (height + (1 << block) - 1) >> block, (width + (1 << block) - 1) >> block
    return np.full((rows, columns), kind) if isinstance(kind, int) else np.random.default_rng(kind[0]).integers(0, 14, (rows, columns))


@pytest.mark.parametrize("kind", range(14))
def test_predictors(kind):
    px = picture(kind, 9, 11)
    assert (webp.decode(webp.encode(px, ((webp.PREDICTOR, 2, modes(9, 11, 2, kind)),))) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    px = picture(colours, 13, 19, colours)
    assert (webp.decode(webp.encode(px, ((webp.PALETTE,),))) == px).all()


@pytest.mark.parametrize("order", list(itertools.permutations(("predictor", "cross", "green"))))
def test_transforms_in_any_order(order):
    px = picture(5, 21, 18)
    factors = np.random.default_rng(6).integers(0, 256, (3, 3, 4))
    made = {"predictor": (webp.PREDICTOR, 3, modes(21, 18, 3, (1,))), "cross": (webp.CROSS_COLOUR, 3, factors), "green": (webp.SUBTRACT_GREEN,)}
    assert (webp.decode(webp.encode(px, tuple(made[o] for o in order))) == px).all()


@pytest.mark.parametrize("bits", [0, 1, 4, 11])
def test_colour_cache_and_runs(bits):
    px = picture(bits, 20, 30, 6)
    px[3:9] = px[0, 0]
    assert (webp.decode(webp.encode(px, cache_bits=bits)) == px).all()


def test_back_references():
    """Copies from the row above, from far away, and overlapping ones."""
    base = picture(2, 4, 16)
    px = np.concatenate([base, base, base[:1].repeat(3, 0), np.tile(base[:1, :2], (1, 8, 1))])
    argb = 16
    references = [(4 * argb, 64, 64), (9 * argb, 32, 16), (11 * argb + 2, 14, 2)]
    assert (webp.decode(webp.encode(px, references=references)) == px).all()


def test_nearest_places_come_first():
    assert len(webp.NEAR) == 120
    assert webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)]
    assert webp.NEAR[-1] == (8, 7)


@given(st.binary(max_size=3000) | st.text(max_size=400).map(str.encode))
@settings(max_examples=80, deadline=None)
def test_payload_round_trip(data):
    pixels = media.from_media(media.to_media(data))
    payload = pixels.tobytes()
    assert payload[: len(data)] == data and set(payload[len(data) :]) <= {255}
    assert len(payload) == 576 * max(1, -(-len(data) // 576))


def test_optional_reader_agrees():
    """Where another reader of the format is installed, it sees the same pixels."""
    image = pytest.importorskip("PIL.Image")
    import io

    px = picture(1, 40, 30)
    for made in (webp.encode(px), webp.encode(px, ((webp.PREDICTOR, 3, modes(40, 30, 3, (2,))),), cache_bits=5)):
        assert (np.array(image.open(io.BytesIO(made)).convert("RGBA")) == px).all()


@pytest.mark.parametrize("cut", [0, 12, 25, 40])
def test_broken_files_are_refused(cut):
    whole = webp.encode(picture(3, 8, 8))
    with pytest.raises((ValueError, IndexError)):
        webp.decode(whole[:cut])


def test_rows(spark):
    long = "long text é " * 200_000
    rows = AWKWARD + [(1, "x" * 576), (2, "x" * 577), (3, long), (4, "same"), (5, "same"), (5, "same")]
    got = media.read_features(media.store(documents(spark, rows, clashing=True))).collect()
    assert len(got) == len(rows)
    by_text = {}
    for i, t in rows:
        by_text.setdefault((i, len((t or "").encode())), t or "")
    for r in got:
        data = by_text[r.doc_id, r.n_bytes].encode()
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        images = media.to_media(data)
        assert (r.media_bytes, r.media_sha256) == (sum(map(len, images)), hashlib.sha256(b"".join(images)).hexdigest())
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (4, 5)}
    assert len(same) == 1


def test_empty_table(spark):
    assert media.read_features(media.store(documents(spark, []))).collect() == []


def test_stored_images_use_every_coding(monkeypatch):
    """Among stored texts are all transforms, a colour cache and references from further away."""
    used = set()
    plain = webp.encode

    def watched(pixels, transforms=(), cache_bits=0, references=None):
        used.update(t[0] for t in transforms)
        used.update(m for t in transforms if t[0] == webp.PREDICTOR for m in ("mode %d" % k for k in np.unique(t[2])))
        used.update(n for n, on in (("cache", cache_bits), ("far", any(d > 1 for _, _, d in references or ()))) if on)
        return plain(pixels, transforms, cache_bits, references)

    monkeypatch.setattr(webp, "encode", watched)
    rng = random.Random(5)
    for k in range(300):
        line = "".join(rng.choice("abcdefghij klmnop\x00\xff") for _ in range(rng.choice((200, 1500, 4000))))
        data = ((line + line[: rng.randrange(800)] + "=" * rng.randrange(300)) * rng.choice((1, 1, 3))).encode()
        assert media.from_media(media.to_media(data)).tobytes()[: len(data)] == data
    assert used >= {webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE, "cache", "far"}
    assert len([u for u in used if str(u).startswith("mode")]) >= 3


def test_cache_with_back_references():
    """Copied pixels enter the cache, too."""
    base = picture(4, 6, 16, 5)
    px = np.concatenate([base, base, picture(5, 6, 16, 40), base[::-1]])
    assert (webp.decode(webp.encode(px, cache_bits=3, references=[(96, 90, 96)])) == px).all()


def test_large_image():
    """More bits than are decoded at once."""
    px = picture(6, 300, 144)
    px[40:90] = px[0:50]
    for options in ({}, {"cache_bits": 6}, {"references": [(40 * 144, 4096, 40 * 144)]}):
        assert (webp.decode(webp.encode(px, **options)) == px).all()


def bits_of(*fields):
    """A bit stream from (value, bits), the lowest bit first; a string is written as it stands."""
    out = "".join(v if isinstance(v, str) else "".join(str(v >> k & 1) for k in range(n)) for v, n in ((f, 0) if isinstance(f, str) else f for f in fields))
    data = bytes(int(out[k : k + 8].ljust(8, "0")[::-1], 2) for k in range(0, len(out), 8))
    body = bytes([0x2F]) + data
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(body) % 2) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


ONE = lambda v: ((1, 1), (0, 1), (1, 1), (v, 8))  # noqa: E731 a code of one symbol
TWO = lambda v, w: ((1, 1), (1, 1), (1, 1), (v, 8), (w, 8))  # noqa: E731 a code of two symbols, 0 and 1


def test_file_written_by_hand():
    """2 x 2 pixels, green 7 or 9, no transform: written from the format's description, not by the encoder."""
    made = bits_of((1, 14), (1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1), *TWO(7, 9), *ONE(1), *ONE(2), *ONE(255), *ONE(0), "0110")
    assert webp.decode(made).tolist() == [[[1, 7, 2, 255], [1, 9, 2, 255]], [[1, 9, 2, 255], [1, 7, 2, 255]]]


def test_transforms_written_by_hand():
    """Subtract green adds the green to red and blue; predictor mode 2 in one block adds the pixel above."""
    green = bits_of((0, 14), (0, 14), (0, 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1), *ONE(10), *ONE(250), *ONE(3), *ONE(255), *ONE(0))
    assert webp.decode(green).tolist() == [[[4, 10, 13, 255]]]
    modes = ((0, 1), *ONE(2), *ONE(0), *ONE(0), *ONE(255), *ONE(0))
    predicted = bits_of((1, 14), (1, 14), (0, 1), (0, 3), (1, 1), (0, 2), (0, 3), *modes, (0, 1), (0, 1), (0, 1), *TWO(5, 8), *ONE(1), *ONE(2), *ONE(0), *ONE(0), "0111")
    # the first pixel follows black, its right neighbour the left one, the second row what is above
    assert webp.decode(predicted).tolist() == [[[1, 5, 2, 255], [2, 13, 4, 255]], [[2, 13, 4, 255], [3, 21, 6, 255]]]


def test_palette_written_by_hand():
    """Two colours, eight pixels a byte; the second colour is the difference to the first."""
    table = ((0, 1), *TWO(4, 20), *ONE(1), *ONE(1), *ONE(127), *ONE(0), "01")
    made = bits_of((3, 14), (0, 14), (0, 1), (0, 3), (1, 1), (3, 2), (1, 8), *table, (0, 1), (0, 1), (0, 1), *ONE(0b0110), *ONE(0), *ONE(0), *ONE(255), *ONE(0))
    one, two = [1, 4, 1, 127], [2, 24, 2, 254]
    assert webp.decode(made).tolist() == [[one, two, two, one]]


def test_copy_and_cache_written_by_hand():
    """A code of three green symbols: a literal, a copy of one pixel from the left, and a cached pixel."""
    argb = 255 << 24 | 1 << 16 | 7 << 8 | 2
    slot = (0x1E35A7BD * argb & 0xFFFFFFFF) >> 31
    lengths = [0] * 282
    lengths[7], lengths[256], lengths[280 + slot] = 1, 2, 2
    out = webp.Writer()
    webp._write_code(out, np.array(lengths))
    field = (out.field, out.size)
    made = bits_of((3, 14), (0, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1), field, *ONE(1), *ONE(2), *ONE(255), *ONE(1), "0", "10", "11", "0")
    assert webp.decode(made).tolist() == [[[1, 7, 2, 255]] * 4]


def test_images_side_by_side(monkeypatch):
    """Many images are read together, a pixel of each at a time; every coding and size gives what reading each alone does."""
    monkeypatch.setattr(webp, "ABREAST", 4)
    monkeypatch.setattr(webp, "STRETCH", 3)
    monkeypatch.setattr(media, "ABREAST_BYTES", 40_000)
    rng = random.Random(7)
    data = [b"", b"\xff" * 700, b"ab" * 900]
    for _ in range(120):
        line = "".join(rng.choice("abcdefghij klmnop\x00\xff") for _ in range(rng.choice((20, 200, 1500, 4000))))
        data.append(((line + line[: rng.randrange(800)] + "=" * rng.randrange(300)) * rng.choice((1, 1, 3))).encode())
    stored = [media.to_media(d) for d in data]
    got = [p.tobytes() for p in media.many_from_media(stored)]
    assert got == [media.from_media(m).tobytes() for m in stored]
    assert all(g[: len(d)] == d for g, d in zip(got, data, strict=True))
    assert list(media.many_from_media([])) == []


@pytest.mark.parametrize("cut", [30, 300])
def test_one_broken_file_among_many_is_refused(monkeypatch, cut):
    monkeypatch.setattr(webp, "ABREAST", 2)
    whole = [webp.encode(picture(k, 20, 30)) for k in range(6)]
    with pytest.raises((ValueError, IndexError)):
        webp.decode_many([*whole[:3], whole[3][:-cut], *whole[3:]])


def test_a_row_costs_few_calls():
    """Short images are written and read by array operations, and without many calls for each pixel or code word."""
    import sys

    rng = random.Random(3)
    data = [" ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(600)).encode() for _ in range(100)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call" or event == "c_call"

    sys.setprofile(count)
    try:
        pixels = list(media.many_from_media([media.to_media(d) for d in data])) if hasattr(media, "many_from_media") else [media.from_media(media.to_media(d)) for d in data]
    finally:
        sys.setprofile(None)
    assert all(p.tobytes().startswith(d) for p, d in zip(pixels, data, strict=True))
    assert calls < 2500 * len(data)
