"""Lossless WebP: files to pixel arrays and back.

`decode` reads any lossless file: prefix codes, back-references, colour cache,
meta prefix codes, and the predictor, cross-colour, subtract-green and palette
transforms. Where one group of codes serves the whole image, the symbols that
would begin at each bit are looked up at once with array operations, and the
image is the chain from the first bit on, which is walked in strides; other files
are read symbol by symbol. Of many such files `decode_many` takes a pixel of each
at a time, until few are left. Pixels are written at once, too, each as one number
of all its code words.
Pixels are arrays (height, width, 4) of RGBA bytes.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
#: Fixed values of the format.
SIGNATURE, MAX_SIDE = 0x2F, 1 << 14
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
N_LITERAL, N_LENGTH, N_DISTANCE = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: The 120 near places of distance codes, by their distance.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
#: Pixels from which a run is written as a back-reference, and its greatest length.
LEAST_RUN, MOST_RUN = 8, 4096
#: Bits that are decoded at once, more than any symbol with its extra bits takes, and doublings of the stride in which their chain is walked.
WINDOW_BITS, SLACK, DOUBLINGS = 1 << 17, 128, 2
#: Images that are read side by side, at least, and pixels of each until their ends are looked at.
ABREAST, STRETCH = 64, 64


class Bits:
    """Reads a bit stream, the lowest bit of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end, self._all = data, 0, 8 * len(data), None

    def read(self, n: int) -> int:
        if not n:
            return 0
        first, shift = self.at >> 3, self.at & 7
        self.at += n
        if self.at > self.end:
            raise ValueError("the image data ends early")
        return (int.from_bytes(self.data[first : first + 4 + (n > 24)], "little") >> shift) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """The next n bits, zeros beyond the end, without moving on."""
        return (int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 3], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def unpacked(self) -> np.ndarray:
        if self._all is None:
            self._all = np.unpackbits(np.frombuffer(self.data, np.uint8), bitorder="little")
        return self._all

    def ahead(self, n: int, width: int) -> np.ndarray:
        """At each of the next n bits and more the number that it and those after it make, `width` in all, the first one highest."""
        first, shift = self.at >> 3, self.at & 7
        raw = np.frombuffer(self.data[first : first + (n + shift >> 3) + 4].ljust((n + shift >> 3) + 4, b"\0"), np.uint8)
        flipped = FLIPPED[raw]
        three = flipped[:-2] << 16 | flipped[1:-1] << 8 | flipped[2:]
        return (three[:, None] >> (24 - width - np.arange(8)) & ((1 << width) - 1)).ravel()[shift:]


#: The bits of each byte in the other order.
FLIPPED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 8)[:, ::-1]).astype(np.int64)


class Code:
    """A canonical prefix code. `table` has (symbol << 4 | length) by the next `longest` bits, the first one highest."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths)
        used = np.flatnonzero(lengths)
        if not len(used):
            used, lengths = np.array([0]), np.array([1])
        self.symbols = used[np.argsort(lengths[used], kind="stable")]
        own = lengths[self.symbols]
        self.longest = int(own[-1]) if len(own) > 1 else 0
        if self.longest and (1 << self.longest >> own).sum() != 1 << self.longest:
            raise ValueError("an incomplete prefix code")
        self.table = (np.repeat(self.symbols << 4 | own, 1 << self.longest >> own) if self.longest else self.symbols << 4).astype(np.int64)
        self._flipped: list[int] | None = None

    def flipped(self) -> list[int]:
        """The table by the next bits, the first one lowest."""
        if self._flipped is None:
            places = np.zeros(1, np.int64)
            for _ in range(self.longest):
                places = np.concatenate([2 * places, 2 * places + 1])
            self._flipped = self.table[places].tolist()
        return self._flipped

    def read(self, bits: Bits) -> int:
        if not self.longest:
            return int(self.symbols[0])
        found = self.flipped()[bits.peek(self.longest)]
        bits.at += found & 15
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
        return found >> 4


#: By alphabet size: codes read lately, as (bits, number that they make, code). Files of one kind of content share codes.
_LATELY: dict[int, list[tuple[int, int, Code]]] = {}


def _read_code(bits: Bits, size: int) -> Code:
    lately, shift = _LATELY.setdefault(size, []), bits.at & 7
    ahead = int.from_bytes(bits.data[bits.at >> 3 : (bits.at >> 3) + 128], "little") >> shift
    for k, (n, number, code) in enumerate(lately):
        if ahead & ((1 << n) - 1) == number and bits.at + n <= bits.end:
            bits.at += n
            if k:
                lately.insert(0, lately.pop(k))
            return code
    start = bits.at
    code = _parse_code(bits, size)
    n = bits.at - start
    if n <= 1000:
        lately.insert(0, (n, ahead & ((1 << n) - 1), code))
        del lately[16:]
    return code


def _parse_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    own, n = np.zeros(19, np.int64), 4 + bits.read(4)
    three = bits.read(24) | bits.read(max(3 * n - 24, 0)) << 24 if n >= 8 else bits.read(3 * n)
    for k in range(n):
        own[LENGTH_ORDER[k]] = three >> 3 * k & 7
    code = _code(own.tobytes())
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    # all that is left of the code as one number: no symbol takes more than 14 bits
    start, most = bits.at >> 3, size * 14 // 8 + 2
    ahead = int.from_bytes(bits.data[start : start + most], "little") >> (bits.at & 7)
    table, mask, found, before, taken = code.flipped(), (1 << code.longest) - 1, [], 8, 0
    low = ahead & _LOW  # a part of it at a time, as short numbers are quicker
    used = 0
    while len(found) < size and left:
        left -= 1
        if used > _LOW_BITS - 14:
            ahead >>= used
            low, used, taken = ahead & _LOW, 0, taken + used
        n = table[low >> used & mask]
        used += n & 15
        n >>= 4
        if n < 16:
            found.append(n)
            before = n or before
        else:
            extra, least = ((2, 3), (3, 3), (7, 11))[n - 16]
            found += [before if n == 16 else 0] * (least + (low >> used & ((1 << extra) - 1)))
            used += extra
    bits.at += taken + used
    if bits.at > bits.end or len(found) > size:
        raise ValueError("the image data ends early")
    lengths[: len(found)] = found
    return _code(lengths.tobytes())


#: Bits of a code that are read from one short number.
_LOW_BITS = 60
_LOW = (1 << _LOW_BITS) - 1


@lru_cache(4096)
def _code(packed: bytes) -> Code:
    return Code(np.frombuffer(packed, np.int64))


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _extended(raw: np.ndarray, at: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances from prefix symbols and the extra bits at `at`, and where those end."""
    extra = np.where(symbols < 4, 0, (symbols - 2) >> 1)
    value = np.where(symbols < 4, symbols, (2 + (symbols & 1)) << extra)
    for k in range(int(extra.max(initial=0))):
        value += np.where(k < extra, raw[at + k].astype(np.int64) << k, 0)
    return value + 1, at + extra


def _chain(after: np.ndarray, most: int) -> np.ndarray:
    """The first `most` places of the chain from place 0, each followed by the one that `after` has for it, as far as they lie in the array."""
    n = len(after)
    hops = [np.append(np.minimum(after, n), n)]
    for _ in range(DOUBLINGS):
        hops.append(hops[-1].take(hops[-1]))
    far, walked, here = hops.pop().item, [], 0
    for _ in range(-(-most >> DOUBLINGS)):
        if here >= n:
            break
        walked.append(here)
        here = far(here)
    places = np.array(walked, np.int64)
    for hop in reversed(hops):
        places = np.stack([places, hop.take(places)], 1).ravel()
    places = places[:most]
    return places[places < n]


def _operations(bits: Bits, codes: list[Code], total: int) -> np.ndarray:
    """The symbols of an image as columns: green or other symbol, red, blue, alpha, pixels that it makes, distance code."""
    most = max(c.longest for c in codes)
    tables = [(c.table, most - c.longest) for c in codes]
    special = codes[0].symbols.max() >= N_LITERAL
    most_bits = sum(c.longest for c in codes) + SLACK * bool(special)  # of a pixel or other symbol
    found, left = [], total
    while left:
        n = min(WINDOW_BITS, bits.end - bits.at, left * most_bits)
        ahead = bits.ahead(n + SLACK, most)
        word = tables[0][0].take(ahead >> tables[0][1])
        lengths = {id(codes[0]): word & 15}  # by code: how long its word is that begins at each bit
        after = np.arange(n) + lengths[id(codes[0])][:n]  # where the next symbol begins
        for code, (table, shift) in zip(codes[1:4], tables[1:4], strict=True):
            if id(code) not in lengths:
                lengths[id(code)] = (table & 15).take(ahead >> shift)
            after += lengths[id(code)].take(after)
        if special:
            sizes, distances = np.ones(n, np.int64), np.zeros(n, np.int64)
            other = np.flatnonzero(word[:n] >= N_LITERAL << 4)
            after[other], symbol = other + (word[other] & 15), (word[other] >> 4) - N_LITERAL
            copies = symbol < N_LENGTH
            own = other[copies]
            if len(own):
                raw = bits.unpacked()[bits.at : bits.at + n + SLACK]
                raw = np.concatenate([raw, np.zeros(n + SLACK - len(raw), np.uint8)])
                sizes[own], at = _extended(raw, after[own], symbol[copies])
                word = tables[4][0].take(ahead[at] >> tables[4][1])
                distances[own], after[own] = _extended(raw, at + (word & 15), word >> 4)
        starts = _chain(after, left)
        if not len(starts):
            raise ValueError("the image data ends early")
        if special:
            ends = np.cumsum(sizes[starts])
            if ends[-1] > left:
                last = int(np.searchsorted(ends, left))
                if ends[last] != left:
                    raise ValueError("a back-reference outside the image")
                starts = starts[: last + 1]
        mine, place = np.empty((6, len(starts)), np.int64), starts
        for k, (table, shift) in enumerate(tables[:4]):
            word = table[ahead[place] >> shift]
            mine[k], place = word >> 4, place + (word & 15)
        mine[4], mine[5] = (sizes[starts], distances[starts]) if special else (1, 0)
        found.append(mine)
        left -= int(mine[4].sum())
        bits.at += int(after[starts[-1]])
        if bits.at > bits.end:
            raise ValueError("the image data ends early")
    return found[0] if len(found) == 1 else np.concatenate(found, 1)


def _abreast(jobs: list[tuple[Bits, list[Code], int]]) -> list[np.ndarray]:
    """As `_operations` of each (bits, codes, total): a symbol of every image at a time, and the last few images one by one."""
    totals = np.array([total for _, _, total in jobs])
    firsts = np.cumsum(totals) - totals
    sizes = np.array([len(bits.data) + 4 for bits, _, _ in jobs])
    bounds = 8 * (np.cumsum(sizes) - sizes)
    joined = b"".join(part for bits, _, _ in jobs for part in (bits.data, b"\0" * 4)) + b"\0" * (STRETCH * (SLACK + 60) // 8)
    flipped = FLIPPED.astype(np.int32)[np.frombuffer(joined, np.uint8)]
    three = flipped[:-2] << 16 | flipped[1:-1] << 8 | flipped[2:]
    at, tables, places = 1, [np.zeros(1, np.int64)], {}  # place 0 is an empty symbol
    for _, codes, _ in jobs:
        for code in codes[:4]:
            if id(code) not in places:
                places[id(code)] = at
                tables.append(code.table)
                at += len(code.table)
    table = np.concatenate(tables)
    base = np.array([[places[id(c)] for c in codes[:4]] for _, codes, _ in jobs]).T
    longest = np.array([[c.longest for c in codes[:4]] for _, codes, _ in jobs]).T
    drop, mask = 24 - longest, (1 << longest) - 1
    live, left, place, ends = np.arange(len(jobs)), totals.copy(), firsts.copy(), bounds + np.array([bits.end for bits, _, _ in jobs])
    pos = bounds + np.array([bits.at for bits, _, _ in jobs])
    found, copies = np.zeros(int(totals.sum()), np.int64), [[] for _ in jobs]
    until = [0] * len(jobs)  # where the operations of each end
    step = 0
    while len(live) >= ABREAST:
        word = table.take(base[0] + (three.take(pos >> 3) >> drop[0] - (pos & 7) & mask[0]))
        pos += word & 15
        made, own_base, own_mask = word >> 4, base, mask
        if word.max() >= N_LITERAL << 4:
            other = made >= N_LITERAL
            own_base, own_mask = np.where(other, 0, base), np.where(other, 0, mask)
            for k in np.flatnonzero(other & (made < N_LITERAL + N_LENGTH)).tolist():
                job = int(live[k])
                bits, codes, _ = jobs[job]
                bits.at = int(pos[k] - bounds[job])
                size = _prefixed(bits, int(made[k]) - N_LITERAL)
                copies[job].append((int(place[k] - firsts[job]), size, _prefixed(bits, codes[4].read(bits))))
                pos[k] = bits.at + bounds[job]
                left[k] -= size - 1
        for k in (1, 2, 3):
            word = table.take(own_base[k] + (three.take(pos >> 3) >> drop[k] - (pos & 7) & own_mask[k]))
            pos += word & 15
            made = made << 8 | word >> 4
        found[place] = made
        place += 1
        left -= 1
        step += 1
        least = left.min()
        if least <= 0 or step % STRETCH == 0:
            if least < 0:
                raise ValueError("a back-reference outside the image")
            if (pos > ends[live]).any():
                raise ValueError("the image data ends early")
            if least == 0:
                for k in np.flatnonzero(left == 0).tolist():
                    until[live[k]] = int(place[k])
                go = np.flatnonzero(left)
                live, left, place, pos, base, drop, mask = live[go], left[go], place[go], pos[go], base[:, go], drop[:, go], mask[:, go]
    rest = {}
    for job, n, end, here in zip(live.tolist(), left.tolist(), place.tolist(), pos.tolist(), strict=True):
        bits, codes, _ = jobs[job]
        bits.at, until[job] = here - int(bounds[job]), end
        rest[job] = _operations(bits, codes, n)
    out = []
    for job, (first, end) in enumerate(zip(firsts.tolist(), until, strict=True)):
        own = found[first:end]
        mine = np.stack([own >> 24, own >> 16 & 0xFF, own >> 8 & 0xFF, own & 0xFF, np.ones_like(own), np.zeros_like(own)])
        for k, size, distance in copies[job]:
            mine[4, k], mine[5, k] = size, distance
        out.append(np.concatenate([mine, rest[job]], 1) if job in rest else mine)
    return out


def _distance(code: int, width: int) -> int:
    return code - len(NEAR) if code > len(NEAR) else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)


def _slots(argb: np.ndarray, cache_bits: int) -> np.ndarray:
    return ((argb.astype(np.uint64) * np.uint64(CACHE_FACTOR)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - cache_bits)


def _pixels(operations: np.ndarray, total: int, width: int, cache_bits: int) -> np.ndarray:
    """What the operations make, as ARGB numbers."""
    green, red, blue, alpha, size, code = operations
    values = (alpha << 24 | red << 16 | green << 8 | blue).astype(np.uint32)
    if green.max(initial=0) < N_LITERAL:
        return values
    is_copy, is_cached = (green >= N_LITERAL) & (green < N_LITERAL + N_LENGTH), green >= N_LITERAL + N_LENGTH
    starts = np.cumsum(size) - size
    copies = [(a, n, _distance(d, width)) for a, n, d in zip(starts[is_copy].tolist(), size[is_copy].tolist(), code[is_copy].tolist(), strict=True)]
    if any(d > a for a, _, d in copies):
        raise ValueError("a back-reference outside the image")
    if not copies and not is_cached.any():
        return values
    if not copies:  # a cached pixel is the last one before with its slot
        slots = np.where(is_cached, green - N_LITERAL - N_LENGTH, _slots(values, cache_bits).astype(np.int64))
        order = np.argsort(slots, kind="stable")
        place = np.arange(total)
        group = np.maximum.accumulate(np.where(np.diff(slots[order], prepend=-1) != 0, place, 0))
        source = np.maximum.accumulate(np.where(is_cached[order], -1, place))
        values[order] = np.where(source >= group, values[order][np.maximum(source, 0)], 0)
        return values
    out = np.zeros(total, np.uint32)
    if not is_cached.any():
        out[starts[~is_copy]] = values[~is_copy]
        for a, n, d in copies:
            out[a : a + n] = np.resize(out[a - d : a], n)
        return out
    pixels, cache = [], {}
    following = iter(copies)
    for value, symbol, cached, copied in zip(values.tolist(), (green - N_LITERAL - N_LENGTH).tolist(), is_cached.tolist(), is_copy.tolist(), strict=True):
        if copied:
            _, n, d = next(following)
            for _ in range(n):
                pixels.append(pixels[-d])
                cache[((CACHE_FACTOR * pixels[-1]) & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[-1]
        else:
            value = cache.get(symbol, 0) if cached else value
            pixels.append(value)
            cache[((CACHE_FACTOR * value) & 0xFFFFFFFF) >> (32 - cache_bits)] = value
    return np.array(pixels, np.uint32)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as a row of ARGB numbers."""
    found = _begun(bits, width, height, main)
    if isinstance(found, np.ndarray):
        return found
    codes, cache_bits = found
    return _pixels(_operations(bits, codes, width * height), width * height, width, cache_bits)


def _begun(bits: Bits, width: int, height: int, main: bool) -> np.ndarray | tuple[list[Code], int]:
    """As `_read_image`, but if one group of codes serves the image and there is more than one colour, just the codes and the bits of the cache."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    groups, meta, block = 1, None, 0
    if main and bits.read(1):
        block = bits.read(3) + 2
        columns = (width + (1 << block) - 1) >> block
        meta = ((_read_image(bits, columns, (height + (1 << block) - 1) >> block, False) >> 8) & 0xFFFF).astype(np.int64)
        groups = int(meta.max()) + 1
    sizes = (N_LITERAL + N_LENGTH + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCE)
    codes = [[_read_code(bits, s) for s in sizes] for _ in range(groups)]
    total = width * height
    if groups == 1 and (codes[0][0].longest or codes[0][0].symbols[0] < N_LITERAL):
        own = codes[0]
        if not any(c.longest for c in own[:4]):
            green, red, blue, alpha = (int(c.symbols[0]) for c in own[:4])
            return np.full(total, alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
        return own, cache_bits
    rows, made = [], 0
    while made < total:
        group = codes[0] if meta is None else codes[meta[(made // width >> block) * columns + (made % width >> block)]]
        symbol = group[0].read(bits)
        if symbol < N_LITERAL:
            rows.append((symbol, *(group[k].read(bits) for k in (1, 2, 3)), 1, 0))
        elif symbol < N_LITERAL + N_LENGTH:
            rows.append((symbol, 0, 0, 0, _prefixed(bits, symbol - N_LITERAL), _prefixed(bits, group[4].read(bits))))
        else:
            rows.append((symbol, 0, 0, 0, 1, 0))
        made += rows[-1][4]
    if made > total:
        raise ValueError("a back-reference outside the image")
    return _pixels(np.array(rows, np.int64).T, total, width, cache_bits)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(…, 4) in the order A, R, G, B."""
    return np.stack([(argb >> s) & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _joined(channels: np.ndarray) -> np.ndarray:
    c = channels.astype(np.uint32) & 0xFF
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


#: The pixel before the first, as A, R, G, B.
BLACK = np.array([255, 0, 0, 0])


def _mean(a, b):
    return (a + b) >> 1


def _guess(mode: int, left: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """The predictions of a mode from arrays of neighbours, channels last."""
    if mode == 11:
        guess = left + top - top_left
        return np.where(abs(guess - left).sum(-1, keepdims=True) < abs(guess - top).sum(-1, keepdims=True), left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        middle = _mean(left, top)
        apart = middle - top_left
        return np.clip(middle + np.where(apart < 0, -(-apart >> 1), apart >> 1), 0, 255)
    simple = {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left, 5: lambda: _mean(_mean(left, top_right), top), 6: lambda: _mean(left, top_left),
        7: lambda: _mean(left, top), 8: lambda: _mean(top_left, top), 9: lambda: _mean(top, top_right), 10: lambda: _mean(_mean(left, top_left), _mean(top, top_right)),
    }
    return simple[mode]() if mode in simple else np.broadcast_to(BLACK, top.shape)


def _neighbours(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Left, top, top right and top left of every pixel below the first row and right of the first column."""
    return pixels[1:, :-1], pixels[:-1, 1:], np.concatenate([pixels[:-1, 2:], pixels[1:, :1]], 1), pixels[:-1, :-1]


def _spread(table: np.ndarray, block: int, height: int, width: int) -> np.ndarray:
    """A block's value for each of its pixels."""
    return np.repeat(np.repeat(table, 1 << block, 0), 1 << block, 1)[:height, :width]


def differences(pixels: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """What the predictor transform stores."""
    height, width, _ = pixels.shape
    out = pixels.copy()
    out[0] -= np.concatenate([BLACK[None], pixels[0, :-1]])
    out[1:, 0] -= pixels[:-1, 0]
    around, inner, own = _neighbours(pixels), out[1:, 1:], _spread(modes, block, height, width)[1:, 1:]
    for mode in np.unique(own).tolist():
        at = own == mode
        inner[at] -= _guess(mode, *(a[at] for a in around))
    return out & 0xFF


def best_modes(argb: np.ndarray, block: int) -> np.ndarray:
    """For each block the mode with the smallest differences."""
    height, width, _ = argb.shape
    rows, columns = (height - 1 >> block) + 1, (width - 1 >> block) + 1
    around, inner = _neighbours(argb), argb[1:, 1:]
    place = (_spread(np.arange(rows * columns).reshape(rows, columns), block, height, width)[1:, 1:]).ravel()
    costs = [np.bincount(place, abs(_signed(inner - _guess(m, *around))).sum(-1).ravel(), rows * columns) for m in range(14)]
    return np.argmin(costs, 0).reshape(rows, columns)


def _restored(differences: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """The pixels from what the predictor transform stores, row by row; within a row a block at once where its mode allows."""
    height, width, _ = differences.shape
    out = np.empty_like(differences)
    out[0] = (np.cumsum(differences[0], 0) + BLACK) & 0xFF
    edges = [1, *range(1 << block, width, 1 << block), width]
    for y in range(1, height):
        row, above, own = out[y], out[y - 1], modes[y >> block].tolist()
        row[0] = (differences[y, 0] + above[0]) & 0xFF
        right = np.concatenate([above[1:], row[:1]])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a >= b:
                continue
            mode, delta = own[a >> block], differences[y, a:b]
            if mode == 1:
                row[a:b] = (np.cumsum(delta, 0) + row[a - 1]) & 0xFF
            elif mode in LEFT_MODES:
                row[a:b] = _sequential(mode, row[a - 1], delta, above[a:b], right[a:b], above[a - 1 : b - 1])
            else:
                row[a:b] = (delta + _guess(mode, above[a:b], above[a:b], right[a:b], above[a - 1 : b - 1])) & 0xFF
    return out


#: Modes that mix the left pixel with others.
LEFT_MODES = frozenset((5, 6, 7, 10, 11, 12, 13))


def _clipped(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _gradient(l: int, t: int, c: int) -> int:
    middle = (l + t) >> 1
    apart = middle - c
    return _clipped(middle + (apart >> 1 if apart >= 0 else -(-apart >> 1)))


def _sequential(mode: int, left: np.ndarray, delta: np.ndarray, top: np.ndarray, top_right: np.ndarray, top_left: np.ndarray) -> np.ndarray:
    """Pixels of a stretch whose mode needs each one before the next."""
    if mode in (5, 6, 7, 10):
        return _means(mode, int(_joined(left)), *(_joined(x).tolist() for x in (delta, top, top_right, top_left)))
    out, left = [], left.tolist()
    for d, t, c in zip(delta.tolist(), top.tolist(), top_left.tolist(), strict=True):
        if mode == 11:  # the guess left + top - top left is as far from left as top is from top left
            use = left if sum(abs(u - k) for u, k in zip(t, c, strict=True)) < sum(abs(l - k) for l, k in zip(left, c, strict=True)) else t
            left = [(x + g) & 255 for x, g in zip(d, use, strict=True)]
        elif mode == 12:
            left = [(x + _clipped(l + u - k)) & 255 for l, x, u, k in zip(left, d, t, c, strict=True)]
        else:
            left = [(x + _gradient(l, u, k)) & 255 for l, x, u, k in zip(left, d, t, c, strict=True)]
        out.append(left)
    return np.array(out)


def _means(mode: int, left: int, delta: list[int], top: list[int], top_right: list[int], top_left: list[int]) -> np.ndarray:
    """The modes of means, with all channels of a pixel in one number: bytes are halved and added side by side."""
    mean = lambda a, b: ((a ^ b) >> 1 & 0x7F7F7F7F) + (a & b)
    other = {5: zip(top_right, top, strict=True), 6: zip(top_left, top_left, strict=True), 7: zip(top, top, strict=True), 10: zip(top_left, map(mean, top, top_right), strict=True)}[mode]
    twice, out = mode in (5, 10), []
    for d, (a, b) in zip(delta, other, strict=True):
        guess = ((left ^ a) >> 1 & 0x7F7F7F7F) + (left & a)
        if twice:
            guess = ((guess ^ b) >> 1 & 0x7F7F7F7F) + (guess & b)
        left = ((d & 0xFF00FF) + (guess & 0xFF00FF) & 0xFF00FF) | ((d & 0xFF00FF00) + (guess & 0xFF00FF00) & 0xFF00FF00)
        out.append(left)
    return _channels(np.array(out, np.int64))


def _signed(a: np.ndarray) -> np.ndarray:
    return ((a & 0xFF) ^ 0x80) - 0x80


def _cross_colour(pixels: np.ndarray, factors: np.ndarray, block: int, forward: bool) -> np.ndarray:
    """Red and blue by the factors (A, red to blue, green to blue, green to red) of each block."""
    height, width, _ = pixels.shape
    own = _spread(factors, block, height, width)
    out, sign = pixels.copy(), -1 if forward else 1
    delta = lambda f, c: (_signed(f) * _signed(c)) >> 5
    red = (pixels[..., 1] + sign * delta(own[..., 3], pixels[..., 2])) & 0xFF
    out[..., 1] = red
    out[..., 3] = (pixels[..., 3] + sign * (delta(own[..., 2], pixels[..., 2]) + delta(own[..., 1], pixels[..., 1] if forward else red))) & 0xFF
    return out


def _packing(colours: int) -> int:
    """How many times pixels of a palette are halved in width, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file."""
    bits, full_width, width, height, transforms = _opened(data)
    return _restored_pixels(_read_image(bits, width, height, True), full_width, width, height, transforms)


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of lossless WebP files."""
    opened = [_opened(data) for data in files]
    found = [_begun(bits, width, height, True) for bits, _, width, height, _ in opened]
    jobs = [k for k, f in enumerate(found) if isinstance(f, tuple)]
    made = _abreast([(opened[k][0], found[k][0], opened[k][2] * opened[k][3]) for k in jobs])
    for k, operations in zip(jobs, made, strict=True):
        _, _, width, height, _ = opened[k]
        found[k] = _pixels(operations, width * height, width, found[k][1])
    return [_restored_pixels(argb, *rest) for argb, (_, *rest) in zip(found, opened, strict=True)]


def _opened(data: bytes) -> tuple[Bits, int, int, int, list[tuple]]:
    """The bits of a file, at the main image, its width, the width and height of the main image, and the transforms."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20] != SIGNATURE:
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", data[16:20])[0]
    bits = Bits(data[21 : 20 + size])
    full_width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    transforms, width = [], full_width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            columns, rows = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            transforms.append((kind, block, _channels(_read_image(bits, columns, rows, False).reshape(rows, columns))))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            table = np.cumsum(_channels(_read_image(bits, colours, 1, False)), axis=0) & 0xFF
            transforms.append((kind, width, table))
            width = (width + (1 << _packing(colours)) - 1) >> _packing(colours)
        else:
            transforms.append((kind, 0, None))
    return bits, full_width, width, height, transforms


def _restored_pixels(argb: np.ndarray, full_width: int, width: int, height: int, transforms: list[tuple]) -> np.ndarray:
    """The RGBA pixels from those of the main image, by the transforms backwards."""
    argb = argb.reshape(height, width)
    for kind, block, extra in reversed(transforms):
        if kind == PREDICTOR:
            argb = _joined(_restored(_channels(argb), extra[..., 2], block))
        elif kind == CROSS_COLOUR:
            argb = _joined(_cross_colour(_channels(argb), extra, block, False))
        elif kind == SUBTRACT_GREEN:
            argb = (argb & _GREEN_ALPHA) | ((argb & _RED_BLUE) + (argb >> 8 & 0xFF) * _TWICE & _RED_BLUE)
        else:
            halvings = _packing(len(extra))
            each = 8 >> halvings
            places = (argb >> 8 & 0xFF).astype(np.int64)[..., None] >> (np.arange(1 << halvings) * each) & ((1 << each) - 1)
            index = places.reshape(height, -1)[:, :block]
            argb = np.concatenate([_joined(extra), np.zeros(256 - len(extra), np.uint32)])[index]
    return _swapped(argb).astype("<u4").view(np.uint8).reshape(height, full_width, 4)


#: Bytes of an ARGB number: green and alpha, red and blue, and a byte in both places of the latter.
_GREEN_ALPHA, _RED_BLUE, _TWICE = np.uint32(0xFF00FF00), np.uint32(0xFF00FF), np.uint32(0x10001)


def _swapped(numbers: np.ndarray) -> np.ndarray:
    """ARGB numbers from those of RGBA bytes, the first one lowest, and the other way round."""
    return (numbers & _GREEN_ALPHA) | (numbers & 0xFF) << 16 | numbers >> 16 & 0xFF


class Writer:
    """Collects a bit stream in a number."""

    def __init__(self):
        self.field = self.size = 0

    def number(self, value: int, n: int) -> None:
        self.field |= value << self.size
        self.size += n

    def numbers(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Many numbers (uint64) of up to 63 bits, put together in words of 64."""
        ends = np.cumsum(sizes)
        n = int(ends[-1]) if len(ends) else 0
        if not n:
            return
        at = ends - sizes
        place, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.concatenate([[0], (place[1:] != place[:-1]).nonzero()[0] + 1])
        packed, place = np.zeros((n >> 6) + 2, np.uint64), place[first]
        packed[place] = np.bitwise_or.reduceat(values << shift, first)
        packed[place + 1] |= np.bitwise_or.reduceat(values >> np.uint64(1) >> np.uint64(63) - shift, first)
        self.number(int.from_bytes(packed.astype("<u8").tobytes(), "little"), n)

    def bytes(self) -> bytes:
        return self.field.to_bytes(-(-self.size // 8), "little")


def huffman_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal code, made flatter until none exceeds `limit`; 1 for a lone symbol."""
    counts = np.asarray(counts, np.int64)
    lengths, used = np.zeros(len(counts), np.int64), np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    while True:
        # the smallest two are the next of the sorted symbols or of the sums, which are made in order
        order = np.argsort(counts[used], kind="stable")
        leaves, sums, parents, i, k = [*counts[used[order]].tolist(), 1 << 62], [1 << 62] * n, [0] * (2 * n - 1), 0, 0
        for made in range(n - 1):
            if leaves[i] <= sums[k]:
                both, parents[i] = leaves[i], made
                i += 1
            else:
                both, parents[n + k] = sums[k], made
                k += 1
            if leaves[i] <= sums[k]:
                both += leaves[i]
                parents[i] = made
                i += 1
            else:
                both += sums[k]
                parents[n + k] = made
                k += 1
            sums[made] = both
        depth = [0] * (n - 1)
        for i in range(n - 3, -1, -1):
            depth[i] = depth[parents[n + i]] + 1
        found = np.array(depth)[parents[:n]] + 1
        if found.max() <= limit:
            lengths[used[order]] = found
            return lengths
        counts = np.where(counts > 0, counts // 2 + 1, 0)


#: How many words of 15 bits begin with a code word of each length, and all those words with the first bit lowest.
_SPANS = 1 << 15 - np.arange(16)
_WORDS = ((FLIPPED[np.arange(1 << 15) & 0xFF] << 8 | FLIPPED[np.arange(1 << 15) >> 8]) >> 1).astype(np.uint64)


def stream_words(lengths: np.ndarray) -> np.ndarray:
    """The code word of each symbol as a number whose lowest bit comes first."""
    words, used = np.zeros(len(lengths), np.uint64), lengths.nonzero()[0]
    order = used[lengths[used].argsort(kind="stable")]
    spans = _SPANS[lengths[order]]
    words[order] = _WORDS[spans.cumsum() - spans]
    return words


#: Tokens of code lengths: the lengths 0 to 15, 3 to 6 times the last one, 3 to 10 and 11 to 138 zeros. Of each its symbol, its extra value and the bits of that.
_TOKEN_SYMBOLS = np.concatenate([np.arange(16), np.repeat([16, 17, 18], [4, 8, 128])])
_TOKEN_EXTRA = np.concatenate([np.zeros(16, np.int64), np.arange(4), np.arange(8), np.arange(128)]).astype(np.uint64)
_TOKEN_BITS = np.repeat([0, 2, 3, 7], [16, 4, 8, 128])


def _length_tokens(lengths: np.ndarray) -> list[int]:
    """Code lengths as tokens."""
    out = []
    edges = np.concatenate([[0], (lengths[1:] != lengths[:-1]).nonzero()[0] + 1, [len(lengths)]])
    for value, times in zip(lengths[edges[:-1]].tolist(), (edges[1:] - edges[:-1]).tolist(), strict=True):
        if times == 1:
            out.append(value)
            continue
        if value:
            out.append(value)
            times -= 1
        while times >= 3:
            if value:
                n = min(times, 6)
                out.append(16 + n - 3)
            elif times >= 11:
                n = min(times, 138)
                out.append(28 + n - 11)
            else:
                n = times
                out.append(20 + n - 3)
            times -= n
        if times:
            out += [value] * times
    return out


@lru_cache(4096)
def _code_field(packed: bytes) -> tuple[int, int, np.ndarray]:
    """A code as it is written (number, bits), and the lengths that its symbols take in the stream."""
    lengths, out = np.frombuffer(packed, np.int64), Writer()
    used = np.flatnonzero(lengths)
    if len(used) <= 1 and (not len(used) or used[0] < 256):
        out.number(1 | (1 << 2), 3)
        out.number(int(used[0]) if len(used) else 0, 8)
        return out.field, out.size, np.zeros(len(lengths), np.int64)
    if len(used) == 1:
        lengths = lengths.copy()
        lengths[0] = lengths[used[0]] = 1
    tokens = np.array(_length_tokens(lengths))
    symbols = _TOKEN_SYMBOLS[tokens]
    own = huffman_lengths(np.bincount(symbols, minlength=19), 7)
    words, sizes = stream_words(own), own.tolist()
    out.number(0, 1)
    out.number(15, 4)
    out.number(sum(sizes[k] << 3 * i for i, k in enumerate(LENGTH_ORDER)), 3 * len(sizes))
    out.number(0, 1)
    if (own > 0).sum() < 2:
        own, words = np.zeros_like(own), np.zeros_like(words)
    own = own[symbols]
    out.numbers(words[symbols] | _TOKEN_EXTRA[tokens] << own.astype(np.uint64), own + _TOKEN_BITS[tokens])
    return out.field, out.size, lengths


def _write_code(out: Writer, lengths: np.ndarray) -> np.ndarray:
    """Write a code; returns the lengths that its symbols take in the stream."""
    field, size, sizes = _code_field(lengths.tobytes())
    out.number(field, size)
    return sizes


def _prefix_of(value: int) -> tuple[int, int, int]:
    """The prefix symbol of a length or distance, its extra value and extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    high = v.bit_length() - 1
    extra = high - 1
    return 2 * high + ((v >> extra) & 1), v & ((1 << extra) - 1), extra


def _runs(argb: np.ndarray) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance) to the pixel before, for runs of one colour."""
    edge = np.concatenate([[0], np.flatnonzero(argb[1:] != argb[:-1]) + 1, [len(argb)]])
    long = np.flatnonzero(np.diff(edge) > LEAST_RUN)
    out = []
    for k in long.tolist():
        at, end = int(edge[k]) + 1, int(edge[k + 1])
        while end - at >= LEAST_RUN:
            n = min(end - at, MOST_RUN)
            out.append((at, n, 1))
            at += n
    return out


def _write_image(out: Writer, argb: np.ndarray, width: int, main: bool, references: list[tuple[int, int, int]], cache_bits: int = 0) -> None:
    """An entropy-coded image with one group of codes, in which all channels have one alphabet: that makes a code, not four, to be written and read."""
    copied, symbols = np.zeros(len(argb), bool), argb >> 8 & 0xFF  # of green, or of a cached pixel
    for start, n, _ in references:
        copied[start : start + n] = True
    literal = ~copied
    if cache_bits:  # a pixel that is the last one before with its slot
        slots = _slots(argb, cache_bits).astype(np.int64)
        order = np.argsort(slots, kind="stable")
        hit = order[1:][(slots[order[1:]] == slots[order[:-1]]) & (argb[order[1:]] == argb[order[:-1]])]
        hit = hit[literal[hit]]
        literal[hit] = False
        symbols = symbols.astype(np.int64)
        symbols[hit] = N_LITERAL + N_LENGTH + slots[hit]
    shared = np.bincount(argb[literal].view(np.uint8), minlength=N_LITERAL)
    special = np.zeros(N_LENGTH + (1 << cache_bits if cache_bits else 0), np.int64)
    if cache_bits:
        special += np.bincount(symbols[hit] - N_LITERAL, minlength=len(special))
    near, far = _near(width), np.zeros(N_DISTANCE, np.int64)
    coded = [(_prefix_of(n), _prefix_of(near.get(d, d + len(NEAR)))) for _, n, d in references]
    for length, distance in coded:
        special[length[0]] += 1
        far[distance[0]] += 1
    out.number(cache_bits << 1 | 1, 5) if cache_bits else out.number(0, 1)
    if main:
        out.number(0, 1)
    own = huffman_lengths(shared, 15)
    first = huffman_lengths(np.concatenate([shared, special]), 15) if special.any() else np.concatenate([own, special])
    sizes = [_write_code(out, lengths) for lengths in (first, own, own, own, huffman_lengths(far, 15))]
    of_green, of_others = sizes[0], sizes[1]
    other_words = stream_words(of_others)
    green_words = stream_words(of_green) if special.any() else other_words
    distances = (stream_words(sizes[4]), sizes[4])
    words, sizes = green_words[symbols], of_green[symbols]
    for shift in (16, 0, 24):
        channel = argb >> shift & 0xFF
        own_words, own_sizes = other_words[channel], of_others[channel]
        if cache_bits:
            own_words[hit], own_sizes[hit] = 0, 0
        words |= own_words << sizes.astype(np.uint64)
        sizes += own_sizes
    if references:
        starts = [start for start, _, _ in references]
        for start, pair in zip(starts, coded, strict=True):
            value = size = 0
            for (symbol, extra, bits), (of, each), base in zip(pair, ((green_words, of_green), distances), (N_LITERAL, 0), strict=True):
                value |= int(of[base + symbol]) << size
                size += int(each[base + symbol])
                value |= extra << size
                size += bits
            words[start], sizes[start] = value, size
        kept = ~copied
        kept[starts] = True
        words, sizes = words[kept], sizes[kept]
    out.numbers(words, sizes)


@lru_cache
def _near(width: int) -> dict[int, int]:
    """The distance code of each near place in an image of this width."""
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width > 0}


def encode(pixels: np.ndarray, transforms: tuple = (), cache_bits: int = 0, references: list[tuple[int, int, int]] | None = None) -> bytes:
    """A lossless WebP file of RGBA pixels.

    `transforms` may list (PREDICTOR, block, modes), (CROSS_COLOUR, block,
    factors), (SUBTRACT_GREEN,) and (PALETTE,), applied in that order.
    `cache_bits` is the size of a colour cache. `references` are back-references
    (start, length, distance) in order; by default runs of one colour are.
    """
    height, width, _ = pixels.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("a side of the image is out of range")
    out = Writer()
    out.number(width - 1, 14)
    out.number(height - 1, 14)
    out.number(1, 1)
    out.number(0, 3)
    argb = _swapped(np.ascontiguousarray(pixels).view("<u4")[..., 0])
    for kind, *rest in transforms:
        out.number(1 | kind << 1, 3)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block, table = rest
            out.number(block - 2, 3)
            full = np.zeros((*table.shape[:2], 4), np.int64)
            if kind == PREDICTOR:
                full[..., 2] = table
                argb = _joined(differences(_channels(argb), table, block))
            else:
                full = table
                argb = _joined(_cross_colour(_channels(argb), table, block, True))
            _write_image(out, _joined(full).ravel(), full.shape[1], False, [])
        elif kind == SUBTRACT_GREEN:
            argb = (argb & _GREEN_ALPHA) | ((argb & _RED_BLUE) + np.uint32(0x1000100) - (argb >> 8 & 0xFF) * _TWICE & _RED_BLUE)
        else:
            colours, index = np.unique(argb, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.number(len(colours) - 1, 8)
            _write_image(out, _joined(np.diff(_channels(colours), axis=0, prepend=0)), len(colours), False, [])
            index, halvings = index.reshape(height, width), _packing(len(colours))
            index = np.pad(index, ((0, 0), (0, -width % (1 << halvings)))).reshape(height, -1, 1 << halvings)
            argb = (0xFF000000 | (index << (np.arange(1 << halvings) * (8 >> halvings))).sum(-1) << 8).astype(np.uint32)
            width = argb.shape[1]
    out.number(0, 1)
    argb = argb.ravel()
    _write_image(out, argb, width, True, _runs(argb) if references is None else references, cache_bits)
    body = bytes([SIGNATURE]) + out.bytes()
    padded = body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(padded)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + padded
