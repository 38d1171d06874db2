"""Lossless WebP: a decoder of the whole format and an encoder that can use all of it.

decode() reads prefix codes (simple, normal, and several groups by tile),
back-references, the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Streams whose literals all have 8-bit
codes and nothing else, as `encode_plain` writes them, are decoded as one
array operation; all others pixel by pixel. Tables of images are written and
read side by side in `webp_batch`.

Pixels are uint8 arrays of (height, width, 4), in the order red, green, blue,
alpha. Inside, a pixel is one integer, alpha << 24 | red << 16 | green << 8 | blue.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_FACTOR = 0x1E35A7BD
MAX_SIDE = 1 << 14
PREDICTOR, CROSS_COLOR, SUBTRACT_GREEN, PALETTE = range(4)

REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1)[:, 0]


class BadImage(ValueError):
    """The bytes are not a lossless WebP image."""


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


# ---------------------------------------------------------------- reading


class _Bits:
    """Bits of a stream, the lowest of each byte first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)
        self.word, self.word_at, self.word_end = 0, 0, 0

    def peek(self, n: int) -> int:
        if self.at < self.word_at or self.at + n > self.word_end:
            first = self.at >> 3
            self.word = int.from_bytes(self.data[first : first + 64], "little")  # zeros behind the end
            self.word_at, self.word_end = first << 3, (first + 64) << 3
        return (self.word >> (self.at - self.word_at)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data):
            raise BadImage("the stream ends too early")
        return value


class _Code:
    """A prefix code from its lengths; its table is built when first needed."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        used = [s for s, n in enumerate(lengths) if n]
        self.only = used[0] if len(used) == 1 else None
        if not used:
            self.only = 0
        self.table: list[tuple[int, int]] | None = None

    def uniform_bytes(self) -> bool:
        return self.lengths[:256] == _EIGHTS and not any(self.lengths[256:])

    def _build(self) -> None:
        self.bits = max(self.lengths)
        self.table = [(0, 0)] * (1 << self.bits)
        filled = 0
        for symbol, code, n in canonical(self.lengths):
            low = int(f"{code:0{n}b}"[::-1], 2)
            for at in range(low, 1 << self.bits, 1 << n):
                self.table[at] = (symbol, n)
                filled += 1
        if filled != 1 << self.bits:
            raise BadImage("an incomplete prefix code")

    def read(self, bits: _Bits) -> int:
        if self.only is not None:
            return self.only
        if self.table is None:
            self._build()
        symbol, n = self.table[bits.peek(self.bits)]
        bits.at += n
        if bits.at > bits.end:
            raise BadImage("the stream ends too early")
        return symbol


_EIGHTS = [8] * 256


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of the canonical code."""
    out, code, last = [], 0, 0
    for n, symbol in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        if code >> n:
            raise BadImage("an overfull prefix code")
        out.append((symbol, code, n))
        code, last = code + 1, n
    return out


def _read_code(bits: _Bits, size: int) -> _Code:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        for s in symbols:
            if s >= size:
                raise BadImage("a symbol outside its alphabet")
            lengths[s] = 1
        return _Code(lengths)
    of = [0] * 19
    for place in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        of[place] = bits.read(3)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    if left > size:
        raise BadImage("too many code lengths")
    code = _Code(of)
    if code.only is not None and code.only < 16:
        lengths[:left] = [code.only] * left
        return _Code(lengths)
    at, previous = 0, 8
    while left and at < size:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[at] = n
            previous, at = n or previous, at + 1
            continue
        times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
        if at + times > size:
            raise BadImage("a run outside its alphabet")
        if n == 16:
            lengths[at : at + times] = [previous] * times
        at += times
    return _Code(lengths)


def _prefixed(bits: _Bits, p: int) -> int:
    if p < 4:
        return p + 1
    extra = (p - 2) >> 1
    return ((2 + (p & 1)) << extra) + bits.read(extra) + 1


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(1, x + y * width)


def _read_image(bits: _Bits, width: int, height: int, main: bool):
    """The pixels of an entropy-coded image: a list of integers, or the (n, 4) bytes of a plain one."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise BadImage("too large a colour cache")
    tile, tiles, groups = 0, None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        tiles = [p >> 8 & 0xFFFF for p in _read_image(bits, _up(width, tile), _up(height, tile), False)]
        groups = max(tiles) + 1
    cached = 1 << cache_bits if cache_bits else 0
    codes = [[_read_code(bits, n) for n in (280 + cached, 256, 256, 256, 40)] for _ in range(groups)]
    count = width * height
    if main and groups == 1 and not cached and all(c.uniform_bytes() for c in codes[0][:4]):
        return _plain(bits, count)
    across = _up(width, tile) if tile else 0
    cache, out = [0] * cached, []
    shift = 32 - cache_bits
    while len(out) < count:
        at = len(out)
        green, red, blue, alpha, far = codes[tiles[(at // width >> tile) * across + (at % width >> tile)] if tiles else 0]
        s = green.read(bits)
        if s < 256:
            r, b = red.read(bits), blue.read(bits)
            new = [alpha.read(bits) << 24 | r << 16 | s << 8 | b]
        elif s < 280:
            length = _prefixed(bits, s - 256)
            back = _distance(_prefixed(bits, far.read(bits)), width)
            if back > at or at + length > count:
                raise BadImage("a reference outside the image")
            for i in range(length):
                out.append(out[at + i - back])
            new = []
            if cached:
                for p in out[at:]:
                    cache[(CACHE_FACTOR * p & 0xFFFFFFFF) >> shift] = p
        else:
            new = [cache[s - 280]]
        if new:
            out += new
            if cached:
                cache[(CACHE_FACTOR * new[0] & 0xFFFFFFFF) >> shift] = new[0]
    return out


def _plain(bits: _Bits, count: int) -> np.ndarray:
    """count pixels of four 8-bit codes each, as they stand in the stream."""
    first, s = bits.at >> 3, bits.at & 7
    raw = np.frombuffer(bits.data, np.uint8)[first : first + 4 * count + (1 if s else 0)]
    if len(raw) < 4 * count + (1 if s else 0):
        raise BadImage("the stream ends too early")
    bits.at += 32 * count
    if s:
        raw = (raw[:-1] >> s) | (raw[1:] << (8 - s))
    return REVERSED[raw].reshape(-1, 4)[:, [1, 0, 2, 3]]


# ---------------------------------------------------------------- transforms


def _add(a: int, b: int) -> int:
    """Sum of each of four bytes."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _sub(a: int, b: int) -> int:
    return (0x00FF00FF + (a & 0xFF00FF00) - (b & 0xFF00FF00) & 0xFF00FF00) | (0xFF00FF00 + (a & 0x00FF00FF) - (b & 0x00FF00FF) & 0x00FF00FF)


def _mean(a: int, b: int) -> int:
    return (a & b) + ((a ^ b) >> 1 & 0x7F7F7F7F)


_SHIFTS = (24, 16, 8, 0)


def _each(f, *pixels: int) -> int:
    return sum(min(255, max(0, f(*[p >> s & 255 for p in pixels]))) << s for s in _SHIFTS)


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs((top >> s & 255) - (corner >> s & 255)) for s in _SHIFTS)
    to_top = sum(abs((left >> s & 255) - (corner >> s & 255)) for s in _SHIFTS)
    return left if to_left < to_top else top


BLACK = 0xFF000000
#: By mode: a prediction from left, top, top right and top left.
PREDICT = [
    lambda L, T, R, C: BLACK,
    lambda L, T, R, C: L,
    lambda L, T, R, C: T,
    lambda L, T, R, C: R,
    lambda L, T, R, C: C,
    lambda L, T, R, C: _mean(_mean(L, R), T),
    lambda L, T, R, C: _mean(L, C),
    lambda L, T, R, C: _mean(L, T),
    lambda L, T, R, C: _mean(C, T),
    lambda L, T, R, C: _mean(T, R),
    lambda L, T, R, C: _mean(_mean(L, C), _mean(T, R)),
    lambda L, T, R, C: _select(L, T, C),
    lambda L, T, R, C: _each(lambda a, b, c: a + b - c, L, T, C),
    lambda L, T, R, C: _each(lambda a, c: a + int((a - c) / 2), _mean(L, T), C),
    lambda L, T, R, C: BLACK,
    lambda L, T, R, C: BLACK,
]


def _predicted(pixels: list[int], width: int, modes: list[int], tile: int, at: int) -> int:
    """The prediction of a pixel from those before it."""
    x, y = at % width, at // width
    if not y:
        return pixels[at - 1] if x else BLACK
    if not x:
        return pixels[at - width]
    mode = modes[(y >> tile) * _up(width, tile) + (x >> tile)] >> 8 & 15
    return PREDICT[mode](pixels[at - 1], pixels[at - width], pixels[at - width + 1], pixels[at - width - 1])


def _signed(b: int) -> int:
    return b - 256 if b > 127 else b


def _crossed(pixel: int, element: int, sign: int) -> int:
    """A pixel with the shares of green and red taken from (sign -1) or given back to (1) red and blue."""
    green, red, blue = pixel >> 8 & 255, pixel >> 16 & 255, pixel & 255
    delta = lambda t, c: (_signed(t & 255) * _signed(c)) >> 5
    new_red = red + sign * delta(element, green) & 255
    blue += sign * (delta(element >> 8, green) + delta(element >> 16, new_red if sign > 0 else red))
    return pixel & 0xFF00FF00 | new_red << 16 | blue & 255


def _cross_all(pixels: list[int], width: int, elements: list[int], tile: int, sign: int) -> list[int]:
    across = _up(width, tile)
    return [_crossed(p, elements[(i // width >> tile) * across + (i % width >> tile)], sign) for i, p in enumerate(pixels)]


def _green_all(pixels: list[int], sign: int) -> list[int]:
    out = []
    for p in pixels:
        g = p >> 8 & 255
        out.append(p & 0xFF00FF00 | ((p >> 16) + sign * g & 255) << 16 | (p + sign * g & 255))
    return out


def _bundle_bits(colors: int) -> int:
    """log2 of how many palette indices share a pixel."""
    return 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0


def _unbundle(pixels: list[int], width: int, packed_width: int, palette: list[int]) -> list[int]:
    bits = _bundle_bits(len(palette))
    per, mask, out = 1 << bits, (1 << (8 >> bits)) - 1, []
    for row in range(0, len(pixels), packed_width):
        for x in range(width):
            i = pixels[row + (x >> bits)] >> 8 + (x & per - 1) * (8 >> bits) & mask
            out.append(palette[i] if i < len(palette) else 0)
    return out


# ---------------------------------------------------------------- decoding


def _chunk(data: bytes) -> bytes:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise BadImage("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise BadImage("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file; BadImage for anything else."""
    bits = _Bits(_chunk(data))
    if bits.read(8) != 0x2F:
        raise BadImage("no signature")
    width, height, _, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise BadImage("an unknown version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise BadImage("a transform that comes twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOR):
            tile = bits.read(3) + 2
            undo.append((kind, now, tile, _read_image(bits, _up(now, tile), _up(height, tile), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, now, 0, None))
        else:
            colors = _read_image(bits, bits.read(8) + 1, 1, False)
            for i in range(1, len(colors)):
                colors[i] = _add(colors[i], colors[i - 1])
            undo.append((kind, now, 0, colors))
            now = _up(now, _bundle_bits(len(colors)))
    pixels = _read_image(bits, now, height, True)
    if isinstance(pixels, np.ndarray):
        if not undo:
            return pixels.reshape(height, width, 4)
        p = pixels.astype(np.uint32)
        pixels = (p[:, 3] << 24 | p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2]).tolist()
    for kind, before, tile, extra in reversed(undo):
        if kind == PREDICTOR:
            for i in range(len(pixels)):
                pixels[i] = _add(pixels[i], _predicted(pixels, before, extra, tile, i))
        elif kind == CROSS_COLOR:
            pixels = _cross_all(pixels, before, extra, tile, 1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green_all(pixels, 1)
        else:
            pixels = _unbundle(pixels, before, now, extra)
        now = before
    p = np.array(pixels, np.uint32)
    return np.stack([p >> 16, p >> 8, p, p >> 24], axis=1).astype(np.uint8).reshape(height, width, 4)


# ---------------------------------------------------------------- writing


class _Out:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def code(self, code: tuple[int, int]) -> None:
        value, n = code
        self.put(int(f"{value:0{n}b}"[::-1], 2) if n else 0, n)

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _lengths(counts: Counter, size: int) -> list[int]:
    """Code lengths of at most 15 for the counted symbols."""
    out, flat = [0] * size, dict(counts)
    while True:
        heap = [(n, s, (s,)) for s, n in flat.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(flat, 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                depth[s] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(depth.values(), default=0) <= 15:
            for s, n in depth.items():
                out[s] = max(n, 1)
            return out
        flat = {s: (n + 1) // 2 for s, n in flat.items()}


def _put_code(out: _Out, lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Writes a code; (code, length) by symbol."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        first = used[0] if used else 0
        out.put(1, 1), out.put(int(len(used) == 2), 1), out.put(1, 1), out.put(first, 8)
        if len(used) == 2:
            out.put(used[1], 8)
            return {used[0]: (0, 1), used[1]: (1, 1)}
        return {first: (0, 0)}
    of = [4] * 13 + [5] * 6  # 13/16 + 6/32: a complete code of the 19 kinds of lengths
    kinds = {s: (c, n) for s, c, n in canonical(of)}
    out.put(0, 1), out.put(15, 4)
    for place in CODE_LENGTH_ORDER:
        out.put(of[place], 3)
    out.put(0, 1)
    at, previous = 0, 8
    while at < len(lengths):
        n, run = lengths[at], 1
        while at + run < len(lengths) and lengths[at + run] == n:
            run += 1
        if n == 0 and run >= 11:
            run = min(run, 138)
            out.code(kinds[18]), out.put(run - 11, 7)
        elif n == 0 and run >= 3:
            run = min(run, 10)
            out.code(kinds[17]), out.put(run - 3, 3)
        elif n == previous and run >= 3:
            run = min(run, 6)
            out.code(kinds[16]), out.put(run - 3, 2)
        else:
            run = 1
            out.code(kinds[n])
            previous = n or previous
        at += run
    if len(used) == 1:
        return {used[0]: (0, 0)}
    return {s: (c, n) for s, c, n in canonical(lengths)}


def _prefix_of(value: int) -> tuple[int, int, int]:
    """(prefix, extra bits, their value) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    top = v.bit_length() - 1
    half = v >> top - 1 & 1
    return 2 * top + half, top - 1, v - ((2 + half) << top - 1)


def _parse(pixels: list[int], width: int, cache_bits: int, references: bool) -> list[tuple]:
    """('lit', p), ('ref', length, distance code) and ('hit', index) events, each with its place."""
    near = {_distance(i + 1, width): i + 1 for i in reversed(range(len(NEAR)))}
    cache, last, out, at = [None] * (1 << cache_bits), {}, [], 0
    index = lambda p: (CACHE_FACTOR * p & 0xFFFFFFFF) >> 32 - cache_bits
    while at < len(pixels):
        length = 0
        key = tuple(pixels[at : at + 3])
        if references and len(key) == 3 and key in last:
            back = at - last[key]
            while length < 4096 and at + length < len(pixels) and pixels[at + length] == pixels[at + length - back]:
                length += 1
        if length >= 3:
            out.append((at, "ref", length, near.get(back, back + len(NEAR))))
        else:
            length, p = 1, pixels[at]
            hit = cache_bits and cache[index(p)] == p
            out.append((at, "hit", index(p)) if hit else (at, "lit", p))
        for i in range(at, at + length):
            last[tuple(pixels[i : i + 3])] = i
            if cache_bits:
                cache[index(pixels[i])] = pixels[i]
        at += length
    return out


def _put_image(out: _Out, pixels: list[int], width: int, main: bool, cache_bits: int = 0, references: bool = True, tile: int = 0, groups: int = 1) -> None:
    out.put(int(cache_bits > 0), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    height = len(pixels) // width
    across = _up(width, tile) if tile else 0
    group = lambda at: 0
    if main:
        out.put(int(tile > 0), 1)
        if tile:
            out.put(tile - 2, 3)
            of = [i % groups for i in range(across * _up(height, tile))]
            _put_image(out, [g << 8 for g in of], across, False)
            groups = max(of) + 1
            group = lambda at: of[(at // width >> tile) * across + (at % width >> tile)]
    events = _parse(pixels, width, cache_bits, references)
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    for at, kind, *x in events:
        c = counts[group(at)]
        if kind == "lit":
            for k, shift in enumerate((8, 16, 0, 24)):
                c[k][x[0] >> shift & 255] += 1
        elif kind == "hit":
            c[0][280 + x[0]] += 1
        else:
            c[0][256 + _prefix_of(x[0])[0]] += 1
            c[4][_prefix_of(x[1])[0]] += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    codes = [[_put_code(out, _lengths(c, n)) for c, n in zip(cs, sizes, strict=True)] for cs in counts]
    for at, kind, *x in events:
        c = codes[group(at)]
        if kind == "lit":
            for k, shift in enumerate((8, 16, 0, 24)):
                out.code(c[k][x[0] >> shift & 255])
        elif kind == "hit":
            out.code(c[0][280 + x[0]])
        else:
            for k, value in ((0, x[0]), (4, x[1])):
                p, n, extra = _prefix_of(value)
                out.code(c[k][p + 256 * (k == 0)])
                out.put(extra, n)


def _file(stream: bytes) -> bytes:
    pad = b"\0" * (len(stream) & 1)
    return b"RIFF" + (12 + len(stream) + len(pad)).to_bytes(4, "little") + b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + pad


def _head(out: _Out, width: int, height: int) -> None:
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise BadImage("a side of 0 or above 16384 pixels")
    out.put(0x2F, 8), out.put(width - 1, 14), out.put(height - 1, 14), out.put(1, 1), out.put(0, 3)


def encode(image: np.ndarray, transforms: tuple[int, ...] = (), modes: list[int] | None = None, elements: list[int] | None = None, tile: int = 2, cache_bits: int = 0, references: bool = True, groups: int = 1) -> bytes:
    """A lossless WebP file. transforms in the order they are applied; modes and elements are repeated over the tiles."""
    height, width = image.shape[:2]
    out = _Out()
    _head(out, width, height)
    c = image.reshape(-1, 4).astype(np.uint32)
    pixels, now = (c[:, 3] << 24 | c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]).tolist(), width
    for kind in transforms:
        out.put(1, 1), out.put(kind, 2)
        tiles = _up(now, tile) * _up(height, tile)
        if kind == PREDICTOR:
            of = [m << 8 for m in ((modes or [11]) * tiles)[:tiles]]
            out.put(tile - 2, 3)
            _put_image(out, of, _up(now, tile), False)
            pixels = [_sub(p, _predicted(pixels, now, of, tile, i)) for i, p in enumerate(pixels)]
        elif kind == CROSS_COLOR:
            of = ((elements or [0]) * tiles)[:tiles]
            out.put(tile - 2, 3)
            _put_image(out, of, _up(now, tile), False)
            pixels = _cross_all(pixels, now, of, tile, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _green_all(pixels, -1)
        else:
            palette = sorted(set(pixels))
            if len(palette) > 256:
                raise BadImage("too many colours for a palette")
            out.put(len(palette) - 1, 8)
            _put_image(out, [_sub(p, q) for p, q in zip(palette, [0, *palette], strict=False)], len(palette), False)
            place, bits, packed = {p: i for i, p in enumerate(palette)}, _bundle_bits(len(palette)), []
            for row in range(0, len(pixels), now):
                for x in range(0, now, 1 << bits):
                    packed.append(sum(place[p] << 8 + i * (8 >> bits) for i, p in enumerate(pixels[row + x : row + min(now, x + (1 << bits))])))
            pixels, now = packed, _up(now, bits)
    out.put(0, 1)
    _put_image(out, pixels, now, True, cache_bits, references, tile if groups > 1 else 0, groups)
    return _file(out.bytes())


def encode_plain(image: np.ndarray) -> bytes:
    """A lossless WebP file of 8-bit literals only: the same size for all content, written and read as arrays."""
    height, width = image.shape[:2]
    out = _Out()
    _head(out, width, height)
    out.put(0, 3)  # no transform, no colour cache, one group of codes
    for _ in range(4):
        out.put(0, 1), out.put(8, 4)
        for place in CODE_LENGTH_ORDER[:12]:
            out.put(int(place == 8), 3)
        out.put(1, 1), out.put(3, 3), out.put(254, 8)  # 256 lengths, all 8
    out.put(1, 1), out.put(0, 3)
    data = REVERSED[image.reshape(-1, 4)[:, [1, 0, 2, 3]]].reshape(-1)
    s, head = out.n & 7, out.bytes()
    if not s:
        return _file(head + data.tobytes())
    body = np.zeros(len(data) + 1, np.uint8)
    body[:-1] = data << s
    body[1:] |= data >> (8 - s)
    body[0] |= head[-1]
    return _file(head[:-1] + body.tobytes())
