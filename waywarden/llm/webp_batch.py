"""Many lossless WebP images at once, as arrays.

encode_all() gives images of few colours a palette; all others go through
subtract-green, a predictor and cross-colour, whose mode and factors are chosen
for each image. What is left is written with references, a colour cache and
prefix codes, found and built for all images side by side.

decode_all() reads the parts of many streams side by side, whatever their
transforms, and walks their pixels in step: at step i each image that still has
pixels reads a symbol of its own stream or goes on with a reference. Then each
image's transforms are inverted as arrays. What it does not walk (groups of
codes by tile, predictors other than black, left and top or several in one
image, the last few long images, broken streams) goes to webp.decode one by
one.
"""

from __future__ import annotations

import numpy as np

from waywarden.llm import webp
from waywarden.llm.webp import CACHE_FACTOR, CODE_LENGTH_ORDER, NEAR

#: Images side by side, and their pixels when written.
IMAGES, PIXELS = 1024, 1 << 20
#: Fewer images than this are decoded one by one.
FEW = 8
#: Entries in the tables of one code of all images.
ENTRIES = 1 << 22
CACHE_BITS = 8
MIN_REFERENCE, MAX_REFERENCE = 3, 4096
#: Longest code that is written; up to 15 are read.
LONGEST = 10

_U = np.uint64


def _near(width: int) -> np.ndarray:
    """Distance codes of small distances: 0 where there is none."""
    far = np.array([max(1, x + y * width) for x, y in NEAR])
    out = np.zeros(far.max() + 1, np.int64)
    out[far[::-1]] = np.arange(len(NEAR), 0, -1)
    return out


# ---------------------------------------------------------------- writing


def _lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code lengths of each row's counted symbols, by Huffman's two queues for all rows at once; 1 for a single symbol."""
    out = np.zeros(counts.shape, np.uint8)
    todo, counts = np.arange(len(counts)), counts.astype(np.int64)
    while len(todo):
        used = np.count_nonzero(counts, axis=1)
        by = np.argsort(-used, kind="stable")
        todo, counts, used = todo[by], counts[by], used[by]
        most, n = int(used.max(initial=0)), len(todo)
        if most == 0:
            break
        none = 1 << 50
        keys = np.sort(np.where(counts > 0, counts << 12 | np.arange(counts.shape[1]), none << 12), axis=1)[:, :most]
        weight = np.full((n, 2 * most + 2), none)  # leaves, then inner nodes, each in order of weight
        weight[:, :most] = keys >> 12
        up = np.zeros((n, 2 * most + 2), np.int64)
        leaf, node = np.zeros(n, np.int64), np.full(n, most + 1)
        alive = np.searchsorted(-used, -np.arange(2, most + 1), side="right")  # rows with a merge at each step
        for step in range(most - 1):
            k = int(alive[step])
            if not k:
                break
            r, new, total = np.arange(k), most + 1 + step, 0
            for _ in range(2):
                a, b = weight[r, leaf[:k]], weight[r, node[:k]]
                first = a <= b
                up[r, np.where(first, leaf[:k], node[:k])] = new
                total = total + np.where(first, a, b)
                leaf[:k] += first
                node[:k] += ~first
            weight[:k, new] = total
        depth = np.zeros((n, 2 * most + 2), np.int64)
        for step in range(most - 2, -1, -1):
            k = int(alive[step])
            at = most + 1 + step
            if step < most - 2:
                rows = np.flatnonzero(used[:k] > step + 2)  # a row's last merge is its root
                depth[rows, at] = depth[rows, up[rows, at]] + 1
        r, c = np.nonzero(np.arange(most) < used[:, None])
        d = np.where(used[r] > 1, depth[r, up[r, c]] + 1, 1)
        deepest = np.zeros(n, np.int64)
        np.maximum.at(deepest, r, d)
        fits = deepest <= longest
        ok = fits[r]
        out[todo[r[ok]], (keys[r, c] & 4095)[ok]] = d[ok]
        todo, counts = todo[~fits], (counts[~fits] + 1) // 2
    return out


def _codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code of each row's symbols, its bits in the order of the stream; 0 where a row has one symbol."""
    out = np.zeros(lengths.shape, np.uint64)
    r, s = np.nonzero(lengths * (np.count_nonzero(lengths, axis=1) > 1)[:, None])
    if not len(r):
        return out
    n = lengths[r, s].astype(np.int64)
    by = np.argsort(r * 16 + n, kind="stable")
    r, s, n = r[by], s[by], n[by]
    share = 1 << 15 - n
    end = np.cumsum(share)
    start = np.r_[True, r[1:] != r[:-1]]
    code = end - share
    code -= np.repeat(code[start], np.diff(np.r_[np.flatnonzero(start), len(r)]))
    out[r, s] = _REVERSED[15][code]  # the code stands in the top bits, so reversed in the lowest
    return out


def _reversals(bits: int) -> np.ndarray:
    x, out = np.arange(1 << bits), np.zeros(1 << bits, np.int64)
    for i in range(bits):
        out |= (x >> i & 1) << bits - 1 - i
    return out


_REVERSED = {n: _reversals(n) for n in range(16)}


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, their value) of length or distance codes."""
    v = value - 1
    top = np.frexp(np.maximum(v, 1).astype(np.float64))[1].astype(np.int64) - 1
    half = v >> np.maximum(top - 1, 0) & 1
    far = v >= 4
    return np.where(far, 2 * top + half, v), np.where(far, top - 1, 0), np.where(far, v - (2 + half << np.maximum(top - 1, 0)), 0)


_KIND_LENGTHS = np.array([[4] * 13 + [5] * 6], np.uint8)
_KINDS = _codes(_KIND_LENGTHS)[0]


def _code_tokens(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, value, bits) that write each row's code."""
    rows, size = lengths.shape
    used = np.count_nonzero(lengths, axis=1)
    simple = (used <= 2) & ~lengths[:, 256:].any(axis=1)
    s = np.flatnonzero(simple)
    first = np.argmax(lengths[s] > 0, axis=1)
    last = size - 1 - np.argmax(lengths[s][:, ::-1] > 0, axis=1)
    two = used[s] == 2
    head = (1 | two << 1 | 1 << 2 | first << 3 | np.where(two, last << 11, 0)).astype(_U)
    parts = [(s, head, np.where(two, 19, 11))]
    m = np.flatnonzero(~simple)
    if len(m):
        value, bits = 0 | 15 << 1, 5
        for place in CODE_LENGTH_ORDER:
            value, bits = value | int(_KIND_LENGTHS[0, place]) << bits, bits + 3
        bits += 1  # lengths for all symbols
        for at in (0, 32):
            parts.append((m, np.full(len(m), value >> at & 0xFFFFFFFF, _U), np.full(len(m), min(32, bits - at))))
        flat = lengths[m].reshape(-1).astype(np.int64)
        cut = np.zeros(len(flat), bool)
        cut[::size] = True
        zero = flat == 0
        cut |= ~zero
        cut[1:] |= ~zero[:-1]
        at = np.flatnonzero(cut)
        run = np.diff(np.r_[at, len(flat)])  # 1 for lengths, else a run of zeros
        pieces = -(-run // 138)
        i = np.repeat(np.arange(len(at)), pieces)
        nth = np.arange(len(i)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        row, n, piece = m[at[i] // size], flat[at[i]], np.minimum(138, run[i] - 138 * nth)
        short = piece < 3
        kind = np.where(short, n, np.where(piece < 11, 17, 18))
        wide = _KIND_LENGTHS[0].astype(np.int64)[kind]
        extra = np.where(short, 0, np.where(piece < 11, piece - 3, piece - 11))
        value = _KINDS[kind] | extra.astype(_U) << wide.astype(_U)
        bits = wide + np.where(short, 0, np.where(piece < 11, 3, 7))
        twice = short & (piece == 2)
        value = np.where(twice, value | value << wide.astype(_U), value)
        parts.append((row, value, np.where(twice, 2 * bits, bits)))
    row, value, bits = (np.concatenate([p[i] for p in parts]) for i in range(3))
    by = np.argsort(row, kind="stable")
    return row[by], value[by], bits[by]


def _packed(image: np.ndarray, value: np.ndarray, bits: np.ndarray, n: int) -> list[bytes]:
    """The tokens' bits (up to 64 each, in order of images) as one stream for each image."""
    total = np.bincount(image, bits, n).astype(np.int64)
    words = -(-total // 64)
    first = np.cumsum(words) - words
    before = np.cumsum(bits) - bits
    at = before - (np.cumsum(total) - total)[image] + 64 * first[image]
    word, s = at >> 6, (at & 63).astype(_U)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    new = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[new]] = np.add.reduceat(value << s, new)
    over = (at & 63) + bits > 64
    out[word[over] + 1] |= value[over] >> (_U(64) - s[over])
    raw = out.astype("<u8").tobytes()
    return [raw[8 * f : 8 * f + (t + 7) // 8] for f, t in zip(first.tolist(), total.tolist(), strict=True)]


#: Tokens of an image sort by image * ORDERS + their part of the stream.
ORDERS = 32
AT_HEAD, AT_PREDICTOR, AT_CROSS, AT_PALETTE, AT_END, AT_MAIN = 0, 1, 2, 3, 11, 12
#: Transforms with one value for all tiles have the largest tiles.
TILE = 9
MODES = (0, 1, 2)
#: Every so many pixels are looked at when a mode is chosen; all are written.
LOOK = 5


def _fields(n: int, fields: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """(value, bits) tokens of up to 64 bits from (value, bits) fields."""
    value, bits = np.zeros(n, np.uint64), 0
    for v, b in fields:
        value, bits = value | np.broadcast_to(np.asarray(v), n).astype(_U) << _U(bits), bits + b
    return value, np.full(n, bits)


def _uniform(n: int, kind: int, green, red, blue) -> tuple[np.ndarray, np.ndarray]:
    """A transform whose image has one colour in all tiles: five codes of one symbol, and no bits for pixels."""
    one = [x for symbol in (green, red, blue, 0, 0) for x in ((0b101, 3), (symbol, 8))]
    return _fields(n, [(1, 1), (kind, 2), (TILE - 2, 3), (0, 1), *one])


def _neighbours(c: np.ndarray, of: np.ndarray, base: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left and top pixels of each, and whether it stands in the first column or row."""
    at = np.arange(len(c)) - base[of]
    x, first_row = at % width[of], at < width[of]
    place = np.arange(len(c))
    return c[np.maximum(place - 1, 0)], c[np.maximum(place - width[of], 0)], x == 0, first_row


def _residual(c: np.ndarray, mode, left, top, first_column, first_row) -> np.ndarray:
    """c (b, g, r, a) less its prediction by a mode for each pixel."""
    black = np.array([0, 0, 0, 255], np.uint8)
    mode = np.broadcast_to(mode, len(c))[:, None]
    predicted = np.where(mode == 0, black, np.where(mode == 1, left, top))
    predicted = np.where(first_row[:, None], left, np.where(first_column[:, None], top, predicted))
    predicted[first_row & first_column] = black
    return c - predicted


def _cost(c: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Bits of each image's bytes by the frequency of each channel."""
    log = lambda v: v * np.log2(np.maximum(v, 1))
    total = 4 * log(np.bincount(of, minlength=n))
    for k in range(4):
        total = total - log(np.bincount(of * 256 + c[:, k], minlength=n * 256)).reshape(n, 256).sum(axis=1)
    return total


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int8).astype(np.int64)


def _fit(y: np.ndarray, x: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each image the factor, in 32nds, by which x foretells y."""
    xy, xx = (np.bincount(of, v, n) for v in (x * y, x * x))
    return np.clip(np.rint(32 * xy / np.maximum(xx, 1)), -128, 127).astype(np.int64)


def _palettes(p: np.ndarray, of: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which images get a palette, the number of their colours, each pixel's place among its image's, and all colours in order."""
    key = of.astype(_U) << _U(32) | p
    by = np.argsort(key, kind="stable")
    ordered = key[by]
    first = np.r_[True, ordered[1:] != ordered[:-1]]
    colours = np.bincount((ordered[first] >> _U(32)).astype(np.int64), minlength=len(count))
    before = np.cumsum(colours) - colours
    rank = np.empty(len(p), np.int64)
    rank[by] = np.cumsum(first) - 1
    return (colours <= 256) & (count >= 2 * colours), colours, rank - before[of], ordered[first] & _U(0xFFFFFFFF)


def _encode(images: list[np.ndarray]) -> list[bytes]:
    n = len(images)
    width, height = np.array([i.shape[1] for i in images]), np.array([i.shape[0] for i in images])
    count = width * height
    base = np.cumsum(count) - count
    of = np.repeat(np.arange(n), count)
    c = np.ascontiguousarray(np.concatenate([i.reshape(-1, 4) for i in images])[:, [2, 1, 0, 3]])  # as in a pixel's number, the lowest byte first
    few, colours, rank, all_colours = _palettes(c.view("<u4")[:, 0].astype(_U), of, count)
    tokens = [(np.arange(n) * ORDERS + AT_HEAD, *_fields(n, [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)])), (np.arange(n) * ORDERS + AT_END, *_fields(n, [(0, 1)]))]

    # images of few colours: the palette, and places in it, several to a pixel where they are short
    ids = np.flatnonzero(few)
    pack = np.where(few, np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0), 0)
    wide = -(-width >> pack)
    size = wide * height
    start = np.cumsum(size) - size
    main = np.zeros(int(size.sum()), np.uint64)
    if len(ids):
        tokens.append((ids * ORDERS + AT_PALETTE, *_fields(len(ids), [(1, 1), (webp.PALETTE, 2), (colours[ids] - 1, 8)])))
        entry = np.repeat(few, colours)
        table = all_colours[entry].astype("<u4").view(np.uint8).reshape(-1, 4)
        own = np.repeat(np.arange(len(ids)), colours[ids])
        head = np.r_[True, own[1:] != own[:-1]]
        step = table - np.where(head[:, None], 0, np.roll(table, 1, axis=0)).astype(np.uint8)
        _entropy(tokens, ids, AT_PALETTE + 1, np.ascontiguousarray(step).view("<u4")[:, 0].astype(_U), own, colours[ids], False)
        at = np.flatnonzero(few[of])
        i, inside = of[at], at - base[of[at]]
        x, y = inside % width[i], inside // width[i]
        np.bitwise_or.at(main, start[i] + y * wide[i] + (x >> pack[i]), (rank[at] << 8 + (x & (1 << pack[i]) - 1) * (8 >> pack[i])).astype(_U))

    # all others: the green channel off the others, a prediction off each pixel, shares of channels off each other
    ids = np.flatnonzero(~few)
    if len(ids):
        at = np.flatnonzero(~few[of])
        c, i = c[at], of[at]
        local = np.cumsum(~few)[i] - 1
        own = np.cumsum(count[ids]) - count[ids]
        c[:, 0] -= c[:, 1]
        c[:, 2] -= c[:, 1]
        near = _neighbours(c, local, own, width[ids])
        some = slice(None, None, LOOK)
        best = np.argmin([_cost(_residual(c[some], m, *(x[some] for x in near)), local[some], len(ids)) for m in MODES], axis=0)
        c = _residual(c, np.array(MODES)[best][local], *near)
        b, g, r = (_signed(np.ascontiguousarray(c[:, k])) for k in range(3))
        to_red = _fit(r, g, local, len(ids))
        to_blue = _fit(b, g, local, len(ids))
        less_blue = b - (to_blue[local] * g >> 5)
        from_red = _fit(_signed(less_blue.astype(np.uint8)), r, local, len(ids))
        c[:, 0] = (less_blue - (from_red[local] * r >> 5)).astype(np.uint8)
        c[:, 2] = (r - (to_red[local] * g >> 5)).astype(np.uint8)
        main[start[i] + at - base[i]] = np.ascontiguousarray(c).view("<u4")[:, 0]
        tokens.append((ids * ORDERS + AT_HEAD, *_fields(len(ids), [(1, 1), (webp.SUBTRACT_GREEN, 2)])))
        tokens.append((ids * ORDERS + AT_PREDICTOR, *_uniform(len(ids), webp.PREDICTOR, np.array(MODES)[best], 0, 0)))
        tokens.append((ids * ORDERS + AT_CROSS, *_uniform(len(ids), webp.CROSS_COLOR, to_blue & 255, from_red & 255, to_red & 255)))

    _entropy(tokens, np.arange(n), AT_MAIN, main, np.repeat(np.arange(n), size), wide, True)
    key, v, b = (np.concatenate([t[i] for t in tokens]) for i in range(3))
    by = np.argsort(key, kind="stable")
    return [webp._file(s) for s in _packed(key[by] // ORDERS, v[by], b[by], n)]


def _entropy(tokens: list, ids: np.ndarray, order: int, p: np.ndarray, of: np.ndarray, width: np.ndarray, full: bool) -> None:
    """Adds the tokens of the entropy-coded images p (image of[i] has width[of[i]]); full: the main image, with references and a cache."""
    n, size, place = len(ids), len(p), np.arange(len(p))
    count = np.bincount(of, minlength=n)
    base = np.cumsum(count) - count
    low = _U(max(1, size.bit_length()))
    none = np.zeros(0, np.int64)
    at, length, far, code, slot, hits, lits = none, none, none, none, none, none, place
    if full:
        at, length, far = _references(p, of, base + count, low)
        depth = np.zeros(size + 1, np.int64)
        depth[at] += 1
        np.add.at(depth, at + length, -1)
        single = np.flatnonzero(np.cumsum(depth[:-1]) == 0)

        # the colour cache: a hit where the last pixel of the same slot is the same
        slot = ((p * _U(CACHE_FACTOR) & _U(0xFFFFFFFF)) >> _U(32 - CACHE_BITS)).astype(np.int64)
        by = np.sort((of << CACHE_BITS | slot) << int(low) | place) & (1 << int(low)) - 1
        hit = np.zeros(size, bool)
        hit[by[1:]] = (of[by[1:]] == of[by[:-1]]) & (p[by[1:]] == p[by[:-1]])
        hits, lits = single[hit[single]], single[~hit[single]]

        code = np.zeros(len(at), np.int64)
        for w in np.unique(width[of[at]]).tolist():
            near, rows = _near(w), np.flatnonzero(width[of[at]] == w)
            f = far[rows]
            short = np.where(f < len(near), near[np.minimum(f, len(near) - 1)], 0)
            code[rows] = np.where(short > 0, short, f + len(NEAR))
    long_p, long_n, long_v = _prefix(length)
    far_p, far_n, far_v = _prefix(code)
    literal = [(p[lits] >> _U(s) & _U(255)).astype(np.int64) for s in (8, 16, 0, 24)]
    sizes = (280 + (1 << CACHE_BITS if full else 0), 256, 256, 256, 40)
    symbols = [
        (np.concatenate([of[lits], of[hits], of[at]]), np.concatenate([literal[0], 280 + slot[hits] if full else none, 256 + long_p])),
        *[(of[lits], x) for x in literal[1:]],
        (of[at], far_p),
    ]
    tables = []
    for k, ((row, sym), m) in enumerate(zip(symbols, sizes, strict=True)):
        lengths = _lengths(np.bincount(row * m + sym, minlength=n * m).reshape(n, m))
        r, v, b = _code_tokens(lengths)
        tokens.append((ids[r] * ORDERS + order + 1 + k, v, b))
        only = np.count_nonzero(lengths, axis=1) == 1
        tables.append((_codes(lengths).astype(np.int32) << 4 | np.where(only[:, None], 0, lengths)).reshape(-1))
    tokens.append((ids * ORDERS + order, *_fields(n, [(1, 1), (CACHE_BITS, 4), (0, 1)] if full else [(0, 1)])))

    # one token for each pixel, hit or reference
    all_v, all_b = np.zeros(size, np.uint64), np.zeros(size, np.int64)

    def chain(rows, *pieces):
        v, b = np.zeros(len(rows), np.uint64), np.zeros(len(rows), np.int64)
        for x, m in pieces:
            v, b = v | x.astype(_U) << b.astype(_U), b + m
        all_v[rows], all_b[rows] = v, b

    def look(k, rows, sym):
        e = tables[k].take(of[rows] * sizes[k] + sym)
        return e >> 4, e & 15

    chain(lits, *[look(k, lits, literal[k]) for k in range(4)])
    if full:
        chain(hits, look(0, hits, 280 + slot[hits]))
        chain(at, look(0, at, 256 + long_p), (long_v, long_n), look(4, at, far_p), (far_v, far_n))
    rows = np.flatnonzero(all_b)
    tokens.append((ids[of[rows]] * ORDERS + order + 6, all_v[rows], all_b[rows]))


def _references(p: np.ndarray, of: np.ndarray, end: np.ndarray, low) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, length, distance): the last place of the same three pixels; a run of one distance is one reference."""
    size, place = len(p), np.arange(len(p))
    three = np.flatnonzero(place + 2 < end[of])
    a, b, d = p[three], p[three + 1], p[three + 2]
    mixed = (a * _U(0x9E3779B97F4A7C15) ^ b * _U(0xC2B2AE3D27D4EB4F) ^ d * _U(0x165667B19E3779F9)) + of[three].astype(_U) * _U(0xD6E8FEB86659FD93)
    by = (np.sort((mixed >> low << low) | three.astype(_U)) & ((_U(1) << low) - _U(1))).astype(np.int64)
    was, now = by[:-1], by[1:]
    same = (of[was] == of[now]) & (p[was] == p[now]) & (now - was < (1 << 20) - 120)
    for k in (1, 2):
        same &= p[was + k] == p[now + k]
    back = np.zeros(size + 1, np.int64)
    back[now[same]] = (now - was)[same]
    edge = np.flatnonzero(back[1:] != back[:-1]) + 1
    starts = np.r_[0, edge]
    ends = np.r_[edge, size + 1]
    real = back[starts] > 0
    starts, ends = starts[real], ends[real] + 2
    # two images' runs may touch: no triple starts in the last two places of an image, so they do not
    starts[1:] = np.maximum(starts[1:], ends[:-1])
    far = back[ends - 3] if len(ends) else ends
    length = ends - starts
    good = length >= MIN_REFERENCE
    starts, length, far = starts[good], length[good], far[good]
    pieces = -(-length // MAX_REFERENCE)
    i = np.repeat(np.arange(len(starts)), pieces)
    nth = np.arange(len(i)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return starts[i] + MAX_REFERENCE * nth, np.minimum(MAX_REFERENCE, length[i] - MAX_REFERENCE * nth), far[i]


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """A lossless WebP file for each image."""
    out, group, total = [], [], 0
    for i in images:
        if not (0 < i.shape[0] <= webp.MAX_SIDE and 0 < i.shape[1] <= webp.MAX_SIDE):
            raise webp.BadImage("a side of 0 or above 16384 pixels")
        n = i.shape[0] * i.shape[1]
        if group and (len(group) == IMAGES or total + n > PIXELS):
            out += _encode(group)
            group, total = [], 0
        group.append(i)
        total += n
    return out + (_encode(group) if group else [])


# ---------------------------------------------------------------- reading


class _Streams:
    """Bits of many streams; bad marks those that break a rule."""

    def __init__(self, chunks: list[bytes]):
        raw = np.frombuffer(b"".join(c + bytes(16) for c in chunks), np.uint8)
        word = raw[:-7].astype(np.uint64)
        for i in range(1, 8):
            word |= raw[i : len(raw) - 7 + i].astype(np.uint64) << _U(8 * i)
        self.word = word.view(np.int64)  # the copies of the sign are never used
        size = np.array([len(c) for c in chunks])
        first = np.cumsum(size + 16) - size - 16
        self.at, self.end = 8 * first, 8 * (first + size)
        self.bad = np.zeros(len(chunks), bool)

    def of(self, who: np.ndarray) -> "_Streams":
        """Some of the streams; put_back() ends their use."""
        out = _Streams.__new__(_Streams)
        out.word, out.at, out.end, out.bad = self.word, self.at[who], self.end[who], self.bad[who]
        return out

    def put_back(self, who: np.ndarray, part: "_Streams") -> None:
        self.at[who], self.bad[who] = part.at, part.bad | (part.at > part.end)

    def peek(self, who: np.ndarray) -> np.ndarray:
        """At least 57 bits; those behind the end do not count."""
        at = self.at[who]
        return self.word.take(at >> 3, mode="clip") >> (at & 7)

    def read(self, who: np.ndarray, n) -> np.ndarray:
        out = self.peek(who) & (1 << np.asarray(n, np.int64)) - 1
        self.at[who] += n
        return out


def _tables(lengths: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, int]:
    """Flat tables, one of 2^bits entries (symbol << 4 | length) for each row, by the next bits; bad gets rows that are no code."""
    n = len(lengths)
    used = np.count_nonzero(lengths, axis=1)
    bits = max(1, int(lengths.max(initial=0)))
    table = np.zeros((n, 1 << bits), np.uint16)
    table[:] = np.where(used == 1, np.argmax(lengths > 0, axis=1) << 4, 0)[:, None]
    share = np.where(lengths > 0, 1 << bits - lengths.astype(np.int64), 0).sum(axis=1)
    whole = (used > 1) & (share == 1 << bits)
    bad |= (used > 1) & ~whole
    rows = np.flatnonzero(whole)
    if len(rows):
        r, s = np.nonzero(lengths[rows])
        m = lengths[rows[r], s].astype(np.int64)
        by = np.argsort(r * 16 + m, kind="stable")
        full = np.repeat((s << 4 | m)[by].astype(np.uint16), 1 << bits - m[by]).reshape(len(rows), -1)
        table[rows] = full[:, _REVERSED[bits]]
    return table.reshape(-1), bits


def _read_lengths(s: _Streams, size: np.ndarray) -> np.ndarray:
    """The next code's lengths in each stream, of an alphabet of so many symbols."""
    n, most = len(size), int(size.max())
    out = np.zeros((n, most), np.uint8)
    simple = s.read(np.arange(n), 1) == 1
    a = np.flatnonzero(simple)
    if len(a):
        two, wide = s.read(a, 1), s.read(a, 1)
        first = s.read(a, np.where(wide, 8, 1))
        second = np.where(two, s.read(a, 8 * two), first)
        s.bad[a] |= (first >= size[a]) | (second >= size[a])
        out[a, np.minimum(first, most - 1)] = 1
        out[a, np.minimum(second, most - 1)] = 1
    m = np.flatnonzero(~simple)
    if not len(m):
        return out
    kinds = 4 + s.read(m, 4)
    of = np.zeros((len(m), 19), np.uint8)
    for i, place in enumerate(CODE_LENGTH_ORDER):
        of[:, place] = s.read(m, np.where(i < kinds, 3, 0))
    some = s.read(m, 1)
    wide = np.where(some, 2 + 2 * s.read(m, 3 * some), 0)
    left = np.where(some, 2 + s.read(m, wide), size[m])
    wrong = left > size[m]
    table, bits = _tables(of, wrong)
    s.bad[m] |= wrong
    left[s.bad[m]] = 0
    at, previous, limit = np.zeros(len(m), np.int64), np.full(len(m), 8), size[m]
    go = np.flatnonzero(left > 0)
    while len(go):
        who = m[go]
        left[go] -= 1
        w = s.peek(who)
        e = table[(go << bits) + (w & (1 << bits) - 1)].astype(np.int64)
        kind, used = e >> 4, e & 15
        plain = kind < 16
        extra = np.where(plain, 0, np.where(kind == 16, 2, np.where(kind == 17, 3, 7)))
        more = w >> used & (1 << extra) - 1
        s.at[who] += used + extra
        times = np.where(plain, 1, np.where(kind == 18, 11, 3) + more)
        over = at[go] + times > limit[go]
        if over.any():
            s.bad[who[over]] = True
            left[go[over]] = 0
            times[over] = 0
        put = np.where(plain, kind, np.where(kind == 16, previous[go], 0))
        for i in range(int(times[put > 0].max(initial=0))):
            x = np.flatnonzero((put > 0) & (times > i))
            out[who[x], at[go[x]] + i] = put[x]
        new = plain & (kind > 0) & ~over
        previous[go[new]] = kind[new]
        at[go] += times
        go = go[(left[go] > 0) & (at[go] < limit[go])]
    return out


def _decode(chunks: list[bytes]) -> list[np.ndarray | None]:
    """The images of chunks, as (height, width, 4) bytes; None where webp.decode must look."""
    n = len(chunks)
    s, everyone = _Streams(chunks), np.arange(len(chunks))
    signed = s.read(everyone, 8) == 0x2F
    width, height = s.read(everyone, 14) + 1, s.read(everyone, 14) + 1
    s.read(everyone, 1)
    s.bad |= ~signed | (s.read(everyone, 3) != 0)
    undo: list[list[tuple]] = [[] for _ in range(n)]
    now, seen, more = width.copy(), np.zeros(n, np.int64), np.flatnonzero(~s.bad)
    while len(more):
        more = more[s.read(more, 1) == 1]
        kinds = s.read(more, 2)
        s.bad[more] |= (seen[more] >> kinds & 1) == 1
        seen[more] |= 1 << kinds
        for kind in range(4):
            who = more[(kinds == kind) & ~s.bad[more]]
            if not len(who):
                continue
            if kind == webp.SUBTRACT_GREEN:
                for i in who.tolist():
                    undo[i].append((kind, 0, None))
            elif kind == webp.PALETTE:
                colours = s.read(who, 8) + 1
                for i, table in zip(who.tolist(), _walk(s, who, colours, np.ones(len(who), np.int64), False), strict=True):
                    undo[i].append((kind, int(width[i]), np.cumsum(_bytes(table), axis=0, dtype=np.uint8) if table is not None else None))
                now[who] = -(-width[who] >> np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0))
            else:
                tile = s.read(who, 3) + 2
                made = _walk(s, who, -(-now[who] >> tile), -(-height[who] >> tile), False)
                for i, t, image in zip(who.tolist(), tile.tolist(), made, strict=True):
                    undo[i].append((kind, t, image))
        more = more[~s.bad[more]]
    images: list[np.ndarray | None] = [None] * n
    good = np.flatnonzero(~s.bad)
    for i, p in zip(good.tolist(), _walk(s, good, now[good], height[good], True), strict=True):
        if not s.bad[i]:
            images[i] = _inverted(_bytes(p).reshape(height[i], now[i], 4).copy(), undo[i])
    return images


def _bytes(pixels: np.ndarray) -> np.ndarray:
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def _inverted(c: np.ndarray, undo: list[tuple]) -> np.ndarray | None:
    """Pixels (b, g, r, a) with the transforms undone, as (r, g, b, a); None for predictors that are left to webp.decode."""
    for kind, size, extra in reversed(undo):
        if kind == webp.SUBTRACT_GREEN:
            c[:, :, 0] += c[:, :, 1]
            c[:, :, 2] += c[:, :, 1]
        elif kind == webp.PALETTE:
            pack = 3 if len(extra) <= 2 else 2 if len(extra) <= 4 else 1 if len(extra) <= 16 else 0
            x = np.arange(size)
            place = c[:, x >> pack, 1] >> ((x & (1 << pack) - 1) * (8 >> pack)) & (1 << (8 >> pack)) - 1
            c = np.concatenate([extra, np.zeros((256 - len(extra), 4), np.uint8)])[place]
        elif kind == webp.CROSS_COLOR:
            if len(extra) > 1:
                h, w = c.shape[:2]
                extra = extra.reshape(-(-h >> size), -1)[np.arange(h)[:, None] >> size, np.arange(w) >> size]
            to_red, to_blue, from_red = ((extra >> k & 255).astype(np.uint8).view(np.int8).astype(np.int16) for k in (0, 8, 16))
            g = c[:, :, 1].view(np.int8).astype(np.int16)
            red = (c[:, :, 2] + (to_red * g >> 5)).astype(np.uint8)
            c[:, :, 0] = (c[:, :, 0] + (to_blue * g >> 5) + (from_red * red.view(np.int8).astype(np.int16) >> 5)).astype(np.uint8)
            c[:, :, 2] = red
        else:
            modes = set((extra >> 8 & 15).tolist())
            if len(modes) > 1 or not modes <= set(MODES):
                return None
            c[:1, :1, 3] += 255
            c[0] = np.cumsum(c[0], axis=0, dtype=np.uint8)
            mode = modes.pop()
            if mode == 2:
                c = np.cumsum(c, axis=0, dtype=np.uint8)
            else:
                c[:, 0] = np.cumsum(c[:, 0], axis=0, dtype=np.uint8)
                if mode == 1:
                    c[1:] = np.cumsum(c[1:], axis=1, dtype=np.uint8)
                else:
                    c[1:, 1:, 3] += 255
    return c[:, :, [2, 1, 0, 3]]


def _walk(s: _Streams, who: np.ndarray, width: np.ndarray, height: np.ndarray, main: bool) -> list[np.ndarray | None]:
    """The pixels of the entropy-coded image that comes next in each of some streams; None where the stream turned out bad."""
    count = width * height
    by = np.argsort(-count, kind="stable")
    part = s.of(who[by])
    everyone = np.arange(len(who))
    flag = part.read(everyone, 1)
    cache_bits = part.read(everyone, 4 * flag)
    part.bad |= cache_bits > 11
    if main:
        part.bad |= part.read(everyone, 1) == 1  # groups of codes by tile
    cache_bits = np.where(part.bad, 0, cache_bits)
    cached = np.where(cache_bits > 0, 1 << cache_bits, 0)
    lengths = [_read_lengths(part, k) for k in (280 + cached, *[np.full(len(who), x) for x in (256, 256, 256, 40)])]
    out: list[np.ndarray | None] = [None] * len(who)
    most = max(1, *(int(x.max(initial=0)) for x in lengths))
    step = max(1, ENTRIES >> most)
    for a in range(0, len(who), step):
        rows = np.arange(a, min(len(who), a + step))
        some = part.of(rows)
        pixels = _pixels(some, width[by[rows]], count[by[rows]], cache_bits[rows], [x[rows] for x in lengths])
        part.put_back(rows, some)
        for i, p in zip(by[rows].tolist(), pixels, strict=True):
            out[i] = p
    s.put_back(who[by], part)
    return [None if s.bad[w] else p for w, p in zip(who.tolist(), out, strict=True)]


def _pixels(s: _Streams, width: np.ndarray, count: np.ndarray, cache_bits: np.ndarray, lengths: list[np.ndarray]) -> list[np.ndarray]:
    """The pixels of images, most pixels first, whose codes have been read."""
    n = len(width)
    cached = np.where(cache_bits > 0, 1 << cache_bits, 0)
    tables = [_tables(x, s.bad) for x in lengths]
    masks = [(1 << b) - 1 for _, b in tables]
    base = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    slots = np.cumsum(np.maximum(cached, 1)) - np.maximum(cached, 1)
    cache = np.zeros(int(np.maximum(cached, 1).sum()), np.int64)
    shift = np.where(cached > 0, 32 - cache_bits, 63)
    left, back = np.zeros(n, np.int64), np.ones(n, np.int64)
    widths, which = np.unique(width, return_inverse=True)
    near = np.stack([np.array([0] + [webp._distance(i + 1, w) for i in range(len(NEAR))]) for w in widths.tolist()])
    steps = np.searchsorted(-count, -np.arange(int(count[0])), side="left").tolist()  # images with more than i pixels
    (green, g), others, (dist, db) = tables[0], tables[1:4], tables[4]
    word = s.word
    eights = (16, 0, 24)
    for i, k in enumerate(steps):
        # one image after the other, from the front, where that is less work than to go on in step
        if k < FEW and (int(count[0]) - i) * FEW > int(count[:k].sum()):
            s.bad[:k] = True
            break
        busy = left[:k] > 0
        a = np.flatnonzero(~busy)
        new = np.zeros(k, np.int64)
        if len(a):
            at = s.at.take(a)
            w = word.take(at >> 3, mode="clip") >> (at & 7)
            e = green.take((a << g) + (w & masks[0])).astype(np.int64)
            sym, used = e >> 4, e & 15
            x = np.flatnonzero(sym < 256)
            if len(x):
                who, m = a.take(x), used.take(x)
                w, p, total = w.take(x) >> m, sym.take(x) << 8, m
                for j, (table, b) in enumerate(others):
                    e = table.take((who << b) + (w & masks[j + 1])).astype(np.int64)
                    p |= e >> 4 << eights[j]
                    m = e & 15
                    total = total + m
                    if j == 0:
                        w = w >> m
                    elif j == 1:  # 57 bits hold three codes
                        here = at.take(x) + total
                        w = word.take(here >> 3, mode="clip") >> (here & 7)
                used[x] = total
                new[who] = p
            s.at[a] = at + used
            x = np.flatnonzero(sym >= 280)
            if len(x):
                who = a[x]
                new[who] = cache[slots[who] + sym[x] - 280]
            x = np.flatnonzero((sym >= 256) & (sym < 280))
            if len(x):
                who = a[x]
                length = _long(s, who, sym[x] - 256)
                e = dist.take((who << db) + (s.peek(who) & masks[4])).astype(np.int64)
                s.at[who] += e & 15
                code = _long(s, who, e >> 4)
                far = np.where(code > len(NEAR), code - len(NEAR), near[which[who], np.minimum(code, len(NEAR))])
                wrong = (far > i) | (i + length > count[who])
                if wrong.any():
                    s.bad[who[wrong]] = True
                    length[wrong], far[wrong] = 1, 0
                left[who], back[who] = length, far
                busy[who] = True
        b = np.flatnonzero(busy)
        if len(b):
            new[b] = out[base[b] + i - back[b]]
            left[b] -= 1
        out[base[:k] + i] = new
        cache[slots[:k] + ((new * CACHE_FACTOR & 0xFFFFFFFF) >> shift[:k])] = new
    s.bad |= s.at > s.end
    return np.split(out, base[1:])


def _long(s: _Streams, who: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Length or distance of a prefix and its extra bits."""
    extra = np.maximum(p - 2 >> 1, 0)
    return np.where(p < 4, p + 1, (2 + (p & 1) << extra) + s.read(who, extra) + 1)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each lossless WebP file; BadImage for anything else."""
    out: list[np.ndarray | None] = [None] * len(files)
    chunks = [webp._chunk(f) for f in files]
    sides = [int.from_bytes(c[1:5], "little") for c in chunks]
    able = sorted(range(len(files)), key=lambda i: -((sides[i] & 0x3FFF) + 1) * ((sides[i] >> 14 & 0x3FFF) + 1))
    for at in range(0, len(able), IMAGES):
        part = able[at : at + IMAGES]
        for i, image in zip(part, _decode([chunks[i] for i in part]), strict=True):
            out[i] = image
    return [webp.decode(f) if o is None else o for o, f in zip(out, files, strict=True)]
