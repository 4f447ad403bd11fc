"""Media columns: lossless WebP, decoded to pixel arrays, and an encoder to write them.

The decoder reads any lossless still image: simple and normal prefix codes, meta
prefix images, back-references with the near-pixel distance codes, the colour
cache, and the inverses of the predictor, cross-colour, subtract-green and
palette transforms. It works on packed ARGB integers. Images whose pixels are
all literals of one varying channel take a path that looks up the code at every
bit position by array operations and then follows the chain of positions; where
one channel varies and pixels are copied, symbols are read one by one and copies
made whole. The palette and a predictor of one mode are undone by array operations.

Bytes are stored as 8-bit samples: one per pixel, in the green channel, 64 in a
row. The encoder writes plain literals, a bundled palette for up to 16 values, the
predictor (left or top) where it lowers the entropy, or back-references for
repetitive payloads, whichever file is smallest. (Cross-colour and the colour
cache cannot shrink an image with one varying channel: they are only read.)
Payloads over 16,383 rows get wider rows, the last one filled up; the number of
samples then stands in a RIFF chunk of its own. What one image can't hold goes to
several files in a row, so the only limit is that of a binary value, 2 GB.

Null texts are empty; an empty text is 64 zero samples. Equal texts give equal
values. Ids may repeat or be null, each row is stored by itself; an empty table
gives none.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import chunks, rows, text_of, texts

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
N_LENGTHS, N_DISTANCES = 24, 40
#: The distance codes 1 to 120, as (columns back, rows up).
NEAR = (
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
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
BLACK = 0xFF000000
#: The chunk with the number of samples of a filled-up image.
COUNT_CHUNK = b"NSMP"
#: Samples of one image: 16,384 rows of 16,384 pixels.
MOST = 1 << 28
#: Shortest copy that the encoder makes, and the longest there is.
SHORTEST, LONGEST = 12, 4096


class Bits:
    """Reads little-endian bit fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data + bytes(16), at

    def read(self, n: int) -> int:
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)
        self.at += n
        if i > len(self.data):
            raise ValueError("the image ends early")
        return v & ((1 << n) - 1)


def canonical(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code with its first bit lowest) of each symbol of a complete prefix code."""
    out, code, last = [], 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out.append((s, n, int(format(code, f"0{n}b")[::-1], 2)))
        code += 1
    return out


class PrefixCode:
    """lengths: bits of each symbol; a code of one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [s for s, n in enumerate(lengths) if n]
        if not used:
            used = [0]
        self.single = used[0] if len(used) == 1 else None
        self.top = max(used)
        self.width = 0 if self.single is not None else max(lengths)
        self.mask = (1 << self.width) - 1
        if self.single is not None:
            self.symbols, self.sizes = np.array([self.single]), np.array([0])
        else:
            if sum(1 << (15 - n) for n in lengths if n) != 1 << 15:
                raise ValueError("the prefix code is not complete")
            self.symbols, self.sizes = np.empty(1 << self.width, np.int32), np.empty(1 << self.width, np.int32)
            for s, n, code in canonical(lengths):
                self.symbols[code :: 1 << n] = s
                self.sizes[code :: 1 << n] = n
        self._list: list[tuple[int, int]] | None = None

    def read(self, bits: Bits) -> int:
        if self._list is None:
            self._list = list(zip(self.symbols.tolist(), self.sizes.tolist(), strict=True))
        i = bits.at >> 3
        s, n = self._list[int.from_bytes(bits.data[i : i + 3], "little") >> (bits.at & 7) & self.mask]
        bits.at += n
        return s


def read_code(bits: Bits, size: int) -> PrefixCode:
    lengths = [0] * size
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    meta = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        meta[k] = bits.read(3)
    code = PrefixCode(meta)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    i, before = 0, 8
    while i < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[i] = n
            before = n or before
            i += 1
            continue
        times = 3 + bits.read(2) if n == 16 else 3 + bits.read(3) if n == 17 else 11 + bits.read(7)
        if i + times > size:
            raise ValueError("code lengths run over")
        lengths[i : i + times] = [before if n == 16 else 0] * times
        i += times
    return PrefixCode(lengths)


def read_extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def literal_chain(data: bytes, at: int, code: PrefixCode, n: int) -> tuple[np.ndarray, int]:
    """The next n symbols of one code, and the bit after them."""
    if code.single is not None:
        return np.full(n, code.single), at
    # Pieces of the stream, so that the arrays stay small. From each bit position the next symbol's is known, so by
    # doubling also that of the 16th: the chain of every 16th is followed one by one, the rest by array operations.
    out, got, pos = [], 0, at
    while got < n:
        first = pos >> 3
        held = np.frombuffer(data, np.uint8, min(1 << 14, len(data) - first), first).astype(np.uint32)
        word = held[:-2] | held[1:-1] << np.uint32(8) | held[2:] << np.uint32(16)
        window = (word[:, None] >> np.arange(8, dtype=np.uint32) & np.uint32(code.mask)).ravel()
        stop = len(window)
        if stop <= pos - 8 * first:
            raise ValueError("the image ends early")
        # Positions behind the piece stay where they are.
        steps = [np.arange(stop + 16, dtype=np.int32)]
        steps[0][:stop] += code.sizes[window]
        for _ in range(4):
            steps.append(steps[-1][steps[-1]])
        far, p, chain = memoryview(steps[4]), pos - 8 * first, []
        add = chain.append
        for _ in range(-(-(n - got) // 16)):
            if p >= stop:
                break
            add(p)
            p = far[p]
        places = np.array(chain, np.int32)
        for step in steps[3::-1]:
            places = np.stack([places, step[places]], 1).ravel()
        places = places[places < stop][: n - got]
        out.append(code.symbols[window[places]])
        got += len(places)
        pos = 8 * first + int(steps[0][places[-1]])
    return np.concatenate(out), pos


def read_distance(bits: Bits, code: PrefixCode, width: int) -> int:
    d = read_extra(bits, code.read(bits))
    if d > 120:
        return d - 120
    x, y = NEAR[d - 1]
    return max(1, x + y * width)


def copy_chain(bits: Bits, green: PrefixCode, distance: PrefixCode, width: int, n: int) -> np.ndarray:
    """The next n values of one channel, literals and copies."""
    out, data, at, mask = bytearray(), bits.data, bits.at, green.mask
    table = list(zip(green.symbols.tolist(), green.sizes.tolist(), strict=True))
    while len(out) < n:
        i = at >> 3
        s, size = table[int.from_bytes(data[i : i + 3], "little") >> (at & 7) & mask]
        at += size
        if i > len(data):
            raise ValueError("the image ends early")
        if s < 256:
            out.append(s)
            continue
        bits.at = at
        length = read_extra(bits, s - 256)
        d = read_distance(bits, distance, width)
        at = bits.at
        if d > len(out) or len(out) + length > n:
            raise ValueError("a back-reference leaves the image")
        seen = out[len(out) - d : len(out) - d + length]
        out += (seen * -(-length // len(seen)))[:length]
    bits.at = at
    return np.frombuffer(bytes(out), np.uint8)


def read_pixels(bits: Bits, width: int, height: int, main: bool) -> list[int] | np.ndarray:
    """An entropy-coded image: packed ARGB, row by row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    group_of, group_bits, n_groups = None, 0, 1
    if main and bits.read(1):
        group_bits = bits.read(3) + 2
        across = -(-width >> group_bits)
        group_of = [p >> 8 & 0xFFFF for p in read_pixels(bits, across, -(-height >> group_bits), False)]
        n_groups = max(group_of) + 1
    sizes = (256 + N_LENGTHS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, N_DISTANCES)
    groups = [[read_code(bits, s) for s in sizes] for _ in range(n_groups)]
    n = width * height
    green, red, blue, alpha, distance = groups[0]
    if n_groups == 1 and green.top < 256 and not cache_bits and None not in (red.single, blue.single, alpha.single):
        symbols, bits.at = literal_chain(bits.data, bits.at, green, n)
        return symbols.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
    if n_groups == 1 and not cache_bits and None not in (red.single, blue.single, alpha.single):
        symbols = copy_chain(bits, green, distance, width, n)
        return symbols.astype(np.uint32) << np.uint32(8) | np.uint32(alpha.single << 24 | red.single << 16 | blue.single)
    out: list[int] = []
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    seen = 0  # pixels that are in the cache

    def catch_up() -> None:
        nonlocal seen
        for p in out[seen:]:
            cache[(p * CACHE_FACTOR & 0xFFFFFFFF) >> shift] = p
        seen = len(out)

    while len(out) < n:
        if group_of:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, distance = groups[group_of[(y >> group_bits) * across + (x >> group_bits)]]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out.append(alpha.read(bits) << 24 | r << 16 | s << 8 | b)
        elif s < 256 + N_LENGTHS:
            length = read_extra(bits, s - 256)
            d = read_distance(bits, distance, width)
            if d > len(out) or len(out) + length > n:
                raise ValueError("a back-reference leaves the image")
            for _ in range(length):
                out.append(out[-d])
        else:
            catch_up()
            out.append(cache[s - 256 - N_LENGTHS])
    return out


def _average(a: int, b: int) -> int:
    return sum((((a >> k & 255) + (b >> k & 255)) >> 1) << k for k in (0, 8, 16, 24))


def _clamp(x: int) -> int:
    return 0 if x < 0 else 255 if x > 255 else x


def _select(left: int, top: int, corner: int) -> int:
    to_left = sum(abs((top >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    to_top = sum(abs((left >> k & 255) - (corner >> k & 255)) for k in (0, 8, 16, 24))
    return left if to_left < to_top else top


def _gradient(a: int, b: int, c: int) -> int:
    return sum(_clamp((a >> k & 255) + (b >> k & 255) - (c >> k & 255)) << k for k in (0, 8, 16, 24))


def _half(a: int, b: int) -> int:
    # The half is rounded towards zero.
    return sum(_clamp((a >> k & 255) + int(((a >> k & 255) - (b >> k & 255)) / 2)) << k for k in (0, 8, 16, 24))


#: The predictors by mode, from the left, top, top-left and top-right pixels.
PREDICT = (
    lambda le, t, tl, tr: BLACK,
    lambda le, t, tl, tr: le,
    lambda le, t, tl, tr: t,
    lambda le, t, tl, tr: tr,
    lambda le, t, tl, tr: tl,
    lambda le, t, tl, tr: _average(_average(le, tr), t),
    lambda le, t, tl, tr: _average(le, tl),
    lambda le, t, tl, tr: _average(le, t),
    lambda le, t, tl, tr: _average(tl, t),
    lambda le, t, tl, tr: _average(t, tr),
    lambda le, t, tl, tr: _average(_average(le, tl), _average(t, tr)),
    lambda le, t, tl, tr: _select(le, t, tl),
    lambda le, t, tl, tr: _gradient(le, t, tl),
    lambda le, t, tl, tr: _half(_average(le, t), tl),
)


def predicted(pixels: list[int], i: int, width: int, modes: list[int], bits: int) -> int:
    """The prediction of pixel i from those before it. The pixel right of the last column is the row's own first."""
    y, x = divmod(i, width)
    if not y:
        return pixels[i - 1] if x else BLACK
    if not x:
        return pixels[i - width]
    mode = modes[(y >> bits) * -(-width >> bits) + (x >> bits)] >> 8 & 15
    return PREDICT[mode if mode < 14 else 0](pixels[i - 1], pixels[i - width], pixels[i - width - 1], pixels[i - width + 1])


def _add(a: int, b: int) -> int:
    return (a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00 | (a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF


def _signed(x: int) -> int:
    return x - 256 if x & 128 else x


def cross(p: int, element: int, way: int) -> int:
    """way 1: undo the cross-colour transform of a pixel; -1: do it."""
    green, red, blue = p >> 8 & 255, p >> 16 & 255, p & 255
    to_red, to_blue, red_to_blue = _signed(element & 255), _signed(element >> 8 & 255), _signed(element >> 16 & 255)
    new = red + way * (to_red * _signed(green) >> 5) & 255
    blue += way * (to_blue * _signed(green) >> 5) + way * (red_to_blue * _signed(new if way > 0 else red) >> 5)
    return p & 0xFF00FF00 | new << 16 | blue & 255


def bundle(size: int) -> int:
    """log2 of the palette indices that one pixel holds."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode(data: bytes) -> tuple[int, int, np.ndarray]:
    """(width, height, packed ARGB as uint32) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image")
        at += 8 + -(-int.from_bytes(data[at + 4 : at + 8], "little") // 2) * 2
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    across, undo = width, []
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            k = bits.read(3) + 2
            undo.append((kind, across, k, list(map(int, read_pixels(bits, -(-across >> k), -(-height >> k), False)))))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, across, 0, []))
        else:
            size = bits.read(8) + 1
            colours, before = [], 0
            for p in read_pixels(bits, size, 1, False):
                before = _add(before, int(p))
                colours.append(before)
            k = bundle(size)
            undo.append((kind, across, k, colours))
            across = -(-across >> k)
    pixels = np.asarray(read_pixels(bits, across, height, True), np.uint32)
    for kind, across, k, extra in reversed(undo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, across, extra, k)
        elif kind == CROSS_COLOUR:
            row = -(-across >> k)
            pixels = np.array([cross(p, extra[(i // across >> k) * row + (i % across >> k)], 1) for i, p in enumerate(pixels.tolist())], np.uint32)
        elif kind == SUBTRACT_GREEN:
            channels = pixels.copy().view(np.uint8).reshape(-1, 4)
            channels[:, 0] += channels[:, 1]
            channels[:, 2] += channels[:, 1]
            pixels = channels.view(np.uint32).ravel()
        else:
            step = 8 >> k
            colours = np.array(extra + [0] * (256 - len(extra)), np.uint32)
            held = (pixels >> np.uint32(8)).astype(np.uint8).reshape(height, -1)
            index = np.repeat(held, 1 << k, 1)[:, :across] >> (step * (np.arange(across) & (1 << k) - 1)).astype(np.uint8) & np.uint8((1 << step) - 1)
            pixels = colours[index.ravel()]
    return width, height, pixels


def undo_predictor(pixels: np.ndarray, width: int, modes: list[int], bits: int) -> np.ndarray:
    """Pixels from what the predictor left of them. One mode, left or top, for all is a running sum."""
    kinds = {m >> 8 & 15 for m in modes}
    if kinds <= {1} or kinds <= {2}:
        channels = pixels.copy().view(np.uint8).reshape(-1, width, 4)
        # The first pixel is predicted as black, the first row from the left, the first column from the top.
        channels[0, 0, 3] += 255
        channels[0] = np.cumsum(channels[0], 0, np.uint8)
        if kinds == {1}:
            channels[:, 0] = np.cumsum(channels[:, 0], 0, np.uint8)
            channels[1:] = np.cumsum(channels[1:], 1, np.uint8)
        else:
            channels = np.cumsum(channels, 0, np.uint8)
        return np.ascontiguousarray(channels).view(np.uint32).ravel()
    out = pixels.tolist()
    for i, p in enumerate(out):
        out[i] = _add(p, predicted(out, i, width, modes, bits))
    return np.array(out, np.uint32)


# Writing


class Writer:
    """Collects little-endian bit fields."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(counts: list[tuple[int, int]], most: int = 15) -> dict[int, int]:
    """Lengths of an optimal prefix code of (symbol, count); counts are halved until no length exceeds ``most``."""
    while True:
        heap = [(n, s, (s,)) for s, n in counts]
        heapq.heapify(heap)
        depth = dict.fromkeys((s for s, _ in counts), 0)
        while len(heap) > 1:
            n, s, a = heapq.heappop(heap)
            m, _, b = heap[0]
            for x in a + b:
                depth[x] += 1
            heapq.heapreplace(heap, (n + m, s, a + b))
        if max(depth.values()) <= most:
            return depth
        counts = [(s, (n + 1) // 2) for s, n in counts]


def put_code(w: Writer, lengths: dict[int, int], size: int) -> None:
    """Writes a code; lengths hold the used symbols only."""
    used = sorted(lengths)
    if len(used) == 1 and used[0] < 256:
        w.put(1 | (used[0] > 1) << 2, 3)
        w.put(used[0], 8 if used[0] > 1 else 1)
        return
    if len(used) == 1:
        # No simple code reaches it: a second symbol makes the code complete.
        lengths = {0: 1, used[0]: 1}
        used = [0, used[0]]
    w.put(0, 1)
    items: list[tuple[int, int, int]] = []  # code-length symbol, extra value, extra bits
    at = 0
    for s in used:
        gap = s - at
        while gap >= 11:
            k = min(gap, 138)
            items.append((18, k - 11, 7))
            gap -= k
        if gap >= 3:
            items.append((17, gap - 3, 3))
            gap = 0
        items += [(0, 0, 0)] * gap
        items.append((lengths[s], 0, 0))
        at = s + 1
    counts: dict[int, int] = {}
    for k, _, _ in items:
        counts[k] = counts.get(k, 0) + 1
    meta = code_lengths(list(counts.items()), 7) if len(counts) > 1 else {next(iter(counts)): 1}
    shown = max(4, max(CODE_LENGTH_ORDER.index(k) for k in meta) + 1)
    w.put(shown - 4, 4)
    for k in CODE_LENGTH_ORDER[:shown]:
        w.put(meta.get(k, 0), 3)
    # The number of code lengths that follow, so that the zeros behind the last are left out.
    need = (len(items) - 2).bit_length()
    field = max(0, -(-(need - 2) // 2))
    if len(items) < 2:
        w.put(0, 1)
    else:
        w.put(1 | field << 1, 4)
        w.put(len(items) - 2, 2 + 2 * field)
    dense = [0] * 19
    for k, n in meta.items():
        dense[k] = n
    codes = {s: (c, n) for s, n, c in canonical(dense)} if len(meta) > 1 else {next(iter(meta)): (0, 0)}
    for k, extra, n in items:
        w.put(*codes[k])
        w.put(extra, n)
    if len(items) < 2:
        raise ValueError("a code of one length can't be written so")


def riff(width: int, height: int, body: bytes, more: bytes = b"") -> bytes:
    """The file of an image's bits."""
    image = b"\x2f" + struct.pack("<I", width - 1 | height - 1 << 14 | 1 << 28) + body
    chunk = b"VP8L" + struct.pack("<I", len(image)) + image + bytes(len(image) & 1) + more
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def packed_bits(codes: np.ndarray, sizes: np.ndarray, start: Writer) -> bytes:
    """The writer's bits, then each code in turn."""
    ends = start.n + np.cumsum(sizes, dtype=np.int64)
    at = ends - sizes
    total = int(ends[-1]) if len(ends) else start.n
    shifted = codes.astype(np.uint64) << (at & 31).astype(np.uint64)
    word = at >> 5
    n = total // 32 + 2
    sums = np.bincount(word, (shifted & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    sums[1:] += np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), n)[:-1]
    out = sums.astype(np.uint64).astype("<u4").tobytes()[: -(-total // 8)]
    head = start.value.to_bytes(-(-start.n // 8), "little")
    if not len(head):
        return out
    k = start.n // 8
    return head[:k] + (bytes([head[k] | out[k]]) + out[k + 1 :] if start.n & 7 and len(out) > k else head[k:] + out[k + 1 :] if start.n & 7 else out[k:])


def prefixed(value: int) -> tuple[int, int, int]:
    """(prefix, extra value, extra bits) of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & (1 << n) - 1, n


def lengths_of(counts: np.ndarray) -> dict[int, int]:
    used = np.flatnonzero(counts)
    return code_lengths(list(zip(used.tolist(), counts[used].tolist(), strict=True))) if len(used) > 1 else {int(used[0]): 1}


def tables(lengths: dict[int, int], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol; a single symbol takes no bits."""
    dense, code, width = [0] * size, np.zeros(size, np.uint32), np.zeros(size, np.int64)
    if len(lengths) > 1:
        for s, k in lengths.items():
            dense[s] = k
        for s, k, c in canonical(dense):
            code[s], width[s] = c, k
    return code, width


def put_image(w: Writer, samples: np.ndarray, alpha: int, main: bool = True) -> bytes:
    """An image of green literals and one alpha, after what w holds."""
    w.put(0, 2 if main else 1)  # no colour cache, one group of codes
    lengths = lengths_of(np.bincount(samples, minlength=256))
    put_code(w, lengths, 256 + N_LENGTHS)
    for only in (0, 0, alpha, 0):  # red, blue, alpha, distance
        put_code(w, {only: 1}, 256)
    if len(lengths) == 1:
        return w.value.to_bytes(-(-w.n // 8), "little")
    code, size = tables(lengths, 256)
    return packed_bits(code[samples], size[samples], w)


def plain_body(samples: np.ndarray) -> bytes:
    w = Writer()
    w.put(0, 1)  # no transform
    return put_image(w, samples, 255)


def palette_body(samples: np.ndarray, width: int, used: np.ndarray) -> bytes:
    """Indices of up to 16 values, several in a pixel."""
    w = Writer()
    w.put(1 | PALETTE << 1, 3)
    w.put(len(used) - 1, 8)
    # The palette: one row of colours, each less the one before it.
    w.put(0, 1)
    green, alpha = np.diff(used, prepend=0), [255] + [0] * (len(used) - 1)
    of_green, of_alpha = lengths_of(np.bincount(green, minlength=256)), dict.fromkeys(alpha, 1)
    for code, size in ((of_green, 256 + N_LENGTHS), ({0: 1}, 256), ({0: 1}, 256), (of_alpha, 256), ({0: 1}, 256)):
        put_code(w, code, size)
    fields = [tables(x, 256) for x in (of_green, of_alpha)]
    for pair in zip(green.tolist(), alpha, strict=True):
        for (code, size), x in zip(fields, pair, strict=True):
            w.put(int(code[x]), int(size[x]))
    w.put(0, 1)
    k = bundle(len(used))
    index = np.searchsorted(used, samples).reshape(-1, width // (1 << k), 1 << k)
    return put_image(w, (index << (8 >> k) * np.arange(1 << k)).sum(2).astype(np.uint8).ravel(), 255)


def predictor_body(rest: np.ndarray, width: int, mode: int) -> bytes:
    w = Writer()
    w.put(1 | PREDICTOR << 1, 3)
    w.put(7, 3)  # blocks of 512 pixels, all of one mode
    put_modes = put_image(w, np.array([mode], np.uint8), 255, False)
    assert len(put_modes) == -(-w.n // 8)
    w.put(0, 1)
    return put_image(w, rest, 0)


def predictor_rest(samples: np.ndarray, width: int, mode: int) -> np.ndarray:
    """What left (1) or top (2) leaves of the samples."""
    x = samples.reshape(-1, width)
    rest = x.copy()
    rest[0, 1:] -= x[0, :-1]
    if mode == 1:
        rest[1:, 1:] -= x[1:, :-1]
        rest[1:, 0] -= x[:-1, 0]
    else:
        rest[1:] -= x[:-1]
    return rest.ravel()


def entropy(samples: np.ndarray) -> float:
    """Bits of the samples by their own frequencies."""
    n = np.bincount(samples, minlength=256)
    n = n[n > 0]
    return float((n * np.log2(len(samples) / n)).sum())


def copies(samples: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of copies, greedily from the left, each from the last place with the same 8 bytes."""
    n, raw = len(samples), samples.tobytes()
    wide = samples.astype(np.uint64)
    word = np.zeros(n - 7, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | wide[k : n - 7 + k]
    order = np.argsort(word, kind="stable")
    same = word[order][1:] == word[order][:-1]
    before = np.full(len(word), -1)
    before[order[1:][same]] = order[:-1][same]
    before[np.arange(len(word)) - before >= 1 << 20] = -1
    at = np.flatnonzero(before >= 0)
    out, i, k, places, sources = [], 0, 0, at.tolist(), before.tolist()
    while k < len(places):
        p = places[k]
        if p < i:
            k = int(np.searchsorted(at, i))
            continue
        d, length, most = p - sources[p], 8, min(LONGEST, n - p)
        while length < most:
            step = min(length, most - length)
            if raw[p + length : p + length + step] != raw[p + length - d : p + length - d + step]:
                while raw[p + length] == raw[p + length - d]:
                    length += 1
                break
            length += step
        if length >= SHORTEST:
            out.append((p, length, d))
            i = p + length
        k += 1
    return out


def copy_body(samples: np.ndarray, found: list[tuple[int, int, int]]) -> bytes:
    """Literals and copies."""
    lens, dists = [prefixed(n) for _, n, _ in found], [prefixed(d + 120) for _, _, d in found]
    covered = np.zeros(len(samples) + 1, np.int64)
    place, length = np.array([p for p, _, _ in found]), np.array([n for _, n, _ in found])
    np.add.at(covered, place, 1)
    np.add.at(covered, place + length, -1)
    literal = np.flatnonzero(np.cumsum(covered[:-1]) == 0)
    green = np.bincount(samples[literal], minlength=256 + N_LENGTHS)
    green += np.bincount([256 + p for p, _, _ in lens], minlength=256 + N_LENGTHS)
    of_green, of_distance = lengths_of(green), lengths_of(np.bincount([p for p, _, _ in dists], minlength=N_DISTANCES))
    w = Writer()
    w.put(0, 3)
    put_code(w, of_green, 256 + N_LENGTHS)
    for only in (0, 0, 255):
        put_code(w, {only: 1}, 256)
    put_code(w, of_distance, N_DISTANCES)
    code, size = tables(of_green, 256 + N_LENGTHS)
    far, far_size = tables(of_distance, N_DISTANCES)
    # Fields in order: a literal has one, a copy four, at the place where it begins.
    order = np.concatenate([literal * 4, np.repeat(place * 4, 4) + np.tile(np.arange(4), len(place))])
    s, d = np.array([256 + p for p, _, _ in lens]), np.array([p for p, _, _ in dists])
    fields = np.stack([code[s], [x for _, x, _ in lens], far[d], [x for _, x, _ in dists]], 1).ravel()
    widths = np.stack([size[s], [n for _, _, n in lens], far_size[d], [n for _, _, n in dists]], 1).ravel()
    by = np.argsort(order)
    return packed_bits(np.concatenate([code[samples[literal]], fields])[by], np.concatenate([size[samples[literal]], widths])[by], w)


def encode_image(payload: bytes) -> bytes:
    n = len(payload)
    width, more = 64, b""
    if n > 64 * 16383:
        width = 16384
        payload += bytes(-n % width)
        more = COUNT_CHUNK + struct.pack("<IQ", 8, n)
    samples = np.frombuffer(payload, np.uint8)
    used = np.flatnonzero(np.bincount(samples, minlength=256))
    bodies = [plain_body(samples)]
    if 1 < len(used) <= 16:
        bodies.append(palette_body(samples, width, used))
    if len(used) > 1:
        rest = {mode: predictor_rest(samples, width, mode) for mode in (1, 2)}
        bits, mode = min((entropy(r), mode) for mode, r in rest.items())
        if bits < 0.95 * entropy(samples):
            bodies.append(predictor_body(rest[mode], width, mode))
        # Copies are looked for where there is much to copy, so that few symbols are left to read.
        if n >= 256 and len(zlib.compress(payload, 1)) < n // 4 and (found := copies(samples)):
            bodies.append(copy_body(samples, found))
    return riff(width, len(payload) // width, min(bodies, key=len), more)


def encode_samples(payload: bytes) -> bytes:
    """Lossless WebP files, one unless the payload is over MOST bytes, with a payload of a multiple of 64 bytes as green samples."""
    return b"".join(encode_image(payload[i : i + MOST]) for i in range(0, len(payload), MOST))


def decode_samples(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        one = data[at : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")]
        _, _, pixels = decode(one)
        samples = (pixels >> np.uint32(8)).astype(np.uint8).tobytes()
        count = one.rfind(COUNT_CHUNK, len(one) - 16) if len(samples) > 64 * 16383 else -1
        out.append(samples[: struct.unpack_from("<Q", one, count + 8)[0]] if count >= 0 else samples)
        at += len(one)
    return b"".join(out)


def feature(payload: bytes) -> str:
    """Height, mean, spread and the shares of four ranges of the samples, from the pixel array."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 6, minlength=4)
    return f"{len(x) // 64}:{x.mean():.4f}:{x.std():.4f}:" + ",".join(map(str, shares.tolist()))


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WebP file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4 << 20):
            raw = texts(batch)
            yield rows(MEDIA, doc_id=batch.column(0), n_bytes=list(map(len, raw)), media=[encode_samples(padded(x)) for x in raw])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, pixels) of a table with media: the samples as bytes."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("pixels", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4 << 20):
            yield rows(out, doc_id=batch.column(0), n_bytes=batch.column(1), pixels=[decode_samples(x) for x in batch.column(2).to_pylist()])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, pixels binary")


def media_report(media: DataFrame) -> DataFrame:
    """Digests of the stored files and of the payloads decoded from them."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in chunks(batches, 4 << 20):
            media = batch.column(2).to_pylist()
            read = [decode_samples(x) for x in media]
            yield rows(out, doc_id=batch.column(0), n_bytes=batch.column(1), payload_bytes=list(map(len, read)), payload_sha256=list(map(sha, read)), tail_crc32=[zlib.crc32(x[-64:]) for x in read], media_bytes=list(map(len, media)), media_sha256=list(map(sha, media)), feature=list(map(feature, read)))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
