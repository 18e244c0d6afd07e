"""Lossless WebP (VP8L) in numpy and Python, and documents stored as such images.

``decode`` reads the whole format: prefix codes (simple and normal, one or many groups), back-references
with the plane distance map, the colour cache, and the four transforms, of which it inverts predictor,
cross-colour, green subtraction and palette (with pixel bundling). ``encode`` writes prefix codes,
back-references, and the colour cache, a palette, predictor and cross-colour transforms where they pay.

A document's UTF-8 bytes, filled with 255 to a positive multiple of 576, are four 8-bit samples a pixel,
144 pixels a row. Null text counts as empty. Texts of any length are stored whole: beyond 16,384 rows the
image grows in width, and a chunk after the image tells the payload's length. Equal texts give equal
bytes. Empty tables give no rows; repeated rows and ids repeat their results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import read_table

UNIT = 576
ROW = 144
SIDE = 1 << 14
LONGEST = 4096
#: Images that are decoded together, and the number below which they are decoded one by one.
DECODED_ROWS, DECODED_BYTES, LANES = 1024, 8 << 20, 12
#: Images that are encoded together, and the pixels beyond which one is encoded alone.
TOGETHER, TOGETHER_PIXELS = 64, 1 << 14
MOST_BITS = 15
#: Longest code that is written: a pixel's four codes fit one 64-bit value.
WRITTEN_BITS = 14
NEVER = 1 << 62
#: Side of a tile of the transforms that ``encode`` chooses itself, in bits; bits that a tile's side pixel costs at most.
AUTO_TILE, PAYS = 9, 4
#: Bits of the colour cache that ``encode`` chooses itself.
AUTO_CACHE = 8

# Fixed values of the format: the order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: (columns left, rows up) of the distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


def _up(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values in order; sorting beats hashing on arrays of a few thousand."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


# ---------------------------------------------------------------- prefix codes


_REVERSED = np.zeros(1, np.int64)
for _ in range(MOST_BITS):  # bit reversal of 15-bit numbers
    _REVERSED = np.concatenate([2 * _REVERSED, 2 * _REVERSED + 1])


def _in_order(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with a length in the order of their codes, their lengths, and the shares of the code space."""
    used = np.flatnonzero(lengths)
    used = used[np.argsort(lengths[used], kind="stable")]
    return used, lengths[used], 1 << (MOST_BITS - lengths[used])


def canonical(lengths: list[int]) -> np.ndarray:
    """Codes of the symbols with a length, bit-reversed, as they are stored least bit first."""
    all_ = np.array(lengths, np.int64)
    used, _, share = _in_order(all_)
    # A code followed by zeros is the share of all codes before it; reversed, the zeros lead.
    all_[used] = _REVERSED[np.cumsum(share) - share]
    return all_


class PrefixTable:
    """Lookup of the next symbol: ``table[bits & mask]`` is symbol << 4 | length."""

    def __init__(self, lengths: list[int]):
        used, each, share = _in_order(np.array(lengths, np.int64))
        self.last = int(used.max()) if len(used) else 0  # the largest symbol
        if len(used) == 1:
            self.mask, self.bits = 0, 0
            self.symbols, self.sizes = used, np.zeros(1, np.int64)
        elif share.sum() != 1 << MOST_BITS:
            raise ValueError("incomplete or oversubscribed prefix code")
        else:
            self.bits = bits = int(each[-1])
            self.mask = (1 << bits) - 1
            index = np.repeat(np.arange(len(used)), 1 << (bits - each))[_REVERSED[: 1 << bits] >> (MOST_BITS - bits)]
            self.symbols, self.sizes = used[index], each[index]
        self._table: list[int] | None = None

    @classmethod
    def made(cls, symbols: np.ndarray, sizes: np.ndarray, last: int) -> "PrefixTable":
        """A table whose entries are known."""
        out = cls.__new__(cls)
        out.symbols, out.sizes, out.last, out._table = symbols, sizes, last, None
        out.mask = len(symbols) - 1
        out.bits = out.mask.bit_length()
        return out

    @classmethod
    def small(cls, lengths: list[int]) -> tuple[list[int], int]:
        """(table, mask) of a code of few symbols, without numpy's cost a call."""
        order = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(order) == 1:
            return [order[0][1] << 4], 0
        bits = order[-1][0] if order else 0
        table, at = [0] * (1 << bits), 0
        for n, s in order:
            table[int(_REVERSED[at << (MOST_BITS - bits)]) if at < 1 << bits else 0 :: 1 << n] = [s << 4 | n] * (1 << (bits - n))
            at += 1 << (bits - n)
        if at != 1 << bits or not order:
            raise ValueError("incomplete or oversubscribed prefix code")
        return table, (1 << bits) - 1

    @property
    def table(self) -> list[int]:
        if self._table is None:
            self._table = (self.symbols << 4 | self.sizes).tolist()
        return self._table

    def shifted(self, by: int) -> list[int]:
        """Symbols shifted to a sample's place in a pixel, over six bits for the length: entries of four samples add up."""
        return (self.symbols << (by + 6) | self.sizes).tolist()


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> list[int]:
    """Huffman code lengths of at most ``most`` bits; rare symbols are counted up until they fit.

    Leaves are sorted once; merged nodes come out in ascending order, so the two least are at the heads of
    two queues.
    """
    used = np.flatnonzero(counts)
    used = used[np.argsort(counts[used], kind="stable")].tolist()
    lengths = [0] * len(counts)
    if len(used) == 1:
        lengths[used[0]] = 1
    weights = counts[used].tolist()
    n, least = len(used), 1
    while n > 1:
        # Both queues end in a value that is never the least.
        leaves = [*(weights if least == 1 else [max(w, least) for w in weights]), NEVER]
        merged = [NEVER] * n
        above = [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            if leaves[i] <= merged[j]:
                pair = leaves[i]
                above[i] = n + k
                i += 1
            else:
                pair = merged[j]
                above[n + j] = n + k
                j += 1
            if leaves[i] <= merged[j]:
                merged[k] = pair + leaves[i]
                above[i] = n + k
                i += 1
            else:
                merged[k] = pair + merged[j]
                above[n + j] = n + k
                j += 1
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= most:
            for s, d in zip(used, depth, strict=False):
                lengths[s] = d
            break
        least *= 2
    return lengths


# ---------------------------------------------------------------- reading


class _Bits:
    def __init__(self, data: bytes):
        self.data = data
        self._windows: list[int] | None = None
        self.end = 8 * len(data)
        self.at = 0

    @property
    def windows(self) -> list[int]:
        """The 64 bits from each byte on."""
        if self._windows is None:
            raw = np.frombuffer(self.data + bytes(64), np.uint8)
            self._windows = np.lib.stride_tricks.sliding_window_view(raw, 8).copy().view("<u8").ravel().tolist()
        return self._windows

    def peek(self, at: int, n: int) -> int:
        """n bits from bit ``at``."""
        return int.from_bytes(self.data[at >> 3 : (at + n + 7) >> 3], "little") >> (at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        at = self.at
        if at + n > self.end:
            raise ValueError("the bit stream ends early")
        self.at = at + n
        return self.peek(at, n)

    def symbol(self, code: PrefixTable) -> int:
        at = self.at
        entry = code.table[(self.windows[at >> 3] >> (at & 7)) & code.mask]
        self.at = at + (entry & 15)
        if self.at > self.end:
            raise ValueError("the bit stream ends early")
        return entry >> 4


def _read_small(bits: _Bits, size: int) -> tuple[list[int], list[int] | None, int, int]:
    """The start of a prefix code: (lengths, None, 0, 0) of a simple one, else the code-length code's table and mask, and how many of its symbols follow."""
    if bits.read(1):
        lengths = [0] * size
        two, wide = bits.read(1), bits.read(1)
        lengths[bits.read(8 if wide else 1)] = 1
        if two:
            lengths[bits.read(8)] = 1
        return lengths, None, 0, 0
    own = [0] * len(LENGTH_ORDER)
    n = 4 + bits.read(4)
    word = bits.read(3 * n)
    for s in LENGTH_ORDER[:n]:
        own[s] = word & 7
        word >>= 3
    table, mask = PrefixTable.small(own)
    return [], table, mask, 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size


def _read_code(bits: _Bits, size: int, made: dict) -> PrefixTable:
    """The next prefix code; codes with equal lengths share a table."""
    lengths, table, mask, left = _read_small(bits, size)
    if table is None:
        return PrefixTable(lengths)
    previous = 8
    windows, at = bits.windows, bits.at
    while len(lengths) < size and left:
        left -= 1
        word = windows[at >> 3] >> (at & 7)
        entry = table[word & mask]
        n = entry & 15
        s = entry >> 4
        if s < 16:
            at += n
            lengths.append(s)
            previous = s or previous
        else:
            word >>= n
            extra, least = ((2, 3), (3, 3), (7, 11))[s - 16]
            at += n + extra
            lengths += [previous if s == 16 else 0] * (least + (word & ((1 << extra) - 1)))
    bits.at = at
    if len(lengths) > size or at > bits.end:
        raise ValueError("too many code lengths, or the bit stream ends early")
    while not lengths[-1]:
        lengths.pop()
        if not lengths:
            raise ValueError("incomplete or oversubscribed prefix code")
    key = tuple(lengths)
    if key not in made:
        made[key] = PrefixTable(lengths)
    return made[key]


# By code-length symbol: bits that follow it, and the least number of lengths it stands for.
_EXTRA = np.array([0] * 16 + [2, 3, 7])
_REPEATS = np.array([1] * 16 + [3, 3, 11])


def _read_codes(bits: list[_Bits], sizes: list[int], windows: np.ndarray, starts: np.ndarray) -> list[PrefixTable]:
    """The next prefix code of each of many streams, a length of each at a time; ``starts``: where a stream begins in ``windows``, in bits."""
    out: list[PrefixTable | None] = [None] * len(bits)
    many, tables, offsets, masks, left = [], [], [], [], []
    held = 0
    for k, (stream, size) in enumerate(zip(bits, sizes, strict=True)):
        lengths, table, mask, follow = _read_small(stream, size)
        if table is None:
            out[k] = PrefixTable(lengths)
        else:
            many.append(k)
            tables += table
            offsets.append(held)
            masks.append(mask)
            left.append(follow)
            held += len(table)
    if not many:
        return out
    lanes, table = np.array(many), np.array(tables)
    offset, mask, left = np.array(offsets), np.array(masks), np.array(left)
    size = np.array(sizes)[lanes]
    pos = np.array([bits[k].at for k in many]) + starts[lanes]
    at, previous = np.zeros(len(lanes), np.int64), np.full(len(lanes), 8)
    grid = np.zeros((len(lanes), int(size.max())), np.int64)
    live = np.arange(len(lanes))
    place, base, low, room, ahead, wide = pos, offset, mask, size, left, at
    ends = np.zeros(len(lanes), np.int64)
    filled = np.zeros(len(lanes), np.int64)
    while len(live):
        word = (windows[place >> 3] >> (place & 7).astype(np.uint64)).astype(np.int64)
        entry = table[base + (word & low)]
        n, symbol = entry & 15, entry >> 4
        extra = _EXTRA[symbol]
        count = _REPEATS[symbol] + ((word >> n) & ((1 << extra) - 1))
        plain = symbol < 16
        if (wide + count > room).any():
            raise ValueError("too many code lengths, or the bit stream ends early")
        grid[live[plain], wide[plain]] = symbol[plain]
        for i in np.flatnonzero(symbol == 16):
            grid[live[i], wide[i] : wide[i] + count[i]] = previous[live[i]]
        seen = plain & (symbol > 0)
        previous[live[seen]] = symbol[seen]
        place = place + n + extra
        wide = wide + count
        ahead = ahead - 1
        over = (ahead == 0) | (wide >= room)
        if over.any():
            ends[live[over]], filled[live[over]] = place[over], wide[over]
            stay = ~over
            live, place, base, low, room, ahead, wide = (x[stay] for x in (live, place, base, low, room, ahead, wide))
    for lane, k in enumerate(many):
        bits[k].at = int(ends[lane] - starts[k])
        if bits[k].at > bits[k].end:
            raise ValueError("too many code lengths, or the bit stream ends early")
    for k, made in zip(many, _tables(grid), strict=True):
        out[k] = made
    return out


def _tables(grid: np.ndarray) -> list[PrefixTable]:
    """A table for each row of code lengths."""
    row, symbol = np.nonzero(grid)
    length = grid[row, symbol]
    order = np.argsort(row * 16 + length, kind="stable")
    row, symbol, length = row[order], symbol[order], length[order]
    used = np.bincount(row, minlength=len(grid))
    share = np.bincount(row, weights=np.ldexp(1.0, MOST_BITS - length), minlength=len(grid))
    if ((used != 1) & (share != 1 << MOST_BITS)).any():
        raise ValueError("incomplete or oversubscribed prefix code")
    last = len(grid[0]) - 1 - np.argmax(grid[:, ::-1] > 0, axis=1)
    bits = np.where(used == 1, 0, grid.max(axis=1))
    out: list[PrefixTable | None] = [None] * len(grid)
    for n in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == n)
        mine = bits[row] == n
        each = length[mine] if n else np.zeros(int(mine.sum()), np.int64)
        times = 1 << (n - each)
        turn = _REVERSED[: 1 << n] >> (MOST_BITS - n)
        symbols = np.repeat(symbol[mine], times).reshape(len(rows), 1 << n)[:, turn]
        sizes = np.repeat(each, times).reshape(len(rows), 1 << n)[:, turn]
        for i, k in enumerate(rows.tolist()):
            out[k] = PrefixTable.made(symbols[i], sizes[i], int(last[k]))
    return out


def _read_group(bits: _Bits, size: int, made: dict) -> list[PrefixTable]:
    """The five codes of a group; a code that is stored with the bits of the one before is that code."""
    out: list[PrefixTable] = []
    stored = (0, 0)
    for n in (size, 256, 256, 256, 40):
        start, width = bits.at, stored[1]
        if n == 256 and width and bits.peek(start, width) == stored[0] and len(out[-1].symbols) and out[-1].last < 256:
            bits.at += width
            out.append(out[-1])
            continue
        out.append(_read_code(bits, n, made))
        stored = (bits.peek(start, bits.at - start), bits.at - start)
    return out


def _prefix_value(bits: _Bits, code: int) -> int:
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def _read_image(bits: _Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image as ARGB values."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    groups_at, tile = None, 0
    n_groups = 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        meta = _read_image(bits, _up(width, tile), _up(height, tile), False)
        groups_at = ((meta >> 8) & 0xFFFF).tolist()
        n_groups = max(groups_at) + 1
    made: dict = {}
    groups = [_read_group(bits, _green_size(cache_bits), made) for _ in range(n_groups)]
    return np.array(_read_pixels(bits, width, width * height, groups, cache_bits, [], groups_at, tile), np.uint32)


def _green_size(cache_bits: int) -> int:
    return 256 + 24 + (1 << cache_bits if cache_bits else 0)


def _read_pixels(bits: _Bits, width: int, total: int, groups: list, cache_bits: int, out: list[int], groups_at: list[int] | None = None, tile: int = 0) -> list[int]:
    """``out`` with the pixels after it up to ``total``, one by one."""
    cache = [0] * (1 << cache_bits) if cache_bits else None
    shift = 32 - cache_bits
    cached = 0  # pixels already in the cache
    windows, end = bits.windows, bits.end
    across = _up(width, tile) if tile else 0
    at = bits.at
    append = out.append
    shifted: dict[int, list[list[int]]] = {}
    single_load = False
    stop = 0  # pixel at which the prefix codes change
    while (have := len(out)) < total:
        if have >= stop:
            if groups_at is None:
                group, stop = groups[0], total
            else:
                y, x = divmod(have, width)
                group = groups[groups_at[(y >> tile) * across + (x >> tile)]]
                stop = y * width + min(width, ((x >> tile) + 1) << tile)
            (g_mask, r_mask, b_mask, a_mask), far = (c.mask for c in group[:4]), group[4]
            if id(group) not in shifted:
                shifted[id(group)] = [c.shifted(by) for c, by in zip(group, (8, 16, 0, 24), strict=False)]
            g_table, r_table, b_table, a_table = shifted[id(group)]
            single_load = sum(c.bits for c in group[:4]) <= 57
        green = 0
        if single_load:
            for _ in range(stop - have):  # literals
                word = windows[at >> 3] >> (at & 7)
                g = g_table[word & g_mask]
                if g >= 1 << 22:
                    green = g
                    at += g & 63
                    break
                word >>= g & 63
                r = r_table[word & r_mask]
                word >>= r & 63
                b = b_table[word & b_mask]
                g += r + b + a_table[(word >> (b & 63)) & a_mask]
                at += g & 63
                append(g >> 6)
        else:
            for _ in range(stop - have):
                word = windows[at >> 3] >> (at & 7)
                g = g_table[word & g_mask]
                at += g & 63
                if g >= 1 << 22:
                    green = g
                    break
                r = r_table[(word >> (g & 63)) & r_mask]
                at += r & 63
                word = windows[at >> 3] >> (at & 7)
                b = b_table[word & b_mask]
                a = a_table[(word >> (b & 63)) & a_mask]
                at += (b & 63) + (a & 63)
                append(g + r + b + a >> 6)
        if at > end:
            raise ValueError("the bit stream ends early")
        green >>= 14
        if green < 256:
            continue
        if green < 280:
            bits.at = at
            length, distance = _copy_of(bits, green - 256, far, width)
            at = bits.at
            start = len(out) - distance
            if start < 0 or len(out) + length > total:
                raise ValueError("back-reference out of the image")
            if distance >= length:
                out += out[start : start + length]
            else:
                piece = out[start:]
                out += (piece * (length // distance + 1))[:length]
        else:
            for value in out[cached:]:
                cache[((value * CACHE_FACTOR) & 0xFFFFFFFF) >> shift] = value
            cached = len(out)
            append(cache[green - 280])
    bits.at = at
    return out


def _copy_of(bits: _Bits, code: int, far: PrefixTable, width: int) -> tuple[int, int]:
    """Length and distance of the back-reference whose length code has just been read."""
    length = _prefix_value(bits, code)
    distance = _prefix_value(bits, bits.symbol(far))
    if distance > 120:
        return length, distance - 120
    x, y = NEAR[distance - 1]
    return length, max(1, x + y * width)


def _channels(pixels: np.ndarray) -> np.ndarray:
    """(n, 4) bytes: blue, green, red, alpha."""
    return pixels.astype("<u4").view(np.uint8).reshape(-1, 4)


def _pixels(channels: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(channels, np.uint8).view("<u4").ravel().astype(np.uint32)


def _predict(mode: int, left, top, top_right, top_left) -> np.ndarray:
    """The prediction of one pixel's four samples (int arrays)."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return ((left + top_right) // 2 + top) // 2
    if mode == 6:
        return (left + top_left) // 2
    if mode == 7:
        return (left + top) // 2
    if mode == 8:
        return (top_left + top) // 2
    if mode == 9:
        return (top + top_right) // 2
    if mode == 10:
        return ((left + top_left) // 2 + (top + top_right) // 2) // 2
    if mode == 11:
        guess = left + top - top_left
        by_left = np.abs(guess - left).sum(axis=-1, keepdims=True) < np.abs(guess - top).sum(axis=-1, keepdims=True)
        return np.where(by_left, left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = (left + top) // 2
    delta = mean - top_left
    return np.clip(mean + np.sign(delta) * (np.abs(delta) // 2), 0, 255)


def _residuals(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, tile: int) -> np.ndarray:
    """What is left of the pixels after prediction; every pixel is known, so each mode is one expression."""
    c = _channels(pixels).reshape(height, width, 4).astype(np.int64)
    guess = np.zeros_like(c)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = c[0, :-1]
    guess[1:, 0] = c[:-1, 0]
    if height > 1 and width > 1:
        top, right = c[:-1, 1:], np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)
        y, x = np.mgrid[1:height, 1:width] >> tile
        mode = modes.reshape(-1, _up(width, tile))[y, x]
        for m in np.unique(mode).tolist():
            at = mode == m
            guess[1:, 1:][at] = _predict(m, c[1:, :-1][at], top[at], right[at], c[:-1, :-1][at])
    return _pixels(((c - guess) & 255).reshape(-1, 4))


def _unpredicted(pixels: np.ndarray, width: int, height: int, modes: np.ndarray, tile: int) -> np.ndarray:
    """The pixels of the residuals: row by row where a row predicts from the left or the top only, else pixel by pixel."""
    given = _channels(pixels).reshape(height, width, 4).astype(np.int64)
    whole = np.zeros_like(given)
    modes = modes.reshape(-1, _up(width, tile))
    whole[0] = (np.cumsum(given[0], axis=0) + (0, 0, 0, 255)) & 255
    for y in range(1, height):
        row = modes[y >> tile]
        whole[y, 0] = (given[y, 0] + whole[y - 1, 0]) & 255
        if (row == 2).all():
            whole[y, 1:] = (given[y, 1:] + whole[y - 1, 1:]) & 255
            continue
        if (row == 1).all():
            whole[y, 1:] = (np.cumsum(given[y, 1:], axis=0) + whole[y, 0]) & 255
            continue
        for x in range(1, width):
            right = whole[y - 1, x + 1] if x + 1 < width else whole[y, 0]
            whole[y, x] = (given[y, x] + _predict(int(row[x >> tile]), whole[y, x - 1], whole[y - 1, x], right, whole[y - 1, x - 1])) & 255
    return _pixels(whole.reshape(-1, 4))


def _cross_colour(pixels: np.ndarray, width: int, height: int, factors: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    c = _channels(pixels).copy()
    y, x = np.divmod(np.arange(width * height), width)
    own = _channels(factors)[(y >> tile) * _up(width, tile) + (x >> tile)].view(np.int8).astype(np.int64)
    to_red, to_blue, red_to_blue = own[:, 0], own[:, 1], own[:, 2]
    signed = lambda v: v.astype(np.uint8).view(np.int8).astype(np.int64)
    sign = -1 if forward else 1
    green = signed(c[:, 1])
    old = c[:, 2].copy()
    c[:, 2] = (c[:, 2].astype(np.int64) + sign * (to_red * green >> 5)) & 255
    red = signed(old if forward else c[:, 2])
    c[:, 0] = (c[:, 0].astype(np.int64) + sign * ((to_blue * green >> 5) + (red_to_blue * red >> 5))) & 255
    return _pixels(c)


def _green(pixels: np.ndarray, sign: int) -> np.ndarray:
    c = _channels(pixels).copy()
    for k in (0, 2):
        c[:, k] = c[:, k] + c[:, 1] if sign > 0 else c[:, k] - c[:, 1]
    return _pixels(c)


def _unbundle(pixels: np.ndarray, packed: int, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    green = ((pixels >> 8) & 255).reshape(height, packed)
    each = 8 >> bits
    index = (green[:, :, None] >> (np.arange(1 << bits) * each)) & ((1 << each) - 1)
    index = index.reshape(height, -1)[:, :width].ravel()
    return np.where(index < len(table), table[np.minimum(index, len(table) - 1)], 0).astype(np.uint32)


class _Open:
    """A file whose header and transforms have been read; the main image comes next."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
            raise ValueError("not a lossless WebP file")
        self.bits = bits = _Bits(data[20 : 20 + struct.unpack("<I", data[16:20])[0]])
        if bits.read(8) != 0x2F:
            raise ValueError("bad signature")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.undo: list[tuple] = []
        self.coded = self.width
        while bits.read(1):
            kind = bits.read(2)
            if kind in [u[0] for u in self.undo]:
                raise ValueError("a transform occurs twice")
            if kind in (PREDICTOR, CROSS_COLOUR):
                tile = bits.read(3) + 2
                self.undo.append((kind, self.coded, tile, _read_image(bits, _up(self.coded, tile), _up(self.height, tile), False)))
            elif kind == PALETTE:
                n = bits.read(8) + 1
                steps = _channels(_read_image(bits, n, 1, False))
                packing = _bundle_bits(n)
                self.undo.append((kind, self.coded, packing, _pixels(np.cumsum(steps, axis=0, dtype=np.uint8))))
                self.coded = _up(self.coded, packing)
            else:
                self.undo.append((kind, self.coded, 0, None))

    def single_group(self) -> bool:
        """Whether the main image, which comes next, has one group of prefix codes; then they come next."""
        start = self.bits.at
        self.cache_bits = self.bits.read(4) if self.bits.read(1) else 0
        if self.cache_bits <= 11 and not self.bits.read(1):
            return True
        self.bits.at = start
        return False

    def pixels(self, pixels: np.ndarray) -> np.ndarray:
        for kind, wide, tile, side in reversed(self.undo):
            if kind == PREDICTOR:
                pixels = _unpredicted(pixels, wide, self.height, (side >> 8) & 255, tile)
            elif kind == CROSS_COLOUR:
                pixels = _cross_colour(pixels, wide, self.height, side, tile, False)
            elif kind == SUBTRACT_GREEN:
                pixels = _green(pixels, 1)
            else:
                pixels = _unbundle(pixels, _up(wide, tile), wide, self.height, tile, side)
        return pixels.reshape(self.height, self.width)


def decode(data: bytes) -> np.ndarray:
    """The (height, width) array of ARGB values (uint32) of a lossless WebP file."""
    image = _Open(data)
    return image.pixels(_read_image(image.bits, image.coded, image.height, True))


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """``decode`` of several files; images with one group of codes advance together, a pixel of each at a time."""
    images = [_Open(f) for f in files]
    lanes = [k for k, x in enumerate(images) if x.single_group()]
    out: list[np.ndarray | None] = [None] * len(images)
    for k in set(range(len(images))) - set(lanes):
        x = images[k]
        out[k] = x.pixels(_read_image(x.bits, x.coded, x.height, True))
    if lanes:
        for k, flat in zip(lanes, _read_together([images[k] for k in lanes]), strict=True):
            out[k] = images[k].pixels(flat)
    return out


def _read_groups(images: list[_Open], windows: np.ndarray, starts: np.ndarray) -> list[list[PrefixTable]]:
    """The five prefix codes of each image; a sample's code that is stored with the bits of the one before is that code."""
    groups: list[list[PrefixTable]] = [[] for _ in images]
    stored = [(0, 0)] * len(images)
    for n in (0, 256, 256, 256, 40):
        read = []
        for k, image in enumerate(images):
            bits, (value, width) = image.bits, stored[k]
            if n == 256 and width and bits.peek(bits.at, width) == value and groups[k][-1].last < 256:
                bits.at += width
                groups[k].append(groups[k][-1])
            else:
                read.append((k, bits.at))
        codes = _read_codes([images[k].bits for k, _ in read], [n or _green_size(images[k].cache_bits) for k, _ in read], windows, starts[[k for k, _ in read]])
        for (k, start), code in zip(read, codes, strict=True):
            groups[k].append(code)
            width = images[k].bits.at - start
            stored[k] = (images[k].bits.peek(start, width), width)
    return groups


def _read_together(images: list[_Open]) -> list[np.ndarray]:
    """The main images, each with its prefix codes and colour cache (one entry that is never read where it has none)."""
    totals = np.array([x.coded * x.height for x in images])
    base = np.cumsum(totals) - totals
    raw = b"".join(x.bits.data + bytes(64) for x in images)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), 8).copy().view("<u8").ravel()
    starts = 8 * np.cumsum([0] + [len(x.bits.data) + 64 for x in images[:-1]])
    codes = _read_groups(images, windows, starts)
    bit = np.array([x.bits.at for x in images]) + starts
    tables, offsets, place, size = [], np.zeros((4, len(images)), np.int64), {}, 0
    masks = np.array([[c.mask for c in g[:4]] for g in codes], np.uint64).T.copy()
    for lane, group in enumerate(codes):
        for k, by in enumerate((8, 16, 0, 24)):
            key = (id(group[k]), by)
            if key not in place:
                place[key] = size
                tables.append(group[k].symbols << (by + 6) | group[k].sizes)
                size += len(tables[-1])
            offsets[k, lane] = place[key]
    table = np.concatenate(tables)
    out = np.zeros(int(totals.sum()), np.uint32)
    done = np.zeros(len(images), np.int64)
    slots = np.array([1 << x.cache_bits for x in images])
    cache, first_slot = np.zeros(int(slots.sum()), np.uint32), np.cumsum(slots) - slots
    drop = np.array([32 - x.cache_bits for x in images], np.uint64)
    low, sample_end, copy_end, factor = np.uint64(63), 1 << 22, 280 << 14, np.uint32(CACHE_FACTOR)
    # A pixel's four codes must fit the 57 bits that are left of a word at any bit.
    fits = np.array([sum(c.bits for c in g[:4]) <= 57 for g in codes])
    live = np.flatnonzero(fits)
    while True:
        live = live[done[live] < totals[live]]
        if len(live) < LANES:
            break
        pos, to = bit[live], base[live] + done[live]
        (g_at, r_at, b_at, a_at), (g_mask, r_mask, b_mask, a_mask) = offsets[:, live], masks[:, live]
        own, shift = first_slot[live], drop[live]
        steps = int((totals[live] - done[live]).min())
        odd = None
        for k in range(steps):  # a pixel of every live image
            word = windows[pos >> 3] >> (pos & 7).astype(np.uint64)
            g = table[g_at + (word & g_mask).astype(np.int64)]
            hit = None
            if g.max() >= sample_end:
                hit = np.flatnonzero(g >= sample_end)
                if g[hit].min() < copy_end:
                    odd = hit[g[hit] < copy_end]
                    steps = k
                    break
            word >>= g.astype(np.uint64) & low
            rest = table[r_at + (word & r_mask).astype(np.int64)]
            word >>= rest.astype(np.uint64) & low
            b = table[b_at + (word & b_mask).astype(np.int64)]
            word >>= b.astype(np.uint64) & low
            rest += b
            rest += table[a_at + (word & a_mask).astype(np.int64)]
            if hit is None:
                g += rest
                value = (g >> 6).astype(np.uint32)
            else:  # images whose next pixel is in their cache
                rest[hit] = 0
                entry = own[hit] + (g[hit] >> 14) - 280
                g += rest
                value = (g >> 6).astype(np.uint32)
                value[hit] = cache[entry]
            pos += g & 63
            cache[own + ((value * factor).astype(np.uint64) >> shift).astype(np.int64)] = value
            out[to] = value
            to += 1
        bit[live] = pos
        done[live] += steps
        for i in odd if odd is not None else ():  # back-references, image by image
            lane = int(live[i])
            image = images[lane]
            image.bits.at = int(bit[lane] - starts[lane]) + int(g[i] & 63)
            length, distance = _copy_of(image.bits, (int(g[i]) >> 14) - 256, codes[lane][4], image.coded)
            have = int(done[lane])
            if distance > have or have + length > totals[lane]:
                raise ValueError("back-reference out of the image")
            at = int(base[lane]) + have
            piece = out[at - distance : at]
            piece = np.resize(piece, length) if distance < length else piece[:length]
            out[at : at + length] = piece
            # Of pixels with one place in the cache the last stays, as if they came one by one.
            cache[first_slot[lane] + ((piece * factor).astype(np.uint64) >> drop[lane]).astype(np.int64)] = piece
            done[lane] += length
            bit[lane] = image.bits.at + starts[lane]
    alone = {*live.tolist(), *np.flatnonzero(~fits).tolist()}
    for lane in sorted(alone):
        image = images[lane]
        image.bits.at = int(bit[lane] - starts[lane])
        have = out[base[lane] : base[lane] + done[lane]].tolist()
        out[base[lane] : base[lane] + totals[lane]] = _read_pixels(image.bits, image.coded, int(totals[lane]), [codes[lane]], image.cache_bits, have)
    over = [x.bits.at if k in alone else int(bit[k] - starts[k]) for k, x in enumerate(images)]
    if any(n > x.bits.end for n, x in zip(over, images, strict=True)):
        raise ValueError("the bit stream ends early")
    return np.split(out, base[1:])


# ---------------------------------------------------------------- writing


class _Writer:
    """Collects (value, bits) pairs and packs them at once, least bit first."""

    def __init__(self):
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.loose: list[tuple[int, int]] = []

    def put(self, value: int, bits: int) -> None:
        self.loose.append((value, bits))

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        self._settle()
        self.values.append(values)
        self.sizes.append(bits)

    def _settle(self) -> None:
        if self.loose:
            pairs = np.fromiter(chain.from_iterable(self.loose), np.int64, 2 * len(self.loose)).reshape(-1, 2)
            self.values.append(pairs[:, 0])
            self.sizes.append(pairs[:, 1])
            self.loose = []

    def bytes(self) -> bytes:
        self._settle()
        return _packed(np.concatenate(self.values), np.concatenate(self.sizes), [0])[0]


def _packed(values: np.ndarray, sizes: np.ndarray, first: list[int]) -> list[bytes]:
    """The values' bits, least bit first, as one string of bytes for each run of values that begins at ``first``."""
    values, first = values.astype(np.uint64), np.array(first)
    ends = np.cumsum(sizes)
    begin = ends[first] - sizes[first]
    bits = np.diff(np.r_[begin, ends[-1]])
    words = (bits >> 6) + 2
    base = np.cumsum(words) - words
    at = ends - sizes + np.repeat(64 * base - begin, np.diff(np.r_[first, len(values)]))
    word, low = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()), np.uint64)
    turn = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    # Values fill a word without overlap, so their sum is their union; the high bits of one may go to the next word.
    out[word[turn]] = np.add.reduceat(values << low, turn)
    out[word[turn] + 1] += np.add.reduceat(values >> np.uint64(1) >> (np.uint64(63) - low), turn)
    raw = out.astype("<u8").tobytes()
    return [raw[8 * w : 8 * w + (n + 7) // 8] for w, n in zip(base.tolist(), bits.tolist(), strict=True)]


def _split_value(value: int) -> tuple[int, int, int]:
    """Prefix code, number of extra bits, extra bits."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    extra = v.bit_length() - 2
    return 2 * extra + 2 + ((v >> extra) & 1), extra, v & ((1 << extra) - 1)


def _runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of code lengths, up to each one's last used symbol: row, code-length symbol, extra bits of runs of zeros and their number."""
    row, used = np.nonzero(grid)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    gaps = np.diff(used, prepend=0) - 1
    gaps[start] = used[start]
    # Gaps over 138 take several runs of zeros; each but the last is a run of 138 before the same symbol.
    many = np.maximum(0, gaps - 1) // 138
    rest = gaps - 138 * many
    last = np.where(rest < 3, rest, 1)
    ends = np.cumsum(many + last + 1) - 1
    symbols, extra, width = (np.zeros(int(ends[-1]) + 1, np.int64) for _ in range(3))
    symbols[ends] = grid[row, used]
    for k in np.flatnonzero(many).tolist():
        at = int(ends[k] - last[k] - many[k])
        symbols[at : at + many[k]], extra[at : at + many[k]], width[at : at + many[k]] = 18, 127, 7
    for chosen, symbol, least, bits in (((rest >= 3) & (rest < 11), 17, 3, 3), (rest >= 11, 18, 11, 7)):
        at = ends[chosen] - 1
        symbols[at], extra[at], width[at] = symbol, rest[chosen] - least, bits
    return np.repeat(row, many + last + 1), symbols, extra, width


def _code_bits(lengths: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Prefix codes as values and numbers of bits."""
    out: list[tuple | None] = [None] * len(lengths)
    normal = []
    for k, own in enumerate(lengths):
        n = len(own) - own.count(0)
        used = [s for s, x in enumerate(own) if x] if n <= 2 else None
        if used is not None and (not used or used[-1] < 256):
            pairs = [(1, 1), (int(n > 1), 1), (1, 1), (used[0] if used else 0, 8)] + ([(used[1], 8)] if n > 1 else [])
            out[k] = tuple(np.array(pairs, np.int64).T)
        else:
            normal.append(k)
    if not normal:
        return out
    grid = np.zeros((len(normal), max(len(lengths[k]) for k in normal)), np.int64)
    for i, k in enumerate(normal):
        grid[i, : len(lengths[k])] = lengths[k]
    row, symbols, extra, width = _runs(grid)
    counts = np.bincount(row * 19 + symbols, minlength=19 * len(normal)).reshape(-1, 19)
    own = [code_lengths(c, 7) for c in counts]
    sizes = np.array(own)
    codes = _canonical(sizes)
    sizes[(sizes > 0).sum(axis=1) == 1] = 0
    each = sizes[row, symbols]
    values, bits = codes[row, symbols] | extra << each, each + width
    ends = np.cumsum(np.bincount(row, minlength=len(normal))).tolist()
    for i, k in enumerate(normal):
        at, end = ends[i - 1] if i else 0, ends[i]
        kept = max(4, max(j for j, s in enumerate(LENGTH_ORDER) if own[i][s]) + 1)
        # The number of runs is stored, so the zeros after the last symbol are not, whatever the alphabet's size.
        most = end - at - 2
        wide = max(1, (most.bit_length() + 1) // 2)
        stored = 0
        for j, s in enumerate(LENGTH_ORDER[:kept]):
            stored |= own[i][s] << 3 * j
        head = np.array([(kept - 4) << 1, stored, 1 | (wide - 1) << 1, most])
        out[k] = (np.concatenate([head, values[at:end]]), np.concatenate([[5, 3 * kept, 4, 2 * wide], bits[at:end]]))
    return out


def _canonical(grid: np.ndarray) -> np.ndarray:
    """``canonical`` of each row of code lengths."""
    row, symbol = np.nonzero(grid)
    length = grid[row, symbol]
    order = np.argsort(row * 16 + length, kind="stable")
    row, symbol, share = row[order], symbol[order], 1 << (MOST_BITS - length[order])
    before = np.cumsum(share) - share
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    before -= np.repeat(before[first], np.diff(np.r_[first, len(row)]))
    out = np.zeros_like(grid)
    out[row, symbol] = _REVERSED[before]
    return out


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    """Distance code by distance, for images of that width."""
    return {x + y * width: k + 1 for k, (x, y) in reversed(list(enumerate(NEAR))) if x + y * width >= 1}


def _copies(pixels: np.ndarray, least: int = 4) -> list[tuple[int, int, int]]:
    """Back-references (start, length, distance), greedy, to the last place with the same four pixels."""
    n = len(pixels)
    if n <= least:
        return []
    p = pixels.astype(np.uint64)
    key = np.zeros(n - least + 1, np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + p[k : n - least + 1 + k]
    # Sorted with their place in the low bits, equal keys lie side by side in order; what is copied is compared below.
    low = np.uint64(len(key).bit_length())
    mixed = np.sort(key >> low << low | np.arange(len(key), dtype=np.uint64))
    order = (mixed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    mixed >>= low
    same = np.flatnonzero(mixed[1:] == mixed[:-1])
    if not len(same):
        return []
    before = np.full(len(key), -1)
    before[order[same + 1]] = order[same]
    return _greedy(pixels, np.flatnonzero(before >= 0).tolist(), before, least)


def _greedy(pixels: np.ndarray, places: list[int], before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Copies at the places, each as long as it goes, from the places before."""
    n = len(pixels)
    out, free = [], 0
    for at in places:
        if at < free:
            continue
        old = int(before[at])
        length, most = 0, min(LONGEST, n - at)
        while length < most:
            step = min(256, most - length)
            differ = np.flatnonzero(pixels[at + length : at + length + step] != pixels[old + length : old + length + step])
            if len(differ):
                length += int(differ[0])
                break
            length += step
        if length >= least:
            out.append((at, length, at - old))
            free = at + length
    return out


def _cache_hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The cache place of each pixel, and whether that place holds the pixel when it comes."""
    slot = ((pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)).astype(np.uint16)
    order = np.argsort(slot, kind="stable")
    hit = np.zeros(len(pixels), bool)
    hit[order[1:]] = pixels[order[1:]] == pixels[order[:-1]]  # equal pixels have one place
    return slot, hit


def _write_image(out: _Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = True, cache: tuple | None = None) -> None:
    n = len(pixels)
    found = _copies(pixels) if copies else []
    if cache_bits:
        slot, hit = cache or _cache_hits(pixels, cache_bits)
    else:
        hit = np.zeros(n, bool)
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    keep = np.ones(n, bool)
    for at, length, _ in found:
        keep[at + 1 : at + length] = False
    starts = np.array([f[0] for f in found], np.int64)
    c = _channels(pixels).astype(np.int64)
    green = c[:, 1].copy()
    literal = keep & ~hit
    if cache_bits:
        green[hit] = 280 + slot[hit].astype(np.int64)
    extras = []
    near = _near_codes(width)
    for at, length, distance in found:
        code, size, extra = _split_value(length)
        far_code, far_size, far_extra = _split_value(near.get(distance, distance + 120))
        green[at] = 256 + code
        literal[at] = False
        extras.append((size, extra, far_code, far_size, far_extra))
    literal &= keep
    size = 256 + 24 + (1 << cache_bits if cache_bits else 0)
    # Red, blue and alpha share one code, and green has it too if it codes samples only: four bytes of text
    # have much the same statistics, and a code is made and written out once.
    plain = not found and not cache_bits
    kinds = [np.bincount(c.ravel(), minlength=256)] if plain else [np.bincount(green[keep], minlength=size), np.bincount(c[literal][:, [2, 0, 3]].ravel(), minlength=256)]
    kinds.append(np.bincount([e[2] for e in extras], minlength=40) if extras else np.zeros(40, np.int64))
    lengths = [code_lengths(counts, WRITTEN_BITS) for counts in kinds]
    made = [(canonical(x), np.array(x, np.int64) * (x.count(0) != len(x) - 1), bits) for x, bits in zip(lengths, _code_bits(lengths), strict=True)]
    if plain:
        made.insert(0, made[0])
    tables = [made[0], made[1], made[1], made[1], made[2]]
    for table in tables:
        out.put_all(*table[2])
    values, sizes = tables[0][0][green], tables[0][1][green]
    for column, k in ((1, 2), (2, 0), (3, 3)):
        code, length, _ = tables[column]
        sample = c[literal, k]
        values[literal] |= code[sample] << sizes[literal]
        sizes[literal] += length[sample]
    if extras:
        # Length bits, distance code and distance bits follow the length symbol; the last may need a value of its own.
        e = np.array(extras, np.int64)
        add = lambda v, n: (np.bitwise_or.at(values, starts, v << sizes[starts]), np.add.at(sizes, starts, n))
        add(e[:, 1], e[:, 0])
        add(tables[4][0][e[:, 2]], tables[4][1][e[:, 2]])
        add(e[:, 4], e[:, 3])
    out.put_all(values[keep], sizes[keep])


def _costs(owner: np.ndarray, samples: np.ndarray, images: int) -> np.ndarray:
    """Bits of each image's samples under a prefix code of their own (their entropy)."""
    n = np.bincount(((owner << 8)[:, None] + samples).ravel(), minlength=256 * images).reshape(images, 256).astype(np.float64)
    total = n.sum(axis=1)
    return total * np.log2(np.maximum(total, 1)) - (n * np.log2(np.maximum(n, 1))).sum(axis=1)


def transform_gains(flat: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of images of one width, one after the other (``counts``: their pixels): predictor mode that pays (0: none), and (red, blue) slopes on green that pay (0: none).

    A transform pays if it saves the samples more than ``PAYS`` bits a tile and 64 bits. Predictors tried are
    the left and the top pixel; cross-colour factors come from the slopes of red and blue on green.
    """
    images = len(counts)
    owner = np.repeat(np.arange(images), counts)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    c = _channels(flat)
    cost = _costs(owner, c, images)
    least = PAYS * _up(width, AUTO_TILE) * ((counts // width + (1 << AUTO_TILE) - 1) >> AUTO_TILE) + 64
    mode, best = np.zeros(images, np.int64), cost - least
    for k, back, at in ((1, 1, np.flatnonzero(place % width)), (2, width, np.flatnonzero(place >= width))):
        n = np.bincount(owner[at], minlength=images)
        guessed = np.where(n > 0, _costs(owner[at], c[at] - c[at - back], images) * counts / np.maximum(n, 1), np.inf)
        mode[guessed < best] = k
        best = np.minimum(best, guessed)
    signed = c.view(np.int8).astype(np.int64)
    first = np.cumsum(counts) - counts
    total = lambda x: np.add.reduceat(x, first).astype(np.float64)
    blue, green, red = signed[:, 0], signed[:, 1], signed[:, 2]
    spread = total(green * green) - total(green) ** 2 / counts
    slopes = np.zeros((images, 2), np.int64)
    saved = np.zeros(images)
    for k, other in enumerate((red, blue)):
        both = total(green * other) - total(green) * total(other) / counts
        own = total(other * other) - total(other) ** 2 / counts
        some = (spread > 0.5) & (own > 0.5)
        slopes[some, k] = np.clip(np.rint(32 * both[some] / spread[some]), -127, 127)
        # What the correlation is worth if both were normal; only if that pays is it tried.
        saved[some] -= counts[some] / 2 * np.log2(np.maximum(1e-9, 1 - both[some] ** 2 / (spread[some] * own[some])))
    slopes[saved <= least] = 0
    tried = slopes.any(axis=1)[owner]
    if tried.any():
        # Red and blue share a code, so they are counted together.
        who, rb, g = owner[tried], c[tried][:, [2, 0]], green[tried]
        turned = (rb - (slopes[who] * g[:, None] >> 5).astype(np.uint8)).astype(np.uint8)
        slopes[_costs(who, rb, images) - _costs(who, turned, images) <= least] = 0
    return mode, slopes


def paying_transforms(flat: np.ndarray, width: int, height: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
    """(transform, its side image) for what pays, and the pixels after it."""
    tiles = _up(width, AUTO_TILE) * _up(height, AUTO_TILE)
    counts = np.array([len(flat)])
    used: list[tuple[int, np.ndarray]] = []
    (mode,), (slopes,) = transform_gains(flat, counts, width)
    if mode:
        side = np.full(tiles, int(mode) << 8 | 0xFF000000, np.uint32)
        used.append((PREDICTOR, side))
        flat = _residuals(flat, width, height, (side >> 8) & 255, AUTO_TILE)
        _, (slopes,) = transform_gains(flat, counts, width)
    if slopes.any():
        side = np.full(tiles, 0xFF000000 | (int(slopes[1]) & 255) << 8 | int(slopes[0]) & 255, np.uint32)
        used.append((CROSS_COLOUR, side))
        flat = _cross_colour(flat, width, height, side, AUTO_TILE, True)
    return used, flat


def encode(pixels: np.ndarray, transforms: tuple | None = None, cache_bits: int | None = None, copies: bool = True, palette: bool | None = None, tile: int = 3) -> bytes:
    """A lossless WebP file of a (height, width) array of ARGB values.

    transforms: of PREDICTOR, CROSS_COLOUR and SUBTRACT_GREEN, in the order in which they are applied, with
    side images that try every mode; by default predictor and cross-colour where they pay. By default a
    palette is used if a colour serves four pixels on average, and a cache of 256 colours if one pixel in
    eight would hit it.
    """
    height, width = pixels.shape
    flat = pixels.ravel().astype(np.uint32)
    out = _Writer()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, bits)
    colours = _distinct(flat)
    wide = None
    if palette or (palette is None and len(colours) <= 256 and 4 * len(colours) <= len(flat)):
        packing = _bundle_bits(len(colours))
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(colours) - 1, 8)
        c = _channels(colours)
        _write_image(out, _pixels(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False, copies=False)
        index = np.searchsorted(colours, flat).reshape(height, width)
        wide = _up(width, packing)
        padded = np.zeros((height, wide << packing), np.int64)
        padded[:, :width] = index
        packed = (padded.reshape(height, wide, 1 << packing) << (np.arange(1 << packing) * (8 >> packing))).sum(axis=2)
        flat, width = (packed.ravel() << 8 | 0xFF000000).astype(np.uint32), wide
    if transforms is None:
        sides, flat = paying_transforms(flat, width, height) if wide is None else ([], flat)
        for kind, side in sides:
            out.loose += [(1, 1), (kind, 2), (AUTO_TILE - 2, 3)]
            _write_image(out, side, _up(width, AUTO_TILE), False)
    for kind in transforms or ():
        out.put(1, 1)
        out.put(kind, 2)
        tiles = _up(width, tile) * _up(height, tile)
        if kind == SUBTRACT_GREEN:
            flat = _green(flat, -1)
            continue
        out.put(tile - 2, 3)
        numbers = np.arange(tiles, dtype=np.uint32)
        side = (numbers % 14) << 8 | 0xFF000000 if kind == PREDICTOR else (numbers * 37 & 255) << 16 | (numbers * 11 & 255) << 8 | (numbers * 5 & 255) | 0xFF000000
        side = side.astype(np.uint32)
        _write_image(out, side, _up(width, tile), False)
        flat = _residuals(flat, width, height, (side >> 8) & 255, tile) if kind == PREDICTOR else _cross_colour(flat, width, height, side, tile, True)
    out.put(0, 1)
    cache = None
    if cache_bits is None:
        cache = _cache_hits(flat, AUTO_CACHE)
        cache_bits = AUTO_CACHE if 8 * np.count_nonzero(cache[1]) >= len(flat) else 0
    _write_image(out, flat, width, True, cache_bits, copies, cache)
    return _riff(out.bytes())


def _riff(data: bytes) -> bytes:
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def encode_all(images: list[np.ndarray]) -> list[bytes]:
    """``encode`` of several images; those of one width that need neither palette nor transform are written together."""
    out: list[bytes | None] = [None] * len(images)
    widths = [x.shape[1] for x in images]
    for width in set(widths):
        block: list[int] = []
        for k in [*(k for k, w in enumerate(widths) if w == width), None]:
            if k is None or len(block) == TOGETHER or images[k].size > TOGETHER_PIXELS:
                for i, made in zip(block, _encode_block([images[i].ravel().astype(np.uint32) for i in block], width), strict=True):
                    out[i] = made or encode(images[i])
                block = []
            if k is not None:
                if images[k].size > TOGETHER_PIXELS:
                    out[k] = encode(images[k])
                else:
                    block.append(k)
    return out


def _encode_block(flats: list[np.ndarray], width: int) -> list[bytes | None]:
    """The files of images of one width; None for those that need a palette or a transform."""
    if not flats:
        return []
    done: list[bytes | None] = [None] * len(flats)
    counts = np.array([len(x) for x in flats])
    owner = np.repeat(np.arange(len(flats)), counts)
    flat = np.concatenate(flats)
    mixed = np.sort(owner.astype(np.uint64) << np.uint64(32) | flat)
    colours = np.bincount((mixed[np.r_[True, mixed[1:] != mixed[:-1]]] >> np.uint64(32)).astype(np.int64), minlength=len(flats))
    mode, slopes = transform_gains(flat, counts, width)
    usual = ~((colours <= 256) & (4 * colours <= counts)) & (mode == 0) & ~slopes.any(axis=1)
    which = np.flatnonzero(usual)
    if len(which):
        for k, data in zip(which.tolist(), _write_usual([flats[k] for k in which.tolist()], width), strict=True):
            done[k] = _riff(data)
    return done


def _write_usual(flats: list[np.ndarray], width: int) -> list[bytes]:
    """The bit streams of images without transforms."""
    images = len(flats)
    counts = np.array([len(x) for x in flats])
    first = np.cumsum(counts) - counts
    owner, flat = np.repeat(np.arange(images), counts), np.concatenate(flats)
    # Colour cache, where one pixel in eight hits it.
    slot = ((flat * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - AUTO_CACHE)).astype(np.int64)
    order = np.argsort((owner << AUTO_CACHE | slot).astype(np.uint16), kind="stable")
    hit = np.zeros(len(flat), bool)
    hit[order[1:]] = (flat[order[1:]] == flat[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    cached = 8 * np.bincount(owner[hit], minlength=images) >= counts
    hit &= cached[owner]
    found, starts = _copies_of_all(flat, owner, flats, first)
    keep = np.ones(len(flat), bool)
    c = _channels(flat).astype(np.int64)
    green = c[:, 1].copy()
    green[hit] = 280 + slot[hit]
    literal = ~hit
    extras = np.zeros((len(starts), 5), np.int64)
    near = _near_codes(width)
    for i, (at, length, distance) in enumerate(found):
        keep[at + 1 : at + length] = False
        code, size, extra = _split_value(length)
        far_code, far_size, far_extra = _split_value(near.get(distance, distance + 120))
        extras[i] = (size, extra, far_code, far_size, far_extra)
        green[at] = 256 + code
    literal[starts] = False
    literal &= keep
    # As in _write_image: one code for red, blue and alpha, and for green too if it codes samples only.
    alphabet = _green_size(AUTO_CACHE)
    of_green = np.bincount(owner[keep] * alphabet + green[keep], minlength=images * alphabet).reshape(images, -1)
    of_rest = np.bincount(((owner[literal] << 8)[:, None] + c[literal][:, [2, 0, 3]]).ravel(), minlength=images << 8).reshape(images, -1)
    of_far = np.bincount(owner[starts] * 40 + extras[:, 2], minlength=images * 40).reshape(images, -1)
    plain = ~cached & (np.bincount(owner[starts], minlength=images) == 0)
    lengths: list[list[int]] = []
    for k in range(images):
        if plain[k]:
            both = code_lengths(of_green[k, :256] + of_rest[k], WRITTEN_BITS)
            lengths += [both, both]
        else:
            lengths += [code_lengths(of_green[k, : _green_size(AUTO_CACHE if cached[k] else 0)], WRITTEN_BITS), code_lengths(of_rest[k], WRITTEN_BITS)]
        lengths.append(code_lengths(of_far[k], WRITTEN_BITS))
    written = _code_bits(lengths)
    grid = np.zeros((len(lengths), alphabet), np.int64)
    for i, x in enumerate(lengths):
        grid[i, : len(x)] = x
    codes = _canonical(grid)
    grid[(grid > 0).sum(axis=1) == 1] = 0
    row = 3 * owner
    values, sizes = codes[row, green], grid[row, green]
    lit = np.flatnonzero(literal)
    row = row[lit] + 1
    lit_values, lit_sizes = values[lit], sizes[lit]
    for k in (2, 0, 3):
        sample = c[lit, k]
        lit_values |= codes[row, sample] << lit_sizes
        lit_sizes += grid[row, sample]
    values[lit], sizes[lit] = lit_values, lit_sizes
    # Length bits, distance code and distance bits follow the length symbol.
    far = 3 * owner[starts] + 2
    for value, size in ((extras[:, 1], extras[:, 0]), (codes[far, extras[:, 2]], grid[far, extras[:, 2]]), (extras[:, 4], extras[:, 3])):
        values[starts] |= value << sizes[starts]
        sizes[starts] += size
    values, sizes = values[keep], sizes[keep]
    ends = np.cumsum(np.bincount(owner[keep], minlength=images)).tolist()
    parts: list[np.ndarray] = []
    widths: list[np.ndarray] = []
    begins, total = [], 0
    for k in range(images):
        head = (0x2F | (width - 1) << 8 | (len(flats[k]) // width - 1) << 22 | 1 << 36, int(cached[k]) | (AUTO_CACHE << 1 if cached[k] else 0))
        at, end = ends[k - 1] if k else 0, ends[k]
        own = written[3 * k : 3 * k + 3]
        parts += [np.array(head), *[own[i][0] for i in (0, 1, 1, 1, 2)], values[at:end]]
        # Signature, size, alpha, version and the end of transforms; then cache, and no groups.
        widths += [np.array((41, 6 if cached[k] else 2)), *[own[i][1] for i in (0, 1, 1, 1, 2)], sizes[at:end]]
        begins.append(total)
        total += sum(len(x) for x in parts[-7:])
    return _packed(np.concatenate(parts), np.concatenate(widths), begins)


def _copies_of_all(flat: np.ndarray, owner: np.ndarray, flats: list[np.ndarray], first: np.ndarray, least: int = 4) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """``_copies`` of each image, with starts in the whole block."""
    n = len(flat) - least + 1
    p = flat.astype(np.uint64)
    key = np.zeros(max(n, 0), np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + p[k : n + k]
    inside = owner[: max(n, 0)] == owner[least - 1 :]
    # Image, hash and place in one number: equal windows of an image lie side by side in order.
    mixed = np.sort(owner[: len(key)][inside].astype(np.uint64) << np.uint64(56) | key[inside] >> np.uint64(28) << np.uint64(20) | np.flatnonzero(inside).astype(np.uint64))
    same = np.flatnonzero(mixed[1:] >> np.uint64(20) == mixed[:-1] >> np.uint64(20))
    place = (mixed & np.uint64((1 << 20) - 1)).astype(np.int64)
    before = np.full(len(flat), -1)
    before[place[same + 1]] = place[same]
    at = np.flatnonzero(before >= 0)
    cuts = np.searchsorted(at, first)
    found: list[tuple[int, int, int]] = []
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(at)], strict=True)):
        if a < b:
            base = int(first[k])
            found += [(s + base, length, distance) for s, length, distance in _greedy(flats[k], (at[a:b] - base).tolist(), before[base : base + len(flats[k])] - base, least)]
    return found, np.array([f[0] for f in found], np.int64)


# ---------------------------------------------------------------- documents


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The filled bytes and the number of the text's own."""
    raw = (text or "").encode()
    fill = -len(raw) % UNIT if raw else UNIT
    return raw + b"\xff" * fill, len(raw)


def store_all(payloads: list[bytes]) -> list[bytes]:
    """The WebP file of each payload."""
    pixels = []
    for payload in payloads:
        rows = len(payload) // UNIT
        wide = -(-rows // SIDE)
        height = -(-rows // wide)
        pixels.append(np.frombuffer(payload + bytes((wide * height - rows) * UNIT), "<u4").reshape(height, wide * ROW))
    out = []
    for payload, array, image in zip(payloads, pixels, encode_all(pixels), strict=True):
        if 4 * array.size != len(payload):
            tail = b"size" + struct.pack("<IQ", 8, len(payload))
            image = image[:4] + struct.pack("<I", len(image) - 8 + len(tail)) + image[8:] + tail
        out.append(image)
    return out


def store(payload: bytes) -> bytes:
    return store_all([payload])[0]


def load_all(stored: list[bytes]) -> list[tuple[np.ndarray, bytes]]:
    """The pixel array of each stored payload, and the payload."""
    out = []
    for media, pixels in zip(stored, decode_all(stored), strict=True):
        size = struct.unpack("<I", media[16:20])[0]
        tail = media[20 + size + (size & 1) :]
        raw = pixels.astype("<u4").tobytes()
        out.append((pixels, raw[: struct.unpack("<IQ", tail[4:16])[1]] if tail[:4] == b"size" else raw))
    return out


def load(media: bytes) -> tuple[np.ndarray, bytes]:
    return load_all([media])[0]


def _blocks(sizes: list[int], rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Slices of up to ``rows`` rows and about ``most`` bytes."""
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and (k - start >= rows or held + n > most):
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def image_feature(pixels: np.ndarray) -> str:
    """Size, mean sample, number of colours and the shares (1/1000) of samples in eight bins."""
    samples = _channels(pixels.ravel())
    bins = np.bincount((samples >> 5).ravel(), minlength=8) * 1000 // samples.size
    return f"{pixels.shape[1]}x{pixels.shape[0]} mean {int(samples.sum(dtype=np.int64)) // samples.size} colours {len(_distinct(pixels.ravel()))} bins {' '.join(map(str, bins.tolist()))}"


def media_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the WebP file) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TOGETHER):
                part = b.slice(at, TOGETHER)
                made = [payload_of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array(store_all([p for p, _ in made]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of what is read back from the media column."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(2)).to_pylist()
            for start, stop in _blocks(sizes, DECODED_ROWS, DECODED_BYTES):
                part = b.slice(start, stop - start)
                rows = []
                stored = part.column(2).to_pylist()
                for media, (pixels, payload) in zip(stored, load_all(stored), strict=True):
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), image_feature(pixels)))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return stored.mapInArrow(run, schema)


def op8_webp(spark: SparkSession, folder: str) -> DataFrame:
    return media_features(media_table(read_table(spark, folder, "documents")))


QUERIES = {"op8_webp": op8_webp}
ORACLES: dict[str, str] = {}
