"""Lossless WebP: a decoder for every tool of the format and an encoder that chooses among them.

The decoder follows the public specification of the lossless bitstream: prefix codes, LZ77
back-references, colour cache, entropy images, and the predictor, cross-colour, subtract-green and
palette transforms. Every image passes the same symbol loop, which looks codes up in tables. The
encoder makes prefix codes for each image, finds back-references to repeated pixels, and uses the
colour cache and the palette, subtract-green or predictor transform where it expects fewer bits.
"""

from __future__ import annotations

import struct
from array import array
from collections import Counter
from functools import cached_property, lru_cache
from operator import itemgetter

import numpy as np

#: Bytes in a row of a stored payload: 192 pixels of three samples.
ROW_BYTES = 576
MAX_SIDE = 16_384
_SIGNATURE = 0x2F

# Fixed values of the format.
_CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
_LENGTH_SYMBOLS = 24
_DISTANCE_SYMBOLS = 40
_CACHE_MULTIPLIER = 0x1E35A7BD

#: Short distance codes: pixels above and to the left, nearest first.
_NEAR = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0),
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0),
)
#: The bits of a number below 2 ** 15 in reverse.
_REVERSED = [int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)]


class WebPError(ValueError):
    """The bytes are no lossless WebP image."""


_WINDOW_BITS = 1024


class Bits:
    """Reads numbers from a bit stream, least significant bit first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.size = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 4], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def skip(self, n: int) -> None:
        self.at += n
        if self.at > self.size:
            raise WebPError("the stream ends too early")

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.skip(n)
        return value

    def window(self) -> int:
        """The next ``_WINDOW_BITS`` bits and some more as one number."""
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + _WINDOW_BITS // 8 + 8], "little") >> (self.at & 7)

    def words(self, first: int, count: int) -> list[int]:
        """The numbers of seven bytes each that start at ``count`` consecutive bytes."""
        raw = np.frombuffer(self.data[first : first + count + 6].ljust(count + 6, b"\0"), np.uint8).astype(np.uint64)
        out = raw[:count].copy()
        for i in range(1, 7):
            out |= raw[i : i + count] << np.uint64(8 * i)
        return out.tolist()


class PrefixCode:
    """A canonical prefix code from code lengths by symbol; a lone symbol takes no bits.

    ``table`` holds symbol * 16 + length for every value of the next ``mask`` bits.
    """

    def __init__(self, lengths: list[tuple[int, int]]) -> None:
        if not lengths:
            raise WebPError("a prefix code has no symbols")
        self.lengths, self.mask = lengths, 0
        if len(lengths) == 1:
            return
        sizes = [n for _, n in lengths]
        if sum([1 << 15 - n for n in sizes]) != 1 << 15:
            raise WebPError("a prefix code is not complete")
        self.mask = (1 << max(sizes)) - 1

    @cached_property
    def table(self) -> list[int]:
        if not self.mask:
            return [self.lengths[0][0] << 4]
        table = [0] * (self.mask + 1)
        for symbol, n, code in canonical(self.lengths):
            table[code :: 1 << n] = [symbol << 4 | n] * (self.mask + 1 >> n)
        return table

    @cached_property
    def array(self) -> np.ndarray:
        """``table`` for numpy: codes of ascending length fill it in the order of their reversed bits."""
        if not self.mask:
            return np.array([self.lengths[0][0] << 4], np.uint16)
        longest = self.mask.bit_length()
        by_length = sorted(self.lengths, key=itemgetter(1))
        entries = np.array([s << 4 | n for s, n in by_length], np.uint16)
        return entries.repeat([1 << longest - n for _, n in by_length]).take(_reversed(longest))

    def read(self, bits: Bits) -> int:
        found = self.table[bits.peek(15) & self.mask]
        bits.skip(found & 15)
        return found >> 4


@lru_cache(maxsize=16)
def _reversed(longest: int) -> np.ndarray:
    """The numbers below 2 ** ``longest`` with their bits reversed."""
    return np.array(_REVERSED[: 1 << longest], np.int64) >> 15 - longest


def canonical(lengths: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Symbol, length and code of each of the ascending symbols; the first bit of a code is its lowest."""
    code = last = 0
    out = []
    for symbol, n in sorted(lengths, key=itemgetter(1)):
        code <<= n - last
        last = n
        out.append((symbol, n, _REVERSED[code] >> 15 - n))
        code += 1
    return out


@lru_cache(maxsize=1024)
def _simple_code(*symbols: int) -> PrefixCode:
    return PrefixCode([(s, 1) for s in symbols])


def _read_code(bits: Bits, alphabet: int, window: int) -> tuple[PrefixCode, int]:
    """A code, and how many symbols of the alphabet it lists; ``window`` holds the next bits."""
    if window & 1:
        two, wide = window >> 1 & 1, window >> 2 & 1
        size = 11 if wide else 4
        symbols = {window >> 3 & (255 if wide else 1)}
        if two:
            symbols.add(window >> size & 255)
            size += 8
        bits.skip(size)
        if max(symbols) >= alphabet:
            raise WebPError("a symbol lies outside its alphabet")
        return _simple_code(*sorted(symbols)), max(symbols) + 1
    listed = 4 + (window >> 1 & 15)
    v = window >> 5 & (1 << 3 * listed) - 1
    code = PrefixCode(sorted([(_CODE_LENGTH_ORDER[i], n) for i in range(listed) if (n := v >> 3 * i & 7)]))
    left, used = alphabet, 6 + 3 * listed
    if window >> used - 1 & 1:
        room = 2 + 2 * (window >> used & 7)
        left = 2 + (window >> used + 3 & (1 << room) - 1)
        used += 3 + room
    lengths: list[tuple[int, int]] = []
    add, table, mask = lengths.append, code.table, code.mask
    at, previous = 0, 8
    while at < alphabet and left:
        if used > _WINDOW_BITS:
            bits.skip(used)
            window, used = bits.window(), 0
        left -= 1
        v = window >> used
        e = table[v & mask]
        s = e >> 4
        used += e & 15
        if s < 16:
            if s:
                add((at, s))
                previous = s
            at += 1
            continue
        value, extra, least = ((previous, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
        n = least + (v >> (e & 15) & ((1 << extra) - 1))
        used += extra
        if at + n > alphabet:
            raise WebPError("code lengths run over their alphabet")
        if value:
            lengths.extend([(k, value) for k in range(at, at + n)])
        at += n
    bits.skip(used)
    return PrefixCode(lengths), at


def _read_group(bits: Bits, cache_size: int) -> list[PrefixCode]:
    alphabets = [256 + _LENGTH_SYMBOLS + cache_size, 256, 256, 256, _DISTANCE_SYMBOLS]
    out: list[PrefixCode] = []
    size = own = least = 0  # bits of the code before, and the smallest alphabet that reads them alike
    for n in alphabets:
        window = bits.window()
        # a code written like the one before is that code: red and blue often follow green so
        if size and least <= n and size <= _WINDOW_BITS and window & ((1 << size) - 1) == own:
            out.append(out[-1])
            bits.skip(size)
            continue
        start = bits.at
        code, listed = _read_code(bits, n, window)
        out.append(code)
        size = bits.at - start if listed < n else 0  # a list that the alphabet's end cut reads otherwise in another
        own, least = window & ((1 << size) - 1), listed + 1
    return out


def _distance(code: int, width: int) -> int:
    if code > len(_NEAR):
        return code - len(_NEAR)
    x, y = _NEAR[code - 1]
    return max(1, x + y * width)


#: Extra bits, and least value, of each symbol of a length or distance code.
_EXTRA_BITS = np.array([max(s - 2, 0) >> 1 for s in range(_DISTANCE_SYMBOLS)])
_LEAST_VALUES = np.array([s + 1 if s < 4 else ((2 + (s & 1)) << (s - 2 >> 1)) + 1 for s in range(_DISTANCE_SYMBOLS)])

#: Bytes of the stream that are looked up at once, and pixels of an image that is worth it.
_PIECE = 1 << 13
_LEAST_PIXELS = 128


def _read_pixels(bits: Bits, width: int, n: int, codes: list[PrefixCode], cache_bits: int) -> np.ndarray | None:
    """The ``n`` pixels of an image with one group of codes, or None if one is taken from an empty slot of the cache.

    Looks up what would start at each bit of a piece, so that the next start is known for all of them,
    and follows these four at a time. The green code must take bits and the alpha code none.
    """
    green, red, blue, alpha, far = codes
    top = alpha.lengths[0][0] << 24
    literals = max(green.lengths)[0] < 256
    values, kinds, counts, places = [], [], [], []
    done, at = 0, bits.at
    while done < n:
        if at >= bits.size:
            raise WebPError("the stream ends too early")
        first = at >> 3
        size = min(_PIECE, len(bits.data) - first)
        raw = np.frombuffer(bits.data[first : first + size + 11].ljust(size + 11, b"\0"), np.uint8)
        # the next 2, 4, 8 and 16 bits of each place
        eight = np.unpackbits(raw, bitorder="little")
        for k in (1, 2, 4):
            eight[:-k] |= eight[k:] << np.uint8(k)
        ahead = eight.astype(np.uint16)
        ahead[:-8] |= ahead[8:] << np.uint16(8)
        limit, every = 8 * size, np.arange(len(ahead))
        greens = green.array.take(ahead & green.mask)
        after = every + (greens & 15)
        after[limit:] = every[limit:]
        # where a red and a blue sample would end; the code of a channel before needs no second look
        if red is green:
            reds, red_ends = greens, after
        else:
            reds = red.array.take(ahead & red.mask)
            red_ends = every + (reds & 15) if red.mask else every
        if blue is red:
            blues, blue_ends = reds, red_ends
        else:
            blues = blue.array.take(ahead & blue.mask)
            blue_ends = every + (blues & 15) if blue.mask else every
        second = red_ends.take(after[:limit])
        nexts = np.concatenate((blue_ends.take(second), every[limit:]))
        if not literals:
            # back-references and cached pixels end elsewhere
            other = (greens[:limit] >= 256 << 4).nonzero()[0]
            symbol = (greens[other] >> 4).astype(np.intp) - 256
            copy = symbol < _LENGTH_SYMBOLS
            nexts[other] = after[other]
            longer = other[copy]
            wide = raw.astype(np.intp)
            words = wide[:-3] | wide[1:-2] << 8 | wide[2:-1] << 16 | wide[3:] << 24
            length, end = _prefix_values(symbol[copy], words, after[longer])
            e = far.array.take(ahead.take(end) & far.mask).astype(np.intp)
            distance, end = _prefix_values(e >> 4, words, end + (e & 15))
            nexts[longer] = np.minimum(end, len(every) - 1)
        two = nexts.take(nexts)
        four = memoryview(two.take(two))
        starts, p = [], at - 8 * first
        while p < limit:
            starts.append(p)
            p = four[p]
        tokens = np.empty((len(starts), 4), np.intp)
        tokens[:, 0] = starts
        tokens[:, 2] = two.take(tokens[:, 0])
        tokens[:, 1::2] = nexts.take(tokens[:, ::2])
        tokens = tokens.ravel()
        tokens = tokens[: tokens.searchsorted(limit)]
        symbol = greens.take(tokens) >> 4
        value = symbol.astype(np.uint32) << 8
        value |= (reds.take(after.take(tokens)) >> 4).astype(np.uint32) << 16
        value |= blues.take(second.take(tokens)) >> 4
        value |= np.uint32(top)
        if literals:
            used = n - done
            if used <= len(tokens):
                value, at = value[:used], 8 * first + int(nexts[tokens[used - 1]])
            else:
                at = 8 * first + p
            values.append(value)
            done += len(value)
            continue
        count = np.ones(len(tokens), np.int64)
        copied = ((symbol >= 256) & (symbol < 256 + _LENGTH_SYMBOLS)).nonzero()[0]
        if len(copied):
            found = np.searchsorted(longer, tokens[copied])
            count[copied] = length[found]
            value[copied] = [_distance(d, width) for d in distance[found].tolist()]
        ends = done + np.cumsum(count)
        used = int(np.searchsorted(ends, n)) + 1
        if used <= len(tokens):
            tokens, symbol, value, count, ends = tokens[:used], symbol[:used], value[:used], count[:used], ends[:used]
            at = 8 * first + int(nexts[tokens[-1]])
        else:
            at = 8 * first + p
        values.append(value)
        kinds.append(symbol)
        counts.append(count)
        places.append(ends - count)
        done = int(ends[-1])
    if done > n:
        raise WebPError("a back-reference leaves the image")
    if at > bits.size:
        raise WebPError("the stream ends too early")
    bits.at = at
    value = np.concatenate(values)
    if literals:
        return value
    symbol, count, place = map(np.concatenate, (kinds, counts, places))
    cached, copied = symbol >= 256 + _LENGTH_SYMBOLS, (symbol >= 256) & (symbol < 256 + _LENGTH_SYMBOLS)
    if len(value) == n and not cached.any():
        return value
    # a copied pixel takes another's value, so it has that one's source
    source = np.arange(n)
    for i, k, back in zip(place[copied].tolist(), count[copied].tolist(), value[copied].tolist(), strict=True):
        if back > i:
            raise WebPError("a back-reference leaves the image")
        source[i : i + k] = source[i - back : i - back + k] if back >= k else source[i - back + np.arange(k) % back]
    pixels = np.zeros(n, np.uint32)
    pixels[place] = value
    if cached.any():
        # pixels have the slots of their sources, and a cached one is the last pixel before of its slot
        slots = (pixels * np.uint32(_CACHE_MULTIPLIER) >> np.uint32(32 - cache_bits)).astype(np.int16)
        hits = place[cached]
        slots[hits] = symbol[cached] - 256 - _LENGTH_SYMBOLS
        slots = slots[source]
        order = np.argsort(slots, kind="stable")
        ends = np.arange(n)
        hit = np.zeros(n, bool)
        hit[hits] = True
        hit = hit[order]
        ends[hit] = 0
        # the last pixel before that is not cached itself; other cached ones between are equal
        last, own = order[np.maximum.accumulate(ends)[hit]], order[hit]
        if hit[0] or (slots[last] != slots[own]).any():
            return None
        source[own] = last
        source = _followed(source)
    return pixels[source]


def _prefix_values(symbols: np.ndarray, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distance codes from their symbols and the bits from ``at`` on, and the places behind them."""
    extra = _EXTRA_BITS.take(symbols)
    bits = words.take(at >> 3) >> (at & 7) & (1 << extra) - 1
    return _LEAST_VALUES.take(symbols) + bits, at + extra


def _followed(source: np.ndarray) -> np.ndarray:
    """Where a chain of sources ends, for each place."""
    while True:
        further = source.take(source)
        if (further == source).all():
            return source
        source = further


#: Bytes of the stream that the symbol loop prepares at once.
_CHUNK = 1 << 16


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as (height, width, 4) samples: alpha, red, green, blue."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache_size = 1 << cache_bits if cache_bits else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    n = width * height
    meta, shift = None, 0
    if main and bits.read(1):
        shift = 2 + bits.read(3)
        sub = _read_image(bits, -(-width >> shift), -(-height >> shift), False).astype(np.int32)
        meta = sub[:, :, 1] << 8 | sub[:, :, 2]
    groups = []
    for _ in range(1 if meta is None else int(meta.max()) + 1):
        green, red, blue, alpha, far = codes = _read_group(bits, cache_size)
        if meta is None and n >= _LEAST_PIXELS and green.mask and not alpha.mask:
            start = bits.at
            if (pixels := _read_pixels(bits, width, n, codes, cache_bits)) is not None:
                return pixels.astype(">u4").view(np.uint8).reshape(height, width, 4)
            bits.at = start
        groups.append((green.table, green.mask, red.table, red.mask, blue.table, blue.mask, alpha.table, alpha.mask, far))

    pixels = array("I")
    add = pixels.append
    cache = [0] * cache_size
    kept = at = 0
    pos, size = bits.at, bits.size
    first = pos >> 3
    words = bits.words(first, min(_CHUNK, (size >> 3) - first + 8))
    end = (first + len(words) - 8) * 8  # symbols that start before have all their bits in ``words``
    while at < n:
        if meta is None:
            group, stop = groups[0], n
        else:
            y, x = divmod(at, width)
            group, stop = groups[int(meta[y >> shift, x >> shift])], y * width + min(width, ((x >> shift) + 1) << shift)
        greens, green_mask, reds, red_mask, blues, blue_mask, alphas, alpha_mask, far = group
        top = alphas[0] >> 4 << 24
        while at < stop:
            if pos >= end:
                if pos > size:
                    raise WebPError("the stream ends too early")
                first = pos >> 3
                words = bits.words(first, min(_CHUNK, (size >> 3) - first + 16))
                end = (first + len(words) - 8) * 8
            v = words[(pos >> 3) - first] >> (pos & 7)
            e = greens[v & green_mask]
            s, k = e >> 4, e & 15
            if s < 256:
                v >>= k
                r = reds[v & red_mask]
                v >>= r & 15
                b = blues[v & blue_mask]
                k += (r & 15) + (b & 15)
                if alpha_mask:
                    bits.at = pos + k
                    a = alphas[bits.peek(15) & alpha_mask]
                    k += a & 15
                    top = a >> 4 << 24
                add(top | r >> 4 << 16 | s << 8 | b >> 4)
                pos += k
                at += 1
            elif s < 256 + _LENGTH_SYMBOLS:
                bits.at = pos + k
                length = _prefix_value(bits, s - 256)
                back = _distance(_prefix_value(bits, far.read(bits)), width)
                pos = bits.at
                if back > at or at + length > n:
                    raise WebPError("a back-reference leaves the image")
                if back >= length:
                    pixels.extend(pixels[at - back : at - back + length])
                else:
                    pixels.extend((pixels[at - back :] * (length // back + 1))[:length])
                at += length
            else:
                for argb in pixels[kept:at]:
                    cache[(_CACHE_MULTIPLIER * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb
                kept = at
                add(cache[s - 256 - _LENGTH_SYMBOLS])
                pos += k
                at += 1
    bits.at = pos
    if pos > size:
        raise WebPError("the stream ends too early")
    return np.array(pixels, ">u4").view(np.uint8).reshape(height, width, 4).copy()


def _prefix_value(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The prediction from the neighbours: left, top, top right and top left."""
    if mode == 11:
        guess = left + top - corner
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        middle = _average(left, top)
        half = middle - corner
        return np.clip(middle + np.where(half < 0, -(-half >> 1), half >> 1), 0, 255)
    black = np.array([255, 0, 0, 0], np.int32)
    return {
        0: lambda: black,
        1: lambda: left,
        2: lambda: top,
        3: lambda: right,
        4: lambda: corner,
        5: lambda: _average(_average(left, right), top),
        6: lambda: _average(left, corner),
        7: lambda: _average(left, top),
        8: lambda: _average(corner, top),
        9: lambda: _average(top, right),
        10: lambda: _average(_average(left, corner), _average(top, right)),
    }.get(mode, lambda: black)()


def predictions(pixels: np.ndarray, y: int, x: int, mode: int) -> np.ndarray:
    """What the predictor transform expects at a place, given the pixels before it."""
    if y == 0 and x == 0:
        return np.array([255, 0, 0, 0], np.int32)
    if y == 0:
        return pixels[0, x - 1]
    if x == 0:
        return pixels[y - 1, 0]
    width = pixels.shape[1]
    right = pixels[y - 1, x + 1] if x + 1 < width else pixels[y, 0]
    return _predict(mode, pixels[y, x - 1], pixels[y - 1, x], right, pixels[y - 1, x - 1])


#: Predictors that need no pixel of the row itself, but the last pixel's top right neighbour.
_FROM_ABOVE = {0, 2, 3, 4, 8, 9}


def _undo_predictor(image: np.ndarray, modes: np.ndarray, shift: int) -> np.ndarray:
    """Row by row, and where the mode allows it all pixels of a block's row at once."""
    out = image.astype(np.int32)
    height, width = out.shape[:2]
    out[0, 0] = (out[0, 0] + [255, 0, 0, 0]) & 255
    out[0] = np.cumsum(out[0], axis=0) & 255
    for y in range(1, height):
        row, above = out[y], out[y - 1]
        row[0] = (row[0] + above[0]) & 255
        x = 1
        while x < width:
            mode = int(modes[y >> shift, x >> shift, 2])
            stop = min(width, ((x >> shift) + 1) << shift)
            while stop < width and modes[y >> shift, stop >> shift, 2] == mode:
                stop = min(width, stop + (1 << shift))
            if mode in _FROM_ABOVE:
                right = above[x + 1 : stop + 1] if stop < width else np.concatenate((above[x + 1 :], row[:1]))
                row[x:stop] = (row[x:stop] + _predict(mode, above[x:stop], above[x:stop], right, above[x - 1 : stop - 1])) & 255
            elif mode == 1:
                row[x - 1 : stop] = np.cumsum(row[x - 1 : stop], axis=0) & 255
            else:
                for k in range(x, stop):
                    row[k] = (row[k] + predictions(out, y, k, mode)) & 255
            x = stop
    return out.astype(np.uint8)


def _spread(blocks: np.ndarray, shift: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(blocks, 1 << shift, 0), 1 << shift, 1)[:height, :width]


def colour_delta(factor: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The cross-colour term of two signed bytes."""
    return (factor.astype(np.int8).astype(np.int32) * sample.astype(np.int8).astype(np.int32)) >> 5


def _undo_colour(image: np.ndarray, blocks: np.ndarray, shift: int) -> np.ndarray:
    factors = _spread(blocks, shift, *image.shape[:2])
    out = image.copy()
    red, green, blue = (image[:, :, c] for c in (1, 2, 3))
    red = (red + colour_delta(factors[:, :, 3], green)).astype(np.uint8)
    blue = blue + colour_delta(factors[:, :, 2], green) + colour_delta(factors[:, :, 1], red)
    out[:, :, 1], out[:, :, 3] = red, blue.astype(np.uint8)
    return out


def _undo_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[:, :, 1] += image[:, :, 2]
    out[:, :, 3] += image[:, :, 2]
    return out


def _undo_palette(image: np.ndarray, palette: np.ndarray, pack: int, width: int) -> np.ndarray:
    index = image[:, :, 2]
    if pack:
        each = 8 >> pack
        shifts = np.arange(1 << pack) * each
        index = (index[:, :, None] >> shifts & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    full = np.zeros((256, 4), np.uint8)
    full[: len(palette)] = palette
    return full[index]


def palette_pack(size: int) -> int:
    """Log2 of the indices in a pixel for a palette of that size."""
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a lossless bitstream: (height, width, 4) of alpha, red, green, blue."""
    bits = Bits(data)
    if bits.read(8) != _SIGNATURE:
        raise WebPError("the signature is missing")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise WebPError("unknown version")
    undo = []
    coded = width
    seen = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise WebPError("a transform occurs twice")
        seen.add(kind)
        if kind in (0, 1):
            shift = 2 + bits.read(3)
            blocks = _read_image(bits, -(-coded >> shift), -(-height >> shift), False)
            step = _undo_colour if kind else _undo_predictor
            undo.append(lambda image, f=step, b=blocks, s=shift: f(image, b, s))
        elif kind == 2:
            undo.append(_undo_green)
        else:
            size = bits.read(8) + 1
            palette = np.cumsum(_read_image(bits, size, 1, False)[0], axis=0, dtype=np.uint8)
            pack = palette_pack(size)
            undo.append(lambda image, p=palette, k=pack, w=coded: _undo_palette(image, p, k, w))
            coded = -(-coded >> pack)
    image = _read_image(bits, coded, height, True)
    for step in reversed(undo):
        image = step(image)
    return image


class BitWriter:
    """Collects numbers, least significant bit first."""

    def __init__(self) -> None:
        self.value = self.size = 0

    def write(self, value: int, n: int) -> None:
        self.value |= value << self.size
        self.size += n

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """Write many numbers of given numbers of bits, at most 64 each."""
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return
        starts = ends - sizes
        words, shifts = starts >> 6, (starts & 63).astype(np.uint64)
        # each 64 bits hold the numbers that start there and what runs over from the last one before
        edges = (words[1:] != words[:-1]).nonzero()[0]
        first = np.zeros(len(edges) + 1, np.intp)
        first[1:] = edges + 1
        out = np.zeros(len(first) + 1, "<u8")
        out[:-1] = np.bitwise_or.reduceat(values << shifts, first)
        last = np.full(len(first), len(words) - 1)
        last[:-1] = edges
        out[1:] |= values[last] >> np.uint64(1) >> (np.uint64(63) - shifts[last])
        self.write(int.from_bytes(out.tobytes(), "little"), total)

    def bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.size // 8), "little")


#: Longest code of an image's symbols that the encoder makes; the format allows 15.
_LONGEST = 13


def code_lengths(counts: list[int], longest: int) -> list[int]:
    """Huffman code lengths of two or more positive counts; rare symbols count more until no code is too long."""
    n = len(counts)
    order = sorted(range(n), key=counts.__getitem__)
    ascending = [counts[i] for i in order]
    none = 2 * n * ascending[-1]  # more than any sum, as equal weights make no long codes
    floor = 1
    while True:
        weights = [c if c > floor else floor for c in ascending]
        weights.append(none)
        sums = [none] * n
        parents, above = [0] * n, [0] * n  # of the symbols and of the nodes
        leaf = node = 0
        least, lowest = weights[0], none
        for new in range(n - 1):
            if least <= lowest:
                total = least
                parents[leaf] = new
                leaf += 1
                least = weights[leaf]
            else:
                total = lowest
                above[node] = new
                node += 1
                lowest = sums[node]
            if least <= lowest:
                total += least
                parents[leaf] = new
                leaf += 1
                least = weights[leaf]
            else:
                total += lowest
                above[node] = new
                node += 1
                lowest = sums[node]
            sums[new] = total
            if node == new:
                lowest = total
        depths = [0] * (n - 1)
        for i in range(n - 3, -1, -1):
            depths[i] = depths[above[i]] + 1
        if max(depths) < longest:
            out = [0] * n
            for i, parent in zip(order, parents, strict=True):
                out[i] = depths[parent] + 1
            return out
        floor *= 2


@lru_cache(maxsize=1024)
def _lone_code(alphabet: int, symbol: int) -> _Code:
    return _Code(alphabet, [symbol], [1])


def _code(counts: np.ndarray) -> _Code:
    used = counts.nonzero()[0]
    if len(used) < 2:
        return _lone_code(len(counts), int(used[0]) if len(used) else 0)
    return _Code(len(counts), used.tolist(), counts[used].tolist())


class _Code:
    """A prefix code for the ascending symbols of an alphabet that occur, to be written and used."""

    def __init__(self, alphabet: int, used: list[int], counts: list[int]) -> None:
        self.lengths = list(zip(used, code_lengths(counts, _LONGEST) if len(used) > 1 else [1], strict=True))
        self.codes, self.sizes = np.zeros(alphabet, np.uint64), np.zeros(alphabet, np.int64)
        if len(used) > 1:
            sizes = np.array([n for _, n in self.lengths])
            order = np.argsort(sizes.astype(np.uint8), kind="stable")
            places, sizes = np.array(used)[order], sizes[order]
            ends = np.cumsum(1 << 15 - sizes)
            self.codes[places], self.sizes[places] = _reversed(15)[ends - (1 << 15 - sizes)], sizes
        self.written: tuple[int, int] | None = None

    def write(self, w: BitWriter) -> None:
        if self.written is None:
            own = BitWriter()
            self._write(own)
            self.written = own.value, own.size
        w.write(*self.written)

    def _write(self, w: BitWriter) -> None:
        symbols = [s for s, _ in self.lengths]
        if len(symbols) <= 2 and symbols[-1] < 256:
            w.write(1, 1)
            w.write(len(symbols) - 1, 1)
            w.write(int(symbols[0] > 1), 1)
            w.write(symbols[0], 8 if symbols[0] > 1 else 1)
            if len(symbols) == 2:
                w.write(symbols[1], 8)
            return
        tokens = _length_tokens(self.lengths)
        kinds = Counter(tokens)
        counts = [0] * 19
        for token, c in kinds.items():
            counts[token & 31] += c
        used = [i for i, c in enumerate(counts) if c]
        own = list(zip(used, code_lengths([counts[i] for i in used], 7) if len(used) > 1 else [1], strict=True))
        by_symbol = [0] * 19
        for i, n in own:
            by_symbol[i] = n
        in_order = [by_symbol[i] for i in _CODE_LENGTH_ORDER]
        while len(in_order) > 4 and not in_order[-1]:
            in_order.pop()
        w.write(0, 1)
        w.write(len(in_order) - 4, 4)
        w.write(sum([n << 3 * i for i, n in enumerate(in_order)]), 3 * len(in_order))
        room = max(2, (len(tokens) - 2).bit_length())
        room += room & 1
        w.write(1, 1)
        w.write(room // 2 - 1, 3)
        w.write(len(tokens) - 2, room)
        codes = dict.fromkeys(used, "")
        for t, n, code in canonical(own) if len(own) > 1 else ():
            codes[t] = f"{code:0{n}b}"
        digits = {t: (f"{t >> 5:0{_REPEAT_BITS[t & 31]}b}" if t & 31 > 15 else "") + codes[t & 31] for t in kinds}
        text = "".join([digits[t] for t in reversed(tokens)])
        w.write(int(text or "0", 2), len(text))


#: Bits behind the symbols that repeat a code length.
_REPEAT_BITS = {16: 2, 17: 3, 18: 7}


def _length_tokens(lengths: list[tuple[int, int]]) -> list[int]:
    """The tokens that list code lengths by symbol: symbol + 32 * extra value.

    Runs of zeros, and of three or more equal lengths after the first, become repeats.
    """
    out: list[int] = []
    add = out.append
    last, previous, run = -1, 8, 0
    for s, n in lengths:
        gap = s - last - 1
        last = s
        if n == previous and not gap:
            run += 1
            continue
        while run:
            k = min(run, 6)
            out += [16 | k - 3 << 5] if k >= 3 else [previous] * k
            run -= k
        while gap >= 3:
            k = min(gap, 138)
            add(18 | k - 11 << 5 if k >= 11 else 17 | k - 3 << 5)
            gap -= k
        if gap:
            out += [0] * gap
        if n == previous:
            run = 1
        else:
            add(n)
            previous = n
    while run:
        k = min(run, 6)
        out += [16 | k - 3 << 5] if k >= 3 else [previous] * k
        run -= k
    return out


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra value and extra bits of a length or distance code."""
    value -= 1
    if value < 4:
        return value, 0, 0
    high = value.bit_length() - 1
    extra = high - 1
    return 2 * high + (value >> extra & 1), value & ((1 << extra) - 1), extra


def _copies(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """Place, length and distance of repeats of three or more pixels, from left to right.

    None where all of them could not save ``_COPIES_WORTH``.
    """
    if len(pixels) < 4:
        return []
    wide, by = pixels.astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
    keys = ((wide[:-2] * by + wide[1:-1]) * by + wide[2:]) * by
    # the low bits of a key give way to the place, so that numbers are sorted and not places by them
    low = np.uint64(len(keys).bit_length())
    order = np.sort(keys >> low << low | np.arange(len(keys), dtype=np.uint64))
    same = (order[1:] >> low == order[:-1] >> low).nonzero()[0]
    # references have at most two pixels more than places here, so they save at most 20 bits a place
    if 20 * len(same) < _COPIES_WORTH:
        return []
    order = (order & (np.uint64(1) << low) - np.uint64(1)).astype(np.intp)
    here, before = order[same + 1], order[same]
    by_place = np.argsort(here)
    out = []
    at, n, one = 0, len(pixels), memoryview(pixels)
    for i, j in zip(here[by_place].tolist(), before[by_place].tolist(), strict=True):
        if i < at or i - j > (1 << 20) - 120:
            continue
        length, step = 0, 64
        most = min(4096, n - i)
        while length < most and length < 16 and one[i + length] == one[j + length]:
            length += 1
        while 16 <= length < most:
            upto = min(length + step, most)
            differ = (pixels[i + length : i + upto] != pixels[j + length : j + upto]).nonzero()[0]
            if len(differ):
                length += int(differ[0])
                break
            length, step = upto, 4 * step
        if length >= 3:
            out.append((i, length, i - j))
            at = i + length
    return out


_CACHE_BITS = 8
#: Bits that back-references must be expected to save, at 5 a sample and 25 a reference: the code they need takes as many.
_COPIES_WORTH = 300


@lru_cache(maxsize=1)
def _n_log_n() -> np.ndarray:
    n = np.arange(1, 1 << 16, dtype=float)
    return np.append(0.0, n * np.log2(n))


def _bits(counts: np.ndarray, total: int) -> float:
    """The entropy of ``total`` counted symbols, in bits."""
    known = _n_log_n()
    if total < len(known):
        return float(known[total] - known.take(counts).sum())
    c = counts[counts > 0].astype(float)
    return float(total * np.log2(total) - (c * np.log2(c)).sum())


def _write_image(w: BitWriter, pixels: np.ndarray, width: int, main: bool) -> None:
    """Pixels (numbers of alpha, red, green, blue) as an entropy-coded image."""
    n = len(pixels)
    copies = _copies(pixels)
    if 3 * 5 * sum([k for _, k, _ in copies]) - 25 * len(copies) < _COPIES_WORTH:
        copies = []
    samples = pixels.astype("<u4", copy=False).view(np.uint8).reshape(n, 4)[:, [1, 2, 0, 3]]  # green, red, blue, alpha
    literal = None  # all of them
    if copies:
        literal = np.ones(n, bool)
        for i, k, _ in copies:
            literal[i : i + k] = False
    own = samples if literal is None else samples[literal]
    counts = [np.bincount(own[:, c], minlength=256) for c in range(4)]
    slots = (pixels * np.uint32(_CACHE_MULTIPLIER) >> np.uint32(32 - _CACHE_BITS)).astype(np.uint8)
    order = np.argsort(slots, kind="stable")
    hits = np.zeros(n, bool)
    # a hit if the last pixel of the same slot was the same
    ordered = pixels[order]
    hits[order[1:]] = ordered[1:] == ordered[:-1]
    if copies:
        hits &= literal
    # a cached pixel takes about eight bits, and so does each slot's code length at first
    n_hits = int(np.count_nonzero(hits))
    each = _bits(counts[0] + counts[1] + counts[2], 3 * len(own)) / max(1, len(own))
    cached = n_hits * (each - 8) > 4 * min(n_hits, 1 << _CACHE_BITS) + 64
    plain = literal
    if cached:
        plain = ~hits if literal is None else literal & ~hits
        own = samples[plain]
        counts = [np.bincount(own[:, c], minlength=256) for c in range(4)]

    lengths = [_prefix(n) for _, n, _ in copies]
    near = _near_codes(width)
    distances = [_prefix(near.get(d, d + len(_NEAR))) for _, _, d in copies]
    green = np.zeros(256 + _LENGTH_SYMBOLS + (1 << _CACHE_BITS if cached else 0), np.int64)
    together = counts[0] + counts[1] + counts[2]
    if sum([_bits(c, len(own)) for c in counts[:3]]) + 300 > _bits(together, 3 * len(own)):
        counts[0] = counts[1] = counts[2] = together  # channels of one kind share their code
    green[:256] = counts[0]
    for k, _, _ in lengths:
        green[256 + k] += 1
    if cached:
        green[256 + _LENGTH_SYMBOLS :] += np.bincount(slots[hits], minlength=1 << _CACHE_BITS)
    far = np.bincount([s for s, _, _ in distances], minlength=_DISTANCE_SYMBOLS)
    codes = [_code(green)]
    codes.append(codes[0] if counts[1] is counts[0] and not copies and not cached else _code(counts[1]))
    codes += [codes[1] if counts[2] is counts[1] else _code(counts[2]), _code(counts[3]), _code(far)]

    w.write(int(cached), 1)
    if cached:
        w.write(_CACHE_BITS, 4)
    if main:
        w.write(0, 1)  # one group of codes
    for code in codes:
        code.write(w)
    values, sizes = codes[0].codes.take(own[:, 0]), codes[0].sizes.take(own[:, 0])
    for code, c in zip(codes[1:4], range(1, 4), strict=True):
        if len(code.lengths) > 1:
            values |= code.codes.take(own[:, c]) << sizes.astype(np.uint64)
            sizes += code.sizes.take(own[:, c])
    if plain is not None:
        some, taken = values, sizes
        values, sizes = np.zeros(n, np.uint64), np.zeros(n, np.int64)
        values[plain], sizes[plain] = some, taken
    if cached:
        at = 256 + _LENGTH_SYMBOLS + slots[hits].astype(np.int64)
        values[hits], sizes[hits] = codes[0].codes[at], codes[0].sizes[at]
    if copies:
        wide, far_wide = ((c.codes.tolist(), c.sizes.tolist()) for c in (codes[0], codes[4]))
        written = []
        for (s, more, k), (t, further, m) in zip(lengths, distances, strict=True):
            size = wide[1][256 + s]
            value, size = wide[0][256 + s] | more << size, size + k
            value, size = value | far_wide[0][t] << size, size + far_wide[1][t]
            written.append((value | further << size, size + m))
        at = [i for i, _, _ in copies]
        values[at], sizes[at] = zip(*written, strict=True)
    w.extend(values, sizes)


@lru_cache(maxsize=64)
def _near_codes(width: int) -> dict[int, int]:
    """The least short code of each distance."""
    return {_distance(code, width): code for code in range(len(_NEAR), 0, -1)}


def _joined(samples: np.ndarray) -> np.ndarray:
    """(..., 3) samples of red, green, blue -> opaque pixels as numbers."""
    wide = samples.astype(np.uint32)
    return np.uint32(255 << 24) | wide[..., 0] << np.uint32(16) | wide[..., 1] << np.uint32(8) | wide[..., 2]


#: Bits that a transform must be expected to save.
_WORTH = 100


def encode_pixels(rgb: bytes, width: int, height: int) -> bytes:
    """A WebP file of opaque pixels, three samples each."""
    samples = np.frombuffer(rgb, np.uint8).reshape(height, width, 3)
    w = BitWriter()
    for value, n in ((_SIGNATURE, 8), (width - 1, 14), (height - 1, 14), (0, 1), (0, 3)):
        w.write(value, n)
    pixels = _joined(samples).ravel()
    costs = {"": _bits(np.bincount(samples.ravel()), samples.size)}
    others = samples[:, :, ::2] - samples[:, :, 1:2]
    costs["green"] = _WORTH + _bits(np.bincount(samples[:, :, 1].ravel()), len(pixels)) + _bits(np.bincount(others.ravel()), others.size)
    residual = samples.copy()
    residual[0, 1:] -= samples[0, :-1]
    residual[1:] -= samples[:-1]
    costs["above"] = _WORTH + _bits(np.bincount(residual.ravel()), residual.size)
    ordered = np.sort(pixels)
    new = (ordered[1:] != ordered[:-1]).nonzero()[0]
    if len(new) < 256:
        colours = np.concatenate((ordered[:1], ordered[new + 1]))
        index = np.searchsorted(colours, pixels).reshape(height, width)
        costs["palette"] = _WORTH + 20 * len(colours) + _bits(np.bincount(index.ravel()), index.size)
    best = min(costs, key=lambda k: costs[k])
    if best == "palette":
        w.write(1, 1)
        w.write(3, 2)
        w.write(len(colours) - 1, 8)
        deltas = colours.view(np.uint8).reshape(-1, 4).copy()
        deltas[1:] -= deltas[:-1].copy()
        _write_image(w, deltas.view(np.uint32).ravel(), len(colours), False)
        pack = palette_pack(len(colours))
        coded = -(-width >> pack)
        packed = np.zeros((height, coded << pack), np.uint32)
        packed[:, :width] = index
        shifts = np.arange(1 << pack, dtype=np.uint32) * np.uint32(8 >> pack)
        pixels = (packed.reshape(height, coded, -1) << shifts).sum(2, dtype=np.uint32).ravel() << np.uint32(8)
        width = coded
    elif best == "green":
        w.write(1, 1)
        w.write(2, 2)
        pixels = _joined(np.stack([others[:, :, 0], samples[:, :, 1], others[:, :, 1]], axis=2)).ravel()
    elif best == "above":
        w.write(1, 1)
        w.write(0, 2)
        w.write(7, 3)  # blocks of 512 pixels
        modes = np.full((-(-height >> 9)) * (-(-width >> 9)), 2 << 8, np.uint32)
        _write_image(w, modes, -(-width >> 9), False)
        pixels = (_joined(residual) & np.uint32(0xFFFFFF)).ravel()
        # only the first pixel's alpha is not predicted; black is opaque, so it is 0 as well
    w.write(0, 1)
    _write_image(w, pixels, width, True)
    stream = w.bytes()
    pad = b"\0" * (len(stream) % 2)
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def pad_payload(raw: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of ``ROW_BYTES``."""
    rows = max(1, -(-len(raw) // ROW_BYTES))
    return raw.ljust(rows * ROW_BYTES, b"\xff")


def encode_payload(payload: bytes) -> bytes:
    """Store a padded payload: one WebP file after another, each of up to 16,384 rows."""
    step = MAX_SIDE * ROW_BYTES
    parts = [payload[i : i + step] for i in range(0, len(payload), step)]
    return b"".join([encode_pixels(p, ROW_BYTES // 3, len(p) // ROW_BYTES) for p in parts])


def decode_files(media: bytes) -> list[np.ndarray]:
    """The pixel arrays of consecutive WebP files."""
    out = []
    while media:
        if media[:4] != b"RIFF" or media[8:16] != b"WEBPVP8L":
            raise WebPError("no lossless WebP file")
        size, n = struct.unpack_from("<I", media, 4)[0], struct.unpack_from("<I", media, 16)[0]
        out.append(decode_stream(media[20 : 20 + n]))
        media = media[8 + size :]
    return out
