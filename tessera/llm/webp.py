"""Lossless WebP (VP8L, RFC 9649): a complete decoder, an encoder with every transform, and fast paths for many images.

decode() reads any lossless WebP: simple and normal prefix codes, entropy images, back-references, colour cache, and the
predictor, cross-colour, subtract-green and palette transforms, which it inverts. encode() writes all of these but entropy
images, as asked. encode_many() and decode_many() do the same work for images that need prefix codes alone, many images at
a time in step, and hand all others to the former two. Images are arrays (height, width, 4) of bytes in the order in which
the format codes them: green, red, blue, alpha.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
#: Fixed values of the format: the order of code-length code lengths, and the nearest pixels by distance code.
ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAREST = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))
HASH = 0x1E35A7BD
#: Our own code for code lengths, the same for all images: lengths of its words by symbol.
LENGTHS_CODE = [5 if s in (1, 13, 14, 15) else 0 if s == 16 else 4 for s in range(19)]
#: Longest prefix code that we write; the format allows 15.
LONGEST = 11
#: Images that are decoded in step.
LANES = 512


class Bits:
    """Bits of data from the least significant on."""

    def __init__(self, data: bytes):
        self.value, self.at, self.end = int.from_bytes(data, "little"), 0, 8 * len(data)

    def read(self, n: int) -> int:
        got = (self.value >> self.at) & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the image ends early")
        return got


class Words:
    """Bits of a long stream, held in a window, so that reading one does not touch them all."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.next, self.held, self.count = data, at >> 3, 0, 0
        self.read(at & 7)

    def _fill(self) -> None:
        part = self.data[self.next : self.next + 512]
        self.held |= int.from_bytes(part, "little") << self.count
        self.next += len(part)
        self.count += 8 * len(part)

    def peek(self) -> int:
        if self.count < 64 and self.next < len(self.data):
            self._fill()
        return self.held

    def skip(self, n: int) -> None:
        self.held >>= n
        self.count -= n
        if self.count < 0:
            raise ValueError("the image ends early")

    def read(self, n: int) -> int:
        got = self.peek() & ((1 << n) - 1)
        self.skip(n)
        return got


class Writer:
    def __init__(self) -> None:
        self.value = self.count = 0
        self.done: list[bytes] = []

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.count
        self.count += n
        if self.count >= 512:
            self.done.append((self.value & ((1 << 512) - 1)).to_bytes(64, "little"))
            self.value >>= 512
            self.count -= 512

    def bytes(self) -> bytes:
        return b"".join(self.done) + self.value.to_bytes((self.count + 7) // 8, "little")


def _reversals(bits: int) -> np.ndarray:
    """Every number of so many bits with its bits in the opposite order."""
    out = np.zeros(1, dtype=np.int64)
    for _ in range(bits):
        out = np.concatenate([out * 2, out * 2 + 1])
    return out


REVERSED = [_reversals(n).tolist() for n in range(16)]
TURNED = [_reversals(n) for n in range(16)]


def canonical(lengths: Sequence[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code as it stands in the stream, length)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, before = {}, 0, used[0][0] if used else 0
    for n, s in used:
        code <<= n - before
        out[s] = (REVERSED[n][code], n)
        code, before = code + 1, n
    return out


def code_lengths(counts: Sequence[int], longest: int = LONGEST) -> list[int]:
    """Lengths of a prefix code for symbols by their counts; a lone symbol gets length 1."""
    out = [0] * len(counts)
    used = sorted((c, s) for s, c in enumerate(counts) if c)
    if len(used) < 2:
        for _, s in used:
            out[s] = 1
        return out
    weights, n = [c for c, _ in used], len(used)
    while True:
        parent, inner, leaf, node = [0] * (2 * n - 1), [], 0, 0
        for new in range(n, 2 * n - 1):  # the two lightest of leaves and inner nodes, both in order, become one
            total = 0
            for _ in range(2):
                if leaf < n and (node >= len(inner) or weights[leaf] <= inner[node]):
                    total += weights[leaf]
                    parent[leaf] = new
                    leaf += 1
                else:
                    total += inner[node]
                    parent[n + node] = new
                    node += 1
            inner.append(total)
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[parent[k]] + 1
        if max(depth[:n]) <= longest:
            for (_, s), d in zip(used, depth, strict=False):
                out[s] = d
            return out
        weights = [(w + 1) // 2 for w in weights]


def _reader(lengths: Sequence[int]) -> tuple[dict[tuple[int, int], int] | int, int]:
    """What symbol() needs: symbols by code and length, or the only symbol; and the longest length."""
    codes = canonical(lengths)
    if len(codes) == 1:
        return next(iter(codes)), 0
    if sum(2.0**-n for _, n in codes.values()) != 1:
        raise ValueError("a prefix code is not complete")
    most = max(n for _, n in codes.values())
    table = [0] * (1 << most)
    for s, (c, n) in codes.items():
        for k in range(c, 1 << most, 1 << n):
            table[k] = s << 4 | n
    return table, most


def _symbol(bits: Words, code: tuple) -> int:
    table, most = code
    if not most:
        return table
    got = table[bits.peek() & ((1 << most) - 1)]
    bits.skip(got & 15)
    return got >> 4


def read_lengths(bits, alphabet: int) -> list[int]:
    """The code lengths of a prefix code. bits: anything with read()."""
    out = [0] * alphabet
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        out[bits.read(8 if wide else 1)] = 1
        if two:
            out[bits.read(8)] = 1
        return out
    own = [0] * 19
    for s in ORDER[: 4 + bits.read(4)]:
        own[s] = bits.read(3)
    codes = {(n, c): s for s, (c, n) in canonical(own).items()}
    lone = next(iter(codes.values())) if len(codes) == 1 else None
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    at, before = 0, 8
    while at < alphabet and left:
        left -= 1
        if lone is not None:
            s = lone
        else:
            c = n = 0
            while (n, c) not in codes:
                c |= bits.read(1) << n
                n += 1
                if n > 7:
                    raise ValueError("no such code")
            s = codes[n, c]
        if s < 16:
            out[at] = s
            at += 1
            before = s or before
        else:
            times, value = (3 + bits.read(2), before) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            out[at : at + times] = [value] * times
            at += times
    if at > alphabet or len(out) != alphabet:
        raise ValueError("too many code lengths")
    return out


def _extended(bits: Words, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    more = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << more) + bits.read(more) + 1


def _pixels(bits: Words, width: int, height: int, main: bool) -> list[int]:
    """Entropy-coded pixels as numbers 0xAARRGGBB."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    cache = [0] * (1 << cache_bits) if cache_bits else []
    block, groups_of, groups = 0, None, 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block) if False else (width + (1 << block) - 1) >> block
        groups_of = [(p >> 8) & 0xFFFF for p in _pixels(bits, across, (height + (1 << block) - 1) >> block, False)]
        groups = max(groups_of) + 1
    sizes = (280 + len(cache), 256, 256, 256, 40)
    codes = [[_reader(read_lengths(bits, n)) for n in sizes] for _ in range(groups)]
    out: list[int] = []
    total, green = width * height, codes[0]
    while len(out) < total:
        at = len(out)
        if groups_of is not None:
            green = codes[groups_of[(at // width >> block) * across + (at % width >> block)]]
        s = _symbol(bits, green[0])
        if s < 256:
            red, blue, alpha = (_symbol(bits, green[k]) for k in (1, 2, 3))
            new = [alpha << 24 | red << 16 | s << 8 | blue]
        elif s < 280:
            length = _extended(bits, s - 256)
            code = _extended(bits, _symbol(bits, green[4]))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAREST[code - 1]
                back = max(1, x + y * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            new = [out[at - back + k % back] for k in range(length)]
        else:
            new = [cache[s - 280]]
        out += new
        if cache:
            for p in new:
                cache[((HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits)] = p
    return out


def _average(a: list[int], b: list[int]) -> list[int]:
    return [(x + y) >> 1 for x, y in zip(a, b, strict=True)]


def predicted(mode: int, left: list[int], top: list[int], right: list[int], corner: list[int]) -> list[int]:
    """A pixel's prediction from its left, top, top right and top left neighbours."""
    if mode == 0 or mode > 13:
        return [0, 0, 0, 255]
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode == 5:
        return _average(_average(left, right), top)
    if mode == 10:
        return _average(_average(left, corner), _average(top, right))
    if mode <= 9:
        return _average(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, corner, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, corner, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [min(255, max(0, x + t - c)) for x, t, c in zip(left, top, corner, strict=True)]
    return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(_average(left, top), corner, strict=True)]


def _modes(row: int, column: int, width: int, block: int, across: int, modes: Sequence[int]) -> int:
    return modes[(row >> block) * across + (column >> block)]


def _predict(image: np.ndarray, modes: Sequence[int], block: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or takes away each pixel's prediction."""
    height, width = image.shape[:2]
    across = (width + (1 << block) - 1) >> block
    given = image.reshape(-1, 4).tolist()
    whole = [p[:] for p in given] if inverse else given
    out = whole if inverse else [p[:] for p in given]
    for at in range(len(given)):
        y, x = divmod(at, width)
        if not at:
            base = [0, 0, 0, 255]
        elif not y:
            base = whole[at - 1]
        elif not x:
            base = whole[at - width]
        else:
            base = predicted(_modes(y, x, width, block, across, modes), whole[at - 1], whole[at - width], whole[at - width + 1], whole[at - width - 1])
        out[at] = [(a + b) & 255 if inverse else (a - b) & 255 for a, b in zip(given[at], base, strict=True)]
    return np.array(out, dtype=np.uint8).reshape(image.shape)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int32)


def _cross(image: np.ndarray, elements: np.ndarray, block: int, inverse: bool) -> np.ndarray:
    """elements: (rows, columns, 3) of green_to_red, green_to_blue, red_to_blue."""
    height, width = image.shape[:2]
    e = _signed(elements)[np.arange(height)[:, None] >> block, np.arange(width)[None] >> block]
    out = image.copy()
    green, old_red = _signed(image[..., 0]), image[..., 1]
    sign = 1 if inverse else -1
    red = (old_red + sign * (e[..., 0] * green >> 5)).astype(np.uint8)
    whole_red = _signed(red if inverse else old_red)
    out[..., 1] = red
    out[..., 2] = (image[..., 2] + sign * ((e[..., 1] * green >> 5) + (e[..., 2] * whole_red >> 5))).astype(np.uint8)
    return out


def _array(pixels: Sequence[int], width: int, height: int) -> np.ndarray:
    raw = np.array(pixels, dtype="<u4").view(np.uint8).reshape(height, width, 4)
    return np.ascontiguousarray(raw[..., [1, 2, 0, 3]])


def _numbers(image: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(image[..., [2, 0, 1, 3]]).view("<u4")[..., 0].ravel()


def _bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _body(data: bytes) -> tuple[bytes, int]:
    """The VP8L chunk of the first WebP file in data, and that file's size."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise ValueError("no lossless WebP")
    size, chunk = struct.unpack_from("<I", data, 4)[0] + 8, struct.unpack_from("<I", data, 16)[0]
    if size > len(data) or 20 + chunk > size or data[20] != 0x2F:
        raise ValueError("no whole lossless WebP")
    return data[20 : 20 + chunk], size


def decode(data: bytes) -> np.ndarray:
    """The image (height, width, 4) of a lossless WebP file."""
    bits = Words(_body(data)[0], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("no such version")
    undo = []
    seen: set[int] = set()
    across = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            columns, rows = (across + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
            part = _pixels(bits, columns, rows, False)
            if kind == PREDICTOR:
                undo.append(lambda i, m=[(p >> 8) & 15 for p in part], b=block: _predict(i, m, b, True))
            else:
                e = np.array([[p & 255, (p >> 8) & 255, (p >> 16) & 255] for p in part]).reshape(rows, columns, 3)
                undo.append(lambda i, e=e, b=block: _cross(i, e, b, True))
        elif kind == SUBTRACT_GREEN:
            undo.append(_add_green)
        else:
            colours = bits.read(8) + 1
            table = np.cumsum(_array(_pixels(bits, colours, 1, False), colours, 1)[0], axis=0, dtype=np.uint64).astype(np.uint8)
            undo.append(lambda i, t=table, w=across: _unbundle(i, t, w))
            shift = _bundle_bits(colours)
            across = (across + (1 << shift) - 1) >> shift
    image = _array(_pixels(bits, across, height, True), across, height)
    for step in reversed(undo):
        image = step(image)
    return image


def _add_green(image: np.ndarray) -> np.ndarray:
    out = image.copy()
    out[..., 1] += image[..., 0]
    out[..., 2] += image[..., 0]
    return out


def _unbundle(image: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    shift = _bundle_bits(len(table))
    each = 8 >> shift
    at = np.arange(width)
    index = image[:, at >> shift, 0] >> (each * (at & ((1 << shift) - 1))) & ((1 << each) - 1)
    full = np.zeros((256, 4), dtype=np.uint8)
    full[: len(table)] = table
    return full[index]


def _put_lengths(out: Writer, lengths: Sequence[int]) -> None:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 1 and (not used or used[0] < 256):
        only = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(only > 1, 1)
        out.put(only, 8 if only > 1 else 1)
        return
    out.put(0, 1)
    out.put(15, 4)
    for s in ORDER:
        out.put(LENGTHS_CODE[s], 3)
    out.put(0, 1)
    before = -1
    for s in [*used, len(lengths)]:
        zeros = s - before - 1
        while zeros:
            if zeros < 3:
                out.put(*_CL[0])
                zeros -= 1
            elif zeros < 11:
                out.put(*_CL[17])
                out.put(zeros - 3, 3)
                zeros = 0
            else:
                n = min(zeros, 138)
                out.put(*_CL[18])
                out.put(n - 11, 7)
                zeros -= n
        if s < len(lengths):
            out.put(*_CL[lengths[s]])
        before = s


_CL = canonical(LENGTHS_CODE)


def _prefix(value: int) -> tuple[int, int, int]:
    """prefix code, extra bits, their number, of a length or distance of at least 1."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    more = high - 1
    return 2 * high + (v >> more & 1), v & ((1 << more) - 1), more


def _put_pixels(out: Writer, image: np.ndarray, main: bool, cache_bits: int = 0, matches: bool = False) -> None:
    width, pixels = image.shape[1], _numbers(image).tolist()
    tokens: list[tuple] = []
    cache = [0] * (1 << cache_bits) if cache_bits else []
    last: dict[tuple, int] = {}
    at = 0
    while at < len(pixels):
        length = back = 0
        if matches:
            key = tuple(pixels[at : at + 3])
            if (j := last.get(key)) is not None and len(key) == 3:
                while at + length < len(pixels) and length < 4096 and pixels[j + length] == pixels[at + length]:
                    length += 1
                back = at - j
        if length >= 3:
            code = next((k + 1 for k, (x, y) in enumerate(NEAREST) if max(1, x + y * width) == back), back + 120)
            tokens.append(("match", _prefix(length), _prefix(code)))
        else:
            length, p = 1, pixels[at]
            slot = ((HASH * p) & 0xFFFFFFFF) >> (32 - cache_bits) if cache else 0
            if cache and cache[slot] == p and at:
                tokens.append(("cache", slot))
            else:
                tokens.append(("pixel", p >> 8 & 255, p >> 16 & 255, p & 255, p >> 24))
        for k in range(at, at + length):
            if cache:
                cache[((HASH * pixels[k]) & 0xFFFFFFFF) >> (32 - cache_bits)] = pixels[k]
            if matches:
                last[tuple(pixels[k : k + 3])] = k
        at += length
    sizes = (280 + len(cache), 256, 256, 256, 40)
    counts = [[0] * n for n in sizes]
    for t in tokens:
        if t[0] == "pixel":
            for c, s in zip(counts, t[1:], strict=False):
                c[s] += 1
        elif t[0] == "match":
            counts[0][256 + t[1][0]] += 1
            counts[4][t[2][0]] += 1
        else:
            counts[0][280 + t[1]] += 1
    if sum(map(bool, counts[0])) == 1 and not any(counts[0][:256]):
        counts[0][0] += 1
    out.put(bool(cache), 1)
    if cache:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    lengths = [code_lengths(c) for c in counts]
    for x in lengths:
        _put_lengths(out, x)
    codes = [canonical(x) if sum(map(bool, x)) > 1 else dict.fromkeys(range(len(x)), (0, 0)) for x in lengths]
    for t in tokens:
        if t[0] == "pixel":
            for c, s in zip(codes, t[1:], strict=False):
                out.put(*c[s])
        elif t[0] == "match":
            for c, s, (_, extra, n) in ((codes[0], 256 + t[1][0], t[1]), (codes[4], t[2][0], t[2])):
                out.put(*c[s])
                out.put(extra, n)
        else:
            out.put(*codes[0][280 + t[1]])


def _file(body: bytes) -> bytes:
    body = b"\x2f" + body
    pad = b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(body) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body + pad


def encode(image: np.ndarray, palette: bool = False, predictor: Sequence[int] | int | None = None, cross_colour: Sequence[int] | None = None, subtract_green: bool = False, cache_bits: int = 0, matches: bool = False, block: int = 4) -> bytes:
    """A lossless WebP file of the image, with the transforms that are asked for.

    predictor: a mode, or modes that blocks take in turn; cross_colour: green_to_red, green_to_blue, red_to_blue of all blocks.
    """
    height, width = image.shape[:2]
    out = Writer()
    for value, n in ((width - 1, 14), (height - 1, 14), (1, 1), (0, 3)):
        out.put(value, n)
    if palette:
        numbers = _numbers(image)
        table, index = np.unique(numbers, return_inverse=True)
        if len(table) > 256:
            raise ValueError("too many colours for a palette")
        out.put(1, 1)
        out.put(PALETTE, 2)
        out.put(len(table) - 1, 8)
        colours = _array(table.tolist(), len(table), 1)
        _put_pixels(out, np.diff(colours, axis=1, prepend=np.zeros((1, 1, 4), dtype=np.uint8)), False)
        shift = _bundle_bits(len(table))
        each, per = 8 >> shift, 1 << shift
        rows = np.zeros((height, -(-width // per) * per), dtype=np.uint8)
        rows[:, :width] = index.reshape(height, width)
        packed = (rows.reshape(height, -1, per) << (each * np.arange(per, dtype=np.uint8))).sum(axis=2, dtype=np.uint8)
        image = np.zeros((*packed.shape, 4), dtype=np.uint8)
        image[..., 0], image[..., 3] = packed, 255
        width = image.shape[1]
    columns, rows_of = (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block
    if predictor is not None:
        modes = ([predictor] if isinstance(predictor, int) else list(predictor)) * (columns * rows_of)
        modes = modes[: columns * rows_of]
        out.put(1, 1)
        out.put(PREDICTOR, 2)
        out.put(block - 2, 3)
        part = np.zeros((rows_of, columns, 4), dtype=np.uint8)
        part[..., 0], part[..., 3] = np.array(modes).reshape(rows_of, columns), 255
        _put_pixels(out, part, False)
        image = _predict(image, modes, block, False)
    if cross_colour is not None:
        e = np.broadcast_to(np.array(cross_colour, dtype=np.int64) & 255, (rows_of, columns, 3))
        out.put(1, 1)
        out.put(CROSS_COLOUR, 2)
        out.put(block - 2, 3)
        part = np.full((rows_of, columns, 4), 255, dtype=np.uint8)
        part[..., 2], part[..., 0], part[..., 1] = e[..., 0], e[..., 1], e[..., 2]
        _put_pixels(out, part, False)
        image = _cross(image, e, block, False)
    if subtract_green:
        out.put(1, 1)
        out.put(SUBTRACT_GREEN, 2)
        image = image.copy()
        image[..., 1] -= image[..., 0]
        image[..., 2] -= image[..., 0]
    out.put(0, 1)
    _put_pixels(out, image, True, cache_bits, matches)
    return _file(out.bytes())


def _packed_lengths(lengths: list[int], used: list[int], alphabets: Sequence[int]) -> list[tuple[int, int]]:
    """What _put_lengths writes for each alphabet, as (bits, their number). The lengths of used symbols; others are 0."""
    value, n = 15 << 1, 5
    for s in ORDER:
        value |= LENGTHS_CODE[s] << n
        n += 3
    n += 1

    def zeros(count: int, value: int, n: int) -> tuple[int, int]:
        while count:
            if count < 3:
                (c, k), extra, more, taken = _CL[0], 0, 0, 1
            elif count < 11:
                (c, k), extra, more, taken = _CL[17], count - 3, 3, count
            else:
                taken = min(count, 138)
                (c, k), extra, more = _CL[18], taken - 11, 7
            value |= (c | extra << k) << n
            n += k + more
            count -= taken
        return value, n

    before = -1
    for s, x in zip(used, lengths, strict=True):
        if s - before > 1:
            value, n = zeros(s - before - 1, value, n)
        c, k = _CL[x]
        value |= c << n
        n += k
        before = s
    return [zeros(a - before - 1, value, n) for a in alphabets]


def encode_many(images: list[np.ndarray]) -> list[bytes]:
    """Files of many images, each with one prefix code for all channels and nothing else."""
    made = []
    for image in images:
        flat = np.ascontiguousarray(image).ravel()
        counts = np.bincount(flat, minlength=256)
        used = np.flatnonzero(counts)
        if len(used) < 2:
            made.append(encode(image))
            continue
        lengths, symbols = code_lengths(counts[used].tolist()), used.tolist()
        order = sorted(zip(lengths, symbols, strict=True))
        table, code, before = np.zeros(256, dtype=np.uint64), 0, order[0][0]
        for n, s in order:
            code <<= n - before
            table[s] = REVERSED[n][code] | n << 32
            code, before = code + 1, n
        (green, green_bits), (other, other_bits) = _packed_lengths(lengths, symbols, (280, 256))
        head = (image.shape[1] - 1) | (image.shape[0] - 1) << 14 | 1 << 28
        head |= green << 35
        bits = 35 + green_bits
        for _ in range(3):
            head |= other << bits
            bits += other_bits
        head |= 1 << bits  # a simple code of the one symbol 0 for distances
        bits += 4
        word = table[flat].reshape(-1, 4)
        n, word = word >> np.uint64(32), word & np.uint64(0xFFFFFFFF)
        both, long = word[:, 0] | word[:, 1] << n[:, 0], n[:, 0] + n[:, 1]
        both |= word[:, 2] << long
        long += n[:, 2]
        both |= word[:, 3] << long
        long += n[:, 3]
        ends = np.cumsum(long) + np.uint64(bits & 63)
        place = ends - long
        shift, at = place & np.uint64(63), (place >> np.uint64(6)).astype(np.int64)
        firsts = np.flatnonzero(np.diff(at, prepend=-1))
        words = np.zeros(at[-1] + 2, dtype=np.uint64)
        words[:-1] = np.bitwise_or.reduceat(both << shift, firsts)
        lasts = np.append(firsts[1:], len(at)) - 1
        words[1:] |= (both[lasts] >> np.uint64(1)) >> (np.uint64(63) - shift[lasts])
        low = bits >> 6 << 3
        raw = head.to_bytes(low + 8, "little")
        words[0] |= np.uint64(int.from_bytes(raw[low:], "little"))
        total = (bits >> 6 << 6) + int(ends[-1])
        made.append(_file((raw[:low] + words.tobytes())[: (total + 7) // 8]))
    return made


_length_tables: dict[tuple, list[int] | None] = {}


def _length_table(own: tuple) -> list[int] | None:
    """symbol << 3 | length by the next seven bits, or None if that is no complete code."""
    if own not in _length_tables:
        codes = canonical(own)
        table = [0] * 128
        for s, (c, n) in codes.items():
            for k in range(c, 128, 1 << n):
                table[k] = s << 3 | n
        _length_tables[own] = table if len(codes) > 1 and all(table) else None
    return _length_tables[own]


def _quick_lengths(value: int, at: int, alphabet: int) -> tuple[list[int], int]:
    """What read_lengths gives, from a number that holds the bits, and where it ended."""
    v = value >> at
    if v & 1 or (v >> 1 & 15) != 15:
        bits = Bits(b"")
        bits.value, bits.at, bits.end = value, at, 1 << 30
        return read_lengths(bits, alphabet), bits.at
    own = [0] * 19
    for k, s in enumerate(ORDER):
        own[s] = v >> (5 + 3 * k) & 7
    table = _length_table(tuple(own))
    v >>= 63  # 5 + 3 * 19 lengths, and the bit that says that all code lengths follow
    if table is None or value >> (at + 62) & 1:
        bits = Bits(b"")
        bits.value, bits.at, bits.end = value, at, 1 << 30
        return read_lengths(bits, alphabet), bits.at
    used, out, before = 63, [], 8
    n = 0
    while n < alphabet:
        e = table[v & 127]
        k, s = e & 7, e >> 3
        if s < 16:
            out.append(s)
            n += 1
            before = s or before
        else:
            extra = 2 if s == 16 else 3 if s == 17 else 7
            times = (v >> k & ((1 << extra) - 1)) + (11 if s == 18 else 3)
            out += [before if s == 16 else 0] * times
            n += times
            k += extra
        v >>= k
        used += k
    if n > alphabet:
        raise ValueError("too many code lengths")
    return out, at + used


def _plain_head(body: bytes) -> tuple[int, int, list[list[int]], int] | None:
    """width, height, lengths of four codes and where pixels begin, if the image needs prefix codes alone."""
    value = int.from_bytes(body[:1536], "little")
    if value >> 37 & 63:  # version, then no transform, no cache, no entropy image
        return None
    width, height = (value >> 8 & 16383) + 1, (value >> 22 & 16383) + 1
    try:
        green, at = _quick_lengths(value, 43, 280)
        if any(green[256:]):
            return None
        codes = [green[:256]]
        text = known = None
        for _ in range(3):
            if known is not None and value >> at & ((1 << known) - 1) == text:
                codes.append(codes[-1])
                at += known
                continue
            lengths, end = _quick_lengths(value, at, 256)
            codes.append(codes[0] if lengths == codes[0] else lengths)
            known = end - at
            text, at = value >> at & ((1 << known) - 1), end
        at = _quick_lengths(value, at, 40)[1]
    except (ValueError, KeyError, IndexError):
        return None
    return (width, height, codes, at) if at < 12_000 else None


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The images of many files. Those with prefix codes alone, of up to LONGEST bits, are decoded in step."""
    out: list[np.ndarray | None] = [None] * len(files)
    plain = []
    for k, f in enumerate(files):
        body = _body(f)[0]
        head = _plain_head(body)
        if head and max(map(max, head[2])) <= LONGEST:
            plain.append((head[0] * head[1], k, head, body))
        else:
            out[k] = decode(f)
    plain.sort(key=lambda x: -x[0])
    for k in range(0, len(plain), LANES):
        _decode_lanes(plain[k : k + LANES], out)
    return out


def _decode_lanes(plain: list[tuple], out: list) -> None:
    """Decodes images of falling size, one pixel of each at a time, into their places in out."""
    n, most = len(plain), max(max(map(max, h[2])) for _, _, h, _ in plain)
    tables: list[np.ndarray] = []
    base = np.zeros((4, n), dtype=np.int64)
    for j, (_, _, head, _) in enumerate(plain):
        for c, lengths in enumerate(head[2]):
            if not c or lengths is not head[2][c - 1]:
                tables.append(_table(lengths, most))
            base[c, j] = len(tables) - 1 << most
    table = np.concatenate(tables)
    bodies = [b for _, _, _, b in plain]
    starts = np.cumsum([0, *(len(b) + 8 for b in bodies)])[:-1]
    stream = np.frombuffer(b"".join(b + bytes(8) for b in bodies) + bytes(8), dtype=np.uint8)
    windows = np.ndarray((len(stream) - 7,), dtype="<u8", buffer=stream, strides=(1,))
    at = 8 * starts + np.array([h[3] for _, _, h, _ in plain])
    limit = 8 * (starts + np.array([len(b) for b in bodies]))
    sizes = np.array([s for s, *_ in plain])
    found = np.zeros((int(sizes[0]), 4, n), dtype=np.uint8)
    mask, active = (1 << most) - 1, n
    for step in range(int(sizes[0])):
        while sizes[active - 1] <= step:
            active -= 1
        now = at[:active]
        w = (windows[now >> 3] >> (now & 7).view(np.uint64)).view(np.int64)
        for c in range(4):
            e = table[base[c, :active] + (w & mask)]
            found[step, c, :active] = e >> 4
            length = (e & 15).astype(np.int64)
            w >>= length
            now += length
        np.minimum(now, limit[:active], out=now)
    for j, (size, k, head, _) in enumerate(plain):
        out[k] = np.ascontiguousarray(found[:size, :, j]).reshape(head[1], head[0], 4)


def _table(lengths: Sequence[int], most: int) -> np.ndarray:
    """symbol << 4 | length by the next bits of the stream."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return np.full(1 << most, used[0][1] << 4, dtype=np.uint16)
    entries = np.array([s << 4 | n for n, s in used], dtype=np.uint16)
    inorder = np.repeat(entries, 1 << (most - (entries & 15).astype(np.int64)))
    if len(inorder) != 1 << most:
        raise ValueError("a prefix code is not complete")
    return inorder[TURNED[most]]
