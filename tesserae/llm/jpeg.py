"""Baseline JPEG in numpy: lossless storage of bytes as DC coefficients, and DC-only thumbnails.

Each byte is the DC coefficient of one 8 x 8 block of a greyscale image (quantised by 8, so the
block's mean is the byte), without AC coefficients: any JPEG reader shows the bytes as grey tiles,
and the DC-only thumbnail is exactly the bytes. Each row of blocks is a restart interval, so rows
are decoded side by side.

The reader takes any baseline (SOF0) file: it parses the markers, Huffman-decodes the scan with
one vector lane for each restart interval, skips AC coefficients, and rebuilds the luminance
thumbnail from the DC coefficients alone. Lanes of many files with equal tables go together.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Payload bytes of an image: memory is some hundred bytes for each.
PART = 1 << 22
WIDTH = 64  # blocks in a row of a stored payload; a wider row only where 65,535 pixels of height don't do
_MOST = 65535 // 8

#: The DC luminance table of the standard (its annex K.3.1): codes by length, then symbols.
_DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
_DC_SYMBOLS = tuple(range(12))
#: The only AC symbol stored is "end of block", with the one-bit code 0.
_AC_COUNTS = (1,) + (0,) * 15
_AC_SYMBOLS = (0,)


def _codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), canonical."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[symbols[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _encoding() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a block (DC size, DC value, end of block) and their number."""
    codes, bits, lengths = _codes(_DC_COUNTS, _DC_SYMBOLS), [], []
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value = d if d >= 0 else d + (1 << size) - 1
        bits.append((code << size | value) << 1)
        lengths.append(n + size + 1)
    return np.array(bits, np.uint32), np.array(lengths, np.int64)


_BITS, _LENGTHS = _encoding()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def store(payload: bytes) -> bytes:
    """Baseline JPEG that holds the payload: one image, or for a long payload images one after the other, of PART bytes each."""
    return b"".join(_image(payload[i : i + PART]) for i in range(0, max(1, len(payload)), PART))


def images(data: bytes) -> list[bytes]:
    """The images of a file that `store` made; any other file is one image."""
    out, i = [], 0
    while data[i : i + 2] == b"\xff\xd8":
        h = parse(data[i:])
        if not h.comment.startswith(b"payload="):
            break
        end = data.find(b"\xff\xd9", i + h.start) + 2  # no entropy-coded byte looks like it
        if end < 2:
            break
        out.append(data[i:end])
        i = end
    return out if out and i == len(data) else [data]


def _image(payload: bytes) -> bytes:
    """One image; the payload's length stands in a comment."""
    n = len(payload)
    width = WIDTH * max(1, -(-n // (WIDTH * _MOST)))
    height = max(1, -(-n // width))
    grid = np.zeros(width * height, np.int64)
    grid[:n] = np.frombuffer(payload, np.uint8)
    grid = grid.reshape(height, width) - 128
    diff = np.diff(grid, axis=1, prepend=0) + 255
    bits, lengths = _BITS[diff], _LENGTHS[diff]
    used = lengths.sum(axis=1)
    room = (used + 7) // 8 * 8  # a row ends on a byte, filled with ones
    start = np.concatenate([[0], np.cumsum(room)[:-1]])
    at = (start[:, None] + np.cumsum(lengths, axis=1) - lengths).ravel()
    bits, lengths = bits.ravel(), lengths.ravel()
    total = int(room.sum()) // 8
    # a code of up to 17 bits at any bit offset lies in three bytes; no two codes share a bit
    wide = bits.astype(np.int64) << 24 - lengths - (at & 7)
    first = at >> 3
    packed = np.zeros(total + 3)
    for k in range(3):
        packed += np.bincount(first + k, wide >> 16 - 8 * k & 255, total + 3)
    packed = packed[:total].astype(np.uint8)
    ends = np.cumsum(room // 8)
    packed[ends - 1] |= ((1 << room - used) - 1).astype(np.uint8)
    # byte 0 after each 0xFF, and the restart marker after each row but the last
    extra = (packed == 0xFF).astype(np.int64)
    extra[ends[:-1] - 1] += 2
    place = np.arange(len(packed)) + np.concatenate([[0], np.cumsum(extra)[:-1]])
    scan = np.zeros(len(packed) + int(extra.sum()), np.uint8)
    scan[place] = packed
    marks = place[ends[:-1] - 1] + 1 + (packed[ends[:-1] - 1] == 0xFF)
    scan[marks] = 0xFF
    scan[marks + 1] = 0xD0 + np.arange(len(marks)) % 8
    head = (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xFE, b"payload=%d" % n)
        + _segment(0xDB, b"\0" + bytes([8]) + bytes([1]) * 63)
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, height * 8, width * 8, 1, 1, 0x11, 0))
        + _segment(0xC4, b"\x00" + bytes(_DC_COUNTS) + bytes(_DC_SYMBOLS))
        + _segment(0xC4, b"\x10" + bytes(_AC_COUNTS) + bytes(_AC_SYMBOLS))
        + _segment(0xDD, struct.pack(">H", width))
        + _segment(0xDA, b"\1\1\0\0\x3f\0")
    )
    return head + scan.tobytes() + b"\xff\xd9"


@dataclass
class Header:
    width: int = 0
    height: int = 0
    parts: list = field(default_factory=list)  # (id, across, down, quantisation table number)
    dc_quant: dict = field(default_factory=dict)
    tables: dict = field(default_factory=dict)  # class << 4 | number -> (counts, symbols)
    scan: list = field(default_factory=list)  # (component, DC table, AC table)
    interval: int = 0
    comment: bytes = b""
    start: int = 0

    def key(self) -> tuple:
        """What files must share for their intervals to be decoded together."""
        return tuple(self.blocks()), tuple(sorted(self.tables.items()))

    def blocks(self) -> list[tuple[int, int, int]]:
        """The blocks of a unit of the scan: (component's place, DC table, AC table)."""
        if len(self.scan) == 1:
            c, d, a = self.scan[0]
            return [(0, d, a)]
        by = {p[0]: p for p in self.parts}
        return [(k, d, a) for k, (c, d, a) in enumerate(self.scan) for _ in range(by[c][1] * by[c][2])]

    def units(self) -> tuple[int, int]:
        """Units across and down."""
        if len(self.scan) == 1:
            p = {p[0]: p for p in self.parts}[self.scan[0][0]]
            across, down = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
            w, h = -(-self.width * p[1] // across), -(-self.height * p[2] // down)
            return -(-w // 8), -(-h // 8)
        return -(-self.width // (8 * max(p[1] for p in self.parts))), -(-self.height // (8 * max(p[2] for p in self.parts)))


def parse(data: bytes) -> Header:
    """Read the markers up to the first scan; raise ValueError on anything but baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    h, i = Header(), 2
    while i + 4 <= len(data):
        if data[i] != 0xFF:
            raise ValueError("marker expected")
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        if n < 2:
            raise ValueError("bad length")
        body = data[i + 4 : i + 2 + n]
        if marker == 0xC0:
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise ValueError("frame cut off")
            precision, h.height, h.width, count = struct.unpack(">BHHB", body[:6])
            if precision != 8 or not h.height or not h.width or not count:
                raise ValueError("no baseline frame")
            h.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            if any(not 1 <= x <= 4 for p in h.parts for x in p[1:3]):
                raise ValueError("bad sampling factors")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                if wide > 1 or len(body) < 1 + 64 * (1 + wide):
                    raise ValueError("bad quantisation table")
                h.dc_quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                if len(body) < 17 + sum(counts) or sum(c << 16 - n for n, c in enumerate(counts, 1)) > 1 << 16:
                    raise ValueError("bad code table")
                h.tables[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            h.interval = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            h.comment = body
        elif marker == 0xDA:
            if not body or len(body) < 1 + 2 * body[0] or not body[0]:
                raise ValueError("scan header cut off")
            h.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            h.start = i + 2 + n
            if not h.parts or not {c for c, _, _ in h.scan} <= {p[0] for p in h.parts}:
                raise ValueError("scan before frame")
            wanted = {t for _, d, a in h.scan for t in (d, 16 | a)}
            if not wanted <= set(h.tables) or {p[0]: p for p in h.parts}[h.scan[0][0]][3] not in h.dc_quant:
                raise ValueError("tables missing")
            across, down = h.units()
            if across * down * len(h.blocks()) * 2 > 8 * (len(data) - h.start):  # a block takes two bits or more
                raise ValueError("larger than its data")
            return h
        i += 2 + n
    raise ValueError("no scan")


def _lookup(table) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol and its code's length (0: no code)."""
    symbol, length = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
    for s, (code, n) in _codes(*table).items():
        lo = code << 16 - n
        symbol[lo : lo + (1 << 16 - n)] = s
        length[lo : lo + (1 << 16 - n)] = n
    return symbol, length


def decode(files: list[tuple[bytes, Header]]) -> list[np.ndarray]:
    """For files with equal keys: the quantised DC coefficients of the first component's blocks, in scan order."""
    blocks, tables = files[0][1].blocks(), {k: _lookup(t) for k, t in files[0][1].tables.items()}
    buffers, starts, units, owner, base = [], [], [], [], 0
    for f, (data, h) in enumerate(files):
        raw = np.frombuffer(data, np.uint8)[h.start :]
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        stop = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
        end = int(stop[0]) if len(stop) else len(raw)
        rst = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)]
        keep = np.ones(end, bool)
        keep[(ff[(after == 0) & (ff + 1 < end)]) + 1] = False
        keep[rst] = keep[rst + 1] = False
        clean = raw[:end][keep]
        across, down = h.units()
        left = np.arange(across * down, 0, -(h.interval or across * down))
        if len(left) != len(rst) + 1:
            raise ValueError("restart markers don't fit the interval")
        starts.append(base + np.concatenate([[0], (rst if len(rst) == 0 else np.cumsum(keep)[rst])]))
        units.append(np.minimum(left, h.interval or across * down))
        owner.append(np.full(len(left), f))
        buffers += [clean, np.full(8, 255, np.uint8)]
        base += len(clean) + 8
    buffer = np.concatenate([*buffers, np.full(8, 255, np.uint8)])
    window = np.ndarray((len(buffer) - 7,), ">u8", buffer, strides=(1,))  # the eight bytes from each byte
    units, owner, pos = np.concatenate(units), np.concatenate(owner), np.concatenate(starts).astype(np.uint64) * np.uint64(8)
    lanes, most, least = np.arange(len(units)), int(units.max()), int(units.min())
    first = [k for k, b in enumerate(blocks) if b[0] == 0]
    out = np.zeros((most * len(first), len(units)), np.int64)
    previous = np.zeros((max(b[0] for b in blocks) + 1, len(units)), np.int64)
    top, low = np.uint64(48), np.uint64(7)
    half = np.array([0, *(1 << k for k in range(15))], np.int64)
    under = np.array([(1 << k) - 1 for k in range(16)], np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        """57 bits or more from each bit position, in the upper bits."""
        return window[np.minimum(p >> np.uint64(3), np.uint64(len(window) - 1))].astype(np.uint64) << (p & low)

    def look(table, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = bits >> top
        used = table[1][at]
        if not used.all():
            raise ValueError("bad code")
        return table[0][at], used

    for u in range(most):
        live = slice(None) if u < least else lanes[units > u]
        for k, (part, d, a) in enumerate(blocks):
            p = pos[live]
            bits = peek(p)
            size, used = look(tables[d], bits)
            if (size > 15).any():
                raise ValueError("bad size")
            v = (bits << used >> np.uint64(1) >> (np.uint64(63) - size)).astype(np.int64)
            now = previous[part, live] + v - np.where(v < half[size], under[size], 0)
            previous[part, live] = now
            if part == 0:
                out[u * len(first) + first.index(k), live] = now
            used = used + size
            s, more = look(tables[16 | a], bits << used)  # 57 bits hold a DC code, its value and an AC code
            p = p + used + more + (s & np.uint64(15))
            if s.any():  # AC coefficients: skip them one by one
                inside = np.flatnonzero(s)
                at = p[inside]
                place = 1 + np.where(s[inside] & np.uint64(15), (s[inside] >> np.uint64(4)).astype(np.int64) + 1, 16)
                while len(going := place < 64) and going.any():
                    inside, at, place = inside[going], at[going], place[going]
                    s, more = look(tables[16 | a], peek(at))
                    at = at + more + (s & np.uint64(15))
                    p[inside] = at
                    place = place + np.where(s & np.uint64(15), (s >> np.uint64(4)).astype(np.int64) + 1, np.where(s == 0xF0, 16, 64))
            pos[live] = p
    out = out.T
    results = [[] for _ in files]
    for lane, f in enumerate(owner):
        results[f].append(out[lane, : units[lane] * len(first)])
    return [np.concatenate(r) if r else np.zeros(0, np.int64) for r in results]


def thumbnail(coefficients: np.ndarray, h: Header) -> np.ndarray:
    """The DC-only luminance image, one sample for each 8 x 8 block, as unsigned bytes."""
    part = {p[0]: p for p in h.parts}[h.scan[0][0]]
    across, down = h.units()
    w, v = (1, 1) if len(h.scan) == 1 else (part[1], part[2])
    grid = coefficients.reshape(down, across, v, w).transpose(0, 2, 1, 3).reshape(down * v, across * w)
    return np.clip(np.round(grid * h.dc_quant[part[3]] / 8 + 128), 0, 255).astype(np.uint8)


def thumbnails(files: list[bytes]) -> list[tuple[Header, np.ndarray]]:
    """Parse and decode many files; those with equal tables are decoded together."""
    heads = [parse(x) for x in files]
    groups: dict[tuple, list[int]] = {}
    for i, h in enumerate(heads):
        groups.setdefault(h.key(), []).append(i)
    out: list = [None] * len(files)
    for group in groups.values():
        for i, c in zip(group, decode([(files[i], heads[i]) for i in group]), strict=True):
            out[i] = (heads[i], thumbnail(c, heads[i]))
    return out


def grey_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each cell of an 8 x 8 reduction is above the mean of the cells."""
    h, w = image.shape
    rows = np.minimum(np.arange(9) * h // 8, h - 1)[:8] if h < 8 else np.arange(8) * h // 8
    cols = np.minimum(np.arange(9) * w // 8, w - 1)[:8] if w < 8 else np.arange(8) * w // 8
    sums = np.add.reduceat(np.add.reduceat(image.astype(np.int64), rows, axis=0), cols, axis=1)
    n_r, n_c = np.diff([*rows, h]).clip(1), np.diff([*cols, w]).clip(1)
    cells = sums / (n_r[:, None] * n_c[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def restore(h: Header, image: np.ndarray) -> bytes:
    """The payload that `store` put in."""
    return image.ravel()[: int(h.comment.removeprefix(b"payload="))].tobytes()
