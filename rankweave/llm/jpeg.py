"""Baseline JPEG in numpy: a lossless payload writer, a parser with Huffman decoding, DC thumbnails.

Writer: every 64 payload bytes are the quantised coefficients of one 8x8 luminance block, in scan order,
with quantiser 1 - JPEG stores those exactly. Byte b is the b-th of the values 0, 1, -1, 2, -2, ...
after the bytes have been ordered by how common they are in text, so common bytes get short codes. The
byte 0, which pads, is the value 0. A comment segment holds the payload's length; blocks that fill up
the last block row are zero. ``INTERVAL`` blocks form a restart interval, within which DC values are coded as
differences.

Reader: markers are parsed one by one (SOI, DQT, SOF0, DHT, DRI, COM, SOS, EOI; others are skipped by
their length). It takes any baseline image: any tables, restart intervals or none, one or more components
with any subsampling, in one scan or several; coefficients are kept of the first component (luminance).
Restart intervals of many images are decoded in lockstep: one numpy step reads the next Huffman symbol of
every interval; a scan without restart markers is one interval. An image that breaks the rules gives an
error message and no more; the others are read all the same.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.scratch import small_batches
from rankweave.llm.textcore import pieces

BLOCK = 64
#: Blocks per restart interval of the writer.
INTERVAL = 8
#: Blocks per block row; a frame is at most 65,535 samples wide and high.
ROW_BLOCKS = 16
MAX_SIDE = 65_535 // 8
#: Bytes in rough order of their frequency in European prose (fixed values); all others follow by value.
COMMON = b" etaonihsrdlucmfwygpb\xc3,.\nTAIEvSkNHRODLW\xa9\xa8!|xzjqCUMBPFGVYK"

_order = [0, *COMMON, *(b for b in range(1, 256) if b not in COMMON)]
_values = np.array([0, *(s * k for k in range(1, 128) for s in (1, -1)), 128], dtype=np.int16)
TO_VALUE = np.zeros(256, dtype=np.int16)
TO_VALUE[_order] = _values
FROM_VALUE = np.zeros(512, dtype=np.uint8)
FROM_VALUE[_values + 256] = _order


def _category(v: np.ndarray) -> np.ndarray:
    """Bits of |v|: the size class of a coefficient."""
    return CATEGORY[np.abs(v)]


CATEGORY = np.array([int(k).bit_length() for k in range(2048)], dtype=np.int64)

#: Code lengths of this writer's tables: DC size classes 0-9 of differences, and for AC (run, size) bytes. Nonzero
#: values directly after another (run 0) have the short codes.
_DC_LENGTHS = {**{s: 3 for s in range(2, 8)}, 8: 4, 9: 5, 1: 6, 0: 7}
_AC_LENGTHS = {0x01: 2, 0x02: 2, 0x03: 2, 0x04: 3, 0x05: 5, 0x06: 6, 0x07: 7, 0x08: 9, 0x00: 7} | {(r << 4) | s: 15 for r in range(1, 16) for s in range(1, 9)} | {0xF0: 14}


def canonical(lengths: dict[int, int]) -> tuple[bytes, bytes, dict[int, tuple[int, int]]]:
    """The 16 counts and the symbols of a DHT segment, and each symbol's (code, length)."""
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    counts, codes, code, last = [0] * 16, {}, 0, 0
    for s in ordered:
        n = lengths[s]
        code = (code << (n - last)) if last else 0
        codes[s], last = (code, n), n
        counts[n - 1] += 1
        code += 1
        if code > (1 << n) - 1 + (s != ordered[-1] and 0):
            raise ValueError("the code lengths leave no code free")
    return bytes(counts), bytes(ordered), codes


_DC_COUNTS, _DC_SYMBOLS, _DC_CODES = canonical(_DC_LENGTHS)
_AC_COUNTS, _AC_SYMBOLS, _AC_CODES = canonical(_AC_LENGTHS)


def _code_arrays(codes: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    code, length = np.zeros(256, np.uint64), np.zeros(256, np.int64)
    for s, (c, n) in codes.items():
        code[s], length[s] = c, n
    return code, length


_DC_CODE, _DC_LEN = _code_arrays(_DC_CODES)
_AC_CODE, _AC_LEN = _code_arrays(_AC_CODES)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _entropy_code(blocks: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stuffed bytes of each restart interval, one after another, and their bounds.

    blocks: coefficients, one row per block, first column DC; first: numbers of the blocks that begin an
    interval, where DC is predicted from 0.
    """
    n = len(blocks)
    flat = blocks.reshape(-1).astype(np.int64)
    here = np.flatnonzero(flat)
    here = here[here % BLOCK != 0]
    block, k = here // BLOCK, here % BLOCK
    fresh = np.ones(len(here), dtype=bool)
    fresh[1:] = block[1:] != block[:-1]
    prev = np.where(fresh, 0, np.concatenate(([0], k[:-1])))
    run = k - prev - 1
    v = flat[here]
    size = _category(v)
    symbol = ((run & 15) << 4) | size
    bits = np.where(v > 0, v, v + (np.int64(1) << size) - 1).astype(np.uint64)
    zrl = run >> 4  # runs of 16 zeros before the coefficient
    # items in order: a block's DC, each coefficient with the ZRL codes before it, EOB unless it ended full
    dc = np.diff(flat[::BLOCK], prepend=0)
    dc[first] = flat[::BLOCK][first]
    dsize = _category(dc)
    dbits = np.where(dc > 0, dc, dc + (np.int64(1) << dsize) - 1).astype(np.uint64)
    per = np.bincount(block, minlength=n)
    lastk = np.zeros(n, dtype=np.int64)
    ended = np.cumsum(per) - 1
    lastk[per > 0] = k[ended[per > 0]]
    eob = lastk < BLOCK - 1
    zrl_until = np.concatenate(([0], np.cumsum(zrl)))
    until = np.concatenate(([0], np.cumsum(per)))
    dc_at = until[:-1] + np.arange(n) + zrl_until[until[:-1]] + np.concatenate(([0], np.cumsum(eob)[:-1]))
    count = per + 1 + zrl_until[until[1:]] - zrl_until[until[:-1]] + eob
    code, length = np.empty(count.sum(), dtype=np.uint64), np.empty(count.sum(), dtype=np.int64)
    code[:], length[:] = _AC_CODES[0xF0]  # what is not overwritten below is ZRL
    code[dc_at], length[dc_at] = (_DC_CODE[dsize] << dsize.astype(np.uint64)) | dbits, _DC_LEN[dsize] + dsize
    item = np.arange(len(here)) + (dc_at - until[:-1] - zrl_until[until[:-1]] + 1)[block] + zrl_until[1:]
    code[item], length[item] = (_AC_CODE[symbol] << size.astype(np.uint64)) | bits, _AC_LEN[symbol] + size
    e = (dc_at + count - 1)[eob]
    code[e], length[e] = _AC_CODES[0x00]
    ends = np.cumsum(length)
    items = np.diff(np.append(dc_at[first], len(length)))
    interval_bits = np.add.reduceat(length, dc_at[first])
    interval_bytes = (interval_bits + 7) >> 3
    byte_at = np.concatenate(([0], np.cumsum(interval_bytes)))
    bit_at = ends - length + np.repeat(byte_at[:-1] * 8 - np.concatenate(([0], np.cumsum(interval_bits)[:-1])), items)
    words = np.zeros((byte_at[-1] + 7) // 8 + 2, dtype=np.uint64)
    # place each item (at most 32 bits) into one or two 64-bit words; items do not overlap, so sums are ors
    w, shift = bit_at >> 6, 64 - (bit_at & 63) - length
    fits = shift >= 0
    _or_into(words, w, np.where(fits, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64)))
    over = np.flatnonzero(~fits)
    _or_into(words, w[over] + 1, code[over] << (64 + shift[over]).astype(np.uint64))
    data = words.astype(">u8").view(np.uint8)[: byte_at[-1]].copy()
    pad = interval_bytes * 8 - interval_bits
    data[byte_at[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    ff = np.flatnonzero(data == 0xFF)
    if len(ff):
        grown = np.zeros(len(data) + len(ff), dtype=np.uint8)
        extra = np.zeros(len(data) + 1, dtype=np.int64)
        extra[ff + 1] = 1
        extra = np.cumsum(extra)
        grown[np.arange(len(data)) + extra[:-1]] = data
        data, byte_at = grown, byte_at + extra[byte_at]
    return data, byte_at


def _or_into(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    if len(at):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        words[at[first]] |= np.bitwise_or.reduceat(value, first)


def write_images(payloads: list[bytes]) -> list[bytes]:
    """One JPEG per payload; payload lengths are multiples of 64, at least 64."""
    shapes, rows = [], []
    for p in payloads:
        n = len(p) // BLOCK
        wide = ROW_BLOCKS
        while -(-n // wide) > MAX_SIDE and wide < MAX_SIDE:
            wide = min(MAX_SIDE, wide * 8)
        wide = min(n, wide)
        high = -(-n // wide)
        if high > MAX_SIDE:
            raise ValueError("the payload is too long for one baseline image")
        shapes.append((wide, high))
        part = np.zeros((wide * high, BLOCK), dtype=np.int16)
        part[:n] = TO_VALUE[np.frombuffer(p, dtype=np.uint8)].reshape(n, BLOCK)
        rows.append(part)
    sizes = np.array([len(part) for part in rows])
    intervals = -(-sizes // INTERVAL)
    begin = np.concatenate(([0], np.cumsum(intervals)))
    first = np.repeat(np.cumsum(sizes) - sizes, intervals) + INTERVAL * (np.arange(begin[-1]) - np.repeat(begin[:-1], intervals))
    data, at = _entropy_code(np.concatenate(rows), first)
    tables = _segment(0xDB, b"\0" + b"\1" * 64)
    huffman = _segment(0xC4, b"\x00" + _DC_COUNTS + _DC_SYMBOLS) + _segment(0xC4, b"\x10" + _AC_COUNTS + _AC_SYMBOLS)
    out = []
    for p, (wide, high), i, n in zip(payloads, shapes, begin, intervals, strict=False):
        # lay the intervals out with their two marker bytes between them
        lo, hi = at[i], at[i + n]
        bounds = at[i : i + n + 1] - lo
        scan = np.empty(hi - lo + 2 * (n - 1), dtype=np.uint8)
        mark = bounds[1:-1] + 2 * np.arange(n - 1)
        body = np.ones(len(scan), dtype=bool)
        body[mark] = body[mark + 1] = False
        scan[body] = data[lo:hi]
        scan[mark] = 0xFF
        scan[mark + 1] = 0xD0 + np.arange(n - 1) % 8
        frame = _segment(0xC0, struct.pack(">BHHBBBB", 8, high * 8, wide * 8, 1, 1, 0x11, 0))
        comment = _segment(0xFE, b"payload-bytes=%d" % len(p))
        out.append(b"\xff\xd8" + comment + tables + frame + huffman + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, b"\1\1\0\0\x3f\0") + scan.tobytes() + b"\xff\xd9")
    return out


@dataclass
class Component:
    """A component of a frame: sampling factors, and numbers of its quantiser and Huffman tables."""

    h: int
    v: int
    quant: int
    dc: int = 0
    ac: int = 0


@dataclass
class Parsed:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    frame: dict[int, Component] = field(default_factory=dict)
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    interval: int = 0
    payload_bytes: int | None = None
    scan: tuple[int, int] = (0, 0)
    order: tuple[int, ...] = ()  # components of the scan that holds the first one

    @property
    def luminance(self) -> Component:
        return next(iter(self.frame.values()))

    @property
    def most(self) -> tuple[int, int]:
        """The largest sampling factors across and down."""
        return max(c.h for c in self.frame.values()), max(c.v for c in self.frame.values())

    @property
    def grid(self) -> tuple[int, int]:
        """Luminance blocks down and across that hold samples of the image."""
        (h, v), c = self.most, self.luminance
        return -(-self.height * c.v // (8 * v)), -(-self.width * c.h // (8 * h))

    @property
    def units(self) -> tuple[int, int]:
        """Coding units of the scan down and across: single blocks if the scan has one component only."""
        if len(self.order) == 1:
            return self.grid
        h, v = self.most
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @property
    def pattern(self) -> tuple[int, ...]:
        """Components of the blocks of a unit, in order."""
        if len(self.order) == 1:
            return self.order
        return tuple(c for c in self.order for _ in range(self.frame[c].h * self.frame[c].v))


def parse(data: bytes) -> Parsed:
    """Read the markers of a baseline image; raises ValueError if they make no sense."""
    try:
        return _parse(data)
    except (IndexError, struct.error, KeyError, StopIteration):
        raise ValueError("a segment ends early or names what is not there") from None


def _scan_end(data: bytes, at: int) -> int:
    """Where the entropy-coded bytes that begin at ``at`` end: at a marker other than a restart."""
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return len(data)
        if data[at + 1] == 0xFF:
            at += 1
        elif data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7:
            at += 2
        else:
            return at


def _parse(data: bytes) -> Parsed:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no SOI marker")
    out, at = Parsed(), 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                table = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                if len(table) != 64:
                    raise ValueError("a quantiser table ends early")
                out.quant[body[0] & 15], body = table, body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                if len(body) < 17 + n:
                    raise ValueError("a Huffman table ends early")
                out.huffman[body[0]], body = (body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xC0:
            depth, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            out.frame = {body[6 + 3 * k]: Component(body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if depth != 8 or not n or not out.height or not out.width or any(not (0 < c.h < 5 and 0 < c.v < 5) for c in out.frame.values()):
                raise ValueError("not a frame of 8-bit samples")
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif marker == 0xDD:
            out.interval = struct.unpack(">H", body)[0]
        elif marker == 0xFE and body.startswith(b"payload-bytes="):
            out.payload_bytes = int(body[14:])
        elif marker == 0xDA:
            order = tuple(body[1 + 2 * k] for k in range(body[0]))
            for k, c in enumerate(order):
                out.frame[c].dc, out.frame[c].ac = body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15
            end = _scan_end(data, at + 2 + size)
            if next(iter(out.frame)) in order:
                out.order, out.scan = order, (at + 2 + size, end)
                _ = out.quant[out.luminance.quant], [(out.huffman[out.frame[c].dc], out.huffman[16 + out.frame[c].ac]) for c in order]
                return out
            at = end
            continue
        at += 2 + size
    raise ValueError("no scan")


_lookups: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray]] = {}


def _lookup(table: tuple[bytes, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every 16-bit prefix: the symbol it starts with and its code length (0: no code)."""
    if table not in _lookups:
        symbol, length = np.zeros(1 << 16, dtype=np.int64), np.zeros(1 << 16, dtype=np.int64)
        code, k = 0, 0
        for n, count in enumerate(table[0], start=1):
            for s in table[1][k : k + count]:
                lo = code << (16 - n)
                symbol[lo : lo + (1 << (16 - n))], length[lo : lo + (1 << (16 - n))] = s, n
                code += 1
            k += count
            code <<= 1
        _lookups[table] = (symbol, length)
    return _lookups[table]


#: What may be wrong with an entropy-coded interval.
FAULTS = ("", "a bit pattern that is no Huffman code", "a coefficient beyond its block", "a scan ends early")


def _decode(data: np.ndarray, at: np.ndarray, end: np.ndarray, blocks: np.ndarray, pattern: tuple[int, ...], tables: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of all blocks of (unstuffed) intervals ``data[at:end]`` in lockstep, and a fault of each.

    blocks: how many each interval has; pattern: for each block of a unit the number of its component;
    tables: for each component its DC and its AC table.
    """
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    out = np.zeros((int(blocks.sum()), BLOCK), dtype=np.int16)
    flat, fault = out.reshape(-1), np.zeros(len(at), dtype=np.int8)
    looked = [_lookup(t) for t in tables]
    symbols, lengths = (np.concatenate([x[k] for x in looked]) for k in (0, 1))
    who = np.array(pattern)
    rows = np.cumsum(blocks) - blocks
    live = np.flatnonzero(blocks > 0)
    bit, stop, row, left = at[live] * 8, end[live] * 8, rows[live] * BLOCK, blocks[live]
    k, turn = np.zeros(len(live), dtype=np.int64), np.zeros(len(live), dtype=np.int64)
    last = np.zeros((len(live), max(pattern) + 1), dtype=np.int64)
    while len(live):
        window = eight[np.minimum(bit >> 3, len(data))].astype(np.uint64) << (bit & 7).astype(np.uint64)
        mine = who[turn]
        begins = k == 0
        look = ((2 * mine + ~begins) << 16) + (window >> np.uint64(48)).astype(np.int64)
        symbol, n = symbols[look], lengths[look]
        size = symbol & 15
        extra = ((window << n.astype(np.uint64)) >> np.uint64(32)).astype(np.int64) >> (32 - size)
        value = np.where(extra >= (np.int64(1) << size) >> 1, extra, extra - (np.int64(1) << size) + 1)
        bit = bit + n + size
        dc = np.flatnonzero(begins)
        if len(dc):
            last[dc, mine[dc]] += value[dc]
            value[dc] = last[dc, mine[dc]]
        k = k + np.where(begins, 0, symbol >> 4)
        bad = np.where(n == 0, 1, np.where((k >= BLOCK) & (size > 0), 2, np.where(bit > stop, 3, 0)))
        put = np.flatnonzero((begins | (size > 0)) & (bad == 0))
        flat[row[put] + k[put]] = value[put]
        k = np.where(~begins & (symbol == 0), BLOCK, k + 1)
        over = np.flatnonzero(k >= BLOCK)
        if len(over):
            k[over] = 0
            row[over] += BLOCK
            left[over] -= 1
            turn[over] = (turn[over] + 1) % len(who)
        ended = (left == 0) | (bad > 0)
        if ended.any():
            fault[live[ended]] = bad[ended]
            stays = ~ended
            live, bit, stop, row, left, k, turn, last = (x[stays] for x in (live, bit, stop, row, left, k, turn, last))
    return out, fault


def _luminance(p: Parsed, blocks: np.ndarray) -> np.ndarray:
    """The blocks of the first component in order of rows, without those that only fill up units."""
    down, across = p.units
    (rows, columns), c = p.grid, p.luminance
    if len(p.order) == 1:
        return blocks
    own = np.flatnonzero(np.array(p.pattern) == next(iter(p.frame)))
    mine = blocks.reshape(down, across, len(p.pattern), BLOCK)[:, :, own].reshape(down, across, c.v, c.h, BLOCK)
    return mine.transpose(0, 2, 1, 3, 4).reshape(down * c.v, across * c.h, BLOCK)[:rows, :columns].reshape(-1, BLOCK)


def read_images(images: list[bytes]) -> list[tuple[Parsed, np.ndarray] | str]:
    """(markers, luminance coefficients by block) of each image, or what is wrong with it; images with equal
    tables and units are decoded together."""
    out: list = ["unread"] * len(images)
    groups: dict[tuple, list[int]] = {}
    parsed: dict[int, Parsed] = {}
    for i, x in enumerate(images):
        try:
            p = parsed[i] = parse(x)
            names = {c: j for j, c in enumerate(p.order)}
            tables = tuple(t for c in p.order for t in (p.huffman[p.frame[c].dc], p.huffman[16 + p.frame[c].ac]))
            groups.setdefault((tuple(names[c] for c in p.pattern), tables), []).append(i)
        except ValueError as e:
            out[i] = str(e)
    for (pattern, tables), members in groups.items():
        scans = [np.frombuffer(images[i], dtype=np.uint8)[slice(*parsed[i].scan)] for i in members]
        data = np.concatenate([*scans, np.zeros(1, np.uint8)])
        last = np.cumsum([len(x) for x in scans])
        # after 0xFF: zero is stuffing, D0-D7 ends an interval; a scan's end ends one too
        ff = np.flatnonzero(data[:-1] == 0xFF)
        ff = ff[~np.isin(ff + 1, last)]
        after = data[ff + 1]
        rst = ff[(after >= 0xD0) & (after <= 0xD7)]
        drop = np.zeros(len(data), dtype=bool)
        drop[ff[after == 0] + 1] = True
        drop[rst] = drop[rst + 1] = True
        begin = np.sort(np.concatenate(([0], last[:-1], rst + 2)))
        end = np.sort(np.concatenate((rst, last)))
        gone = np.concatenate(([0], np.cumsum(drop)))
        share = np.arange(len(members) + 1) + np.concatenate(([0], np.searchsorted(rst, last)))  # intervals before each image
        sizes = np.zeros(len(begin), dtype=np.int64)
        sound = []
        for j, i in enumerate(members):
            p, n = parsed[i], share[j + 1] - share[j]
            units = p.units[0] * p.units[1]
            per = p.interval or units
            # a block takes two bits at least: a frame that its scan cannot fill is no reason to take memory
            if n != -(-units // per) or units * len(pattern) > 4 * (parsed[i].scan[1] - parsed[i].scan[0]):
                out[i] = "the scan does not fit the frame"
                continue
            sizes[share[j] : share[j + 1]] = len(pattern) * np.minimum(per, units - per * np.arange(n))
            sound.append(j)
        blocks, fault = _decode(data[~drop], begin - gone[begin], end - gone[end], sizes, pattern, list(tables))
        at = np.concatenate(([0], np.cumsum(sizes)))
        for j in sound:
            wrong = fault[share[j] : share[j + 1]].max()
            p = parsed[members[j]]
            out[members[j]] = FAULTS[wrong] if wrong else (p, _luminance(p, blocks[at[share[j]] : at[share[j + 1]]]))
    return out


def payload(p: Parsed, blocks: np.ndarray) -> bytes | None:
    """The payload that write_images stored; none if another writer made the image."""
    if p.payload_bytes is None:
        return None
    return FROM_VALUE[blocks.reshape(-1) + 256][: p.payload_bytes].tobytes()


def thumbnail(p: Parsed, blocks: np.ndarray) -> np.ndarray:
    """One luminance sample per block, from its DC coefficient only."""
    dc = blocks[:, 0].astype(np.int64) * int(p.quant[p.luminance.quant][0])
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8).reshape(p.grid)


def thumbnail_hash(image: np.ndarray) -> str:
    """A 64-bit average hash: the thumbnail in 8x8 cells, each against the mean of all (hex)."""
    h, w = image.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = image.astype(np.int64).cumsum(0).cumsum(1)
    r1, c1 = np.maximum((np.arange(8) + 1) * h // 8, rows + 1), np.maximum((np.arange(8) + 1) * w // 8, cols + 1)
    cells = total[np.ix_(r1, c1)] - total[np.ix_(rows, c1)] - total[np.ix_(r1, cols)] + total[np.ix_(rows, cols)]
    area = np.outer(r1 - rows, c1 - cols)
    bits = cells * (h * w) > total[-1, -1] * area
    return np.packbits(bits.reshape(-1)).tobytes().hex()


def pad(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of 64."""
    return data + b"\0" * (max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def add_media(docs: DataFrame, *, text_col: str = "text", out_col: str = "media") -> DataFrame:
    """docs with a binary column holding each whole text as a JPEG.

    Null and empty texts are stored as one block of padding, very long ones whole; equal texts give equal
    images; rows with null or repeated ids keep their rows; an empty table stays empty. A column named
    ``out_col`` is replaced, others pass through.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(out_col)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(at)):
                media = write_images([pad(piece.text(k)) for k in range(len(piece))])
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(media, pa.binary())], names=[*names, out_col])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out_col}` binary")


MEDIA_COLUMNS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumbnail_hash string, feature string, error string"


def media_values(images: list[bytes]) -> list[tuple]:
    """The MEDIA_COLUMNS of each image; an empty one is none."""
    out: list[tuple] = [(None,) * 10] * len(images)
    some = [k for k, x in enumerate(images) if x]
    for k, got in zip(some, read_images([images[k] for k in some]), strict=True):
        size, sha = len(images[k]), hashlib.sha256(images[k]).hexdigest()
        if isinstance(got, str):
            out[k] = (None, None, None, size, sha, None, None, None, None, got)
            continue
        p, blocks = got
        data, thumb = payload(p, blocks), thumbnail_hash(thumbnail(p, blocks))
        stored = (None, None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]))
        out[k] = (*stored, size, sha, p.width, p.height, thumb, f"jpeg {p.width}x{p.height} {thumb}", None)
    return out


def read_media(rows: DataFrame, *, keep: tuple[str, ...] = (), media_col: str = "media") -> DataFrame:
    """The kept columns, and what the stored JPEGs hold: payload digests, dimensions, thumbnail hashes.

    * a null or empty image has null columns;
    * an image that is no baseline JPEG, or a broken one, has its size and digest, null columns for the rest
      and the reason in ``error``; other rows are not affected;
    * a baseline image of another writer has no payload columns;
    * rows are handled one by one, whatever their size: repeated ids or images keep their rows, equal images
      get equal values; an empty table gives an empty result; columns that are not kept are ignored.
    """
    small_batches(rows.sparkSession)
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in MEDIA_COLUMNS.split(", ")]
        types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split(" ")[1]] for c in MEDIA_COLUMNS.split(", ")]
        for batch in batches:
            for piece in pieces(batch.column(len(keep))):
                got = media_values([piece.text(k) for k in range(len(piece))])
                part = batch.slice(piece.first, len(piece))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True))], names=[*keep, *names])

    return rows.select(*keep, F.col(media_col)).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in keep) + MEDIA_COLUMNS)
