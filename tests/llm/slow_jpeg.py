"""A baseline JPEG coder and decoder written bit by bit, apart from the library's."""

from __future__ import annotations

import struct


def bit_size(v):
    return len(bin(abs(v))) - 2 if v else 0


def table(symbols, length=8):
    """Codes of equal length for a list of at most 255 symbols: symbol -> bit string, and the DHT body."""
    codes = {s: format(k, f"0{length}b") for k, s in enumerate(symbols)}
    counts = [0] * 16
    counts[length - 1] = len(symbols)
    return codes, bytes(counts) + bytes(symbols)


DC, DC_BODY = table(list(range(12)), 5)
AC, AC_BODY = table([(r << 4) | s for r in range(16) for s in range(1, 11)] + [0x00, 0xF0], 9)


def value_bits(v):
    n = bit_size(v)
    return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""


def block_bits(block, before):
    """Bits of one block whose DC is coded against ``before``."""
    d = block[0] - before
    out, run = DC[bit_size(d)] + value_bits(d), 0
    last = max([k for k in range(1, 64) if block[k]], default=0)
    for k in range(1, last + 1):
        if not block[k]:
            run += 1
            continue
        while run > 15:
            out, run = out + AC[0xF0], run - 16
        out, run = out + AC[(run << 4) | bit_size(block[k])] + value_bits(block[k]), 0
    return out + (AC[0x00] if last < 63 else "")


def segment(marker, body):
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def scan_units(components, width, height, chosen):
    """The blocks of each coding unit of a scan over the chosen components, as (component, block)."""
    hmax, vmax = max(c["h"] for c in components), max(c["v"] for c in components)
    if len(chosen) == 1:
        c = components[chosen[0]]
        rows, columns = -(-(-(-height * c["v"] // vmax)) // 8), -(-(-(-width * c["h"] // hmax)) // 8)
        return [[(chosen[0], c["blocks"][y][x])] for y in range(rows) for x in range(columns)]
    out = []
    for my in range(-(-height // (8 * vmax))):
        for mx in range(-(-width // (8 * hmax))):
            out.append([(k, components[k]["blocks"][my * components[k]["v"] + y][mx * components[k]["h"] + x]) for k in chosen for y in range(components[k]["v"]) for x in range(components[k]["h"])])
    return out


def entropy_bytes(bits):
    bits += "1" * (-len(bits) % 8)
    data = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
    return data.replace(b"\xff", b"\xff\x00")


def encode(components, width, height, interval=0, scans=None):
    """components: [{h, v, blocks[row][column][64]}], quantiser 1 for the first, 2 for others."""
    scans = scans or [list(range(len(components)))]
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + b"\1" * 64) + segment(0xDB, b"\x11" + b"\0\2" * 64)
    out += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(components)) + b"".join(bytes([k + 1, c["h"] << 4 | c["v"], int(k > 0)]) for k, c in enumerate(components)))
    out += segment(0xC4, b"\x00" + DC_BODY + b"\x11" + AC_BODY)
    if interval:
        out += segment(0xDD, struct.pack(">H", interval))
    for chosen in scans:
        out += segment(0xDA, bytes([len(chosen)]) + b"".join(bytes([k + 1, 0x01]) for k in chosen) + b"\0\x3f\0")
        units = scan_units(components, width, height, chosen)
        step = interval or len(units)
        for n, at in enumerate(range(0, len(units), step)):
            before, bits = {}, ""
            for unit in units[at : at + step]:
                for k, block in unit:
                    bits += block_bits(block, before.get(k, 0))
                    before[k] = block[0]
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + entropy_bytes(bits)
    return out + b"\xff\xd9"


def decode_grey(data):
    """(width, height, blocks in scan order) of an image with one component."""
    at, tables, interval = 2, {}, 0
    while True:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for n in range(1, 17):
                for _ in range(body[n]):
                    codes[format(code, f"0{n}b")] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    total = -(-width // 8) * -(-height // 8)
    parts, part = [], bytearray()
    while data[at : at + 2] != b"\xff\xd9":
        if data[at] == 0xFF and 0xD0 <= data[at + 1] <= 0xD7:
            parts.append(bytes(part))
            part, at = bytearray(), at + 2
        else:
            part.append(data[at])
            at += 2 if data[at] == 0xFF else 1
    blocks = []
    for part in [*parts, bytes(part)]:
        bits, p, before = "".join(format(b, "08b") for b in part), 0, 0

        def symbol(codes):
            nonlocal p
            n = 1
            while bits[p : p + n] not in codes:
                n += 1
            p += n
            return codes[bits[p - n : p]]

        def number(n):
            nonlocal p
            p += n
            raw = int(bits[p - n : p] or "0", 2)
            return raw if not n or raw >> (n - 1) else raw - (1 << n) + 1

        for _ in range(min(interval or total, total - len(blocks))):
            block = [0] * 64
            before = block[0] = before + number(symbol(tables[0]))
            k = 1
            while k < 64:
                s = symbol(tables[16])
                if s == 0:
                    break
                k += s >> 4
                if s & 15:
                    block[k] = number(s & 15)
                k += 1
            blocks.append(block)
    return width, height, blocks
