"""Media columns: progressive JPEG with numpy.

``encode`` writes quantised coefficients as a progressive file (4:2:0): a DC scan, spectral
selection of the AC coefficients, and a second bit of successive approximation for all.
``coefficients`` accumulates the scans of a file into coefficient arrays, and ``pixels``
inverse-transforms them, upsamples the chroma and returns a full-resolution RGB tensor.

A payload is kept without loss in the format's own unit: byte k of a block of 64 is its k-th
coefficient in zigzag order of the luma (DC: the byte; AC: 256 + the byte, so never 0).  A null or empty
text is one padded unit.  Every row is independent; repeated rows get equal values.

Files of other writers are read too: Huffman tables of each component's own, restart intervals, any
whole sampling ratios.  A null file, one that isn't a progressive JPEG, is cut off or broken, or has more
pixels than ``most`` (a bound of ``tensors`` on a row's memory) has null values and harms no other row.
Input columns named like the added ones give way to them, others pass through.
"""

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, table, without

UNIT = 576
MARKER, RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff[\xd0-\xd7]")


def _zigzag() -> np.ndarray:
    """Natural position of each zigzag index."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


def _inverse() -> np.ndarray:
    """64 x 64: zigzag coefficients to samples, the two-dimensional inverse DCT as one matrix."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    a = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    a[0] /= np.sqrt(2)
    return np.kron(a, a)[ZIGZAG].astype(np.float32)


ZIGZAG = _zigzag()
INVERSE = _inverse()
#: (components, Ss, Se, Ah, Al) of each scan, for pictures
SCRIPT = [((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
          ((0, 1, 2), 0, 0, 1, 0), ((0,), 1, 63, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0)]
#: The same for payloads, which leave the chroma flat: scans that aren't there add nothing.
PAYLOAD_SCRIPT = [((0, 1, 2), 0, 0, 0, 0), ((0,), 1, 63, 0, 1), ((0,), 1, 63, 1, 0)]


def bit_size(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, lengths: np.ndarray) -> bytes:
    """Bit strings (value, length up to 32) one after another, filled with ones, FF stuffed."""
    if not len(values):
        return b""
    values, lengths = values.astype(np.uint64), lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    at = ends - lengths
    word, shift = at >> 6, 64 - (at & 63) - lengths
    out = np.zeros((int(ends[-1]) >> 6) + 2, np.uint64)
    over = shift < 0
    high = np.where(over, values >> np.where(over, -shift, 0).astype(np.uint64), values << np.where(over, 0, shift).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat(high, first)
    if over.any():
        out[word[over] + 1] |= values[over] << (64 + shift[over]).astype(np.uint64)
    data = np.frombuffer(out.astype(">u8").tobytes(), np.uint8)[: (int(ends[-1]) + 7) >> 3].copy()
    if ends[-1] & 7:
        data[-1] |= (1 << (8 - (int(ends[-1]) & 7))) - 1
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def pack_bits(bits: np.ndarray) -> bytes:
    """Single bits, filled with ones, FF stuffed."""
    data = np.packbits(bits)
    if len(bits) & 7:
        data[-1] |= (1 << (8 - (len(bits) & 7))) - 1
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def bits_of(value: int, n: int) -> list[int]:
    return [value >> i & 1 for i in range(n - 1, -1, -1)]


def table_for(symbols: np.ndarray):
    """A Huffman table of equal code lengths for the symbols that occur; -> (counts, symbols, code by symbol, length)."""
    used = np.flatnonzero(np.bincount(symbols, minlength=1))
    n = max(1, int(len(used)).bit_length())  # the code of all ones stays free
    counts = [0] * 16
    counts[n - 1] = len(used)
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(len(used), dtype=np.uint64)
    return bytes(counts), used.astype(np.uint8).tobytes(), code, n


def coded(symbols, extra, sizes):
    counts, used, code, n = table_for(symbols)
    return counts + used, pack((code[symbols] << sizes.astype(np.uint64)) | extra.astype(np.uint64), n + sizes)


def restarted(parts: list[bytes]) -> bytes:
    """Entropy-coded intervals with the restart markers between them."""
    return b"".join(p + (bytes([0xFF, 0xD0 + i % 8]) if i + 1 < len(parts) else b"") for i, p in enumerate(parts))


def differences(dc: np.ndarray, luma: int = 4) -> np.ndarray:
    """DC values by MCU (luma blocks, cb, cr) less the one before of the same component."""
    diff = np.diff(dc, axis=0, prepend=0)
    diff[:, :luma] = np.diff(dc[:, :luma].ravel(), prepend=0).reshape(-1, luma)
    return diff


def first_dc(dc: np.ndarray, apart: bool, restart: int):
    """First pass over DC values by MCU: bytes of the tables (one, or luma's and chroma's) and entropy-coded bytes."""
    diffs = [differences(dc[i : i + restart]) for i in range(0, len(dc), restart)] if restart else [differences(dc)]
    sizes = [bit_size(d) for d in diffs]
    every = np.concatenate(sizes)
    made = [table_for(every[:, :4].ravel()), table_for(every[:, 4:].ravel())] if apart else [table_for(every.ravel())]
    turn = np.array([0] * 4 + [len(made) - 1] * 2)
    code, n = np.stack([m[2] for m in made]), np.array([m[3] for m in made])
    parts = [pack((code[turn, s] << s.astype(np.uint64) | signed_bits(d, s).astype(np.uint64)).ravel(), (n[turn] + s).ravel()) for d, s in zip(diffs, sizes)]
    return [m[0] + m[1] for m in made], restarted(parts)


def signed_bits(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def first_ac(z: np.ndarray, ss: int, se: int, al: int, restart: int = 0):
    """First pass over an AC band: table bytes and entropy-coded bytes."""
    band = z[:, ss : se + 1]
    if restart:
        parts = [ac_symbols(band[i : i + restart], al) for i in range(0, len(band), restart)]
        counts, used, code, n = table_for(np.concatenate([p[0] for p in parts]))
        return counts + used, restarted([pack((code[s] << w.astype(np.uint64)) | b.astype(np.uint64), n + w) for s, b, w in parts])
    low = int(band.min()) >> al
    if low > 0 and (n := (int(band.max()) >> al).bit_length()) == low.bit_length() <= 15:
        # Dense band of one size: one symbol, so a zero bit and then the value's own bits.
        grid = np.zeros((band.size, n + 1), np.uint8)
        grid[:, 1:] = np.unpackbits((band.ravel() >> al).astype(">u2").view(np.uint8)).reshape(-1, 16)[:, 16 - n :]
        return bytes([1] + [0] * 15 + [n]), pack_bits(grid.ravel())
    return coded(*ac_symbols(band, al))


def ac_symbols(band: np.ndarray, al: int):
    """Symbols, their bits and the number of these, of blocks of an AC band in their first pass."""
    size = band.shape[1]
    band = np.sign(band) * (np.abs(band) >> al)
    block, k = np.nonzero(band)
    v = band[block, k]
    before = np.r_[-1, k[:-1]]
    before[np.r_[True, block[1:] != block[:-1]][: len(k)]] = -1
    run, room = k - before - 1, bit_size(v)
    last = np.full(len(band), -1)
    last[block] = k  # the last one stays
    ends = np.flatnonzero(last < size - 1)
    # In order of (block, place): long runs (15, 0) before their coefficient, an end of block after the last.
    long = run // 16
    places = np.concatenate([np.repeat(block * 256 + 2 * k, long), block * 256 + 2 * k + 1, ends * 256 + 255])
    sym = np.concatenate([np.full(long.sum(), 0xF0), (run % 16) << 4 | room, np.zeros(len(ends), np.int64)])
    zeros = np.zeros(long.sum(), np.int64)
    bits = np.concatenate([zeros, signed_bits(v, room), np.zeros(len(ends), np.int64)])
    width = np.concatenate([zeros, room, np.zeros(len(ends), np.int64)])
    order = np.argsort(places, kind="stable") if len(ends) or len(zeros) else slice(None)
    return sym[order], bits[order], width[order]


def refine_ac(z: np.ndarray, ss: int, se: int, al: int, restart: int = 0):
    """Later pass over an AC band: table bytes and entropy-coded bytes."""
    band = np.abs(z[:, ss : se + 1]) >> al
    if not restart and (band != 1).all():
        # No coefficient appears anew: runs of ended blocks, each followed by their correction bits.
        parts = [band[a : a + 32767] for a in range(0, len(band), 32767)]
        exps = [len(p).bit_length() - 1 for p in parts]
        counts, used, code, w = table_for(np.array(exps, dtype=np.int64) << 4)
        bits = []
        for p, e in zip(parts, exps):
            bits += [np.array(bits_of(int(code[e << 4]) << e | len(p) - (1 << e), w + e), np.uint8), (p[p > 1] & 1).astype(np.uint8)]
        return counts + used, pack_bits(np.concatenate(bits))
    step = restart or len(band)
    parts = [refined(band[i : i + step], z[i : i + step, ss : se + 1]) for i in range(0, len(band), step)]
    counts, used, code, w = table_for(np.array([s for items in parts for s, _ in items], dtype=np.int64))
    out = []
    for items in parts:
        values = [x for s, b in items for x in (int(code[s]), *b)]
        lengths = [x for s, b in items for x in (w, *[1] * len(b))]
        out.append(pack(np.array(values, np.uint64), np.array(lengths)))
    return counts + used, restarted(out)


def refined(band: np.ndarray, source: np.ndarray) -> list[tuple[int, list[int]]]:
    """Symbols of blocks of an AC band in a later pass, each with the bits behind it."""
    items = []
    for row, src in zip(band, source):
        run, held, last = 0, [], np.flatnonzero(row == 1)
        last = last[-1] if len(last) else -1
        for k, v in enumerate(row):
            if v == 0:
                run += 1
                continue
            while run > 15 and k <= last:
                items.append((0xF0, held))
                run, held = run - 16, []
            if v > 1:
                held.append(int(v) & 1)
            else:
                items.append((run << 4 | 1, [int(src[k] > 0), *held]))
                run, held = 0, []
        if run or held:
            items.append((0, held))
    return items


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def order_420(mcus_wide: int, mcus_high: int) -> np.ndarray:
    """For luma blocks in MCU order: their raster numbers."""
    y, x = np.divmod(np.arange(mcus_wide * mcus_high), mcus_wide)
    return (((2 * y)[:, None] + [0, 0, 1, 1]) * 2 * mcus_wide + (2 * x)[:, None] + [0, 1, 0, 1]).ravel()


def encode(luma: np.ndarray, cb: np.ndarray, cr: np.ndarray, wide: int, high: int, script=SCRIPT, apart: bool = False, restart: int = 0) -> bytes:
    """Zigzag coefficient blocks (luma in raster order, 2 x 2 for each chroma block) -> progressive file.

    ``apart`` gives the chroma tables of its own, ``restart`` is the restart interval in MCUs (0: none).
    """
    planes, mcu = [luma, cb, cr], order_420(wide, high)
    out = [b"\xff\xd8", segment(0xDB, b"\x00" + b"\x01" * 64)]
    out.append(segment(0xC2, struct.pack(">BHHB", 8, 16 * high, 16 * wide, 3) + b"\x01\x22\x00\x02\x11\x00\x03\x11\x00"))
    if restart:
        out.append(segment(0xDD, struct.pack(">H", restart)))
    for comps, ss, se, ah, al in script:
        if ss == 0:
            dc = np.empty((wide * high, 6), np.int64)
            dc[:, :4], dc[:, 4], dc[:, 5] = luma[mcu, 0].reshape(-1, 4) >> al, cb[:, 0] >> al, cr[:, 0] >> al
            if ah:
                step = restart or len(dc)
                body = restarted([pack_bits((dc[i : i + step] & 1).ravel().astype(np.uint8)) for i in range(0, len(dc), step)])
            else:
                heads, body = first_dc(dc, apart, restart)
                out.append(segment(0xC4, b"".join(bytes([i]) + h for i, h in enumerate(heads))))
        else:
            head, body = (refine_ac if ah else first_ac)(planes[comps[0]], ss, se, al, restart)
            out.append(segment(0xC4, bytes([0x10 + (apart and comps[0] > 0)]) + head))
        out.append(segment(0xDA, bytes([len(comps)]) + b"".join(bytes([c + 1, 0x11 if apart and c else 0]) for c in comps) + bytes([ss, se, ah << 4 | al])) + body)
    return b"".join(out) + b"\xff\xd9"


class Bits:
    """Entropy-coded bytes; code words are looked up at every bit at once."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.n = 8 * len(self.data)

    def all(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.data, np.uint8))

    def windows(self) -> np.ndarray:
        """The 32 bits from every bit position on."""
        d = np.frombuffer(self.data + b"\xff" * 8, np.uint8).astype(np.uint64)
        n = len(self.data)
        five = sum(d[i : n + i] << np.uint64(32 - 8 * i) for i in range(5))
        return ((five[:, None] >> (8 - np.arange(8)).astype(np.uint64)) & np.uint64(0xFFFFFFFF)).ravel()


def read_table(body: bytes):
    counts = list(body[:16])
    symbols, out, code, at = body[16 : 16 + sum(counts)], [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[at]))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def lookup(codes, windows: np.ndarray):
    """Symbol and code length at every bit position (length 0 where no code word starts)."""
    sym, length = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    for code, n, s in codes:
        hit = (windows >> np.uint64(32 - n)) == code
        sym[hit], length[hit] = s, n
    return sym, length


def extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def decode_dc(bits: Bits, turns: list, count: int) -> np.ndarray:
    """``count`` differences; the tables in ``turns`` take turns."""
    w = bits.windows()
    first = [next(j for j, u in enumerate(turns) if u is t) for t in turns]
    kinds = sorted(set(first))
    sym, length = (np.stack(x) for x in zip(*(lookup(turns[j], w) for j in kinds)))
    follow, at, p = (np.arange(len(w)) + length + sym).tolist(), [], 0
    if len(kinds) == 1:
        follow, turn = follow[0], np.zeros(count, np.int64)
        for _ in range(count):
            at.append(p)
            p = follow[p]
    else:
        turn = np.resize([kinds.index(j) for j in first], count)
        for t in turn.tolist():
            at.append(p)
            p = follow[t][p]
    at = np.array(at, np.int64)
    n, length = sym[turn, at], length[turn, at]
    if (length == 0).any() or p > len(w):
        raise ValueError("no code word")
    # Code word and value together stay within 32 bits: 16 + 11.
    value = (w[at] << length.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> (32 - n).astype(np.uint64)
    return extend(np.where(n > 0, value.astype(np.int64), 0), n)


def decode_ac_first(bits: Bits, codes, z: np.ndarray, rows: np.ndarray, ss: int, se: int, al: int) -> None:
    if len(codes) == 1 and codes[0][2] >> 4 == 0 and 0 < codes[0][2] <= 15:
        # One symbol, no run: every coefficient takes the same number of bits.
        c, s, n = codes[0][1], codes[0][2], len(rows) * (se - ss + 1)
        grid = bits.all()[: n * (c + s)].reshape(n, c + s)
        if s <= 8:
            v = np.packbits(grid[:, c:], axis=1).reshape(n).astype(np.int16) >> (8 - s)
        else:
            wide = np.zeros((n, 16), np.uint8)
            wide[:, 16 - s :] = grid[:, c:]
            v = np.packbits(wide, axis=1).view(">u2").reshape(n).astype(np.int16)
        if not grid[:, c].all():  # the first bit of a value tells its sign
            v = np.where(grid[:, c] > 0, v, v - (1 << s) + 1)
        v <<= al
        where = slice(0, len(z)) if len(rows) == len(z) else rows
        z[where, ss : se + 1] = v.reshape(len(rows), -1)
        return
    w = bits.windows()
    sym, length = lookup(codes, w)
    extra = np.where((sym & 15) > 0, sym & 15, np.where(sym < 0xF0, sym >> 4, 0))
    value = ((w << length.astype(np.uint64) & np.uint64(0xFFFFFFFF)) >> (32 - extra).astype(np.uint64)).astype(np.int64)
    signed, there = extend(value, extra).tolist(), (length > 0).tolist()
    follow, sym, value = (np.arange(len(w)) + length + extra).tolist(), sym.tolist(), value.tolist()
    p, skip = 0, 0
    for row in rows:
        if skip:
            skip -= 1
            continue
        k = ss
        while k <= se:
            s, q = sym[p], p
            if not there[p]:
                raise ValueError("no code word")
            p = follow[p]
            if s & 15:
                k += s >> 4
                z[row, k] = signed[q] << al if signed[q] > 0 else -(-signed[q] << al)
                k += 1
            elif s == 0xF0:
                k += 16
            else:
                skip = (1 << (s >> 4)) + (value[q] if s >> 4 else 0) - 1
                break


def decode_ac_later(bits: Bits, codes, z: np.ndarray, rows: np.ndarray, ss: int, se: int, al: int) -> None:
    b, p = bits.all(), 0
    words = {(n, c): s for c, n, s in codes}
    one, i = 1 << al, 0

    def word() -> int:
        nonlocal p
        code = 0
        for n in range(1, 17):
            code = code << 1 | int(b[p])
            p += 1
            if (n, code) in words:
                return words[n, code]
        raise ValueError("no code word")

    def correct(r, cells) -> None:
        """Adds a bit to each coefficient in ``cells`` of row(s) r that isn't 0 yet."""
        nonlocal p
        part = z[r, cells]
        live = part != 0
        n = int(live.sum())
        part[live] += np.where(b[p : p + n] > 0, np.sign(part[live]) * one, 0)
        z[r, cells] = part
        p += n

    while i < len(rows):
        k = ss
        while k <= se:
            s = word()
            run, size = s >> 4, s & 15
            if size == 0 and run < 15:
                n = (1 << run) + (int("".join(map(str, b[p : p + run])), 2) if run else 0)
                p += run
                correct(rows[i], slice(k, se + 1))
                if n > 1:
                    ended = slice(i + 1, i + n) if len(rows) == len(z) else rows[i + 1 : i + n]
                    cells = z[ended, ss : se + 1]
                    live = cells != 0
                    m = int(live.sum())
                    if m == cells.size and (cells > 0).all():
                        cells = cells + (b[p : p + m] * np.int16(one)).reshape(cells.shape)
                    else:
                        cells[live] += np.where(b[p : p + m] > 0, np.sign(cells[live]) * one, 0)
                    z[ended, ss : se + 1] = cells
                    p += m
                i += n
                break
            sign = 0
            if size:
                sign, p = (one if b[p] else -one), p + 1
            zero = np.flatnonzero(z[rows[i], k : se + 1] == 0)
            stop = k + int(zero[run]) if run < len(zero) else se
            correct(rows[i], slice(k, stop + 1))
            if size:
                z[rows[i], stop] = sign
            k = stop + 1
        else:
            i += 1


def coefficients(data: bytes, most: int | None = None):
    """A progressive file -> (width, height, planes): per component h, v, blocks wide, high, zigzag coefficients, quantisers."""
    at, quant, tables, planes = 2, {}, {}, []
    width = height = every = 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while data[at + 1] != 0xD9:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        if data[at + 1] == 0xFF:  # fill byte
            at += 1
            continue
        marker, n = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            while body:
                size = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if size == 128 else np.uint8).astype(np.float32)
                body = body[1 + size :]
        elif marker == 0xC4:
            while body:
                tables[body[0]] = codes = read_table(body[1:])
                body = body[17 + len(codes) :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xC2:
            height, width, count = struct.unpack(">HHB", body[1:6])
            if body[0] != 8 or not width * height or count not in (1, 3) or most is not None and width * height > most:
                raise ValueError("neither grey nor three components of 8 bits, or too large")
            parts = [body[6 + 3 * i : 9 + 3 * i] for i in range(count)]
            hm, vm = max(p[1] >> 4 for p in parts), max(p[1] & 15 for p in parts)
            wide, high = -(-width // (8 * hm)), -(-height // (8 * vm))
            for p in parts:
                h, v = p[1] >> 4, p[1] & 15
                planes.append({"id": p[0], "h": h, "v": v, "wide": wide * h, "high": high * v, "used": (-(-(-(-width * h // hm)) // 8), -(-(-(-height * v // vm)) // 8)), "z": np.zeros((wide * h * high * v, 64), np.int16), "q": p[2]})
        elif marker == 0xDA:
            known = {p["id"]: p for p in planes}
            comps = [(known[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            ss, se, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            end = MARKER.search(data, at).start()
            parts, at = RESTART.split(data[at:end]) if every else [data[at:end]], end
            scan([Bits(p) for p in parts], every, comps, tables, ss, se, approx >> 4, approx & 15, wide, high)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only progressive Huffman files are read")
    for p in planes:
        p["q"] = quant[p["q"]]
    return width, height, planes


def scan(parts: list[Bits], every: int, comps, tables, ss, se, ah, al, wide, high) -> None:
    """Adds a scan to its components; each of the parts holds ``every`` MCUs (0: all), and starts anew."""
    if ss == 0:
        if len(comps) == 1:
            c = comps[0][0]
            slots = [(0, ((np.arange(c["used"][1]) * c["wide"])[:, None] + np.arange(c["used"][0])).ravel()[:, None])]
        else:
            y, x = np.divmod(np.arange(wide * high), wide)
            slots = [(j, (((c["v"] * y)[:, None] + np.repeat(np.arange(c["v"]), c["h"])) * c["wide"] + (c["h"] * x)[:, None] + np.tile(np.arange(c["h"]), c["v"]))) for j, (c, _) in enumerate(comps)]
        per, mcus = sum(s.shape[1] for _, s in slots), len(slots[0][1])
        turns = [] if ah else [tables[comps[k][1] >> 4] for k, s in slots for _ in range(s.shape[1])]
        for bits, part in intervals(parts, every, mcus):
            count = per * (part.stop - part.start)
            got = (bits.all()[:count] if ah else decode_dc(bits, turns, count)).reshape(-1, per)
            j = 0
            for k, slot in slots:
                where, z = slot[part], comps[k][0]["z"]
                values = got[:, j : j + where.shape[1]].ravel()
                if ah:
                    z[where.ravel(), 0] |= values.astype(np.int16) << al
                else:
                    z[where.ravel(), 0] = np.cumsum(values) << al
                j += where.shape[1]
        return
    c, t = comps[0]
    rows = ((np.arange(c["used"][1]) * c["wide"])[:, None] + np.arange(c["used"][0])).ravel()
    for bits, part in intervals(parts, every, len(rows)):
        (decode_ac_later if ah else decode_ac_first)(bits, tables[0x10 | t & 15], c["z"], rows[part], ss, se, al)


def intervals(parts: list[Bits], every: int, count: int) -> list[tuple[Bits, slice]]:
    """The parts of a scan, each with the MCUs that it holds."""
    every = every or count
    if len(parts) != -(-count // every):
        raise ValueError("restart markers don't fit the size")
    return [(p, slice(i * every, min(count, (i + 1) * every))) for i, p in enumerate(parts)]


def pixels(width: int, height: int, planes) -> np.ndarray:
    """Full-resolution RGB, uint8 (height, width, 3); a single plane gives grey."""
    hm, vm = max(p["h"] for p in planes), max(p["v"] for p in planes)
    full = []
    for p in planes:
        s = (p["z"].astype(np.float32) * p["q"]) @ INVERSE + 128
        s = s.reshape(p["high"], p["wide"], 8, 8).transpose(0, 2, 1, 3).reshape(8 * p["high"], 8 * p["wide"])
        full.append(np.clip(s, 0, 255).repeat(vm // p["v"], 0).repeat(hm // p["h"], 1)[:height, :width])
    if len(full) == 1:
        full *= 3
        return np.stack(full, -1).round().astype(np.uint8)
    y, cb, cr = full
    cb, cr = cb - 128, cr - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.round(rgb), 0, 255).astype(np.uint8)


# --- payloads -------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def store(payload: bytes) -> bytes:
    """Payload of whole units -> progressive file with the payload's bytes as luma coefficients."""
    n = len(payload) // 64
    mcus = -(-n // 4)
    wide = int(np.ceil(np.sqrt(mcus)))
    high = -(-mcus // wide)
    z = np.zeros((wide * high * 4, 64), np.int16)
    z[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    z[:, 1:] += 256
    flat = np.zeros((wide * high, 64), np.int16)
    return encode(z, flat, flat, wide, high, PAYLOAD_SCRIPT)


def fetch(data: bytes, size: int):
    """Stored file -> (payload of ``size`` bytes, RGB tensor)."""
    width, height, planes = coefficients(data)
    return planes[0]["z"].astype(np.uint8).tobytes()[:size], pixels(width, height, planes)


def feature(rgb: np.ndarray) -> str:
    flat = rgb.reshape(-1, 3)
    mean, dark = flat.mean(0, dtype=np.float64), (flat < 64).mean(0)
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean=" + ",".join(f"{x:.3f}" for x in mean) + ";dark=" + ",".join(f"{x:.4f}" for x in dark)


def with_media(docs: DataFrame) -> DataFrame:
    """Adds n_bytes, payload_bytes and ``media``, the stored file."""

    @F.pandas_udf("binary")
    def stored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([store(padded((t or "").encode())) for t in s], dtype=object)

    n = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    size = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("long")
    (made,) = fresh(docs, "made")
    got = without(docs.withColumn(made, F.struct(n.alias("n"), size.alias("size"), stored("text").alias("file"))), "n_bytes", "payload_bytes", "media")
    m = F.col(made)
    return got.select("*", m.n.alias("n_bytes"), m["size"].alias("payload_bytes"), m.file.alias("media")).drop(made)


def readable(read, *args):
    """What ``read`` makes of a file; None of one that is null or can't be read."""
    try:
        return None if args[0] is None else read(*args)
    except (ValueError, LookupError, AttributeError, TypeError, struct.error):
        return None


def tensors(media: DataFrame, most: int = 1 << 27) -> DataFrame:
    """Adds ``rgb``: bytes of the full-resolution tensor, with its height and width; null where there's none."""

    @F.pandas_udf("struct<height:int,width:int,data:binary>")
    def decoded(files: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in files:
            rgb = [readable(lambda x: pixels(*coefficients(x, most)), x) for x in s]
            yield pd.DataFrame([(None, None, None) if x is None else (*x.shape[:2], x.tobytes()) for x in rgb], columns=["height", "width", "data"]).astype({"height": "Int32", "width": "Int32"})

    (made,) = fresh(media, "made")
    out = without(media.withColumn(made, decoded("media")), "rgb")
    return out.withColumn("rgb", F.when(F.col(made).data.isNotNull(), F.col(made))).drop(made)


def digests(media: DataFrame) -> DataFrame:
    """Reads the stored files back: payload digests and a feature string of the pixels."""

    @F.pandas_udf("struct<payload_sha256:string,tail_crc32:long,feature:string>")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for files, sizes in parts:
            rows = []
            for data, size in zip(files, sizes):
                got = readable(fetch, data, size)
                rows.append((None, None, None) if got is None else (hashlib.sha256(got[0]).hexdigest(), zlib.crc32(got[0][-32:]), feature(got[1])))
            yield pd.DataFrame(rows, columns=["payload_sha256", "tail_crc32", "feature"]).astype({"tail_crc32": "Int64"})

    (made,) = fresh(media, "made")
    got = media.withColumn(made, F.struct(read("media", "payload_bytes").alias("r"), F.octet_length("media").cast("long").alias("n"), F.sha2("media", 256).alias("sha")))
    m = F.col(made)
    kept = without(got, "media", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return kept.select("*", m.r.payload_sha256.alias("payload_sha256"), m.r.tail_crc32.alias("tail_crc32"), m.n.alias("media_bytes"), m.sha.alias("media_sha256"), m.r.feature.alias("feature")).drop(made)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(with_media(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
