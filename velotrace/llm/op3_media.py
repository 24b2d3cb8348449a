"""Progressive JPEG media columns: a lossless payload writer and a decoder to full-resolution RGB tensors.

Writer: each run of 64 payload bytes is one 8x8 block, byte k (as a signed 8-bit unit) being coefficient k in zigzag order. Blocks fill the Y, then
the Cb and Cr planes of a 4:2:0 image. Five scans a component: DC first and refined, AC 1-5 first and refined, AC 6-63. A restart marker follows
each block, so that entropy-coded segments are independent and numpy decodes one symbol of all of them at a step.
Decoder: the scans of spectral selection and successive approximation accumulate into coefficient arrays; then inverse transform, chroma upsampling
and colour conversion. Files with other restart intervals, interleaved DC scans or runs of ends of block go through a decoder block by block.

Defined results: null text is the empty text, which is one block of zeros; repeated rows give equal rows; an empty table gives none; extra columns
are ignored; memory follows the longest text (an image has up to 65,520 x 65,520 pixels, 6.4 GB of payload; longer texts raise ValueError).
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, keep_columns, table

#: Place y * 8 + x of each coefficient on the zigzag path: by diagonal, going up on the even ones.
ZIGZAG = np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p % 8 if (p // 8 + p % 8) % 2 == 0 else p // 8)))
FRACTION = 13
LOW, HIGH = (1, 5), (6, 63)
NEXT_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]")


def _basis() -> np.ndarray:
    """Integer inverse DCT: row k holds what zigzag coefficient k adds to the 64 samples, times 2^FRACTION. Sums in float64 are exact."""
    c = np.array([[math.sqrt(0.125) if u == 0 else 0.5 * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return np.rint(full[ZIGZAG] * (1 << FRACTION))


BASIS = _basis()


class Huffman:
    """A canonical code from {symbol: length}, with tables to write and to read it."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda s: (lengths[s], s))
        self.values = order
        self.counts = [sum(1 for s in order if lengths[s] == n) for n in range(1, 17)]
        self.code, self.size = np.zeros(256, np.int64), np.zeros(256, np.int64)
        self.look_sym, self.look_len = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
        code = at = 0
        for n in range(1, 17):
            for s in order[at : at + self.counts[n - 1]]:
                self.code[s], self.size[s] = code, n
                lo = code << (16 - n)
                self.look_sym[lo : lo + (1 << (16 - n))], self.look_len[lo : lo + (1 << (16 - n))] = s, n
                code += 1
            at += self.counts[n - 1]
            code <<= 1

    def segment(self, kind: int, slot: int) -> bytes:
        body = bytes([kind << 4 | slot, *self.counts, *self.values])
        return b"\xff\xc4" + (len(body) + 2).to_bytes(2, "big") + body


DC = Huffman({s: 4 for s in range(12)})
AC = Huffman({0x07: 2, 0x06: 2, 0x05: 3, 0x00: 4, 0x03: 5, 0x04: 5} | {s: 11 for r in range(16) for n in range(1, 11) if (s := r << 4 | n) not in (3, 4, 5, 6, 7)} | {0xF0: 11})
WIDTH = np.array([int(v).bit_length() for v in range(1 << 11)], np.int64)


def _pack(value: np.ndarray, bits: np.ndarray, lane_bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of lanes (each filled up with ones to a byte), and each lane's first byte and the end."""
    size = (lane_bits + 7) >> 3
    first = np.concatenate([[0], np.cumsum(size)])
    pad = (size << 3) - lane_bits
    before = np.cumsum(pad) - pad
    ends = np.cumsum(bits)
    lane_of = np.repeat(np.arange(len(lane_bits)), np.diff(np.searchsorted(ends, np.concatenate([[0], np.cumsum(lane_bits)]), "right")))
    pos = ends - bits + before[lane_of]
    word = pos >> 5
    v = value.astype(np.uint64) << (64 - (pos & 31) - bits).astype(np.uint64)
    new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(first[-1] >> 2) + 3, np.uint64)
    out[word[new]] += np.add.reduceat(v >> np.uint64(32), new)
    out[word[new] + 1] += np.add.reduceat(v & np.uint64(0xFFFFFFFF), new)
    raw = out.astype(">u4").view(np.uint8)[: first[-1]].copy()
    raw[first[1:] - 1] |= ((1 << pad) - 1).astype(np.uint8)
    return raw, first


def _framed(raw: np.ndarray, first: np.ndarray, scan_lanes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The lanes with stuffed bytes and restart markers between those of one scan; and each scan's first byte and the end."""
    lane_end = first[1:] - 1
    edge = np.cumsum(scan_lanes)
    number = np.arange(len(lane_end)) - np.repeat(edge - scan_lanes, scan_lanes)
    inner = number + 1 < np.repeat(scan_lanes, scan_lanes)
    full = raw == 255
    inc = 1 + full.astype(np.int64)
    inc[lane_end[inner]] += 2
    at = np.cumsum(inc) - inc
    out = np.zeros(int(inc.sum()), np.uint8)
    out[at] = raw
    mark = at[lane_end[inner]] + 1 + full[lane_end[inner]]
    out[mark], out[mark + 1] = 255, 0xD0 + (number[inner] & 7)
    begin = np.concatenate([at, [len(out)]])[first[np.concatenate([[0], edge])]]
    return out.tobytes(), begin


def _shifted(c: np.ndarray, al: int) -> np.ndarray:
    return np.sign(c) * (np.abs(c) >> al)


def _dc_first(dc: np.ndarray, al: int):
    v = dc >> al
    s = WIDTH[np.abs(v)]
    bits = DC.size[s] + s
    return DC.code[s] << s | (v + (v < 0) * ((1 << s) - 1)), bits, bits


def _ac_first(c: np.ndarray, al: int):
    v = _shifted(c, al)
    n, width = v.shape
    block, k = np.nonzero(v)
    val = v[block, k]
    same = np.zeros(len(block), bool)
    same[1:] = block[1:] == block[:-1]
    run = k - np.where(same, np.concatenate([[0], k[:-1]]), -1) - 1
    s = WIDTH[np.abs(val)]
    sym = (run & 15) << 4 | s
    value, bits = AC.code[sym] << s | (val + (val < 0) * ((1 << s) - 1)), AC.size[sym] + s
    skips = run >> 4
    if skips.any():
        idx = np.repeat(np.arange(len(block)), skips + 1)
        own = np.zeros(len(idx), bool)
        own[np.cumsum(skips + 1) - 1] = True
        value, bits, block = np.where(own, value[idx], AC.code[0xF0]), np.where(own, bits[idx], AC.size[0xF0]), block[idx]
    open_ = v[:, -1] == 0
    count = np.bincount(block, minlength=n)
    total = count + open_
    end = np.cumsum(total)
    dest = np.arange(len(block)) + (np.cumsum(open_) - open_)[block]
    out_v, out_b = np.empty(int(end[-1]), np.int64), np.empty(int(end[-1]), np.int64)
    out_v[dest], out_b[dest] = value, bits
    out_v[end[open_] - 1], out_b[end[open_] - 1] = AC.code[0], AC.size[0]
    return out_v, out_b, np.add.reduceat(out_b, end - total)


def _ac_refine(c: np.ndarray, al: int):
    """At most 16 coefficients a band, so that no run needs a skip symbol and a block's bits fit one word."""
    n, width = c.shape
    mag = np.abs(c) >> al
    acc, bits, wait, waits, run = (np.zeros(n, np.int64) for _ in range(5))
    for k in range(width):
        m = mag[:, k]
        old, new = m > 1, m == 1
        wait, waits = np.where(old, wait << 1 | (m & 1), wait), waits + old
        sym = run << 4 | 1
        add = np.where(new, AC.size[sym] + 1, 0)
        acc = np.where(new, ((acc << add | (AC.code[sym] << 1 | (c[:, k] > 0))) << waits) | wait, acc)
        bits += np.where(new, add + waits, 0)
        wait, waits, run = np.where(new, 0, wait), np.where(new, 0, waits), np.where(new, 0, run + (m == 0))
    open_ = (run > 0) | (waits > 0)
    acc = np.where(open_, ((acc << AC.size[0] | AC.code[0]) << waits) | wait, acc)
    bits += np.where(open_, AC.size[0] + waits, 0)
    return acc, bits, bits


def _split(value: np.ndarray, bits: np.ndarray, lane_bits: np.ndarray):
    """Words of more than 32 bits as two entries."""
    lo = np.minimum(bits, 30)
    both = np.stack([value >> lo, value & ((1 << lo) - 1)], 1).ravel()
    sizes = np.stack([bits - lo, lo], 1).ravel()
    some = sizes > 0
    return both[some], sizes[some], lane_bits


def layout(n_blocks: int) -> tuple[int, int]:
    """Rows and columns of 16x16 units for so many blocks."""
    units = max(1, -(-n_blocks // 6))
    cols = min(4095, math.isqrt(units - 1) + 1)
    rows = -(-units // cols)
    if rows > 4095:
        raise ValueError("a payload of over 6.4 GB doesn't fit one image")
    return rows, cols


SCANS = ((0, 0, 0, 1), (*LOW, 0, 1), (*HIGH, 0, 0), (*LOW, 1, 0), (0, 0, 1, 0))


def encode(payloads: list[np.ndarray], lengths: list[int]) -> list[bytes]:
    """One progressive JPEG for each payload (uint8, a multiple of 64 long); lengths are kept in a comment."""
    shapes = [layout(len(p) // 64) for p in payloads]
    lanes = np.array([[4 * r * c, r * c, r * c] for r, c in shapes]).ravel()
    coef = np.zeros((int(lanes.sum()), 64), np.int64)
    at = 0
    for p, (r, c) in zip(payloads, shapes):
        coef[at : at + len(p) // 64] = p.view(np.int8).reshape(-1, 64)
        at += 6 * r * c
    lo, hi, dc = coef[:, LOW[0] : LOW[1] + 1], coef[:, HIGH[0] : HIGH[1] + 1], coef[:, 0]
    one = np.ones(len(dc), np.int64)
    parts = []
    for made in (_dc_first(dc, 1), _ac_first(lo, 1), _ac_first(hi, 0), _split(*_ac_refine(lo, 0)), (dc & 1, one, one)):
        parts.append(_framed(*_pack(*made), lanes))
    out = []
    for d, (r, c) in enumerate(shapes):
        note = b"payload=%d" % lengths[d]
        head = [b"\xff\xd8\xff\xfe", (len(note) + 2).to_bytes(2, "big"), note, b"\xff\xdb\x00\x43\x00" + bytes([1] * 64)]
        head.append(b"\xff\xc2\x00\x11\x08" + (16 * r).to_bytes(2, "big") + (16 * c).to_bytes(2, "big") + b"\x03\x01\x22\x00\x02\x11\x00\x03\x11\x00")
        head += [DC.segment(0, 0), AC.segment(1, 0), b"\xff\xdd\x00\x04\x00\x01"]
        for (ss, se, ah, al), (data, begin) in zip(SCANS, parts):
            for k in range(3):
                head.append(b"\xff\xda\x00\x08\x01" + bytes([k + 1, 0, ss, se, ah << 4 | al]))
                head.append(data[begin[3 * d + k] : begin[3 * d + k + 1]])
        out.append(b"".join(head) + b"\xff\xd9")
    return out


class Image:
    """What a file's markers say, its scans and its coefficient arrays (zigzag order, one row a block)."""

    def __init__(self):
        self.quant, self.tables, self.scans, self.note, self.restart = {}, {}, [], b"", 0
        self.parts: list = []


def parse(data: bytes) -> Image:
    im, i = Image(), 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while i < len(data):
        if data[i] != 255:
            raise ValueError("a marker is missing")
        m = data[i + 1]
        if m == 255:
            i += 1
            continue
        if m == 0xD9:
            break
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + n]
        i += 2 + n
        if m == 0xDB:
            while body:
                wide = body[0] >> 4
                im.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif m == 0xC2:
            im.height, im.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            im.parts = [{"id": body[6 + 3 * k], "h": body[7 + 3 * k] >> 4, "v": body[7 + 3 * k] & 15, "q": body[8 + 3 * k]} for k in range(body[5])]
            hm, vm = max(p["h"] for p in im.parts), max(p["v"] for p in im.parts)
            im.mcols, im.mrows = -(-im.width // (8 * hm)), -(-im.height // (8 * vm))
            for p in im.parts:
                p["cols"], p["rows"] = im.mcols * p["h"], im.mrows * p["v"]
                p["own_cols"], p["own_rows"] = -(-(-(-im.width * p["h"] // hm)) // 8), -(-(-(-im.height * p["v"] // vm)) // 8)
        elif m in (0xC0, 0xC1, 0xC9, 0xCA):
            raise ValueError("only Huffman-coded progressive files are decoded")
        elif m == 0xC4:
            while body:
                counts = body[1:17]
                values = body[17 : 17 + sum(counts)]
                lengths, at = {}, 0
                for size, count in enumerate(counts, 1):
                    for s in values[at : at + count]:
                        lengths[s] = size
                    at += count
                im.tables[body[0]] = _table(bytes(body[: 17 + at]), lengths, list(values))
                body = body[17 + at :]
        elif m == 0xDD:
            im.restart = int.from_bytes(body, "big")
        elif m == 0xFE:
            im.note = bytes(body)
        elif m == 0xDA:
            found = NEXT_MARKER.search(data, i)
            if not found:
                raise ValueError("the file ends within a scan")
            end = found.start()
            k = body[0]
            sel = [(next(j for j, p in enumerate(im.parts) if p["id"] == body[1 + 2 * j0]), body[2 + 2 * j0]) for j0 in range(k)]
            im.scans.append({"sel": [(j, im.tables.get(t >> 4), im.tables.get(16 | (t & 15))) for j, t in sel], "band": (body[1 + 2 * k], body[2 + 2 * k], body[3 + 2 * k] >> 4, body[3 + 2 * k] & 15), "at": i, "end": end, "restart": im.restart})
            i = end
    return im


_tables: dict[bytes, Huffman] = {}


def _table(key: bytes, lengths: dict[int, int], values: list[int]) -> Huffman:
    if key not in _tables:
        made = Huffman(lengths)
        if made.values != values:  # within one length the file's order counts
            made = Huffman.__new__(Huffman)
            made.look_sym, made.look_len = np.zeros(65536, np.int64), np.zeros(65536, np.int64)
            code = at = 0
            for n in range(1, 17):
                count = sum(1 for s in values if lengths[s] == n)
                for s in values[at : at + count]:
                    lo = code << (16 - n)
                    made.look_sym[lo : lo + (1 << (16 - n))], made.look_len[lo : lo + (1 << (16 - n))] = s, n
                    code += 1
                at += count
                code <<= 1
        _tables[key] = made
    return _tables[key]


def _by_block(im: Image, scan: dict, data: bytes) -> None:
    """Any scan, block after block; its restart segments in turn."""
    ss, se, ah, al = scan["band"]
    pieces = []
    raw, at = data[scan["at"] : scan["end"]], 0
    while True:
        nxt = at
        while (nxt := raw.find(b"\xff", nxt)) >= 0 and raw[nxt + 1] == 0:
            nxt += 2
        pieces.append(raw[at : nxt if nxt >= 0 else len(raw)].replace(b"\xff\x00", b"\xff"))
        if nxt < 0:
            break
        at = nxt + 2
    order = []
    if len(scan["sel"]) == 1:
        j, d, a = scan["sel"][0]
        p = im.parts[j]
        order = [[(p["coef"][y * p["cols"] + x], j, d, a)] for y in range(p["own_rows"]) for x in range(p["own_cols"])]
    else:
        for my in range(im.mrows):
            for mx in range(im.mcols):
                order.append([(im.parts[j]["coef"][(my * im.parts[j]["v"] + v) * im.parts[j]["cols"] + mx * im.parts[j]["h"] + h], j, d, a) for j, d, a in scan["sel"] for v in range(im.parts[j]["v"]) for h in range(im.parts[j]["h"])])
    step = scan["restart"] or len(order)
    for number, begin in enumerate(range(0, len(order), step)):
        piece = pieces[number] + b"\xff" * 8
        pos, run, pred = 0, 0, {}

        def bits(n: int) -> int:
            nonlocal pos
            w = int.from_bytes(piece[pos >> 3 : (pos >> 3) + 4], "big")
            v = w >> (32 - (pos & 7) - n) & ((1 << n) - 1)
            pos += n
            return v

        def symbol(t: Huffman) -> int:
            nonlocal pos
            w = int.from_bytes(piece[pos >> 3 : (pos >> 3) + 3].ljust(3, b"\xff"), "big") >> (8 - (pos & 7)) & 0xFFFF
            pos += int(t.look_len[w])
            return int(t.look_sym[w])

        def signed(s: int) -> int:
            v = bits(s) if s else 0
            return v if not s or v >> (s - 1) else v - (1 << s) + 1

        for block, j, d, a in (x for unit in order[begin : begin + step] for x in unit):
            if ss == 0:
                if ah == 0:
                    pred[j] = pred.get(j, 0) + signed(symbol(d))
                    block[0] = pred[j] << al
                elif bits(1):
                    block[0] |= 1 << al
                continue
            k = ss
            if ah == 0:
                if run:
                    run -= 1
                    continue
                while k <= se:
                    sym = symbol(a)
                    r, s = sym >> 4, sym & 15
                    if s:
                        k += r
                        block[k] = signed(s) * (1 << al)
                        k += 1
                    elif r == 15:
                        k += 16
                    else:
                        run = (1 << r) + (bits(r) if r else 0) - 1
                        break
                continue

            def correct(k: int) -> None:
                if bits(1) and not abs(int(block[k])) & 1 << al:
                    block[k] += (1 << al) if block[k] > 0 else -(1 << al)

            if run == 0:
                while k <= se:
                    sym = symbol(a)
                    r, s = sym >> 4, sym & 15
                    val = 0
                    if s:
                        val = (1 << al) if bits(1) else -(1 << al)
                    elif r < 15:
                        run = (1 << r) + (bits(r) if r else 0)
                        break
                    while k <= se:
                        if block[k]:
                            correct(k)
                        elif r == 0:
                            if val:
                                block[k] = val
                            k += 1
                            break
                        else:
                            r -= 1
                        k += 1
            if run:
                while k <= se:
                    if block[k]:
                        correct(k)
                    k += 1
                run -= 1


def _lanes(coef: np.ndarray, rows: np.ndarray, pos: np.ndarray, win: np.ndarray, band: tuple, dc: Huffman, ac: Huffman) -> bool:
    """Decodes a segment a block, one symbol of all at a step; False where an end-of-block run needs the other decoder."""
    ss, se, ah, al = band

    def take(p: np.ndarray, n) -> np.ndarray:
        return win[p >> 3] >> (40 - (p & 7) - n) & ((1 << n) - 1)

    if ss == 0:
        if ah:
            coef[rows, 0] |= take(pos, 1) << al
            return True
        w = take(pos, 16)
        s = dc.look_sym[w]
        v = take(pos + dc.look_len[w], s)
        coef[rows, 0] = np.where((s > 0) & (v >> np.maximum(s - 1, 0) == 0), v - (1 << s) + 1, v) << al
        return True
    if ah == 0:
        k = np.full(len(rows), ss)
        while len(rows):
            shift = 40 - (pos & 7)
            w = win[pos >> 3]
            peek = w >> (shift - 16) & 0xFFFF
            sym, size = ac.look_sym[peek], ac.look_len[peek]
            s, r = sym & 15, sym >> 4
            k += r
            some = s > 0
            v = w >> (shift - size - s) & ((1 << s) - 1)
            v = np.where(v >> np.maximum(s - 1, 0) == 0, v - (1 << s) + 1, v)
            if not some.all():
                if ((s == 0) & (r > 0) & (r < 15)).any():
                    return False
                coef[rows[some], k[some]] = v[some] << al
                k = np.where(some | (r == 15), k + 1, se + 1)
            else:
                coef[rows, k] = v << al
                k += 1
            pos = pos + size + s
            left = k <= se
            if not left.all():
                rows, k, pos = rows[left], k[left], pos[left]
        return True
    n = len(rows)
    wait, done, r, val = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k in range(ss, se + 1):
        need = ~(wait | done)
        w = take(pos, 16)
        sym, size = ac.look_sym[w], ac.look_len[w]
        if (need & (sym & 15 == 0) & (sym > 0) & (sym < 0xF0)).any():
            return False
        end = need & (sym == 0)
        new = need & (sym & 15 == 1)
        pos = pos + np.where(need, size, 0)
        sign = take(pos, 1)
        pos = pos + new
        val = np.where(need, np.where(new, np.where(sign == 1, 1 << al, -(1 << al)), 0), val)
        r = np.where(need, sym >> 4, r)
        wait, done = wait | (need & ~end), done | end
        c = coef[rows, k]
        old = c != 0
        bit = take(pos, 1)
        pos = pos + old
        put = ~old & wait & (r == 0)
        c = np.where(old & (bit == 1) & (np.abs(c) & 1 << al == 0), c + (np.sign(c) << al), np.where(put, val, c))
        coef[rows, k] = c
        r = r - (~old & wait & ~put)
        wait = wait & ~put
    return True


def coefficients(files: list[bytes]) -> list[Image]:
    """All scans of all files accumulated; like scans of many files are decoded together."""
    images = [parse(f) for f in files]
    total = sum(p["cols"] * p["rows"] for im in images for p in im.parts)
    coef, at = np.zeros((total, 64), np.int64), 0
    base, starts = [], np.cumsum([0, *map(len, files)])
    for im in images:
        for p in im.parts:
            p["coef"] = coef[at : at + p["cols"] * p["rows"]]
            p["row"] = at
            at += p["cols"] * p["rows"]
    raw = np.frombuffer(b"".join(files), np.uint8)
    ff = np.flatnonzero(raw[:-1] == 255)
    stuffed = ff[raw[ff + 1] == 0] + 1
    marks = ff[(raw[ff + 1] >= 0xD0) & (raw[ff + 1] <= 0xD7)]
    clean = np.delete(raw, stuffed).astype(np.int64)
    clean = np.concatenate([clean, np.full(8, 255)])
    win = clean[:-4] << 32 | clean[1:-3] << 24 | clean[2:-2] << 16 | clean[3:-1] << 8 | clean[4:]
    for turn in range(max(len(im.scans) for im in images)):
        like: dict = {}
        for n, im in enumerate(images):
            if turn < len(im.scans):
                s = im.scans[turn]
                j, d, a = s["sel"][0]
                p = im.parts[j]
                whole = p["own_cols"] == p["cols"] and p["own_rows"] == p["rows"]
                if len(s["sel"]) == 1 and s["restart"] == 1 and whole:
                    like.setdefault((s["band"], id(d), id(a)), []).append((n, s, p))
                else:
                    _by_block(im, s, files[n])
        for (band, *_), group in like.items():
            firsts, rows = [], []
            for n, s, p in group:
                lo, hi = np.searchsorted(marks, [starts[n] + s["at"], starts[n] + s["end"]])
                firsts += [[starts[n] + s["at"]], marks[lo:hi] + 2]
                rows.append(np.arange(p["row"], p["row"] + hi - lo + 1))
            first, row = np.concatenate(firsts), np.concatenate(rows)
            pos = (first - np.searchsorted(stuffed, first)) * 8
            _, d, a = group[0][1]["sel"][0]
            if not _lanes(coef, row, pos, win, band, d, a):
                for n, s, p in group:
                    if not band[2]:
                        p["coef"][:, band[0] : band[1] + 1] = 0
                    _by_block(images[n], s, files[n])
    return images


def payload(im: Image) -> bytes:
    """The bytes that the writer stored: whole blocks."""
    size = int(im.note.partition(b"=")[2])
    body = np.concatenate([p["coef"] for p in im.parts]).astype(np.int8).view(np.uint8).ravel()
    return body[: max(64, -(-size // 64) * 64)].tobytes()


def tensors(images: list[Image]) -> list[np.ndarray]:
    """Height x width x 3 samples: inverse transform, chroma repeated to full resolution, colours converted."""
    out = []
    for im in images:
        planes = []
        hm, vm = max(p["h"] for p in im.parts), max(p["v"] for p in im.parts)
        for p in im.parts:
            q = im.quant[p["q"]]
            flat = (p["coef"] * q if (q != 1).any() else p["coef"]).astype(np.float64) @ BASIS
            flat = np.clip(np.floor((flat + (1 << (FRACTION - 1))) / (1 << FRACTION)) + 128, 0, 255).astype(np.int32)
            plane = flat.reshape(p["rows"], p["cols"], 8, 8).swapaxes(1, 2).reshape(p["rows"] * 8, p["cols"] * 8)
            if p["v"] < vm:
                plane = plane.repeat(vm // p["v"], 0)
            if p["h"] < hm:
                plane = plane.repeat(hm // p["h"], 1)
            planes.append(plane[: im.height, : im.width])
        rgb = np.empty((im.height, im.width, 3), np.uint8)
        if len(planes) == 1:
            rgb[:] = planes[0][:, :, None]
        else:
            y, cb, cr = (planes[0] << 16) + 32768, planes[1] - 128, planes[2] - 128
            rgb[:, :, 0] = np.clip((y + 91881 * cr) >> 16, 0, 255)
            rgb[:, :, 1] = np.clip((y - 22554 * cb - 46802 * cr) >> 16, 0, 255)
            rgb[:, :, 2] = np.clip((y + 116130 * cb) >> 16, 0, 255)
        out.append(rgb)
    return out


def feature(rgb: np.ndarray) -> str:
    """Size, mean colours and a checksum of the whole tensor."""
    mean = rgb.reshape(-1, 3).mean(0)
    return f"{rgb.shape[0]}x{rgb.shape[1]} {mean[0]:.3f} {mean[1]:.3f} {mean[2]:.3f} {zlib.crc32(rgb):08x}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tensors_too: bool = False) -> DataFrame:
    """Stores texts as progressive JPEG and reads them back; with tensors_too, adds media, height, width and the RGB tensor as bytes."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    if tensors_too:
        schema += ", media binary, height int, width int, rgb binary"
        names += ["media", "height", "width", "rgb"]

    def work(batches):
        for batch in batches:
            for row, data, offs in chunks(batch.column(1), 1 << 19):
                sizes = np.diff(offs).tolist()
                parts = []
                for a, n in zip(offs.tolist(), sizes):
                    p = np.zeros(max(64, -(-n // 64) * 64), np.uint8)
                    p[:n] = data[a : a + n]
                    parts.append(p)
                files = encode(parts, sizes)
                images = coefficients(files)
                back = [payload(im) for im in images]
                rgb = tensors(images)
                sha = lambda b: hashlib.sha256(b).hexdigest()
                cols = [sizes, [len(b) for b in back], [sha(b) for b in back], [zlib.crc32(b[-64:]) for b in back], [len(f) for f in files], [sha(f) for f in files], [feature(x) for x in rgb]]
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                if tensors_too:
                    cols += [files, [x.shape[0] for x in rgb], [x.shape[1] for x in rgb], [x.tobytes() for x in rgb]]
                    types += [pa.binary(), pa.int32(), pa.int32(), pa.binary()]
                arrays = [batch.column(0).slice(row, len(sizes)), *(pa.array(c, t) for c, t in zip(cols, types))]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return keep_columns(docs, id_col, text_col).mapInArrow(work, schema)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(table(spark, sf_dir, "documents"))
