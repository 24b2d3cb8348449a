"""FIT binary protocol: messages from bytes, and bytes from messages, by numpy over runs of messages of one shape. Spark hands it one file at a time."""

from __future__ import annotations

import math
import struct

import numpy as np

#: base type: format, size, invalid value
BASE = {
    0x00: ("B", 1, 0xFF), 0x01: ("b", 1, 0x7F), 0x02: ("B", 1, 0xFF), 0x83: ("h", 2, 0x7FFF), 0x84: ("H", 2, 0xFFFF), 0x85: ("i", 4, 0x7FFFFFFF), 0x86: ("I", 4, 0xFFFFFFFF),
    0x88: ("f", 4, None), 0x89: ("d", 8, None), 0x0A: ("B", 1, 0), 0x8B: ("H", 2, 0), 0x8C: ("I", 4, 0), 0x0D: ("B", 1, 0xFF), 0x8E: ("q", 8, 0x7FFFFFFFFFFFFFFF), 0x8F: ("Q", 8, 0xFFFFFFFFFFFFFFFF), 0x90: ("Q", 8, 0),
}
_DTYPE = {(f, o): np.dtype(f).newbyteorder(o) for f, *_ in BASE.values() for o in "<>"}
ENUM, SINT8, UINT8, UINT16, SINT32, UINT32, UINT64, STRING = 0x00, 0x01, 0x02, 0x84, 0x85, 0x86, 0x8F, 0x07
FILE_ID, SESSION, LAP, RECORD, EVENT, ACTIVITY = 0, 18, 19, 20, 21, 34
GARMIN = {1, 13, 15, 89}


def _byte_table() -> list[int]:
    out = []
    for b in range(256):
        crc = b
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
        out.append(crc)
    return out


_CRC = _byte_table()


_BLOCK = 4096


def _place_table() -> np.ndarray:
    """What a byte adds to the checksum by how many bytes follow it."""
    one = np.array(_CRC, np.uint16)
    out = np.empty((_BLOCK, 256), np.uint16)
    out[0] = one
    for k in range(1, _BLOCK):
        out[k] = out[k - 1] >> 8 ^ one[out[k - 1] & 0xFF]
    return out.ravel()


_PLACE = _place_table()
_ROW = np.arange(_BLOCK - 1, -1, -1, dtype=np.intp) * 256


def crc16(data: bytes, crc: int = 0) -> int:
    """By blocks, whose bytes each add what stands for them and their place: the checksum is linear, and its state before a block counts as part of the first two bytes."""
    whole = np.frombuffer(data, np.uint8)
    for begin in range(0, len(data), _BLOCK):
        block = whole[begin : begin + _BLOCK]
        n = len(block)
        if n == 1:
            return crc >> 8 ^ _CRC[(crc ^ int(block[0])) & 0xFF]
        at = _ROW[-n:] + block
        at[0] = _ROW[-n] + (int(block[0]) ^ crc & 0xFF)
        at[1] = _ROW[-n + 1] + (int(block[1]) ^ crc >> 8)
        crc = int(np.bitwise_xor.reduce(_PLACE[at]))
    return crc


class FitError(ValueError):
    pass


def messages(data: bytes, wanted: set[int] | None = None, check: bool = True):
    """(global number, {field: raw value}) in file order; invalid values are left out; files may follow each other."""
    for number, n, fields in runs(data, wanted, check):
        for i in range(n):
            yield number, {num: v[i] if isinstance(v, list) else v[i].item() for num, (v, valid) in fields.items() if valid[i]}


def runs(data: bytes, wanted: set[int] | None = None, check: bool = True):
    """(global number, how many, {field: (raw values, which are valid)}) of messages in file order, those of one shape that follow each other at once."""
    at = 0
    if not data:
        raise FitError("empty file")
    while at < len(data):
        if len(data) - at < 12 or data[at + 8 : at + 12] != b".FIT" or data[at] < 12:
            raise FitError("not a FIT file")
        head = data[at]
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        end = at + head + size
        if end + 2 > len(data):
            raise FitError("the file is cut off")
        if check and crc16(data[at : end + 2]):
            raise FitError("wrong checksum")
        yield from _body(data, at + head, end, wanted)
        at = end + 2


def _body(data: bytes, at: int, end: int, wanted: set[int] | None):
    known: dict[int, tuple] = {}
    last_time = 0
    whole = np.frombuffer(data, np.uint8)
    while at < end:
        h = data[at]
        if h & 0xC0 == 0x40:
            at += 1
            if at + 5 > end:
                raise FitError("a definition is cut off")
            order = ">" if data[at + 1] else "<"
            number = struct.unpack_from(order + "H", data, at + 2)[0]
            n = data[at + 4]
            at += 5
            fields, place = [], 0
            for _ in range(n):
                if at + 3 > end:
                    raise FitError("a definition is cut off")
                num, size, base = data[at : at + 3]
                fields.append((num, size, base, place))
                place += size
                at += 3
            if h & 0x20:
                if at >= end or at + 1 + 3 * data[at] > end:
                    raise FitError("a definition is cut off")
                for _ in range(data[at]):
                    place += data[at + 2]
                    at += 3
                at += 1
            known[h & 15] = (number, order, fields, place)
            continue
        local, offset = (h >> 5 & 3, h & 31) if h & 0x80 else (h & 15, -1)
        if local not in known:
            raise FitError("data without a definition")
        number, order, fields, total = known[local]
        if at + 1 + total > end:
            raise FitError("a message is cut off")
        heads = whole[at : end - total : total + 1]
        other = np.flatnonzero(heads[:64] != h)
        if not len(other):
            other = np.flatnonzero(heads != h)
        n = int(other[0]) if len(other) else len(heads)
        read = wanted is None or number in wanted
        values: dict[int, tuple] = {}
        for num, size, base, place in fields:
            if not read and num != 253:
                continue
            lo = at + 1 + place
            if base == STRING:
                texts = [data[k : k + size].split(b"\0", 1)[0].decode("utf-8", "replace") for k in range(lo, lo + n * (total + 1), total + 1)]
                values[num] = (texts, np.array([bool(x) for x in texts], bool))
                continue
            fmt, one, invalid = BASE.get(base, ("B", 1, 0xFF))
            if size < one:
                continue
            v = np.ndarray((n,), _DTYPE[fmt, order], data, lo, (total + 1,))
            values[num] = (v, v == v if invalid is None else v != invalid)
        if offset >= 0:
            last_time += (offset - (last_time & 31)) & 31
            values[253] = (np.full(n, last_time), np.ones(n, bool))
        elif 253 in values and not isinstance(values[253][0], list):
            v, valid = values[253]
            if valid.any():
                last_time = int(v[np.flatnonzero(valid)[-1]])
        at += n * (total + 1)
        if read:
            yield number, n, values


class Writer:
    """Collects messages and closes them with header and checksum (protocol 2.0)."""

    def __init__(self):
        self.out, self.known = bytearray(), {}

    def add(self, number: int, fields: list[tuple[int, int, object]]) -> None:
        """fields: (number, base type, value); those without a value are left out."""
        fields = [(n, b, v) for n, b, v in fields if v is not None]
        shape = (number, tuple((n, b, len(v.encode()) + 1 if b == STRING else BASE[b][1]) for n, b, v in fields))
        if shape not in self.known:
            local = len(self.known) % 16
            self.known = {k: v for k, v in self.known.items() if v != local}
            self.known[shape] = local
            self.out += bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields))
            for n, b, size in shape[1]:
                self.out += bytes([n, size, b])
        self.out.append(self.known[shape])
        for _, b, v in fields:
            self.out += v.encode() + b"\0" if b == STRING else struct.pack("<" + BASE[b][0], v)

    def add_block(self, number: int, fields: list[tuple[int, int, np.ndarray, np.ndarray]]) -> None:
        """Messages of one shape at once. fields: (number, base type, values, which there are); fields without any are left out, and missing values are written as invalid."""
        fields = [(n, b, v, ok) for n, b, v, ok in fields if ok.any()]
        rows = len(fields[0][2]) if fields else 0
        if not rows:
            return
        shape = (number, tuple((n, b, BASE[b][1]) for n, b, *_ in fields))
        if shape not in self.known:
            local = len(self.known) % 16
            self.known = {k: v for k, v in self.known.items() if v != local}
            self.known[shape] = local
            self.out += bytes([0x40 | local, 0, 0]) + struct.pack("<HB", number, len(fields))
            for n, b, size in shape[1]:
                self.out += bytes([n, size, b])
        block = np.zeros(rows, [("head", "u1"), *((f"f{k}", _DTYPE[BASE[b][0], "<"]) for k, (_, b, *_) in enumerate(fields))])
        block["head"] = self.known[shape]
        for k, (_, b, v, ok) in enumerate(fields):
            block[f"f{k}"] = np.where(ok, v, BASE[b][2])
        self.out += block.tobytes()

    def close(self) -> bytes:
        head = struct.pack("<BBHI4s", 14, 0x20, 2132, len(self.out), b".FIT")
        head += struct.pack("<H", crc16(head))
        body = head + bytes(self.out)
        return body + struct.pack("<H", crc16(body))


def _fit(v, lo: int, hi: int):
    return None if v is None or not lo <= v <= hi else int(v)


def _half_up(v: float) -> int:
    """As C rounds what isn't negative."""
    return math.floor(v + 0.5)


def _total(number: int, v: int) -> tuple:
    """A total: 32 bits as in the profile, or 64 where these can't hold it."""
    return number, UINT32 if v <= 2**32 - 2 else UINT64, v


POINT_FIELDS = ("t_fit", "lat", "lon", "elevation", "heart_rate", "cadence", "cum_dist_m", "speed_sensor_ms", "power", "temperature")


def encode_activity(points: list[dict], stats: dict) -> bytes:
    """encode_fields of points as dicts."""
    column = lambda c: np.array([np.nan if p.get(c) is None else p[c] for p in points], float)
    return encode_fields(record_fields({c: column(c) for c in POINT_FIELDS}), stats)


def record_fields(p: dict[str, np.ndarray]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Fields of records for add_block, of the points of one activity or of many. p has a column of floats for each of POINT_FIELDS, NaN where a value is missing; what a field can't hold is missing, too."""

    def field(number: int, base: int, x: np.ndarray, lo: int, hi: int) -> tuple:
        with np.errstate(invalid="ignore"):
            ok = (x >= lo) & (x <= hi)
        return number, base, np.where(ok, x, 0).astype(np.int64), ok

    semi = 2147483648.0 / 180.0
    lat, lon = field(0, SINT32, np.trunc(p["lat"] * semi), -(2**30), 2**30), field(1, SINT32, np.trunc(p["lon"] * semi), -(2**31), 2**31 - 2)
    both = lat[3] & lon[3]
    return [
        field(253, UINT32, p["t_fit"], 1, 2**32 - 2), (*lat[:3], both), (*lon[:3], both), field(2, UINT16, np.rint((p["elevation"] + 500) * 5), 0, 65534), field(3, UINT8, p["heart_rate"], 1, 254), field(4, UINT8, p["cadence"], 1, 254),
        field(5, UINT32, np.rint(np.where(p["cum_dist_m"] > 0, p["cum_dist_m"], np.nan) * 100), 0, 2**32 - 2), field(6, UINT16, np.rint(np.where(p["speed_sensor_ms"] > 0, p["speed_sensor_ms"], np.nan) * 1000), 0, 65534),
        field(7, UINT16, p["power"], 1, 65534), field(13, SINT8, p["temperature"], -128, 126),
    ]


def encode_fields(records: list[tuple[int, int, np.ndarray, np.ndarray]], stats: dict) -> bytes:
    """An activity file: file id, timer start, records (of record_fields), timer stop, one lap, one session, activity. Times and distances of rides that 32 bits can't hold are written in 64; ascent and descent end at 65534."""
    if not len(records[0][2]):
        raise FitError("no points to write")
    w = Writer()
    start, end = int(stats["start_fit"] or 0), int(stats["end_fit"] or 0)
    w.add(FILE_ID, [(0, ENUM, 4), (1, UINT16, 255), (2, UINT16, 0), (4, UINT32, start)])
    w.add(EVENT, [(253, UINT32, start), (0, ENUM, 0), (1, ENUM, 0)])
    over = lambda v: v if v is not None and v > 0 else None
    w.add_block(RECORD, records)
    w.add(EVENT, [(253, UINT32, end), (0, ENUM, 0), (1, ENUM, 4)])
    ms, cm = stats["elapsed_s"] * 1000, _half_up((over(stats["distance_m"]) or 0) * 100)
    up = lambda c: None if over(stats[c]) is None else _half_up(min(stats[c], 65534))
    speed = lambda c: None if over(stats[c]) is None else _fit(_half_up(stats[c] * 1000), 0, 65534)
    common = [(253, UINT32, end), (2, UINT32, start), _total(7, ms), _total(8, ms), _total(9, cm)]
    w.add(LAP, [*common, (13, UINT16, speed("avg_speed_ms")), (14, UINT16, speed("max_speed_ms")), (21, UINT16, up("ascent_m")), (22, UINT16, up("descent_m"))])
    w.add(SESSION, [
        *common, (5, ENUM, 2), (6, ENUM, 0), (14, UINT16, speed("avg_speed_ms")), (15, UINT16, speed("max_speed_ms")), (16, UINT8, _fit(stats["avg_heart_rate"], 0, 254)), (17, UINT8, _fit(stats["max_heart_rate"], 0, 254)),
        (18, UINT8, _fit(stats["avg_cadence"], 0, 254)), (19, UINT8, _fit(stats["max_cadence"], 0, 254)), (20, UINT16, _fit(stats["avg_power"], 0, 65534)), (21, UINT16, _fit(stats["max_power"], 0, 65534)), (22, UINT16, up("ascent_m")), (23, UINT16, up("descent_m")), (25, UINT16, 0), (26, UINT16, 1),
    ])
    w.add(ACTIVITY, [(253, UINT32, end), _total(0, ms), (1, UINT16, 1), (2, ENUM, 0), (3, ENUM, 26), (4, ENUM, 1), (5, UINT32, end)])
    return w.close()
