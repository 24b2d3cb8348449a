"""SentencePiece BPE encoding by a table of last tokens, and decoding.

Every prefix of a text has one BPE encoding, so it has one last token. The table holds that token for each prefix: among the pieces that an
automaton finds to end there, it is the one whose pair with the last token of the shorter prefix encodes to just that pair. The ids are then read
off from the end backwards. Pieces never span a change from other text to the space mark, and characters outside the vocabulary never merge,
so the table is filled unit by unit, and units seen before come from a bounded cache. Units seen once are kept apart, so that they, however many, don't
displace those seen again.

Defined results: null text is the empty text; an empty text has the end id alone; repeated rows give equal rows; an empty table gives none; extra
columns are ignored. Texts of any length are encoded whole; the table takes memory in proportion to the longest run without a space.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import keep_columns, table

MARK = "▁"
CACHE = 150_000
NORMAL, BYTE_PIECE = 1, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes):
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if kind == 2 else (4 if kind == 5 else 8, i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


def read_model(path: str) -> tuple[list[tuple[str, float, int]], dict]:
    """(piece, score, type) by id, and the normaliser's settings."""
    with open(path, "rb") as f:
        raw = f.read()
    pieces, normal = [], {}
    for field, value in _fields(raw):
        if field == 1:
            d = dict(_fields(value))
            pieces.append((d[1].decode(), struct.unpack("<f", d.get(2, bytes(4)))[0], d.get(3, NORMAL)))
        elif field == 3:
            d = dict(_fields(value))
            normal = {"name": d.get(1, b"").decode(), "rules": d.get(2, b""), "prefix": d.get(3, 1), "squeeze": d.get(4, 1), "escape": d.get(5, 1)}
    return pieces, normal


class PrefixTable:
    """Encoder for a BPE model with an identity normaliser and byte fallback."""

    def __init__(self, path: str, cache: int = CACHE):
        self.pieces, normal = read_model(path)
        if normal["rules"] or normal["squeeze"] or not normal["escape"]:
            raise ValueError("only models with the identity normaliser are supported")
        self.prefix, self.cache_size = bool(normal["prefix"]), cache
        self.id = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.score = {p: self.pieces[i][1] for p, i in self.id.items()}
        self.byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE_PIECE}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte fallback")
        self.chars = {p for p in self.id if len(p) == 1}
        if any(re.search(f"[^{MARK}]{MARK}", p) or not set(p) <= self.chars for p in self.id):
            raise ValueError("a piece spans units or holds a character that is no piece")
        self.ok: dict[int, bool] = {}
        self.size = {i: len(p) for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(set(p)) == 1 and p[0] == MARK or self.merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        breaks = "" if "\n" in self.chars else "\n"
        self.unit = re.compile(f"{MARK}*[^{MARK}{breaks}]+|{MARK}+" + (f"|{breaks}" if breaks else ""))
        self.text = [str(i) for i in range(len(self.pieces))]
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.once: dict[str, tuple] = {}
        self.once_old: dict[str, tuple] = {}

    def merge(self, text: str) -> list[int]:
        """Plain merging, best score first and leftmost on ties: decides pairs, and runs of the space mark."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.id[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two pieces, one after the other, encode to just themselves."""
        key = left << 20 | right
        known = self.ok.get(key)
        if known is None:
            if len(self.ok) > 1_000_000:
                self.ok.clear()
            known = self.ok[key] = self.merge(self.pieces[left][0] + self.pieces[right][0]) == [left, right]
        return known

    def run(self, text: str) -> list[int]:
        """The ids of a run of known characters."""
        n = len(text)
        last = [-1] * (n + 1)
        done, fits, ok = 0, self.fits, self.ok
        for end, (i, size) in self.automaton.iter(text):
            if end < done:
                continue
            begin = end + 1 - size
            if begin:
                left = last[begin]
                if left < 0:
                    continue
                known = ok.get(left << 20 | i)
                if not (fits(left, i) if known is None else known):
                    continue
            last[end + 1], done = i, end + 1
        out, at = [], n
        while at:
            i = last[at]
            if i < 0:
                return self.heap(text)
            out.append(i)
            at -= self.size[i]
        out.reverse()
        return out

    def heap(self, text: str) -> list[int]:
        """Merging with a queue, for runs of space marks whose pieces all have one score."""
        import heapq

        n = len(text)
        part, nxt, prv = list(text), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list = []

        def add(a: int) -> None:
            b = nxt[a]
            if b < n and (s := self.score.get(part[a] + part[b])) is not None:
                heapq.heappush(queue, (-s, a, part[a] + part[b], b))

        for k in range(n - 1):
            add(k)
        while queue:
            _, a, whole, b = heapq.heappop(queue)
            if part[a] is None or part[b] is None or nxt[a] != b or part[a] + part[b] != whole:
                continue
            part[a], part[b], nxt[a] = whole, None, nxt[b]
            if nxt[a] < n:
                prv[nxt[a]] = a
            if prv[a] >= 0:
                add(prv[a])
            add(a)
        return [self.id[p] for p in part if p is not None]

    def unit_ids(self, unit: str) -> list[int]:
        marks = len(unit) - len(unit.lstrip(MARK))
        if marks > 1:
            return self._known(unit, self.heap if set(unit) <= {MARK} else self.spaced)
        return self._known(unit, self.run)

    def spaced(self, text: str) -> list[int]:
        """A run that begins with several space marks, whose pieces share a score."""
        return self.heap(text)

    def _known(self, unit: str, encode) -> list[int]:
        if self.chars.issuperset(unit):
            return encode(unit)
        out: list[int] = []
        begin = 0
        for k, c in enumerate(unit):
            if c not in self.chars:
                if begin < k:
                    out += encode(unit[begin:k])
                out += [self.byte[x] for x in c.encode()]
                begin = k + 1
        return out + (encode(unit[begin:]) if begin < len(unit) else [])

    def lookup(self, unit: str) -> tuple:
        hit = self.old.get(unit)
        if hit is None:
            hit = self.once.pop(unit, None) or self.once_old.pop(unit, None)
            if hit is None:
                hit = tuple(self.unit_ids(unit))
                if len(unit) <= 64:
                    if len(self.once) >= self.cache_size // 2:
                        self.once_old, self.once = self.once, {}
                    self.once[unit] = hit
                return hit
        if len(self.new) >= self.cache_size:
            self.old, self.new = self.new, {}
        self.new[unit] = hit
        return hit

    def encode(self, text: str, end: int | None = 2) -> tuple[list[int], str]:
        """The ids, and the same joined by spaces."""
        ids: list[int] = []
        if text:
            get = self.new.get
            for unit in self.unit.findall((MARK if self.prefix else "") + text.replace(" ", MARK)):
                hit = get(unit)
                if hit is None:
                    hit = self.lookup(unit)
                    get = self.new.get
                ids += hit
        if end is not None:
            ids.append(end)
        return ids, " ".join(map(self.text.__getitem__, ids))


_loaded: dict[str, tuple] = {}


def load(path: str) -> tuple[PrefixTable, sentencepiece.SentencePieceProcessor]:
    if path not in _loaded:
        _loaded[path] = (PrefixTable(path), sentencepiece.SentencePieceProcessor(model_file=path))
    return _loaded[path]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", outputs: str = "digests") -> DataFrame:
    """Encodes each text with an end id and decodes the ids again.

    outputs "digests": id, n_tokens, ids_sha256, decoded_sha256. outputs "ids": id, ids array, decoded text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    digests = outputs == "digests"
    schema = f"`{id_col}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def work(batches):
        enc, lib = load(model)
        for batch in batches:
            texts = batch.column(1)
            for lo in range(0, len(texts), 256):
                ids, joined = [], []
                for t in texts.slice(lo, 256).to_pylist():
                    a, b = enc.encode(t or "")
                    ids.append(a)
                    joined.append(b)
                plain = lib.decode(ids)
                if digests:
                    cols = [
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in plain], pa.string()),
                    ]
                else:
                    cols = [pa.array(ids, pa.list_(pa.int32())), pa.array(plain, pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] if digests else [id_col, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 256), *cols], names)

    return keep_columns(docs, id_col, text_col).mapInArrow(work, schema)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path())
