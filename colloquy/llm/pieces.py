"""SentencePiece encoding with offsets, and decoding.

Rows in: doc_id and text, further columns ignored. A null text counts as empty and has no pieces.
Every row is encoded by itself, so repeated rows give repeated results.

The normaliser is our own: at each place the longest key of the model's compiled character map that
is a prefix of the rest is replaced, else one character is kept, and every byte put out records the
byte of the source it came from. White space handling follows the model: dummy prefix, removal of
extra spaces, escaping as U+2581. The normalised text is cut into units before each run of
U+2581, which no piece of the vocabulary spans (checked on loading; without that property the
whole text is one unit), and each distinct unit is encoded once by the library and remembered.
Pieces are projected back to byte spans of the source through the recorded alignment.
"""

from __future__ import annotations

import array
import bisect
import hashlib
import itertools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units remembered by one worker; beyond that it starts anew. Bounds memory, not results.
CACHE_UNITS = 400_000


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes) -> Iterator[tuple[int, int, object, bytes]]:
    """Protocol buffer fields: number, wire type, value, the field's own bytes."""
    i = 0
    while i < len(data):
        start = i
        key, i = _varint(data, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            size, i = _varint(data, i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        yield key >> 3, kind, value, data[start:i]


class CharacterMap:
    """A compiled character map: a double-array trie from byte strings to places in a table of
    zero-ended replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.table = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.table = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at a place."""
        if not self.units:
            return None
        units, found = self.units, None
        node = 0
        unit = units[node]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            byte = data[i]
            node ^= byte
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != byte:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if not found:
            return None
        end = self.table.index(b"\0", found[1])
        return found[0], self.table[found[1] : end]


class Model:
    """A SentencePiece model file: its normaliser, and the library over normalised text."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.dummy_prefix = self.trim = self.escape = True
        self.suffix = False
        blob, pieces, rest = b"", [], []
        for number, _, value, raw in _fields(data):
            if number == 3:
                for n, _, v, _ in _fields(value):
                    if n == 2:
                        blob = v
                    elif n == 3:
                        self.dummy_prefix = bool(v)
                    elif n == 4:
                        self.trim = bool(v)
                    elif n == 5:
                        self.escape = bool(v)
                continue
            if number == 1:
                pieces.append(next(v for n, _, v, _ in _fields(value) if n == 1).decode())
            elif number == 2:
                self.suffix = any(n == 24 and v for n, _, v, _ in _fields(value))
            rest.append(raw)
        self.map = CharacterMap(blob)
        # the same model with a normaliser that changes nothing: name, and the three switches off
        plain = b"\x0a\x08identity\x18\x00\x20\x00\x28\x00"
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=b"".join(rest) + b"\x1a" + bytes([len(plain)]) + plain)
        self.outer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.unit_safe = self.escape and not self.suffix and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.cache: dict[str, tuple[int, str, str, bytes, bytes, int]] = {}
        # source bytes of each piece whose every character came from itself or from an escaped space; -1: not known from the piece
        shrink = len(SPACE.encode()) - 1 if self.escape else 0
        whole = lambda i: not (self.inner.is_byte(i) or self.inner.is_unknown(i) or self.inner.is_control(i))
        self.spoken = [p.replace(SPACE, " ") for p in pieces]
        self.source_bytes = [len(p.encode()) - shrink * p.count(SPACE) if whole(i) else -1 for i, p in enumerate(pieces)]

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """Normalised text and, for each of its bytes and its end, the byte of the source it came
        from. None stands for the plain alignment of a model whose character map is empty."""
        space = SPACE if self.escape else " "
        if not self.map.units and not self.trim:
            if not text:
                return "", None
            body = text.replace(" ", SPACE) if self.escape else text
            return (space if self.dummy_prefix and not self.suffix else "") + body + (space if self.dummy_prefix and self.suffix else ""), None
        data, at, out, align = text.encode(), 0, bytearray(), []
        spaced = space.encode()
        chunks = []
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                size, to = hit
            else:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                to = data[at : at + size]
            chunks.append((to, at))
            at += size
        end = len(data)
        if self.trim:
            while chunks and chunks[0][0] in (b" ", b""):
                chunks.pop(0)
        if not chunks:
            return "", [0]

        def put(b: bytes, source: int) -> None:
            out.extend(b)
            align.extend([source] * len(b))

        if self.dummy_prefix and not self.suffix:
            put(spaced, chunks[0][1])
        blank = self.trim
        for to, source in chunks:
            if blank and self.trim:
                to = to.lstrip(b" ")
            if not to:
                continue
            for k in range(len(to)):
                if to[k] == 32:
                    put(spaced, source)
                else:
                    put(to[k : k + 1], source)
            blank = to.endswith(b" ")
        if self.trim:
            while out.endswith(spaced):
                del out[len(out) - len(spaced) :]
                end = align[len(out)]
                del align[len(out) :]
        if self.dummy_prefix and self.suffix:
            put(spaced, end)
        align.append(end)
        return out.decode(), align

    def units_of(self, normal: str) -> list[str]:
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", normal) if self.unit_safe else [normal] if normal else []

    def learn(self, texts: list[str]) -> None:
        """Remember all units of these texts, given normalised; new ones go to the library in one call."""
        units = {u for t in texts for u in self.units_of(t)}
        new = list(units.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_UNITS:
            self.cache.clear()
            new = list(units)
        for text, ids in zip(new, self.inner.encode(new, num_threads=1) if new else [], strict=True):
            self.cache[text] = self._unit(text, ids)

    def unit(self, text: str) -> tuple[int, str, str, bytes, bytes, int]:
        """Of a unit: number of ids, the ids as decimals joined by commas, their decoding, the begins
        and ends of their spans as 32-bit numbers from the unit's start, and its bytes in the source,
        where each escaped space is one."""
        known = self.cache.get(text)
        if known is None:
            known = self._unit(text, self.inner.encode(text))
        return known

    def _unit(self, text: str, ids: list[int]) -> tuple[int, str, str, bytes, bytes, int]:
        sizes = [self.source_bytes[i] for i in ids]
        if min(sizes, default=0) >= 0:
            ends = list(itertools.accumulate(sizes))
            begins, size = [0, *ends[:-1]], ends[-1] if ends else 0
            decoded = "".join([self.spoken[i] for i in ids])
        else:
            align, size = self._plain_alignment(text.replace(SPACE, " ") if self.escape else text)
            spans = self._project(text.encode(), align, [ids])
            begins, ends = [x[2] for x in spans], [x[3] for x in spans]
            decoded = self._decoded(ids, text)
        return len(ids), ",".join(map(str, ids)), decoded, array.array("I", begins[: len(ids)]).tobytes(), array.array("I", ends).tobytes(), size

    def _decoded(self, ids: list[int], text: str) -> str:
        # the library drops one leading space at the start of what it decodes
        spoken = self.outer.decode(ids)
        return " " + spoken if self.unit_safe and self.dummy_prefix and text.startswith(SPACE) else spoken

    def encode_decode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by commas, and the decoded text."""
        return self.encode_decode_spans(text)[:3]

    def encode_decode_spans(self, text: str) -> tuple[int, str, str, np.ndarray]:
        """Number of ids, the ids as decimals joined by commas, the decoded text, and the begin and end
        of every piece's span of source bytes, as spans() gives them."""
        return self._assembled(text, *self.normalise(text))

    def encode_decode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str, np.ndarray]]:
        """encode_decode_spans of every text, with the library called once for all new units."""
        normal = [self.normalise(t) for t in texts]
        self.learn([n for n, _ in normal])
        return (self._assembled(t, *n) for t, n in zip(texts, normal, strict=True))

    def _assembled(self, text: str, normal: str, align: list[int] | None) -> tuple[int, str, str, np.ndarray]:
        found = list(map(self.unit, self.units_of(normal)))
        counts, ids, texts, begins, ends, sizes = zip(*found, strict=True) if found else ((),) * 6
        decoded = "".join(texts)
        if self.unit_safe and self.dummy_prefix and decoded.startswith(" "):
            decoded = decoded[1:]
        if align is not None or self.suffix or not self.escape or SPACE in text:
            where = np.array([x[2:] for x in self.spans(text)], dtype=np.int64).reshape(-1, 2)
        else:  # a unit's spans are the same wherever it stands; only the dummy prefix is not in the source
            at = np.zeros(len(found), dtype=np.int64)
            np.cumsum(sizes[:-1], out=at[1:])
            at = np.repeat(at - bool(self.dummy_prefix), counts)
            where = np.empty((len(at), 2), dtype=np.int64)
            for k, part in enumerate((begins, ends)):
                np.add(np.frombuffer(b"".join(part), dtype=np.uint32), at, out=where[:, k])
            np.maximum(where, 0, out=where)
        return sum(counts), ",".join(ids), decoded, where

    def _plain_alignment(self, text: str) -> tuple[list[int], int]:
        """The source byte of every byte of a text with its spaces escaped, and of its end; its size."""
        source, align = 0, []
        for c in text:
            size = len(c.encode())
            align += [source] * (len(SPACE.encode()) if c == " " and self.escape else size)
            source += size
        return [*align, source], source

    def spans(self, text: str) -> list[tuple[int, str, int, int]]:
        """Every piece in order: id, piece, and the span of source bytes it came from. A byte piece
        has the span of its character; what came from nothing, as the dummy prefix, is empty."""
        normal, align = self.normalise(text)
        raw = normal.encode()
        if align is None:
            prefix = len(SPACE.encode() if self.escape else b" ") if self.dummy_prefix and not self.suffix and normal else 0
            align, source = self._plain_alignment(text)
            align = [0] * prefix + align
            align += [source] * (len(raw) + 1 - len(align))
        return self._project(raw, align, map(self.inner.encode, self.units_of(normal)))

    def _project(self, raw: bytes, align: list[int], encoded: Iterable[list[int]]) -> list[tuple[int, str, int, int]]:
        """The pieces of normalised bytes, given as lists of ids, with their spans of the source."""
        starts = sorted(set(align))
        out, at = [], 0
        for ids in encoded:
            for i in ids:
                piece = self.inner.id_to_piece(i)
                size = 1 if self.inner.is_byte(i) else len(piece.encode()) if not self.inner.is_unknown(i) else None
                if size is None:  # an unknown piece is one character
                    lead = raw[at]
                    size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                begin, last = align[at], align[at + size - 1]
                after = align[at + size]
                if after <= last and not (begin == last == after):  # inside what one source character gave
                    k = bisect.bisect_right(starts, last)
                    after = starts[k] if k < len(starts) else after
                out.append((i, piece, begin, after))
                at += size
        return out


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _digests(path: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in frames:
            counts, ids, texts, spans = [], [], [], []
            given = [t or "" for t in batch.column("text").to_pylist()]
            for n, joined, decoded, where in (x for at in range(0, len(given), 256) for x in m.encode_decode_batch(given[at : at + 256])):
                counts.append(n)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                spans.append(hashlib.sha256(where.astype("<i8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"])

    return run


def _encoded(path: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in frames:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [m.spans(t.as_py() or "") for t in part.column("text")]
                columns = [pa.array([[x[k] for x in f] for f in found], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "ids", "pieces", "begins", "ends"])

    return run


def _decode(path: str):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in frames:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m.outer.decode(ids.as_py() or []) for ids in batch.column("ids")], pa.string())], ["doc_id", "text"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, pieces, and begins and ends (byte spans in the UTF-8 source), arrays in piece order."""
    return _texts(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>, pieces array<string>, begins array<long>, ends array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text from doc_id and ids (null: empty)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decode(path), "doc_id long, text string")


def encode_decode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, by the encoder above and its decoding."""
    return encode_decode_span_digests(docs, path).drop("spans_sha256")


def encode_decode_span_digests(docs: DataFrame, path: str) -> DataFrame:
    """The same and spans_sha256, of begin and end of every piece as 64-bit little-endian numbers."""
    return _texts(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
