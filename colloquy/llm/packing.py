"""Packing of tokenised documents into sequences of fixed capacity by the sum-of-squares rule.

Rows in: doc_id and text, further columns ignored. A null or empty text is the end id alone. A
document longer than the capacity is cut into full pieces; its first piece takes what is left over.
Repeated rows are packed as rows of their own.

The sum-of-squares rule places a piece where the sum, over residual gaps, of the squared number of
open sequences with that gap becomes smallest. Only lengths matter to it, and there are at most
`capacity` of them, so it runs on the whole histogram of lengths, long ones first, with the true counts of open
sequences. The pieces of a length go in at most BUNDLES bundles: one by one up to that count, else by
bundles for which the rule decides once. Work and memory on the driver are thus bounded whatever the number of
documents (capacity times BUNDLES decisions), and each piece finds its place from its rank
among the pieces of its length: task counts, prefix sums over tasks, and a search in the packings.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import staged

BUNDLES = 512

_encoders: dict = {}


def byte_bpe(path: str):
    """An encoder for a byte-level BPE vocabulary in tokenizers' JSON format, built on tiktoken: ids
    are merge ranks there, so both give the same ids. The file's added tokens get their own ids
    wherever a text holds them, and part it."""
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        added = spec.get("added_tokens", [])
        if any(x[flag] for x in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that look at their neighbours")
        special = {x["content"]: x["id"] for x in added}
        ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


def _cut(path: str, end_id: int, capacity: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, seen = byte_bpe(path), TaskContext.get().partitionId(), Counter()
        for batch in frames:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = np.array([*encoder.encode(text.as_py() or "", allowed_special="all"), end_id], dtype="<u4")
                start, piece = 0, 0
                length = len(ids) % capacity or min(capacity, len(ids))
                while start < len(ids):
                    out.append((doc_id.as_py(), piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), task, seen[length]))
                    seen[length] += 1
                    start, piece, length = start + length, piece + 1, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in PIECES.split(", ")])

    return run


def pack_histogram(counts: dict[int, int], capacity: int, bundles: int = BUNDLES) -> list[tuple[tuple[int, ...], int]]:
    """Packings (lengths in a sequence, how many such sequences) for counts pieces of each length. Ties
    go to the smallest gap, a new sequence last; of equal gaps the latest sequence is filled."""
    number = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap
    # runs of like sequences by gap, the latest last: their lengths and how many they are
    runs: list[list[list]] = [[] for _ in range(capacity + 1)]
    for size in sorted((k for k, n in counts.items() if n), reverse=True):
        left, bundle, rest = counts[size], -(-counts[size] // bundles), capacity - size
        while left:
            can = np.flatnonzero(number[size:capacity]) + size
            gap, want = capacity, min(bundle, left)
            if can.size:
                # leaving a gap lessens the sum by 2N-1; entering another adds 2N+1, a closed one nothing
                change = 1 - 2 * number[can] + np.where(can > size, 2 * number[can - size] + 1, 0)
                at = int(np.argmin(change))
                if change[at] <= (2 * number[rest] + 1 if rest else 0):
                    gap = int(can[at])
            elif rest < size:
                want = left  # no choice for any of them
            if gap == capacity:
                runs[rest].append([(size,), want])
                number[rest] += want
                left -= want
                continue
            want = min(want, int(number[gap]))
            number[gap] -= want
            number[gap - size] += want
            left -= want
            while want:
                sizes, n = runs[gap][-1]
                taken = min(n, want)
                if taken == n:
                    runs[gap].pop()
                else:
                    runs[gap][-1][1] -= taken
                runs[gap - size].append([(*sizes, size), taken])
                want -= taken
    out: Counter = Counter()
    for gap in runs:
        for sizes, n in gap:
            out[sizes] += n
    return sorted(out.items())


def _places(packings: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: the rank at which each packing's places begin, places in one sequence, the first
    sequence's number, and the offsets of the places."""
    rows: dict[int, list] = {}
    first = 0
    for sizes, times in packings:
        at, mine = 0, {}
        for s in sizes:
            mine.setdefault(s, []).append(at)
            at += s
        for s, offsets in mine.items():
            rows.setdefault(s, []).append((len(offsets) * times, len(offsets), first, offsets))
        first += times
    out = {}
    for s, r in rows.items():
        begin = np.r_[0, np.cumsum([x[0] for x in r])[:-1]]
        per = np.array([x[1] for x in r])
        at = np.r_[0, np.cumsum(per)[:-1]]
        out[s] = (begin, per, np.array([x[2] for x in r]), at, np.concatenate([x[3] for x in r]))
    return out


def _seat(places):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = places.value
        for batch in frames:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for s in np.unique(length).tolist():
                mine = np.flatnonzero(length == s)
                begin, per, first, at, offsets = table[s]
                k = np.searchsorted(begin, rank[mine], side="right") - 1
                inside = rank[mine] - begin[k]
                sequence[mine] = first[k] + inside // per[k]
                offset[mine] = offsets[at[k] + inside % per[k]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(texts.mapInArrow(_cut(tokenizer, end_id, capacity), PIECES), "pieces")
    counts = staged(pieces.groupBy("task", "length").count(), "counts")
    # at most `capacity` rows
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("count")).collect()}
    places = spark.sparkContext.broadcast(_places(pack_histogram(histogram, capacity)))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("task", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    # before grows with the number of tasks: a merge join at every size
    return pieces.join(before.hint("merge"), ["task", "length"]).mapInArrow(_seat(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
