"""Packing, windows and running totals over ordered rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.scan import Rows, ordered_scan

SECOND = 1_000_000
# Defaults in microseconds.
PACK_MAX, PACK_GAP = 28 * SECOND, SECOND
WINDOW_MAX, WINDOW_PAD, WINDOW_GAP, TICK = 28 * SECOND, 150_000, 5 * SECOND, 20_000
CENTROID_CAP, CENTROID_MIN = 30 * SECOND, 500_000


def pack_clips(clips: DataFrame, max_us: int = PACK_MAX, gap_us: int = PACK_GAP) -> DataFrame:
    """clips(rec, id, length_us) in order of id to windows: rec, id, length_us, window, offset_us. A window
    is closed when the next clip after a gap would pass max_us; a clip too long stands alone."""

    def scan(rows: Rows) -> Iterator[tuple]:
        window, used = -1, None
        for r in rows:
            if used is None or used + gap_us + r["length_us"] > max_us:
                window, offset = window + 1, 0
            else:
                offset = used + gap_us
            used = offset + r["length_us"]
            yield r["rec"], r["id"], r["length_us"], window, offset

    return ordered_scan(clips.select("rec", "id", "length_us"), ["rec"], ["id"], scan, "rec string, id long, length_us long, window long, offset_us long")


def unpack(packed: DataFrame, words: DataFrame) -> DataFrame:
    """Words recognised in windows (rec, window, word, start_us, end_us) back to the clips that hold
    their midpoints: rec, id, word, start_us, end_us within the clip."""
    p, w = packed.alias("p"), words.alias("w")
    twice = F.col("w.start_us") + F.col("w.end_us")
    on = (F.col("p.rec") == F.col("w.rec")) & (F.col("p.window") == F.col("w.window")) & (twice >= 2 * F.col("p.offset_us")) & (twice < 2 * (F.col("p.offset_us") + F.col("p.length_us")))
    return w.join(p, on).select("p.rec", "p.id", "w.word", (F.col("w.start_us") - F.col("p.offset_us")).alias("start_us"), (F.col("w.end_us") - F.col("p.offset_us")).alias("end_us"))


def make_windows(utterances: DataFrame, max_us: int = WINDOW_MAX, pad_us: int = WINDOW_PAD, gap_us: int = WINDOW_GAP) -> DataFrame:
    """utterances(rec, id, stretch, start_us, end_us) in order of start to training windows: rec, id, window,
    window_start_us. A new one begins with another stretch, past max_us, or after a gap over gap_us."""

    def scan(rows: Rows) -> Iterator[tuple]:
        window, start, end, stretch = -1, 0, 0, None
        for r in rows:
            new = window < 0 or r["stretch"] != stretch or max(end, r["end_us"]) + pad_us - start > max_us or r["start_us"] - end > gap_us
            if new:
                window, start, end, stretch = window + 1, r["start_us"] - pad_us, r["end_us"], r["stretch"]
            end = max(end, r["end_us"])
            yield r["rec"], r["id"], window, start

    return ordered_scan(utterances.select("rec", "id", "stretch", "start_us", "end_us"), ["rec"], ["start_us", "end_us", "id"], scan, "rec string, id long, window long, window_start_us long")


def window_segments(members: DataFrame, tick_us: int = TICK, least_us: int = 100_000, pad_us: int = WINDOW_PAD) -> DataFrame:
    """members(rec, window, id, start_us, end_us, window_start_us) to quantised spans within their window:
    each starts no earlier than the one before ended, lasts least_us or more if the window has room, and ends
    within the window, which reaches pad_us beyond its last end. Spans that are empty after that go. One window's
    rows are held at a time; make_windows bounds them."""

    def scan(rows: Rows) -> Iterator[tuple]:
        mine, last = list(rows), 0
        grid = lambda t: (t + tick_us // 2) // tick_us * tick_us
        room = max(r["end_us"] for r in mine) + pad_us - mine[0]["window_start_us"]
        for r in mine:
            start = grid(max(r["start_us"] - r["window_start_us"], last))
            end = grid(min(max(r["end_us"] - r["window_start_us"], start + least_us), room))
            if end > start:
                yield r["rec"], r["window"], r["id"], start, end
                last = end

    return ordered_scan(members.select("rec", "window", "id", "start_us", "end_us", "window_start_us"), ["rec", "window"], ["start_us", "end_us", "id"], scan, "rec string, window long, id long, start_us long, end_us long")


def longest_run(words: Column) -> Column:
    """Length of the longest run of one word."""
    state = F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        n = F.when(s["w"].eqNullSafe(w), s["n"] + 1).otherwise(1)
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(s["most"], n).alias("most"))

    return F.aggregate(words, state, step, lambda s: s["most"])


def pathological_repeat(words: Column, most: int = 4) -> Column:
    return longest_run(words) > most


def first_appearance(turns: DataFrame) -> DataFrame:
    """rec, speaker, label: speakers numbered by first start."""
    first = turns.groupBy("rec", "speaker").agg(F.min("start_us").alias("first_us"))
    n = F.row_number().over(W.partitionBy("rec").orderBy("first_us", "speaker"))
    return first.select("rec", "speaker", F.concat(F.lit("Speaker_"), n.cast("string")).alias("label"))


def running_offset(rows: DataFrame, keys: list[str], order: list[str], size: str) -> DataFrame:
    """rows with offset: the exclusive running total of size."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(before), F.lit(0)))


def longest_first(spans: DataFrame, min_us: int = CENTROID_MIN, cap_us: int = CENTROID_CAP) -> DataFrame:
    """Per (rec, speaker), spans of at least min_us, longest first, until their total reaches cap_us; the
    one that reaches it is in. Columns rec, speaker, id, start_us, end_us."""
    length = F.col("end_us") - F.col("start_us")
    before = W.partitionBy("rec", "speaker").orderBy(F.desc("length_us"), "start_us", "id").rowsBetween(W.unboundedPreceding, -1)
    some = spans.withColumn("length_us", length).where(F.col("length_us") >= min_us)
    return some.withColumn("_before", F.coalesce(F.sum("length_us").over(before), F.lit(0))).where(F.col("_before") < cap_us).select("rec", "speaker", "id", "start_us", "end_us")


def spaced(total: Column, n: Column) -> Column:
    """n evenly spaced places of total, as an array."""
    return F.when((n <= 0) | (total <= 0), F.array().cast("array<long>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0).cast("long"), F.least(n, total).cast("long") - 1), lambda i: F.floor(i * total / F.least(n, total)).cast("long"))))


FRAME = 1 << 16


def timeline(clips: DataFrame, rate: int, frame: int = FRAME) -> DataFrame:
    """clips(rec, id, start_us, samples) laid on one timeline for each recording, later ones over earlier: rec,
    frame (its number; frames without a clip are left out), first (sample number) and samples. A frame holds at most
    `frame` samples and is built by itself, so a long recording is many small tasks; the last one ends with its last clip."""
    at = F.greatest(F.lit(0), F.floor(F.col("start_us") * rate / SECOND)).cast("long")
    some = clips.where(F.size("samples") > 0).select("rec", "id", "start_us", at.alias("at"), F.col("samples").cast("array<double>").alias("samples"))
    touched = F.sequence(F.floor(F.col("at") / frame), F.floor((F.col("at") + F.size("samples") - 1) / frame))
    cut = some.withColumn("frame", F.explode(touched)).withColumn("first", F.greatest("at", F.col("frame") * frame))
    part = F.slice("samples", (F.col("first") - F.col("at") + 1).cast("int"), F.least(F.lit(frame), (F.col("frame") + 1) * frame - F.col("first")).cast("int"))
    pieces = cut.select("rec", "frame", "start_us", "id", (F.col("first") - F.col("frame") * frame).alias("offset"), part.alias("part"))

    def scan(rows: Rows) -> Iterator[tuple]:
        out, rec, number, reach = np.zeros(frame), None, 0, 0
        for r in rows:
            rec, number = r["rec"], r["frame"]
            out[r["offset"] : r["offset"] + len(r["part"])] = r["part"]
            reach = max(reach, r["offset"] + len(r["part"]))
        yield rec, number, number * frame, out[:reach].tolist()

    return ordered_scan(pieces, ["rec", "frame"], ["start_us", "id"], scan, "rec string, frame long, first long, samples array<double>", batch=1)
