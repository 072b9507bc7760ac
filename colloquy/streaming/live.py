"""Around the commits of a live session: chunks of PCM in, messages out, latency."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DoubleType

from colloquy.functions.vectors import rms
from colloquy.operators.words import line_message


class Chunks(SimpleDataSourceStreamReader):
    """Offsets count chunks; a replay reads the same chunks again."""

    def __init__(self, path: str, chunk_bytes: int):
        self.path, self.size = path, chunk_bytes

    def _rows(self, start: int, end: int | None) -> list[tuple]:
        out = []
        with open(self.path, "rb") as f:
            f.seek(start * self.size)
            while end is None or start + len(out) < end:
                data = f.read(self.size)
                if not data:
                    break
                out.append((start + len(out), data))
        return out

    def initialOffset(self) -> dict:
        return {"chunk": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._rows(start["chunk"], start["chunk"] + 16)
        return iter(rows), {"chunk": start["chunk"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._rows(start["chunk"], end["chunk"]))


class PcmSource(DataSource):
    """A growing file of 16-bit samples as a stream of (chunk, data): what a socket would deliver.
    Options: path, chunkBytes (16000: half a second at 16 kHz)."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return "chunk long, data binary"

    def simpleStreamReader(self, schema) -> Chunks:
        return Chunks(self.options["path"], int(self.options.get("chunkbytes", self.options.get("chunkBytes", 16000))))


def pcm_levels(chunks: DataFrame) -> DataFrame:
    """chunk, samples and rms of chunks of little-endian 16-bit PCM, samples scaled to [-1, 1)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def unpack(data: pd.Series) -> pd.Series:
        return pd.Series([(np.frombuffer(d[: len(d) // 2 * 2], "<i2") / 32768).tolist() for d in data])

    return chunks.select("chunk", unpack("data").alias("samples")).withColumn("rms", rms(F.col("samples")))


class BoxResampler:
    """Averages runs of input samples to a lower rate; what a chunk leaves over carries into the next."""

    def __init__(self, source: int, target: int):
        if target > source:
            raise ValueError("only downwards")
        self.ratio, self.at, self.left = source / target, 0.0, np.zeros(0)

    def feed(self, chunk) -> np.ndarray:
        x = np.concatenate([self.left, np.asarray(chunk, float)])
        out, at = [], self.at
        while at + self.ratio <= len(x):
            low, high = int(at), max(int(at) + 1, int(at + self.ratio))
            out.append(x[low:high].mean())
            at += self.ratio
        used = int(at)
        self.left, self.at = x[used:], at - used
        return np.array(out)


def messages(committed: DataFrame, text: str = "text") -> DataFrame:
    """rec and a JSON message for each committed line (speaker, start_us, end_us, text, overlap)."""
    return committed.select("rec", line_message(F.col("speaker"), F.col("start_us"), F.col("end_us"), F.col(text), F.col("overlap")).alias("message"))


def send(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to sink, one at a time: a slow sink holds the next batch back."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latency(batches: DataFrame) -> DataFrame:
    """rec, mean_us, max_us of committed lines (end_us, committed_at_us)."""
    late = F.col("committed_at_us") - F.col("end_us")
    return batches.groupBy("rec").agg(F.avg(late).alias("mean_us"), F.max(late).alias("max_us"))
