"""Reading and writing references, transcripts and audio."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from colloquy.functions.text import clean
from colloquy.functions.vectors import resampled
from colloquy.model import micros
from colloquy.operators.windowing import pathological_repeat
from colloquy.ship import ship

REFERENCE = "turns array<struct<speaker:string,start:double,end:double,text:string>>, diar_turns array<struct<speaker:string,start:double,end:double>>"


def read_rttm(spark: SparkSession, path: str) -> DataFrame:
    """rec (second field), speaker, start_us, end_us of the SPEAKER lines with at least eight fields."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 8) & (F.col("f")[0] == "SPEAKER"))
    start = micros(F.col("f")[3].cast("double"))
    return rows.select(F.col("f")[1].alias("rec"), F.col("f")[7].alias("speaker"), start.alias("start_us"), (start + micros(F.col("f")[4].cast("double"))).alias("end_us"))


def _reference(spark: SparkSession, path: str) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.json$", "")
    return spark.read.schema(REFERENCE).json(path, multiLine=True).withColumn("rec", name)


def _turns(df: DataFrame, column) -> DataFrame:
    t = df.select("rec", F.explode(column).alias("t"))
    return t.select("rec", "t.speaker", micros(F.col("t.start")).alias("start_us"), micros(F.col("t.end")).alias("end_us"), "t.text")


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """rec (file name), speaker, start_us, end_us, text."""
    return _turns(_reference(spark, path), F.col("turns"))


def read_diarization(spark: SparkSession, path: str) -> DataFrame:
    """Diarization turns where a file has some, else its transcript turns."""
    plain = F.transform("turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["start"].alias("start"), t["end"].alias("end"), F.lit(None).cast("string").alias("text")))
    own = F.transform("diar_turns", lambda t: F.struct(t["speaker"].alias("speaker"), t["start"].alias("start"), t["end"].alias("end"), F.lit(None).cast("string").alias("text")))
    return _turns(_reference(spark, path), F.when(F.size("diar_turns") > 0, own).otherwise(plain)).drop("text")


def with_text(turns: DataFrame) -> DataFrame:
    return turns.where(F.trim("text") != "")


def read_utterances(spark: SparkSession, path: str, rec: str | None = None) -> DataFrame:
    """rec, speaker, start_us, end_us, text of Parquet shards (meeting_id, speaker_id, begin_time, end_time,
    text); only these columns are read and an equality on the recording reaches the scan."""
    df = spark.read.parquet(path)
    if rec is not None:
        df = df.where(F.col("meeting_id") == rec)
    return df.select(F.col("meeting_id").alias("rec"), F.col("speaker_id").alias("speaker"), micros(F.col("begin_time")).alias("start_us"), micros(F.col("end_time")).alias("end_us"), "text").where(F.trim("text") != "")


def read_meetings(spark: SparkSession, path: str, rec: str | None = None, drop_repeats: bool = False) -> DataFrame:
    """Utterances of Parquet shards for training: text cleaned; those left empty go and, if asked for, those that
    repeat one word too often."""
    u = read_utterances(spark, path, rec).withColumn("text", clean(F.col("text"))).where("text <> ''")
    return u.where(~pathological_repeat(F.split("text", " "))) if drop_repeats else u


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """rec, speaker, start_us, end_us from parallel arrays timestamps_start, timestamps_end, speakers."""
    df = spark.read.parquet(path)
    z = df.select(F.col("rec"), F.explode(F.arrays_zip("speakers", "timestamps_start", "timestamps_end")).alias("z"))
    return z.select("rec", F.col("z.speakers").alias("speaker"), micros(F.col("z.timestamps_start")).alias("start_us"), micros(F.col("z.timestamps_end")).alias("end_us"))


def shuffled(rows: DataFrame, key: str, seed: int, n: int, min_us: int = 0, max_us: int | None = None) -> DataFrame:
    """n rows in a seeded order, of lengths within bounds."""
    length = F.col("end_us") - F.col("start_us")
    some = rows.where(length >= min_us)
    if max_us is not None:
        some = some.where(length <= max_us)
    return some.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def match_files(left: DataFrame, right: DataFrame, keep_left: bool = False) -> DataFrame:
    """Two listings (path) joined by file name: name, left, right."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    a, b = left.select(name("path").alias("name"), F.col("path").alias("left")), right.select(name("path").alias("name"), F.col("path").alias("right"))
    return a.join(b, "name", "left" if keep_left else "inner")


def separation_cases(files: DataFrame, limit: int | None = None) -> DataFrame:
    """name, mix, first, second of a listing (path) in either layout: folders mix_clean, mix_both or mix_single, s1 and s2 with files of one name
    in each (name: the file's), or a folder for each case with mix.wav, s1.wav and s2.wav (name: the folder's). In order of name, the first limit of them."""
    parts = F.split("path", "/")
    file, folder = F.element_at(parts, -1), F.element_at(parts, -2)
    inside = F.regexp_replace(file, r"\.wav$", "")
    by_role = F.when(folder.isin("mix_clean", "mix_both", "mix_single", "s1", "s2"), F.struct(file.alias("name"), folder.alias("role"), F.lit("folders").alias("layout")))
    by_case = F.when(inside.isin("mix", "s1", "s2"), F.struct(folder.alias("name"), inside.alias("role"), F.lit("cases").alias("layout")))
    told = files.where(F.size(parts) >= 2).select("path", F.coalesce(by_role, by_case).alias("c")).where("c is not null").select("path", "c.*")
    role = lambda *names: F.min(F.when(F.col("role").isin(*names), F.col("path")))
    cases = told.groupBy("layout", "name").agg(role("mix", "mix_clean", "mix_both", "mix_single").alias("mix"), role("s1").alias("first"), role("s2").alias("second"))
    whole = cases.where("mix is not null and first is not null and second is not null").select("name", "mix", "first", "second")
    return whole if limit is None else whole.orderBy("name", "mix").limit(limit)


def wav_samples(data: bytes) -> tuple[int, list[float]]:
    """Rate and mono samples of a PCM WAV file of 8, 16 or 32 bits; channels are averaged."""
    with wave.open(io.BytesIO(data)) as w:
        width, raw = w.getsampwidth(), w.readframes(w.getnframes())
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
        return w.getframerate(), x.reshape(-1, w.getnchannels()).mean(axis=1).tolist()


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.round(np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(StructType([StructField("rate", IntegerType()), StructField("samples", ArrayType(DoubleType()))]))
def decode_wav(content: pd.Series) -> pd.DataFrame:
    rows = [wav_samples(c) for c in content]
    return pd.DataFrame({"rate": [r[0] for r in rows], "samples": [r[1] for r in rows]})


@F.pandas_udf(BinaryType())
def encode_wav(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([wav_bytes(s, int(r)) for s, r in zip(samples, rate, strict=True)])


@F.pandas_udf(ArrayType(DoubleType()))
def _at_rate(samples: pd.Series, source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([resampled(np.asarray(x, float), int(a), int(b)).tolist() for x, a, b in zip(samples, source, target, strict=True)])


def read_wav(spark: SparkSession, path: str, rate: int | None = None) -> DataFrame:
    """rec (path), rate, samples: mono, resampled where a rate is asked for."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    read = files.select(F.col("path").alias("rec"), decode_wav("content").alias("w")).select("rec", "w.rate", "w.samples")
    return read if rate is None else read.select("rec", F.lit(rate).alias("rate"), _at_rate("samples", "rate", F.lit(rate)).alias("samples"))


def write_transcript(lines: DataFrame, path: str) -> None:
    """Rendered lines (rec, start_us, line), a folder for each recording, in order."""
    lines.repartition("rec").sortWithinPartitions("rec", "start_us", "line").select("rec", F.col("line").alias("value")).write.partitionBy("rec").text(path)


def write_reference(turns: DataFrame, path: str) -> None:
    """One JSON object for each recording: rec and its turns in order, times in seconds."""
    seconds = lambda c: F.col(c) / 1e6
    t = F.array_sort(F.collect_list(F.struct(seconds("start_us").alias("start"), seconds("end_us").alias("end"), "speaker", "text")))
    turns.groupBy("rec").agg(t.alias("turns")).write.json(path)


def write_truth(mixtures: DataFrame, path: str) -> None:
    """One JSON object for each of mixtures(id, rate, snr_db, first_us, offset_us, second_us): what a mixture of two clips
    is made of, times in seconds; first_us and second_us are lengths, overlap is null where the clips do not meet."""
    s = lambda c: (c / 1e6)
    first, begin, end = F.col("first_us"), F.col("offset_us"), F.col("offset_us") + F.col("second_us")
    turn = lambda who, a, b: F.struct(F.lit(who).alias("speaker"), s(a).alias("start"), s(b).alias("end"))
    meet = F.when(begin < F.least(first, end), F.array(s(begin), s(F.least(first, end))))
    mixtures.select("id", F.col("rate").alias("sample_rate"), "snr_db", F.array(turn("s1", F.lit(0), first), turn("s2", begin, end)).alias("turns"), meet.alias("overlap")).write.option("ignoreNullFields", "false").json(path)


def write_pairs(rows: DataFrame, path: str) -> None:
    """One JSON object for each recognised utterance of rows(rec, ref, hyp): meeting, ref in lower case, hyp trimmed."""
    rows.select(F.col("rec").alias("meeting"), F.lower("ref").alias("ref"), F.trim("hyp").alias("hyp")).write.json(path)


def replay(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder as a stream, a few for each trigger."""
    ship(spark)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_windows(windows: DataFrame, path: str) -> None:
    """windows(rec, speaker, window, samples, parts) as Parquet with the running byte offset that each would
    have in one file of 16-bit samples: offset, length. parts: [(start, end, text)] of the window."""
    from colloquy.operators.windowing import running_offset

    sized = windows.withColumn("length", F.size("samples").cast("long"))
    running_offset(sized.withColumn("_bytes", 2 * F.col("length")), ["rec"], ["speaker", "window"], "_bytes").drop("_bytes").write.parquet(path)


def read_windows(spark: SparkSession, path: str, first: int = 0, n: int | None = None) -> DataFrame:
    """Windows with samples[first : first + n]; other columns as written."""
    df = spark.read.parquet(path)
    end = F.size("samples") if n is None else F.lit(n)
    return df.withColumn("samples", F.slice("samples", F.lit(first + 1), end))


def discover(samples: DataFrame, audio: DataFrame, truth: DataFrame) -> DataFrame:
    """Curated samples (id, title) that have an audio file (path) named by their id, with their truth file if there is
    one and its distinct speakers: id, title, audio, truth, speakers. truth: path, speaker."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    a = audio.select(stem.alias("id"), F.col("path").alias("audio"))
    t = truth.groupBy(stem.alias("id")).agg(F.min("path").alias("truth"), F.count_distinct("speaker").alias("speakers"))
    return samples.join(a, "id").join(t, "id", "left").select("id", "title", "audio", "truth", F.coalesce("speakers", F.lit(0)).alias("speakers"))
