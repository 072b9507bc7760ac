"""Relations and their conventions.

Times are BIGINT microseconds since the start of a recording, rounded once when a double of seconds
comes in. Spans are half open. Every relation carries `rec`; every order has a total key; speakers sort by the number they end in, then
as strings. turns(rec, speaker, start_us, end_us) may overlap; segments(rec, start_us, end_us,
speakers) do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(seconds: Column) -> Column:
    """Seconds as whole microseconds, half away from zero."""
    return F.round(seconds * 1e6).cast("long")


def natural(speaker: Column) -> Column:
    """Sort key of a speaker: trailing number (none first), then the string."""
    return F.struct(F.regexp_extract(speaker, r"(\d{1,18})$", 1).try_cast("long").alias("n"), speaker.alias("s"))


def sorted_speakers(speakers: Column) -> Column:
    return F.transform(F.array_sort(F.transform(speakers, natural)), lambda x: x["s"])


def event_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: rec = day, speaker = user, span = ts for value seconds; event_id kept."""
    e = table(spark, sf_dir, "events").where("ts is not null and value > 0")
    start = F.expr("timestampdiff(MICROSECOND, date_trunc('day', ts), ts)")
    out = e.select(F.date_format("ts", "yyyy-MM-dd").alias("rec"), F.col("user_id").cast("string").alias("speaker"), start.alias("start_us"), micros(F.col("value")).alias("length_us"), "event_id", "event_type")
    return out.select("rec", "speaker", "start_us", (F.col("start_us") + F.col("length_us")).alias("end_us"), "event_id", "event_type").where("end_us > start_us")


def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as utterances: rec = conv_id, speaker = role, turn, text."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec"), F.col("role").alias("speaker"), "turn", "text")
