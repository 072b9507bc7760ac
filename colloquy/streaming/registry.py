"""Speaker identities over time: the labels of one step matched to known voices, as relations.

Everything is keyed by rec, so one call serves the sessions of a whole batch. Relations: turns(rec,
speaker, start_us, end_us) with the step's own labels as speakers; previous, the same with identities;
known(rec, speaker, v, weight), where v is a weighted sum of unit vectors. A voice model is a function
embed(spans: rec, speaker, start_us, end_us) to (rec, speaker, v), one row for each speaker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions.vectors import cosine, unit
from colloquy.operators.intervals import build_segments, overlap_matrix
from colloquy.operators.matching import assign
from colloquy.operators.windowing import longest_first

# Defaults.
SIMILARITY, TEMPORAL_US, WEIGHT_CAP, WEAK_WEIGHT, PRINT_CAP_US = 0.4, 400_000, 120.0, 0.3, 20_000_000

KNOWN = "rec string, speaker string, v array<double>, weight double"
Embed = Callable[[DataFrame], DataFrame]


def carried(turns: DataFrame, previous: DataFrame, least_us: int = TEMPORAL_US) -> DataFrame:
    """rec, label, speaker: labels that share at least least_us with an identity of the step before, one to one."""
    shared = overlap_matrix(turns, previous).withColumnRenamed("shared_us", "score")
    return assign(shared, least_us).select("rec", F.col("left").alias("label"), F.col("right").alias("speaker"))


def prints(turns: DataFrame, embed: Embed, cap_us: int = PRINT_CAP_US) -> DataFrame:
    """rec, label, v, weight, weak, first_us: a vector of every label's speech alone, longest spans first until
    their total reaches cap_us. A label never heard alone is weak: its spans under others count for less."""
    spans = turns.select("rec", "speaker", "start_us", "end_us")
    solo = build_segments(spans).where(F.size("speakers") == 1).select("rec", F.col("speakers")[0].alias("speaker"), "start_us", "end_us")
    hidden = spans.join(solo.select("rec", "speaker").distinct(), ["rec", "speaker"], "left_anti")
    told = solo.withColumn("weak", F.lit(False)).unionByName(hidden.withColumn("weak", F.lit(True)))
    told = told.withColumn("id", F.xxhash64("start_us", "end_us"))
    used = longest_first(told, 0, cap_us).join(told.select("rec", "speaker", "weak").distinct(), ["rec", "speaker"])
    seconds = F.sum(F.col("end_us") - F.col("start_us")) / 1e6
    sized = used.groupBy("rec", "speaker", "weak").agg((seconds * F.when(F.col("weak"), WEAK_WEIGHT).otherwise(1.0)).alias("weight"))
    first = spans.groupBy("rec", "speaker").agg(F.min("start_us").alias("first_us"))
    heard = sized.join(embed(used.select("rec", "speaker", "start_us", "end_us")), ["rec", "speaker"]).join(first, ["rec", "speaker"])
    return heard.select("rec", F.col("speaker").alias("label"), "v", "weight", "weak", "first_us")


def identify(now: DataFrame, known: DataFrame, fixed: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """rec, label, speaker, fresh for every print in now. Fixed labels keep their identity; the others go to
    identities nobody holds, for the highest total similarity, from threshold up; what is left are new
    identities, numbered on from the known ones in order of first appearance."""
    held = fixed.join(now.select("rec", "label"), ["rec", "label"], "left_semi").select("rec", "label", "speaker")
    free = now.join(held, ["rec", "label"], "left_anti").select("rec", F.col("label").alias("left"), F.col("v").alias("a"))
    idle = known.join(held, ["rec", "speaker"], "left_anti").select("rec", F.col("speaker").alias("right"), F.col("v").alias("b"))
    near = free.join(idle, "rec").select("rec", "left", "right", cosine(F.col("a"), F.col("b")).alias("score"))
    found = held.unionByName(assign(near, threshold).select("rec", F.col("left").alias("label"), F.col("right").alias("speaker")))
    size = known.groupBy("rec").agg(F.count("*").alias("size"))
    order = F.row_number().over(W.partitionBy("rec").orderBy("first_us", "label"))
    new = now.join(found, ["rec", "label"], "left_anti").withColumn("nth", order).join(size, "rec", "left")
    named = new.select("rec", "label", F.concat(F.lit("Speaker_"), (F.coalesce("size", F.lit(0)) + F.col("nth")).cast("string")).alias("speaker"))
    return found.withColumn("fresh", F.lit(False)).unionByName(named.withColumn("fresh", F.lit(True)))


def learn(known: DataFrame, now: DataFrame, who: DataFrame, cap: float = WEIGHT_CAP) -> DataFrame:
    """known after a step: every print adds its unit vector by its weight to its identity, except a weak print to
    an identity known before. A weight above cap is scaled down to it with its vector, so old speech fades."""
    gains = now.join(who, ["rec", "label"]).where(F.col("fresh") | ~F.col("weak"))
    gains = gains.select("rec", "speaker", F.transform(unit(F.col("v")), lambda x: x * F.col("weight")).alias("gain_v"), F.col("weight").alias("gain"))
    both = known.join(gains, ["rec", "speaker"], "full")
    added = F.coalesce(F.zip_with("v", "gain_v", lambda a, b: a + b), F.col("v"), F.col("gain_v"))
    sums = both.select("rec", "speaker", added.alias("v"), (F.coalesce("weight", F.lit(0.0)) + F.coalesce("gain", F.lit(0.0))).alias("weight"))
    scale = F.least(F.lit(1.0), cap / F.col("weight"))
    return sums.select("rec", "speaker", F.transform("v", lambda x: x * scale).alias("v"), F.least("weight", F.lit(cap)).alias("weight"))
