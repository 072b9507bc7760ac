"""The live step: a rolling window of every session's turns to newly committed segments, once and for good.

A micro-batch holds rows heard(rec, label, start_us, end_us, flush): turns as a diarizer labels the window, in
absolute time; a row without a label only carries the time heard (end_us) or a flush. For each session with enough new
time, labels become identities (time shared with the step before, then voices), turns are clipped to
[committed, horizon), cut to segments, and told whether a speaker goes on across their edges: on the left also from the
last segment of an earlier step, on the right, where the step's last segment ends, always unless the session is flushed.

State is relations in a folder, keyed by rec, one version for each batch: a batch that runs again starts from the
version before and writes the same, so every segment is put out once. Versions but the last two are deleted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colloquy.operators.intervals import build_segments, neighbours_continue
from colloquy.streaming.commit import GUARD, HOP, WINDOW
from colloquy.streaming.registry import KNOWN, Embed, carried, identify, learn, prints

#: State relations and their columns; all but the first are read by rec only.
STATE = {
    "sessions": "rec string, committed_us long, heard_us long",
    "known": KNOWN,
    "window": "rec string, speaker string, start_us long, end_us long",
    "last": "rec string, start_us long, end_us long, speakers array<string>",
}


def rolling(turns: DataFrame, heard: DataFrame, window_us: int = WINDOW) -> DataFrame:
    """The parts of turns within the last window_us that each session heard (rec, heard_us)."""
    low = F.greatest(F.lit(0), F.col("heard_us") - window_us)
    parts = turns.join(heard.select("rec", "heard_us"), "rec")
    return parts.withColumns({"start_us": F.greatest("start_us", low), "end_us": F.least("end_us", "heard_us")}).where("end_us > start_us").drop("heard_us")


def step(heard: DataFrame, state: dict[str, DataFrame], embed: Embed, hop_us: int = HOP, guard_us: int = GUARD, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Segments committed now (rec, start_us, end_us, speakers, from_before, into_next) and the state after. keep(table, name)
    may write what several results are made of and give it back as read."""
    told = heard.groupBy("rec").agg(F.max("end_us").alias("newest_us"), F.max(F.coalesce("flush", F.lit(False))).alias("flush"))
    s = told.join(state["sessions"], "rec", "full").select("rec", F.coalesce("committed_us", F.lit(0)).cast("long").alias("committed_us"), F.greatest(F.coalesce("newest_us", F.lit(0)), F.coalesce("heard_us", F.lit(0))).cast("long").alias("heard_us"), F.coalesce("flush", F.lit(False)).alias("flush"))
    s = s.withColumn("horizon_us", F.when(F.col("flush"), F.col("heard_us")).otherwise(F.col("heard_us") - guard_us))
    s = s.withColumn("ready", (F.col("horizon_us") > F.col("committed_us")) & (F.col("flush") | (F.col("horizon_us") - F.col("committed_us") >= hop_us)))
    s = keep(s, "told")
    due = s.where("ready").select("rec", "committed_us", "horizon_us", "flush")

    turns = heard.where("label is not null").join(due.select("rec"), "rec", "left_semi").select("rec", F.col("label").alias("speaker"), "start_us", "end_us")
    labels = turns.join(due, "rec").where((F.col("end_us") > F.col("committed_us")) & (F.col("start_us") < F.col("horizon_us"))).select("rec", "speaker").distinct()
    here = turns.join(labels, ["rec", "speaker"], "left_semi")
    now = prints(turns, embed).join(labels.withColumnRenamed("speaker", "label"), ["rec", "label"], "left_semi")
    now = keep(now, "prints")
    who = keep(identify(now, state["known"], carried(here, state["window"])), "who")
    named = here.withColumnRenamed("speaker", "label").join(who, ["rec", "label"]).select("rec", "speaker", "start_us", "end_us")

    clipped = named.join(due, "rec").withColumns({"start_us": F.greatest("start_us", "committed_us"), "end_us": F.least("end_us", "horizon_us")}).where("end_us > start_us")
    fresh = build_segments(clipped.select("rec", "speaker", "start_us", "end_us"))
    with_last = fresh.withColumn("old", F.lit(False)).unionByName(state["last"].join(due.select("rec"), "rec", "left_semi").withColumn("old", F.lit(True)))
    final = F.row_number().over(W.partitionBy("rec").orderBy(F.desc("start_us"), F.desc("end_us"))) == 1
    out = neighbours_continue(with_last).withColumn("final", final).where("not old").join(due.select("rec", "flush"), "rec")
    out = keep(out.select("rec", "start_us", "end_us", "speakers", "from_before", (F.col("into_next") | (F.col("final") & ~F.col("flush"))).alias("into_next")), "out")

    stays = lambda name: state[name].join(due.select("rec"), "rec", "left_anti")
    latest = out.groupBy("rec").agg(F.max_by(F.struct("start_us", "end_us", "speakers"), F.struct("start_us", "end_us")).alias("m")).select("rec", "m.*")
    after = {
        "sessions": s.select("rec", F.when(F.col("ready"), F.col("horizon_us")).otherwise(F.col("committed_us")).alias("committed_us"), "heard_us"),
        "known": learn(state["known"], now, who),
        "window": stays("window").unionByName(named),
        "last": state["last"].join(latest, "rec", "left_anti").unionByName(latest),
    }
    return out, after


class Live:
    """Steps over the micro-batches of a stream, with state in a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str, embed: Embed, sink: Callable[[DataFrame, int], None], hop_us: int = HOP, guard_us: int = GUARD):
        self.spark, self.folder, self.embed, self.sink, self.hop, self.guard = spark, folder.rstrip("/"), embed, sink, hop_us, guard_us

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _version(self, batch: int) -> dict[str, DataFrame]:
        fs, p = self._files(f"{self.folder}/{batch}/_done")
        if batch < 0 or not fs.exists(p):
            return {name: self.spark.createDataFrame([], schema) for name, schema in STATE.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.folder}/{batch}/{name}") for name, schema in STATE.items()}

    def batch(self, heard: DataFrame, number: int) -> None:
        """One micro-batch: put out what it commits, then write the state after it."""
        heard = heard.persist()
        try:
            here = f"{self.folder}/{number}"

            def keep(table: DataFrame, name: str) -> DataFrame:
                table.write.mode("overwrite").parquet(f"{here}/{name}")
                return self.spark.read.schema(table.schema).parquet(f"{here}/{name}")

            out, after = step(heard, self._version(number - 1), self.embed, self.hop, self.guard, keep)
            for name, table in after.items():
                table.write.mode("overwrite").parquet(f"{here}/{name}")
            fs, done = self._files(f"{here}/_done")
            fs.create(done, True).close()
            self.sink(out, number)
            fs, old = self._files(f"{self.folder}/{number - 2}")
            fs.delete(old, True)
        finally:
            heard.unpersist()

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Micro-batches run one at a time: a slow step holds the next one back."""
        return stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

