"""Further queries of the catalogue: crops, shifts, labels, levels, signals, listings and timelines, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.model import conversation_words, event_turns, table
from colloquy.operators import intervals as I
from colloquy.operators import matching as M
from colloquy.operators import windowing as N
from colloquy.operators import words as O
from colloquy.plans.catalogue import TURNS, WORDS, event_utterances, query
from colloquy.sources import files

HOUR = 3_600_000_000


@query(f"WITH {TURNS} SELECT rec, event_id, start_us, end_us FROM turns WHERE start_us >= {6 * HOUR} AND end_us <= {18 * HOUR}")
def contained_turns(spark, sf_dir):
    return I.contained(event_turns(spark, sf_dir), F.lit(6 * HOUR), F.lit(18 * HOUR)).select("rec", "event_id", "start_us", "end_us")


@query(f"WITH {TURNS} SELECT event_id, greatest(start_us, {6 * HOUR}) AS low_us, least(end_us, {18 * HOUR}) AS high_us FROM turns WHERE greatest(start_us, {6 * HOUR}) < least(end_us, {18 * HOUR})")
def common_parts(spark, sf_dir):
    part = I.span_overlap(F.col("start_us"), F.col("end_us"), F.lit(6 * HOUR), F.lit(18 * HOUR))
    return event_turns(spark, sf_dir).select("event_id", part.alias("p")).where("p is not null").select("event_id", F.col("p.start_us").alias("low_us"), F.col("p.end_us").alias("high_us"))


@query(
    f"""WITH {TURNS}, kept AS (SELECT *, row_number() OVER (PARTITION BY rec, speaker ORDER BY start_us, end_us, event_id) AS k, row_number() OVER (PARTITION BY rec, speaker ORDER BY start_us DESC, end_us DESC, event_id DESC) AS back
  FROM turns WHERE start_us + end_us >= {12 * HOUR} AND start_us + end_us < {36 * HOUR})
SELECT rec, speaker, string_agg(event_type, ' ' ORDER BY k) AS text, CAST(min(start_us) FILTER (k = 1) - {6 * HOUR} AS BIGINT) AS start_us, CAST(min(end_us) FILTER (back = 1) - {6 * HOUR} AS BIGINT) AS end_us, count(*) AS words FROM kept GROUP BY rec, speaker"""
)
def cropped_utterances(spark, sf_dir):
    """A user's words of a day, those of the hours from six to eighteen, in time from six on."""
    u = event_utterances(spark, sf_dir)
    u = u.select("rec", "speaker", O.shift_words(F.col("words"), F.lit(-6 * HOUR)).alias("words"))
    u = u.withColumns({"text": F.lit(""), "start_us": F.col("words")[0]["start_us"], "end_us": F.element_at("words", -1)["end_us"]})
    return O.crop(u, F.lit(0), F.lit(12 * HOUR)).select("rec", "speaker", "text", "start_us", "end_us", F.size("words").cast("long").alias("words"))


SECONDS = "CAST(({0} + 5000) // 10000 / 100.0 AS DOUBLE)"


@query(f"""WITH {TURNS} SELECT event_id, '{{"type":"line","speaker":"' || speaker || '","start":' || {SECONDS.format("start_us")} || ',"end":' || {SECONDS.format("end_us")} || ',"text":"' || event_type || '","overlap":' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS message FROM turns""")
def line_messages(spark, sf_dir):
    m = O.line_message(F.col("speaker"), F.col("start_us"), F.col("end_us"), F.col("event_type"), F.col("event_id") % 2 == 0)
    return event_turns(spark, sf_dir).select("event_id", m.alias("message"))


@query(f"WITH {TURNS} SELECT DISTINCT speaker, 'Speaker_' || (CAST(speaker AS BIGINT) + 1) AS label FROM turns")
def display_labels(spark, sf_dir):
    return event_turns(spark, sf_dir).select("speaker", T.display_label(F.concat(F.lit("SPEAKER_"), F.lpad("speaker", 6, "0"))).alias("label")).distinct()


@query(
    f"""WITH {TURNS}, l AS (SELECT DISTINCT rec, speaker FROM turns WHERE event_id % 2 = 0), r AS (SELECT DISTINCT rec, speaker FROM turns WHERE event_id % 2 = 1),
p AS (SELECT rec, speaker FROM l JOIN r USING (rec, speaker)),
a AS (SELECT rec, speaker, row_number() OVER (PARTITION BY rec ORDER BY speaker) AS n FROM (SELECT * FROM l EXCEPT SELECT * FROM p)), b AS (SELECT rec, speaker, row_number() OVER (PARTITION BY rec ORDER BY speaker) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM p))
SELECT rec, speaker AS "left", speaker AS "right" FROM p UNION ALL SELECT rec, a.speaker, b.speaker FROM a JOIN b USING (rec, n)"""
)
def leftover_pairs(spark, sf_dir):
    t = event_turns(spark, sf_dir)
    l, r = (t.where(f"event_id % 2 = {k}").select("rec", F.col("speaker").alias(side)).distinct() for k, side in ((0, "left"), (1, "right")))
    both = l.join(r, (l["rec"] == r["rec"]) & (F.col("left") == F.col("right"))).select(l["rec"], "left", "right")
    return M.pair_leftovers(both, l, r)


@query(
    f"""WITH {TURNS}, n AS (SELECT *, lead(start_us) OVER (PARTITION BY rec, speaker ORDER BY start_us, end_us, event_id) - end_us AS gap FROM turns)
SELECT rec, speaker, count(*) FILTER (gap >= 600000) AS pauses, count(*) FILTER (gap >= 600000) + 1 AS texts FROM n GROUP BY rec, speaker"""
)
def rendered_pauses(spark, sf_dir):
    """Parts of the rendered text of a user's day: pauses, and texts between them."""
    parts = T.rendered_parts(O.display_text(F.col("words")))
    p = event_utterances(spark, sf_dir).select("rec", "speaker", parts.alias("p"))
    count = lambda tag: F.size(F.filter("p", lambda x: x["pause"] == tag)).cast("long")
    return p.select("rec", "speaker", count(True).alias("pauses"), count(False).alias("texts"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, len(w) AS words, coalesce(len(w) > 2.8 * len(list_distinct(w)), false) AS repetitive FROM w""")
def repetitive_texts(spark, sf_dir):
    w = T.verbatim(F.col("text"))
    n, d = F.size("w").cast("long"), F.size(F.array_distinct("w"))
    return table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).select("doc_id", n.alias("words"), F.coalesce(O.compressible(n / F.when(d > 0, d)), F.lit(False)).alias("repetitive"))


@query(f"WITH {TURNS}, t AS (SELECT rec, event_id, event_type, end_us - start_us AS us FROM turns) SELECT rec, event_id FROM t QUALIFY max(us) OVER (PARTITION BY rec, event_type) > 0 AND us >= 0.1 * max(us) OVER (PARTITION BY rec, event_type)")
def loud_streams(spark, sf_dir):
    """Events of a day and type whose length is a tenth of the longest or more."""
    t = event_turns(spark, sf_dir).withColumn("rms", F.col("end_us") - F.col("start_us"))
    return O.loud_streams(t, ["rec", "event_type"]).select("rec", "event_id")


@query(f"WITH {TURNS} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN start_us ELSE greatest(start_us, {6 * HOUR}) END AS start_us FROM turns")
def floored_starts(spark, sf_dir):
    return event_turns(spark, sf_dir).select("event_id", O.start_floor(F.col("start_us"), F.lit(6 * HOUR), F.col("event_id") % 2 == 0).alias("start_us"))


@query("SELECT rec, list_sort(list_distinct(list_transform(range(least(7, n)), lambda i: i * n // least(7, n)))) AS places FROM (SELECT conv_id AS rec, count(*) AS n FROM conversations GROUP BY conv_id)")
def spaced_places(spark, sf_dir):
    """Seven evenly spaced turns of every conversation."""
    n = conversation_words(spark, sf_dir).groupBy("rec").count()
    return n.select("rec", N.spaced(F.col("count"), F.lit(7)).alias("places"))


@query(
    """SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'audio/' || c_custkey || '.wav' AS audio, CASE WHEN count(o_orderkey) > 0 THEN 'truth/' || c_custkey || '.json' END AS truth, count(DISTINCT o_orderpriority) AS speakers
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY c_custkey, c_name"""
)
def discovered_samples(spark, sf_dir):
    """Customers as samples; those of even number have audio, orders are the truth."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    path = lambda folder, key, end: F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(end)).alias("path")
    return files.discover(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title")), c.where("c_custkey % 2 = 0").select(path("audio/", "c_custkey", ".wav")), o.select(path("truth/", "o_custkey", ".json"), F.col("o_orderpriority").alias("speaker")))


@query("""SELECT c_custkey || '.wav' AS name, 'mix/' || c_custkey || '.wav' AS "left", 'clean/' || s_suppkey || '.wav' AS "right" FROM customer JOIN supplier ON c_custkey = s_suppkey""")
def matched_files(spark, sf_dir):
    path = lambda t, folder, key: table(spark, sf_dir, t).select(F.concat(F.lit(folder), F.col(key).cast("string"), F.lit(".wav")).alias("path"))
    return files.match_files(path("customer", "mix/", "c_custkey"), path("supplier", "clean/", "s_suppkey"))


SAMPLES = "x AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"WITH {SAMPLES} SELECT vec_id, round(sqrt(list_inner_product(e, e) / len(e)), 9) AS level, round(list_max(list_transform(e, lambda v: abs(greatest(-0.99, least(0.99, v * least(50.0, 0.05 / sqrt(list_inner_product(e, e) / len(e)))))))), 9) AS peak FROM x WHERE list_inner_product(e, e) > 0")
def normalized_levels(spark, sf_dir):
    """Embeddings as clips: their level, and their peak after normalising."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    peak = F.array_max(F.transform(V.normalize_rms(F.col("e")), lambda v: F.abs(v)))
    return e.where(V.rms(F.col("e")) > 0).select("vec_id", F.round(V.rms(F.col("e")), 9).alias("level"), F.round(peak, 9).alias("peak"))


@query(
    f"""WITH {SAMPLES}, p AS (SELECT vec_id, e, lead(e) OVER (PARTITION BY label ORDER BY vec_id) AS r FROM x),
c AS (SELECT vec_id, list_transform(e, lambda v: v - list_avg(e)) AS e, list_transform(r, lambda v: v - list_avg(r)) AS r FROM p WHERE r IS NOT NULL),
t AS (SELECT vec_id, e, list_transform(r, lambda v: v * list_inner_product(e, r) / (list_inner_product(r, r) + 1e-8)) AS t FROM c),
n AS (SELECT vec_id, t, list_transform(list_zip(e, t), lambda z: z[1] - z[2]) AS n FROM t)
SELECT vec_id, round(10 * log10((list_inner_product(t, t) + 1e-8) / (list_inner_product(n, n) + 1e-8)), 5) AS db FROM n"""
)
def signal_scores(spark, sf_dir):
    """Every clip against the next of its label."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    p = e.withColumn("r", F.lead("e").over(W.partitionBy("label").orderBy("vec_id"))).where("r is not null")
    return p.select("vec_id", F.round(V.si_sdr("e", "r"), 5).alias("db"))


@query(
    f"""WITH {SAMPLES}, s AS (SELECT label, vec_id, vec_id * 16 + unnest(range(len(e))) AS p, unnest(e) AS v FROM x),
l AS (SELECT label, p, arg_max(v, vec_id) AS v FROM s GROUP BY ALL),
ends AS (SELECT label, p // 4096 AS frame, max(p) AS last FROM l GROUP BY ALL),
every AS (SELECT label, frame, unnest(range(frame * 4096, last + 1)) AS p FROM ends)
SELECT CAST(label AS VARCHAR) AS rec, frame, min(p) AS first, count(*) AS samples, round(sum(coalesce(v, 0) * (1 + p % 7)), 6) AS weighed FROM every LEFT JOIN l USING (label, p) GROUP BY label, frame"""
)
def timelines(spark, sf_dir):
    """Clips of a label on one timeline, sixteen samples a second, a clip begun at its number's second; later ones over earlier."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    clips = e.select(F.col("label").cast("string").alias("rec"), F.col("vec_id").alias("id"), (F.col("vec_id") * 1_000_000).alias("start_us"), F.col("embedding").cast("array<double>").alias("samples"))
    weighed = F.aggregate(F.transform("samples", lambda v, i: v * (1 + (F.col("first") + i) % 7)), F.lit(0.0), lambda a, v: a + v)
    return N.timeline(clips, 16, frame=4096).select("rec", "frame", "first", F.size("samples").cast("long").alias("samples"), F.round(weighed, 6).alias("weighed"))
