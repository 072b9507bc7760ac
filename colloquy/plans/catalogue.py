"""One query for each operator over the fixture tables, and the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions.vectors import unit
from colloquy.model import conversation_words, event_turns, table
from colloquy.operators import intervals as I
from colloquy.operators import matching as M
from colloquy.operators import scoring as S
from colloquy.operators import windowing as N
from colloquy.operators import words as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(speakers: Column) -> Column:
    return F.array_join(speakers, "+").alias("speakers")


# Larger thresholds than the defaults, for spans of events are tens of seconds long.
LONG_OVERLAP, LONG_GAP, LONG_SPEECH = 20_000_000, 30_000_000, 10_000_000

TURNS = """turns AS (
  SELECT * FROM (SELECT strftime(ts, '%Y-%m-%d') AS rec, CAST(user_id AS VARCHAR) AS speaker, date_diff('microsecond', date_trunc('day', ts), ts) AS start_us,
    date_diff('microsecond', date_trunc('day', ts), ts) + CAST(round(value * 1e6) AS BIGINT) AS end_us, event_id, event_type
  FROM events WHERE ts IS NOT NULL AND value > 0) WHERE end_us > start_us)"""
PIECES = (
    TURNS
    + """,
cuts AS (SELECT rec, start_us AS t FROM turns UNION SELECT rec, end_us FROM turns),
spans AS (SELECT rec, t AS a, lead(t) OVER (PARTITION BY rec ORDER BY t) AS b FROM cuts),
pieces AS (SELECT s.rec, a AS start_us, b AS end_us, string_agg(DISTINCT speaker, '+' ORDER BY CAST(speaker AS BIGINT)) AS speakers
  FROM spans s JOIN turns t ON s.rec = t.rec AND t.start_us <= a AND a < t.end_us WHERE b IS NOT NULL GROUP BY ALL)"""
).replace("string_agg(DISTINCT speaker, '+' ORDER BY CAST(speaker AS BIGINT))", "array_to_string(list_transform(list_sort(list_distinct(list(CAST(speaker AS BIGINT)))), lambda x: CAST(x AS VARCHAR)), '+')")


def merged_sql(source: str, name: str, gap: int) -> str:
    return f""",
{name}_mark AS (SELECT *, CASE WHEN lag(speakers) OVER w = speakers AND start_us - lag(end_us) OVER w <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source} WINDOW w AS (PARTITION BY rec ORDER BY start_us, end_us)),
{name}_isle AS (SELECT *, sum(fresh) OVER (PARTITION BY rec ORDER BY start_us, end_us) AS isle FROM {name}_mark),
{name} AS (SELECT rec, min(start_us) AS start_us, max(end_us) AS end_us, any_value(speakers) AS speakers FROM {name}_isle GROUP BY rec, isle)"""


def segments_sql(overlap: int, gap: int, speech: int) -> str:
    one = "NOT contains({0}, '+') AND list_contains(string_split(s.speakers, '+'), {0})"
    return (
        PIECES
        + merged_sql("pieces", "first_merge", gap)
        + f""",
numbered AS (SELECT *, row_number() OVER w AS n, lead(speakers) OVER w AS after FROM first_merge WINDOW w AS (PARTITION BY rec ORDER BY start_us, end_us)),
fold AS (
  SELECT s.rec, s.n, s.start_us, s.end_us, CASE WHEN NOT contains(s.speakers, '+') OR s.end_us - s.start_us >= {overlap} THEN s.speakers
    WHEN s.after IS NOT NULL AND {one.format("s.after")} THEN s.after ELSE string_split(s.speakers, '+')[1] END AS speakers
  FROM numbered s WHERE n = 1
  UNION ALL
  SELECT s.rec, s.n, s.start_us, s.end_us, CASE WHEN NOT contains(s.speakers, '+') OR s.end_us - s.start_us >= {overlap} THEN s.speakers
    WHEN {one.format("f.speakers")} THEN f.speakers
    WHEN s.after IS NOT NULL AND {one.format("s.after")} THEN s.after ELSE string_split(s.speakers, '+')[1] END
  FROM fold f JOIN numbered s ON s.rec = f.rec AND s.n = f.n + 1)"""
        + merged_sql("fold", "second_merge", gap)
        + f""",
segments AS (SELECT rec, start_us, end_us, speakers FROM second_merge WHERE contains(speakers, '+') OR end_us - start_us >= {speech})"""
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_segments(event_turns(spark, sf_dir), LONG_OVERLAP, LONG_GAP, LONG_SPEECH)


SEGMENTS = segments_sql(LONG_OVERLAP, LONG_GAP, LONG_SPEECH)


@query(f"WITH {PIECES} SELECT rec, start_us, end_us, speakers FROM pieces")
def elementary_intervals(spark, sf_dir):
    return I.elementary(event_turns(spark, sf_dir)).withColumn("speakers", joined(F.col("speakers")))


@query(f"WITH {PIECES}{merged_sql('pieces', 'm', LONG_GAP)} SELECT rec, start_us, end_us, speakers FROM m")
def merge_gaps(spark, sf_dir):
    return I.merge(I.elementary(event_turns(spark, sf_dir)), LONG_GAP).withColumn("speakers", joined(F.col("speakers")))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT rec, start_us, end_us, speakers FROM segments")
def routing_segments(spark, sf_dir):
    return segments(spark, sf_dir).withColumn("speakers", joined(F.col("speakers")))


@query(f"WITH RECURSIVE {segments_sql(400_000, 400_000, 150_000)} SELECT rec, start_us, end_us, speakers FROM segments")
def routing_segments_default(spark, sf_dir):
    return I.build_segments(event_turns(spark, sf_dir)).withColumn("speakers", joined(F.col("speakers")))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT rec, CAST(sum(end_us - start_us) AS BIGINT) AS speech_us, CAST(sum(CASE WHEN contains(speakers, '+') THEN end_us - start_us ELSE 0 END) AS BIGINT) AS overlap_us, count(*) AS segments FROM segments GROUP BY rec")
def speech_totals(spark, sf_dir):
    return I.speech_totals(segments(spark, sf_dir))


@query(f"WITH RECURSIVE {SEGMENTS} SELECT CASE WHEN contains(speakers, '+') THEN 'overlap' ELSE 'single' END AS route, rec, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM segments GROUP BY ALL")
def routed_segments(spark, sf_dir):
    one, many = O.route(segments(spark, sf_dir))
    both = one.withColumn("route", F.lit("single")).unionByName(many.withColumn("route", F.lit("overlap")))
    return both.groupBy("route", "rec").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


HALVES = """,
l AS (SELECT rec, speaker, start_us, end_us FROM turns WHERE event_id % 2 = 0), r AS (SELECT rec, speaker, start_us, end_us FROM turns WHERE event_id % 2 = 1)"""


def halves(spark, sf_dir):
    t = event_turns(spark, sf_dir)
    return t.where("event_id % 2 = 0"), t.where("event_id % 2 = 1")


@query(f'WITH {TURNS}{HALVES} SELECT l.rec, l.speaker AS "left", r.speaker AS "right", CAST(sum(least(l.end_us, r.end_us) - greatest(l.start_us, r.start_us)) AS BIGINT) AS shared_us FROM l JOIN r ON l.rec = r.rec AND l.start_us < r.end_us AND r.start_us < l.end_us GROUP BY ALL')
def overlap_matrix(spark, sf_dir):
    """Turns of even events against those of odd ones."""
    return I.overlap_matrix(*halves(spark, sf_dir))


@query(f"WITH {TURNS}{HALVES}, m AS (SELECT l.rec, l.speaker AS s, r.speaker AS o, sum(least(l.end_us, r.end_us) - greatest(l.start_us, r.start_us)) AS us FROM l JOIN r ON l.rec = r.rec AND l.start_us < r.end_us AND r.start_us < l.end_us GROUP BY ALL) SELECT rec, s AS speaker, CAST(max(us) AS DOUBLE) / CAST(sum(us) AS DOUBLE) AS share, CAST(sum(us) AS BIGINT) AS shared_us FROM m GROUP BY ALL")
def consistency(spark, sf_dir):
    return S.consistency(*halves(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {SEGMENTS},
one AS (SELECT * FROM segments WHERE NOT contains(speakers, '+')),
u AS (SELECT rec, event_id AS id, start_us, start_us + 3000000 AS end_us FROM turns),
hit AS (SELECT u.rec, u.id, u.start_us, u.end_us, o.start_us AS s, o.end_us AS e, o.speakers AS speaker FROM u ASOF JOIN one o ON u.rec = o.rec AND u.start_us < o.end_us)
SELECT rec, id, speaker, s AS seg_start_us, e AS seg_end_us FROM hit WHERE s <= start_us AND least(end_us, e) - greatest(start_us, s) >= 0.9 * (end_us - start_us)"""
)
def solo_asof(spark, sf_dir):
    """The first three seconds of every event against segments of one speaker."""
    t = event_turns(spark, sf_dir).select("rec", F.col("event_id").alias("id"), "start_us", (F.col("start_us") + 3_000_000).alias("end_us"))
    return I.solo_utterances(t, segments(spark, sf_dir))


@query(f"""WITH {TURNS}, w AS (SELECT rec, start_us, end_us, {", ".join(f"lead(start_us, {k}) OVER o AS s{k}, lead(end_us, {k}) OVER o AS e{k}" for k in (1, 2, 3))} FROM turns WINDOW o AS (PARTITION BY rec ORDER BY start_us, end_us, event_id))
SELECT rec, CAST(sum({" + ".join(f"coalesce(greatest(0, least(end_us, e{k}) - greatest(start_us, s{k})) * (s{k} IS NOT NULL)::INT, 0)" for k in (1, 2, 3))}) AS BIGINT) AS overlap_us FROM w GROUP BY rec""")
def next3_overlap(spark, sf_dir):
    return I.next_overlaps(event_turns(spark, sf_dir), "event_id")


@query(
    f"""WITH RECURSIVE {SEGMENTS}, n AS (SELECT *, lag(speakers) OVER w AS sb, start_us - lag(end_us) OVER w AS gb, lead(speakers) OVER w AS sa, lead(start_us) OVER w - end_us AS ga FROM segments WINDOW w AS (PARTITION BY rec ORDER BY start_us, end_us))
SELECT rec, start_us, end_us, speakers, coalesce(list_has_any(string_split(speakers, '+'), string_split(sb, '+')) AND gb <= 400000, false) AS from_before,
coalesce(list_has_any(string_split(speakers, '+'), string_split(sa, '+')) AND ga <= 400000, false) AS into_next FROM n"""
)
def neighbour_continues(spark, sf_dir):
    return I.neighbours_continue(segments(spark, sf_dir)).withColumn("speakers", joined(F.col("speakers")))


@query(f"WITH {TURNS} SELECT rec, event_id, greatest(start_us, 21600000000) AS start_us, least(end_us, 64800000000) AS end_us FROM turns WHERE least(end_us, 64800000000) > greatest(start_us, 21600000000)")
def clip_to_window(spark, sf_dir):
    """Turns clipped to the hours from six to eighteen."""
    hour = 3_600_000_000
    return I.clip(event_turns(spark, sf_dir), F.lit(6 * hour), F.lit(18 * hour)).select("rec", "event_id", "start_us", "end_us")


NORMAL = r"""regexp_replace(replace(regexp_replace(lower(coalesce(text, '')), '\[pause[^\]]*\]', ' ', 'g'), '-', ' '), '[^a-z0-9''\s-]', ' ', 'g')"""
FILLER_LIST = "(" + ", ".join(f"'{w}'" for w in T.FILLERS) + ")"
WORDS = rf"list_filter(string_split_regex({NORMAL}, '\s+'), lambda w: w <> '')"


@query(f"SELECT conv_id AS rec, turn, array_to_string(list_filter({WORDS}, lambda w: w NOT IN {FILLER_LIST}), ' ') AS words, len(list_filter({WORDS}, lambda w: w NOT IN {FILLER_LIST})) AS n FROM conversations")
def normalize_tokens(spark, sf_dir):
    w = T.normalize(F.col("text"))
    return conversation_words(spark, sf_dir).select("rec", "turn", F.array_join(w, " ").alias("words"), F.size(w).cast("long").alias("n"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9''\- ]', ' ', 'g'), ' +', ' ', 'g')) AS text FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean(F.col("text")).alias("text"))


@query(f"SELECT conv_id AS rec, turn, len(list_filter({WORDS}, lambda w: w IN {FILLER_LIST})) AS fillers, len({WORDS}) AS words FROM conversations")
def filler_counts(spark, sf_dir):
    return conversation_words(spark, sf_dir).select("rec", "turn", T.filler_count(F.col("text")).cast("long").alias("fillers"), F.size(T.verbatim(F.col("text"))).cast("long").alias("words"))


@query(
    f"""WITH t AS (SELECT conv_id AS rec, role, unnest({WORDS}) AS w FROM conversations), f AS (SELECT * FROM t WHERE w IN {FILLER_LIST}),
r AS (SELECT rec, w, count(*) AS n FROM f WHERE role = 'user' GROUP BY ALL), h AS (SELECT rec, w, count(*) AS n FROM f WHERE role = 'assistant' GROUP BY ALL)
SELECT rec, CAST(sum(least(r.n, coalesce(h.n, 0))) AS BIGINT) AS hits, CAST(sum(r.n) AS BIGINT) AS total FROM r LEFT JOIN h USING (rec, w) GROUP BY rec"""
)
def filler_recall(spark, sf_dir):
    """Users' fillers found again in the assistants' turns."""
    c = conversation_words(spark, sf_dir)
    return S.filler_recall(c.where("speaker = 'user'"), c.where("speaker = 'assistant'"))


@query("SELECT conv_id AS rec, role AS speaker, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL")
def text_by_speaker(spark, sf_dir):
    return S.text_by_speaker(conversation_words(spark, sf_dir))


@query(f"SELECT conv_id AS rec, count(*) AS turns, CAST(sum(len({WORDS})) AS BIGINT) AS words, count(DISTINCT role) AS speakers FROM conversations GROUP BY conv_id")
def excerpt_counts(spark, sf_dir):
    return S.excerpt_counts(conversation_words(spark, sf_dir))


@query(
    f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w, unnest(range(len({WORDS}))) AS i FROM documents),
m AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS isle FROM w),
runs AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id, w, isle)
SELECT d.doc_id, coalesce(max(n), 0) AS longest, coalesce(max(n), 0) > 4 AS pathological FROM documents d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id"""
)
def repeat_runs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.longest_run(T.verbatim(F.col("text"))).cast("long").alias("longest")).withColumn("pathological", F.col("longest") > 4)


def event_utterances(spark, sf_dir):
    """A user's events of a day as the words of one utterance."""
    word = F.struct(F.concat(F.lit(" "), "event_type").alias("word"), "start_us", "end_us")
    words = F.array_sort(F.collect_list(F.struct("start_us", "end_us", "event_id", word.alias("w"))))
    return event_turns(spark, sf_dir).groupBy("rec", "speaker").agg(F.transform(words, lambda x: x["w"]).alias("words"))


@query(
    f"""WITH {TURNS}, n AS (SELECT *, lead(start_us) OVER (PARTITION BY rec, speaker ORDER BY start_us, end_us, event_id) - end_us AS gap FROM turns)
SELECT rec, speaker, trim(string_agg(' ' || event_type || CASE WHEN gap >= 600000 THEN ' [pause ' || CAST((gap + 50000) // 1000000 AS VARCHAR) || '.' || CAST((gap + 50000) // 100000 % 10 AS VARCHAR) || 's]' ELSE '' END, '' ORDER BY start_us, end_us, event_id)) AS text FROM n GROUP BY rec, speaker"""
)
def pause_markers(spark, sf_dir):
    return event_utterances(spark, sf_dir).select("rec", "speaker", O.display_text(F.col("words")).alias("text"))


CLIPS = f"{TURNS}, clips AS (SELECT rec, event_id AS id, end_us - start_us AS length_us, row_number() OVER (PARTITION BY rec ORDER BY event_id) AS n FROM turns)"


@query(
    f"""WITH RECURSIVE {CLIPS}, fold AS (
  SELECT rec, n, id, length_us, CAST(0 AS BIGINT) AS "window", CAST(0 AS BIGINT) AS offset_us FROM clips WHERE n = 1
  UNION ALL
  SELECT c.rec, c.n, c.id, c.length_us, CASE WHEN f.offset_us + f.length_us + 1000000 + c.length_us > 120000000 THEN f."window" + 1 ELSE f."window" END,
    CASE WHEN f.offset_us + f.length_us + 1000000 + c.length_us > 120000000 THEN 0 ELSE f.offset_us + f.length_us + 1000000 END
  FROM fold f JOIN clips c ON c.rec = f.rec AND c.n = f.n + 1)
SELECT rec, id, length_us, "window", offset_us FROM fold"""
)
def pack_windows(spark, sf_dir):
    clips = event_turns(spark, sf_dir).select("rec", F.col("event_id").alias("id"), (F.col("end_us") - F.col("start_us")).alias("length_us"))
    return N.pack_clips(clips, max_us=120_000_000)


GREEDY = f"""{TURNS}, u AS (SELECT rec, event_id AS id, event_type AS stretch, start_us, end_us, row_number() OVER (PARTITION BY rec ORDER BY start_us, end_us, event_id) AS n FROM turns),
fold AS (
  SELECT rec, n, id, stretch, CAST(0 AS BIGINT) AS "window", start_us - 150000 AS s, end_us AS e, start_us, end_us FROM u WHERE n = 1
  UNION ALL
  SELECT u.rec, u.n, u.id, u.stretch, f."window" + fresh, CASE WHEN fresh = 1 THEN u.start_us - 150000 ELSE f.s END, CASE WHEN fresh = 1 THEN u.end_us ELSE greatest(f.e, u.end_us) END, u.start_us, u.end_us
  FROM fold f JOIN u ON u.rec = f.rec AND u.n = f.n + 1,
  LATERAL (SELECT CASE WHEN u.stretch <> f.stretch OR greatest(f.e, u.end_us) + 150000 - f.s > 600000000 OR u.start_us - f.e > 300000000 THEN 1 ELSE 0 END AS fresh))"""


@query(f'WITH RECURSIVE {GREEDY} SELECT rec, id, "window", s AS window_start_us FROM fold')
def greedy_windows(spark, sf_dir):
    u = event_turns(spark, sf_dir).select("rec", F.col("event_id").alias("id"), F.col("event_type").alias("stretch"), "start_us", "end_us")
    return N.make_windows(u, max_us=600_000_000, gap_us=300_000_000)


@query(
    f"""WITH RECURSIVE {GREEDY},
placed AS (SELECT *, row_number() OVER (PARTITION BY rec, "window" ORDER BY start_us, end_us, id) AS k, max(end_us) OVER (PARTITION BY rec, "window") + 150000 - s AS room FROM fold),
span AS (
  SELECT rec, "window", k, id, b AS start_us, c AS end_us, CASE WHEN c > b THEN c ELSE 0 END AS last FROM placed,
    LATERAL (SELECT (greatest(start_us - s, 0) + 10000) // 20000 * 20000 AS b), LATERAL (SELECT (least(greatest(end_us - s, b + 100000), room) + 10000) // 20000 * 20000 AS c) WHERE k = 1
  UNION ALL
  SELECT p.rec, p."window", p.k, p.id, b, c, CASE WHEN c > b THEN c ELSE f.last END FROM span f JOIN placed p ON p.rec = f.rec AND p."window" = f."window" AND p.k = f.k + 1,
    LATERAL (SELECT (greatest(p.start_us - p.s, f.last) + 10000) // 20000 * 20000 AS b), LATERAL (SELECT (least(greatest(p.end_us - p.s, b + 100000), p.room) + 10000) // 20000 * 20000 AS c))
SELECT rec, "window", id, start_us, end_us FROM span WHERE end_us > start_us"""
)
def window_segments(spark, sf_dir):
    u = event_turns(spark, sf_dir).select("rec", F.col("event_id").alias("id"), F.col("event_type").alias("stretch"), "start_us", "end_us")
    return N.window_segments(N.make_windows(u, max_us=600_000_000, gap_us=300_000_000).join(u.drop("stretch"), ["rec", "id"]))


@query(f"WITH {TURNS} SELECT rec, event_id, CAST(coalesce(sum(end_us - start_us) OVER (PARTITION BY rec ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM turns")
def prefix_offset(spark, sf_dir):
    t = event_turns(spark, sf_dir).withColumn("length_us", F.col("end_us") - F.col("start_us"))
    return N.running_offset(t, ["rec"], ["event_id"], "length_us").select("rec", "event_id", "offset")


@query(f"""WITH {TURNS}, b AS (SELECT *, coalesce(sum(end_us - start_us) OVER (PARTITION BY rec, speaker ORDER BY end_us - start_us DESC, start_us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM turns WHERE end_us - start_us >= 500000)
SELECT rec, speaker, event_id AS id, start_us, end_us FROM b WHERE before < 30000000""")
def longest_first_cap(spark, sf_dir):
    return N.longest_first(event_turns(spark, sf_dir).select("rec", "speaker", F.col("event_id").alias("id"), "start_us", "end_us"))


@query(f"WITH {TURNS}, f AS (SELECT rec, speaker, min(start_us) AS t FROM turns GROUP BY ALL) SELECT rec, speaker, 'Speaker_' || CAST(row_number() OVER (PARTITION BY rec ORDER BY t, speaker) AS VARCHAR) AS label FROM f")
def first_appearance(spark, sf_dir):
    return N.first_appearance(event_turns(spark, sf_dir))


def clock_sql(t: str) -> str:
    q = f"(({t} + 50000) // 100000)"
    return f"'[' || lpad(CAST({q} // 600 AS VARCHAR), greatest(2, len(CAST({q} // 600 AS VARCHAR)))::INT, '0') || ':' || lpad(CAST({q} % 600 // 10 AS VARCHAR), 2, '0') || '.' || CAST({q} % 10 AS VARCHAR) || ']'"


@query(f"WITH {TURNS} SELECT event_id, {clock_sql('start_us')} || ' Speaker_' || speaker || ': ' || event_type AS line FROM turns")
def render_lines(spark, sf_dir):
    return event_turns(spark, sf_dir).select("event_id", T.render(F.col("start_us"), F.concat(F.lit("Speaker_"), "speaker"), F.col("event_type")).alias("line"))


@query(
    f"""SELECT conv_id AS rec, turn, trim(coalesce(text, ''), ' ') <> '' AND NOT regexp_matches(coalesce(text, ''), '[\\[\\]()_]') AND NOT (turn % 2 = 1 AND (len(text) % 10 > 6 OR (len({WORDS}) > 0 AND len(list_filter({WORDS}, lambda w: w NOT IN {FILLER_LIST})) = 0))) AS usable FROM conversations"""
)
def usable_lines(spark, sf_dir):
    """Odd turns are strict, and doubtful where their length ends in 7, 8 or 9."""
    doubtful = F.length("text") % 10 > 6
    ok = O.usable(F.col("text"), F.when(doubtful, 0.9).otherwise(0.1), F.lit(-2.0), F.col("turn") % 2 == 1)
    return conversation_words(spark, sf_dir).select("rec", "turn", F.coalesce(ok, F.lit(False)).alias("usable"))


@query(f"WITH {TURNS} SELECT event_id, coalesce(c_name, speaker) AS name FROM turns LEFT JOIN customer ON c_custkey = CAST(speaker AS BIGINT) AND c_custkey % 3 = 0")
def name_lookup(spark, sf_dir):
    """Users with an enrolled name: customers whose number divides by three."""
    names = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("label"), F.col("c_name").alias("name"))
    return O.name_lookup(event_turns(spark, sf_dir), names).select("event_id", "name")


@query(f"WITH {TURNS}{HALVES} SELECT DISTINCT rec, speaker FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rec = l.rec AND r.speaker = l.speaker)")
def unmatched(spark, sf_dir):
    a, b = halves(spark, sf_dir)
    return M.unmatched(a.select("rec", "speaker").distinct(), b.select("rec", "speaker"), ["rec", "speaker"])


@query(f"WITH {TURNS} SELECT DISTINCT rec, speaker FROM turns WHERE end_us > 21600000000 AND start_us < 64800000000")
def settled(spark, sf_dir):
    t = event_turns(spark, sf_dir)
    return M.settled(t.select("rec", "speaker").distinct(), t, 21_600_000_000, 64_800_000_000)


def centroids(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("label", "vec_id", F.posexplode(unit(F.col("embedding"))).alias("i", "x"))
    each = v.groupBy("label", "i").agg(F.sum(F.round(F.col("x") * 1_000_000).cast("long")).alias("x"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"].cast("double")).alias("v"))


CENTROIDS = """unit AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
scaled AS (SELECT vec_id, label, list_transform(e, lambda x: x / (sqrt(list_inner_product(e, e)) + 1e-8)) AS e FROM unit),
flat AS (SELECT label, unnest(range(len(e))) AS i, unnest(e) AS x FROM scaled),
cells AS (SELECT label, i, sum(CAST(round(x * 1000000) AS BIGINT)) AS x FROM flat GROUP BY ALL),
cent AS (SELECT label, list(CAST(x AS DOUBLE) ORDER BY i) AS v FROM cells GROUP BY label)"""
COSINE = "list_inner_product({0}, {1}) / (sqrt(list_inner_product({0}, {0})) * sqrt(list_inner_product({1}, {1})) + 1e-8)"


@query(
    f"""WITH {CENTROIDS}, s AS (SELECT u.vec_id, u.label, c.label AS nearest, round({COSINE.format("u.e", "c.v")}, 6) AS score FROM unit u CROSS JOIN cent c)
SELECT vec_id, label, nearest, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, nearest) = 1"""
)
def nearest_centroid(spark, sf_dir):
    """Every vector's nearest label centroid; scores are reported to six decimals."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("rec"), F.col("label").alias("left"), F.col("embedding").alias("v"))
    s = M.similarity(e, centroids(spark, sf_dir).select(F.col("label").alias("right"), "v"))
    s = s.select(F.col("rec").alias("vec_id"), F.col("left").alias("label"), F.col("right").alias("nearest"), F.round("score", 6).alias("score"))
    # one row for each vector without a window: the largest (score, -label)
    return s.groupBy("vec_id", "label").agg(F.max(F.struct("score", (-F.col("nearest")).alias("n"))).alias("m")).select("vec_id", "label", (-F.col("m.n")).alias("nearest"), "m.score")


def centroid_scores(spark, sf_dir) -> DataFrame:
    c = centroids(spark, sf_dir)
    left = c.select(F.lit("r").alias("rec"), F.concat(F.lit("s"), F.col("label").cast("string")).alias("left"), "v")
    gallery = c.select(F.concat(F.lit("n"), ((F.col("label") + 1) % 10).cast("string")).alias("right"), F.reverse("v").alias("v"))
    return M.similarity(left, gallery).withColumn("score", F.round("score", 6))


SCORED = f"""{CENTROIDS},
scored AS (SELECT 'r' AS rec, 's' || a.label AS "left", 'n' || (b.label + 1) % 10 AS "right", round({COSINE.format("a.v", "list_reverse(b.v)")}, 6) AS score FROM cent a CROSS JOIN cent b)"""


def greedy_sql(steps: int) -> str:
    """One step takes the best pair that is left."""
    taken = ['taken0 AS (SELECT * FROM scored WHERE false)']
    for k in range(1, steps + 1):
        taken.append(f'taken{k} AS (SELECT * FROM taken{k - 1} UNION ALL (SELECT * FROM scored WHERE "left" NOT IN (SELECT "left" FROM taken{k - 1}) AND "right" NOT IN (SELECT "right" FROM taken{k - 1}) ORDER BY score DESC, "left", "right" LIMIT 1))')
    return ",\n".join(taken)


def assignment_sql(scored: str, steps: int) -> str:
    """Rows in order each take a free column or none; of equal sets of columns the best total goes on. scored: rec,
    left, right and score, whole numbers. The result, chosen(rec, left, right), has the highest total."""
    out = [
        f"""sides AS (SELECT rec, "left", dense_rank() OVER (PARTITION BY rec ORDER BY "left") AS i, "right", dense_rank() OVER (PARTITION BY rec ORDER BY "right") - 1 AS j, score FROM {scored})""",
        f"""best0 AS (SELECT rec, CAST(0 AS BIGINT) AS used, CAST(0 AS HUGEINT) AS total, CAST([] AS VARCHAR[]) AS pairs FROM {scored} GROUP BY rec)""",
    ]
    for k in range(1, steps + 1):
        out.append(
            f"""best{k} AS (SELECT rec, used, max(total) AS total, arg_max(pairs, total) AS pairs FROM (
  SELECT rec, used, total, pairs FROM best{k - 1} UNION ALL
  SELECT b.rec, used + (1::BIGINT << j::INT), total + score, list_append(pairs, "left" || '|' || "right") FROM best{k - 1} b JOIN sides s ON s.rec = b.rec AND s.i = {k} AND (used >> j::INT) % 2 = 0) GROUP BY rec, used)"""
        )
    out.append(f"""chosen AS (SELECT rec, split_part(p, '|', 1) AS "left", split_part(p, '|', 2) AS "right" FROM (SELECT rec, unnest(arg_max(pairs, total)) AS p FROM best{steps} GROUP BY rec))""")
    return ",\n".join(out)


@query(f"WITH {SCORED}, {greedy_sql(10)} SELECT * FROM taken10")
def enroll_greedy(spark, sf_dir):
    """Centroids against a gallery of reversed centroids, greedily by falling similarity."""
    return M.greedy(centroid_scores(spark, sf_dir), threshold=-1.0)


@query(f"""WITH {SCORED}, whole AS (SELECT rec, "left", "right", CAST(round((score + 1) * 1000000) AS BIGINT) AS score FROM scored), {assignment_sql("whole", 10)}
SELECT c.rec, c."left", c."right", s.score FROM chosen c JOIN scored s USING (rec, "left", "right")""")
def optimal_assignment(spark, sf_dir):
    return M.assign(centroid_scores(spark, sf_dir))


def distance_sql(source: str) -> str:
    """Word errors of source(id, r, h), two lists: one row of the table of distances after another, where insertions
    are a running minimum along the row. The result is errors(id, errors)."""
    return f"""
lists AS (SELECT id, r, h, len(r) AS n, len(h) AS m FROM {source}),
cells(id, i, j, d) USING KEY (id, j) AS (
  SELECT id, CAST(0 AS BIGINT) AS i, unnest(range(0, m + 1)) AS j, unnest(range(0, m + 1)) AS d FROM lists
  UNION
  SELECT id, i, j, j + min(b - j) OVER (PARTITION BY id ORDER BY j) FROM (
    SELECT c.id, i + 1 AS i, j, CASE WHEN j = 0 THEN d + 1 ELSE least(d + 1, lag(d) OVER (PARTITION BY c.id ORDER BY j) + (r[i + 1] <> h[j])::INT) END AS b
    FROM cells c JOIN lists l ON l.id = c.id AND c.i < l.n)),
errors AS (SELECT l.id, d AS errors FROM lists l JOIN cells c ON c.id = l.id AND c.i = l.n AND c.j = l.m)"""


CONTENT = f"list_filter({WORDS}, lambda w: w NOT IN {FILLER_LIST})"
NEXT_TURN = f"""spoken AS (SELECT conv_id AS rec, turn, text, {CONTENT} AS w FROM conversations),
follow AS (SELECT row_number() OVER (ORDER BY rec, turn, text) AS id, rec, turn, w AS r, coalesce(lead(w) OVER (PARTITION BY rec ORDER BY turn, text), CAST([] AS VARCHAR[])) AS h FROM spoken), {distance_sql("follow")}"""


@query(f"WITH RECURSIVE {NEXT_TURN} SELECT rec, turn, errors, len(r) AS ref_words FROM follow JOIN errors USING (id)")
def word_edit_distance(spark, sf_dir):
    """Errors between neighbouring turns of a conversation, over whole texts."""
    after = F.lead("text").over(W.partitionBy("rec").orderBy("turn", "text"))
    pairs = conversation_words(spark, sf_dir).withColumn("next", after)
    return S.word_errors(pairs, "text", "next").select("rec", "turn", "errors", "ref_words")


@query(f"WITH RECURSIVE {NEXT_TURN} SELECT rec, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(len(r)) AS BIGINT) AS ref_words, CASE WHEN sum(len(r)) > 0 THEN CAST(sum(errors) AS DOUBLE) / CAST(sum(len(r)) AS DOUBLE) END AS wer FROM follow JOIN errors USING (id) GROUP BY rec")
def wer(spark, sf_dir):
    pairs = word_edit_distance(spark, sf_dir)
    return pairs.groupBy("rec").agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("ref_words"), S.rate().alias("wer"))


@query(
    # the hypothesis only leaves words out: no mapping of speakers costs less than the words that are missing, and names undone costs that
    f"""WITH told AS (SELECT conv_id AS rec, role AS speaker, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
heard AS (SELECT rec, array_to_string(list_filter(string_split(text, ' '), lambda w, i: i % 7 <> 0), ' ') AS text FROM told),
r AS (SELECT rec, sum(len({CONTENT})) AS n FROM told GROUP BY rec), h AS (SELECT rec, sum(len({CONTENT})) AS n FROM heard GROUP BY rec)
SELECT rec, CAST(r.n - h.n AS BIGINT) AS errors, CAST(r.n AS BIGINT) AS ref_words, CASE WHEN r.n > 0 THEN CAST(r.n - h.n AS DOUBLE) / CAST(r.n AS DOUBLE) END AS cp_wer FROM r JOIN h USING (rec)"""
)
def cp_wer(spark, sf_dir):
    """Conversations against a hypothesis that loses each seventh word and names speakers otherwise."""
    ref = S.text_by_speaker(conversation_words(spark, sf_dir))
    dropped = F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 7 != 6), " ")
    return S.cp_wer(ref, ref.select("rec", F.concat(F.lit("x"), F.reverse("speaker")).alias("speaker"), dropped.alias("text")))


def late(t: DataFrame) -> DataFrame:
    """Events half a second late, every fifth lost."""
    return t.where("event_id % 5 <> 0").withColumns({"start_us": F.col("start_us") + 500_000, "end_us": F.col("end_us") + 500_000})


@query()
def der(spark, sf_dir):
    """Events against themselves half a second late, every fifth lost. Hundreds of speakers a day: tests compare with brute force."""
    t = event_turns(spark, sf_dir)
    return S.der(t, late(t))


KINDS = 6


@query(
    f"""WITH {TURNS}, ref AS (SELECT rec, 'r:' || event_type AS speaker, start_us, end_us FROM turns),
hyp AS (SELECT rec, 'h:' || event_type AS speaker, start_us + 500000 AS start_us, end_us + 500000 AS end_us FROM turns WHERE event_id % 5 <> 0),
meet AS (SELECT ref.rec, ref.speaker AS "left", hyp.speaker AS "right", CAST(sum(least(ref.end_us, hyp.end_us) - greatest(ref.start_us, hyp.start_us)) AS BIGINT) AS score FROM ref JOIN hyp ON ref.rec = hyp.rec AND ref.start_us < hyp.end_us AND hyp.start_us < ref.end_us GROUP BY ALL),
{assignment_sql("meet", KINDS)},
everyone AS (SELECT * FROM ref UNION ALL SELECT * FROM hyp),
cuts AS (SELECT rec, start_us AS t FROM everyone UNION SELECT rec, end_us FROM everyone),
spans AS (SELECT rec, t AS a, lead(t) OVER (PARTITION BY rec ORDER BY t) AS b FROM cuts),
pieces AS (SELECT s.rec, a, b - a AS us, list(DISTINCT speaker) AS who FROM spans s JOIN everyone t ON s.rec = t.rec AND t.start_us <= a AND a < t.end_us WHERE b IS NOT NULL GROUP BY ALL),
n AS (SELECT rec, a, us, len(list_filter(who, lambda x: x[1:2] = 'r:')) AS r, len(list_filter(who, lambda x: x[1:2] = 'h:')) AS h, (SELECT count(*) FROM chosen c WHERE c.rec = p.rec AND list_contains(p.who, c."left") AND list_contains(p.who, c."right")) AS c FROM pieces p),
sums AS (SELECT rec, CAST(sum(greatest(0, r - h) * us) AS BIGINT) AS missed_us, CAST(sum(greatest(0, h - r) * us) AS BIGINT) AS false_alarm_us, CAST(sum((least(r, h) - c) * us) AS BIGINT) AS confusion_us, CAST(sum(r * us) AS BIGINT) AS ref_us FROM n GROUP BY rec)
SELECT *, CASE WHEN ref_us > 0 THEN CAST(missed_us + false_alarm_us + confusion_us AS DOUBLE) / CAST(ref_us AS DOUBLE) END AS der FROM sums"""
)
def der_by_type(spark, sf_dir):
    """The same with types of events for speakers."""
    t = event_turns(spark, sf_dir).withColumn("speaker", F.col("event_type"))
    return S.der(t, late(t))


@query(
    # what is only left out costs its own number of words
    f"""WITH told AS (SELECT regexp_replace(coalesce(text, ''), '<\\|[^|]*\\|>', '', 'g') AS text FROM conversations),
ask AS (SELECT len({CONTENT}) AS n, len(list_filter({CONTENT}, lambda w, i: i % 5 <> 0)) AS m FROM told)
SELECT CAST(sum(n - m) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS ref_words, CAST(sum(n - m) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS wer FROM ask"""
)
def asr_totals(spark, sf_dir):
    """Micro-averaged word errors of all turns against themselves without each fifth word."""
    c = conversation_words(spark, sf_dir)
    kept = F.array_join(F.filter(T.normalize(T.strip_tags(F.col("text"))), lambda w, i: i % 5 != 4), " ")
    pairs = c.select(F.col("text").alias("ref"), kept.alias("hyp"), F.lit(1).alias("audio_us"), F.lit(1).alias("wall_us"))
    return S.asr_totals(pairs).select("errors", "ref_words", "wer")


@query(f"WITH {TURNS} SELECT count(*) AS lines, count(DISTINCT speaker) AS speakers, count(DISTINCT rec) AS recs, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM turns")
def session_counters(spark, sf_dir):
    return event_turns(spark, sf_dir).agg(F.count("*").alias("lines"), F.count_distinct("speaker").alias("speakers"), F.count_distinct("rec").alias("recs"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


@query(f"WITH {TURNS} SELECT event_id, CAST(CAST(speaker AS BIGINT) % 8 AS INTEGER) AS color, (start_us + 10000) // 20000 * 20000 AS tick_us, CAST(least(224, 8 * (end_us - start_us) // 1000000 + 24) AS INTEGER) AS cap FROM turns")
def display_values(spark, sf_dir):
    return event_turns(spark, sf_dir).select("event_id", T.color_index(F.concat(F.lit("Speaker_"), "speaker")).alias("color"), T.quantize(F.col("start_us")).alias("tick_us"), T.token_cap(F.col("end_us") - F.col("start_us")).alias("cap"))


@query(
    f"""WITH RECURSIVE {TURNS}, o AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY start_us, end_us, speaker) AS n, max(end_us) OVER (PARTITION BY rec) AS newest FROM turns),
clock AS (
  SELECT rec, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS committed, CAST(0 AS BIGINT) AS low FROM o WHERE n = 1
  UNION ALL
  SELECT o.rec, o.n, CASE WHEN o.start_us - 3000000 - c.committed >= 4000000 THEN o.start_us - 3000000 ELSE c.committed END, c.committed FROM clock c JOIN o ON o.rec = c.rec AND o.n = c.n + 1),
cuts AS (SELECT rec, low, committed AS high FROM clock WHERE committed > low UNION ALL SELECT c.rec, max(committed), any_value(newest) FROM clock c JOIN o USING (rec) GROUP BY c.rec)
SELECT t.rec, t.speaker, greatest(t.start_us, low) AS start_us, least(t.end_us, high) AS end_us FROM turns t JOIN cuts c ON c.rec = t.rec AND t.start_us < high AND low < t.end_us"""
)
def stream_commit(spark, sf_dir):
    """What the incremental commits and the flush put out: every turn cut where a horizon passed it."""
    from colloquy.streaming.commit import commit_batch

    return commit_batch(event_turns(spark, sf_dir).select("rec", "speaker", "start_us", "end_us"))
