"""Hand-written cases and invariants of the operators."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.functions import vectors as V
from colloquy.functions.scan import ordered_scan
from colloquy.operators import intervals as I
from colloquy.operators import matching as M
from colloquy.operators import scoring as S
from colloquy.operators import windowing as N
from colloquy.operators import words as O
from colloquy.streaming import registry as R
from colloquy.streaming import step as L

TURNS = "rec string, speaker string, start_us long, end_us long"
SEC = 1_000_000


def turns(spark, rows):
    return spark.createDataFrame([("r", s, round(a * SEC), round(b * SEC)) for s, a, b in rows], TURNS)


def spans(df):
    return [(r["start_us"] / SEC, r["end_us"] / SEC, tuple(r["speakers"])) for r in df.orderBy("rec", "start_us").collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# intervals


def test_elementary_splits_and_leaves_silence_out(spark):
    got = spans(I.elementary(turns(spark, [("Speaker_1", 0, 5), ("Speaker_2", 3, 7), ("Speaker_1", 9, 10)])))
    assert got == [(0, 3, ("Speaker_1",)), (3, 5, ("Speaker_1", "Speaker_2")), (5, 7, ("Speaker_2",)), (9, 10, ("Speaker_1",))]


def test_speakers_sort_by_number(spark):
    assert spans(I.elementary(turns(spark, [("Speaker_10", 0, 1), ("Speaker_2", 0, 1)])))[0][2] == ("Speaker_2", "Speaker_10")


def test_short_overlap_goes_to_the_neighbour(spark):
    got = spans(I.build_segments(turns(spark, [("A", 0, 5.1), ("B", 4.8, 10)])))
    assert got == [(0, 5.1, ("A",)), (5.1, 10, ("B",))]


def test_overlap_of_exactly_the_minimum_stays_wherever_it_is(spark):
    for at in (1.0, 1001.3):
        got = spans(I.build_segments(turns(spark, [("A", 0, at + 0.4), ("B", at, at + 5)])))
        assert [len(s) for _, _, s in got] == [1, 2, 1]


def test_demotion_falls_to_the_first_speaker(spark):
    got = spans(I.demote_short_overlaps(I.elementary(turns(spark, [("B", 0, 0.3), ("A", 0, 0.3)]))))
    assert got == [(0, 0.3, ("A",))]


def test_blips_go_and_gaps_close(spark):
    got = spans(I.build_segments(turns(spark, [("A", 0, 1), ("A", 1.3, 2), ("B", 5, 5.1)])))
    assert got == [(0, 2, ("A",))]


@given(st.lists(st.tuples(st.sampled_from("ABC"), st.integers(0, 40), st.integers(1, 15)), max_size=12))
@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_pieces_cover_exactly_the_turns(spark, rows):
    df = spark.createDataFrame([("r", s, a, a + n) for s, a, n in rows], TURNS)
    covered = {}
    for r in I.elementary(df, width=7).collect():
        for t in range(r["start_us"], r["end_us"]):
            assert t not in covered
            covered[t] = set(r["speakers"])
    want = {}
    for s, a, n in rows:
        for t in range(a, a + n):
            want.setdefault(t, set()).add(s)
    assert covered == want


def test_overlap_matrix_counts_each_pair_once(spark):
    a, b = turns(spark, [("A", 0, 200)]), turns(spark, [("X", 50, 130), ("X", 100, 300)])
    assert [tuple(r) for r in I.overlap_matrix(a, b).collect()] == [("r", "A", "X", 180 * SEC)]


def test_clip_contain_and_common_part(spark):
    t = turns(spark, [("A", 0, 5), ("A", 6, 9)])
    assert I.clip(t, F.lit(4 * SEC), F.lit(7 * SEC)).count() == 2
    assert I.contained(t, F.lit(5 * SEC), F.lit(9 * SEC)).count() == 1
    assert one(spark, I.span_overlap(F.lit(1), F.lit(5), F.lit(3), F.lit(9)))["start_us"] == 3
    assert one(spark, I.span_overlap(F.lit(1), F.lit(3), F.lit(3), F.lit(9))) is None


def test_slices_are_padded_and_clamped(spark):
    x = F.array(*[F.lit(i) for i in range(10)])
    assert one(spark, I.slice_samples(x, F.lit(2 * SEC), F.lit(4 * SEC), 1, SEC)) == [1, 2, 3, 4]
    assert one(spark, I.slice_samples(x, F.lit(0), F.lit(99 * SEC), 1, SEC)) == list(range(10))


# words


def words_df(spark, words, text="x"):
    rows = [(text, 0, 10 * SEC, [{"word": w, "start_us": int(a * SEC), "end_us": int(b * SEC)} for w, a, b in words])]
    return spark.createDataFrame(rows, "text string, start_us long, end_us long, words array<struct<word:string,start_us:long,end_us:long>>")


def test_crop_is_half_open_by_midpoints(spark):
    df = words_df(spark, [(" a", 0, 1), (" b", 1, 3), (" c", 3, 5)])
    left = O.crop(df, F.lit(0), F.lit(2 * SEC)).first()
    right = O.crop(df, F.lit(2 * SEC), F.lit(9 * SEC)).first()
    assert (left["text"], right["text"], right["start_us"]) == ("a", "b c", SEC)
    assert O.crop(words_df(spark, []), F.lit(6 * SEC), F.lit(9 * SEC)).count() == 0
    assert O.crop(words_df(spark, []), F.lit(None).cast("long"), F.lit(9 * SEC)).count() == 1


def test_shift_and_pauses(spark):
    df = words_df(spark, [(" a", 0, 1), (" b", 1.6, 2), (" c", 2.5, 3)])
    assert df.select(O.display_text(F.col("words"))).first()[0] == "a [pause 0.6s] b c"
    assert df.select(O.shift_words(F.col("words"), F.lit(5))).first()[0][0]["start_us"] == 5


@pytest.mark.parametrize(
    ("text", "strict", "no_speech", "log_prob", "want"),
    [("hello", True, 0.1, -0.1, True), ("", False, 0, 0, False), ("[music]", False, 0, 0, False), ("um uh", True, 0.1, -0.1, False), ("um uh", False, 0.1, -0.1, True), ("hello", True, 0.7, -1.5, False), ("hello", False, 0.7, -1.5, True), (None, True, 0, 0, False)],
)
def test_usable(spark, text, strict, no_speech, log_prob, want):
    assert one(spark, O.usable(F.lit(text).cast("string"), F.lit(float(no_speech)), F.lit(float(log_prob)), F.lit(strict))) is want


def test_labels_names_and_streams(spark):
    assert one(spark, O.joint_label(F.array(F.lit("a"), F.lit("b")), F.create_map(F.lit("a"), F.lit("Ann")))) == "Ann+b"
    s = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.05), (2, 0, 0.0)], "seg int, i int, rms double")
    assert [(r.seg, r.i) for r in O.loud_streams(s, ["seg"]).collect()] == [(1, 0)]
    assert one(spark, O.start_floor(F.lit(1), F.lit(3), F.lit(False))) == 3
    assert '"overlap":true' in one(spark, O.line_message(F.lit("A"), F.lit(SEC), F.lit(2 * SEC), F.lit("t"), F.lit(True)))


# text


def test_normalize(spark):
    assert one(spark, T.normalize(F.lit("Um, well-known [pause 1.2s]  IT'S"))) == ["well", "known", "it's"]
    assert one(spark, T.clean(F.lit("Hé, -x_"))) == "h -x"


@pytest.mark.parametrize(("us", "want"), [(0, "[00:00.0]"), (59_950_000, "[01:00.0]"), (59_949_999, "[00:59.9]"), (250_000, "[00:00.3]"), (6000 * SEC, "[100:00.0]")])
def test_clock_rounds_half_up_once(spark, us, want):
    assert one(spark, T.clock(F.lit(us))) == want


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abc"), max_size=9))
def test_edit_distance(a, b):
    assert T._distance(a, b) == brute_distance(a, b)


def test_small_text_functions(spark):
    assert one(spark, T.display_label(F.lit("SPEAKER_03"))) == "Speaker_4"
    assert one(spark, T.color_index(F.lit("Speaker_11"))) == 3
    assert one(spark, T.strip_tags(F.lit("<|en|> hi"))) == "hi"
    assert one(spark, T.pause_tags(F.lit("a [pause 1.2s] b"))) == ["1.2"]
    assert one(spark, T.quantize(F.lit(29_999))) == 20_000
    assert one(spark, T.token_cap(F.lit(100 * SEC))) == 224


# vectors


def test_vectors(spark):
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, V.norm(a)) == 5.0
    assert one(spark, V.cosine(a, a)) == pytest.approx(1.0)
    assert one(spark, V.rms(a)) == pytest.approx(np.sqrt(12.5))
    assert one(spark, V.to_int16(F.array(F.lit(2.0), F.lit(-0.5)))) == [32767, -16384]
    assert max(map(abs, one(spark, V.normalize_rms(a)))) <= 0.99


def test_sdr_prefers_the_right_source(spark):
    t = np.arange(400) / 50
    a, b = np.sin(t), np.cos(3 * t)
    assert V.si_sdr_db(a * 3, a) > 60 and V.si_sdr_db(b, a) < 0
    df = spark.createDataFrame([([b.tolist(), a.tolist()], [a.tolist(), b.tolist()]), ([a.tolist()], [b.tolist(), a.tolist()])], "e array<array<double>>, r array<array<double>>")
    full, short = (r[0] for r in df.select(V.pit_si_sdr("e", "r")).collect())
    assert min(full) > 60
    assert short[0] is None and short[1] > 60


def test_resample_keeps_a_slow_wave():
    x = np.sin(2 * np.pi * 5 * np.arange(4000) / 1000)
    y = V.resampled(x, 1000, 1600)
    want = np.sin(2 * np.pi * 5 * np.arange(6400) / 1600)
    assert len(y) == 6400 and np.abs(y - want)[100:-100].max() < 0.01


def test_trim_and_mix(spark):
    x = [0.0] * 40 + [1.0] * 40 + [0.0] * 45
    df = spark.createDataFrame([(x,)], "x array<double>")
    assert tuple(df.select(V.trim_silence(F.col("x"), 1000)).first()[0]) == ([1.0] * 40, 40_000)
    for still in ([0.0] * 50, [1.0] * 3, []):
        d = spark.createDataFrame([(still,)], "x array<double>")
        assert tuple(d.select(V.trim_silence(F.col("x"), 1000)).first()[0]) == (still, 0)
    m = spark.createDataFrame([([1.0] * 10, [1.0] * 10, 5, 0.0)], "a array<double>, b array<double>, k int, snr double").select(V.mix("a", "b", "k", "snr").alias("m")).first()["m"]
    assert (len(m["samples"]), m["overlap_start"], m["overlap_end"]) == (15, 5, 10) and max(m["samples"]) == pytest.approx(0.9)
    assert m["first"] == pytest.approx([0.45] * 10 + [0.0] * 5) and np.allclose(np.add(m["first"], m["second"]), m["samples"])


def test_separation_gain(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 400))
    noisy = [(b + 0.1 * rng.normal(size=400)).tolist(), (a + 0.1 * rng.normal(size=400)).tolist()]
    rows = spark.createDataFrame([(1, (a + b).tolist(), noisy, [a.tolist(), b.tolist()])], "id long, mix array<double>, estimates array<array<double>>, references array<array<double>>")
    r = S.separation_gain(rows).first()
    score = np.mean([V.si_sdr_db(np.array(noisy[1]), a), V.si_sdr_db(np.array(noisy[0]), b)])
    base = np.mean([V.si_sdr_db(a + b, a), V.si_sdr_db(a + b, b)])
    assert (r["score_db"], r["mix_db"], r["gain_db"]) == pytest.approx((score, base, score - base)) and r["gain_db"] > 15
    assert tuple(S.mean_gain(rows).first()) == (1, pytest.approx(score - base))


def test_asr_totals(spark):
    rows = [("um the cat [pause 1.2s] sat", "the cat sat down", 2 * SEC, SEC), ("<|en|> Well-known, uh uh", "well known uh", SEC, SEC), (None, None, 0, 0)]
    r = S.asr_totals(spark.createDataFrame(rows, "ref string, hyp string, audio_us long, wall_us long")).first()
    assert (r["errors"], r["ref_words"], r["hits"], r["total"], r["rtf"]) == (1, 5, 1, 3, pytest.approx(2 / 3))
    # as spoken: um, pause, 1, 2s, down and en, uh
    assert (r["verbatim_errors"], r["verbatim_words"]) == (7, 12)
    empty = S.asr_totals(spark.createDataFrame([], "ref string, hyp string, audio_us long, wall_us long")).first()
    assert empty["errors"] == 0 and empty["wer"] is None


def test_words_by_all_separators(spark):
    said = "Hello\nworld\ta,b well/known X-Y it's\x0bso\u00a0on\u2014[Pause 3s]end"
    want = ["hello", "world", "a", "b", "well", "known", "x", "y", "it's", "so", "on", "end"]
    assert spark.createDataFrame([(said,)], "t string").select(T.normalize(F.col("t"))).first()[0] == want


def test_rendered_parts(spark):
    got = one(spark, T.rendered_parts(F.lit("well [pause 1.2s] then [pause 0.6s]")))
    assert [tuple(x) for x in got] == [(False, "well"), (True, "1.2"), (False, "then"), (True, "0.6")]


def test_a_wide_assignment_ends(spark):
    n = 1500
    rows = [(f"a{i:05}", f"b{i + d:05}", 1.0) for i in range(n) for d in (0, 1)]
    got = M.assign(spark.createDataFrame([("r", *x) for x in rows], "rec string, left string, right string, score double")).collect()
    assert len(got) == n and all(r["left"][1:] == r["right"][1:] for r in got)


# matching


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 3), st.integers(0, 10**6))
@settings(max_examples=200, deadline=None)
def test_assignment_is_best_and_lowest(n, m, top, seed):
    score = np.random.default_rng(seed).integers(0, top + 1, (n, m)).astype(float)
    got = M.best_assignment(score)
    k = max(n, m)
    best = max((sum(score[i, p[i]] for i in range(n) if p[i] < m), tuple(-x for x in p[:n])) for p in itertools.permutations(range(k)))
    assert sum(score[i, j] for i, j in enumerate(got) if j >= 0) == best[0]
    if n <= m:
        assert tuple(-j for j in got) == best[1]


def scores(spark, rows):
    return spark.createDataFrame([("r", a, b, float(s)) for a, b, s in rows], "rec string, left string, right string, score double")


def test_greedy_is_not_the_best_total(spark):
    s = scores(spark, [("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.85), ("b", "y", 0.5)])
    pairs = lambda d: sorted((r["left"], r["right"]) for r in d.collect())
    assert pairs(M.greedy(s)) == [("a", "x"), ("b", "y")]
    assert pairs(M.assign(s)) == [("a", "y"), ("b", "x")]
    assert pairs(M.greedy(s, 0.6)) == [("a", "x")]
    assert pairs(M.assign(s, 0.85)) == [("b", "x")]


def test_leftovers_pair_by_position(spark):
    pairs = spark.createDataFrame([("r", "a", "x")], "rec string, left string, right string")
    left = spark.createDataFrame([("r", c) for c in "abc"], "rec string, left string")
    right = spark.createDataFrame([("r", c) for c in "xyz"], "rec string, right string")
    assert sorted(tuple(r)[1:] for r in M.pair_leftovers(pairs, left, right).collect()) == [("a", "x"), ("b", "y"), ("c", "z")]


# scoring


def test_cp_wer_finds_the_mapping(spark):
    ref = spark.createDataFrame([("r", "A", "one two three"), ("r", "B", "four five")], "rec string, speaker string, text string")
    hyp = spark.createDataFrame([("r", "x", "four five"), ("r", "y", "one two"), ("r", "z", "extra")], "rec string, speaker string, text string")
    got = S.cp_wer(ref, hyp).first()
    assert (got["errors"], got["ref_words"], got["cp_wer"]) == (2, 5, 0.4)
    empty = S.cp_wer(ref.where("false"), hyp).first()
    assert (empty["errors"], empty["ref_words"], empty["cp_wer"]) == (5, 0, None)


def test_der(spark):
    ref = turns(spark, [("A", 0, 10), ("B", 10, 20)])
    got = S.der(ref, turns(spark, [("x", 0, 12), ("y", 12, 20), ("y", 25, 26)])).first()
    assert (got["missed_us"], got["false_alarm_us"], got["confusion_us"], got["ref_us"]) == (0, SEC, 2 * SEC, 20 * SEC)
    assert S.der(ref, ref).first()["der"] == 0
    collar = S.der(ref, turns(spark, [("x", 0, 10.1), ("y", 10.1, 20)]), collar_us=SEC // 4).first()
    assert collar["confusion_us"] == 0


def test_same_span_of_two_speakers_counts_twice(spark):
    ref = turns(spark, [("A", 0, 10), ("B", 0, 10)])
    got = S.der(ref, turns(spark, [("x", 0, 10)])).first()
    assert (got["missed_us"], got["ref_us"]) == (10 * SEC, 20 * SEC)


def test_consistency_and_fillers(spark):
    got = S.consistency(turns(spark, [("A", 0, 10)]), turns(spark, [("x", 0, 8), ("y", 8, 10)])).first()
    assert got["share"] == 0.8
    t = spark.createDataFrame([("r", "um um uh ok")], "rec string, text string")
    h = spark.createDataFrame([("r", "um hm")], "rec string, text string")
    assert tuple(S.filler_recall(t, h).first()) == ("r", 1, 3)


# windows


def test_pack_and_unpack(spark):
    clips = spark.createDataFrame([("r", i, n * SEC) for i, n in enumerate([10, 10, 40, 5])], "rec string, id long, length_us long")
    packed = N.pack_clips(clips)
    assert [(r["window"], r["offset_us"] // SEC) for r in packed.orderBy("id").collect()] == [(0, 0), (0, 11), (1, 0), (2, 0)]
    words = spark.createDataFrame([("r", 0, "b", 12 * SEC, 13 * SEC), ("r", 0, "gap", 10 * SEC, 11 * SEC)], "rec string, window long, word string, start_us long, end_us long")
    assert [(r["id"], r["start_us"]) for r in N.unpack(packed, words).collect()] == [(1, SEC)]


def test_windows_and_segments(spark):
    u = spark.createDataFrame([("r", i, s, int(a * SEC), int(b * SEC)) for i, (s, a, b) in enumerate([(0, 1, 5), (0, 5.5, 9), (0, 15, 16), (1, 17, 18)])], "rec string, id long, stretch long, start_us long, end_us long")
    w = N.make_windows(u)
    assert [r["window"] for r in w.orderBy("id").collect()] == [0, 0, 1, 2]
    s = N.window_segments(w.join(u.drop("stretch"), ["rec", "id"])).orderBy("id").collect()
    assert s[0]["start_us"] == 160_000 and all(r["start_us"] % 20_000 == 0 for r in s)
    m = spark.createDataFrame([("r", 0, 0, 0, 0, -150_000), ("r", 0, 1, 10_000, 30_000, -150_000), ("r", 0, 2, 500_000, 900_000, -150_000)], "rec string, window long, id long, start_us long, end_us long, window_start_us long")
    got = [(r["id"], r["start_us"], r["end_us"]) for r in N.window_segments(m, pad_us=0).orderBy("id").collect()]
    # stretched to 0.1 s, pushed on by the one before, cut at the window's end
    assert got == [(0, 160_000, 260_000), (1, 260_000, 360_000), (2, 660_000, 1_060_000)]


def test_runs_numbers_and_offsets(spark):
    assert one(spark, N.longest_run(F.split(F.lit("a b b b a"), " "))) == 3
    assert one(spark, N.spaced(F.lit(10), F.lit(4))) == [0, 2, 5, 7]
    f = N.first_appearance(turns(spark, [("x", 3, 4), ("y", 1, 2)])).orderBy("label").collect()
    assert [r["speaker"] for r in f] == ["y", "x"]
    t = N.timeline(spark.createDataFrame([("r", 1, 0, [1.0, 1.0]), ("r", 2, SEC, [2.0])], "rec string, id long, start_us long, samples array<double>"), 1).first()
    assert (t["frame"], t["samples"]) == (0, [1.0, 2.0])
    long = spark.createDataFrame([("r", 1, 0, [1.0] * 10), ("r", 2, 3 * SEC, [2.0] * 3), ("r", 3, 20 * SEC, [3.0])], "rec string, id long, start_us long, samples array<double>")
    frames = N.timeline(long, 1, frame=4).orderBy("frame").collect()
    assert [(r["frame"], r["first"], r["samples"]) for r in frames] == [(0, 0, [1.0] * 3 + [2.0]), (1, 4, [2.0] * 2 + [1.0] * 2), (2, 8, [1.0] * 2), (5, 20, [3.0])]


def test_scans_stream_over_batches(spark):
    df = spark.range(20_000).selectExpr("id % 3 as rec", "id as v")

    def scan(rows):
        n = 0
        for r in rows:
            n += 1
        yield r["rec"], n

    assert sorted(tuple(r) for r in ordered_scan(df, ["rec"], ["v"], scan, "rec long, n long").collect()) == [(0, 6667), (1, 6667), (2, 6666)]
    assert ordered_scan(df.where("false"), ["rec"], ["v"], scan, "rec long, n long").collect() == []


# identities


NOW = "rec string, label string, v array<double>, weight double, weak boolean, first_us long"
AXES = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0]}


def voice(by: dict):
    """A voice model that knows every label."""

    def embed(spans):
        v = F.create_map(*[F.lit(x) for k, a in by.items() for x in (k,)] and [y for k, a in by.items() for y in (F.lit(k), F.array(*map(F.lit, a)))])
        return spans.select("rec", "speaker").distinct().select("rec", "speaker", v[F.col("speaker")].alias("v"))

    return embed


def now(spark, *rows):
    return spark.createDataFrame([("r", label, AXES[axis], float(w), weak, i) for i, (label, axis, w, weak) in enumerate(rows)], NOW)


def told(df):
    return {r["label"]: (r["speaker"], r["fresh"]) for r in df.collect()}


def test_identities_are_kept_and_added(spark):
    none, nobody = spark.createDataFrame([], R.KNOWN), spark.createDataFrame([], "rec string, label string, speaker string")
    first = now(spark, ("x", "a", 1, False), ("y", "b", 1, False))
    who = R.identify(first, none, nobody)
    assert told(who) == {"x": ("Speaker_1", True), "y": ("Speaker_2", True)}
    known = R.learn(none, first, who)
    second = now(spark, ("q", "c", 1, False), ("p", "a", 1, True))
    who = R.identify(second, known, nobody)
    assert told(who) == {"q": ("Speaker_3", True), "p": ("Speaker_1", False)}
    weights = {r["speaker"]: r["weight"] for r in R.learn(known, second, who).collect()}
    assert weights == {"Speaker_1": 1.0, "Speaker_2": 1.0, "Speaker_3": 1.0}  # a weak print teaches nothing of a known voice
    # a fixed identity is not given to another label, whatever its voice
    fixed = spark.createDataFrame([("r", "p", "Speaker_2")], "rec string, label string, speaker string")
    assert told(R.identify(now(spark, ("p", "a", 1, False), ("s", "b", 1, False)), known, fixed)) == {"p": ("Speaker_2", False), "s": ("Speaker_3", True)}
    heavy = now(spark, ("p", "a", 500, False))
    capped = {r["speaker"]: r for r in R.learn(known, heavy, R.identify(heavy, known, nobody)).collect()}["Speaker_1"]
    assert capped["weight"] == 120.0 and capped["v"][0] == pytest.approx(120.0)


def test_shared_time_carries_identities_and_prints_hear_labels_alone(spark):
    before = turns(spark, [("Speaker_1", 0, 10)])
    assert [tuple(r) for r in R.carried(turns(spark, [("a", 5, 9), ("b", 0, 0.1)]), before).collect()] == [("r", "a", "Speaker_1")]
    got = {r["label"]: r for r in R.prints(turns(spark, [("a", 0, 5), ("b", 1, 3), ("c", 8, 40), ("c", 50, 60)]), voice(AXES)).collect()}
    assert (got["a"]["weak"], got["a"]["weight"]) == (False, 3.0) and (got["b"]["weak"], got["b"]["weight"]) == (True, pytest.approx(0.6))
    assert got["c"]["weight"] == 32.0 and got["c"]["first_us"] == 8 * SEC


def test_live_steps_commit_every_piece_once(spark, tmp_path):
    """Windows of one session, labelled anew each time, against all turns at once."""
    true = [("a", 0, 6), ("b", 5, 9), ("a", 9, 14), ("c", 14, 18), ("b", 18.2, 21), ("a", 21, 24)]
    names, out = ["xyz", "zxy", "yzx"], []
    live = L.Live(spark, str(tmp_path / "state"), voice(AXES), lambda rows, n: out.extend((n, *r) for r in rows.collect()))
    schema = "rec string, label string, start_us long, end_us long, flush boolean"
    for n, heard in enumerate([8, 17, 24, 24]):
        called = dict(zip("abc", names[n % 3], strict=True))
        live.embed = voice({called[k]: v for k, v in AXES.items()})
        window = L.rolling(turns(spark, [t for t in true if t[1] < heard]), spark.createDataFrame([("r", heard * SEC)], "rec string, heard_us long"), 14 * SEC)
        rows = [("r", called[r["speaker"]], r["start_us"], r["end_us"], False) for r in window.collect()] + [("r", None, None, heard * SEC, n == 3)]
        live.batch(spark.createDataFrame(rows, schema), n)
        if n == 1:  # a batch that runs again puts out the same
            once = [r[1:] for r in out if r[0] == 1]
            live.batch(spark.createDataFrame(rows, schema), n)
            assert [r[1:] for r in out if r[0] == 1] == once * 2
            del out[len(out) - len(once) :]
    ends = [(s / SEC, e / SEC, tuple(w)) for _, _, s, e, w, *_ in sorted(out, key=lambda r: r[2])]
    assert all(a[1] <= b[0] for a, b in itertools.pairwise(ends)) and ends[0][0] == 0 and ends[-1][1] == 24
    joined = []
    for s, e, w in ends:
        if joined and joined[-1][2] == w and joined[-1][1] == s:
            joined[-1] = (joined[-1][0], e, w)
        else:
            joined.append((s, e, w))
    who = {"a": "Speaker_1", "b": "Speaker_2", "c": "Speaker_3"}
    assert joined == spans(I.build_segments(turns(spark, [(who[k], s, e) for k, s, e in true])))
    # the first segment of a later step knows what was committed before it; the last but one expects more
    starts = {}
    for n, _, s, _, _, before, after in sorted(out, key=lambda r: (r[0], r[2])):
        starts.setdefault(n, []).append((s, before, after))
    steps = sorted(starts)
    assert all(starts[n][-1][2] for n in steps[:-1]) and not starts[steps[-1]][-1][2]
    # at 5 s a speaker goes on, at 14 and 21 s another begins
    assert [starts[n][0][:2] for n in steps[1:]] == [(5 * SEC, True), (14 * SEC, False), (21 * SEC, False)]


@pytest.mark.parametrize("collar", [0, SEC])
def test_der_of_crowded_turns_needs_no_lists_of_speakers(spark, monkeypatch, collar):
    """Totals by running sums of edges, not by joining every piece with the turns over it; the same as counted second by second."""
    monkeypatch.setattr(I, "elementary", None)
    monkeypatch.setattr(S, "elementary", None, raising=False)
    rng = np.random.default_rng(6)
    spans = lambda names: [(str(rng.choice(list(names))), int(s), int(s + rng.integers(0, 40))) for s in rng.integers(0, 200, 60)]
    ref, hyp = spans("ABC"), spans("xyz")
    got = S.der(turns(spark, ref), turns(spark, hyp), collar_us=2 * collar).first()
    shared = {(a, b): sum(max(0, min(e, f) - max(s, t)) for x, s, e in ref for y, t, f in hyp if (x, y) == (a, b)) for a in "ABC" for b in "xyz"}
    best = max(itertools.permutations("xyz"), key=lambda p: sum(shared[a, b] for a, b in zip("ABC", p, strict=True)))
    missed = false = wrong = total = 0
    for t in range(-5, 300):
        if collar and any(x - 1 <= t < x + 1 for _, s, e in ref if e > s for x in (s, e)):
            continue
        r, h = {a for a, s, e in ref if s <= t < e}, {b for b, s, e in hyp if s <= t < e}
        right = sum(b in h for a, b in zip("ABC", best, strict=True) if a in r)
        missed, false, wrong, total = missed + max(0, len(r) - len(h)), false + max(0, len(h) - len(r)), wrong + min(len(r), len(h)) - right, total + len(r)
    assert [got[c] for c in ("missed_us", "false_alarm_us", "confusion_us", "ref_us")] == [x * SEC for x in (missed, false, wrong, total)]


def of_turns(rows):
    return M._Turns({"speaker": a, "start_us": s, "end_us": e} for a, s, e in sorted(rows))


@pytest.mark.parametrize("held", [10**6, 0])
def test_most_shared_is_best_and_lowest(monkeypatch, held):
    """Against all assignments of known pairs, rows in order taking the lowest they may; the pairs held at once, or found by prices."""
    monkeypatch.setattr(M, "HELD_PAIRS", held)
    monkeypatch.setattr(M, "BEST_PAIRS", 1)
    rng = np.random.default_rng(8)
    for _ in range(150):
        spans = lambda: [(f"s{rng.integers(5)}", int(s), int(s + rng.integers(1, 12))) for s in rng.integers(0, 25, rng.integers(1, 12))]
        ref, hyp = spans(), spans()
        left, right = of_turns(ref), of_turns(hyp)
        score = np.array([[sum(max(0, min(e, f) - max(s, t)) for a, s, e in ref for b, t, f in hyp if (a, b) == (x, y)) for y in right.names] for x in left.names])
        m = len(right)
        ways = (p for p in itertools.product(range(m + 1), repeat=len(left)) if all(y == m or score[x, y] for x, y in enumerate(p)) and len({y for y in p if y < m}) == sum(y < m for y in p))
        best = max(ways, key=lambda p: (sum(score[x, y] for x, y in enumerate(p) if y < m), tuple(-y for y in p)))
        assert M._most_shared(left, right).tolist() == [y if y < m else -1 for y in best]


def test_der_of_many_speakers_needs_no_matrix(spark, monkeypatch):
    """Thousands of speakers that meet, each hypothesis with the next one's turn too: turns are assigned, not all pairs of them."""
    monkeypatch.setattr(S, "overlap_matrix", None)
    n = 4000
    ref = [(f"a{i:04}", 10 * i, 10 * i + 12) for i in range(n)]
    got = S.der(turns(spark, ref), turns(spark, [(f"x{i:04}", s, e + 3) for i, (_, s, e) in enumerate(ref)])).first()
    # neighbours overlap: of each 15 s of a hypothesis 12 are right, and 3 more of it lie beside other speakers
    spans, extra = [(s, e) for _, s, e in ref], [(s, e + 3) for _, s, e in ref]
    steps = np.zeros((2, 10 * n + 20), dtype=int)
    for k, side in enumerate((spans, extra)):
        for s, e in side:
            steps[k, s:e] += 1
    r, h = steps
    both = np.minimum(r, h).sum() - 12 * n
    assert [got[c] for c in ("missed_us", "false_alarm_us", "confusion_us", "ref_us")] == [x * SEC for x in (int(np.maximum(0, r - h).sum()), int(np.maximum(0, h - r).sum()), int(both), 12 * n)]
