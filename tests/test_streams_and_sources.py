"""Streaming commits against batch, the offline plan, and files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.plans.transcribe import packed_recogniser, score, stand_in_recogniser, transcribe
from colloquy.sources import files
from colloquy.streaming.commit import Session, commit_batch, commit_stream, status

SEC = 1_000_000
TURNS = "rec string, speaker string, start_us long, end_us long"


def some_turns(n=40, seed=1):
    rng, t, out = np.random.default_rng(seed), 0, []
    for i in range(n):
        t += int(rng.integers(0, 3 * SEC))
        out.append((f"r{i % 2}", "AB"[int(rng.integers(0, 2))], t, t + int(rng.integers(SEC, 6 * SEC))))
    return out


def active(rows):
    """Time by recording and speaker, as sorted unions of spans, in milliseconds."""
    out = {}
    for rec, who, a, b in rows:
        out.setdefault((rec, who), set()).update(range(a // 1000, b // 1000))
    return out


def test_session_commits_once_and_flush_takes_the_tail():
    s = Session()
    s.feed("A", 0, 10 * SEC)
    assert s.commit(7 * SEC) == [("A", 0, 7 * SEC)] and s.commit(7 * SEC) == []
    s.feed("B", SEC, 5 * SEC)
    assert s.late == 1
    s.feed("B", 5 * SEC, 7 * SEC + 100)
    assert s.commit(s.heard) == [("B", 7 * SEC, 7 * SEC + 100), ("A", 7 * SEC, 10 * SEC)]
    assert s.pending == []


def test_batch_commit_keeps_every_turn(spark):
    rows = [(r, s, a // 1000 * 1000, b // 1000 * 1000) for r, s, a, b in some_turns()]
    got = commit_batch(spark.createDataFrame(rows, TURNS)).collect()
    assert active([tuple(r) for r in got]) == active(rows)
    assert sum(r["end_us"] - r["start_us"] for r in got) == sum(b - a for _, _, a, b in rows)
    assert len(got) > len(rows)


def test_stream_commits_the_same_time_as_batch(spark, tmp_path):
    rows = [(r, s, a // 1000 * 1000, b // 1000 * 1000) for r, s, a, b in some_turns()]
    for k in range(0, len(rows), 8):
        part = [(*r, False) for r in rows[k : k + 8]]
        spark.createDataFrame(part, TURNS + ", flush boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # files are taken in order of time
        import time

        time.sleep(1.1)
    spark.createDataFrame([(f"r{i}", None, None, None, True) for i in range(2)], TURNS + ", flush boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = files.replay(spark, str(tmp_path / "in"), TURNS + ", flush boolean")
    q = commit_stream(stream).writeStream.format("memory").queryName("committed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = spark.table("committed")
    assert active([tuple(r)[:4] for r in got.collect()]) == active(rows)
    lag = {r["rec"]: r["lag_us"] for r in status(got, spark.createDataFrame(rows, TURNS)).collect()}
    assert lag == {"r0": 0, "r1": 0}


def test_transcript_of_known_words_has_every_word_once(spark):
    turns = [("m", "Speaker_1", 0, 5 * SEC), ("m", "Speaker_2", 6 * SEC, 12 * SEC), ("m", "Speaker_1", 11 * SEC, 15 * SEC)]
    words = [("m", f" w{i}", i * SEC + 200_000, i * SEC + 700_000) for i in range(15) if i != 5]
    w = spark.createDataFrame(words, "rec string, word string, start_us long, end_us long")
    names = spark.createDataFrame([("Speaker_1", "Ann")], "label string, name string")
    lines = transcribe(spark.createDataFrame(turns, TURNS), stand_in_recogniser(w), names)
    got = lines.orderBy("start_us").collect()
    said = " ".join(r["text"] for r in got).split()
    assert sorted(x for x in said if x.startswith("w")) == sorted(x[1].strip() for x in words)
    assert got[0]["speaker"] == "Ann" and got[0]["line"].startswith("[00:00.2] Ann: w0")
    assert any(r["overlap"] for r in got)
    ref = spark.createDataFrame([(*t, "x") for t in turns], TURNS + ", text string")
    assert set(score(ref, lines)) == {"cp_wer", "fillers", "der", "consistency"}
    assert score(ref, lines)["der"].first()["ref_us"] == 15 * SEC


def test_separated_overlaps_are_lines_of_their_owners(spark):
    axes = {"Speaker_1": [1.0, 0.0], "Speaker_2": [0.0, 1.0]}
    turns = [("m", "Speaker_1", 0, 10 * SEC), ("m", "Speaker_2", 6 * SEC, 16 * SEC)]
    words = [("m", who, f" {who[-1]}w{i}", i * SEC + 200_000, i * SEC + 700_000) for who, a, b in (("Speaker_1", 0, 10), ("Speaker_2", 6, 16)) for i in range(a, b)]
    w = spark.createDataFrame(words, "rec string, speaker string, word string, start_us long, end_us long")
    # streams come in arbitrary order, the third too quiet; their voices lean to one speaker
    separate = lambda j: j.select("rec", "job", F.explode(F.array(*[F.struct(F.lit(s).alias("stream"), F.lit(r).alias("rms")) for s, r in (("s0", 0.5), ("s1", 0.4), ("s2", 0.01))])).alias("s")).select("rec", "job", "s.*")
    lean = lambda s: s.withColumn("v", F.when(F.col("stream") == "s0", F.array(F.lit(0.1), F.lit(0.9))).otherwise(F.array(F.lit(0.9), F.lit(0.2))))
    embed = lambda spans: spans.select("rec", "speaker").distinct().withColumn("v", F.when(F.col("speaker") == "Speaker_1", F.array(*map(F.lit, axes["Speaker_1"]))).otherwise(F.array(*map(F.lit, axes["Speaker_2"]))))

    def windows(layout):
        p, k = layout.alias("p"), w.alias("k")
        inside = (F.col("p.rec") == F.col("k.rec")) & (F.col("k.start_us") >= F.col("p.clip_start_us")) & (F.col("k.end_us") <= F.col("p.clip_start_us") + F.col("p.length_us"))
        at = lambda c: (F.col(f"k.{c}") - F.col("p.clip_start_us") + F.col("p.offset_us")).alias(c)
        return p.join(k, inside).select("p.rec", "p.window", "k.word", at("start_us"), at("end_us"))

    df = spark.createDataFrame(turns, TURNS)
    for packed in (None, packed_recogniser(windows)):
        lines = transcribe(df, stand_in_recogniser(w), None, separate, lean, embed, packed).orderBy("start_us", "speaker").collect()
        said = {}
        for r in lines:
            said.setdefault(r["speaker"], []).extend(r["text"].split())
        assert {k: sorted(x for x in v if "w" in x) for k, v in said.items()} == {s: sorted(x[2].strip() for x in words if x[1] == s) for s in axes}
        assert sum(r["overlap"] for r in lines) == 2
    # without separation the overlap is one line of both, and nothing in it is judged strictly
    joint = [r for r in transcribe(df, stand_in_recogniser(w.drop("speaker"))).collect() if r["overlap"]]
    assert [r["speaker"] for r in joint] == ["Speaker_1+Speaker_2"]
    called = spark.createDataFrame([("Speaker_2", "Bo")], "label string, name string")
    assert {r["speaker"] for r in transcribe(df, stand_in_recogniser(w.drop("speaker")), called).collect()} == {"Speaker_1", "Bo", "Speaker_1+Bo"}


def test_references(spark, tmp_path):
    (tmp_path / "a.rttm").write_text("SPEAKER f 1 1.5 2.0 <NA> <NA> s1 <NA> <NA>\nSPKR-INFO f 1 <NA>\nSPEAKER short\n")
    assert [tuple(r) for r in files.read_rttm(spark, str(tmp_path / "a.rttm")).collect()] == [("f", "s1", 1_500_000, 3_500_000)]
    (tmp_path / "m.json").write_text(json.dumps({"turns": [{"speaker": "A", "start": 0.1, "end": 1, "text": " "}, {"speaker": "B", "start": 1, "end": 2, "text": "hi"}]}))
    ref = files.read_reference(spark, str(tmp_path / "m.json"))
    assert ref.count() == 2 and [r["rec"] for r in files.with_text(ref).collect()] == ["m"]
    assert files.read_diarization(spark, str(tmp_path / "m.json")).count() == 2
    files.write_reference(ref, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert back.first()["turns"][0]["start"] == 0.1


def test_wav_round_trip(spark, tmp_path):
    x = np.sin(np.arange(800) / 20) * 0.5
    (tmp_path / "x.wav").write_bytes(files.wav_bytes(x, 8000))
    r = files.read_wav(spark, str(tmp_path / "x.wav")).first()
    assert r["rate"] == 8000 and np.allclose(r["samples"], x, atol=1e-4)
    data = spark.createDataFrame([(x.tolist(), 8000)], "s array<double>, rate int").select(files.encode_wav("s", "rate")).first()[0]
    assert bytes(data) == files.wav_bytes(x, 8000)


def test_wav_at_another_rate(spark, tmp_path):
    x = np.sin(2 * np.pi * 5 * np.arange(8000) / 8000) * 0.5
    (tmp_path / "x.wav").write_bytes(files.wav_bytes(x, 8000))
    r = files.read_wav(spark, str(tmp_path / "x.wav"), 4000).first()
    assert r["rate"] == 4000 and np.abs(np.array(r["samples"]) - x[::2])[100:-100].max() < 0.01


def test_meetings_cases_and_truth(spark, tmp_path):
    rows = [("m1", "s1", 0.0, 1.0, "Hi, THERE!", 1), ("m1", "s2", 1.0, 5.0, "?!", 2), ("m2", "s1", 0.0, 9.0, "no no no no no way", 3)]
    spark.createDataFrame(rows, "meeting_id string, speaker_id string, begin_time double, end_time double, text string, audio int").write.parquet(str(tmp_path / "u"))
    assert [r["text"] for r in files.read_meetings(spark, str(tmp_path / "u"), drop_repeats=True).collect()] == ["hi there"]
    assert files.read_meetings(spark, str(tmp_path / "u")).count() == 2
    paths = ["d/mix_clean/1.wav", "d/s1/1.wav", "d/s2/1.wav", "d/mix_clean/2.wav", "d/s1/2.wav", "e/case/mix.wav", "e/case/s1.wav", "e/case/s2.wav", "x.wav"]
    found = files.separation_cases(spark.createDataFrame([(p,) for p in paths], "path string")).orderBy("name").collect()
    assert [tuple(r) for r in found] == [("1.wav", "d/mix_clean/1.wav", "d/s1/1.wav", "d/s2/1.wav"), ("case", "e/case/mix.wav", "e/case/s1.wav", "e/case/s2.wav")]
    files.write_truth(spark.createDataFrame([(1, 16000, 0.0, 2 * SEC, SEC, 3 * SEC), (2, 16000, 5.0, SEC, 2 * SEC, SEC)], "id long, rate int, snr_db double, first_us long, offset_us long, second_us long"), str(tmp_path / "truth"))
    truth = {r["id"]: r for r in spark.read.json(str(tmp_path / "truth")).collect()}
    assert truth[1]["overlap"] == [1.0, 2.0] and truth[2]["overlap"] is None and truth[1]["turns"][1]["end"] == 4.0
    files.write_pairs(spark.createDataFrame([("m", "Hello", " hi ")], "rec string, ref string, hyp string"), str(tmp_path / "pairs"))
    assert spark.read.json(str(tmp_path / "pairs")).first()["hyp"] == "hi"


def test_tables_of_utterances(spark, tmp_path):
    rows = [("m1", "s1", 0.0, 1.0, "hi", 1), ("m1", "s2", 1.0, 5.0, " ", 2), ("m2", "s1", 0.0, 9.0, "yo", 3)]
    spark.createDataFrame(rows, "meeting_id string, speaker_id string, begin_time double, end_time double, text string, audio int").write.parquet(str(tmp_path / "u"))
    u = files.read_utterances(spark, str(tmp_path / "u"), "m1")
    assert [tuple(r) for r in u.collect()] == [("m1", "s1", 0, SEC, "hi")]
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "audio" not in plan
    assert files.shuffled(files.read_utterances(spark, str(tmp_path / "u")), "text", 7, 1, max_us=2 * SEC).count() == 1
    spark.createDataFrame([("m", ["a", "b"], [0.0, 1.0], [1.0, 2.0])], "rec string, speakers array<string>, timestamps_start array<double>, timestamps_end array<double>").write.parquet(str(tmp_path / "a"))
    assert files.read_annotations(spark, str(tmp_path / "a")).count() == 2
    lines = spark.createDataFrame([("m", 2, "b"), ("m", 1, "a")], "rec string, start_us long, line string")
    files.write_transcript(lines, str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t" / "rec=m")).collect()] == ["a", "b"]
    left = spark.createDataFrame([("x/1.wav",), ("x/2.wav",)], "path string")
    assert files.match_files(left, left.limit(1)).count() == 1 and files.match_files(left, left.limit(1), True).count() == 2


def test_windows_and_samples(spark, tmp_path):
    w = spark.createDataFrame([("r", "s", i, [0.5] * (i + 1)) for i in range(3)], "rec string, speaker string, window long, samples array<double>")
    files.write_windows(w, str(tmp_path / "w"))
    got = files.read_windows(spark, str(tmp_path / "w"), 1, 1).orderBy("window").collect()
    assert [(r["offset"], r["length"], len(r["samples"])) for r in got] == [(0, 1, 0), (2, 2, 1), (6, 3, 1)]
    s = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, title string")
    audio = spark.createDataFrame([("/x/a.wav",), ("/x/b.wav",)], "path string")
    truth = spark.createDataFrame([("/t/a.json", "p"), ("/t/a.json", "q")], "path string, speaker string")
    assert [(r["id"], r["speakers"]) for r in files.discover(s, audio, truth).orderBy("id").collect()] == [("a", 2), ("b", 0)]


def test_pcm_stream_and_sink(spark, tmp_path):
    from colloquy.streaming import live

    (tmp_path / "x.pcm").write_bytes(np.full(1000, 16384, "<i2").tobytes())
    assert [len(r[1]) for r in live.Chunks(str(tmp_path / "x.pcm"), 800)._rows(0, None)] == [800, 800, 400]
    chunks = spark.createDataFrame([(0, np.full(4, 16384, "<i2").tobytes())], "chunk long, data binary")
    assert live.pcm_levels(chunks).first()["rms"] == 0.5
    lines = spark.createDataFrame([("r", "A", 0, SEC, "hi", False)], TURNS + ", text string, overlap boolean")
    assert json.loads(live.messages(lines).first()["message"])["speaker"] == "A"
    late = spark.createDataFrame([("r", 1, 4), ("r", 2, 9)], "rec string, end_us long, committed_at_us long")
    assert tuple(live.latency(late).first()) == ("r", 5.0, 7)


@pytest.mark.parametrize("cut", [1, 7, 100])
def test_box_resampler_carries_over_chunks(cut):
    from colloquy.streaming.live import BoxResampler

    x = np.arange(480, dtype=float)
    whole = BoxResampler(48000, 16000).feed(x)
    r = BoxResampler(48000, 16000)
    assert np.allclose(np.concatenate([r.feed(x[i : i + cut]) for i in range(0, 480, cut)]), whole) and len(whole) == 160
