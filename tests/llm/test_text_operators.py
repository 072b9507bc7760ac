"""The text operators against brute force, on small tables and on odd rows."""

import binascii
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from colloquy.llm import ann, chat, jaccard, licenses, line_dedup, packing, pieces, quality, queries, warc
from colloquy.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(30000))
ODD = [(1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "One two"), (6, "one two"), (6, "one two"), (7, "a b c d"), (8, "A b\x0bc\rd"), (9, "é ü ñ 日本 語"), (10, LONG), (11, LONG), (12, "x" * 5000), (None, "a b c d"), (None, None)]
ODD_SCHEMA = "doc_id long, text string"


def odd(spark):
    """ODD with an extra column whose name clashes with names the operators use."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(ODD, ODD_SCHEMA)
    return d.withColumns({c: F.lit(None).cast("string") for c in ("key", "sid", "lang", "task", "rank", "gone", "stratum", "a", "b", "words", "kept", "_t", "_w", "_id", "_gone")})


def none(spark):
    return odd(spark).where("false")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_doc(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


# 4: n-gram Jaccard join


def shingles(text, width):
    w = WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(rows, width, num, den):
    sets = [(i, shingles(t, width)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for (i, (_, a)), (j, (_, b)) in itertools.combinations(enumerate(sets), 2):
        if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
            up[top(j)] = top(i)
    least = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return sorted(((i, len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize(("width", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_documents(spark, sf, width, num, den):
    d = documents(spark, sf)
    got = jaccard.jaccard_components(d, width, num, den).collect()
    want = brute_components([(r["doc_id"], r["text"]) for r in d.collect()], width, num, den)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_jaccard_near_copies_of_all_sizes(spark):
    rng, rows = np.random.default_rng(5), []
    for size in (4, 8, 11, 12, 18, 20, 21, 22, 25, 30, 60, 200):
        for _ in range(4):
            base = [f"v{x}" for x in rng.integers(0, 10_000, size + 2)]
            for _ in range(5):
                w = list(base)
                for _ in range(rng.integers(0, 3)):
                    w[rng.integers(0, len(w))] = f"n{rng.integers(0, 10**6)}"
                rows.append((len(rows), " ".join(w[: len(w) - rng.integers(0, 2)])))
    d = spark.createDataFrame(rows, ODD_SCHEMA)
    for width, num in ((3, 90), (1, 80)):
        got = jaccard.jaccard_components(d, width, num, 100).collect()
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(rows, width, num, 100)


def test_jaccard_common_shingles_change_nothing(spark, sf, monkeypatch):
    d = documents(spark, sf)
    want = sorted(jaccard.jaccard_components(d, 5, 80, 100).collect(), key=str)
    monkeypatch.setattr(jaccard, "COMMON", 3)
    assert sorted(jaccard.jaccard_components(d, 5, 80, 100).collect(), key=str) == want


def test_jaccard_odd_rows(spark):
    got = jaccard.jaccard_components(odd(spark), 3, 90, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute_components(ODD, 3, 90, 100)
    assert jaccard.jaccard_components(none(spark), 3, 90, 100).collect() == []


def test_jaccard_rows_without_id_link_others(spark):
    w = [f"w{i}" for i in range(64)]
    bridge = [*w[:61], "x"]
    rows = [(1, " ".join([*bridge[:60], "p", "q"])), (2, " ".join(["r", "s", *bridge[2:]])), (None, " ".join(bridge)), (3, "nothing like the others at all")]
    want = brute_components(rows, 3, 90, 100)
    assert [c for i, _, c in want if i != 3] == [1, 1, 1] and {c for *_, c in brute_components(rows[:2], 3, 90, 100)} == {1, 2}
    got = jaccard.jaccard_components(spark.createDataFrame(rows, ODD_SCHEMA), 3, 90, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == want


def test_word_hashes_cut_long_texts(monkeypatch):
    texts = pa.array(["a bb  ccc", "", " x ", "word " * 50, "y" * 300 + " z", "\n"])
    whole = [w.tolist() for w in jaccard.word_hashes(texts)]
    assert [len(w) for w in whole] == [3, 0, 1, 50, 2, 0]
    monkeypatch.setattr(jaccard, "SEGMENT", 16)
    assert [w.tolist() for w in jaccard.word_hashes(texts)] == whole


@given(st.integers(1, 400), st.integers(0, 40), st.integers(0, 10**6))
@settings(max_examples=150, deadline=None)
def test_linked_sets_share_a_list(n, changes, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    drop = rng.integers(0, changes + 1)
    b = np.unique(np.r_[a[min(drop, len(a) - 1) :], rng.integers(0, 1 << 63, changes - drop).astype(np.uint64)])
    for num in (80, 90):
        both = len(np.intersect1d(a, b))
        if 100 * both >= num * (len(a) + len(b) - both):
            common = rng.integers(0, 256, jaccard.COMMON_BITS // 8).astype(np.uint8)
            for bits in (None, common):
                assert set(jaccard.prefix_keys(a, num, 100, bits)) & set(jaccard.prefix_keys(b, num, 100, bits))


# 7: quality rules


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_words_alike_to_a_polynomial_are_apart(spark):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper()), (4, word[:60]), (5, word[60:120])]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, ODD_SCHEMA), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)]


def test_components_by_rounds(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(3000, 2999)]
    labels = jaccard.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    assert {r["cid"]: r["comp"] for r in labels} == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000), 2999: 2999, 3000: 2999}


def test_quality_counts(spark, sf):
    d = documents(spark, sf)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    for r in quality.judge(d, labels).collect():
        assert tuple(r)[1:7] == brute_quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (4, None, None), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.judge(odd(spark), labels).collect()
    assert sorted([tuple(r)[:7] for r in got], key=str) == sorted([(i, *brute_quality(t)) for i, t in ODD], key=str)
    kept = quality.accepted(odd(spark), labels)
    assert kept.columns == odd(spark).columns
    assert quality.judge(none(spark), labels.where("false")).collect() == []
    assert quality.accepted(none(spark), labels).collect() == []


def test_quality_cutoffs_reject_junk_only_when_certified(spark):
    rows = [(i, " ".join(f"word{k * 7 % 61}" for k in range(60)), "en", 1) for i in range(1600)]
    rows += [(i, " ".join(f"w{i}k{k}$$$" for k in range(60)), "en", 0) for i in range(1600, 1700)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    judged = {r["doc_id"]: r["kept"] for r in quality.judge(d.drop("quality"), d.select("doc_id", "quality")).collect()}
    assert all(judged[i] for i in range(1600)) and not any(judged[i] for i in range(1600, 1700))
    few = quality.judge(d.drop("quality"), d.select("doc_id", "quality").limit(20)).collect()
    assert all(r["kept"] for r in few)


def brute_kept(rows, labels, risk=0.01, error=0.05):
    """Verdicts by the definition: scales, strata, exact binomial tails by summing, fixed sequence."""
    from math import comb

    def measures(t):
        n, chars, symbols, dup, rep, _ = brute_quality(t)
        lines = len([x for x in (t or "").split("\n") if WORD.search(x)])
        capitals = len([c for c in t or "" if c.isupper()])
        return symbols / max(chars, 1), capitals / max(chars, 1), (t or "").count("!") / max(n, 1), dup / max(lines, 1), rep / max(n, 1), chars / max(n, 1)

    m = {i: measures(t) for i, t, _ in rows}
    fails = {i: brute_quality(t)[5] for i, t, _ in rows}
    fit = {i: zlib.crc32(str(i).encode()) % 2 == 0 for i, *_ in rows}
    good = [(i, s) for i, _, s in rows if labels.get(i) == 1 and not fails[i]]
    strata = {s for i, _, s in rows if i in labels and not fails[i]}
    own = {s for s in strata if (1 - risk) ** sum(g == s and not fit[i] for i, g in good) <= error / (len(strata) + 1)}
    name = lambda s: s if s in own else ""
    least = [quality.LEAST_SCALE[x] for x in quality.MEASURES]
    scale, cut = {}, {}
    held = {name(s) for i, s in good if not fit[i]}
    for s in {*own, ""}:
        mine = [m[i] for i, g in good if name(g) == s and fit[i]]
        scale[s] = [max(lo, sorted(c)[-(-99 * len(c) // 100) - 1]) for lo, c in zip(least, zip(*mine, strict=True), strict=True)] if mine else least
        excess = [max(x / y for x, y in zip(m[i], scale[s], strict=True)) for i, g in good if name(g) == s and not fit[i]]
        cut[s] = float("inf")
        for c in quality.CUTOFFS if excess else ():
            k, n = sum(e > c for e in excess), len(excess)
            if sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(k + 1)) > error / len(held):
                break
            cut[s] = c
    return {i: not fails[i] and max(x / y for x, y in zip(m[i], scale[name(s)], strict=True)) <= cut[name(s)] for i, _, s in rows}, cut


def test_quality_verdicts_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], {}
    for i in range(5200):
        lang = ("en", "de", "fr", "es")[0 if i < 3000 else 1 + i % 3]
        junk = i % 9 == 0
        words = [f"w{x}" for x in rng.integers(0, 9000, 60)]
        for k in rng.integers(0, 60, int(rng.integers(0, 4)) + 18 * junk):
            words[k] += "$#!"[int(rng.integers(0, 3))] * 2
        rows.append((i, " ".join(words), lang))
        if i % 5:
            labels[i] = int(not junk)
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame(list(labels.items()), "doc_id long, quality int")
    want, cut = brute_kept(rows, labels)
    assert {r["doc_id"]: r["kept"] for r in quality.judge(d, told).collect()} == want
    assert set(cut) == {"en", ""} and all(c < float("inf") for c in cut.values())
    assert {r["doc_id"] for r in quality.accepted(d, told).collect()} == {i for i, k in want.items() if k}


# 2: line dedup

PASSAGE = "\n".join(" ".join(f"pas{i}word{j}" for j in range(22)) for i in range(3))


def unique_lines(k, n=6):
    return ["line %d of text %d tells of %d things that no other line has" % (i, k, k * 100 + i) for i in range(n)]


def test_line_dedup_removes_later_passages(spark):
    rows = []
    for k in range(6):
        lines = unique_lines(k)
        rows.append((k, "\n".join([*lines[:k], PASSAGE, *lines[k:]])))
    rows.append((7, "\n".join(unique_lines(7))))
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(spark.createDataFrame(rows, ODD_SCHEMA)).collect()}
    assert got[0]["text"] == rows[0][1]
    assert got[7]["text"] == rows[6][1] and got[7]["removed_chunks"] == 0
    for k in range(1, 6):
        assert "pas1word" not in got[k]["text"] and got[k]["text"] == "\n".join(unique_lines(k))


def test_line_dedup_removes_whole_passages_of_short_lines(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"{'abcdefghij'[rng.integers(0, 10)]}{rng.integers(0, 10**4)}"
    short = lambda words: " ".join(word() for _ in range(words))
    rows, want = [], {}
    for case in range(60):
        passage = [short(words) for words in ([8] * 7, [7] * 8, [6] * 9)[case % 3]]
        if case % 4 == 0:
            passage[3:3] = ["", ""]
        assert all(len(x) < line_dedup.LONG_CHARS for x in passage)
        for i in (2 * case, 2 * case + 1):
            before, after = [short(5) for _ in range(rng.integers(0, 4))] + [""] * (case % 2), [""] * (case % 2) + [short(5) for _ in range(rng.integers(0, 4))]
            rows.append((i, "\n".join([*before, *passage, *after])))
            want[i] = "\n".join([*before, *passage, *after] if i % 2 == 0 else [*before, *after])
    # 20 words that two documents share, next to 20 others of a third, are no passage of 25
    a, b = [short(5) for _ in range(4)], [short(5) for _ in range(4)]
    rows += [(1000, "\n".join(a)), (1001, "\n".join(b)), (1002, "\n".join(a + b)), (1003, "\n".join(["same old line of words"] * 12))]
    want |= {i: t for i, t in rows if 1000 <= i < 1003} | {1003: "\n".join(["same old line of words"] * 2)}
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, ODD_SCHEMA)).collect()}
    assert got == want


def brute_dedup(rows, least=line_dedup.MIN_WORDS):
    """All units of all texts, compared as texts; later ones go where their runs are long enough."""
    count = lambda x: len(WORD.findall(x))
    places, lines = collections.defaultdict(list), {i: t.split("\n") for i, t in rows}
    for i, all_lines in lines.items():
        full = [n for n, x in enumerate(all_lines) if count(x)]
        for k, n in enumerate(full):
            if len(all_lines[n]) >= line_dedup.LONG_CHARS:
                places["\n", all_lines[n]].append((i, k, n, None))
            if k + 1 < len(full) and not all(len(all_lines[x]) >= line_dedup.LONG_CHARS for x in full[k : k + 2]):
                places["pair", "\n".join(all_lines[n : full[k + 1] + 1])].append((i, k, n, full[k + 1]))
    marks = collections.defaultdict(lambda: [False, False])
    for (kind, _), found in places.items():
        first = min(found)[:2]
        for i, k, n, q in found:
            if (i, k) > (first[0], first[1] + (kind == "pair")):
                marks[i, k, n][0] |= kind == "\n"
                if q is not None:
                    marks[i, k, n][0] |= False
                    marks[i, k + 1, q][1] = True
    out = {}
    for i, all_lines in lines.items():
        mine = sorted((k, n) for j, k, n in marks if j == i)
        runs = []
        for k, n in mine:
            alone, linked = marks[i, k, n]
            if runs and runs[-1][-1][0] == k - 1 and (linked or alone and marks[i, k - 1, runs[-1][-1][1]][0]):
                runs[-1].append((k, n))
            else:
                runs.append([(k, n)])
        gone = {x for r in runs if sum(count(all_lines[n]) for _, n in r) >= least for x in range(r[0][1], r[-1][1] + 1)}
        out[i] = "\n".join(x for n, x in enumerate(all_lines) if n not in gone)
    return out


def test_line_dedup_by_brute_force(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    rng = np.random.default_rng(4)
    pool = [" ".join(f"{'abcdefghij'[x % 10]}{x}" for x in rng.integers(0, 40, int(rng.integers(0, 14)))) for _ in range(60)]
    rows += [(10**6 + k, "\n".join(pool[x] for x in rng.integers(0, 60, int(rng.integers(1, 12))))) for k in range(300)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(spark.createDataFrame(rows, ODD_SCHEMA)).collect()}
    assert got == brute_dedup(rows)


def test_line_dedup_odd_rows(spark):
    got = line_dedup.without_repeats(odd(spark))
    assert got.columns == [*odd(spark).columns, "removed_chunks"]
    want = sorted([(i, "" if i == 11 else t) for i, t in ODD], key=str)
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == want
    assert line_dedup.without_repeats(none(spark)).collect() == []


def test_chunks_join_to_the_text(spark, sf):
    from pyspark.sql import functions as F

    d = documents(spark, sf).select("text", line_dedup.chunk_texts(F.col("text")).alias("c"))
    assert all("\n".join(r["c"]) == r["text"] for r in d.collect())


# 10: packing


def check_packing(rows, got, capacity):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % capacity or min(capacity, len(ids))
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    inside = collections.defaultdict(list)
    for r in got:
        inside[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in inside.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside), sum(r["length"] for r in got)


def test_packing_documents(spark, sf):
    d = documents(spark, sf)
    got = packing.pack(d, tokenizer_path("byte_bpe_50k.json"), 2, 1024).collect()
    sequences, total = check_packing([(r["doc_id"], r["text"]) for r in d.collect()], got, 1024)
    assert sequences <= -(-total // 1024) * 1.02 + 1


def test_packing_odd_rows(spark):
    got = packing.pack(odd(spark), tokenizer_path("byte_bpe_50k.json"), 2, 1024).collect()
    check_packing(ODD, got, 1024)
    assert packing.pack(none(spark), tokenizer_path("byte_bpe_50k.json"), 2, 1024).collect() == []


def test_packing_ids_of_special_tokens(spark):
    from tokenizers import Tokenizer

    end, path = "<|endoftext|>", tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    parts = [end, end, "<|endoftext", "|>", " ", "  ", "\n\n", "don", "'t", "a", "7", "é", "日本", "!?"]
    rows = [(0, f"a{end}b"), *[(i, "".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(1, 30)))) for i in range(1, 400)]]
    assert t.encode(rows[0][1], add_special_tokens=False).ids == [64, 50256, 65]
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(spark.createDataFrame(rows, ODD_SCHEMA), path, 2, 1024).collect()}
    for i, text in rows:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        assert got[i] == (len(ids), zlib.crc32(ids.tobytes()))


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 5000), max_size=20))
@settings(max_examples=60, deadline=None)
def test_histogram_packing_places_every_piece(counts):
    seen = collections.Counter()
    for sizes, times in packing.pack_histogram(dict(counts), 64, bundles=300):
        assert sum(sizes) <= 64
        for s in sizes:
            seen[s] += times
    assert seen == collections.Counter(counts)


def brute_sum_of_squares(lengths, capacity):
    """The rule piece by piece, by the sums themselves."""
    bins, number = [], collections.Counter()
    for size in lengths:
        best = (2 * number[capacity - size] + 1 if size < capacity else 0, capacity)
        for gap in sorted(g for g in number if size <= g < capacity and number[g]):
            after = number.copy()
            after[gap] -= 1
            if gap > size:
                after[gap - size] += 1
            best = min(best, (sum(n * n for n in after.values()) - sum(n * n for n in number.values()), gap))
        gap = best[1]
        if gap == capacity:
            bins.append([capacity, []])
        else:
            number[gap] -= 1
        mine = next(b for b in reversed(bins) if b[0] == gap)
        mine[0] -= size
        mine[1].append(size)
        if mine[0]:
            number[mine[0]] += 1
    return collections.Counter(tuple(b[1]) for b in bins)


@given(st.lists(st.integers(1, 24), max_size=150))
@settings(max_examples=60, deadline=None)
def test_histogram_packing_is_the_rule(lengths):
    got = packing.pack_histogram(collections.Counter(lengths), 24)
    want = brute_sum_of_squares(sorted(lengths, reverse=True), 24)
    gaps = lambda p: collections.Counter((24 - sum(s),) for s, n in p.items() for _ in range(n))
    assert sum(dict(got).values()) == sum(want.values()) and gaps(dict(got)) == gaps(want)


def test_packing_of_many_pieces_by_bundles():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 300, 120_000), 1024)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    least = -(-int(lengths.sum()) // 1024)
    one_by_one, bundled = (sum(n for _, n in packing.pack_histogram(counts, 1024, bundles=b)) for b in (10**9, 64))
    assert least <= one_by_one <= 1.002 * least and least <= bundled <= 1.004 * least
    times = sum(n for _, n in packing.pack_histogram({k: 1_000_000 * n for k, n in counts.items()}, 1024))
    assert times <= 1.004 * 1_000_000 * least


# 3: SentencePiece


def test_pieces_equal_the_library(spark, sf):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf).collect()]
    for df, source in ((documents(spark, sf), rows), (odd(spark), ODD)):
        want = collections.Counter()
        for i, t in source:
            ids = sp.encode(t or "")
            want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
        assert collections.Counter(tuple(r) for r in pieces.encode_decode_digests(df, path).collect()) == want
    assert pieces.encode_decode_digests(none(spark), path).collect() == []


@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n▁aAéñ日😀́"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_pieces_on_any_text(text):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    m = pieces.model(path)
    ids = m.outer.encode(text)
    n, joined, decoded = m.encode_decode(text)
    assert (n, joined, decoded) == (len(ids), ",".join(map(str, ids)), m.outer.decode(ids))
    spans = m.spans(text)
    assert [s[0] for s in spans] == ids
    raw = text.encode()
    at = 0
    for _, _, begin, end in spans:
        assert begin <= end <= len(raw) and begin <= at
        at = max(at, end)
    assert at == len(raw)


@given(st.text(alphabet=st.one_of(st.sampled_from("  \t\n▁aAéñ日😀́"), st.characters(exclude_categories=["Cs"])), max_size=40))
@settings(max_examples=300, deadline=None)
def test_piece_spans_from_units_on_any_text(text):
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    for t in (text, text.replace("▁", " ")):
        assert m.encode_decode_spans(t)[3].tolist() == [[*x[2:]] for x in m.spans(t)]


def test_spans_are_the_librarys(spark, sf):
    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    for r in documents(spark, sf).select("text").limit(60).collect():
        text = r["text"] or ""
        want = [(p.id, p.begin, p.end) for p in m.outer.encode(text, return_type="proto").pieces]
        got = [(i, b, e) for i, _, b, e in m.spans(text)]
        assert [x[0] for x in got] == [x[0] for x in want]
        # byte pieces of one character share its span here; the library gives it to the last of them
        assert all(g == w for g, w in zip(got, want, strict=True) if not m.inner.is_byte(g[0]))


def test_query_has_the_spans_of_all_pieces(spark, sf):
    from colloquy.llm.queries import op3_sentencepiece

    m = pieces.model(tokenizer_path("piece_bpe_32k.model"))
    want = {r["doc_id"]: hashlib.sha256(np.array([x[2:] for x in m.spans(r["text"] or "")], dtype="<i8").tobytes()).hexdigest() for r in documents(spark, sf).collect()}
    assert {r["doc_id"]: r["spans_sha256"] for r in op3_sentencepiece(spark, sf).collect()} == want


@given(st.text(alphabet=st.one_of(st.sampled_from(" 　ﬁ①Ǻe​\xadABab"), st.characters(exclude_categories=["Cs", "Cn", "Co"])), max_size=30))
@settings(max_examples=300, deadline=None)
def test_character_map_equals_the_library(text):
    import sentencepiece

    n = normaliser()
    m = object.__new__(pieces.Model)
    m.dummy_prefix, m.trim, m.escape, m.suffix = False, True, False, False
    m.map = pieces.CharacterMap(n[1])
    got, align = m.normalise(text)
    assert got == n[0].normalize(text)
    assert len(align) == len(got.encode()) + 1 and align == sorted(align)


_normaliser: list = []


def normaliser():
    import sentencepiece

    if not _normaliser:
        n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", escape_whitespaces=False, add_dummy_prefix=False, remove_extra_whitespaces=True)
        spec = next(v for f, _, v, _ in pieces._fields(n.serialized_model_proto()) if f == 3)
        _normaliser[:] = [n, next(v for f, _, v, _ in pieces._fields(spec) if f == 2)]
    return _normaliser


def test_encode_then_decode(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    back = by_doc(pieces.decode(pieces.encode(odd(spark), path), path))
    assert all(sorted(r["text"] for r in back[i]) == sorted((t or "") for j, t in ODD if i == j) for i, _ in ODD)


# 5: WARC


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [(r["page_id"], r["html"]) for r in pages.collect()]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, rows[0][1]), (None, "é\r\n\r\nWARC/1.1\r\n\r\n"), (10**6 + 3, "é\r\n\r\nWARC/1.1\r\n\r\n"), (10**6 + 4, "x" * 200_000)]
    for least in (0, 10):
        df = spark.createDataFrame([(i, "http://x/\r\ny" if i else None, h, "z") for i, h in rows], "page_id long, url string, html string, file string")
        first = {}
        for i, h in rows:
            if i is not None and len((h or "").encode()) >= least:
                first[h or ""] = min(i, first.get(h or "", i))
        got = warc.round_trip(df, least).collect()
        want = []
        import base64

        for i, h in rows:
            p = (h or "").encode()
            again = len(p) >= least and first.get(h or "", i) != i
            want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
        assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(want, key=str)
    assert warc.round_trip(df.where("false")).collect() == []
    alike = spark.createDataFrame([(1, "http://b/", "same"), (1, "http://a/", "same"), (2, None, "same")], "page_id long, url string, html string")
    path = warc.archive_path(spark)
    told = sorted((r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(warc.write(alike, path), path).collect())
    assert told == [(1, "http://a/", "response", None, 4), (1, "http://b/", "revisit", 1, 4), (2, "", "revisit", 1, 4)]


def test_warc_reads_only_selected_records(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * 50) for i in range(200)], "page_id long, url string, html string")
    path = warc.archive_path(spark)
    index = warc.write(df, path)
    some = index.where("page_id % 7 = 3")
    got = {r["page_id"]: (r["url"], bytes(r["payload"])) for r in warc.read(some, path).collect()}
    assert got == {i: (f"http://h/{i}", (f"<p>{i}</p>" * 50).encode()) for i in range(200) if i % 7 == 3}
    reads = warc.ranges(some, gap=0)
    assert reads.count() <= some.count() and reads.selectExpr("sum(end - begin)").first()[0] == some.selectExpr("sum(length)").first()[0]


# 6: nearest neighbours


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 32))
    rows = [(i, [float(x) for x in a], 1) for i, a in enumerate(v)]
    rows += [(3000, None, 1), (3020, [0.0] * 32, 1), (3040, [float("nan")] * 32, 1), (3060, [None] * 32, 1), (3080, [1.0], 1), (None, [1.0] * 32, 1), (3100, [float(x) for x in v[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 10).collect()
    all_v = np.vstack([v, v[:1]])
    ids = np.r_[np.arange(3000), 3100]
    exact = []
    for q in [*range(0, 3000, 20), 3100]:
        x = all_v[ids == q][0]
        score = (all_v * x).sum(axis=1)
        score[ids == q] = -np.inf
        exact += [(q, int(ids[j])) for j in np.lexsort((ids, -score))[:10]]
    assert ann.recall([(r["query_id"], r["vec_id"]) for r in got], exact) >= 0.9
    by = collections.defaultdict(list)
    for r in got:
        assert r["score"] == pytest.approx(float((all_v[ids == r["query_id"]][0] * all_v[ids == r["vec_id"]][0]).sum()), abs=1e-12)
        by[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert all([x[0] for x in sorted(r)] == list(range(1, 11)) and sorted(r) == sorted(r, key=lambda x: x[1:]) for r in by.values())
    assert ann.nearest(df.where("false"), df.where("false"), 10).collect() == []
    few = df.where("vec_id < 5 or vec_id = 3080")
    assert {(r["query_id"], r["vec_id"]) for r in ann.nearest(few, few.where("vec_id = 0"), 20).collect()} == {(0, i) for i in range(1, 5)}


@pytest.mark.parametrize("norms", ["gaussian", "uniform", "lognormal", "one huge"])
def test_nearest_recall_with_unequal_norms(spark, norms):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(3000, 64))
    if norms != "gaussian":
        v /= np.sqrt((v * v).sum(axis=1))[:, None]
    if norms == "uniform":
        v *= rng.uniform(0.5, 1.5, (3000, 1))
    elif norms == "lognormal":
        v *= rng.lognormal(0, 1, (3000, 1))
    elif norms == "one huge":
        v[7] *= 1e9
    df = spark.createDataFrame([(i, [float(x) for x in a]) for i, a in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect()
    exact = []
    for q in range(0, 3000, 20):
        score = (v * v[q]).sum(axis=1)
        score[q] = -np.inf
        exact += [(q, int(j)) for j in np.argsort(-score)[:20]]
    assert ann.recall([(r["query_id"], r["vec_id"]) for r in got], exact) >= 0.9


def _brute_nearest(ids, v, k):
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = (v * v[i]).sum(axis=1)
        score[ids == ids[i]] = -np.inf
        out += [(int(ids[i]), n + 1, int(ids[j])) for n, j in enumerate(np.lexsort((ids, -score))[:k])]
    return out


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_nearest_recall_on_the_tables(spark, size):
    table = spark.read.parquet(f"/root/testdata/{size}/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    got = queries.op6_nearest(spark, f"/root/testdata/{size}").collect()
    exact = _brute_nearest(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float), 20)
    assert len(got) == len(exact)
    assert ann.recall([(r["query_id"], r["vec_id"]) for r in got], [(q, i) for q, _, i in exact]) >= 0.9


def test_nearest_equal_vectors_and_short_lists(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    v[100:300] = v[100]  # half of all rows are one vector
    ids = np.arange(400)
    schema = "vec_id long, embedding array<double>, v string, name int"
    df = spark.createDataFrame([(int(i), [float(x) for x in a], "x", 1) for i, a in zip(ids, v, strict=True)], schema)
    found = ann.nearest(df.unionByName(df.where("vec_id = 7")), df.where("vec_id % 20 = 0"), 20, visited=128)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found.collect())
    assert got == sorted(_brute_nearest(ids, v, 20))
    # files too short for k rows: every file is visited instead
    alone = df.where("vec_id < 100 or vec_id >= 300")
    spread = ann.nearest(alone, alone.where("vec_id % 20 = 0"), 150, pivots=50, posted=1, visited=1, rerank=1)
    kept = (ids < 100) | (ids >= 300)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in spread.collect()) == sorted(_brute_nearest(ids[kept], v[kept], 150))


# 1: licences


def test_licenses_found(spark):
    mit = licenses.TEMPLATES["MIT"]
    wrapped = "\n".join(mit[i : i + 60] for i in range(0, len(mit), 60))
    rows = [(1, "Some prose here.\nReleased under the MIT License.\nMore."), (2, mit), (3, f"Title\n\n{wrapped}\n\nfoo bar"), (4, None), (5, ""), (6, "license"), (7, "licensed UNDER the apache license version 2.0"), (7, "All rights reserved."), (None, "All rights reserved."), (8, "This text has no such thing, all is quiet.")]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, w string, kind string")
    got = sorted(((r["doc_id"], r["kind"], r["license"]) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "line", "MIT-notice"), (2, "line", "MIT"), (3, "paragraph", "MIT"), (3, "text", "MIT"), (7, "line", "Apache-2.0"), (7, "line", "all-rights-reserved"), (None, "line", "all-rights-reserved")], key=str)
    assert licenses.scan(df.where("false")).collect() == []
    assert licenses.scan(odd(spark)).collect() == []


def test_complete_licenses_found(spark):
    rows, want, n = [], [], 0
    for name, text in licenses.COMPLETE.items():
        at = text.index("THE SOFTWARE IS" if name != "BSD-2-Clause" else "THIS SOFTWARE IS")
        parts = [text[:at].strip(), text[at:].strip()]
        wrapped = ["\n".join(p[i : i + 70] for i in range(0, len(p), 70)) for p in parts]
        prose = ["\n".join(f"Prose {k} of {name} with words {k * 7 + i} and nothing else." for i in range(8)) for k in range(12)]
        for body, kind, unit in ((text, "line", 0), ("\n".join(wrapped), "paragraph", 0), ("\n\n".join(wrapped), "paragraphs", 0), ("\n\n".join([*prose, *wrapped, *prose]), "paragraphs", 12), ("\n\n".join([*prose, *parts, *prose]), "paragraphs", 12)):
            rows.append((n, body))
            want.append((n, kind, unit, name))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["kind"], r["unit"], r["license"]) for r in licenses.scan(df).collect()}
    assert set(want) <= got
    assert sum(x[1] == "paragraphs" for x in got) == 9


def test_licenses_equal_sql(spark, sf):
    import duckdb

    want = duckdb.execute(licenses.oracle().replace("FROM documents", f"FROM '{sf}/documents.parquet'")).fetchall()
    assert sorted(tuple(r) for r in licenses.scan(documents(spark, sf)).collect()) == sorted(want) and want


def test_queries_equal_sql(spark, sf):
    import duckdb

    from colloquy.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ("op4_jaccard_join", "op5_warc"):
        rel = c.execute(ORACLE[name])
        names = [d[0] for d in rel.description]
        assert sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()), key=str) == sorted(rel.fetchall(), key=str)


# 8: chat formatting


def test_chat_recovers_roles(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    got = chat.format_conversations(turns).collect()
    found = {(r["conv_id"], r["turn"]): r for r in got}
    right = total = 0
    for r in turns.collect():
        total += 1
        f = found.get((r["conv_id"], r["turn"]))
        right += f is not None and f["role"] == r["role"] and f["content"] == r["text"]
    assert right / total >= 0.9, right / total
    assert all(r["rendered"].startswith(f"<|{r['role']}|>\n") and r["rendered"].endswith("\n<|end|>") for r in got)


def test_chat_blocks_decode_as_one(spark):
    emit = chat.prior_emissions()
    rng = np.random.default_rng(2)
    names = ["User: ", "Assistant: ", "", "Q: ", "### Human: "]
    lines = [names[k] + ("why?" if q else "because of that long and winding reason, no less than that") for k, q in zip(rng.integers(0, 5, 300), rng.integers(0, 2, 300), strict=True)]
    fs = [chat.feature(x, i % 3 == 0) for i, x in enumerate(lines)]
    trans = chat._transitions()

    def likelihood(path):
        return chat._START[path[0]] + sum(trans[a, b] for a, b in itertools.pairwise(path)) + sum(emit[s, f] for s, f in zip(path, fs, strict=True))

    whole = likelihood(chat.viterbi_path(fs, emit, None, None))
    rows = [(1, i // 7, i, x, i % 3 == 0) for i, x in enumerate(lines)] + [(None, 0, 0, None, None), (2, 0, 0, "<|user|> hi", True), (2, 0, 1, "<|end|>", False)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, block long, place int, line string, gap boolean, entry int")
    got = chat.decode(df, emit).collect()
    mine, block, begun = [], None, 0
    for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["block"], r["at"])):
        begun = begun if r["block"] == block else 0
        mine.append(2 * chat.ROLES.index(r["role"]) + (r["begun"] == begun))
        block, begun = r["block"], r["begun"]
    assert likelihood(mine) == pytest.approx(whole)
    text = {r["conv_id"]: r["rendered"] for r in chat.render(chat.decode(df.where("conv_id = 2 or conv_id is null"), emit)).collect()}
    assert text[2] == "<|user|>\nhi\n< |end|>\n<|end|>" and None in text
    assert chat.render(chat.decode(df.where("false"), emit)).collect() == []


def test_chat_recovers_roles_of_held_out_conversations(spark):
    from pyspark.sql import functions as F

    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = turns.where(~chat.in_fit_half(F.col("conv_id")))
    want = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in held.collect()}
    found = {(r["conv_id"], r["turn"]): (r["role"], r["content"]) for r in chat.format_conversations(turns).collect()}
    assert len(want) > 100 and sum(found.get(k) == v for k, v in want.items()) / len(want) >= 0.9


def test_chat_path_is_the_best_of_all_paths():
    rng = np.random.default_rng(7)
    emit, trans = chat.prior_emissions(), chat._transitions()
    for _ in range(25):
        fs = rng.integers(0, chat.FEATURES, 5).tolist()
        score = {p: chat._START[p[0]] + sum(trans[a, b] for a, b in itertools.pairwise(p)) + sum(emit[s, f] for s, f in zip(p, fs, strict=True)) for p in itertools.product(range(chat.STATES), repeat=5)}
        assert score[tuple(chat.viterbi_path(fs, emit, None, None))] == pytest.approx(max(score.values()))


def test_chat_content_that_looks_like_a_marker_stays():
    assert chat.unmarked("User: hello", 1) == "hello" and chat.unmarked("[bot] ok", 2) == "ok"
    for line, role in (("Context", 1), ("A - the first letter", 2), ("System: none", 1), ("agents: two", 2), ("", 0)):
        assert chat.unmarked(line, role) == line


def test_chat_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, None, "user", ""), (None, 0, "pilot", "a\nb"), (2, 10**6, "assistant", "ok")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, block int")
    told = chat.format_conversations(df).collect()
    assert {r["conv_id"] for r in told} == {1, 2, None} and next(r["content"] for r in told if r["conv_id"] == 2) == "ok"
    assert chat.format_conversations(df.where("false")).collect() == []


def test_long_marks_rule_out_unrelated_sets_and_no_link():
    """At every size, where marks of one fixed length rule out nothing from some thousand elements on."""
    rng, rows, want, far = np.random.default_rng(8), [], set(), set()
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.int64).view(np.uint64)
    for n in (1, 2, 3, 9, 64, 65, 500, 2047, 2048, 2049, 20_000):
        for loss in (0.0, 0.03, 0.05, 0.1, 0.12, 0.3, 1.0):
            a = fresh(n)
            b = np.unique(np.r_[a[int(loss * n) :], fresh(int(loss * n * rng.random()) + (loss == 1.0))])
            a = np.unique(a)
            both = len(np.intersect1d(a, b))
            (want if 100 * both >= 90 * (len(a) + len(b) - both) else far if loss >= 0.3 and n > 60 else set()).add(len(rows))
            rows.append((len(rows), 0, len(a), len(b), jaccard.long_mark(a), jaccard.long_mark(b)))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["a", "b", "n_a", "n_b", "mark_a", "mark_b"])
    kept = set(pa.Table.from_batches(jaccard._may_link_long(90, 100)(iter([batch]))).column("a").to_pylist())
    assert want <= kept and not kept & far and len(far) > 10


def test_list_entries_far_in_size_from_all_others_are_not_kept(spark, monkeypatch):
    """Texts in one list whose sizes differ by a fifth each: no entry is left to compare."""
    words, rows, n = [f"w{i}" for i in range(3000)], [], 20.0
    rng = np.random.default_rng(3)
    while n < 700:
        rows.append((len(rows), " ".join([*words[:3], *(f"x{k}" for k in rng.integers(0, 10**9, int(n)))])))
        n *= 1.2
    met = {}
    real = jaccard.staged
    monkeypatch.setattr(jaccard, "staged", lambda df, name: met.setdefault(name, real(df, name)) if name == "lists" else real(df, name))
    monkeypatch.setattr(jaccard, "discard", lambda *tables: None)
    monkeypatch.setattr(jaccard, "prefix_keys", lambda items, num, den, common: items)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(i, i) for i, _ in rows]
    assert met["lists"].count() == 0
