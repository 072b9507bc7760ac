"""Quality rules whose cutoffs are certified on labelled holdouts. DataFrame functions only.

Rows in: doc_id, text and a stratum column; further columns are ignored. Null, empty and blank texts
have no words and fail the base rule. Every row is judged by itself, so repeated rows get equal verdicts.
Labels are one row for each doc_id after grouping: with contradictory labels a document counts as
good only if all of them are 1; null labels and labels without a document are left out. Without
labels, or with too few to certify any cutoff, only the base rule rejects.

The cutoffs: each rule's measure is divided by its 99th percentile among good documents of the fit
half (by crc32 of doc_id) of its stratum, and a document's excess is the largest of these ratios.
Cutoffs on the excess are tested on the other half from lenient to strict, and testing stops at the
first that fails, so one error budget covers the whole sequence; the budget is split over the strata
(Bonferroni). Strata whose holdout is too small to certify any cutoff, which its count alone tells, share one stratum. A cutoff passes if the exact binomial probability of so few false rejections, were
their rate as high as `risk`, is within the budget. So with probability 1 - `error` no stratum
loses more than `risk` of its good documents to the cutoffs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import BLANKS, binomial_cdf, let, staged, words_of

SYMBOLS = "#*$%&|<>"
MEASURES = ("symbols", "capitals", "bangs", "dup_lines", "repeats", "word_length")
LEAST_SCALE = {"symbols": 0.01, "capitals": 0.05, "bangs": 0.02, "dup_lines": 0.1, "repeats": 0.1, "word_length": 4.0}
CUTOFFS = (8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.1, 1.0)
#: At most so many strata, the largest of the labelled rows, get their own cutoffs; the rest share one.
MAX_STRATA = 64


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows found twice or more, overlaps counted once."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.array_sort(windows), covered))


def features(docs: DataFrame, stratum: str, *keep: str) -> DataFrame:
    """The columns keep, stratum, the base counts, base_failed, and the measures of the rules."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*keep, F.col(stratum).cast("string").alias("stratum"), t.alias("_t"), words_of(F.col("text")).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *keep,
        "stratum",
        F.size("_w").cast("long").alias("n_words"),
        _without(F.col("_t"), BLANKS).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("_l"),
        _repeat_words(F.col("_w")).cast("long").alias("n_repeat_words"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}", ""))).cast("long").alias("n_capitals"),
        (F.length("_t") - _without(F.col("_t"), "!")).cast("long").alias("n_bangs"),
    )
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return counted.select(
        *keep,
        "stratum",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("_l.n") - F.col("_l.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbols"),
        (F.col("n_capitals") / chars).alias("capitals"),
        (F.col("n_bangs") / words).alias("bangs"),
        ((F.col("_l.n") - F.col("_l.d")) / F.greatest("_l.n", F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"),
        (F.col("word_chars") / words).alias("word_length"),
    )


@dataclass
class Rules:
    """Scales of the measures and the certified cutoff (None: reject nothing) of each stratum; "" is the rest."""

    scales: dict[str, tuple[float, ...]]
    cutoffs: dict[str, float | None]

    def _named(self) -> Column:
        own = [s for s in self.scales if s]
        return F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(F.lit("")) if own else F.lit("")

    def excess(self) -> Column:
        pairs = [F.create_map(*[F.lit(x) for s, v in self.scales.items() for x in (s, float(v[i]))])[self._named()] for i in range(len(MEASURES))]
        return F.greatest(*[F.col(m) / p for m, p in zip(MEASURES, pairs, strict=True)])

    def kept(self) -> Column:
        cut = F.create_map(*[F.lit(x) for s, v in self.cutoffs.items() for x in (s, float("inf") if v is None else v)])[self._named()]
        return ~F.col("base_failed") & (self.excess() <= cut)


def fit(feats: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05) -> Rules:
    """Cutoffs from feats (with doc_id) and labels (doc_id, quality). The driver gets a few rows for each stratum."""
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = staged(feats.where(~F.col("base_failed")).join(told, "doc_id").withColumn("fit", F.crc32(F.col("doc_id").cast("string")) % 2 == 0), "labelled")
    good_holdout = F.count_if((F.col("quality") == 1) & ~F.col("fit"))
    top = known.where("stratum is not null and stratum <> ''").groupBy("stratum").agg(F.count("*").alias("n"), good_holdout.alias("good")).orderBy(F.desc("n"), "stratum").limit(MAX_STRATA).collect()
    own = [r["stratum"] for r in top if (1 - risk) ** r["good"] <= error / (len(top) + 1)]
    strata = {s: tuple(LEAST_SCALE[m] for m in MEASURES) for s in [*own, ""]}
    named = known.withColumn("s", F.when(F.col("stratum").isin(own), F.col("stratum")).otherwise(F.lit("")) if own else F.lit(""))
    good = named.where("quality = 1")
    for r in good.where("fit").groupBy("s").agg(*[F.percentile_approx(m, 0.99, 10000).alias(m) for m in MEASURES]).collect():
        strata[r["s"]] = tuple(max(LEAST_SCALE[m], r[m]) for m in MEASURES)
    rules = Rules(strata, dict.fromkeys(strata))
    excess = rules.excess()
    counts = good.where(~F.col("fit")).groupBy("s").agg(F.count("*").alias("n"), *[F.count_if(excess > c).alias(f"k{i}") for i, c in enumerate(CUTOFFS)]).collect()
    for r in counts:
        for i, c in enumerate(CUTOFFS):
            if binomial_cdf(r[f"k{i}"], r["n"], risk) > error / len(counts):
                break
            rules.cutoffs[r["s"]] = c
    return rules


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed and kept."""
    feats = staged(features(docs, stratum, "doc_id"), "features")
    rules = fit(feats, labels)
    return feats.select("doc_id", *BASE, rules.kept().alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    columns = docs.columns
    # features() renames nothing of docs: the row goes along as one struct, written once with its features
    whole = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs["text"], docs[stratum])
    feats = staged(features(whole, stratum, "_row"), "features")
    rules = fit(feats.withColumn("doc_id", F.col("_row.doc_id")).drop("_row"), labels)
    return feats.where(rules.kept()).select(*[F.col("_row").getField(c).alias(c) for c in columns])
