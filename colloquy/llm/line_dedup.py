"""Repeated passages across documents, by lines and pairs of lines. DataFrame functions only.

Rows in: doc_id, text and any further columns. Units of a text are its lines of LONG_CHARS characters
or more, and its pairs of neighbouring lines of which one at least is shorter, with the blank lines
between them. A passage's units depend on nothing outside it and cover all its lines, so it is found
whole wherever it stands. Units that occur again anywhere in the corpus are found by the hashes of
their lines; lines are compared byte by byte (grouped by the text itself), and units of hashes that
stand for different texts are left alone. The occurrence with the least (doc_id, place) stays, and a
pair that overlaps it. The lines of the others make runs: neighbours in a run are a repeated pair or
two repeated long lines. Runs with at least `min_words` words go, with the blank lines inside them.

A null text stays null, an empty one empty. Rows that share a doc_id count as one document and keep
or lose their equal lines together; rows with a null doc_id are neither changed nor counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import let, staged, words_of

LONG_CHARS = 48
MIN_WORDS = 25


def chunk_texts(text: Column) -> Column:
    """The lines of a text in order, as an array of strings; joined by newlines they give the text."""
    return F.split(text, "\n", -1)


def _units(text: Column) -> Column:
    """Units as structs: k, the number of the first line among those not blank, the lines p and q
    (null: one long line) with their places and hashes, step from p to q (0: none), and what is between."""

    def paired(lines: Column) -> Column:
        seen = F.transform(lines, lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), (F.length(x) >= LONG_CHARS).alias("long"), F.size(words_of(x)).alias("words")))

        def units(full: Column) -> Column:
            def unit(p: Column, k: Column, q: Column) -> Column:
                step = F.coalesce(q["line"] - p["line"], F.lit(0))
                between = F.when(step > 1, F.array_join(F.slice(lines, p["line"] + 2, step - 1), "\n")).otherwise(F.lit(""))
                return F.struct(k.alias("k"), p.alias("p"), q.alias("q"), step.alias("step"), between.alias("between"))

            single = F.filter(F.transform(full, lambda p, k: unit(p, k, F.get(full, F.lit(-1)))), lambda u: u["p"]["long"])
            pair = F.filter(F.transform(full, lambda p, k: unit(p, k, F.get(full, k + 1))), lambda u: u["q"].isNotNull() & ~(u["p"]["long"] & u["q"]["long"]))
            return F.concat(single, pair)

        return let(F.filter(seen, lambda p: p["words"] > 0), units)

    return let(chunk_texts(text), paired)


def _occurrence(doc_id: str, no: str) -> Column:
    """(doc_id, no) as one ordered number, which aggregates without sorting."""
    return F.col(doc_id).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(no).cast("decimal(11,0)")


def repeated_chunks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id and the places (array of int) of the lines to remove, for documents that have some."""
    source = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = source.select(F.explode(chunk_texts(F.col("text"))).alias("line")).where("line <> ''")
    texts = lines.select(F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"), "line").groupBy("h1", "h2", "line").agg(F.lit(1).alias("one"))
    mixed = texts.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")

    key = ["p1", "p2", "q1", "q2", "step", "between"]
    # a long line alone has its own hashes twice: no key that all of them share
    hashes = [(F.coalesce(F.col(f"u.q.h{n}"), F.col(f"u.p.h{n}")) if x == "q" else F.col(f"u.p.h{n}")).alias(f"{x}{n}") for x in "pq" for n in (1, 2)]
    words = [F.col(f"u.{x}.words").alias(f"{x}_words") for x in "pq"]
    rows = source.select("doc_id", F.explode(_units(F.col("text"))).alias("u")).select("doc_id", "u.k", *hashes, "u.step", "u.between", F.col("u.p.line").alias("p_line"), *words)
    same = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(_occurrence("doc_id", "k")).alias("first")).where("n > 1").drop("n")
    for x in "pq":
        same = same.join(mixed.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2")).hint("merge"), [f"{x}1", f"{x}2"], "left_anti")
    later = rows.join(same.hint("merge"), key).where(_occurrence("doc_id", "k") > F.col("first") + F.when(F.col("step") > 0, 1).otherwise(0))
    later = later.withColumn("q_line", F.when(F.col("step") > 0, F.col("p_line") + F.col("step")))

    def told(x: str, k: Column, linked: bool) -> Column:
        alone = F.col("step") == 0
        return F.struct(k.alias("k"), F.col(f"{x}_line").alias("line"), F.col(f"{x}_words").alias("words"), alone.alias("alone"), F.lit(linked).alias("linked"))

    marks = later.select("doc_id", F.explode(F.filter(F.array(told("p", F.col("k"), False), told("q", F.col("k") + 1, True)), lambda m: m["line"].isNotNull())).alias("m")).select("doc_id", "m.*")
    marked = marks.groupBy("doc_id", "k", "line", "words").agg(F.max("alone").alias("alone"), F.max("linked").alias("linked"))
    by_place = W.partitionBy("doc_id").orderBy("k")
    follows = F.coalesce((F.lag("k").over(by_place) == F.col("k") - 1) & (F.col("linked") | (F.col("alone") & F.lag("alone").over(by_place))), F.lit(False))
    runs = marked.withColumn("begins", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("begins").over(by_place))
    long = runs.groupBy("doc_id", "run").agg(F.sum("words").alias("total"), F.min("line").alias("begin"), F.max("line").alias("end")).where(F.col("total") >= min_words)
    return staged(long.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence("begin", "end")))).alias("gone")), "gone")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows and columns of docs with repeated passages cut from text, and removed_chunks (int: lines cut)."""
    gone = repeated_chunks(docs, min_words).select(F.col("doc_id").alias("_id"), F.col("gone").alias("_gone"))
    columns = docs.columns
    # the row goes along as one struct, so no column of docs can clash
    rows = docs.select(F.struct(*[docs[c] for c in columns]).alias("_row"), docs["doc_id"].cast("long").alias("_doc"), docs["text"].cast("string").alias("_text"))
    # gone grows with the corpus: a merge join at every size, never a broadcast that flips to one
    joined = rows.join(gone.hint("merge"), F.col("_doc") == F.col("_id"), "left")

    def rest(c: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(c) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(c, i)), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(let(chunk_texts(F.col("_text")), rest))
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in columns], F.coalesce(F.size("_gone"), F.lit(0)).alias("removed_chunks"))
