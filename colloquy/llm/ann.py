"""Nearest neighbours by inner product through a permutation index.

Rows in: an id and a vector, further columns ignored. Vectors that are null or zero, or hold null or
non-finite components, or whose dimension is not the commonest one of the pivot sample, take no
part, nor do rows without an id. Equal vectors are searched once and share their candidates; of
rows that repeat both id and vector one counts. A query never meets a row of its own id, so an id that
stands on several vectors may leave it fewer than k neighbours. An empty table gives no rows.

Pivots are a bounded sample: the PIVOTS vectors with the least hash. Every vector is represented by its
nearest pivots in order, its permutation, and posted in the inverted files of its first POSTED pivots.
A query visits the files of its first VISITED pivots; there the rows are ranked by the footrule distance
between the permutations (over the first LENGTH pivots; beyond, all places count as LENGTH), and the best
RERANK are scored by exact inner products. For vectors of unequal norm a row's permutation is
taken in the space with one more coordinate, in which all rows and pivots have equal norm; a query has
0 there, so its order is that of inner products.

A file of more than BLOCK rows is dealt into blocks, each ranked and reranked by itself: memory is
bounded, a hot file is spread over tasks, and recall does not fall as the table grows. A query
that found fewer than k rows visits all files and has every row scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import staged

PIVOTS, LENGTH, POSTED, VISITED, RERANK, BLOCK = 128, 48, 4, 40, 256, 2048


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v (array of double) of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(F.forall("v", fine) & F.exists("v", lambda x: x != 0))


def near_lifted(x: np.ndarray, pivots: np.ndarray, top: float) -> np.ndarray:
    """Nearness of rows to pivots with the coordinate that makes all norms top, as the negated squared
    distance less what is the same for all pivots: lifts are subtracted, never multiplied, so a top far
    above the other norms does not drown them."""
    norms, pivot_norms = (x * x).sum(axis=1)[:, None], (pivots * pivots).sum(axis=1)
    lift = lambda n: np.sqrt(np.maximum(0.0, top * top - n))
    both = lift(norms) + lift(pivot_norms)
    gap = np.divide(pivot_norms - norms, both, out=np.zeros_like(both), where=both > 0)
    return 2 * (x @ pivots.T) - pivot_norms - gap * gap


def permutations(near: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `length` pivots in order of nearness, and the closeness (length for the nearest down to
    1, 0 beyond) of every pivot. The footrule distance of two rows is what their summed least closenesses lack
    of the greatest possible sum, times two."""
    order = np.argsort(-near, axis=1, kind="stable")[:, :length]
    close = np.zeros(near.shape, dtype=np.int16)
    np.put_along_axis(close, order, np.broadcast_to(np.arange(order.shape[1], 0, -1, dtype=np.int16), order.shape), axis=1)
    return order, close


def search_block(q: np.ndarray, names: np.ndarray, x: np.ndarray, pivots: np.ndarray, top: float, k: int, length: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block of a file: query's place, row's name and score of the k best rows of each query. Rows come in order of
    names, so of equal distances and scores the smaller names come first."""
    order = np.argsort(names, kind="stable")
    names, x = names[order], x[order]
    close = np.ascontiguousarray(permutations(near_lifted(x, pivots, top), length)[1].T)
    first, mine = permutations(q @ pivots.T, length)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(q)):
        best = np.arange(len(x))
        if len(x) > rerank:
            shared = close[first[i]]
            np.minimum(shared, mine[i, first[i]][:, None], out=shared)
            # the place breaks ties; closenesses sum to less than 2^15, places are less than 2^31
            rank = shared.sum(axis=0, dtype=np.int16).astype(np.int64) * len(x) - best
            best = np.sort(np.argpartition(rank, len(x) - rerank)[len(x) - rerank :])
        # summed in one fixed order, so a row scores equally in every file
        score = (x[best] * q[i]).sum(axis=1)
        chosen = np.argsort(-score, kind="stable")[:k]
        out.append((np.full(len(chosen), i), names[best[chosen]], score[chosen]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _dense(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _first_pivots(given, lifted: bool, times: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, top = given.value
        for batch in frames:
            if batch.num_rows:
                x = _dense(batch.column("v"))
                order = permutations(near_lifted(x, pivots, top) if lifted else x @ pivots.T, times)[0]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, order.shape[1]), pa.int32()), pa.array(order.ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("v"), lists], ["name", "v", "pivots"])

    return run


def _search(given, k: int, length: int, rerank: int):
    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        pivots, top = given.value
        found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            found = search_block(_dense(left.column("v")), right.column("name").to_numpy(), _dense(right.column("v")), pivots, top, k, length, rerank)
        return pa.table({"query": pa.array(left.column("name").to_numpy()[found[0]], pa.int64()), "name": pa.array(found[1], pa.int64()), "score": pa.array(found[2], pa.float64())})

    return run


def _visit(rows: DataFrame, asked: DataFrame, given, k: int, pivots: int, length: int, posted: int, visited: int, rerank: int) -> DataFrame:
    """query, name and score of the best rows that the queries find in the files they visit."""
    files = lambda df, lifted, times: df.select("name", "v").mapInArrow(_first_pivots(given, lifted, times), "name long, v array<double>, pivots array<int>").select("name", "v", F.explode("pivots").alias("file"))
    entries = staged(files(rows, True, posted).withColumn("deal", F.xxhash64("name")), "files")
    # at most `pivots` rows
    blocks = {r[0]: -(-r[1] // BLOCK) for r in entries.groupBy("file").count().collect()}
    many = F.element_at(F.array(*[F.lit(blocks.get(p, 0)) for p in range(pivots)]), F.col("file") + 1)
    right = entries.withColumn("block", F.pmod(F.col("deal"), many).cast("int")).select("file", "block", "name", "v")
    left = files(asked, False, visited).where(many > 0).select("file", F.explode(F.sequence(F.lit(0), many - 1)).alias("block"), "name", "v")
    found = left.groupBy("file", "block").cogroup(right.groupBy("file", "block")).applyInArrow(_search(given, k, length, rerank), "query long, name long, score double")
    order = W.partitionBy("query").orderBy(F.desc("score"), "name")
    # a row found in several files has one score: it counts once
    return found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).select("query", "name", "score").distinct()


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", pivots: int = PIVOTS, length: int = LENGTH, posted: int = POSTED, visited: int = VISITED, rerank: int = RERANK) -> DataFrame:
    """The k nearest rows of vectors for each row of queries, never the row with the query's id:
    query_id, rank (from 1), vec_id, score. Ties go to the smaller id."""
    spark = vectors.sparkSession
    # of equal vectors, the k + 1 smallest ids are all that any query can want
    alike = W.partitionBy("v").orderBy("id")
    some = usable(vectors, id_column, vector_column).withColumn("place", F.dense_rank().over(alike)).where(F.col("place") <= k + 1)
    rows = staged(some.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.xxhash64("v").alias("hash"), "v", "ids"), "vectors")
    result = "query_id long, rank int, vec_id long, score double"
    sample = rows.orderBy("hash", "ids").limit(pivots).select("v").toPandas()
    if not len(sample):
        return spark.createDataFrame([], result)
    dimension = int(pd.Series([len(v) for v in sample["v"]]).mode().iloc[0])
    chosen = np.stack([np.asarray(v) for v in sample["v"] if len(v) == dimension])
    # names follow the smallest ids, so ties between names are ties between ids
    fits = rows.where(F.size("v") == dimension).select(F.element_at("ids", 1).alias("least"), "v", "ids")
    repeated = fits.groupBy("least").count().where("count > 1").limit(1).count()
    named = staged(fits.withColumn("name", F.monotonically_increasing_id() if repeated else F.col("least")), "named")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    ids, top = named.agg(F.sum(F.size("ids")), F.max(norm)).first()
    if not ids:
        return spark.createDataFrame([], result)
    given = spark.sparkContext.broadcast((chosen, float(top)))

    wanted = usable(queries, id_column, vector_column).where(F.size("v") == dimension).distinct()
    asked = staged(wanted.select("id", F.xxhash64("v").alias("hash"), "v"), "asked")
    each = staged(asked.groupBy("v").agg(F.min("id").alias("some"), F.first("hash").alias("hash")).withColumn("name", F.monotonically_increasing_id()), "searches")
    members = staged(asked.join(each.select("name", "v", "hash"), ["hash", "v"]).select(F.col("name").alias("query"), F.col("id").alias("query_id")), "members")

    def results(found: DataFrame, of: DataFrame) -> DataFrame:
        expanded = found.join(named.select("name", "ids"), "name").select("query", "score", F.explode("ids").alias("vec_id"))
        kept = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        best = expanded.withColumn("place", F.row_number().over(kept)).where(F.col("place") <= k + 1)
        # one query id may stand on several vectors: the best of all of them
        met = of.join(best, "query").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    p = len(chosen)
    first = staged(results(_visit(named, each, given, k + 1, p, min(length, p), min(posted, p), min(visited, p), rerank), members), "found")
    short = members.join(first.groupBy("query_id").count(), "query_id", "left").where(F.coalesce("count", F.lit(0)) < k).select("query", "query_id")
    short = staged(short, "short")
    # with k rows or fewer beside its own every query is short, and first has all of them where all files were visited
    if (visited >= p and ids <= rerank) or not short.limit(1).count():
        return first
    again = each.join(short.select(F.col("query").alias("name")).distinct(), "name", "left_semi")
    all_rows = results(_visit(named, again, given, k + 1, p, min(length, p), 1, p, BLOCK * BLOCK), members.join(short.select("query_id").distinct(), "query_id", "left_semi"))
    return first.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(all_rows)


def recall(found: Iterator[tuple[int, int]], exact: Iterator[tuple[int, int]]) -> float:
    """Share of exact (query, id) pairs found."""
    want = set(exact)
    return len(want & set(found)) / max(1, len(want))
