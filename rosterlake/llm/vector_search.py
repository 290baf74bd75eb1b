"""Exact top-k inner-product search over vector-approximation files.

The approximation file holds one byte per component: the number of the vector's cell among CELLS
equal ones between the smallest and largest value of that component over all vectors. With a cell's
middle in place of a component, a score is off by half a cell at most, so each query has one radius and
the middle score plus or minus it bounds the exact score.

Blocks of queries meet blocks of the approximation file only (exact vectors stay where they are) and
keep, per query, the vectors whose upper bound reaches the block's k-th lower bound. Over all blocks the
k first in the order of the bounds are read exactly; their k-th exact score then says which others
must be read too (upper bound at or above it, ties included), and everything else is certain
to stay out. Exact rows are fetched by a join on their ids. Nothing is broadcast but the cells' edges
(two numbers per component).

Edge cases: vectors that are null, or hold null or non-finite components, take no part, neither as
queries nor as candidates; vectors are searched among those of their own length; ties go to the smaller
vec_id; a query never returns its own id; rows repeated whole are candidates each, and ask once;
with fewer than k candidates all are returned; empty tables give no rows. Scores are exact
up to 2**53; components beyond what a long holds are cut to it by floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm._common import discard, load, ship, stored

CELLS = 256
ROWS, ASKED = 65_536, 4096


class Grid:
    """Equal cells of each component: lowest edges and widths."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, np.maximum((high - low) / CELLS, 1e-300)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) / self.width, 0, CELLS - 1).astype(np.uint8)

    def middles(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes + 0.5) * self.width

    def radius(self, q: np.ndarray) -> np.ndarray:
        """How far an exact score of each query can be from that of the cells' middles, with room for rounding."""
        reach = np.abs(q) @ (self.width / 2)
        return reach * (1 + 1e-6) + 1e-9 * (np.abs(q) @ (np.abs(self.low) + CELLS * self.width)) + 1e-6


def candidates(grid: Grid, ids: np.ndarray, codes: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query number, vector number, middle score) that one block's bounds cannot rule out."""
    middles, radius = grid.middles(codes), grid.radius(q)
    step = max(1, 4_000_000 // max(1, len(ids)))
    for at in range(0, len(q), step):
        score = q[at : at + step] @ middles.T
        score[q_ids[at : at + step, None] == ids[None, :]] = -np.inf
        floor = np.partition(score, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(score), -np.inf)
        # the k-th lower bound is floor - radius; an upper bound is score + radius
        i, j = np.nonzero((score >= (floor - 2 * radius[at : at + step])[:, None]) & np.isfinite(score))
        yield i + at, j, score[i, j]


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, rows: int = ROWS, asked: int = ASKED) -> DataFrame:
    """query_id, rank, vec_id, score; both frames have vec_id long and v array<double> of whole numbers."""
    spark = vectors.sparkSession
    ship(spark)
    edges = vectors.select(F.size("v").alias("d"), F.posexplode("v")).groupBy("d", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).collect()
    grids: dict[int, Grid] = {}
    for d in {r["d"] for r in edges}:
        own = sorted((r["pos"], r["low"], r["high"]) for r in edges if r["d"] == d)
        grids[d] = Grid(np.array([x for _, x, _ in own]), np.array([x for *_, x in own]))
    sent = spark.sparkContext.broadcast(grids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [sent.value[len(v)].codes(np.asarray(v.values)).tobytes() for v in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(codes, pa.binary())], ["vec_id", "code"])

    cells = stored(vectors.select("vec_id", "v").mapInArrow(encode, "vec_id long, code binary"), "cells")
    asking = queries.select("vec_id", "v").distinct().withColumn("qk", F.xxhash64("vec_id", "v"))
    n, m = max(1, -(-cells.count() // rows)), max(1, -(-asking.count() // asked))
    pair = F.concat_ws("-", "b", "a", "d")
    base = cells.select("vec_id", "code", F.length("code").alias("d"), F.pmod(F.xxhash64("vec_id", "code"), F.lit(n)).alias("b"))
    base = base.withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).select(pair.alias("p"), "vec_id", "code")
    ask = asking.select("vec_id", "qk", "v", F.size("v").alias("d"), F.pmod("qk", F.lit(m)).alias("a"))
    ask = ask.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select(pair.alias("p"), "vec_id", "qk", "v")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"qk": [], "vec_id": [], "middle": [], "radius": []})
        q, codes = np.stack(right["v"].to_numpy()), np.stack([np.frombuffer(c, np.uint8) for c in left["code"]])
        grid, ids, own = sent.value[q.shape[1]], left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        radius, qk = grid.radius(q), right["qk"].to_numpy()
        parts = list(candidates(grid, ids, codes, own, q, k))
        i, j, s = (np.concatenate([p[c] for p in parts]) for c in range(3))
        return pd.DataFrame({"qk": qk[i], "vec_id": ids[j], "middle": s, "radius": radius[i]})

    met = base.groupBy("p").cogroup(ask.groupBy("p")).applyInPandas(meet, "qk long, vec_id long, middle double, radius double").distinct()
    by_bound = Window.partitionBy("qk").orderBy(F.desc("middle"), "vec_id")
    open_ = stored(met.withColumn("place", F.row_number().over(by_bound)), "open")
    # an id may stand at several vectors: they are all read, and their exact scores decide
    exact = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x).cast("long")
    target = asking.select("qk", F.col("vec_id").alias("query_id"), F.col("v").alias("q"))

    def read(some: DataFrame) -> DataFrame:
        return some.join(vectors, "vec_id").join(target, "qk").filter(F.size("v") == F.size("q")).select("qk", "query_id", "vec_id", exact.alias("score"))

    first = stored(read(open_.filter(F.col("place") <= k).select("qk", "vec_id")), "first")
    order = Window.partitionBy("qk").orderBy(F.desc("score"), "vec_id")
    least = first.withColumn("r", F.row_number().over(order)).filter(F.col("r") == k).select("qk", F.col("score").alias("least"))
    rest = open_.filter(F.col("place") > k).join(least, "qk").filter(F.col("middle") + F.col("radius") >= F.col("least"))
    ranked = first.union(read(rest.select("qk", "vec_id"))).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    done = stored(ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score"), "hits")
    for df in (cells, open_, first):
        discard(df)
    return done


def whole_numbers(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component; rows with unusable vectors go."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull() & (F.size(vector) > 0) & sound).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(load(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.filter(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, q.e, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
      FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
