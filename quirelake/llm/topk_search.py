"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merge of the lists.

Rows are packed into blocks (shards of candidates, tiles of queries) of a fixed number of rows. A tile meets every shard
through an equi join on the shard number; each meeting is one matrix product and yields at most k entries per query.
Lists of one query merge in a tree of a fixed fan-in, so no task ever holds more than fan-in * k entries of a query.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part; vectors of another
length than a query's do not meet it; fewer candidates than k give all of them; ties go to the smaller id; rows repeated
under one id are separate candidates, but none with the query's own id counts; a query id that repeats is answered once
per distinct vector id, from its smallest vector; no queries or an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = "block int, dim int, ids binary, rows binary"
HIT = "query_id long, vec_id long, score long, part int"


def usable(vector: Column) -> Column:
    """Neither null nor empty, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def blocks(rows: DataFrame, per_block: int) -> DataFrame:
    """Rows (vec_id, v array<double>) packed into blocks of one dimension, of at most 2 * per_block rows or nearly so."""
    n = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"))
    cut = rows.withColumn("dim", F.size("v")).join(n, "dim")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("n") / per_block)).cast("int"))

    def pack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(tables))
        ids = t["vec_id"].to_numpy().astype("<i8")
        m = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
        order = np.lexsort([*m.T[::-1], ids]) if len(ids) else []
        yield pa.RecordBatch.from_pydict({"block": pa.array([t["block"][0].as_py()], pa.int32()), "dim": pa.array([m.shape[1]], pa.int32()), "ids": [ids[order].tobytes()], "rows": [np.ascontiguousarray(m[order]).tobytes()]})

    return cut.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(pack, BLOCK)


def exact_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer-valued rows: by BLAS where a double holds every partial sum, else with Python integers."""
    if q.shape[1] * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < 2.0**53:
        return (q @ c.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    big = to_int(q) @ to_int(c).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, in order: high scores first, then small ids."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= edge)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def top_k(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, shard_rows: int = 4096, tile_rows: int = 256, fan_in: int = 16) -> DataFrame:
    """For each row that `queries` selects, its k best other rows by integer inner product of floor(scale * vector).

    vectors: columns vec_id and embedding; others are ignored. Returns query_id, rank (from 1), vec_id, score.
    """
    whole = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = whole.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"))
    asked = rows.where(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    shards = blocks(rows, shard_rows)
    tiles = blocks(asked, tile_rows).select(F.col("block").alias("tile"), "dim", F.col("ids").alias("tile_ids"), F.col("rows").alias("tile_rows"))
    numbers = shards.select("dim", "block").distinct()
    pairs = tiles.join(numbers, "dim").join(shards, ["dim", "block"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids = np.frombuffer(r["tile_ids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                q = np.frombuffer(r["tile_rows"], "<f8").reshape(len(q_ids), r["dim"])
                c = np.frombuffer(r["rows"], "<f8").reshape(len(c_ids), r["dim"])
                products = exact_products(q, c)
                out = []
                for i, own in enumerate(q_ids):
                    other = c_ids != own
                    ids, score = c_ids[other], products[i][other]
                    at = best(score, ids, k)
                    out.append((np.full(len(at), own), ids[at], score[at]))
                a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int64()), pa.array(np.full(len(a), r["block"]), pa.int32())], ["query_id", "vec_id", "score", "part"])

    hits = pairs.mapInArrow(multiply, HIT)
    better = F.struct((-F.col("score")).alias("down"), "vec_id")

    def merged(hits: DataFrame, *keys: str) -> DataFrame:
        lists = hits.groupBy("query_id", *keys).agg(F.slice(F.array_sort(F.collect_list(better)), 1, k).alias("top"))
        return lists.select("query_id", *keys, F.posexplode("top").alias("pos", "hit")).select("query_id", *keys, (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.down")).alias("score"))

    levels = merged(hits.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(fan_in * fan_in)).cast("int")), "part")
    levels = merged(levels.withColumn("part", (F.col("part") / fan_in).cast("int")), "part")
    return merged(levels).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3(spark, sf_dir):
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
