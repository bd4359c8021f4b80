"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in SQL functions only.

The ring has CELLS cells; each virtual node stands at the start of a cell, and a cell belongs to the next node clockwise.
A row's place on the ring is a hash of doc_id and text. No shard takes more than (1 + slack) of an equal share of the
bytes: a shard takes what is offered in ring order until it is full, and the rest continues clockwise to the next shard
on the ring that has room. Loads are settled on the cells' sums, whose number does not grow with the data; a row then
finds its part of a cell by the bytes that precede it there, and its slot by the rows that precede it.

The law that holds is `bytes`. Sizes exceed a share by no more than slack and half a row for each cell that is cut.

Defined results: a null text has no bytes, size 1 and checksum 0; an empty table gives no rows; repeated rows each take a
slot; fewer rows than shards leave shards empty; columns named like an added one are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

CELLS = 1 << 14
NODES = 64
SLACK = 0.001


def ring(shards: int, nodes: int, cells: int) -> list[list[int]]:
    """For each cell, all shards in the order in which the ring reaches them clockwise."""
    at: dict[int, int] = {}
    for s in range(shards):
        for v in range(nodes):
            cell = int.from_bytes(hashlib.md5(f"shard {s} node {v}".encode()).digest()[:8]) % cells
            while cell in at:  # a taken cell sends the node to the next one
                cell = (cell + 1) % cells
            at[cell] = s
    order: list[int] = []
    out: list[list[int]] = [[]] * cells
    for cell in range(2 * cells - 1, -1, -1):  # backwards, twice around: the nearest node comes first
        if (s := at.get(cell % cells)) is not None:
            order = [s, *(x for x in order if x != s)]
        out[cell % cells] = order
    return out


def placed(rows: DataFrame, shards: int, nodes: int, cells: int, slack: float) -> DataFrame:
    """(cell, bytes) summed by cell -> segments (cell, shard, from, until) of the cells' bytes."""
    spark = rows.sparkSession
    arcs: list[tuple[int, int, list[int]]] = []
    for cell, order in enumerate(ring(shards, nodes, cells)):
        if arcs and arcs[-1][2] == order:
            arcs[-1] = (arcs[-1][0], cell, order)
        else:
            arcs.append((cell, cell, order))
    nodes_df = spark.createDataFrame(arcs, "first int, last int, ways array<int>").select(F.explode(F.sequence("first", "last")).alias("cell"), "ways")
    offered = rows.join(nodes_df, "cell").select("cell", "ways", F.lit(0).cast("long").alias("from"), "bytes")
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    most = max(1, -(-int(total * (1 + slack)) // shards))
    room = {s: most for s in range(shards)}
    found = None
    for turn in range(shards):
        free = F.create_map(*[F.lit(x) for k, v in room.items() for x in (k, v)])
        order = Window.partitionBy("shard").orderBy("cell", "from")
        offers = offered.withColumn("shard", F.col("ways")[turn])
        before = F.sum("bytes").over(order) - F.col("bytes")
        offers = offers.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("bytes"), free[F.col("shard")] - before)).cast("long"))
        offers = common.stored(offers, f"ring-{turn}")
        new = offers.where("taken > 0").select("cell", "shard", "from", (F.col("from") + F.col("taken")).alias("until"))
        found = new if found is None else found.unionByName(new)
        for r in offers.groupBy("shard").agg(F.sum("taken").alias("n")).collect():  # a row for each shard
            room[r["shard"]] -= r["n"]
        offered = offers.where("taken < bytes").select("cell", "ways", (F.col("from") + F.col("taken")).alias("from"), (F.col("bytes") - F.col("taken")).alias("bytes"))
        if offered.isEmpty():
            break
    return found


def shard(docs: DataFrame, shards: int = 8, nodes: int = NODES, cells: int = CELLS, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(F.lit("ring"), "doc_id", text)
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), h.alias("h"))
    rows = common.stored(rows.withColumn("cell", F.pmod(F.col("h"), F.lit(cells)).cast("int")), "ring-rows")
    segments = placed(rows.groupBy("cell").agg(F.sum("size").alias("bytes")), shards, nodes, cells, slack)
    in_cell = Window.partitionBy("cell").orderBy("h", "doc_id", "size")
    rows = rows.withColumn("start", F.sum("size").over(in_cell.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    middle = F.col("start") + F.floor(F.col("size") / 2)
    rows = rows.join(segments, "cell").where((middle >= F.col("from")) & (middle < F.col("until")))
    rows = rows.withColumn("local", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("start", "h")) - 1)
    counts = rows.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    base = counts.select(F.col("shard").alias("_s"), F.col("cell").alias("_c"), (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("base"))
    rows = rows.join(base, (F.col("shard") == F.col("_s")) & (F.col("cell") == F.col("_c")))
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("local")).cast("long").alias("slot"))


def op7(spark, sf_dir):
    out = shard(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
