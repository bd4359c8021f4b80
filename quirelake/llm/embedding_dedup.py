"""Near-duplicate vectors by PCA-ordered tiled comparison with early stopping.

Vectors are scaled to length one and turned to the principal axes of all of them, largest first. They are cut by range
of the first coordinate into tiles. Two tiles meet only if their ranges come closer than two vectors at the threshold can
lie apart. A meeting multiplies the leading dimensions first; a pair whose partial product plus the product of the norms
of what is left cannot reach the threshold stops there, and only the others are finished and decided in double precision
on the original scaled vectors.

The tiles are stored once, as the vectors came, and never shuffled again: a turn broadcasts a bounded number of them, and each
tile from these on that may meet them is read where it lies. So disk holds the vectors about twice, however many tiles meet.

A task returns a count for each vector and edges that connect what its links connect, not the links themselves: at most as many
edges as it has met vectors. Components of these edges are those of all links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
unlike lengths do not link; rows that repeat one vec_id count one by one and reach each other; a null vec_id links with
nothing and keeps a row; an empty table gives no rows; labels and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components
from .topk_search import usable

#: Rows of a tile, and dimensions that are multiplied before a pair may stop.
TILE = 2048
LEADING = 16
#: Bytes of the tiles that one turn broadcasts, and after how many turns what they found becomes one table.
TURN_BYTES = 32 << 20
FOLD = 16
#: Files of tiles at least, so that tasks have some each.
FILES = 32
_PART = "dim int, tile int, least double, most double, rows long, ids binary, vectors binary"


def usable_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that may link, as they came: floats stay floats."""
    kept = vectors.schema["embedding"].dataType.elementType == T.FloatType()
    v = F.col("embedding") if kept else F.col("embedding").cast("array<double>")
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.exists("v", lambda x: x != 0))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one. Each row comes out alike whatever rows stand beside it."""
    m = m.astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)  # by the largest component first: squares of very large or small ones stay finite
    return m / np.sqrt(np.cumsum(m * m, axis=1)[:, -1:])


def first(m: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """First principal coordinate of rows of length one, alike whatever rows stand beside."""
    return np.cumsum(m * turn[:, 0], axis=1)[:, -1]


def by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places, matrix) of each vector length in each batch; places: which of its rows."""
    for batch in batches:
        lists = batch.column("v")
        ends = lists.offsets.to_numpy()
        sizes, flat = np.diff(ends), lists.values.to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            at = np.flatnonzero(sizes == dim)
            yield batch, at, flat[ends[at][:, None] + np.arange(dim)]


def axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes for each vector length, from all rows: one matrix of moments a task."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, _, m in by_length(batches):
            m = unit(m)
            total[m.shape[1]] = total.get(m.shape[1], 0) + m.T @ m
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(total), pa.int32()), "m": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, m in zip(batch.column("dim").to_pylist(), batch.column("m").to_pylist(), strict=True):
                total[dim] = total.get(dim, 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(total), pa.int32()), "m": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    parts = rows.select("v").mapInArrow(moments, "dim int, m binary")
    tree = parts.repartition(16).mapInArrow(added, "dim int, m binary").repartition("dim").mapInArrow(added, "dim int, m binary")
    out = {}
    for r in tree.collect():  # a matrix for each vector length
        m = np.frombuffer(r["m"]).reshape(r["dim"], r["dim"])
        out[r["dim"]] = np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1])
    return out


def tiles(rows: DataFrame, turns: dict[int, np.ndarray], per_tile: int) -> DataFrame:
    """Rows packed into tiles by range of the first principal coordinate."""
    cell = lambda lead: np.trunc(lead * 4096).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, m in by_length(batches):
            dim = m.shape[1]
            cells, n = np.unique(cell(first(unit(m), turns[dim])), return_counts=True)
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(cells), dim, np.int32), "cell": cells, "n": n.astype(np.int64)})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, m in by_length(batches):
            lead = first(unit(m), turns[m.shape[1]])
            yield pa.RecordBatch.from_pydict({"dim": np.full(len(at), m.shape[1], np.int32), "cell": cell(lead), "lead": lead, "vec_id": batch.column("vec_id").take(pa.array(at)), "v": [x.tobytes() for x in m]})

    # bounds of the ranges; rows of one bound are told apart by a hash, so a hot value spreads over tiles
    cells = common.stored(rows.select("v").mapInArrow(count, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")), "cells")
    tiles_n = cells.groupBy("dim").agg(F.ceil(F.sum("n") / per_tile).alias("n")).agg(F.sum("n")).first()[0] or 1
    upto = F.sum("n").over(Window.partitionBy("dim").orderBy("cell"))
    ranges = cells.select(F.col("dim").alias("_dim"), F.col("cell").alias("_cell"), "n", (upto - F.col("n")).alias("before"))
    placed = rows.mapInArrow(place, "dim int, cell int, lead double, vec_id long, v binary")
    at = placed.join(common.small(ranges), (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell")))
    within = F.pmod(F.xxhash64("vec_id", "lead"), F.col("n"))
    at = at.withColumn("tile", F.floor((F.col("before") + within) / F.lit(per_tile)).cast("int"))
    kind = _kind(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        dim, raw = t["dim"][0].as_py(), b"".join(t["v"].to_pylist())
        lead = first(unit(np.frombuffer(raw, kind).reshape(-1, dim)), turns[dim])
        yield pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "tile": pa.array([t["tile"][0].as_py()], pa.int32()), "least": [lead.min()], "most": [lead.max()], "rows": [len(t)], "ids": [t["vec_id"].to_numpy().astype("<i8").tobytes()], "vectors": [raw]})

    files = max(min(tiles_n, FILES), -(-tiles_n // 16))
    out = common.stored(at.select("dim", "tile", "vec_id", "v").repartition(files, "dim", "tile").groupBy("dim", "tile").applyInArrow(pack, _PART), "tiles")
    common.forget(cells)
    return out


def _kind(rows: DataFrame) -> str:
    return "<f4" if rows.schema["v"].dataType.elementType == T.FloatType() else "<f8"


def prepared(m: np.ndarray, turn: np.ndarray, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length one, and of each the leading dimensions with the norm of the rest behind: their products bound the cosines."""
    m = unit(m)
    turned = m @ turn
    rest = np.sqrt(np.maximum(0, (turned[:, leading:] ** 2).sum(axis=1, keepdims=True)))
    return m, np.concatenate([turned[:, :leading], rest], axis=1).astype(np.float32)


def close_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of prepared rows whose cosine is at least `least`: bound first, then the whole product."""
    (a, bound_a), (b, bound_b) = a, b
    slack = (bound_a.shape[1] + 4) * 2.0**-22  # of single precision
    i, j = np.nonzero(bound_a @ bound_b.T >= np.float32(least - slack))
    out = []
    for s in range(0, len(i), 1 << 17):
        x, y = i[s : s + (1 << 17)], j[s : s + (1 << 17)]
        ok = np.einsum("ij,ij->i", a[x], b[y]) >= least
        out.append((x[ok], y[ok]))
    return np.concatenate([o[0] for o in out]) if out else i, np.concatenate([o[1] for o in out]) if out else j


def merged(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least member of each node's component, when those of `up` are joined by links (i, j) as well."""
    while True:
        x, y = up[i], up[j]
        apart = x != y
        if not apart.any():
            return up
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        up = up.copy()
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(higher := up[up], up):
            up = higher


def turn(packed: DataFrame, dim: int, heads: list, axes_of: np.ndarray, kind: str, least: float, leading: int) -> DataFrame:
    """(a, b, n) of the tiles `heads` among each other and with those behind them: n links of the vector a, or an edge (a, b)."""
    gap = float(np.sqrt(2 - 2 * least)) + 1e-9
    low, high = min(h["tile"] for h in heads), max(h["tile"] for h in heads)
    own = packed.where((F.col("dim") == dim) & F.col("tile").between(low, high))
    own = own.select("tile", "least", "most", F.col("ids").alias("a_ids"), F.col("vectors").alias("a"))
    near = (F.col("l") <= max(h["most"] for h in heads) + gap) & (F.col("m") >= min(h["least"] for h in heads) - gap)
    theirs = packed.select("dim", F.col("tile").alias("other"), F.col("least").alias("l"), F.col("most").alias("m"), F.col("ids").alias("b_ids"), F.col("vectors").alias("b"))
    theirs = theirs.where((F.col("dim") == dim) & (F.col("other") >= low) & near)
    pairs = theirs.join(F.broadcast(own), (F.col("tile") <= F.col("other")) & (F.col("l") <= F.col("most") + gap) & (F.col("m") >= F.col("least") - gap))
    ends = np.cumsum([0, *[h["rows"] for h in heads]])
    begin = {h["tile"]: int(e) for h, e in zip(heads, ends[:-1], strict=True)}
    total = int(ends[-1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = lambda raw: prepared(np.frombuffer(raw, kind).reshape(-1, dim), axes_of, leading)
        ids, up, counts = np.zeros(total, np.int64), np.arange(total), np.zeros(total, np.int64)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        now = None  # the tile that meets those of the turn: number, ids, prepared rows, links of each

        def found(at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": at[n > 0], "b": pa.nulls(int((n > 0).sum()), pa.int64()), "n": n[n > 0]})

        def edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"a": a, "b": b, "n": pa.nulls(len(a), pa.int64())})

        for batch in batches:
            for n in range(batch.num_rows):
                tile, other, a_ids, a, b_ids, b = (batch.column(c)[n] for c in range(6))
                tile, other = tile.as_py(), other.as_py()
                if tile not in known:
                    known[tile] = read(a.as_buffer())
                    ids[begin[tile] : begin[tile] + len(known[tile][0])] = np.frombuffer(a_ids.as_buffer(), "<i8")
                if now is None or now[0] != other:
                    if now and now[0] not in begin:
                        yield found(now[1], now[3])
                    b_ids = np.frombuffer(b_ids.as_buffer(), "<i8")
                    now = other, b_ids.copy(), read(b.as_buffer()), np.zeros(len(b_ids), np.int64)
                    if other in begin:
                        ids[begin[other] : begin[other] + len(b_ids)] = b_ids
                i, j = close_pairs(known[tile], now[2], least)
                if tile == other:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                i = i + begin[tile]
                counts += np.bincount(i, minlength=total)
                if other in begin:
                    j = j + begin[other]
                    counts += np.bincount(j, minlength=total)
                    up = merged(up, i, j)
                else:
                    now[3][:] += np.bincount(j, minlength=len(now[1]))
                    both = merged(np.concatenate([up, total + np.arange(len(now[1]))]), i, total + j)
                    up, to = both[:total], both[total:]
                    linked = np.flatnonzero(to < total)
                    yield edges(ids[to[linked]], now[1][linked])
        if now and now[0] not in begin:
            yield found(now[1], now[3])
        yield found(ids, counts)
        led = np.flatnonzero(up < np.arange(total))
        yield edges(ids[up[led]], ids[led])
        common.give_back()

    return common.stored(pairs.select("tile", "other", "a_ids", "a", "b_ids", "b").mapInArrow(compare, "a long, b long, n long"), "near")


def folded(found: list[DataFrame]) -> DataFrame:
    """What turns found as one table: a count a vector, an edge a vector."""
    every = reduce(DataFrame.unionByName, found)
    counts = every.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n")).select("a", F.lit(None).cast("long").alias("b"), "n")
    edges = components(every.where("b IS NOT NULL").select("a", "b")).where("node <> component")
    out = common.stored(counts.unionByName(edges.select(F.col("component").alias("a"), F.col("node").alias("b"), F.lit(None).cast("long").alias("n"))), "near")
    common.forget(*found)
    return out


def near(vectors: DataFrame, least: float = 0.9, per_tile: int = TILE, leading: int = LEADING) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    rows = usable_rows(vectors)
    turns = axes(rows)
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    if not turns:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    packed = tiles(rows, turns, per_tile)
    heads = packed.select("dim", "tile", "least", "most", "rows", F.length("vectors").alias("bytes")).orderBy("dim", "tile").collect()  # a row for each tile
    found, own, size = [], [], 0
    for k, head in enumerate(heads):
        own, size = [*own, head], size + head["bytes"]
        after = heads[k + 1] if k + 1 < len(heads) else None
        if after is None or after["dim"] != head["dim"] or size + after["bytes"] > TURN_BYTES:
            found.append(turn(packed, head["dim"], own, turns[head["dim"]], _kind(rows), least, leading))
            own, size = [], 0
            if len(found) >= FOLD:
                found = [folded(found)]
    common.forget(packed)
    every = reduce(DataFrame.unionByName, found)
    counts = every.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n_links"))
    joined = components(every.where("b IS NOT NULL").select("a", "b"))
    out = ids.join(counts, ids["vec_id"] == counts["a"], "left").join(joined, ids["vec_id"] == joined["node"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op9(spark, sf_dir):
    return near(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.r, a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT x AS a, x AS b FROM links UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x
), owner AS (
  SELECT a, min(b) AS component FROM reach GROUP BY a
), counts AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(e.vec_id = coalesce(component, e.vec_id), false) AS kept
FROM embeddings e LEFT JOIN counts ON counts.x = e.vec_id LEFT JOIN owner ON owner.a = e.vec_id
"""
