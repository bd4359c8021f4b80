"""Operators on embeddings against brute force."""

from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import common, embedding_dedup, topk_search
from quirelake.llm.components import components

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def odd_vectors(n=400, dim=16):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist(), i % 3, "x") for i in range(n)]
    for i in range(0, 120, 3):  # near and equal copies
        noise = 0.02 * (i % 4) * rng.normal(size=dim)
        rows.append((n + i, (np.array(rows[i][1]) * 3 + noise).astype(np.float32).tolist(), None, None))
    rows += [(1000, None, 1, ""), (1001, [], 1, ""), (1002, [0.0] * dim, 1, ""), (1003, [float("nan")] + [1.0] * (dim - 1), 1, ""), (1004, [None] + [1.0] * (dim - 1), 1, ""), (1005, [float("inf")] * dim, 1, ""), (1006, [1.0, 2.0], 1, ""), (1007, [2.0, 4.0], 1, ""), (None, [1.0] * dim, 1, ""), (1100, rows[0][1], 1, ""), (1100, rows[0][1], 1, "")]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


def test_top_k_equals_brute_force(spark):
    rows = odd_vectors()
    good = [(i, np.floor(1024 * np.array(v, np.float64))) for i, v, *_ in rows if i is not None and usable(v)]
    want = set()
    for q in sorted({i for i, _ in good if i % 100 == 0}):
        own = min((tuple(v) for i, v in good if i == q))
        hits = sorted((-int(np.dot(own, v)), i) for i, v in good if i != q and len(v) == len(own))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)}
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk_search.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=64, tile_rows=2).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want
    assert topk_search.top_k(df.where("false"), F.lit(True)).count() == 0


def test_exact_products_of_large_values():
    q, c = np.array([[1e17, 3.0]]), np.array([[7.0, 1.0], [-9.0, 2.0]])
    assert topk_search.exact_products(q, c).tolist() == [[7 * 10**17 + 3, -9 * 10**17 + 6]]


def test_near_vectors_equal_brute_force(spark):
    rows = odd_vectors()
    m = {k: np.array(v, np.float64) for k, (i, v, *_) in enumerate(rows) if i is not None and usable(v) and any(v)}
    unit = {k: v / np.linalg.norm(v) for k, v in m.items()}
    links, up = Counter(), {r[0]: r[0] for r in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(rows[a][0]), root(rows[b][0])))
                up[y] = x
    per_id = Counter()
    for k, n in links.items():
        per_id[rows[k][0]] += n
    want = Counter((r[0], per_id[r[0]], None if r[0] is None else root(r[0])) for r in rows)
    df = spark.createDataFrame(rows, SCHEMA)
    out = embedding_dedup.near(df, per_tile=50, leading=4).collect()
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in out) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert embedding_dedup.near(df.where("false")).count() == 0


def test_near_vectors_in_turns_hold_the_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(6000, 64)).astype(np.float32)
    m[3000:3200] = m[0] * rng.uniform(1, 3, size=(200, 1))  # a large group across tiles
    m[4000:4400] = m[1000:1400] + 0.1 * rng.normal(size=(400, 64))
    folder, held, stored = common.shared_dir(spark).removeprefix("file:"), [], common.stored
    size = lambda: sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))
    before = size()

    def watched(df, name):
        out = stored(df, name)
        held.append(size() - before)
        return out

    monkeypatch.setattr(common, "stored", watched)
    monkeypatch.setattr(embedding_dedup, "TURN_BYTES", 1500 * 256, raising=False)
    monkeypatch.setattr(embedding_dedup, "FOLD", 3, raising=False)
    df = spark.createDataFrame(((i, v.tolist(), 0, "") for i, v in enumerate(m)), SCHEMA)
    out = {r.vec_id: r for r in embedding_dedup.near(df, per_tile=300).collect()}
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    assert [out[i].n_links for i in range(6000)] == (near.sum(axis=1) - 1).tolist()
    lowest = np.arange(6000)
    while not np.array_equal(least := np.where(near, lowest, 6000).min(axis=1), lowest):
        lowest = least
    assert [out[i].component_id for i in range(6000)] == lowest.tolist()
    assert max(held) < 1.5 * m.nbytes


@pytest.mark.parametrize("edges, want", [
    ([], {}),
    ([(1, 2), (2, 3), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}),
    ([(i, i + 1) for i in range(50)], dict.fromkeys(range(51), 0)),
    ([(7, 7), (3, 9), (9, 3)], {3: 3, 9: 3}),
])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == want
