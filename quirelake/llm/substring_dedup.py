"""Removal of long repeated passages by De Bruijn compaction.

An edge is a window of `long` consecutive words; a repeated edge is one that starts at two places at least. Edges are
not shuffled one by one: consecutive edges of a document that share their smallest k-word seed form a path, and a path
travels as one row (seed, body, where it starts, how many edges). Paths with equal words are one path.

* A seed all of whose occurrences are one and the same path is nonbranching: each of its edges is repeated.
* At a branching seed, each distinct path is spelled out into its edges once, with the number of its copies, from one
  source coordinate; edges are counted, and a path keeps a bit for each edge that is repeated.

Joins bring the bits back to every occurrence's source coordinates, and a document drops the words they cover. A path is
known by two independent 64-bit hashes of its words, an edge by its seed and another; equal edges have equal seeds at
equal places, so counting within a seed misses nothing.

Defined results: a null or empty text has no words; fewer words than `long` remove nothing; overlapping repeats within one
document count; repeated rows count as separate documents; no order of rows is needed, so ties do not arise; other
columns are kept, those named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LONG = 35
SEED_WORDS = 6


def least_in_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `width` values, its least one and where that stands first; by doubling."""
    v, p, step = values, np.arange(len(values)), 1

    def join(shift: int) -> None:
        nonlocal v, p
        right = v[shift:] < v[:-shift]
        v, p = np.where(right, v[shift:], v[:-shift]), np.where(right, p[shift:], p[:-shift])

    while step * 2 <= width:
        join(step)
        step *= 2
    if width > step:
        join(width - step)
    return v, p


def paths_of(words: common.Words, long: int, k: int) -> tuple[np.ndarray, ...]:
    """text index, first word in the text, edges, seed, body of each path."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(words) < long:
        return none
    seeds, at = least_in_windows(words.runs(k), long - k + 1)
    of = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    start = np.flatnonzero(of[: len(of) - long + 1] == of[long - 1 :])
    if not len(start):
        return none
    seeds, at = seeds[start], at[start]
    new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    edges = np.diff(np.concatenate([new, [len(start)]]))
    first = start[new]
    body = words.spans(first, edges + long - 1, 1)
    return of[first], first - words.first[of[first]], edges, seeds[new].view(np.int64), body.view(np.int64)


def paths(docs: DataFrame, long: int, k: int) -> DataFrame:
    """(doc_id, tag, text) -> a row for each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.as_bytes(batch.column("text"))
            for a, b in common.slices(raw):
                of, start, edges, seed, body = paths_of(common.Words(raw[a:b]), long, k)
                at = pa.array(of + a)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "tag": batch.column("tag").take(at), "start": pa.array(start, pa.int32()), "edges": pa.array(edges, pa.int32()), "seed": pa.array(seed), "body": pa.array(body)})

    kept = [docs.schema["doc_id"], docs.schema["tag"]]
    return docs.mapInArrow(run, T.StructType([*kept, *T._parse_datatype_string("start int, edges int, seed long, body long").fields]))


def spelled(docs: DataFrame, long: int) -> DataFrame:
    """(text, paths array) -> seed, body, edge number, copies, hash of the edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.as_bytes(batch.column("text"))
            rows = batch.column("paths").to_pylist()
            for a, b in common.slices(raw):
                words = common.Words(raw[a:b])
                own = [(p["start"] + int(words.first[i]), p["edges"], p["seed"], p["body"], p["copies"]) for i in range(b - a) for p in rows[a + i]]
                start, edges, seed, body, copies = (np.array(x, np.int64) for x in zip(*own, strict=True)) if own else [np.zeros(0, np.int64)] * 5
                number = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                edge = words.spans(np.repeat(start, edges) + number, long, 1).view(np.int64)
                yield pa.RecordBatch.from_pydict({"seed": np.repeat(seed, edges), "body": np.repeat(body, edges), "number": pa.array(number, pa.int32()), "copies": np.repeat(copies, edges), "edge": edge})

    return docs.mapInArrow(run, "seed long, body long, number int, copies long, edge long")


def kept_words(text: bytes, words: list[bytes], marks: list[dict], long: int) -> list[bytes]:
    starts = [m["start"] + i for m in marks for i in range(m["bits"].bit_length()) if m["bits"] >> i & 1]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, np.array(starts), 1)
    np.add.at(cover, np.minimum(np.array(starts) + long, len(words)), -1)
    keep = np.cumsum(cover[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


def cut(docs: DataFrame, long: int) -> DataFrame:
    """Add n_words, n_removed and kept_text by the marks of each row; marks goes."""
    new = ("n_words", "n_removed", "kept_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = common.as_bytes(batch.column("text"))
            marks = batch.column("marks").to_pylist()
            total, removed, text = [], [], []
            for t, m in zip(raw, marks, strict=True):
                words = t.split()
                kept = kept_words(t, words, m, long) if m else words
                total.append(len(words))
                removed.append(len(words) - len(kept))
                text.append(b" ".join(kept).decode())
            keep = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in (*new, "marks", "tag")}
            yield pa.RecordBatch.from_pydict(keep | {"n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(text, pa.string())})

    kept = [f for f in docs.schema.fields if f.name not in (*new, "marks", "tag")]
    return docs.mapInArrow(run, T.StructType([*kept, *T._parse_datatype_string("n_words long, n_removed long, kept_text string").fields]))


def repeated(docs: DataFrame, long: int, k: int) -> DataFrame:
    """(doc_id, tag, text) -> doc_id, tag, marks: starts of paths with a bit for each repeated edge."""
    every = common.stored(paths(docs, long, k), "paths")
    seeds = every.groupBy("seed").agg(F.count("*").alias("n"), F.min("body").alias("least"), F.max("body").alias("most"))
    seeds = seeds.where("n > 1").select("seed", (F.col("least") != F.col("most")).alias("branches"))
    hits = common.stored(every.join(seeds, "seed"), "repeated-seeds")
    kinds = hits.where("branches").groupBy("seed", "body").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "tag", "start", "edges")).alias("at"))
    here = kinds.groupBy(F.col("at.doc_id").alias("doc_id"), F.col("at.tag").alias("tag")).agg(
        F.collect_list(F.struct(F.col("at.start").alias("start"), F.col("at.edges").alias("edges"), "seed", "body", "copies")).alias("paths"))
    edges = common.stored(spelled(_with(docs.select("doc_id", "tag", "text"), here, "inner").select("text", "paths"), long), "edges")
    more = edges.groupBy("seed", "edge").agg(F.sum("copies").alias("n")).where("n > 1").select("seed", "edge")
    bit = F.expr("shiftleft(1L, number)")
    bits = edges.join(more, ["seed", "edge"]).groupBy("seed", "body").agg(F.bit_or(bit).alias("bits"))
    plain = hits.where("NOT branches").select("doc_id", "tag", "start", F.expr("shiftleft(1L, edges) - 1").alias("bits"))
    forked = hits.where("branches").join(bits, ["seed", "body"]).select("doc_id", "tag", "start", "bits")
    return plain.unionByName(forked).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("start", "bits")).alias("marks"))


def _with(docs: DataFrame, more: DataFrame, how: str) -> DataFrame:
    more = more.withColumnsRenamed({"doc_id": "_doc_id", "tag": "_tag"})
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("tag") == F.col("_tag"))
    return docs.join(more, on, how).drop("_doc_id", "_tag")


def remove_repeats(docs: DataFrame, long: int = LONG, k: int = SEED_WORDS) -> DataFrame:
    """Add n_words, n_removed and kept_text: the words left, joined by one space. `long` - k must be below 63."""
    docs = docs.drop("marks").withColumn("tag", common.text_tag(F.col("text")))
    return cut(_with(docs, repeated(docs, long, k), "left"), long)


def op1(spark, sf_dir):
    out = remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 33)) AS i) s
), again AS (
  SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM windows JOIN again USING (h))
), words AS (
  SELECT r, k, w[k] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) s
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN covered USING (r, k) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
