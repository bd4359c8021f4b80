"""Shared pieces of the corpus operators: table access, scratch tables, and the numpy word kernel."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the `documents` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A word is a run of bytes other than the space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"

_scratch: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local one only where it is unset and all runs in one process (tests)."""
    key = spark.sparkContext.applicationId
    if key not in _scratch:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = f"file://{tempfile.mkdtemp(prefix='quirelake-')}"
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(base)
        _scratch[key] = f"{base.rstrip('/')}/quirelake-{key}-{uuid.uuid4().hex[:8]}"
        atexit.register(_forget, spark, _scratch[key])
    return _scratch[key]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    """Best effort: the session may have ended before the interpreter."""
    try:
        _delete(spark, path)
    except Exception:  # noqa: BLE001 - the JVM is gone; nothing is left to ask
        return


#: Settings of a write: its shuffle files go when it ends, not when the driver collects its garbage; and a batch of long texts stays small.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


#: Seconds between two returns of the driver's memory, and MB of its heap up to which no garbage is collected for that.
SHRINK_SECONDS, SHRINK_MB = 5, 128
#: Of the heap of the driver, the hundredth parts that may be free after a collection; the JVM's own value is 70.
_FREE = "40"
_shrunk: dict[str, float] = {}


def _managed(spark: SparkSession, bean: str, operation: str, *args: str) -> None:
    """Call an operation of a management bean of the driver's JVM; the beans' classes are closed, the interface is open."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm

    def array(kind, items):
        out = gateway.new_array(kind, len(items))
        for i, x in enumerate(items):
            out[i] = x
        return out

    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    name = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}")
    call.invoke(server, array(jvm.Object, [name, operation, array(jvm.Object, args), array(jvm.String, ["java.lang.String"] * len(args))]))


def shrink_driver(spark: SparkSession) -> None:
    """Return what the driver's JVM has freed to the system: many queries of many tasks grow its heap to the limit, full of garbage,
    and it keeps that heap and what the C library has freed. Best effort: other JVMs lack the beans."""
    key = spark.sparkContext.applicationId
    heap = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if key in _shrunk and time.monotonic() - _shrunk[key] < SHRINK_SECONDS:
        return
    try:
        if key not in _shrunk:
            _managed(spark, "HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", _FREE)
        if heap.totalMemory() > SHRINK_MB << 20:
            spark.sparkContext._jvm.System.gc()
        _managed(spark, "DiagnosticCommand", "systemTrimNativeHeap")
    except Exception:  # noqa: BLE001 - a JVM without them; its heap stays as it is
        pass
    _shrunk[key] = time.monotonic()


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut lineage: write a scratch table to the shared folder and read it back. Lost executors lose nothing of it.

    codec: of a table that lies long and holds texts; else the session's.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    shrink_driver(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables of which nothing more is read."""
    for df in tables:
        _delete(df.sparkSession, df._scratch_path)


#: Bytes up to which a table is broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, lists: str = "", wide: int = 32) -> DataFrame:
    """Broadcast a scratch table whose bytes are counted and few; leave any other to a shuffle.

    wide: bytes of a row at most; lists: SQL for the number of entries of 32 bytes that a row has besides, if any.
    """
    size = df.agg(F.sum(F.lit(wide) + (F.expr(lists) * 32 if lists else F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def text_tag(text: Column) -> Column:
    """64 bits that tell apart rows of one doc_id whose texts differ."""
    return F.xxhash64(text)


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


# ---- numpy word kernel -------------------------------------------------------------------------------------------

_Q = (0xD1342543DE82EF95, 0x2545F4914F6CDD1D)
_QINV = tuple(pow(q, -1, 1 << 64) for q in _Q)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Keys of the two hashes of a word, each a keyed hash of all its bytes.
_KEYS = ("quirelake-word-0", "quirelake-word-1")
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have, dtype=np.uint64)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of a few texts, two independent 64-bit hashes of each, and the first word of each text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        cut = [(t.translate(_LOWER) if lower else t).split() for t in texts]
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(w) for w in cut], out=self.first[1:])
        self.words = np.empty(self.first[-1], object)
        self.words[:] = list(chain.from_iterable(cut))
        self._hash: dict[int, np.ndarray] = {}
        self._total: dict[int, np.ndarray] = {}

    def hashes(self, kind: int = 0) -> np.ndarray:
        if kind not in self._hash:
            self._hash[kind] = hash_array(self.words, hash_key=_KEYS[kind], categorize=False) if len(self.words) else np.zeros(0, np.uint64)
        return self._hash[kind]

    def __len__(self) -> int:
        return len(self.words)

    def runs(self, n: int, kind: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; those that cross into the next text are there too, for the caller to leave out."""
        return self.spans(np.arange(max(0, len(self) - n + 1)), n, kind)

    def spans(self, start: np.ndarray, n: np.ndarray | int, kind: int = 0) -> np.ndarray:
        """Hash of n words from each start. kind: one of two independent hashes."""
        with np.errstate(over="ignore"):
            if kind not in self._total:
                total = np.zeros(len(self) + 1, np.uint64)
                np.cumsum(self.hashes(kind) * powers(_Q[kind], len(self)), out=total[1:])
                self._total[kind] = total
            total = self._total[kind]
            out = (total[start + n] - total[start]) * powers(_QINV[kind], len(self) + 1)[start]
        return mixed(out ^ np.asarray(n, np.uint64))


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Cut a batch so that each piece holds about `limit` bytes, or one text; bounds a worker's memory."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def give_back() -> None:
    """Return what a worker has freed to the system: between tasks it lives on, beside the memory of the JVM."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
