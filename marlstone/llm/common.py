"""Shared helpers of the training-data operators: tables that cut lineage, and vectorised word tables."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Multiplier of the polynomial hashes (odd, so that it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
#: Bytes that part words: space, tab, newline, vertical tab, form feed, return.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_BYTE_VALUES = np.random.default_rng(11).integers(1, 2**63, 256).astype(np.uint64)


#: Rows and bytes of a batch that goes to Python, and bytes of a Parquet row group while it is written: whole texts are large rows.
BATCH_ROWS, BATCH_BYTES, ROW_GROUP_BYTES = 2_000, 4 << 20, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that later plans of this session send to Python, unless they are bounded closer already."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        have = spark.conf.get(key, None)
        if have is None or not have.isdigit() or not 0 < int(have) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` if the session has it; on one machine else a folder made here."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/marlstone/{uuid.uuid4().hex}"
    schema = df.schema
    # the shuffle files behind the table are of no use once it is written
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(key, before)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(schema).parquet(path)
    _WRITTEN[id(out)] = (out, where)
    return out


#: Tables of this session that were written and may be discarded, by the frames that read them.
_WRITTEN: dict[int, tuple] = {}


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more; other frames are left alone."""
    for df in tables:
        _, path = _WRITTEN.pop(id(df), (None, None))
        if path is not None:
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, as UTF-8 (null: none)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a polynomial hash over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


_POWERS = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, np.uint64)
        step = base
        while len(have) < n:
            have = np.concatenate([have, have * np.uint64(step)])
            step = step * step % 2**64
        _POWERS[base] = have
    return have[:n]


class Rolling:
    """Hashes of any slices of one array, from prefix sums: slice (s, e) hashes to its values weighted by powers, shifted back by s: equal slices of any arrays hash alike."""

    def __init__(self, values: np.ndarray, base: int = BASE):
        self.base = base
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers(self.n, base), out=self.sums[1:])

    @staticmethod
    def of_bytes(buf: np.ndarray, base: int = BASE) -> Rolling:
        return Rolling(_BYTE_VALUES[buf], base)

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(self.n + 1, pow(self.base, -1, 2**64))
        return mix((self.sums[end] - self.sums[start]) * back[start])


def exact_ids(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class number of each slice of a byte array: equal slices, and only they, share it. Hashes form classes, bytes decide."""
    n, size = len(start), end - start
    if n == 0:
        return np.zeros(0, np.int64)
    h = Rolling.of_bytes(buf).slices(start, end)
    order = np.lexsort((size, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (size[order][1:] != size[order][:-1])])
    first = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]  # the slice that stands for each class
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(new) - 1
    other = np.flatnonzero(~new)
    for s, e in _portions(size[order[other]], 1 << 18):
        mine, its = order[other[s:e]], first[other[s:e]]
        step = np.arange(size[mine].sum()) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
        if not np.array_equal(buf[np.repeat(start[mine], size[mine]) + step], buf[np.repeat(start[its], size[mine]) + step]):
            raw, names = buf.tobytes(), {}  # two different slices with one hash
            return np.array([names.setdefault(raw[x:y], len(names)) for x, y in zip(start.tolist(), end.tolist())], np.int64)
    return out


def _portions(size: np.ndarray, most: int):
    """Bounds of neighbouring items with about ``most`` bytes together."""
    part = (np.cumsum(size) - size) // most
    return zip(*bounds(part))


def joined(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one UTF-8 byte array with a newline after each, and the start of each (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), at


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts (A-Z lower-cased), and where the words of each text begin (one more at the end)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() if isinstance(t, str) else b"" for t in texts]
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.diff(np.concatenate([[True], SPACES[buf], [True]]).astype(np.int8))
    ws, we = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return Rolling.of_bytes(buf).slices(ws, we), np.searchsorted(ws, at)


def chunks(pdf: pd.DataFrame, text: str, most: int = 300_000):
    """Slices of a batch whose texts have about ``most`` characters together (one long text stays whole)."""
    if len(pdf) == 0:
        return
    size = pdf[text].map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    part = np.cumsum(size) // most
    for s, e in zip(*bounds(part)):
        yield pdf.iloc[s:e]


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    if len(keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return s, np.append(s[1:], len(keys))
