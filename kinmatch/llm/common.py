"""Shared pieces of the corpus operators: table access, scratch tables, word hashing.

Every operator writes its intermediate tables below the folder that the
cluster names in ``spark.checkpoint.dir``; a folder of our own is used only
where that setting is absent and the master is local (tests, notebooks).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.shipping import ship

#: ASCII white space as the word contracts define it.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

_ODD = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        where = getattr(shared_dir, "own", None)
        if where is None:
            where = shared_dir.own = f"file://{tempfile.mkdtemp(prefix='kinmatch-')}"
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/kinmatch/{tag}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; a stopped session leaves it to the cluster's own cleaning."""
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        return


#: Spark's setting by which the shuffle files of a query are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage, survives lost executors, and forgets the
    partitioning, so that adaptive execution may split hot keys afterwards.
    The write's shuffle files go with its end, not with a later collection of
    the driver's garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*frames: DataFrame) -> None:
    for df in frames:
        if path := getattr(df, "_scratch", None):
            remove_path(df.sparkSession, path)


#: Most narrow rows that are broadcast after they are counted (a key of two or three numbers: at most about 100 MB).
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame) -> DataFrame:
    """A written narrow table, marked for broadcast if its count allows it; beyond that the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def match_nulls(left: DataFrame, right: DataFrame, columns: dict[str, str]):
    """Equality of ``left``'s columns with ``right``'s, nulls being equal to each other."""
    out = None
    for a, b in columns.items():
        same = left[a].eqNullSafe(right[b])
        out = same if out is None else out & same
    return out


def text_key(column: str = "text") -> list:
    """Two hashes, t0 and t1, that tell the rows of one doc_id apart by their text."""
    return [F.xxhash64(column).alias("t0"), F.xxhash64(F.lit(1), column).alias("t1")]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(column: str, buckets: int):
    """``crc32(doc_id as text) mod buckets``; null ids fall in no bucket (null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def text_slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of each."""
    if _powers.up.size < n:
        n = 1 << max(19, n.bit_length())
        inverse = pow(_ODD, -1, 1 << 64)
        up, down = (np.full(n, x, np.uint64) for x in (_ODD, inverse))
        up[0] = down[0] = 1
        _powers.up, _powers.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers.up, _powers.down


_powers.up = np.empty(0, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer with full avalanche, on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_PIECE = 1 << 18


def _hash_buffer(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every maximal run of nonzero bytes."""
    inside = buffer != 0
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(buffer.size + 1)
    total = np.zeros(buffer.size + 1, np.uint64)
    np.cumsum(buffer.astype(np.uint64) * up[: buffer.size], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56))), start


def word_hashes(texts: list[bytes], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of ``texts`` and where each text's words begin.

    ``classes`` maps each byte to the byte that is hashed, 0 for separators.
    Returns ``(hashes, bounds)`` with ``bounds`` one longer than ``texts``.
    Long inputs are cut at separators, so memory follows the longest word.
    """
    joined = b"\n".join(texts) + b"\n"
    buffer = classes[np.frombuffer(joined, np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, starts, at = [], [], 0
    while at < buffer.size:
        to = min(at + _PIECE, buffer.size)
        if to < buffer.size:
            gaps = np.flatnonzero(buffer[at:to] == 0)
            if gaps.size:
                to = at + int(gaps[-1]) + 1
            else:
                more = np.flatnonzero(buffer[to:] == 0)
                to = to + int(more[0]) + 1 if more.size else buffer.size
        h, s = _hash_buffer(buffer[at:to])
        hashes.append(h)
        starts.append(s + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    return h, np.concatenate([[0], np.searchsorted(s, ends)])


def byte_classes(separators: bytes, lower: bool = True) -> np.ndarray:
    """Each byte to its class: lower case A-Z if asked, 0 for separators (and byte 0 to 255)."""
    out = np.arange(256, dtype=np.uint8)
    out[0] = 255
    if lower:
        out[65:91] += 32
    out[list(separators)] = 0
    return out


SPACES = b" \t\n\x0b\x0c\r"
#: Words are runs without ASCII white space, A-Z lower-cased.
WORD_BYTES = byte_classes(SPACES)
#: Words are runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM_BYTES = byte_classes(bytes(b for b in range(1, 128) if not chr(b).isalnum()) + b"\x00")


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of the runs of ``width`` words, sorted; a shorter text counts as one run."""
    if h.size == 0:
        return h
    n = max(1, h.size - width + 1)
    acc = np.zeros(n, np.uint64)
    for k in range(min(width, h.size)):
        acc = mix(acc * np.uint64(_ODD) + h[k : k + n])
    return np.unique(acc)


def encoded(values) -> list[bytes]:
    """UTF-8 of a column of texts; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in values]
