"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a bundle ends
with a seek table (the sizes of all frames) in a skippable frame, in the
public seekable format. A record is found by bundle, frame, and the offset
inside the frame.

Of records with equal payloads one is a ``response`` and the others are
``revisit`` records that refer to it and repeat neither payload nor headers.

Writing survives lost executors: a task writes to a file of its own name and
hands over its index rows, and only files named by the committed index count.
Files of failed attempts are never read.

Defined results: a null payload is empty; payloads are compared by SHA-1 and
length; of rows that repeat the smallest page_id of a payload each is a
response; a null page_id is a revisit if any id is known for the payload and
a response otherwise; other columns are ignored; an empty table writes nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.common import encoded, materialize, scratch_path, table

#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 0
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 256 << 20
#: Record bytes that one task reads back at a time, as whole frames.
READ_BYTES = 64 << 20
MOST_READERS = 100_000
LEVEL = 3

# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; the id and the payload's full length are kept in extension fields."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Target-URI", _one_line(url or "")),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"),
        ("X-Payload-Length", str(len(payload))),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page-ID", str(refers_to))]
    body = b"" if revisit else payload
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(fields, body, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:stop].decode("utf-8", "surrogatepass").split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    body = stop + 4
    end = body + int(fields["Content-Length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    return fields, data[body:end], end + 4


class BundleWriter:
    """Writes frames to a binary stream and the seek table at its end."""

    def __init__(self, stream):
        self.stream, self.sizes, self.offset, self.open, self.filled = stream, [], 0, [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame number, offset inside it) of the record."""
        if self.filled and self.filled + len(data) > FRAME_BYTES:
            self.flush()
        place = len(self.sizes), self.filled
        self.open.append(data)
        self.filled += len(data)
        return place

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.stream.write(frame)
            self.sizes.append((len(frame), self.filled))
            self.offset += len(frame)
            self.open, self.filled = [], 0

    def finish(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class BundleReader:
    """Reads the seek table from the end of a bundle, then any frame on its own."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, descriptor, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        file.seek(size - 9 - count * width)
        table_ = file.read(count * width)
        self.sizes = [struct.unpack_from("<II", table_, i * width) for i in range(count)]
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.decompressor = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        self.file.seek(self.starts[number])
        return self.decompressor.decompress(self.file.read(self.sizes[number][0]), max_output_size=self.sizes[number][1])


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


INDEX = "page_id long, bundle string, frame long, at long, length long"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        stream = writer = None
        rows: list[tuple] = []

        def close() -> pa.RecordBatch:
            writer.finish()
            stream.close()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [f.split()[0] for f in INDEX.split(", ")])

        name = ""
        for batch in batches:
            ids, urls, refers, revisit = (batch.column(i) for i in (0, 1, 3, 4))
            payloads = encoded(x.as_py() for x in batch.column(2))
            for i, payload in enumerate(payloads):
                if writer is None:
                    name, rows = f"bundle-{uuid.uuid4().hex}.warc.zst", []
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer = BundleWriter(stream)
                data = record(ids[i].as_py(), urls[i].as_py(), payload, refers[i].as_py(), revisit[i].as_py())
                rows.append((ids[i].as_py(), name, *writer.add(data), len(data)))
                if writer.offset > BUNDLE_BYTES:
                    yield close()
                    writer = None
        if writer is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write all ``pages`` (page_id, url, html) to bundles in ``folder``; returns the committed index.

    Digests are compared on narrow rows; only payloads that repeat are joined
    back, from a table that is reread so that a hot payload can be split.
    """
    page = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    key = page.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    groups = key.select("page_id", "sha", "size").filter(F.col("size") >= least_revisit).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    repeated = materialize(groups.filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"), "repeated")
    known = key.join(repeated, ["sha", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = known.select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))
    return materialize(rows.mapInArrow(_writer(folder), INDEX), "warc-index")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _rows(bundle: BundleReader, first: int, last: int) -> Iterator[tuple]:
    """The records of the frames from ``first`` to ``last``."""
    for number in range(first, last + 1):
        data, at = bundle.frame(number), 0
        while at < len(data):
            f, body, at = parse_record(data, at)
            revisit = f["WARC-Type"] == "revisit"
            digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
            if not revisit and (payload_digest(body) != digest or len(body) != int(f["X-Payload-Length"])):
                raise ValueError("a payload differs from its digest")
            number_of = lambda x: int(x) if x else None
            yield number_of(f["X-Page-ID"]), f["WARC-Target-URI"], int(f["X-Payload-Length"]), digest, f["WARC-Type"], number_of(f.get("X-Refers-To-Page-ID", "")), None if revisit else body


def _reader(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for name, first, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    rows: list[tuple] = []
                    held = 0
                    for row in _rows(BundleReader(file, file.size()), first, last):
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(row[-1] or b"") if payloads else 1
                        if held > (4 << 20) or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def frame_ranges(index: DataFrame, read_bytes: int = READ_BYTES) -> DataFrame:
    """(bundle, first, last): ranges of whole frames of about ``read_bytes``, dealt evenly over explicit partitions.

    Each bundle gives as many ranges of equally many frames as its records fill, and each core has several where there are enough frames.
    """
    spark = index.sparkSession
    bundles = index.groupBy("bundle").agg((F.max("frame") + 1).alias("frames"), F.sum("length").alias("bytes"))
    total = bundles.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    aim = max(1, min(read_bytes, total // (4 * spark.sparkContext.defaultParallelism)))
    per = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("frames") * F.lit(float(aim)) / F.col("bytes")).cast("long"))
    cut = bundles.withColumn("per", per).select("bundle", "frames", "per", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, F.col("per"))).alias("first"))
    ranges = materialize(cut.select("bundle", "first", F.least(F.col("first") + F.col("per"), F.col("frames")).alias("end")).select("bundle", "first", (F.col("end") - 1).alias("last")), "frames")
    return ranges.repartition(max(1, min(ranges.count(), MOST_READERS)))


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """All records of the bundles that a committed index names; payloads are checked against their digests.

    A task finds its frames by the seek table and decompresses no others.
    """
    return frame_ranges(index).mapInArrow(_reader(folder, payloads), RECORDS)


def fetch(index_rows: list[tuple[str, int, int]], folder: str) -> list[tuple[dict[str, str], bytes]]:
    """Single records by (bundle, frame, offset), each from one decompressed frame."""
    fs, root = _store(folder)
    out = []
    for name, frame, at in index_rows:
        with fs.open_input_file(f"{root}/{name}") as file:
            out.append(parse_record(BundleReader(file, file.size()).frame(frame), at)[:2])
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), g AS (
  SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS b, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS head FROM p
)
SELECT page_id, payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(substr(b, 1 + 5 * i, 1) AS INTEGER) * 16
           + CAST(substr(b, 2 + 5 * i, 1) AS INTEGER) * 8 + CAST(substr(b, 3 + 5 * i, 1) AS INTEGER) * 4
           + CAST(substr(b, 4 + 5 * i, 1) AS INTEGER) * 2 + CAST(substr(b, 5 + 5 * i, 1) AS INTEGER), 1), '' ORDER BY i)
        FROM range(32) AS r(i)) AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = head THEN NULL ELSE head END AS refers_to
FROM g
"""
