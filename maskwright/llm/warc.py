"""WARC archives in seekable Zstandard bundles.

Every row becomes a WARC record. Records are grouped into independent Zstandard
frames; a bundle ends with a skippable frame that holds a seek table (compressed
and plain size of each frame), and an index maps a record's id to its bundle,
frame and offset within the frame's plain bytes. A bundle is written under a
name of its task attempt and moved into place whole, so a lost task leaves no half
bundle that counts: the index names the bundles that do.

Of records with equal payloads of at least ``LEAST`` bytes the one with the
smallest id is a response; the others are revisits without payload that name it. The
reader takes frames from a bundle's own seek table; the index says which frame, and
where in it.

Defined cases: a null payload or URL is empty; payloads under ``LEAST`` bytes are
always responses; rows of one id are records of their own: of equal payloads under
the smallest id all are responses, and rows that repeat id and payload share a record
id; rows without an id are revisits of the smallest id, or responses if all copies lack
one; URLs are percent-encoded as UTF-8 where they hold other than visible ASCII, and then
kept as they were in a field of their own; very long payloads get a frame
of their own; an empty table writes no bundle; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm._store import new_path, prepare, stage

LEAST = 100
#: Plain bytes after which a frame, and compressed bytes after which a bundle, is closed.
FRAME = 1 << 20
BUNDLE = 64 << 20
SALTS = 16
#: Digests of payloads with copies up to which they are broadcast (some 150 bytes each); beyond, both sides are shuffled.
BROADCAST_COPIES = 500_000
_SKIP, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_INDEX = "record_id string, bundle string, frame int, record_at long, record_size long"
_IDS = uuid.UUID("6b1f2d34-8d50-4c58-9f55-0d5f0c1f7a11")
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


def record_id(page_id: int | None, digest: str) -> str:
    """The same for every run and every task, so that a revisit can name the record that it refers to."""
    return str(uuid.uuid4() if page_id is None else uuid.uuid5(_IDS, f"{page_id}:{digest}"))


def _uri(url: str) -> str:
    return "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record_bytes(rid: str, page_id: int | None, url: str, kind: str, refers: int | None, digest: str, size: int, payload: bytes) -> bytes:
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_uri(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}",
    ]
    if _uri(url) != url:
        head.append(f"X-Target-URL-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{record_id(refers, digest)}>",
            "WARC-Refers-To-Date: 1970-01-01T00:00:00Z", f"X-Refers-To-Page-ID: {refers}",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + payload + b"\r\n\r\n"


def target_url(fields: dict[str, str]) -> str:
    """The URL of a parsed record, as it was."""
    kept = fields.get("X-Target-URL-Base64")
    return base64.b64decode(kept).decode("utf-8", "surrogatepass") if kept else fields["WARC-Target-URI"]


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable footer frame: compressed and plain size of every frame."""
    body = b"".join(struct.pack("<II", a, b) for a, b in frames) + struct.pack("<IBI", len(frames), 0, _SEEKABLE)
    return struct.pack("<II", _SKIP, len(body)) + body


def read_seek_table(footer: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes of the frames of a bundle, from its last bytes or the whole of it."""
    count, _, magic = struct.unpack("<IBI", footer[-9:])
    if magic != _SEEKABLE:
        raise ValueError("no seek table")
    at = len(footer) - 9 - 8 * count
    return [struct.unpack_from("<II", footer, at + 8 * i) for i in range(count)]


class _Frames:
    """A bundle that is read by its seek table: one frame at a time."""

    def __init__(self, path: str) -> None:
        files, name = _place(path)
        self.path, self.file, self.now = path, files.open_input_file(name), (-1, b"")
        size = self.file.size()
        count = struct.unpack("<I", self.file.read_at(9, size - 9)[:4])[0]
        self.sizes = read_seek_table(self.file.read_at(9 + 8 * count, size - 9 - 8 * count))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.tool = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        if self.now[0] != number:
            packed, plain = self.sizes[number]
            data = self.tool.decompress(self.file.read_at(packed, self.starts[number]))
            if len(data) != plain:
                raise ValueError("a frame differs from the seek table")
            self.now = (number, data)
        return self.now[1]


class _Bundle:
    """One bundle being written."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.files, self.name = _place(path)
        self.temp = f"{self.name}.{uuid.uuid4().hex}.tmp"
        self.out = self.files.open_output_stream(self.temp)
        self.tool = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.at, self.plain, self.waiting, self.index = 0, bytearray(), [], []

    def add(self, record_id: str, data: bytes) -> None:
        if self.plain and len(self.plain) + len(data) > FRAME:
            self.close_frame()
        self.waiting.append((record_id, len(self.plain), len(data)))
        self.plain += data

    def close_frame(self) -> None:
        if self.plain:
            packed = self.tool.compress(bytes(self.plain))
            self.out.write(packed)
            self.index += [(r, self.path, len(self.frames), a, n) for r, a, n in self.waiting]
            self.frames.append((len(packed), len(self.plain)))
            self.at += len(packed)
            self.plain, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.close_frame()
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.files.move(self.temp, self.name)
        return self.index


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _INDEX.split(", ")])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for page, url, html, digest, kind, refers in zip(*batch.columns):
                payload = html.as_py() or b""
                bundle = bundle or _Bundle(f"{folder}/{uuid.uuid4().hex}.warc.zst")
                page, kind, digest = page.as_py(), kind.as_py(), digest.as_py()
                rid = record_id(page, digest)
                bundle.add(rid, record_bytes(rid, page, url.as_py() or "", kind, refers.as_py(), digest, len(payload), payload if kind == "response" else b""))
                if bundle.at >= BUNDLE:
                    yield _index_batch(bundle.close())
                    bundle = None
        if bundle:
            yield _index_batch(bundle.close())

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bundle = None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if bundle is None or bundle.path != row["bundle"]:
                bundle = _Frames(row["bundle"])
            fields, payload = parse_record(bundle.frame(row["frame"])[row["record_at"]: row["record_at"] + row["record_size"]])
            if fields["WARC-Record-ID"] != f"<urn:uuid:{row['record_id']}>":
                raise ValueError("the index does not lead to its record")
            page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
            if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                raise ValueError("a payload differs from its digest")
            out.append((page and int(page), size, digest, kind, refers and int(refers)))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in _READ.split(", ")])


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html (binary), digest, kind, refers_to of each row of pages (page_id, url, html)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # Only ids and digests are grouped; payloads stay where they are.
    firsts = pages.select(F.col("page_id").cast("long").alias("p"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).filter(F.octet_length("html") >= LEAST)
    firsts = stage(firsts.select("p", F.sha2("html", 256).alias("d")).groupBy("d").agg(F.min("p").alias("first"), F.count("*").alias("n")).filter("n > 1").select("d", "first"), "firsts")
    if firsts.count() <= BROADCAST_COPIES:
        rows = rows.join(F.broadcast(firsts), F.col("digest") == F.col("d"), "left")
    else:  # a payload of very many copies is met in SALTS parts
        firsts = firsts.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        rows = rows.join(firsts, (F.col("digest") == F.col("d")) & (F.col("salt") == F.col("t")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "html", "digest", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the bundles and return the index, as a table that is written too."""
    prepare(pages.sparkSession)
    files, name = _place(folder)
    files.create_dir(name, recursive=True)
    return stage(marked(pages).mapInArrow(_writer(folder), _INDEX), "index")


def read_archives(index: DataFrame) -> DataFrame:
    """The records that the index names, checked against their digests."""
    prepare(index.sparkSession)
    return index.sortWithinPartitions("bundle", "frame", "record_at").mapInArrow(_reader, _READ)


def query_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))


WARC_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {LEAST} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= {LEAST}
"""
