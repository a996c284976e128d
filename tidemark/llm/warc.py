"""Web archives in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle is a run of frames closed by a seek table in a skippable
frame, as in the public seekable format. The index maps a record's id to its bundle, frame, and place within the frame, so one record
is read by decompressing one frame. Equal payloads of at least ``SHARED_BYTES`` are stored once: the record with the smallest id is the
response and the others are revisit records that name it.

Bundles go to a folder of the session's shared storage, each under a name that carries the task's attempt, so attempts never meet. The
index, committed by Spark, lists the bundles of the attempts that count; readers follow it, and what other attempts left is never read.

Defined results: null html is an empty payload, null urls are empty; rows with the smallest id of a payload are all responses if
that id is repeated; a null page_id is never the smallest unless all are null (then these are responses); an empty table gives no
bundles. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shipping import ship
from tidemark.session import scratch_path

# Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 1 << 24
SHARED_BYTES = 100
LEVEL = 3
INDEX = "page_id long, record_id string, bundle string, frame int, offset int, length int"


def record(kind: str, record_id: str, url: str, digest: str, size: int, payload: bytes, page_id: int | None, refers_to: int | None, named: str | None) -> bytes:
    """One WARC/1.1 record. A revisit has no payload, and keeps the full payload's digest and length."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {url}"]
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{named}>", f"X-Refers-To-Page: {refers_to}"]
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame for (compressed, plain) sizes."""
    entries = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(entries)) + entries


def frames(tail: bytes) -> list[tuple[int, int]]:
    """(offset, compressed size) of each frame, from a bundle's last bytes."""
    count, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    table = tail[-9 - 8 * count : -9]
    at, found = 0, []
    for size, _ in struct.iter_unpack("<II", table):
        found.append((at, size))
        at += size
    return found


def url_text(column):
    """A URL that keeps a record's header on one line."""
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"[\r\n]+", " ")


def written(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write the archives of a table and return their index."""
    ship(pages.sparkSession)
    rows = pages.select(
        pages[page_id].cast("long").alias("page_id"), url_text(pages[url]).alias("url"), F.coalesce(pages[html], F.lit("")).alias("html")
    ).withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    lean = rows.where(f"size >= {SHARED_BYTES}").select("page_id", "digest")
    shared = lean.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    placed = rows.join(shared, "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    placed = placed.select("page_id", "url", "digest", "size", F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("html")).alias("html"))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import zstandard
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        number, done, sizes, open_frame, index = 0, [], [], [], []

        def close_frame() -> None:
            plain = b"".join(open_frame)
            done.append(press.compress(plain))
            sizes.append((len(done[-1]), len(plain)))
            open_frame.clear()

        def close_bundle() -> pa.RecordBatch:
            name = f"part-{task:05d}-{number:05d}-{attempt}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:  # the name would ask for it
                out.write(b"".join(done) + seek_table(sizes))
            columns = list(zip(*index))
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays.insert(2, pa.array([name] * len(index), pa.string()))
            for x in (done, sizes, index):
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in INDEX.split(", ")])

        held = 0
        for batch in batches:
            ids, urls, digests, full, named, texts = batch.columns
            for i in range(len(batch)):
                refers, text, who = named[i].as_py(), texts[i].as_py(), ids[i].as_py()
                digest = digests[i].as_py()
                record_id = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{who}/{digest}"))
                other = None if refers is None else str(uuid.uuid5(uuid.NAMESPACE_URL, f"{refers}/{digest}"))
                data = record("response" if refers is None else "revisit", record_id, urls[i].as_py(), digest, full[i].as_py(), (text or "").encode(), who, refers, other)
                index.append((who, record_id, len(sizes), held, len(data)))
                open_frame.append(data)
                held += len(data)
                if held >= FRAME_BYTES:
                    close_frame()
                    held = 0
                    if sum(s for s, _ in sizes) >= BUNDLE_BYTES:
                        yield close_bundle()
                        number += 1
        if open_frame:
            close_frame()
        if index:
            yield close_bundle()

    spark = pages.sparkSession
    placed.mapInArrow(bundle, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the bundles that a folder's index lists: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed from the payload that was read; a revisit's are those it keeps.
    """
    ship(spark)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import zstandard

        unpress = zstandard.ZstdDecompressor()
        store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None) as held:
                    packed = held.read()
                for at, size in frames(packed):
                    found, plain, here = [], unpress.decompress(packed[at : at + size]), 0
                    while here < len(plain):
                        body = plain.index(b"\r\n\r\n", here) + 4
                        length = int(plain[plain.rindex(b"Content-Length: ", here, body) + 16 : body - 4])
                        fields, payload = parsed(plain[here : body + length])
                        here = body + length + 4
                        first = fields["warc-type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if first else fields["warc-payload-digest"].partition(":")[2]
                        if first and fields["warc-payload-digest"] != f"sha256:{digest}":
                            raise ValueError(f"damaged record {fields['warc-record-id']}")
                        page, refers = fields.get("x-page-id"), fields.get("x-refers-to-page")
                        found.append((page and int(page), fields["warc-target-uri"], payload, len(payload) if first else int(fields["x-payload-length"]), digest, fields["warc-type"], refers and int(refers)))
                    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], [c.split()[0] for c in schema.split(", ")])

    bundles = spark.read.schema(INDEX).parquet(f"{folder}/index").select("bundle").distinct()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return bundles.repartition(tasks, "bundle").mapInArrow(records, schema)  # a number given: names are short, what they name is not


def fetch(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry, reading its bundle's seek table and one frame."""
    import pyarrow.fs as fs
    import zstandard

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    with store.open_input_file(f"{root}/{bundle}") as held:
        total = held.size()
        count = struct.unpack("<IBI", held.read_at(9, total - 9))[0]
        at, size = frames(held.read_at(9 + 8 * count, total - 9 - 8 * count))[frame]
        plain = zstandard.ZstdDecompressor().decompress(held.read_at(size, at))
    return parsed(plain[offset : offset + length])


def query(spark: SparkSession, folder: str) -> DataFrame:
    archives = scratch_path(spark, "warc")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if written(pages, archives).isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, archives).select(columns)


ORACLE = f"""
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n < {SHARED_BYTES} OR page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN n >= {SHARED_BYTES} AND page_id <> least THEN least END AS refers_to
FROM (SELECT page_id, digest, n, min(page_id) OVER (PARTITION BY digest) AS least
  FROM (SELECT page_id, sha256(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages))
"""
