"""WARC records in ZIP packages: archive and index as stored members, records read by range."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .scratch import Scratch
from .zip_archive import ZipReader, ZipWriter

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Equal payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
#: A package is closed beyond so many bytes; records are fetched in ranges of about so many.
PACKAGE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
DATE = "2020-01-01T00:00:00Z"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


def _record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}')}>"


def _line(text: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, gzipped by itself; a revisit holds no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    head += [] if url is None else [f"WARC-Target-URI: {_line(url)}"]
    head += [] if page_id is None else [f"X-Page-ID: {page_id}"]
    if revisit:
        head += [
            f"WARC-Refers-To: {_record_id(refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if revisit else payload)
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the payload, of one gzipped record."""
    data = gzip.decompress(raw)
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _open(uri: str, write: bool = False):
    """A stream at a URI of any store that pyarrow knows, and its size if it is read."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path), 0
    return store.open_input_file(path), store.get_file_info(path).size


def write_archives(df: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record for every row of df into packages under folder (a URI that executors share).

    Returns the manifest rows (path, records, bytes); packages are written when it is computed, one
    or more for each partition, each under a name of its own: those of failed or repeated tasks are
    not in the manifest. Payloads are the html in UTF-8, null as empty. Of rows with equal payloads
    of at least REVISIT_BYTES, those with the largest key are responses (one, unless rows repeat
    that key) and the others revisits of it; null keys revisit any other, and where all keys are
    null all are responses. Empty tables give no package. Other columns are ignored.
    """
    raw = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload"))
    # only payloads that occur again: the pages themselves need no exchange while these are few
    again = (
        rows.where(F.col("n") >= REVISIT_BYTES)
        .groupBy("digest", "n")
        .agg(F.max("key").alias("first"), F.count("*").alias("rows"))
        .where("rows > 1")
        .drop("rows")
    )
    placed = rows.join(again, ["digest", "n"], "left").withColumn(
        "refers_to", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    )

    def write(batches):
        out = writer = None
        manifest: list[tuple[str, int, int]] = []
        pending = (r for b in batches for r in zip(*(b.column(k) for k in range(5))))
        more = next(pending, None)
        while more is not None:
            path = f"{folder}/{uuid.uuid4().hex}.zip"
            out, _ = _open(path, write=True)
            writer, index, at = ZipWriter(out), [], 0

            def records():
                nonlocal more, at
                while more is not None and at < PACKAGE_BYTES:
                    k, u, p, d, r = (x.as_py() for x in more)
                    data = build_record(k, u, p, d, r)
                    index.append(f"{at} {len(data)}\n")
                    at += len(data)
                    yield data
                    more = next(pending, None)

            writer.add(ARCHIVE, records())
            writer.add(INDEX, ["".join(index).encode()])
            writer.close()
            out.close()
            manifest.append((path, len(index), at))
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*manifest)], names=["path", "records", "bytes"])

    return placed.select("key", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, records long, bytes long")


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """A row for every record of the packages in manifest(path).

    (page_id, record_type, target_uri, record_id, payload_bytes, payload_digest, refers_to[, payload]):
    bytes and digest are those of the full payload, for a revisit as its header says; a response's
    are computed from its payload and must equal its header. Nothing is extracted: a package's
    directory and index are read, then ranges of RANGE_BYTES of its archive, dealt out evenly.
    """

    def plan(batches):
        for batch in batches:
            out = []
            for path in batch.column(0).to_pylist():
                file, size = _open(path)
                package = ZipReader(file, size)
                start, _ = package.span(ARCHIVE)
                lengths, begin, total = [], 0, 0
                for line in package.read(INDEX).split(b"\n")[:-1]:
                    lengths.append(int(line.split()[1]))
                    total += lengths[-1]
                    if total >= RANGE_BYTES:
                        out.append((path, start + begin, lengths))
                        begin, total, lengths = begin + total, 0, []
                if lengths:
                    out.append((path, start + begin, lengths))
                file.close()
            if out:
                a, b, c = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.list_(pa.int64()))], names=["path", "start", "lengths"]
                )

    names = ["page_id", "record_type", "target_uri", "record_id", "payload_bytes", "payload_digest", "refers_to"]
    kinds = [T.LongType(), *[T.StringType()] * 3, T.LongType(), T.StringType(), T.LongType()]
    fields = [T.StructField(n, k) for n, k in zip(names, kinds)] + [T.StructField("payload", T.BinaryType())] * payload
    schema = T.StructType(fields)
    arrow = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def fetch(batches):
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(k).to_pylist() for k in range(3))):
                file, _ = _open(path)
                file.seek(start)
                data, at, out = memoryview(file.read(sum(lengths))), 0, []
                file.close()
                for n in lengths:
                    head, body = parse_record(data[at : at + n])
                    at += n
                    size = int(head["x-payload-length"])
                    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                    if head["warc-type"] == "response" and (len(body), hashlib.sha1(body).hexdigest()) != (size, digest):
                        raise ValueError(f"payload of {head['warc-record-id']} in {path} is not what its header says")
                    whole = lambda name: int(head[name]) if name in head else None
                    out.append(
                        (whole("x-page-id"), head["warc-type"], head.get("warc-target-uri"), head["warc-record-id"],
                         size, digest, whole("x-refers-to-page-id"), body)[: len(fields)]
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), arrow)], names=schema.names)

    ranges = manifest.select("path").mapInArrow(plan, "path string, start long, lengths array<bigint>")
    return ranges.repartition(ranges.sparkSession.sparkContext.defaultParallelism * 4).mapInArrow(fetch, schema)


def round_trip(spark: SparkSession, df: DataFrame, **columns) -> DataFrame:
    """df written to the shared folder and read back, without the payloads."""
    scratch = Scratch(spark, "warc")
    manifest = scratch.save(write_archives(df, scratch.path("packages"), **columns), "manifest")
    return read_archives(manifest, payload=False)
