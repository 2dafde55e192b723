"""WARC archives compressed with a dictionary of their own.

A table of records is written as .warc.zst files.  Each file begins with a
skippable frame that holds a Zstandard dictionary built from the file's own
records, and each record is a frame of its own, so a reader can start at any
record once it has the dictionary.  Records with equal payloads become one
response and revisits of it.

A task writes a file when the records at hand reach ARCHIVE_BYTES, so it holds
one file and one record.  Files are written under a name of their own attempt;
only those named by the written manifest count, so lost tasks leave no trace in
the result.  Every file system that pyarrow opens from a URI works for
writing; reading goes through Spark.

Defined results: a null html is an empty payload; payloads below the given
size are always responses; of rows with the smallest id of a payload one is
the response and repeated rows revisit it; null ids come after all others and
have an empty id field; null urls are written as about:blank; an empty table
makes no archive and gives no rows; columns beyond id, url and html are not
read.  Too few or too small records for training are a raw dictionary.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ARCHIVE_BYTES = 16_000_000
DICTIONARY_BYTES = 65_536
SAMPLE_BYTES = 4_000_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format: magic number of the dictionary's skippable frame, and of a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decide(pages: DataFrame, least_bytes: int = 0, id_column: str = "page_id") -> DataFrame:
    """Pages with id, url, payload, digest, refers_to; refers_to is set for revisits.

    Only ids and digests are grouped; pages move once, by their own id.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    key = F.coalesce(F.col("id"), F.lit(2**63 - 1))
    narrow = rows.select(key.alias("key"), "digest", F.length("payload").alias("n"))
    first = narrow.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"))
    known = narrow.select("key", "digest").distinct().join(first, "digest", "left")
    met = rows.withColumn("key", key).join(known, ["key", "digest"])
    again = F.row_number().over(Window.partitionBy("key", "digest").orderBy("url")) > 1
    revisit = F.col("first").isNotNull() & ((F.col("first") != F.col("key")) | again)
    return met.select("id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit holds the HTTP head alone."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"\s", "%20", url) if url else "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{_base32(digest)}"),
        ("Page-ID", "" if page_id is None else page_id),
    ]
    if revisit:
        fields += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"),
            ("Refers-To-Page-ID", refers_to),
        ]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]):
    """Dictionary trained on records evenly spaced over the archive."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    samples = [r[:131_072] for r in records[::step]]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(256, sum(map(len, samples)) // 8)), samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\0")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def make_archive(records: list[bytes]) -> bytes:
    import zstandard

    words = build_dictionary(records)
    body = words.as_bytes()
    out = io.BytesIO()
    out.write(DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
    press = zstandard.ZstdCompressor(level=3, dict_data=words, write_checksum=True)
    for record in records:
        out.write(press.compress(record))
    return out.getvalue()


def read_archive(content: bytes) -> Iterator[bytes]:
    """Records of an archive, one frame each."""
    import zstandard

    if int.from_bytes(content[:4], "little") != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with a dictionary frame")
    size = int.from_bytes(content[4:8], "little")
    body, view = content[8 : 8 + size], memoryview(content)[8 + size :]
    kind = zstandard.DICT_TYPE_FULLDICT if body[:4] == DICTIONARY_MAGIC else zstandard.DICT_TYPE_RAWCONTENT
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body, dict_type=kind))
    while len(view):
        one = unpress.decompressobj()
        yield one.decompress(view)
        view = view[len(view) - len(one.unused_data) :]


def parse_record(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record fields, HTTP fields and payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(decided: DataFrame, folder: str) -> DataFrame:
    """Writes .warc.zst files below a shared folder; returns their manifest."""
    spark = decided.sparkSession
    target = folder if "://" in folder else f"file://{folder}"

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", target))
        store.create_dir(path, recursive=True)

        def close(records):
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            content = make_archive(records)
            with store.open_output_stream(name, compression=None) as f:
                f.write(content)
            return pa.RecordBatch.from_pydict(
                {"name": [name.rpartition("/")[2]], "n_records": [len(records)], "n_bytes": [len(content)]}
            )

        held, size = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                record = make_record(row["id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield close(held)
                    held, size = [], 0
        if held:
            yield close(held)

    decided.mapInArrow(write, "name string, n_records long, n_bytes long").write.parquet(f"{folder}-manifest")
    return spark.read.parquet(f"{folder}-manifest")


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record of the archives that the manifest names.

    payload is null for revisits; payload_bytes and payload_digest are of the
    full payload, computed anew for responses.
    """
    if manifest.isEmpty():
        content = spark.createDataFrame([], "path string, content binary")
    else:
        content = spark.read.format("binaryFile").load(f"{folder}/*.warc.zst").select("path", "content")
    named = manifest.select("name")
    listed = content.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(named, "name", "left_semi")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                for record in read_archive(content.as_py()):
                    fields, http, payload = parse_record(record)
                    response = fields["WARC-Type"] == "response"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if response and digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                        raise ValueError(f"damaged record of page {fields['Page-ID']}")
                    rows.append(
                        {
                            "page_id": int(fields["Page-ID"]) if fields["Page-ID"] else None,
                            "url": fields["WARC-Target-URI"],
                            "payload_bytes": len(payload) if response else int(http["Content-Length"]),
                            "payload_digest": digest,
                            "record_type": fields["WARC-Type"],
                            "refers_to": int(fields["Refers-To-Page-ID"]) if not response else None,
                            "payload": payload if response else None,
                        }
                    )
                    size += len(payload)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    import pyarrow as pa

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )
    columns = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "payload binary"
    )
    return listed.select("content").mapInArrow(read, columns)
