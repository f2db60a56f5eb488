"""WARC archives in Zstandard frames, written and read by Spark tasks.

An archive begins with a skippable frame that holds the dictionary of all its frames;
each record is one frame of its own.  The writer makes one archive per partition and the
dictionary from the first payloads of it.  The reader takes archive files as binary rows,
loads the dictionary, decodes frame by frame, and validates each record: version line,
needed headers, content length and payload digest.  A frame that fails is reported as a
row with its error; the frames after it are still read.

Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest id
is the response, the others are revisits without a body that refer to it.

Defined results: a null or empty payload is a response with an empty body; a null id or
URL is written without that header; repeated rows are records of their own, and of
equal payloads every row with the least id is a response; an empty table gives no archives
and reads as no records.

Spark has no writer for binary files, so the archives are rows of a binary column; the
reader takes those as well as files by way of ``spark.read.format("binaryFile")``.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from veilmark.llm.common import new_folder, small_side, written

#: Payloads from this length on are written once.
REVISIT_BYTES = 100
#: Bytes of payload in one archive, about; archives are also the reader's unit of work.
ARCHIVE_BYTES = 16 << 20
#: Bytes of sample payloads and of the dictionary trained on them.
SAMPLE_BYTES = 1 << 19
DICTIONARY_BYTES = 32 << 10
#: Declared sizes up to this are allocated at once; beyond it memory grows with the content.
TRUSTED_BYTES = 64 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records carry the same date, so that writing again gives the same bytes.
DATE = "2020-01-01T00:00:00Z"


class Malformed(ValueError):
    """A frame or record that is not what the format asks for."""


# ---- records ---------------------------------------------------------------
def record(page_id, url, payload, digest, refers_to):
    """The bytes of one record."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)]
        headers.append(("X-Payload-Length", str(len(payload))))
    body = payload if refers_to is None else b""
    headers += [("Content-Type", "text/html"), ("Content-Length", str(len(body)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return b"".join((VERSION, b"\r\n", lines, b"\r\n", body, b"\r\n\r\n"))


def parse(data):
    """Headers and body of a record's bytes, or Malformed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise Malformed("no end of headers")
    lines = head.split(b"\r\n")
    if lines[0] != VERSION:
        raise Malformed("version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Malformed("header without colon")
        headers[name.strip().decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise Malformed(f"no {name}")
    if not headers["content-length"].isdigit():
        raise Malformed("content-length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise Malformed("length of the body")
    return headers, rest[:size]


def _page(value):
    if not value.startswith("<urn:page:") or value[-1] != ">":
        raise Malformed("record id")
    return int(value[10:-1]) if value[10:-1] else None


def checked(headers, body):
    """page_id, url, payload, payload_bytes, digest, type and refers_to of a record."""
    kind = headers["warc-type"]
    digest = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    page, target = _page(headers["warc-record-id"]), None
    if kind == "response":
        if hashlib.sha256(body).hexdigest() != digest:
            raise Malformed("payload digest")
        size = len(body)
    elif kind == "revisit":
        if body or "warc-refers-to" not in headers or not headers.get("x-payload-length", "").isdigit():
            raise Malformed("revisit")
        target, size = _page(headers["warc-refers-to"]), int(headers["x-payload-length"])
    else:
        raise Malformed("type")
    return page, headers.get("warc-target-uri"), body, size, digest, kind, target


# ---- frames ----------------------------------------------------------------
def dictionary(samples):
    """A dictionary of the samples, or their own bytes where too few to train."""
    total = sum(map(len, samples))
    if total > 4 * DICTIONARY_BYTES and len(samples) > 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


def archive(records, primer, level=3):
    """The bytes of an archive: the dictionary in a skippable frame, a frame per record."""
    out = [struct.pack("<II", DICTIONARY_MAGIC, len(primer)), primer]
    shared = zstandard.ZstdCompressionDict(primer) if primer else None
    packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
    out.extend(map(packer.compress, records))
    return b"".join(out)


def frame_end(data, start):
    """Where the frame that begins at ``start`` ends, from its headers alone."""
    if data[start : start + 4] != FRAME_MAGIC:
        raise Malformed("frame magic")
    if len(data) < start + 5:
        raise Malformed("cut frame")
    flags = data[start + 4]
    single = flags >> 5 & 1
    content = (1 if single else 0, 2, 4, 8)[flags >> 6]
    at = start + 5 + (0 if single else 1) + (0, 1, 2, 4)[flags & 3] + content
    while True:
        if len(data) < at + 3:
            raise Malformed("cut frame")
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 if flags >> 2 & 1 else 0
    if at > len(data):
        raise Malformed("cut frame")
    return at


def read_archive(data):
    """(offset, fields or None, error or None) of every record of an archive."""
    at, shared = 0, None
    if len(data) >= 8:
        magic, size = struct.unpack_from("<II", data)
        if magic == DICTIONARY_MAGIC:
            if len(data) < 8 + size:
                yield 0, None, "cut dictionary"
                return
            primer = bytes(data[8 : 8 + size])
            if primer[:4] == FRAME_MAGIC:  # the dictionary may be compressed itself
                try:
                    primer = zstandard.ZstdDecompressor().decompressobj().decompress(primer)
                except zstandard.ZstdError as error:
                    yield 0, None, str(error)
                    return
            shared = zstandard.ZstdCompressionDict(primer) if primer else None
            at = 8 + size
    try:
        unpacker = zstandard.ZstdDecompressor(dict_data=shared)
    except zstandard.ZstdError as error:
        yield 0, None, f"dictionary: {error}"
        return
    while at < len(data):
        start = at
        try:
            at = frame_end(data, start)
        except Malformed as error:
            # The next frame can only be found by its magic.
            yield start, None, str(error)
            at = data.find(FRAME_MAGIC, start + 1)
            if at < 0:
                return
            continue
        try:
            frame = data[start:at]
            size = zstandard.frame_content_size(frame)
            # A declared size is only trusted, and its memory taken at once, if it is small.
            trusted = 0 <= size <= TRUSTED_BYTES
            plain = unpacker.decompress(frame) if trusted else unpacker.decompressobj().decompress(frame)
            if size >= 0 and len(plain) != size:
                raise Malformed("content size")
            yield start, checked(*parse(plain)), None
        except (Malformed, zstandard.ZstdError, UnicodeDecodeError, ValueError, MemoryError) as error:
            yield start, None, str(error) or type(error).__name__


# ---- tables ----------------------------------------------------------------
def with_revisits(pages, id_col, url_col, payload_col):
    """``page_id, url, payload, digest, refers_to``: the least id of each payload is kept
    in full.  Only digests are grouped; payloads are not shuffled by them."""
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"),
    )
    return rows.withColumn("digest", F.sha2("payload", 256))


def first_of_payloads(rows):
    """``digest, first``: the smallest id of each payload that occurs more than once."""
    long = rows.where(F.octet_length("payload") >= REVISIT_BYTES)
    found = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    return found.where("copies > 1").select("digest", "first")


def write_archives(pages, folder, id_col="page_id", url_col="url", payload_col="html", archive_bytes=ARCHIVE_BYTES):
    """Write archives to ``folder`` as rows ``name, content`` of a binary table."""
    rows = with_revisits(pages, id_col, url_col, payload_col)
    firsts = small_side(written(first_of_payloads(rows), "payloads"))
    whole = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"),
    )

    def run(batches):
        held, size, number = [], 0, 0
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in whole.slice(start, 256).columns)):
                    held.append(row)
                    size += len(row[2])
                    if size >= archive_bytes:
                        yield _pack(held)
                        held, size = [], 0
        if held:
            yield _pack(held)

    whole.mapInArrow(run, "records BIGINT, content BINARY").write.parquet(folder)
    return folder


def _pack(rows):
    samples, total = [], 0
    for row in rows:
        if total >= SAMPLE_BYTES:
            break
        if row[4] is None and row[2]:
            samples.append(row[2][: SAMPLE_BYTES // 8])
            total += len(samples[-1])
    records = [record(page, url, payload, digest, target) for page, url, payload, digest, target in rows]
    data = archive(records, dictionary(samples))
    return pa.RecordBatch.from_arrays(
        [pa.array([len(rows)], pa.int64()), pa.array([data], pa.binary())], names=["records", "content"]
    )


RECORDS = (
    "offset BIGINT, page_id BIGINT, url STRING, payload BINARY, payload_bytes BIGINT, payload_digest STRING, "
    "record_type STRING, refers_to BIGINT, error STRING"
)
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]


def read_archives(archives, content_col="content", count_col=None):
    """A row per record of a table of archives, such as ``spark.read.format("binaryFile")``
    gives for files: its fields, or its error.  ``count_col`` names the number of records that an
    archive should have; another number is an error at its end."""
    wanted = F.lit(None).cast("long") if count_col is None else F.col(count_col).cast("long")

    def run(batches):
        names = [part.split()[0] for part in RECORDS.split(", ")]
        for batch in batches:
            for data, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, seen = [], 0, 0
                for offset, fields, error in read_archive(data or b""):
                    seen += error is None
                    held.append((offset, *(fields or (None,) * 7), error))
                    size += len(fields[2]) if fields else 0
                    if size > 8 << 20 or len(held) >= 2000:
                        yield _rows(held, names)
                        held, size = [], 0
                if count is not None and seen != count:
                    held.append((len(data or b""), *(None,) * 7, f"{seen} of {count} records"))
                if held:
                    yield _rows(held, names)

    return archives.select(F.col(content_col).alias("content"), wanted.alias("wanted")).mapInArrow(run, RECORDS)


def _rows(held, names):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), _KINDS)], names=names)


def round_trip(pages, **columns):
    """Write the pages as archives to the shared folder and read them back."""
    spark = pages.sparkSession
    folder = write_archives(pages, new_folder(spark, "warc"), **columns)
    archives = spark.read.schema("records BIGINT, content BINARY").parquet(folder)
    return read_archives(archives, count_col="records")
