"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame per record.

Archives are rows (path, content), the shape of Spark's binaryFile source, so that the reader takes
.warc.zst files and written tables alike; save_archives writes the rows as files into a folder that all executors share.
The reader takes records of all types; those that aren't HTTP messages have their block as payload.
The writer puts each distinct payload into one response record; records with the
same payload and a larger page_id become revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.store import Scratch

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
ARCHIVE_BYTES = 4 << 20
DICTIONARY_BYTES = 16 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit, whose block keeps only the HTTP header."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A .warc.zst file."""
    samples = [r[:4096] for r in records[:: max(1, len(records) // 200)]]
    try:
        dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples to train on: the first record's bytes serve as they are
        dictionary = zstandard.ZstdCompressionDict(samples[0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = dictionary.as_bytes()
    compressor = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(packed)), packed, *map(compressor.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its block headers."""
    head = bytes(data[at : at + 18])
    if head[:4] != FRAME:
        raise ValueError("no Zstandard frame")
    place = at + zstandard.frame_header_size(head)
    while True:
        if place + 3 > len(data):
            raise ValueError("a frame is cut off")
        block = int.from_bytes(data[place : place + 3], "little")
        kind, size = block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("a reserved block type")
        place += 3 + (1 if kind == 1 else size)
        if block & 1:
            break
    place += 4 * zstandard.get_frame_parameters(head).has_checksum
    if place > len(data):
        raise ValueError("a frame is cut off")
    return place


def frames(content: bytes) -> Iterator[bytes]:
    """The decompressed frames of an archive, one per record."""
    data = memoryview(content)
    at, decompressor = 0, zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("a frame is cut off")
        magic, size = struct.unpack("<II", data[at : at + 8])
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(data):
                raise ValueError("a skippable frame is cut off")
            if at == 0 and magic == SKIPPABLE:
                packed = bytes(data[8 : 8 + size])
                if packed[:4] == FRAME:  # the dictionary may be compressed itself
                    packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(packed))
            at += 8 + size
            continue
        end = frame_end(data, at)
        if zstandard.get_frame_parameters(bytes(data[at : at + 18])).content_size == zstandard.CONTENTSIZE_UNKNOWN:
            yield decompressor.stream_reader(io.BytesIO(data[at:end])).read()
        else:
            yield decompressor.decompress(data[at:end])
        at = end


def _header(block: bytes, first: bytes) -> tuple[dict[str, str], int]:
    end = block.find(b"\r\n\r\n")
    lines = block[: max(end, 0)].split(b"\r\n")
    if end < 0 or not lines[0].startswith(first):
        raise ValueError(f"no {first.decode()} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("a header line without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    return fields, end + 4


PAGE = "<urn:page:"


def parse(raw: bytes) -> tuple:
    """A record's fields in the order of RECORDS, without path and problem; ValueError if it isn't valid.

    Its header has the four mandatory fields, the block has the length that it gives, and sha1 digests of block and payload
    hold where they are given (of a revisit the payload digest is that of the record that it refers to).  The payload of a block with an HTTP header is what follows
    the header, of other records the block itself; a revisit's is null.
    """
    fields, at = _header(raw, b"WARC/1.")
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys()
    if missing:
        raise ValueError(f"no {sorted(missing)[0]}")
    length = int(fields["content-length"])
    if length < 0 or len(raw) != at + length + 4 or raw[-4:] != b"\r\n\r\n":
        raise ValueError("content-length differs from the block")
    kind, block = fields["warc-type"].lower(), raw[at : at + length]
    sha1 = lambda data: base64.b32encode(hashlib.sha1(data).digest()).decode()
    given = {name: value.removeprefix("sha1:").upper() for name in ("warc-block-digest", "warc-payload-digest") if (value := fields.get(name, "")).startswith("sha1:")}
    if given.get("warc-block-digest", sha1(block)) != sha1(block):
        raise ValueError("the digest differs from the block")
    payload, size = block, length
    if block.startswith(b"HTTP/") and kind in ("response", "revisit") or "application/http" in fields.get("content-type", "") and kind == "request":
        head = block.partition(b"\r\n\r\n")[0].split(b"\r\n")
        payload = block[len(b"\r\n".join(head)) + 4 :]
        http = {name.strip().lower(): value.strip() for name, _, value in (line.partition(b":") for line in head[1:])}
        stated = http.get(b"content-length", b"")
        size = int(stated) if stated.isdigit() else len(payload)
        # A chunked or compressed body may differ from the length that its server stated.
        if kind != "revisit" and size != len(payload) and not {b"transfer-encoding", b"content-encoding"} & http.keys():
            raise ValueError("the HTTP content-length differs from the payload")
        size = size if kind == "revisit" else len(payload)
    digest = given.get("warc-payload-digest")
    refers = fields.get("warc-refers-to")
    if kind == "revisit":
        if payload and payload is not block:
            raise ValueError("a revisit with a payload")
        if refers is None and "warc-refers-to-target-uri" not in fields:
            raise ValueError("a revisit without a reference")
        payload = None
    elif digest is None:
        digest = sha1(payload)
    elif digest != sha1(payload):
        raise ValueError("the digest differs from the payload")
    number = lambda x: int(x[len(PAGE) : -1]) if x and x.startswith(PAGE) and x[len(PAGE) : -1].lstrip("-").isdigit() else None
    return fields["warc-record-id"], number(fields["warc-record-id"]), fields.get("warc-target-uri"), fields["warc-date"], kind, payload, size, digest, refers, number(refers)


ARCHIVES = "path string, content binary"
RECORDS = "path string, record_id string, page_id long, url string, date string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to_record string, refers_to long, problem string"
_EMPTY = (None,) * 10


def _write(batches):
    from pyspark import TaskContext

    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
    part, n, records, size = TaskContext.get().partitionId(), 0, [], 0

    def flush():
        nonlocal n, records, size
        name = f"pages-{part:05d}-{n:05d}.warc.zst"
        out = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(records)], pa.binary())], schema=schema)
        n, records, size = n + 1, [], 0
        return out

    for batch in batches:
        for page_id, url, html, digest, refers_to in zip(*batch.columns, strict=True):
            payload = (html.as_py() or "").encode()
            records.append(record(page_id.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py()))
            size += len(records[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
    if records:
        yield flush()


def write_archives(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archives (path, content) with a record per row of pages (page_id, url, html).

    Of rows with equal payloads (html in UTF-8; null counts as empty) of at least least_bytes, those with the smallest page_id
    are responses, the others revisits that refer to it; rows without a page_id are responses. A null
    url is left out of its record; line breaks in one are escaped.  Other columns may have any name.
    An empty table gives no archive.  A task holds one archive of about ARCHIVE_BYTES and one page's payload, of at most 2 GB (Arrow's limit for a cell).

    Which payloads are equal is found out on (page_id, digest) alone; of each row with an id the html is shuffled once, by page_id, so
    many pages with the same payload are spread over all tasks.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("__digest"))
    narrow = rows.where(F.col("page_id").isNotNull() & (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)).select("page_id", "__digest").distinct()
    scratch = Scratch(spark, "digests")
    narrow = scratch.keep(narrow)
    first = scratch.keep(narrow.groupBy("__digest").agg(F.min("page_id").alias("__refers")))
    revisits = narrow.join(first, "__digest").where("page_id <> __refers").select("page_id", "__digest", "__refers")
    rows = rows.join(scratch.keep(revisits).hint("merge"), ["page_id", "__digest"], "left")
    return rows.select("page_id", "url", "html", "__digest", "__refers").mapInArrow(_write, ARCHIVES)


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each row of archives (path, content) as a file of that name into folder, a URI that pyarrow's file systems reach from all executors; returns (path, bytes).

    A file is written under another name and then moved, so a task that is run again or twice leaves one whole file.  Rows with a null path or content are no files.
    The files are there once the returned table is read (write it, or count it).
    """

    def put(batches):
        from pyarrow import fs

        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base, recursive=True)
        for batch in batches:
            done = []
            for path, content in zip(*batch.columns, strict=True):
                if path.is_valid and content.is_valid:
                    data, own = content.as_buffer(), f"{base}/.{path.as_py()}.{uuid.uuid4().hex}"
                    with where.open_output_stream(own) as out:
                        out.write(data)
                    where.move(own, f"{base}/{path.as_py()}")
                    done.append((path.as_py(), data.size))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())], names=["path", "bytes"])

    return archives.select("path", "content").mapInArrow(put, "path string, bytes long")


def _read(batches):
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (column.split() for column in RECORDS.split(", "))])
    rows, size = [], 0

    def flush():
        nonlocal rows, size
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows, size = [], 0
        return out

    for batch in batches:
        for path, content in zip(*batch.columns, strict=True):
            try:
                for raw in frames(content.as_py() or b""):
                    try:
                        rows.append((path.as_py(), *parse(raw), None))
                    except ValueError as e:
                        rows.append((path.as_py(), *_EMPTY, str(e)))
                    size += len(raw)
                    if size >= ARCHIVE_BYTES:
                        yield flush()
            except (ValueError, zstandard.ZstdError) as e:  # the rest of the archive can't be found
                rows.append((path.as_py(), *_EMPTY, str(e)))
    if rows:
        yield flush()


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of archives (path, content, as of the binaryFile source), in RECORDS' columns.

    page_id and refers_to are the numbers of this writer's record ids, null for others; record_id and refers_to_record are the ids as they stand.
    A record whose header, lengths or digests don't hold has only path and problem; what
    follows a frame that is cut off is one such row.  An empty or null content has no records.
    """
    return archives.select("path", "content").mapInArrow(_read, RECORDS)


def op8_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    archives = scratch.keep(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, array_to_string(list_transform(string_split(h, ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), '') AS bits FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CASE WHEN substr(bits, i * 5 + j + 1, 1) = '1' THEN 1 << (4 - j) ELSE 0 END))::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
