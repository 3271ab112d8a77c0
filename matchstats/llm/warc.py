"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchstats.llm.shared import fresh_path, table

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 16_000_000
#: Bytes of the records from which an archive's dictionary is trained, and of the dictionary.
SAMPLE_BYTES, DICTIONARY_BYTES = 400_000, 16_384
#: A record that unpacks to more than this is refused.
RECORD_BYTES = 1 << 31


class BadArchive(ValueError):
    """An archive or record breaks the format."""


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """A response record, or a revisit (headers only) where refers_to is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = lambda x: "<urn:page>" if x is None else f"<urn:page:{quote(str(x), safe='')}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or '')}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's first records; with too few of them, their bytes serve as a raw dictionary."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1"


def archive(records: Iterator[bytes], out, most: int = ARCHIVE_BYTES) -> tuple[int, bool]:
    """Writes records to a file object up to `most` bytes; how many, and whether some may be left."""
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    if not first:
        return 0, False
    words = train(first)
    packed = zstandard.ZstdCompressor(level=9).compress(words)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(packed)) + packed)
    c = zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(words))
    n, written = 0, 0
    for r in first:
        n, written = n + 1, written + out.write(c.compress(r))
    while written < most:
        if (r := next(records, None)) is None:
            return n, False
        n, written = n + 1, written + out.write(c.compress(r))
    return n, True


def frame_length(data: memoryview) -> int:
    """Compressed bytes of the frame at the start of data, from its block headers."""
    try:
        at, checksum = zstandard.frame_header_size(data), zstandard.get_frame_parameters(data).has_checksum
    except zstandard.ZstdError as e:
        raise BadArchive(f"no frame: {e}") from e
    last = False
    while not last:
        if at + 3 > len(data):
            raise BadArchive("a frame is cut off")
        head = int.from_bytes(data[at : at + 3], "little")
        last = head & 1
        at += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
    at += 4 * checksum
    if at > len(data):
        raise BadArchive("a frame is cut off")
    return at


def frames(data: bytes, most: int = RECORD_BYTES) -> Iterator[bytes]:
    """The unpacked frames of an archive, with the dictionary of its leading skippable frame if it has one."""
    view, at, words = memoryview(data), 0, None
    if len(view) >= 8 and (head := struct.unpack("<II", view[:8]))[0] == DICTIONARY_MAGIC:
        at = 8 + head[1]
        if at > len(view):
            raise BadArchive("the dictionary is cut off")
        words = bytes(view[8:at])
        if words[:4] == FRAME_MAGIC:
            words = zstandard.ZstdDecompressor().decompress(words, max_output_size=1 << 27)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words)) if words else zstandard.ZstdDecompressor()
    while at < len(view):
        if len(view) - at >= 8 and (magic := struct.unpack("<I", view[at : at + 4])[0]) & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack("<I", view[at + 4 : at + 8])[0]  # any later skippable frame
            if at > len(view):
                raise BadArchive("a skippable frame is cut off")
            continue
        n = frame_length(view[at:])
        try:
            frame = unpacker.stream_reader(view[at : at + n]).read(most + 1) if zstandard.frame_content_size(view[at : at + n]) <= most else None
        except zstandard.ZstdError as e:
            raise BadArchive(f"a frame can't be unpacked: {e}") from e
        if frame is None or len(frame) > most:
            raise BadArchive("a record is too long")
        yield frame
        at += n


def parse(frame: bytes) -> dict:
    """The one record of a frame, its headers and lengths checked."""
    end = frame.find(b"\r\n\r\n")
    lines = frame[: max(end, 0)].decode("utf-8").split("\r\n")
    if end < 0 or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon or not key:
            raise BadArchive(f"a bad header line: {line[:80]!r}")
        fields[key.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise BadArchive(f"missing headers: {sorted(missing)}")
    if not fields["content-length"].isdigit():
        raise BadArchive("a bad Content-Length")
    n = int(fields["content-length"])
    if len(frame) != end + 4 + n + 4 or frame[-4:] != b"\r\n\r\n":
        raise BadArchive("the record's length differs from its Content-Length")
    block = frame[end + 4 : end + 4 + n]
    out = {"fields": fields, "type": fields["warc-type"], "payload": None, "payload_bytes": None}
    if out["type"] in ("response", "revisit"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
        if not blank or not said:
            raise BadArchive("no HTTP header")
        out["payload_bytes"] = int(said[1])
        if out["type"] == "response":
            if len(payload) != out["payload_bytes"]:
                raise BadArchive("the payload's length differs from the HTTP header")
            if fields.get("warc-payload-digest", "sha1:" + digest32(payload)) != "sha1:" + digest32(payload):
                raise BadArchive("the payload's digest differs")
            out["payload"] = payload
        elif "warc-refers-to" not in fields:
            raise BadArchive("a revisit without WARC-Refers-To")
    return out


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of pages (page_id, url, html; null html: empty) and returns the written (path, records).

    Of rows with equal payloads of at least min_bytes bytes, those with the largest page_id become responses, the others
    revisits of it; a row without a page_id is the smallest, and among only such rows all are responses.  Payload
    digests are aggregated partially, so a hot payload is one row for each task; only digests that occur more than once
    are joined back, by an adaptive join that splits hot ones.  Names of archives are unique to each attempt of a task
    and only those in the returned table (committed by Spark) count, so retries and lost executors leave no doubles.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"), F.unhex(F.sha1(payload.cast("binary"))).alias("digest"))
    copies = rows.where(F.octet_length("html") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count("*").alias("n"))
    copies = table(copies.where("n > 1 and head is not null").select("digest", "head"), "warc-copies")
    marked = rows.join(copies, "digest", "left").withColumn("refers_to", F.when(~F.col("head").eqNullSafe(F.col("page_id")), F.col("head")))
    folder = fresh_path(spark, "warc")

    def run(batches):
        def records():
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to"))):
                    page_id, url, html, refers_to = (x.as_py() for x in row)
                    yield record(page_id, url, html.encode(), refers_to, date)

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root)
        source, more = records(), True
        while more:
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                n, more = archive(source, out)
            if n:
                yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n]})

    return table(marked.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of all archives named in column `path`, one task for some archives, each record checked.

    Returns record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to_id and payload (null for
    revisits).  A damaged archive raises BadArchive; an empty one has no rows.
    """

    def run(batches):
        names = ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to_id", "payload")
        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, name = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(name) as f:
                    data = f.read()
                rows, size = [], 0
                for frame in frames(data):
                    r = parse(frame)
                    f = r["fields"]
                    rows.append((f["warc-record-id"], r["type"], f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:"), r["payload_bytes"], f.get("warc-refers-to"), r["payload"]))
                    size += len(frame)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to_id string, payload binary"
    return paths.select("path").repartition(n, F.xxhash64("path")).mapInArrow(run, schema)


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per page what its record says after writing and reading back: page_id, payload_bytes, payload_digest,
    record_type, refers_to.

    Null html is an empty payload, a null page_id stays null; repeated rows have a record each; an empty table gives an
    empty one; payloads may be of any length up to RECORD_BYTES.
    """
    kind = dict(pages.dtypes)["page_id"]
    number = lambda c: F.when(F.startswith(F.col(c), F.lit("<urn:page:")), F.url_decode(F.regexp_extract(c, r"<urn:page:(.*)>", 1))).cast(kind)
    read = read_archives(write_archives(pages, min_bytes))
    return read.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to")
    )
