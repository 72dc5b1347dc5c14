"""WARC: writing, normalising and reading web archives.

write() lets Spark's own text writer make *monolithic* archives: each output file is one gzip stream over many records, so it
can't be entered in the middle. normalise() inflates each such file once, as it is read, and rewrites every record as its own
gzip member, with a sidecar index (offset, length, record id) beside the archive. read() enters members by the sidecar.
Archives may come from elsewhere: several members, header names in any case, any HTTP head, any record types, .warc.gz.

At scale: one task handles one archive at a time and holds a block of it and a record's header; a record's content passes
through in blocks, so neither archives nor records need to fit in memory before they are read as rows. Payloads that repeat
become revisit records; the groups are found by digest with a partial aggregation, and a hot digest is split by adaptive
execution. Archives are written under a task-unique name and renamed, so a repeated task does no harm.

Defined results: a null html is an empty payload; a null url is an empty target; a null page_id is a record without page id,
which can be a revisit but never the response that others refer to; line breaks in a url are percent-encoded; rows that share
the largest page_id of a group are all responses; an empty table gives empty archives and no rows. A foreign record has no
page_id unless its id is one of write()'s; a revisit without the length of its payload has none. An archive that ends within a
record, and a payload that doesn't match its digest, are errors.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REVISIT_FROM = 1000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BLOCK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, refers_to_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def records(pages: DataFrame, least: int = REVISIT_FROM) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest and target: the page that holds the same payload, else null."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"), F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("payload_digest"))
    groups = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.count("*").alias("n"), F.max("page_id").alias("target"))
    groups = groups.where("n > 1 and target is not null").select(F.col("payload_digest").alias("__d"), F.col("payload_bytes").alias("__b"), "target")
    same = (F.col("payload_digest") == F.col("__d")) & (F.col("payload_bytes") == F.col("__b"))
    return rows.join(groups, same, "left").drop("__d", "__b").withColumn("target", F.when(~F.col("page_id").eqNullSafe(F.col("target")), F.col("target")))


def _text(date: str) -> Column:
    """A record but for its last line feed, which the text writer adds."""
    revisit = F.col("target").isNotNull()
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = F.coalesce(F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">")), F.lit("<urn:page:none>"))
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), ident),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("target").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write(pages: DataFrame, folder: str, records_per_file: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes monolithic gzip archives of pages into folder."""
    out = records(pages).select(_text(date).alias("value")).write
    out.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", records_per_file).option("zlib.compress.level", "BEST_SPEED").text(folder)


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _inflated(source) -> Iterator[bytes]:
    """Blocks of a gzip stream (an object with read), also one of several members."""
    stream, piece, begun = zlib.decompressobj(31), b"", False
    while piece or (piece := source.read(BLOCK)):
        if stream.eof:
            piece = piece.lstrip(b"\0")  # padding
            if not piece:
                continue
            stream = zlib.decompressobj(31)
        begun = True
        if out := stream.decompress(piece, BLOCK):
            yield out
        piece = stream.unconsumed_tail or stream.unused_data
    if tail := stream.flush():
        yield tail
    if begun and not stream.eof:
        raise ValueError("the gzip stream is cut off")


def _fields(header: bytes) -> dict[str, str]:
    """A header's fields by lower-case name; folded lines belong to the field before."""
    lines = re.sub(rb"\r?\n[ \t]+", b" ", header).decode("utf-8", "replace").splitlines()
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def split_records(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(fields, pieces of the whole record with its header) of a WARC stream. The pieces must be taken before the next record."""
    held = bytearray()

    def more() -> bool:
        block = next(blocks, None)
        held.extend(block or b"")
        return block is not None

    def pieces(header: bytes, length: int) -> Iterator[bytes]:
        yield header
        while length:
            if not held and not more():
                raise ValueError(f"the archive ends within a record ({length} bytes are missing)")
            part = bytes(held[:length])
            del held[: len(part)]
            length -= len(part)
            yield part
        yield b"\r\n\r\n"

    while True:
        while held[:1] in (b"\r", b"\n"):  # between records
            del held[:1]
        if not held:
            if not more():
                return
            continue
        while not (end := re.search(rb"\r?\n\r?\n", held)):
            if not more():
                raise ValueError(f"the archive ends within a header ({len(held)} bytes are left)")
        header = bytes(held[: end.end()])
        if not header.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {header[:20]!r}")
        del held[: len(header)]
        fields = _fields(header)
        body = pieces(header, int(fields["content-length"]))
        yield fields, body
        for _ in body:  # what was not taken
            pass


def normalise(spark: SparkSession, folder: str, out: str, level: int = 3) -> DataFrame:
    """Rewrites each monolithic archive in folder as one of single-record members in out, with its sidecar. Returns (archive, n_records), already written."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                name = re.sub(r"\.(txt|warc)\.gz$|\.gz$", "", path.rsplit("/", 1)[1])
                store, base = _store(f"{out}/archives")
                own, at, n = f"{base}/{name}.{uuid.uuid4().hex}", 0, 0
                store.create_dir(base)
                origin, source = _store(path)
                with origin.open_input_stream(source, compression=None) as content, store.open_output_stream(f"{own}.part", compression=None) as sink, store.open_output_stream(f"{own}.idx") as index:
                    for fields, record in split_records(_inflated(content)):
                        deflate, size = zlib.compressobj(level, zlib.DEFLATED, 31), 0
                        for piece in record:
                            size += sink.write(deflate.compress(piece))
                        size += sink.write(deflate.flush())
                        index.write(f"{at}\t{size}\t{fields.get('warc-record-id', '')}\n".encode())
                        at, n = at + size, n + 1
                store.move(f"{own}.idx", f"{base}/{name}.warc.gz.idx")
                store.move(f"{own}.part", f"{base}/{name}.warc.gz")
                yield pa.RecordBatch.from_pydict({"archive": [f"{out}/archives/{name}.warc.gz"], "n_records": [n]})

    # The content column is not read: tasks open the paths.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).select(F.col("_metadata.file_path").alias("path"))
    done = files.mapInArrow(rewrite, "archive string, n_records long")
    done.write.parquet(f"{out}/done")
    return spark.read.schema(done.schema).parquet(f"{out}/done")


def _digest(text: str) -> str | None:
    """A sha1 digest as lower-case hex, from hex or base 32; None if it is none."""
    kind, _, value = text.rpartition(":")
    if kind.lower() not in ("", "sha1") or len(value) not in (32, 40):
        return None
    return (base64.b32decode(value.upper()).hex() if len(value) == 32 else value).lower()


def _parsed(record: bytes) -> tuple:
    end = re.search(rb"\r?\n\r?\n", record).end()
    fields, content = _fields(record[:end]), record[end:]
    content = content[: int(fields["content-length"])]
    if fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        head = re.search(rb"\r?\n\r?\n", content)
        content = content[head.end() :] if head else b""
    kind, ident, other = fields.get("warc-type", "").lower(), fields.get("warc-record-id"), fields.get("warc-refers-to")
    stated, own = _digest(fields.get("warc-payload-digest", "")), None
    if kind != "revisit":
        own = hashlib.sha1(content).hexdigest()
        if stated not in (None, own):
            raise ValueError(f"{ident}: the payload doesn't match its digest")
    known = fields.get("x-payload-length")
    size = len(content) if own else int(known) if known else None
    number = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", x or "")) else None
    return ident, other, number(ident), size, own or stated, kind, number(other), fields.get("warc-target-uri"), content if own else None


def read(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The records of normalised archives (archive), entered member by member through their sidecars. payload: carry the bytes too."""

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch["archive"].to_pylist():
                store, path = _store(archive)
                with store.open_input_stream(f"{path}.idx") as f:
                    index = [line.split("\t") for line in f.read().decode().splitlines()]
                with store.open_input_file(path) as f:
                    rows, held = [], 0
                    for k, (offset, length, _) in enumerate(index, 1):
                        f.seek(int(offset))
                        row = _parsed(zlib.decompress(f.read(int(length)), 31))
                        rows.append(row if payload else (*row[:-1], None))
                        held += len(row[-1] or b"") if payload else 0
                        if len(rows) < 256 and held < BLOCK and k < len(index):
                            continue
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
                        rows, held = [], 0

    return archives.select("archive").mapInArrow(members, RECORD)


SCHEMA = pa.schema([("record_id", pa.string()), ("refers_to_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
