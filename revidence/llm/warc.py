"""Operator 1: WARC archives and the normaliser of monolithic gzip streams.

``write_monolithic`` writes one record per page, every file being one gzip stream over all its records, as tools do that
compress a finished archive. Such a file can't be read from the middle. ``normalise`` inflates each stream once, piece by
piece, rewrites every record as a gzip member of its own and writes a sidecar index (offset, length, type, id) beside
the archive. ``read_archives`` reads records by that index, any range of it in any task.

Archives are written under a temporary name and moved into place, the sidecar after its archive, so a task that is lost
and run again leaves the same files. Memory per task: one record and one megabyte of stream.

Rows: null html is an empty payload, a null url leaves out the target URI. Of records with equal payloads of at least
``min_bytes`` bytes those with the largest page_id are responses, the others revisits that refer to it; rows repeated
with that id are responses too. A null page_id never is the largest; equal payloads with null ids alone are responses.
An empty table gives archives without records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from revidence.functions.columns import computed
from revidence.llm.common import scratch, written

PIECE = 1 << 20
CRLF = "\r\n"
INDEX = "archive string, offset long, length long, type string, record_id string"
RECORDS = "record_id string, type string, target string, refers_to string, digest string, payload_bytes long, payload binary"


def base32(hexed: Column) -> Column:
    """Upper-case base 32 of a 160-bit number in hexadecimal: four times 40 bits."""
    parts = [F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, first: the page_id referred to, null for responses."""
    base = computed(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")), digest=F.sha1(F.col("payload").cast("binary")))
    firsts = base.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    rows = base.join(firsts.where("n > 1").select("digest", "top"), "digest", "left")
    return rows.select("page_id", "url", "payload", base32(F.col("digest")).alias("digest"),
                       F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("first"))


def write_monolithic(pages: DataFrame, path: str, *, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> None:
    """WARC files of one gzip stream each. The text writer ends every record with its last line feed."""
    size = F.octet_length("payload").cast("string")
    revisit = F.col("first").isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(date)), F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), line("X-Payload-Length", size),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
                                 line("WARC-Refers-To", record_id(F.col("first"))))).otherwise(""),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(revisit, "0").otherwise(size)), F.lit(CRLF))
    body = F.concat(head, F.when(revisit, "").otherwise(F.col("payload")), F.lit("\r\n\r"))
    rows = with_roles(pages, min_bytes).select(body.alias("value"))
    rows.write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(path)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a Hadoop-style URI (file:/a is file:///a, s3a is s3)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def inflate(stream) -> Iterator[bytes]:
    """Pieces of at most PIECE bytes of all gzip members of a stream."""
    d = zlib.decompressobj(31)
    while chunk := stream.read(PIECE):
        while chunk:
            if d.eof:
                d = zlib.decompressobj(31)
            out = d.decompress(chunk, PIECE)
            if out:
                yield out
            chunk = d.unused_data if d.eof else d.unconsumed_tail
    while not d.eof and (out := d.decompress(d.unconsumed_tail, PIECE)):
        yield out


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, whole record with its two closing line ends) of each record."""
    buffer, pieces = bytearray(), iter(pieces)

    def fill() -> bool:
        piece = next(pieces, None)
        buffer.extend(piece or b"")
        return piece is not None
    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0 and fill():
            pass
        if end < 0:
            if buffer.strip():
                raise ValueError("archive ends inside a record header")
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buffer[:end].decode().split(CRLF)[1:])}
        size = end + 4 + int(fields["content-length"]) + 4
        while len(buffer) < size:
            if not fill():
                raise ValueError("archive ends inside a record")
        yield fields, bytes(buffer[:size])
        del buffer[:size]


def normalise(spark: SparkSession, source: str, target: str, *, level: int = 6) -> DataFrame:
    """Rewrite all .gz files of ``source`` into ``target`` with a member for each record; returns the index."""
    def one(uri: str) -> int:
        files, path = _open(uri)
        out_files, folder = _open(target)
        out_files.create_dir(folder, recursive=True)
        stem = path.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt")
        name, tmp = f"{folder}/{stem}.warc.gz", f"{folder}/.{stem}.{uuid.uuid4().hex}"
        n = offset = 0
        with files.open_input_stream(path, compression=None) as raw, out_files.open_output_stream(tmp, compression=None) as out, \
                out_files.open_output_stream(f"{tmp}.idx", compression=None) as index:
            for fields, record in split_records(inflate(raw)):
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record) + z.flush()
                out.write(member)
                index.write("\t".join((f"{target}/{stem}.warc.gz", str(offset), str(len(member)), fields["warc-type"], fields["warc-record-id"])).encode() + b"\n")
                offset, n = offset + len(member), n + 1
        out_files.move(tmp, name)
        out_files.move(f"{tmp}.idx", f"{name}.idx")
        return n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"source": b["path"], "records": [one(p) for p in b["path"]]})
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")
    written(found.mapInPandas(run, "source string, records long"), "warc-manifest").count()
    return read_index(spark, target)


def read_index(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(INDEX).option("sep", "\t").option("pathGlobFilter", "*.idx").option("quote", "").csv(target)


def read_archives(index: DataFrame) -> DataFrame:
    """The records of an index (or of any part of it): RECORDS, payload empty for revisits."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, handle = None, None
        for b in batches:
            rows, held = [], 0
            for archive, offset, length in zip(b["archive"], b["offset"], b["length"]):
                if archive != opened:
                    if handle:
                        handle.close()
                    files, path = _open(archive)
                    opened, handle = archive, files.open_input_file(path)
                record = zlib.decompress(handle.read_at(length, offset), 31)
                (fields, whole), = split_records(iter([record]))
                payload = whole[whole.index(b"\r\n\r\n") + 4:-4]
                rows.append((fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
                             fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), payload))
                held += len(payload)
                if held > 8 * PIECE:
                    yield pd.DataFrame(rows, columns=names)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names)
        if handle:
            handle.close()
    names = [x.split()[0] for x in RECORDS.split(", ")]
    return index.select("archive", "offset", "length").mapInPandas(run, RECORDS)


def archived(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, target."""
    spark = pages.sparkSession
    raw, target = scratch(spark, "warc-raw"), scratch(spark, "warc")
    write_monolithic(pages, raw, min_bytes=min_bytes)
    records = read_archives(normalise(spark, raw, target))
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    response = F.col("type") == "response"
    return records.select(number("record_id").alias("page_id"), F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                          F.when(response, base32(F.sha1("payload"))).otherwise(F.col("digest")).alias("payload_digest"),
                          F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "target")
