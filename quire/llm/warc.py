"""WARC archives: a writer of one gzip member per record, and a splittable reader.

Writing: equal payloads of a least size share one ``response`` record, the others are ``revisit``
records that refer to it and carry no payload.  Tasks write archives of bounded size to the shared
folder, each under a name of its own attempt; only archives named in the returned manifest count,
so a lost or repeated task leaves nothing that is read.

Reading: every archive is cut into byte ranges.  A task scans its range for the gzip magic and
validates a candidate by decoding it: a member must begin with a WARC header, hold as many bytes as
that states, and end in a valid checksum.  A range owns the records that start inside it and reads
beyond its end to finish the last one.  After a valid member the scan goes on behind it.  So that no
range can start inside a member and take embedded archive bytes for a record, the writer packs a
record anew when its compressed bytes hold the magic by chance or because a payload is an archive.

Defined results: a null or empty payload makes a record without payload; of rows that share the
smallest page_id of a payload, one is the response; a payload whose rows have no page_id at all is
always a response; a null url leaves its header out; an empty table makes no archive and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import file_system, stored, work_folder
from quire.session import cut_lineage

#: Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Least payload (bytes) that is worth a revisit, size at which a new archive begins, size of a
#: range, bytes read at a time, and zlib's level.
LEAST_REVISIT = 100
ARCHIVE_BYTES = 256 << 20
RANGE_BYTES = 16 << 20
CHUNK = 1 << 20
LEVEL = 3
ID = "urn:page:"


def gzip_member(record: bytes) -> bytes:
    """One gzip member without the magic anywhere but at its start.

    Tried are zlib's level, Huffman coding alone and fixed codes; at last the record goes out as
    stored blocks so short that the magic never lies whole in one.
    """
    for strategy in (zlib.Z_DEFAULT_STRATEGY, zlib.Z_HUFFMAN_ONLY, zlib.Z_FIXED):
        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31, 9, strategy)
        out = z.compress(record) + z.flush()
        if out.find(MAGIC, 1) < 0:
            return out
    stored = b"".join(bytes([0, n & 255, 0, ~n & 255, 255]) + record[i : i + n] for i in range(0, len(record), 2) for n in [min(2, len(record) - i)])
    return b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\xff" + stored + b"\x01\x00\x00\xff\xff" + zlib.crc32(record).to_bytes(4, "little") + (len(record) & 0xFFFFFFFF).to_bytes(4, "little")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit if it refers to a page."""
    clean = lambda v: "".join(c if c.isprintable() else "%" + c.encode("utf-8", "replace").hex().upper() for c in v)
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"), ("WARC-Date", "2024-01-01T00:00:00Z")]
    if url is not None:
        head.append(("WARC-Target-URI", clean(url)))
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{ID}{refers_to}>")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, refers_to) of a table (page_id, url, html) at rest, whose rows
    get the same numbers whenever they are read."""
    p = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("row", F.monotonically_increasing_id())
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("large", F.length("payload") >= least)
    known = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "row")
    first = p.where("large").groupBy("digest").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first.page_id is not null").select("digest", "first")
    refers = F.when(F.col("large") & (F.col("row") != F.col("first.row")), F.col("first.page_id"))
    return p.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the records to archives in a shared folder; the manifest (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = out = None
        path, size, n = "", 0, 0
        done = []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    uri = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, path = file_system(uri)
                    fs.create_dir(path.rsplit("/", 1)[0])
                    out, size, n = fs.open_output_stream(path, compression=None), 0, 0
                member = gzip_member(record(*(v.as_py() for v in row)))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((uri, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((uri, size, n))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()))], ["path", "bytes", "records"])

    return cut_lineage(records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def ranges(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, bytes, start, end): one row per byte range, dealt over the cluster."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    r = manifest.where("bytes > 0").select("path", "bytes", starts.alias("start")).withColumn("end", F.least(F.col("start") + range_bytes, F.col("bytes")))
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return r.repartition(max(int(n), 1))


class _Bytes:
    """A file's bytes from some place on, read in chunks as they are asked for."""

    def __init__(self, file, start: int, size: int):
        self.file, self.base, self.size, self.data = file, start, size, bytearray()

    def until(self, end: int) -> None:
        while self.base + len(self.data) < min(end, self.size):
            at = self.base + len(self.data)
            chunk = self.file.read_at(min(CHUNK, self.size - at), at)
            if not chunk:
                raise OSError(f"the archive ends at {at}, before its size of {self.size}")
            self.data += chunk

    def drop(self, before: int) -> None:
        del self.data[: before - self.base]
        self.base = before

    def find_magic(self, at: int, end: int) -> int:
        """The first candidate in [at, end), or -1."""
        while at < end:
            self.until(min(at + CHUNK, end) + len(MAGIC) - 1)
            found = self.data.find(MAGIC, at - self.base, min(at + CHUNK, end) + len(MAGIC) - 1 - self.base)
            if found >= 0:
                return found + self.base
            at = min(at + CHUNK, end)
            self.drop(min(at, self.base + len(self.data)))
        return -1

    def member(self, at: int) -> tuple[dict[str, str], bytes, int] | None:
        """Header, block and end of the record whose member begins here, or None if none does."""
        z, out, pos = zlib.decompressobj(31), bytearray(), at
        head, need = None, 0
        try:
            while not z.eof:
                self.until(pos + 1)
                chunk = bytes(self.data[pos - self.base : pos - self.base + (CHUNK if head else 4096)])
                if not chunk:
                    return None
                out += z.decompress(chunk)
                pos += len(chunk)
                if head is None:
                    if not out.startswith(b"WARC/1."[: len(out)]):
                        return None
                    cut = out.find(b"\r\n\r\n")
                    if cut >= 0:
                        lines = bytes(out[:cut]).decode("utf-8").split("\r\n")[1:]
                        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                        need = cut + 4 + int(head["content-length"])
                elif len(out) > need + 4:
                    return None
        except (zlib.error, ValueError, KeyError):
            return None
        if head is None or len(out) != need + 4 or not out.endswith(b"\r\n\r\n"):
            return None
        return head, bytes(out[cut + 4 : need]), pos - len(z.unused_data)


def records_in(file, size: int, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header, block) of the records that start in [start, end) of an open file."""
    data, at = _Bytes(file, start, size), start
    while (at := data.find_magic(at, end)) >= 0:
        if found := data.member(at):
            yield at, found[0], found[1]
            at = found[2]
        else:
            at += 1
        data.until(at)
        data.drop(at)


def read_records(parts: DataFrame) -> DataFrame:
    """(page_id, record_type, url, payload, digest, refers_to, path, offset) of the records in a
    table of ranges; ``digest`` is as stated in the header, ``payload`` null for revisits."""
    schema = "page_id long, record_type string, url string, payload binary, digest string, refers_to long, path string, offset long"
    kinds = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("refers_to", pa.int64()), ("path", pa.string()), ("offset", pa.int64())])

    def number(v: str | None) -> int | None:
        digits = (v or "").strip("<>").removeprefix(ID)
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                fs, at = file_system(path)
                rows, held = [], 0
                with fs.open_input_file(at) as file:
                    for offset, head, block in records_in(file, size, start, end):
                        kind = head.get("warc-type")
                        payload = None if kind == "revisit" else block.partition(b"\r\n\r\n")[2]
                        rows.append((number(head.get("warc-record-id")), kind, head.get("warc-target-uri"), payload, head.get("warc-payload-digest", "").removeprefix("sha256:"), number(head.get("warc-refers-to")), path, offset))
                        held += len(block)
                        if held > 4 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return parts.select("path", "bytes", "start", "end").mapInArrow(run, schema)


def round_trip(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, range_bytes: int = RANGE_BYTES, at_rest: bool = False) -> DataFrame:
    """Writes a table (page_id, url, html) as archives in the shared folder and reads them back:
    (page_id, record_type, payload_bytes, payload_digest, refers_to).

    Digest and size of a response are taken from the payload that was read; a revisit's are those
    of the response that it refers to, which must state the same digest.  Rows that don't come
    straight from files (``at_rest``) are written first, so that their numbers can't change.
    """
    spark: SparkSession = pages.sparkSession
    folder = work_folder(spark, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    manifest = write_archives(plan_records(pages if at_rest else stored(pages, "warc-pages")), folder, archive_bytes)
    read = cut_lineage(read_records(ranges(manifest, range_bytes)).select("page_id", "record_type", "digest", "refers_to", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")), "warc-read")
    responses = read.where("record_type = 'response'")
    targets = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to", "digest"])
    revisits = read.where("record_type = 'revisit'").select("page_id", "record_type", "digest", "refers_to").join(targets, ["refers_to", "digest"], "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(revisits.select(*columns))

