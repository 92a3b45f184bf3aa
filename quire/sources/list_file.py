"""S6, raw form: a JSON list of candidate lists, read by byte ranges of one file.

A range can begin anywhere, also inside a string, so reading takes two passes.  The first one scans
every range under both assumptions, that it begins outside and inside a string, and notes where it
ends up, how far brackets are open and how many elements' commas it has.  Ranges in order of place
then tell each other what is true (a few numbers a range go through the driver).  In the second
pass every range parses the elements whose opening mark it holds, reading on past its end for the
last one.  The element number, the row id, is the number of commas between elements before it.

Files are opened by pyarrow, in the tasks; ``s3a`` is opened as ``s3``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one range.
RANGE_BYTES = 16 << 20
_EVENT = re.compile(rb'\\.|["\[\],]', re.S)
_LOOK_BACK = 1 << 10

RANGES = "path string, start long, end long, size long"
_STATES = "path string, start long, inside boolean, ends_inside boolean, depth int, commas map<int,long>"
_TRUE = "path string, start long, end long, size long, inside boolean, depth int, first long"


class _File:
    def __init__(self, path: str):
        from pyarrow import fs

        where, inner = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))
        self.file = where.open_input_file(inner)

    def read(self, start: int, end: int) -> bytes:
        return self.file.read_at(end - start, start)

    def escaped(self, start: int) -> bool:
        """Is the byte at ``start`` escaped, if it lies in a string?  An odd run of backslashes is before it."""
        run, end = 0, start
        while end > 0:
            back = self.read(max(end - _LOOK_BACK, 0), end)
            n = len(back) - len(back.rstrip(b"\\"))
            run += n
            if n < len(back):
                break
            end -= len(back)
        return run % 2 == 1


def _events(data: bytes, inside: bool, escaped: bool) -> Iterator[tuple[int, int]]:
    """(place, byte) of the brackets and commas outside strings; at last (-1, whether it ends inside one)."""
    at = 1 if inside and escaped else 0
    while True:
        m = _EVENT.search(data, at)
        if m is None:
            yield -1, int(inside)
            return
        mark = data[m.start()]
        at = m.end()
        if mark == 34:  # a quote
            inside = not inside
        elif mark == 92:  # a backslash
            at = m.end() if inside else m.start() + 1
        elif not inside:
            yield m.start(), mark


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            f = _File(r["path"])
            data, escaped = f.read(r["start"], r["end"]), f.escaped(r["start"])
            for inside in (False, True):
                depth, commas, last = 0, {}, 0
                for place, mark in _events(data, inside, escaped):
                    if place < 0:
                        last = mark
                    elif mark == 44:
                        commas[depth] = commas.get(depth, 0) + 1
                    else:
                        depth += 1 if mark == 91 else -1
                out.append({"path": r["path"], "start": r["start"], "inside": inside, "ends_inside": bool(last), "depth": depth, "commas": list(commas.items())})
        kind = pa.schema([("path", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("ends_inside", pa.bool_()), ("depth", pa.int32()), ("commas", pa.map_(pa.int32(), pa.int64()))])
        yield pa.RecordBatch.from_pylist(out, kind)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements whose opening mark (the list's bracket, or a comma at its level) lies in the range."""
    kind = pa.schema([("row_id", pa.int64()), ("candidates", pa.list_(pa.string()))])
    for batch in batches:
        for r in batch.to_pylist():
            f = _File(r["path"])
            start, end, number, depth = r["start"], r["end"], r["first"], r["depth"]
            data = f.read(start, end)
            escaped = f.escaped(start)
            rows, opened, more = [], None, 1 << 16
            inside, base, done = r["inside"], 0, False
            while True:
                ended = inside
                for place, mark in _events(data[base:], inside, escaped):
                    if place < 0:
                        ended = bool(mark)
                        break
                    place += base
                    opens = mark == 91 and depth == 0
                    parts = mark == 44 and depth == 1
                    closes = mark == 93 and depth == 1
                    if opened is not None and (parts or closes):
                        text = data[opened:place].strip()
                        if text or parts or number:
                            rows.append({"row_id": number, "candidates": _candidates(text)})
                        opened = None
                    number += parts
                    if (opens or parts) and start + place < end:
                        opened = place + 1
                    depth += (mark == 91) - (mark == 93)
                    if opened is None and start + place >= end:
                        done = True
                        break
                at_end = start + len(data) >= r["size"]
                if done or opened is None or at_end:
                    break
                inside, base = ended, len(data)
                escaped = (len(data) - len(data.rstrip(b"\\"))) % 2 == 1
                data += f.read(start + base, min(start + base + more, r["size"]))
                more *= 2
            if opened is not None:
                raise ValueError(f"{r['path']}: the list isn't closed")
            yield pa.RecordBatch.from_pylist(rows, kind)


def _candidates(text: bytes) -> list[str | None] | None:
    value = json.loads(text)
    if value is None or isinstance(value, list) and all(v is None or isinstance(v, str) for v in value):
        return value
    raise ValueError(f"not a list of texts: {text[:80]!r}")


def ranges_of(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, end, size) of all files at ``path``, listed without reading them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))
    return files.select("path", F.explode(starts).alias("start"), "size").select("path", "start", F.least(F.col("start") + range_bytes, F.col("size")).alias("end"), "size")


def read_lists(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(row_id, candidates) of the lists at ``path``: an element's place in its file, and its texts.

    Many tasks read one large file.  A file that isn't one closed list of lists of texts fails.
    """
    ranges = ranges_of(spark, path, range_bytes)
    spread = lambda df: df.repartition(max(df.count(), 1), "path", "start")
    known = spread(ranges).mapInArrow(_scan, _STATES).collect()  # two rows a range
    at = {(r["path"], r["start"], r["inside"]): r for r in known}
    out, state = [], None
    for r in sorted(ranges.collect(), key=lambda r: (r["path"], r["start"])):
        if r["start"] == 0:
            state = (False, 0, 0)
        inside, depth, first = state
        out.append((r["path"], r["start"], r["end"], r["size"], inside, depth, first))
        found = at[r["path"], r["start"], inside]
        state = (found["ends_inside"], depth + found["depth"], first + found["commas"].get(1 - depth, 0))
        if r["end"] == r["size"] and state[:2] != (False, 0):
            raise ValueError(f"{r['path']}: not one closed list")
    return spread(spark.createDataFrame(out, _TRUE)).mapInArrow(_parse, "row_id long, candidates array<string>")
