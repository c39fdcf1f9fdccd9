"""Legacy archive converter: ARC files of either version to WARC files, and a reader for the result.

All archives are written by Spark's text writer, whose line separator is the archive's record separator, so
they land in whatever store the path names and a lost executor's files are written again; they are gzip
files of at most PER_FILE records. They are read as binary files, decompressed step by step and cut into records
by their declared lengths; a task holds one compressed archive and some records. What cannot be read (a header
line of another shape, a length that is no number, a broken gzip member, a wrong digest) is reported in the
column `problem`, and reading goes on behind it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

#: Records in an archive that is written here.
PER_FILE = 20_000
#: Fixed: the header fields of URL records in version 1 and 2 of the ARC format.
ARC_FIELDS = {
    "1": ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    "2": [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset",
        "Filename", "Archive-length"
    ],
}
#: Fixed: the WARC profile of records that repeat an earlier payload.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PARSED = (
    "uri string, ip string, captured string, mime string, http string, payload string, payload_bytes long, "
    "payload_digest string, record_id string, truncated boolean, problem string, path string"
)
READ = (
    "record_type string, record_id string, refers_to_id string, uri string, http string, payload_bytes long, "
    "payload_digest string, problem string"
)


class Stream:
    """Bytes of a file that may be gzipped, in any number of members, decompressed as they are read."""

    def __init__(self, data: bytes, step: int = 1 << 18):
        self.data, self.at, self.step, self.buffer, self.offset = memoryview(data), 0, step, bytearray(), 0
        self.broken = self.begun = False
        self.zip = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        if self.at >= len(self.data):
            self.broken |= self.begun  # a member without its end
            self.begun = False
            return False
        part = self.data[self.at : self.at + self.step]
        self.at += len(part)
        if self.zip is None:
            self.buffer += part
            return True
        while part:
            self.begun = True
            try:
                self.buffer += self.zip.decompress(part)
            except zlib.error:  # what was read before it stays
                self.at, self.broken = len(self.data), True
                return True
            part = self.zip.unused_data
            if self.zip.eof:
                self.begun = False
                part = part.lstrip(b"\0")  # padding
                self.zip = zlib.decompressobj(31)
            else:
                break
        return True

    def read(self, n: int) -> bytes:
        while len(self.buffer) < n and self._more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[: len(out)]
        self.offset += len(out)
        return out

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        seen = 0
        while (k := self.buffer.find(b"\n", seen)) < 0:
            seen = len(self.buffer)
            if not self._more():
                k = len(self.buffer)
                break
        if not self.buffer and k == 0:
            return None
        return self.read(k + 1).rstrip(b"\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(header with its blank line, payload); a block that is no HTTP message is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def _number(value: bytes | str | None) -> int | None:
    """A declared length; None if it is none."""
    text = value.decode("ascii", "replace") if isinstance(value, bytes) else (value or "")
    return int(text) if text.isascii() and text.isdigit() else None


def _unread(problem: str) -> dict:
    return {"uri": None, "ip": None, "captured": None, "mime": None, "http": b"", "payload": b"", "payload_bytes": 0} | {
        "payload_digest": None, "record_id": None, "truncated": False, "problem": problem,
    }


def arc_records(name: str, data: bytes) -> Iterator[dict]:
    """URL records of an ARC file: the version block names the version, and so the fields of the header lines.

    A run of lines that are no header gives one row whose problem is "header", a broken gzip member ends the file
    with a row "gzip", and a record that the file's end cuts off is marked as truncated.
    """
    stream, fields, lost = Stream(data), ARC_FIELDS["1"], False
    while (line := stream.line()) is not None:
        if not line.strip():
            continue
        offset = stream.offset
        if line.startswith(b"filedesc://") and (size := _number(line.rsplit(b" ", 1)[-1])) is not None:
            version = stream.read(size).split(b"\n", 1)[0].split(b" ")[0].decode("ascii", "replace")
            fields, lost = ARC_FIELDS.get(version, fields), False
            continue
        parts = line.rsplit(b" ", len(fields) - 1)
        size = _number(parts[-1]) if len(parts) == len(fields) else None
        if size is None:
            if not lost:
                yield _unread("header")
            lost = True
            continue
        lost = False
        head = {k: v.decode("utf-8", "replace") for k, v in zip(fields, parts)}
        block = stream.read(size)
        http, payload = split_http(block)
        yield {
            "uri": head["URL"], "ip": head["IP-address"], "captured": head["Archive-date"],
            "mime": head["Content-type"],
            "http": http, "payload": payload, "payload_bytes": len(payload), "payload_digest": base32_sha1(payload),
            "record_id": str(uuid.uuid5(_SPACE, f"{name}#{offset}")), "truncated": len(block) < size, "problem": None,
        }
    if stream.broken:
        yield _unread("gzip")


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of every record of a WARC file.

    A record whose length is no number has the field "problem" and an empty block; reading goes on at the next
    version line. A broken gzip member ends the file with such a record.
    """
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        fields: dict[str, str] = {}
        while line := stream.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        if (size := _number(fields.get("content-length"))) is None:
            yield fields | {"problem": "length"}, b""
            continue
        yield fields, stream.read(size)
    if stream.broken:
        yield {"problem": "gzip"}, b""


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).view(pa.string())


def _bounded(rows: Iterator[dict], size: int = 8 << 20) -> Iterator[list[dict]]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += len(r.get("payload", b"")) + 500
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def _relative(path: str, root: str) -> str:
    """The path below the root that is read, which names a file wherever the whole folder lies."""
    bare = root.split("://", 1)[-1].split(":", 1)[-1].rstrip("/") + "/"
    return path.split(bare, 1)[-1]


def _parse_arc(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for path, data in zip(b.column("path"), b.column("content")):
                for r in arc_records(_relative(path.as_py(), root), data.as_py()):
                    yield r | {"path": path.as_py()}

    strings = ("uri", "ip", "captured", "mime", "payload_digest", "record_id", "problem", "path")
    for held in _bounded(rows()):
        new = {k: pa.array([r[k] for r in held], pa.string()) for k in strings}
        new |= {k: _text([r[k] for r in held]) for k in ("http", "payload")}
        new["payload_bytes"] = pa.array([r["payload_bytes"] for r in held], pa.int64())
        new["truncated"] = pa.array([r["truncated"] for r in held], pa.bool_())
        yield pa.RecordBatch.from_pydict({k: new[k] for k in held[0]})


def _read_row(fields: dict[str, str], block: bytes) -> tuple:
    """The row of a WARC record in the order of READ."""
    http, payload = split_http(block)
    digest, size, problem = base32_sha1(payload), len(payload), fields.get("problem")
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        told = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        digest, size = declared, int(told[1]) if told else _number(fields.get("x-payload-length")) or 0
    elif declared and declared != digest:
        problem = problem or "digest"
    ids = (fields.get(k) for k in ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri"))
    return (*ids, http.decode("utf-8", "replace"), size, digest, problem)


def _parse_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for data in b.column("content"):
                for fields, block in warc_records(data.as_py()):
                    if "problem" in fields or fields.get("warc-type") in ("response", "resource", "revisit"):
                        yield {"row": _read_row(fields, block)}

    names = [c.split()[0] for c in READ.split(", ")]
    kinds = [pa.int64() if n == "payload_bytes" else pa.string() for n in names]
    for held in _bounded(rows()):
        columns = zip(*(r["row"] for r in held))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def write_arc(pages: DataFrame, path: str, captured: str = "20240101000000") -> None:
    """ARC files of pages(page_id, url, html), version 1 and 2 in turn, one record a row."""
    html, page_id = F.coalesce("html", F.lit("")), F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: "), page_id,
        F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    url = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), "[\\x00-\\x20]", "%20")
    size = (F.octet_length(http) + F.octet_length(html)).cast("string")
    second = F.spark_partition_id() % 2 == 1
    told = [url, F.lit("0.0.0.0"), F.lit(captured), F.lit("text/html")]
    more = [F.lit(x) for x in ("200", "-", "-", "0", "-")]
    line = F.when(second, F.concat_ws(" ", *told, *more, size)).otherwise(F.concat_ws(" ", *told, size))

    def block(version: str) -> str:
        body = f"{version} 0 mediapulse\n{' '.join(ARC_FIELDS[version])}\n"
        extra = "200 - - 0 part.arc " * (version == "2")
        return f"filedesc://part.arc 0.0.0.0 {captured} text/plain {extra}{len(body)}\n{body}\n"

    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lead = F.when(at % PER_FILE != 0, F.lit("")).when(second, F.lit(block("2"))).otherwise(F.lit(block("1")))
    rows = pages.select(F.concat(lead, line, F.lit("\n"), http, html).alias("value"))
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(path)


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Records of all ARC files under a path whose names match, of either version, gzipped or not."""
    return _files(spark, path, pattern).mapInArrow(partial(_parse_arc, path), PARSED)


def _field(name: str, value: str | None) -> bytes:
    return f"{name}: {value or ''}\r\n".encode()


def _iso(captured: str) -> str:
    return re.sub(r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", r"\1-\2-\3T\4:\5:\6Z", captured)


def warc_record(r: dict, again: dict | None) -> bytes:
    """The WARC record of an ARC record: a revisit of `again`, else a response, or a resource if it is no message."""
    body = r["http"] if again else r["http"] + r["payload"]
    head = [b"WARC/1.1\r\n", _field("WARC-Type", "revisit" if again else "response" if r["http"] else "resource")]
    head += [_field("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), _field("WARC-Date", _iso(r["captured"]))]
    head += [_field("WARC-Target-URI", r["uri"]), _field("WARC-IP-Address", r["ip"])]
    if again:
        head += [_field("WARC-Profile", REVISIT_PROFILE), _field("WARC-Refers-To", f"<urn:uuid:{again['to']}>")]
        head += [
            _field("WARC-Refers-To-Target-URI", again["uri"]), _field("WARC-Refers-To-Date", _iso(again["captured"]))
        ]
        head += [_field("X-Payload-Length", str(r["payload_bytes"]))]
    if r["truncated"]:
        head += [_field("WARC-Truncated", "unspecified")]
    mime = "application/http; msgtype=response" if r["http"] else r["mime"]
    head += [_field("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), _field("Content-Type", mime)]
    return b"".join([*head, _field("Content-Length", str(len(body))), b"\r\n", body])


def _convert(root: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WARC records of files, with the records that each file's revisits refer to."""

    def rows():
        for b in batches:
            for k in range(b.num_rows):
                path, again = b.column("path")[k].as_py(), {
                    r["record_id"]: r for r in b.column("again")[k].as_py() or ()
                }
                for r in arc_records(_relative(path, root), b.column("content")[k].as_py()):
                    if r["problem"] is None:
                        yield {"payload": warc_record(r, again.get(r["record_id"]))}

    for held in _bounded(rows()):
        yield pa.RecordBatch.from_arrays([_text([r["payload"] for r in held])], names=["value"])


def arc_to_warc(spark: SparkSession, arc: str, warc: str, order: str, least: int = 0, pattern: str = "*") -> DataFrame:
    """Convert the ARC files under `arc` into WARC files under `warc`; returns (problem, n) of what could not be read.

    Of records with equal payloads of at least `least` bytes the one with the largest value of the SQL
    expression `order` (over the parsed columns) becomes a response and the others revisits of it; ties fall
    to the largest record id. Header lines that do not fit the file's version are skipped; a record cut off
    by the file's end keeps what is there, marked as truncated. Empty archives give no records.

    A first reading gathers digests and identifiers only; the second one writes each file's records beside the list
    of its revisits. So no payload is ever shuffled, only the compressed files are.
    """
    every = read_arc(spark, arc, pattern).withColumn("ord", F.expr(order))
    narrow = ("path", "record_id", "uri", "captured", "payload_digest", "payload_bytes", "ord", "problem")
    every = written(every.select(*narrow), "records")
    problems = written(every.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n")), "problems")
    parsed = every.where((F.col("payload_bytes") >= least) & F.col("problem").isNull())
    best = F.max(F.struct("ord", "record_id", "uri", "captured")).alias("top")
    top = parsed.groupBy("payload_digest").agg(best, F.count("*").alias("copies")).where("copies > 1")
    later = parsed.select("path", "record_id", "payload_digest").join(top, "payload_digest").where(
        "record_id <> top.record_id"
    )
    told = F.struct("record_id", F.col("top.record_id").alias("to"), "top.uri", "top.captured")
    again = later.groupBy("path").agg(F.collect_list(told).alias("again"))
    rows = _files(spark, arc, pattern).join(again, "path", "left").select("path", "content", "again")
    out = rows.mapInArrow(partial(_convert, arc), "value string").write.option("lineSep", "\r\n\r\n")
    out.option("compression", "gzip").option("maxRecordsPerFile", PER_FILE).text(warc)
    discard(every)
    return problems


def read_warc(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The columns of READ for every response, resource and revisit; digests are computed again and compared."""
    return _files(spark, path, pattern).mapInArrow(_parse_warc, READ)


def page_archive(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Archive pages as ARC, convert to WARC, read back: one row per page with its digest and type.

    A null html is an empty payload, a null page_id stays null and counts as the smallest; repeated rows are
    records of their own, the later ones revisits. A very long html is one record like any other. Columns but
    page_id, url and html are ignored. An empty table gives an empty result. Records that do not come back as
    they were written raise an error.
    """
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType.simpleString()
    number = f"try_cast(nullif(regexp_extract(http, 'X-Page-Id: ([^\\\\r\\\\n]*)', 1), '') as {kind})"
    write_arc(pages, f"{folder}/arc")
    lost = arc_to_warc(spark, f"{folder}/arc", f"{folder}/warc", number, least)
    back = read_warc(spark, f"{folder}/warc").withColumn("page_id", F.expr(number))
    back = written(back.drop("http", "uri"), "warc_rows")
    bad = lost.select("problem").union(back.where("problem is not null").select("problem")).limit(1).collect()
    if bad:
        raise RuntimeError(f"the archives under {folder} have records with a wrong {bad[0].problem}")
    targets = back.where("record_type <> 'revisit'")
    targets = targets.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    found = back.join(targets, "refers_to_id", "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
