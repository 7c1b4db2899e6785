"""Web archives: pages as WARC records, a normaliser for monolithic gzip, and reading by offset.

An archive that was compressed as one stream can only be read from its start. ``normalise`` inflates such a stream once, writes every record
as a gzip member of its own, and a sidecar index of the members' offsets beside the archive. ``read_records`` then reads any part of any
archive in any task. Streams are read and written in pieces: what is held is a record's head and a piece of its block.

Archives are written by tasks under fresh names; those count that the index names, so a task that runs twice or is lost leaves
nothing but a file that no one reads. Paths are URIs that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from math import ceil
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import parts, ship, spool, unspool
from vicinal.sources.interim import delete
from vicinal.sources.interim import folder as fresh

#: Smaller payloads are never revisits.
LEAST_REVISIT = 1000
#: Bytes before compression after which a writer starts another archive, and compressed bytes that a reading task takes.
ROLL, READ = 256 << 20, 32 << 20
#: The longest head of a record, and the piece in which streams are read.
MOST_HEAD, PIECE = 1 << 20, 1 << 18
GZIP = 31
#: Pages have no time of their own.
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PRINTABLE = "".join(map(chr, range(0x21, 0x7F)))
_FILE = "path string, records long"
_INDEX = "path string, offset long, length long, record_type string, record_id string, error string"
_RECORD = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_sha1 string, stated_bytes long, stated_sha1 string, payload binary, error string"


class WarcError(ValueError):
    """Bytes that are no archive."""


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def _rows(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _head(first: str, fields: dict[str, str | None]) -> bytes:
    return "".join([first, "\r\n", *(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None), "\r\n"]).encode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit with its head alone."""
    http = _head("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=UTF-8", "Content-Length": str(len(payload))})
    block = http if revisit else http + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": quote(url, safe=_PRINTABLE) if url else None,
        "WARC-Profile": PROFILE if revisit else None, "WARC-Refers-To": record_id(refers_to) if revisit else None,
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def info_record() -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return _head("WARC/1.1", {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields", "Content-Length": str(len(block))}) + block + b"\r\n\r\n"


class Inflated:
    """The bytes behind a gzip stream of one member or several, a piece at a time."""

    def __init__(self, raw):
        self.raw, self.held, self.z, self.fed = raw, b"", None, b""

    def _more(self) -> bool:
        """Get another piece; false at a sound end."""
        while True:
            if not self.fed:
                self.fed = self.raw.read(PIECE)
                if not self.fed:
                    if self.z is not None:
                        raise WarcError("the gzip stream ends within a member")
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(GZIP)
            try:
                out = self.z.decompress(self.fed, PIECE)
            except zlib.error as e:
                raise WarcError(f"no sound gzip: {e}") from None
            self.fed = self.z.unconsumed_tail
            if self.z.eof:
                self.fed, self.z = self.z.unused_data, None
            if out:
                self.held += out
                return True

    def head(self) -> bytes | None:
        """Up to the first empty line, with it; None at the end. Line breaks before a record don't count."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            if self.held:
                break
            if not self._more():
                return None
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if len(self.held) > MOST_HEAD or not self._more():
                raise WarcError("a record's head has no end")
        out, self.held = self.held[: at + 4], self.held[at + 4 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self._more():
                raise WarcError("the archive ends within a record")
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def parse_head(head: bytes, first: str = r"WARC/\d\.\d") -> dict[str, str]:
    """Fields by lower-case name; a line that starts with a space carries on the one before it."""
    start, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace").removesuffix("\r\n\r\n")).split("\r\n")
    if not re.match(first, start):
        raise WarcError("no record where one should start")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _length(fields: dict[str, str]) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", n := fields.get("content-length", "")):
        raise WarcError("a record without its length")
    return int(n)


def _opened(path: str) -> tuple[pf.FileSystem, str]:
    return pf.FileSystem.from_uri(path)


def write_monolith(batches: Iterator[pa.RecordBatch], folder: str, roll: int = ROLL) -> Iterator[pa.RecordBatch]:
    """Archives of (page_id, url, html, refers_to, is_revisit), each one gzip stream from end to end."""
    path = out = z = None
    size = n = 0
    for b in parts(batches, 2):
        for page, url, html, refers, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if out is None:
                path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                fs, at = _opened(path)
                out, z = fs.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, GZIP)  # it is inflated once and goes
                out.write(z.compress(info_record()))
            record = page_record(page, url, (html or "").encode(), refers, revisit)
            out.write(z.compress(record))
            size, n = size + len(record), n + 1
            if size >= roll:
                out.write(z.flush())
                out.close()
                out = None
                yield _rows([(path, n)], _FILE)
    if out is not None:
        out.write(z.flush())
        out.close()
        yield _rows([(path, n)], _FILE)


def normalise_archive(path: str, target: str) -> Iterator[tuple]:
    """Rewrite the archive at ``path`` as ``target``, a member for each record, and ``target``.idx, a line of JSON for each; gives the rows of the index.

    A stream that is not sound gives a last row with the error; the whole records before it are kept. A file that can't be read or written ends the task.
    """
    (fs, at), (to_fs, to) = _opened(path), _opened(target)
    with to_fs.open_output_stream(to, compression=None) as out, to_fs.open_output_stream(f"{to}.idx", compression=None) as idx:
        offset = 0
        try:
            with fs.open_input_stream(at, compression=None) as raw:
                stream = Inflated(raw)
                while (head := stream.head()) is not None:
                    fields = parse_head(head)
                    z, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), 0
                    size += out.write(z.compress(head))
                    for piece in stream.take(_length(fields)):
                        size += out.write(z.compress(piece))
                    size += out.write(z.compress(b"\r\n\r\n") + z.flush())
                    row = {"offset": offset, "length": size, "type": fields.get("warc-type"), "id": fields.get("warc-record-id")}
                    idx.write(json.dumps(row).encode() + b"\n")
                    yield (target, *row.values(), None)
                    offset += size
        except WarcError as e:
            yield (target, None, None, None, None, f"{path}: {e}")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """The index (path, offset, length, record_type, record_id, error) of the archives at ``path``, rewritten into ``folder``. An archive is a task's, as a gzip stream has to be."""

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for path in b.column(0).to_pylist():
                for row in normalise_archive(path, f"{folder}/{uuid.uuid4().hex}.warc.gz"):
                    rows.append(row)
                    if len(rows) == 4096:
                        yield _rows(rows, _INDEX)
                        rows = []
        yield _rows(rows, _INDEX)

    paths = archives.select("path")
    return spool(paths.repartition(max(1, paths.count())).mapInArrow(rewritten, _INDEX), "offsets")


def read_sidecars(paths: DataFrame) -> DataFrame:
    """The index again, from the sidecars of the normalised archives at ``path``."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, at = _opened(f"{path}.idx")
                with fs.open_input_stream(at, compression=None) as f:
                    rest, end = b"", False
                    while not end:
                        end = not (piece := f.read(PIECE))
                        *whole, rest = (rest + piece).split(b"\n")
                        if whole:
                            yield _rows([(path, x["offset"], x["length"], x["type"], x["id"], None) for x in map(json.loads, whole)], _INDEX)

    return paths.select("path").mapInArrow(lines, _INDEX)


def parse_record(member: bytes, payload: bool = True) -> tuple:
    """A row of ``read_records`` from a gzip member. Of HTTP messages the body is the payload, of other records the block."""

    class Held:
        def __init__(self):
            self.left = member

        def read(self, n: int) -> bytes:
            out, self.left = self.left[:n], self.left[n:]
            return out

    stream = Inflated(Held())
    if (head := stream.head()) is None:
        raise WarcError("an empty member")
    fields = parse_head(head)
    body = b"".join(stream.take(_length(fields)))
    said = None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, body = body.partition(b"\r\n\r\n")
        said = parse_head(http + b"\r\n\r\n", r"HTTP/").get("content-length")
    digest = re.fullmatch(r"sha1:([A-Z2-7]{32})", fields.get("warc-payload-digest", ""))
    return (
        fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), len(body), hashlib.sha1(body).hexdigest(),
        int(said) if said and re.fullmatch(r"[0-9]{1,18}", said) else None, base64.b32decode(digest[1]).hex() if digest else None, body if payload else None, None,
    )


def _read(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    path, f, held, start, rows, size = None, None, b"", 0, [], 0
    for b in batches:
        for p, offset, length in zip(*(b.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
            if p != path:
                if f is not None:
                    f.close()
                fs, at = _opened(p)
                path, f, held, start = p, fs.open_input_file(at), b"", 0
            if not start <= offset <= offset + length <= start + len(held):
                held, start = bytes(f.read_at(max(length, 16 * PIECE), offset)), offset
            try:
                rows.append(parse_record(held[offset - start : offset - start + length], payload))
            except WarcError as e:
                rows.append((None,) * 9 + (f"{p} at {offset}: {e}",))
            size += len(rows[-1][8] or b"") + 300
            if size >= 4 * PIECE:
                yield _rows(rows, _RECORD)
                rows, size = [], 0
    if f is not None:
        f.close()
    yield _rows(rows, _RECORD)


def read_records(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records by their offsets; tasks share an archive's ranges of 32 MB. A member that is no record has an ``error`` and nulls."""
    d = index.filter("error is null").select("path", "offset", "length")
    n = d.agg(F.sum("length")).first()[0] or 0
    tasks = max(2 * index.sparkSession.sparkContext.defaultParallelism, ceil(n / READ))
    d = d.repartition(tasks, "path", F.shiftright("offset", 22)).sortWithinPartitions("path", "offset")
    return d.mapInArrow(lambda it: _read(it, payload), _RECORD)


def plan_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, refers_to, is_revisit): of equal payloads of ``least`` bytes or more, all but that of the largest page_id revisit it.

    Rows that share the largest page_id are responses all; a null page_id is below any other. Equal means an equal SHA-256.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("_same", F.when(F.octet_length("html") >= least, F.sha2("html", 256)))
    many = p.filter("_same is not null").groupBy("_same").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    later = F.coalesce(F.col("_last") > F.col("page_id"), F.col("_last").isNotNull() & F.col("page_id").isNull())
    d = p.join(many, "_same", "left").withColumn("is_revisit", later)
    return d.select("page_id", "url", "html", F.when(F.col("is_revisit"), F.col("_last")).alias("refers_to"), "is_revisit")


def write_archives(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """(index, folder): ``pages`` (page_id, url, html) as normalised archives in ``folder``, one of the shared ones unless given.

    They are written as monolithic streams first, which then go. Null html is an empty payload; a null url is left out; control characters and
    spaces in urls are percent-encoded; repeated rows are repeated records; an empty table gives no archive.
    """
    spark = pages.sparkSession
    raw = fresh(spark, "monoliths", make=True)
    folder = folder or fresh(spark, "archives", make=True)
    files = spool(plan_revisits(pages).mapInArrow(lambda it: write_monolith(it, raw), _FILE), "files")
    index = normalise(files, folder)
    wrote, broken = files.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0], index.filter("error is not null").select("error").take(1)
    kept = index.filter(F.col("record_type").isin("response", "revisit")).count()
    if broken or kept != wrote:  # these archives are ours: what is lost here is no result
        raise WarcError(broken[0]["error"] if broken else f"{wrote} records were written, {kept} are in the index")
    unspool(files)
    delete(spark, raw)
    return index, folder


def page_of(column: str) -> Column:
    """The page_id in a record id."""
    return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages' records, those of revisits from the response that they refer to.

    A record that can't be read, or whose payload isn't what its head says, ends the job.
    """
    ours = F.col("record_type").isin("response", "revisit")
    wrong = F.col("error").isNotNull() | (F.col("record_type") == "response") & ~(F.col("payload_sha1").eqNullSafe(F.col("stated_sha1")) & F.col("payload_bytes").eqNullSafe(F.col("stated_bytes")))
    r = records.filter(ours | F.col("error").isNotNull())
    r = r.select(F.when(wrong, F.raise_error(F.coalesce("error", F.concat(F.lit("payload and head differ: "), "record_id"))).cast("string")).otherwise(F.col("record_type")).alias("record_type"), page_of("record_id").alias("page_id"), "refers_to", "payload_bytes", "payload_sha1", "stated_bytes", "stated_sha1")
    r = spool(r, "records")
    first = r.filter("record_type = 'response'").select("page_id", "payload_bytes", F.col("payload_sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = r.filter("record_type = 'revisit'").select("page_id", page_of("refers_to").alias("refers_to"), "record_type", "stated_bytes", "stated_sha1")
    full = first.select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").distinct()
    same = [again["refers_to"] == full["refers_to"], again["stated_sha1"] == full["payload_digest"], again["stated_bytes"] == full["payload_bytes"]]
    lost = F.raise_error(F.concat(F.lit("no such response: "), again["refers_to"].cast("string"))).cast("string")
    again = again.join(full, same, "left").select("page_id", "payload_bytes", "payload_digest", F.when(F.col("payload_digest").isNotNull(), F.col("record_type")).otherwise(lost).alias("record_type"), again["refers_to"])
    return first.unionByName(again)


ship(__name__)
