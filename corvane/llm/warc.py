"""WARC archives with a two-level capture index."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import materialize, scratch_path

#: Lines of a block of the index, and bytes of payload from which copies are revisits.
BLOCK_LINES, LEAST_REVISIT = 256, 100
_DIRECTORY = "first_key string, block_file string, block_offset long, block_length long, lines long"


def surt(url: str | None) -> str:
    """The key that ``_surt_column`` gives a URL, by that same expression."""
    return SparkSession.active().range(1).select(_surt_column(F.lit(url).cast("string"))).first()[0]


def _surt_column(url: Column) -> Column:
    """A key that sorts the pages of a host together: the host's labels reversed, then path and query; scheme, ``www.``, port, fragment and blanks at either end do not count.

    What is no usual URL has an empty host and all of it as path; only the order and the reading of it matter to the index.
    """
    line = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")  # as index lines hold it
    bare = F.regexp_replace(F.regexp_replace(line, r"#.*$", ""), r"^\s+|\s+$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?(?:[wW]{3}\.)?([^/:?]*)", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def _record(kind: str, url: str, page: str, row: int, digest: str, length: int, payload: bytes, refers: str | None) -> bytes:
    """One WARC/1.1 record as a gzip member of its own: an HTTP response with the payload, or, of a revisit, its header alone. Rows have ids of their own, copies too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row} {page} {url} {digest}')}>", "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {_one_line(page)}", f"X-Payload-Length: {length}",
        *([] if refers is None else [f"X-Refers-To-Page: {_one_line(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}", "", "",
    ]
    return gzip.compress("\r\n".join(head).encode() + http + payload + b"\r\n\r\n", compresslevel=4, mtime=0)


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (first line under '') and payload of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {"": first} | dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


class _Sink:
    """A file under a task's own name; it counts only once its rows are committed, so a lost or repeated task does no harm."""

    def __init__(self, path: str) -> None:
        self.path, self.at = path, 0
        fs, inner = _open(path)
        self.out = fs.open_output_stream(inner, compression=None)

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)


def _write_partition(folder: str) -> object:
    """Writes rows that come in key order: a WARC file, and its index lines in compressed blocks; yields the blocks' directory."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        warc = blocks = None
        lines: list[bytes] = []
        first = ""
        told: list[tuple] = []

        def close_block() -> None:
            packed = zlib.compress(b"".join(lines), 6)
            told.append((first, blocks.path, blocks.add(packed), len(packed), len(lines)))
            lines.clear()

        for batch in batches:
            if warc is None and len(batch):
                context = TaskContext.get()
                name = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}"
                warc, blocks = _Sink(f"{name}.warc.gz"), _Sink(f"{name}.cdx.z")
            for key, page, row, url, kind, digest, length, payload, refers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                member = _record(kind, url or "", "" if page is None else str(page), row, digest, length, payload or b"", None if refers is None else str(refers))
                at = warc.add(member)
                if not lines:
                    first = key
                lines.append(f"{_one_line(key)}\t{warc.path}\t{at}\t{len(member)}\n".encode())
                if len(lines) == BLOCK_LINES:
                    close_block()
        if warc is not None:
            if lines:
                close_block()
            warc.out.close()
            blocks.out.close()
        columns = list(zip(*told, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["first_key", "block_file", "block_offset", "block_length", "lines"])

    return write


def write_archives(pages: DataFrame, folder: str | None = None, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Write a WARC record for each row and return the index's sparse directory, one row a block of 256 captures.

    Of rows with equal payloads of at least ``least`` bytes (equal lengths and SHA-256) that of the smallest id is a
    response with the payload and the others revisit it, without. Records lie in the order of their keys, reversed host
    first; index lines (key, file, offset, length) lie in compressed blocks beside them. A host's keys go on with path and
    page, so a hot host spreads over many files.

    A null payload is empty, a null url has the empty host; a row with a null id is always a response; of rows that repeat
    in id and payload the first is the response; an empty table gives an empty directory; other columns are not read.
    ``pages`` is read twice and must give its rows in the same order.
    """
    folder = folder or scratch_path(pages.sparkSession, "warc")
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    digest, row = F.sha2(payload, 256).alias("_cv_digest"), F.monotonically_increasing_id().alias("_cv_rid")
    rows = pages.select(F.col(id_col).alias("_cv_id"), row, F.col(url_col).alias("_cv_url"), payload.alias("_cv_payload"), digest, F.octet_length(payload).cast("long").alias("_cv_length"))
    narrow = pages.select(F.struct(F.col(id_col).alias("id"), row.alias("row")).alias("i"), digest, F.octet_length(payload).alias("n")).where((F.col("n") >= least) & F.col("i.id").isNotNull())
    firsts = narrow.groupBy("_cv_digest").agg(F.min("i").alias("_cv_first"), F.count("*").alias("c")).where("c > 1").select("_cv_digest", "_cv_first")
    firsts = materialize(firsts, "warc-firsts")  # its size in files decides how it is joined
    rows = rows.join(firsts, "_cv_digest", "left").withColumn("_cv_key", _surt_column(F.col("_cv_url")))
    again = F.coalesce(F.struct(F.col("_cv_id").alias("id"), F.col("_cv_rid").alias("row")) > F.col("_cv_first"), F.lit(False)) & F.col("_cv_id").isNotNull()
    rows = rows.select(
        "_cv_key", "_cv_id", "_cv_rid", "_cv_url", F.when(again, "revisit").otherwise("response").alias("kind"), "_cv_digest", "_cv_length",
        F.when(~again, F.col("_cv_payload").cast("binary")).alias("payload"), F.when(again, F.col("_cv_first.id")).alias("refers"),
    )
    ordered = rows.repartitionByRange("_cv_key", "_cv_id").sortWithinPartitions("_cv_key", "_cv_id")
    return materialize(ordered.mapInArrow(_write_partition(folder), _DIRECTORY), "warc-directory")


def _range(handles: dict, path: str, offset: int, length: int) -> bytes:
    if path not in handles:
        if len(handles) > 8:
            handles.pop(next(iter(handles))).close()
        fs, inner = _open(path)
        handles[path] = fs.open_input_file(inner)
    return handles[path].read_at(length, offset)


def _lines(handles: dict, block_file: str, offset: int, length: int) -> list[tuple[str, str, int, int]]:
    raw = zlib.decompress(_range(handles, block_file, offset, length)).decode()
    return [(k, f, int(a), int(n)) for k, f, a, n in (x.rsplit("\t", 3) for x in raw.split("\n")[:-1])]


def read_archives(directory: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Every capture of an index, or of the keys that ``locate`` found in it, by range reads through its blocks: key, page_id, payload_bytes, payload_digest, record_type, refers_to, payload.

    The digest and length of a response are taken from the payload that was read, and must be those in its header; a
    revisit carries those of the payload it refers to. An empty directory gives no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handles: dict = {}
        for batch in batches:
            for block_file, offset, length, keys in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                out: list[tuple] = []
                wanted = None if keys is None else set(keys)
                for key, path, at, n in _lines(handles, block_file, offset, length):
                    if wanted is not None and key not in wanted:
                        continue
                    fields, payload = parse_record(_range(handles, path, at, n))
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"])
                    if fields["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != size):
                        raise ValueError(f"damaged record at {at} of {path}")
                    out.append((key, fields["X-Page-ID"] or None, size, digest, fields["WARC-Type"], fields.get("X-Refers-To-Page"), payload))
                columns = list(zip(*out, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(columns[k], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()))], ["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    keys = F.col("keys") if "keys" in directory.columns else F.lit(None).cast("array<string>").alias("keys")
    spread = directory.select("block_file", "block_offset", "block_length", keys).repartition(F.col("block_file"), F.col("block_offset"))
    found = spread.mapInArrow(read, "key string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, payload binary")
    return found.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def _spanned(firsts: list[str], key: str) -> range:
    """Which of the pieces that begin with ``firsts``, in order, may hold a key: by binary search, that before the first one to begin with it or later, and all that begin with it."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


def locate(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """The blocks of an index that may hold any of the keys (column key), each with those keys.

    Two binary searches: among the archive files by their first keys (one a file, as many as tasks wrote them, is what
    the driver and all tasks hold), then, file by file, in its part of the sparse directory. A key that fills many blocks
    or files is sought in each of them by tasks of their own. Null keys are left out; an empty directory has no blocks.
    """
    starts = sorted((r["k"], r["block_file"]) for r in directory.groupBy("block_file").agg(F.min("first_key").alias("k")).collect())
    fences, files = [k for k, _ in starts], [f for _, f in starts]

    def to_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(key, files[i]) for key in batch.column(0).to_pylist() for i in _spanned(fences, key)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["key", "block_file"])

    def to_blocks(wanted: pa.Table, blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by([("first_key", "ascending"), ("block_offset", "ascending")])
        firsts, by = blocks["first_key"].to_pylist(), {}
        for key in wanted["key"].to_pylist():
            for i in _spanned(firsts, key) if firsts else ():
                by.setdefault(i, []).append(key)
        taken = blocks.select(["block_file", "block_offset", "block_length"]).take(list(by)) if by else blocks.select(["block_file", "block_offset", "block_length"]).slice(0, 0)
        return taken.append_column("keys", pa.array(list(by.values()), pa.list_(pa.string())))

    sought = keys.where(F.col("key").isNotNull()).select("key").distinct().mapInArrow(to_files, "key string, block_file string")
    return sought.groupBy("block_file").cogroup(directory.groupBy("block_file")).applyInArrow(to_blocks, "block_file string, block_offset long, block_length long, keys array<string>")


@dataclass
class CaptureIndex:
    """Looks single URLs up: the sparse directory, in key order, is searched by halves, and only the blocks that may hold the key are read."""

    keys: list[str]
    blocks: list[tuple[str, int, int]]

    @classmethod
    def load(cls, directory: DataFrame) -> CaptureIndex:
        """The directory alone is read: a row for each 256 captures."""
        rows = directory.orderBy("first_key", "block_file", "block_offset").collect()
        return cls([r["first_key"] for r in rows], [(r["block_file"], r["block_offset"], r["block_length"]) for r in rows])

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL, headers and payload."""
        key, handles, out = surt(url), {}, []
        for at in _spanned(self.keys, key) if self.keys else ():
            out += [parse_record(_range(handles, path, start, n)) for k, path, start, n in _lines(handles, *self.blocks[at]) if k == key]
        return out


def records_of(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of a whole archive file, front to back, without an index."""
    source = io.BytesIO(data)
    rest = source.read()
    while rest:
        d = zlib.decompressobj(31)
        raw = d.decompress(rest) + d.flush()
        used = len(rest) - len(d.unused_data)
        yield parse_record(rest[:used])
        rest = d.unused_data
        del raw


def archive_pages(spark: SparkSession, pages: DataFrame, *, url_col: str = "url", **how: object) -> DataFrame:
    """Write ``pages``, then look every page's key up in the index and read the captures back."""
    directory = write_archives(pages, url_col=url_col, **how)
    return read_archives(locate(directory, pages.select(_surt_column(F.col(url_col)).alias("key"))), dict(pages.dtypes)[how.get("id_col", "page_id")])
