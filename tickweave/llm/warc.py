"""Deterministic sharded WARC writer and reader.

Pages are cut into parts, ranges of ids whose bounds come from exact byte counts, so
that parts don't depend on samples, tasks or the session. Records are sorted within
a part, written as gzip members, and rolled into a new file when the compressed size
passes a limit. A task writes to temporary names of its attempt and lists them in a
table that Spark commits as a whole; only listed files then get their final names,
in a step that can be repeated, and the manifest names them. A task that is run again
writes the same bytes.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import Scratch, ship_package, table

#: Compressed bytes after which a file is closed. Bytes of payload of a part: a 64th of all, within these bounds.
ROLL, LEAST_PART, LARGEST_PART = 32 << 20, 4 << 20, 256 << 20
#: Equal id ranges that are counted first, and that a heavy range is cut into; heavy ranges of a round at most.
RANGES, CUTS, HEAVY = 4096, 256, 1024
#: Groups of equal payloads up to which their table (about 60 bytes a row) is broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    """One record with its headers, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"))
    headers.append(("WARC-Block-Digest", f"sha1:{payload_digest(block)}"))
    if revisit:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(stream):
    """(headers, block) of each record of an uncompressed stream; a broken record raises."""
    while True:
        line = stream.readline()
        while line in (b"\r\n", b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("the archive is cut off")
        yield headers, block


def _store(uri: str):
    """File system and path of a URI; ``s3a`` and ``s3n`` are what Hadoop calls ``s3``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", uri))


class _Files:
    """Rolls the files of one part after another; ``rows`` has a line of each file."""

    def __init__(self, uri: str, attempt: int, roll: int):
        self.fs, self.root = _store(uri)
        self.attempt, self.roll, self.part = attempt, roll, None
        self.rows, self.out, self.number = [], None, 0

    def write(self, part: int, record: bytes) -> None:
        if part != self.part:
            self.close()
            self.part, self.number = part, 0
        if self.out is None:
            self.name = f"part-{part:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"_{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.count, self.sha = self.fs.open_output_stream(f"{self.root}/{self.temporary}"), 0, 0, hashlib.sha256()
        packer = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = packer.compress(record) + packer.flush()
        self.out.write(member)
        self.sha.update(member)
        self.size, self.count = self.size + len(member), self.count + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out, self.number = None, self.number + 1
            self.rows.append((self.name, self.part, self.count, self.size, self.sha.hexdigest(), self.temporary))


def _counted(sizes: DataFrame, starts: list[int]) -> list[int]:
    """Bytes of the ids in each of the ranges that begin at ``starts``; a number per range and task is shuffled."""

    def run(batches):
        edges, total = np.array(starts, np.int64), np.zeros(len(starts), np.int64)
        for batch in batches:
            at = np.searchsorted(edges, batch.column(0).to_numpy(), "right") - 1
            np.add.at(total, at, batch.column(1).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = [0] * len(starts)
    for r in sizes.select("page_id", "size").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out


def part_bounds(sizes: DataFrame, part: int | None) -> list[int]:
    """First ids of parts of about ``part`` bytes (by default a 64th of all, within bounds), from exact counts of (page_id, size).

    Equal ranges of ids are counted; heavy ones are cut and counted again, until they are
    light or hold one id. What comes to the driver is bounded by RANGES and, per round,
    HEAVY times CUTS numbers.
    """
    sizes = sizes.where("page_id is not null").select("page_id", F.col("size").cast("long").alias("size"))
    ends = sizes.agg(F.min("page_id").alias("a"), F.max("page_id").alias("z"), F.sum("size").alias("n")).first()
    if ends["a"] is None:
        return []
    part = part or min(LARGEST_PART, max(LEAST_PART, ends["n"] // 64))
    limit = max(part, ends["n"] // HEAVY)
    cut = lambda a, z, pieces: list(range(a, z, -(-(z - a) // pieces)))
    starts = cut(ends["a"], ends["z"] + 1, RANGES)
    while True:
        counts, out, again = _counted(sizes, starts), [], False
        held = part + 1
        for a, z, n in zip(starts, [*starts[1:], ends["z"] + 1], counts):
            if n > limit and z - a > 1:  # to be counted in smaller ranges
                out += cut(a, z, CUTS)
                again, held = True, part + 1
            elif held + n > part:
                out += cut(a, z, max(1, -(-n // part)))
                held = n if n <= part else part + 1
            else:
                held += n
        starts = out
        if not again:
            return starts


def classify(pages: DataFrame, scratch: Scratch, id_col="page_id", url_col="url", html_col="html", least: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with payload (page_id, url, payload, key), their sizes (page_id, key, size), and page_id, key, keep_id of rows that have equals.

    keep_id is the largest id with an equal payload. Equal means the same SHA-256 and
    length. Only payloads of at least ``least`` bytes are compared. Counts are
    pre-aggregated before the shuffle, and no payload is shuffled.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("key", F.concat(F.sha2("payload", 256), F.length("payload").cast("string")))
    sizes = scratch.write(rows.select("page_id", "key", F.length("payload").alias("size")), "sizes")
    groups = sizes.where(F.col("size") >= least).groupBy("key").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1 and keep_id is not null").drop("n")
    groups = scratch.write(groups, "groups")
    few = groups.count() <= BROADCAST_ROWS
    return rows, sizes, sizes.select("page_id", "key").join(F.broadcast(groups) if few else groups, "key").distinct()


def write_archives(pages: DataFrame, scratch: Scratch, roll: int = ROLL, part: int | None = None, **columns) -> tuple[DataFrame, str]:
    """Write a record per page; returns the manifest (file, part, records, bytes, sha256) and the folder's URI.

    A page whose payload equals that of a page with a larger id becomes a
    revisit record of the one with the largest id. Nulls: a null payload is
    empty; a null id or url leaves its header out, and a page without an id is a
    revisit if an equal page has one. Rows with the same largest id are all
    responses. An empty table gives an empty manifest. Whole payloads of any length are
    written, records one by one; a record larger than ``roll`` has a file of its own
    size. Other columns, whatever their names, aren't read.

    Payloads are shuffled once, by part; what is known of a page's equals is sorted
    before it and merged by the writer.
    """
    spark = pages.sparkSession
    ship_package(spark)
    uri = scratch.path("archives")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(hadoop)
    rows, sizes, equals = classify(pages, scratch, **columns)
    bounds = part_bounds(sizes, part)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(np.searchsorted(np.array(bounds, np.int64), ids.to_numpy(), "right") - 1, 0).astype(np.int32))

    first = F.coalesce("page_id", F.lit(-(1 << 63)))  # no id: first part
    both = rows.select("page_id", "key", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("keep_id"))
    known = equals.select("page_id", "key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "keep_id")
    both = both.union(known).withColumn("part", part_of(first))
    both = both.repartition(max(1, min(len(bounds), MOST_TASKS)), "part").sortWithinPartitions("part", "page_id", "key", "kind", "url")

    def run(batches):
        files, of, keep_id = _Files(uri, TaskContext.get().taskAttemptId(), roll), None, None
        for batch in batches:
            for number, page_id, key, kind, url, payload, keep in zip(*(batch.column(c) for c in ("part", "page_id", "key", "kind", "url", "payload", "keep_id"))):
                page_id, same = page_id.as_py(), (page_id.as_py(), key.as_py())
                if same != of:
                    of, keep_id = same, None
                if not kind.as_py():
                    keep_id = keep.as_py()
                else:
                    files.write(number.as_py(), build_record(page_id, url.as_py(), payload.as_py(), keep_id, keep_id is not None and keep_id != page_id))
        files.close()
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*files.rows)) or [[]] * 6, kinds)], MANIFEST)

    written = scratch.write(both.mapInArrow(run, "file string, part int, records long, bytes long, sha256 string, temporary string"), "written")

    def name(batches):
        store, root = _store(uri)
        for batch in batches:
            for old, new, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "file", "bytes"))):
                _rename(store, f"{root}/{old}", f"{root}/{new}", size)
            yield batch.select(MANIFEST[:-1])

    manifest = scratch.write(written.mapInArrow(name, "file string, part int, records long, bytes long, sha256 string"), "manifest")
    return manifest, uri


#: Columns of the table of written files; the manifest has all but the last.
MANIFEST = ["file", "part", "records", "bytes", "sha256", "temporary"]
#: Tasks that write at most; each writes several parts in turn if there are more.
MOST_TASKS = 20_000


def _rename(store, old: str, new: str, size: int) -> None:
    """Give a committed file its name; right also if it was done before, or begun by a task that was lost."""
    from pyarrow import fs

    there, temporary = store.get_file_info([new, old])
    if temporary.type == fs.FileType.NotFound:
        if there.type != fs.FileType.File or there.size != size:
            raise FileNotFoundError(f"neither {old} nor a whole {new}")
        return
    if there.type != fs.FileType.NotFound:
        store.delete_file(new)
    store.move(old, new)


def read_archives(manifest: DataFrame, uri: str, with_payload: bool = True) -> DataFrame:
    """A row per record of the files that a manifest lists; digests are checked while reading.

    Columns: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and, if asked for, payload (null for revisits). Files are read as streams.
    """
    spark = manifest.sparkSession
    ship_package(spark)
    files = manifest.select("file").repartition(max(1, min(manifest.count(), 20_000)), "file")
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields += [("payload", pa.binary())] if with_payload else []
    number = lambda x: None if x is None else int(x)

    def run(batches):
        store, root = _store(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for headers, block in parse_records(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
                            raise ValueError(f"{name}: payload and digest differ")
                        row = [number(headers.get("x-page-id")), headers.get("warc-target-uri"), size, digest, kind, number(headers.get("x-refers-to-page-id"))]
                        rows.append(row + [payload if kind == "response" else None] * with_payload)
                        held += len(payload) * with_payload + 200
                        if held > 4 << 20:
                            yield _batch(rows, fields)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, fields)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    return files.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))


def _batch(rows, fields) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages written as WARC files and read back."""
    manifest, uri = write_archives(table(spark, sf_dir, "pages"), Scratch(spark, "op9"))
    return read_archives(manifest, uri, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base-32 digits of a hexadecimal SHA-1 are 32 groups of five bits.
OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h FROM p
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS keep_id FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (((('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2))::BIGINT >> (3 - (5 * i) % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = keep_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep_id THEN keep_id END AS refers_to
FROM k
"""
