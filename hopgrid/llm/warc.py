"""WARC archives: writing with payload deduplication, and reading by boundary-chain verification.

Archives are uncompressed and roll over at ARCHIVE_BYTES. They go to the folder that all executors
share; a file's name holds the task attempt, and only files that finished attempts report are read,
so a lost or repeated task leaves no half-written archive in the result.

Reading splits archives into blocks. A task looks for the version line in its block, and for each
place that parses as a header follows the record lengths as far as the block goes: it gives the
offset where the chain leaves the block. Pointer jumping over those offsets from each file's start
(doubling the distance each round, over one row per possible block entry) leaves the real entry of
each block; only records on the chain are read. A version line inside a payload starts no chain.

Defined cases: null html is an empty payload; a null page id is less than any other (its record can
be a response if nothing else has the payload); equal rows are written and read as often as they
occur, those with the largest page id all as responses; url may be null or hold line ends, and one over
32 kB is written as its digest; an empty
table gives no rows; a chain that doesn't end at the file's end is an error.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopgrid.session import cut, shared_dir

ARCHIVE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
LEAST_DEDUP = 1000
#: Rows of (digest, page id) that go to every task; more are joined by exchange.
BROADCAST_ROWS = 100_000
MAGIC = b"WARC/1.1\r\n"
HEADER_BYTES = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to): refers_to is null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n_bytes"))
    large = rows.select("page_id", "digest", "n_bytes").filter(F.col("n_bytes") >= LEAST_DEDUP)
    kept = cut(large.groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep"))
    if kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        kept = F.broadcast(kept)
    joined = rows.join(kept, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))
    return joined.select("page_id", "url", "html", "digest", "n_bytes", refers.alias("refers_to"))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None) -> bytes:
    target = quote(url or "urn:page:none", safe=":/?#[]@!$&'()*+,;=%")
    if len(target) > HEADER_BYTES // 2:  # headers must fit the reader's window
        target = f"urn:sha1:{hashlib.sha1(target.encode()).hexdigest()}"
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "Payload-Length": str(len(body))}
    if page_id is not None:
        head["Page-Id"] = str(page_id)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + body
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "Refers-To-Page-Id": str(refers_to)}
        block = http
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return MAGIC + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write archives under `folder` (a new one in the shared folder by default); (file, size, n) of each."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        context = TaskContext.get()
        sink, name, size, n, k = None, "", 0, 0, 0
        done: list[tuple[str, int, int]] = []
        for rb in batches:
            for page_id, url, html, digest, refers in zip(*(rb.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if sink is None:
                    name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{k:04d}.warc"
                    sink, size, n, k = fs.open_output_stream(f"{base}/{name}"), 0, 0, k + 1
                raw = record(page_id, url, html, digest, refers)
                sink.write(raw)
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    sink.close()
                    done.append((name, size, n))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{d[0]}" for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "size", "n"])

    return cut(plan(pages).mapInArrow(run, "file string, size long, n long"))


def parse(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(header, first byte of the block, first byte after the record) of a record at data[at:]; None if it isn't one."""
    if not data.startswith(MAGIC, at):
        return None
    end = data.find(b"\r\n\r\n", at, at + HEADER_BYTES)
    if end < 0:
        return None
    head = {}
    for line in data[at + len(MAGIC) : end].split(b"\r\n"):
        k, sep, v = line.partition(b": ")
        if not sep:
            return None
        head[k.decode("latin-1")] = v.decode("latin-1")
    length = head.get("Content-Length", "")
    if not length.isdigit():
        return None
    return head, end + 4, end + 4 + int(length) + 4


def _blocks(archives: DataFrame, block: int) -> DataFrame:
    return archives.filter("size > 0").select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("start"))


def exits(archives: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, at, out): each candidate record, and where the chain from it leaves its block (-1: it breaks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            rows: list[tuple[str, int, int]] = []
            for file, size, start in zip(*(x.to_pylist() for x in rb.columns)):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as f:
                    data = f.read_at(min(block + HEADER_BYTES, size - start), start)
                found: dict[int, int] = {}
                at = data.find(MAGIC)
                while 0 <= at < block:
                    got = parse(data, at)
                    if got and start + got[2] <= size:
                        found[at] = got[2]
                    at = data.find(MAGIC, at + 1)
                last: dict[int, int] = {}
                for at in sorted(found, reverse=True):  # later candidates know their exit already
                    nxt = found[at]
                    last[at] = start + nxt if nxt >= block or start + nxt == size else last.get(nxt, -1)
                rows += [(file, start + at, out) for at, out in last.items()]
            cols = list(zip(*rows)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["file", "at", "out"])

    return _blocks(archives, block).repartition("file", "start").mapInArrow(run, "file string, at long, out long")


def entries(archives: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(file, at): where the chain of records from each file's start enters its blocks."""
    every = cut(exits(archives, block))
    targets = every.select("file", F.col("out").alias("at")).distinct()
    starts = archives.filter("size > 0").select("file", F.lit(0).cast("long").alias("at"))
    hops = cut(every.join(targets.union(starts).distinct(), ["file", "at"], "left_semi"))
    reached, n = cut(starts.join(hops.select("file", "at"), ["file", "at"], "left_semi")), -1
    while (now := reached.count()) != n:
        n = now
        step = reached.join(hops, ["file", "at"]).select("file", F.col("out").alias("at"))
        ends = archives.select("file", F.col("size").alias("at"))
        reached = cut(reached.union(step.join(ends, ["file", "at"], "left_anti")).distinct())
        far = hops.select("file", F.col("at").alias("out"), F.col("out").alias("far"))
        hops = cut(hops.join(far, ["file", "out"], "left").select("file", "at", F.coalesce("far", "out").alias("out")))
    return reached


def read(archives: DataFrame, block: int = BLOCK_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of every record on the chains.

    A response's size and digest are taken from the payload read; payload is null for revisits.
    """
    inside = entries(archives, block).join(archives.select("file", "size"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for file, at, size in zip(*(x.to_pylist() for x in rb.columns)):
                fs, path = pafs.FileSystem.from_uri(file)
                until = min(size, (at // block + 1) * block)
                rows = []
                with fs.open_input_file(path) as f:
                    data = f.read_at(min(until + HEADER_BYTES, size) - at, at)
                    pos = 0
                    while at + pos < until:
                        got = parse(data, pos)
                        if got is None:
                            raise ValueError(f"{file}: no record at {at + pos}")
                        head, first, end = got
                        if end > len(data):
                            data += f.read_at(end - len(data), at + len(data))
                        if len(data) < end or data[end - 4 : end] != b"\r\n\r\n":
                            raise ValueError(f"{file}: the record at {at + pos} is cut off")
                        revisit = head["WARC-Type"] == "revisit"
                        body = data[data.find(b"\r\n\r\n", first) + 4 : end - 4]
                        page = int(head["Page-Id"]) if "Page-Id" in head else None
                        if revisit:
                            rows.append((page, int(head["Payload-Length"]), head["WARC-Payload-Digest"][5:], "revisit", int(head["Refers-To-Page-Id"]), None))
                        else:
                            rows.append((page, len(body), hashlib.sha1(body).hexdigest(), "response", None, body))
                        pos = end
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return inside.select("file", "at", "size").repartition("file", "at").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def drop(archives: DataFrame) -> None:
    """Delete the archives' folder."""
    first = archives.select("file").first()
    if first:
        fs, path = pafs.FileSystem.from_uri(first["file"])
        fs.delete_dir(path.rpartition("/")[0])


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns of every page, written to archives and read back; the archives go afterwards."""
    archives = write(pages)
    back = cut(read(archives).drop("payload"))
    drop(archives)
    return back
