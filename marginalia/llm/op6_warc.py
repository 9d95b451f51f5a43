r"""WARC archives of pages and a two-level index over their captures.

Writing: every page becomes a WARC/1.1 record; of equal payloads of at least `least` bytes the one with
the largest page_id is a response and the others are revisits that refer to it. The records are rows of
a text table whose line separator is the record separator, so Spark's own writer (and its commit
protocol, on any file system Spark can reach) produces the archives. A file ends with the record that
brings it to `file_bytes`.

Index: a capture's key is its URL with the host reversed (com,example)/path. Captures are range-sorted by
key, cut into blocks of `lines` lines, each block compressed and stored with its number; the sparse
directory, a table of its own, has the first and last key of each block. `CaptureIndex.lookup` (one URL)
and `CaptureIndex.find` (a table of URLs) bisect the directory, open the blocks that can hold a key and
bisect their lines; records are then read by file, offset and length, neighbouring ones in one range. A
directory too large to broadcast is met by a join of keys instead, and where the executors' Python can't
open the archives' file system, Spark reads the files and the same ranges are cut from them.

A revisit's size and digest are those of the response's payload as read; one whose response isn't there, or
has another digest than the revisit states, has null for both.

Defined cases: a null html is an empty payload; a null url is indexed under the empty key; null
page_ids sort lowest; rows with the same page_id and payload as the response are responses too (and bear
the same record id); an empty table writes no records and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from functools import cached_property
from hashlib import sha1
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.common import BROADCAST_ROWS, join_hot, scratch, small, stash
from marginalia.session import shared_dir

LEAST, FILE_BYTES, LINES = 1000, 16_000_000, 3000
#: Bytes of neighbouring records that one range read fetches at most (a longer record is a range of its own).
RANGE = 4_000_000
END = "\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
_length = re.compile(rb"\r\nContent-Length: (\d+)\r\n\r\n")


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, ')', then path and query, all in lower case; no scheme, port 80/443 or fragment."""
    if not url:
        return ""
    parts = urlsplit(url if "//" in url else "//" + url)
    try:
        host, port = parts.hostname or "", parts.port
    except ValueError:
        host, port = parts.netloc.lower(), None
    host = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def pages_with_roles(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload (text), size, digest, record_type and refers_to of every page."""
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
    seen = base.where(F.col("size") >= least).groupBy(F.col("digest").alias("_d"), F.col("size").alias("_s")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = base.join(small(stash(seen, "copies")), (F.col("digest") == F.col("_d")) & (F.col("size") == F.col("_s")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "size", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """One WARC record per page under `path`; the files hold about file_bytes each."""
    rows = pages_with_roles(pages, least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
    opt = lambda name, value: F.coalesce(line(name, value), F.lit(""))
    safe = F.regexp_replace("url", r"[\r\n]", "")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"))), opt("WARC-Target-URI", safe), line("WARC-Date", F.lit(DATE)),
        opt("X-Page-Id", F.col("page_id")), opt("WARC-Refers-To", F.when(F.col("record_type") == "revisit", name(F.col("refers_to")))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("record_type") == "revisit", line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body)), F.lit("\r\n"), body,
    ).alias("value")

    def cut(batches):
        done = 0
        for b in batches:
            ends = pc.add(pc.cumulative_sum(pc.add(pc.binary_length(b.column("value")).cast(pa.int64()), len(END))), done)
            starts = pc.subtract(ends, pc.add(pc.binary_length(b.column("value")).cast(pa.int64()), len(END)))
            done = ends[-1].as_py() if len(ends) else done
            yield pa.RecordBatch.from_arrays([b.column("value"), pc.divide(starts, file_bytes)], names=["value", "cut"])

    rows.select(record).mapInArrow(cut, "value string, cut bigint").write.partitionBy("cut").option("lineSep", END).text(path)


def _header(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)


def records(data: bytes):
    """(offset, length, header, payload) of every record of an archive."""
    at = 0
    while at < len(data):
        m = _length.search(data, at)
        if m is None or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = m.end() + int(m[1])
        yield at, end - at, _header(data[at : m.end() - 4]), data[m.end() : end]
        at = end + len(END)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


_CAPTURE = "key string, page_id {kind}, file string, at bigint, length bigint"


def captures(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """key, page_id, file, at and length of every record under `path`, read from the archives."""

    def of(batches):
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                got = [(_escaped(url_key(h.get("WARC-Target-URI"))), h.get("X-Page-Id"), file, at, n) for at, n, h, _ in records(data)]
                if got:
                    key, page, file_, at, n = zip(*got)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(page, pa.string()), pa.array(file_), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "page_id", "file", "at", "length"])

    return _files(spark, path).mapInArrow(of, _CAPTURE.format(kind="string")).withColumn("page_id", F.col("page_id").cast(kind))


def _escaped(key: str) -> str:
    return key.replace("\t", "%09").replace("\n", "%0a")


class CaptureIndex:
    """The index under `path`: blocks of compressed capture lines and the sparse directory over them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, spark: SparkSession, archives: str, path: str, kind: str = "bigint", lines: int = LINES) -> CaptureIndex:
        def pack(batches):
            held: list[tuple[str, str]] = []

            def block(some):
                text = "\n".join(x for _, x in some).encode()
                return pa.RecordBatch.from_arrays([pa.array([some[0][0]]), pa.array([some[-1][0]]), pa.array([len(some)], pa.int32()), pa.array([zlib.compress(text, 6)], pa.binary())], names=["first_key", "last_key", "n", "block"])

            for b in batches:
                cols = (b.column(c).to_pylist() for c in ("key", "page_id", "file", "at", "length"))
                held += [(k, "\t".join((_escaped(k), "" if p is None else str(p), f, str(a), str(n)))) for k, p, f, a, n in zip(*cols)]
                while len(held) >= lines:
                    yield block(held[:lines])
                    del held[:lines]
            if held:
                yield block(held)

        found = captures(spark, archives, kind).repartitionByRange("key", "file", "at").sortWithinPartitions("key", "file", "at")
        blocks = found.mapInArrow(pack, "first_key string, last_key string, n int, block binary")
        blocks.select(F.monotonically_increasing_id().alias("number"), "*").write.parquet(f"{path}/blocks")
        spark.read.parquet(f"{path}/blocks").select("number", "first_key", "last_key").write.parquet(f"{path}/directory")
        return cls(spark, path)

    @property
    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    @cached_property
    def directory(self) -> tuple[list[str], list[str], list[int]] | None:
        """First keys, last keys and numbers of the blocks in order; None if they are too many for one machine."""
        table = self.spark.read.parquet(f"{self.path}/directory")
        if table.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
            return None
        rows = sorted((r["first_key"], r["last_key"], r["number"]) for r in table.collect())
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]

    def captures(self, kind: str = "bigint") -> DataFrame:
        """Every capture line of every block."""

        def unpack(batches):
            for b in batches:
                for raw in b.column("block").to_pylist():
                    rows = [x.split("\t") for x in zlib.decompress(raw).decode().split("\n")]
                    key, page, file, at, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([p or None for p in page], pa.string()), pa.array(file), pa.array(list(map(int, at)), pa.int64()), pa.array(list(map(int, n)), pa.int64())], names=["key", "page_id", "file", "at", "length"])

        return self.blocks.select("block").mapInArrow(unpack, _CAPTURE.format(kind="string")).withColumn("page_id", F.col("page_id").cast(kind))

    def find(self, urls: DataFrame, kind: str = "bigint") -> DataFrame:
        """The captures of all URLs of a table (url), each once: the directory is bisected, then the lines of the blocks."""

        def keys(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string())], names=["key"])

        wanted = urls.select(F.col("url").cast("string").alias("url")).distinct().mapInArrow(keys, "key string").distinct()
        known = self.directory
        if known is None:
            return self.captures(kind).join(wanted, "key", "left_semi")

        def place(batches):
            firsts, lasts, numbers = known
            for b in batches:
                key = b.column("key").to_pylist()
                spans = [(bisect_left(lasts, k), bisect_right(firsts, k)) for k in key]
                some = [(k, numbers[i]) for k, (a, z) in zip(key, spans) for i in range(a, z)]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["key", "number"])

        def search(batches):
            for b in batches:
                rows = []
                for raw, own in zip(b.column("block").to_pylist(), b.column("keys").to_pylist()):
                    lines = zlib.decompress(raw).decode().split("\n")
                    names = [x.split("\t", 1)[0] for x in lines]
                    for k in own:
                        k = _escaped(k)
                        rows += [x.split("\t") for x in lines[bisect_left(names, k) : bisect_right(names, k)]]
                cols = list(zip(*rows)) or [()] * 5
                types = ((0, pa.string(), str), (1, pa.string(), lambda p: p or None), (2, pa.string(), str), (3, pa.int64(), int), (4, pa.int64(), int))
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in cols[n]], t) for n, t, f in types], names=["key", "page_id", "file", "at", "length"])

        hit = wanted.mapInArrow(place, "key string, number bigint").groupBy("number").agg(F.collect_list("key").alias("keys"))
        found = self.blocks.select("number", "block").join(hit, "number").select("block", "keys").mapInArrow(search, _CAPTURE.format(kind="string"))
        return found.withColumn("page_id", F.col("page_id").cast(kind))

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Header and payload of each capture of a URL: bisect the directory, then the blocks' lines, then range reads."""
        found = self.find(self.spark.createDataFrame([(url,)], "url string")).orderBy("file", "at").collect()
        return [next(records(self._read(r["file"], r["at"], r["length"])))[2:] for r in found]

    def _read(self, file: str, at: int, length: int) -> bytes:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(file)
        stream = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
        finally:
            stream.close()


def _reachable(uri: str) -> bool:
    """Whether Python can open the file system of a path."""
    try:
        _opened(uri)
    except Exception:  # noqa: BLE001 (an unknown scheme, a library that isn't there, ...)
        return False
    return True


def _opened(uri: str):
    system, path = FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")
    return system.open_input_file(path)


_READ = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def _described(raws) -> pa.RecordBatch:
    """A row of _READ for each record."""
    got = []
    for raw in raws:
        _, _, h, payload = next(records(raw))
        whole = h["WARC-Type"] == "response"
        refers = h.get("WARC-Refers-To", "").removeprefix("<urn:page:").removesuffix(">")
        digest = sha1(payload).hexdigest() if whole else h["WARC-Payload-Digest"].removeprefix("sha1:")
        got.append((h.get("X-Page-Id"), len(payload) if whole else None, digest, h["WARC-Type"], None if refers in ("", "null") else refers))
    cols = list(zip(*got)) or [()] * 5
    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_records(spark: SparkSession, archives: str, found: DataFrame) -> DataFrame:
    """The records that captures point at (file, at, length), as rows of _READ; a revisit's size is null."""

    def ranges(batches):
        name, stream = None, None
        for b in batches:
            rows, raws, i = list(zip(*(b.column(c).to_pylist() for c in ("file", "at", "length")))), [], 0
            while i < len(rows):
                file, at, length = rows[i]
                j, end = i + 1, at + length
                while j < len(rows) and rows[j][0] == file and rows[j][1] + rows[j][2] - at <= RANGE:
                    end = max(end, rows[j][1] + rows[j][2])
                    j += 1
                if file != name:
                    name, stream = file, _opened(file)
                data = stream.read_at(end - at, at)
                raws += [data[a - at : a - at + n] for _, a, n in rows[i:j]]
                if sum(map(len, raws)) > RANGE:
                    yield _described(raws)
                    raws = []
                i = j
            yield _described(raws)

    def cuts(batches):
        for b in batches:
            for data, places in zip(b.column("content").to_pylist(), b.column("places").to_pylist()):
                yield _described(data[p["at"] : p["at"] + p["length"]] for p in places)

    first = found.select("file").first()
    if first is None or _reachable(first["file"]):
        return found.select("file", "at", "length").repartition("file").sortWithinPartitions("file", "at").mapInArrow(ranges, _READ)
    places = found.groupBy("file").agg(F.collect_list(F.struct("at", "length")).alias("places"))
    return _files(spark, archives).join(places, F.col("path") == F.col("file")).select("content", "places").mapInArrow(cuts, _READ)


def read_back(spark: SparkSession, archives: str, index: CaptureIndex, kind: str = "bigint", pages: DataFrame | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the captures of the pages' URLs (of all captures)."""
    with scratch(spark) as keep:
        found = stash(index.captures(kind) if pages is None else index.find(pages, kind), "captures")
        read = keep(stash(read_records(spark, archives, found), "records")).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
    revisits = read.where("record_type = 'revisit'")
    named = revisits.groupBy(F.col("payload_digest").alias("stated")).agg(F.count("*").alias("n"))
    seen = read.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("stated")).agg(F.max("page_id").alias("first"), F.max("payload_bytes").alias("size"))
    known = stash(seen.join(small(stash(named, "named")), "stated", "right"), "known")
    held = join_hot(revisits.withColumnRenamed("payload_digest", "stated"), known, "stated")
    same = F.col("size").isNotNull() & F.col("first").eqNullSafe(F.col("refers_to"))
    checked = held.select("page_id", F.when(same, F.col("size")).alias("payload_bytes"), F.when(same, F.col("stated")).alias("payload_digest"), "record_type", "refers_to")
    return read.where("record_type = 'response'").unionByName(checked)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    kind = pages.schema["page_id"].dataType.simpleString()
    top = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, f"{top}/archives")
    index = CaptureIndex.build(spark, f"{top}/archives", f"{top}/index", kind)
    return read_back(spark, f"{top}/archives", index, kind, pages)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM m
"""
