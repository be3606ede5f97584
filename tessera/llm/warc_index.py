"""WARC archives of captures, and their index by external merging.

Writing.  Captures with equal payloads (SHA-1, length and a second hash agree)
are one group; the one with the largest id is written as a ``response`` with
its payload, the others as ``revisit`` records that name it and carry the HTTP
header only.  Spark's text writer writes the records (a record ends with two
line ends, which is the writer's separator), so a lost task is run again and
only committed files are seen.

Reading.  Each archive file is parsed by the records' Content-Length, payload
digests are recomputed and compared (the files are compressed; offsets are
those of the uncompressed archive), and the file's index entries are sorted
by (URL key, timestamp, id): one run per file, written to the shared folder.

Merging.  The key space is cut into ranges of about ``MERGE_ROWS`` entries
(Spark's range partitioning by key, timestamp and id, so a URL or host with a
third of all captures is cut too); the task of a range holds the pieces of
the runs in its range and merges them with a loser tree.  The ranges in
order are the globally ordered capture history.

Cases: null html is an empty payload; a null url has the empty key; null
timestamps come first; repeated rows are captures of their own, of which one
is the response; payloads under ``min_bytes`` are never revisits; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._shared import Scratch, own

END = "\r\n\r\n"
RECORDS_PER_FILE = 1000
MERGE_ROWS = 100_000
_ENTRY = ("run string, seq long, urlkey string, ts long, page_id long, uid long, offset long, length long, "
          "record_type string, payload_bytes long, payload_digest string, refers_to long")
_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in _ENTRY.split(", ")])


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and sorted query: ``org,example)/a?b=1&c=2``."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^?#]*)(?:\?([^#]*))?", (url or "").strip(), re.I)
    if not m:
        return (url or "").strip().lower()
    host, port, path, query = m.groups()
    host = re.sub(r"^www\d*\.", "", host.lower())
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in ("80", "443") else "")
    path = path.lower().rstrip("/") or "/"
    return f"{key}){path}" + (f"?{'&'.join(sorted(query.lower().split('&')))}" if query else "")


def _record(page_id, uid, url, ts, html, size, sha1, refers_to, later) -> str:
    page = lambda p: "" if p is None else p
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    date = "" if ts is None else datetime.fromtimestamp(ts / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    body = http if later else http + html
    # a payload has one response, so its page and digest name it; a revisit's name holds a number of its own
    name = f"<urn:x-capture:{page(page_id)}:{digest}{f':{uid}' if later else ''}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if later else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http; msgtype=response"]
    if later:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-capture:{page(refers_to)}:{digest}>"]
    return "\r\n".join(head) + f"\r\nContent-Length: {len(body.encode())}{END}{body}"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([_record(*r) for r in zip(*(c.to_pylist() for c in b.columns))], pa.string())], names=["value"])


def write_archives(captures: DataFrame, path: str, page_id: str = "page_id", url: str = "url", ts: str = "ts", html: str = "html", min_bytes: int = 0) -> None:
    c = own(captures, page_id, url, ts, html).toDF("page_id", "url", "ts", "html")
    c = c.select(F.col("page_id").cast("long").alias("page_id"), "url", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.coalesce("html", F.lit("")).alias("html"))
    c = c.withColumns({"size": F.octet_length("html").cast("long"), "sha1": F.sha1(F.col("html").cast("binary")), "other": F.xxhash64("html")})
    payload = ["sha1", "size", "other"]
    rows = c.where(F.col("size") >= min_bytes).groupBy(*payload, "page_id").agg(F.count(F.lit(1)).alias("n"))
    top = rows.groupBy(*payload).agg(F.sum("n").alias("n"), F.max(F.struct("page_id", F.col("n").alias("same"))).alias("top")).where("n > 1").drop("n")
    top = Scratch(captures.sparkSession, "warc-groups").write(top, "groups")
    rows = c.join(top, payload, "left")
    first = F.col("page_id").eqNullSafe(F.col("top.page_id"))
    if top.where("top.same > 1").take(1):                # repeated rows: one of them is the response
        tied = first & (F.col("top.same") > 1)
        w = Window.partitionBy(*payload, "page_id").orderBy("ts", "url")
        rows = rows.where(~F.coalesce(tied, F.lit(False))).withColumn("rank", F.lit(1)).unionByName(rows.where(tied).withColumn("rank", F.row_number().over(w)))
        first = first & (F.col("rank") == 1)
    later = F.col("top").isNotNull() & ~first
    rows = rows.select("page_id", F.monotonically_increasing_id().alias("uid"), "url", "ts", "html", "size", "sha1", F.when(later, F.col("top.page_id")).alias("refers_to"), later.alias("later"))
    rows.mapInArrow(_records, "value string").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(path)


def _headers(block: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in block.decode().split("\r\n")[1:])}


def _parse(content: bytes) -> Iterator[tuple]:
    """Entries ``(urlkey, ts, page_id, uid, offset, length, type, payload bytes, digest, refers_to)`` of one archive."""
    end, at = END.encode(), 0
    while at < len(content):
        cut = content.index(end, at)
        h = _headers(content[at:cut])
        body = cut + len(end)
        stop = body + int(h["content-length"])
        if content[stop:stop + len(end)] != end:
            raise ValueError(f"record at {at} does not end where its length says")
        split = content.index(end, body, stop)
        http = _headers(content[body:split])
        digest = h["warc-payload-digest"].removeprefix("sha1:")
        refers, size = None, int(http["content-length"])
        if h["warc-type"] == "response":
            payload = content[split + len(end):stop]
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
                raise ValueError(f"record at {at}: payload and digest differ")
        else:
            refers = h["warc-refers-to"].strip("<>").split(":")[2]
        page, _, *uid = h["warc-record-id"].strip("<>").split(":")[2:]
        ts = None
        if h["warc-date"]:
            d = datetime.strptime(h["warc-date"], "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=timezone.utc) - datetime.fromtimestamp(0, timezone.utc)
            ts = (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds
        yield (url_key(h["warc-target-uri"]), ts, int(page) if page else None, int(uid[0]) if uid else -1, at, stop + len(end) - at, h["warc-type"], size, digest,
               int(refers) if refers else None)
        at = stop + len(end)


def _key(e: tuple) -> tuple:
    """Sort key of (urlkey, ts, page_id, uid, ...): nulls first."""
    return (e[0], e[1] is not None, e[1] or 0, e[2] is not None, e[2] or 0, e[3])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b.column(0).to_pylist(), b.column(1)):
            rows = sorted(_parse(gzip.decompress(content.as_py())), key=_key)
            run = name.rsplit("/", 1)[-1]
            if rows:
                cols = list(zip(*((run, k, *r) for k, r in enumerate(rows))))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """One locally sorted run of index entries per archive file."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_runs, _ENTRY)


class LoserTree:
    """K-way merge: inner nodes keep the loser of their match, so replacing the winner replays one path."""

    def __init__(self, runs: Iterable[list], key):
        self.runs, self.key = [r for r in runs if r], key
        k = len(self.runs)
        self.pos = [0] * k
        self.head = [key(r[0]) for r in self.runs]
        self.loser = [-1] * k                            # loser[0]: the overall winner
        for i in range(k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _play(self, i: int) -> None:
        """Run i goes up from its leaf; at a node not played yet it waits."""
        node = (i + len(self.runs)) // 2
        while node > 0:
            other = self.loser[node]
            if other < 0:
                self.loser[node] = i
                return
            if self._less(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator:
        if not self.runs:
            return
        while True:
            i = self.loser[0]
            if self.head[i] is None:
                return
            run = self.runs[i]
            yield run[self.pos[i]]
            self.pos[i] += 1
            self.head[i] = self.key(run[self.pos[i]]) if self.pos[i] < len(run) else None
            self._play(i)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    runs: dict[str, list] = {}
    for b in batches:
        for run, seq, *entry in zip(*(c.to_pylist() for c in b.columns)):
            runs.setdefault(run, []).append((seq, entry))
    pieces = [[(run, seq, *e) for seq, e in sorted(rows, key=lambda r: r[0])] for run, rows in sorted(runs.items())]
    part = TaskContext.get().partitionId()
    schema = _SCHEMA.append(pa.field("part", pa.int64())).append(pa.field("at", pa.int64()))
    out = []
    for at, row in enumerate(LoserTree(pieces, lambda r: _key(r[2:]))):
        out.append((*row, part, at))
        if len(out) == 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def merge_runs(runs: DataFrame, rows: int, scratch: Scratch, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """All entries in global order: ``position`` (0 ..) and ``capture_no`` (1 .. per URL key) besides the entry."""
    n = max(1, -(-rows // merge_rows))
    dealt = runs.repartitionByRange(n, "urlkey", F.col("ts").asc_nulls_first(), F.col("page_id").asc_nulls_first(), "uid")
    merged = scratch.write(dealt.mapInArrow(_merged, _ENTRY + ", part long, at long"), "merged")
    # one row per range: their number is rows / merge_rows
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    out = merged.join(before, "part").withColumn("position", F.col("before") + F.col("at")).drop("part", "at", "before")
    first = out.groupBy("urlkey").agg(F.min("position").alias("first"))
    return out.join(first, "urlkey").withColumn("capture_no", F.col("position") - F.col("first") + 1).drop("first")


def archive_and_index(captures: DataFrame, page_id: str = "page_id", url: str = "url", ts: str = "ts", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder, read them back, and return the merged index."""
    spark = captures.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write_archives(captures, path, page_id, url, ts, html, min_bytes)
    runs = scratch.write(read_runs(spark, path), "runs")
    return merge_runs(runs, runs.count(), scratch)
