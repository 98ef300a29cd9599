"""WARC archives, their capture index and its external merge.

Each task sorts its pages by URL key and time and writes them as WARC records, one gzip
member each, to archive files in the shared folder; the rows that it returns, a sorted run
of the capture index, name only files that it finished, so what a lost task left behind is
never read. The runs are dealt out by ranges of (URL key, time, page, run, place), about
``RANGE`` captures each, and in each range a loser tree merges them: capture histories in
global order. Archives are read back record
by record at the places that the merged index gives.

Archives are written and read through ``pyarrow.fs`` at the shared folder's own URI.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._stage import fresh_path, staged

LEAST = 100  # bytes of a payload that can be revisited
ARCHIVE_BYTES = 64 << 20
RANGE = 250_000  # captures of a merging task, about
CAPTURE = "run string, nth long, urlkey string, ts string, page_id long, record_type string, digest string, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, urlkey string, ts string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """The sort-friendly form of a URL; "-" without one.

    >>> url_key("https://www.Blog.example.com:443/En/1?b=2#top")
    'com,example,blog)/en/1?b=2'
    """
    try:
        u = urlsplit((url or "").strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return "-"
    if not host:
        return "-"
    port = f":{port}" if port and port != {"http": 80, "https": 443}.get(u.scheme) else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(u.path or '/').lower()}{'?' + u.query.lower() if u.query else ''}"


def record(kind: str, url: str | None, ts: str, page_id: int | None, digest: str, size: int, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record. A revisit keeps the HTTP headers, whose Content-Length is the full payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block += payload if kind == "response" else b""
    date = f"{ts[:4]}-{ts[4:6]}-{ts[6:8]}T{ts[8:10]}:{ts[10:12]}:{ts[12:]}Z"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'\s', '%20', url or '')}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    x = (name or "<urn:page:none>").removeprefix("<urn:page:").removesuffix(">")
    return None if x == "none" else int(x)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted iterators: every inner node keeps the loser of its match, so a step costs one match a level."""

    def __init__(self, runs: list[Iterator], key) -> None:
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.head = [self._next(r) for r in runs] or [None]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _next(self, run: Iterator) -> tuple | None:
        """A run's next item under its key, which is made once."""
        return next(((self.key(x), x) for x in run), None)

    def _before(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return a < 0  # a place that is still open wins, until all have played
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x[0] < y[0] or (x[0] == y[0] and a < b)

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            if self._before(self.tree[node], winner):
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while (x := self.head[w := self.tree[0]]) is not None:
            yield x[1]
            self.head[w] = self._next(self.runs[w])
            self._play(w)


def decide(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> the same with payload size, digest, record_type and refers_to.

    Only payloads that occur more than once are looked up; how often they do does not
    matter to the join but through its skew, which adaptive execution splits.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("size", F.octet_length("html").cast("long")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    again = p.filter(F.col("size") >= LEAST).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first")
    p = p.join(staged(again, "copies"), "digest", "left")
    revisit = (F.col("size") >= LEAST) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("html", F.when(revisit, "").otherwise(F.col("html"))).drop("first")


def write_archives(decided: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of ``decide``'s rows to archives in ``folder`` -> the runs of the capture index.

    Pages have no time of their own; a fixed day plus page_id seconds (over a year) stands in.
    """
    key = F.pandas_udf(lambda urls: pd.Series([url_key(u) for u in urls], dtype=object), "string")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyyMMddHHmmss")
    rows = decided.withColumn("urlkey", key("url")).withColumn("ts", stamp).sortWithinPartitions("urlkey", "ts", "page_id", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, n, nth, out, at, file = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0, None, 0, ""
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            made = []
            for r in b.to_pylist():
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    file, n, at = f"{name}-{n:04d}.warc.gz", n + 1, 0
                    out = fs.open_output_stream(f"{base}/{file}", compression=None)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = z.compress(record(r["record_type"], r["url"], r["ts"], r["page_id"], r["digest"], r["size"], r["html"].encode("utf-8", "surrogatepass"), r["refers_to"])) + z.flush()
                out.write(raw)
                made.append((name, nth, r["urlkey"], r["ts"], r["page_id"], r["record_type"], r["digest"], file, at, len(raw)))
                nth, at = nth + 1, at + len(raw)
            yield _batch(made, CAPTURE)
        if out is not None:
            out.close()

    return rows.select("page_id", "url", "html", "size", "digest", "record_type", "refers_to", "urlkey", "ts").mapInArrow(run, CAPTURE)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def merge_runs(runs: DataFrame) -> DataFrame:
    """The runs of a capture index, a written table -> captures in global order of (urlkey, ts, page_id): ``part`` and ``place`` in it.

    A task merges what each run has in its range of keys. No two captures share a key, as their
    run and their place in it belong to it, so no URL makes a range large. A task holds its
    range as Arrow columns and gives the merged captures out in batches. Null page ids come first.
    """
    n = runs.count()
    ranges = max(1, min(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 5_000)), -(-n // RANGE))
    dealt = runs.repartitionByRange(ranges, "urlkey", "ts", "page_id", "run", "nth").sortWithinPartitions("run", "nth")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        part, kept = TaskContext.get().partitionId(), t.drop_columns(["run", "nth"])
        own = [t[c].combine_chunks() for c in ("urlkey", "ts", "page_id")]
        begin = [0, *(np.flatnonzero(pc.not_equal(t["run"].slice(1), t["run"].slice(0, len(t) - 1)).to_numpy()) + 1).tolist()]
        tree = LoserTree([iter(range(a, z)) for a, z in zip(begin, [*begin[1:], len(t)], strict=True)], lambda i: _order(*(c[i].as_py() for c in own)))
        order, at = iter(tree), 0
        while some := list(islice(order, 20_000)):
            b = kept.take(pa.array(some, pa.int64())).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), pa.array(np.arange(at, at + len(some))), *b.columns], ["part", "place", *b.schema.names])
            at += len(some)

    return dealt.mapInArrow(run, "part int, place long, " + CAPTURE.split(", ", 2)[2])


def _order(urlkey: str, ts: str, page_id: int | None) -> tuple[bytes, str, int]:
    """What captures sort by, as Spark sorts: text by its UTF-8 bytes, nulls first."""
    return urlkey.encode("utf-8", "surrogatepass"), ts, -(1 << 63) if page_id is None else page_id


def histories(merged: DataFrame) -> DataFrame:
    """A row for each URL key: captures, first and last time, different payloads."""
    return merged.groupBy("urlkey").agg(F.count("*").alias("captures"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("digest").alias("payloads"))


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Captures (file, offset, length, urlkey, ts) -> what their records say, each read at its place; payloads are hashed anew.

    As many tasks as archives (10,000 at most): the rows are few bytes, what they name is not.
    """
    files = captures.select("file").distinct().count()
    dealt = captures.select("file", "offset", "length", "urlkey", "ts").repartition(max(1, min(files, 10_000)), "file").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        name, source = None, None
        for b in batches:
            made = []
            for r in b.to_pylist():
                if r["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = r["file"], fs.open_input_file(f"{base}/{r['file']}")
                warc, http, payload = parse(zlib.decompress(source.read_at(r["length"], r["offset"]), 31))
                kind, digest, size = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:"), int(http["Content-Length"])
                if kind == "response":
                    size, own = len(payload), hashlib.sha256(payload).hexdigest()
                    if own != digest:
                        raise ValueError(f"the payload of {warc['WARC-Record-ID']} does not have its digest")
                made.append((_page(warc["WARC-Record-ID"]), size, digest, kind, _page(warc.get("WARC-Refers-To")), r["urlkey"], r["ts"]))
            yield _batch(made, RECORD)
        if source is not None:
            source.close()

    return dealt.mapInArrow(run, RECORD)


def archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to archives, merge their index, read the records back: see ``RECORD``.

    A null html is an empty payload, a null url has the key "-"; of rows with the smallest
    page_id of equal payloads all are responses; with null page ids alone all are. An empty
    table writes nothing. Other columns are not read.
    """
    runs = staged(write_archives(decide(pages), folder), "captures")
    return read_records(staged(merge_runs(runs), "merged"), folder)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    out = archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""
