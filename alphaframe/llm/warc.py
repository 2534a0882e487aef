"""Web archives: records written and read back, and one index over all captures.

Records go through Spark's text writer, whose line separator is the end of a record, so that the
files reach whatever store the cluster uses and a lost executor costs one task. Each file's index is
sorted where the file is read and forms a run. The runs are dealt out by ranges of (URL key, time,
page), and each range merges its parts of the runs with a loser tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, shared_folder, stored

END = "\r\n\r\n"
LEAST_BYTES = 100
FIRST_SECOND = 1_704_067_200  # 2024-01-01, the time of page 0 where pages carry no time
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([
    ("url_key", pa.string()), ("captured", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("file", pa.string()), ("file_offset", pa.int64()),
])
INDEX_FIELDS = (
    "url_key string, captured long, page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, file string, file_offset long"
)


def first_of_payload(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """page_id, digest, refers_to of each page whose payload of ``least`` bytes or more an earlier page has."""
    digests = pages.where(F.octet_length("html") >= least).select("page_id", "digest")
    shared = stored(digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
                    .where("n > 1").drop("n"))
    return stored(digests.join(shared, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct())


def write_warc(pages: DataFrame, folder: str, *, per_file: int = 1024) -> None:
    """Write a record per row of (page_id, url, html, digest, captured, refers_to) as WARC 1.0 text files.

    A null payload is empty. Rows with ``refers_to`` become revisit records without payload.
    """
    n = F.octet_length("html").cast("string")
    mark = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n, F.lit(END))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("html"))).otherwise(http)

    def head(kind: str, *more: Column) -> Column:
        return F.concat(
            F.lit(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), mark(F.col("page_id")),
            F.lit("\r\nWARC-Date: "), F.date_format(F.timestamp_seconds("captured"), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), *more,
            F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END))

    lines = pages.withColumn("html", F.coalesce("html", F.lit(""))).withColumn("block", block).select(F.concat(
        F.when(F.col("refers_to").isNull(), head("response")).otherwise(
            head("revisit", F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), mark(F.col("refers_to")))),
        F.col("block")).alias("value"))
    lines.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], memoryview]]:
    """Offset, header fields and block of each record of a file."""
    view, at = memoryview(content), 0
    while at < len(content):
        body = content.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in content[at:body].decode().split("\r\n")[1:])
        size = int(fields["Content-Length"])
        yield at, fields, view[body + 4:body + 4 + size]
        at = body + 4 + size + 4


def url_key(url: str) -> str:
    """Host labels from the right, then the rest: ``http://a.example.com/x`` is ``com,example,a)/x``."""
    rest = url.split("://", 1)[-1]
    cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    return ",".join(reversed(rest[:cut].lower().split("."))) + ")" + rest[cut:]


def page_of(mark: str) -> int | None:
    name = mark.removeprefix("<urn:page:").removesuffix(">")
    return None if name == "none" else int(name)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index of each file, sorted by (url_key, captured, page_id): one run per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime

        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for at, f, block in records(content.as_py()):
                    response, page = f["WARC-Type"] == "response", page_of(f["WARC-Record-ID"])
                    http = bytes(block[:4096]).index(b"\r\n\r\n") + 4
                    payload = block[http:]
                    size = int(bytes(block[:http]).rsplit(b": ", 1)[1])
                    digest = hashlib.sha256(payload).hexdigest() if response else f["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((
                        url_key(f.get("WARC-Target-URI", "")), int(datetime.fromisoformat(f["WARC-Date"]).timestamp()), page,
                        len(payload) if response else size, digest, f["WARC-Type"],
                        None if response else page_of(f["WARC-Refers-To"]), path, at))
                rows.sort(key=order)
                yield pa.RecordBatch.from_pylist([dict(zip(INDEX.names, r, strict=True)) for r in rows], schema=INDEX)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(run, INDEX_FIELDS)


def order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2]


class LoserTree:
    """Merges sorted runs; each step replays one path of losers from the winner's leaf."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at, self.k = runs, [0] * len(runs), len(runs)
        self.heads = [(0, order(r[0])) if r else (1,) for r in runs]  # (1,) is behind all others
        self.losers = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._replay(leaf)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # still building: wait here for the other side
                self.losers[node] = winner
                return
            if (self.heads[other], other) < (self.heads[winner], winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[w := self.losers[0]] != (1,):
            run, at = self.runs[w], self.at[w]
            yield run[at]
            self.at[w] = at = at + 1
            self.heads[w] = (0, order(run[at])) if at < len(run) else (1,)
            self._replay(w)


def merge_runs(runs: DataFrame) -> DataFrame:
    """Rows of all runs plus ``position``, their place in the order (url_key, captured, page_id).

    Ranges end anywhere in a URL's history, so one URL with very many captures is shared by several
    tasks. A task holds one range. Equal keys are ordered arbitrarily; null pages come first.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_run: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_run.setdefault(row[7], []).append(row)
        for rows in by_run.values():
            rows.sort(key=order)  # runs arrive in order; where a fetch mixed its blocks, restore it
        part, out, n = TaskContext.get().partitionId(), [], 0
        for row in LoserTree(list(by_run.values())):
            out.append((*row, part, n))
            n += 1
            if len(out) == 4096:
                yield to_batch(out)
                out = []
        if out:
            yield to_batch(out)

    schema = INDEX.append(pa.field("part", pa.int32())).append(pa.field("at", pa.int64()))

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    dealt = runs.repartitionByRange("url_key", "captured", F.col("page_id").asc_nulls_first())
    merged = stored(dealt.mapInArrow(merge, f"{INDEX_FIELDS}, part int, at long"))
    sizes = merged.groupBy("part").agg(F.count("*").alias("n"))
    starts = stored(sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start")))  # a row per range
    return merged.join(starts, "part").withColumn("position", F.col("start") + F.col("at")).drop("part", "at", "start")


def archive(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None,
    folder: str | None = None, per_file: int = 1024,
) -> DataFrame:
    """Write pages as WARC files, read them back, and return the merged index of all captures.

    Of records with equal payloads of at least 100 bytes the smallest page is the response and the
    others revisit it; smaller payloads are responses. A null payload is empty, a null URL has the
    key ``)``, a page without id is a response that no other refers to. Rows that repeat the smallest
    id of their payload are responses as well. Without ``time_col`` (seconds) a page's time is its id in
    seconds after 2024. An empty table gives an empty index; further columns are ignored.
    """
    spark = pages.sparkSession
    rows = only(pages, page_id=id_col, url=url_col, html=html_col, **({"captured": time_col} if time_col else {}))
    if not time_col:
        rows = rows.withColumn("captured", F.lit(FIRST_SECOND) + F.coalesce("page_id", F.lit(0)))
    folder = folder or shared_folder(spark)
    rows = rows.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
    # Stored first, so that its size is known before any payload would be dealt out for the join.
    later = first_of_payload(rows)
    write_warc(rows.join(later, ["page_id", "digest"], "left"), folder, per_file=per_file)
    return merge_runs(stored(read_runs(spark, folder)))
