"""WARC archives of pages, and their index by an external merge of sorted capture runs.

``write_archives`` writes one WARC record per page as Spark text output (records end in two line ends, which is
the line separator), so files are committed like any other output. ``read_archives`` reads them back;
each file becomes one run of captures sorted by URL key and time. ``merge_runs`` merges all runs: ranges of
(URL key, time, page) are dealt to tasks, and every task merges its slices of the runs with a tree
of losers, so that the histories of captures come out in one global order.

Defined results: null html is an empty payload; a null URL is written empty; a null key is written empty and never referred to. Of
records with equal payloads the ones with the smallest key are responses (all of them, where that key is
repeated), the others revisits. Payloads below ``min_bytes`` are always responses. Line ends in
URLs are percent-encoded. Extra columns are ignored; an empty table gives no archive records and an
empty index.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.llm.common import columns
from rowloom.plans.scale import salted_join
from rowloom.session import new_folder

#: Bytes of records aimed at per archive file: one task holds a whole file when it is read back.
FILE_BYTES = 16 << 20
#: Rows per merging task.
MERGE_ROWS = 200_000
#: Groups of equal payloads up to this number are broadcast (at most about 50 MB), more are joined by a shuffle.
BROADCAST_GROUPS = 500_000
#: Time of the capture with key 0; each key is one second later where no time column is named.
EPOCH = 1_700_000_000

_CAPTURE = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("pos", T.LongType()),
    T.StructField("urlkey", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a binary column in upper-case base 32: five bytes are eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", time: str | None = None,
    min_bytes: int = 0,
) -> DataFrame:
    """``(page_id, url, seconds, payload, payload_bytes, payload_digest, record_type, refers_to)`` per page."""
    wanted = {"page_id": key, "url": url, "payload": html} | ({"seconds": time} if time else {})
    rows = columns(pages, **wanted)
    if not time:
        rows = rows.withColumn("seconds", F.lit(EPOCH) + F.coalesce(F.col("page_id"), F.lit(0)))
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = rows.select(
        "page_id", "url", F.col("seconds").cast("long").alias("seconds"), payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload.cast("binary")).alias("payload_digest"),
    )
    # Groups are found over digests alone: counts and minima are combined before the shuffle.
    groups = (
        rows.where(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.count("*").alias("_n"), F.min("page_id").alias("first_id"))
        .where(F.col("_n") > 1).drop("_n")
    )
    path = new_folder(pages.sparkSession, "payload-groups")
    groups.write.parquet(path)
    groups = pages.sparkSession.read.schema(groups.schema).parquet(path)
    on = ["payload_digest", "payload_bytes"]
    if groups.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(groups), on, "left")
    else:
        joined = salted_join(rows, groups, on, "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "seconds", "payload", "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first_id")).alias("refers_to"),
    )


def _record_text(rows: DataFrame) -> Column:
    crlf = "\r\n"
    revisit = F.col("record_type") == "revisit"
    identifier = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    address = F.replace(
        F.replace(F.coalesce(F.col("url"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")
    )
    http = f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}{crlf}"
    body = F.when(revisit, F.lit(http)).otherwise(F.concat(F.lit(http), F.col("payload")))
    date = F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.col("record_type"),
        F.lit(f"{crlf}WARC-Record-ID: <urn:page:"), identifier, F.lit(">"),
        F.lit(f"{crlf}WARC-Date: "), date,
        F.lit(f"{crlf}WARC-Target-URI: "), address,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit(f"{crlf}Payload-Bytes: "), F.col("payload_bytes").cast("string"),
        F.when(
            revisit,
            F.concat(
                F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
                      f"{crlf}WARC-Refers-To: <urn:page:"),
                F.col("refers_to").cast("string"), F.lit(">"),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(f"{crlf}{crlf}"),
    )
    return F.concat(header, body)


def write_archives(rows: DataFrame, path: str, mean_bytes: float) -> str:
    """Writes records as gzipped WARC files of about ``FILE_BYTES`` each, without a shuffle."""
    per_file = max(1, int(FILE_BYTES / (mean_bytes + 600)))
    out = rows.select(_record_text(rows).alias("value"))
    out.write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=per_file).text(path)
    return path


def _url_key(url: str) -> str:
    """The host's labels reversed, then the rest, in lower case."""
    rest = url.lower().split("://", 1)[-1]
    host, slash, tail = rest.partition("/")
    return ",".join(reversed(host.split(":", 1)[0].split("."))) + ")" + slash + tail


def _parse(run: str, data: bytes) -> list[tuple]:
    """The captures of one archive, in file order; positions are filled in after sorting."""
    found, at = [], 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        head = data[at:head_end].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError(f"{run}: no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head[1:])
        size = int(fields["Content-Length"])
        end = head_end + 4 + size + 4
        identifier = fields["WARC-Record-ID"][len("<urn:page:"):-1]
        earlier = fields.get("WARC-Refers-To")
        url = fields.get("WARC-Target-URI", "")
        stamp = "".join(c for c in fields["WARC-Date"] if c.isdigit())
        found.append((
            run, 0, _url_key(url), stamp, int(identifier) if identifier else None, url, fields["WARC-Type"],
            int(fields["Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"),
            int(earlier[len("<urn:page:"):-1]) if earlier else None, at, end - at,
        ))
        at = end
    return found


def _order(capture: tuple) -> tuple:
    """Captures are ordered by URL key, time and page; unnamed pages come first."""
    return (capture[2], capture[3], capture[4] is not None, capture[4] or 0)


def _frame(captures: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(captures, columns=_CAPTURE.fieldNames())
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives at ``path``: each file is one run, sorted, with places ``pos`` in it."""

    def runs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                data = gzip.decompress(content) if bytes(content[:2]) == b"\x1f\x8b" else bytes(content)
                captures = sorted(_parse(name, data), key=_order)
                yield _frame([(c[0], i, *c[2:]) for i, c in enumerate(captures)])

    # One file a batch: a file is bounded, a batch of files would not be.
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(_one_by_one(runs), _CAPTURE)


def _one_by_one(function):
    """Feeds a pandas function one row at a time, so that only one file is unpacked at once."""
    import pyarrow as pa

    def call(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for frame in function(iter([batch.slice(i, 1).to_pandas()])):
                    yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return call


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list[tuple]], order):
        self.runs, self.order, self.k = runs, order, max(1, len(runs))
        self.at = [0] * len(runs)
        self.keys = [order(run[0]) if run else None for run in runs]
        self.losers = [-1] * self.k
        self.winner = -1
        for run in range(len(runs)):
            self._play(run, first=True)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[a] is not None
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, run: int, first: bool = False) -> None:
        node = (run + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0 and first:
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.winner = run

    def __iter__(self):
        while self.winner >= 0 and self.keys[self.winner] is not None:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            left = self.at[run] < len(self.runs[run])
            self.keys[run] = self.order(self.runs[run][self.at[run]]) if left else None
            self._play(run)


def merge_runs(captures: DataFrame, rows: int) -> DataFrame:
    """All runs merged by URL key, time and page: partitions follow each other in order, and so do their rows.

    A range of keys is cut by time and page too, so one busy URL spreads over many tasks.
    """
    tasks = max(1, -(-rows // MERGE_ROWS))
    names = _CAPTURE.fieldNames()

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slices: dict[str, list[tuple]] = {}
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            for capture in part[names].itertuples(index=False, name=None):
                slices.setdefault(capture[0], []).append(capture)
        runs = [sorted(slices[name], key=lambda c: c[1]) for name in sorted(slices)]
        out = []
        for capture in LoserTree(runs, _order):
            out.append(capture)
            if len(out) == 10_000:
                yield _frame(out)
                out = []
        if out:
            yield _frame(out)

    ranged = captures.repartitionByRange(tasks, "urlkey", "timestamp", "page_id")
    return ranged.mapInPandas(merge, _CAPTURE)


def archive_index(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", time: str | None = None,
    min_bytes: int = 0, path: str | None = None,
) -> DataFrame:
    """Writes the pages to archives at ``path``, reads them back and returns their merged index."""
    spark = pages.sparkSession
    path = path or new_folder(spark, "archives")
    rows = records(pages, key, url, html, time, min_bytes)
    sizes = columns(pages, html=html).agg(F.count("*").alias("n"), F.avg(F.octet_length("html")).alias("mean")).first()
    write_archives(rows, path, sizes["mean"] or 0)
    runs = new_folder(spark, "capture-runs")
    if not sizes["n"]:
        return spark.createDataFrame([], _CAPTURE)
    read_archives(spark, path).write.parquet(runs)
    return merge_runs(spark.read.schema(_CAPTURE).parquet(runs), sizes["n"])
