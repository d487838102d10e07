"""WARC archives and an external merge of their capture index.

* ``write_archives``: one record per page. Of records with equal payloads (at
  least ``min_bytes`` long) the one with the largest id is a response, the others
  are revisit records that refer to it and carry no payload. Spark's text writer
  with the record separator CRLF CRLF produces the archives, so the files are
  committed like any other Spark output and a lost executor leaves no half file.
* ``read_archives``: parses the archives back by Content-Length, checks each
  payload against its digest and gives one capture row per record; the captures
  of one archive file form a run sorted by (URL key, timestamp, id).
* ``merge_runs``: runs are range-partitioned by the whole sort key (so one hot URL
  spreads over many ranges) and every range merges its k run segments with a
  loser tree; the output is ordered across and within partitions.

Defined cases: a null payload is empty; a null id, URL or time stays null and
sorts first; rows that repeat id and payload are the same capture, each of them
is a response when it holds the largest id; an empty table gives empty archives
and an empty index; line breaks in a URL are percent-encoded in its header.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, shared_path, slices, stored

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:dyadic:page:"
RECORDS_PER_FILE = 256


def base32_of_hex(h: Column) -> Column:
    """Base32 of a 40-digit hex string: every 5 hex digits are 4 base32 characters."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(h, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and comma-joined, ``)``, then path and query."""
    url = F.coalesce(url, F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    host = F.translate(F.regexp_extract(bare, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"),
                    F.regexp_replace(bare, r"^[^/?#]*", ""))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", time: Column | None = None) -> None:
    when = time if time is not None else F.timestamp_seconds(
        F.lit(1_577_836_800) + F.coalesce(F.col(id_col).cast("long"), F.lit(0)) % 1_000_000_000)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = (pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), when.alias("at"),
                         payload.alias("payload"))
            .withColumn("digest", F.sha1(F.col("payload").cast("binary")))
            .withColumn("n", F.octet_length("payload").cast("long")))
    # only digests that occur more than once; stored, so that the join below reads a plain table
    # and adaptive execution can split a hot digest
    repeated = stored(rows.where(F.col("n") >= min_bytes).groupBy("digest")
                      .agg(F.max("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
                      .where("copies > 1").select("digest", "first_id"), "payloads")
    rows = rows.join(repeated, "digest", "left").withColumn(
        "refers", F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
                         & (F.col("n") >= min_bytes), F.col("first_id")))
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), "payload"))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        F.coalesce(line("WARC-Date", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("digest")))),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(F.col("refers"))).substr(F.lit(1), F.when(revisit, 1 << 20)),
                            line("WARC-Profile", F.lit(PROFILE))), F.lit("")),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block)
    (rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))


CAPTURE_SCHEMA = ("run string, offset long, page_id long, uri string, at string, payload_bytes long, "
                  "payload_digest string, record_type string, refers_to long")


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one uncompressed archive, located by Content-Length only."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        body = head_end + 4
        end = body + int(fields["Content-Length"])
        yield {"offset": at, "fields": fields, "block": data[body:end]}
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} does not end where its length says")
        at = end + 4


def _number(urn: str | None) -> int | None:
    digits = (urn or "").removeprefix(f"<{URN}").removesuffix(">")
    return int(digits) if digits else None


def _captures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            rows = []
            for r in parse_records(zlib.decompress(bytes(content), 31)):
                f, size = r["fields"], int(r["fields"]["X-Payload-Length"])
                digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                if f["WARC-Type"] == "response":
                    payload = r["block"].partition(b"\r\n\r\n")[2]
                    if len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"{path}: payload of the record at byte {r['offset']} is damaged")
                rows.append((path, r["offset"], _number(f["WARC-Record-ID"]), f.get("WARC-Target-URI"),
                             f.get("WARC-Date"), size, digest, f["WARC-Type"], _number(f.get("WARC-Refers-To"))))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURE_SCHEMA.split(", ")])
            out["page_id"], out["refers_to"] = out["page_id"].astype("Int64"), out["refers_to"].astype("Int64")
            yield out


SORT_KEY = ["url_key", "at", "page_id", "offset"]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Stored capture rows; ``run`` is the archive file, and the rows of a run stand together in key order."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    found = files.mapInPandas(_captures, CAPTURE_SCHEMA).withColumn("url_key", url_key(F.col("uri")))
    return stored(found.sortWithinPartitions("run", *SORT_KEY), "captures")


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so each step replays one leaf-to-root path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _enter(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node:
            if self.losers[node] < 0:  # first to arrive waits for its opponent
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, tuple]]:
        while self.k:
            leaf = self.losers[0]
            row = self.head[leaf]
            if row is None:
                return
            yield leaf, row
            self.head[leaf] = next(self.runs[leaf], None)
            node, winner = (leaf + self.k) // 2, leaf
            while node:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = [b for b in batches if len(b)]
    if not part:
        return
    pdf = pd.concat(part, ignore_index=True)
    key = list(zip(pdf["url_key"], pdf["at"].fillna(""), pdf["page_id"].astype("Int64").fillna(-(1 << 62)),
                   pdf["offset"], range(len(pdf))))
    # a run's segment arrives sorted unless the shuffle cut it; sorting a sorted list is one pass
    runs = [sorted(key[i] for i in rows) for rows in pdf.groupby("run", sort=True).indices.values()]
    yield pdf.iloc[[row[-1] for _, row in LoserTree(runs)]]


def merge_runs(captures: DataFrame) -> DataFrame:
    """The captures of all runs in global order of (URL key, timestamp, id)."""
    n = slices(captures.sparkSession, captures.count(), 200_000)
    return captures.repartitionByRange(n, *SORT_KEY).mapInPandas(_merge, captures.schema)


def archive_and_index(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Write the archives, read them back, and return the merged capture index."""
    path = path or shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **columns)
    return merge_runs(read_archives(pages.sparkSession, path))
