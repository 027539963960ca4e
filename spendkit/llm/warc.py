"""WARC archives: written with Spark's text sink, read back by a verified chain of record boundaries.

Writing. A record is one string; the two line ends that close a record are the sink's line separator, so
the files are plain WARC 1.1 and any file system that Spark writes to will do. Of records with equal payloads
the one with the largest page_id is a response, the others are revisits without the payload.

Reading. The files are split at every version line, wherever tasks cut them, so a payload that
contains the version line yields false candidates. Each candidate gives its successor from its own
Content-Length. Inside a split pointer jumping finds where the chain from every candidate leaves the split; over
splits pointer jumping from offset 0 of each file finds where the true chain enters each split. Only candidates
on that chain are records. Rows that travel hold offsets and header fields; payloads travel only for records
that contain the version line.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .storage import Bloom, cut_lineage

MAGIC = "WARC/1.1\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_FIELDS = {
    "record_type": "string", "record_id": "string", "page_id": "long", "target_uri": "string", "refers_to": "long",
    "payload_bytes": "long", "payload_digest": "string",
}


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four times 40 bits, eight digits each."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uri(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, its digest, and a number that stands for page and digest."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    return rows.withColumn("key", F.xxhash64("digest", "page_id"))


def _sieve(batches: Iterator[pa.RecordBatch], revisits: Bloom, doubtful: Bloom) -> Iterator[pa.RecordBatch]:
    """The rows that may be responses; `doubtful` tells those that the exact join has to decide."""
    for batch in batches:
        keys = batch["key"].to_numpy().view(np.uint64)
        unsure = revisits.has(keys)
        kept = ~unsure | doubtful.has(keys)
        yield batch.append_column("doubtful", pa.array(unsure)).filter(pa.array(kept))


def decided(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(responses with their payload, revisits with its size only and `response_id`: the page that holds an equal payload).

    Payloads below `min_bytes` are always stored. Revisits are found by digest, page_id and size alone. Payloads do not
    travel: a Bloom filter of the revisits, whose size is fixed, tells tasks which rows are surely responses. The
    rows that it takes for revisits by mistake are found from their keys, and only these go through an exact join.
    """
    rows = _rows(pages)
    known = cut_lineage(rows.select("page_id", "url", "digest", "key", F.octet_length("payload").alias("size")))
    large = known.where(F.col("size") >= min_bytes)
    holders = large.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = cut_lineage(large.join(holders, "digest").where("response_id is not null and not (page_id <=> response_id)"))
    sieve = Bloom.of(revisits.select("key").distinct(), "key")
    caught = known.select("key", "digest", "page_id").mapInArrow(
        lambda batches: (b.filter(pa.array(sieve.has(b["key"].to_numpy().view(np.uint64)))) for b in batches), "key long, digest string, page_id long",
    )
    told = revisits.select("digest", "page_id").distinct()
    same = lambda a, b: (a["digest"] == b["digest"]) & a["page_id"].eqNullSafe(b["page_id"])
    mistaken = cut_lineage(caught.distinct().join(told, same(caught, told), "left_anti"))
    doubtful = Bloom.of(mistaken, "key")
    schema = "page_id long, url string, payload binary, digest string, key long, doubtful boolean"
    sifted = rows.mapInArrow(lambda batches: _sieve(batches, sieve, doubtful), schema)
    responses = sifted.where("not doubtful")
    if not mistaken.isEmpty():
        unsure = sifted.where("doubtful")
        responses = responses.unionByName(unsure.join(mistaken, same(unsure, mistaken), "left_semi"))
    return responses.select("page_id", "url", "payload", "digest"), revisits.select("page_id", "url", "digest", "size", "response_id")


def _record(kind: str, size: Column, body: Column, *more: Column) -> Column:
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(RECORD_END),
    )
    clean = F.regexp_replace("url", r"[\r\n]+", " ")
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.lit(kind)),
        _line("WARC-Record-ID", _uri(F.col("page_id"))),
        F.when(F.col("url").isNotNull(), _line("WARC-Target-URI", clean)).otherwise(F.lit("")),
        _line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        *more,
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.octet_length(body)).cast("string")),
        F.lit("\r\n"), http,
    )
    return F.concat(head.cast("binary"), body).cast("string").alias("value")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One text per page: a whole record without the two line ends that close it."""
    responses, revisits = decided(pages, min_bytes)
    profile = _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    refers = _line("WARC-Refers-To", _uri(F.col("response_id")))
    return responses.select(_record("response", F.octet_length("payload"), F.col("payload"))).unionByName(
        revisits.select(_record("revisit", F.col("size"), F.lit("").cast("binary"), profile, refers))
    )


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record per row of `pages` (page_id, url, html) to new files below `path`.

    Null html is an empty payload. Rows that share the largest page_id of a payload are responses all; a row
    without page_id revisits one that has an id, and is a response where no copy has one. Line ends in a URL
    become a blank. Other columns are not read.
    """
    records(pages, min_bytes).write.option("lineSep", RECORD_END).text(path)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace"))
    return out


def _page(uri: str | None) -> int | None:
    number = (uri or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _payload(block: bytes) -> tuple[dict[str, str], bytes]:
    """HTTP fields and payload of a block; a block without an HTTP head is all payload."""
    if not block.startswith(b"HTTP/"):
        return {}, block
    head, end, body = block.partition(b"\r\n\r\n")
    return _fields(head), body if end else b""


def parse(record: bytes) -> dict:
    """The fields of one whole record, given from after its version line to the end of its block."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = _fields(head)
    http, body = _payload(block)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = int(http["content-length"]) if http.get("content-length", "").isdigit() else len(body)
    if fields.get("warc-type") != "revisit":
        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    return {
        "record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"),
        "page_id": _page(fields.get("warc-record-id")), "target_uri": fields.get("warc-target-uri"),
        "refers_to": _page(fields.get("warc-refers-to")), "payload_bytes": size, "payload_digest": digest,
    }


def _extent(piece: bytes) -> int | None:
    """Bytes from the start of the version line to the successor, by the piece's own head; None without a length."""
    head, end, _ = piece.partition(b"\r\n\r\n")
    if not end or b":" not in head:
        return None
    length = _fields(head).get("content-length", "")
    return len(MAGIC) + len(head) + 4 + int(length) + 4 if length.isdigit() and len(length) < 16 else None


def jump(offsets: np.ndarray, successors: np.ndarray, end: int) -> np.ndarray:
    """Where the chain from each candidate leaves [0, end): the first offset at or after `end`, or -1 if it breaks.

    Pointers are doubled until none moves.
    """
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    hit = (at < n) & (offsets[np.minimum(at, n - 1)] == successors) if n else np.zeros(0, bool)
    out = np.where(successors >= end, successors, -1)
    to = np.where(hit & (successors < end), at, np.arange(n))
    while True:
        further = to[to]
        if (further == to).all():
            return out[to]
        to = further


PIECES = "file string, split long, at long, successor long, leaves long, size long, whole boolean, " + ", ".join(
    f"{k} {v}" for k, v in RECORD_FIELDS.items()
)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per piece its offset relative to the split's first piece, its successor and where its chain leaves the split."""
    split, rows, end = None, [], 0

    def done() -> pd.DataFrame:
        columns = dict(zip(["at", "successor", "whole", *RECORD_FIELDS], zip(*rows)))
        whole_numbers = [c for c, t in RECORD_FIELDS.items() if t == "long"]
        out = pd.DataFrame({c: pd.array(v, "Int64") if c in whole_numbers else list(v) for c, v in columns.items()})
        follows = np.array([-1 if x is None else x for x in columns["successor"]], np.int64)
        known = follows >= 0
        leaves = np.full(len(out), -1)
        leaves[known] = jump(out["at"].to_numpy(np.int64)[known], follows[known], end)
        out["file"], out["split"], out["size"] = *split, end
        out["leaves"], out["successor"] = leaves, follows
        return out[[f.split()[0] for f in PIECES.split(", ")]]

    for batch in batches:
        for file, start, value in zip(batch["file"], batch["split"], batch["value"]):
            if (file, start) != split:
                if rows:
                    yield done()
                split, rows, end = (file, start), [], 0
            if start == 0 and not rows:
                # What stands before the first version line, nothing in a sound file, only counts for the offsets.
                rows.append((-1, None, False, *[None] * len(RECORD_FIELDS)))
                end = len(value)
                continue
            extent = _extent(value)
            whole = extent == len(MAGIC) + len(value)
            rows.append((end, None if extent is None else end + extent, whole, *(parse(value[:-4]).values() if whole else [None] * len(RECORD_FIELDS))))
            end += len(MAGIC) + len(value)
    if rows:
        yield done()


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The bytes between version lines, as the text source splits them, in order within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.col("value").cast("binary").alias("value"),
    )


def _piece_key(file: str, split: int, at: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{file}|{split}|{at}".encode(), digest_size=8).digest(), "big", signed=True)


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"key": [_piece_key(*x) for x in zip(batch["file"], batch["split"], batch["at"])]}, dtype="int64")


def _values(batches: Iterator[pd.DataFrame], wanted: Bloom | None) -> Iterator[pd.DataFrame]:
    """The pieces that may be wanted, with their offsets relative to the split."""
    split, end, first = None, 0, True
    for batch in batches:
        at = []
        for file, start, value in zip(batch["file"], batch["split"], batch["value"]):
            if (file, start) != split:
                split, end, first = (file, start), 0, start == 0
            at.append(-1 if first else end)
            end += len(value) + (0 if first else len(MAGIC))
            first = False
        batch["at"] = at
        batch = batch[batch["at"] >= 0]
        if wanted is not None:
            keys = np.array([_piece_key(*x) for x in zip(batch["file"], batch["split"], batch["at"])], np.int64)
            batch = batch[wanted.has(keys.view(np.uint64))]
        yield batch[["file", "split", "at", "value"]]


def _mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of one split that the chain from its entry visits."""
    rows = rows.sort_values("offset", ignore_index=True)
    place = {offset: i for i, offset in enumerate(rows["offset"])}
    follows, visited, at = rows["successor"].to_numpy(), [], int(rows["entry"].iloc[0])
    while at in place:
        visited.append(place[at])
        at = int(follows[place[at]])
    return rows.iloc[visited][["file", "split", "offset"]]


def chain(candidates: DataFrame, splits: int) -> DataFrame:
    """(file, split, offset) of the candidates that are reachable from offset 0 of their file.

    `candidates` has file, split, offset, successor and leaves, null where the chain breaks inside the split.
    A chain enters a split once, so at most as many entries as a file has splits are strung together, and
    doubled pointers reach all of them in the logarithm of that many rounds.
    """
    entries = candidates.where("leaves is not null").select("file", F.col("leaves").alias("offset")).distinct()
    nodes = candidates.select("file", "offset", "leaves")
    pointers = cut_lineage(nodes.where("offset = 0").unionByName(nodes.where("offset > 0").join(entries, ["file", "offset"], "left_semi")))
    reached = cut_lineage(pointers.where("offset = 0").select("file", "offset"))
    for _ in range(splits.bit_length()):
        ahead = reached.join(pointers, ["file", "offset"]).where("leaves is not null").select("file", F.col("leaves").alias("offset"))
        reached = cut_lineage(reached.unionByName(ahead).distinct())
        far = pointers.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("further"))
        pointers = cut_lineage(pointers.join(far, ["file", "leaves"]).select("file", "offset", F.col("further").alias("leaves")))
    entry = candidates.join(reached, ["file", "offset"]).select("file", "split", F.col("offset").alias("entry"))
    return candidates.join(entry, ["file", "split"]).groupBy("file", "split").applyInPandas(_mark, "file string, split long, offset long")


def _assemble(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("offset")
    record = MAGIC.encode().join(rows["value"])[:-4]
    _, body = _payload(record.partition(b"\r\n\r\n")[2])
    return pd.DataFrame([{"file": key[0], "offset": key[1], **parse(record), "payload": body}]).astype(
        {"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"}
    )


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives below `path`: file, offset, length and the fields of RECORD_FIELDS; `payload` if asked.

    Size and digest of a response are those of the payload that was read; those of a revisit are what its record
    says of the payload it refers to. A file that does not begin with a version line has no records; a chain
    ends at a record that no other follows, and a record that runs past the end of its file is left out.
    """
    pieces = cut_lineage(_pieces(spark, path).mapInPandas(_candidates, PIECES))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    spans = (
        pieces.groupBy("file", "split").agg(F.max("size").alias("size"))
        .withColumn("base", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .withColumn("file_size", F.sum("size").over(Window.partitionBy("file")))
    ).drop("size")
    placed = pieces.drop("size").join(spans, ["file", "split"]).where("at >= 0").withColumn("offset", F.expr("base + at"))
    candidates = placed.where("successor >= 0").select(
        "file", "split", "offset", F.expr("base + successor").alias("successor"),
        F.expr("case when leaves >= 0 then base + leaves end").alias("leaves"),
    )
    most = pieces.groupBy("file").agg(F.countDistinct("split").alias("n")).agg(F.max("n")).first()[0]
    true = chain(candidates, most or 0)
    records = cut_lineage(
        placed.join(true, ["file", "split", "offset"]).where("base + successor <= file_size")
        .withColumn("length", F.expr("successor - at"))
    )
    fields = ["file", "offset", "length", *RECORD_FIELDS]
    broken = records.where(~F.col("whole"))
    if not payload and broken.isEmpty():
        return records.select(*fields)
    # Every piece belongs to the last record that begins at or before it, in this split or an earlier one.
    last = records.groupBy("file", "split").agg(F.max("offset").alias("last"))
    carried = spans.join(last, ["file", "split"], "left").withColumn("before", F.max("last").over(earlier)).select("file", "split", "before")
    begins = records.select("file", "split", "offset", F.col("offset").alias("begin"))
    owner = F.coalesce(F.last("begin", True).over(Window.partitionBy("file", "split").orderBy("offset")), "before")
    owned = (
        placed.select("file", "split", "at", "offset").join(begins, ["file", "split", "offset"], "left")
        .join(carried, ["file", "split"]).withColumn("owner", owner)
    )
    asked = (records if payload else broken).select("file", F.col("offset").alias("owner"), "length")
    wanted = cut_lineage(owned.join(asked, ["file", "owner"]).where("offset < owner + length").select("file", "split", "at", "offset", "owner"))
    few = None if payload else Bloom.of(wanted.select("file", "split", "at").mapInPandas(_keyed, "key long"), "key")
    values = _pieces(spark, path).mapInPandas(lambda batches: _values(batches, few), "file string, split long, at long, value binary")
    schema = "file string, offset long, " + ", ".join(f"{k} {v}" for k, v in RECORD_FIELDS.items()) + ", payload binary"
    read = values.join(wanted, ["file", "split", "at"]).groupBy("file", "owner").applyInPandas(_assemble, schema)
    read = read.join(records.select("file", "offset", "length"), ["file", "offset"])
    if payload:
        return read.select(*fields, "payload")
    return records.where("whole").select(*fields).unionByName(read.select(*fields))
