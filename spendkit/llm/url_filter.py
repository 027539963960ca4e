"""URL filter: a sort-merge range join of URLs with (host, path) rules.

A host is turned into a key with its labels reversed, `www.example.com` into `com.example.www.`, so the
hosts below a rule's host are the interval of keys that begin with the rule's key. URLs are laid out in ranges
of (key, path), which also cuts a hot host. A rule goes to every range that its interval meets; a range's first key
has only as many rules above it as the host has labels. Each range is then one sorted sweep with a stack of the
rules whose interval is open; the path decides among them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .line_dedup import LOWER, UPPER
from .storage import cut_lineage

RULE_SCHEMA = "host string, path string, verdict string"
#: Above every character that a host key may hold after a rule's key.
TOP = "\U0010ffff"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))
    )


def _deal(batches: Iterator[pa.RecordBatch], spans: list[tuple[int, str, str]]) -> Iterator[pa.RecordBatch]:
    """A rule once for every range that its interval meets; ranges are in order, so these stand side by side."""
    least, most = [s[1] for s in spans], [s[2] for s in spans]
    names = ["key", "path", "rule_host", "verdict"]
    for batch in batches:
        parts, rows = [], []
        for k, key in enumerate(batch["key"].to_pylist()):
            for at in range(bisect_left(most, key), bisect_right(least, key + TOP)):
                parts.append(spans[at][0])
                rows.append(k)
        dealt = batch.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), *(dealt[c] for c in names)], ["part", *names])


class _Open:
    """The rules of one host key whose interval is open, found by the lengths of their paths."""

    def __init__(self, key: str):
        self.key, self.by_path, self.lengths = key, {}, set()

    def add(self, host: str, path: str, verdict: str) -> None:
        if self.by_path.get(path, (None, None))[1] != "block":
            self.by_path[path] = (host, verdict)
        self.lengths.add(len(path))

    def fit(self, path: str) -> Iterator[tuple]:
        for n in self.lengths:
            if n <= len(path) and (found := self.by_path.get(path[:n])):
                yield len(found[0]) + n, len(found[0]), found[0] + path[:n], found[1]


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (part, key, rules first), with a stack of the rules that are open, outermost first."""
    part, stack = None, []
    for batch in batches:
        named, judged = [], []
        columns = [batch[c].to_pylist() for c in ("part", "key", "path", "rule_host", "verdict")]
        for at, key, path, rule_host, verdict in zip(*columns):
            if at != part:
                part, stack = at, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if rule_host is not None:
                if not stack or stack[-1].key != key:
                    stack.append(_Open(key))
                stack[-1].add(rule_host, path, verdict)
                continue
            best = max((fit for rules in stack for fit in rules.fit(path)), default=(0, 0, None, default))
            named.append(best[2])
            judged.append(best[3])
        urls = batch.filter(pc.is_null(batch["rule_host"]))
        yield pa.RecordBatch.from_arrays(
            [*(urls[c] for c in ("page_id", "url", "host", "path")), pa.array(named, pa.string()), pa.array(judged, pa.string())],
            ["page_id", "url", "host", "path", "rule", "verdict"],
        )


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per page: page_id, url, host, path, rule (host and path of the rule that decided, else null), verdict.

    `rules` has host, path and verdict (allow or block). A rule fits its host and all hosts below it if the URL's
    path begins with the rule's; the longest host and path together wins, then the longer host, then block.
    Without a rule the verdict is `default`. A null URL or one without `://` has empty host and path and fits no
    rule. Rules without a host are left out, a null path is empty, a rule that repeats counts once. Repeated
    pages are judged each. Other columns are not read; empty tables are fine on either side.
    """
    urls = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
    ).withColumn("key", host_key(F.col("host")))
    # Stored, so that every later job sees the same ranges.
    ranged = cut_lineage(urls.repartitionByRange("key", "path", "page_id").withColumn("part", F.spark_partition_id()))
    # One row per range: as many as there are partitions, whatever the data.
    spans = ranged.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most")).collect()
    spans = sorted(tuple(s) for s in spans)
    asked = rules.where("host <> ''").select(
        F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("path"), "verdict",
    ).distinct().withColumn("key", host_key(F.col("rule_host")))
    dealt = asked.mapInArrow(
        lambda batches: _deal(batches, spans), "part int, key string, path string, rule_host string, verdict string",
    )
    none = F.lit(None)
    rows = ranged.select("part", "key", "path", "page_id", "url", "host", none.cast("string").alias("rule_host"), none.cast("string").alias("verdict"))
    rows = rows.unionByName(dealt.select(
        "part", "key", "path", none.cast("long").alias("page_id"), none.cast("string").alias("url"), none.cast("string").alias("host"), "rule_host", "verdict",
    ))
    swept = rows.repartition("part").sortWithinPartitions("part", "key", F.col("rule_host").isNull())
    return swept.mapInArrow(
        lambda batches: _sweep(batches, default), "page_id long, url string, host string, path string, rule string, verdict string",
    )
