"""URL filters: a sort-merge range join of urls with (host, path) rules.

A host is written with its labels reversed ("com.example.m."), so that a rule's host and all its subdomains are
one interval of keys. Urls and rules are dealt by key range, a rule to every range that its interval meets, and
sorted; one sweep over a range keeps a stack of the rules that are open there, each nested in the one below. Since
subdomains stand between a host and its paths in that order, intervals are of hosts; each open host has its rules'
paths at hand by their lengths.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls that are looked at to find the ranges' bounds, for each range; they only decide how rows are dealt.
BOUND_ROWS = 30


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _range_ids(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            ids = [bisect_right(bounds, x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *batch.columns[1:]], names=["range", *batch.schema.names[1:]])

    return place


def _rule_ranges(shared):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            ids, rows = [], []
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = range(bisect_right(bounds, key), bisect_right(bounds, key[:-1] + "/") + 1)  # "/" follows "."
                ids += own
                rows += [i] * len(own)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *taken.columns[1:]], names=["range", *batch.schema.names[1:]])

    return place


class Open:
    """The rules of one host that is open in the sweep, by path."""

    def __init__(self, key: str, host: str) -> None:
        self.key, self.host, self.paths, self.sizes = key, host, {}, []

    def add(self, path: str, verdict: str) -> None:
        if verdict == "block" or path not in self.paths:
            self.paths[path] = verdict
            self.sizes = sorted({len(p) for p in self.paths}, reverse=True)

    def longest(self, path: str) -> str | None:
        return next((path[:n] for n in self.sizes if n <= len(path) and path[:n] in self.paths), None)


def judge(stack: list[Open], host: str, path: str) -> tuple[str, str] | None:
    """The longest fitting rule and its verdict; of equally long ones the one with the longer host."""
    best = None
    for own in stack:
        if (found := own.longest(path)) is not None and (host == own.host or host.endswith("." + own.host)):
            if best is None or len(own.host) + len(found) >= best[0]:
                best = (len(own.host) + len(found), own.host + found, own.paths[found])
    return best and best[1:]


def _sweep(default: str):
    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []
        for batch in batches:
            col = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names[:6])}
            keep, rules, verdicts = [], [], []
            for i in range(batch.num_rows):
                if col["range"][i] != at:
                    at, stack = col["range"][i], []
                key, host, path = col["key"][i], col["host"][i], col["path"][i]
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if col["kind"][i] == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Open(key, host))
                    stack[-1].add(path, col["verdict"][i])
                else:
                    found = judge(stack, host, path)
                    keep.append(i)
                    rules.append(found and found[0])
                    verdicts.append(found[1] if found else default)
            rows = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(6), rows.column(3), rows.column(4), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["own", "host", "path", "rule", "verdict"])

    return sweep


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """All columns of ``pages`` with host, path, rule and verdict by ``rules`` (host, path, verdict: allow or block).

    A rule fits its host and all subdomains, if the url's path starts with the rule's. Without a fitting rule,
    rule is null and the verdict is ``default``; so for a null url or one without ``://``. Of equal rules block
    wins; rules with an empty host or a null part are left out. Equal urls are judged alike; an empty table
    gives an empty result; columns named like an output are replaced, all others come back whatever their names
    and types.
    """
    spark = pages.sparkSession
    columns = rest(pages, "host", "path", "rule", "verdict")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    url = F.col("url").cast("string")
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("own")
    rows = pages.select(own, host_of(url).alias("host"), path_of(url).alias("path"), F.xxhash64(url, F.monotonically_increasing_id()).alias("_row"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    # a host with many urls spans several ranges: its rows are told apart by a hash
    rows = rows.withColumn("dealt", F.concat("key", F.lit("\0"), F.lpad(F.hex("_row"), 16, "0")))
    some = rows.select("dealt", "_row").orderBy(F.xxhash64("_row")).limit(ranges * BOUND_ROWS).select("dealt").collect()
    bounds = spark.sparkContext.broadcast(sorted(r["dealt"] for r in some)[BOUND_ROWS::BOUND_ROWS])
    head = T.StructType.fromDDL("range int, kind int, key string, host string, path string, verdict string")
    kept = rows.schema["own"]
    urls = rows.select("dealt", F.lit(1).alias("kind"), "key", "host", "path", F.lit(None).cast("string").alias("verdict"), "own")
    urls = urls.mapInArrow(_range_ids(bounds), T.StructType([*head, kept]))
    named = rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict").filter("host <> '' and path is not null and verdict is not null")
    named = named.withColumn("key", host_key(F.col("host"))).select("key", F.lit(0).alias("kind"), F.col("key").alias("_k"), "host", "path", "verdict")
    named = named.mapInArrow(_rule_ranges(bounds), head)
    both = urls.unionByName(named, allowMissingColumns=True)
    dealt = both.repartition(ranges, "range").sortWithinPartitions("range", "key", "kind")
    out = dealt.mapInArrow(_sweep(default), T.StructType([kept, *T.StructType.fromDDL("host string, path string, rule string, verdict string")]))
    return out.select(*[F.col(f"own.`{c}`") for c in columns], "host", "path", "rule", "verdict")


#: The rules of the registered query.
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(h, q, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, h || q AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || q) DESC) AS k
      FROM p JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, q))
SELECT p.page_id, host, path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id AND m.k = 1
"""
