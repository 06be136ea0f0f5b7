"""URL filters by a sort-merge range join.

A host's key is its labels in reverse, each closed by a zero byte, so a rule's host and all its subdomains are the keys
that start with the rule's key: an interval. Urls and rules are dealt into ranges of keys, a rule to each range that its
interval touches; every range is sorted and swept once, with a stack of the rules whose intervals are open. On a url the
stack holds the rules of its host and of the domains above it, of which those fit whose path starts its path. The longest
rule (host and path together, then host) wins.

Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. A null url or one
without :// has both empty and fits no rule. The key of a range also holds path and id, so a hot host is dealt over ranges.
Rules without a host are ignored, of equal rules the first by action counts. Repeated rows get a row each.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism

DEFAULT = "allow"
RANGES = 2000
SAMPLE = 20  # sampled keys for each range; they only place the cuts


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def key_of(host: str) -> bytes:
    return b"".join(label.encode() + b"\0" for label in reversed(host.split(".")))


def _place(host: str, path: str, tie: int) -> bytes:
    return key_of(host) + b"\0" + path.encode() + b"\0" + tie.to_bytes(8, "big", signed=True)


def _sweep(batches):
    """Rows sorted by key, rules before urls; a rule has an action."""
    stack: list[tuple[bytes, int, dict]] = []
    for batch in batches:
        ids, hosts, paths, rules, verdicts = [], [], [], [], []
        for key, page, host, path, action in zip(*(batch.column(c).to_pylist() for c in ("key", "page_id", "host", "path", "action"))):
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if action is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, len(host), {}))
                stack[-1][2].setdefault(path, (host, path, action))
                continue
            best = None
            for _, size, own in stack if host else ():
                fits = max((p for p in own if path.startswith(p)), key=len, default=None) if len(own) < 8 else next((path[:i] for i in range(len(path), -1, -1) if path[:i] in own), None)
                if fits is not None and (best is None or (size + len(fits), size) > best[0]):
                    best = (size + len(fits), size), own[fits]
            ids.append(page)
            hosts.append(host)
            paths.append(path)
            rules.append(best and best[1][0] + best[1][1])
            verdicts.append(best[1][2] if best else DEFAULT)
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], ["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of pages(page_id, url) under rules(host, path, action)."""
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    ranges = min(RANGES, 2 * parallelism(spark))
    sample = urls.orderBy(F.xxhash64("page_id", "host", "path")).limit(SAMPLE * ranges).collect()
    keys = sorted(_place(r.host, r.path, r.page_id or 0) for r in sample)
    cuts = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []
    shared = spark.sparkContext.broadcast(cuts)
    schema = "range int, key binary, page_id long, host string, path string, action string"
    names = ["range", "key", "page_id", "host", "path", "action"]

    def rows(range_, key, page, host, path, action):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((range_, key, page, host, path, action), (pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()))], names)

    def of_urls(batches):
        for b in batches:
            pages_, hosts, paths = (b.column(c).to_pylist() for c in ("page_id", "host", "path"))
            where = [bisect.bisect_right(shared.value, _place(h, p, i or 0)) for i, h, p in zip(pages_, hosts, paths)]
            yield rows(where, [key_of(h) for h in hosts], pages_, hosts, paths, [None] * len(hosts))

    def of_rules(batches):
        for b in batches:
            out = []
            for h, p, a in zip(*(b.column(c).to_pylist() for c in ("host", "path", "action"))):
                key = key_of(h)
                for i in range(bisect.bisect_right(shared.value, key), bisect.bisect_right(shared.value, key[:-1] + b"\1") + 1):
                    out.append((i, key, None, h, p, a))
            if out:
                yield rows(*zip(*out))

    known = rules.filter("host is not null and host <> '' and action is not null").select("host", F.coalesce("path", F.lit("")).alias("path"), "action")
    both = urls.select(F.col("page_id").cast("long").alias("page_id"), "host", "path").mapInArrow(of_urls, schema).unionByName(known.mapInArrow(of_rules, schema))
    dealt = both.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("key", F.col("action").asc_nulls_last(), "path")
    return dealt.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
