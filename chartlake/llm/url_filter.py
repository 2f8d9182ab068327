"""URL rules as a sort-merge range join.

A host with its labels reversed turns "this host and all its subdomains" into one interval of the sorted
host keys, and such intervals nest. Rules and URLs are sorted together in one range shuffle; every partition
is swept once with a stack of the rule hosts whose interval holds the current key. A rule host that opens in
an earlier partition reaches a later one as a carried row: the host prefixes of the partition's first key,
joined with the rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlake.llm.common import staged

_SEP = "\x01"
_EVENT = ["pid", "host_key", "kind", "path", "tie", "page_id", "host", "rule", "verdict"]
_OUT = "page_id long, host string, path string, rule string, verdict string"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _SEP), F.lit(_SEP))


class _Active:
    """A rule host on the stack: its paths, by length."""

    def __init__(self, key: str) -> None:
        self.key, self.by_length = key, {}

    def add(self, path: str, rule: str, verdict: str) -> None:
        self.by_length.setdefault(len(path), {})[path] = (rule, verdict)

    def match(self, path: str) -> tuple[str, str] | None:
        for n in sorted(self.by_length, reverse=True):
            if n <= len(path) and (hit := self.by_length[n].get(path[:n])):
                return hit
        return None


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[_Active] = []
        current = None
        for batch in batches:
            out: list[tuple] = []
            for pid, key, kind, path, page_id, host, rule, verdict in zip(*(batch.column(c).to_pylist() for c in ("pid", "host_key", "kind", "path", "page_id", "host", "rule", "verdict")), strict=True):
                if pid != current:
                    stack, current = [], pid
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind < 2:
                    if not stack or stack[-1].key != key:
                        stack.append(_Active(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                hits = [hit for a in stack if (hit := a.match(path))] if host else []
                best = max(hits, key=lambda h: len(h[0])) if hits else (None, default)
                out.append((page_id, host, path, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()), strict=True)], names=["page_id", "host", "path", "rule", "verdict"])

    return run


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (host and path of the rule that won, or null) and verdict.

    ``rules`` has host, path and verdict; its size is free, nothing is broadcast. The rule with the longest
    text wins (host and path together), of equally long ones that with the shorter host; of rules with equal
    host and path the least verdict. A null url, or one without ``://``, has empty host and path and gets the
    default, as does a host that no rule covers. Rules with a null or empty host fit nothing; a null rule path is
    empty. Repeated pages are judged each; an empty page table gives no rows; other columns are not read.
    """
    r = rules.where("host is not null and host <> ''").select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    r = r.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(host_key(F.col("host")).alias("host_key"), F.lit(1).alias("kind"), "path", F.lit(0).cast("long").alias("tie"), F.lit(None).cast("long").alias("page_id"), "host", F.concat("host", "path").alias("rule"), "verdict")
    u = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    none = F.lit(None).cast("string")
    u = u.select(host_key(F.col("host")).alias("host_key"), F.lit(2).alias("kind"), "path", F.xxhash64("page_id", "path").alias("tie"), "page_id", "host", none.alias("rule"), none.alias("verdict"))
    order = ["host_key", "kind", "path", "tie"]
    events = staged(r.unionByName(u).repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "urls")
    firsts = events.groupBy("pid").agg(F.min("host_key").alias("first"))
    labels = F.split(F.rtrim(F.col("first"), F.lit(_SEP)), _SEP)
    opened = firsts.select("pid", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), _SEP), F.lit(_SEP)))).alias("host_key"))
    carried = opened.join(r.withColumn("kind", F.lit(0)), "host_key")
    dealt = events.select(*_EVENT).unionByName(carried.select(*_EVENT)).repartition("pid").sortWithinPartitions("pid", *order)
    # a carried host is a prefix of the first key, so it sorts before it
    return dealt.mapInArrow(_sweep(default), _OUT)
