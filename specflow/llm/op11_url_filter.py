"""URL filter: allow and block rules in a trie of reversed host labels and path segments.

A rule has a host (it fits the host itself and all its subdomains) and a path that the
url's path must start with.  Of all rules that fit a url the longest wins: first the one
with more host labels, then the one with the longer path; of equal rules, block.

The rules are built into one trie: host labels from the last to the first, then the
path's segments, and at a node the rest of a path behind its last slash.  A trie of at
most ``trie_bytes`` is broadcast and every url walks it once.  Larger rule sets aren't
broadcast: the urls' own (host suffix, path directory) pairs, no deeper than the deepest
rule, are joined with the rules' on equality, which is the same walk as a join.

Defined results: a null url, or one without ``://``, has an empty host and path, which
only a rule with an empty host and path fits; null hosts and paths of rules count as
empty, null actions as block; an empty table gives an empty result.  Rows keep their
number, repeated and null ids included.  Other columns of the pages are left behind.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed values: (action, host, path) of the registered query's rules.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Bytes of rule text up to which the trie is broadcast.
TRIE_BYTES = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_FOUND = "rule string, action string"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: from the first :// up to /, ? or #, A-Z lower-cased; then up to ? or #."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(u, _URL, 1), _UPPER, _LOWER), F.regexp_extract(u, _URL, 2)


class Trie:
    """Rules by host label, last label first, and below each host by path segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for action, host, path in rules:
            node = self.root
            for label in _labels(host):
                node = node.setdefault("hosts", {}).setdefault(label, {})
            *segments, rest = path.split("/")
            node = node.setdefault("paths", {})
            for s in segments:
                node = node.setdefault("next", {}).setdefault(s, {})
            ends = node.setdefault("ends", {})
            if ends.get(rest, ("", "allow"))[1] != "block":
                ends[rest] = (host + path, action)
        _sort_ends(self.root)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The (rule, action) that wins, or None."""
        at, nodes = self.root, [self.root]
        for label in _labels(host):
            at = at.get("hosts", {}).get(label)
            if at is None:
                break
            nodes.append(at)
        for node in reversed(nodes):  # the longest host first
            best, start = None, 0
            at = node.get("paths")
            while at is not None:
                for rest, hit in at.get("ends", ()):  # the longest first
                    if path.startswith(rest, start):
                        best = hit
                        break
                slash = path.find("/", start)
                if slash < 0:
                    break
                at = at.get("next", {}).get(path[start:slash])
                start = slash + 1
            if best:
                return best
        return None


def _labels(host: str) -> list[str]:
    return host.split(".")[::-1] if host else []


def _sort_ends(root: dict) -> None:
    stack = [root]
    while stack:
        node = stack.pop()
        if "ends" in node:
            node["ends"] = sorted(node["ends"].items(), key=lambda e: -len(e[0]))
        stack += [*node.get("hosts", {}).values(), *node.get("next", {}).values(), *([node["paths"]] if "paths" in node else [])]


def url_filter(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] | None = None, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    ``rules`` are (action, host, path) rows or a DataFrame with these columns; ``rule`` is
    the winner's host and path, else null; ``verdict`` its action, else ``default``.
    """
    spark = pages.sparkSession
    if rules is None or isinstance(rules, list):
        rules = spark.createDataFrame(RULES if rules is None else rules, "action string, host string, path string")
    r = rules.select(F.when(F.col("action") == "allow", "allow").otherwise("block").alias("action"),
                     F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
                     F.coalesce("path", F.lit("")).alias("path"))
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    size = r.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 16)).first()[0] or 0
    found = _walked(urls, r) if size <= trie_bytes else _joined(urls, r)
    return found.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def _walked(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each url walks the broadcast trie."""
    trie = urls.sparkSession.sparkContext.broadcast(Trie([(r["action"], r["host"], r["path"]) for r in rules.collect()]))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column("host").to_pylist(), b.column("path").to_pylist())
            hits = [trie.value.find(h, p) or (None, None) for h, p in pairs]
            cols = [pa.array([x[i] for x in hits], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=["page_id", "host", "path", "rule", "action"])

    return urls.mapInArrow(walk, f"page_id long, host string, path string, {_FOUND}")


def _joined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same by joins on (host suffix, path directory), for rules too large to broadcast."""
    labels = F.reverse(F.split("host", r"\."))
    rules = materialize(rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # block after allow
                        .withColumn("dir", F.regexp_extract("path", "(?s)^(.*/)?", 1))
                        .withColumn("depth", F.when(F.col("host") == "", 0).otherwise(F.size(labels)))
                        .withColumn("dirs", F.size(F.split("dir", "/")) - 1), "url-rules")
    deep = rules.agg(F.coalesce(F.max("depth"), F.lit(0)), F.coalesce(F.max("dirs"), F.lit(0))).first()
    each = urls.select("host", "path").distinct()
    suffixes = F.transform(F.sequence(F.lit(0), F.when(F.col("host") == "", 0).otherwise(F.least(F.size(labels), F.lit(deep[0])))),
                           lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.reverse(F.slice(labels, F.lit(1), k)), ".")))
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(deep[1]))),
                          lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))))
    keys = each.select("host", "path", F.explode(suffixes).alias("r_host")).select("*", F.explode(folders).alias("dir"))
    hit = (keys.join(rules.withColumnsRenamed({"host": "r_host", "path": "r_path"}), ["r_host", "dir"])
           .filter(F.expr("startswith(path, r_path)"))
           .groupBy("host", "path").agg(F.max(F.struct("depth", F.length("r_path").alias("n"), F.concat("r_host", "r_path").alias("rule"), "action")).alias("w"))
           .select("host", "path", "w.rule", "w.action"))
    return urls.join(hit, ["host", "path"], "left").select("page_id", "host", "path", "rule", "action")
