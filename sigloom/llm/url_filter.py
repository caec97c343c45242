"""URL filters: a trie over reversed host labels and path segments.

A rule is a host and a path; it fits the host and all its subdomains if the url's path starts with the rule's.
The host's labels are walked from the last to the first; each node on the way may hold a trie over path
segments. The longest rule wins: the most host labels first, then the longest path; for equal rules a block
entry beats an allow entry. A url that no rule fits gets the default verdict.

The rules are one broadcast trie if they are at most ``TRIE_RULES`` and ``TRIE_BYTES``; a longer list is joined on the
pairs of host suffix and rule path that can fit, with the same result. Urls are neither shuffled nor collected in
the first form; hosts of any frequency cost the same.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end.
Defined results: a null url and one without ``://`` have empty host and path; an empty host fits no rule. An
empty rule list gives the default. Rules with a null host, path or verdict are ignored. Every row is returned,
repeated ones too. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIE_RULES, TRIE_BYTES = 200_000, 16 << 20
RULES_SCHEMA = "host string, path string, verdict string"


class Trie:
    """Nodes are dicts: host labels, reversed, then under the key ``/`` path segments.

    A path of n slashes is n whole segments and a rest; a node's key ``""`` holds ``(rest, verdict)`` entries,
    longest first, as a rule may end inside a segment."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, verdict in sorted(rules, key=lambda r: r[2] != "block"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault((label,), {})
            node = node.setdefault("/", {})
            *segments, rest = path.split("/")
            for s in segments:
                node = node.setdefault((s,), {})
            ends = node.setdefault("", [])
            if rest not in [e[0] for e in ends]:
                ends.append((rest, host + path, verdict))
                ends.sort(key=lambda e: -len(e[0]))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        node, found, segments = self.root, None, path.split("/")
        if not host:
            return None, None
        for label in reversed(host.split(".")):
            node = node.get((label,))
            if node is None:
                break
            at, i, best = node.get("/"), 0, None
            while at is not None:
                for rest, rule, verdict in at.get("", ()):
                    if segments[i].startswith(rest):
                        best = (rule, verdict)
                        break
                at = at.get((segments[i],)) if i < len(segments) - 1 else None
                i += 1
            found = best or found
        return found or (None, None)


def host_and_path(url: str = "url"):
    """Native expressions for host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def _lower(host):
    """A-Z lower-cased and nothing else, for the hosts of urls and rules alike."""
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judge(pages: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow",
          trie_rules: int = TRIE_RULES, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``keep`` columns of ``pages`` with ``host, path, rule, verdict``; ``rules(host, path, verdict)``.
    Kept columns of these names give way."""
    rules = (rules.where("host is not null and path is not null and verdict is not null")
             .select(_lower(F.col("host")).alias("host"), "path", "verdict").distinct())
    keep = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(url)
    urls = pages.select(*[F.col(c) for c in keep], host.alias("__host"), path.alias("__path"))
    n, size = rules.agg(F.count("*"), F.sum(F.octet_length("host") + F.octet_length("path"))).first()
    if n > trie_rules or (size or 0) > trie_bytes:
        return _joined(urls, rules, keep, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in rules.collect()]))

    @F.pandas_udf("rule string, verdict string")
    def look_up(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([trie.value.match(h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"])

    return (urls.withColumn("__m", look_up("__host", "__path"))
            .select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__m.rule").alias("rule"),
                    F.coalesce("__m.verdict", F.lit(default)).alias("verdict")))


def _joined(urls: DataFrame, rules: DataFrame, keep: list[str], default: str) -> DataFrame:
    """The same by joins on distinct (host, path) pairs: host suffixes and path prefixes of the lengths in use."""
    pairs = urls.select("__host", "__path").distinct()
    labels = F.split("__host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)),
                         lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = pairs.where("__host <> ''").select("__host", "__path", F.explode(suffix).alias("host"))
    lengths = rules.select("host", F.length("path").alias("n")).distinct()
    fits = (keys.join(lengths, "host").where(F.length("__path") >= F.col("n"))
            .withColumn("path", F.expr("left(__path, n)")).join(rules, ["host", "path"]))
    order = Window.partitionBy("__host", "__path").orderBy(F.length("host").desc(), F.col("n").desc(), F.col("verdict") != "block")
    best = (fits.withColumn("r", F.row_number().over(order)).where("r = 1")
            .select("__host", "__path", F.concat("host", "path").alias("rule"), "verdict"))
    return (urls.join(best, ["__host", "__path"], "left")
            .select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), "rule",
                    F.coalesce("verdict", F.lit(default)).alias("verdict")))
