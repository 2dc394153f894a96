"""URL filters: allow and block rules for a host, its subdomains and a path prefix, in a sorted digest array.

Each rule is stored under the key ``host`` + NUL + ``path``. A url asks for the suffixes of its host
with as many labels as some rule's host, with every path prefix of a length that some rule has; all keys of a batch are probed by vectorised
binary search. The longest stored rule (host and path together, then host) gives the verdict.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. Equal rules
with both verdicts block. Rules with a null host, path or verdict are ignored. Repeated urls are judged row by row;
an empty rule table allows all. Extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphbatch.llm.common import scratch_path
from graphbatch.llm.digest_index import DigestIndex, build_index

DEFAULT_VERDICT = "allow"
SCHEMA = "page_id long, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def rule_entries(rules: DataFrame) -> DataFrame:
    """Index rows of (host, path, verdict) rules. 'block' sorts behind 'allow', so the stored value of a block is the smaller one."""
    known = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
    return known.select(F.concat_ws("\0", "host", "path").cast("binary").alias("key"), F.when(F.col("verdict") == "block", "0").otherwise("1").cast("binary").alias("value"))


def build_rule_index(rules: DataFrame, uri: str) -> dict:
    """Index the rules and return what a probe must know: where it is, its shards, and the lengths of the rules' paths and hosts (in labels)."""
    known = rules.where(F.col("path").isNotNull() & F.col("host").isNotNull())
    lengths = [r[0] for r in known.select(F.length("path")).distinct().collect()]  # at most one number per path length
    labels = [r[0] for r in known.select(F.size(F.split("host", r"\."))).distinct().collect()]  # at most one per number of labels
    return {"uri": uri, "shards": build_index(rule_entries(rules), uri), "lengths": sorted(lengths), "labels": sorted(labels)}


def candidates(host: str, path: str, lengths: list[int], labels: list[int]) -> list[tuple[str, str]]:
    """Suffixes of the host with as many labels as some rule has, with prefixes of the path; the time is linear in the url."""
    parts = host.rsplit(".", max(labels, default=0)) if host else []
    if len(parts) > max(labels, default=0):
        parts = parts[1:]  # what is left of the longest suffix
    hosts = [".".join(parts[-n:]) for n in labels if n <= len(parts)]
    paths = [path[:n] for n in lengths if n <= len(path)]
    return [(h, p) for h in hosts for p in paths]


def judge_urls(pages: DataFrame, index: dict, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    asked = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = DigestIndex.cached(index["uri"], index["shards"])
        for b in batches:
            found: list[tuple[str | None, str]] = [(None, DEFAULT_VERDICT)] * len(b)
            best = [(-1, -1)] * len(b)
            asked = [(k, h, p) for k, (host, path) in enumerate(zip(b["host"], b["path"], strict=True)) for h, p in candidates(host, path, index["lengths"], index["labels"])]
            for (k, h, p), value in zip(asked, table.lookup([f"{h}\0{p}".encode() for _, h, p in asked]), strict=True):
                if value is not None and (size := (len(h) + len(p), len(h))) > best[k]:
                    best[k], found[k] = size, (h + p, "block" if value == b"0" else "allow")
            yield b.assign(rule=[r for r, _ in found], verdict=[v for _, v in found])

    return asked.mapInPandas(judge, SCHEMA)


def filter_urls(pages: DataFrame, rules: DataFrame, index_uri: str | None = None) -> DataFrame:
    """Build the index in the shared folder (or at ``index_uri``) and judge every page."""
    return judge_urls(pages, build_rule_index(rules, index_uri or scratch_path(pages.sparkSession, "url-rules")))
