"""URL filter: a trie over reversed host labels and path segments, sent to every task, longest match wins.

The rule list is part of the code or configuration that calls it, and its size is checked against
``MAX_RULES`` before it is shipped; the URLs are only ever streamed, so there is no shuffle.

Defined results: a null URL, or one without ``://``, has an empty host and path and so takes the default
verdict, as does a URL that no rule fits. A host is compared as written (port and user included), with
only A-Z lowered. Of two rules that fit, the one with more host labels wins, then the one with the longer
path; of an allow and a block entry for the same place, block wins. A rule path is a plain prefix. URLs of any length
are judged whole, repeated rows each on their own; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import map_arrow

MAX_RULES = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL column, as Catalyst expressions."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


class UrlTrie:
    """Nodes are dicts: host labels from the right, then ``/`` to the path tree, whose nodes hold the
    remaining prefixes (the part of a rule path after its last slash) under ``""``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        rules = list(rules)
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are sent to the tasks")
        self.root: dict = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"unknown verdict {verdict!r}")
            node = self.root
            for label in self._labels(host.translate(str.maketrans(_UPPER, _LOWER))):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            *whole, tail = path.split("/")
            for segment in whole:
                node = node.setdefault("/" + segment, {})
            tails = node.setdefault("", {})
            if tails.get(tail, ("", ""))[1] != "block":
                tails[tail] = (host + path, verdict)

    @staticmethod
    def _labels(host: str) -> list[str]:
        return ["." + x for x in reversed(host.split("."))] if host else []

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest match."""
        node, trees = self.root, [self.root.get("/")]
        for label in self._labels(host):
            node = node.get(label)
            if node is None:
                break
            trees.append(node.get("/"))
        segments = path.split("/")
        for tree in reversed(trees):
            found = None
            for k, segment in enumerate(segments):
                if tree is None:
                    break
                here = [t for t in tree.get("", ()) if "/".join(segments[k:]).startswith(t)]
                if here:
                    found = tree[""][max(here, key=len)]
                tree = tree.get("/" + segment)
            if found:
                return found
        return None


def url_verdicts(
    pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row; only the id and the URL are read."""
    trie = UrlTrie(rules)
    host, path = url_parts(F.col(f"`{url_col}`").cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(trie)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        find = shared.value.find
        hits = [find(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
        rule = pa.array([h and h[0] for h in hits], pa.string())
        verdict = pa.array([h[1] if h else default for h in hits], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], ["page_id", "host", "path", "rule", "verdict"])

    slim = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    return map_arrow(slim, judge, "page_id long, host string, path string, rule string, verdict string")


#: The rules of query op8.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


OP8_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
