"""URL filter: a broadcast trie over reversed host labels and path segments.

A rule (verdict, host, path) fits its host and all subdomains when the url's path starts
with the rule's path. The rule with the longest host wins, then the one with the longest
path; of an allow and a block rule for the same place the block rule wins. Urls that no
rule fits get ``default``.

Defined cases: a null url, or one without ``://``, has an empty host and path, which only a
rule with an empty host could fit. A port or user name counts as part of the host, as
written. Rows and their other columns stay as they are; copies of a row are judged alike.
No rules: every url gets the default. Urls of any length are read whole. An empty table gives an
empty result; the added column changes its name where the table has it.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specflow.llm.common import fresh

Rule = tuple[str, str, str]

#: rules per broadcast trie; more rules make more tries, each url passes through all of them
RULES_PER_TRIE = 500_000

_FOUND = "host string, path string, labels int, length int, rule string, verdict string"
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "#?":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_UPPER), slash + path


class PathNode:
    __slots__ = ("segments", "ends")

    def __init__(self) -> None:
        self.segments: dict[str, PathNode] = {}
        #: beginnings of the next segment at which a rule ends, with the rule
        self.ends: dict[str, Rule] = {}


class HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self) -> None:
        self.labels: dict[str, HostNode] = {}
        self.paths: PathNode | None = None


def build_trie(rules: Iterable[Rule]) -> HostNode:
    root = HostNode()
    for verdict, host, path in rules:
        node = root
        for label in reversed(host.translate(_UPPER).split(".")):
            node = node.labels.setdefault(label, HostNode())
        node.paths = node.paths or PathNode()
        place = node.paths
        *whole, last = path.split("/")
        for segment in whole:
            place = place.segments.setdefault(segment, PathNode())
        if place.ends.get(last, ("allow",))[0] != "block":
            place.ends[last] = (verdict, host, path)
    return root


def best_path(place: PathNode | None, segments: list[str]) -> Rule | None:
    best = None
    for segment in segments:
        if place is None:
            break
        if place.ends:
            fitting = [end for end in place.ends if segment.startswith(end)]
            if fitting:
                best = place.ends[max(fitting, key=len)]
        place = place.segments.get(segment)
    return best


def judge(root: HostNode, host: str, path: str) -> tuple[int, Rule] | None:
    """Number of host labels and the rule that wins, if any fits."""
    segments = path.split("/")
    node, found = root, None
    for depth, label in enumerate(reversed(host.split(".")), 1):
        node = node.labels.get(label)
        if node is None:
            break
        rule = best_path(node.paths, segments)
        if rule:
            found = depth, rule
    return found


def look_up_in(shared):
    """Column function of (url, what earlier tries found) for the rules of one broadcast trie."""

    @F.pandas_udf(_FOUND)
    def look_up(urls: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        root, rows = shared.value, []
        known = zip(before["labels"], before["length"], before["rule"], before["verdict"])
        for link, (labels, length, rule, verdict) in zip(urls, known):
            host, path = split_url(link)
            best = judge(root, host, path)
            if best:
                rank = best[0], len(best[1][2])
                if rank > (labels, length) or rank == (labels, length) and best[1][0] == "block":
                    (labels, length), rule, verdict = rank, best[1][1] + best[1][2], best[1][0]
            rows.append((host, path, labels, length, rule, verdict))
        return pd.DataFrame(rows, columns=["host", "path", "labels", "length", "rule", "verdict"])

    return look_up


def judge_urls(
    df: DataFrame, rules: Iterable[Rule], url: str = "url", out: str = "judged", default: str = "allow",
    per_trie: int = RULES_PER_TRIE,
) -> DataFrame:
    """Adds ``out``, a struct of host, path, rule (``host`` + ``path`` of the rule, or null) and verdict."""
    rules = list(rules)
    context = df.sparkSession.sparkContext
    (found,) = fresh(df, "_found")
    none = F.lit(None).cast("string")
    last = F.struct(
        none.alias("host"), none.alias("path"), F.lit(0).alias("labels"), F.lit(-1).alias("length"),
        none.alias("rule"), none.alias("verdict"),
    )
    for start in range(0, max(len(rules), 1), per_trie):
        last = look_up_in(context.broadcast(build_trie(rules[start : start + per_trie])))(F.col(url), last)
    picked = F.struct(
        F.col(f"{found}.host").alias("host"), F.col(f"{found}.path").alias("path"),
        F.col(f"{found}.rule").alias("rule"), F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"),
    )
    names = [c for c in df.columns if c.lower() != out.lower()]
    return df.withColumn(found, last).select(*[F.col(f"`{c}`") for c in names], picked.alias(out))
