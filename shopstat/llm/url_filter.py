"""URL filter: a broadcast trie with longest-match precedence (operator 10).

The trie's keys are the host labels in reverse (``com``, ``example``,
``www``), then the path cut after each ``/``.  A walk along a url's labels
and path pieces meets every rule that fits; the deepest wins: the rule with
the longer host, then the longer path.  A rule whose path doesn't end in
``/`` keeps its last piece as a prefix on the node above.  If the same rule
is listed twice with both verdicts, block wins.

Beyond ``max_trie_bytes`` of rule text (checked before anything is sent),
``judge_by_join`` joins each url's host suffixes with the rules instead.

Defined results: a null url, or one without ``://``, has empty host and
path; no rule fits an empty host; without a rule the verdict is ``default``.
Every row is judged, repeated ones too; other columns pass through, and the
four result columns replace columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULE_SCHEMA = "host string, path string, verdict string"
MAX_TRIE_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleTrie:
    """Nested dicts: labels, then path pieces under ``"/"``; entries under None."""

    _PATHS, _ENTRY, _TAILS = 0, 1, 2

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        # block is put last, so it wins over an allow of the same rule
        for host, path, verdict in sorted(rules, key=lambda r: r[2] == "block"):
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(self._PATHS, {})
            *pieces, tail = path.split("/")
            for piece in pieces:
                node = node.setdefault(piece, {})
            if tail:
                node.setdefault(self._TAILS, {})[tail] = (host + path, verdict)
            else:
                node[self._ENTRY] = (host + path, verdict)

    def _deepest(self, node: dict, pieces: list[str]) -> tuple[str, str] | None:
        best = None
        for i, piece in enumerate(pieces):
            best = node.get(self._ENTRY, best)
            tails = node.get(self._TAILS)
            if tails:
                fits = [t for t in tails if piece.startswith(t)]
                if fits:
                    best = tails[max(fits, key=len)]
            node = node.get(piece) if i < len(pieces) - 1 else None
            if node is None:
                return best
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        if not host:
            return None
        node, best, pieces = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(self._PATHS)
            if paths is not None:
                best = self._deepest(paths, pieces) or best
        return best


def _split(urls: DataFrame, url: str) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    return urls.select(*rest, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))


def judge_by_trie(urls: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    trie = urls.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf(T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]))
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        match = trie.value.find
        for hosts, paths in batches:
            found = [match(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    judged = _split(urls, url).withColumn("_found", find("host", "path"))
    return judged.select(*[c for c in judged.columns if c != "_found"], "_found.rule", "_found.verdict")


def judge_by_join(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """The same verdicts for rule tables of any size: every url joins the
    rules of its host's suffixes (one row per label) and keeps the deepest."""
    split = _split(urls, url).withColumn("_id", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = split.filter("host <> ''").select("_id", F.col("path").alias("_p"), F.explode(suffixes).alias("_h"))
    r = rules.select(F.col("host").alias("_h"), F.col("path").alias("_rp"), F.col("verdict").alias("_v"))
    best = (keyed.join(r, "_h").filter(F.col("_p").startswith(F.col("_rp")))
            .groupBy("_id").agg(F.max(F.struct(F.length("_h").alias("a"), F.length("_rp").alias("b"),
                                               F.col("_v").alias("v"), F.concat("_h", "_rp").alias("rule"))).alias("_b")))
    out = split.join(best, "_id", "left")
    return out.select(*[c for c in split.columns if c != "_id"], F.col("_b.rule").alias("rule"),
                      F.coalesce(F.col("_b.v"), F.lit(default)).alias("verdict"))


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
                max_trie_bytes: int = MAX_TRIE_BYTES) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` and ``verdict``."""
    rules = rules.select("host", "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    size = rules.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 100), F.lit(0)).alias("n")).first()["n"]
    if size > max_trie_bytes:
        return judge_by_join(urls, rules, default, url)
    return judge_by_trie(urls, [tuple(r) for r in rules.collect()], default, url)
