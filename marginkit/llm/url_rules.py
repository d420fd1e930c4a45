"""URL allow and block rules: longest match over a trie of reversed host labels and path
segments.

A rule is ``(verdict, host, path)``. It fits its host and all subdomains, if the URL's
path starts with the rule's path. Among the rules that fit, the one with the most host
labels wins, then the longest path; an allow beats an equal block. URLs no rule fits get
the default verdict.

Edge cases: a null URL, or one without ``://``, has an empty host and path and gets the
default (unless a rule has an empty host, which fits every URL). Rows are kept as they
are: repeated rows give repeated results, an empty table gives an empty one, other
columns are not looked at.

Rules are a list, or a table with those three columns. Up to ``MAX_BROADCAST_RULES``
rules (counted first) the trie is broadcast; beyond that the rules stay distributed and
every URL joins its own host suffixes and path folders against them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, fold, materialise

MAX_BROADCAST_RULES = 200_000


class RuleTrie:
    """Host labels from the right, then path segments; a path need not end at a slash,
    so the rest after a rule's last slash is kept beside the node."""

    def __init__(self, rules):
        self.root = {"kids": {}, "bare": None, "path": {"kids": {}, "tails": {}}}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["kids"].setdefault(label, {"kids": {}, "bare": None, "path": {"kids": {}, "tails": {}}})
            entry = (f"{host}{path}", verdict)
            if path == "":
                node["bare"] = self._better(node["bare"], entry)
                continue
            at = node["path"]
            *folders, tail = path.split("/")
            for segment in folders:
                at = at["kids"].setdefault(segment, {"kids": {}, "tails": {}})
            at["tails"][tail] = self._better(at["tails"].get(tail), entry)

    @staticmethod
    def _better(old, new):
        return new if old is None or new[1] == "allow" else old

    @staticmethod
    def _in_path(at, path):
        best, rest = None, path
        while at is not None:
            fits = [t for t in at["tails"] if rest.startswith(t)]
            if fits:
                best = at["tails"][max(fits, key=len)]
            segment, slash, rest = rest.partition("/")
            at = at["kids"].get(segment) if slash else None
        return best

    def match(self, host, path):
        """(rule, verdict) of the longest match, or (None, None)."""
        best, node = None, self.root
        labels = host.split(".") if host else []
        while node is not None:
            best = self._in_path(node["path"], path) or node["bare"] or best
            node = node["kids"].get(labels.pop()) if labels else None
        return best or (None, None)


def parse_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` and ``path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    return df.select(
        F.struct("*").alias("_row"),
        fold(F.regexp_extract(text, "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(text, "://[^/?#]*([^?#]*)", 1).alias("path"))


def judge_urls(pages: DataFrame, rules, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict."""
    if isinstance(rules, DataFrame):
        rules = materialise(rules.select("verdict", "host", "path"), "url-rules")
        if rules.count() > MAX_BROADCAST_RULES:
            return _judge_by_join(pages, rules, key, url, default)
        rules = [tuple(r) for r in rules.collect()]
    elif len(rules) > MAX_BROADCAST_RULES:
        spark = pages.sparkSession
        return _judge_by_join(pages, spark.createDataFrame(rules, "verdict string, host string, path string"), key, url, default)
    trie = Shared(pages.sparkSession, RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def match(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        t = trie.value
        return pd.DataFrame([t.match(h, p) for h, p in zip(host, path)], columns=["rule", "verdict"], dtype=object)

    return (parse_url(pages.select(key, url), url)
            .select(F.col(f"_row.{key}").alias(key), "host", "path", match("host", "path").alias("_m"))
            .select(key, "host", "path", F.col("_m.rule").alias("rule"),
                    F.coalesce("_m.verdict", F.lit(default)).alias("verdict")))


def _judge_by_join(pages, rules, key, url, default):
    """The same result without a broadcast: candidates of each distinct host and path are
    its host suffixes times the folders of its path (both bounded by the URL's length)."""
    parsed = parse_url(pages.select(key, url), url)
    cut = F.length(F.regexp_extract("path", "^(.*/)?", 1))
    keyed = rules.select(
        "verdict", F.col("host").alias("_host"), F.substring(F.col("path"), F.lit(1), cut).alias("_folder"),
        F.expr("substring(path, length(regexp_extract(path, '^(.*/)?', 1)) + 1)").alias("_tail"),
        F.concat("host", "path").alias("rule"), F.col("path").alias("_rule_path"))
    unique = parsed.select("host", "path").distinct()
    suffixes = F.expr("concat(array(''), filter(transform(sequence(1, size(split(host, '[.]'))), "
                      "i -> array_join(slice(split(host, '[.]'), -i, i), '.')), s -> s <> ''))")
    folders = F.expr("concat(array(''), filter(transform(sequence(1, size(split(path, '/'))), "
                     "i -> array_join(slice(split(path, '/'), 1, i), '/') || '/'), f -> startswith(path, f)))")
    best = (unique.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("_host"))
            .select("*", F.explode(F.array_distinct(folders)).alias("_folder"))
            .join(keyed, ["_host", "_folder"])
            .where(F.expr("startswith(substring(path, length(_folder) + 1), _tail)"))
            .where("_rule_path = '' or path <> ''")
            .groupBy("host", "path")
            .agg(F.max(F.struct(F.when(F.col("_host") == "", 0).otherwise(F.size(F.split("_host", "[.]"))).alias("a"),
                                F.length("_rule_path").alias("b"), (F.col("verdict") == "allow").alias("c"),
                                "rule", "verdict")).alias("_m")))
    return (parsed.join(best, ["host", "path"], "left")
            .select(F.col(f"_row.{key}").alias(key), "host", "path", F.col("_m.rule").alias("rule"),
                    F.coalesce("_m.verdict", F.lit(default)).alias("verdict")))
