"""URL filter: allow and block rules in a trie over reversed host labels and path segments, broadcast
to the tasks; the longest fitting rule decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; urls that no
rule fits get ``DEFAULT_VERDICT``; a rule that appears twice counts once, and of two rules with the same
host and path the block wins; of fitting rules of one length, the longer host wins. Rows are judged one
by one; repeated rows and empty tables need nothing special.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VERDICT = "allow"
#: Upper bound of the broadcast rule text; larger lists are refused, not cut.
MAX_RULE_BYTES = 256 << 20
#: The rules of the registered query: (verdict, host, path) (fixed values of the contract).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))


def segments(path: str) -> list[str]:
    """Path pieces, each with its closing slash; the last may be open: /en/a -> '/', 'en/', 'a'."""
    return [s + "/" for s in path.split("/")[:-1]] + [path.rsplit("/", 1)[-1]]


class RuleTrie:
    """Host nodes: label -> node; at a node, a path trie: segment -> node, plus open last segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root = ({}, ({}, {}, []))
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, ({}, ({}, {}, [])))
            *whole, rest = segments(path)
            at = node[1]
            for s in whole:
                at = at[0].setdefault(s, ({}, {}, []))
            if rest:
                at[1][rest] = self._hold(at[1].get(rest), (host + path, verdict))
            else:
                at[2][:] = [self._hold(at[2][0] if at[2] else None, (host + path, verdict))]

    @staticmethod
    def _hold(old, new):
        return new if old is None or new[1] == "block" else old

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, with its verdict."""
        best, parts, node = None, segments(path) if path else [], self.root
        for label in reversed(host.split(".")):
            node = node[0].get(label)
            if node is None:
                break
            found = self._in_path(node[1], parts)
            if found and (best is None or len(found[0]) >= len(best[0])):
                best = found
        return best

    @staticmethod
    def _in_path(at, parts):
        found = at[2][0] if at[2] else None
        for part in parts:
            for k in range(1, len(part) + 1) if at[1] else ():
                found = at[1].get(part[:k], found)
            at = at[0].get(part)
            if at is None:
                break
            found = at[2][0] if at[2] else found
        return found


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule and verdict (columns of those names are replaced)."""
    rules = list(rules)
    size = sum(len(h) + len(p) for _, h, p in rules)
    if size > MAX_RULE_BYTES:
        raise ValueError(f"{size} bytes of rules; the bound of a broadcast is {MAX_RULE_BYTES}")
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(hosts, paths):
        import pandas as pd

        found = [trie.value.find(h, p) if h or p else None for h, p in zip(hosts, paths)]
        return pd.DataFrame({"rule": [f[0] if f else None for f in found],
                             "verdict": [f[1] if f else DEFAULT_VERDICT for f in found]}, dtype=object)

    rest = F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parsed = pages.drop("host", "path", "rule", "verdict").withColumns(
        {"host": F.translate(host, upper, upper.lower()), "path": path})
    return parsed.withColumn("__judged", judge("host", "path")).select(
        *parsed.columns, F.col("__judged.rule").alias("rule"), F.col("__judged.verdict").alias("verdict"))


_rules_sql = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLE = f"""
WITH r(verdict, rhost, rpath) AS (VALUES {_rules_sql}),
u AS (SELECT page_id, url, row_number() OVER () AS rid,
    CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT *, translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(verdict, length(rhost || rpath)) AS verdict FROM p JOIN r
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT_VERDICT}') AS verdict FROM p LEFT JOIN f USING (rid)"""
