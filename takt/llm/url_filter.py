"""URL filter: prefix rules as nested intervals of reversed-host keys, met by a sorted sweep."""
from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
RULES_A_SWEEP = 100_000
AFTER = chr(0x10FFFF)


@dataclass(frozen=True)
class Rule:
    """verdict for all urls of a host and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
         Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"))


def reversed_host(host: str) -> str:
    """Labels from the last to the first, each closed by a dot: a domain's key is a prefix of its subdomains'."""
    return ".".join(reversed(host.split("."))) + "."


class Sweep:
    """Rules sorted by their canonical key: rule path, a separator, reversed host.

    A rule's hosts are the interval of keys that start with its own, and such intervals nest or are disjoint. A
    url asks with one key for each rule path that its own path starts with; the longest rule of all wins (of
    equally long ones the one with the longer host).
    """

    def __init__(self, rules: Sequence[Rule]):
        self.rules = sorted(((f"{r.path}\0{reversed_host(r.host)}", r) for r in set(rules)), key=lambda x: (x[0], x[1].verdict))
        self.paths = {r.path for r in rules}
        self.lengths = sorted({len(p) for p in self.paths})

    def keys(self, host: str, path: str) -> Iterator[str]:
        for n in self.lengths:
            if n > len(path):
                return
            if path[:n] in self.paths:
                yield f"{path[:n]}\0{reversed_host(host)}"

    def judge(self, urls: Sequence[tuple[str, str]]) -> list[Rule | None]:
        """The winning rule of each (host, path): keys and rules are swept in order with a stack of open rules."""
        best: list[Rule | None] = [None] * len(urls)
        asked = sorted((k, i) for i, (h, p) in enumerate(urls) for k in self.keys(h, p))
        stack: list[tuple[str, Rule]] = []
        at = 0
        for key, i in asked:
            while at < len(self.rules) and self.rules[at][0] <= key:
                start, rule = self.rules[at]
                while stack and not start.startswith(stack[-1][0]):
                    stack.pop()
                stack.append((start, rule))
                at += 1
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if stack and (best[i] is None or rank(stack[-1][1]) > rank(best[i])):
                best[i] = stack[-1][1]
        return best


def rank(rule: Rule) -> tuple[int, int]:
    return len(rule.text), len(rule.host)


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = DEFAULT, rules_a_sweep: int = RULES_A_SWEEP) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages; rule is NULL and verdict the default where none fits.

    host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to
    ``?``, ``#`` or the end. A NULL url or one without ``://`` has both empty. An empty path starts with no rule
    path but an empty one. Of rules alike in host and path the last verdict by name counts. Repeated rows are
    judged alike, an empty table gives none, other columns are not read. Every task sorts its own batch and
    sweeps it with the rules, so nothing is shuffled. A sweep takes ``rules_a_sweep`` rules at most; a longer
    list is cut into several sweeps over the batch and the longest rule of all of them wins.
    """
    ordered = sorted(set(rules), key=lambda r: (r.path, reversed_host(r.host), r.verdict))
    parts = [tuple(ordered[i:i + rules_a_sweep]) for i in range(0, len(ordered), rules_a_sweep)]
    rest = F.substring_index("url", "://", 1)
    after = F.when(F.instr("url", "://") > 0, F.substring(F.col("url"), F.length(rest) + 4, F.length("url"))).otherwise("")
    split = pages.select(F.col("page_id").cast("long"), F.coalesce(after, F.lit("")).alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*)?", 1).alias("path"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweeps = [Sweep(p) for p in parts]
        for batch in batches:
            urls = list(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()))
            best: list[Rule | None] = [None] * len(urls)
            for sweep in sweeps:
                best = [max((x for x in (a, b) if x), key=rank, default=None) for a, b in zip(best, sweep.judge(urls))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.text if r else None for r in best], pa.string()),
                 pa.array([r.verdict if r else default for r in best], pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    return split.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


ORACLE = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(rest, '') AS rest FROM cut),
urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM parts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fit AS (SELECT u.*, r.h || r.p AS rule, r.verdict,
               row_number() OVER (PARTITION BY page_id ORDER BY CASE WHEN r.h IS NULL THEN 1 ELSE 0 END, length(r.h || r.p) DESC) AS rn
        FROM urls u LEFT JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE rn = 1
"""
