"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is a host and the beginning of a path.  It fits a url if the url's host is the
rule's or one of its subdomains and the url's path starts with the rule's.  The trie's
upper levels are host labels from the last one on (``org``, ``example``, ...); a node
that ends some rule's host carries a second trie over the path's segments.  All but
the last segment of a rule's path have to be equal, the last one is a beginning:
``/en/1`` fits ``/en/17``.  So one walk down the labels and, from each node that ends a
host, one walk down the segments meets every rule that fits, whatever their number.

Precedence: the longest rule (host and path, in characters) wins, whether it allows or
blocks; of equally long ones the one with the longer host, then the allowing one.

A trie of at most ``TRIE_RULES`` rules and ``TRIE_CHARS`` characters is broadcast.  A
longer rule list is cut into several tries, each broadcast for a scan of its own over
the addresses (not the pages' html); each scan keeps the better of its rule and the
one found before, so the result does not depend on the cut.  The list itself is a
DataFrame and passes the driver one trie at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, written

TRIE_RULES = 200_000            # of one trie
TRIE_CHARS = 16 << 20

ALLOW, BLOCK = "allow", "block"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class UrlTrie:
    """Allow and block rules.  An entry is ((length, host length, allows), rule, verdict),
    so that the greatest entry is the rule that wins.

    Nodes are numbers, so a trie of any depth can be sent.  ``before``: a host node's
    children by label; ``paths``: the path node of the rules whose host ends there, or
    None; ``after``: a path node's children by whole segment; ``begins``: its entries by
    beginning of the next segment; ``sizes``: the lengths of those."""

    def __init__(self, rules: Iterable[tuple[str, str, str]] = ()):
        self.before: list[dict[str, int]] = [{}]
        self.paths: list[int | None] = [None]
        self.after: list[dict[str, int]] = []
        self.begins: list[dict[str, tuple]] = []
        self.sizes: list[list[int]] = []
        for verdict, host, path in rules:
            self.add(verdict, host, path)

    def _host_node(self) -> int:
        self.before.append({})
        self.paths.append(None)
        return len(self.before) - 1

    def _path_node(self) -> int:
        self.after.append({})
        self.begins.append({})
        self.sizes.append([])
        return len(self.after) - 1

    def add(self, verdict: str, host: str, path: str) -> None:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"a rule allows or blocks, not {verdict!r}")
        at = 0
        for label in reversed(host.split(".")) if host else ():
            if label not in self.before[at]:
                self.before[at][label] = self._host_node()
            at = self.before[at][label]
        if self.paths[at] is None:
            self.paths[at] = self._path_node()
        node = self.paths[at]
        *whole, last = path.split("/")
        for segment in whole:
            if segment not in self.after[node]:
                self.after[node][segment] = self._path_node()
            node = self.after[node][segment]
        entry = ((len(host) + len(path), len(host), verdict == ALLOW), host + path, verdict)
        if last not in self.begins[node] or self.begins[node][last] < entry:
            self.begins[node][last] = entry
        if len(last) not in self.sizes[node]:
            self.sizes[node].append(len(last))

    def _along(self, node: int, segments: list[str], found: tuple | None) -> tuple | None:
        """The better of ``found`` and the best rule below ``node`` that the segments fit."""
        for segment in segments:
            for n in self.sizes[node]:
                entry = self.begins[node].get(segment[:n]) if n <= len(segment) else None
                if entry is not None and (found is None or entry > found):
                    found = entry
            node = self.after[node].get(segment)
            if node is None:
                break
        return found

    def longest(self, host: str, path: str) -> tuple | None:
        """The entry of the rule that wins for a url, or None."""
        at, found, segments, end = 0, None, path.split("/"), len(host)
        while True:
            if self.paths[at] is not None:
                found = self._along(self.paths[at], segments, found)
            if end < 0:
                return found
            dot = host.rfind(".", 0, end)       # the next label, from the last one on
            at = self.before[at].get(host[dot + 1:end])
            if at is None:
                return found
            end = dot


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for
    null or where there is no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def tries(rules: DataFrame, most_rules: int, most_chars: int) -> Iterator[UrlTrie]:
    """The rules as tries of a bounded size, one at a time.  Hosts are lower-cased like the
    urls'; null hosts and paths count as empty (a rule for every host, every path)."""
    rows = rules.select(F.col("verdict").cast("string"), F.translate(F.coalesce(F.col("host").cast("string"), F.lit("")),
                        UPPER, LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"))
    trie, n, chars = UrlTrie(), 0, 0
    for r in rows.toLocalIterator():
        if n and (n >= most_rules or chars + len(r["host"]) + len(r["path"]) > most_chars):
            yield trie
            trie, n, chars = UrlTrie(), 0, 0
        trie.add(*r)
        n, chars = n + 1, chars + len(r["host"]) + len(r["path"])
    yield trie


def matched(addresses: DataFrame, trie: UrlTrie, default: str, last: bool) -> DataFrame:
    """One scan: ``rule`` and ``verdict`` of each (host, path), given those found before."""
    shared = addresses.sparkSession.sparkContext.broadcast(trie)
    given = "rule" in addresses.columns
    at = {c: i for i, c in enumerate(addresses.columns)}

    def order(rule: str, verdict: str, size: int) -> tuple:
        return (len(rule), size, verdict == ALLOW), rule, verdict

    def run(batches):
        longest = shared.value.longest
        for batch in batches:
            hosts, paths = batch.column(at["host"]).to_pylist(), batch.column(at["path"]).to_pylist()
            if given:
                old = [None if r is None else order(r, v, s) for r, v, s in
                       zip(*(batch.column(at[c]).to_pylist() for c in ("rule", "verdict", "host_size")))]
            else:
                old = [None] * batch.num_rows
            rules, verdicts, sizes = [], [], []
            for host, path, before in zip(hosts, paths, old):
                found = longest(host, path)
                if found is None or (before is not None and before > found):
                    found = before
                rules.append(found and found[1])
                verdicts.append(found[2] if found else default if last else None)
                sizes.append(found[0][1] if found else None)
            kept = [batch.column(at[c]) for c in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(sizes, pa.int32())],
                names=["page_id", "host", "path", "rule", "verdict", "host_size"])

    key = dict(addresses.dtypes)["page_id"]
    return addresses.mapInArrow(run, f"page_id {key}, host string, path string, rule string, verdict string, host_size int")


def judge(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]], default: str = ALLOW, id_col: str = "page_id",
          url_col: str = "url", trie_rules: int = TRIE_RULES, trie_chars: int = TRIE_CHARS) -> DataFrame:
    """Per row: page_id, host, path, rule (host and path of the rule that wins, null if
    none fits) and verdict (the rule's, else ``default``).

    ``rules``: (verdict, host, path), as rows of a DataFrame or a list.  A null url and
    one without ``://`` have an empty host and path, which only a rule without a host
    fits.  The host is what stands there, with a port or user name if there is one.
    Every row gives a row, repeated ones too; other columns are ignored, whatever
    their names; an empty table gives no row, an empty rule list the default."""
    if default not in (ALLOW, BLOCK):
        raise ValueError(f"the default allows or blocks, not {default!r}")
    if isinstance(rules, list):
        rules = rules_frame(pages.sparkSession, rules)
    url = F.col(url_col).cast("string")
    addresses = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    before = None
    several = tries(rules, trie_rules, trie_chars)
    trie = next(several)
    for following in chain(several, [None]):
        addresses = matched(addresses, trie, default, last=following is None)
        if following is not None:               # one trie at a time in the workers
            addresses = written(addresses, "urls")
            if before is not None:
                discard(before)
            before = addresses
        trie = following
    return addresses.select("page_id", "host", "path", "rule", "verdict")

