"""Secret scans by a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that
every match satisfies (all trigrams of a string that must occur, alternatives
joined by OR).  Each Arrow batch of documents gets an inverted index: for every
trigram some rule asks for, the sorted rows that hold it (lower-cased ASCII).
The queries intersect and unite postings, and only the remaining rows are
verified with the rule itself.  A rule without mandatory trigrams (runs of hex
digits) reads every text.

Matching is by text: a scan without shuffle, bounded by the Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

ANY = ("any",)              # satisfied by every text
MAX_STRINGS = 16            # exact strings kept before they become trigrams

# kind, pattern, group that has to be long enough, its least length, ignore case
BASE_RULES = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", r"AKIA[A-Z0-9]+", 0, 18, False),
    ("hex", r"[0-9a-f]+", 0, 16, False),
]
MORE_RULES = [
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----", 0, 1, False),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40, False),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15, False),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, False),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39, False),
    ("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24, False),
]


class Facts:
    """What is known of the strings an expression matches: all of them (``exact``,
    or None), their possible beginnings and endings, and a trigram query."""

    def __init__(self, exact=None, prefix=frozenset({""}), suffix=frozenset({""}), match=ANY):
        self.exact, self.prefix, self.suffix, self.match = exact, prefix, suffix, match


def all_of(*queries):
    parts = []
    for q in queries:
        parts += q[1:] if q[0] == "and" else [] if q == ANY else [q]
    parts = list(dict.fromkeys(parts))
    return ANY if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def any_of(*queries):
    if any(q == ANY for q in queries):
        return ANY
    parts = []
    for q in queries:
        parts += q[1:] if q[0] == "or" else [q]
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def trigrams_of(strings) -> tuple:
    """A text that holds one of the strings holds all trigrams of it."""
    strings = list(strings)
    if not strings or any(len(s) < 3 for s in strings):
        return ANY
    return any_of(*[all_of(*[("gram", s[i:i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def settled(x: Facts) -> Facts:
    """Give up the list of exact strings for their trigrams, ends and beginnings."""
    if x.exact is None:
        return x
    return Facts(None, frozenset(s[:2] for s in x.exact), frozenset(s[-2:] for s in x.exact),
                 all_of(x.match, trigrams_of(x.exact)))


def small(x: Facts) -> Facts:
    if x.exact is not None and len(x.exact) > MAX_STRINGS:
        x = settled(x)
    if len(x.prefix) > MAX_STRINGS:
        x = Facts(x.exact, frozenset({""}), x.suffix, x.match)
    if len(x.suffix) > MAX_STRINGS:
        x = Facts(x.exact, x.prefix, frozenset({""}), x.match)
    return x


def concat(x: Facts, y: Facts) -> Facts:
    if x.exact is not None and y.exact is not None and len(x.exact) * len(y.exact) <= MAX_STRINGS:
        return Facts(frozenset(a + b for a in x.exact for b in y.exact), match=all_of(x.match, y.match))
    ends = x.exact if x.exact is not None else x.suffix
    starts = y.exact if y.exact is not None else y.prefix
    across = trigrams_of(a + b for a in ends for b in starts) if len(ends) * len(starts) <= 256 else ANY
    prefix = frozenset(a + b[:2] for a in x.exact for b in starts) if x.exact is not None else x.prefix
    suffix = frozenset(a[-2:] + b for a in ends for b in y.exact) if y.exact is not None else y.suffix
    x, y = settled(x), settled(y)
    return small(Facts(None, prefix, suffix, all_of(x.match, y.match, across)))


def alternate(items: list[Facts]) -> Facts:
    if all(i.exact is not None for i in items):
        return small(Facts(frozenset().union(*[i.exact for i in items]), match=any_of(*[i.match for i in items])))
    items = [settled(i) for i in items]
    return small(Facts(None, frozenset().union(*[i.prefix for i in items]),
                       frozenset().union(*[i.suffix for i in items]), any_of(*[i.match for i in items])))


def analyse(tree) -> Facts:
    out = Facts(frozenset({""}))
    for op, arg in tree:
        out = concat(out, _analyse_one(op, arg))
    return out


def _analyse_one(op, arg) -> Facts:
    if op is sre.LITERAL:
        return Facts(frozenset({chr(arg).lower()}))
    if op is sre.IN:
        chars = _members(arg)
        return Facts(frozenset(chars)) if chars is not None and len(chars) <= MAX_STRINGS else Facts()
    if op is sre.BRANCH:
        return alternate([analyse(t) for t in arg[1]])
    if op is sre.SUBPATTERN:
        return analyse(arg[3])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, body = arg
        one = analyse(body)
        if least == 0:
            return small(Facts(one.exact | {""}, match=ANY)) if most == 1 and one.exact is not None else Facts()
        out = one
        for _ in range(min(least, 3) - 1):
            out = concat(out, one)
        if most == least <= 3:
            return out
        out = settled(out)          # more may follow: beginnings and endings stay, trigrams hold
        return out
    if op is sre.AT:
        return Facts(frozenset({""}))
    return Facts()


def _members(items) -> set[str] | None:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < 64:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return chars


def trigram_query(pattern: str):
    """The Boolean trigram query that every match of ``pattern`` satisfies."""
    return settled(analyse(sre_parse.parse(pattern))).match


def grams_in(query) -> set[str]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*[grams_in(q) for q in query[1:]]) if len(query) > 1 else set()


def evaluate(query, postings: dict[str, np.ndarray], everything: np.ndarray) -> np.ndarray:
    """Rows that satisfy the query: intersections and unions of postings."""
    if query == ANY:
        return everything
    if query[0] == "gram":
        return postings.get(query[1], everything[:0])
    rows = [evaluate(q, postings, everything) for q in query[1:]]
    if query[0] == "or":
        return np.unique(np.concatenate(rows))
    rows.sort(key=len)
    out = rows[0]
    for r in rows[1:]:
        out = np.intersect1d(out, r, assume_unique=True)
    return out


class Scanner:
    def __init__(self, rules):
        self.rules = [(kind, re.compile(p, re.ASCII | (re.IGNORECASE if fold else 0)), group, least, trigram_query(p))
                      for kind, p, group, least, fold in rules]
        self.order = {kind: i for i, (kind, *_) in enumerate(rules)}
        self.grams = sorted(set().union(*[grams_in(q) for *_, q in self.rules]))
        self.codes = np.array([int.from_bytes(g.encode("ascii"), "big") for g in self.grams], np.uint32)
        self.number = np.full(1 << 24, -1, np.int16)
        self.number[self.codes] = np.arange(len(self.grams))
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """trigram -> sorted rows that hold it, for the texts data[offsets[i]:offsets[i + 1]]."""
        found = []
        step = 1 << 20
        for a in range(0, max(0, len(data) - 2), step):
            low = self.fold[data[a:a + step + 2]].astype(np.uint32)
            number = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
            at = np.flatnonzero(number >= 0)
            row = np.searchsorted(offsets, at + a, side="right") - 1
            inside = at + a + 3 <= offsets[row + 1]
            found.append(np.unique(number[at][inside].astype(np.int64) << 40 | row[inside]))
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        gram, row = pairs >> 40, pairs & ((1 << 40) - 1)
        cut = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return {g: row[cut[i]:cut[i + 1]] for i, g in enumerate(self.grams) if cut[i] < cut[i + 1]}

    def scan(self, column: pa.Array) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) of every text, in code points, by start, then kind."""
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
        postings = self.postings(data, offsets - offsets[0])
        everything = np.arange(len(column))
        spans: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for kind, rule, group, least, query in self.rules:
            for i in evaluate(query, postings, everything).tolist():
                text = texts.get(i)
                if text is None:
                    text = texts[i] = column[i].as_py()
                for m in rule.finditer(text):
                    if m.end(group) - m.start(group) >= least:
                        spans[i].append((kind, m.start(), m.end()))
        for s in spans:
            s.sort(key=lambda x: (x[1], self.order[x[0]]))
        return spans


def joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def scan(docs: DataFrame, rules=None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A span is the whole match; it counts if the rule's group is long enough.  Null
    and empty texts have no span (the digest is that of the empty string).  Matches
    of one rule do not overlap; those of different rules may.  Repeated rows are
    each returned; other columns are ignored; an empty table gives no row."""
    rules = list(rules or BASE_RULES + MORE_RULES)
    base = [kind for kind, *_ in BASE_RULES]

    def run(batches):
        scanner = Scanner(rules)
        for batch in text_batches(batches, 1):
            spans = scanner.scan(batch.column(1))
            of_base = [[s for s in x if s[0] in base] for x in spans]
            count = [pa.array([sum(s[0] == k for s in x) for x in of_base], pa.int64()) for k in base]
            digest = pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in of_base], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *count, digest, pa.array([joined(x) for x in spans], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in base], "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, "
                                         "base_sha256 string, spans string")


def without(text: str, spans) -> str:
    """The text with each stretch of overlapping spans replaced by one mark."""
    out, at = [], 0
    a = b = None
    for _, start, end in [*spans, ("", len(text) + 1, len(text) + 1)]:
        if a is not None and start < b:
            b = max(b, end)
            continue
        if a is not None:
            out += [text[at:a], "[SECRET]"]
            at = b
        a, b = start, end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules=None) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``[SECRET]``; every row stays.
    ``n_chars``, if there is such a column, follows where a text changes."""
    rules = list(rules or BASE_RULES + MORE_RULES)
    at = docs.columns.index("text")
    n_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        scanner = Scanner(rules)
        for batch in text_batches(batches, at):
            spans = scanner.scan(batch.column(at))
            hit = [i for i, s in enumerate(spans) if s]
            cols = list(batch.columns)
            if hit:
                texts = cols[at].to_pylist()
                for i in hit:
                    texts[i] = without(texts[i], spans[i])
                cols[at] = pa.array(texts, cols[at].type)
                if n_at is not None:
                    n = cols[n_at].to_pylist()
                    for i in hit:
                        n[i] = len(texts[i])
                    cols[n_at] = pa.array(n, cols[n_at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
