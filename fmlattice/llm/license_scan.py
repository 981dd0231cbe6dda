"""License scans: winnowed fingerprints of templates, inverted index, banded alignment.

Tokens are runs of ASCII letters and digits (lower-cased) and of other non-ASCII
bytes.  A template's token k-grams are hashed and winnowed: of every window of
hashes the least is kept (the rightmost on ties), so a copied run of
K_GRAM + WINDOW - 1 tokens shares a fingerprint.  The inverted index maps a
fingerprint to its places in templates.  All k-grams of a document are looked up;
hits of one template near one diagonal are a candidate, and a banded alignment
of the template with the document around the diagonal gives the tokens matched in
order, their share of the template (coverage) and the span.  Groups of diagonals
apart by no more than the template's length are also aligned as one, so text put
inside a notice does not hide it.  Short templates keep all their k-grams.  The
version numbers and family words of a template (``MARKS``) must be those of the
span, no more and no less.

Templates are few and fixed, so the index goes with the function; documents are
scanned whole, without shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, seeds, text_batches, text_slices, word_spans
from .license_texts import ALL, TEMPLATES  # noqa: F401

K_GRAM = 3
WINDOW = 3
BAND = 8                # tokens that an alignment may leave the diagonal on either side
COVERAGE = 0.8
SHORT = 25              # tokens of a template up to which all its k-grams are kept
# words that tell versions and families of licences apart
MARKS = ("0 1 2 3 4 5 nc sa nd lesser library affero noncommercial sharealike noderivatives noderivs".split())

TOKEN_BYTE = np.zeros(256, bool)
TOKEN_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def tokens(data: np.ndarray, offsets: np.ndarray):
    """(hash, first byte, end byte, text) of every token of the texts."""
    return word_spans(LOWER[data], offsets, TOKEN_BYTE)


def k_grams(hashes: np.ndarray, owner: np.ndarray, k: int = K_GRAM):
    """Hashes of k tokens in a row of one text, and where they begin."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[k - 1:])
    by = seeds(k, 11)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        out += hashes[at + j] * by[j]
    return mix(out), at


def winnow(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints: the least hash of each window, rightmost on ties."""
    if len(hashes) <= window:
        return list(range(len(hashes)))
    kept = set()
    for a in range(len(hashes) - window + 1):
        part = hashes[a:a + window]
        kept.add(a + window - 1 - int(np.argmin(part[::-1])))
    return sorted(kept)


def marks_of(words: np.ndarray, marks: np.ndarray) -> list[int]:
    """The hashes of a run of tokens that are among ``marks``, in order."""
    return words[np.isin(words, marks)].tolist()


class TemplateIndex:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.words: list[np.ndarray] = []
        places = defaultdict(list)
        for t, name in enumerate(self.names):
            data = np.frombuffer(templates[name].encode("utf-8"), np.uint8)
            hashes, _, _, owner = tokens(data, np.array([0, len(data)]))
            self.words.append(hashes)
            grams, at = k_grams(hashes, owner)
            for p in range(len(grams)) if len(hashes) <= SHORT else winnow(grams):
                places[int(grams[p])].append((t, int(at[p])))
        self.places = dict(places)
        data = np.frombuffer(" ".join(MARKS).encode("utf-8"), np.uint8)
        self.marks = tokens(data, np.array([0, len(data)]))[0]
        self.marked = [marks_of(w, self.marks) for w in self.words]
        self.keys = np.array(sorted(self.places), np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places among ``grams`` that are fingerprints of some template."""
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        return at[np.isin(grams[at], self.keys)] if len(at) else at


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, last): the most template tokens matched in order to text tokens
    within ``band`` of the diagonal, and the first and last text token matched; among
    equal ones the latest first, then the earliest last.  (0, -1, -1) if nothing matches."""
    width = 2 * band + 1
    # best[j] for text place i + diagonal - band + j: (matched, first, -last)
    none = (0, -1, 0)
    best = [none] * width
    for i, word in enumerate(template.tolist()):
        lead = i + diagonal - band
        # moving one template token on shifts the band by one text token
        before = best
        best = []
        run = none
        for j in range(width):
            p = lead + j
            up = before[j + 1] if j + 1 < width else none           # skip a template token
            diag = before[j]
            here = max(up, run)                                     # or a text token
            if 0 <= p < len(text) and text[p] == word:
                here = max(here, (diag[0] + 1, diag[1] if diag[0] else p, -p))
            run = here
            best.append(here)
    matched, first, last = max(best)
    return (matched, first, -last) if matched else (0, -1, -1)


def matches(index: TemplateIndex, words: np.ndarray, grams: np.ndarray, at: np.ndarray, coverage: float):
    """(template, matched, coverage, first token, last token) in one text."""
    near = defaultdict(set)
    for g in index.hits(grams).tolist():
        for t, q in index.places[int(grams[g])]:
            near[t].add(int(at[g]) - q)
    out = []
    for t, diagonals in near.items():
        template = index.words[t]
        diagonals = sorted(diagonals)
        groups = [[diagonals[0]]]
        for d in diagonals[1:]:
            if d - groups[-1][0] <= BAND:
                groups[-1].append(d)
            else:
                groups.append([d])

        def measure(low: int, high: int) -> bool:
            """Align around the diagonals from ``low`` to ``high``."""
            d = low + (high - low) // 2
            band = BAND if high - low <= BAND else BAND + high - d
            lo = max(0, d - band)
            hi = min(len(words), d + len(template) + band)
            if np.isin(template, words[lo:hi]).sum() < coverage * len(template):
                return False                    # too few of its tokens are there at all
            matched, first, last = align(template, words[lo:hi], d - lo, band)
            if matched < coverage * len(template):
                return False
            if index.marked[t] and marks_of(words[lo + first:lo + last + 1], index.marks) != index.marked[t]:
                return False
            out.append((t, matched, matched / len(template), lo + first, lo + last))
            return True

        alone = [g for g in groups if not measure(g[0], g[-1])]
        j = 0
        for i, g in enumerate(alone):           # a notice with text put in or left out
            j = max(j, i)
            while j + 1 < len(alone) and alone[j + 1][-1] - g[0] <= len(template):
                j += 1
            if alone[j][-1] > g[-1]:
                measure(g[0], alone[j][-1])
    best: dict[tuple[int, int], tuple] = {}
    for m in out:                       # one match for each template and first token
        key = (m[0], m[3])
        if key not in best or (m[1], -m[4]) > (best[key][1], -best[key][4]):
            best[key] = m
    return sorted(best.values(), key=lambda m: (m[3], index.names[m[0]]))


def code_points(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Byte places of a UTF-8 text as code point places."""
    starts = (data & 0xC0) != 0x80
    return np.r_[0, np.cumsum(starts)][places]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Per row: doc_id, n_matches, license (the template with most tokens matched, the
    first by name on ties; null if none), coverage (its share matched, 0 if none),
    spans (name:start:end:coverage in code points, end exclusive, by start, then name).

    Null and empty texts match nothing.  Repeated rows are each returned; other
    columns are ignored; an empty table gives no row."""
    templates = ALL if templates is None else templates

    def run(batches):
        index = TemplateIndex(templates)
        for batch in text_batches(batches, 1):
            found: list[list] = []
            for _, data, offsets in text_slices(batch.column(1)):
                hashes, begin, end, owner = tokens(data, offsets)
                grams, at = k_grams(hashes, owner)
                per_text = [[] for _ in range(len(offsets) - 1)]
                hit = np.unique(owner[at[index.hits(grams)]]) if len(grams) else []
                first = np.searchsorted(owner, np.arange(len(offsets)))
                gram_first = np.searchsorted(at, first)
                for i in hit:
                    a, b = first[i], first[i + 1]
                    ga, gb = gram_first[i], gram_first[i + 1]
                    text = data[offsets[i]:offsets[i + 1]]
                    for t, n, share, x, y in matches(index, hashes[a:b], grams[ga:gb], at[ga:gb] - a, coverage):
                        s, e = code_points(text, np.array([begin[a + x], end[a + y]]) - offsets[i])
                        per_text[i].append((index.names[t], n, share, int(s), int(e)))
                found += per_text
            best = [min(f, key=lambda m: (-m[1], -m[2], m[0])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()),
                 pa.array([b and b[0] for b in best], pa.string()),
                 pa.array([b[2] if b else 0.0 for b in best], pa.float64()),
                 pa.array([",".join(f"{n}:{s}:{e}:{c:.4f}" for n, _, c, s, e in f) for f in found], pa.string())],
                names=["doc_id", "n_matches", "license", "coverage", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_matches long, license string, coverage double, spans string")
