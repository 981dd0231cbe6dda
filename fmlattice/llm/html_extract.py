"""Main text of web pages by a linear-chain conditional random field.

A page is cut into leaf blocks: the stretches of text between tags that begin or
end a block, each with its chain of open elements.  Features of a block are its
ancestors' tags and the words of their class and id, and of its text (length,
share in links, punctuation, marks of boilerplate) and place.  A two-state chain
(main, other) scores a page's blocks jointly; weights are learned by maximising the
conditional likelihood of labelled pages (``page_samples``), with gradients from the
forward-backward recursion, and a page is decoded by Viterbi.

Pages are independent: a scan with an Arrow function, no shuffle; the weights (a
vector of fixed size) go with the function.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

BITS = 14                   # weights of a state: 2^BITS, features are hashed
ROUNDS = 60                 # passes over the labelled pages
STEP, DECAY = 0.2, 1e-4

# HTML's element kinds (fixed values)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())     # no markup inside
SHOWN = frozenset(["xmp"])      # of these, those whose text the page shows
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp "
                   "rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   # formulas and drawings stand in the line
                   "math annotation annotation-xml maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom "
                   "mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover "
                   "semantics svg circle clippath defs desc ellipse filter foreignobject g image line lineargradient marker "
                   "mask metadata path pattern polygon polyline radialgradient rect stop symbol text textpath tspan use".split())
# a start tag closes an open element of these kinds, within the given border
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSED_BY_BLOCK = "p"
KEEPS_P = frozenset("select option optgroup noscript template".split())     # blocks of their own in an open p

TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>"
    r"|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
MARKS = re.compile("©|copyright|all rights reserved|cookie|subscribe|newsletter|sign in|log in|privacy|comment|reply|"
                   "advert|sponsored|share this|related")

HELD = re.compile(r"</(select|noscript|template)(?=[\s/>])", re.I)


class Open:
    """An open element.  ``up``: the nearest enclosing one that counts (no inline element
    without class or id words); ``own``: its hashed features; ``new``: those that none of
    the enclosing ones has.  Blocks share these nodes, so a page of n elements takes memory
    for n, however deep it is."""

    __slots__ = ("name", "inline", "words", "up", "own", "new", "sums")

    def __init__(self, name, words):
        self.name, self.words = name, words
        self.inline = name in INLINE
        self.up = self.own = self.new = self.sums = None

    def counts(self) -> bool:
        return not self.inline or bool(self.words)


class Block:
    __slots__ = ("inside", "parts", "linked", "text", "n")

    def __init__(self, inside):
        self.inside, self.parts, self.linked = inside, [], 0


class Elements:
    """The open elements, with what finds one of a name, or the innermost block, at once."""

    def __init__(self):
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []         # places of those that are not inline
        self.inside: Open | None = None     # the innermost one that counts
        self.held: dict[int, int] = {}      # hashed features of the open ones
        self.links = 0

    def push(self, name: str, words: tuple[str, ...]) -> None:
        o, at = Open(name, words), len(self.stack)
        self.stack.append(o)
        self.places.setdefault(name, []).append(at)
        self.links += name == "a"
        if not o.inline:
            self.blocks.append(at)
        if o.counts():
            o.up, self.inside = self.inside, o
            o.own = {hashed(f"in:{name}"), *(hashed(f"word:{w}") for w in words)}
            o.new = tuple(sorted(f for f in o.own if not self.held.get(f)))
            for f in o.own:
                self.held[f] = self.held.get(f, 0) + 1

    def close(self, depth: int) -> None:
        """Close the elements from ``depth`` on."""
        while len(self.stack) > depth:
            o = self.stack.pop()
            self.places[o.name].pop()
            self.links -= o.name == "a"
            if not o.inline:
                self.blocks.pop()
            if o.own is not None:
                self.inside = o.up
                for f in o.own:
                    self.held[f] -= 1

    def last(self, name: str) -> int | None:
        places = self.places.get(name)
        return places[-1] if places else None

    def close_innermost(self, ends, border=frozenset(), through=None) -> None:
        """Close the innermost open block of ``ends`` unless one of ``border`` (or, with
        ``through``, any but those) lies within it."""
        if not any(self.places.get(e) for e in ends):
            return
        for at in reversed(self.blocks):
            name = self.stack[at].name
            if name in ends:
                self.close(at)
                return
            if name in border or (through is not None and name not in through):
                return


def attribute_words(attrs: str) -> tuple[str, ...]:
    out = []
    for name, value in ATTRIBUTE.findall(attrs):
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            if value.strip("\"'").lower() != "false":
                out.append("hidden")
        else:
            out += WORD.findall(value.lower())
    return tuple(out)


def leaf_blocks(html: str) -> list[Block]:
    """The page's blocks with some text, in order."""
    blocks: list[Block] = []
    open_ = Elements()
    current: Block | None = None
    at, n = 0, len(html)
    find = TOKEN.search
    last_end = {m.group(1).lower(): m.start() for m in HELD.finditer(html)}

    def add(piece: str) -> None:
        nonlocal current
        if current is None:
            if not piece.strip():
                return
            current = Block(open_.inside)
            blocks.append(current)
        current.parts.append(piece)
        if open_.links:
            current.linked += len(piece)

    while at < n:
        m = find(html, at)
        if m is None:
            rest = html[at:]
            cut = rest.rfind("<")
            if cut >= 0 and re.match(r"<[a-zA-Z/!]", rest[cut:]):   # a tag cut off by the page's end
                rest = rest[:cut]
            add(rest)
            break
        if m.start() > at:
            add(html[at:m.start()])
        at = m.end()
        name = m.group("name")
        if name is None:
            continue
        name = name.lower()
        if m.group("end"):
            if name not in INLINE:
                current = None
            depth = open_.last(name)
            if depth is None:
                continue
            if name in INLINE and open_.blocks and open_.blocks[-1] > depth:
                continue                                # an inline end tag does not close blocks
            open_.close(depth)
            continue
        attrs = m.group("attrs")
        if name == "br":
            add(" ")
            continue
        if name in VOID:
            if name == "hr":
                current = None
            elif current is not None:
                add(" ")
            continue
        if name in RAW and not attrs.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if name in SHOWN:
                current = None
                open_.push(name, attribute_words(attrs) if attrs else ())
                add(html[at:close.start() if close else n].replace("&", "&amp;"))     # as it stands
                open_.close(len(open_.stack) - 1)
                current = None
            at = close.end() if close else n
            continue
        if name not in INLINE:
            current = None
            if name in CLOSES:
                open_.close_innermost(*CLOSES[name])
            if name not in ("option", "optgroup"):      # a select holds nothing else
                open_.close_innermost({"select"}, through={"option", "optgroup"})
            if name not in KEEPS_P:                     # a block closes an open paragraph
                open_.close_innermost({CLOSED_BY_BLOCK}, through=())
        if name in ("select", "noscript", "template") and last_end.get(name, -1) < at:
            continue                                    # never closed: the page's rest is not its content
        if not attrs.endswith("/"):
            open_.push(name, attribute_words(attrs) if attrs else ())
    out = []
    for b in blocks:
        b.text = SPACE.sub(" ", unescape("".join(b.parts))).strip()
        b.n = len(b.text)
        if b.n:
            out.append(b)
    return out


@lru_cache(maxsize=1 << 16)
def hashed(feature) -> int:
    return crc32(repr(feature).encode("utf-8")) & ((1 << BITS) - 1)


def bucket(x: float, cuts) -> int:
    return sum(x >= c for c in cuts)


def own_features(b: Block, i: int, n: int) -> list[int]:
    """Features of block ``i`` of ``n``: its element and its whole text."""
    raw = sum(map(len, b.parts)) or 1
    words = b.text.count(" ") + 1
    inside = b.inside
    f = [f"own:{inside.name}", *(f"own-word:{w}" for w in set(inside.words))] if inside else ["own:none"]
    f += [("words", bucket(words, (2, 4, 8, 16, 32, 64))), ("links", bucket(b.linked / raw, (0.01, 0.3, 0.7))),
          ("stops", bucket((b.text.count(".") + b.text.count(",")) / words, (0.01, 0.05, 0.15))),
          ("ends", b.text[-1] in ".!?:;…»”\"'"), ("upper", b.text[0].isupper()),
          ("place", bucket((i + 1) / (n + 1), (0.1, 0.3, 0.7, 0.9))), ("bias", 1)]
    f += [("mark", m) for m in set(MARKS.findall(b.text.lower()))]
    if i == 0:
        f.append(("place", "first"))
    if i == n - 1:
        f.append(("place", "last"))
    return [hashed(x) for x in f]


def path_features(inside: Open | None) -> list[int]:
    out: list[int] = []
    while inside is not None:
        out += inside.new
        inside = inside.up
    return out


def features(blocks: list[Block]) -> list[tuple[int, ...]]:
    """All features of each block, for training; a page is decoded by ``decode_blocks``."""
    return [tuple(path_features(b.inside) + own_features(b, i, len(blocks))) for i, b in enumerate(blocks)]


class Chain:
    """Two-state linear-chain CRF over hashed binary features."""

    def __init__(self):
        self.weights = np.zeros((2, 1 << BITS))
        self.step = np.zeros((2, 2))        # from state, to state

    def scores(self, feats) -> np.ndarray:
        at = np.concatenate([np.array(f) for f in feats])
        starts = np.cumsum([0] + [len(f) for f in feats[:-1]])
        return np.add.reduceat(self.weights[:, at], starts, axis=1).T

    def freeze(self) -> Chain:
        """Keep the weights as lists too, which decode many small pages faster."""
        self.frozen = (self.weights[0].tolist(), self.weights[1].tolist())
        return self

    def marginals(self, emit: np.ndarray):
        """State marginals (n, 2) and summed pair marginals (2, 2)."""
        n = len(emit)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = emit[0]
        for t in range(1, n):
            alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + self.step, axis=0)
        for t in range(n - 2, -1, -1):
            beta[t] = np.logaddexp.reduce(self.step + (emit[t + 1] + beta[t + 1])[None, :], axis=1)
        log_z = np.logaddexp.reduce(alpha[-1])
        pairs = np.zeros((2, 2))
        for t in range(1, n):
            pairs += np.exp(alpha[t - 1][:, None] + self.step + (emit[t] + beta[t])[None, :] - log_z)
        return np.exp(alpha + beta - log_z), pairs

    def fit(self, pages: list[tuple[list[tuple[int, ...]], list[int]]], rounds: int = ROUNDS) -> Chain:
        """Gradient ascent with per-weight steps (AdaGrad) on the conditional log-likelihood."""
        seen, seen_step = np.full(self.weights.shape, 1e-6), np.full((2, 2), 1e-6)
        for _ in range(rounds):
            for feats, labels in pages:
                if not feats:
                    continue
                state, pairs = self.marginals(self.scores(feats))
                gradient: dict[tuple[int, int], float] = {}
                for t, (f, y) in enumerate(zip(feats, labels)):
                    for s in (0, 1):
                        g = (s == y) - state[t, s]
                        if abs(g) > 1e-6:
                            for k in f:
                                gradient[s, k] = gradient.get((s, k), 0.0) + g
                for (s, k), g in gradient.items():
                    g -= DECAY * self.weights[s, k]
                    seen[s, k] += g * g
                    self.weights[s, k] += STEP * g / np.sqrt(seen[s, k])
                g = -pairs - DECAY * self.step
                for a, b in zip(labels, labels[1:]):
                    g[a, b] += 1
                seen_step += g * g
                self.step += STEP * g / np.sqrt(seen_step)
        return self.freeze()

    def decode(self, feats) -> list[int]:
        """Viterbi: the best state of each block (1 is main); ties go to 0."""
        if not feats:
            return []
        w0, w1 = self.frozen
        return self.best([(sum([w0[k] for k in f]), sum([w1[k] for k in f])) for f in feats])

    def decode_blocks(self, blocks: list[Block]) -> list[int]:
        """``decode`` of their features.  What an element adds to the score of all blocks
        within it is kept with it, so the work is linear in the page."""
        if not blocks:
            return []
        w0, w1 = self.frozen
        emit = []
        for i, b in enumerate(blocks):
            s0, s1 = self.inherited(b.inside)
            own = own_features(b, i, len(blocks))
            emit.append((s0 + sum([w0[k] for k in own]), s1 + sum([w1[k] for k in own])))
        return self.best(emit)

    def inherited(self, inside: Open | None) -> tuple[float, float]:
        w0, w1 = self.frozen
        above = []
        while inside is not None and inside.sums is None:
            above.append(inside)
            inside = inside.up
        sums = inside.sums if inside is not None else (0.0, 0.0)
        for o in reversed(above):
            sums = o.sums = (sums[0] + sum([w0[k] for k in o.new]), sums[1] + sum([w1[k] for k in o.new]))
        return sums

    def best(self, emit: list[tuple[float, float]]) -> list[int]:
        (a00, a01), (a10, a11) = self.step.tolist()
        s0, s1 = emit[0]
        back = []
        for e0, e1 in emit[1:]:
            from0, from1 = s0 + a00 >= s1 + a10, s0 + a01 >= s1 + a11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            s0, s1 = (e0 + (s0 + a00 if from0 else s1 + a10)), (e1 + (s0 + a01 if from1 else s1 + a11))
        state = 0 if s0 >= s1 else 1
        out = [state]
        for b in reversed(back):
            state = b[state]
            out.append(state)
        return out[::-1]


def main_text(chain: Chain, html: str) -> str:
    blocks = leaf_blocks(html)
    return "\n\n".join(b.text for b, s in zip(blocks, chain.decode_blocks(blocks)) if s)


@lru_cache(maxsize=1)
def trained() -> Chain:
    """The chain fitted to the labelled pages."""
    from .page_samples import labelled_pages
    pages = []
    for html, main in labelled_pages():
        blocks = leaf_blocks(html)
        pages.append((features(blocks), [int(b.text in main) for b in blocks]))
    return Chain().fit(pages)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """Per row: page_id, url, text (empty if no block is main), n_chars.

    Null and empty html give an empty text.  Markup may be broken or cut off; what is
    left is read.  Only comments, tags and the text of script, style, textarea, title,
    iframe, noembed and noframes (up to the page's end if not closed, as in HTML) are
    no block.  Repeated rows are each returned; other columns are ignored; an
    empty table gives no row."""
    chain = chain or trained()
    # only the weights that are not zero travel
    at = np.flatnonzero(chain.weights.any(0))
    values, step = chain.weights[:, at], chain.step

    def run(batches):
        own = Chain()
        own.weights[:, at] = values
        own.step = step
        own.freeze()
        for batch in text_batches(batches, 2):
            texts = [main_text(own, h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")
                        ).mapInArrow(run, "page_id long, url string, text string, n_chars long")
