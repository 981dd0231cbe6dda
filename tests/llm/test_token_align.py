import collections
import hashlib
import random
import re

import pyarrow.parquet as pq
import public_tokenizers as P
import pytest

from fmlattice.llm.queries import SIDE_A, SIDE_B
from fmlattice.llm.token_align import Aligner, align, alignment, side
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "doc_id long, text string, u int, pair string, total string, links string"
TEXTS = [None, "", " ", "a", "Hello, world", "  two  spaces\n\n\ttab", "é😀 naïve 中文 ü", "▁ is no space", "<|endoftext|> <s> <unk> <0x41>",
         "a\x00b", "x" * 3000, "the the the the", "the the the the", "don't stop", " ", "́combining", "<0xE2>", "\r\n end"]


@pytest.fixture(scope="module")
def sides():
    from tokenizers import Tokenizer
    import sentencepiece
    a = Tokenizer.from_file(P.path(SIDE_A))
    a.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of, more = {}, 256
    for b in range(256):
        if b in printable:
            byte_of[chr(b)] = b
        else:
            byte_of[chr(more)] = b
            more += 1
    b = sentencepiece.SentencePieceProcessor(model_file=P.path(SIDE_B))

    def tokens(text):
        enc = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in enc.ids]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            hexed = re.fullmatch("<0x(..)>", p)
            right.append((i, bytes([int(hexed[1], 16)]) if hexed else p.replace("▁", " ").encode()))
        return left, right

    return tokens


def ranges(tokens):
    out, at = [], 0
    for i, b in tokens:
        out.append((i, at, at + len(b)))
        at += len(b)
    return out


def brute(rows, tokens):
    """Every pair of tokens of a text against each other."""
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        left, right = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if b"".join(t for _, t in left) != whole or b"".join(t for _, t in right) != whole:
            docs.append((doc_id, [], [], [], "", []))
            continue
        left, right = ranges(left), ranges(right)
        links = [(x[0], y[0]) for x in left for y in right if x[2] == y[2]]
        overlap = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[1] < y[2] and y[1] < x[2]]
        groups, at = [], 0
        for end in sorted({x[2] for x in left} & {y[2] for y in right}):
            groups.append("|".join(",".join(str(t[0]) for t in s if at <= t[1] < end) for s in (left, right)))
            at = end
        counts.update(links)
        docs.append((doc_id, left, right, links, ";".join(groups), overlap))
    best = collections.Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = [(d, len(left), len(right), g.count(";") + 1 if g else 0, len(links),
            sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(g.encode()).hexdigest() if g else "") for d, left, right, links, g, _ in docs]
    return out, docs


def key(row):
    return [(v is None, v if v is not None else 0) for v in row]


def test_against_all_pairs(frame, sides):
    r = random.Random(2)
    prose = [t[:r.randint(1, 400)] for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:40] if t]
    rows = [(i, t) for i, t in enumerate(TEXTS + prose)] + [(3, "a"), (None, "the end"), (None, None)]
    want, docs = brute(rows, sides)
    table = frame([(d, t, 1, "p", "t", "l") for d, t in rows], SCHEMA).repartition(3)
    paths = P.path(SIDE_A), P.path(SIDE_B)
    for limits in ({}, {"broadcast_pairs": 5, "hot_share": 20}):
        got = [tuple(x) for x in alignment(table, *paths, **limits).collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    spans = align(table, *paths, with_spans=True).collect()
    assert sorted(((x["doc_id"] is None, x["doc_id"], x["groups"], [tuple(o) for o in x["overlaps"]]) for x in spans),
                  key=str) == sorted(((d is None, d, g, o) for d, _, _, _, g, o in docs), key=str)
    assert alignment(frame([], SCHEMA), *paths).collect() == []


def test_sides_give_texts_back():
    for name, space in ((SIDE_A, b" "), (SIDE_B, b" ")):
        s = side(P.path(name))
        texts = [t for t in TEXTS if t and "▁" not in t]
        for t, ids in zip(texts, s.encode(texts)):
            assert b"".join(s.pieces[i] for i in ids) == space + t.encode()


def test_units_give_the_ids_of_whole_texts():
    sides = [side(P.path(n)) for n in (SIDE_A, SIDE_B)]
    assert all(s.by_unit for s in sides)
    texts = [t for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist() if t]
    r = random.Random(9)
    marks = ["a", "word", "Der", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "12", "é", "\u0301", "\u00a0", "\u2003", "中", "😀", "\x1c", "\x85",
             "<|endoftext|>", "(", "_", "\u200b", "\u3000", "ſ"]
    texts += ["".join(r.choice(marks) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    al = Aligner(*sides)
    for start in range(0, len(texts), 500):
        some = texts[start:start + 500]
        places, kept = al.encoded(some)
        for s, (ids, counts) in zip(sides, kept):
            want = [i for p in places for i in s.encode([some[p]])[0]]
            assert ids.tolist() == want
