import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from fmlattice.llm.bpe import NO_PAIR, PairTree, encode_decode, merge_piece, tokenizer
from tests.llm.frames import frame  # noqa: F401

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tok():
    return tokenizer(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def theirs(tok):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tok.ranks, special_tokens={})


def texts():
    r = random.Random(3)
    out = ["", " ", "a", "<|endoftext|>", "it's we'll ''s 's", "x" * 30_000, " " * 5000 + "y", "\n\n \t b", "ab" * 9000]
    out += ["".join(r.choice("ab're \n\t\x0b\x1c\x85\xa0é漢😀१½ſK٣_-!中") for _ in range(r.randint(0, 60))) for _ in range(300)]
    return out


def test_as_tiktoken(tok, theirs):
    for t in texts():
        ids = tok.ids(t)
        assert [int(i) for i in ids.split()] == theirs.encode_ordinary(t)
        assert tok.decode(ids) == t.encode()


def brute(piece, ranks):
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks.get(parts[i] + parts[i + 1], NO_PAIR), i) for i in range(len(parts) - 1)]
        if not pairs or min(pairs)[0] == NO_PAIR:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_segment_tree_merges(tok):
    r = random.Random(5)
    for _ in range(300):
        piece = bytes(r.choice(b"abctheningo \xc3\xa9") for _ in range(r.randint(1, 40)))
        assert merge_piece(piece, tok.ranks) == brute(piece, tok.ranks)


def test_tree_leftmost_least():
    r = random.Random(2)
    for n in (1, 2, 3, 7, 8, 9):
        vals = [r.randint(0, 3) for _ in range(n)]
        tree = PairTree(vals)
        for _ in range(30):
            i, v = r.randrange(n), r.choice([0, 1, 2, NO_PAIR])
            tree.update(i, v)
            vals[i] = v
            assert tree.first() == (min(vals), vals.index(min(vals)) if min(vals) < NO_PAIR else 0)


def test_query_rows(frame, theirs):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (3, "hello wörld", 5), (None, "x", 1)]
    got = encode_decode(frame(rows, "doc_id long, text string, n_tokens int"), PATH, P.PATTERN, with_ids=True).collect()
    assert len(got) == 5
    for (i, t, _), r in zip(rows, sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"]))):
        ids = theirs.encode_ordinary(t or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == (t or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert encode_decode(frame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0
