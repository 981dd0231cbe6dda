import random

from fmlattice.llm.packing import LENGTHS, best_fit, pack, sequence_cost
from pyspark.sql import functions as F
from tests.llm.frames import frame  # noqa: F401


def slow_run(sizes, opening):
    room, bins = [], []
    for i, s in enumerate(sizes):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            _, b = min(fits)
        else:
            b = len(room)
            room.append(opening(i))
        room[b] -= s
        bins.append(b)
    return bins, len(room)


def downsized(sizes, bins, n, lengths):
    used = [sum(s for s, x in zip(sizes, bins) if x == b) for b in range(n)]
    return [min(c for c in lengths if c >= u) for u in used]


def slow_pack(sizes, lengths, cost):
    """The same packing by plain search over all open bins and all remaining pieces."""
    lengths = sorted(lengths)

    def joint(i):
        def price(c):
            held = sizes[i]
            for s in sizes[i + 1:]:
                held += s if held + s <= c else 0
            return cost(min(x for x in lengths if x >= held)) / held
        return min([c for c in lengths if c >= sizes[i]], key=lambda c: (price(c), c))

    best = None
    for length in [None, *lengths]:
        opening = joint if length is None else lambda i: min(c for c in lengths if c >= max(sizes[i], length))
        bins, n = slow_run(sizes, opening)
        final = downsized(sizes, bins, n, lengths)
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, bins, final)
    return best[1:]


def mixes():
    r = random.Random(1)
    for _ in range(40):
        yield sorted((r.randint(1, r.choice([20, 600, 8192])) for _ in range(r.randint(0, 120))), reverse=True)


def test_against_plain_search():
    for sizes in mixes():
        assert pack(sizes) == tuple(slow_pack(sizes, LENGTHS, sequence_cost))
    cheap_long = lambda c: 1 + c * 0.001
    sizes = [300, 200, 100, 50]
    assert pack(sizes, (100, 400, 1000), cheap_long) == tuple(slow_pack(sizes, (100, 400, 1000), cheap_long))


def test_never_dearer_than_a_single_length():
    r = random.Random(3)
    big = [sorted((r.randint(a, b) for _ in range(8000)), reverse=True)
           for a, b in ((300, 419), (1, 600), (900, 1100), (1, 8192), (2100, 2900), (171, 171))]
    big.append(sorted((r.choice([90, 700, 3000]) for _ in range(8000)), reverse=True))
    cheaper = []
    for sizes in [*mixes(), *big]:
        total = sum(map(sequence_cost, pack(sizes)[1]))
        singles = []
        for length in LENGTHS:
            rooms, used = [], []            # best fit, bins kept by room
            from bisect import bisect_left, insort
            for s in sizes:
                k = bisect_left(rooms, (s, -1))
                if k < len(rooms):
                    room, b = rooms.pop(k)
                else:
                    room, b = min(c for c in LENGTHS if c >= max(s, length)), len(used)
                    used.append(0)
                used[b] += s
                insort(rooms, (room - s, b))
            singles.append(sum(sequence_cost(min(c for c in LENGTHS if c >= u)) for u in used))
        assert total <= min(singles)
        cheaper.append(total < min(singles))
    assert cheaper[-len(big)]           # pieces of 300 to 419 tokens: a mixture of lengths is cheapest


def check(df, rows, lengths):
    got = df.collect()
    pieces, bins = {}, {}
    for p in got:
        if p["bin_id"] is None:
            assert p["n_tokens"] == 0
            continue
        pieces.setdefault(p["doc_id"], []).append((p["start"], p["n_tokens"]))
        bins.setdefault((p["bin_id"], p["bin_length"]), []).append((p["bin_offset"], p["n_tokens"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):         # contents lie one after the other
            assert offset == at
            at += n
        assert length == min(c for c in lengths if c >= at)     # downsized to the contents
    for i, n in rows:
        at = 0
        for start, m in sorted(pieces.get(i, [])):
            assert start == at
            at += m
        assert at == max(0, n or 0)
    return got, bins


def test_pieces_and_bins(frame):
    r = random.Random(2)
    rows = [(i, r.choice([0, 1, 7, 100, 512, 8192, 8193, 30_000, r.randint(1, 3000)])) for i in range(300)]
    rows += [(300, None), (301, -5)]
    df = frame([(*x, "t", 1) for x in rows], "doc_id long, n_tok long, piece string, n long")
    for shard in (10**9, 20_000):
        got, bins = check(best_fit(df, tokens=F.col("n_tok"), shard_tokens=shard), rows, LENGTHS)
        assert {g["doc_id"] for g in got} == {i for i, _ in rows}
    full = sum(max(0, n or 0) for _, n in rows)
    _, bins = check(best_fit(df, tokens=F.col("n_tok")), rows, LENGTHS)
    assert full / sum(length for _, length in bins) > 0.9


def test_odd_rows(frame):
    df = frame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    got = best_fit(df).collect()
    assert sorted(g["n_tokens"] for g in got) == [0, 0, 2, 3, 3]
    assert best_fit(df.limit(0)).count() == 0
