import hashlib
import re

import numpy as np

import pytest

from fmlattice.llm.exact_dedup import (CountingQuotientFilter, exact_dedup, keep_first, merge_runs, pack_filter,
                                       pack_slots, scan_filter, unpack_slots)
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, kept string, norm string"


def row(i, text):
    return (i, text, "en", "s", None, "x", "y", "z")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_against_brute_force(frame):
    rows = [row(5, "a  b"), row(3, "a\tb"), row(9, None), row(8, ""), row(1, " "), row(7, "x" * 200_000),
            row(2, "x" * 200_000), row(4, "A b"), row(6, "a b"), row(10, "a b"), row(11, "\n\n")]
    got = {r["doc_id"]: r for r in exact_dedup(frame(rows, SCHEMA)).collect()}
    groups = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r[0])
    for r in rows:
        g = groups[norm(r[1])]
        have = got[r[0]]
        assert (have["keep_id"], have["group_size"], have["kept"]) == (min(g), len(g), r[0] == min(g))
        assert have["text_sha256"] == hashlib.sha256(norm(r[1]).encode()).hexdigest()


def test_repeated_rows_null_ids_and_keep(frame):
    rows = [row(1, "a"), row(1, "a"), row(1, "b"), row(0, "b"), row(None, "c"), row(None, None), row(2, "")]
    df = frame(rows, SCHEMA)
    out = exact_dedup(df).collect()
    assert len(out) == len(rows)
    assert sum(r["kept"] for r in out) == 4
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in keep_first(df).collect())
    assert kept == [(False, 0, "b"), (False, 1, "a"), (False, 2, ""), (True, 0, "c")]
    assert keep_first(df).columns == df.columns


def test_empty_table(frame):
    df = frame([], SCHEMA)
    assert exact_dedup(df).count() == 0 and keep_first(df).count() == 0


def test_hot_group(spark):
    df = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) as text")
    got = exact_dedup(df).where("group_size > 1")
    assert got.count() == 1000 and got.where("kept").collect()[0]["doc_id"] == 0


def test_filter_counts():
    r = np.random.default_rng(1)
    a, b = r.integers(-50, 50, 500), r.integers(-50, 50, 300)
    keys, counts = merge_runs([np.unique(a.view(np.uint64), return_counts=True), np.unique(b.view(np.uint64), return_counts=True)])
    want = np.unique(np.concatenate([a, b]).view(np.uint64), return_counts=True)
    assert (keys == want[0]).all() and (counts == want[1]).all()
    f = CountingQuotientFilter(3)
    f.add(a)
    got = [(blk << 61) + int(x) for blk, rem, _ in f.blocks() for x in rem]
    assert sorted(got) == sorted(int(x) for x in np.unique(a.view(np.uint64)))


@pytest.mark.parametrize("width", [2, 5, 12, 48, 63])
def test_filters_give_back_what_they_hold(width):
    r = np.random.default_rng(width)
    for n in (1, 2, 7, 100, 3000):
        top = min(1 << width, 1 << 62)
        keys = np.unique(r.integers(0, top, n, dtype=np.uint64) if n % 2 else r.integers(0, max(1, top // 50), n, dtype=np.uint64))
        counts = r.choice([1, 1, 1, 2, 3, 4, 9, 100_000, 5_000_000_000], len(keys)).astype(np.int64)
        if width < 12:
            counts = np.minimum(counts, 40)
        got = merge_runs([scan_filter(pack_filter(keys, counts, width), width)])
        assert (got[0] == keys).all() and (got[1] == counts).all()


def test_first_and_last_keys_and_long_runs():
    """Quotients at the table's ends, and runs that push others on."""
    for keys in ([0], [(1 << 40) - 1], [0, (1 << 40) - 1], list(range(200)), list(range((1 << 40) - 200, 1 << 40))):
        keys = np.array(keys, np.uint64)
        for counts in (np.ones(len(keys), np.int64), np.full(len(keys), 2), np.full(len(keys), 7)):
            got = scan_filter(pack_filter(keys, counts, 40), 40)
            assert (got[0] == keys).all() and (got[1] == counts).all()


def test_packed_slots_and_bytes_an_entry():
    r = np.random.default_rng(2)
    for bits in (2, 13, 45, 64):
        values = r.integers(0, 1 << min(bits, 63), 70_001, dtype=np.uint64)
        data = pack_slots(values, bits)
        assert len(data) == -(-len(values) * bits // 8) and (unpack_slots(data, bits, len(values)) == values).all()
    # 16 bytes as key and count; a table has a power of two of slots
    for n, most in ((249_000, 6.5), (250_000, 11)):
        keys = np.unique(r.integers(0, 1 << 56, n, dtype=np.uint64))
        assert len(pack_filter(keys, np.ones(len(keys), np.int64), 56)) / len(keys) < most


def test_clashing_columns(frame):
    df = frame([(1, "a", 9, 9, 9, 9, 9), (2, "a", 8, 8, 8, 8, 8), (2, "b", 7, 7, 7, 7, 7), (2, "b", 6, 6, 6, 6, 6)],
               "doc_id long, text string, __fp int, __of_id int, k_fp int, n int, row int")
    got = sorted(map(tuple, keep_first(df).collect()))
    assert got == [(1, "a", 9, 9, 9, 9, 9), (2, "b", 6, 6, 6, 6, 6)]
