import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest

from fmlattice.llm import audit_dp as dp
from fmlattice.llm import conversation_repair as cr
from tests.llm.frames import frame  # noqa: F401

PATTERN = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, h int, place string, kind string, audit int"


def brute(rows):
    """Cheapest audit of (role, text) turns with whole strings, and the repaired turns."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else
                      "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(None)
    def best(i, seen_roles, inserts):
        """(cost, audit, turns) from row i on; seen_roles: what stands before, cut to what matters."""
        out = []

        def go(cost, letter, turn, j, more=0):
            last = seen_roles if turn is None else turn[0][:1]
            if turn is not None:
                pair = seen_roles + turn[0][:1]
                if not turn[0] or pair not in ("s", "u", "su", "ua", "au"):
                    return
            rest = best(j, last, more)
            if rest:
                out.append((cost + rest[0], letter + rest[1], ([turn] if turn else []) + rest[2]))

        if i == len(rows):
            if seen_roles in ("", "a"):
                out.append((0, "", []))
        else:
            role, text = rows[i]
            go(2, "D", None, i + 1)
            if faults[i] not in ("blank", "duplicate"):
                extra = 5 if faults[i] == "truncated" else 0
                go(extra, "K", (role, text), i + 1)
                for r in ("user", "assistant"):
                    go(1 + extra, "R", (r, text), i + 1)
        if inserts < 2:
            for r in ("user", "assistant"):
                go(5, "I", (r, ""), i, inserts + 1)
        return min(out, key=lambda x: x[:2], default=None)

    cost, audit, turns = best(0, "", 0)
    best.cache_clear()
    return faults, cost, audit, turns


def random_rows(r, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "User", "ugly"]
    texts = ["Yes.", "no", "", " \t", "What?", "So!  ", "a. b", "é."]
    return [(r.choice(roles[:r.randint(1, 8)]), r.choice(texts[:r.randint(1, 8)]) + ("" if r.random() < .5 else str(k) + "."))
            for k in range(n)]


def coded(rows, faults):
    kinds = {"s": dp.SYSTEM, "u": dp.USER, "a": dp.ASSISTANT}
    names = {"": dp.FINE, "blank": dp.BLANK, "duplicate": dp.DUPLICATE, "truncated": dp.TRUNCATED}
    return [(kinds.get(role[:1], dp.OTHER), names[f]) for (role, _), f in zip(rows, faults)]


def test_brute_against_all_audits():
    """The reference here against every string of edits of a short conversation."""
    r = random.Random(1)
    for _ in range(25):
        rows = random_rows(r, r.randint(0, 3))
        faults, cost, audit, turns = brute(rows)
        found = []
        for letters in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(rows) + 3)):
            if sum(x != "I" for x in letters) != len(rows):
                continue
            free = [("user", "assistant") if x in "IR" else (None,) for x in letters]
            for roles in itertools.product(*free):
                i, c, initials, bad = 0, 0, "", False
                for x, role in zip(letters, roles):
                    if x == "I":
                        c, initials = c + 5, initials + role[0]
                        continue
                    if x == "D":
                        c += 2
                    else:
                        bad |= faults[i] in ("blank", "duplicate") or (x == "K" and not rows[i][0])
                        c += (x == "R") + 5 * (faults[i] == "truncated")
                        initials += role[0] if x == "R" else rows[i][0][:1]
                    i += 1
                if not bad and PATTERN.fullmatch(initials):
                    found.append((c, "".join(letters)))
        assert min(found) == (cost, audit), rows


@pytest.mark.parametrize("modulus", [dp.HASH_MODULUS, 1, 2, 5])
def test_audits_in_any_pieces(monkeypatch, modulus):
    """Also where hashes collide."""
    monkeypatch.setattr(dp, "HASH_MODULUS", modulus)
    r = random.Random(modulus % 100)
    for _ in range(60):
        rows = random_rows(r, r.randint(0, 14))
        faults, cost, audit, _ = brute(rows)
        turns = coded(rows, faults)
        assert dp.whole(turns) == (cost, audit)
        cuts = sorted(r.sample(range(len(turns) + 1), min(len(turns), r.randint(0, 3))))
        parts = [turns[a:b] for a, b in zip([0, *cuts], [*cuts, len(turns)])]
        ways = [dp.ways(p, first=False) for p in parts]
        picks, closing = dp.chosen([(c, k) for c, _, k in ways])
        assert "".join(w[1][p] for w, p in zip(ways, picks)) + closing == audit
        assert sum(w[0][p] for w, p in zip(ways, picks)) + 5 * len(closing) == cost


def test_audit_order():
    r = random.Random(5)
    nodes = {"": dp.Audit()}
    for _ in range(300):
        before = r.choice(sorted(nodes))
        letter = r.choice("DIKR")
        if before + letter not in nodes:
            nodes[before + letter] = dp.Audit(nodes[before], letter)
    some = r.sample(sorted(nodes), 80)
    for x, y in itertools.permutations(some, 2):
        assert dp.precedes(nodes[x], nodes[y]) == (x < y)
    assert all(str(v) == k for k, v in nodes.items())


def expected(rows, ids):
    damaged = {}
    for conv, turn, role, text, *_ in rows:
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if c == 0:
            continue
        text = "" if c == 1 else re.sub("[.!?]", "", text) if c == 2 else text
        role = "user" if c == 4 else role
        damaged.setdefault(conv, []).extend([(turn, role, text)] * (2 if c == 3 else 1))
    out = []
    for conv in ids:
        turns = sorted(damaged.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(t[2].encode()).digest()))
        numbers = {t[0] for t in turns if t[0] is not None}
        pairs = [(r, x) for _, r, x in turns]
        faults, cost, audit, repaired = brute(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in repaired).encode()).hexdigest()
        out.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha, repaired))
    return out


def rows_of(r):
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randint(1, 9)):
            role, text = random_rows(r, 1)[0]
            rows.append((conv, None if r.random() < .05 else turn if r.random() < .9 else turn + 2,
                         None if r.random() < .05 else role, None if r.random() < .05 else text, 1, "p", "k", 2))
    long = random_rows(r, 150)
    rows += [(77, k, role, text, 1, "p", "k", 2) for k, (role, text) in enumerate(long)]
    return rows + rows[:7] + [(78, 0, "user", "x" * 300_000 + ".", 1, "p", "k", 2)]


@pytest.mark.parametrize("bits", [12, 3, 1])
def test_tables_in_chunks_of_any_size(frame, monkeypatch, bits):
    monkeypatch.setattr(cr, "CHUNK_BITS", bits)
    rows = rows_of(random.Random(bits))
    table = frame(rows, SCHEMA).repartition(3)
    ids = list(dict.fromkeys(x[0] for x in rows))
    want = expected(rows, ids)
    got = cr.repair(cr.damage(table), table).collect()
    assert sorted((tuple(x) for x in got), key=lambda x: (x[0] is None, x[0])) == sorted(
        (x[:9] for x in want), key=lambda x: (x[0] is None, x[0]))
    if bits == 3:
        turns = cr.repaired_turns(cr.damage(table)).orderBy("conv_id", "position").collect()
        lists = {}
        for t in turns:
            assert t["position"] == len(lists.setdefault(t["conv_id"], []))
            lists[t["conv_id"]].append((t["role"], t["text"]))
        assert lists == {x[0]: x[9] for x in want if x[9]}


def test_nothing_and_nothing_left(frame):
    empty = frame([], SCHEMA)
    assert cr.repair(cr.damage(empty), empty).collect() == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table = frame([(gone, 0, "user", "Hi.", 1, "p", "k", 2)], SCHEMA)
    assert [tuple(x) for x in cr.repair(cr.damage(table), table).collect()] == [
        (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
