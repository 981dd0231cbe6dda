import random

from fmlattice.llm.chat_format import format_chats
from tests.llm.frames import frame  # noqa: F401

SCHEMA = "conv_id long, turn long, role string, text string, place string, n string, h1 string"


def rows_of(convs):
    return [(c, t, r, x, "a", "b", "c") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]


def brute(convs):
    out = {}
    for c, turns in convs.items():
        if any(len(o) > len(turns) and o[:len(turns)] == turns for o in convs.values()):
            continue
        same = [d for d, o in convs.items() if o == turns]
        out[min(same)] = (len(turns), len(same))
    return out


def test_against_brute_force(frame):
    r = random.Random(1)
    convs = {i: [(r.choice(["user", "assistant"]), r.choice("ab")) for _ in range(r.randint(1, 6))] for i in range(80)}
    got = {x["conv_id"]: (x["n_turns"], x["copies"]) for x in format_chats(frame(rows_of(convs), SCHEMA)).collect()}
    assert got == brute(convs)


def test_rendering(frame):
    df = frame([(1, 2, "gpt", None, "", "", ""), (1, 1, " Human ", "hi <|im_end|>", "", "", ""),
                (1, None, None, "last", "", "", "")], SCHEMA)
    r = format_chats(df).collect()
    assert len(r) == 1 and r[0]["n_turns"] == 3
    assert r[0]["chat"] == ("<|im_start|>user\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
                            "<|im_start|>user\nlast<|im_end|>\n")
    assert r[0]["n_chars"] == len(r[0]["chat"])


def test_null_ids_repeats_and_empty(frame):
    df = frame([(None, 0, "user", "alone", "", "", ""), (None, 1, "user", "alone", "", "", ""),
                (None, 0, "user", "start", "", "", ""), (4, 0, "user", "start", "", "", ""),
                (4, 1, "assistant", "go", "", "", ""), (5, 0, "user", "x", "", "", ""), (5, 0, "user", "x", "", "", "")],
               SCHEMA)
    got = sorted((r["conv_id"] or -1, r["n_turns"], r["copies"]) for r in format_chats(df).collect())
    assert got == [(-1, 1, 2), (4, 2, 1), (5, 2, 1)]
    assert format_chats(df.limit(0)).count() == 0


def test_common_first_turn_and_long(frame):
    convs = {i: [("user", "hello")] + [("assistant", str(i))] * (i % 3) for i in range(120)}
    convs[999] = [("user", "hello"), ("assistant", "x" * 300_000)] * 150
    got = {x["conv_id"]: (x["n_turns"], x["copies"]) for x in format_chats(frame(rows_of(convs), SCHEMA)).collect()}
    assert got == brute(convs)


def test_plan_is_native(frame):
    df = format_chats(frame(rows_of({1: [("user", "a")]}), SCHEMA))
    plan = df._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_hot_conversation_over_many_ranges(frame):
    """Most rows are one conversation; its prefixes are found, and it is rendered in parts."""
    turns = [("user" if i % 2 == 0 else "assistant", f"t{i // 3}") for i in range(700)]
    convs = {7: turns, 3: turns[:650], 4: turns[:100], 5: turns[:99] + [("user", "other")], 6: turns[:700]}
    df = frame(rows_of(convs), SCHEMA)
    got = format_chats(df).collect()
    assert {r["conv_id"]: (r["n_turns"], r["copies"]) for r in got} == brute(convs)
    whole = {r["conv_id"]: r["chat"] for r in got}
    parts = {}
    for r in sorted(format_chats(df, part_turns=64).collect(), key=lambda r: (r["conv_id"], r["part"])):
        assert r["chat"].count("<|im_start|>") <= 64
        parts[r["conv_id"]] = parts.get(r["conv_id"], "") + r["chat"]
    assert parts == whole
