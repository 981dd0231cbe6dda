import random

import numpy as np

from fmlattice.llm.license_scan import COVERAGE, TEMPLATES, align, k_grams, scan, tokens, winnow
from fmlattice.llm.license_texts import ALL
from tests.llm.frames import frame  # noqa: F401


def words(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return tokens(data, np.array([0, len(data)]))[0]


def full_alignment(template, text):
    """Most template tokens matched in order, without a band."""
    row = [0] * (len(text) + 1)
    for t in template:
        new = [0]
        for j, w in enumerate(text):
            new.append(max(row[j] + 1 if t == w else 0, row[j + 1], new[-1]))
        row = new
    return row[-1]


def mutate(text, r, n):
    w = text.split()
    for _ in range(n):
        i = r.randrange(len(w))
        w[i:i + 1] = r.choice([[], ["changed"], [w[i], "added"]])
    return " ".join(w)


def test_finds_templates_and_spans(frame):
    r = random.Random(1)
    filler = lambda n: " ".join(r.choice("alpha beta gamma delta été".split()) for _ in range(n))
    rows, want = [], {}
    for i, name in enumerate(sorted(TEMPLATES)):
        before = filler(30) + " "
        long = len(TEMPLATES[name].split()) > 25
        inner = mutate(TEMPLATES[name], r, 2) if long else TEMPLATES[name].upper()
        rows.append((i, before + inner + " " + filler(20), "x"))
        want[i] = (name, len(before), len(before) + len(inner))
    rows += [(90, None, "x"), (91, "", "x"), (92, filler(500), "x"), (93, "the license of the software " * 5, "x"), (90, None, "x")]
    got = {}
    for g in scan(frame(rows, "doc_id long, text string, license string")).collect():
        got[g["doc_id"]] = g
    for i, (name, a, b) in want.items():
        assert got[i]["license"] == name, (name, got[i])
        assert got[i]["coverage"] >= COVERAGE
        spans = {s.split(":")[0]: s.split(":")[1:] for s in got[i]["spans"].split(",")}
        s, e = int(spans[name][0]), int(spans[name][1])
        assert a <= s < a + 40 and b - 40 < e <= b, (name, a, b, spans)
    for i in (90, 91, 92, 93):
        assert got[i]["n_matches"] == 0 and got[i]["license"] is None
    assert scan(frame([], "doc_id long, text string")).count() == 0


def test_repeated_and_long(frame):
    notice = TEMPLATES["MIT-notice"]
    text = (notice + " word " * 50) * 40
    got = scan(frame([(1, text)], "doc_id long, text string")).collect()[0]
    spans = [s for s in got["spans"].split(",") if s.startswith("MIT-notice")]
    assert len(spans) == 40
    for s in spans:
        a, b = map(int, s.split(":")[1:3])
        assert text[a:b] == notice.rstrip(".")


def test_versions_and_families_are_told_apart(frame):
    rows = {"GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
            "CC-BY-4.0-short": "Licensed under CC BY 4.0.", "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0.",
            "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.", "BSD-3-Clause": ALL["BSD-3-Clause"],
            "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
            None: "This work is licensed under the GNU General Public License, version 9."}
    df = frame([(i, t) for i, t in enumerate(rows.values())], "doc_id long, text string")
    got = {g["doc_id"]: g for g in scan(df).collect()}
    assert [got[i]["license"] for i in range(len(rows))] == list(rows)
    assert [got[i]["n_matches"] for i in range(4)] == [1, 1, 1, 1]


def test_every_template_is_found_as_itself(frame):
    names = sorted(ALL)
    df = frame([(i, f"été {ALL[n]} word") for i, n in enumerate(names)], "doc_id long, text string")
    got = {g["doc_id"]: g for g in scan(df).collect()}
    assert [got[i]["license"] for i in range(len(names))] == names


def test_text_put_inside_a_notice(frame):
    w = TEMPLATES["ISC"].split()
    text = " ".join(w[:15] + ["other"] * 14 + w[15:])
    got = scan(frame([(1, text)], "doc_id long, text string")).collect()[0]
    assert got["license"] == "ISC" and got["coverage"] == 1.0


def test_band_against_full_alignment():
    r = random.Random(5)
    for name in ("MIT", "ISC", "GPL-3.0-header"):
        template = words(TEMPLATES[name])
        for _ in range(5):
            text = words(mutate(TEMPLATES[name], r, 3))
            assert align(template, text, 0)[0] == full_alignment(template.tolist(), text.tolist())


def test_winnowing_keeps_one_of_each_window():
    r = np.random.default_rng(1)
    h = r.integers(0, 50, 200).astype(np.uint64)
    kept = winnow(h, 4)
    assert all(any(a <= k < a + 4 for k in kept) for a in range(197))
    grams, at = k_grams(np.arange(6, dtype=np.uint64), np.array([0, 0, 0, 0, 1, 1]), 3)
    assert at.tolist() == [0, 1]


def test_repeated_phrases_take_linear_time():
    """A phrase of a template over and over, and a whole notice over and over."""
    import time

    from fmlattice.llm import license_scan as L
    index = L.TemplateIndex(L.ALL)
    notice = L.ALL[min(index.names, key=lambda n: len(L.ALL[n]))] + " "
    phrase = " ".join(L.ALL[max(index.names, key=lambda n: len(L.ALL[n]))].split()[:8]) + " "

    def took(text):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes, _, _, owner = L.tokens(data, np.array([0, len(data)]))
        grams, at = L.k_grams(hashes, owner)
        began = time.process_time()
        found = L.matches(index, hashes, grams, at, L.COVERAGE)
        return time.process_time() - began, len(found)

    for piece, found in ((notice, True), (phrase, False)):
        n = 100_000 // len(piece)
        few, many = took(piece * n), took(piece * 4 * n)
        assert (few[1] > 0) == found and abs(many[1] - 4 * few[1]) <= 4
        assert many[0] < 8 * few[0] + 0.5       # quadratic: 16 times
