import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from duelytics.llm import repeats
from duelytics.llm.run_index import RunIndex, earliest
from tests.llm.helpers import documents, prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"ab", b"b", b"\x00", b"aba", b"\xff"]), max_size=12).map(b"".join), max_size=8),
       st.integers(1, 6))
def test_earliest_places(strings, length):
    seen, expected = set(), []
    for text in strings:
        own = []
        for k in range(len(text) - length + 1):
            piece = text[k : k + length]
            if piece in seen:
                own.append(k)
            seen.add(piece)
        expected.append(own)
    assert [list(map(int, x)) for x in earliest(strings, length)] == expected


def test_runs_are_those_of_the_transform():
    text = b"mississippi"
    index = RunIndex([text])
    ended = text + b"\0"
    order = sorted(range(len(ended)), key=lambda k: ended[k:])
    transform = "".join(chr(ended[k - 1]) for k in order)
    shown = "".join(chr(int(s) - 1 if s else 0) * n for s, n in zip(index.run_symbols, index.run_lengths))
    assert shown == transform
    match, partner = index.matching_statistics()
    for k in range(len(text)):
        row = order.index(k)
        assert partner[k] == (order[row - 1] if match[k] > 0 else -1)
        shared = 0
        while row and ended[k + shared] == ended[order[row - 1] + shared] != 0:
            shared += 1
        assert max(match[k], 0) == shared


def test_repetitive_texts_have_few_runs():
    piece = prose(random.Random(1), 20).encode()
    index = RunIndex([piece] * 200)
    assert len(index.run_lengths) < 0.05 * index.n + 400


def windows_of(parts):
    found = repeats.Pieces(parts)
    return sorted((int(r), int(s) + k, int(a)) for r, s, w, a in zip(found.row, found.start, found.windows, found.anchor)
                  for k in range(w))


def test_equal_windows_have_equal_anchors_wherever_texts_are_cut(monkeypatch):
    rng = random.Random(5)
    passage = prose(rng, 60)
    texts = [f"{prose(rng, 40)} {passage} {prose(rng, 30)}".encode() for _ in range(4)] + [b"short", b"q" * 130, b""]
    whole = windows_of([part for parts in repeats.cut_texts(texts) for part in parts])
    assert [w[:2] for w in whole] == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - 99)]
    monkeypatch.setattr(repeats, "SEGMENT", 97)
    cut = sorted(w for parts in repeats.cut_texts(texts) for w in windows_of(parts))
    assert cut == whole
    by_bytes = {}
    for row, start, anchor in whole:
        by_bytes.setdefault(texts[row][start : start + 100], set()).add(anchor)
    assert all(len(anchors) == 1 for anchors in by_bytes.values())


def expected(rows):
    # In order of documents; rows that repeat an id and a text are one.
    order = sorted({(-(1 << 63) if i is None else i, (t or "")) for i, t in rows})
    seen, found = set(), {}
    for key, text in order:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            piece = data[s : s + 100]
            if piece in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen.add(piece)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        found[key, text] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted(((i, *found[-(1 << 63) if i is None else i, t or ""]) for i, t in rows), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    passages = [prose(rng, n) for n in (16, 17, 30, 80, 200)] + ["ab" * 90, "é" * 60, "x" * 230]
    out = []
    for k in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.6 else prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 6))]
        out.append((k * 3, rng.choice(["", " ", "\n"]).join(parts)))
    near = prose(rng, 120).split()
    for k in range(40):
        own = list(near)
        for _ in range(3):
            own[rng.randrange(len(own))] = f"other{rng.randrange(1000)}"
        out.append((500 + k, " ".join(own)))
    out += [(700 + k, " ".join(near)) for k in range(30)]
    out += [(800, None), (801, ""), (802, "y" * 99), (803, "y" * 99), (804, "y" * 100), (805, "y" * 101), (806, "z" * 3000),
            (None, passages[3]), (-7, passages[4]), (9, out[3][1]), (807, passages[4] * 40)]
    return out


@pytest.mark.parametrize("crowd", [repeats.CROWD, 1])
def test_against_brute_force(spark, rows, crowd):
    got = repeats.dedup(documents(spark, rows, clashing=True), crowd=crowd).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)


def test_repeated_rows_and_no_rows(spark, rows):
    twice = rows[:40] + rows[:5]
    got = repeats.dedup(documents(spark, twice)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(twice)
    assert repeats.dedup(documents(spark, [])).count() == 0


def test_a_row_repeated_some_thousand_times_is_one_text(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 60), prose(rng, 30)
    rows = [(5, f"{other} {passage}")] * 3000 + [(None, f"{passage} x")] * 7 + [(6, f"{passage} {other}"), (8, f"{other} {passage}")]
    rows += [(9, "short")] * 20 + [(5, "other text of one id")]
    before = {t.name for t in spark.catalog.listTables()}
    got = repeats.dedup(documents(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_long_text_goes_in_segments(spark):
    rng = random.Random(2)
    text = prose(rng, 60_000)
    rows = [(1, text), (2, text[:300_000] + "!" + text[300_001:]), (3, np.random.default_rng(0).bytes(20).hex() + text[1000:2000])]
    got = repeats.dedup(documents(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
