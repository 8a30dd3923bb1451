import random
import re

import numpy as np
import pytest

from duelytics.llm import dart_minhash as dm
from duelytics.llm.graph import components
from duelytics.llm.words import Block
from tests.llm.helpers import documents, prose

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    words = WORD.findall((text or "").encode().lower())
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(rows, similarity=0.8):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return sorted(((i, None if i is None else root(i)) for i, _ in rows), key=repr)


def changed(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "changed" + str(rng.randrange(10**6))
    return " ".join(words)


@pytest.mark.parametrize("outsiders", [dm.OUTSIDERS, 0])
def test_classes_against_all_pairs(spark, outsiders):
    rng = random.Random(11)
    rows, at = [], 0
    for n in (8, 30, 60, 200):
        for _ in range(6):
            base = prose(rng, n)
            for k in range(rng.randint(1, 5)):
                rows.append((at, changed(rng, base, k)))
                at += 1
    hot = prose(rng, 150)
    for _ in range(60):
        rows.append((at, changed(rng, hot, rng.randint(0, 8))))
        at += 1
    shared = prose(rng, 60)
    for k in range(60):  # a passage that is common to different texts, most of the text for some
        rows.append((at, prose(rng, 2 + k % 25) + " " + shared + " " + prose(rng, 3 + k % 7)))
        at += 1
    rows += [(1000, None), (1001, ""), (1002, " !! "), (1003, "two words"), (1004, "Two, WORDS!"), (1005, "two"),
             (None, hot), (None, None), (3, rows[3][1]), (1006, prose(rng, 20_000)), (-5, rows[0][1])]
    got = dm.classes(documents(spark, rows, clashing=True), outsiders=outsiders).collect()
    assert sorted(map(tuple, got), key=repr) == expected(rows)
    if outsiders == 0:
        return
    kept = dm.one_of_each(documents(spark, rows, clashing=True))
    assert kept.columns == documents(spark, rows, clashing=True).columns
    own = sorted({c for i, c in expected(rows) if c is not None})
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == own
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_empty_table(spark):
    assert dm.classes(documents(spark, [])).count() == 0
    assert dm.one_of_each(documents(spark, [])).count() == 0


def test_signatures_agree_as_often_as_weighted_sets_are_similar():
    rng = np.random.default_rng(1)
    for shared, left, right in ((400, 50, 50), (100, 100, 20), (5, 3, 2), (30, 0, 0)):
        names = rng.integers(0, 2**63, shared + left + right).astype(np.uint64)
        weight = rng.integers(1, 5, len(names)).astype(float)
        a = np.concatenate([names[:shared], names[shared : shared + left]])
        b = np.concatenate([names[:shared], names[shared + left :]])
        wa, wb = weight[: shared + left], np.concatenate([weight[:shared], weight[shared + left :]])
        wb[: shared // 2] += 1.5                       # heavier in the second text
        both = np.minimum(wa[:shared], wb[:shared]).sum()
        true = both / (wa.sum() + wb.sum() - both)
        t = 2000
        agree = (dm.dart_signature(a, wa, t) == dm.dart_signature(b, wb, t)).mean()
        assert abs(agree - true) < 5 * np.sqrt(max(true * (1 - true), 1e-4) / t) + 1e-9


def test_order_of_elements_does_not_matter():
    rng = np.random.default_rng(2)
    names = rng.integers(0, 2**63, 100).astype(np.uint64)
    order = rng.permutation(100)
    assert (dm.dart_signature(names, np.ones(100), 125) == dm.dart_signature(names[order], np.ones(100), 125)).all()


def test_counted_weights_tell_repetition(spark):
    base = prose(random.Random(4), 40)
    rows = [(1, base), (2, " ".join([base] * 30))]
    plain = dm.classes(documents(spark, rows)).collect()
    counted = dm.classes(documents(spark, rows), counted=True).collect()
    assert {r.class_id for r in plain} == {1}            # as sets they are nearly equal
    assert {r.class_id for r in counted} == {1, 2}


def test_shingles_of_a_block():
    texts = [b"a b c d e f", b"", b"x y", b"a b c d e f a b c d e"]
    found = dm.text_shingles(Block(texts))
    assert [len(e) for e, _ in found] == [2, 0, 1, 7 - 1]
    assert found[3][1].max() == 2 and set(found[0][0]) < set(found[3][0])


@pytest.mark.parametrize("seed", [0, 1])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(30)]
    edges += [(500, 500 + k) for k in range(1, 30)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    got = {r.id: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
