import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from duelytics.llm import anchors
from tests.llm.helpers import documents, words


def hashes(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return [" ".join(found[i:i + 4]) for i in range(max(1, len(found) - 3))] if found else []


def expected_print(text):
    own = [xxhash.xxh64_intdigest(s.encode(), 42) for s in hashes(text)]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in own) > len(own))


def all_pairs(prints, distance=4):
    """Smallest place that chains of close prints reach, by comparing everything."""
    prints = np.array(prints, np.uint64)
    label = list(range(len(prints)))
    for i in range(len(prints)):
        group = {label[j] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= distance)}
        label = [min(group) if x in group else x for x in label]
    return label


def flipped(rng, value, n):
    for bit in rng.sample(range(64), n):
        value ^= 1 << bit
    return value


def test_the_code_is_perfect():
    counts = np.bincount(anchors.syndrome(anchors._patterns(0)[0]), minlength=2048)
    assert (counts == 1).all()


def test_close_prints_meet():
    rng = random.Random(1)
    for distance in range(7):
        x = [rng.getrandbits(64) for _ in range(300)]
        y = [flipped(rng, v, distance) for v in x]
        met = []
        for prints in (x, y):
            own, key = anchors.anchors(np.array(prints, np.uint64), -(-(2 * distance // 3) // 2))
            met.append([set(key[own == i].tolist()) for i in range(len(x))])
        assert all(a & b for a, b in zip(*met))


def test_links_connect_as_all_pairs(spark):
    rng = random.Random(2)
    prints = [0, (1 << 64) - 1, 1]
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            prints.append(value)
            value = flipped(rng, value, rng.randint(1, 7))
    crowd = rng.getrandbits(64)  # many prints around one anchor
    prints += [flipped(rng, crowd, rng.randint(1, 3)) for _ in range(900)]
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "print long").cache()
    edges = anchors.links(df, crowd=100).collect()
    assert all(r.a != r.b for r in edges)
    label = {p: i for i, p in enumerate(signed)}
    for _ in range(len(edges)):
        before = dict(label)
        for r in edges:
            label[r.a] = label[r.b] = min(label[r.a], label[r.b])
        if label == before:
            break
    assert [label[p] for p in signed] == all_pairs(prints)
    assert len(edges) < 4 * len(prints)  # no list of all pairs


def test_rows_grow_with_the_fingerprints(spark):
    rng = random.Random(5)
    lone = spark.createDataFrame([(i, rng.getrandbits(62), i) for i in range(200)], "anchor int, print long, label long")
    met = spark.createDataFrame([(i // 20, rng.getrandbits(62), i) for i in range(200)], lone.schema)
    for visits in (lone, met):
        assert anchors._dealt(visits, 20).count() == 200
    assert anchors._dealt(met, 5).count() == 800  # four blocks


def texts(rng):
    rows = []
    for i in range(120):
        own = words(rng, rng.choice([3, 4, 5, 40, 400, 3000]))
        rows.append((len(rows), " ".join(own)))
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(len(own))] = "changed"
            rows.append((len(rows), " \n".join(own).title()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "Ä É"), (904, "ä é"), (None, "null id"), (None, None)]
    return rows + [(5, "another text of id 5"), rows[7], rows[7]]


def test_as_by_all_pairs(spark):
    rows = texts(random.Random(3))
    got = anchors.near_copies(documents(spark, rows, clashing=True).repartition(5))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    prints = [expected_print(t) for _, t in rows]
    label = all_pairs(prints)
    first = {}
    for (i, _), name in zip(rows, label):
        if i is not None:
            first[name] = min(i, first.get(name, i))
    expected = [(i, f"{p:016x}", first.get(name)) for (i, _), p, name in zip(rows, prints, label)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)
    assert len({f for _, _, f in expected}) < len(rows) - 20


def test_hash_is_that_of_spark(spark):
    rows = spark.createDataFrame([("one two three four",), ("ä é ö ü",)], "s string")
    for text, value in rows.select("s", F.xxhash64("s")).collect():
        assert np.concatenate(list(anchors.shingle_hashes(text))).view(np.int64).tolist() == [value]


def test_long_text_in_slices(monkeypatch):
    text = " ".join(words(random.Random(4), 2000))
    whole = anchors.fingerprint(text)
    monkeypatch.setattr(anchors, "SHINGLES", 37)
    assert anchors.fingerprint(text) == whole == expected_print(text)


def test_no_documents(spark):
    assert anchors.near_copies(documents(spark, [])).count() == 0
