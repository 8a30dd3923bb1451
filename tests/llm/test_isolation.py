import random
import re

import numpy as np
import pytest

from duelytics.llm import isolation
from tests.llm.helpers import documents, prose

TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "x y z " * 40, "line here\nline here\n\n\nline here", "Ünïcode wörds é ** <|> &",
    "the same three\nwords the same three", "\x0bvertical\x0ctabs\r\n", "no-break space", "long " * 40_000, "$$$ %%% ### a",
]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found, repeated = {}, set()
    for k in range(len(words) - 2):
        found.setdefault(tuple(words[k : k + 3]), []).append(k)
    for places in found.values():
        if len(places) > 1:
            repeated.update(k + d for k in places for d in range(3))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(repeated))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_counts_against_brute_force(spark):
    rng = random.Random(8)
    alphabet = ["ab", "c", " ", " ", "\n", "$", "é", "\t"]
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    rows += [(100 + k, "".join(rng.choices(alphabet, k=rng.randint(0, 200)))) for k in range(200)]
    rows += [(None, "no id"), (4, TEXTS[4])]
    got = isolation.rule_verdicts(documents(spark, rows, clashing=True), labels(spark, [])).collect()
    found = sorted(((r.doc_id, tuple(r[c] for c in isolation.COUNTS), r.base_failed, r.kept) for r in got), key=repr)
    expected = []
    for i, t in rows:
        c = counts(t)
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        expected.append((i, c, failed, not failed))
    assert found == sorted(expected, key=repr)
    assert isolation.rule_verdicts(documents(spark, []), labels(spark, [])).count() == 0


def test_outliers_have_short_paths():
    rng = np.random.default_rng(1)
    clean = rng.normal(0, 1, (600, 5))
    forest = isolation.grow(clean)
    far = rng.normal(0, 1, (50, 5)) + np.array([15, 0, 0, 0, 0])
    assert forest.path_lengths(far).max() < np.quantile(forest.path_lengths(clean), 0.05)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    clean = [(k, prose(rng, rng.randint(60, 300)).replace(" s", ". S")) for k in range(300)]
    junk = [(1000 + k, " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 100).split())) for k in range(40)]
    junk += [(2000 + k, prose(rng, 100).upper().replace(" ", "!! ")) for k in range(40)]
    return clean + junk


def test_labelled_junk_fails_and_clean_rows_stay(spark, rows):
    known = [(i, int(i < 1000), 0) for i, _ in rows if i % 2 == 0] + [(None, 1, 0), (0, 1, 0), (9999, 0, 0), (2, None, 0)]
    docs = documents(spark, rows, clashing=True)
    got = {r.doc_id: r.kept for r in isolation.rule_verdicts(docs, labels(spark, known)).collect()}
    clean = [kept for i, kept in got.items() if i < 1000]
    assert np.mean(clean) > 0.98 and not any(kept for i, kept in got.items() if i >= 1000)
    good = isolation.good_documents(docs, labels(spark, known))
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(i for i, kept in got.items() if kept)


def test_the_sample_is_bounded_and_the_same_each_time(spark, rows):
    docs, known = documents(spark, rows), labels(spark, [(i, 1, 0) for i, _ in rows])
    once = sorted(r.doc_id for r in isolation.labelled_sample(docs, known, 50).collect())
    assert len(once) == 50
    assert once == sorted(r.doc_id for r in isolation.labelled_sample(docs.repartition(5), known, 50).collect())


def test_repeated_ids_give_the_same_forest_each_time(spark, rows):
    rng = random.Random(9)
    docs = documents(spark, rows + [(i, prose(rng, rng.randint(60, 300))) for i, _ in rows])
    known = labels(spark, [(i, int(i < 1000), 0) for i, _ in rows])
    assert len({isolation.train(docs.repartition(n), known).threshold for n in (1, 3, 8)}) == 1


def test_every_row_is_judged_by_its_own_text(spark, rows):
    known = labels(spark, [(i, int(i < 1000), 0) for i, _ in rows if i % 2 == 0])
    junk = "### $$$ " * 80
    odd = [(None, rows[1][1]), (None, junk), (3, junk), (2001, rows[5][1])]
    got = isolation.good_documents(documents(spark, rows + odd, clashing=True), known).collect()
    found = [(r.doc_id, r.text) for r in got]
    assert odd[0] in found and odd[3] in found and rows[3] in found
    assert odd[1] not in found and odd[2] not in found
    assert (2001, dict(rows)[2001]) not in found
