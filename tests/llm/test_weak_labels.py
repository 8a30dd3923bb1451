import numpy as np
import pytest

from duelytics.llm import weak_labels as wl
from duelytics.llm.store import table
from tests.conftest import SF
from tests.llm.helpers import documents


def test_em_finds_accuracies_and_labels():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.9, 0.8, 0.7, 0.95, 0.85])
    cast = np.where(rng.random((len(truth), 5)) < accuracy, truth[:, None], ~truth[:, None]).astype(int)
    cast[rng.random(cast.shape) < 0.3] = wl.NOTHING
    patterns, counts = np.unique(cast @ 3 ** np.arange(5), return_counts=True)
    model = wl.expectation_maximisation(wl.cast_of(patterns, 5), counts)
    assert abs(model.good - 0.8) < 0.03
    found = model.table[1, :, wl.GOOD] / (model.table[1, :, wl.GOOD] + model.table[1, :, wl.BAD])
    assert np.abs(found - accuracy).max() < 0.05
    voted = (cast != wl.NOTHING).any(axis=1)
    assert ((model.posterior(cast) > 0.5) == truth)[voted].mean() > 0.95
    assert (model.posterior(cast)[~voted] == model.good).all()


def test_patterns_and_votes_are_inverse():
    cast = np.random.default_rng(0).integers(0, 3, (50, len(wl.LABELLERS)))
    assert (wl.cast_of(wl.pattern_of(cast)) == cast).all()


@pytest.fixture(scope="module")
def labelled(spark):
    docs = table(spark, SF.replace("0.001", "0.01"), "documents")
    labels = table(spark, SF.replace("0.001", "0.01"), "labels")
    return wl.classify(docs).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(labelled):
    good = labelled.quality == 1
    assert (labelled.kept == good).mean() > 0.98
    assert labelled.kept[good].mean() > 0.985 and (~labelled.kept[~good]).mean() > 0.9


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "word " * 50_000), (None, "some words are here"), (5, "plain words of a text. " * 3),
            (5, "plain words of a text. " * 3), (6, "\n\n"), (7, "é")]
    got = wl.classify(documents(spark, rows, clashing=True)).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 and isinstance(r.kept, bool) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1 and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert wl.classify(documents(spark, [])).count() == 0


def test_scorer_learns_and_shares_the_reading_of_blocks():
    from duelytics.llm.words import Block

    texts = [b"plain words in a row", b"$$$ %%% ### !!!"] * 20
    part = wl.read(Block(texts))
    label = np.array([1.0, 0.0] * 20)
    scorer = wl.train(part.feature, part.owner, part.value, label)
    assert ((scorer.probability(part, 40) > 0.5) == (label > 0.5)).all()
    alone = wl.read(Block(texts[1:2]))
    assert np.isclose(scorer.probability(alone, 1)[0], scorer.probability(part, 40)[1])


def test_repeated_ids_train_one_row_each_whatever_the_order(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = ["plain", "words", "of", "a", "text", "$$$", "AND", "more!", "1234"]
    rows = [(k % 30, " ".join(rng.choice(words, 60 + k % 50))) for k in range(300)]
    rows += rows[:40]
    trained = []
    train = wl.train
    monkeypatch.setattr(wl, "train", lambda *x: trained.append(len(x[3])) or train(*x))
    found = [wl.fit(documents(spark, r).repartition(n), sample=20)[1] for r, n in ((rows, 1), (rows[::-1], 7))]
    assert trained == [20, 20]
    assert (found[0].weight == found[1].weight).all() and found[0].bias == found[1].bias
