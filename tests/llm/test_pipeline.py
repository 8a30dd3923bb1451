import hashlib
import inspect
import re
from array import array

import pytest

import corpus_pipeline
from duelytics.llm import isolation, mixing
from duelytics.llm.queries import ORACLES, QUERIES, vocabulary_path
from duelytics.llm.store import table
from tests.conftest import SF
from tests.llm.helpers import documents
from tests.llm.test_dart_minhash import expected as classes_of
from tests.llm.test_line_runs import expected as lines_of
from tools.check import compare, oracle_connection


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows before and after each stage."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        following = spark.read.parquet(f"{folder}/{name}")
        out[name] = (docs, following)
        docs = following
    return out


def test_stages_and_their_columns(stages):
    names = ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "encode"]
    assert [n for n, _ in corpus_pipeline.STAGES] == names
    for name in names[:-1]:
        assert stages[name][1].columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_stage_keeps_what_the_verdicts_keep(spark, stages):
    before, after = stages["quality_rules"]
    verdicts = isolation.rule_verdicts(before, table(spark, SF, "labels")).collect()
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in verdicts if r.kept)


def test_line_stage_against_brute_force(stages):
    before, after = stages["line_dedup"]
    expected = lines_of([(r.doc_id, r.text) for r in before.collect()])
    got = sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in after.collect()), key=repr)
    assert got == sorted(((e[0], e[3]) for e in expected), key=repr)


def test_near_stage_keeps_one_of_each_class(stages):
    before, after = stages["near_dedup"]
    expected = classes_of([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in expected})


def test_mix_stage_takes_the_words_of_the_mix(stages):
    before, after = stages["mix_sources"]
    taken = {r.doc_id: r.taken for r in mixing.mix(before).collect() if r.taken}
    held = {}
    for r in after.collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    assert held == taken


def test_last_stage_and_the_whole_run(spark, stages):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    before, after = stages["encode"]
    expected = []
    for r in before.collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                         hashlib.sha256(r.text.encode()).hexdigest()))
    assert sorted(map(tuple, after.collect())) == sorted(expected)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(expected)


def test_every_stage_takes_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id " * 30), (3, "a text of words that goes on and on. " * 1), (3, "a text of words"),
            (4, "x" * 50_000)]
    docs = documents(spark, rows, clashing=True)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        got.collect()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0


def test_registered_names():
    assert sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == list(QUERIES)
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert list(inspect.signature(corpus_pipeline.run).parameters) == ["spark", "sf_dir"]


@pytest.mark.parametrize("key", ORACLES)
def test_queries_beside_their_sql(spark, key):
    assert compare(QUERIES[key](spark, SF), oracle_connection(SF), ORACLES[key]) is None
