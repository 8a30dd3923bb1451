import hashlib
import random
from array import array

import pytest
from hypothesis import given, settings, strategies as st

from duelytics.llm import bpe
from duelytics.llm.queries import vocabulary_path
from tests.llm.helpers import documents

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    found = tokenizers.Tokenizer.from_file(vocabulary_path())
    found.no_truncation()
    found.no_padding()
    return found


@pytest.fixture(scope="module")
def coder():
    return bpe.Transducer(bpe.read_vocabulary(vocabulary_path()))


def ids_of(coder, text):
    return [i for part in coder.encode(text) for i in part]


TEXTS = [
    "", " ", "a", "Hello world's it'll we'l 'll", "  two  spaces \n\n\t tabs\t", "naïve çà é — “quotes”", "日本語 текст ελλ",
    "x" * 9000, " " * 7000 + "end", "ab" * 20000, "😀👩‍👩‍👧 é", "<|endoftext|>a<|endoftext|>", "<|endoftext", "1234567 ½ Ⅳ",
    "  wide　spaces", "a\x00b\x7f", "'s't", "word " * 30000,
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text_as_the_library(coder, library, text):
    ids = ids_of(coder, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert "".join(coder.decode(iter([ids]))) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_random_texts(coder, library, text):
    assert ids_of(coder, text) == library.encode(text, add_special_tokens=False).ids


def test_streamed_pieces_equal_whole_ones(coder):
    rng = random.Random(3)
    for letters in ("ab", "the an in", "eaiou tnsr", "xyzq"):
        data = "".join(rng.choices(letters, k=3 * coder.window + 17)).encode()
        assert [t for part in coder.stream(data) for t in part] == coder.merge(data)


def test_lookahead_of_a_chain_of_merges():
    # c d first, then b c, then a b: whether a joins b hangs on d.
    merges = [(b"c", b"d"), (b"b", b"c"), (b"a", b"b")]
    assert bpe.sufficient_lookahead(merges) >= 3


def test_decoding_holds_back_unfinished_characters(coder, library):
    ids = library.encode("é😀", add_special_tokens=False).ids
    assert "".join(coder.decode(iter([[i] for i in ids]))) == "é😀"
    assert "".join(coder.decode(iter([ids[:-1]]))) == library.decode(ids[:-1], skip_special_tokens=False)


def test_round_trip_of_a_table(spark, library):
    rows = [(1, None), (2, ""), (3, "some text, some text"), (3, "some text, some text"), (None, "no id"),
            (5, "z" * 300_000), (6, "<|endoftext|> é\n")]
    found = bpe.round_trip(documents(spark, rows, clashing=True), vocabulary_path()).collect()
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(),
                         hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)
    assert bpe.round_trip(documents(spark, []), vocabulary_path()).count() == 0


def test_encode_and_decode_tables(spark):
    docs = documents(spark, [(1, "one two"), (2, None), (3, "café")])
    back = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    assert {r.doc_id: r.text for r in back.collect()} == {1: "one two", 2: "", 3: "café"}


@pytest.mark.parametrize("text", ["!\x1c!" * 50_000, "a \x1f?b " * 30_000, ("!" * 65_535 + "\x1c!") * 3, "!\x1c" * 70_000 + " x\x85y" * 9_000,
                                  "x" * 65_535 + " y" * 70_000, "x" * 65_536 + " y", " " * 140_000 + "x"])
def test_slices_end_at_cuts_of_the_pre_tokenizer(coder, library, text):
    assert ids_of(coder, text) == library.encode(text, add_special_tokens=False).ids
    assert [p for part in coder.slices(text) for p in coder.pieces.findall(part)] == coder.pieces.findall(text)
