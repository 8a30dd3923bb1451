"""Finding many names or keywords in long texts in one pass over each text.

One `contains` or regular expression per name reads every text once per name.  Keywords are whole words,
so a text is cut into words once and all lists look at the words in hashed sets.  Names may begin and
end inside words and be any number; they are found by their rarest gram, in a join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from duelytics.session import stored

GRAM, PIECE, FILTER_BITS, HELD = 8, 1 << 17, 1 << 20, 20_000
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def gram_index(names: DataFrame, size: int = GRAM) -> DataFrame:
    """kind, name, gram, offset: each name filed under the one of its grams (strings of `size` bytes)
    that the fewest names have. A shorter name is its own gram."""
    own = names.select("kind", "name").distinct().where("name <> ''")
    grams = own.selectExpr("kind", "name", f"""posexplode(transform(
        sequence(1, greatest(1, octet_length(name) - {size - 1})), i -> substring(cast(name AS binary), i, {size})))
        AS (offset, gram)""")
    shared = grams.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n"))
    return grams.join(shared, F.col("gram") == F.col("g")).groupBy("kind", "name").agg(
        F.min(F.struct("n", "gram", "offset")).alias("rarest")).select("kind", "name", "rarest.gram", "rarest.offset")


def _places(grams: np.ndarray) -> np.ndarray:
    """Places in the map of grams, which are numbers of up to eight bytes."""
    return (grams * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)


def _gram_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = [int.from_bytes(gram, "little") for gram in batch.column("gram").to_pylist()]
        place = _places(np.array(grams, np.uint64)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])


def _grams_at(data: np.ndarray, size: int) -> np.ndarray:
    """The `size` bytes from each byte on as one number; behind the last come zeros."""
    grams = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for n in (1, 2, 4):
        grams = grams[:-n] | grams[n:] << np.uint64(8 * n)
    return grams if size == 8 else grams & np.uint64((1 << 8 * size) - 1)


def names_in_texts(docs: DataFrame, names: DataFrame, size: int = GRAM) -> DataFrame:
    """Distinct (model, kind, name) such that a text of the model contains a name of `names` (kind, name).

    Names are filed under their rarest gram, at most eight bytes. Texts are looked at as bytes, and of their
    grams only those go on that a map of `FILTER_BITS` bits does not rule out, with as many bytes around them
    as names in this part of the map need. They meet the names in a join on the gram, and the bytes decide. So
    nothing but the map and its reaches, whose sizes are fixed, travel with the tasks, however many names there
    are; with so many names that it rules out little, more grams go through the join.
    """
    index = stored(gram_index(names, size).mapInArrow(
        _gram_places, "kind string, name string, gram binary, offset int, place int"), "grams")
    words = index.groupBy(F.expr("place div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, place % 64)")).alias("bits"),
        F.max("offset").alias("before"), F.max(F.expr("octet_length(name) - offset")).alias("behind"))
    bits, reach = np.zeros(FILTER_BITS // 64, "<i8"), np.zeros((2, FILTER_BITS // 64), np.int32)
    for row in words.collect():  # at most FILTER_BITS / 64 rows
        bits[row["word"]], reach[:, row["word"]] = row["bits"], (row["before"], row["behind"])
    sizes = sorted(index.agg(F.collect_set(F.octet_length("gram"))).first()[0])
    known, step = bits.tobytes(), PIECE

    def work(batches):
        listed = np.unpackbits(np.frombuffer(known, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            texts = batch.column("text")
            _, borders, content = texts.buffers()
            borders = np.frombuffer(borders, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            content = memoryview(content)[: borders[-1]] if content else b""
            data = np.frombuffer(content, np.uint8)
            models = batch.column("model").to_pylist()
            hits = set()
            for low in range(int(borders[0]), len(data), step):
                for n in sizes:
                    places = _places(_grams_at(data[low : low + step + n - 1], n)[:step])
                    at = np.flatnonzero(listed[places])
                    before, behind = reach[:, places[at] // 64].astype(np.int64)
                    at += low
                    text = np.searchsorted(borders, at, "right") - 1
                    inside = at + n <= borders[text + 1]
                    start = np.maximum(at - before, borders[text])
                    end = np.minimum(at + behind, borders[text + 1])
                    hits.update(
                        (models[t], bytes(content[i : i + n]), i - a, bytes(content[a:b]))
                        for t, i, a, b in zip(*(x[inside].tolist() for x in (text, at, start, end))))
                if len(hits) >= HELD:
                    yield handed_on(hits)
                    hits.clear()
            if hits:
                yield handed_on(hits)

    def handed_on(hits):
        kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary())
        columns = [pa.array(column, kind) for column, kind in zip(zip(*hits), kinds)]
        return pa.RecordBatch.from_arrays(columns, ["model", "gram", "before", "around"])

    texts = docs.select("model", F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    marked = texts.mapInArrow(work, "model string, gram binary, before int, around binary")
    return marked.join(index, "gram").where(
        "before >= offset AND substring(around, before - offset + 1, octet_length(name)) = cast(name AS binary)"
    ).select("model", "kind", "name").distinct()


def token_runs(text: str) -> list[str]:
    """A text as runs of word characters and of others, in turn."""
    return re.findall(r"\w+|\W+", text)


def _among(words: Iterable[str]) -> str:
    """A list of constants in SQL."""
    escaped = (word.replace("\\", "\\\\").replace("'", "\\'") for word in sorted(words))
    return "(" + ", ".join(f"'{word}'" for word in escaped) + ")"


def _starts(keywords: Iterable[str]) -> str:
    """Where a keyword may start in `text`: the number of the token, how many there are from it on, and the
    strings of the first 1, 2, … tokens, as long as some keyword of this length begins with the token."""
    by_length: dict[int, set[str]] = {}
    for keyword in keywords:
        runs = token_runs(keyword)
        by_length.setdefault(len(runs), set()).add(runs[0])
    runs = ["'run1', get(tokens, i)"] + [
        f"'run{n}', if(get(tokens, i) IN {_among(by_length[n])}, array_join(slice(tokens, i + 1, {n}), ''), NULL)"
        for n in sorted(by_length) if n > 1
    ]
    # An array of one element binds the tokens to a name, so that a text is cut once.
    return f"""get(transform(array(regexp_extract_all(text, r'{TOKEN}', 0)), tokens -> transform(
        filter(transform(tokens, (token, i) -> if(token IN {_among(set().union(*by_length.values()))}, i, NULL)),
            i -> i IS NOT NULL),
        i -> named_struct('at', i, 'left', size(tokens) - i, {", ".join(runs)}))), 0)"""


def _length_at(by_length: Mapping[int, Sequence[str]]) -> str:
    """Tokens of the longest keyword that begins at `start`, 0 without one.

    An edge of a keyword that is no word character must touch one.
    """
    cases = []
    for n, keywords in sorted(by_length.items(), reverse=True):
        edges: dict[tuple[bool, bool], list[str]] = {}
        for keyword in keywords:
            edges.setdefault((not is_word(keyword[0]), not is_word(keyword[-1])), []).append(keyword)
        for (before, after), own in edges.items():
            touching = " AND start.at > 0" * before + f" AND start.left > {n}" * after
            cases.append(f"WHEN start.left >= {n} AND start.run{n} IN {_among(own)}{touching} THEN {n}")
    return f"CASE {' '.join(cases)} ELSE 0 END"


def _hits(by_length: Mapping[int, Sequence[str]]) -> str:
    """Hits of one list in the starts of a text: the leftmost wins, then the longest."""
    if not by_length:
        return "0"
    length = _length_at(by_length)
    if set(by_length) == {1}:  # words do not overlap
        return f"size(filter(starts, start -> {length} > 0))"
    return f"""aggregate(starts, named_struct('free', 0, 'hits', 0), (state, start) -> get(transform(
        array(if(start.at >= state.free, {length}, 0)), n -> named_struct(
            'free', if(n > 0, start.at + n, state.free), 'hits', state.hits + if(n > 0, 1, 0))), 0)).hits"""


def keyword_hits(docs: DataFrame, categories: Sequence[Sequence[str]]) -> DataFrame:
    """(model, index, hits, texts) for each keyword list: whole-word hits and the number of texts
    with one, zeros included.

    Within a list hits do not overlap: the leftmost wins, then the longest.  A word character is
    a letter, a number or an underscore; an edge of a keyword that is one must not touch
    another.  A text is cut once into runs of word characters and of others; the runs that some
    keyword begins with are the starts, and each list folds over the starts in order.  All of it are
    expressions of one projection; the shuffle carries a row per model and task.
    """
    lengths: list[dict[int, list[str]]] = [{} for _ in categories]
    for keywords, by_length in zip(categories, lengths):
        for keyword in {k for k in keywords if k}:
            by_length.setdefault(len(token_runs(keyword)), []).append(keyword)
    every = [k for by_length in lengths for keywords in by_length.values() for k in keywords]
    if not lengths:
        return docs.selectExpr("model", "0 AS index", "0L AS hits", "0L AS texts").limit(0)
    rows = docs.selectExpr("model", f"{_starts(every) if every else 'array()'} AS starts")
    # A null text has no starts.
    counted = rows.selectExpr("model", *[
        f"greatest(coalesce({_hits(by_length)}, 0), 0) AS h{i}" for i, by_length in enumerate(lengths)])
    sums = counted.groupBy("model").agg(*[
        F.expr(f"{how}) AS {name}{i}") for i in range(len(lengths))
        for how, name in ((f"sum(h{i}", "hits"), (f"count_if(h{i} > 0", "texts"))])
    entries = (f"named_struct('index', {i}, 'hits', hits{i}, 'texts', texts{i})" for i in range(len(lengths)))
    return sums.selectExpr("model", f"inline(array({', '.join(entries)}))")
