"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

The pre-tokenizer cuts a text into pieces (words with a leading space, runs of digits, of
symbols, of white space); a merge never crosses a cut. Text is taken in slices that end before
white space behind another character, where a cut always is. Within a piece the transducer
holds a window of bytes. `lookahead` is the number of bytes behind a token boundary that can
still move that boundary: a rule (a, b) at the boundary can only be undone by an earlier rule
that takes a right part of b away, that one by a still earlier rule, and so on; the longest such
chain in the merge list bounds the bytes that matter. Tokens ending that far before the end of
the window are stable and leave it. So memory depends on the vocabulary, not on the text, and
pieces without any cut (a megabyte of one letter) stream as well.

Decoding joins the bytes of the tokens and feeds them to an incremental UTF-8 state machine,
which holds back at most three bytes; malformed sequences become U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern of the byte-level pre-tokenizer.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SLICE = 1 << 16       # characters of text looked at together
WHOLE = 256           # pieces of more bytes than this are streamed
CACHE = 1 << 18       # distinct pieces remembered by one worker before it forgets them all


class Vocabulary(NamedTuple):
    """What encoding needs; small (its size is that of the tokenizer file) and sent to the tasks."""

    tokens: list[bytes]                        # by id
    merges: list[tuple[bytes, bytes]]          # by rank
    specials: dict[str, int]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        stored = json.load(file)
    letters = byte_alphabet()
    model = stored["model"]
    specials = {t["content"]: t["id"] for t in stored.get("added_tokens", [])}

    def raw(token: str) -> bytes:
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    size = max([*model["vocab"].values(), *specials.values()]) + 1
    tokens = [b""] * size
    for token, at in (model["vocab"] | specials).items():
        tokens[at] = raw(token)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    return Vocabulary(tokens, [(raw(a), raw(b)) for a, b in pairs], specials)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes behind a token boundary that can still change what stands before it.

    Rules are taken by rank. `reach[x]` is the most bytes any rule so far that takes x as its left
    part can depend on; a rule (a, b) depends on b itself, and on what can take away one of the
    parts that end b while b is being built.
    """
    made: dict[bytes, bytes] = {}              # token -> right part of the rule that first makes it
    for a, b in merges:
        made.setdefault(a + b, b)
    reach: dict[bytes, int] = {}
    longest = 0
    for a, b in merges:
        best, tail = 0, b
        while True:
            best = max(best, reach.get(tail, 0))
            if tail not in made:
                break
            tail = made[tail]
        need = len(b) + best
        reach[a] = max(reach.get(a, 0), need)
        longest = max(longest, need)
    return longest + max((len(a + b) for a, b in merges), default=1)


class Transducer:
    """Encoder and decoder of one vocabulary; a worker keeps one and its cache of pieces."""

    def __init__(self, vocabulary: Vocabulary):
        self.tokens = vocabulary.tokens
        ids = {t: i for i, t in enumerate(vocabulary.tokens) if i not in set(vocabulary.specials.values())}
        self.bytes = [ids.get(bytes([b]), -1) for b in range(256)]
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(vocabulary.merges):
            self.rules.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.lookahead = sufficient_lookahead(vocabulary.merges)
        self.window = max(4096, 4 * self.lookahead)
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile(r"\S(?=\s)")
        self.last_cut = regex.compile(r"(?r)\S(?=\s)")
        self.special_ids = vocabulary.specials
        self.specials = (
            regex.compile("|".join(regex.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True)))
            if vocabulary.specials else None
        )
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge(self, data: bytes) -> list[int]:
        """The tokens of a whole piece or window: the rule of lowest rank first, leftmost first."""
        ids = [self.bytes[b] for b in data]
        n = len(ids)
        if n < 2:
            return [i for i in ids if i >= 0]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rules = self.rules
        heap = []
        for i in range(n - 1):
            rule = rules.get((ids[i], ids[i + 1]))
            if rule:
                heap.append((rule[0], i, ids[i], ids[i + 1], rule[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rule = rules.get((made, ids[k]))
                if rule:
                    heapq.heappush(heap, (rule[0], i, made, ids[k], rule[1]))
            h = before[i]
            if h >= 0:
                rule = rules.get((ids[h], made))
                if rule:
                    heapq.heappush(heap, (rule[0], h, ids[h], made, rule[1]))
        return [i for i in ids if i >= 0]

    def stream(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one piece, however long, as they become stable."""
        at, held = 0, b""
        while at < len(data):
            held += data[at : at + self.window]
            at += self.window
            tokens = self.merge(held)
            if at < len(data):
                end, stable, limit = 0, 0, len(held) - self.lookahead
                for t in tokens:
                    if end + len(self.tokens[t]) > limit:
                        break
                    end += len(self.tokens[t])
                    stable += 1
                tokens, held = tokens[:stable], held[end:]
            yield tokens

    def piece(self, text: str) -> tuple[int, ...]:
        """Tokens of a piece that is not remembered."""
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > WHOLE:
            return tuple(t for part in self.stream(data) for t in part)
        found = tuple(self.merge(data))
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[text] = found
        return found

    def slices(self, text: str) -> Iterator[str]:
        """Slices that end where a cut of the pre-tokenizer is."""
        start, n = 0, len(text)
        while n - start > SLICE:
            # White space is what the pre-tokenizer takes for it; str.isspace takes U+001C to U+001F too.
            found = self.last_cut.search(text, start, start + SLICE + 1)
            if not found:  # none in this slice: on to the next one behind it
                found = self.cut.search(text, start + SLICE)
                if not found:
                    break
            end = found.end()
            yield text[start:end]
            start = end
        if start < n:
            yield text[start:]

    def plain(self, text: str) -> Iterator[list[int]]:
        for part in self.slices(text):
            known = self.cache
            out: list[int] = []
            extend = out.extend
            for piece in self.pieces.findall(part):
                ids = known.get(piece)
                extend(self.piece(piece) if ids is None else ids)
            yield out

    def encode(self, text: str) -> Iterator[list[int]]:
        """Batches of ids in order. Special tokens are found in the text first, as the library does."""
        start = 0
        if self.specials and "<" in text:
            for found in self.specials.finditer(text):
                yield from self.plain(text[start : found.start()])
                yield [self.special_ids[found.group()]]
                start = found.end()
        yield from self.plain(text[start:] if start else text)

    def decode(self, batches: Iterator[list[int]]) -> Iterator[str]:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        tokens = self.tokens
        for ids in batches:
            yield machine.decode(b"".join([tokens[i] for i in ids]))
        yield machine.decode(b"", True)


_transducers: dict[int, Transducer] = {}


def _transducer(shared) -> Transducer:
    if shared.id not in _transducers:
        _transducers[shared.id] = Transducer(shared.value)
    return _transducers[shared.id]


class _Shared(NamedTuple):
    """A broadcast vocabulary and a name for it that tasks of one worker agree on."""

    id: str
    broadcast: object

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def shared_vocabulary(spark, path: str) -> _Shared:
    """Read the file on the driver and send it to the executors (as large as the file)."""
    vocabulary = read_vocabulary(path)
    name = hashlib.sha1(repr(vocabulary).encode()).hexdigest()
    return _Shared(name, spark.sparkContext.broadcast(vocabulary))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, and the digests of ids and decoded text.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows give repeated
    results, a null doc_id stays null, other columns are not looked at, an empty table gives none.
    """
    shared = shared_vocabulary(docs.sparkSession, path)

    def digests(coder: Transducer, text: str | None) -> tuple[int, str, str]:
        n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

        def hashed():
            nonlocal n
            for ids in coder.encode(text or ""):
                n += len(ids)
                ids_hash.update(array("I", ids).tobytes())
                yield ids

        for part in coder.decode(hashed()):
            text_hash.update(part.encode("utf-8"))
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def work(batches):
        coder = _transducer(shared)
        for batch in batches:
            found = [digests(coder, text.as_py()) for text in batch.column("text")]
            n, ids, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()),
                 pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(
        work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every text, as an array."""
    shared = shared_vocabulary(docs.sparkSession, path)

    def work(batches):
        coder = _transducer(shared)
        for batch in batches:
            ids = [[i for part in coder.encode(text.as_py() or "") for i in part]
                   for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(
        work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text of every array of ids; null counts as no ids."""
    shared = shared_vocabulary(encoded.sparkSession, path)

    def work(batches):
        coder = _transducer(shared)
        for batch in batches:
            texts = ["".join(coder.decode(iter([ids.as_py() or []]))) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.selectExpr("cast(doc_id AS bigint) AS doc_id", "ids").mapInArrow(
        work, "doc_id long, text string")
