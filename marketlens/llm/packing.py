"""Packing documents into sequences: order-preserving dynamic programming over window cuts.

The documents of a partition, in stored order, are one stream of token ids. A *window* of at most
``WINDOW`` ids becomes a sequence. Windows may end after a document, after a sentence, inside a very
long sentence at steps of ``STEP`` ids, and anywhere near the end of the stream. The cuts are those of
least cost: the padding of each window, ``CHARGE`` per window, and the penalty of each cut that is not
the end of a document.

A window is padded to ``WINDOW`` ids, but not if its length is a power of two. So the least cost up to
a cut j is the smallest of cost(i) + WINDOW - (j - i) over the cuts i of the last WINDOW ids, which is a
sliding minimum of cost(i) + i, kept in a monotone queue, and of cost(j - 2**k) for the powers.

No row is shuffled: every partition is packed by itself, in order, and a stream is settled whenever
``HORIZON`` words have gathered (its last two windows stay open), so that a task holds no more than
those and one document. The cuts are the best ones between two such settlements.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import chain, repeat
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketlens.llm import pretokens

WINDOW, STEP, HORIZON = 4096, 256, 1 << 18
#: Costs in ids of padding: of a window, of a cut after a sentence, of any other cut inside a document.
CHARGE, SENTENCE, INSIDE = 4, 2, 16
#: Words and ids that a worker process keeps encoded, over its tasks.
CACHED_WORDS, CACHED_IDS = 1 << 20, 1 << 23
#: Words that are looked up at once, and pieces that are encoded as one text.
LOOKED_UP, ENCODED = 1 << 14, 1 << 10
MARKS = (".", "!", "?")
CLOSING = "\"')]}»”’"
#: The pieces of a lower-case word below U+0250, as the vocabulary's pattern cuts it (a fixed value but for the classes).
PIECES = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{pretokens.LETTERS}]+|[{pretokens.NUMBERS}]|[^{pretokens.LETTERS}{pretokens.NUMBERS}]+"
)
#: Characters that are left to the library: other scripts, odd white space, a letter whose lower case has two parts.
UNUSUAL = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ɏ]")


class WordEncoder:
    """Token ids of texts by their words, for tokenizers that drop white space and never join words across it.

    Words are split at ASCII white space only; what other white space they hold is left to the library.
    A word of usual characters is one piece or several; the ids of a piece end with one that ends a word,
    so that many pieces are encoded as one text. Tables only speed this up; they are dropped when full.
    """

    def __init__(self, model: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.end_id = Tokenizer.from_str(model), end_id
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        """Drop all words; the first is the end of a document."""
        self.known: dict[tuple[str] | str | None, int] = {None: 0}
        self.ids, self.ends, self.sentence = array("I", [self.end_id]), array("q", [0, 1]), bytearray([0])

    def full(self) -> bool:
        return len(self.known) > CACHED_WORDS or len(self.ids) > CACHED_IDS

    def words(self, text: str) -> list:
        """The words of a text, as ``numbers`` takes them: those for the library in tuples."""
        if UNUSUAL.search(text) is None and "<|" not in text:  # special tokens begin so
            return text.lower().split()
        return [(word,) for word in text.translate(BLANKS).split(" ") if word]

    def numbers(self, words: list) -> np.ndarray:
        """The number of each word; None is the end of a document."""
        numbers = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(numbers < 0).tolist()
        if at:
            self.learn({words[i] for i in at})
            numbers[at] = [self.known[words[i]] for i in at]
        return numbers

    def learn(self, words: set) -> None:
        odd = [word for word in words if isinstance(word, tuple)]
        texts = [word for (word,) in odd]
        if odd:
            ids = [np.array(x, np.uint32) for x in pretokens.encoded(self.tokenizer, texts)]
            self.add(odd, texts, np.concatenate(ids), np.cumsum([len(x) for x in ids]))
        whole = {word for word in words if isinstance(word, str) and word.isalpha()}
        cut = [word for word in words if isinstance(word, str) and word not in whole]
        parts = list(map(PIECES.findall, cut))
        whole.update(piece for piece in chain.from_iterable(parts) if piece not in self.known)
        self.learn_pieces(list(whole))
        joined = [(word, own) for word, own in zip(cut, parts, strict=True) if len(own) > 1]
        if joined:
            pieces = np.array([self.known[piece] for _, own in joined for piece in own])
            ids, sizes = self.ids_of(pieces)
            upto = np.cumsum(sizes)[np.cumsum([len(own) for _, own in joined]) - 1]
            self.add([word for word, _ in joined], [word for word, _ in joined], ids, upto)

    def learn_pieces(self, pieces: list[str]) -> None:
        for first in range(0, len(pieces), ENCODED):
            some = pieces[first : first + ENCODED]
            ids = np.array(pretokens.encoded(self.tokenizer, [" ".join(some)])[0], np.uint32)
            upto = np.flatnonzero(self.ends_word[ids]) + 1
            if len(upto) != len(some):
                each = [np.array(x, np.uint32) for x in pretokens.encoded(self.tokenizer, some)]
                ids, upto = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.add(some, some, ids, upto)

    def add(self, words: list, texts: list[str], ids: np.ndarray, upto: np.ndarray) -> None:
        """Number the words; their ids follow one another, those of each up to its place in ``upto``."""
        self.known.update(zip(words, range(len(self.sentence), len(self.sentence) + len(words)), strict=True))
        self.ends.frombytes((upto + self.ends[-1]).astype(np.int64).tobytes())
        self.ids.frombytes(ids.astype(np.uint32).tobytes())
        self.sentence.extend(text.endswith(MARKS) or text.endswith(tuple(CLOSING)) and text.rstrip(CLOSING).endswith(MARKS) for text in texts)

    def ids_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one after the other, and how many each has."""
        ends = np.frombuffer(self.ends, np.int64)
        sizes = (ends[1:] - ends[:-1])[numbers]
        upto = np.cumsum(sizes)
        source = np.repeat(ends[:-1][numbers] - (upto - sizes), sizes) + np.arange(upto[-1])
        return np.frombuffer(self.ids, np.uint32)[source], sizes


BLANKS = str.maketrans(dict.fromkeys("\t\n\v\f\r", " "))


def kept() -> dict:
    """The encoder that the last task of this process has left, by its model and end id.

    It is held by a module of the process: this one is shipped by value, so that each task has its own copy.
    """
    return vars(sys.modules.setdefault("marketlens_packing", ModuleType("marketlens_packing"))).setdefault("encoders", {})


ENCODERS = kept()


def shared_encoder(model: str, end_id: int) -> WordEncoder:
    """An encoder with the words that earlier tasks of this process have looked up, else a new one.

    It is taken out; a task that ends well puts it back, so that none is left half written. One is kept, and it is bounded.
    """
    found = kept().pop((model, end_id), None)
    kept().clear()
    if found is None:
        return WordEncoder(model, end_id)
    if found.full():
        found.forget()
    return found


def leave(model: str, end_id: int, encoder: WordEncoder) -> None:
    """Leave an encoder to later tasks of this process."""
    kept()[model, end_id] = encoder


def best_cuts(places: np.ndarray, penalties: np.ndarray, window: int = WINDOW) -> list[int]:
    """Numbers of the places at which to cut, the last place included; windows begin at the first place.

    Neighbouring places are at most ``window`` apart.
    """
    n = len(places)
    met_by, met = [], []
    for power in range(window.bit_length()):
        wanted = places - (1 << power)
        first = np.searchsorted(places, wanted)
        same = np.flatnonzero(places[first] == wanted)
        met_by.append(same)
        met.append(first[same])
    order = np.argsort(np.concatenate(met_by), kind="stable")
    met_by, met = [*np.concatenate(met_by)[order].tolist(), n], np.concatenate(met)[order].tolist()
    at, extra = places.tolist(), (penalties + CHARGE).tolist()
    # per place the least cost up to it, that plus its place, and the cut before
    cost, rank, back = [0] * n, at[:1] * n, [0] * n
    queue, h = deque([0]), 0
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - window:
            queue.popleft()
        i = queue[0]
        least = rank[i] + window - here
        while met_by[h] == j:
            if cost[met[h]] < least:
                i = met[h]
                least = cost[i]
            h += 1
        least += extra[j]
        cost[j], back[j] = least, i
        rank[j] = least = least + here
        while queue and rank[queue[-1]] >= least:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


class Packer:
    """The stream of one partition: documents in, settled pieces out."""

    def __init__(self, encoder: WordEncoder, window: int = WINDOW, horizon: int = HORIZON):
        self.encoder, self.window, self.horizon = encoder, window, horizon
        # texts as words to look up; numbers of words, how many; documents
        self.texts, self.words, self.waiting, self.doc_ids = [], [], 0, []
        # of the open stream: its first place, ids, places where it may be cut with their penalties, ends and ids of its documents
        self.begin, self.ids = 0, np.zeros(0, np.uint32)
        self.places, self.penalties = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.doc_ends, self.open_ids = np.zeros(0, np.int64), []
        self.doc_begin, self.sequences = 0, 0

    def add(self, doc_id: int | None, text: str) -> bool:
        """Add a document; true if it is time to settle."""
        self.texts += self.encoder.words(text)
        self.texts.append(None)
        self.doc_ids.append(doc_id)
        if len(self.texts) >= LOOKED_UP:
            self.look_up()
        return self.waiting >= self.horizon

    def look_up(self) -> None:
        self.words.append(self.encoder.numbers(self.texts))
        self.waiting += len(self.texts)
        self.texts = []

    def gather(self) -> None:
        """The ids and cuts of the words added."""
        words = np.concatenate(self.words)
        ids, sizes = self.encoder.ids_of(words)
        upto = np.cumsum(sizes)
        begin = self.begin + len(self.ids)
        doc_end = words == 0
        may = doc_end | (np.frombuffer(self.encoder.sentence, np.uint8)[words] > 0)
        places, penalties = upto[may] + begin, np.where(doc_end[may], 0, SENTENCE)
        # a word without ids may end where another does
        order = np.lexsort((penalties, places))
        places, first = np.unique(places[order], return_index=True)
        places, penalties = places[places > begin], penalties[order][first][places > begin]
        before = np.concatenate([[begin], places[:-1]])
        steps = (places - before - 1) // STEP
        if steps.any():
            inner = np.repeat(before, steps) + STEP * (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps) + 1)
            places, penalties = np.concatenate([places, inner]), np.concatenate([penalties, np.full(len(inner), INSIDE)])
            order = np.argsort(places, kind="stable")
            places, penalties = places[order], penalties[order]
        self.ids = np.concatenate([self.ids, ids])
        self.places, self.penalties = np.concatenate([self.places, places]), np.concatenate([self.penalties, penalties])
        self.doc_ends = np.concatenate([self.doc_ends, upto[doc_end] + begin])
        self.open_ids += self.doc_ids
        self.words, self.waiting, self.doc_ids = [], 0, []
        if self.encoder.full():
            self.encoder.forget()

    def settle(self, last: bool) -> dict[str, list]:
        """Pieces of all windows but the last two, or of all at the end of the stream."""
        if self.texts:
            self.look_up()
        if self.words:
            self.gather()
        end = self.begin + len(self.ids)
        if last and len(self.ids):
            tail = np.arange(max(self.begin + 1, end - 2 * self.window), end)
            tail = np.setdiff1d(tail, self.places, assume_unique=True)
            self.places, self.penalties = np.concatenate([self.places, tail]), np.concatenate([self.penalties, np.full(len(tail), INSIDE)])
            order = np.argsort(self.places, kind="stable")
            self.places, self.penalties = self.places[order], self.penalties[order]
        places = np.concatenate([[self.begin], self.places])
        cuts = places[best_cuts(places, np.concatenate([[0], self.penalties]), self.window)]
        return self.pieces(cuts if last else cuts[:-2])

    def pieces(self, cuts: np.ndarray) -> dict[str, list]:
        """Pieces up to the last cut; what follows stays open."""
        if not len(cuts):
            return {name: [] for name in COLUMNS}
        begins = np.unique(np.concatenate([[self.begin], cuts, self.doc_ends[self.doc_ends < cuts[-1]]]))
        begins, ends = begins[:-1], begins[1:]
        doc = np.searchsorted(self.doc_ends, begins, "right")
        doc_begins = np.concatenate([[self.doc_begin], self.doc_ends[:-1]])
        window = np.searchsorted(cuts, begins, "right")
        window_begins = np.concatenate([[self.begin], cuts])[window]
        spans = zip((begins - self.begin).tolist(), (ends - self.begin).tolist(), strict=True)
        contents = [self.ids[a:b].tobytes() for a, b in spans]
        found = {
            "doc_id": [self.open_ids[i] for i in doc.tolist()],
            "start": (begins - doc_begins[doc]).tolist(),
            "length": (ends - begins).tolist(),
            "ids_crc32": list(map(zlib.crc32, contents)),
            "doc_tokens": (self.doc_ends - doc_begins)[doc].tolist(),
            "sequence_id": (window + self.sequences).tolist(),
            "offset": (begins - window_begins).tolist(),
            "ids": contents,
        }
        cut, self.sequences = int(cuts[-1]), self.sequences + len(cuts)
        done = int(np.searchsorted(self.doc_ends, cut, "right"))
        if done:
            self.doc_begin = int(self.doc_ends[done - 1])
        self.ids, self.begin = self.ids[cut - self.begin :], cut
        later = self.places > cut
        self.places, self.penalties = self.places[later], self.penalties[later]
        self.doc_ends, self.open_ids = self.doc_ends[done:], self.open_ids[done:]
        return found


COLUMNS = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(), "ids": pa.binary(),
}


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = WINDOW, horizon: int = HORIZON, ids: bool = True) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text, anything else), one row each:

    doc_id, ``start`` and ``length`` of the piece in the document's ids (those of the text and ``end_id``),
    ``ids_crc32`` and, if asked for, the ``ids`` themselves (little-endian unsigned 32-bit integers),
    ``doc_tokens`` of the whole document, the ``sequence_id`` and the ``offset`` therein.

    The pieces of a document are neighbours in the order of sequences, and sequences hold documents in
    the order in which the partitions of ``docs`` store them; to pack in another order, sort the table
    first. Sequence ids are unique and ascend along the partitions with gaps. A null text counts as
    empty: one piece of the end id. Null and repeated ids and repeated rows are documents of their own. An empty
    table gives no piece. Only doc_id and text are read. The tokenizer must drop white space (as
    ``word_bpe_49k.json`` does); its file, whose size does not depend on the data, is broadcast.
    """
    if window & (window - 1) or window < 2 * STEP:
        raise ValueError(f"the window must be a power of two of at least {2 * STEP}")
    with open(tokenizer_path, encoding="utf-8") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kinds = {name: kind for name, kind in COLUMNS.items() if ids or name != "ids"}
    schema = pa.schema(list(kinds.items()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, packer = TaskContext.get().partitionId() << 40, None

        def settled(last: bool) -> pa.RecordBatch:
            found = packer.settle(last)
            found["sequence_id"] = [first + i for i in found["sequence_id"]]
            return pa.RecordBatch.from_pydict({name: found[name] for name in kinds}, schema=schema)

        for batch in batches:
            packer = packer or Packer(shared_encoder(model.value, end_id), window, horizon)
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if packer.add(doc_id, text):
                    yield settled(False)
        if packer is not None:
            yield settled(True)
            leave(model.value, end_id, packer.encoder)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    types = {pa.int64(): "long", pa.binary(): "binary"}
    return rows.mapInArrow(find, ", ".join(f"{name} {types[kind]}" for name, kind in kinds.items()))
