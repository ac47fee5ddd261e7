"""Packing of tokenised documents into sequences of at most `capacity` tokens, by harmonic classes.

The classes are the reciprocals of the capacity: class k takes pieces of capacity // k tokens, and a sequence of class k holds k of
them. Documents may be cut, so each is cut into pieces that fit their classes exactly: the longest class that the rest fills, again and
again, down to the class of single tokens. A class is used only if its full sequence lacks at most `slack` tokens of the capacity, so
`slack` trades cuts for padding: 0 leaves the powers of two (of a capacity that is one) and no padding, 4 of 1024 tokens pads at most
0.4 % and cuts about half as often. Each worker fills the sequences of each class by itself, in the order of its documents, and no row is shuffled. What
a worker has left in the end, at most one open sequence a class, is joined and cut again into full sequences; the last of those is cut at powers
of two, which need no padding.

Tokens are the ids of a `tokenizers` file followed by one end id. Texts are split into the tokenizer's words here and each different word
is encoded by the library's model once in a while (a bounded cache of CACHED words a worker process, which its tasks share); texts with other characters than those below
U+0530 and common punctuation, or with one of the file's added tokens, go to the library whole. Both give the same ids.

A worker holds the batch at hand, the cache and the open sequences (less than `capacity` tokens a class). Sequences are numbered by
partition (its number times 2^40, plus a count), so a task that is run again gives the same rows; another division of the input into
partitions packs differently.

Defined results: a null text is empty; an empty text is its end id; repeated rows, rows with one id and rows with a null id are
packed each for itself; ids may be of any type; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words of the cache of one worker; longer words than LONGEST aren't kept.
CACHED, LONGEST = 800_000, 64
FLUSH = 20_000


def _char_class(kind: str) -> str:
    """The characters below U+0530 of a general category (its first letter), for a character set of a pattern."""
    return "".join(re.escape(chr(c)) for c in range(0x530) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _NUMBERS, _SPACES = _char_class("L"), _char_class("N"), r"\t-\r \x85\xa0"
#: The word pattern of byte-level BPE.
WORDS = re.compile(f" ?[{_LETTERS}]+| ?[{_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_SPACES}{_LETTERS}{_NUMBERS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")
FOREIGN = re.compile("[^\x00-ԯ‐-‧‰-⁞₠-₿]")


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*plain}))}


class Encoder:
    """encode(texts): each text's ids as little-endian unsigned 32-bit integers, as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.letters = self.library.model, _byte_letters()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cache: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        own = [not FOREIGN.search(t) and not any(a in t for a in self.added) for t in texts]
        words = [WORDS.findall(t) if mine else [] for t, mine in zip(texts, own, strict=True)]
        new = list(set(chain.from_iterable(words)).difference(self.cache))
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(set(chain.from_iterable(words)))
        self.cache.update(zip(new, map(self._word, new), strict=True))
        whole = iter(self._library([t for t, mine in zip(texts, own, strict=True) if not mine]))
        ids = [b"".join(map(self.cache.__getitem__, w)) if mine else next(whole) for w, mine in zip(words, own, strict=True)]
        for w in new:
            if len(w) > LONGEST:
                del self.cache[w]
        return ids


@cache
def encoder_of(path: str) -> Encoder:
    """The worker process's encoder."""
    return Encoder(path)


def classes(capacity: int, slack: int) -> list[tuple[int, int]]:
    """(tokens of a piece, pieces of a sequence), longest pieces first, of the reciprocal classes that lack at most `slack` tokens."""
    if capacity < 1 or slack < 0:
        raise ValueError("capacity must be positive and slack not negative")
    most = {capacity // k: k for k in range(1, capacity + 1)}  # of classes with equal pieces the one with most
    return [(size, k) for size, k in sorted(most.items(), reverse=True) if capacity - k * size <= slack or size == 1]


class Packer:
    """Rows (doc, start, length, crc, doc tokens, sequence, offset) of one worker's documents. A piece is (doc, start, its ids as bytes, doc tokens)."""

    def __init__(self, capacity: int, slack: int, first: int = 0):
        self.capacity, self.kinds, self.next = capacity, classes(capacity, slack), first
        self.per = dict(self.kinds)
        self.open: dict[int, list[tuple]] = {size: [] for size in self.per}
        #: The longest class that a rest fills, by the rest.
        self.fits = [0] * (capacity + 1)
        for size, _ in reversed(self.kinds):
            self.fits[size:] = [size] * (capacity + 1 - size)

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        at, rows = 0, []
        for doc, start, data, total in pieces:
            rows.append((doc, start, len(data) // 4, zlib.crc32(data), total, self.next, at))
            at += len(data) // 4
        self.next += 1
        return rows

    def add(self, doc, data: bytes) -> list[tuple]:
        """The rows of the sequences that this document fills."""
        total, at, rows = len(data) // 4, 0, []
        while at < total:
            size = self.fits[min(total - at, self.capacity)]
            held = self.open[size]
            held.append((doc, at, data[4 * at : 4 * (at + size)], total))
            at += size
            if len(held) == self.per[size]:
                rows += self._close(held)
                held.clear()
        return rows

    def finish(self) -> list[tuple]:
        """What is left, joined: full sequences, then sequences of powers of two."""
        rest = [p for size, _ in self.kinds for p in self.open[size]]
        left, rows, held, need = sum(len(p[2]) // 4 for p in rest), [], [], 0
        for doc, start, data, total in rest:
            at = 0
            while at < len(data):
                if not need:
                    need = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
                    left -= need
                part = data[at : at + 4 * need]
                held.append((doc, start + at // 4, part, total))
                at += len(part)
                need -= len(part) // 4
                if not need:
                    rows += self._close(held)
                    held = []
        for size in self.open:
            self.open[size] = []
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, slack: int = 4, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: the id, start (ids of its document before it), length, ids_crc32 (unsigned, of the ids as little-endian unsigned
    32-bit integers), doc_tokens (the end id included), sequence_id, offset (in the sequence, without gaps from 0)."""
    kind = docs.schema[id_col].dataType
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([T.StructField(id_col, kind), *longs])
    classes(capacity, slack)
    end = np.array([end_id], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = encoder_of(tokenizer)
        packer = Packer(capacity, slack, TaskContext.get().partitionId() << 40)
        id_type, rows = None, []

        def table() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type)] + [pa.array(c, pa.int64()) for c in columns[1:]], names=schema.names)

        for batch in batches:
            id_type = batch.column(0).type
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                rows += packer.add(doc, ids + end)
                if len(rows) >= FLUSH:
                    yield table()
                    rows = []
        rows += packer.finish()
        if rows:
            yield table()

    return docs.select(id_col, text_col).mapInArrow(work, schema)
