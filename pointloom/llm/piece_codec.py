"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text becomes words at each white space that follows other characters: no piece of the model has one there, so no merge crosses
and words can be merged apart (checked when the model is read). All new words of a batch lie in flat numpy arrays of symbols. In
each round every word finds its smallest pair rank by a segmented minimum, all words merge the leftmost pair of that rank at once,
and the arrays are compacted; a word ends when none of its pairs is a piece. Where no merge of the round can make a pair of the
same or a smaller rank, all its pairs of that rank merge at once, left to right, which gives the same result as one at a time.
Words keep their ids for later batches, in a store of bounded size. A word of more than SERIAL symbols whose pairs can only merge one
at a time would take a round of arrays for each: it leaves the rounds, and a heap of (rank, place) ends it with the same result.

Defined results: a null text is empty; an empty text has no ids and decodes to an empty text; texts of any length are encoded in
pieces cut between words.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
NONE = np.iinfo(np.int32).max
#: Characters encoded at once, words kept, and symbols beyond which a word that must merge one pair at a time leaves the rounds.
CHUNK, KEPT_WORDS, SERIAL = 200_000, 100_000, 64


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(wire) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """The vocabulary, the pairs of symbols that make a piece, and the texts that ids stand for."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for field, value in proto_fields(data):
            if field == 1:
                d = dict(proto_fields(value))
                pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(proto_fields(value))
            elif field == 3:
                normalizer = dict(proto_fields(value))
        kinds = [k for _, _, k in pieces]
        if trainer.get(3) != 2:
            raise ValueError("not a BPE model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only the identity normaliser with a dummy prefix and kept white space is supported")
        if {USER_DEFINED, UNUSED} & set(kinds) or any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k == NORMAL):
            raise ValueError("pieces that are user-defined, unused or hold white space after other characters are not supported")
        self.unk = kinds.index(UNKNOWN)
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.bytes = np.full(256, self.unk, np.int32)
        for i, (p, _, k) in enumerate(pieces):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.byte_fallback = BYTE in kinds
        #: Symbols: ids of pieces, then characters of pieces that are no pieces themselves, then base + code point for all others.
        self.symbols = dict(self.ids)
        for p in self.ids:
            for c in p:
                self.symbols.setdefault(c, len(pieces) + len(self.symbols) - len(self.ids))
        self.base = len(pieces) + len(self.symbols) - len(self.ids)
        self.names = {i: p for p, i in self.symbols.items()}
        order = {s: r for r, s in enumerate(sorted({s for _, s, k in pieces if k == NORMAL}, reverse=True))}
        pairs = {}
        for p, i in self.ids.items():
            for cut in range(1, len(p)):
                left, right = self.symbols.get(p[:cut]), self.symbols.get(p[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = (order[pieces[i][1]], i)
        # An open-addressing table of the pairs, at most an eighth full; `probes` is its longest search.
        self.shift = 64 - (8 * len(pairs)).bit_length()
        slots = 1 << (64 - self.shift)
        self.keys, self.ranks, self.merged = np.full(slots, -1, np.int64), np.full(slots, NONE, np.int32), np.full(slots, -1, np.int32)
        self.probes = 0
        keys = np.array(list(pairs), np.int64)
        for k, at in zip(keys.tolist(), self.slot(keys).tolist(), strict=True):
            steps = 1
            while self.keys[at] != -1:
                at, steps = (at + 1) & (slots - 1), steps + 1
            self.keys[at], (self.ranks[at], self.merged[at]) = k, pairs[k]
            self.probes = max(self.probes, steps)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in self.symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        surface = [b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, _, k in pieces]
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_n = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_n) - self.surface_n
        digits = [b"%d," % i for i in range(len(pieces))]
        self.digits = np.frombuffer(b"".join(digits), np.uint8)
        self.digits_n = np.array([len(s) for s in digits], np.int64)
        self.digits_at = np.cumsum(self.digits_n) - self.digits_n
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.starts_space = np.array([k == NORMAL and p.startswith(SPACE) for p, _, k in pieces])
        self.is_control = np.array([k == CONTROL for k in kinds])

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def pair(self, left: int, right: int) -> tuple[int, int] | None:
        """(rank, merged symbol) of one pair."""
        if left >= self.base or right >= self.base:
            return None
        key = left * self.base + right
        at = (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> self.shift
        while self.keys[at] != key:
            if self.keys[at] == -1:
                return None
            at = (at + 1) & (len(self.keys) - 1)
        return int(self.ranks[at]), int(self.merged[at])

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair makes no piece) and merged symbol of each pair."""
        key = left * self.base + right
        key[(left >= self.base) | (right >= self.base)] = -2
        at = self.slot(key)
        held = self.keys[at]
        for _ in range(self.probes - 1):
            astray = np.flatnonzero((held != key) & (held != -1))
            if not len(astray):
                break
            at[astray] = (at[astray] + 1) & (len(self.keys) - 1)
            held[astray] = self.keys[at[astray]]
        hit = held == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def merge_serial(self, symbols: list[int]) -> list[int]:
        """One pair at a time by a heap of (rank, position): the end of words that the rounds hand over."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (got := self.pair(symbols[i], symbols[j])):
                heapq.heappush(heap, (got[0], i, symbols[i], symbols[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i] = self.pair(left, right)[1]
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s, a in zip(symbols, alive, strict=True) if a]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word (each with its white space in front)."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.of_char[points].astype(np.int64)
        sym = np.where(sym < 0, self.base + points, sym)
        word = np.repeat(np.arange(len(words)), size)
        done_sym, done_word = [], []
        rank, into = self.lookup(sym, np.append(sym[1:], self.base))
        rank[np.append(word[1:] != word[:-1], True)] = NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            count = np.diff(np.append(first, len(word)))
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == NONE, count)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, into = sym[~over], word[~over], rank[~over], into[~over]
                continue
            n = len(sym)
            least = np.repeat(best, count)
            hit = rank == least
            # Leftmost first: in a run of neighbouring hits every second one, from the first, can merge.
            at = np.flatnonzero(hit)
            run_start = np.append(True, (at[1:] != at[:-1] + 1))
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            if not lead.all():
                # Would a merge make a pair that must go before the others? Its left neighbour may have merged, its right one not yet.
                new = into[at]
                joined_left = np.append(False, (at[1:] == at[:-1] + 2) & ~lead[1:])
                left = np.where(joined_left, np.append(0, new[:-1]), sym[np.maximum(at - 1, 0)])
                has_left = (at > 0) & (word[np.maximum(at - 1, 0)] == word[at])
                right_at = np.minimum(at + 2, n - 1)
                has_right = (at + 2 < n) & (word[right_at] == word[at])
                low = least[at]
                bad = (has_left & (self.lookup(left, new)[0] <= low)) | (has_right & (self.lookup(new, sym[right_at])[0] <= low))
                if bad.any():
                    slow = np.unique(word[at[bad]])
                    long = slow[size[slow] > SERIAL]
                    if len(long):
                        for w in long.tolist():
                            lo, hi = np.searchsorted(word, [w, w + 1])
                            out = self.merge_serial(sym[lo:hi].tolist())
                            done_sym.append(np.array(out, np.int64))
                            done_word.append(np.full(len(out), w))
                        stay = ~np.isin(word, long)
                        sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
                        continue
                    at = at[lead | ~np.isin(word[at], slow)]
            sym[at] = into[at]
            stay = np.ones(n, bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            at = place[at]
            sym, word, rank, into = sym[stay], word[stay], rank[stay], into[stay]
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[np.maximum(at - 1, 0)] = True
            fresh = np.flatnonzero(touched)
            nxt = np.minimum(fresh + 1, len(sym) - 1)
            r, m = self.lookup(sym[fresh], sym[nxt])
            r[(nxt == fresh) | (word[nxt] != word[fresh])] = NONE
            rank[fresh], into[fresh] = r, m
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return self.to_ids(sym[order], word[order], len(words))

    def to_ids(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols to ids: those that are no pieces become byte pieces, or the unknown one."""
        width = np.ones(len(sym), np.int64)
        foreign = np.flatnonzero(sym >= len(self.surface_n))
        texts = [(self.names[s] if s < self.base else chr(s - self.base)).encode() for s in sym[foreign].tolist()]
        if self.byte_fallback:
            width[foreign] = [len(t) for t in texts]
        ids = np.repeat(sym, width)
        start = np.cumsum(width) - width
        for i, t in zip(foreign.tolist(), texts, strict=True):
            ids[start[i] : start[i] + width[i]] = self.bytes[list(t)] if self.byte_fallback else self.unk
        return ids.astype(np.int32), np.bincount(word, weights=width, minlength=n_words).astype(np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0]+size[0]-1, start[1] .. , as one flat index."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


WORD = re.compile(" *[^ ]+| +")
CUT = re.compile("(?<=[^ ])(?= )")


class Codec:
    """Encoder and decoder of batches, with a store of the words that it has merged."""

    def __init__(self, data: bytes):
        self.model = PieceModel(data)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.flat, self.start, self.size, self.used = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self) -> None:
        """Make room: only words met more than once since the last time stay, or none if those are many."""
        stay = np.flatnonzero(self.used > 1)
        if len(stay) > KEPT_WORDS // 2:
            return self.clear()
        words = list(self.slots)
        self.slots = {words[k]: i for i, k in enumerate(stay.tolist())}
        self.flat = self.flat[ranges(self.start[stay], self.size[stay])]
        self.size = self.size[stay]
        self.start = np.cumsum(self.size) - self.size
        self.used = np.zeros(len(stay), np.int64)

    def learn(self, words: list[str]) -> None:
        ids, size = self.model.merge_words([SPACE + w.replace(" ", SPACE) for w in words])
        self.slots.update(zip(words, range(len(self.slots), len(self.slots) + len(words)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, ids])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int64)])

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each word; a word here is without its first white space."""
        if len(self.slots) > KEPT_WORDS:
            self.forget()
        missing = [w for w in dict.fromkeys(words) if w not in self.slots]
        if missing:
            self.learn(missing)
        slot = np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words))
        self.used += np.bincount(slot, minlength=len(self.used))
        size = self.size[slot]
        return self.flat[ranges(self.start[slot], size)], size

    @staticmethod
    def words(text: str) -> list[str]:
        text = text.replace(SPACE, " ")
        return text.split(" ") if text[0] != " " and "  " not in text and text[-1] != " " else [w[1:] for w in WORD.findall(" " + text)]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, as the library gives them without begin or end ids."""
        out: list[np.ndarray] = []
        held: list[str] = []
        counts: list[int] = []

        def flush() -> None:
            if counts:
                ids, size = self.encode_words(held)
                ends = np.append(0, np.cumsum(size))[np.cumsum(counts)]
                out.extend(np.split(ids, ends[:-1]))
                held.clear()
                counts.clear()

        chars = 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK:
                flush()
                chars = 0
                out.append(self.encode_long(text))
                continue
            words = self.words(text) if text else []
            held += words
            counts.append(len(words))
            chars += len(text)
            if chars > CHUNK:
                flush()
                chars = 0
        flush()
        return out

    def encode_long(self, text: str) -> np.ndarray:
        parts, words, chars = [], [], 0
        for m in WORD.finditer(" " + text.replace(SPACE, " ")):
            words.append(m.group()[1:])
            chars += len(words[-1]) + 1
            if chars > CHUNK:
                parts.append(self.encode_words(words)[0])
                words, chars = [], 0
        if words:
            parts.append(self.encode_words(words)[0])
        return np.concatenate(parts)

    def decode(self, texts: list[np.ndarray]) -> list[str]:
        """The text of each list of ids. The first white space of a text is the dummy prefix and goes; a byte that is no part of valid UTF-8 becomes U+FFFD."""
        m = self.model
        out = []
        for ids in texts:
            ids = np.asarray(ids, np.int64)
            raw = m.surface[ranges(m.surface_at[ids], m.surface_n[ids])].tobytes()
            lead = int(np.argmin(m.is_control[ids])) if len(ids) else 0
            if len(ids) and m.starts_space[ids[lead]]:
                raw = raw[1:]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(decode_bytewise(raw))
        return out

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        m = self.model
        return m.digits[ranges(m.digits_at[ids], m.digits_n[ids])].tobytes()[:-1]


def decode_bytewise(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is no part of a valid character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """This process's codec of a model; the tables are built once for each Python worker."""
    name = hashlib.sha256(data).hexdigest()
    if name not in _codecs:
        _codecs[name] = Codec(data)
    return _codecs[name]


def slices(texts: pd.Series, most: int = 2 * CHUNK) -> Iterator[slice]:
    """Row ranges whose texts hold about `most` characters at most, or one row."""
    begin = chars = 0
    for i, n in enumerate(texts.str.len().fillna(0).tolist()):
        if chars and chars + n > most:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += n
    if begin < len(texts):
        yield slice(begin, len(texts))


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; it travels with the tasks: half a megabyte, whatever the corpus."""
    with open(path, "rb") as f:
        return f.read()


def encode_column(text: Column, model_path: str) -> Column:
    """The ids of a text."""
    data = model_bytes(model_path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pd.Series) -> pd.Series:
        codec = codec_of(data)
        return pd.Series([ids for part in slices(texts) for ids in codec.encode(texts.iloc[part].tolist())])

    return run(text)


def decode_column(ids: Column, model_path: str) -> Column:
    """The text that ids stand for; null ids give an empty text."""
    data = model_bytes(model_path)

    @F.pandas_udf(T.StringType())
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series(codec_of(data).decode([[] if x is None else x for x in rows]))

    return run(ids)


def round_trip(text: Column, model_path: str, with_ids: bool = False) -> Column:
    """struct(n_tokens, ids_sha256, decoded_sha256[, ids]): encode, then decode the ids; a text is encoded once for all of them."""
    data = model_bytes(model_path)
    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), ("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields[: 3 + with_ids]])
    sha = lambda b: hashlib.sha256(b).hexdigest()

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        codec = codec_of(data)
        rows = []
        for part in slices(texts):
            ids = codec.encode(texts.iloc[part].tolist())
            rows += [(len(i), sha(codec.decimal(i)), sha(t.encode()), i)[: 3 + with_ids] for i, t in zip(ids, codec.decode(ids), strict=True)]
        return pd.DataFrame(rows, columns=schema.names)

    return run(text)
