r"""Secret scans by one combined deterministic automaton.

The rules' regular expressions over bytes become position automata; subset construction over all of them at once, with every byte
as a possible start, and Moore minimisation give one table of transitions, so all rules are scanned in a single byte pass: the texts of
a batch are cut at bytes that no rule has (no match holds one), and all pieces step through the table together, as arrays, longest
first. The pass tells in which pieces which rules match. Those few pieces are resolved rule by rule: a backward pass of the rule's
reversed automaton marks where matches can start, and from the leftmost start its anchored automaton takes the longest match; the next
starts where it ended.

Base kinds (assign, access, hex) follow the contract's patterns; the other rules only add spans. Syntax of rules: literals, classes,
groups, (?i:...), alternatives and * + ? {m,n}; bytes, ASCII only.

Defined results: null and empty texts have no spans; texts of any length take one step for each byte; spans count code points and
end exclusively; repeated rows and null ids pass through; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Pieces from which on they step together; fewer go one by one, which costs less than a step of arrays for each byte.
LANES = 48


@dataclass(frozen=True)
class Rule:
    """A match is `head` then `value` (which may be empty); it counts from so many bytes of the value, or of the whole."""

    kind: str
    head: str
    value: str = ""
    least_value: int = 0
    least: int = 0


# The base patterns of the contract, then formats that providers publish for their tokens.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", least_value=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Positions:
    """Position automata of several expressions: a byte set for each position, and which positions may follow which."""

    def __init__(self):
        self.sets: list[int] = []
        self.follow: list[int] = []

    def add(self, regex: str) -> tuple[bool, int, int]:
        """(matches the empty string, first positions, last positions) of an expression; positions are bits."""
        self.text, self.at, self.fold = regex, 0, False
        out = self.build(self.alternatives())
        if self.at != len(regex):
            raise ValueError(f"unexpected {regex[self.at]!r} at {self.at} of {regex!r}")
        return out

    # Parsing, into ("set", bits), ("cat", parts), ("alt", parts), ("rep", node, least, most or None).
    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self) -> str:
        self.at += 1
        return self.text[self.at - 1]

    def alternatives(self) -> tuple:
        parts = [self.sequence()]
        while self.peek() == "|":
            self.take()
            parts.append(self.sequence())
        return ("alt", parts) if len(parts) > 1 else parts[0]

    def sequence(self) -> tuple:
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.quantified())
        return ("cat", parts)

    def quantified(self) -> tuple:
        node = self.atom()
        while self.peek() and self.peek() in "*+?{":
            c = self.take()
            if c == "{":
                end = self.text.index("}", self.at)
                low, _, high = self.text[self.at : end].partition(",")
                most = int(high) if high else None if "," in self.text[self.at : end] else int(low)
                self.at = end + 1
                node = ("rep", node, int(low), most)
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            before = self.fold
            if self.text.startswith("?i:", self.at):
                self.at, self.fold = self.at + 3, True
            elif self.text.startswith("?:", self.at):
                self.at += 2
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.text!r}")
            self.take()
            self.fold = before
            return node
        if c == "[":
            return ("set", self.byte_class())
        if c == ".":
            return ("set", ((1 << 256) - 1) & ~(1 << 10))
        return ("set", self.folded(1 << (self.escaped() if c == "\\" else ord(c))))

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.at += 2
            return int(self.text[self.at - 2 : self.at], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def byte_class(self) -> int:
        negated = self.peek() == "^"
        self.at += negated
        bits = 0
        while self.peek() != "]":
            c = self.take()
            low = high = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                c = self.take()
                high = self.escaped() if c == "\\" else ord(c)
            for b in range(low, high + 1):
                bits |= 1 << b
        self.take()
        return ((1 << 256) - 1) & ~bits if negated else self.folded(bits)

    def folded(self, bits: int) -> int:
        if self.fold:
            for b in range(65, 91):
                if bits >> b & 1 or bits >> (b + 32) & 1:
                    bits |= 1 << b | 1 << (b + 32)
        return bits

    def link(self, last: int, first: int) -> None:
        for p in ones(last):
            self.follow[p] |= first

    def build(self, node: tuple) -> tuple[bool, int, int]:
        kind = node[0]
        if kind == "set":
            self.sets.append(node[1])
            self.follow.append(0)
            bit = 1 << (len(self.sets) - 1)
            return False, bit, bit
        if kind == "alt":
            built = [self.build(n) for n in node[1]]
            return any(b[0] for b in built), join(b[1] for b in built), join(b[2] for b in built)
        if kind == "cat":
            return self.chained([self.build(n) for n in node[1]])
        _, inner, least, most = node
        copies = [self.build(inner) for _ in range(max(least, 1) if most is None else most)]
        if most is None:
            self.link(copies[-1][2], copies[-1][1])
        return self.chained([(e or k >= least, f, z) for k, (e, f, z) in enumerate(copies)])

    def chained(self, parts: list[tuple[bool, int, int]]) -> tuple[bool, int, int]:
        empty, first, last = True, 0, 0
        for e, f, z in parts:
            self.link(last, f)
            first |= f if empty else 0
            last = z | (last if e else 0)
            empty = empty and e
        return empty, first, last


def ones(bits: int) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(low.bit_length() - 1)
        bits ^= low
    return out


def join(masks) -> int:
    out = 0
    for m in masks:
        out |= m
    return out


@dataclass
class Automaton:
    """moves[state][byte] -> state; accepts[state]: bits of the rules of which a match ends there. State 0 is the start."""

    moves: list[list[int]]
    accepts: list[int]
    dead: int


def automaton(sets: list[int], follow: list[int], first: int, lasts: list[int], anchored: bool) -> Automaton:
    """Subset construction and minimisation. anchored: matches start at the first byte only."""
    signature: dict[int, int] = {}
    classes = [signature.setdefault(join((s >> b & 1) << p for p, s in enumerate(sets)), len(signature)) for b in range(256)]
    allowed = list(signature)
    START = -1
    number, queue, table = {START: 0}, [START], []
    for state in queue:
        after = first if state == START else join(follow[p] for p in ones(state)) | (0 if anchored else first)
        row = []
        for mask in allowed:
            new = after & mask
            if new not in number:
                number[new] = len(queue)
                queue.append(new)
            row.append(number[new])
        table.append(row)
    moves = np.array(table)
    accepts = np.array([0 if s == START else sum((s & last != 0) << k for k, last in enumerate(lasts)) for s in queue])
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[moves]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    # Number the groups by their first state, so that the start is 0.
    firsts = np.full(group.max() + 1, len(group))
    np.minimum.at(firsts, group, np.arange(len(group)))
    order = np.argsort(firsts)
    renamed = np.empty(len(order), int)
    renamed[order] = np.arange(len(order))
    least = firsts[order]
    small = renamed[group[moves[least]]][:, classes]
    dead = number.get(0)
    return Automaton(small.tolist(), accepts[least].tolist(), int(renamed[group[dead]]) if dead is not None and anchored else -1)


def reverse_links(follow: list[int]) -> list[int]:
    out = [0] * len(follow)
    for p, mask in enumerate(follow):
        for q in ones(mask):
            out[q] |= 1 << p
    return out


def shortest_match(machine: Automaton) -> int:
    """Bytes of the shortest match of any rule: steps from the start to a state that accepts."""
    seen, front, steps = {0}, {0}, 0
    while front and not any(machine.accepts[s] for s in front):
        front = {n for s in front for n in machine.moves[s]} - seen
        seen |= front
        steps += 1
    return steps


class Scanner:
    """All rules' automata: one for the pass over all, and for each rule the two that find its spans."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        p = Positions()
        parts = [p.add(r.head + r.value) for r in rules]
        if any(e for e, _, _ in parts):
            raise ValueError("a rule matches the empty string")
        self.all = automaton(p.sets, p.follow, join(f for _, f, _ in parts), [z for _, _, z in parts], anchored=False)
        self.table, self.ending = np.array(self.all.moves, np.int32), np.array(self.all.accepts, np.int64)
        known = join(p.sets)
        self.apart = np.array([not known >> b & 1 for b in range(256)])
        self.shortest = shortest_match(self.all)
        self.forward, self.backward, self.head = [], [], []
        for r in rules:
            p = Positions()
            _, first, last = p.add(r.head + r.value)
            self.forward.append(automaton(p.sets, p.follow, first, [last], anchored=True))
            self.backward.append(automaton(p.sets, reverse_links(p.follow), last, [first], anchored=False))
            p = Positions()
            _, first, last = p.add(r.head)
            self.head.append(automaton(p.sets, p.follow, first, [last], anchored=True))

    def hits(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bits of the rules that match in each piece of the data: one pass over its bytes, all pieces of a length together."""
        order = np.argsort(-size, kind="stable")
        at, size = start[order], size[order]
        state, found = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1 if len(size) else 1), side="right").tolist()
        step = 0
        while step < len(live) and live[step] >= LANES:
            n = live[step]
            state[:n] = now = self.table[state[:n], data[at[:n] + step]]
            found[:n] |= self.ending[now]
            step += 1
        moves, accepts = self.all.moves, self.all.accepts
        for k in range(live[step] if step < len(live) else 0):  # few long pieces: each by itself
            now, bits = int(state[k]), int(found[k])
            for b in data[at[k] + step : at[k] + size[k]].tolist():
                now = moves[now][b]
                bits |= accepts[now]
            found[k] = bits
        out = np.empty_like(found)
        out[order] = found
        return out

    @staticmethod
    def longest(machine: Automaton, data: bytes, start: int) -> int:
        state, end = 0, -1
        for i in range(start, len(data)):
            state = machine.moves[state][data[i]]
            if state == machine.dead:
                break
            if machine.accepts[state]:
                end = i + 1
        return end

    def resolved(self, data: bytes, k: int) -> list[tuple[int, int]]:
        """(start, end) of a rule's matches: leftmost, longest, not overlapping."""
        moves, accepts, state = self.backward[k].moves, self.backward[k].accepts, 0
        starts = []
        for i in range(len(data) - 1, -1, -1):
            state = moves[state][data[i]]
            if accepts[state]:
                starts.append(i)
        out = []
        rule, done = self.rules[k], 0
        for start in reversed(starts):
            if start < done:
                continue
            done = self.longest(self.forward[k], data, start)
            value = done - self.longest(self.head[k], data, start) if rule.value else 0
            if value >= rule.least_value and done - start >= rule.least:
                out.append((start, done))
        return out

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule, end) in bytes, in order of start, then rule."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        apart = self.apart[data]
        edges = np.zeros(len(data) + 1, bool)
        edges[0] = edges[ends] = True
        edges[:-1] |= apart
        edges[1:] |= apart
        edge = np.flatnonzero(edges)
        start, size = edge[:-1], np.diff(edge)
        long = size >= self.shortest
        start, size = start[long], size[long]
        bits = self.hits(data, start, size)
        for p in np.flatnonzero(bits).tolist():
            s = int(start[p])
            text = int(np.searchsorted(ends, s, side="right"))
            begin = int(ends[text]) - len(texts[text])
            piece = data[s : s + int(size[p])].tobytes()
            out[text] += [(s - begin + i, k, s - begin + j) for k in ones(int(bits[p])) for i, j in self.resolved(piece, k)]
        return [sorted(x) for x in out]

    def text_spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """For each text (kind, start, end) in code points."""
        data = [(t or "").encode() for t in texts]
        out = []
        for text, raw, found in zip(texts, data, self.spans(data), strict=True):
            if found and len(raw) != len(text):
                before = np.cumsum(np.append(0, (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
                found = [(int(before[s]), k, int(before[e])) for s, k, e in found]
            out.append([(self.rules[k].kind, s, e) for s, k, e in found])
        return out


BASE_KINDS = ("assign", "access", "hex")
_scanner: Scanner | None = None


def scanner() -> Scanner:
    """This process's scanner of RULES; the tables are built once for each Python worker."""
    global _scanner
    _scanner = _scanner or Scanner()
    return _scanner


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(text: Column) -> Column:
    """array<struct<kind, start, end>> of a text, by start, then kind in the order of RULES."""

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        found = scanner().text_spans(texts.tolist())
        return pd.Series([[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in found])

    return run(text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs, id_col: str = "doc_id", text_col: str = "text"):
    found = docs.select(id_col, find_secrets(F.col(text_col)).alias("s"))
    base = F.filter("s", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(id_col, *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("s")).alias("spans"))
