"""Compressed point records: adaptive arithmetic coding of LAS records in chunks, after the public LASzip format.

Point formats 0 to 3 are coded point by point (items of version 2), formats 6 to 8 in layers, one for each group of attributes (items of version 3);
extra bytes are coded in both. Chunks don't depend on each other. The rules of a record are written once: an Encoder's methods take a value and return
it, a Decoder's ignore the argument and return what they read. No Spark in here.

Not coded here: wave packets (formats 4, 5, 9, 10), the older item versions, and in formats 6 to 8 a return number beyond the number of returns
or 0 (but for 0 of 0); those raise.
"""

from __future__ import annotations

import struct
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import numpy as np

CHUNK_SIZE = 50_000
VLR_USER, VLR_RECORD = "laszip encoded", 22204
# Fixed values of the format: item types, and the compressors of points one by one and in layers.
BYTE, POINT10, GPSTIME11, RGB12, POINT14, RGB14, RGBNIR14, BYTE14 = 0, 6, 7, 8, 10, 11, 12, 14
POINTWISE, LAYERED = 2, 3
# Fixed values of the arithmetic coder: least interval, bits of probabilities of bits and of symbols.
LEAST, BIT_SHIFT, SYMBOL_SHIFT = 1 << 24, 13, 15
WORD = 0xFFFFFFFF
# The context of a point by its number of returns and its return, point formats 0 to 3.
RETURN_CONTEXT = (
    (15, 14, 13, 12, 11, 10, 9, 8),
    (14, 0, 1, 3, 6, 10, 10, 9),
    (13, 1, 2, 4, 7, 11, 11, 10),
    (12, 3, 4, 5, 8, 12, 12, 11),
    (11, 6, 7, 8, 9, 13, 13, 12),
    (10, 10, 11, 12, 13, 14, 14, 13),
    (9, 10, 11, 12, 13, 14, 15, 14),
    (8, 9, 10, 11, 12, 13, 14, 15),
)
# Multiples of the last time step that have a symbol of their own.
MULTI, MULTI_LOW = 500, -10


class BitModel:
    __slots__ = ("zeros", "total", "prob", "cycle", "left")

    def __init__(self):
        self.zeros, self.total, self.prob, self.cycle, self.left = 1, 2, 1 << (BIT_SHIFT - 1), 4, 4

    def update(self) -> None:
        self.total += self.cycle
        if self.total > 1 << BIT_SHIFT:
            self.total, self.zeros = (self.total + 1) >> 1, (self.zeros + 1) >> 1
            self.total += self.zeros == self.total
        self.prob = (0x80000000 // self.total * self.zeros) >> (31 - BIT_SHIFT)
        self.cycle = self.left = min(5 * self.cycle >> 2, 64)


class Model:
    """Adaptive probabilities of symbols 0 to n - 1: low[s] is the share of smaller symbols in 2^15ths."""

    __slots__ = ("counts", "low", "total", "cycle", "left")

    def __init__(self, n: int):
        self.counts, self.total, self.cycle = [1] * n, 0, n
        self.update()
        self.cycle = self.left = (n + 6) >> 1

    def update(self) -> None:
        counts = self.counts
        self.total += self.cycle
        if self.total > 1 << SYMBOL_SHIFT:
            self.counts = counts = [(c + 1) >> 1 for c in counts]
            self.total = sum(counts)
        scale, below, low = 0x80000000 // self.total, 0, []
        for c in counts:
            low.append((scale * below) >> (31 - SYMBOL_SHIFT))
            below += c
        self.low = low
        self.cycle = self.left = min(5 * self.cycle >> 2, (len(counts) + 6) << 3)


class Integers:
    """The models of numbers of some bits that are coded as corrections of a prediction, in contexts."""

    HIGH = 8

    def __init__(self, bits: int, contexts: int = 1):
        self.bits, self.k = bits, 0
        self.sizes = [Model(bits + 1) for _ in range(contexts)]
        self.bit = BitModel()
        self.parts = [None] + [Model(1 << min(k, self.HIGH)) for k in range(1, bits + 1)]


def signed(v: int, bits: int = 32) -> int:
    return ((v + (1 << (bits - 1))) & ((1 << bits) - 1)) - (1 << (bits - 1))


class Encoder:
    writes = True

    def __init__(self):
        self.out, self.base, self.length = bytearray(), 0, WORD

    def _narrow(self, low: int, length: int) -> None:
        base = self.base + low
        if base > WORD:
            base &= WORD
            i = len(self.out) - 1
            while self.out[i] == 255:
                self.out[i] = 0
                i -= 1
            self.out[i] += 1
        while length < LEAST:
            self.out.append(base >> 24)
            base = base << 8 & WORD
            length <<= 8
        self.base, self.length = base, length

    def bit(self, m: BitModel, v: int) -> int:
        x = m.prob * (self.length >> BIT_SHIFT)
        if v:
            self._narrow(x, self.length - x)
        else:
            m.zeros += 1
            self._narrow(0, x)
        m.left -= 1
        if not m.left:
            m.update()
        return v

    def symbol(self, m: Model, v: int) -> int:
        unit = self.length >> SYMBOL_SHIFT
        x = m.low[v] * unit
        self._narrow(x, (m.low[v + 1] * unit if v + 1 < len(m.low) else self.length) - x)
        m.counts[v] += 1
        m.left -= 1
        if not m.left:
            m.update()
        return v

    def raw(self, bits: int, v: int) -> int:
        if bits > 19:
            self.raw(16, v & 0xFFFF)
            self.raw(bits - 16, v >> 16)
        else:
            unit = self.length >> bits
            self._narrow(v * unit, unit)
        return v

    def integer(self, ic: Integers, near: int, v: int, context: int = 0) -> int:
        """v, a number of ic's bits, near a prediction; ic.k is then the number of bits of the correction."""
        c = signed(v - near, ic.bits)
        ic.k = k = (-c if c <= 0 else c - 1).bit_length()
        self.symbol(ic.sizes[context], k)
        if not k:
            self.bit(ic.bit, c)
        elif k < 32:
            c = c + (1 << k) - 1 if c < 0 else c - 1
            more = max(0, k - ic.HIGH)
            self.symbol(ic.parts[k], c >> more)
            if more:
                self.raw(more, c & ((1 << more) - 1))
        return v

    def finish(self) -> bytes:
        wide = self.length > 2 * LEAST
        self._narrow(LEAST if wide else LEAST >> 1, LEAST >> 1 if wide else LEAST >> 9)
        return bytes(self.out) + bytes(3 if wide else 2)


class Decoder:
    writes = False

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at, self.length = data, at + 4, WORD
        self.value = int.from_bytes(data[at : at + 4].ljust(4, b"\0"), "big")

    def _narrow(self, low: int, length: int) -> None:
        value = self.value - low
        while length < LEAST:
            value = value << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            length <<= 8
        self.value, self.length = value, length

    def bit(self, m: BitModel, _: int = 0) -> int:
        x = m.prob * (self.length >> BIT_SHIFT)
        v = int(self.value >= x)
        if v:
            self._narrow(x, self.length - x)
        else:
            m.zeros += 1
            self._narrow(0, x)
        m.left -= 1
        if not m.left:
            m.update()
        return v

    def symbol(self, m: Model, _: int = 0) -> int:
        unit = self.length >> SYMBOL_SHIFT
        low = m.low
        v = bisect_right(low, self.value // unit) - 1
        x = low[v] * unit
        self._narrow(x, (low[v + 1] * unit if v + 1 < len(low) else self.length) - x)
        m.counts[v] += 1
        m.left -= 1
        if not m.left:
            m.update()
        return v

    def raw(self, bits: int, _: int = 0) -> int:
        if bits > 19:
            small = self.raw(16)
            return self.raw(bits - 16) << 16 | small
        unit = self.length >> bits
        v = self.value // unit
        self._narrow(v * unit, unit)
        return v

    def integer(self, ic: Integers, near: int, _: int = 0, context: int = 0) -> int:
        ic.k = k = self.symbol(ic.sizes[context])
        if not k:
            c = self.bit(ic.bit)
        elif k < 32:
            more = max(0, k - ic.HIGH)
            c = self.symbol(ic.parts[k])
            if more:
                c = c << more | self.raw(more)
            c = c + 1 if c >= 1 << (k - 1) else c - (1 << k) + 1
        else:
            c = -(1 << 31)
        return signed(near + c) if ic.bits == 32 else near + c & ((1 << ic.bits) - 1)


class Median:
    """The middle of the last five differences, kept sorted; high and low values leave by turns."""

    __slots__ = ("values", "high")

    def __init__(self):
        self.values, self.high = [0] * 5, True

    def add(self, v: int) -> None:
        s, middle = self.values, self.values[2]
        if self.high:
            s.pop()
            self.high = v < middle
        else:
            s.pop(0)
            self.high = not middle < v
        at = bisect_right(s, v)
        s.insert(at, v)


class Times:
    """GPS times as their 64 bits: multiples of the last step, in four sequences. `same`: whether a symbol says that the time is unchanged."""

    def __init__(self, first: int, same: bool):
        self.same = int(same)
        self.full = MULTI - MULTI_LOW + 1 + self.same
        self.multi, self.none = Model(self.full + 4), Model(5 + self.same)
        self.steps, self.last, self.next = Integers(32, 9), 0, 0
        self.time, self.step, self.extreme = [first, 0, 0, 0], [0] * 4, [0] * 4

    def _new(self, coder, v: int) -> int:
        high = coder.integer(self.steps, signed(self.time[self.last] >> 32), signed(v >> 32), 8)
        low = coder.raw(32, v & WORD)
        self.last = self.next = (self.next + 1) & 3
        self.time[self.last], self.step[self.last], self.extreme[self.last] = high << 32 | low, 0, 0
        return self.time[self.last]

    def _kind(self, v: int, by_step: bool) -> int:
        """The symbol for a time, chosen by the encoder: how it follows from the last one, another sequence, or none."""
        fits = lambda i: -(1 << 31) <= v - self.time[(self.last + i) & 3] < 1 << 31
        full = self.full if by_step else 1 + self.same
        if self.same and v == self.time[self.last]:
            return self.full - 1 if by_step else 0
        if not fits(0):
            return next((full + i for i in (1, 2, 3) if fits(i)), full)
        if not by_step:
            return self.same
        ratio = float(np.float32(v - self.time[self.last]) / np.float32(self.step[self.last]))
        multi = int(ratio + 0.5) if ratio >= 0 else int(ratio - 0.5)
        return min(multi, MULTI) if multi >= 0 else MULTI - max(multi, MULTI_LOW)

    def code(self, coder, v: int) -> int:
        at = self.last
        step, by_step = self.step[at], self.step[at] != 0
        kind = coder.symbol(self.multi if by_step else self.none, self._kind(v, by_step) if coder.writes else 0)
        full = self.full if by_step else 1 + self.same
        if kind > full:
            self.last = (at + kind - full) & 3
            return self.code(coder, v)
        if kind == full:
            return self._new(coder, v)
        if self.same and kind == (self.full - 1 if by_step else 0):
            return self.time[at]
        gone = signed(v - self.time[at])
        if not by_step:
            self.step[at] = gone = coder.integer(self.steps, 0, gone, 0)
            self.extreme[at] = 0
        else:
            multi = kind if kind <= MULTI else MULTI - kind
            context = 1 if multi == 1 else 7 if multi == 0 else 4 if multi == MULTI else 6 if multi == MULTI_LOW else 5 if multi < 0 else 2 if multi < 10 else 3
            gone = coder.integer(self.steps, signed(multi * step), gone, context)
            if context == 1:
                self.extreme[at] = 0
            elif context in (4, 6, 7):
                self.extreme[at] += 1
                if self.extreme[at] > 3:
                    self.step[at], self.extreme[at] = gone, 0
        self.time[at] = signed(self.time[at] + gone, 64)
        return self.time[at]


class Bytes:
    """A byte coded as its difference from the last one."""

    def __init__(self):
        self.model = Model(256)

    def code(self, coder, last: int, v: int) -> int:
        return (last + coder.symbol(self.model, (v - last) & 255)) & 255


class Colours:
    def __init__(self):
        self.used, self.parts = Model(128), [Model(256) for _ in range(6)]

    def code(self, coder, last: tuple, v: tuple) -> tuple:
        """Three numbers of 16 bits: which bytes change, then red's differences, and those of green and blue from what red's let expect."""
        parts = [x >> s & 255 for x in last for s in (0, 8)]
        new = [x >> s & 255 for x in v for s in (0, 8)]
        grey = all(new[i] == new[i + 2] == new[i + 4] for i in (0, 1))
        used = coder.symbol(self.used, sum((a != b) << i for i, (a, b) in enumerate(zip(parts, new, strict=True))) | (not grey) << 6 if coder.writes else 0)
        out = list(parts)
        byte = lambda i, near: (near + coder.symbol(self.parts[i], (new[i] - near) & 255)) & 255 if used >> i & 1 else parts[i]
        for i in (0, 1):
            out[i] = byte(i, parts[i])
        if not used >> 6 & 1:
            out[2:] = out[:2] * 2
        else:
            for i in (0, 1):
                gone = out[i] - parts[i]
                out[i + 2] = byte(i + 2, min(max(gone + parts[i + 2], 0), 255))
                gone = int((gone + out[i + 2] - parts[i + 2]) / 2)
                out[i + 4] = byte(i + 4, min(max(gone + parts[i + 4], 0), 255))
        return tuple(out[i] | out[i + 1] << 8 for i in (0, 2, 4))


def _z_context(k: int, most: int) -> int:
    return k & ~1 if k < most else most


class Point10:
    """Records of formats 0 to 3: a point is (x, y, z, intensity, flags, classification, angle, user data, source, time, colour, extra bytes)."""

    def __init__(self, first: tuple, timed: bool, coloured: bool):
        self.last = first
        self.changed, self.intensity, self.source = Model(64), Integers(16, 4), Integers(16)
        self.angle = [Model(256), Model(256)]
        self.flags, self.kind, self.user = (defaultdict(lambda: Model(256)) for _ in range(3))
        self.x, self.y, self.z = Integers(32, 2), Integers(32, 22), Integers(32, 20)
        self.dx, self.dy = [Median() for _ in range(16)], [Median() for _ in range(16)]
        self.bright, self.height = [0] * 16, [0] * 8
        self.times = Times(first[9], same=True) if timed else None
        self.colours = Colours() if coloured else None
        self.extra = [Bytes() for _ in first[11]]

    def code(self, coder, p: tuple) -> tuple:
        x, y, z, bright, flags, kind, angle, user, source, time, colour, extra = p
        lx, ly, lz, _, lflags, lkind, langle, luser, lsource, ltime, lcolour, lextra = self.last
        # The intensity is compared with the last of the point's own returns, so the flags come first.
        context = RETURN_CONTEXT[flags >> 3 & 7][flags & 7]
        changed = (flags != lflags) << 5 | (self.bright[context] != bright) << 4 | (kind != lkind) << 3 | (angle != langle) << 2 | (user != luser) << 1 | (source != lsource)
        changed = coder.symbol(self.changed, changed)
        flags = coder.symbol(self.flags[lflags], flags) if changed & 32 else lflags
        r, n = flags & 7, flags >> 3 & 7
        context, level, single = RETURN_CONTEXT[n][r], abs(n - r), int(n == 1)
        if changed & 16:
            self.bright[context] = coder.integer(self.intensity, self.bright[context], bright, min(context, 3))
        bright = self.bright[context]
        kind = coder.symbol(self.kind[lkind], kind) if changed & 8 else lkind
        angle = (langle + coder.symbol(self.angle[flags >> 6 & 1], (angle - langle) & 255)) & 255 if changed & 4 else langle
        user = coder.symbol(self.user[luser], user) if changed & 2 else luser
        source = coder.integer(self.source, lsource, source) if changed & 1 else lsource
        dx = coder.integer(self.x, self.dx[context].values[2], signed(x - lx), single)
        self.dx[context].add(dx)
        dy = coder.integer(self.y, self.dy[context].values[2], signed(y - ly), single + _z_context(self.x.k, 20))
        self.dy[context].add(dy)
        z = self.height[level] = coder.integer(self.z, self.height[level], z, single + _z_context((self.x.k + self.y.k) // 2, 18))
        time = self.times.code(coder, time) if self.times else 0
        colour = self.colours.code(coder, lcolour, colour) if self.colours else ()
        extra = tuple(m.code(coder, a, b) for m, a, b in zip(self.extra, lextra, extra, strict=True)) if self.extra else ()
        self.last = (signed(lx + dx), signed(ly + dy), z, bright, flags, kind, angle, user, source, time, colour, extra)
        return self.last


#: Layers of a record of formats 6 to 8 before those of colour, infrared and extra bytes. The first two are always there.
LAYERS = ("xy", "z", "kind", "flags", "bright", "angle", "user", "source", "time")


def _extended_context(n: int, r: int) -> int:
    """One of six contexts: only, first of two, last of two, first, inner and last of more returns."""
    if n == r == 0:
        return 0
    if not 1 <= r <= n:
        raise ValueError(f"return {r} of {n} can't be coded")
    if n < 3:
        return r if n == 2 else 0
    return 3 if r == 1 else 5 if r == n else 4


class Channel:
    """The models of one scanner channel."""

    def __init__(self, first: tuple, coloured: bool, infrared: bool):
        self.last, self.timed = first, 0
        self.changed = [Model(128) for _ in range(8)]
        self.channel, self.jump = Model(3), Model(13)
        self.number, self.back = (defaultdict(lambda: Model(16)) for _ in range(2))
        self.kind, self.user = (defaultdict(lambda: Model(256)) for _ in range(2))
        self.flags = defaultdict(lambda: Model(64))
        self.x, self.y, self.z = Integers(32, 2), Integers(32, 22), Integers(32, 20)
        self.intensity, self.angle, self.source = Integers(16, 4), Integers(16, 2), Integers(16)
        self.dx, self.dy = [Median() for _ in range(12)], [Median() for _ in range(12)]
        self.height, self.bright = [first[2]] * 8, [first[3]] * 8
        self.times = Times(first[9], same=False)
        self.colours = Colours() if coloured else None
        self.infrared = (Model(4), Bytes(), Bytes()) if infrared else None
        self.extra = [Bytes() for _ in first[11]]


class Point14:
    """Records of formats 6 to 8; flags are the 16 bits of returns (4, 4), classification flags (4), channel (2), direction and edge. Colours of
    format 8 have infrared as their fourth number. Coders are by layer; a layer that isn't in a file is None and its values stay."""

    def __init__(self, first: tuple, coloured: bool, infrared: bool):
        self.coloured, self.has_infrared = coloured, infrared
        self.now = first[4] >> 12 & 3
        self.channels: dict[int, Channel] = {self.now: Channel(first, coloured, infrared)}
        self.names = [*LAYERS, *(["colour"] if coloured else []), *(["infrared"] if infrared else []), *[f"extra{i}" for i in range(len(first[11]))]]

    def code(self, coders: dict, p: tuple) -> tuple:
        x, y, z, bright, flags, kind, angle, user, source, time, colour, extra = p
        xy = coders["xy"]
        here = self.channels[self.now]
        lr, ln = here.last[4] & 15, here.last[4] >> 4 & 15
        before = int(lr == 1) | int(lr >= ln) << 1 | here.timed << 2
        channel, r, n = flags >> 12 & 3, flags & 15, flags >> 4 & 15
        last = self.channels.get(channel, here).last if xy.writes else here.last
        changed = 0
        if xy.writes:
            back = (r - last[4]) & 15
            changed = (channel != self.now) << 6 | (source != last[8]) << 5 | (time != last[9]) << 4 | (angle != last[6]) << 3 | (n != last[4] >> 4 & 15) << 2 | {0: 0, 1: 1, 15: 2}.get(back, 3)
        changed = xy.symbol(here.changed[before], changed)
        if changed & 64:
            channel = (self.now + 1 + xy.symbol(here.channel, (channel - self.now - 1) & 3)) & 3
            if channel not in self.channels:
                self.channels[channel] = Channel(here.last, self.coloured, self.has_infrared)
            self.now, here = channel, self.channels[channel]
        lx, ly, _, lbright, lflags, lkind, langle, luser, lsource, ltime, lcolour, lextra = here.last
        lr, ln, timed = lflags & 15, lflags >> 4 & 15, changed >> 4 & 1
        n = xy.symbol(here.number[ln], n) if changed & 4 else ln
        if changed & 3 < 3:
            r = (lr + (0, 1, 15)[changed & 3]) & 15
        elif timed:
            r = xy.symbol(here.back[lr], r)
        else:
            r = (lr + 2 + xy.symbol(here.jump, (r - lr - 2) & 15)) & 15
        m, level, single = _extended_context(n, r) << 1 | timed, min(abs(n - r), 7), int(n == 1)
        place = int(r == 1) << 1 | int(r >= n)
        dx = xy.integer(here.x, here.dx[m].values[2], signed(x - lx), single)
        here.dx[m].add(dx)
        dy = xy.integer(here.y, here.dy[m].values[2], signed(y - ly), single + _z_context(here.x.k, 20))
        here.dy[m].add(dy)
        z = here.height[level] = coders["z"].integer(here.z, here.height[level], z, single + _z_context((here.x.k + here.y.k) // 2, 18))
        # Layers without a change aren't in the file.
        c = coders["kind"]
        kind = c.symbol(here.kind[(lkind & 31) << 1 | int(place == 3)], kind) if c else lkind
        c = coders["flags"]
        bits = lambda f: (f >> 15 & 1) << 5 | (f >> 14 & 1) << 4 | f >> 8 & 15
        marks = c.symbol(here.flags[bits(lflags)], bits(flags)) if c else bits(lflags)
        flags = r | n << 4 | (marks & 15) << 8 | self.now << 12 | (marks >> 4 & 1) << 14 | (marks >> 5) << 15
        c, which = coders["bright"], place << 1 | timed
        if c:
            bright = here.bright[which] = c.integer(here.intensity, here.bright[which], bright, place)
        else:
            bright = lbright
        c = coders["angle"]
        angle = signed(c.integer(here.angle, langle & 0xFFFF, angle & 0xFFFF, timed), 16) if c and changed & 8 else langle
        c = coders["user"]
        user = c.symbol(here.user[luser >> 2], user) if c else luser
        c = coders["source"]
        source = c.integer(here.source, lsource, source) if c and changed & 32 else lsource
        c = coders["time"]
        time = here.times.code(c, time) if c and timed else ltime
        new = colour
        if self.coloured:
            c = coders["colour"]
            new = here.colours.code(c, lcolour[:3], colour[:3]) if c else lcolour[:3]
        if self.has_infrared:
            c, (used, low, high) = coders["infrared"], here.infrared
            was, is_ = lcolour[3], colour[3]
            if c:
                which = c.symbol(used, (is_ & 255 != was & 255) | (is_ >> 8 != was >> 8) << 1 if c.writes else 0)
                was = (low.code(c, was & 255, is_ & 255) if which & 1 else was & 255) | (high.code(c, was >> 8, is_ >> 8) if which & 2 else was >> 8) << 8
            new = (*new, was)
        more = tuple(b.code(coders[f"extra{i}"], a, v) if coders[f"extra{i}"] else a for i, (b, a, v) in enumerate(zip(here.extra, lextra, extra, strict=True)))
        here.timed = timed
        here.last = (signed(lx + dx), signed(ly + dy), z, bright, flags, kind, angle, user, source, time, new, more)
        return here.last


def _points(raw: np.ndarray, fmt: int) -> list[tuple]:
    """Records as tuples of integers; times as the integers of their bits."""
    n, names = len(raw), raw.dtype.names
    angle = raw["ScanAngle"] if fmt >= 6 else raw["ScanAngleRank"].view("u1")
    time = np.ascontiguousarray(raw["GpsTime"]).view("<i8").tolist() if "GpsTime" in names else [0] * n
    inks = [c for c in ("red", "green", "blue", "NIR") if c in names]
    colour = list(zip(*[raw[c].tolist() for c in inks], strict=True)) if inks else [()] * n
    size = _base_size(fmt)
    extra = raw.view("u1").reshape(n, raw.dtype.itemsize)[:, size:].tolist()
    columns = [raw[c].tolist() for c in ("x", "y", "z", "Intensity", "flags", "Classification")] + [angle.tolist(), raw["UserData"].tolist(), raw["PointSourceID"].tolist(), time, colour]
    return [(*p, tuple(e)) for p, e in zip(zip(*columns, strict=True), extra, strict=True)]


def _records(points: list[tuple], dtype: np.dtype, fmt: int) -> np.ndarray:
    raw = np.zeros(len(points), dtype)
    columns = list(zip(*points, strict=True))
    for name, values in zip(("x", "y", "z", "Intensity", "flags", "Classification"), columns, strict=False):
        raw[name] = values
    raw["ScanAngle" if fmt >= 6 else "ScanAngleRank"] = np.array(columns[6], np.int64).astype("<i2" if fmt >= 6 else "u1").view("<i2" if fmt >= 6 else "i1")
    raw["UserData"], raw["PointSourceID"] = columns[7], columns[8]
    if "GpsTime" in dtype.names:
        raw["GpsTime"] = np.array(columns[9], "<i8").view("<f8")
    for i, name in enumerate(c for c in ("red", "green", "blue", "NIR") if c in dtype.names):
        raw[name] = [c[i] for c in columns[10]]
    size = _base_size(fmt)
    if dtype.itemsize > size:
        raw.view("u1").reshape(len(raw), dtype.itemsize)[:, size:] = columns[11]
    return raw


def _base_size(fmt: int) -> int:
    from .las_format import record_dtype

    if fmt not in (0, 1, 2, 3, 6, 7, 8):
        raise ValueError(f"point format {fmt} can't be compressed here: wave packets have no codec")
    return record_dtype(fmt).itemsize


def items(fmt: int, extra: int) -> list[tuple[int, int, int]]:
    """(type, size, version) of the items of a record with so many extra bytes."""
    _base_size(fmt)
    if fmt >= 6:
        ink = {6: [], 7: [(RGB14, 6, 3)], 8: [(RGBNIR14, 8, 3)]}[fmt]
        return [(POINT14, 30, 3), *ink, *([(BYTE14, extra, 3)] if extra else [])]
    return [(POINT10, 20, 2), *([(GPSTIME11, 8, 2)] if fmt in (1, 3) else []), *([(RGB12, 6, 2)] if fmt in (2, 3) else []), *([(BYTE, extra, 2)] if extra else [])]


@dataclass
class Description:
    """The record in which a file says how its points are coded. chunk_size WORD: chunks of any size."""

    compressor: int
    chunk_size: int
    items: list[tuple[int, int, int]]

    @classmethod
    def of(cls, fmt: int, extra: int, chunk_size: int = CHUNK_SIZE) -> Description:
        if not 0 < chunk_size < WORD:
            raise ValueError("chunks hold at least one point")
        return cls(LAYERED if fmt >= 6 else POINTWISE, chunk_size, items(fmt, extra))

    def pack(self) -> bytes:
        head = struct.pack("<HHBBHIIqqH", self.compressor, 0, 3 if self.compressor == LAYERED else 2, 4 if self.compressor == LAYERED else 2, 0, 0, self.chunk_size, -1, -1, len(self.items))
        return head + b"".join(struct.pack("<HHH", *i) for i in self.items)

    @classmethod
    def unpack(cls, data: bytes) -> Description:
        compressor, coder, _, _, _, _, chunk_size, _, _, n = struct.unpack_from("<HHBBHIIqqH", data)
        if coder or compressor not in (POINTWISE, LAYERED):
            raise ValueError(f"compressor {compressor} with coder {coder} isn't known")
        return cls(compressor, chunk_size, [struct.unpack_from("<HHH", data, 34 + 6 * i) for i in range(n)])

    def check(self, fmt: int, extra: int) -> None:
        """Raise unless the records are coded in the way of this module."""
        if self.items != items(fmt, extra):
            raise ValueError(f"items {self.items} of point format {fmt} have no codec")


def encode_chunk(raw: np.ndarray, fmt: int) -> bytes:
    """Records (packed, of a point format and extra bytes) as a chunk: the first as it is, the others coded."""
    points = _points(np.ascontiguousarray(raw), fmt)
    first = raw[:1].tobytes()
    if fmt < 6:
        coder, state = Encoder(), Point10(points[0], fmt in (1, 3), fmt in (2, 3))
        for p in points[1:]:
            state.code(coder, p)
        return first + coder.finish()
    state = Point14(points[0], fmt in (7, 8), fmt == 8)
    coders = {name: Encoder() for name in state.names}
    for p in points[1:]:
        state.code(coders, p)
    _extended_context(points[0][4] >> 4 & 15, points[0][4] & 15)
    column = {"kind": 5, "bright": 3, "angle": 6, "user": 7, "source": 8, "time": 9}
    value = {name: (lambda p, i=i: p[i]) for name, i in column.items()}
    value |= {"flags": lambda p: p[4] & 0xCF00, "colour": lambda p: p[10][:3], "infrared": lambda p: p[10][3:]}
    value |= {f"extra{i}": (lambda p, i=i: p[11][i]) for i in range(len(points[0][11]))}
    same = {name for name, f in value.items() if name in coders and all(f(p) == f(points[0]) for p in points)}
    layers = [b"" if name in same else coders[name].finish() for name in state.names]
    return first + struct.pack(f"<I{len(layers)}I", len(points), *map(len, layers)) + b"".join(layers)


def decode_chunk(data: bytes, count: int, dtype: np.dtype, fmt: int, whole: int | None = None) -> np.ndarray:
    """The first `count` records of a chunk of `whole` points (the same number unless given)."""
    size = dtype.itemsize
    if count < 1 or len(data) < size:
        raise ValueError("a chunk ends before its first point")
    points = _points(np.frombuffer(data[:size], dtype), fmt)
    if fmt < 6:
        coder, state = Decoder(data, size), Point10(points[0], fmt in (1, 3), fmt in (2, 3))
        points += [state.code(coder, points[0]) for _ in range(count - 1)]
        if coder.at > len(data) + 4:
            raise ValueError("a chunk ends before its last point")
        return _records(points, dtype, fmt)
    state = Point14(points[0], fmt in (7, 8), fmt == 8)
    held, *sizes = struct.unpack_from(f"<I{len(state.names)}I", data, size)
    at, coders = size + 4 + 4 * len(sizes), {}
    if held != (count if whole is None else whole) or at + sum(sizes) > len(data):
        raise ValueError("a chunk's layers don't fit its size")
    for name, n in zip(state.names, sizes, strict=True):
        coders[name] = Decoder(data[at : at + n]) if n else None
        at += n
    points += [state.code(coders, points[0]) for _ in range(count - 1)]
    return _records(points, dtype, fmt)


def pack_table(sizes: list[int]) -> bytes:
    """The table of chunks of fixed numbers of points: version, number of chunks, coded sizes in bytes."""
    coder, numbers, last = Encoder(), Integers(32, 2), 0
    for size in sizes:
        coder.integer(numbers, last, size, 1)
        last = size
    return struct.pack("<II", 0, len(sizes)) + coder.finish()


def unpack_table(data: bytes, varying: bool) -> list[tuple[int, int]]:
    """(points, bytes) of each chunk; points are -1 unless their number varies."""
    version, n = struct.unpack_from("<II", data)
    if version:
        raise ValueError(f"unknown version {version} of a table of chunks")
    coder, numbers, points, size, out = Decoder(data, 8), Integers(32, 2), 0, 0, []
    for _ in range(n):
        points = coder.integer(numbers, points, context=0) if varying else -1
        size = coder.integer(numbers, size, context=1)
        out.append((points, size))
    return out
