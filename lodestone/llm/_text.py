"""Texts as flat numpy arrays: code points, word spans and span hashes.

A list of texts becomes one array of code points with a line feed after each
text, so that no span crosses texts.  Arrays are made for a bounded number of
characters at a time (``slabs``); one text longer than that is a slab of its own
and its hashes are still computed piecewise."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLAB = 1 << 20
#: Where workers also hold vocabularies: characters at a time, and words of a cache.  A
#: worker lives on through all stages of a job, so what it keeps counts in all of them.
SMALL_SLAB, SMALL_CACHE = 1 << 18, 200_000
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def slabs(texts: list, most: int = SLAB) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) with at most ``most`` characters unless
    a single text is longer.  None counts as empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points (a line feed after each text) and each text's start, with the end."""
    cp = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(lens + 1, out=starts[1:])
    return cp, starts


def is_space(cp: np.ndarray) -> np.ndarray:
    return (cp == 32) | ((cp >= 9) & (cp <= 13))


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return cp + ((cp >= 65) & (cp <= 90)).astype(np.uint32) * np.uint32(32)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class _Powers:
    base = inverse = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.base) < n:
            n = max(n, SLAB + 4096)
            for name, b in (("base", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, b, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.base, cls.inverse


_LONG = 512  # spans beyond this are hashed one by one


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span; the spans are in order and don't overlap.
    A polynomial by prefix sums; long spans take a byte hash instead."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    k = 0
    while k < len(starts):
        lo = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, lo + SLAB, "right")))
        hi = int(ends[stop - 1])
        if hi - lo <= SLAB:
            power, inverse = _Powers.of(hi - lo + 1)
            x = cp[lo:hi].astype(np.uint64)
            x += np.uint64(1)
            x *= _M2
            x ^= x >> np.uint64(29)
            x *= power[: hi - lo]
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(x, out=sums[1:])
            s, e = starts[k:stop] - lo, ends[k:stop] - lo
            h = (sums[e] - sums[s]) * inverse[s]
            h += (e - s).astype(np.uint64) * _M1
            out[k:stop] = mix(h)
        k = stop
    for i in np.flatnonzero(ends - starts > _LONG):
        import xxhash

        out[i] = xxhash.xxh3_64_intdigest(cp[starts[i] : ends[i]].tobytes())
    return out


def words(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the number of
    the first word of each text (with the end)."""
    s, e = spans(~is_space(cp))
    return s, e, np.searchsorted(s, starts)


class Slots:
    """Places of distinct 64-bit hashes in the order they were added; an open table
    that is at most a quarter full."""

    def __init__(self):
        self.keys = np.empty(0, np.uint64)
        self._table(1 << 10)

    def _table(self, size: int) -> None:
        self.table = np.full(size, -1, np.int32)
        self.shift = np.uint64(65 - size.bit_length())
        self._place(0)

    def _place(self, first: int) -> None:
        at = (self.keys[first:] >> self.shift).astype(np.int64)
        slot = np.arange(first, len(self.keys), dtype=np.int32)
        while len(at):
            free = self.table[at] < 0
            self.table[at[free]] = slot[free]
            lost = self.table[at] != slot
            at, slot = (at[lost] + 1) & (len(self.table) - 1), slot[lost]

    def add(self, fresh: np.ndarray) -> None:
        """Hashes that are distinct and new."""
        first = len(self.keys)
        self.keys = np.concatenate([self.keys, fresh])
        if 4 * len(self.keys) > len(self.table):
            self._table(1 << (4 * len(self.keys) - 1).bit_length())
        else:
            self._place(first)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if unknown."""
        at = (h >> self.shift).astype(np.int64)
        slot = self.table[at]
        open_ = np.flatnonzero(slot >= 0)
        while len(open_):
            open_ = open_[self.keys[slot[open_]] != h[open_]]
            at[open_] = (at[open_] + 1) & (len(self.table) - 1)
            slot[open_] = self.table[at[open_]]
            open_ = open_[slot[open_] >= 0]
        return slot


class IdCache:
    """Hash of a word -> its ids, as flat arrays; beyond ``most`` words those used
    last stay, half of them at most.  ``fill(words)`` gives the id arrays of new words;
    with ``as_spans`` it is called as fill(cp, starts, ends), the words being spans."""

    def __init__(self, fill, most: int = 800_000, as_spans: bool = False):
        self.fill, self.most, self.as_spans = fill, most, as_spans
        self.clear()

    def clear(self) -> None:
        self.slots = Slots()
        self.used = np.empty(0, np.int32)  # the call that used a word last
        self.calls = 0
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.empty(0, np.uint32)

    @property
    def keys(self) -> np.ndarray:
        return self.slots.keys

    def _shrink(self) -> None:
        kept = np.flatnonzero(self.used > np.partition(self.used, -(self.most // 2))[-(self.most // 2)])
        keys, self.used = self.keys[kept], self.used[kept]
        self.ids, counts = gather(self.offsets, self.ids, kept)
        self.offsets = np.concatenate([[0], np.cumsum(counts)])
        self.slots = Slots()
        self.slots.add(keys)

    def rows(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Slot of each span's word; ids of slot k are ids[offsets[k]:offsets[k+1]]."""
        if len(self.keys) > self.most:
            self._shrink()
        slot = self.slots.find(h)
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            order = np.argsort(h[miss])
            own = h[miss[order]]
            head = np.concatenate([[True], own[1:] != own[:-1]])
            w, n = miss[order[head]], len(self.keys)
            lists = self.fill(cp, s[w], e[w]) if self.as_spans else self.fill(strings(cp, s[w], e[w]))
            counts = lists.counts if isinstance(lists, _Flat) else np.fromiter(map(len, lists), np.int64, len(lists))
            ids = lists.flat if isinstance(lists, _Flat) else np.fromiter((i for x in lists for i in x), np.uint32, int(counts.sum()))
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(w), np.int32)])
            self.slots.add(own[head])
            slot[miss[order]] = n - 1 + np.cumsum(head)
        self.calls += 1
        self.used[slot] = self.calls
        return slot


def gather_spans(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The code points of all spans, one after the other."""
    n = e - s
    return cp[np.arange(int(n.sum())) + np.repeat(s - (np.cumsum(n) - n), n)]


def strings(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[str]:
    """The text of each span."""
    text = gather_spans(cp, s, e).tobytes().decode("utf-32-le", "surrogatepass")
    upto = np.cumsum(e - s)
    return [text[a:b] for a, b in zip((upto - (e - s)).tolist(), upto.tolist())]


class _Flat(list):
    """Id lists that also come as one flat array."""

    flat: np.ndarray
    counts: np.ndarray


def gather(offsets: np.ndarray, values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows, one after the other, and the count of each row."""
    counts = offsets[rows + 1] - offsets[rows]
    total = int(counts.sum())
    if not total:
        return values[:0], counts
    ends = np.cumsum(counts)
    index = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - (ends - counts), counts)
    return values[index], counts
