"""SentencePiece BPE by vectorised merge rounds.

A text becomes ``▁`` + text with spaces as ``▁``.  No piece has a ``▁`` after
another character, so the merges of a text fall apart into *words*: a run of
``▁`` and what follows up to the next one.  Where no piece holds a line feed, a feed
is a word of its own and ends the one before.  A word's ids depend on the word
alone; distinct words are encoded once and kept in a bounded cache.

The words of one call are one flat array of symbols.  Each round takes, for
every word, the best rank among its adjacent pairs (a segmented minimum), merges
its leftmost pairs of that rank at the same time and compacts the array; words
without a pair leave.  Merging many at the same time equals merging one after
the other unless the new symbol could at once form a pair of a better rank; for
such symbols only the leftmost pair is merged in a round.

Symbols outside the vocabulary end as byte pieces.

Defined cases: null counts as empty; an empty text has no ids and decodes to an
empty text; a text of any length is encoded whole; rows are treated one by one,
so repeated rows and null ids are kept as they are; other columns are not read,
so their names can't clash; an empty table gives no rows."""

from __future__ import annotations

import hashlib

import numpy as np

from ._shared import id_array, parts
from ._text import SMALL_CACHE, SMALL_SLAB, IdCache, Slots, _Flat, flat, gather, gather_spans, slabs, span_hashes

SPACE = 0x2581
_NONE = np.int32(1 << 30)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


class PieceBpe:
    """The merge table of a SentencePiece BPE model, derived from its pieces."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model_file = model_file
        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = lib.get_piece_size()
        if n > 1 << 20:
            raise ValueError("pairs of pieces are keyed by 20 bits each")
        plain = {}
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                plain[p] = i
        self.chars = np.full(0x110000, -1, np.int32)
        pairs = {}
        risky = np.zeros(n, bool)
        # the order in which pieces are merged: by score, best first
        score = {p: -lib.get_score(i) for p, i in plain.items()}
        self.rank = np.full(n + 1, _NONE, np.int32)  # the last one for no piece, -1
        levels = {s: k for k, s in enumerate(sorted({score[p] for p in plain if len(p) > 1}))}
        for p, i in plain.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
                continue
            self.rank[i] = levels[score[p]]
            for c in range(1, len(p)):
                a, b = plain.get(p[:c]), plain.get(p[c:])
                if a is None or b is None:
                    continue
                pairs[a << 20 | b] = i
                for x, q in ((a, p[:c]), (b, p[c:])):
                    if len(q) > 1 and score[p] <= score[q]:
                        risky[x] = True
        self.risky = risky
        self.feeds_alone = not any("\n" in p for p in plain)
        self.pairs = Slots()
        self.pairs.add(np.fromiter(pairs.keys(), np.uint64, len(pairs)) * _SPREAD)
        self.merged = np.array([*pairs.values(), -1], np.int32)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 if none."""
        k = ((a.astype(np.int64) << 20) | b).view(np.uint64) * _SPREAD
        out = self.merged[self.pairs.find(k)]
        out[(a | b) < 0] = -1
        return out

    def encode_spans(self, cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> _Flat:
        """The ids of each span of code points, a word each."""
        count = ends - starts
        char = gather_spans(cp, starts, ends)
        sym = self.chars[char]
        lost = np.flatnonzero(sym < 0)
        sym[lost] = -1 - char[lost].astype(np.int32)  # an unknown character keeps its code point
        last = np.zeros(len(sym), bool)  # symbols that end a word
        last[np.cumsum(count)[count > 0] - 1] = True
        name = np.flatnonzero(count)
        count = count[name]
        piece = self._pieces(sym, last, np.arange(len(sym)))
        rank = self.rank[piece]
        done = []
        while len(name):
            first = np.cumsum(count) - count
            best = np.minimum.reduceat(rank, first)
            live = best < _NONE
            keep = np.repeat(live, count)
            gone = ~live
            if gone.any():  # words without a pair are finished
                done.append((name[gone], count[gone], sym[~keep]))
                best[gone] = -1
            at = np.flatnonzero(rank == np.repeat(best, count))
            # of touching pairs in a run, every second one from the left
            new_run = np.diff(at, prepend=-2) != 1
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            word = np.searchsorted(first, at, "right") - 1
            risky = self.risky[piece[at]]
            if risky.any():
                leftmost = np.diff(word, prepend=-1) != 0
                careful = np.zeros(len(name), bool)
                careful[word[risky]] = True
                go = leftmost | ~careful[word]
                at, word = at[go], word[go]
            sym[at] = piece[at]
            last[at] = last[at + 1]
            keep[at + 1] = False
            # only symbols next to a merge have new pairs
            place = at - np.arange(len(at)) - np.cumsum(np.where(gone, count, 0))[word]
            place = np.concatenate([place, place[place > 0] - 1])
            count = (count - np.bincount(word, minlength=len(name)))[live]
            name, sym, last, piece, rank = name[live], sym[keep], last[keep], piece[keep], rank[keep]
            piece[place] = self._pieces(sym, last, place)
            rank[place] = self.rank[piece[place]]
        counts = np.zeros(len(starts), np.int64)
        for k, n, _ in done:
            counts[k] = n
        first = np.cumsum(counts) - counts
        sym = np.empty(int(counts.sum()), np.int32)
        for k, n, own in done:
            sym[np.arange(len(own)) + np.repeat(first[k] - (np.cumsum(n) - n), n)] = own
        unknown = np.flatnonzero(sym < 0)
        if len(unknown):  # byte pieces
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in sym[unknown].tolist()]
            times = np.ones(len(sym), np.int64)
            times[unknown] = [len(r) for r in raw]
            where, word = np.repeat(sym < 0, times), np.repeat(np.arange(len(counts)), counts)
            counts = np.bincount(word, weights=times, minlength=len(counts)).astype(np.int64)
            sym = np.repeat(sym, times)
            sym[where] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        out = _Flat(range(len(counts)))
        out.flat, out.counts = sym.astype(np.uint32), counts
        return out

    def _pieces(self, sym: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What the symbols at some places make with the next ones of their words."""
        out = self.pair(sym[place], sym[np.minimum(place + 1, len(sym) - 1)])
        out[last[place]] = -1
        return out


class Encoder:
    """Whole texts to ids, through a bounded cache of words."""

    _made: dict[str, Encoder] = {}

    def __init__(self, model_file: str):
        self.bpe = PieceBpe(model_file)
        self.cache = IdCache(self.bpe.encode_spans, SMALL_CACHE, as_spans=True)

    @classmethod
    def of(cls, model_file: str) -> Encoder:
        if model_file not in cls._made:
            cls._made[model_file] = cls(model_file)
        return cls._made[model_file]

    def encode(self, texts: list) -> list[np.ndarray]:
        out = []
        for _, part in slabs(texts, SMALL_SLAB):
            part = ["▁" + t.replace(" ", "▁") if t else "" for t in part]
            cp, starts = flat(part)
            end = np.zeros(len(cp), bool)
            end[starts[1:] - 1] = True  # the feeds between texts belong to none
            mark = cp == SPACE
            head = mark & ~np.concatenate([[False], mark[:-1]])
            if self.bpe.feeds_alone:
                feed = cp == 10
                head |= feed
                head[1:] |= feed[:-1]
                head &= ~end
            s = np.flatnonzero(head)
            cuts = np.flatnonzero(head | end)
            e = cuts[np.searchsorted(cuts, s, "right")]
            rows = self.cache.rows(cp, s, e, span_hashes(cp, s, e))
            ids, counts = gather(self.cache.offsets, self.cache.ids, rows)
            upto = np.concatenate([[0], np.cumsum(counts)])
            cut = upto[np.searchsorted(s, starts)]
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return [self.bpe.lib.decode(x.tolist()) if len(x) else "" for x in ids]


def _digests(model_file: str):
    def run(batches):
        import pandas as pd

        enc = Encoder.of(model_file)
        names = np.array([str(i) for i in range(enc.bpe.lib.get_piece_size())], dtype=object)
        for pdf in batches:
            for a, b in parts(pdf["__text"].tolist()):
                part = pdf.iloc[a:b]
                ids = enc.encode(part["__text"].tolist())
                back = enc.decode(ids)
                yield pd.DataFrame({
                    "doc_id": id_array(part["__id"]),
                    "n_tokens": [len(x) for x in ids],
                    "ids_sha256": [hashlib.sha256(",".join(names[x].tolist()).encode()).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in back],
                })

    return run


def encode_texts(docs, model_file: str, *, id_col: str = "doc_id", text_col: str = "text"):
    """(id, ids array<int>, decoded string) of every whole text."""
    from pyspark.sql import functions as F

    from ._shared import id_text

    def run(batches):
        import pandas as pd

        enc = Encoder.of(model_file)
        for pdf in batches:
            for a, b in parts(pdf["__text"].tolist()):
                part = pdf.iloc[a:b]
                ids = enc.encode(part["__text"].tolist())
                yield pd.DataFrame({"doc_id": id_array(part["__id"]), "ids": [x.astype(np.int32) for x in ids], "decoded": enc.decode(ids)})

    rows = docs.select(id_text(F.col(id_col)).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInPandas(run, "doc_id long, ids array<int>, decoded string")


def digests(docs, model_file: str, *, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, from
    the encoder's ids and the library's decoding of them."""
    from pyspark.sql import functions as F

    from ._shared import id_text

    rows = docs.select(id_text(F.col(id_col)).alias("__id"), F.col(text_col).alias("__text"))
    return rows.mapInPandas(_digests(model_file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
