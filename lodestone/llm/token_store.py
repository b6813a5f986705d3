"""Token ids in word-aligned Simple-8b files.

Encoding: the vocabulary's added tokens are found first, as the library does; what
lies between them is cut into the byte-level pre-tokens by array operations, each
distinct pre-token is encoded once by the ``tokenizers`` library's model (bounded
cache), and ids are gathered per text.

File format: documents lie in ascending id order over files (one file per range
partition) and chunks (whole documents).  A chunk row holds

    file, chunk, start     position: ids of the file before this chunk
    doc_ids, counts        its documents and the ids of each, end id included
    offsets                first 64-bit word of each block of ``BLOCK`` ids
    words                  little-endian 64-bit words

A word is a selector (4 bits) over 60 payload bits: the selector says how many
ids share the word and how wide each is.  Selector 15 is an escape: one value
too wide for 60 bits follows as a raw word.  A block starts at a word of its
own, so blocks decode independently and all words of one selector decode in one
array operation; ``unpack`` takes any range of blocks by the offsets, a full read
goes through a chunk by so many blocks at a time, and ``read_document`` decodes
only the blocks that a document touches.

The rows are Parquet written by Spark: commits are atomic, lost tasks are
rerun, and any store that Spark writes to will do.

Null text counts as empty (only the end id); a text of any length is encoded
whole; rows repeating an id are kept, in the order of their texts' hashes, and may
lie in several files, null ids likewise, which come first; other columns are not
read, so their names can't clash; an empty table gives no rows."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

from ._shared import id_array, id_longs
from ._text import IdCache, _Flat, flat, gather, gather_spans, slabs, span_hashes

BLOCK = 1024
#: Ids in a word and bits of each, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
# the count of selector 15 tells escapes from 60-bit values: both are one value,
# and a payload of all ones means that the value follows raw
_RAW = np.uint64((1 << 60) - 1)


_SMALL = np.array([i.bit_length() for i in range(1 << 16)], np.int8)


def _widths(v: np.ndarray) -> np.ndarray:
    if not len(v) or int(v.max()) < 1 << 16:
        return _SMALL[v]
    w = np.zeros(len(v), np.int8)
    for shift in (48, 32, 16, 0):
        part = _SMALL[(v >> np.uint64(shift)) & np.uint64(0xFFFF)]
        w = np.where((w == 0) & (part > 0), part + np.int8(shift), w)
    return w


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned values."""
    v = np.ascontiguousarray(values, np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    grid = np.zeros((blocks, BLOCK), np.int8)
    wide = _widths(v)
    escape = v >= _RAW
    if escape.any():
        wide[escape] = 60
    grid.ravel()[:n] = wide
    size = np.full(blocks, BLOCK)
    size[-1] = n - (blocks - 1) * BLOCK
    # the widest of the next 1, 2, 4 ... values; beyond the block counts as 0
    top = {1: grid}
    p = 1
    while p < 128:
        m = top[p].copy()
        m[:, :-p] = np.maximum(m[:, :-p], top[p][:, p:])
        top[2 * p] = m
        p *= 2
    choice = np.full((blocks, BLOCK), 15, np.int8)
    for sel in range(14, -1, -1):  # wider words first, so that the fullest stays
        c = int(COUNTS[sel])
        p = 1 << (c.bit_length() - 1)
        m = top[p]
        if c > p:
            m = m.copy()
            m[:, : BLOCK - (c - p)] = np.maximum(m[:, : BLOCK - (c - p)], top[p][:, c - p :])
        fits = m <= BITS[sel]
        fits[:, BLOCK - c + 1 :] = False
        fits[-1, max(0, size[-1] - c + 1) :] = False
        np.copyto(choice, np.int8(sel), where=fits)
    choice = choice.ravel()
    # follow the words of all blocks in step
    at = np.arange(blocks, dtype=np.int64) * BLOCK
    end = np.minimum(at + BLOCK, n)
    step = COUNTS[choice]
    begins = np.zeros(len(choice), bool)
    while len(at):
        begins[at] = True
        at = at + step[at]
        go = at < end
        if not go.all():
            at, end = at[go], end[go]
    start = np.flatnonzero(begins)
    blk = start // BLOCK
    sel = choice[start]
    raw = (sel == 15) & escape[start]
    place = np.arange(len(start)) + np.cumsum(raw) - raw
    words = np.zeros(len(start) + int(raw.sum()), np.uint64)
    for s in range(16):
        k = np.flatnonzero(sel == s)
        if not len(k):
            continue
        word = np.full(len(k), np.uint64(s) << np.uint64(60), np.uint64)
        if BITS[s]:
            for j in range(int(COUNTS[s])):
                x = v[start[k] + j]
                if s == 15:
                    x = np.minimum(x, _RAW)
                word |= x << np.uint64(j * int(BITS[s]))
        words[place[k]] = word
    words[place[raw] + 1] = v[start[raw]]
    first = np.searchsorted(blk, np.arange(blocks))
    return words, place[first].astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray | None = None, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of ``pack``; with ``offsets`` those of the blocks ``first`` to
    ``last`` (exclusive) alone."""
    words = np.ascontiguousarray(words, np.uint64)
    if offsets is not None:
        ends = np.append(offsets, len(words))
        words = words[ends[first] : ends[len(offsets) if last is None else min(last, len(offsets))]]
    sel = (words >> np.uint64(60)).astype(np.int64)
    payload = words & _RAW
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero((sel == 15) & (payload == _RAW)).tolist():
        if not raw[i]:  # a raw word may look like an escape itself
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[sel])
    at = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in range(2, 16):
        k = np.flatnonzero((sel == s) & ~raw)
        if not len(k):
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for j in range(int(COUNTS[s])):
            out[at[k] + j] = (payload[k] >> np.uint64(j * int(BITS[s]))) & mask
    follows = np.flatnonzero(raw)
    out[at[follows - 1]] = words[follows]
    return out


def documents(words: np.ndarray, offsets: np.ndarray, ends: np.ndarray, blocks: int = 256):
    """The ids of each document of a chunk, whose ids end at ``ends``; decodes
    ``blocks`` blocks at a time."""
    held, base, at, begin = np.empty(0, np.uint64), 0, 0, 0  # decoded values from ``base`` on
    for end in ends.tolist():
        if base + len(held) < end:
            got, have = [held[begin - base :]], base + len(held)
            while have < end:
                got.append(unpack(words, offsets, at, at + blocks))
                have, at = have + len(got[-1]), at + blocks
            held, base = np.concatenate(got), begin
        yield held[begin - base : end - base]
        begin = end


class _Classes:
    table: np.ndarray | None = None

    @classmethod
    def get(cls) -> np.ndarray:
        """Class of each code point: 1 white space, 2 letter, 3 number, 4 other."""
        if cls.table is None:
            import regex

            every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
            t = np.full(0x110000, 4, np.uint8)
            for k, p in ((1, r"\s"), (2, r"\p{L}"), (3, r"\p{N}")):
                for m in regex.finditer(p + "+", every):
                    a, b = ord(m[0][0]), ord(m[0][-1])
                    t[a : b + 1] = k
            t[0xD800:0xE000] = 4
            cls.table = t
        return cls.table


def pretokens(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the byte-level pre-tokens: contractions; letters,
    numbers or other signs with one space before them; white space, of which the
    last before something else stands alone or goes with that."""
    cls = _Classes.get()[cp]
    cls[starts[1:] - 1] = 0
    head = np.flatnonzero(np.diff(cls, prepend=255) != 0)
    # texts that are empty follow each other as one run of ends
    rs, re_, rc = head, np.append(head[1:], len(cp)), cls[head]
    nxt = np.append(rc[1:], 0)
    blank = rc == 1
    before = blank & (nxt >= 2)
    ends_in_space = cp[re_ - 1] == 32
    glued = np.concatenate([[False], (before & ends_in_space)[:-1]])
    word = rc >= 2
    a, b = rs - glued, re_.copy()
    # a lone apostrophe before certain letters takes them
    quote = np.flatnonzero(word & ~glued & (re_ - rs == 1) & (cp[rs] == 39) & (nxt == 2))
    if len(quote):
        p = re_[quote]
        one = cp[p]
        two = np.where(re_[quote + 1] - p >= 2, cp[np.minimum(p + 1, len(cp) - 1)], 0)
        take = np.zeros(len(quote), np.int64)
        take[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for x, y in ("re", "ve", "ll"):
            take[(one == ord(x)) & (two == ord(y))] = 2
        b[quote] += take
        a[quote + 1] += take
    body_end = re_ - before
    lone = before & ~ends_in_space
    s = np.concatenate([a[word], rs[blank], re_[lone] - 1])
    e = np.concatenate([b[word], body_end[blank], re_[lone]])
    full = e > s
    s, e = s[full], e[full]
    order = np.argsort(s)
    return s[order], e[order]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in such vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteEncoder:
    """Whole texts to ids by the ``tokenizers`` library's model."""

    _made: dict[str, ByteEncoder] = {}

    def __init__(self, path: str, most: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.model = self.lib.model
        added = self.lib.get_added_tokens_decoder()
        self.added = {t.content: i for i, t in added.items()}
        # the library takes the leftmost, of those the longest
        self.found = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True)) + ")") if added else None
        # tokens that take white space or whole words along are left to the library
        self.plain = not any(t.lstrip or t.rstrip or t.single_word for t in added.values())
        self.letters = _byte_letters()
        self.letter = np.array([ord(self.letters[b]) for b in range(256)], "<u2")
        self.cache = IdCache(self.fill, most, as_spans=True)

    @classmethod
    def of(cls, path: str, most: int = 800_000) -> ByteEncoder:
        if (path, most) not in cls._made:
            cls._made[path, most] = cls(path, most)
        return cls._made[path, most]

    def fill(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> _Flat:
        char = gather_spans(cp, s, e)
        raw = np.frombuffer(char.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
        text = self.letter[raw].tobytes().decode("utf-16-le")
        # bytes before each character, then before each word
        upto = np.concatenate([[0], np.cumsum(1 + (char > 0x7F) + (char > 0x7FF) + (char > 0xFFFF))])
        cut = upto[np.concatenate([[0], np.cumsum(e - s)])].tolist()
        run = self.model.tokenize
        found = [run(text[a:b]) for a, b in zip(cut[:-1], cut[1:])]
        out = _Flat(range(len(found)))
        out.flat, out.counts = np.array([t.id for x in found for t in x], np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        return out

    def encode(self, texts: list) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        held = [k for k, t in enumerate(texts) if self.found is not None and self.found.search(t)]
        if not held:
            return self._encode(texts)
        split = {k: self.found.split(texts[k]) for k in held}
        # the stretches between added tokens are texts of their own
        flat_ = [x for k, t in enumerate(texts) for x in (split[k][::2] if k in split else [t])]
        ids, out = iter(self._encode(flat_)), []
        for k in range(len(texts)):
            own = [next(ids) for _ in range(len(split[k][::2]) if k in split else 1)]
            if k not in split:
                out += own
            elif self.plain:
                between = [np.array([self.added[x]], np.uint32) for x in split[k][1::2]]
                out.append(np.concatenate([x for pair in zip(own, between) for x in pair] + own[-1:]))
            else:
                out.append(np.array(self.lib.encode(texts[k], add_special_tokens=False).ids, np.uint32))
        return out

    def _encode(self, texts: list) -> list[np.ndarray]:
        out = []
        for _, part in slabs(texts):
            cp, starts = flat(part)
            s, e = pretokens(cp, starts)
            rows = self.cache.rows(cp, s, e, span_hashes(cp, s, e))
            ids, counts = gather(self.cache.offsets, self.cache.ids, rows)
            upto = np.concatenate([[0], np.cumsum(counts)])
            cut = upto[np.searchsorted(s, starts)]
            out += [ids[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        return out


#: Columns of a chunk row.
FORMAT = "file int, chunk long, start long, doc_ids array<long>, counts array<long>, offsets array<int>, words binary"


def write_tokens(docs, path: str, vocabulary: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", chunk_docs: int = 200) -> None:
    """Encode every whole text, append ``end_id`` and write the chunk rows."""
    from pyspark.sql import functions as F

    from ._shared import id_text, parts

    spark = docs.sparkSession

    def run(batches):
        import pandas as pd
        from pyspark import TaskContext

        enc = ByteEncoder.of(vocabulary)
        file, chunk, start = TaskContext.get().partitionId(), 0, 0
        for pdf in batches:
            for a, b in parts(pdf["__text"].tolist(), rows=chunk_docs):
                part = pdf.iloc[a:b]
                ids = [np.append(x, np.uint32(end_id)) for x in enc.encode(part["__text"].tolist())]
                counts = np.array([len(x) for x in ids], np.int64)
                words, offsets = pack(np.concatenate(ids))
                yield pd.DataFrame({
                    "file": [file], "chunk": [chunk], "start": [start], "doc_ids": [id_longs(part["__id"])],
                    "counts": [counts], "offsets": [offsets], "words": [words.astype("<u8").tobytes()],
                })
                chunk, start = chunk + 1, start + int(counts.sum())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    # by id and hash: rows without an id would be one range otherwise
    rows = rows.withColumn("__hash", F.xxhash64("__text")).repartitionByRange(n, "__id", "__hash").sortWithinPartitions("__id", "__hash")
    rows.select(id_text(F.col("__id")).alias("__id"), "__text").mapInPandas(run, FORMAT).write.parquet(path)


def read_tokens(spark, path: str):
    """(file, start, doc_id, n_tokens, ids) of every document of the files; start
    counts the ids of all documents before it, over all files."""
    return _read(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def read_checksums(spark, path: str):
    """As ``read_tokens`` with the CRC-32 of the ids as little-endian 32-bit
    integers instead of the ids."""
    return _read(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()))


def _read(spark, path: str, column: str, make):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    name = column.split()[0]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ends = np.cumsum(np.asarray(r.counts, np.int64))
                yield pd.DataFrame({
                    "file": r.file, "doc_id": id_array(r.doc_ids), "start": ends - r.counts + r.start, "n_tokens": r.counts,
                    name: [make(x) for x in documents(np.frombuffer(r.words, "<u8"), r.offsets, ends)],
                })

    rows = spark.read.schema(FORMAT).parquet(path)
    docs = rows.select("file", "start", F.col("doc_ids").cast("array<string>").alias("doc_ids"), "counts", "offsets", "words").mapInPandas(run, f"file int, doc_id long, start long, n_tokens long, {column}")
    # a row for each file: their number is that of the writer's partitions
    last = rows.select("file", (F.col("start") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("stop"))
    total = last.groupBy("file").agg(F.max("stop").alias("n"))
    before = total.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    return docs.join(before, "file").withColumn("start", F.col("start") + F.col("before")).drop("before")


def read_document(spark, path: str, doc_id: int):
    """(doc_id, ids) of the rows with one id; of each chunk that holds it only the
    blocks that its ids touch are decoded."""
    from pyspark.sql import functions as F

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ends, words = np.cumsum(np.asarray(r.counts, np.int64)), np.frombuffer(r.words, "<u8")
                for k in np.flatnonzero(np.array(r.doc_ids) == str(doc_id)).tolist():
                    a, b = int(ends[k] - r.counts[k]), int(ends[k])
                    first = a // BLOCK
                    got = unpack(words, r.offsets, first, -(-b // BLOCK))
                    yield pd.DataFrame({"doc_id": [doc_id], "ids": [got[a - first * BLOCK : b - first * BLOCK].astype(np.int32)]})

    rows = spark.read.schema(FORMAT).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long")))
    return rows.select(F.col("doc_ids").cast("array<string>").alias("doc_ids"), "counts", "offsets", "words").mapInPandas(run, "doc_id long, ids array<int>")
