"""Quality rules: base counts and tokeniser fertility.

Base counts of a whole text, over words ``[^\\x20\\x09-\\x0D]+``: code points in
words, signs ``#*$%&|<>``, lines equal to an earlier line, and words inside
8-word windows found at least twice.  A text fails the base with fewer than 20
words or over 30 % repeated words.

Fertility: public vocabularies encode the whole text, a SentencePiece one with byte
fallback (*piece*) and a byte-level one (*byte*).  Of each, three figures are held
against the bands of the text's language or script:

- characters per token;
- byte share: tokens that are no whole character, that is fallback bytes of the
  one (without those of control characters) and parts of characters of the other;
- entropy share: the entropy in bits of the text's token counts, divided by
  log2(1 + n / (1 + n / SATURATION)) for n tokens.  The divisor is one formula at
  every size; it nears log2 n for short texts and the bound log2(1 + SATURATION),
  since natural text of any length goes on with the tokens that it has.

Junk takes many tokens for few characters, falls back to bytes, or repeats few
tokens.  A text of Latin script takes the bands of the language that holds most
of its words as function words (``FUNCTION_WORDS``, at least ``LEAST_SHARE`` of
them), else those of its script.  The bands come from figures over labelled and
natural texts; a script without figures for a vocabulary has no band there.  A
text whose letters are of no listed script takes the band ``other``.

Null or empty text: all counts 0, base_failed, not kept.  Rows are treated one
by one, so ties and repeated rows don't matter; a text of any length is measured
whole; a result column replaces an input column of the same name; an empty table
gives no rows."""

from __future__ import annotations

import dataclasses
import functools

import numpy as np

from ._text import SMALL_CACHE, SMALL_SLAB, flat, mix, slabs, span_hashes, spans, words
from .decontaminate import _Lower
from .sentencepiece_bpe import Encoder
from .token_store import ByteEncoder, _Classes

#: First and last code point of the letters of each script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "odia": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "armenian": [(0x530, 0x58F)],
    "kana_han": [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}


@dataclasses.dataclass(frozen=True)
class Band:
    """Accepted range: characters per token, byte-fallback share, entropy share."""

    chars_low: float
    chars_high: float
    bytes_high: float
    entropy_low: float


#: The four languages come from ``fit_bands`` over the training rows of the labelled
#: test documents (README states what held-out rows give).  The rest comes from manual
#: pages and translated names on the test machine, with room around the extremes seen;
#: where a vocabulary lacks a script its letters are bytes in good text too, so that
#: the byte bound near 1 judges nothing there and the other two figures do.
BANDS = {
    "en": Band(1.94, 7.0, 0.1, 0.773),
    "de": Band(2.357, 7.0, 0.1, 0.753),
    "fr": Band(1.982, 7.0, 0.1, 0.742),
    "es": Band(2.065, 7.0, 0.1, 0.758),
    "latin": Band(1.35, 12.0, 0.20, 0.74),
    "greek": Band(0.93, 8.0, 0.11, 0.47),
    "cyrillic": Band(1.70, 10.0, 0.12, 0.66),
    "hebrew": Band(0.93, 8.0, 0.13, 0.43),
    "arabic": Band(0.92, 8.0, 0.16, 0.42),
    "devanagari": Band(0.85, 8.0, 0.21, 0.46),
    "bengali": Band(0.78, 8.0, 0.34, 0.46),
    "gurmukhi": Band(0.37, 8.0, 0.93, 0.35),
    "gujarati": Band(0.43, 8.0, 0.89, 0.37),
    "odia": Band(0.33, 8.0, 0.96, 0.32),
    "tamil": Band(0.72, 8.0, 0.40, 0.44),
    "telugu": Band(0.54, 8.0, 0.73, 0.42),
    "kannada": Band(0.61, 8.0, 0.59, 0.43),
    "malayalam": Band(0.43, 8.0, 0.88, 0.37),
    "sinhala": Band(0.54, 8.0, 0.73, 0.41),
    "thai": Band(0.91, 8.0, 0.12, 0.50),
    "lao": Band(0.33, 8.0, 0.96, 0.32),
    "myanmar": Band(0.60, 8.0, 0.63, 0.43),
    "georgian": Band(0.90, 8.0, 0.15, 0.42),
    "ethiopic": Band(0.38, 8.0, 0.90, 0.39),
    "khmer": Band(0.75, 8.0, 0.38, 0.50),
    "armenian": Band(0.84, 8.0, 0.29, 0.47),
    "kana_han": Band(0.88, 6.0, 0.35, 0.45),
    "hangul": Band(0.83, 6.0, 0.26, 0.55),
    "other": Band(0.33, 12.0, 0.96, 0.32),
}
BYTE_BANDS = {
    "en": Band(2.136, 7.0, 0.134, 0.779),
    "de": Band(2.141, 7.0, 0.18, 0.752),
    "fr": Band(1.973, 7.0, 0.257, 0.736),
    "es": Band(1.894, 7.0, 0.241, 0.74),
    "latin": Band(0.90, 12.0, 0.60, 0.74),
}
#: Frequent function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on with as be at by this are from or an have not which but his they had you were".split(),
    "de": "der die und das zu den mit von ist für auf nicht ein eine dem des sich im auch als es an er so dass nach wird bei einer um".split(),
    "fr": "le la les de des et un une du en que qui dans pour pas est au sur il ne ce se plus par avec son elle sont mais nous".split(),
    "es": "el la los las de y en que un una por con para del se no es lo su al como más o pero sus le ha me si sin".split(),
}
LEAST_SHARE = 0.04
SATURATION = 512
_NAMES = [*SCRIPTS, "other"]


def _script_table() -> np.ndarray:
    t = np.full(0x110000, 255, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            t[a : b + 1] = k
    return t


_SCRIPT_OF = _script_table()
_SYMBOL = np.isin(np.arange(128), [ord(c) for c in "#*$%&|<>"])
WINDOW = 8
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, language string, chars_per_token double, byte_share double, entropy_share double, "
    "byte_chars_per_token double, byte_byte_share double, byte_entropy_share double"
)


def base_counts(cp: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The base counts of each text of a flat array."""
    n = len(starts) - 1
    s, e, first = words(cp, starts)
    doc = np.repeat(np.arange(n), np.diff(first))
    out = {"n_words": np.diff(first), "word_chars": np.bincount(doc, weights=e - s, minlength=n).astype(np.int64)}
    symbol = np.flatnonzero(_SYMBOL[np.minimum(cp, 127)])
    out["n_symbols"] = np.diff(np.searchsorted(symbol, starts))
    # lines with a word, fewer the distinct ones
    feed = cp == 10
    ls, le = spans(~feed)
    spoken = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[spoken], le[spoken]
    ldoc = np.searchsorted(starts, ls, "right") - 1
    key = span_hashes(cp, ls, le) + mix(ldoc.astype(np.uint64))
    distinct = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(ldoc, minlength=n) - np.bincount(ldoc[distinct], minlength=n)
    # windows of eight words of one text
    repeat = np.zeros(n, np.int64)
    if len(s) >= WINDOW:
        h = span_hashes(cp, s, e)
        m = len(s) - WINDOW + 1
        total = np.zeros(m, np.uint64)
        for j in range(WINDOW):
            total += h[j : j + m] * np.uint64(pow(0x9E3779B97F4A7C15, 2 * j + 1, 1 << 64))
        begin = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
        key = mix(total[begin]) + mix(doc[begin].astype(np.uint64))
        order = np.argsort(key)
        own = key[order]
        same = own[1:] == own[:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(s) + 1, np.int64)
        at = begin[twice]
        np.add.at(step, at, 1)
        np.add.at(step, at + WINDOW, -1)
        covered = np.cumsum(step)[:-1] > 0
        repeat = np.bincount(doc[covered], minlength=n)
    out["n_repeat_words"] = repeat.astype(np.int64)
    return out


def scripts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Number in ``_NAMES`` of the script with most letters of each text."""
    kind = _SCRIPT_OF[cp]
    table = np.zeros((len(starts) - 1, len(SCRIPTS)), np.int64)
    for k in np.flatnonzero(np.bincount(kind, minlength=256)[: len(SCRIPTS)]).tolist():
        table[:, k] = np.add.reduceat(kind == k, starts[:-1], dtype=np.int64)
    return np.where(table.sum(1) > 0, table.argmax(1), len(SCRIPTS))


@functools.lru_cache(1)
def _function_keys() -> tuple[np.ndarray, np.ndarray, int]:
    """All function words, each as a number of its code points (a byte each), in
    order; whether each language has them; the length of the longest."""
    keys = {w: int.from_bytes(w.encode("latin-1"), "big") for words in FUNCTION_WORDS.values() for w in words}
    every = sorted(keys, key=keys.get)
    own = np.array([[w in words for w in every] for words in FUNCTION_WORDS.values()])
    return np.array([keys[w] for w in every], np.uint64), own, max(map(len, every))


def languages(cp: np.ndarray, starts: np.ndarray) -> list[str | None]:
    """The language whose function words hold most of each text's words."""
    kind = _Classes.get()[cp]
    s, e = spans((kind == 2) | (kind == 3))
    first = np.searchsorted(s, starts)
    keys, own, longest = _function_keys()
    short = np.flatnonzero(e - s <= longest)
    a, n, low = s[short], (e - s)[short], _Lower.get()
    word, fits = np.zeros(len(short), np.uint64), np.ones(len(short), bool)
    for k in range(longest):
        more = n > k
        char = low[cp[np.where(more, a + k, a)]]
        fits &= char < 256
        word = np.where(more, word << np.uint64(8) | char, word)
    at = np.minimum(np.searchsorted(keys, word), len(keys) - 1)
    hit = np.flatnonzero(fits & (keys[at] == word))
    doc = np.searchsorted(starts, a[hit], "right") - 1
    names = list(FUNCTION_WORDS)
    hits = [np.bincount(doc[o[at[hit]]], minlength=len(starts) - 1) for o in own]
    table, n = np.stack(hits, 1), np.diff(first)
    best = table.argmax(1)
    return [names[b] if c > 0 and c >= LEAST_SHARE * m else None for b, c, m in zip(best.tolist(), table.max(1).tolist(), n.tolist())]


def figures(ids: list[np.ndarray], chars: np.ndarray, bad: np.ndarray, less: np.ndarray | int = 0) -> np.ndarray:
    """Rows of characters per token, byte share and entropy share, a column for each
    text's ids; ``bad`` marks the tokens that are no whole character, ``less`` of
    which don't count."""
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    doc = np.repeat(np.arange(len(ids)), n)
    token = np.concatenate([np.empty(0, np.int64), *ids]).astype(np.int64)
    some = np.maximum(n, 1)
    fallback = np.maximum(0, np.bincount(doc, weights=bad[token], minlength=len(ids)) - less)
    # runs of equal tokens of a text are its counts
    key = np.sort(doc * len(bad) + token)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    own = key[first] // len(bad)
    p = np.diff(first, append=len(key)) / some[own]
    entropy = np.maximum(0.0, -np.bincount(own, weights=p * np.log2(p), minlength=len(ids)))
    most = np.log2(1 + some / (1 + some / SATURATION))
    return np.where(n > 0, np.stack([chars / some, fallback / some, entropy / most]), 0.0)


@functools.lru_cache(4)
def _parts(enc: ByteEncoder) -> np.ndarray:
    """Whether each token of a byte-level vocabulary is no run of whole characters."""
    byte = {c: b for b, c in enc.letters.items()}
    out = np.zeros(enc.lib.get_vocab_size(), bool)
    for token, i in enc.lib.get_vocab().items():
        if token not in enc.added:
            raw = bytes(byte[c] for c in token)
            out[i] = raw.decode("utf-8", "ignore").encode() != raw
    return out


def _fits(found: np.ndarray, band: Band | None) -> bool:
    return band is None or bool(band.chars_low <= found[0] <= band.chars_high and found[1] <= band.bytes_high and found[2] >= band.entropy_low)


def measure(texts: list, model_file: str, byte_file: str | None = None, bands: dict[str, Band] = BANDS, byte_bands: dict[str, Band] = BYTE_BANDS) -> dict[str, list]:
    """All result columns for a list of texts."""
    enc = Encoder.of(model_file)
    is_byte = np.zeros(enc.bpe.lib.get_piece_size(), bool)
    is_byte[enc.bpe.bytes] = True
    second = ByteEncoder.of(byte_file, SMALL_CACHE) if byte_file else None
    found: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    for _, part in slabs(texts, SMALL_SLAB):
        cp, starts = flat(part)
        got = base_counts(cp, starts)
        kinds, spoken = scripts(cp, starts), languages(cp, starts)
        failed = (got["n_words"] < 20) | (100 * got["n_repeat_words"] > 30 * got["n_words"])
        control = np.concatenate([[0], np.cumsum(cp < 32)])
        chars = np.diff(starts) - 1
        # line feeds and tabs are byte tokens too, but no fallback for lack of a piece
        piece = figures(enc.encode(part), chars, is_byte, control[starts[1:] - 1] - control[starts[:-1]])
        byte = figures(second.encode(part), chars, _parts(second)) if second else None
        for k in range(len(part)):
            script = _NAMES[kinds[k]]
            language = spoken[k] if script == "latin" else None
            name = language if language in bands else script
            fits = _fits(piece[:, k], bands[name]) and (byte is None or _fits(byte[:, k], byte_bands.get(name)))
            found["kept"].append(bool(fits and not failed[k]))
            found["script"].append(script)
            found["language"].append(language)
        for row, c in enumerate(("chars_per_token", "byte_share", "entropy_share")):
            found[c] += piece[row].tolist()
            found[f"byte_{c}"] += byte[row].tolist() if byte is not None else [None] * len(part)
        found["base_failed"] += failed.tolist()
        for c, v in got.items():
            found[c] += v.tolist()
    return found


def fit_bands(measured, labels, *, chars_room: float = 0.03, bytes_room: float = 0.10, entropy_room: float = 0.01, chars_high: float = 7.0,
              id_col: str = "doc_id") -> tuple[dict[str, Band], dict[str, Band]]:
    """The bands of each language and vocabulary from labelled documents, as arguments
    of ``quality_rules``: ``measured`` are its rows, ``labels`` (id, quality).  Of the
    rows with quality 1 that pass the base and whose crc32(id as text) mod 5 is not 0,
    the lowest characters per token less ``chars_room`` of it, the highest byte share
    plus ``bytes_room``, the lowest entropy share less ``entropy_room`` of it.  Rows of
    quality 0 and held-out rows take no part.  ``chars_high`` is no extreme of the rows
    but a bound beyond prose in these languages.  One row a language reaches the driver."""
    from pyspark.sql import functions as F

    good = labels.where("quality = 1").select(F.col(id_col).cast("long").alias("__id")).distinct()
    rows = measured.where(F.col("language").isNotNull() & ~F.col("base_failed") & (F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 != 0))
    seen = rows.join(good, F.col(id_col).cast("long") == F.col("__id"), "left_semi").groupBy("language").agg(*[
        how(f"{v}{c}").alias(f"{v}{c}") for v in ("", "byte_") for how, c in ((F.min, "chars_per_token"), (F.max, "byte_share"), (F.min, "entropy_share"))
    ]).collect()

    def of(v: str) -> dict[str, Band]:
        return {x.language: Band(x[f"{v}chars_per_token"] * (1 - chars_room), chars_high, x[f"{v}byte_share"] + bytes_room, x[f"{v}entropy_share"] * (1 - entropy_room))
                for x in seen if x[f"{v}chars_per_token"] is not None}

    return of(""), of("byte_")


def quality_rules(docs, model_file: str, byte_file: str | None = None, *, text_col: str = "text", bands: dict[str, Band] = BANDS,
                  byte_bands: dict[str, Band] = BYTE_BANDS):
    """All columns of ``docs`` plus those of ``SCHEMA``; a result column replaces
    an input column of the same name.  Without ``byte_file`` the byte-level
    vocabulary's figures are null and judge nothing."""
    from pyspark.sql import types as T

    from ._shared import parts

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    own = docs.drop(*[c for c in names if c in docs.columns and c != text_col])
    # input columns go by place through the Python function, whatever they are called
    passed, place = own.toDF(*[f"c{k}" for k in range(len(own.columns))]), own.columns.index(text_col)
    schema = T.StructType([*passed.schema.fields, *T._parse_datatype_string(SCHEMA).fields])

    def run(batches):
        import pyarrow as pa

        kind = dict(zip(names, (c.split()[1] for c in SCHEMA.split(", "))))
        arrow = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}
        for batch in batches:
            held = batch.column(place).to_pylist()
            for a, b in parts(held):
                part = batch.slice(a, b - a)
                found = measure(held[a:b], model_file, byte_file, bands, byte_bands)
                arrays = [pa.array(found[c], arrow[kind[c]]) for c in names]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*part.schema.names, *names])

    return passed.mapInArrow(run, schema).toDF(*own.columns, *names)
