"""Quality rules: base counts of words, lines and repeats, and zstandard compression bands."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import BLANKS, add_columns, free_name

SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Band:
    """Compressed size over size must lie in [low, high] for a text (or chunk) of up to ``up_to`` bytes."""

    up_to: float
    low: float
    high: float


# A frame header weighs on short texts and long texts have more to refer back to, so limits fall with length.
# Prose lies inside; text said over and over falls below, encoded bytes (six bits a byte in base64) rise above.
# Up to 160 bytes neither prose nor noise shrinks, so there only repetition can be told apart.
BANDS = (Band(160, 0.30, 1.25), Band(192, 0.25, 0.95), Band(256, 0.22, 0.88), Band(384, 0.15, 0.84), Band(512, 0.15, 0.79), Band(768, 0.15, 0.76),
         Band(1024, 0.15, 0.72), Band(2048, 0.13, 0.68), Band(4096, 0.13, 0.63), Band(16384, 0.11, 0.55), Band(float("inf"), 0.09, 0.50))
CHUNK = 4096
CHUNK_BAND = Band(CHUNK, 0.13, 0.60)
BAD_SHARE = 0.25
# Limits for corpora of natural prose: lower ones lie two to four percent below the first percentile of the learning rows labelled 1 (none of
# which is over 33 KB; longer texts refer back to more, so they may shrink further). Text that says little new for its length falls below.
PROSE_BANDS = (Band(160, 0.60, 1.25), Band(192, 0.60, 0.95), Band(256, 0.58, 0.88), Band(384, 0.57, 0.84), Band(512, 0.57, 0.79), Band(768, 0.525, 0.76), Band(1024, 0.50, 0.72),
               Band(2048, 0.47, 0.68), Band(4096, 0.445, 0.63), Band(8192, 0.42, 0.55), Band(16384, 0.405, 0.55), Band(65536, 0.38, 0.50), Band(float("inf"), 0.30, 0.50))
PROSE_CHUNK = Band(CHUNK, 0.435, 0.60)

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_bytes long, ratio double, bad_chunks double")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words that lie in some window of words that the text has twice or more, first ones included.

    Windows become integers by doubling (exact: every pair of ranks gets its own rank), so memory is a few
    integers a word, also for very long texts.
    """
    n = len(words)
    if n <= window:
        return 0
    rank: dict[bytes, int] = {}
    single = np.fromiter((rank.setdefault(w, len(rank)) for w in words), np.int64, n)
    if len(rank) == n:
        return 0
    code, width = single, 1
    while width < window:
        step = min(width, window - width)  # overlap is harmless: both parts lie inside the window
        tail = code if step == width else _ranks_of(single, step)
        m = n - width - step + 1
        code = np.unique(code[:m] * n + tail[width:width + m], return_inverse=True)[1]
        width += step
    again = np.bincount(code)[code] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _ranks_of(single: np.ndarray, width: int) -> np.ndarray:
    n, code = len(single), single
    for k in range(1, width):
        m = n - k
        code = np.unique(code[:m] * n + single[k:], return_inverse=True)[1]
    return code


def measurer(bands=BANDS, chunk: int = CHUNK, chunk_band: Band = CHUNK_BAND, bad_share: float = BAD_SHARE):
    """Row function for one task: whole text -> the fields in FIELDS."""
    press = zstandard.ZstdCompressor(level=3)

    def outside(data: bytes, band: Band) -> tuple[float, bool]:
        ratio = len(press.compress(data)) / len(data)
        return ratio, not band.low <= ratio <= band.high

    def measure(text: str | None) -> tuple:
        data = (text or "").encode()
        words = data.split()
        n = len(words)
        solid = len(data.translate(None, BLANKS))
        chars = len(text or "") - (len(data) - solid)
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        lines = [x for x in data.split(b"\n") if x.strip(BLANKS)]
        repeats = repeated_words(words)
        failed = n < 10 or 100 * repeats > 20 * n
        ratio, share, good = None, 0.0, True
        if data:
            ratio, bad = outside(data, next(b for b in bands if len(data) <= b.up_to))
            if len(data) > chunk:  # a shorter text is its own chunk
                cuts = [*range(0, len(data) - chunk, chunk), len(data) - chunk]  # the last one reaches back to be full
                share = sum(outside(data[i:i + chunk], chunk_band)[1] for i in cuts) / len(cuts)
            good = not bad and share <= bad_share
        return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, good and not failed, len(data), ratio, share

    return measure


def measured(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs with the columns of FIELDS appended.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    line), n_repeat_words (words in five-word windows found twice or more), base_failed (under ten words, or
    over a fifth of the words repeated), kept: not base_failed and zstandard's ratio of the whole text lies in
    the band of its length and no more than ``bad_share`` of its chunks leave the chunk band (all of a text's bytes are in some chunk).
    NULL and empty texts: all counts 0, ratio NULL, base_failed, not kept. Every row is judged by itself, so
    ties, repeated rows and an empty table need no rule. Input columns that have one of these names give way
    to the measured ones.
    """
    narrow = docs.drop(*[c for c in docs.columns if c.lower() in {f.split()[0] for f in FIELDS.split(", ")} and c != text])
    return add_columns(narrow, text, lambda: measurer(**limits), FIELDS)


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of docs whose text is kept; all columns as they were."""
    kept = free_name(docs, "__kept")
    make = lambda: (lambda f: lambda t: (f(t)[6],))(measurer(**limits))
    return add_columns(docs, text, make, f"{kept} boolean").where(F.col(kept)).drop(kept)

