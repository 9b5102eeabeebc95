"""Quality rules by compression bands.

Zstandard ratios (compressed bytes over bytes) of the whole document and of fixed chunks are
held against limits that depend on the length: a ratio under the lower limit means repetitive
text, one over the upper limit incompressible text. The word rules of the contract (too few
words, repeated five-word windows) come first.

Limits depend on how many bytes the script's characters take as well, for texts and for each chunk.

Defined results: a null or empty text has no words and fails the word rules; its ratio is null. A very long text is judged whole, in time in
proportion to its length. Repeated rows are judged one by one; an empty table gives an empty one. Columns other than ``doc_id`` and ``text`` aren't read.
"""

from __future__ import annotations

import bisect

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACE, map_rows

LEVEL = 3
#: A rest of at most half a chunk belongs to the chunk before it: on its own, the ratio of so little text says nothing.
CHUNK_BYTES = 4096
#: A document fails when over this share of its chunks is outside the chunk's band.
BAD_CHUNK_SHARE = 0.25
#: (bytes up to which the band holds, least ratio, greatest ratio), for scripts of one or two bytes a character. Short inputs compress badly, so their
#: upper limit is loose; long ones share more, so their lower limit falls. From 257 bytes on the upper limits lie
#: between prose and random letters and digits; up to 256 the ratios of the two overlap.
BANDS = (
    (64, 0.0, 9.0),
    (256, 0.30, 1.15),
    (512, 0.25, 0.83),
    (1024, 0.25, 0.78),
    (4096, 0.20, 0.72),
    (32768, 0.15, 0.66),
    (float("inf"), 0.10, 0.62),
)
#: The same for scripts of three or four bytes a character, whose prose has more in each byte: Chinese has a ratio of 0.94 at 256 bytes, 0.84 at 512 and 0.76 at
#: 1000, which is also what random characters have (0.94, 0.85, 0.78, and 0.72 without end). So only what is denser than these is held incompressible.
WIDE_BANDS = (
    (64, 0.0, 9.0),
    (256, 0.30, 1.25),
    (512, 0.25, 1.10),
    (1024, 0.25, 1.00),
    (4096, 0.20, 0.92),
    (32768, 0.15, 0.85),
    (float("inf"), 0.10, 0.85),
)
#: First bytes of characters of three and four bytes, and from which share of such characters' bytes on a text is of a wide script.
LEADS = bytes(range(0xE0, 0xF5))
WIDE_SHARE = 0.3
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, bad_chunks int, verdict string"
)


def band(size: int, wide: bool = False) -> tuple[float, float]:
    """The least and greatest ratio for ``size`` bytes."""
    bands = WIDE_BANDS if wide else BANDS
    _, low, high = bands[bisect.bisect_left([b[0] for b in bands], size)]
    return low, high


def is_wide(text: bytes) -> bool:
    return 3 * (len(text) - len(text.translate(None, LEADS))) >= WIDE_SHARE * len(text)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in a window of ``window`` words that the text holds twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
    kinds = len(number)
    if kinds == n:
        return 0
    code, width = ids, 1
    # Codes stay exact: a window's code is ranked again before the next word would overflow it.
    span = kinds
    while width < window:
        if span > (1 << 62) // kinds:
            code = np.unique(code, return_inverse=True)[1]
            span = int(code.max()) + 1
        code = code[: n - width] * kinds + ids[width:]
        span *= kinds
        width += 1
    ordered = np.sort(code)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    twice = np.unique(ordered[1:][same])
    at = np.searchsorted(twice, code)
    starts = np.flatnonzero(twice[np.minimum(at, len(twice) - 1)] == code)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    count = 0
    for line in text.split(b"\n"):
        if line in seen:
            count += 1
        elif line.strip(SPACE):
            seen.add(line)
    return count


def make_judge():
    """A function from (doc_id, text) rows to rows of SCHEMA."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)

    def judge(rows: list) -> list:
        out = []
        for doc_id, text in rows:
            text = text or b""
            words = text.split()
            n = len(words)
            inside = text.translate(None, SPACE)
            chars = len(inside.decode("utf-8", "surrogatepass"))
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            repeats = repeated_words(words)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            ratio = len(squeeze.compress(text)) / len(text) if text else None
            bad = chunks = 0
            if len(text) > CHUNK_BYTES:
                starts = [*range(0, len(text) - CHUNK_BYTES // 2, CHUNK_BYTES)]
                for start, stop in zip(starts, [*starts[1:], len(text)]):
                    piece = text[start:stop]
                    low, high = band(len(piece), is_wide(piece))
                    chunks += 1
                    bad += not low <= len(squeeze.compress(piece)) / len(piece) <= high
            low, high = band(len(text), is_wide(text))
            if ratio is None or ratio < low:
                verdict = "repetitive" if text else "empty"
            elif ratio > high:
                verdict = "incompressible"
            else:
                verdict = "chunks" if bad > BAD_CHUNK_SHARE * chunks else "ok"
            out.append((doc_id, n, chars, symbols, duplicate_lines(text), repeats, failed, not failed and verdict == "ok", ratio, bad, verdict))
        return out

    return judge


def compression_bands(documents: DataFrame) -> DataFrame:
    """One row of SCHEMA for each row of ``documents``; ``verdict`` names the rule that rejects."""
    return map_rows(documents.select(F.col("doc_id").cast("long"), F.col("text")), make_judge, SCHEMA)
