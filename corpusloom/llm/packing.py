"""Best-two-fit packing of tokenised documents into sequences.

Tokenising makes thin rows (document, piece, length, checksum). What packing needs of them is
the number of pieces of each length, at most ``SEQUENCE`` numbers at any scale. On this histogram
the plan is made: a sequence is filled greedily with the longest pieces that fit, then its smallest
piece is replaced by the two unpacked pieces that fill the expanded gap most tightly; the filled
sequence is a pattern that is used as often as the histogram has its pieces. Pieces then find
their place from their rank within their length, which a distributed prefix sum gives, so no
task sees more than a slice of a length, and the plan is a short table whatever the input.

Defined results: a null text is tokenised as an empty one, which is one piece of the closing id
alone. Texts of any length are tokenised whole; an empty table gives no pieces. Rows that repeat a doc_id are packed one by one. Ties of rank (equal rows) may fall either
way, each place is given once. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import sliced, text_bytes
from corpusloom.runtime import stash

SEQUENCE = 2048
CLOSING_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps, about 200 bytes each.
CACHE_WORDS = 400_000
#: New words encoded as one string, and what stands between them: a character that is a token of its own.
JOINED_WORDS = 2048
MARK = "\x01"
#: Slices of each length for the ranks.
SLICES = 256

PIECE_SCHEMA = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> dict[int, str]:
    """The characters that byte-level vocabularies write bytes as: printable ones as themselves, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Words that need no more than splitting and lower-casing: ASCII without apostrophes, and precomposed Latin letters
#: (without U+0130, whose lower case is two characters).
LATIN = "a-zß-öø-ÿā-įı-ſ"
PLAIN = re.compile("[!-&(-~À-ÖØ-öø-įı-ſ]+")
PARTS = re.compile(rf"[{LATIN}]+|[0-9]|[^{LATIN}0-9]+")


#: How a tokenizer file must say that it normalises and splits texts for its words' ids to be put together by the rules here.
ASSUMED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class Words:
    """Ids of whole texts, put together from cached ids of their words, or by the whole tokenizer where it isn't as ASSUMED.

    The tokenizer lower-cases, drops white space and never joins characters across it, so a text's ids are its
    words' ids one after the other. A plain word (PLAIN) is cut into runs of letters, single digits and runs of
    other characters, as the tokenizer does, and its vocabulary's merges are applied to each. Other new words go
    through the whole tokenizer, many at a time as one string with MARK between them; a word that holds MARK
    itself goes alone. The tests hold the result against whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        stated = json.loads(self.tokenizer.to_str())
        self.by_words = all(stated[k] == v for k, v in ASSUMED.items()) and stated["model"]["type"] == "BPE" and all("<|" in t["content"] for t in stated["added_tokens"])
        self.merge = self.tokenizer.model.tokenize
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.letters = byte_characters()
        self.cache: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def part(self, part: str) -> bytes:
        """The ids of a run of letters, a digit or a run of other characters."""
        found = self.parts.get(part)
        if found is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found = self.parts[part] = self.packed([token.id for token in self.merge(shown)])
        return found

    def learn(self, words: list[bytes]) -> None:
        """Put the ids of new words into the cache."""
        others = []
        for word in words:
            text = word.decode("utf-8", "surrogatepass")
            if PLAIN.fullmatch(text) and "<|" not in text:
                self.cache[word] = b"".join(map(self.part, PARTS.findall(text.lower())))
            else:
                others.append(word)
        mark = MARK.encode()
        joined = [w for w in others if mark not in w] if len(self.mark) == 1 else []
        groups = [joined[i : i + JOINED_WORDS] for i in range(0, len(joined), JOINED_WORDS)]
        texts = [(b" " + mark + b" ").join(group).decode("utf-8", "surrogatepass") for group in groups]
        for group, encoded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(encoded.ids, "<u4")
            raw = ids.tobytes()
            ends = [*(4 * np.flatnonzero(ids == self.mark[0])).tolist(), len(raw)]
            start = 0
            for word, end in zip(group, ends, strict=True):
                self.cache[word] = raw[start:end]
                start = end + 4
        for word in others:
            if word not in self.cache:
                self.cache[word] = self.packed(self.tokenizer.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        if not self.by_words:
            whole = self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)
            return [self.packed(e.ids) for e in whole]
        cache = self.cache
        for known in (cache, self.parts):
            if len(known) > CACHE_WORDS:
                # Frequent words come early, so those that came last go.
                for word in list(known)[CACHE_WORDS // 2 :]:
                    del known[word]
        # The names of special tokens are matched before lower-casing.
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if new := [w for w in set(itertools.chain.from_iterable(split)) if w not in cache]:
            self.learn(new)
        find = cache.__getitem__
        return [b"".join(map(find, words)) for words in split]


_WORDS: dict[str, Words] = {}


def words_of(path: str) -> Words:
    """The tokenizer and its cache, kept from task to task."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def tokenised(documents: DataFrame, path: str | None = None) -> DataFrame:
    """One row of PIECE_SCHEMA for each piece of each document; ``row`` tells repeated documents apart."""
    path = path or tokenizer_path()

    def run(batches):
        words = words_of(path)
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for part in sliced(batches):
            texts = [t or b"" for t in text_bytes(part.column(1))]
            out = []
            for doc_id, row, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), words.ids(texts)):
                ids += closing
                for piece, at in enumerate(range(0, len(ids), 4 * SEQUENCE)):
                    own = ids[at : at + 4 * SEQUENCE]
                    out.append((doc_id, row, piece, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, PIECE_SCHEMA)


def fill(counts: np.ndarray, size: int) -> list[int]:
    """The lengths of one sequence from the pieces that ``counts`` still has: greedy, then best two for the smallest."""
    left, room, chosen = counts.copy(), size, []
    while room > 0:
        fits = np.flatnonzero(left[: room + 1])
        if not len(fits):
            break
        length = int(fits[-1])
        take = min(int(left[length]), room // length)
        chosen += [length] * take
        left[length] -= take
        room -= take * length
    if room and len(chosen) > 1:
        smallest = chosen[-1]
        gap = room + smallest
        # Two pieces that fit the gap and leave less of it than the smallest piece does.
        there = np.flatnonzero(left[: gap + 1])
        there = there[there > 0]
        if len(there):
            partner_limit = gap - there
            index = np.searchsorted(there, partner_limit, "right") - 1
            ok = index >= 0
            partner = there[np.maximum(index, 0)]
            # The same length twice needs two pieces; otherwise the next smaller length is the partner.
            twin = ok & (partner == there) & (left[there] < 2)
            lower = index - 1
            partner = np.where(twin, there[np.maximum(lower, 0)], partner)
            ok &= ~twin | (lower >= 0)
            total = np.where(ok, there + partner, 0)
            best = int(total.argmax())
            if total[best] > smallest:
                chosen = [*chosen[:-1], *sorted((int(there[best]), int(partner[best])), reverse=True)]
    return chosen


def plan(histogram: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): pieces of ``length`` with these ranks go to consecutive sequences at ``offset``."""
    counts = histogram.astype(np.int64).copy()
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    while counts.any():
        lengths = fill(counts, size)
        kinds, need = np.unique(lengths, return_counts=True)
        times = int((counts[kinds] // need).min())
        offset = 0
        for length in lengths:
            rows.append((length, int(used[length]), times, sequence, offset))
            used[length] += times
            offset += length
        counts[kinds] -= need * times
        sequence += times
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, a number from 0 without gaps within each length."""
    rows = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(SLICES)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # At most SEQUENCE x SLICES rows, whatever the input.
    starts = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n")).select("length", "slice", before.alias("slice_start"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("doc_id", "row", "piece"))
    return rows.withColumn("inside", inside).join(starts, ["length", "slice"]).withColumn("rank", F.col("slice_start") + F.col("inside") - 1)


def pack(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece."""
    pieces = stash(tokenised(documents, path), "pieces")
    histogram = np.zeros(SEQUENCE + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():
        histogram[row["length"]] = row["count"]
    rows = np.array(sorted(plan(histogram)), np.int64).reshape(-1, 5)
    # (length, first rank) in one number, so that one binary search finds a piece's row of the plan.
    stride = int(histogram.max()) + 1
    keys = rows[:, 0] * stride + rows[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * stride + rank, "right") - 1
            sequence = rows[at, 3] + rank - rows[at, 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence, pa.int64()), pa.array(rows[at, 4], pa.int64())], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    thin = ranked(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return thin.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
