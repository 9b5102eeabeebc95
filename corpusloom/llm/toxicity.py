"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Each word has two hashes into two embedding tables whose rows are added, so that two words
share an embedding only if both hashes collide; the hashes of its prefixes of PREFIXES bytes have
a table each, so that inflected and compounded forms share what their stem has learned. Filters of several widths run over the word
sequence, the maximum over the whole text is pooled, and a logistic unit reads the pooled
values. Only embeddings of words that differ significantly between the
classes in training are learned; those of other words are zero, so they stay neutral. A threshold is
calibrated for each language (guessed from the text itself: function words for those written in Latin letters, the letters'
script for others) on part of
the training rows, and the score is shifted so that the threshold lies at ``CUT``. In scripts
without spaces each character is a word, of which the filters see up to three in a row.

Training takes a bounded sample of labelled rows outside the held-out part: ``TRAIN_POSITIVE`` and
``TRAIN_NEGATIVE`` rows, chosen by a hash of the id, and of these no more than ``TRAIN_BYTES`` of text for a class, no text over
``TRAIN_TEXT_BYTES``. Scoring reads whole texts.

Defined results: a null or empty text is scored as a text without words. With no labelled rows of
both classes every score is 0. Labels that repeat an id with different values count one by one, and so do
repeated rows of documents. An empty table gives an empty one.
Only ``doc_id`` and ``text`` are read, and in training ``toxic``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, sliced, text_bytes
from corpusloom.runtime import drop, stash

TRAIN_POSITIVE = 4000
TRAIN_NEGATIVE = 6000
#: Bytes of text of a class that the sample has, and of one text in it. Of its words only those near learned ones go to the driver, 8 bytes each.
TRAIN_BYTES = 32_000_000
TRAIN_TEXT_BYTES = 400_000
TABLE_BITS = 16
PREFIXES = (4, 5)
TABLES = 2 + len(PREFIXES)
MIN_DOCS = 3
#: Standard deviations by which a word's share of toxic texts must differ from its share of others to be learned.
SIGNIFICANT = 4.0
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
EPOCHS = 8
BATCH = 32
#: Small samples are gone through more often.
MIN_STEPS = 1500
RATE = 0.1
START = 0.1
#: The score at the calibrated threshold of every language.
CUT = 0.3
#: Positive and negative calibration rows that a language needs for a threshold of its own.
MIN_CALIBRATION = 15
LOGIT_CUT = float(np.log(CUT / (1 - CUT)))

#: Function words that tell languages apart (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for with be by on are this from at",
    "fr": "le la les des et un une du que qui dans pour sur par avec est en au",
    "de": "der die das und ist nicht ein eine zu den mit von im auf dem sich des es",
    "es": "el la los las y que en un una por con para del se es no su lo",
}
#: Scripts by the first bytes of their letters in UTF-8, both ends included.
SCRIPTS = {
    "greek": (0xCD, 0xCF), "cyrillic": (0xD0, 0xD4), "armenian_hebrew": (0xD5, 0xD7), "arabic": (0xD8, 0xDF), "indic_thai": (0xE0, 0xE1), "han_kana": (0xE3, 0xE9), "hangul": (0xEA, 0xED),
}
LANGUAGES = ("other", *FUNCTION_WORDS, *SCRIPTS)
#: First bytes of characters that are words of their own (three bytes each).
SINGLE = (0xE3, 0xE9)

SCHEMA = "doc_id long, held_out boolean, score double, predicted int, language string"

_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, _INVERSE)):
                steps = np.full(size + 1, base, np.uint64)
                steps[0] = 1
                _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mixed(codes: np.ndarray) -> np.ndarray:
    """Codes whose bits all depend on all of the hash's bits."""
    codes = codes ^ (codes >> np.uint64(29))
    codes *= np.uint64(0xBF58476D1CE4E5B9)
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(29))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words (runs of letters and digits, A to Z lower-cased) of all texts: 64-bit hashes, embedding rows (TABLES for each word); where each text's words begin."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    inside = _IS_WORD[joined]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    single = np.flatnonzero((joined >= SINGLE[0]) & (joined <= SINGLE[1]))
    if len(single):
        begins[single] = True
        behind = np.minimum(single + 3, len(joined) - 1)
        begins[behind] |= inside[behind]
    starts = np.flatnonzero(begins)
    stops = begins | ~inside
    ends = np.flatnonzero(stops[1:] & inside[:-1]) + 1
    up, down = powers(len(joined))
    mask = np.uint64((1 << TABLE_BITS) - 1)
    slots = np.empty((len(starts), TABLES), np.uint16)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64, out=sums[1:])
        first, scale = sums[starts], down[starts]
        codes = mixed((sums[ends] - first) * scale)
        slots[:, 0] = codes & mask
        slots[:, 1] = (codes >> np.uint64(TABLE_BITS)) & mask
        for k, width in enumerate(PREFIXES, 2):
            slots[:, k] = mixed((sums[np.minimum(starts + width, ends)] - first) * scale + np.uint64(k)) & mask
    text_starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)]) if len(texts) else np.zeros(0, np.int64)
    return codes, slots, np.searchsorted(starts, text_starts)


_WORD_LANGUAGE: tuple[np.ndarray, np.ndarray] | None = None


def language_votes(codes: np.ndarray) -> np.ndarray:
    """For each word and language of LANGUAGES 1 where the word is one of its function words."""
    global _WORD_LANGUAGE
    if _WORD_LANGUAGE is None:
        table: dict[int, np.ndarray] = {}
        for i, words in enumerate(FUNCTION_WORDS.values(), 1):
            for word in words.split():
                table.setdefault(int(word_hashes([word.encode()])[0][0]), np.zeros(len(LANGUAGES), np.float32))[i] = 1
        keys = np.array(sorted(table), np.uint64)
        _WORD_LANGUAGE = keys, np.array([table[int(k)] for k in keys] + [np.zeros(len(LANGUAGES))], np.float32)
    keys, votes = _WORD_LANGUAGE
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return votes[np.where(keys[at] == codes, at, len(keys))]


def by_text(values: np.ndarray, starts: np.ndarray, how: np.ufunc, empty: float) -> np.ndarray:
    """``how`` over each text's rows of ``values``; texts without rows get ``empty``."""
    out = np.full((len(starts), values.shape[1]), empty, np.float32)
    ends = np.append(starts[1:], len(values))
    full = ends > starts
    if full.any():
        out[full] = how.reduceat(values, starts[full], axis=0)
    return out


def languages_of(texts: list[bytes], codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each text its place in LANGUAGES: the script of most of its bytes, else the language of most function words."""
    votes = by_text(language_votes(codes), starts, np.add, 0)
    found = np.where(votes.max(1) > 0, votes.argmax(1), 0)
    first = len(LANGUAGES) - len(SCRIPTS)
    for i, text in enumerate(texts):
        if not text.isascii():
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            letters = [counts[low : high + 1].sum() for low, high in SCRIPTS.values()]
            # Letters of these scripts against Latin ones.
            if 2 * sum(letters) > counts[97:123].sum() + counts[65:91].sum() + counts[0xC3:0xC6].sum():
                found[i] = first + int(np.argmax(letters))
    return found


class Net:
    """The classifier's numbers; small enough (8 MB) to be part of a task's closure."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = [np.zeros((1 << TABLE_BITS, DIM), np.float32) for _ in range(TABLES)]
        self.filters = [rng.normal(0, 0.5, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
        self.bias = np.full(len(WIDTHS) * FILTERS, 0.05, np.float32)
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.base = np.float32(0)
        self.thresholds = np.zeros(len(LANGUAGES), np.float32)

    def words(self, slots: np.ndarray) -> np.ndarray:
        """Embeddings, one row for each row of table places."""
        found = self.tables[0][slots[:, 0]]
        for k in range(1, TABLES):
            found += self.tables[k][slots[:, k]]
        return found

    def convolved(self, slots: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """For each width the filter values at every word; windows that leave their text are cut off at its end."""
        words = self.words(slots)
        n = len(words)
        ends = np.append(starts[1:], n)
        left = np.repeat(ends, ends - starts) - np.arange(n) if n else np.zeros(0, np.int64)
        outs = []
        for kernel in self.filters:
            value = words @ kernel[0]
            for j in range(1, len(kernel)):
                inner = np.flatnonzero(left > j)
                value[inner] += words[inner + j] @ kernel[j]
            outs.append(value)
        return outs

    def logits(self, slots: np.ndarray, starts: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([by_text(v, starts, np.maximum, 0) for v in self.convolved(slots, starts)], axis=1)
        return np.maximum(pooled + self.bias, 0) @ self.out + self.base

    def gradients(self, slots: np.ndarray, starts: np.ndarray, wanted: np.ndarray) -> tuple:
        """Of the mean logistic loss of a batch, by (bias, out, base, filters, words that took part, their embeddings)."""
        values = self.convolved(slots, starts)
        ends = np.append(starts[1:], len(slots))
        best = np.full((len(starts), len(WIDTHS) * FILTERS), -1, np.int64)
        pooled = np.zeros(best.shape, np.float32)
        for i, (s, e) in enumerate(zip(starts, ends)):
            if e > s:
                for k, v in enumerate(values):
                    at = v[s:e].argmax(0)
                    best[i, k * FILTERS : (k + 1) * FILTERS] = s + at
                    pooled[i, k * FILTERS : (k + 1) * FILTERS] = v[s + at, np.arange(FILTERS)]
        hidden = pooled + self.bias
        active = np.maximum(hidden, 0)
        error = (1 / (1 + np.exp(-(active @ self.out + self.base))) - wanted).astype(np.float32) / len(starts)
        back = np.outer(error, self.out) * (hidden > 0)
        new_filters = [np.zeros_like(k) for k in self.filters]
        rows, grads = [], []
        for k, kernel in enumerate(self.filters):
            for f in range(FILTERS):
                c = k * FILTERS + f
                use = np.flatnonzero((back[:, c] != 0) & (best[:, c] >= 0))
                for j in range(len(kernel)):
                    at = best[use, c] + j
                    inner = at < ends[use]
                    at, g = at[inner], back[use[inner], c][:, None]
                    words = self.words(slots[at])
                    new_filters[k][j, :, f] += (words * g).sum(0)
                    rows.append(at)
                    grads.append(g * kernel[j, :, f])

        found = (np.concatenate(rows), np.concatenate(grads)) if rows else (np.zeros(0, np.int64), np.zeros((0, DIM), np.float32))
        return back.sum(0), error @ active, error.sum(), new_filters, *found

    def step(self, slots: np.ndarray, starts: np.ndarray, wanted: np.ndarray, square: list, learned: np.ndarray) -> None:
        """One Adagrad step on the mean logistic loss of a batch; ``learned``: (TABLES, rows) that may move."""
        new_bias, new_out, new_base, new_filters, rows, grads = self.gradients(slots, starts, wanted)

        def adagrad(value, grad, at):
            square[at] += grad * grad
            value -= RATE * grad / np.sqrt(square[at] + 1e-8)

        adagrad(self.bias, new_bias, 0)
        adagrad(self.out, new_out, 1)
        square[2] += new_base * new_base
        self.base -= np.float32(RATE * new_base / np.sqrt(square[2] + 1e-8))
        for k, grad in enumerate(new_filters):
            adagrad(self.filters[k], grad, 3 + k)
        if len(rows):
            for t in range(TABLES):
                used, inverse = np.unique(slots[rows, t], return_inverse=True)
                total = np.zeros((len(used), DIM), np.float32)
                np.add.at(total, inverse, grads)
                memory = square[3 + len(WIDTHS) + t]
                total *= learned[t, used][:, None]
                memory[used] += (total * total).mean(1, keepdims=True)
                self.tables[t][used] -= RATE * total / np.sqrt(memory[used] + 1e-8)


def labelled(documents: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """The written rows that the bounded training sample is of, and the sample (doc_id, text, toxic); None without rows of both classes."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = F.when(F.col("toxic") == 1, min(1.0, TRAIN_POSITIVE / counts[1])).otherwise(min(1.0, TRAIN_NEGATIVE / counts[0]))
    # The bound on the sample bounds what is sent to each executor here.
    chosen = F.broadcast(marked.where(place < share).withColumn("place", place / share))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_TEXT_BYTES).join(chosen, "doc_id")
    written = stash(rows, "labelled")
    sizes = {r["toxic"]: r["size"] or 0 for r in written.groupBy("toxic").agg(F.sum(F.octet_length("text")).alias("size")).collect()}
    part = lambda c: min(1.0, TRAIN_BYTES / max(sizes.get(c, 0), 1))
    return written, written.where(F.col("place") < F.when(F.col("toxic") == 1, part(1)).otherwise(part(0))).select("doc_id", "text", "toxic")


def order_of(doc_id: int) -> int:
    """A training row's place; a fifth of the places calibrates."""
    return zlib.crc32(b"order %d" % doc_id)


def is_tuning(doc_id: int) -> bool:
    return order_of(doc_id) % 5 == 0


def place_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts have each embedding place, (part, class, table, place), and how many texts there are, (part, class); part 1 calibrates.

    Counted on the executors; what comes to the driver is at most four numbers for each place that MIN_DOCS texts have.
    """
    size = TABLES << TABLE_BITS
    names = ("a", "b", "c", "d")

    def run(batches):
        counts = np.zeros((size + 1, 4), np.int32)
        for part in sliced(batches):
            _, slots, starts = word_hashes([t or b"" for t in text_bytes(part.column(1))])
            for doc_id, toxic, own in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), np.split(slots, starts[1:])):
                at = 2 * is_tuning(doc_id) + toxic
                counts[size, at] += 1
                for t in range(TABLES):
                    counts[(t << TABLE_BITS) + np.unique(own[:, t]).astype(np.int64), at] += 1
        used = np.flatnonzero(counts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(counts[used, k]) for k in range(4))], ["place", *names])

    summed = rows.mapInArrow(run, "place int, a int, b int, c int, d int").groupBy("place").agg(*(F.sum(c).cast("int").alias(c) for c in names))
    got = summed.where(sum((F.col(c) for c in names), F.lit(0)) >= F.when(F.col("place") == size, 1).otherwise(MIN_DOCS)).toArrow()
    counts = np.zeros((size + 1, 4), np.int64)
    for k, c in enumerate(names):
        counts[got["place"].to_numpy(), k] = got[c].to_numpy()
    return counts[:size].T.reshape(2, 2, TABLES, 1 << TABLE_BITS), counts[size].reshape(2, 2)


def telling(docs: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(TABLES, places) where a place is in at least MIN_DOCS texts and more (or less) often in toxic ones than chance explains.

    ``docs``: texts that have a place, (class, table, place); ``n``: texts of a class.
    """
    share = docs.sum(0) / n.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (docs.sum(0) >= MIN_DOCS) & (np.abs(docs[1] / n[1] - docs[0] / n[0]) >= SIGNIFICANT * spread)


def near_telling(slots: np.ndarray, learned: np.ndarray) -> np.ndarray:
    """Which words of a text a filter's value can depend on: those with a learned place, and so many around them that every window keeps its words.

    Other words are zero in training. Of a longer run of them enough stay for a window of nothing else.
    """
    reach = max(WIDTHS) - 1
    telling_ = np.zeros(len(slots), bool)
    for t in range(TABLES):
        telling_ |= learned[t, slots[:, t]]
    keep = telling_.copy()
    for k in range(1, reach + 1):
        keep[:-k] |= telling_[k:]
        keep[k:] |= telling_[:-k]
    keep[: 2 * reach] = keep[-2 * reach :] = True
    return keep


def samples(rows: DataFrame, learned: np.ndarray) -> list:
    """The sample as rows (place, toxic, language, table places of the words that matter), made on the executors."""

    def run(batches):
        for part in sliced(batches):
            texts = [t or b"" for t in text_bytes(part.column(1))]
            codes, slots, starts = word_hashes(texts)
            split = [x[near_telling(x, learned)].tobytes() for x in np.split(slots, starts[1:])] if texts else []
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(languages_of(texts, codes, starts), pa.int32()), pa.array(split, pa.binary())], ["doc_id", "toxic", "language", "slots"])

    got = rows.mapInArrow(run, "doc_id long, toxic int, language int, slots binary").toArrow().to_pylist()
    found = [(order_of(r["doc_id"]), r["toxic"], r["language"], np.frombuffer(r["slots"], np.uint16).reshape(-1, TABLES)) for r in got]
    return sorted(found, key=lambda r: (*r[:3], len(r[3])))


def batch_of(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Table places, starts and labels of training rows, laid end to end."""
    sizes = [len(r[3]) for r in rows]
    starts = np.concatenate([[0], np.cumsum(sizes[:-1])]).astype(np.int64)
    return np.concatenate([r[3] for r in rows]), starts, np.array([r[1] for r in rows], np.float32)


def best_threshold(logits: np.ndarray, wanted: np.ndarray) -> float:
    """The logit between two rows at which F1 is greatest (the middle of the gap)."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(wanted[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + wanted.sum())
    k = int(f1.argmax())
    low = logits[order[k + 1]] if k + 1 < len(order) else logits[order[k]] - 1
    return float((logits[order[k]] + low) / 2)


def fit(documents: DataFrame, labels: DataFrame) -> Net | None:
    """Train on the sample and calibrate on a fifth of it; None without rows of both classes."""
    found = labelled(documents, labels)
    if found is None:
        return None
    written, chosen = found
    docs, n = place_counts(chosen)
    if not n.sum(0).all():
        return None
    apart = bool(n.all())
    learned = telling(docs[0], n[0]) if apart else telling(docs.sum(0), n.sum(0))
    rows = samples(chosen, learned)
    drop(written)
    # Too few rows for parts of both classes train and calibrate alike.
    tune = [r for r in rows if r[0] % 5 == 0] if apart else rows
    train = [r for r in rows if r[0] % 5] if apart else rows
    net = Net()
    shapes = [net.bias, net.out, np.zeros(()), *net.filters]
    square = [np.zeros_like(s, dtype=np.float32) for s in shapes] + [np.zeros((1 << TABLE_BITS, 1), np.float32) for _ in range(TABLES)]
    square[2] = 0.0
    learned = learned.astype(np.float32)
    # Small random values, so that the maximum, and with it the first gradients, falls on any word of a text.
    rng = np.random.default_rng(11)
    for t in range(TABLES):
        net.tables[t][:] = rng.normal(0, START, net.tables[t].shape) * learned[t][:, None]
    for _ in range(max(EPOCHS, -(-MIN_STEPS * BATCH // len(train)))):
        order = rng.permutation(len(train))
        for start in range(0, len(order), BATCH):
            slots, starts, wanted = batch_of([train[i] for i in order[start : start + BATCH]])
            net.step(slots, starts, wanted, square, learned)
    logits = []
    for start in range(0, len(tune), 256):
        slots, starts, _ = batch_of(tune[start : start + 256])
        logits.append(net.logits(slots, starts))
    logits, speech, wanted = np.concatenate(logits), np.array([r[2] for r in tune]), np.array([r[1] for r in tune])
    net.thresholds[:] = best_threshold(logits, wanted)
    for i in range(len(LANGUAGES)):
        own = speech == i
        if min(wanted[own].sum(), (1 - wanted[own]).sum()) >= MIN_CALIBRATION:
            net.thresholds[i] = best_threshold(logits[own], wanted[own])
    return net


def score(documents: DataFrame, net: Net | None) -> DataFrame:
    """One row of SCHEMA for each document."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches):
        for part in sliced(batches):
            texts = [t or b"" for t in text_bytes(part.column(1))]
            codes, slots, starts = word_hashes(texts)
            speech = languages_of(texts, codes, starts)
            if net is None:
                scores = np.zeros(len(texts))
            else:
                shifted = net.logits(slots, starts).astype(float) - net.thresholds[speech] + LOGIT_CUT
                # Sums differ in their last bits with a text's place in the batch.
                scores = np.round(1 / (1 + np.exp(-np.clip(shifted, -60, 60))), 6)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(scores, pa.float64()), pa.array((scores >= CUT).astype(np.int32)), pa.array([LANGUAGES[i] for i in speech], pa.string())], schema=arrow
            )

    doc_id = F.col("doc_id").cast("long")
    return documents.select(doc_id.alias("doc_id"), F.col("text"), held_out(doc_id).alias("held_out")).mapInArrow(run, SCHEMA)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``labels`` and score every document."""
    return score(documents, fit(documents, labels))
