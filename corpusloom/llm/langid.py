"""Language identification by mixture inference.

Training counts hashed character trigrams for each language over a bounded sample of labelled
documents (``TRAIN_DOCS`` for each language, chosen by a hash of the id). Every labelled language is
learned; the model is 2 ** BUCKET_BITS numbers for each. For each document,
expectation-maximisation estimates the proportions with which the languages generate its
trigrams. The language set is then selected by penalised likelihood: each further language must
raise the log-likelihood by ``PENALTY`` x log(number of trigrams). The proportions are estimated
again within the set; the prediction is the language of greatest proportion there, its score that proportion.

Defined results: a null text, or one without any letter, is ``und`` with score 0, and so is every text
where no labelled document exists. Ties of proportions fall to the smaller language name. Texts are judged
whole, however long. Repeated rows are judged one by one; an empty table gives an empty one. Only
``doc_id``, ``text`` and (in training) ``lang`` are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out, is_held_out, map_rows, sliced, text_bytes

#: Bound of the training sample: about this many documents for each language.
TRAIN_DOCS = 1500
BUCKET_BITS = 15
SMOOTHING = 0.5
ROUNDS = 30
CLOSE = 1e-3
PENALTY = 2.0
UNDETERMINED = "und"

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, proportions array<double>"

_LETTER = None


def letter_table() -> np.ndarray:
    """For each code point of the first plane whether it is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16)
    return _LETTER


def trigrams(text: str) -> np.ndarray:
    """Hashed trigrams of the lower-cased text, runs of other characters than letters as one blank. Empty if there is no letter."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 1 << 16) | letter_table()[np.minimum(points, (1 << 16) - 1)]
    if (points >= 1 << 16).any():
        high = np.flatnonzero(points >= 1 << 16)
        letter[high] = [chr(c).isalpha() for c in points[high]]
    if not letter.any():
        return np.zeros(0, np.int64)
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    points = points[keep].astype(np.uint64)
    code = (points[:-2] << np.uint64(42)) ^ (points[1:-1] << np.uint64(21)) ^ points[2:]
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def training_rows(documents: DataFrame) -> tuple[DataFrame, int]:
    """A bounded, reproducible sample of labelled documents outside the held-out part, (text, lang), and the number of languages."""
    rows = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    # One short row for each language is all that comes to the driver and goes back.
    counts = [(r["lang"], min(1.0, TRAIN_DOCS / r["count"])) for r in rows.groupBy("lang").count().collect()]
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    shares = documents.sparkSession.createDataFrame(counts, "_lang string, _share double")
    return rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).where(place < F.col("_share")).select("text", "lang"), len(counts)


def fit(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order and the log-probabilities, shape (2 ** BUCKET_BITS, languages)."""

    def make():
        def count(rows: list) -> list:
            by: dict[bytes, np.ndarray] = {}
            for text, lang in rows:
                if text:
                    grams = trigrams(text.decode("utf-8", "surrogatepass"))
                    if len(grams):
                        counts = by.setdefault(lang, np.zeros(1 << BUCKET_BITS, np.int64))
                        counts += np.bincount(grams, minlength=1 << BUCKET_BITS)
            return [(lang.decode(), int(b), int(c[b])) for lang, c in by.items() for b in np.flatnonzero(c)]

        return count

    rows, kinds = training_rows(documents)
    # A task's counts cover all buckets of its languages, so few languages go to few tasks.
    rows = rows.repartition(max(4, kinds // 4))
    counted = map_rows(rows, make, "lang string, bucket int, n long", rows=1 << 14).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toPandas()
    languages = sorted(got["lang"].unique())
    counts = np.zeros((1 << BUCKET_BITS, len(languages)))
    counts[got["bucket"].to_numpy(), np.searchsorted(languages, got["lang"].to_numpy().astype(str)) if languages else []] = got["n"].to_numpy()
    return languages, np.log(counts + SMOOTHING) - np.log(counts.sum(0) + SMOOTHING * len(counts))


def proportions(likelihood: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation and the log-likelihood reached.

    ``likelihood`` has a row for each distinct trigram, scaled so that its largest value is 1.
    """
    kinds = likelihood.shape[1]
    total = counts.sum()
    mix = np.full(kinds, 1.0 / kinds)
    if kinds > 1:
        for _ in range(ROUNDS):
            seen = likelihood @ mix
            new = mix * ((counts / seen) @ likelihood) / total
            moved = np.abs(new - mix).max()
            mix = new
            if moved < CLOSE:
                break
    return mix, float(counts @ np.log(likelihood @ mix))


def infer(grams: np.ndarray, model: np.ndarray) -> tuple[list[int], np.ndarray, float]:
    """The selected languages by falling proportion, their proportions within the set, and the share that the set has among all languages."""
    buckets, counts = np.unique(grams, return_counts=True)
    logs = model[buckets]
    likelihood = np.exp(logs - logs.max(1, keepdims=True))
    counts = counts.astype(float)
    mix, _ = proportions(likelihood, counts)
    order = np.argsort(-mix, kind="stable")
    price = PENALTY * np.log(counts.sum() + 1)
    best, chosen, inner = -np.inf, order[:1], np.ones(1)
    for k in range(1, len(order) + 1):
        subset = np.sort(order[:k])
        within, gained = proportions(likelihood[:, subset], counts)
        if gained - price * k <= best:
            break
        best, chosen, inner = gained - price * k, subset, within
    by_share = np.argsort(-inner, kind="stable")
    return chosen[by_share].tolist(), inner[by_share], float(mix[chosen].sum())


def identify(documents: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """One row of SCHEMA for each document; the model is fitted on ``documents`` unless given."""
    languages, logs = model or fit(documents)
    logs = logs.astype(np.float32)

    def make():
        def work(rows: list) -> list:
            out = []
            for doc_id, text in rows:
                grams = trigrams(text.decode("utf-8", "surrogatepass")) if text and languages else ()
                if not len(grams):
                    out.append((doc_id, is_held_out(doc_id), UNDETERMINED, 0.0, [], []))
                    continue
                chosen, share, _ = infer(grams, logs)
                out.append((doc_id, is_held_out(doc_id), languages[chosen[0]], float(min(1.0, share[0])), [languages[i] for i in chosen], share.tolist()))
            return out

        return work

    return map_rows(documents.select(F.col("doc_id").cast("long"), F.col("text")), make, SCHEMA)


def keep_identified(documents: DataFrame, min_score: float, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """The documents, unchanged, of whose text the selected languages together have a share of at least ``min_score``.

    Documents without a letter, and with no labelled document all of them, have no language and go.
    """
    languages, logs = model or fit(documents)
    logs = logs.astype(np.float32)
    at = documents.columns.index("text")

    def run(batches):
        for part in sliced(batches):
            keep = []
            for text in text_bytes(part.column(at)):
                grams = trigrams(text.decode("utf-8", "surrogatepass")) if text and languages else ()
                if not len(grams):
                    keep.append(False)
                    continue
                keep.append(infer(grams, logs)[2] >= min_score)
            yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
