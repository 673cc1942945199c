"""Language identification with a string kernel.

The kernel of two texts is the blended spectrum of their character n-grams by presence: the number
of distinct n-grams of all orders that both hold, divided by the geometric mean of what each
holds. A few labelled texts are landmarks (Nyström); kernel ridge regression, one language against
the rest, is fitted on the landmarks' features. Texts are scored in batches by matrix products:
presence matrix times landmarks gives the kernel, kernel times whitening and weights the scores.

n-grams fall into hash buckets, so a text is a bit set of fixed size. Presence alone forgets which
language most of a text is in, so a text is scored in segments, all of them, and the scores are
averaged by the segments' length.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmark.llm.base import or_empty, query, table

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 14
#: Labelled texts per language for the fit (a third of them as a short cut), and landmarks per
#: language. The bound of the sample: rows of BUCKETS / 8 bytes reach the driver.
PER_LANGUAGE = 300
LANDMARKS = 48
RIDGE = 0.01
UNKNOWN = "und"
#: Words of a short cut of a training text: texts of a few words are scored, too.
CUT_WORDS = (2, 12)
#: Parts that a language's rows are ranked in before they are ranked together.
SLICES = 256
#: Characters of a segment, and segments of a matrix product.
SEGMENT = 1000
BATCH = 256

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str) -> np.ndarray:
    """The buckets of the text's n-grams as booleans. Case is folded, runs of characters that
    are no letters count as one space, and the ends of the text as spaces."""
    out = np.zeros(BUCKETS, dtype=bool)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters(points)
    points = np.where(letters, points, 32)
    points = points[letters | np.r_[False, letters[:-1]]]  # of other characters those right after a letter
    x = np.r_[32, points, np.full(int(len(points) == 0 or points[-1] != 32), 32)].astype(np.uint64)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        if len(x) < n:
            break
        # The hash of an n-gram from that of its first n - 1 characters.
        h = (h[: len(x) - n + 1] ^ x[n - 1 :]) * _PRIME
        h ^= h >> np.uint64(29)
        if n in ORDERS:
            out[((h * _PRIME) >> np.uint64(50)).astype(np.int64)] = True
    return out


_TABLE = np.zeros(0x110000, dtype=np.int8)  # 0 not looked up, 1 letter, -1 none


def _letters(points: np.ndarray) -> np.ndarray:
    kind = _TABLE[points]
    if not kind.all():
        for p in np.unique(points[kind == 0]).tolist():
            _TABLE[p] = 1 if chr(p).isalpha() else -1
        kind = _TABLE[points]
    return kind > 0


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised common n-grams of the rows of two presence matrices (float32)."""
    scale = np.sqrt(np.maximum(x.sum(axis=1), 1)), np.sqrt(np.maximum(landmarks.sum(axis=1), 1))
    return (x @ landmarks.T) / scale[0][:, None] / scale[1][None, :]


class Model:
    """Nyström features of the landmarks and one ridge regression per language."""

    def __init__(self, rows: np.ndarray, labels: list[str], landmarks: np.ndarray, ridge: float = RIDGE):
        self.languages = sorted(set(labels))
        self.landmarks = landmarks
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
        good = values > 1e-6 * values.max()
        whiten = vectors[:, good] / np.sqrt(values[good])
        features = kernel(rows, landmarks) @ whiten
        targets = np.where(np.array(labels)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        # Languages weigh alike, whatever their number of rows.
        counts = {name: labels.count(name) for name in self.languages}
        weight = np.array([1 / counts[x] for x in labels])[:, None]
        self.center = (features * weight).sum(axis=0) / weight.sum()
        self.bias = (targets * weight).sum(axis=0) / weight.sum()
        f = features - self.center
        system = (f * weight).T @ f + ridge * np.eye(f.shape[1]) * weight.sum() / len(rows)
        self.weights = (whiten @ np.linalg.solve(system, (f * weight).T @ (targets - self.bias))).astype(np.float32)
        self.offset = (self.bias - self.center @ np.linalg.solve(system, (f * weight).T @ (targets - self.bias))).astype(np.float32)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks) @ self.weights + self.offset


def short_cut(text: str, seed: int) -> str:
    words = text.split()
    rng = np.random.default_rng(seed % (1 << 32))
    n = int(rng.integers(CUT_WORDS[0], CUT_WORDS[1] + 1))
    start = int(rng.integers(0, max(1, len(words) - n)))
    return " ".join(words[start : start + n])


def segments(text: str) -> list[str]:
    return [text[i : i + SEGMENT] for i in range(0, len(text), SEGMENT)]


def training_text(text: str, seed: int) -> str:
    """A short cut of every third text, else one of its segments that has a letter."""
    if seed % 3 == 0:
        return short_cut(text, seed)
    lettered = [s for s in segments(text) if has_letter(s)]
    return lettered[seed * 7919 % len(lettered)] if lettered else ""


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS) -> Model | None:
    """A model of ``(doc_id, text, lang)``; rows without text, letter or language are not used.

    The sample takes ``per_language`` rows of each language by the hash of their id; ties of the
    hash go by text hash. Ids and languages are ranked alone, texts become bit sets
    on the executors, and those alone reach the driver. None if there is no language.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), F.xxhash64("text"))
    keys = usable.select("lang", F.struct(F.col("doc_id")).alias("key"), F.xxhash64("text").alias("text_key"), F.col("doc_id"), "text")
    chosen = (
        keys.select("lang", "key", "text_key", "doc_id", F.lit(None).cast("string").alias("text"))
        # Each of many slices of a language leaves its first rows, so the last ranking sees few.
        .withColumn("slice", F.pmod(F.xxhash64(F.lit("slice"), "doc_id"), F.lit(SLICES)))
        .withColumn("n", F.row_number().over(order.partitionBy("lang", "slice")))
        .filter(F.col("n") <= per_language)
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= per_language)
        .groupBy("lang", "key", "text_key")
        .agg(F.min("n").alias("n"))
    )
    # A broadcast of per_language rows a language at most; rows that repeat are learnt once.
    sample = keys.join(F.broadcast(chosen), ["lang", "key", "text_key"]).groupBy("lang", "n").agg(F.first("text").alias("text"))

    def encode(batches):
        for batch in batches:
            lang, n, bits = [], [], []
            for name, i, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "n", "text"))):
                lang.append(name)
                n.append(i)
                bits.append(np.packbits(presence(training_text(text, i))).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n, pa.int32()), pa.array(bits, pa.binary())], names=["lang", "n", "bits"])

    held = sample.mapInArrow(encode, "lang string, n int, bits binary").collect()
    if not held:
        return None
    held.sort(key=lambda r: (r["lang"], r["n"], bytes(r["bits"])))
    rows = np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in held), np.uint8)).reshape(len(held), BUCKETS).astype(np.float32)
    marks = rows[[i for i, r in enumerate(held) if r["n"] <= landmarks]]
    return Model(rows, [r["lang"] for r in held], marks)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``lang_pred`` and ``score`` (0 to 1) beside ``doc_id`` and ``held_out`` of ``docs``.

    ``und`` with score 0 where the text is NULL or has no letter, or nothing was learnt.
    Equal texts get equal results; whole texts are read.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if model is not None:
                total, weight = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
                parts = ((i, s) for i, t in enumerate(texts) for s in segments(t or "") if has_letter(s))
                while part := list(islice(parts, BATCH)):
                    owner, size = np.array([i for i, _ in part]), np.array([len(s) for _, s in part], float)
                    rows = np.stack([presence(s) for _, s in part]).astype(np.float32)
                    np.add.at(total, owner, model.scores(rows) * size[:, None])
                    np.add.at(weight, owner, size)
                for i in np.flatnonzero(weight):
                    mean = total[i] / weight[i]
                    best = int(mean.argmax())
                    names[i], scores[i] = model.languages[best], float(min(1.0, max(0.0, (mean[best] + 1) / 2)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def with_fold(docs: DataFrame) -> DataFrame:
    """``held_out``: the CRC of the id as text is 2 modulo 4; a NULL id counts as empty text."""
    return docs.withColumn("held_out", F.pmod(F.crc32(or_empty(F.col("doc_id").cast("string"))), F.lit(4)) == 2)


def predict_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learn on the rows that are not held out, predict all rows of ``(doc_id, text, lang)``.

    An empty table gives an empty result; repeated rows are predicted each.
    """
    rows = with_fold(docs.select("doc_id", "text", "lang"))
    model = fit(rows.filter(~F.col("held_out")).select("doc_id", "text", "lang"), per_language)
    return identify(rows, model)


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return predict_languages(table(spark, sf_dir, "documents"))
