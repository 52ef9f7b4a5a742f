"""Language identification by string kernels.

Two texts are as alike as the byte n-grams (one to three bytes, ASCII lower-cased) that occur in both: a blended spectrum
kernel on presence, K(x, y) = |x & y| / sqrt(|x| |y|), over the n-grams that any landmark has.  Landmarks (a Nyström sample)
turn the kernel into a short vector per text, and one-versus-rest kernel ridge regression into one matrix.  A batch is scored
by two matrix products: presence x landmarks, then by the fitted matrix.

Fitting uses bounded samples (LANDMARKS and SAMPLE rows, as even over the languages as they allow); scoring reads every whole
text.  Edge cases: a null text, or one without a letter, is `und` with score 1; without any labelled row all are `und` with
score 0; a text that shares nothing with any landmark gets the commonest pattern's even score; of languages with equal
margins the first by code point is predicted; rows that repeat an id are predicted one by one and equal texts equally; a
very long text is read whole, alone in its slice; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, table
from .shingles import slices

LANDMARKS = 96
SAMPLE = 3_000
ORDERS = (1, 2, 3)
RIDGE = 1e-2
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32


def _codes(data: np.ndarray, offsets: np.ndarray):
    """Per order: the n-grams as numbers, and the text of each.  No n-gram reaches over a text's end."""
    d = _LOWER[data]
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    code = d
    for n in ORDERS:
        if n > 1:
            if len(data) < n:
                return
            code = (code[:-1] << np.uint32(8)) | d[n - 1 :]
            same = doc[: len(code)] == doc[n - 1 :]
            yield n, code[same], doc[: len(code)][same]
        else:
            yield n, code, doc


def grams(texts: pa.Array) -> list[np.ndarray]:
    """Distinct n-grams of each text, the order in the top byte."""
    out: list[np.ndarray] = []
    for a, b, data, offsets in slices(texts):
        sets: list[list] = [[] for _ in range(b - a)]
        for n, code, doc in _codes(data, offsets):
            at = np.searchsorted(doc, np.arange(b - a + 1))
            for k in range(b - a):
                sets[k].append(np.unique(code[at[k] : at[k + 1]]) | np.uint32(n << 24))
        out += [np.concatenate(s).astype(np.int64) if s else np.zeros(0, np.int64) for s in sets]
    return out


class Kernel:
    """Presence of the landmarks' n-grams, and similarity to each landmark."""

    def __init__(self, landmarks: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(landmarks)) if landmarks else np.zeros(0, np.int64)
        self.member = np.zeros((len(self.grams), len(landmarks)), np.float32)
        for k, own in enumerate(landmarks):
            self.member[np.searchsorted(self.grams, own), k] = 1
        self.size = np.sqrt(np.maximum(self.member.sum(axis=0), 1))
        self.places = {}
        for n in ORDERS:
            mine = np.flatnonzero(self.grams >> 24 == n)
            place = np.full(1 << (8 * n), -1, np.int32)
            place[self.grams[mine] & ((1 << 24) - 1)] = mine
            self.places[n] = place

    def near(self, data: np.ndarray, offsets: np.ndarray, rows: int = 128) -> np.ndarray:
        """Similarity of texts, given end to end, to the landmarks."""
        docs, width = len(offsets) - 1, len(self.grams)
        out = np.zeros((docs, self.member.shape[1]), np.float32)
        for a in range(0, docs, rows):
            b = min(docs, a + rows)
            there = np.zeros((b - a) * width, np.float32)
            for n, code, doc in _codes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                place = self.places[n][code]
                flat = doc.astype(np.int64) * width + place
                there[flat[place >= 0]] = 1
            there = there.reshape(b - a, width)
            out[a:b] = there @ self.member / np.sqrt(np.maximum(there.sum(axis=1, keepdims=True), 1)) / self.size
        return out


class Model:
    def __init__(self, kernel: Kernel, languages: list[str], matrix: np.ndarray):
        self.kernel, self.languages, self.matrix = kernel, languages, matrix

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], []
        for a, b, data, offsets in slices(texts):
            margin = self.kernel.near(data, offsets) @ self.matrix
            best = margin.argmax(axis=1)
            odds = np.exp(6 * (margin - margin.max(axis=1, keepdims=True)))
            names += [self.languages[k] for k in best]
            scores.append(1 / odds.sum(axis=1))
        return names, np.concatenate(scores) if scores else np.zeros(0)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fit(landmarks: list[np.ndarray], near: np.ndarray, names: list[str], ridge: float = RIDGE) -> tuple[list[str], np.ndarray]:
    """near: similarity of labelled texts to the landmarks.  Returns the languages and the matrix from similarities to margins."""
    kernel = Kernel(landmarks)
    inner = kernel.member.T @ kernel.member / kernel.size[:, None] / kernel.size[None, :]
    values, vectors = np.linalg.eigh(inner.astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    z = near.astype(np.float64) @ whiten
    languages = sorted(set(names))
    y = np.array([[1.0 if n == lang else -1.0 for lang in languages] for n in names])
    weight = 1 / np.array([names.count(lang) for lang in languages], np.float64)
    w = np.array([weight[languages.index(n)] for n in names])[:, None] / len(languages)
    beta = np.linalg.solve(z.T @ (w * z) + ridge * np.eye(z.shape[1]) / len(names), z.T @ (w * y))
    return languages, (whiten @ beta).astype(np.float32)


def _letters(text: str):
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def train(rows: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", landmarks: int = LANDMARKS, sample: int = SAMPLE) -> Model | None:
    """Fit on labelled rows.  What reaches the driver: the landmarks' distinct n-grams and a short vector per sampled row."""
    told = rows.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("lang").isNotNull() & _letters("text"))

    def distinct(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "grams": pa.array([g.tolist() for g in grams(batch.column(1))], pa.list_(pa.int64()))})

    marks = bounded_sample(told, "lang", "key", landmarks, "landmarks").select("lang", "text").mapInArrow(distinct, "lang string, grams array<long>").collect()
    if not marks:
        return None
    chosen = [np.array(g, np.int64) for _, g in sorted((r[0], r[1]) for r in marks)]

    def similar(batches):
        kernel = Kernel(chosen)
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(1)):
                yield pa.RecordBatch.from_pydict({"lang": batch.column(0).slice(a, b - a), "near": pa.array(kernel.near(data, offsets).tolist(), pa.list_(pa.float32()))})

    seen = bounded_sample(told, "lang", "key", sample, "sample").select("lang", "text").mapInArrow(similar, "lang string, near array<float>").collect()
    seen = sorted((r[0], r[1]) for r in seen) or [(r[0], None) for r in marks]
    if seen[0][1] is None:  # a table so small that the sample drew nothing: the landmarks teach
        k = Kernel(chosen)
        near = (k.member.T @ k.member) / k.size[:, None] / k.size[None, :]
        names = sorted(r[0] for r in marks)
    else:
        near, names = np.array([x for _, x in seen], np.float32), [n for n, _ in seen]
    languages, matrix = fit(chosen, near, names)
    return Model(Kernel(chosen), languages, matrix)


_models: dict[int, Model] = {}


def predictor(model: Model | None):
    """text -> struct of language and score, as an Arrow UDF.  The model's parts travel once; its tables are rebuilt per worker."""
    if model is None:
        parts = None
    else:
        parts = (model.kernel.grams, np.packbits(model.kernel.member.astype(bool), axis=0), model.languages, model.matrix)
    key = 0 if parts is None else hash((parts[0].tobytes(), parts[3].tobytes()))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        letters = [has_letter(t.as_py()) for t in texts]
        if parts is None:
            names, scores = ["und"] * len(letters), [0.0 if x else 1.0 for x in letters]
        else:
            if key not in _models:
                all_grams, packed, languages, matrix = parts
                member = np.unpackbits(packed, axis=0, count=len(all_grams)).astype(bool)
                _models.clear()
                _models[key] = Model(Kernel([all_grams[member[:, k]] for k in range(member.shape[1])]), languages, matrix)
            names, scores = _models[key].predict(texts)
            names = [n if x else "und" for n, x in zip(names, letters)]
            scores = [float(s) if x else 1.0 for s, x in zip(scores, letters)]
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.filter(~held))
    found = docs.select("doc_id", held.alias("held_out"), predictor(model)(F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
