"""Counterfactual-regularised toxicity classifier.

A logistic model over the distinct words of a text and their prefixes.  Besides the labels, it is fitted on pairs: a
labelled text and the same text with its identity terms swapped for others of their family.  The squared difference of the
two scores is penalised, so a group's name alone does not move a score, however it is spread over the labels.

Fitting uses a bounded sample (SAMPLE rows, as even over the labels as they allow) of the labelled rows; scoring reads every
whole text.  Edge cases: null and wordless texts get the score of no evidence; rows without a label or document teach
nothing; with no labels at all, or one value alone, the scores stand at that value's smoothed share; rows that repeat an id
are scored one by one and equal texts equally; a very long text is read whole and scored by its distinct words; a score of
exactly the threshold is toxic; an empty table gives an empty result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, drop, ship, table, written
from .postings import words_of

SAMPLE = 8_000
FEATURES = 2_048
#: A feature needs this many toxic texts, and this z-score.
LEAST, EVIDENCE = 2, 3.0
THRESHOLD = 0.7
PREFIXES = (4, 5, 6)
CACHE_WORDS = 400_000
#: Families of group names; a term is swapped for the next of its family.
IDENTITY = (
    "women men girls boys", "woman man girl boy", "muslims christians jews hindus buddhists atheists", "muslim christian jewish hindu buddhist atheist",
    "black white asian latino arab", "immigrants refugees foreigners locals", "gay straight lesbian bisexual transgender", "deaf blind disabled autistic", "old young",
    "frauen männer mädchen jungen", "muslime christen juden hindus", "ausländer flüchtlinge einheimische", "femmes hommes filles garçons", "musulmans chrétiens juifs",
    "immigrés réfugiés étrangers", "mujeres hombres chicas chicos", "musulmanes cristianos judíos", "inmigrantes refugiados extranjeros",
)


def swaps(families=IDENTITY) -> dict[bytes, bytes]:
    out = {}
    for family in families:
        terms = [t.encode() for t in family.split()]
        out |= {a: b for a, b in zip(terms, terms[1:] + terms[:1]) if a not in out}
    return out


def features(words: set[bytes]) -> Counter:
    """Each word, and for each prefix the number of words that have it."""
    found = Counter(b"=" + w for w in words)
    for k in PREFIXES:
        found.update(w[:k] for w in words if len(w) > k)
    return found


class Model:
    def __init__(self, bias: float, weights: dict[bytes, float]):
        self.bias, self.weights = bias, weights

    def of_word(self, w: bytes) -> float:
        get = self.weights.get
        return get(b"=" + w, 0.0) + sum(get(w[:k], 0.0) for k in PREFIXES if len(w) > k)

    def score(self, words: set[bytes]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + math.fsum(map(self.of_word, words))))))


def _bags(families=IDENTITY):
    """label, text -> label, the distinct words, and those of the counterfactual text if the text has an identity term."""
    swapped = swaps(families)

    def run(batches):
        for batch in batches:
            names, words, others = [], [], []
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words_of(t.as_py())
                names.append(y)
                words.append(b" ".join(sorted(set(own))))
                others.append(b" ".join(sorted({swapped.get(w, w) for w in own})) if not swapped.keys().isdisjoint(own) else None)
            yield pa.RecordBatch.from_pydict({"label": pa.array(names, pa.int32()), "words": pa.array(words, pa.binary()), "other": pa.array(others, pa.binary())})

    return run


def _counted(batches):
    """Bags -> per feature the number of toxic and of other texts that have it, summed over a batch."""
    for batch in batches:
        counts = (Counter(), Counter())
        for y, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[y].update(features(set(words.as_py().split())).keys())
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.binary()), "a": pa.array([counts[1][f] for f in names], pa.int64()), "b": pa.array([counts[0][f] for f in names], pa.int64())})


def _vectors(index: dict[bytes, int]):
    """Bags -> label, and the chosen features' numbers and counts in the text and in its counterfactual."""

    def of(words: bytes | None) -> list | None:
        return None if words is None else [x for f, n in features(set(words.split())).items() if f in index for x in (index[f], n)]

    def run(batches):
        for batch in batches:
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_pydict({"label": batch.column(0), "own": pa.array([of(w.as_py()) for w in batch.column(1)], kind), "other": pa.array([of(w.as_py()) for w in batch.column(2)], kind)})

    return run


def chosen(bags: DataFrame, n1: int, n0: int, most: int = FEATURES) -> list[bytes]:
    """The features with the strongest evidence for the label, and all of the identity terms that occur."""
    identity = sorted({f for w in swaps() for f in features({w})})
    counts = bags.mapInArrow(_counted, "feature binary, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = written(counts.filter((F.col("a") >= LEAST) | F.col("feature").isin(identity)), "features")
    p = (F.col("a") + F.col("b") + 1) / F.lit(n1 + n0 + 2)
    z = (F.col("a") / F.lit(n1) - F.col("b") / F.lit(n0)) / F.sqrt(p * (1 - p) * F.lit(1 / n1 + 1 / n0))
    strong = counts.filter((F.col("a") >= LEAST) & (z >= EVIDENCE)).orderBy(z.desc(), "feature").limit(most).collect()
    always = counts.filter(F.col("feature").isin(identity)).collect()
    drop(counts)
    return sorted({bytes(r.feature) for r in [*strong, *always]})


def fit(names: list[bytes], rows: list[tuple[int, list[int], list[int] | None]], penalty: float = 10.0, ridge: float = 2e-4, steps: int = 400) -> Model:
    """names: the features; rows: label, then features' numbers and counts of the text, and of the counterfactual if there is one."""
    y = np.array([r[0] for r in rows], np.float32)
    n1, n0 = float(y.sum()), float((1 - y).sum())

    def matrix(vectors: list[list[int]]) -> np.ndarray:
        m = np.zeros((len(vectors), len(names)), np.float32)
        for k, v in enumerate(vectors):
            m[k, v[::2]] = v[1::2]
        return m

    x = matrix([own for _, own, _ in rows])
    other = [(k, z) for k, (_, _, z) in enumerate(rows) if z is not None]
    gap = matrix([z for _, z in other]) - x[[k for k, _ in other]] if other else np.zeros((0, len(names)), np.float32)
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    pull, shrink = np.float32(2 * penalty / max(1, len(gap))), np.float32(ridge)
    w, b, ahead_w, ahead_b = np.zeros(len(names), np.float32), 0.0, np.zeros(len(names), np.float32), 0.0
    # Nesterov's method; the step is one over a bound of the curvature, found by power iteration.
    v = np.full(len(names), 1 / math.sqrt(max(1, len(names))), np.float32)
    for _ in range(30):
        v = 0.25 * (x.T @ (weight * (x @ v))) + pull * (gap.T @ (gap @ v))
        v /= np.linalg.norm(v) or 1
    top = float(v @ (0.25 * (x.T @ (weight * (x @ v))) + pull * (gap.T @ (gap @ v)))) if names else 0.0
    step = np.float32(1 / (1.1 * top + 0.25 + ridge))
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead_w + np.float32(ahead_b), -30, 30)))
        r = weight * (p - y)
        w2 = ahead_w - step * (x.T @ r + shrink * ahead_w + pull * (gap.T @ (gap @ ahead_w)))
        b2 = ahead_b - float(step) * float(r.sum())
        m = np.float32(k / (k + 3))
        ahead_w, ahead_b = w2 + m * (w2 - w), b2 + float(m) * (b2 - b)
        w, b = w2, b2
    return Model(float(b), {f: float(w[k]) for k, f in enumerate(names) if abs(w[k]) > 1e-6})


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "toxic", **options) -> Model:
    """Fit on labelled documents; labels that are held out must be filtered before.

    The sampled texts' bags of words stay in the shared folder; the driver gets the chosen features and, per sampled row,
    the counts of those alone: at most 2 * sample rows of at most FEATURES (and identity) numbers, however long the texts.
    """
    drawn = bounded_sample(labels.select(F.col(key).alias("k"), (F.col(label) > 0).cast("int").alias("label")), "label", "k", sample, "toxicity")
    joined = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("k")).select("label", "text")
    bags = written(joined.mapInArrow(_bags(), "label int, words binary, other binary").distinct(), "bags")
    seen = {r[0]: r[1] for r in bags.groupBy("label").count().collect()}
    n1, n0 = seen.get(1, 0), seen.get(0, 0)
    if not n1 or not n0:
        drop(bags)
        p = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(math.log(p / (1 - p)), {})
    names = chosen(bags, n1, n0)
    rows = bags.mapInArrow(_vectors({f: k for k, f in enumerate(names)}), "label int, own array<int>, other array<int>").collect()
    drop(bags)
    return fit(names, sorted(((r[0], list(r[1]), None if r[2] is None else list(r[2])) for r in rows), key=repr), **options)


def scorer(model: Model):
    """text -> score, as an Arrow UDF."""
    bias, weights = model.bias, model.weights

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        own = _scorers.get(key) or _scorers.setdefault(key, _Cache(Model(bias, weights)))
        out = []
        for t in texts:
            words = set(words_of(t.as_py()))
            z = bias + math.fsum(map(own.__getitem__, words))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        if len(own) > CACHE_WORDS:
            own.clear()
        return pa.array(out, pa.float64())

    key = hash((bias, len(weights), sum(weights.values())))
    return score


class _Cache(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, w: bytes) -> float:
        self[w] = v = self.model.of_word(w)
        return v


_scorers: dict[int, _Cache] = {}


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    ship(docs.sparkSession)
    model = train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1), **options)
    return docs.filter(scorer(model)(F.col("text")) < threshold)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    scored = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), scorer(model)(F.col("text")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
