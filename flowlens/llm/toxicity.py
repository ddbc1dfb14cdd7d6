"""Toxicity by a linear classifier that counterfactual sentences keep fair.

Features are the words of a text and the beginnings of its longer words, present or not. The fit minimises the
logistic loss with a sparse penalty and one more: for every sentence of a labelled text that names a group, the
group's name is swapped for each other name of its kind, and the square of the change of the score is
penalised. A name that occurs more often in toxic texts then earns no weight of its own, and neutral mentions
keep the score of the plain sentence.

The fit sees a sample of bounded size (``per_label`` texts of each label, by the hash of their ids); scoring
reads every whole text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import staged

register_pickle_by_value(sys.modules[__name__])

WORD, SENTENCE = re.compile(r"\w+"), re.compile(r"[.!?\n]+")
STARTS = (4, 5, 6)
PER_LABEL, MIN_TEXTS = 4000, 5
# Names of groups by kind; each kind has a neutral word.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "believers"),
    ("black", "white", "asian", "latino", "african", "european", "american", "local"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "single"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("disabled", "blind", "deaf", "elderly", "young", "adult"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("mujeres", "hombres", "chicas", "chicos", "gente"),
)


def features(words) -> set[str]:
    out = set(words)
    for k in STARTS:
        out |= {w[:k] + "*" for w in words if len(w) > k}
    return out


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swaps(text: str, identities: Sequence[Sequence[str]]):
    """(features gained, features lost) of each swap of a group's name in each sentence."""
    kinds = {w: k for k in identities for w in k}
    for sentence in SENTENCE.split(text.lower()):
        words = set(WORD.findall(sentence))
        for name in words & kinds.keys():
            for other in kinds[name]:
                if other not in words:
                    a, b = features(words), features((words - {name}) | {other})
                    yield b - a, a - b


@dataclass
class Model:
    """Weights by feature (a word, or a word's beginning and '*') and the weight of every text."""

    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        import math

        known = self.weights
        z = self.bias + math.fsum(known[f] for f in sorted(features(words_of(text or "")) & known.keys()))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [("", self.bias), *sorted(self.weights.items())]
        return spark.createDataFrame(rows, "feature string, weight double")

    @staticmethod
    def load(frame: DataFrame) -> Model:
        weights = {r["feature"]: r["weight"] for r in frame.collect()}  # one row per weight of the fitted model
        return Model({f: w for f, w in weights.items() if f}, weights.get("", 0.0))


def held_out(doc_id: Column) -> Column:
    """Rows that no fit may see: crc32 of the id's text divisible by 5. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_texts(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """text, toxic of at most 2 * per_label labelled texts that are not held out, the same ones in every run.

    Several labels of a doc_id count as toxic if one is; null labels and ids are left out. Of several rows with
    one doc_id a single one is taken, chosen by the hash of its text.
    """
    known = (labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    order = [F.xxhash64("doc_id"), "doc_id"]
    picks = [known.filter(F.col("toxic") == y).orderBy(*order).limit(per_label) for y in (0, 1)]
    # At most 2 * per_label rows.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")
    return rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def _hashes(fs):
    import numpy as np
    import xxhash

    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, fs), np.uint64, len(fs)))


def _common_features(sample: DataFrame, min_texts: int):
    """Sorted hashes of the features met in at least ``min_texts`` texts; counted in Spark, only those reach the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for text in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_hashes(features(words_of(text))).view(np.int64))], ["f"])

    counts = sample.select("text").mapInArrow(run, "f long").groupBy("f").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_texts)
    return np.sort(np.array([r["f"] for r in counts.select("f").collect()], np.int64).view(np.uint64))


def _texts(sample: DataFrame, names) -> list:
    """(toxic, places of its features in ``names``) of each text of the sample."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = [np.flatnonzero(np.isin(names, _hashes(features(words_of(t))), assume_unique=True)).astype(np.int32).tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], ["y", "at"])

    return sample.mapInArrow(run, "y int, at binary").collect()


def _swaps(sample: DataFrame, identities) -> list:
    """(features gained, features lost, how often) of the swaps in all sentences. Gains and losses are parts of the features of two
    names, so their number follows from the lists of names, however long the texts are."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for b in batches:
            met = Counter((_hashes(gain).tobytes(), _hashes(loss).tobytes()) for t in b.column(0).to_pylist() for gain, loss in swaps(t, identities))
            cols = [pa.array([g for g, _ in met], pa.binary()), pa.array([x for _, x in met], pa.binary()), pa.array(list(met.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["gain", "loss", "n"])

    met = sample.select("text").mapInArrow(run, "gain binary, loss binary, n long").groupBy("gain", "loss").agg(F.sum("n").alias("n"))
    return sorted(map(tuple, met.collect()))


def _names(sample: DataFrame, wanted: set[int], identities) -> dict[int, str]:
    """The features behind the hashes that carry weight."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in batches:
            found = {f for text in b.column(0).to_pylist() for f in features(words_of(text)) if xxhash.xxh3_64_intdigest(f) in wanted}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], ["f"])

    import xxhash

    names = {r[0] for r in sample.select("text").mapInArrow(run, "f string").distinct().collect()}
    names |= features({w for k in identities for w in k})
    return {xxhash.xxh3_64_intdigest(f): f for f in names}


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, fairness: float = 1.0, sparsity: float = 3e-4,
        identities: Sequence[Sequence[str]] = IDENTITIES, steps: int = 300) -> Model:
    """Fit on labelled texts; ``fairness`` weighs the penalty on score changes under swapped names.

    Without labelled texts or repeated features the model has no features and scores on the harmless side; with
    one label only, on that label's side. The driver holds, of at most 2 * per_label texts, the features that at least
    MIN_TEXTS of them share, and one row per kind of swap.
    """
    import numpy as np

    sample = staged(training_texts(docs, labels, per_label), "labelled")
    pairs = [(np.frombuffer(g, np.uint64), np.frombuffer(x, np.uint64), n) for g, x, n in _swaps(sample, identities)]
    names = np.union1d(_common_features(sample, MIN_TEXTS), np.concatenate([np.empty(0, np.uint64), *(x for p in pairs for x in p[:2])]))
    texts = sorted((r["y"], r["at"]) for r in _texts(sample, names))
    y = np.array([t[0] for t in texts], float)
    if not len(y) or y.min() == y.max():
        return Model({}, 3.0 if len(y) and y[0] == 1 else -3.0)
    m = len(names)
    if not m:
        return Model({}, -3.0)
    share = np.array([p[2] for p in pairs], float)
    share /= share.sum() or 1.0

    def flat(sets):
        """(row, column) of sets of columns."""
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate([np.empty(0, np.int64), *sets]).astype(np.int64)

    r0, c0 = flat([np.frombuffer(t[1], np.int32) for t in texts])
    (r1, c1), (r2, c2) = (flat([np.searchsorted(names, p[k]) for p in pairs]) for k in (0, 1))
    rs, cs = np.concatenate([r1, r2]), np.concatenate([c1, c2])
    sign = np.concatenate([np.ones(len(r1)), -np.ones(len(r2))])
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())  # both labels count alike

    def unfair(w):
        """Half the gradient of the mean square of the score's change."""
        change = np.bincount(rs, sign * w[cs], len(pairs)) * share
        return fairness * np.bincount(cs, sign * change[rs], m) if len(pairs) else 0.0

    def gradient(w, b):
        z = b + np.bincount(r0, w[c0], len(y))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        return np.bincount(c0, g[r0], m) + 2 * unfair(w), g.sum()

    # Accelerated proximal steps. The step length follows from the largest curvature, found by power iteration.
    v = np.full(m, 1 / np.sqrt(m))
    for _ in range(20):
        u = np.bincount(c0, (weight / 4 * np.bincount(r0, v[c0], len(y)))[r0], m) + 2 * unfair(v)
        size = float(np.linalg.norm(u)) or 1.0
        v = u / size
    rate = 0.9 / (size + 0.25)
    w, b, x, xb, t = np.zeros(m), 0.0, np.zeros(m), 0.0, 1.0
    for _ in range(steps):
        g, gb = gradient(x, xb)
        new = x - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        nb, nt = xb - rate * gb, (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, xb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    carry = {int(names[i]): float(w[i]) for i in np.flatnonzero(w)}
    known = _names(sample, set(carry), identities)
    return Model({known[h]: value for h, value in carry.items()}, float(b))


def toxicity(model: Model):
    """A column function: the score of a whole text; null and empty texts get the score of no words."""

    @F.pandas_udf("double")
    def score(text):
        import pandas as pd

        return pd.Series([model.score(t) for t in text], dtype="float64")

    return score


def score_texts(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Repeated rows score alike, null ids stay null, an empty table gives an empty one; other columns are not read.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), toxicity(model)(F.col("text")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
