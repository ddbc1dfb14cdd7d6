"""Feed-forward training by data-parallel gradient sums, for plain, weighted and focal losses.

Every step is one pass: a task adds up the gradients of its rows, the sums meet in a bounded number of groups, and the driver,
which holds the weights only, takes one Adam step. The result depends on the rows, up to the rounding of sums.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, functions as F

from ..plans.small import materialise

register_pickle_by_value(sys.modules[__name__])

# Weights a net may have: they travel in the task closure. Groups in which the tasks' sums meet.
MAX_WEIGHTS, GROUPS = 1_000_000, 8


@dataclass
class Loss:
    """Cross-entropy with a weight for positives, or focal loss with ``gamma`` > 0 and ``alpha`` for positives."""

    pos_weight: float = 1.0
    gamma: float = 0.0
    alpha: float | None = None

    def value_and_slope(self, z, y):
        """Per row the loss and its slope in the logit ``z``."""
        import numpy as np

        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        right = np.where(y == 1, p, 1 - p)
        weight = np.where(y == 1, self.pos_weight, 1.0)
        if self.alpha is not None:
            weight = weight * np.where(y == 1, self.alpha, 1 - self.alpha)
        log, wrong = np.log(right), 1 - right
        value = -weight * wrong ** self.gamma * log
        # d right / d z is right * wrong, with the sign of the label.
        slope = weight * wrong ** self.gamma * (self.gamma * right * log - wrong) * np.where(y == 1, 1.0, -1.0)
        return value, slope


def start(sizes: Sequence[int], seed: int = 42) -> list:
    """(weights, bias) of each layer, scaled to its inputs."""
    import numpy as np

    rng = np.random.default_rng(seed)
    layers = [(rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)) for a, b in zip(sizes[:-1], sizes[1:])]
    if sum(w.size + b.size for w, b in layers) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights: train a smaller net")
    return layers


def forward(layers, x):
    """Inputs of every layer and the logits."""
    import numpy as np

    inputs = [x]
    for w, b in layers[:-1]:
        inputs.append(np.maximum(inputs[-1] @ w + b, 0))
    return inputs, (inputs[-1] @ layers[-1][0] + layers[-1][1])[:, 0]


def gradient_sums(layers, x, y, loss: Loss):
    """Sum of the losses and of their gradients over rows, flat: weights and bias of each layer in turn."""
    import numpy as np

    inputs, z = forward(layers, x)
    value, slope = loss.value_and_slope(z, y)
    parts, back = [], slope[:, None]
    for (w, _), given in zip(reversed(layers), reversed(inputs)):
        parts[:0] = [(given.T @ back).ravel(), back.sum(axis=0)]
        back = (back @ w.T) * (given > 0)
    return float(value.sum()), np.concatenate(parts)


def gradient(rows: DataFrame, layers, loss: Loss):
    """(mean loss, mean gradient) over all rows with the columns x (array of double) and y."""
    import numpy as np

    def add(batches):
        import numpy as np
        import pyarrow as pa

        total, n, sums = 0.0, 0, None
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                value, grad = gradient_sums(layers, x, b.column(1).to_numpy(), loss)
                total, n, sums = total + value, n + b.num_rows, grad if sums is None else sums + grad
        if n:
            slot = TaskContext.get().partitionId() % GROUPS
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n]), pa.array([total]), pa.array([sums.tobytes()], pa.binary())], ["slot", "n", "loss", "grad"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        n, total, sums = 0, 0.0, None
        for b in batches:
            for k, value, grad in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                own = np.frombuffer(grad)
                n, total, sums = n + k, total + value, own if sums is None else sums + own
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total]), pa.array([sums.tobytes()], pa.binary())], ["n", "loss", "grad"])

    partial = rows.select("x", "y").mapInArrow(add, "slot int, n long, loss double, grad binary")
    # At most GROUPS sums reach the driver.
    found = partial.repartition(GROUPS, "slot").mapInArrow(merge, "n long, loss double, grad binary").collect()
    n = sum(r["n"] for r in found)
    if not n:
        return None, None
    return sum(r["loss"] for r in found) / n, sum(np.frombuffer(r["grad"]) for r in found) / n


def train(df: DataFrame, features: Sequence[str], y: str, hidden: Sequence[int] = (16,), steps: int = 60, rate: float = 0.05, loss: Loss = Loss(),
          weights: str | None = None, seed: int = 42) -> tuple[list, list[float]]:
    """(layers, mean loss before each step). ``weights="balanced"`` weighs positives by negatives per positive.

    Features should be scaled. Rows with a null label or a missing feature are left out; without rows the net stays as it starts.
    """
    import numpy as np

    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(x.alias("x"), F.col(y).cast("double").alias("y")).filter(F.col("y").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)))
    rows = materialise(rows, "net")
    if weights == "balanced":
        pos, n = rows.agg(F.count_if(F.col("y") == 1), F.count(F.lit(1))).first()
        loss = Loss((n - pos) / pos if pos else 1.0, loss.gamma, loss.alpha)
    layers, log = start([len(features), *hidden, 1], seed), []
    flat = np.concatenate([p.ravel() for layer in layers for p in layer])
    first, second = np.zeros_like(flat), np.zeros_like(flat)
    for t in range(1, steps + 1):
        value, grad = gradient(rows, layers, loss)
        if grad is None:
            break
        log.append(value)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        flat = flat - rate * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.999 ** t)) + 1e-8)
        layers, at = [], 0
        for a, b in zip([len(features), *hidden], [*hidden, 1]):
            layers.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
            at += a * b + b
    return layers, log


def score(df: DataFrame, layers, features: Sequence[str], name: str = "score") -> DataFrame:
    """Probability of class 1; a missing feature gives a missing score."""

    @F.pandas_udf("double")
    def predict(x):
        import numpy as np
        import pandas as pd

        z = forward(layers, x.to_numpy(dtype=float, na_value=np.nan))[1]
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return df.withColumn(name, predict(F.struct(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)])))
