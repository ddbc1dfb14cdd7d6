"""Column expressions shared by the operators. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A decimal number as plain text (no digit separators, no type suffix). Fixed value.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
# Texts that are numbers but not finite. Fixed value.
SPECIAL = r"^[+-]?(inf|infinity|nan)$"

INF = float("inf")


def finite(c: Column) -> Column:
    """The one missing value is NULL: NaN and infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def is_number(c: Column) -> Column:
    """True when the trimmed text reads as a number, special values included."""
    t = F.trim(c)
    return F.coalesce(t.rlike(NUMBER) | F.lower(t).rlike(SPECIAL), F.lit(False))


def to_double(c: Column) -> Column:
    """Text to double, special values kept, anything else NULL."""
    return F.when(is_number(c), F.trim(c).try_cast("double"))


def plain_double(c: Column) -> Column:
    """Plain decimal text to double, anything else NULL (a huge exponent still gives infinity)."""
    t = F.trim(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def parse_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text columns to finite doubles; empty, special and garbage cells become NULL.

    Two projections, so that the text is matched and cast once per cell.
    """
    return (df.withColumns({c: plain_double(F.col(c)) for c in cols})
            .withColumns({c: finite(F.col(c)) for c in cols}))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside array lambdas, which would evaluate it per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nan_to_num(c: Column, replacement: float = 0.0) -> Column:
    return F.coalesce(finite(c), F.lit(float(replacement)))


def safe_div(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def log_clamped(c: Column, eps: float = 1e-9) -> Column:
    return F.log(F.greatest(c, F.lit(eps)))


def log_shifted(c: Column, eps: float = 1e-9) -> Column:
    return F.log(c + F.lit(eps))


def clip(c: Column, lo, hi) -> Column:
    """NULL stays NULL (greatest/least alone would skip it)."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(c.isNotNull(), F.greatest(lo, F.least(hi, c)))


def sigmoid(z: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, 1.0 / (1.0 + e)).otherwise(e / (1.0 + e))


def log_odds(p: Column, eps: float = 1e-7) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))
    return F.log(q / (1.0 - q))


def probability(score: Column, from_logits: bool, eps: float) -> Column:
    p = sigmoid(score) if from_logits else score
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), p))


def predict(score: Column, threshold=0.5) -> Column:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(score >= t, 1).otherwise(0)


def binary_label(c: Column) -> Column:
    """Numeric text: 0 stays 0, anything else 1. Other text: BENIGN is 0."""
    t = F.trim(c)
    num = to_double(c)
    return (F.when(num == 0, 0).when(num.isNotNull(), 1)
            .when(t == "BENIGN", 0).otherwise(1))


def passthrough_label(c: Column) -> Column:
    """Whole numbers pass unchanged; otherwise three spellings of benign are 0."""
    return (F.when(F.trim(c).rlike(r"^[+-]?[0-9]+$"), F.trim(c).try_cast("int"))
            .when(c.isin("BENIGN", "Benign", "benign"), 0).otherwise(1))


# --- activations -----------------------------------------------------------

def relu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(0.0)


def relu_slope(x: Column) -> Column:
    return F.when(x > 0, 1.0).otherwise(0.0)


def leaky_relu(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, x).otherwise(x * alpha)


def leaky_relu_slope(x: Column, alpha: float = 0.01) -> Column:
    return F.when(x > 0, 1.0).otherwise(alpha)


def sigmoid_slope(a: Column) -> Column:
    """``a`` is already the sigmoid output."""
    return a * (1.0 - a)


ACTIVATIONS = {"relu": relu, "leaky_relu": leaky_relu, "sigmoid": sigmoid,
               "linear": lambda x: x, None: lambda x: x}


def activation(name):
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}")
    return ACTIVATIONS[name]


def softmax(v: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    def scaled(s: Column) -> Column:
        return F.transform(s["v"], lambda x: F.exp(x - s["top"]))

    def shares(s: Column) -> Column:
        return F.transform(s["e"], lambda x: x / s["total"])

    exps = let(F.struct(v.alias("v"), F.array_max(v).alias("top")), scaled)
    return let(exps, lambda e: let(F.struct(e.alias("e"), F.aggregate(e, F.lit(0.0), lambda a, x: a + x).alias("total")), shares))


# --- per-row losses and their slopes ---------------------------------------

def bce(y: Column, score: Column, from_logits: bool = False, eps: float = 1e-9,
        pos_weight: float = 1.0) -> Column:
    p = probability(score, from_logits, eps)
    w = F.when(y == 1, F.lit(float(pos_weight))).otherwise(1.0)
    return -w * (y * F.log(p) + (1.0 - y) * F.log(1.0 - p))


def bce_slope(y: Column, score: Column, n: Column, from_logits: bool = False,
              eps: float = 1e-9, pos_weight: float = 1.0) -> Column:
    w = F.when(y == 1, F.lit(float(pos_weight))).otherwise(1.0)
    if from_logits:
        return w * (sigmoid(score) - y) / n
    p = probability(score, False, eps)
    return w * (-y / p + (1.0 - y) / (1.0 - p)) / n


def _focal_parts(y: Column, score: Column, alpha: float, from_logits: bool, eps: float):
    p = probability(score, from_logits, eps)
    p_t = F.when(y == 1, p).otherwise(1.0 - p)
    a_t = F.when(y == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    return p, p_t, a_t


def focal(y: Column, score: Column, alpha: float = 0.25, gamma: float = 2.0,
          from_logits: bool = False, eps: float = 1e-9) -> Column:
    _, p_t, a_t = _focal_parts(y, score, alpha, from_logits, eps)
    return -a_t * F.pow(1.0 - p_t, F.lit(gamma)) * F.log(p_t)


def focal_slope(y: Column, score: Column, n: Column, alpha: float = 0.25, gamma: float = 2.0,
                from_logits: bool = False, eps: float = 1e-9) -> Column:
    p, p_t, a_t = _focal_parts(y, score, alpha, from_logits, eps)
    sign = F.when(y == 1, 1.0).otherwise(-1.0)
    fading = -gamma * F.pow(1.0 - p_t, F.lit(gamma - 1.0)) * F.log(p_t)
    pull = -F.pow(1.0 - p_t, F.lit(gamma)) / p_t
    slope = sign * a_t * (fading + pull)
    return slope * p * (1.0 - p) / n if from_logits else slope / n
