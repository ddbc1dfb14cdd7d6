"""Delimited text: lenient reading, and strict ingest with reject reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import expr as X

FLOAT_MAX = 3.4028235677973366e38  # first magnitude a 32-bit float cannot hold


def unique_names(names: Sequence[str]) -> list[str]:
    """Trimmed header names; a repeated name gets a numbered suffix."""
    seen: set[str] = set()
    out = []
    for n in (n.strip() for n in names):
        k, name = 1, n
        while name in seen:
            k += 1
            name = f"{n}_{k}"
        seen.add(name)
        out.append(name)
    return out


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as trimmed text: blank lines dropped, short rows padded with '', long rows cut, no quoting.

    The header of one file names the columns; every file starts with the same header.
    """
    opts = dict(header=True, sep=sep, quote="", mode="PERMISSIVE",
                ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    # Names come from the header line itself, so that repeated names are seen as written.
    first = (spark.read.text(path).filter(F.length("value") > 0)
             .where(F.col("_metadata.file_block_start") == 0).limit(1).first())
    names = unique_names(first["value"].split(sep)) if first else []
    schema = ", ".join(f"_c{i} string" for i in range(len(names)))
    raw = spark.read.schema(schema).options(**opts).csv(path, enforceSchema=True)
    return raw.select(*[F.coalesce(F.trim(F.col(f"_c{i}")), F.lit("")).alias(n) for i, n in enumerate(names)])


def cast_numeric(df: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Numeric columns to double with one missing value (NULL)."""
    return X.parse_columns(df, numeric)


def strict_records(lines: DataFrame, line: str, n_features: int, keep: Sequence[str] = (), sep: str = ",") -> DataFrame:
    """One pass over raw lines: features as 32-bit floats, label byte, and why a row is rejected.

    Too few fields, an unreadable number or an unknown label reject a row; an
    empty feature is 0.0; the label is the last field.
    """
    def number(cell):
        t = F.trim(cell)
        return F.when(t == "", F.lit(0.0)).otherwise(X.to_double(t))

    def unusable(v):
        # NaN sorts above every number, so it is excluded before the range check.
        return v.isNull() | (~F.isnan(v) & (F.abs(v) != F.lit(X.INF)) & (F.abs(v) >= F.lit(FLOAT_MAX)))

    def judge(cells):
        label = F.upper(F.trim(F.element_at(cells, -1)))

        def record(values):
            reason = (F.when(F.size(cells) < n_features + 1, "short").when(F.exists(values, unusable), "number")
                      .when(~label.isin("ATTACK", "BENIGN"), "label"))
            return F.struct(values.alias("x"), F.when(label == "ATTACK", 1).otherwise(0).cast("tinyint").alias("label"),
                            reason.alias("reason"))

        return X.let(F.transform(F.slice(cells, 1, n_features), number), record)

    # The line is split once and each cell read once; a filter on the reason that is
    # pushed below the projection repeats this expression once, not once per use.
    judged = lines.select(*keep, X.let(F.split(F.col(line), sep, -1), judge).alias("_r"))
    return judged.select(*keep, *[F.get("_r.x", F.lit(i)).cast("float").alias(f"f{i}") for i in range(n_features)],
                         F.col("_r.label").alias("label"), F.col("_r.reason").alias("reject_reason"))


def accepted(records: DataFrame) -> DataFrame:
    return records.filter("reject_reason IS NULL").drop("reject_reason")


def reject_counts(records: DataFrame) -> DataFrame:
    """Rows written and rows skipped per reason."""
    return (records.groupBy(F.coalesce("reject_reason", F.lit("written")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("n")))


def head_rows(df: DataFrame, n: int, order: Sequence[str], features: Sequence[str], label: str) -> DataFrame:
    """First n rows in order: declared features (empty is 0.0) and 0/1 label, by top-k."""
    top = df.orderBy(*order).limit(n)
    cols = [F.when(F.trim(F.col(f)) == "", 0.0).otherwise(X.to_double(F.col(f))).alias(f) for f in features]
    y = F.when(F.upper(F.trim(F.col(label))) == "BENIGN", 0).otherwise(1)
    return top.select(*order, *cols, y.alias("label"))
