"""Ratios, clipping, probability transforms and output normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

PROBABILITY_EPSILON = 1e-6


def whole_number(value: Column, kind: str = "bigint") -> Column:
    """Lenient whole number: text such as ``54635.0`` counts, anything without a numeric reading or with a fraction is null."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), number.try_cast(kind)))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """``n / d``; 0.0 when the denominator is zero."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def ratio_or_null(numerator: Column, denominator: Column) -> Column:
    """``n / d``; null when the denominator is zero or missing."""
    return F.try_divide(numerator, denominator)


def percent_or_null(numerator: Column, denominator: Column) -> Column:
    return ratio_or_null(numerator, denominator) * 100.0


def percent_or_zero(numerator: Column, denominator: Column) -> Column:
    return ratio_or_zero(numerator, denominator) * 100.0


def clip(value: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound a value; null stays null."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def logit(probability: Column, epsilon: float = PROBABILITY_EPSILON) -> Column:
    """ln(p / (1 - p)), written with one mention of p so that nested scores stay small expressions."""
    return -F.ln(1.0 / clip(probability, epsilon, 1.0 - epsilon) - 1.0)


def sigmoid(z: Column) -> Column:
    """Logistic function. A large negative z makes the exponential infinite and the result exactly 0."""
    return 1.0 / (1.0 + F.exp(-z))


def platt(probability: Column, coefficient: Column | float, intercept: Column | float,
          epsilon: float = PROBABILITY_EPSILON) -> Column:
    """Apply a fitted sigmoid calibrator to a raw probability."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return sigmoid(as_column(coefficient) * logit(probability, epsilon) + as_column(intercept))


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def normalise_record(df: DataFrame) -> DataFrame:
    """Make a table fit for JSON: NaN becomes null, dates and timestamps become yyyy-MM-dd text."""
    def plain(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(value), value).alias(field.name)
        if isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.date_format(value, "yyyy-MM-dd").alias(field.name)
        return value

    return df.select(*[plain(field) for field in df.schema.fields])
