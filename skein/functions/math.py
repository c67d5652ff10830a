"""Arithmetic of scores, edges and vectors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_EQUATION = re.compile(r"\s*(?:(?:\d+(?:\.\d+)?|pos|neg|obscene|[-+*/()])\s*)+")


def equation(text: str) -> Column:
    """A stored equation over pos, neg, obscene as a column; null where it divides by zero.

    Only numbers, these names, + - * / and parentheses are allowed. Division is true division.
    """
    if not _EQUATION.fullmatch(text):
        raise ValueError(f"not an equation over pos, neg, obscene: {text!r}")
    divides = "/" in text
    names = re.sub(r"(\d+(?:\.\d+)?|pos|neg|obscene)", r"cast(\1 as double)", text)
    return F.expr(_tried(names) if divides else names).cast("double")


def _tried(text: str) -> str:
    """a / b as a / nullif(b, 0), b being a parenthesis, a cast or a number."""
    out, at = "", 0
    while (slash := text.find("/", at)) >= 0:
        out += text[at:slash] + "/ nullif("
        at = slash + 1
        while text[at] == " ":
            at += 1
        end, depth = at, 0
        while end < len(text):
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
            if not depth and text[end - 1] == ")":
                break
        out += _tried(text[at:end]) + ", 0)"
        at = end
    return out + text[at:]


def edge_value(frequency: Column, score: Column) -> Column:
    return frequency * F.log2(F.greatest(score + 1, F.lit(1))) / 10


def branching_discount(branches: Column) -> Column:
    x = F.log(branches + 5) / F.log(F.lit(5.0)) - 2.5
    return F.exp(-x * x / 2) / (2 * 3.141592653589793) ** 0.5


def noisy_or(a: Column, b: Column) -> Column:
    return F.greatest(a, b) + (1 - F.greatest(a, b)) * F.least(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def noisy_or_of(values: Column) -> Column:
    """Noisy or of an array, in order."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: noisy_or(acc, x))


def colour_mix(similarities: list[Column], colours: list[tuple[int, int, int]]) -> list[Column]:
    """Red, green and blue of colours mixed by the cubes of similarities to them; each from 0 to 255, grey if the cubes
    add up to 0."""
    cubes = [s * s * s for s in similarities]
    total = sum(cubes[1:], cubes[0])
    out = []
    for i in range(3):
        parts = [F.lit(float(c[i])) * w / total for c, w in zip(colours, cubes)]
        mixed = sum(parts[1:], parts[0])
        out.append(F.when(total == 0, 128).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(255.0), mixed)).cast("int")))
    return out


def valued(df, value, keep=()):
    """df with v = value(df), rows of all conditions in ``keep`` only; value and conditions make columns of a frame."""
    for condition in keep:
        df = df.where(condition(df))
    return df.withColumn("v", value(df))


def coalesce_sum(x: Column) -> Column:
    """The sum, 0 of nothing."""
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def register_table_functions(spark) -> None:
    """skein_terms(text, mark): rows pos, term of a delimited text."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, term string")
    class Terms:
        def eval(self, text: str, mark: str):
            for i, term in enumerate((text or "").split(mark)):
                yield i, term

    spark.udtf.register("skein_terms", Terms)


def rounded(x: Column, places: int) -> Column:
    """A double with so many decimal places as SQL engines round it that scale by a power of ten: halves of the scaled
    value away from zero. (Spark's own rounds the shortest decimal that stands for it, so 157.325 up.)"""
    scaled = F.abs(x * 10.0**places)
    whole = F.floor(scaled)
    up = whole + F.when(scaled - whole >= 0.5, 1.0).otherwise(0.0)
    exact = x.isNull() | F.isnan(x) | (F.abs(x) >= 2.0**52 / 10.0**places)
    return F.when(exact, x).otherwise(F.signum(x) * up / 10.0**places)
