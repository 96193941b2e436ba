"""Reports: JSON, aligned text, Markdown and escaped tab-separated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines into a folder that must not exist."""
    df.write.mode("errorifexists").json(path)


def json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def escaped(c: Column) -> Column:
    """Backslash, tab and line breaks written as two characters."""
    out = F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def tsv_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.coalesce(escaped(F.col(c)), F.lit("")) for c in df.columns]).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Table rows; cells with a bar are escaped."""
    cell = lambda c: F.replace(F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("|"), F.lit("\\|"))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |")).alias("value"))


def with_total(df: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """The rows and a TOTAL row; columns that aren't summed are null in it."""
    total = df.agg(*[F.sum(c).alias(c) for c in sums])
    cast = [F.lit("TOTAL").alias(c) if c == label else F.col(c) if c in sums else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]
    return df.withColumn(label, F.col(label).cast("string")).unionByName(total.select(*cast))


def aligned_rows(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Right-aligned cells of given widths; the first column is aligned left."""
    first = df.columns[0]
    cell = lambda c: (F.rpad if c == first else F.lpad)(F.coalesce(F.col(c).cast("string"), F.lit("-")), widths.get(c, 10), " ")
    return df.select(F.concat_ws(" ", *map(cell, df.columns)).alias("value"))
