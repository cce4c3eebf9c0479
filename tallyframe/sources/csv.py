"""CSV scan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions.columns import unused
from tallyframe.operators.clean import named


def scan_csv(
    spark: SparkSession,
    path: str,
    types: T.StructType | None = None,
    infer: bool = False,
    corrupt: str | None = None,
    same_header: bool = True,
) -> DataFrame:
    """Read CSV with a header line and doubled quotes; ``path`` may be on any Hadoop file system.

    Columns are matched to ``types`` by their name in the header, so their order does not matter and
    columns may lack or be added; a column without a declared type is text. Only the header line is read
    for that. ``infer`` reads all rows once more to find types (see ``scan_checked`` for types that some rows do not fit). Rows that do not fit have null in the bad
    field; with ``corrupt`` their whole line is kept in a column of that name. A missing file raises. Of a
    folder the first header counts, and any file with another one raises; without ``same_header`` such a file is read by
    the position of its columns. A ``.gz`` file is read by one task.
    """
    reader = spark.read.option("header", True).option("escape", '"').option("mode", "PERMISSIVE")
    if infer:
        inferred = reader.option("inferSchema", True).csv(path)
        if not corrupt:
            return inferred
        types = inferred.schema
    declared = {f.name: f.dataType for f in types.fields} if types else {}
    header = reader.csv(path).columns
    schema = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
    if corrupt:
        schema = schema.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    if not same_header:
        return reader.schema(schema).csv(path)
    # a column without a name is called _c<position> by Spark, but is compared by its empty name
    first = spark.read.option("escape", '"').csv(path).first()
    given = [schema[n].name if n >= len(header) or first[n] else "" for n in range(len(schema))]
    compared = T.StructType([T.StructField(g, f.dataType) for g, f in zip(given, schema, strict=True)])
    return reader.schema(compared).option("enforceSchema", False).csv(path).toDF(*schema.names)


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop a first column without a name in the header (row numbers), which Spark calls ``_c0``."""
    return df.drop("_c0")


class Checked(NamedTuple):
    """Rows of a scan, each with the cause that makes it bad and its line; both are null in a good row."""

    rows: DataFrame
    cause: str
    line: str


_GUESSED = [T.LongType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()]


def scan_checked(
    spark: SparkSession,
    path: str,
    types: T.StructType | None = None,
    infer: bool = False,
    columns: Sequence[str] | None = None,
    tolerance: float = 0.99,
) -> Checked:
    """Read CSV so that each row is good or has a cause: ``line`` for a wrong number of fields, or the first bad column.

    Fields are read as text and cast to ``types`` by name; a field that is not empty and does not fit makes its row bad.
    ``infer`` finds the types of the other columns in one pass over the well-formed lines: the first of whole number,
    number, date and time that ``tolerance`` of the known fields fit, else text. So some bad fields do not make a
    column text, as they do in Spark's own inference. ``columns`` names the fields of files without a header line.
    """
    reader = spark.read.option("escape", '"').option("mode", "PERMISSIVE").option("columnPruning", False)
    names = list(columns or reader.option("header", True).csv(path).columns)
    text = T.StructType([T.StructField(c, T.StringType()) for c in names])
    line, cause = unused(spark.createDataFrame([], text), "_line", "_cause")
    reader = reader.option("header", columns is None).option("columnNameOfCorruptRecord", line)
    rows = reader.schema(text.add(line, T.StringType())).csv(path)
    declared = {f.name: f.dataType for f in types.fields} if types else {}
    if infer:
        guessed = _guess(rows.filter(named(line).isNull()), [c for c in names if c not in declared], tolerance)
        declared = guessed | declared
    typed = {c: named(c).try_cast(declared[c]) for c in names if c in declared}
    bad = [F.when((F.trim(named(c)) != "") & value.isNull(), F.lit(c)) for c, value in typed.items()]
    causes = F.coalesce(F.when(named(line).isNotNull(), F.lit("line")), *bad)
    kept = F.when(causes.isNotNull(), F.coalesce(named(line), F.to_csv(F.struct(*[named(c) for c in names]))))
    cells = [typed.get(c, named(c)).alias(c) for c in names]
    return Checked(rows.select(*cells, causes.alias(cause), kept.alias(line)), cause, line)


def _guess(rows: DataFrame, cols: Sequence[str], tolerance: float) -> dict[str, T.DataType]:
    if not cols:
        return {}
    known = {c: F.nullif(F.trim(named(c)), F.lit("")) for c in cols}

    def fitting(text: Column, dtype: T.DataType) -> Column:
        # a time can be cast to a date, which would lose the hour
        return F.count(F.when(~F.lit(dtype == T.DateType()) | (F.length(text) <= 10), text.try_cast(dtype)))

    fits = [F.array(F.count(k), *[fitting(k, t) for t in _GUESSED]).alias(f"c{n}") for n, k in enumerate(known.values())]
    counts = rows.agg(*fits).first()
    found = {}
    for n, c in enumerate(cols):
        total, *fit = counts[n]
        found |= {c: t for t, k in reversed(list(zip(_GUESSED, fit, strict=True))) if total and k >= tolerance * total}
    return found
