"""The CSV staging table, whose arrays are kept as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A record is a line, as line breaks are written as marks; so one large file is
# read by several tasks.
_CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


#: What stands for a backslash and for line breaks.  The backslash goes first and
#: comes back last, so no text looks like a mark, nor like the one for null.
_MARKS = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def _escaped(column: Column) -> Column:
    for text, mark in _MARKS:
        column = F.replace(column, F.lit(text), F.lit(mark))
    return column


def _unescaped(column: Column) -> Column:
    for text, mark in reversed(_MARKS):
        column = F.replace(column, F.lit(mark), F.lit(text))
    return column


#: A compressed file cannot be cut, so it holds no more rows than one task should read.
_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 100_000}


def write_staging_csv(
    df: DataFrame, path: str, partition_by: tuple[str, ...] = (), packed: bool = False
) -> None:
    """Write a header CSV; arrays become JSON text.

    The columns of ``partition_by`` go into the names of folders, as they are.
    ``packed`` files take a third of the disk.
    """

    def flat(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.ArrayType):
            return F.to_json(field.name).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return _escaped(F.col(field.name)).alias(field.name)
        return F.col(field.name)

    options = _CSV | (_PACKED if packed else {})
    df.select(*map(flat, df.schema)).write.mode("overwrite").options(**options).partitionBy(*partition_by).csv(path)


def _once(column: Column) -> Column:
    """The same value, worked out once for a row.

    Filters and projections above a generator are not pushed below it, so what they
    use of the value does not parse the line again.
    """
    return F.explode(F.array(column))


def read_staging_lines(
    spark: SparkSession, path: str, schema: T.StructType
) -> tuple[DataFrame, DataFrame]:
    """The sound records in the types of ``schema``, and the others: ``file``, ``line`` and ``reason``.

    A record is turned down if it has another number of fields, or a text that
    is not of its column's type; the reason names all such columns.  Nothing is
    lost: every line but the headers is in one of the two.  Both read the lines
    once and in parallel, as a record is a line.
    """
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    with_bad = T.StructType([*text, T.StructField("_bad", T.StringType())])
    options = {k: str(v) for k, v in _CSV.items() if k != "header"}
    options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    header = ",".join(f.name for f in schema)
    lines = (
        spark.read.text(path)
        .select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("_line"))
        .filter((F.col("_line") != header) & (F.col("_line") != ""))
    )
    fields = lines.select("_file", "_line", _once(F.from_csv("_line", with_bad.simpleString(), options)).alias("_text"))

    def typed(field: T.StructField) -> Column:
        value = F.col(f"_text.`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            return F.from_json(value, field.dataType)
        if isinstance(field.dataType, T.StringType):
            return _unescaped(value)
        return value.try_cast(field.dataType)

    values = fields.select("*", _once(F.struct(*[typed(f).alias(f.name) for f in schema])).alias("_typed"))
    wrong = [
        F.when(F.col(f"_text.`{f.name}`").isNotNull() & F.col(f"_typed.`{f.name}`").isNull(), F.lit(f.name))
        for f in schema
    ]
    read = values.select(
        "_file",
        "_line",
        F.when(F.col("_text._bad").isNotNull(), F.lit(f"not {len(schema)} fields"))
        .otherwise(F.nullif(F.concat(F.lit("wrong type: "), F.array_join(F.array(*wrong), ", ")), F.lit("wrong type: ")))
        .alias("_reason"),
        *[F.col(f"_typed.`{f.name}`").alias(f.name) for f in schema],
    )
    rejects = read.filter("_reason IS NOT NULL").select(
        F.col("_file").alias("file"), F.col("_line").alias("line"), F.col("_reason").alias("reason")
    )
    return read.filter("_reason IS NULL").select(*schema.names), rejects


def read_staging_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read a staging CSV back into the types of ``schema``."""
    text = T.StructType(
        [
            T.StructField(
                f.name, T.StringType() if isinstance(f.dataType, T.ArrayType) else f.dataType
            )
            for f in schema
        ]
    )

    def typed(field: T.StructField) -> Column:
        if isinstance(field.dataType, T.ArrayType):
            return F.from_json(field.name, field.dataType).alias(field.name)
        if isinstance(field.dataType, T.StringType):
            return _unescaped(F.col(field.name)).alias(field.name)
        return F.col(field.name)

    return spark.read.schema(text).options(**_CSV).csv(path).select(*map(typed, schema))
