"""CSV and parquet tables of prompts and results."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattsift.functions.text import category_label, model_name, model_precision, number_or_null, precision_label
from wattsift.schemas import CANONICAL_NAMES, PROMPT_FILE, RESULT_FILES
from wattsift.sources.quoted import read_quoted

# Quoted fields may hold commas, doubled quotes and line breaks; surrounding blanks are data.
CSV = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "multiLine": True,
    "enforceSchema": False,
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
CSV_WRITE = {k: v for k, v in CSV.items() if k not in ("multiLine", "enforceSchema")} | {"quoteAll": True}

# For readers that cannot split text with line breaks inside a file; ``read_quoted`` can.
ROWS_PER_FILE = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with or without a UTF-8 byte order mark. A header other than the schema's columns, in order, fails the read."""
    return spark.read.schema(schema).options(**CSV).csv(path)


def _canonical(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(CANONICAL_NAMES.get(c, c)) for c in df.columns])


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    rows = _canonical(read_quoted(spark, path, PROMPT_FILE))
    return rows.withColumnRenamed("run_id", "prompt_id").withColumn("prompt_id", F.col("prompt_id").cast("bigint"))


def read_runs(spark: SparkSession, path: str, variant: str) -> DataFrame:
    """A result file of one of the known variants, under canonical column names; columns are found by name.

    Blank score columns (text in unscored files) come back as NULL doubles. ``unreadable`` has the text of records with
    a cell that its column cannot hold or a wrong number of cells, and is NULL for others.
    """
    rows = _canonical(read_quoted(spark, path, RESULT_FILES[variant], corrupt="unreadable"))
    scores = [c for c in ("q_ped", "lpw") if c in rows.columns]
    bad = F.col("unreadable")
    for c in scores:
        if rows.schema[c].dataType == T.StringType():
            bad = F.coalesce(bad, F.when(_score(rows, c).isNull() & (F.trim(c) != ""), F.concat(F.lit(f"{c}: "), F.col(c))))
    return rows.withColumn("unreadable", bad).withColumns({c: _score(rows, c) for c in scores})


def _score(df: DataFrame, name: str) -> Column:
    text = df.schema[name].dataType == T.StringType()
    return number_or_null(F.col(name)) if text else F.col(name).cast("double")


def harmonise(*tables: DataFrame) -> DataFrame:
    """Union of result variants: canonical names, one spelling per label, blank scores and missing columns NULL.

    A variant without a precision column has it behind the model's name.
    """

    def clean(df: DataFrame) -> DataFrame:
        df = _canonical(df)
        labels: dict[str, Column] = {c: _score(df, c) for c in ("q_ped", "lpw") if c in df.columns}
        if "model" in df.columns and "precision" not in df.columns:
            labels["precision"] = precision_label(model_precision(F.col("model")))
            labels["model"] = model_name(F.col("model"))
        if "category" in df.columns:
            labels["category"] = category_label(F.col("category"))
        if "precision" in df.columns:
            labels["precision"] = precision_label(F.col("precision"))
        return df.withColumns(labels)

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(clean, tables))


def write_csv(df: DataFrame, path: str, bom: bool = False, rows_per_file: int = ROWS_PER_FILE) -> None:
    """CSV with header; ``bom`` puts a byte order mark ahead of each file's header."""
    if bom:
        first = df.columns[0]
        df, options = df.withColumnRenamed(first, "\ufeff" + first), CSV_WRITE | {"quoteAll": False}
    else:
        options = CSV_WRITE
    df.write.options(**options, maxRecordsPerFile=rows_per_file).csv(path)


def write_runs(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Results table; parquet unless a CSV export is asked for."""
    if fmt == "csv":
        write_csv(df, path)
    else:
        df.write.partitionBy(*(partition_by or [])).format(fmt).save(path)
