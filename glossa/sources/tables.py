"""Table and text sources.

Parquet is the format between steps (splittable, typed, pushdown). CSV is read
the way a quoted export needs: header, multi-line quoted cells, ``"`` escaped
by doubling. Multi-line CSV is not splittable — convert it to Parquet once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glossa.functions.text import na_normalize

CSV_READ = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
            "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
CORRUPT = "_corrupt_record"   # the raw row of a CSV record that does not fit its schema


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", na_rules: str = "spark",
               schema: str | StructType | None = None, infer: bool = False,
               keep_corrupt: bool = False) -> DataFrame:
    """Read a table. ``na_rules='pandas'`` turns the pandas NA spellings of
    string cells (``NA``, ``null``, ``None``, ``nan``, ...) into nulls.

    CSV without a schema reads every column as text (no extra pass); typed
    columns are cast where they are used (``try_cast``). ``infer=True`` infers
    types from all rows (one more pass). With a schema, ``keep_corrupt=True`` adds
    the raw text of every record that does not fit it as ``_corrupt_record``
    (``malformed`` counts them), so nothing turns null unseen.
    """
    r = spark.read
    if schema:
        if keep_corrupt and fmt == "csv":
            given = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            schema = StructType([*given.fields, StructField(CORRUPT, StringType())])
        r = r.schema(schema)
    if fmt == "csv":
        r = r.options(**CSV_READ)
        if infer and not schema:
            r = r.option("inferSchema", "true")
        df = r.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    else:
        df = r.format(fmt).load(path)
    if na_rules == "pandas":
        df = df.select(*[na_normalize(c).alias(c) if t == "string" and c != CORRUPT else F.col(c) for c, t in df.dtypes])
    return df


def malformed(df: DataFrame) -> int:
    """Records of a ``keep_corrupt`` read that do not fit the schema. The hash keeps
    all columns in the scan: a pruned one would not be parsed."""
    rest = [c for c in df.columns if c != CORRUPT]
    return df.agg(F.count_if(F.col(CORRUPT).isNotNull()).alias("n"), F.max(F.xxhash64(*rest))).first().n


def read_wholetext(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``value``): templates and question banks."""
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (``value``), newline stripped, blank lines dropped."""
    return spark.read.text(path).where(F.trim("value") != "")
