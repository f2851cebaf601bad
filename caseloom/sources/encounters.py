"""Wide encounter tables: schema, scans, cleaning, and the array and long forms of the code columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.codes import clean_code
from caseloom.functions.numbers import lenient_double

# Column names of the wide encounter table.
ID_COLUMN = "N"
DX_COLUMNS = tuple(f"I10_DX{i}" for i in range(1, 35))
CPT_COLUMNS = tuple(f"CPT{i}" for i in range(1, 101))
LABEL_COLUMN = "Readmitted30"
SCORE_COLUMN = "CCI_Score"
NUMBER_COLUMNS = {"AGE": "double", "LOS": "double", "I10_NDX": "int", "NCPT": "int", LABEL_COLUMN: "int"}

# How many codes of each kind a feature tier uses.
TIERS = {"rich": (34, 100), "limited": (5, 5)}


def encounter_schema(with_score: bool = False) -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in (ID_COLUMN, *DX_COLUMNS, *CPT_COLUMNS)]
    kinds = {"double": T.DoubleType(), "int": T.IntegerType()}
    fields += [T.StructField(c, kinds[kind]) for c, kind in NUMBER_COLUMNS.items()]
    if with_score:
        fields.append(T.StructField(SCORE_COLUMN, T.IntegerType()))
    return T.StructType(fields)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Return ``df``, or stop with the names of the missing columns. Reads the schema only."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available are {df.columns}")
    return df


def add_missing_columns(df: DataFrame, columns, kind: str = "string") -> DataFrame:
    """Add every absent column as NULL of type ``kind``."""
    return df.withColumns({c: F.lit(None).cast(kind) for c in columns if c not in df.columns})


def read_encounter_csv(spark: SparkSession, path: str) -> DataFrame:
    """Encounter CSV with a header row, columns in any order, some possibly absent.

    Files whose headers differ are an error. Every column is read as text, so leading zeros and codes like ``86152``
    survive; numbers are cast leniently.
    """
    return conform(spark.read.option("header", True).option("enforceSchema", False).csv(path))


def read_checked_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Good rows in the encounter schema, and rejected lines as ``(file, line, reason)``.

    ``columns`` are the columns of the files in their order, with or without a ``header`` line. A line is rejected if it has more or fewer fields, or no
    encounter id, or text in a number column; it is kept whole, with the first reason. Both tables come from one scan each;
    cleaning is that of ``conform``.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, "_line")])
    read = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
    raw = read.option("columnNameOfCorruptRecord", "_line").csv(path).withColumn("_file", F.col("_metadata.file_path"))
    numbers = [F.col(c) for c in NUMBER_COLUMNS if c in columns]
    wrong = [(F.trim(c) != "") & lenient_double(c).isNull() for c in numbers]
    reason = F.when(F.col("_line").isNotNull(), "number of fields").when(F.col(ID_COLUMN).isNull(), "no encounter id")
    for name, bad in zip([c for c in NUMBER_COLUMNS if c in columns], wrong, strict=True):
        reason = reason.when(bad, f"no number in {name}")
    judged = raw.withColumn("_reason", reason)
    whole = F.coalesce("_line", F.concat_ws(",", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    rejected = judged.where(F.col("_reason").isNotNull()).select(F.col("_file").alias("file"), whole.alias("line"), F.col("_reason").alias("reason"))
    return conform(judged.where(F.col("_reason").isNull()).drop("_line", "_file", "_reason")), rejected


def read_encounters(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def conform(raw: DataFrame) -> DataFrame:
    """Bring a raw table to the encounter schema; extra columns pass through, absent code columns become NULL."""
    require_columns(raw, [ID_COLUMN])
    df = add_missing_columns(raw, (*DX_COLUMNS, *CPT_COLUMNS))
    numbers = {**NUMBER_COLUMNS, SCORE_COLUMN: "int"}
    casts: dict[str, Column] = {ID_COLUMN: F.col(ID_COLUMN).cast("string")}
    for name in (*DX_COLUMNS, *CPT_COLUMNS):
        casts[name] = clean_code(F.col(name).cast("string"))
    for name, kind in numbers.items():
        if name in df.columns:
            casts[name] = lenient_double(F.col(name)).try_cast(kind)
    return df.withColumns(casts)


def fill_categorical(df: DataFrame, columns) -> DataFrame:
    return df.fillna("missing", subset=list(columns))


def fill_numeric(df: DataFrame, columns) -> DataFrame:
    return df.fillna(0, subset=list(columns))


def tier_columns(tier: str) -> list[str]:
    """Feature columns of a tier: score, diagnosis codes, procedure codes."""
    dx, cpt = TIERS[tier]
    return [SCORE_COLUMN, *DX_COLUMNS[:dx], *CPT_COLUMNS[:cpt]]


def with_code_arrays(df: DataFrame, dx: int = len(DX_COLUMNS), cpt: int = len(CPT_COLUMNS)) -> DataFrame:
    """Add ``dx_codes`` and ``cpt_codes``, the wide columns as arrays in position order (NULLs kept)."""
    return df.withColumns(
        {
            "dx_codes": F.array(*[F.col(c) for c in DX_COLUMNS[:dx]]),
            "cpt_codes": F.array(*[F.col(c) for c in CPT_COLUMNS[:cpt]]),
        }
    )


def long_codes(df: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """``(key, kind, pos, code)``, one row per filled code position, positions from 1. No shuffle."""
    def tagged(kind: str, columns) -> Column:
        codes = F.array(*[F.col(c) for c in columns])
        return F.transform(
            codes, lambda code, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("pos"), code.alias("code"))
        )

    both = F.concat(tagged("dx", DX_COLUMNS), tagged("cpt", CPT_COLUMNS))
    return df.select(key, F.inline(F.filter(both, lambda cell: cell["code"].isNotNull())))


def first_positions(codes: DataFrame, key: str, order: list, limit: int, out: str = "pos") -> DataFrame:
    """Number the codes of every key and keep positions 1..limit.

    The bound makes Spark cut each group to ``limit`` rows before the shuffle, so one huge group does not land on a task.
    """
    position = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return codes.withColumn(out, position).where(F.col(out) <= limit)


def widen(codes: DataFrame, key: str, columns: dict[str, tuple[str, int]]) -> DataFrame:
    """Long codes with ``pos`` back to one row per key; ``columns`` maps output name to (code column, position)."""
    picks = [F.max(F.when(F.col("pos") == pos, F.col(code))).alias(name) for name, (code, pos) in columns.items()]
    return codes.groupBy(key).agg(*picks)
