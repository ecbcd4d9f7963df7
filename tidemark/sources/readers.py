"""Reading exports: wrapped values, mixed date formats, bad numbers, required fields."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PARSE_FAILURES = 0.05
EPOCH_MILLIS_ABOVE = 1e11
_TIME = "[ H:mm[:ss]]"
# Shape of the text -> formats tried in order, month first before day first.
# A failed parse costs an exception inside Spark, so only formats of the right shape are tried.
DATE_SHAPES = {
    r"^(0?[1-9]|1[0-2])/": ("M/d/yyyy", "d/M/yyyy"),
    r"^\d{1,2}/": ("d/M/yyyy",),
    r"^\d{4}/": ("yyyy/M/d",),
    r"^(0?[1-9]|1[0-2])-": ("M-d-yyyy", "d-M-yyyy"),
    r"^\d{1,2}-\d": ("d-M-yyyy",),
    r"^\d{1,2}\.": ("d.M.yyyy",),
    r"^[A-Za-z]+ \d": ("MMM d, yyyy", "MMMM d, yyyy"),
    r"^\d{1,2} [A-Za-z]": ("d MMM yyyy", "d MMMM yyyy"),
    r"^\d{8}$": ("yyyyMMdd",),
}

_WRAPPERS = {"$oid", "$date", "$numberLong", "$numberInt", "$numberDouble", "$numberDecimal"}


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: Column | None = None) -> DataFrame:
    """A filtered and projected parquet scan; both reach the file reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def parse_date(raw: str | Column) -> Column:
    """Epoch milliseconds, then ISO, then month-first, then day-first formats; null when nothing fits."""
    text = (F.col(raw) if isinstance(raw, str) else raw).cast("string")
    number = text.try_cast("double")
    millis = F.when(number > EPOCH_MILLIS_ABOVE, F.timestamp_millis(number.try_cast("bigint")))
    # A bare number is no ISO date, whatever its length.
    iso = F.when(number.isNull(), text.try_cast("timestamp"))
    shaped = F.when(F.lit(False), F.lit(None).cast("timestamp"))
    for shape, formats in DATE_SHAPES.items():
        tail = "" if shape.endswith("$") else _TIME
        shaped = shaped.when(text.rlike(shape), F.coalesce(*[F.try_to_timestamp(text, F.lit(f + tail)) for f in formats]))
    return F.coalesce(millis, iso, shaped)


def parse_dates(df: DataFrame, columns: Iterable[str], max_failures: float = MAX_PARSE_FAILURES) -> DataFrame:
    """Replace raw date columns by timestamps; too many failures in any column stop the job."""
    columns = list(columns)
    report = df.agg(*[
        F.coalesce(F.avg((F.col(c).isNotNull() & parse_date(c).isNull()).cast("int")), F.lit(0.0)).alias(c)
        for c in columns]).first()
    bad = {c: report[c] for c in columns if report[c] > max_failures}
    if bad:
        raise ValueError(f"share of dates that do not parse: {bad}")
    return df.withColumns({c: parse_date(c) for c in columns})


def to_number(raw: str | Column) -> Column:
    """Number, or null for anything that is not one."""
    return (F.col(raw) if isinstance(raw, str) else raw).try_cast("double")


def _unwrap(c: Column, kind: T.DataType) -> Column:
    """Value of a wrapper object; other values unchanged."""
    if isinstance(kind, T.StructType):
        names = set(kind.fieldNames())
        if names and names <= _WRAPPERS:
            parts = [_unwrap(c[f.name], f.dataType).cast("string") for f in kind.fields]
            return F.coalesce(*parts)
        return F.struct(*[_unwrap(c[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _unwrap(x, kind.elementType))
    return c


def _leaves(c: Column, kind: T.DataType, name: str) -> list[Column]:
    if isinstance(kind, T.StructType) and not set(kind.fieldNames()) <= _WRAPPERS:
        return [leaf for f in kind.fields for leaf in _leaves(c[f.name], f.dataType, f"{name}_{f.name}")]
    return [_unwrap(c, kind).alias(name)]


def flatten(df: DataFrame) -> DataFrame:
    """Unwrap `$oid`, `$date`, `$number…` objects and turn nested objects into a_b columns."""
    return df.select(*[leaf for f in df.schema.fields for leaf in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)])


def read_export(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """A JSON export, flattened.  Line-delimited files split over tasks; one big array does not."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return flatten(reader.json(path))


def load_records(spark: SparkSession, path: str, schema: T.StructType | str, required: Sequence[str], at,
                 lines: bool = False) -> DataFrame:
    """Records of a hand-kept file: malformed JSON or an empty required field is an error; stamped with `at`."""
    df = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    gaps = df.agg(*[F.count_if(F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(c) for c in required]).first()
    missing = {c: gaps[c] for c in required if gaps[c]}
    if missing:
        raise ValueError(f"required fields without a value: {missing}")
    return df.withColumn("updated_at", F.lit(at).cast("timestamp"))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Exactly the named columns, each filled with its default when null or absent."""
    return df.select(*[
        F.coalesce(F.col(c), F.lit(d)).alias(c) if c in df.columns else F.lit(d).alias(c) for c, d in defaults.items()])


def json_field(column: str, path: str) -> Column:
    return F.get_json_object(column, path)


def next_number(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Highest sequence number of a code column plus one; 1 for an empty table."""
    from tidemark.functions.semantics import code_number

    return df.agg((F.coalesce(F.max(code_number(F.col(column), prefix)), F.lit(0)) + 1).alias("next"))
