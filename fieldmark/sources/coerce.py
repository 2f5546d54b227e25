"""Type clean-up for raw rows: one projection over the schema, no extra pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.functions.expr import number
from fieldmark.schemas import ID_ENDINGS, NULL_TEXT


def _drop_null_text(c: Column) -> Column:
    return F.when(~c.isin(NULL_TEXT), c)


def is_id_column(name: str) -> bool:
    return name.lower().endswith(tuple(ID_ENDINGS))


def harmonise(df: DataFrame) -> DataFrame:
    """Id-like columns become text (``1234.0`` -> ``1234``); text null markers become NULL."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if is_id_column(field.name) and isinstance(field.dataType, T.FractionalType):
            # whole numbers print without a fraction or exponent
            c = c.cast("decimal(38,0)").cast("string") if _is_float(field) else c.cast("string")
        elif is_id_column(field.name) and isinstance(field.dataType, T.IntegralType):
            c = c.cast("string")
        if isinstance(field.dataType, T.StringType):
            c = _drop_null_text(F.regexp_replace(c, r"\.0$", "") if is_id_column(field.name) else c)
        out.append(c.alias(field.name))
    return df.select(*out)


def _is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.DoubleType, T.FloatType))


def widen(df: DataFrame, keep: tuple[str, ...] = ("season",)) -> DataFrame:
    """Stable raw types: untyped columns -> text, integers (but the partition key) -> double."""
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.NullType):
            c = c.cast("string")
        elif isinstance(field.dataType, T.IntegralType) and field.name not in keep:
            c = c.cast("double")
        out.append(c.alias(field.name))
    return df.select(*out)


def to_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text to double, bad text to NULL."""
    return df.withColumns({c: number(F.col(c)) for c in cols if c in df.columns})


def try_number(c: Column, source: T.DataType, kind: T.NumericType) -> Column:
    """Parse to a number of the kind. Whole numbers never pass through a double unless they
    are written with a fraction (``"3.0"``), so large ids stay exact."""
    if isinstance(kind, T.DecimalType) or isinstance(source, T.IntegralType):
        return c.try_cast(kind)
    if isinstance(kind, T.IntegralType) and isinstance(source, T.StringType):
        return F.coalesce(c.try_cast(kind), number(c).try_cast(kind))
    return number(c).try_cast(kind)


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast columns that the target table already has; other columns pass through."""
    known = {f.name: f.dataType for f in target.fields}
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), known.get(field.name)
        if isinstance(kind, T.StringType):
            c = _drop_null_text(c.cast("string"))
        elif kind is None or kind == field.dataType:
            pass
        elif isinstance(kind, T.NumericType):
            c = try_number(c, field.dataType, kind)
        else:
            c = c.try_cast(kind)
        out.append(c.alias(field.name))
    return df.select(*out)


def project_to(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exactly the declared columns in order; missing ones are typed NULLs."""
    have = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for field in target.fields:
        source = have.get(field.name)
        if source is None:
            c = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.NumericType):
            c = try_number(F.col(field.name), source, field.dataType)
        else:
            c = F.col(field.name).try_cast(field.dataType)
        out.append(c.alias(field.name))
    return df.select(*out)
