"""Columns rewritten by their schema, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kept(name: str) -> bool:
    return not name.startswith("_")


def _touched(kind: T.DataType) -> bool:
    """Whether something in the type may have to go."""
    if isinstance(kind, T.StructType):
        return any(not _kept(f.name) or _touched(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _touched(kind.elementType)
    return isinstance(kind, T.MapType) and (isinstance(kind.keyType, T.StringType) or _touched(kind.valueType))


def _public(x: Column, kind: T.DataType) -> Column:
    if not _touched(kind):
        return x
    if isinstance(kind, T.StructType):
        fields = [_public(x.getField(f.name), f.dataType).alias(f.name) for f in kind if _kept(f.name)]
        if not fields:  # nothing is left of it
            return F.lit(None).cast("void")
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda e: _public(e, kind.elementType))
    out = F.map_filter(x, lambda k, v: ~k.startswith("_")) if isinstance(kind.keyType, T.StringType) else x
    return F.transform_values(out, lambda k, v: _public(v, kind.valueType)) if _touched(kind.valueType) else out


def without_internal(df: DataFrame) -> DataFrame:
    """``df`` without the columns, fields and string keys of maps that begin with ``_``, in structs, arrays and maps of any depth.

    Nulls stay null, empty arrays and maps empty; an object of which all fields go is null, and a column of such goes.
    """
    out = [_public(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema if _kept(f.name) and not (isinstance(f.dataType, T.StructType) and not any(_kept(g.name) for g in f.dataType))]
    return df.select(*out)
