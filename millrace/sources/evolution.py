"""Schema evolution over generations of a table whose columns come, go and change type."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whole numbers by width, then the types that hold all of them.
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
TIMES = (T.DateType, T.TimestampNTZType, T.TimestampType)


def widest(one: T.DataType, two: T.DataType) -> T.DataType:
    """Smallest type that holds the values of both: the join of two types in the lattice.

    Whole numbers widen to the larger one; with decimals to a decimal that keeps all digits, or double if there is none;
    with floating point to double. Dates widen to timestamps, structs field by field, arrays and maps by their parts, and all else to
    string. The order of generations does not matter.
    """
    if one == two:
        return one
    if isinstance(one, T.NullType) or isinstance(two, T.NullType):
        return two if isinstance(one, T.NullType) else one
    a, b = type(one), type(two)
    if a in WHOLE and b in WHOLE:
        return max(one, two, key=lambda t: WHOLE.index(type(t)))
    if isinstance(one, T.NumericType) and isinstance(two, T.NumericType):
        if any(isinstance(t, T.FractionalType) and not isinstance(t, T.DecimalType) for t in (one, two)):
            return T.DoubleType()
        exact = [t if isinstance(t, T.DecimalType) else T.DecimalType(DIGITS[type(t)], 0) for t in (one, two)]
        scale = max(t.scale for t in exact)
        before = max(t.precision - t.scale for t in exact)
        return T.DecimalType(before + scale, scale) if before + scale <= 38 else T.DoubleType()
    if a in TIMES and b in TIMES:
        return max(one, two, key=lambda t: TIMES.index(type(t)))
    if isinstance(one, T.StructType) and isinstance(two, T.StructType):
        return merge_schemas([one, two])
    if isinstance(one, T.ArrayType) and isinstance(two, T.ArrayType):
        return T.ArrayType(widest(one.elementType, two.elementType))
    if isinstance(one, T.MapType) and isinstance(two, T.MapType):
        return T.MapType(widest(one.keyType, two.keyType), widest(one.valueType, two.valueType))
    return T.StringType()


def merge_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    """Every column of any schema, in order of first appearance, at the widest of its types."""
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        for field in schema.fields:
            kinds[field.name] = widest(kinds[field.name], field.dataType) if field.name in kinds else field.dataType
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


def reshaped(value: Column, kind: T.DataType, goal: T.DataType) -> Column:
    """``value`` of type ``kind`` as the wider ``goal``; fields a struct lacks are NULL."""
    if kind == goal:
        return value
    if isinstance(kind, T.StructType) and isinstance(goal, T.StructType):
        has = {f.name: f.dataType for f in kind.fields}
        fields = [
            (reshaped(value.getField(f.name), has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in goal.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and isinstance(goal, T.ArrayType):
        return F.transform(value, lambda x: reshaped(x, kind.elementType, goal.elementType))
    return value.cast(goal)


def evolve_all(generations: Sequence[DataFrame], number: str | None = None) -> DataFrame:
    """Rows of all generations under the merged schema; what a generation lacks is NULL.

    ``number`` names a column for the position of the row's generation. A generation is what was written under one schema (a run's
    folder); Spark reads the schema of each from a footer, and the rows of all are read once and never shuffled.
    """
    schema = merge_schemas([g.schema for g in generations])

    def shaped(position: int, frame: DataFrame) -> DataFrame:
        has = {f.name: f.dataType for f in frame.schema.fields}
        columns = [
            (reshaped(F.col(f"`{f.name}`"), has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
        return frame.select(*columns, *([F.lit(position).alias(number)] if number else []))

    return reduce(DataFrame.unionByName, [shaped(i, g) for i, g in enumerate(generations)])


def evolution_report(generations: Sequence[DataFrame]) -> list[tuple[str, str, str, str, int, int]]:
    """(column, change, types, merged type, first and last generation) of every column: kept, added, removed or retyped.

    A column that is retyped and also added or removed is called retyped.
    """
    schema = merge_schemas([g.schema for g in generations])
    rows = []
    for field in schema.fields:
        seen = [(i, f.dataType.simpleString()) for i, g in enumerate(generations) for f in g.schema.fields if f.name == field.name]
        types = list(dict.fromkeys(t for _, t in seen))
        first, last = seen[0][0], seen[-1][0]
        change = (
            "retyped" if len(types) > 1 else "added" if first else "removed" if last < len(generations) - 1 else "kept")
        rows.append((field.name, change, ",".join(types), field.dataType.simpleString(), first, last))
    return rows
