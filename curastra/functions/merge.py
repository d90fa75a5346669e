"""Records merged key by key; the later one wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged(left: Column, left_type: T.StructType, right: Column, right_type: T.StructType, deep: bool = True) -> tuple[Column, T.StructType]:
    """Two structs as one, and its type: fields in order of first appearance, those of ``right`` win.

    A field that ``right`` has counts even if it is null, as a key would. Structs on both sides
    are merged the same way if ``deep``, unless that of ``right`` is null; arrays and maps are
    values. Where ``right`` as a whole is null, ``left`` stays.
    """
    mine, theirs = {f.name: f.dataType for f in left_type}, {f.name: f.dataType for f in right_type}
    parts, fields = [], []
    for name in [*mine, *(n for n in theirs if n not in mine)]:
        kind = theirs.get(name, mine.get(name))
        if name not in theirs:
            value = left[name]
        elif name not in mine:
            value = right[name]
        elif deep and isinstance(mine[name], T.StructType) and isinstance(kind, T.StructType):
            both, kind = merged(left[name], mine[name], right[name], theirs[name], deep)
            value = F.when(right[name].isNotNull(), both)
            value = F.when(right.isNull(), both).otherwise(value)
        else:
            value = F.when(right.isNotNull(), right[name]) if mine[name] != kind else F.when(right.isNotNull(), right[name]).otherwise(left[name])
        parts.append(value.alias(name))
        fields.append(T.StructField(name, kind))
    return F.struct(*parts), T.StructType(fields)


def merge_columns(rows: DataFrame, *names: str, deep: bool = True) -> DataFrame:
    """Rows whose columns are the fields of some struct columns, merged in the order given."""
    first = (F.col(names[0]), rows.schema[names[0]].dataType)
    whole, kind = reduce(lambda a, n: merged(*a, F.col(n), rows.schema[n].dataType, deep), names[1:], first)
    return rows.select(whole.alias("_m")).select(*(F.col("_m")[f.name].alias(f.name) for f in kind))
