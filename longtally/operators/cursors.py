"""Pages behind a cursor over several keys.

A cursor holds the order's values of one row, so a page starts behind that row however many rows
came in before it. The predicate is a lexicographic comparison on plain columns, and each task keeps
one page of rows.
"""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

#: Name and whether ascending, the most significant first. The last one should be unique.
Order = list[tuple[str, bool]]
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def _keys(df: DataFrame, order: Order) -> list[T.StructField]:
    return [T.StructField(f"k{i}", df.schema[name].dataType) for i, (name, _) in enumerate(order)]


def _behind(name: str, ascending: bool, value) -> Column:
    """Rows behind ``value`` in one key. Nulls come first in ascending and last in descending order, as Spark sorts them."""
    c = F.col(name)
    if ascending:
        return c.isNotNull() if value is None else F.coalesce(c > value, F.lit(False))
    return F.lit(False) if value is None else c.isNull() | (c < value)


def page(df: DataFrame, order: Order, size: int, cursor: str | None = None, name: str = "cursor") -> DataFrame:
    """The first ``size`` rows in ``order`` behind the row of ``cursor`` (None: from the start), each with its own cursor.

    A column called ``name`` is replaced. A cursor made for another order is an error. Rows that share all keys
    cannot be told apart: a page that ends among them leaves the others out, hence the unique last key.
    """
    fields = _keys(df, order)
    rest = df
    if cursor is not None:
        values = _decoded(df, order, cursor)
        behind, equal = F.lit(False), F.lit(True)
        for (key, ascending), field, value in zip(order, fields, values, strict=True):
            at = F.lit(value).cast(field.dataType) if value is not None else None
            behind = behind | (equal & _behind(key, ascending, at))
            equal = equal & (F.col(key).isNull() if at is None else F.coalesce(F.col(key) == at, F.lit(False)))
        rest = df.filter(behind)
    sort = [F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last() for key, ascending in order]
    values = F.to_json(F.struct(*(F.col(key).alias(f.name) for (key, _), f in zip(order, fields, strict=True))), JSON)
    own = F.base64(F.concat(F.lit(_shape(order) + "\n"), values).cast("binary"))
    return rest.withColumn(name, own).orderBy(*sort).limit(size)


def _shape(order: Order) -> str:
    return ",".join(("+" if ascending else "-") + key for key, ascending in order)


def _decoded(df: DataFrame, order: Order, cursor: str) -> list:
    try:
        shape, _, values = base64.b64decode(cursor).decode().partition("\n")
    except ValueError as e:
        raise ValueError("not a cursor") from e
    if shape != _shape(order):
        raise ValueError(f"a cursor of the order {shape!r}, not of {_shape(order)!r}")
    spark = df.sparkSession
    row = spark.range(1).select(F.from_json(F.lit(values), T.StructType(_keys(df, order)), JSON).alias("v")).first()
    return list(row["v"])


def last_cursor(rows: DataFrame, order: Order, name: str = "cursor") -> str | None:
    """The cursor of the last row of a page; None for an empty one. One value reaches the driver."""
    sort = [F.col(key).desc_nulls_last() if ascending else F.col(key).asc_nulls_first() for key, ascending in order]
    last = rows.orderBy(*sort).select(name).first()
    return last[0] if last else None
