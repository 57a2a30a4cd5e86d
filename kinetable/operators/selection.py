"""Distributed selection: the row at a wanted rank, found by counting and without moving rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinetable.operators.blocks import number_rows

#: Bits of a value that one count tells apart, rows that are sorted on the driver's side of a limit.
BITS, FEW = 16, 10_000

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class Cut:
    """The row at a rank: its values in order, how many equal rows come before it, and how many equal it."""

    columns: tuple[str, ...]
    values: tuple
    before: int
    equal: int
    kinds: tuple[T.DataType, ...]

    def _sides(self) -> tuple[Column, Column]:
        # The names keep both structs of one type; nulls come first in both.
        here = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(self.columns)])
        return here, F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(self.values, self.kinds, strict=True))])

    def above(self) -> Column:
        """Rows that come before the cut's row."""
        a, b = self._sides()
        return a < b

    def here(self) -> Column:
        a, b = self._sides()
        return a == b


def _value_at(df: DataFrame, column: str, rank: int) -> tuple[object, int]:
    """The value of an integer column at a rank, nulls first, and the rank among the rows that have it.

    A count by the leading bits names the range that holds the rank; the range
    is counted again by its next bits until it is one value.
    """
    x = F.col(column).cast("long")
    nulls, low, high = df.agg(F.count(F.when(x.isNull(), 1)), F.min(x), F.max(x)).first()
    if rank < nulls:
        return None, rank
    rank -= nulls
    while low < high:
        shift = max(0, (high - low).bit_length() - BITS)
        part = df.filter((x >= low) & (x <= high)).groupBy(F.shiftright(x, shift).alias("b"))
        for r in sorted(part.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("a"), F.max(x).alias("z")).collect(), key=lambda r: r.b):  # 2**BITS + 1 rows at most
            if rank < r.n:
                low, high = r.a, r.z
                break
            rank -= r.n
    return low, rank


def cut_at(df: DataFrame, order: Sequence[str], rank: int) -> Cut | None:
    """The row of ``df`` at ``rank`` (from 0) in ascending ``order``, nulls first; None beyond the last.

    Integer columns are selected one after the other among the rows that are
    equal so far. Once these are FEW, the first of them are sorted; where a
    later column is no integer and more are left, they alone are ranked.
    """
    n = df.count()
    if not 0 <= rank < n:
        return None
    rest, values = df.select(*order), []
    kinds = tuple(df.schema[c].dataType for c in order)
    for i, c in enumerate(order):
        if n <= FEW or not isinstance(kinds[i], _INTEGERS):
            break
        v, rank = _value_at(rest, c, rank)
        values.append(v)
        rest = rest.filter(F.col(c).eqNullSafe(F.lit(v).cast(kinds[i])))
        n = rest.count()
    left = list(order[len(values) :])
    equal, before = n, rank
    if left:
        if n <= FEW:
            rows = [tuple(r) for r in rest.select(*left).orderBy(*left).limit(n).collect()]
            row = rows[rank]
            equal, before = rows.count(row), rank - rows.index(row)
        else:
            bucket = F.when(F.col(left[0]).isNotNull(), F.col(left[0]))
            row = tuple(number_rows(rest.select(*left), [], left, bucket, "_at").where(F.col("_at") == rank).select(*left).first())
            same = rest
            for c, v, k in zip(left, row, kinds[len(values) :], strict=True):
                same = same.filter(F.col(c).eqNullSafe(F.lit(v).cast(k)))
            equal = same.count()
            before = 0 if equal == 1 else rank - rest.filter(Cut(tuple(left), row, 0, equal, kinds[len(values) :]).above()).count()
        values += row
    return Cut(tuple(order), tuple(values), before, equal, kinds)
