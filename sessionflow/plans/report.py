"""Small report shapes built from one-row aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def rows_from_one(one_row: DataFrame, rows: Sequence[Sequence[tuple[str, str]]]) -> DataFrame:
    """Turn a one-row aggregate into N report rows with ``inline(array(struct))``.

    The reference writes N ``UNION ALL`` branches over the same CTE; Spark
    inlines CTEs, so a literal union would plan the aggregate once per branch.
    One ``Generate`` over the single row plans it once. Each row is a list of
    ``(name, expression text)``; all rows must use the same names and types.
    """
    structs = [", ".join(f"{expr} AS `{name}`" for name, expr in row) for row in rows]
    return one_row.selectExpr(f"inline(array({', '.join(f'struct({s})' for s in structs)}))")
