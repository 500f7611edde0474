"""Running sums in order over a whole table: a scan in two passes.

A window without a partition orders every row in one task, and a window over a hot group orders that group in
one.  Here the rows are dealt by ranges of (group, order), so that a group of any size spans as many ranges as
its share of the rows asks for.  Each range makes its own running sums; what a range has of its last group is
then carried into the ranges in which that group goes on.  What is gathered for that is one row a range.

Edge cases: groups that are null are one group, ordered as Spark orders nulls; rows that are equal in group and
order are dealt to several ranges and get their sums in an arbitrary, but fixed, order; an empty table gives an
empty result.  Columns whose names start with ``scan_`` are not allowed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import kept

#: Equal rows are told apart by so many values, so that a range can end among them.
TIES = 8192


def running(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """rows with, for each name in sums, the running sum of its column in the given order inside each group of ``by``.

    Sums include the row itself; its column must not be null and be a long or a double.  ``parts``: number of ranges.
    """
    if clash := [c for c in rows.columns if c.lower().startswith("scan_")]:
        raise ValueError(f"columns {clash}: names that start with scan_ are taken")
    held = rows.withColumns({f"scan_value_{n}": c for n, c in sums.items()})
    held = held.withColumn("scan_tie", F.monotonically_increasing_id() % TIES)
    ordered = [*order, F.col("scan_tie")]
    dealt = [*[F.col(c) for c in by], *ordered]
    ranged = held.repartitionByRange(parts, *dealt) if parts else held.repartitionByRange(*dealt)
    inside = Window.partitionBy("scan_part", *by).orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("scan_part", F.spark_partition_id())
    run = ranged.withColumns({n: F.sum(f"scan_value_{n}").over(inside) for n in sums} | {"scan_at": F.count(F.lit(1)).over(inside)})
    run = kept(run.drop("scan_tie", *[f"scan_value_{n}" for n in sums]))
    carried = _carried(run, list(sums), list(by))
    first = F.col("scan_first").eqNullSafe(_group(by))
    out = run.join(F.broadcast(carried), "scan_part", "left")  # one row a range at most
    return out.withColumns({n: F.col(n) + F.when(first, F.col(f"scan_before_{n}")).otherwise(F.lit(0)) for n in sums}).select(*rows.columns, *sums)


def _group(by: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))


def _carried(run: DataFrame, sums: list[str], by: list[str]) -> DataFrame:
    """scan_part, scan_first, scan_before_*: what earlier ranges have of the group with which a range begins.

    Ranges without such rows are left out, so with small groups hardly any row is left.
    """
    last = F.max(F.struct(_group(by).alias("group"), "scan_at", *sums)).alias("last")
    ends = run.groupBy("scan_part").agg(F.min(_group(by)).alias("scan_first"), last)
    in_order = Window.orderBy("scan_part")  # over one row a range
    same = Window.partitionBy("last.group").orderBy("scan_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumns({f"scan_to_{n}": F.sum(f"last.{n}").over(same) for n in sums})
    ends = ends.withColumn("scan_goes_on", F.lag("last.group").over(in_order).eqNullSafe(F.col("scan_first")))
    ends = ends.withColumns({f"scan_before_{n}": F.lag(f"scan_to_{n}").over(in_order) for n in sums})
    return ends.filter("scan_goes_on").select("scan_part", "scan_first", *[f"scan_before_{n}" for n in sums])
