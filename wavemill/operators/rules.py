"""Selection rules as data, compiled to a filter.

A rule is ``{"name": ..., "conditions": {attribute: wanted}}``; all conditions
must hold. A number must be equal; a text must be equal without regard to case,
or found as a regular expression; of a list, every text must occur in the
attribute. Attributes that are missing, empty or 0 never match; wanted values
that are empty or 0 are not asked for.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(attribute: Column, wanted: Any, numeric: bool) -> Column:
    if not wanted:
        return F.lit(True)
    if numeric and isinstance(wanted, (int, float)):
        hit = (attribute != 0) & (attribute == F.lit(wanted))
    elif isinstance(wanted, (list, tuple)):
        text = F.lower(attribute.cast("string"))
        hit = reduce(lambda a, b: a & b, [F.contains(text, F.lit(str(w).lower())) for w in wanted]) & (text != "")
    else:
        text = attribute.cast("string")
        hit = (text != "") & ((F.lower(text) == F.lit(str(wanted).lower())) | text.rlike(f"(?i){wanted}"))
    return F.coalesce(hit, F.lit(False))


def select(df: DataFrame, rules: list[dict], group: list[str], order: list[str], all_matched: bool = False) -> DataFrame:
    """Rows that match each rule, with ``selection``; without ``all_matched`` only the first one of each group and rule."""
    numeric = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "double", "float", "short", "byte")}
    hits = [F.when(reduce(lambda a, b: a & b, [condition(F.col(c), v, c in numeric) for c, v in r["conditions"].items()], F.lit(True)), F.lit(r["name"])) for r in rules]
    out = df.withColumn("selection", F.explode(F.array_compact(F.array(*hits))))
    if all_matched:
        return out
    w = Window.partitionBy(*group, "selection").orderBy(*order)
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
