"""Hashes that identify rows, captures and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_hash(**fields: Column) -> Column:
    """SHA-256 of the JSON of the fields in order of name; nulls are kept."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def row_hash(rank: Column, name: Column, metric_raw: Column, board: Column, metric: Column) -> Column:
    return json_hash(sourceRank=rank, governorNameRaw=name, metricRaw=F.coalesce(metric_raw, F.lit("")), rankingType=board, metricKey=metric)


def ordered_hash(position: Column, value: Column) -> Column:
    """An aggregate: SHA-256 of the values of a group in order of position."""
    inner = F.array_sort(F.collect_list(F.struct(position.alias("p"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(inner, lambda x: x["v"]), ","), 256)
