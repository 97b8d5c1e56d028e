"""Small tables of strings as literals, looked up in constant time within an expression: hash buckets in an array."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F


def literal_table(rows: DataFrame, key: str, value: str):
    """A function from a string column to the value (a double) that ``rows`` has for it, null for others. ``rows`` is brought to the driver, so its size must have a bound."""
    n = 1 << max(4, rows.count().bit_length())
    table: list[list[dict]] = [[] for _ in range(n)]
    for k, b, v in rows.select(key, F.pmod(F.xxhash64(key), F.lit(n)), F.col(value).cast("double")).collect():
        table[b].append({"k": k, "v": v})
    # Folded into a literal when the plan is optimised.
    literal = F.from_json(F.lit(json.dumps(table)), "array<array<struct<k:string,v:double>>>")

    def found(x: Column) -> Column:
        bucket = F.get(literal, F.pmod(F.xxhash64(x), F.lit(n)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["k"] == x), F.lit(0))["v"]

    return found
