"""Capped JSON rendering of a result: so many rows, so many bytes, vectors in short."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, NumericType

ROWS, BYTES = 200, 64 << 10


def render(df: DataFrame, rows: int = ROWS, most: int = BYTES) -> str:
    """{"columns", "rows", "truncated"} of at most so many rows and bytes; vectors show as <vector(n)>, blobs in hexadecimal.

    Only rows + 1 rows come to the driver.
    """
    shown = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, NumericType):
            c = F.when(c.isNotNull(), F.concat(F.lit("<vector("), F.size(c).cast("string"), F.lit(")>")))
        elif isinstance(f.dataType, BinaryType):
            c = F.hex(c)
        shown.append(c.alias(f.name))
    told = df.select(F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})).limit(rows + 1).collect()
    out = {"columns": df.columns, "rows": [], "truncated": False}
    size = len(json.dumps(out))
    for k, (text,) in enumerate(told):
        own = list(json.loads(text).values())
        size += len(json.dumps(own).encode()) + 2
        if k == rows or size > most:
            out["truncated"] = True
            break
        out["rows"].append(own)
    return json.dumps(out)
