"""Records out of free text: shape-only repair of JSON, and the contract's projection.

Finding a balanced object and duplicate keys needs a parser, so that part is an Arrow
function; what follows is native. Values are never changed, truncated JSON never closed.
"""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructType

_FENCE = re.compile(r"```[A-Za-z]*\s*\n?(.*?)```", re.S)
_TRAILING = re.compile(r",(\s*[}\]])")
REPAIR_SCHEMA = (
    StructType()
    .add("status", StringType())
    .add("json", StringType())
    .add("fence", BooleanType())
    .add("extracted", BooleanType())
    .add("trailing_commas", IntegerType())
    .add("duplicate_keys", ArrayType(StringType()))
    .add("error", StringType())
)


def first_object(text: str) -> str | None:
    """The first balanced {...}, aware of strings and escapes; None if it never closes."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if escaped:
            escaped = False
        elif quoted:
            escaped, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start : i + 1]
    return None


def repair(text: str | None) -> dict:
    """Fence, surrounding text and trailing commas removed; of repeated keys the last stays and is reported.

    Commas before a closing bracket are always removed and counted, without a look at strings.
    """
    out = {"status": "failed", "json": None, "fence": False, "extracted": False, "trailing_commas": 0, "duplicate_keys": [], "error": None}
    if text is None or not text.strip():
        return out | {"status": "no_response"}
    if m := _FENCE.search(text):
        text, out["fence"] = m.group(1), True
    body = first_object(text)
    if body is None:
        return out | {"error": "no balanced object"}
    out["extracted"] = body != text.strip()

    def pairs(items):
        seen = dict(items)
        if len(seen) < len(items):
            out["duplicate_keys"] += sorted(k for k, n in Counter(k for k, _ in items).items() if n > 1)
        return seen

    body, out["trailing_commas"] = _TRAILING.subn(r"\1", body)
    try:
        return out | {"status": "ok", "json": json.dumps(json.loads(body, object_pairs_hook=pairs), ensure_ascii=False, sort_keys=True)}
    except ValueError as e:
        return out | {"error": str(e), "duplicate_keys": []}


@F.pandas_udf(REPAIR_SCHEMA)
def repair_json(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) for t in text], columns=["status", "json", "fence", "extracted", "trailing_commas", "duplicate_keys", "error"])


def contract_keys(obj: Column, contract: list[str]) -> tuple[Column, Column]:
    """(missing, extra) keys of a JSON object's text against a contract."""
    keys, names = F.coalesce(F.json_object_keys(obj), F.array().cast("array<string>")), F.array(*[F.lit(k) for k in contract])
    return F.array_except(names, keys), F.array_except(keys, names)


def key_frequencies(parsed: DataFrame, keys: str) -> DataFrame:
    return parsed.select(F.explode(keys).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
