"""JSON schemas in a subset of their language."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship

#: The types there are, and the keys that stay.
TYPES = ("string", "number", "boolean", "integer", "object", "array", "null")
KEYS = ("type", "description", "enum", "items", "properties", "required", "additionalProperties", "anyOf")
#: What a schema without a type is, by the keys it has: the first row that fits, else a string.
IMPLIED = (
    ("object", ("properties", "required", "additionalProperties")),
    ("array", ("items", "prefixItems")),
    ("string", ("enum", "const", "format")),
    ("number", ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf")),
)
ANY = {"type": "string"}


def lenient(schema):
    """The schema in the subset: any schema gives one, with a type, and what its type needs to have."""
    if isinstance(schema, bool):
        return dict(ANY)
    if not isinstance(schema, dict):
        raise ValueError("not a schema")
    asked = schema.get("type")
    types = [t for t in (asked if isinstance(asked, list) else [asked]) if t in TYPES] if asked is not None else []
    if not types and "anyOf" not in schema:
        types = [next((t for t, keys in IMPLIED if any(k in schema for k in keys)), "string")]
    out = {"type": types[0] if len(types) == 1 else types} if types else {}
    for k in ("description", "enum", "required"):
        if k in schema:
            out[k] = schema[k]
    if "const" in schema:
        out["enum"] = [schema["const"]]
    if isinstance(schema.get("anyOf"), list):
        out["anyOf"] = [lenient(x) for x in schema["anyOf"]]
    if isinstance(schema.get("properties"), dict):
        out["properties"] = {k: lenient(v) for k, v in schema["properties"].items()}
    elif "object" in types:
        out["properties"] = {}
    if "items" in schema:
        out["items"] = lenient(schema["items"])
    elif "array" in types:
        out["items"] = dict(ANY)
    if "additionalProperties" in schema:
        more = schema["additionalProperties"]
        out["additionalProperties"] = more if isinstance(more, bool) else lenient(more)
    return out


def lenient_schema(text: Column) -> Column:
    """JSON text as its lenient schema, keys sorted; null for what is no schema and for the type null alone."""
    ship(SparkSession.active())

    def one(s):
        try:
            got = lenient(json.loads(s))
        except (TypeError, ValueError):
            return None
        return None if got.get("type") == "null" else json.dumps(got, sort_keys=True, separators=(",", ":"))

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([one(s) for s in texts], dtype=object)

    return run(text)
