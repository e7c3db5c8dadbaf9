"""SQL type names, their Spark types, and the coercion of literals to a column's type."""

from __future__ import annotations

import json
import re
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .errors import SchemaError
from .functions import semistructured as semi

NAMES = {
    "INTEGER": ("INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT"),
    "FLOAT": ("FLOAT", "REAL", "DOUBLE", "NUMERIC", "DECIMAL"),
    "TEXT": ("TEXT", "STRING", "VARCHAR", "CHAR"),
    "BOOLEAN": ("BOOL", "BOOLEAN"),
    "TIMESTAMP": ("TIMESTAMP", "DATETIME"),
    "JSON": ("JSON",),
    "JSONB": ("JSONB",),
    "XML": ("XML",),
    "GEOMETRY": ("GEOMETRY", "SPATIAL"),
}
TYPE_OF = {name: kind for kind, names in NAMES.items() for name in names}
SPARK = {"INTEGER": "bigint", "FLOAT": "double", "TEXT": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "JSON": "string", "JSONB": "string", "XML": "string", "GEOMETRY": semi.GEOMETRY}


def kind_of(name: str) -> str:
    try:
        return TYPE_OF[name.upper()]
    except KeyError:
        raise SchemaError(f"unsupported column type {name}") from None


def kind_of_spark(spark_type: str) -> str:
    """The kind of a column that was not declared here."""
    t = spark_type.lower()
    if t in ("tinyint", "smallint", "int", "bigint"):
        return "INTEGER"
    if t in ("float", "double") or t.startswith("decimal"):
        return "FLOAT"
    if t == "boolean":
        return "BOOLEAN"
    if t in ("timestamp", "timestamp_ntz", "date"):
        return "TIMESTAMP"
    return "GEOMETRY" if t == semi.GEOMETRY else "TEXT"


def parse_timestamp(text: str) -> datetime:
    """RFC 3339, a date and time, or a date; UTC where no offset is given."""
    t = text.strip()
    try:
        out = datetime.fromisoformat(re.sub(r"[zZ]$", "+00:00", t))
    except ValueError:
        raise SchemaError(f"not a timestamp: {text!r}") from None
    return out.replace(tzinfo=UTC) if out.tzinfo is None else out.astimezone(UTC)


def coerce(value, kind: str):
    """A literal as the Python value of a column's kind; None stays None."""
    if value is None:
        return None

    def no():
        raise SchemaError(f"schema mismatch: {value!r} is not {kind}")

    v = value.text if isinstance(value, Typed) else value
    if kind == "INTEGER":
        if isinstance(v, bool | int):
            return int(v)
        if isinstance(v, float):
            return int(v) if v.is_integer() else no()
        try:
            return int(v.strip())
        except (ValueError, AttributeError):
            return no()
    if kind == "FLOAT":
        if isinstance(v, bool | int | float):
            return float(v)
        try:
            return float(v.strip())
        except (ValueError, AttributeError):
            return no()
    if kind == "TEXT":
        if isinstance(v, bool):
            return "true" if v else "false"
        return v.isoformat().replace("+00:00", "Z") if isinstance(v, datetime) else str(v)
    if kind == "BOOLEAN":
        if isinstance(v, bool):
            return v
        if isinstance(v, int | float):
            return v != 0
        return {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}.get(str(v).strip().lower()) if str(v).strip().lower() in ("true", "t", "1", "false", "f", "0") else no()
    if kind == "TIMESTAMP":
        if isinstance(v, datetime):
            return v
        if isinstance(v, int | float) and not isinstance(v, bool):
            return datetime.fromtimestamp(int(v), UTC)
        return parse_timestamp(v) if isinstance(v, str) else no()
    if kind in ("JSON", "JSONB"):
        text = json.dumps(v) if not isinstance(v, str) else v
        try:
            json.loads(text)
        except ValueError:
            return no()
        return semi.canonical_json_literal(text) if kind == "JSONB" else text
    if kind == "XML":
        return v if isinstance(v, str) and semi.well_formed_xml(v) else no()
    if kind == "GEOMETRY":
        return semi.parse_geometry_literal(str(v)) or no()
    raise SchemaError(f"unknown kind {kind}")


class Typed:
    """A literal with a type before it: JSON '..', XML '..', POINT(..)."""

    def __init__(self, kind: str, text: str):
        self.kind, self.text = kind, text

    def __eq__(self, other):
        return isinstance(other, Typed) and (self.kind, self.text) == (other.kind, other.text)

    def __hash__(self):
        return hash((self.kind, self.text))

    def __repr__(self):
        return f"{self.kind} {self.text!r}"


def literal(value, kind: str, spark_type: str | None = None) -> Column:
    """A coerced literal as a column of the kind's (or the given) Spark type."""
    v = coerce(value, kind)
    if v is None:
        return F.lit(None).cast(spark_type or SPARK[kind])
    if kind == "GEOMETRY":
        return semi.geometry_literal(v)
    if kind == "TIMESTAMP":
        text = v.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
        return F.to_timestamp_ntz(F.lit(text)) if spark_type == "timestamp_ntz" else F.to_timestamp(F.lit(text + "+00:00"))
    return F.lit(v).cast(spark_type) if spark_type else F.lit(v)
