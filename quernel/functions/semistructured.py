"""JSON, XML and geometry values as column expressions."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "struct<kind:string,min_x:double,min_y:double,max_x:double,max_y:double>"
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"


def canonical_json(text: Column) -> Column:
    """Keys sorted at every depth, no spaces; null where the text isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def canonical_json_literal(text: str) -> str:
    """The canonical form of a literal as the column expression gives it (whole-valued numbers lose their fraction)."""

    def plain(v):
        if isinstance(v, dict):
            return {k: plain(v[k]) for k in sorted(v)}
        if isinstance(v, list):
            return [plain(x) for x in v]
        return int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1e15 else v

    return json.dumps(plain(json.loads(text)), separators=(",", ":"), ensure_ascii=False)


def metadata_matches(payload: Column, wanted: dict) -> Column:
    """Every top-level key has exactly the wanted JSON value. A null payload matches nothing, an empty filter everything."""
    if not wanted:
        return F.lit(True)
    parsed = F.try_parse_json(payload)
    out = None
    for key, value in wanted.items():
        quoted = key.replace("\\", "\\\\").replace("'", "\\'")
        found = F.to_json(F.try_variant_get(parsed, f"$['{quoted}']", "variant"))
        hit = found == F.lit(canonical_json_literal(json.dumps(value)))
        out = hit if out is None else out & hit
    return F.coalesce(out, F.lit(False))


def xml_root_name(text: Column) -> Column:
    """The root element's local name, of well-formed XML."""
    return F.xpath_string(text, F.lit("local-name(/*)"))


def well_formed_xml(text: str) -> bool:
    try:
        ET.fromstring(text)
    except ET.ParseError:
        return False
    return True


def parse_geometry(text: Column) -> Column:
    """POINT(x y), POINT(x,y), [a,b,c,d] or a JSON object with type and coordinates, as a struct of kind and envelope; null for anything else."""
    t = F.trim(text)
    point = rf"(?i)^POINT\s*\(\s*({NUMBER})\s*[,\s]\s*({NUMBER})\s*\)$"
    box = rf"^\[\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*,\s*({NUMBER})\s*\]$"
    kind, coordinates = F.lower(F.get_json_object(t, "$.type")), F.get_json_object(t, "$.coordinates")
    pair = rf"^\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]$"

    def made(kind_: str, c: Column) -> Column:
        """The numbers of a text that is known to fit, taken out once."""
        numbers = F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: x.cast("double"))

        def shape(v: Column) -> Column:
            x0, y0 = v[0], v[1]
            ends = [x0, y0, x0, y0] if kind_ == "point" else [F.least(x0, v[2]), F.least(y0, v[3]), F.greatest(x0, v[2]), F.greatest(y0, v[3])]
            return F.struct(*[x.alias(n) for x, n in zip([F.lit(kind_), *ends], ("kind", "min_x", "min_y", "max_x", "max_y"), strict=True)])

        return F.get(F.transform(F.array(numbers), shape), F.lit(0)).cast(GEOMETRY)

    return (
        F.when(t.rlike(point), made("point", t))
        .when(t.rlike(box), made("bbox", t))
        .when((kind == "point") & coordinates.rlike(pair), made("point", coordinates))
        .when((kind == "bbox") & coordinates.rlike(box), made("bbox", coordinates))
    )


def parse_geometry_literal(text: str) -> tuple | None:
    """(kind, min_x, min_y, max_x, max_y) of a literal."""
    t = text.strip()
    if m := re.match(rf"(?i)^POINT\s*\(\s*({NUMBER})\s*[,\s]\s*({NUMBER})\s*\)$", t):
        x, y = float(m[1]), float(m[2])
        return "point", x, y, x, y
    try:
        v = json.loads(t)
    except ValueError:
        return None
    kind = "bbox"
    if isinstance(v, dict):
        kind, v = str(v.get("type", "")).lower(), v.get("coordinates")
    if not isinstance(v, list) or not all(isinstance(x, int | float) for x in v):
        return None
    if kind == "point" and len(v) == 2:
        return "point", float(v[0]), float(v[1]), float(v[0]), float(v[1])
    if kind == "bbox" and len(v) == 4:
        a, b, c, d = map(float, v)
        return "bbox", min(a, c), min(b, d), max(a, c), max(b, d)
    return None


def geometry_literal(value: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(value, ("kind", "min_x", "min_y", "max_x", "max_y"), strict=True)]).cast(GEOMETRY)


def print_geometry(g: Column) -> Column:
    point = F.concat(F.lit("POINT("), g["min_x"].cast("string"), F.lit(" "), g["min_y"].cast("string"), F.lit(")"))
    box = F.concat(F.lit("["), F.concat_ws(",", *[g[n].cast("string") for n in ("min_x", "min_y", "max_x", "max_y")]), F.lit("]"))
    return F.when(g["kind"] == "point", point).when(g.isNotNull(), box)


def overlaps(a: Column, b: Column) -> Column:
    """Envelopes that meet, borders included."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])
