"""A profile document checked against its schema: every fault of a JSON text, as an array of messages.

The schema is data; check() compiles it to column expressions over variants, so documents are checked as rows, without
Python. It knows type, required, properties, additionalProperties, items, enum, minimum, maximum and pattern.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_AMOUNT, _SHARE = {"type": "number", "minimum": 0}, {"type": "number", "minimum": 0, "maximum": 1}
_COUNT, _PERCENT = {"type": "integer", "minimum": 0}, {"type": "integer", "minimum": 0, "maximum": 100}
#: The published format of a profile.
PROFILE: dict[str, Any] = {
    "type": "object",
    "required": ["version", "profile_id", "style", "metadata"],
    "properties": {
        "version": {"type": "string", "pattern": r"^[0-9]+\.[0-9]+$"},
        "profile_id": _TEXT,
        "style": {"type": "object", "additionalProperties": {"type": "object", "required": ["value", "confidence"], "properties": {"value": _PERCENT, "confidence": _SHARE}}},
        "syntax": {
            "type": "object",
            "properties": {
                "average_sentence_length": _AMOUNT,
                "sentence_length_variance": _AMOUNT,
                "average_paragraph_length": _AMOUNT,
                "contraction_preference": _SHARE,
                "fragment_preference": _SHARE,
                "question_preference": _SHARE,
                "passive_preference": _SHARE,
                "vocabulary_diversity": _AMOUNT,
            },
        },
        "punctuation": {"type": "object", "additionalProperties": {"type": "string", "enum": ["never", "rare", "occasional", "frequent"]}},
        "vocabulary": {"type": "object", "properties": {"prefer": _TEXTS, "avoid": _TEXTS, "technical_terms": _TEXTS, "colloquialisms": _TEXTS}},
        "phrasing": {"type": "object", "properties": {"preferred": _TEXTS, "avoided": _TEXTS}},
        "structure": {
            "type": "object",
            "properties": {
                "paragraph_length": {"type": "string", "enum": ["short", "medium", "long"]},
                "heading_preference": {"type": "string", "enum": ["low", "medium", "high"]},
                "bullet_preference": {"type": "string", "enum": ["low", "medium", "high"]},
            },
        },
        "contexts": {"type": "object", "additionalProperties": {"type": "object"}},
        "metadata": {
            "type": "object",
            "required": ["sample_count", "word_count"],
            "properties": {"sample_count": _COUNT, "word_count": _COUNT, "sentence_count": _COUNT, "created_at": _TEXT, "updated_at": _TEXT, "generator": _TEXT, "scoring_version": _TEXT},
        },
        "notes": {
            "type": "object",
            "properties": {
                "approximate_metrics": _TEXTS,
                "avoid_inferred_from_absence": {"type": "boolean"},
                "avoid_confirmed_by_choice": _TEXTS,
                "varies_by_context": {
                    "type": "array",
                    "items": {"type": "object", "required": ["dimension", "low", "high"], "properties": {"dimension": _TEXT, "low": _PERCENT, "high": _PERCENT, "scatter": _AMOUNT}},
                },
                "describes": _TEXT,
            },
        },
    },
}
#: What schema_of_variant() says of each type.
TYPES = {"object": "^OBJECT", "array": "^ARRAY", "string": "^STRING$", "number": "^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)", "integer": "^BIGINT$", "boolean": "^BOOLEAN$", "null": "^VOID$"}


def none() -> Column:
    return F.array().cast("array<string>")


def check(value: Column, schema: dict[str, Any], where: Column) -> Column:
    """Messages on a variant; `where` is its path."""
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    of_type = F.schema_of_variant(value).rlike(TYPES[schema["type"]])
    wrong = F.array(F.concat(where, F.lit(f": expected {schema['type']}, got "), F.lower(kind)))
    found = []
    text = F.try_variant_get(value, "$", "string")
    number = F.try_variant_get(value, "$", "double")

    def fault(bad: Column, *message: Column) -> Column:
        return F.when(bad, F.array(F.concat(where, *message))).otherwise(none())

    if "enum" in schema:
        found.append(fault(~text.isin(*schema["enum"]), F.lit(": "), text, F.lit(f" is not one of {', '.join(schema['enum'])}")))
    if "pattern" in schema:
        found.append(fault(~text.rlike(schema["pattern"]), F.lit(": "), text, F.lit(f" does not match {schema['pattern']}")))
    if "minimum" in schema:
        found.append(fault(number < schema["minimum"], F.lit(f": below minimum {schema['minimum']}")))
    if "maximum" in schema:
        found.append(fault(number > schema["maximum"], F.lit(f": above maximum {schema['maximum']}")))
    if schema["type"] == "object":
        found += [fault(F.try_variant_get(value, f"$.{k}", "variant").isNull(), F.lit(f": missing required key '{k}'")) for k in schema.get("required", ())]
        for k, child in schema.get("properties", {}).items():
            found.append(optional(F.try_variant_get(value, f"$.{k}", "variant"), child, F.concat(where, F.lit(f".{k}"))))
        if "additionalProperties" in schema:
            entries = F.map_entries(F.try_variant_get(value, "$", "map<string,variant>"))
            found.append(F.flatten(F.transform(entries, lambda e: optional(e["value"], schema["additionalProperties"], F.concat(where, F.lit("."), e["key"])))))
    if schema["type"] == "array" and "items" in schema:
        items = F.try_variant_get(value, "$", "array<variant>")
        found.append(F.flatten(F.transform(items, lambda v, i: optional(v, schema["items"], F.concat(where, F.lit("["), i.cast("string"), F.lit("]"))))))
    return F.when(of_type, F.concat(none(), *(F.coalesce(f, none()) for f in found))).otherwise(wrong)


def optional(value: Column, schema: dict[str, Any], where: Column) -> Column:
    return F.when(value.isNull(), none()).otherwise(check(value, schema, where))


def errors(document: Column, schema: dict[str, Any] = PROFILE, name: str = "profile") -> Column:
    """Every way in which a JSON text breaks the schema; a text that is no JSON is one fault."""

    def found(value: Column) -> Column:
        return F.when(value.isNull(), F.array(F.lit(f"{name}: not JSON"))).otherwise(check(value, schema, F.lit(name)))

    return F.element_at(F.transform(F.array(F.try_parse_json(document)), found), 1)  # parsed once, though read often
