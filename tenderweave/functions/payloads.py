"""JSON payloads as VARIANT values: canonical text, fingerprints and hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The JSON with the keys of every object sorted and no white space between; null for what is no JSON.

    A VARIANT keeps an object's fields by name, so writing it out again is all that is to do."""
    return F.to_json(F.try_parse_json(text))


def canonical_fingerprint(text: Column) -> Column:
    """sha256 (lowercase hex) of the canonical JSON: two orders of keys give one. Text that is no JSON counts as it is."""
    return F.sha2(F.coalesce(canonical_json(text), text), 256)


def wrapped_payload(text: Column) -> Column:
    """The payload as an object: what is no object (an array, a number, a text) becomes {"items": it}; null if malformed."""
    parsed = F.try_parse_json(text)
    plain = F.to_json(parsed)
    items = F.try_parse_json(F.concat(F.lit('{"items":'), plain, F.lit("}")))
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed).otherwise(items)


def hint(payload: Column, *fields: str) -> Column:
    """The first of these fields of an object payload that says something, as text: null, empty texts and containers,
    zero and false say nothing."""
    found = []
    for f in fields:
        text = F.try_variant_get(payload, f"$.{f}", "string")
        found.append(F.when(~F.coalesce(text, F.lit("")).isin("", "0", "0.0", "false", "[]", "{}"), text))
    return F.coalesce(*found)
