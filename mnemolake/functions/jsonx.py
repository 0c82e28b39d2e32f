"""JSON payloads: typed reads that keep a number apart from its text, the outcome contract, canonical forms."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(payload: str | Column, path: str) -> Column:
    """The JSON text of a value, strings unquoted; null if it is missing, JSON null, or the payload isn't JSON."""
    return F.get_json_object(payload, path)


def _variant(payload: str | Column) -> Column:
    return F.try_parse_json(F.col(payload) if isinstance(payload, str) else payload)


def kind_at(payload: str | Column, path: str) -> Column:
    """The type tag of a value: STRING, BIGINT, DECIMAL(p,s), DOUBLE, BOOLEAN, VOID, ARRAY<...>, OBJECT<...>; null if missing."""
    return F.schema_of_variant(F.try_variant_get(_variant(payload), path, "variant"))


def strict_uint(payload: str, field: str) -> Column:
    """A non-negative integer that is a JSON number, else null: text, fractions and signs don't count.

    The text `"12"` and the number `12` look the same to get_json_object, so the type tag decides; `10.0` is no integer.
    """
    t = raw(payload, f"$.{field}")
    # the tag is looked at only where the cheap test on the text passes
    return F.when(t.rlike(r"^\d+$") & (kind_at(payload, f"$.{field}") != "STRING"), t.try_cast("bigint"))


def strict_number(payload: str, field: str) -> Column:
    """A JSON number as double, else null."""
    t = raw(payload, f"$.{field}")
    return F.when(t.rlike(r"^-?\d") & (kind_at(payload, f"$.{field}") != "STRING"), t.try_cast("double"))


def strict_string(payload: str, field: str) -> Column:
    """A JSON string, else null."""
    return F.when(kind_at(payload, f"$.{field}") == "STRING", raw(payload, f"$.{field}"))


def has_field(payload: str, field: str) -> Column:
    """Whether the payload is an object with this field, also where its value is null."""
    return F.coalesce(F.array_contains(F.json_object_keys(payload), field), F.lit(False))


def _is_object_text(t: Column) -> Column:
    return t.startswith("{")


def outcome_tag(payload: str = "payload") -> Column:
    """Ok, Timeout or Err by the contract: anything else, missing included, is Ok.

    An object with a field Err is an error; a text that only looks like such an object is Ok.
    """
    t = raw(payload, "$.outcome")
    is_err = _is_object_text(t) & has_field_of(t, "Err") & (kind_at(payload, "$.outcome") != "STRING")
    return F.when(t == "Timeout", F.lit("Timeout")).when(is_err, F.lit("Err")).otherwise(F.lit("Ok"))


def has_field_of(text: Column, field: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(text), field), F.lit(False))


def outcome_message(payload: str = "payload") -> Column:
    """The message of an error; empty where Err isn't text. Only meaningful where outcome_tag is Err."""
    t = raw(payload, "$.outcome.Err")
    # the tag costs a second parse; only values whose text could be another type need it
    doubtful = t.rlike(r"^\s*[-\d\[{]") | t.isin("true", "false")
    return F.when(t.isNull(), F.lit("")).when(doubtful & (kind_at(payload, "$.outcome.Err") != "STRING"), F.lit("")).otherwise(t)


def outcome_text(payload: str = "payload") -> Column:
    """Ok, Timeout, or `Err: message`."""
    tag = outcome_tag(payload)
    return F.when(tag == "Err", F.concat(F.lit("Err: "), outcome_message(payload))).otherwise(tag)


def outcome_is_error(payload: str = "payload") -> Column:
    return outcome_tag(payload) != "Ok"


def index_token(doc: str | Column, field: str) -> Column:
    """The key of an equality index: s: text, n: a number's own text, b: a flag; null for null, arrays, objects, missing."""
    path = f"$.{field}"
    t, k = raw(doc, path), kind_at(doc, path)
    return (
        F.when(k == "STRING", F.concat(F.lit("s:"), t))
        .when(k == "BOOLEAN", F.concat(F.lit("b:"), t))
        .when(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), F.concat(F.lit("n:"), t))
    )


def token_of(value: object) -> str | None:
    """index_token of a Python value."""
    if isinstance(value, bool):
        return "b:" + ("true" if value else "false")
    if isinstance(value, str):
        return "s:" + value
    if isinstance(value, (int, float)):
        return "n:" + json.dumps(value)
    return None


def canonical_json(text: Column) -> Column:
    """One text for all spellings of a JSON value: no spaces, keys in byte order, escapes and number forms resolved.

    Built on the variant encoding, which sorts the keys of an object and normalises numbers. A text that isn't JSON stays
    as it is, behind a mark that no JSON text starts with, so that it equals only itself; null stays null.
    """
    return F.coalesce(F.to_json(F.try_parse_json(text)), F.concat(F.lit("!"), text))


def pointer_to_path(pointer: str) -> str:
    """A JSON pointer as a path: a missing leading slash is added; ~1 and ~0 are read; digits index arrays."""
    p = pointer if pointer.startswith("/") or not pointer else "/" + pointer
    out = "$"
    for part in p.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else f"['{part}']"
    return out
