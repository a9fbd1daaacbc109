"""JSON attribute expressions: access, dates, key tests and containment."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def field_text(json_text: Column, key: str) -> Column:
    """Field of a JSON object as text; NULL when absent or JSON null."""
    return F.get_json_object(json_text, "$['" + key.replace("'", "\\'") + "']")


def field_date(json_text: Column, key: str) -> Column:
    """Field as a date when it starts like one, else NULL."""
    text = field_text(json_text, key)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("date"))


def key_exists(json_text: Column, key: str) -> Column:
    """Whether the object has the key, even with a JSON null."""
    return F.coalesce(
        F.array_contains(F.json_object_keys(json_text), F.lit(key)), F.lit(False)
    )


def contains(have: Column, want: Any) -> Column:
    """JSON containment of a variant in the sense of ``have @> want``."""
    kind = F.schema_of_variant(have)
    if isinstance(want, dict):
        test = kind.startswith("OBJECT")
        for key, value in want.items():
            test = test & contains(F.try_variant_get(have, _path(key), "variant"), value)
    elif isinstance(want, list):
        items = F.try_variant_get(have, "$", "array<variant>")
        test = kind.startswith("ARRAY")
        for value in want:
            test = test & F.exists(items, _containing(value))
    elif want is None:
        test = kind == "VOID"
    elif isinstance(want, bool):
        test = (kind == "BOOLEAN") & (F.try_variant_get(have, "$", "boolean") == F.lit(want))
    elif isinstance(want, (int, float)):
        number = ~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.rlike("^(OBJECT|ARRAY)")
        test = number & (F.try_variant_get(have, "$", "double") == F.lit(float(want)))
    else:
        test = (kind == "STRING") & (F.try_variant_get(have, "$", "string") == F.lit(str(want)))
    return F.coalesce(test, F.lit(False))


def _containing(want: Any) -> Callable[[Column], Column]:
    return lambda item: contains(item, want)
