"""Specification sheets and texts unfolded in SQL: table functions that a LATERAL join calls once for each row."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class KeyValues:
    """(feature, value) of a JSON list of key-value objects; of a repeated key the last one counts, at its first place.

    Names get the prefix and lose left-to-right marks; a null or unreadable sheet gives no rows.
    """

    def eval(self, sheet: str, prefix: str):
        try:
            items = json.loads(sheet) if sheet else []
        except ValueError:
            return
        found: dict[str, str | None] = {}
        for item in items if isinstance(items, list) else []:
            if isinstance(item, dict) and isinstance(item.get("key"), str):
                value = item.get("value")
                found[(prefix or "") + item["key"].replace("\u200e", "")] = value if value is None or isinstance(value, str) else json.dumps(value)
        yield from found.items()


class Paragraphs:
    """(place, section, value) of the lines of a text; blank ones keep their place and go."""

    def eval(self, text: str):
        for k, line in enumerate((text or "").split("\n"), 1):
            if line.strip(" "):
                yield k, f"paragraph_{k}", line


def register(spark: SparkSession) -> None:
    """Make ``kv(sheet, prefix)`` and ``paragraphs(text)`` known to the session's SQL."""
    spark.udtf.register("kv", udtf(KeyValues, returnType="feature string, value string", useArrow=True))
    spark.udtf.register("paragraphs", udtf(Paragraphs, returnType="place int, section string, value string", useArrow=True))
