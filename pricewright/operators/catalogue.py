"""The catalogue build: paragraphs and spec sheets to a long typed feature table, headers grouped by meaning."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewright.functions import parse, style
from pricewright.operators import typing as ty

LONG = ("row_id", "section", "feature", "value")


def paragraphs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(row_id, section, value): the lines of a text as ``paragraph_1``, ``paragraph_2``, …; blank ones keep their place."""
    parts = rows.select(F.col(key).alias("row_id"), F.posexplode(F.split(text, "\n")).alias("at", "value"))
    return parts.where(F.trim("value") != "").select("row_id", F.concat(F.lit("paragraph_"), (F.col("at") + 1).cast("string")).alias("section"), "value")


def about_items(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(row_id, section, value) from a JSON list of ``{about_item}``: an item without the field keeps its place as null,
    anything but an object takes none, and a row without items goes."""
    items = F.filter(F.from_json(data, "array<string>"), lambda x: x.startswith("{"))
    parts = rows.select(F.col(key).alias("row_id"), F.posexplode(items).alias("at", "item"))
    value = F.get_json_object("item", "$.about_item")
    return parts.select("row_id", F.concat(F.lit("paragraph_"), (F.col("at") + 1).cast("string")).alias("section"), value.alias("value"))


def style_long(sections: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """The style features of each section of (row_id, section, value), one row for each feature, or for each of ``only``."""
    found = {k: v for k, v in style.features(F.col("value")).items() if only is None or k in only}
    pairs = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in found.items()])
    return sections.select("row_id", "section", F.explode(pairs).alias("x")).select("row_id", "section", "x.feature", "x.value")


def sheet_long(rows: DataFrame, key: str, data: str, prefix: str) -> DataFrame:
    """(row_id, section, feature, value) from a JSON list of key-value objects; of a repeated key the last one counts."""
    items = F.from_json(data, "array<struct<key:string,value:string>>")
    parts = rows.select(F.col(key).alias("row_id"), F.posexplode(items).alias("at", "x"))
    name = F.concat(F.lit(prefix), F.replace(F.col("x.key"), F.lit("‎"), F.lit("")))
    return parts.groupBy("row_id", F.lit("clean").alias("section"), name.alias("feature")).agg(F.max_by("x.value", "at").alias("value"))


# ---- headers ------------------------------------------------------------------------------------------------------


def shingle_embedding(text: str, size: int = 256) -> np.ndarray:
    """An offline stand-in for a language model: hashed counts of character trigrams, of length 1."""
    out = np.zeros(size)
    padded = f"  {text} "
    for i in range(len(padded) - 2):
        out[int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=4).digest(), "big") % size] += 1
    return out / max(np.linalg.norm(out), 1e-12)


def last_noun(text: str) -> str:
    """The subject of a header when no tagger is there: its last word without a plural ending."""
    words = re.findall(r"[a-z]+", text.lower())
    return re.sub(r"(?<=[a-z]{3})s$", "", words[-1]) if words else ""


@dataclass
class HeaderCluster:
    leader: np.ndarray
    subject: str
    names: list[str]


def header_clusters(
    headers: Sequence[str],
    nearest: float = 0.025,
    embed: Callable[[str], np.ndarray] = shingle_embedding,
    translate: Callable[[str], str] = parse.concept,
    subject: Callable[[str], str] = last_noun,
) -> list[HeaderCluster]:
    """Greedy groups of headers: each joins the nearest group with its subject whose leader is within a cosine distance,
    or starts one; leaders are running means. There are as many headers as the schema has."""
    groups: list[HeaderCluster] = []
    for header in headers:
        plain = translate(header)
        vector, topic = embed(plain), subject(plain)
        best, least = None, nearest
        for g in groups:
            away = 1 - float(vector @ g.leader) / max(np.linalg.norm(vector) * np.linalg.norm(g.leader), 1e-12)
            if g.subject == topic and away < least:
                best, least = g, away
        if best is None:
            groups.append(HeaderCluster(vector, topic, [header]))
        else:
            n = len(best.names)
            best.leader = (best.leader * n + vector) / (n + 1)
            best.names.append(header)
    return groups


def merged_headers(long: DataFrame, groups: Sequence[HeaderCluster]) -> DataFrame:
    """A long frame with each group's headers under the first of them; where a row has several, the first in the group."""
    table = [(name, g.names[0], i) for g in groups for i, name in enumerate(g.names)]
    names = long.sparkSession.createDataFrame(table, "feature string, lead string, priority int")
    joined = long.join(F.broadcast(names), "feature", "left").where("value is not null")  # one row for each header
    lead = F.coalesce("lead", "feature").alias("feature")
    return joined.groupBy("row_id", "section", lead).agg(F.min_by("value", F.coalesce("priority", F.lit(0))).alias("value"))


@dataclass
class Catalogue:
    """A long typed table, its data dictionary and the fitted scales."""

    table: DataFrame
    types: DataFrame
    scales: ty.Normaliser


def build_catalogue(sheets: DataFrame, least: float = 0.02) -> Catalogue:
    """Group headers, drop rare features, type and scale the rest of a long frame; the scales are kept with the result."""
    headers = sorted(r["feature"] for r in sheets.select("feature").distinct().collect())
    merged = merged_headers(sheets, header_clusters(headers))
    rows = merged.select("row_id").distinct().agg(F.count("*").alias("rows"))
    filled = merged.groupBy("feature").agg(F.countDistinct("row_id").alias("n")).crossJoin(F.broadcast(rows))  # one row
    kept = merged.join(filled.where(F.col("n") >= least * F.col("rows")).select("feature"), "feature", "left_semi")
    scales = ty.Normaliser().fit(kept)
    return Catalogue(scales.transform(kept.select(*LONG)), ty.column_types(kept), scales)


def build_all(terms: Sequence[str], load: Callable[[str], DataFrame]) -> tuple[dict[str, Catalogue], dict[str, str]]:
    """A catalogue for each search term, and the message of each term that failed; one failure stops no other."""
    done, failed = {}, {}
    for term in terms:
        try:
            done[term] = build_catalogue(load(term))
        except Exception as e:  # noqa: BLE001
            failed[term] = str(e).splitlines()[0]
    return done, failed
