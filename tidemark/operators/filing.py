"""Filing: extract validation, page composition, the idempotent draft queue."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import URL_LIKE

MOST_ITEMS, MOST_TEXT = 200, 2000
#: key -> (required text field, optional time field)
FIELDS = {"commitments": ("text", "due"), "log_entries": ("text", "ts"), "reading": ("title", "ts")}
#: action -> (statuses it may start from, status it leads to)
TRANSITIONS = {"approve": (("draft",), "approved"), "dismiss": (("draft", "approved"), "dismissed"), "commit": (("approved",), "committed"), "undo": (("committed",), "undone")}
STATUSES = ("draft", "approved", "dismissed", "committed", "undone")
NO_ACTIVITY = "No activity captured for this period."
EXTRACT_SQL = "commitments array<struct<text: string, due: string>>, log_entries array<struct<text: string, ts: string>>, reading array<struct<title: string, ts: string>>"
_INSTANT = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:?\d\d)")
_URL = re.compile(URL_LIKE)


def rejection(text: str | None) -> str | None:
    """Why an extract is refused, the first reason; null if it stands."""
    try:
        o = json.loads(text or "")
    except ValueError:
        return "not a JSON object"
    if not isinstance(o, dict):
        return "not a JSON object"
    if extra := sorted(set(o) - set(FIELDS)):
        return f"unknown field: {extra[0]}"
    if _URL.search(text):
        return "URL in payload"
    for key, (name, when) in FIELDS.items():
        items = o.get(key, [])
        if not isinstance(items, list):
            return "malformed schema"
        for x in items:
            if not isinstance(x, dict) or not isinstance(x.get(name), str):
                return "malformed schema"
            if x.get(when) is not None and not (isinstance(x[when], str) and _INSTANT.fullmatch(x[when])):
                return "malformed schema"
    lists = {key: o.get(key, []) for key in FIELDS}
    if any(len(v) > MOST_ITEMS for v in lists.values()):
        return "too many items"
    for key, items in lists.items():
        for x in items:
            t = x[FIELDS[key][0]]
            if not t.strip():
                return "empty text"
            if len(t) > MOST_TEXT:
                return "text too long"
            if _URL.search(t):
                return "URL in field"
    return None


@F.pandas_udf(T.StringType())
def rejection_reason(payload: pd.Series) -> pd.Series:
    return payload.map(lambda t: rejection(t if isinstance(t, str) else None))


def validated(df: DataFrame, column: str = "payload") -> DataFrame:
    """df plus reason (null if valid) and extract (null if not)."""
    d = df.withColumn("reason", rejection_reason(F.col(column)))
    return d.withColumn("extract", F.when(F.col("reason").isNull(), F.from_json(F.col(column), EXTRACT_SQL)))


_BLOCK = "struct<object: string, type: string, text: string, checked: boolean>"


def blocks(extract: Column) -> Column:
    """Blocks of a page: headed sections of what there is, or one paragraph."""
    block = lambda kind, text, checked=None: F.struct(F.lit("block").alias("object"), F.lit(kind).alias("type"), text.alias("text"), F.lit(checked).cast("boolean").alias("checked")).cast(_BLOCK)
    none = F.array().cast(f"array<{_BLOCK}>")

    def section(title: str, items: Column, make) -> Column:
        some = F.size(F.coalesce(items, F.array())) > 0
        return F.when(some, F.concat(F.array(block("heading_2", F.lit(title))), F.transform(items, make))).otherwise(none)

    day = lambda d: F.date_format(F.try_to_timestamp(d), "yyyy-MM-dd")
    due = lambda c: F.when(c["due"].isNotNull(), F.concat(c["text"], F.lit(" (due "), day(c["due"]), F.lit(")"))).otherwise(c["text"])
    all_ = F.concat(
        section("Commitments", extract["commitments"], lambda c: block("to_do", due(c), False)),
        section("Log", extract["log_entries"], lambda c: block("bulleted_list_item", c["text"])),
        section("Reading", extract["reading"], lambda c: block("bulleted_list_item", c["title"])),
    )
    return F.when(F.size(all_) == 0, F.array(block("paragraph", F.lit(NO_ACTIVITY)))).otherwise(all_)


def block_json(b: Column) -> Column:
    """A block as REST JSON; its text is a run without a link."""
    run = F.array(F.struct(F.lit("text").alias("type"), F.struct(b["text"].alias("content")).alias("text")))
    body = F.when(b["type"] == "to_do", F.to_json(F.struct(run.alias("rich_text"), b["checked"].alias("checked")))).otherwise(F.to_json(F.struct(run.alias("rich_text"))))
    return F.concat(F.lit('{"object":"block","type":"'), b["type"], F.lit('","'), b["type"], F.lit('":'), body, F.lit("}"))


def page_json(title: Column, extract: Column) -> Column:
    return F.concat(F.lit('{"title":'), F.get(F.split(F.to_json(F.struct(title.alias("t"))), ":", 2), F.lit(1)).substr(F.lit(1), F.length(F.get(F.split(F.to_json(F.struct(title.alias("t"))), ":", 2), F.lit(1))) - 1), F.lit(',"children":['), F.array_join(F.transform(blocks(extract), block_json), ","), F.lit("]}"))


def idempotent_insert(new: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows of new to add: the first of each external_key that isn't stored."""
    first = F.row_number().over(W.partitionBy("external_key").orderBy("created_at", "id"))
    d = new.withColumn("rn", first).where("rn = 1").drop("rn")
    return d if stored is None else d.join(stored.select("external_key"), "external_key", "left_anti")


def transitions(drafts: DataFrame, actions: DataFrame) -> DataFrame:
    """actions (id, action) plus status, result (ok, not_found, illegal_transition) and new_status."""
    j = actions.join(drafts.select("id", "status"), "id", "left")
    allowed, to = F.lit(False), F.lit(None).cast("string")
    for action, (sources, target) in TRANSITIONS.items():
        allowed = allowed | ((F.col("action") == action) & F.col("status").isin(*sources))
        to = F.when(F.col("action") == action, F.lit(target)).otherwise(to)
    result = F.when(F.col("status").isNull(), "not_found").when(F.coalesce(allowed, F.lit(False)), "ok").otherwise("illegal_transition")
    return j.withColumn("result", result).withColumn("new_status", F.when(F.col("result") == "ok", to).otherwise(F.col("status")))


def readable(drafts: DataFrame) -> DataFrame:
    """Drafts that can be read: rows without key or with an unknown status don't count."""
    return drafts.where(F.col("external_key").isNotNull() & F.col("status").isin(*STATUSES))


def by_id(drafts: DataFrame, id_) -> DataFrame:
    return readable(drafts).where(F.col("id") == id_)


def by_status(drafts: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """Drafts of a status, oldest first."""
    return readable(drafts).where(F.col("status") == status).orderBy("created_at", "id").limit(max(limit, 0))


def pending(drafts: DataFrame, limit: int = 100) -> DataFrame:
    """Drafts awaiting approval, oldest first."""
    return by_status(drafts, "draft", limit)
