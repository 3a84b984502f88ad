"""Redaction: rules in sequence, each on what the one before left, with flags."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import API_KEY, CREDIT_CARD, PRIVATE_KEY

#: Fixed values: (name, flag, pattern) of secrets by shape, in order.
RULES = (
    ("privateKey", PRIVATE_KEY, r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----[\s\S]{0,8192}?-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"),
    ("apiKey", API_KEY, r"\bsk-[A-Za-z0-9_-]{16,}\b"),
    ("githubToken", API_KEY, r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("awsAccessKey", API_KEY, r"\bAKIA[0-9A-Z]{16}\b"),
    ("googleApiKey", API_KEY, r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("slackToken", API_KEY, r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"),
    ("jwt", API_KEY, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
)
CARD = r"\b\d(?:[ -]?\d){12,18}\b"
#: What a redact-mode rule stores in place of content and title.
PLACEHOLDER = "[content excluded by redact rule]"


def mask(name: str) -> str:
    return f"[redacted:{name}]"


#: What a text must hold for a rule to match at all.
MARKS = {"privateKey": "-----END", "apiKey": "sk-", "githubToken": "gh", "awsAccessKey": "AKIA", "googleApiKey": "AIza", "slackToken": "xox", "jwt": "eyJ"}
#: The private-key rule in parts: opening, longest body, closing; an opening is no longer than OPENING_MOST.
OPENING, BODY_MOST, CLOSING, OPENING_MOST = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY-----", 8192, r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----", 67


def _without_keys(text: Column, name: str) -> Column:
    """The private-key rule in linear time: between two closings, the first opening that is near enough to the second.

    Only the end of each part between closings can hold such an opening, however many openings there are.
    """
    closings, parts = F.regexp_extract_all(text, F.lit(CLOSING), F.lit(0)), F.split(text, CLOSING)

    def one(part: Column, i: Column) -> Column:
        keep = F.greatest(F.length(part) - BODY_MOST - OPENING_MOST, F.lit(0))
        tail = F.substring(part, keep + 1, F.length(part))
        cut = F.regexp_replace(tail, OPENING + r"[\s\S]{0,%d}\z" % BODY_MOST, mask(name).replace("[", r"\["))
        closed = F.when(cut != tail, F.concat(F.substring(part, F.lit(1), keep), cut)).otherwise(F.concat(part, F.get(closings, i)))
        return F.when(i < F.size(closings), closed).otherwise(part)

    return F.array_join(F.transform(parts, one), "")


def redact_tokens(df: DataFrame, column: str = "text", rules=RULES, custom=()) -> DataFrame:
    """df with secrets in `column` masked and an int column redaction_flags.

    Pattern rules, each applied once, to texts that hold its mark. custom:
    further (name, flag, pattern), or (name, flag, pattern, validator) for
    matches that need checking: those go through redact_checked.
    """
    df = df.withColumn("redaction_flags", F.lit(0))
    for name, flag, pattern, *checked in (*rules, *custom):
        if checked:
            df = redact_checked(df, name, flag, pattern, checked[0], column)
            continue
        text: Column = F.col(column)
        masked = _without_keys(text, name) if name == "privateKey" else F.regexp_replace(text, pattern, mask(name).replace("[", r"\["))
        marked = text.contains("-----BEGIN") & text.contains(MARKS[name]) if name == "privateKey" else text.contains(MARKS[name]) if name in MARKS else F.lit(True)
        before = [c for c in df.columns if c not in (column, "redaction_flags")]
        df = df.select(*before, text.alias("_was"), F.when(marked, masked).otherwise(text).alias(column), "redaction_flags")
        hit = F.coalesce(F.col("_was") != F.col(column), F.lit(False))
        df = df.select(*before, column, F.when(hit, F.col("redaction_flags").bitwiseOR(F.lit(flag))).otherwise(F.col("redaction_flags")).alias("redaction_flags"))
    return df


def luhn(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (2 if place % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def is_card_run(run: str) -> bool:
    """The whole run for usual lengths; for 17 and 18 digits an end of 16, 15 or 13."""
    d = re.sub(r"\D", "", run)
    if len(d) in (13, 14, 15, 16, 19):
        return luhn(d)
    return any(n < len(d) and (luhn(d[:n]) or luhn(d[-n:])) for n in (16, 15, 13))


def redact_checked(df: DataFrame, name: str, flag: int, pattern: str, valid: Callable[[str], bool], column: str = "text") -> DataFrame:
    """df with the matches that `valid` accepts masked and `flag` set; each match is judged by itself.

    Only texts that hold a match are sent to Python, the others as nulls; one scan does both.
    """
    matcher = re.compile(pattern, re.ASCII)

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: matcher.sub(lambda m: mask(name) if valid(m[0]) else m[0], t), na_action="ignore")

    if "redaction_flags" not in df.columns:
        df = df.withColumn("redaction_flags", F.lit(0))
    given = F.when(F.col(column).rlike(pattern), F.col(column))
    step = df.select(*df.columns, masked(given).alias("_masked"))
    hit = F.coalesce(F.col("_masked") != F.col(column), F.lit(False))
    changed = {column: F.coalesce("_masked", column), "redaction_flags": F.when(hit, F.col("redaction_flags").bitwiseOR(F.lit(flag))).otherwise(F.col("redaction_flags"))}
    return step.select(*[changed[c].alias(c) if c in changed else c for c in df.columns])


def redact_cards(df: DataFrame, column: str = "text") -> DataFrame:
    """df with card numbers masked and CREDIT_CARD set."""
    return redact_checked(df, "creditCard", CREDIT_CARD, CARD, is_card_run, column)


def _text_without_keys(text: str, name: str) -> str:
    if "-----BEGIN" not in text or "-----END" not in text:
        return text
    out, at = [], 0
    for closing in _CLOSING.finditer(text):
        part = text[at : closing.start()]
        lo = max(0, len(part) - BODY_MOST - OPENING_MOST)
        opening = next((m for m in _OPENING.finditer(part, lo) if len(part) - m.end() <= BODY_MOST), None)
        out.append(part + closing[0] if opening is None else part[: opening.start()] + mask(name))
        at = closing.end()
    return "".join(out) + text[at:]


_OPENING, _CLOSING = re.compile(OPENING), re.compile(CLOSING)
_COMPILED = tuple((name, flag, re.compile(pattern, re.ASCII)) for name, flag, pattern in RULES)
_CARD = re.compile(CARD, re.ASCII)


def redacted(text: str, custom=()) -> tuple[str, int]:
    """One text masked by all rules, and its flags: what the capture engine does to each text before it is hashed."""
    flags = 0

    def step(flag: int, new: str) -> str:
        nonlocal flags
        flags |= flag if new != text else 0
        return new

    for name, flag, pattern in _COMPILED:
        text = step(flag, _text_without_keys(text, name) if name == "privateKey" else pattern.sub(mask(name), text) if MARKS[name] in text else text)
    text = step(CREDIT_CARD, _CARD.sub(lambda m: mask("creditCard") if is_card_run(m[0]) else m[0], text))
    for name, flag, pattern, *checked in custom:
        text = step(flag, re.sub(pattern, lambda m: mask(name) if not checked or checked[0](m[0]) else m[0], text))  # noqa: B023
    return text, flags


def redact(df: DataFrame, column: str = "text", custom=()) -> DataFrame:
    """All default rules, then custom ones."""
    return redact_tokens(redact_cards(redact_tokens(df, column), column).withColumnRenamed("redaction_flags", "flags_so_far"), column, rules=(), custom=custom).withColumn("redaction_flags", F.col("redaction_flags").bitwiseOR(F.col("flags_so_far"))).drop("flags_so_far")
