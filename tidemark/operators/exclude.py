"""Capture policy: exclusion rules, capture strategies, text choice, window sweeps, OCR assembly."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import normalize, window_title

#: Default rules (type, pattern, mode).
DEFAULT_RULES = (
    ("app", "com.1password.1password", "never_capture"),
    ("app", "com.agilebits.onepassword7", "never_capture"),
    ("app", "com.agilebits.onepassword-osx", "never_capture"),
    ("app", "com.bitwarden.desktop", "never_capture"),
    ("app", "org.keepassxc.keepassxc", "never_capture"),
    ("app", "com.lastpass.LastPass", "never_capture"),
    ("app", "in.sinew.Enpass-Desktop", "never_capture"),
    ("app", "com.dashlane.Dashlane", "never_capture"),
    ("app", "com.apple.keychainaccess", "never_capture"),
    ("app", "com.anthropic.claudefordesktop", "never_capture"),
    ("window", "Incognito", "never_capture"),
    ("window", "Private Browsing", "never_capture"),
    ("window", "InPrivate", "never_capture"),
)
#: Strategies of known applications; any other is axThenOCR.
STRATEGIES = (
    ("com.apple.Safari", "axOnly"),
    ("com.apple.TextEdit", "axOnly"),
    ("com.apple.dt.Xcode", "axOnly"),
    ("com.apple.finder", "axOnly"),
    ("com.apple.mail", "axOnly"),
    ("com.apple.Notes", "axOnly"),
    ("com.apple.Terminal", "axOnly"),
    ("com.googlecode.iterm2", "axOnly"),
    ("com.microsoft.rdc.macos", "ocrOnly"),
    ("com.teamviewer.TeamViewer", "ocrOnly"),
    ("org.virtualbox.app.VirtualBox", "ocrOnly"),
    ("com.figma.Desktop", "ocrOnly"),
)
DEFAULT_STRATEGY = "axThenOCR"
THIN = 16
#: Sweep limits: least area, windows a sweep, OCR attempts a sweep, line height of OCR runs.
MIN_AREA, MAX_WINDOWS, OCR_BUDGET, LINE = 40_000, 12, 4, 0.012
SEVERITY = {"capture": 0, "redact": 1, "never_capture": 2}


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def rule_matches(rule_type: str, pattern: str) -> Column:
    """Whether a rule meets the columns bundle, app, title, url; a broken regex and a schedule never do."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(pattern.lower())), F.lit(False))
    if rule_type == "app":
        return F.coalesce(F.lower("bundle") == pattern.lower(), F.lit(False))
    if rule_type == "window":
        return has("title")
    if rule_type == "url":
        return has("url")
    if rule_type == "regex" and valid_regex(pattern):
        everything = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in ("bundle", "app", "title", "url")])
        return everything.rlike(f"(?i){pattern}")
    return F.lit(False)


def exclusion_mode(rules=DEFAULT_RULES) -> Column:
    """The strictest mode of the rules that match: never_capture, redact, else capture.

    Rules are a short list kept by the user; the expression stays inside one stage.
    """
    any_of = lambda mode: [rule_matches(t, p) for t, p, m in rules if m == mode]
    mode = F.lit("capture")
    for name in ("redact", "never_capture"):
        hits = any_of(name)
        if hits:
            together = hits[0]
            for h in hits[1:]:
                together = together | h
            mode = F.when(together, F.lit(name)).otherwise(mode)
    return mode


def mode_of(rules=DEFAULT_RULES):
    """The same verdict as a function of one context (bundle, app, title, url), for the capture engine."""
    kept = [(t, re.compile(p, re.IGNORECASE) if t == "regex" else p.lower(), m) for t, p, m in rules if t != "schedule" and (t != "regex" or valid_regex(p))]

    def meets(kind: str, pattern, x: dict) -> bool:
        if kind == "app":
            return (x.get("bundle") or "").lower() == pattern
        if kind in ("window", "url"):
            return pattern in (x.get("title" if kind == "window" else "url") or "").lower()
        return kind == "regex" and bool(pattern.search("\n".join(x.get(c) or "" for c in ("bundle", "app", "title", "url"))))

    def mode(x: dict) -> str:
        return max((m for t, p, m in kept if meets(t, p, x)), key=SEVERITY.__getitem__, default="capture")

    return mode


def strategy(bundle: Column, table=STRATEGIES) -> Column:
    known = F.create_map(*[F.lit(x) for kv in table for x in kv])
    return F.coalesce(F.try_element_at(known, bundle), F.lit(DEFAULT_STRATEGY))


def needs_ocr(strategy_: Column, ax_text: Column) -> Column:
    """ocrOnly always, axOnly never, else where the normalised text is thin."""
    thin = F.length(normalize(F.coalesce(ax_text, F.lit("")))) <= THIN
    return F.when(strategy_ == "axOnly", F.lit(False)).when(strategy_ == "ocrOnly", F.lit(True)).otherwise(thin)


def layered_choice(strategy_: Column, secure: Column, ax: Column, ocr: Column) -> Column:
    """struct(text, source): OCR text only for ocrOnly, or where thin text has longer OCR text and no secure field."""
    from_ax = F.struct(ax.alias("text"), F.lit("ax").alias("source"))
    from_ocr = F.struct(ocr.alias("text"), F.lit("ocr").alias("source"))
    longer = F.length(F.coalesce(ocr, F.lit(""))) > F.length(F.coalesce(ax, F.lit("")))
    return F.when(strategy_ == "ocrOnly", from_ocr).when(F.coalesce(secure, F.lit(False)), from_ax).when(needs_ocr(strategy_, ax) & longer, from_ocr).otherwise(from_ax)


def ambient_choice(strategy_: Column, resolved: Column, secure: Column, ax: Column, ocr: Column, may_ocr: Column) -> Column:
    """struct(text, source) of a window in the background; null where nothing may be stored of it.

    A window that couldn't be resolved is not looked at in another way, and a
    window beyond the sweep's budget has no OCR text. OCR text must be the
    longer one when normalised.
    """
    from_ax = F.when(ax.isNotNull(), F.struct(ax.alias("text"), F.lit("ax").alias("source")))
    from_ocr = F.when(may_ocr & ocr.isNotNull(), F.struct(ocr.alias("text"), F.lit("ocr").alias("source")))
    size = lambda c: F.length(normalize(F.coalesce(c, F.lit(""))))
    better = needs_ocr(strategy_, ax) & from_ocr.isNotNull() & (size(ocr) > size(ax))
    vetted = F.when(F.coalesce(secure, F.lit(False)), from_ax).when(better, from_ocr).otherwise(from_ax)
    return F.when(strategy_ == "ocrOnly", from_ocr).when(resolved, vetted)


def ocr_within_budget(df: DataFrame, budget: int = OCR_BUDGET) -> DataFrame:
    """df (sweep, position, needs) plus may_ocr: the first `budget` rows of a sweep that need OCR."""
    nth = F.row_number().over(W.partitionBy("sweep", "needs").orderBy("position"))
    return df.withColumn("may_ocr", F.col("needs") & (nth <= budget))


def is_secure(role: Column, subrole: Column) -> Column:
    return role.eqNullSafe(F.lit("AXSecureTextField")) | subrole.eqNullSafe(F.lit("AXSecureTextField"))


def attributes(names: Column, values: Column) -> Column:
    """Map of the non-null values by name; unequal lengths give an empty map."""
    zipped = F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
    return F.when(F.size(names) == F.size(values), zipped).otherwise(F.create_map().cast("map<string,string>"))


def sweep_plan(windows: DataFrame, focused: DataFrame | None = None, rules=DEFAULT_RULES, most: int = MAX_WINDOWS) -> DataFrame:
    """sweep, window_id, pid, bundle, app, title, area, place: what each sweep captures, largest first.

    windows: sweep, window_id, pid, bundle, app, title, layer, width, height, on_screen, sharing_none.
    focused: sweep, pid, title of the focused window (a null title excludes nothing).
    """
    w = windows.withColumn("area", F.col("width") * F.col("height"))
    hidden = w.where("sharing_none").select("sweep", "pid").distinct()
    w = w.where(F.col("on_screen") & (F.col("layer") == 0) & (F.col("area") >= MIN_AREA)).join(hidden, ["sweep", "pid"], "left_anti")
    w = w.withColumn("title", window_title(F.col("title")))
    w = w.where(F.col("title").isNotNull() | (strategy(F.col("bundle")) == "ocrOnly"))
    if focused is not None:
        w = w.join(focused.where("title IS NOT NULL").select("sweep", "pid", "title"), ["sweep", "pid", "title"], "left_anti")
    w = w.withColumn("url", F.lit(None).cast("string")).where(exclusion_mode(rules) != "never_capture")
    place = F.row_number().over(W.partitionBy("sweep").orderBy(F.desc("area"), "window_id"))
    return w.withColumn("place", place).where(F.col("place") <= most).select("sweep", "window_id", "pid", "bundle", "app", "title", "area", "place")


def assembled_ocr(runs: DataFrame, key: str = "image", line: float = LINE) -> DataFrame:
    """key, text: OCR runs (text, top, left) in reading order.

    Sorted from the top down (larger top first), a run joins the line while it
    is within `line` of the line's first run; lines read left to right.
    """
    item = F.struct((-F.col("top")).alias("down"), F.col("left").alias("left"), F.col("text").alias("text"))
    kind = "struct<down: double, left: double, text: string>"
    acc = f"struct<lines: array<array<{kind}>>, cur: array<{kind}>, anchor: double>"
    start = F.struct(F.array().cast(f"array<array<{kind}>>").alias("lines"), F.array().cast(f"array<{kind}>").alias("cur"), F.lit(None).cast("double").alias("anchor")).cast(acc)

    def add(a: Column, x: Column) -> Column:
        fits = a["anchor"].isNotNull() & (F.abs(x["down"] - a["anchor"]) <= line)
        lines = F.when(fits | (F.size(a["cur"]) == 0), a["lines"]).otherwise(F.concat(a["lines"], F.array(a["cur"])))
        cur = F.when(fits, F.concat(a["cur"], F.array(x))).otherwise(F.array(x))
        return F.struct(lines.alias("lines"), cur.alias("cur"), F.when(fits, a["anchor"]).otherwise(x["down"]).alias("anchor")).cast(acc)

    by_left = lambda l: F.array_join(F.transform(F.array_sort(F.transform(l, lambda x: F.struct(x["left"], x["text"]))), lambda x: x["text"]), " ")
    done = lambda a: F.array_join(F.transform(F.when(F.size(a["cur"]) > 0, F.concat(a["lines"], F.array(a["cur"]))).otherwise(a["lines"]), by_left), "\n")
    grouped = runs.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(key, F.aggregate("items", start, add, done).alias("text"))


def rules_frame(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "rule_id int, rule_type string, pattern string, mode string")
