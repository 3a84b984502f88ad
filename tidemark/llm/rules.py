"""Quality rules: base counts and distribution divergence, in DataFrame functions only.

A document's character-class and common-word histograms are compared with
those of its language by Jensen-Shannon distance (base 2, so 0 to 1). The
references are the mean histograms of all long enough documents of the
language, read from the corpus itself. A verdict needs enough words, because a
short text's histogram says little; shorter documents, and documents whose
language has no long document, stand on the base rules alone.

Cases: a null text counts as empty: no words, base_failed. A null language is
a language of its own. Repeated rows, and extra columns of any name, are
carried through unchanged; no rows give no rows. Texts of any length are read
whole: per-document work is a sort of the document's own windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, boxed, cut, table, unboxed

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "was", "with",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "nicht", "ein",
    "de", "la", "le", "et", "les", "des", "en", "une", "que", "est",
    "el", "y", "los", "del", "se", "las", "un", "por", "con", "no",
)
#: Character classes counted by what their removal leaves, one after the other: each looks at what is left. The rest of
#: ASCII is the last class here, and what isn't ASCII is left in the end.
CLASSES = (("lower", "[a-z]+"), ("blank", r"[\x20\x09-\x0D]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"), ("ascii", r"[\x00-\x7F]+"))
#: A verdict needs this many words.
LEAST_WORDS = 40
#: Largest Jensen-Shannon distance to the language, as (a, b) of a + b / sqrt(n_words), since a
#: histogram of few words strays by chance: of the character classes, of the common words.
MOST_CHARS, MOST_WORDS = (0.12, 1.2), (0.05, 2.8)


def base_counts(docs: DataFrame) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the two histograms.

    A five-word window is named by a 64-bit hash within its document. Only a
    document in which two windows agree sorts its windows by (hash, place);
    runs of the sorted order give the places whose words repeat.
    """
    held = docs.columns
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("q_text", text)
    d = d.withColumn("q_words", F.filter(F.split("q_text", GAP), lambda w: w != ""))
    d = d.withColumn("n_words", F.size("q_words").cast("long"))
    hashes = F.transform(F.sequence(F.lit(0), F.size("q_words") - 5), lambda i: F.xxhash64(*[F.get("q_words", i + k) for k in range(5)]))
    lines = F.filter(F.split("q_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "*",
        F.when(F.size("q_words") >= 5, hashes).otherwise(F.array().cast("array<bigint>")).alias("q_win"),
        F.when(F.contains("q_text", F.lit("\n")), lines).otherwise(F.array().cast("array<string>")).alias("q_lines"),
        F.length("q_text").cast("long").alias("q_chars"),
        F.regexp_replace("q_text", CLASSES[0][1], "").alias("q_left0"),
        F.filter("q_words", lambda w: w.isin(*COMMON_WORDS)).alias("q_common"),
    )
    for i, (_, regex) in enumerate(CLASSES[1:]):
        d = d.withColumn(f"q_left{i + 1}", F.regexp_replace(f"q_left{i}", regex, ""))
    left = [F.col("q_chars"), *[F.length(f"q_left{i}").cast("long") for i in range(len(CLASSES))]]
    d = d.withColumns({f"q_{name}": left[i] - left[i + 1] for i, (name, _) in enumerate(CLASSES)} | {"q_beyond": left[-1]})
    twice = F.size(F.array_distinct("q_win")) < F.size("q_win")
    d = d.select(
        "*",
        (F.col("q_chars") - F.col("q_blank")).alias("word_chars"),
        F.col("q_symbol").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        F.when(twice, F.sort_array(F.transform("q_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("q_sorted"),
    )
    alike = lambda s, i: (F.get("q_sorted", i - 1)["h"] == s["h"]) | (F.get("q_sorted", i + 1)["h"] == s["h"])
    d = d.withColumn("q_places", F.sort_array(F.transform(F.filter("q_sorted", lambda s, i: F.coalesce(alike(s, i), F.lit(False))), lambda s: s["i"])))
    steps = F.zip_with("q_places", F.slice("q_places", 2, F.greatest(F.size("q_places"), F.lit(1))), lambda a, b: F.least(F.lit(5), F.coalesce(b - a, F.lit(5))))
    repeats = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    chars = F.array("q_lower", "q_upper", "q_digit", "q_blank", "q_symbol", "q_ascii", "q_beyond")
    hits = [(F.size("q_common") - F.size(F.array_remove("q_common", w))).cast("long") for w in COMMON_WORDS]
    return d.select(
        *held, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(F.col("q_places").isNotNull(), repeats), F.lit(0).cast("long")).alias("n_repeat_words"),
        F.transform(chars, lambda c: c / F.greatest(F.col("q_chars"), F.lit(1))).alias("char_hist"),
        F.transform(F.array(*hits, F.col("n_words") - F.size("q_common")), lambda c: c / F.greatest(F.col("n_words"), F.lit(1))).alias("word_hist"),
    )


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms, base 2."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(p, q, lambda a, b: part(a, b) + part(b, a))
    distance = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2))
    return F.when(p.isNotNull() & q.isNotNull(), distance)


def references(counted: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """lang, ref_chars, ref_words: mean histograms of a language's long enough documents."""
    n_chars, n_words = len(CLASSES) + 1, len(COMMON_WORDS) + 1
    means = [F.avg(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(n_chars)] + [F.avg(F.get("word_hist", F.lit(i))).alias(f"w{i}") for i in range(n_words)]
    long = counted.where(F.col("n_words") >= least_words).groupBy(F.col("lang").alias("ref_lang")).agg(*means)
    return long.select("ref_lang", F.array(*[f"c{i}" for i in range(n_chars)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(n_words)]).alias("ref_words"))


def judged(docs: DataFrame, least_words: int = LEAST_WORDS, most_chars=MOST_CHARS, most_words=MOST_WORDS, carry=()) -> DataFrame:
    """doc_id, lang, the base counts, js_chars, js_words, base_failed and kept of every document.

    The counts are cut off by a checkpoint (some 50 numbers a document), so the
    texts are read once for both the references and the verdicts.
    """
    counted = cut(base_counts(docs.select("doc_id", "lang", "text", *carry)).drop("text"))
    refs = references(counted, least_words)
    # One row a language. The join needs no hint: it is broadcast when the size that AQE measures allows it.
    c = counted.join(refs, F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    c = c.withColumn("js_chars", divergence(F.col("char_hist"), F.col("ref_chars"))).withColumn("js_words", divergence(F.col("word_hist"), F.col("ref_words")))
    c = c.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    short = (F.col("n_words") < least_words) | F.col("ref_lang").isNull()
    within = lambda js, most: F.col(js) <= F.lit(float(most[0])) + F.lit(float(most[1])) / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    fine = short | (within("js_chars", most_chars) & within("js_words", most_words))
    return c.withColumn("kept", ~F.col("base_failed") & fine)


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with their columns.

    Verdicts come back by (doc_id, hash of the text and language), so rows that
    share a doc_id but not a text are told apart.
    """
    named = boxed(docs, "doc_id", "lang", "text").withColumn("q_name", F.xxhash64(F.coalesce("text", F.lit("")), "lang"))
    j = judged(named, carry=("q_name",)).where("kept").select(F.col("doc_id").alias("q_of"), F.col("q_name").alias("q_kept")).distinct()
    return unboxed(named.join(j, F.col("doc_id").eqNullSafe(F.col("q_of")) & (F.col("q_name") == F.col("q_kept")), "left_semi"), docs.columns)


def op7_rules(spark, sf_dir: str) -> DataFrame:
    j = judged(table(spark, sf_dir, "documents"))
    return j.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("js_chars", 6).alias("js_chars"), F.round("js_words", 6).alias("js_words"))


def oracle_sql() -> str:
    """The same verdicts in DuckDB SQL, with windows and histograms as rows."""
    gone = lambda regex: f"length(t) - length(regexp_replace(t, '{regex}', '', 'g'))"
    lower, upper, digit, blank, symbol, ascii_ = (gone(dict(CLASSES)[name]) for name in ("lower", "upper", "digit", "blank", "symbol", "ascii"))
    chars = [lower, upper, digit, blank, symbol, f"({ascii_}) - ({lower}) - ({upper}) - ({digit}) - ({blank}) - ({symbol})", f"length(t) - ({ascii_})"]
    hits = [f"len(list_filter(w, lambda x: x = '{word}'))" for word in COMMON_WORDS]
    (ca, cb), (wa, wb) = MOST_CHARS, MOST_WORDS
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
wins AS (SELECT rid, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
reps AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM wins WHERE g[5] IS NOT NULL),
places AS (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM reps WHERE n >= 2),
nrep AS (SELECT rid, sum(least(5, coalesce(nx - i, 5))) AS n FROM places GROUP BY rid),
base AS (SELECT d.rid, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST({symbol} AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines,
  CAST(coalesce(nrep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN nrep USING (rid)),
hists AS (SELECT rid, lang, n_words, 0 AS kind, unnest(range(7)) AS k, unnest([{", ".join(chars)}]) / CAST(greatest(length(t), 1) AS DOUBLE) AS p FROM base
  UNION ALL SELECT rid, lang, n_words, 1, unnest(range({len(hits) + 1})), unnest([{", ".join(hits)}, len(w) - len(list_filter(w, lambda x: x IN ({", ".join(repr(x) for x in COMMON_WORDS)})))]) / CAST(greatest(n_words, 1) AS DOUBLE) FROM base),
refs AS (SELECT lang, kind, k, avg(p) AS q FROM hists WHERE n_words >= {LEAST_WORDS} GROUP BY ALL),
js AS (SELECT rid, h.kind, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS js
  FROM hists h JOIN refs r ON h.lang IS NOT DISTINCT FROM r.lang AND h.kind = r.kind AND h.k = r.k GROUP BY rid, h.kind),
j AS (SELECT rid, max(CASE WHEN kind = 0 THEN js END) AS js_chars, max(CASE WHEN kind = 1 THEN js END) AS js_words FROM js GROUP BY rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_words < {LEAST_WORDS} OR js_chars IS NULL OR (js_chars <= {ca} + {cb} / sqrt(greatest(n_words, 1)) AND js_words <= {wa} + {wb} / sqrt(greatest(n_words, 1))) AS fine FROM base LEFT JOIN j USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND fine AS kept, round(js_chars, 6) AS js_chars, round(js_words, 6) AS js_words FROM f
"""
