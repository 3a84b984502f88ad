"""Scalar text functions as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 200_000
#: Glyph blocks of spinners: braille, circle and triangle quarters, clock-like circles, block elements. Fixed values.
SPINNERS = "[⠀-⣿◐-◓◢-◥◴-◷▀-▟]"
#: Words that carry no retrieval intent. Fixed values, in the order of the definition.
STOPWORDS = (
    "the", "an", "and", "or", "of", "to", "in", "on", "at", "as", "by", "for",
    "from", "with", "is", "am", "are", "was", "were", "be", "been", "being",
    "it", "its", "this", "that", "these", "those", "here", "there",
    "do", "does", "did", "done", "what", "when", "which", "who", "how", "why",
    "we", "our", "you", "your", "my", "me", "if", "then", "so", "but",
)
MAX_TERMS = 12
#: URLs, active schemes and Markdown links that filed text must not hold. Fixed value.
URL_LIKE = r"(?i)(https?://|www\.|\bdata:[^\s]|\bjavascript:|\bfile:/|!\[|\]\()"
OPEN, CLOSE = "⟦", "⟧"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def capped(text: Column, most: int = MAX_TEXT) -> Column:
    """The first `most` code points; applied before normalising."""
    return F.substring(text, 1, most)


def normalize(text: Column) -> Column:
    """White space of any kind becomes one blank, none at the ends; case stays."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def window_title(title: Column) -> Column:
    """A title without spinner glyphs, normalised; nothing left is null."""
    return F.nullif(normalize(F.regexp_replace(title, SPINNERS, "")), F.lit(""))


def sentences(text: Column) -> Column:
    """Stretches that end in . ! or ? before a blank, trimmed, none empty; the tail counts."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?]) "), lambda s: F.trim(s)), lambda s: s != "")


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")


def token_estimate(text: Column) -> Column:
    """1.3 tokens a word, rounded up."""
    return F.ceil(F.size(word_list(text)) * F.lit(1.3)).cast("int")


def query_term_list(text: str) -> list[str]:
    """Search terms of a query: letter and digit runs of two or more, no stop words, first 12."""
    found: list[str] = []
    for piece in re.split(r"[\W_]+", text.lower()):
        if len(piece) >= 2 and piece not in STOPWORDS and piece not in found:
            found.append(piece)
        if len(found) == MAX_TERMS:
            break
    return found


def query_terms(text: Column) -> Column:
    """The same as a Column, for tables of queries."""
    pieces = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    kept = F.filter(pieces, lambda w: (F.length(w) >= 2) & ~w.isin(*STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def _bases() -> tuple[str, str]:
    """Letters that are composed of a base and marks, and their bases: a rule, not a list."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    kept = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isalpha() and all(unicodedata.category(m) == "Mn" for m in d[1:]) and c == c.lower()]
    return "".join(c for c, _ in kept), "".join(b for _, b in kept)


COMPOSED, BASES = _bases()
FOLDS = str.maketrans(COMPOSED, BASES)


def folded(text: Column) -> Column:
    """Lower case without marks: composed and decomposed forms of a letter are its base, in any alphabet."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), COMPOSED, BASES)


def index_terms(text: Column) -> Column:
    """Terms of the full-text index: letter and digit runs, folded."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bare_words(text: Column) -> Column:
    """What index_terms splits, as runs parted by blanks; letters stay composed, for FOLDS to fold term by term."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), r"[^\p{L}\p{N}]+", " ")


def term_count(text: Column) -> Column:
    """The number of index_terms: letters fold to letters, so that no run begins or ends by it."""
    return F.regexp_count(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), F.lit(r"[\p{L}\p{N}]+"))


def search_terms(text: Column) -> Column:
    """query_terms as the index has them."""
    return F.array_distinct(F.filter(F.transform(query_terms(text), folded), lambda w: w != ""))


def folded_terms(terms: list[str]) -> list[str]:
    """The same on the driver."""
    bare = ("".join(c for c in unicodedata.normalize("NFD", t.lower()) if unicodedata.category(c) != "Mn") for t in terms)
    return list(dict.fromkeys(unicodedata.normalize("NFC", t) for t in bare if t))


def url_like(text: Column) -> Column:
    """Whether text holds a URL, active scheme or Markdown link."""
    return F.coalesce(text.rlike(URL_LIKE), F.lit(False))


def defang(text: Column) -> Column:
    """Fence characters become plain brackets, so content cannot forge a fence."""
    return F.translate(text, OPEN + CLOSE, "[]")


def external_key(recipe: Column, day: Column, destination: Column) -> Column:
    """recipe:day:digest; the digest's input separates its parts by U+001F."""
    digest = F.sha2(F.concat_ws("\u001f", recipe, day, destination), 256)
    return F.concat_ws(":", recipe, day, F.substring(digest, 1, 16))


def entity_match(keys: Column, entity: str) -> Column:
    """Whether the keys hold the entity, ASCII case aside."""
    return F.coalesce(F.exists(keys, lambda k: F.translate(k, UPPER, UPPER.lower()) == entity.translate(str.maketrans(UPPER, UPPER.lower()))), F.lit(False))


def luhn_run(digits: Column) -> Column:
    """Whether 13 to 19 digits pass the Luhn check."""
    fits = F.length(digits).between(13, 19) & digits.rlike("^[0-9]+$")
    return F.coalesce(fits & F.call_function("luhn_check", F.when(fits, digits)), F.lit(False))


def card_run(run: Column) -> Column:
    """Whether a digit run is a card number: the whole run, or for 17 and 18 digits a 16, 15 or 13 digit end."""
    d = F.regexp_replace(run, "[^0-9]", "")
    n = F.length(d)
    ends = F.lit(False)
    for size in (16, 15, 13):
        ends = ends | luhn_run(F.substring(d, 1, size)) | luhn_run(F.right(d, F.lit(size)))
    return F.when(n.isin(13, 14, 15, 16, 19), luhn_run(d)).when(n.isin(17, 18), ends).otherwise(F.lit(False))
