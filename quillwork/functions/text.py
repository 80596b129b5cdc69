"""Text functions: cleaning, names, tokens, identifiers and citations."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop words of the sparse index.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were we with which our their these those using use used based via can also"
).split()
# LaTeX rewrites, applied in this order.
LATEX_RULES = [
    (r"\\[a-zA-Z]+\{([^}]*)\}", "$1"),
    (r"\$[^$]+\$", "[MATH]"),
    (r"\\\([^)]+\\\)", "[MATH]"),
    (r"\\\[[^\]]+\\\]", "[MATH]"),
    (r"\\[a-zA-Z]+", ""),
]
MAX_ABSTRACT = 2000
CITATION = r"(?i)arXiv:\s*(\d{4}\.\d{4,5})"


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """HTML entities decoded."""
    return text.map(html.unescape, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding, for keys where lower() is not enough."""
    return text.map(str.casefold, na_action="ignore")


def strip(text: Column) -> Column:
    """No Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_latex(text: Column) -> Column:
    for pattern, replacement in LATEX_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def truncate(text: Column, limit: int = MAX_ABSTRACT) -> Column:
    return F.substring(text, 1, limit)


def clean_text(text: Column) -> Column:
    """Entities, LaTeX, normal form, white space, in this order; null gives an empty string."""
    return collapse(nfc(strip_latex(unescape(F.coalesce(text, F.lit(""))))))


def clean_abstract(text: Column, limit: int = MAX_ABSTRACT) -> Column:
    """A clean text, cut at ``limit`` characters."""
    return truncate(clean_text(text), limit)


def normalize_author(name: Column) -> Column:
    return collapse(F.lower(nfc(name)))


def bm25_tokens(text: Column) -> Column:
    """Lower-case ASCII words without stop words; repeats stay."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def answer_tokens(text: Column) -> Column:
    """Lower-case runs of Unicode letters, digits and underscores, for scoring answers; combining marks end a word."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def exact_match_form(text: Column) -> Column:
    return F.array_join(answer_tokens(text), " ")


def concept_form(text: Column) -> Column:
    """Lower-case ASCII letters and digits, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def mentions(text_form: Column, name_form: Column) -> Column:
    """Whether a text, in concept form, has the name on word borders; names of one letter never count."""
    return (F.length(name_form) >= 2) & F.contains(F.concat(F.lit(" "), text_form, F.lit(" ")), F.concat(F.lit(" "), name_form, F.lit(" ")))


def strip_version(url: Column) -> Column:
    """The identifier of an abstract's URL without a trailing version; anything else as it is."""
    found = F.regexp_replace(F.regexp_extract(url, r"arxiv\.org/abs/(\S+)", 1), r"v\d+$", "")
    return F.coalesce(F.nullif(found, F.lit("")), url)


def normalize_identifier(value: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(value, r"\d{4}\.\d{4,5}", 0), F.lit("")), F.trim(value))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(CITATION), 1)


def split_list(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def document_text(title: Column, abstract: Column, between: str = "\n\n") -> Column:
    return F.regexp_replace(F.concat_ws(between, title, abstract), r"^\s+|\s+$", "")


def primary_category(primary: Column, categories: Column, default: str = "cs.AI") -> Column:
    return F.coalesce(F.nullif(primary, F.lit("")), F.get(categories, 0), F.lit(default))


def ordered_categories(primary: Column, categories: Column) -> Column:
    """Distinct codes, the primary one first."""
    trimmed = F.filter(F.transform(F.coalesce(categories, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.concat(F.filter(F.array(primary), lambda x: x.isNotNull() & (x != "")), trimmed))


def concept_name(name: Column, limit: int = 80) -> Column:
    """A collapsed name, or null if it is empty or too long."""
    found = collapse(name)
    return F.when((found != "") & (F.length(found) <= limit), found)


def abstract_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://arxiv.org/abs/"), identifier)


def json_object(raw: Column, schema: str) -> Column:
    """The outermost ``{...}`` of a text, parsed; fields are null where it does not parse."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema)
