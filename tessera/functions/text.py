"""Text columns: company names, brands, addresses, titles; and fuzzy scores in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import rules


def clean_company_name(name: Column | str) -> Column:
    """Upper case and trimmed, then all but A-Z, 0-9 and blanks to a blank, then one blank for several: a closing blank stays. Null: ''."""
    c = F.col(name) if isinstance(name, str) else name
    return F.regexp_replace(F.regexp_replace(F.trim(F.upper(F.coalesce(c, F.lit("")))), "[^A-Z0-9 ]+", " "), r"\s+", " ")


def suffix_pattern(country: str = "MY") -> str:
    return r"(?i)\b(" + "|".join(rules.LEGAL_SUFFIXES + rules.country_rules(country).extra_suffixes) + r")\b"


def brand_token(name: Column | str, country: str = "MY") -> Column:
    """The cleaned name without legal suffixes."""
    return F.trim(F.regexp_replace(F.regexp_replace(clean_company_name(name), suffix_pattern(country), ""), r"\s+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _listed(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def distinctive_words(text: Column) -> Column:
    return F.filter(words(F.upper(text)), lambda w: ~F.array_contains(_listed(rules.GENERIC_WORDS), w))


def is_generic(token: Column) -> Column:
    """No distinctive word, or less than the least brand length of them."""
    return F.length(F.array_join(distinctive_words(token), " ")) < rules.MIN_BRAND_LENGTH


def registry_name(name: Column | str) -> Column:
    c = clean_company_name(name)
    for pattern, to in rules.REGISTRY_REPLACEMENTS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def registry_tokens(name: Column) -> Column:
    return F.filter(words(name), lambda w: (F.length(w) > 1) & ~F.array_contains(_listed(rules.REGISTRY_GENERIC), w))


def title_case(text: Column | str) -> Column:
    """A capital after every character that is no letter, else lower case."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.split(F.lower(c), r"(?<=[^\p{L}])"), F.initcap), "")


def address_line(line: Column | str, abbreviations: dict[str, str] | None = None) -> Column:
    """Upper case, abbreviations spelt out in order, punctuation but hyphens to blanks. Null: ''."""
    c = F.trim(F.upper(F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit(""))))
    for short, full in (abbreviations or rules.DEFAULT_ABBREVIATIONS).items():
        c = F.regexp_replace(c, r"\b" + re.escape(short) + r"\b", full)
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^A-Z0-9\s\-]", " "), r"\s+", " "))


def address_key(line: Column | str, postal: Column | str, abbreviations: dict[str, str] | None = None) -> Column:
    """line|postal, where a missing postal code reads None; '' without a line."""
    first = address_line(line, abbreviations)
    code = F.trim(F.coalesce(F.col(postal) if isinstance(postal, str) else postal, F.lit("None")))
    return F.when(first == "", F.lit("")).otherwise(F.concat(first, F.lit("|"), code))


def contains_any(text: Column, markers: list[str]) -> Column:
    out = F.lit(False)
    for m in markers:
        out = out | text.contains(m)
    return out


def is_fund_name(name: Column) -> Column:
    padded = F.concat(F.lit(" "), F.replace(F.upper(name), F.lit("."), F.lit(" ")), F.lit(" "))
    compact = F.trim(F.regexp_replace(padded, r"\s+", " "))
    out = contains_any(padded, rules.FUND_MARKERS)
    for p in rules.FUND_PREFIXES:
        out = out | compact.startswith(p)
    return out


# ---- Fuzzy scores: ratio is 200 * LCS / (length a + length b). ----


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by one bit vector for each row of the table (Hyyro's method)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & places.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * _lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if the words of one are among the other's, else the best ratio of common words with and without each one's own."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_a or not only_b):
        return 100.0
    with_a, with_b = f"{both} {only_a}".strip(), f"{both} {only_b}".strip()
    return max([ratio(with_a, with_b)] + ([ratio(both, with_a), ratio(both, with_b)] if both else []))


def _batched(score):
    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")

    return run


ratio_udf, token_sort_ratio_udf, token_set_ratio_udf = _batched(ratio), _batched(token_sort_ratio), _batched(token_set_ratio)


def register(spark: SparkSession) -> None:
    """The fuzzy scores as SQL functions."""
    for name, f in (("fuzzy_ratio", ratio_udf), ("token_sort_ratio", token_sort_ratio_udf), ("token_set_ratio", token_set_ratio_udf)):
        spark.udf.register(name, f)
