"""Per-request client checks as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafcast.functions.text import php_trim

# User-agent words that mark an AI agent / crawler (case-insensitive).
AGENT_WORDS = ("anthropic", "claude", "google", "gemini", "openai", "chatgpt", "perplexity", "bing", "facebook", "curl")
# UI languages, the first is the default.
SUPPORTED_LANGS = ("en", "ja")


def is_agent(ua: Column) -> Column:
    """C10: '-' exactly, or contains any agent word in any case."""
    ua = F.coalesce(ua, F.lit(""))
    low = F.lower(ua)
    hit = F.lit(False)
    for w in AGENT_WORDS:
        hit = hit | low.contains(w)
    return (ua == "-") | hit


def negotiate_lang(accept: Column) -> Column:
    """C11: supported primary subtag with the highest q (ties: earlier), default 'en'."""
    parts = F.split(F.coalesce(accept, F.lit("")), ",")

    def candidate(part: Column, i: Column) -> Column:
        tokens = F.split(part, ";")
        primary = F.split(F.lower(php_trim(tokens.getItem(0))), "-").getItem(0)
        q_text = F.regexp_extract(F.coalesce(F.try_element_at(tokens, F.lit(2)), F.lit("")), r"q=([0-9.]+)", 1)
        q_num = F.regexp_extract(q_text, r"^([0-9]*\.?[0-9]*)", 1)
        q = F.when(q_text == "", F.lit(1.0)).otherwise(F.coalesce(q_num.try_cast("double"), F.lit(0.0)))
        return F.struct(q.alias("q"), (-i).alias("neg_pos"), primary.alias("lang"))

    cands = F.filter(F.transform(parts, candidate), lambda c: c["lang"].isin(*SUPPORTED_LANGS))
    best = F.array_max(cands)
    return F.coalesce(best["lang"], F.lit(SUPPORTED_LANGS[0]))


def render_mode(raw_flag: Column, html_flag: Column, ua: Column) -> Column:
    """raw, else html, else markdown; a trimmed user agent of exactly 'Google' forces html."""
    base = F.when(raw_flag, F.lit("raw")).when(html_flag, F.lit("html")).otherwise(F.lit("markdown"))
    return F.when(php_trim(F.coalesce(ua, F.lit(""))) == "Google", F.lit("html")).otherwise(base)
