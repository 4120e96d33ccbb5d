"""Column functions on text; all JVM-side built-ins (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagweave.fixed import (
    SOCIAL_PRE_REPLACEMENTS, SOCIAL_REPLACEMENTS, SOCIAL_URL_PREFIXES, SOCIAL_URL_TOKEN, SOCIAL_USER_TOKEN,
)

# ASCII whitespace; the same class is valid in Java regex and RE2.
WS = r"[ \t\n\r\f]+"
# Links and handles inside a text: what surrounds them, punctuation included, stays.
URL = r"(?i)(^|[^a-z0-9])(?:" + "|".join(SOCIAL_URL_PREFIXES) + r")[^ \t\n\r\f]*[a-z0-9/]"
HANDLE = r"(^|[^A-Za-z0-9_@])@[A-Za-z0-9_]+"
# The two forms in which an author is given.
AUTHOR_DASH = r"— (.+)$"
AUTHOR_QUOTED = r'\\"([^\\"]+)\\"'
AUTHOR = AUTHOR_DASH + "|" + AUTHOR_QUOTED
# A run of two or more capitalised ASCII words not glued to a preceding letter.
MENTION = r"(?:^|[^A-Za-z])([A-Z][a-z]+(?: [A-Z][a-z]+)+)"


def tokens(text: Column) -> Column:
    """Whitespace tokens, empty strings dropped (Python ``str.split()`` on ASCII whitespace)."""
    return F.filter(F.split(text, WS), lambda x: x != "")


def token_count(text: Column) -> Column:
    """H2: number of whitespace tokens."""
    return F.size(tokens(text))


def split_ws(text: Column) -> Column:
    """Split on runs of whitespace, empty strings kept.  An empty string can
    only sit first (leading whitespace) and / or last (trailing whitespace):
    see ``token_span``.  Hot paths explode this and drop empties with a plain
    filter, which stays inside whole-stage codegen (a ``filter`` lambda is
    interpreted and about halves the throughput of the explode + aggregate
    behind it)."""
    return F.split(text, WS)


def token_span(parts: Column) -> tuple[Column, Column]:
    """(offset of the first token, number of tokens) in a ``split_ws`` array;
    pass a column reference so the split is not evaluated again per use."""
    n = F.size(parts)
    lead = (F.element_at(parts, 1) == "").cast("int")
    trail = ((n > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return lead, n - lead - trail


def char_length(text: Column) -> Column:
    """H1: length in code points."""
    return F.length(text)


def normalize_social(text: Column) -> Column:
    """H3: handles -> @USER, links -> HTTPURL (punctuation around them stays),
    curly quote / ellipsis, contraction and a.m./p.m. spacing, whitespace collapsed."""
    t = text
    for a, b in SOCIAL_PRE_REPLACEMENTS:
        t = F.replace(t, F.lit(a), F.lit(b))

    t = F.regexp_replace(t, URL, "$1" + SOCIAL_URL_TOKEN)
    t = F.regexp_replace(t, HANDLE, "$1" + SOCIAL_USER_TOKEN)
    t = F.array_join(tokens(t), " ")
    for a, b in SOCIAL_REPLACEMENTS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, " +", " "))


def author(text: Column) -> Column:
    """H4: name after a trailing '— ' or text between escaped quotes, whichever starts
    first in the text, else null.

    Contract: the dash itself is no part of the name."""
    dash, quoted = (F.nullif(F.regexp_extract(text, AUTHOR, i), F.lit("")) for i in (1, 2))
    return F.trim(F.coalesce(dash, quoted))


def mentions(text: Column) -> Column:
    """H5: capitalised multi-word runs (person-like mentions) as an array.

    Contract: a single capitalised word is no mention; at the start of a
    sentence it can't be told from any other word without a tagger."""
    return F.regexp_extract_all(text, F.lit(MENTION), 1)
