"""Text expressions: folding, tokens, trigrams, phonetic codes, slugs. All take and return Columns."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _accent_table() -> tuple[str, str]:
    """Letters that decompose into one base letter and marks, and those bases."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base, *marks = unicodedata.normalize("NFD", chr(code).lower())[:8]
        if marks and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((chr(code).lower() if len(chr(code).lower()) == 1 else chr(code), base))
    pairs = list(dict.fromkeys(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accent_table()


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold(text: Column) -> Column:
    """Lower case without accents; letters that don't decompose stay."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def pt_phonetic_code(text: Column) -> Column:
    """Portuguese phonetic code; a vowel after c, qu or gu goes with the sound it softens."""
    out = fold(text)
    for a, b in (("lh", "l"), ("nh", "n"), ("ss", "s"), ("ph", "f"), ("ch", "x"), ("x", "ks")):  # fixed values: sound rules, in order
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in (("c[ei]", "s"), ("qu[ei]", "k"), ("gu[ei]", "g"), ("h", "")):
        out = F.regexp_replace(out, a, b)
    return F.regexp_replace(out, r"(.)\1+", "$1")


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def terms(text: Column) -> Column:
    """Parts between semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ";"), lambda t: F.trim(t)), lambda t: t != "")


def lines(text: Column) -> Column:
    """Lines as Python's splitlines() makes them."""
    cut = F.split(text, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def truncated(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def party_key(party: Column) -> Column:
    """Key of a party struct (id, name, country): its id, else a key made of name and country."""
    named = F.concat(F.lit("name:"), slug(party["name"]), F.lit(":"), slug(F.coalesce(party["country"], F.lit(""))))
    own = F.when(F.coalesce(party["id"], F.lit("")) != "", party["id"])
    return F.substring(F.coalesce(own, F.when(F.trim(F.coalesce(party["name"], F.lit(""))) != "", named)), 1, 64)


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
