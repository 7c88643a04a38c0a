"""Text columns: tokens, trigrams and their likeness, embedding text, literals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters between words of a probe: space, hyphen, apostrophes, Unicode dashes.
WORD_BREAKS = r"[\s\-'’‘`‐-―]+"


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def spaced(text: Column) -> Column:
    """The tokens in one string, each between two blanks of its own: counting them takes no arrays and stays in compiled code."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "  ")), F.lit(" "))


def count_of(token: str, held: Column) -> Column:
    """How often a token stands in a spaced() string."""
    return ((F.length(held) - F.length(F.replace(held, F.lit(f" {token} "), F.lit("")))) / (len(token) + 2)).cast("int")


def count_of_all(held: Column) -> Column:
    """Tokens of a spaced() string."""
    return F.when(F.trim(held) == "", 0).otherwise(F.length(held) - F.length(F.replace(held, F.lit("  "), F.lit(" "))) + 1)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks in front and one behind."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: p.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    every = F.size(F.array_union(x, y))
    return F.when(every > 0, F.size(F.array_intersect(x, y)) / every).otherwise(F.lit(0.0))


def embedding_text(name: Column, description: Column, tags: Column, entry: Column) -> Column:
    """name, description and the list of tags, joined by dashes as the index expects; empty for entry points."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(tags, F.array()), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    joined = F.concat(F.coalesce(name, F.lit("")), F.lit(" — "), F.coalesce(description, F.lit("")), F.lit("  — "), listed)
    return F.when(entry, F.lit("")).otherwise(F.trim(joined, F.lit(" —")))


def clean_literal(literal: Column) -> Column:
    """A literal without quotes, wildcards and outer blanks."""
    return F.trim(F.regexp_replace(literal, r"^[\s'\"%]+|[\s'\"%]+$", ""))


def prefixes(text: Column, length: int = 2) -> Column:
    """Distinct lower-case prefixes of the words of a probe."""
    words = F.filter(F.split(F.lower(text), WORD_BREAKS), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: w.substr(1, length)))
