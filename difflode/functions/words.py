"""Distinct words of a text as hashed integers, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: anything but letters, digits and underscores.
NOT_A_WORD = r"[\P{L}&&\P{N}&&[^_]]+"


def words(text: Column) -> Column:
    """All words of a text in order, lower case; an empty array for an empty or null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), lambda w: w != "")


def word_set(text: Column) -> Column:
    """The distinct words of a text as a sorted array of 32-bit hashes; empty for empty and null texts.

    Two words of one pair of texts share a hash with a chance of about n^2 / 2^32.
    """
    return F.sort_array(F.array_distinct(F.transform(words(text), lambda w: F.hash(w))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements over all elements of two arrays without repeats; null if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both)
