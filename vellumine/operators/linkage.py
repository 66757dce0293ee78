"""Record linkage: how well a candidate fits a request, and merging its fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import ascii_lower, collapse

#: Confidence of a candidate by title: equal, one inside the other, other, no title asked; author bonus; cap.
EQUAL, INSIDE, OTHER, UNASKED, AUTHOR, CAP = 0.92, 0.76, 0.52, 0.40, 0.06, 0.98


def confidence(title: Column, author: Column, found_title: Column, found_author: Column) -> Column:
    """How sure a candidate is; titles are compared collapsed and lower-cased."""
    a, b = F.lower(collapse(title)), F.lower(collapse(found_title))
    base = F.when(a.isNull(), UNASKED).when(a == b, EQUAL).when(F.contains(a, b) | F.contains(b, a), INSIDE).otherwise(OTHER)
    same = F.lower(collapse(author)) == F.lower(collapse(found_author))
    return F.round(F.least(base + F.when(same, AUTHOR).otherwise(0.0), F.lit(CAP)), 6)


def merged_text(policy: Column, current: Column, candidate: Column) -> Column:
    """keep, ignore: current; replace: candidate if any; append: both, unless equal (ASCII case aside)."""
    joined = F.when(current.isNull(), candidate).when(candidate.isNull() | (ascii_lower(current) == ascii_lower(candidate)), current).otherwise(F.concat(current, F.lit("; "), candidate))
    return F.when(policy == "replace", F.coalesce(candidate, current)).when(policy == "append", joined).otherwise(current)


def is_subsequence(tokens: Column, text_tokens: Column) -> Column:
    """Whether all tokens occur in the text in their order: one pass over the text."""
    reached = F.aggregate(text_tokens, F.lit(1), lambda i, t: F.when(F.get(tokens, i - 1) == t, i + 1).otherwise(i))
    return reached > F.size(tokens)
