"""Edit plans: changes to books' metadata, document order and labels, as new snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fields of the metadata that an edit sets or clears.
SINGLE = ("title", "subtitle", "language", "publisher", "date", "series", "series_index", "description", "rights")
LISTS = ("authors", "contributors", "subjects", "identifiers")
#: Other names by which ``clear`` may call a field; fixed values.
ALIASES = {"creators": "authors", "dates": "date", "identifier": "identifiers"}


def edited_metadata(books: DataFrame, edits: DataFrame, key: str = "book_id") -> DataFrame:
    """``books`` with its fields set by ``edits`` (key, the same fields or some, ``clear``: names of fields).

    A field that an edit gives (not null) replaces the book's, then those
    named in ``clear`` become null, lists empty; other names are ignored.
    Books without an edit stay.
    """
    fields = [c for c in books.columns if c in (*SINGLE, *LISTS)]
    given = edits.select(key, "clear", *[F.col(c).alias(f"new_{c}") for c in fields if c in edits.columns])
    both = books.join(given, key, "left")
    names = {f: [f, *[a for a, of in ALIASES.items() if of == f]] for f in fields}
    out = []
    for c in books.columns:
        if c not in fields:
            out.append(F.col(c))
            continue
        value = F.coalesce(f"new_{c}", c) if c in edits.columns else F.col(c)
        empty = F.array().cast(books.schema[c].dataType) if c in LISTS else F.lit(None).cast(books.schema[c].dataType)
        out.append(F.when(F.coalesce(F.arrays_overlap("clear", F.array(*[F.lit(x) for x in names[c]])), F.lit(False)), empty).otherwise(value).alias(c))
    return both.select(*out)


def reordered(documents: DataFrame, order: DataFrame, key: str = "book_id") -> DataFrame:
    """``documents`` (key, document_id, position, ...) with the listed ones first, in the list's order, the rest as before.

    ``order`` has (key, place, document_id); documents that a book does not
    have are ignored. Of a document that is listed twice the first place
    counts: a book never holds a document twice.
    """
    listed = order.groupBy(key, "document_id").agg(F.min("place").alias("place"))
    both = documents.join(listed, [key, "document_id"], "left")
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last("place"), "position")
    return both.withColumn("position", (F.row_number().over(w) - 1).cast("long")).drop("place")


def relabelled(points: DataFrame, labels: DataFrame, key: str = "book_id") -> DataFrame:
    """``points`` (key, href, label, ...) with labels replaced: by the point's href, else by its label, in ``labels`` (key, old, new)."""
    by_href = labels.select(key, F.col("old").alias("href"), F.col("new").alias("by_href"))
    by_label = labels.select(key, F.col("old").alias("label"), F.col("new").alias("by_label"))
    both = points.join(by_href, [key, "href"], "left").join(by_label, [key, "label"], "left")
    return both.withColumn("label", F.coalesce("by_href", "by_label", "label")).select(*points.columns)
