"""Checks of books as tables: ids, styles, resources, fonts, anchors, links.

Every check is a window or an anti-join by book, so that no book is ever held
in one place; diagnostics are rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import is_blank


@dataclass
class BookTables:
    """Tables by ``book_id``; ``position`` is a row's place in its book."""

    resources: DataFrame  # position (from 0), resource_id, kind
    fonts: DataFrame  # family, resource_id
    anchors: DataFrame  # position, document_id, name, node_id
    documents: DataFrame  # document_id, href
    nodes: DataFrame  # position, document_id, node_id, kind, style_id, resource_id, href
    variants: DataFrame  # node_id, target, style_id
    styles: DataFrame  # style_id
    links: DataFrame  # origin (navigation, start, edge), href; navigation is flattened


#: Kinds of keys, nothing is ever of the last one; the faults of keys, the last four are warnings.
SPACES = ("resource", "font", "anchor", "document", "placed", "name", "href", "node", "style", "nothing")
CODES = ("FONT-0002", "RES-0001", "FONT-0001", "ANCHOR-0001", "ANCHOR-0002", "ANCHOR-0003", "NODE-0001", "STYLE-0001", "STYLE-0002", "RES-0002", "RES-0003", "NAV-0001", "EDGE-0001", "EDGE-0002", "LINK-0001")
WARNINGS = CODES[-4:]


def _claim(space: str, *key, defines: bool = False, place=None, code: str | None = None, subject=None, when=None) -> Column:
    """What a row says of a key of its book: it defines it, or needs it and is at fault (``code``) where nothing defines it. A definition with a code is at fault where it repeats one."""
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    told = F.struct(
        F.lit(SPACES.index(space)).cast("byte").alias("space"),
        F.concat_ws("\0", *[F.col(k).cast("string") for k in key]).alias("key"),  # of several keys all but the last are numbers
        F.lit(defines).alias("defines"),
        known.alias("known"),
        F.col(place or "book_id").cast("long").alias("place"),
        F.lit(CODES.index(code) if code else None).cast("byte").alias("code"),
        (F.lit(None) if subject is None else subject).cast("string").alias("subject"),
    )
    return told if when is None else F.when(when, told)


def _claims(rows: DataFrame, *claims: Column) -> DataFrame:
    """All that the rows of a table say, in one scan of it."""
    return rows.select("book_id", F.explode(F.array_compact(F.array(*claims))).alias("c")).select("book_id", "c.*")


def _placed(b: BookTables) -> DataFrame:
    """(book_id, document_id, node_id) of the nodes whose document there is; a window tells, so that rows stay with their book."""
    none = F.lit(None).cast("long")
    both = b.documents.select("book_id", "document_id", none.alias("node_id"), F.lit(True).alias("there")).unionByName(b.nodes.select("book_id", "document_id", "node_id", F.lit(False).alias("there")))
    by_document = Window.partitionBy("book_id", "document_id").orderBy(F.desc("there")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("known", F.max("there").over(by_document)).where("known AND NOT there AND document_id IS NOT NULL").select("book_id", "document_id", "node_id")


def diagnostics(b: BookTables) -> DataFrame:
    """(book_id, code, severity, subject): one row for each fault.

    Each table tells what it defines and needs; sorted by book, kind of key
    and key, definitions first, a running maximum tells what is missing and a
    running number what is repeated. No key is held: windows run over sorted
    rows. Tables that are dealt out by book already, in as many parts, are not
    shuffled again: their rows are fewer and narrower than what they say.
    """
    path = F.split_part("href", F.lit("#"), F.lit(1))
    outside = (path == "") | (F.col("origin") == "navigation") | F.contains(path, F.lit("://")) | F.startswith(path, F.lit("mailto:")) | F.startswith(path, F.lit("data:"))
    at = F.instr("href", "#")
    links = b.links.withColumns({"path": path, "name": F.when(at > 0, F.substring("href", at + 1, F.length("href"))), "inner": ~outside})
    name, node, href = F.col("name"), F.col("node_id"), F.col("href")
    said = (
        _claims(b.resources, _claim("resource", "resource_id", defines=True, place="position", code="RES-0001", subject=F.col("resource_id")), _claim("font", "resource_id", defines=True, when=F.col("kind") == "font")),
        _claims(b.fonts, _claim("font", "resource_id", code="FONT-0001", subject=F.col("family")), _claim("nothing", code="FONT-0002", subject=F.col("family"), when=is_blank(F.col("family")))),
        _claims(
            b.anchors,
            _claim("anchor", "document_id", "name", defines=True, place="position", code="ANCHOR-0001", subject=name),
            _claim("document", "document_id", code="ANCHOR-0002", place="position", subject=name),
            _claim("placed", "document_id", "node_id", code="ANCHOR-0003", subject=name),
            _claim("name", "name", defines=True),
        ),
        _claims(b.documents, _claim("document", "document_id", defines=True), _claim("href", "href", defines=True)),
        _claims(
            b.nodes,
            _claim("node", "node_id", defines=True, place="position", code="NODE-0001", subject=node),
            _claim("style", "style_id", code="STYLE-0001", subject=node),
            _claim("resource", "resource_id", code="RES-0002", subject=node, when=(F.col("kind") == "image") & F.col("resource_id").isNotNull()),
            _claim("resource", "resource_id", code="RES-0003", subject=node, when=(F.col("kind") == "svg") & F.col("resource_id").isNotNull()),
            _claim("nothing", code="LINK-0001", subject=node, when=F.col("kind").isin("link", "footnote") & (F.col("href") == "")),
        ),
        # a node stands where its document does
        _claims(_placed(b), _claim("placed", "document_id", "node_id", defines=True)),
        _claims(b.variants, _claim("style", "style_id", code="STYLE-0002", subject=F.concat_ws(":", "node_id", "target"))),
        _claims(b.styles, _claim("style", "style_id", defines=True)),
        _claims(
            links,
            _claim("href", "path", code="NAV-0001", subject=href, when=(F.col("origin") == "navigation") & (F.col("path") != "")),
            _claim("href", "path", code="EDGE-0001", subject=href, when=F.col("inner")),
            _claim("name", "name", code="EDGE-0002", subject=href, when=(F.col("origin") == "edge") & (name != "")),
        ),
    )
    every = said[0]
    for rows in said[1:]:
        every = every.unionByName(rows)
    # the hash leads the sort: rows that share a book differ in it at once
    by_key = Window.partitionBy("hash", "book_id", "space", "key").orderBy(F.desc("defines"), "place")
    met = every.withColumn("hash", F.xxhash64("book_id", "space", "key")).withColumns({"there": F.max(F.col("defines") & F.col("known")).over(by_key.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(by_key)})
    again = (F.col("n") > 1) | (F.col("space") == SPACES.index("resource")) & (F.col("subject") != F.col("place").cast("string"))
    fault = F.col("code").isNotNull() & F.when(F.col("defines"), again).otherwise(~F.col("there"))
    code = F.get(F.array(*[F.lit(c) for c in CODES]), F.col("code").cast("int"))
    return met.where(fault).select("book_id", code.alias("code"), F.when(code.isin(*WARNINGS), "warning").otherwise("error").alias("severity"), "subject")


def verdicts(books: DataFrame, found: DataFrame) -> DataFrame:
    """(book_id, n_errors, n_warnings, is_valid) of each book of ``books`` (book_id)."""
    counts = found.groupBy("book_id").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    zero = F.lit(0).cast("long")
    full = books.select("book_id").join(counts, "book_id", "left")
    return full.select("book_id", F.coalesce("n_errors", zero).alias("n_errors"), F.coalesce("n_warnings", zero).alias("n_warnings"), (F.coalesce("n_errors", zero) == 0).alias("is_valid"))
