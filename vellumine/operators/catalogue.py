"""The catalogue: books, their people, series, tags, identifiers and files.

Tables: books (id, title, sort_title, ...), people/series/tags (id, name),
book_people (book_id, person_id, position), book_series (book_id, series_id,
series_index), book_tags (book_id, tag_id), identifiers (book_id, scheme,
value), variants (id, book_id, root_id, path, ..., state, hash).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.text import ascii_lower


@dataclass
class Catalogue:
    books: DataFrame
    people: DataFrame
    book_people: DataFrame
    series: DataFrame
    book_series: DataFrame
    tags: DataFrame
    book_tags: DataFrame
    identifiers: DataFrame
    variants: DataFrame
    file_metadata: DataFrame
    roots: DataFrame


#: Rows that a page or an identifier lookup gives at most.
PAGE_LIMIT = 1000


def relations(c: Catalogue) -> DataFrame:
    """(book_id, kind, secondary, value): authors by position, series by index, tags and identifiers, in one list."""
    authors = c.book_people.join(c.people, c.book_people.person_id == c.people.id).select("book_id", F.lit("author").alias("kind"), F.col("position").cast("string").alias("secondary"), F.col("name").alias("value"))
    series = c.book_series.join(c.series, c.book_series.series_id == c.series.id).select("book_id", F.lit("series"), F.col("series_index").cast("string"), "name")
    tags = c.book_tags.join(c.tags, c.book_tags.tag_id == c.tags.id).select("book_id", F.lit("tag"), F.lit(None).cast("string"), "name")
    identifiers = c.identifiers.select("book_id", F.lit("identifier"), "scheme", "value")
    return authors.union(series).union(tags).union(identifiers)


#: Books whose relations one task puts beside their titles.
TASK_BOOKS = 50_000


def titled_relations(c: Catalogue, n_books: int) -> DataFrame:
    """``relations`` with ``title``, those of books that are there.

    ``n_books`` is about how many books there are: they are dealt out by that
    number, or else Spark puts as many together as its cores leave of them
    and a task sorts what grows with the catalogue.
    """
    parts = max(c.books.sparkSession.sparkContext.defaultParallelism, n_books // TASK_BOOKS)
    titles = c.books.select(F.col("id").alias("book_id"), "title")
    return relations(c).repartition(parts, "book_id").join(titles.repartition(parts, "book_id"), "book_id")


def page(books: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of the list by sort title (ASCII case aside) and id: a bounded top-k, never a full sort."""
    return books.orderBy(ascii_lower(F.col("sort_title")), "id").offset(offset).limit(min(limit, PAGE_LIMIT))


def page_after(books: DataFrame, title: str, book_id: int, limit: int) -> DataFrame:
    """The page after a row: deep pages cost what the first one does."""
    key = ascii_lower(F.col("sort_title"))
    after = (key > F.lit(title)) | ((key == F.lit(title)) & (F.col("id") > book_id))
    return books.where(after).orderBy(key, "id").limit(min(limit, PAGE_LIMIT))


def by_identifier(c: Catalogue, scheme: str, value: str, limit: int = PAGE_LIMIT) -> DataFrame:
    """Books with an identifier, by sort title in code-point order."""
    hits = c.identifiers.where((F.col("scheme") == scheme) & (F.col("value") == value)).select(F.col("book_id").alias("id")).distinct()
    return c.books.join(hits, "id").orderBy("sort_title", "id").limit(min(limit, PAGE_LIMIT))


def book(c: Catalogue, book_id: int) -> DataFrame:
    """A book by id; the condition reaches the scan."""
    return c.books.where(F.col("id") == book_id)


def file(c: Catalogue, file_id: int) -> DataFrame:
    """A file by id, with its inspected metadata, if any."""
    found, meta = c.variants.where(F.col("id") == file_id), c.file_metadata.where(F.col("file_id") == file_id)
    return found.join(meta, found.id == meta.file_id, "left").drop("file_id")


def files_of_root(c: Catalogue, root_id: int) -> DataFrame:
    """The files below a storage root that is there."""
    root = c.roots.where(F.col("id") == root_id).select(F.col("id").alias("root_id"))
    return c.variants.where(F.col("root_id") == root_id).join(root, "root_id", "left_semi")


def counted_page(books: DataFrame, offset: int, limit: int) -> DataFrame:
    """``page`` with ``n_books``, how many books there are in all."""
    return page(books, offset, limit).crossJoin(F.broadcast(books.agg(F.count("*").alias("n_books"))))  # one row


def ordered_relations(c: Catalogue, books: DataFrame) -> DataFrame:
    """(book_id, place, kind, secondary, value): the relations of ``books`` (id), by kind, then by position or index as text, then by value; null first."""
    own = relations(c).join(books.select(F.col("id").alias("book_id")), "book_id", "left_semi")
    # identifiers have no position here: their scheme is no part of the order
    shown = F.when(F.col("kind") == "identifier", None).otherwise(F.col("secondary"))
    by = Window.partitionBy("book_id").orderBy("kind", shown, "value")
    return own.withColumn("place", F.row_number().over(by) - 1)


def files_with_metadata(c: Catalogue) -> DataFrame:
    """Each file with its inspected metadata, if any."""
    meta = c.file_metadata
    return c.variants.join(meta, c.variants.id == meta.file_id, "left").drop("file_id")


def best_variant(variants: DataFrame) -> DataFrame:
    """Of each root and content hash the present file first, then the least id."""
    best = F.min(F.struct((F.col("state") != "present").alias("absent"), "id")).alias("best")
    return variants.groupBy("root_id", "hash").agg(best, F.count("*").alias("n_files")).select("root_id", "hash", F.col("best.id").alias("id"), (~F.col("best.absent")).alias("present"), "n_files")


def statistics(c: Catalogue) -> DataFrame:
    """One row: books, files, present and missing files, roots."""
    files = c.variants.agg(F.count("*").alias("n_files"), F.count_if(F.col("state") == "present").alias("n_present"), F.count_if(F.col("state") == "missing").alias("n_missing"))
    one = [x.withColumn("one", F.lit(1)) for x in (c.books.agg(F.count("*").alias("n_books")), files, c.roots.agg(F.count("*").alias("n_roots")))]
    return one[0].join(one[1], "one").join(one[2], "one").drop("one")


def search_documents(c: Catalogue) -> DataFrame:
    """(book_id, title, authors, series, tags, identifiers): each list joined by spaces in a fixed order.

    Every link table is aggregated before it is joined.
    """
    def listed(links: DataFrame, names: DataFrame, key: str, order: list, name: str) -> DataFrame:
        return links.join(names, links[key] == names["id"]).groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "name"))), lambda x: x["name"]), " ").alias(name))

    out = c.books.select(F.col("id").alias("book_id"), "title")
    for part in (
        listed(c.book_people, c.people, "person_id", ["position"], "authors"),
        listed(c.book_series, c.series, "series_id", [], "series"),
        listed(c.book_tags, c.tags, "tag_id", [], "tags"),
        c.identifiers.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "scheme", "value"))), " ").alias("identifiers")),
    ):
        out = out.join(part, "book_id", "left")
    return out.select("book_id", *[F.coalesce(x, F.lit("")).alias(x) for x in ("title", "authors", "series", "tags", "identifiers")])


def orphans(links: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """Links whose parent does not exist: the check before a write."""
    return links.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")


def with_new_names(dimension: DataFrame, names: DataFrame) -> DataFrame:
    """``dimension`` (id, name) with the names it lacks, ids going on from its largest.

    New ids are dense and follow from the names alone: names are numbered in
    blocks of their hash, not in one window over all rows. One writer at a
    time, as for any snapshot.
    """
    new = names.select("name").where("name IS NOT NULL").distinct().join(dimension, "name", "left_anti")
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    block = new.withColumn("block", F.substring(F.sha2("name", 256), 1, 2))
    sizes = block.groupBy("block").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))  # 256 rows at most
    place = F.row_number().over(Window.partitionBy("block").orderBy("name"))
    return dimension.select("id", "name").unionByName(block.join(F.broadcast(starts), "block").select((F.lit(top) + F.col("start") + place).cast("long").alias("id"), "name"))


def put_books(c: Catalogue, drafts: DataFrame) -> Catalogue:
    """The catalogue after books are created or updated, as new tables.

    ``drafts`` has book_id (one that is new creates a book), title,
    sort_title, authors (in order), series, series_index, tags and
    identifiers (array<struct<scheme, value>>). A draft replaces all links
    of its book; names that are not known yet are added once; repeated tags
    and identifiers of a book count once.
    """
    ids = drafts.select("book_id")

    def kept(links: DataFrame) -> DataFrame:
        return links.join(ids, "book_id", "left_anti")

    authors = drafts.select("book_id", F.posexplode("authors").alias("position", "name"))
    series = drafts.where("series IS NOT NULL").select("book_id", "series_index", F.col("series").alias("name"))
    tags = drafts.select("book_id", F.explode(F.array_distinct("tags")).alias("name"))
    people, all_series, all_tags = with_new_names(c.people, authors), with_new_names(c.series, series), with_new_names(c.tags, tags)

    def linked(rows: DataFrame, names: DataFrame, key: str, like: DataFrame) -> DataFrame:
        # a name that many drafts share meets the few that drafts have, not all that there are
        known = names.join(rows.select("name").distinct(), "name").withColumnRenamed("id", key)
        return rows.join(known, "name").select(*[F.col(x).cast(like.schema[x].dataType) for x in like.columns])

    books = c.books.join(ids.withColumnRenamed("book_id", "id"), "id", "left_anti").unionByName(drafts.select(F.col("book_id").alias("id"), "title", "sort_title"))
    identifiers = drafts.select("book_id", F.inline("identifiers")).select("book_id", "scheme", "value").distinct()
    return replace(
        c,
        books=books,
        people=people,
        series=all_series,
        tags=all_tags,
        book_people=kept(c.book_people).unionByName(linked(authors, people, "person_id", c.book_people)),
        book_series=kept(c.book_series).unionByName(linked(series, all_series, "series_id", c.book_series)),
        book_tags=kept(c.book_tags).unionByName(linked(tags, all_tags, "tag_id", c.book_tags)),
        identifiers=kept(c.identifiers).unionByName(identifiers),
    )


def synthetic_books(spark: SparkSession, n: int) -> DataFrame:
    """A catalogue of any size by rule: id, title, author, series, tag, identifier."""
    i = F.col("id")
    return spark.range(n).select(
        "id",
        F.format_string("Synthetic Book %07d", i).alias("title"),
        F.format_string("Author %d", i % 1000).alias("author"),
        F.format_string("Series %d", i % 100).alias("series"),
        F.format_string("tag-%d", i % 50).alias("tag"),
        F.format_string("book-%07d", i).alias("identifier"),
    )


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key, as a new snapshot."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def fingerprint(*fields: Column) -> Column:
    """SHA-256 of a canonical text of metadata fields; arrays count as sorted sets, null as nothing."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(f, F.lit("\x00")) for f in fields]), 256)


def changed_fields(old: str, new: str, fields: list[str]) -> Column:
    """The names of the fields in which two structs differ, nulls being equal to nulls."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{old}.{f}").eqNullSafe(F.col(f"{new}.{f}")), F.lit(f)) for f in fields]))
