"""Books of several HTML files: the order of their documents and the files that these refer to.

Three orders are merged by precedence: a manifest's, that of the links in the
index, that of the paths. Each gives a document a rank; what it leaves out
follows by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import lines, safe_path, utrim
from vellumine.operators import links, markup

#: Names of manifests at a book's root, and of index documents.
MANIFESTS, INDEXES = ("manifest.txt",), ("index.html", "index.htm")
#: Extensions of documents and of resources; fixed values.
DOCUMENTS = ("html", "htm", "xhtml")
RESOURCES = ("css", "jpg", "jpeg", "png", "gif", "webp", "svg", "woff", "woff2", "ttf", "otf", "mp3", "m4a")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_document(path: Column) -> Column:
    return extension(path).isin(*DOCUMENTS)


def manifest_entries(files: DataFrame, manifests: tuple = MANIFESTS, key: str = "book_id") -> DataFrame:
    """(key, line, name, reason) of each line that counts in a manifest: white space around it, blank lines and comments do not. ``reason`` says why a line is wrong."""
    listed = files.where(F.col("path").isin(*manifests)).select(key, F.posexplode(lines(F.coalesce("text", F.lit("")))).alias("line", "value"))
    listed = listed.select(key, (F.col("line") + 1).alias("line"), utrim(F.col("value")).alias("value")).where("value <> '' AND NOT startswith(value, '#')")
    named = listed.withColumn("name", safe_path(F.col("value")))
    there = files.where(is_document(F.col("path"))).select(key, F.col("path").alias("name")).distinct().withColumn("there", F.lit(True))
    again = F.row_number().over(Window.partitionBy(key, "name").orderBy("line")) > 1
    reason = F.when(F.col("name").isNull(), "unsafe_path").when(~is_document(F.col("name")), "not_a_document").when(F.col("there").isNull(), "missing_document").when(again, "duplicate_document")
    return named.join(there, [key, "name"], "left").select(key, "line", "name", reason.alias("reason"))


def ordered_documents(files: DataFrame, manifests: tuple = MANIFESTS, key: str = "book_id") -> tuple[DataFrame, DataFrame]:
    """Documents (key, path, place) in their order, and (key, order, error): which order it is, or why there is none.

    ``files`` has (key, path, text). ``order`` is manifest,
    manifest_incomplete, index_links, paths or single; what an index does
    not link follows by path. A book
    with more than one manifest, or with a wrong or empty one, has an error
    and no documents; of several wrong lines the first counts.
    """
    docs = files.where(is_document(F.col("path"))).select(key, "path", "text")
    entries = manifest_entries(files, manifests, key)
    wrong = entries.where("reason IS NOT NULL").groupBy(key).agg(F.min_by(F.concat_ws(":", "reason", "line"), "line").alias("wrong"))
    books = files.groupBy(key).agg(F.count_if(F.col("path").isin(*manifests)).alias("n_manifests"), F.count_if(is_document(F.col("path"))).alias("n_docs"))
    listed = entries.groupBy(key).agg(F.count("*").alias("n_listed"))
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    index = docs.where(name.isin(*INDEXES)).groupBy(key).agg(F.min("path").alias("index"), F.min_by("text", "path").alias("text"))
    hrefs = index.select(key, "index", F.posexplode(markup.attributes(F.col("text"), "href")).alias("n", "href")).where(~links.is_external(F.col("href")))
    target = links.normal_path(F.concat_ws("/", F.nullif(F.regexp_extract("index", "^(.*)/[^/]*$", 1), F.lit("")), F.split_part("href", F.lit("?"), F.lit(1))))
    linked = hrefs.select(key, target.alias("path"), "n").where(F.col("path").isNotNull()).groupBy(key, "path").agg(F.min("n").alias("linked"))
    told = books.join(listed, key, "left").join(wrong, key, "left").join(index.select(key, "index"), key, "left")
    error = F.when(F.col("n_manifests") > 1, "several_manifests").when(F.col("wrong").isNotNull(), F.col("wrong")).when((F.col("n_manifests") == 1) & F.col("n_listed").isNull(), "empty_manifest")
    told = told.withColumn("error", error)
    ranked = docs.select(key, "path").distinct().join(told.where("error IS NULL").select(key, "n_manifests", "index"), key)
    ranked = ranked.join(entries.select(key, F.col("name").alias("path"), F.col("line").alias("listed")), [key, "path"], "left").join(linked, [key, "path"], "left")
    by_index = F.when(F.col("path") == F.col("index"), -1).otherwise(F.col("linked"))
    rank = F.when(F.col("n_manifests") == 1, F.col("listed")).otherwise(by_index)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("rank").asc_nulls_last(), "path")) - 1
    placed = ranked.withColumn("rank", rank).withColumn("place", place)
    order = (
        F.when(F.col("error").isNotNull(), None)
        .when((F.col("n_manifests") == 1) & (F.col("n_listed") < F.col("n_docs")), "manifest_incomplete")
        .when(F.col("n_manifests") == 1, "manifest")
        .when(F.col("n_docs") < 2, "single")
        .when(F.col("index").isNull(), "paths")
        .otherwise("index_links")
    )
    return placed.select(key, "path", "place"), told.select(key, order.alias("order"), "error")


def resources(files: DataFrame, documents: DataFrame, key: str = "book_id", whole: bool = True) -> tuple[DataFrame, DataFrame]:
    """Resources (key, path, referenced) of the books, and what was not taken (key, reason, subject).

    Documents refer by ``src`` and by ``url()``; remote and inline references
    are told and left, local ones that are not there too. ``whole``: the
    resource files that no document refers to are taken as well.
    """
    text = documents.join(files.select(key, "path", "text"), [key, "path"])
    values = F.array_distinct(F.concat(markup.attributes(F.col("text"), "src"), markup.css_urls(F.col("text"))))
    asked = text.select(key, "path", F.explode(values).alias("value")).where(~F.startswith("value", F.lit("#")))
    remote = markup.is_remote(F.col("value"))
    local = links.normal_path(F.concat_ws("/", F.nullif(F.regexp_extract("path", "^(.*)/[^/]*$", 1), F.lit("")), F.split_part("value", F.lit("?"), F.lit(1))))
    wanted = asked.where(~remote).select(key, local.alias("path")).where(extension(F.col("path")).isin(*RESOURCES)).distinct()
    there = files.where(extension(F.col("path")).isin(*RESOURCES)).select(key, "path").distinct()
    found = there.join(wanted.withColumn("referenced", F.lit(True)), [key, "path"], "left" if whole else "inner").withColumn("referenced", F.coalesce("referenced", F.lit(False)))
    missing = wanted.join(there, [key, "path"], "left_anti").select(key, F.lit("not_found").alias("reason"), F.col("path").alias("subject"))
    return found, asked.where(remote).select(key, F.lit("remote").alias("reason"), F.col("value").alias("subject")).distinct().unionByName(missing)
