"""References between documents: what a link names, and where navigation leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.functions.text import let, utrim


def is_external(href: Column) -> Column:
    """Whether a reference leaves the book: ``//`` or a scheme in front."""
    return F.startswith(href, F.lit("//")) | href.rlike("^[A-Za-z0-9+.-]+:")


def normal_path(path: Column) -> Column:
    """A path with percent signs decoded, ``.`` and ``..`` resolved; null if it is empty, climbs out or is coded wrongly."""
    plain = F.try_url_decode(F.replace(F.split_part(path, F.lit("#"), F.lit(1)), F.lit("+"), F.lit("%2B")))
    parts = F.filter(F.split(F.replace(plain, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    none = F.lit(None).cast("array<string>")

    def step(done: Column, p: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(none)
        return F.when(done.isNull(), none).when(p == "..", up).otherwise(F.concat(done, F.array(p)))

    return let(F.aggregate(parts, F.array().cast("array<string>"), step), lambda done: F.when(F.size(done) > 0, F.array_join(done, "/")))


def resolved(document: Column, href: Column) -> Column:
    """The target of a link in a document, with its fragment; external ones as they are, null if the path is bad."""
    folder = F.regexp_extract(document, "^(.*)/[^/]*$", 1)
    at = F.instr(href, "#")
    path = F.when(at > 0, F.substring(href, F.lit(1), at - 1)).otherwise(href)
    fragment = F.when(at > 0, F.substring(href, at + 1, F.length(href))).otherwise("")
    full = F.when(path == "", document).otherwise(normal_path(F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))))
    return F.when(is_external(href), href).when(fragment == "", full).otherwise(F.concat(full, F.lit("#"), fragment))


def navigation_targets(points: DataFrame, documents: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """``points`` (book_id, href, ...) with document_id, node_id and, where the target is not found, ``reason``.

    ``documents`` has (book_id, document_id, href), ``anchors`` (book_id,
    document_id, name, node_id), ``nodes`` (book_id, document_id, node_id).
    Only an anchor whose node exists counts. A target that is there more than
    once is ambiguous, never a guess.
    """
    href = utrim(F.coalesce("href", F.lit("")))
    at = F.instr(href, "#")
    path = F.when(at > 0, F.substring(href, F.lit(1), at - 1)).otherwise(href)
    name = F.when(at > 0, F.substring(href, at + 1, F.length(href))).otherwise("")
    cut = points.withColumns({"vq_href": href, "vq_path": path, "vq_name": name})
    docs = documents.groupBy("book_id", F.col("href").alias("vq_path")).agg(F.min("document_id").alias("document_id"), F.count("*").alias("vq_docs"))
    real = anchors.join(nodes.select("book_id", "document_id", "node_id").distinct(), ["book_id", "document_id", "node_id"], "left_semi")
    marks = real.groupBy("book_id", "document_id", F.col("name").alias("vq_name")).agg(F.min("node_id").alias("node_id"), F.count("*").alias("vq_marks"))
    met = cut.join(docs, ["book_id", "vq_path"], "left").join(marks, ["book_id", "document_id", "vq_name"], "left")
    reason = (
        F.when(F.col("vq_href") == "", "empty_target")
        .when(is_external(F.col("vq_href")), "external_target")
        .when(F.col("vq_path") == "", "missing_document_context")
        .when(F.col("vq_docs").isNull(), "document_not_found")
        .when(F.col("vq_docs") > 1, "ambiguous_document")
        .when(F.col("vq_name") == "", None)
        .when(F.col("vq_marks").isNull(), "anchor_not_found")
        .when(F.col("vq_marks") > 1, "ambiguous_anchor")
    )
    told = met.withColumn("reason", reason)
    found = F.col("reason").isNull()
    return told.select(*points.columns, F.when(found, F.col("document_id")).alias("document_id"), F.when(found & (F.col("vq_name") != ""), F.col("node_id")).alias("node_id"), "reason")
