"""Registered queries: the catalogue over the order tables, search, changes.

A book is an order, its author the customer, its series the customer's nation,
its tags the parts' brands, its identifiers the order keys, its files the
line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.operators import catalogue as C
from vellumine.operators import changes, search
from vellumine.plans.text import read


def tables(spark: SparkSession, sf_dir: str) -> C.Catalogue:
    orders, customer, nation, part, line = (read(spark, sf_dir, t) for t in ("orders", "customer", "nation", "part", "lineitem"))
    key = F.col("o_orderkey").alias("book_id")
    title = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "the ").otherwise("The "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey") % 997)
    tags = part.select(F.col("p_brand").alias("name")).distinct().select(F.xxhash64("name").alias("id"), "name")
    tagged = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_orderkey").alias("book_id"), F.xxhash64("p_brand").alias("tag_id")).distinct()
    file_id = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    return C.Catalogue(
        orders.select(F.col("o_orderkey").alias("id"), title.alias("title"), title.alias("sort_title")),
        customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        orders.select(key, F.col("o_custkey").alias("person_id"), F.lit(0).alias("position")),
        nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        orders.join(customer, orders.o_custkey == customer.c_custkey).select(key, F.col("c_nationkey").alias("series_id"), (F.col("o_orderkey") % 7).alias("series_index")),
        tags,
        tagged,
        orders.select(key, F.lit("order").alias("scheme"), (F.col("o_orderkey") % 500).cast("string").alias("value")),
        line.select(
            file_id.alias("id"), F.col("l_orderkey").alias("book_id"), F.col("l_suppkey").alias("root_id"), F.concat_ws("/", "l_returnflag", file_id).alias("path"),
            F.when(F.col("l_returnflag") == "R", "missing").otherwise("present").alias("state"), (F.col("l_partkey") % 50).alias("hash"),
        ),
        line.where("l_linenumber % 2 = 0").groupBy(file_id.alias("file_id")).agg(F.min(F.col("l_quantity").cast("long")).alias("pages")),
        read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")),
    )


_TITLE = "(CASE WHEN o_orderkey % 2 = 0 THEN 'the ' ELSE 'The ' END || o_orderpriority || ' ' || (o_orderkey % 997))"
_FILE = "(l_orderkey * 10 + l_linenumber)"


def book_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.relations(tables(spark, sf_dir))


BOOK_RELATIONS = """SELECT o_orderkey AS book_id, 'author' AS kind, '0' AS secondary, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT o_orderkey, 'series', (o_orderkey % 7)::VARCHAR, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT DISTINCT l_orderkey, 'tag', NULL, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT o_orderkey, 'identifier', 'order', (o_orderkey % 500)::VARCHAR FROM orders"""


def book_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page(tables(spark, sf_dir).books, 200, 50).select("id", "title")


BOOK_PAGE = f"SELECT o_orderkey AS id, {_TITLE} AS title FROM orders ORDER BY lower({_TITLE}), o_orderkey LIMIT 50 OFFSET 200"


def books_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_identifier(tables(spark, sf_dir), "order", "42").select("id", "title")


BOOKS_BY_IDENTIFIER = f"SELECT o_orderkey AS id, {_TITLE} AS title FROM orders WHERE o_orderkey % 500 = 42 ORDER BY {_TITLE}, o_orderkey LIMIT 1000"


def book_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book, a file with its metadata and the files of a root, by their ids."""
    c = tables(spark, sf_dir)
    found = C.book(c, 33).select(F.lit("book").alias("what"), "id", F.col("title").alias("text"), F.lit(None).cast("long").alias("pages"))
    files = C.files_of_root(c, 7).select(F.lit("root"), "id", "path", F.lit(None).cast("long"))
    return found.union(C.file(c, 332).select(F.lit("file"), "id", "path", "pages")).union(C.file(c, 333).select(F.lit("file"), "id", "path", "pages")).union(files)


BOOK_LOOKUPS = f"""WITH m AS (SELECT {_FILE} AS id, min(l_quantity::BIGINT) AS pages FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), f AS (SELECT {_FILE} AS id, l_suppkey AS root, l_returnflag || '/' || {_FILE} AS path FROM lineitem)
SELECT 'book' AS what, o_orderkey AS id, {_TITLE} AS text, NULL::BIGINT AS pages FROM orders WHERE o_orderkey = 33 UNION ALL SELECT 'file', f.id, path, pages FROM f LEFT JOIN m USING (id) WHERE f.id IN (332, 333) UNION ALL SELECT 'root', id, path, NULL FROM f WHERE root = 7"""


def counted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the list with the number of all books."""
    return C.counted_page(tables(spark, sf_dir).books, 10, 25).select("id", "title", "n_books")


COUNTED_PAGE = f"SELECT o_orderkey AS id, {_TITLE} AS title, (SELECT count(*) FROM orders) AS n_books FROM orders ORDER BY lower({_TITLE}), o_orderkey LIMIT 25 OFFSET 10"


def ordered_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relations of all books in their order."""
    c = tables(spark, sf_dir)
    return C.ordered_relations(c, c.books).select("book_id", F.col("place").cast("long").alias("place"), "kind", "secondary", "value")


ORDERED_RELATIONS = f"""SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY kind, CASE WHEN kind <> 'identifier' THEN secondary END NULLS FIRST, value) - 1 AS place, kind, secondary, value FROM ({BOOK_RELATIONS})"""


def files_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.files_with_metadata(tables(spark, sf_dir)).select("id", "book_id", "path", "state", "pages")


FILES_WITH_METADATA = f"""SELECT {_FILE} AS id, l_orderkey AS book_id, l_returnflag || '/' || {_FILE} AS path, CASE WHEN l_returnflag = 'R' THEN 'missing' ELSE 'present' END AS state,
pages FROM lineitem LEFT JOIN (SELECT {_FILE} AS f, min(l_quantity::BIGINT) AS pages FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1) ON f = {_FILE}"""


def best_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_variant(tables(spark, sf_dir).variants)


BEST_VARIANTS = f"""SELECT l_suppkey AS root_id, l_partkey % 50 AS hash, arg_min({_FILE}, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, {_FILE})) AS id,
bool_or(l_returnflag <> 'R') AS present, count(*) AS n_files FROM lineitem GROUP BY ALL"""


def library_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.statistics(tables(spark, sf_dir))


LIBRARY_STATISTICS = """SELECT (SELECT count(*) FROM orders) AS n_books, count(*) AS n_files, count(*) FILTER (WHERE l_returnflag <> 'R') AS n_present,
count(*) FILTER (WHERE l_returnflag = 'R') AS n_missing, (SELECT count(*) FROM supplier) AS n_roots FROM lineitem"""


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.search_documents(tables(spark, sf_dir))


SEARCH_DOCUMENTS = f"""SELECT o_orderkey AS book_id, {_TITLE} AS title, coalesce(c_name, '') AS authors, coalesce(n_name, '') AS series, coalesce(tags, '') AS tags, 'order:' || (o_orderkey % 500) AS identifiers
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT p_brand, ' ' ORDER BY p_brand) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) ON l_orderkey = o_orderkey"""


def file_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without a book, once every seventh order is gone."""
    c = tables(spark, sf_dir)
    return C.orphans(c.variants, "book_id", c.books.where("id % 7 <> 0")).select("id", "book_id")


FILE_ORPHANS = f"SELECT {_FILE} AS id, l_orderkey AS book_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0)"


def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and changed fields of customers against an edited copy."""
    c = read(spark, sf_dir, "customer")
    old = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))
    new = F.struct(
        F.when(F.col("c_custkey") % 5 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"),
        F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.col("c_mktsegment")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
    )
    both = c.select("c_custkey", old.alias("old"), new.alias("new"))
    fields = ["name", "segment", "nation"]
    prints = {s: C.fingerprint(*[F.col(f"{s}.{f}") for f in fields]) for s in ("old", "new")}
    return both.select("c_custkey", prints["old"].alias("old_print"), F.array_join(C.changed_fields("old", "new", fields), ",").alias("changed"), F.when(prints["old"] == prints["new"], "synced").otherwise("different").alias("status"))


METADATA_CHANGES = r"""WITH e AS (SELECT c_custkey, c_name AS n0, c_mktsegment AS s0, c_nationkey::VARCHAR AS k, CASE WHEN c_custkey % 5 = 0 THEN c_name || '!' ELSE c_name END AS n1,
CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS s1 FROM customer)
SELECT c_custkey, sha256(concat_ws(chr(31), n0, s0, k)) AS old_print, concat_ws(',', CASE WHEN n0 IS DISTINCT FROM n1 THEN 'name' END, CASE WHEN s0 IS DISTINCT FROM s1 THEN 'segment' END) AS changed,
CASE WHEN n0 IS DISTINCT FROM n1 OR s0 IS DISTINCT FROM s1 THEN 'different' ELSE 'synced' END AS status FROM e"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files before and after: moved, edited (some to another file's content), gone, copied and unreadable ones."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.col("n_chars").alias("size"))
    k, zero = F.col("doc_id"), F.lit(0).cast("long")
    path = F.concat(F.lit("lib/"), k, F.lit(".txt"))
    state = F.when(k % 13 == 0, "missing").when(k % 17 == 0, "error").otherwise("present")
    old = docs.where("doc_id % 10 <> 9").select(k.alias("id"), path.alias("path"), "size", zero.alias("mtime"), "hash", state.alias("state"))
    moved = F.when(k % 10 == 3, F.concat(F.lit("moved/"), k, F.lit(".txt"))).otherwise(path)
    edited = F.when(k % 10 == 5, F.sha2(F.concat((k % 20).cast("string"), F.lit("x")), 256)).otherwise(F.col("hash"))
    new = docs.where("doc_id % 10 <> 7").select(moved.alias("path"), "size", F.when(k % 10 == 5, 1).otherwise(0).cast("long").alias("mtime"), edited.alias("hash"), (k % 11 != 0).alias("ok"))
    copies = docs.where("doc_id % 50 = 1").select(F.concat(F.lit("copy/"), k, F.lit(".txt")), "size", zero, "hash", F.lit(True))
    same = docs.where("doc_id % 50 = 5").select(F.concat(F.lit("same/"), k, F.lit(".txt")), "size", zero, F.sha2(F.lit("5x"), 256), F.lit(True))
    return old, new.union(copies).union(same)


def scan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of two snapshots with what became of it."""
    return changes.classify(*_snapshots(spark, sf_dir))


_SNAPSHOTS = """d AS (SELECT doc_id, sha256(text) AS hash, n_chars AS size FROM documents),
o AS (SELECT doc_id AS id, 'lib/' || doc_id || '.txt' AS path, size, 0 AS mtime, hash, CASE WHEN doc_id % 13 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'error' ELSE 'present' END AS state FROM d WHERE doc_id % 10 <> 9),
n AS (SELECT CASE WHEN doc_id % 10 = 3 THEN 'moved/' ELSE 'lib/' END || doc_id || '.txt' AS path, size, CASE WHEN doc_id % 10 = 5 THEN 1 ELSE 0 END AS mtime,
  CASE WHEN doc_id % 10 = 5 THEN sha256((doc_id % 20) || 'x') ELSE hash END AS hash, doc_id % 11 <> 0 AS ok FROM d WHERE doc_id % 10 <> 7
  UNION ALL SELECT 'copy/' || doc_id || '.txt', size, 0, hash, true FROM d WHERE doc_id % 50 = 1
  UNION ALL SELECT 'same/' || doc_id || '.txt', size, 0, sha256('5x'), true FROM d WHERE doc_id % 50 = 5),
f AS (SELECT n.*, o.id, o.hash AS old_hash, CASE WHEN o.id IS NULL THEN CASE WHEN ok THEN 'unknown' ELSE 'failed' END
  WHEN o.state = 'present' AND o.size = n.size AND o.mtime = n.mtime THEN 'unchanged' WHEN ok THEN 'modified' ELSE 'failed' END AS action FROM n LEFT JOIN o USING (path)),
files AS (SELECT CASE WHEN action = 'unchanged' THEN old_hash ELSE hash END AS hash, id, path, action = 'failed' AS absent, false AS gone FROM f WHERE id IS NOT NULL
  UNION ALL SELECT hash, id, path, state <> 'present', true FROM o WHERE path NOT IN (SELECT path FROM n)),
best AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY hash ORDER BY absent, id) = 1),
fresh AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY path) AS k FROM f WHERE action = 'unknown'),
put AS (SELECT fresh.path, CASE WHEN best.id IS NULL AND k = 1 THEN 'new' WHEN gone AND k = 1 THEN 'moved' ELSE 'duplicate' END AS action, CASE WHEN gone AND k = 1 THEN best.path END AS old_path, CASE WHEN gone AND k = 1 THEN best.id END AS id FROM fresh LEFT JOIN best USING (hash)),
acts AS (SELECT path, action, old_path, id FROM put UNION ALL SELECT path, action, NULL, id FROM f WHERE action <> 'unknown'
UNION ALL SELECT path, 'missing', NULL, id FROM o WHERE path NOT IN (SELECT path FROM n) AND path NOT IN (SELECT old_path FROM put WHERE old_path IS NOT NULL) AND state <> 'missing')"""
SCAN_CHANGES = f"WITH {_SNAPSHOTS} SELECT path, action, old_path, id FROM acts"


def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' table after the scan."""
    return changes.next_snapshot(*_snapshots(spark, sf_dir))


SCAN_SNAPSHOT = f"""WITH {_SNAPSHOTS}, there AS (SELECT a.id, n.path, n.size, n.mtime, CASE WHEN action = 'unchanged' THEN o.hash ELSE n.hash END AS hash,
CASE action WHEN 'failed' THEN 'error' WHEN 'duplicate' THEN 'duplicate' ELSE 'present' END AS state FROM acts a JOIN n USING (path) LEFT JOIN o ON a.id = o.id WHERE action <> 'missing' AND NOT (action = 'failed' AND a.id IS NULL))
SELECT id, path, size, mtime::BIGINT AS mtime, hash, state FROM there UNION ALL SELECT id, path, size, mtime, hash, 'missing' FROM o WHERE id NOT IN (SELECT id FROM there WHERE id IS NOT NULL)"""


def scan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.report(scan_changes(spark, sf_dir))


SCAN_REPORT = f"WITH {_SNAPSHOTS} SELECT action, count(*) AS n FROM acts GROUP BY action"


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of a two-term query over documents."""
    return search.bm25(read(spark, sf_dir, "documents"), ["the", "that"]).withColumn("score", F.round("score", 6))


TEXT_SEARCH = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
l AS (SELECT d.doc_id, count(w) AS n FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1), s AS (SELECT count(*) AS docs, avg(n) AS mean FROM l),
f AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w IN ('the', 'that') GROUP BY ALL), i AS (SELECT w, ln((docs - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM f, s GROUP BY w, docs)
SELECT doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM f JOIN i USING (w) JOIN l USING (doc_id), s GROUP BY doc_id"""


def phrase_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a phrase."""
    return search.phrase(read(spark, sf_dir, "documents"), "of the").select("doc_id", F.col("n_hits").cast("long").alias("n_hits"))


PHRASE_SEARCH = """WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents)
SELECT doc_id, n_hits FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS n_hits FROM t) WHERE n_hits > 0"""


def catalogue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the books that hold a phrase in any field, best rank first, then by id."""
    c = tables(spark, sf_dir)
    found = search.ranked_phrase(C.search_documents(c).withColumn("book_id", F.col("book_id").cast("string")), "1-Urgent", ["title", "authors", "series", "tags", "identifiers"])
    hits = found.withColumn("rank", F.round("rank", 9)).join(c.books, found["book_id"].cast("long") == c.books["id"])
    return hits.orderBy("rank", "id").offset(20).limit(200).select("id", "title", "rank")


CATALOGUE_SEARCH = f"""WITH s AS ({SEARCH_DOCUMENTS}), u AS (SELECT book_id, unnest([title, authors, series, tags, identifiers]) AS x FROM s),
t AS (SELECT book_id, regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}]+') AS w FROM u),
c AS (SELECT book_id, sum(len(w)) AS d, sum(len(list_filter(range(1, len(w)), lambda i: w[i] = '1' AND w[i + 1] = 'urgent'))) AS f FROM t GROUP BY book_id),
m AS (SELECT count(*) AS n, count(*) FILTER (WHERE f > 0) AS hit, avg(d) AS mean FROM c)
SELECT book_id AS id, title, round(-greatest(ln((n - hit + 0.5) / (hit + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean)), 9) AS rank FROM c JOIN s USING (book_id), m WHERE f > 0 ORDER BY rank, id LIMIT 200 OFFSET 20"""


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh order edited, and a new book for every hundredth."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    edited = o.where("o_orderkey % 7 = 0 OR o_orderkey % 100 = 1").withColumn("book_id", F.when(k % 7 == 0, k).otherwise(k + 100_000_000))
    pair = lambda a, b: F.struct(F.lit(a).alias("scheme"), b.alias("value"))
    return edited.select(
        "book_id",
        F.concat(F.lit("Edited "), k).alias("title"),
        F.concat(F.lit("edited "), k).alias("sort_title"),
        F.array(F.concat(F.lit("New Author "), k % 11), F.lit("Second Hand")).alias("authors"),
        F.when(k % 2 == 0, F.concat(F.lit("Series "), k % 5)).alias("series"),
        (k % 9).alias("series_index"),
        F.array(F.lit("edited"), F.lit("edited"), F.concat(F.lit("t"), k % 3)).alias("tags"),
        F.array(pair("isbn", k.cast("string")), pair("isbn", k.cast("string")), pair("order", (k % 500).cast("string"))).alias("identifiers"),
    )


def catalogue_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All relations of all books once the drafts are written."""
    before = tables(spark, sf_dir)
    return C.titled_relations(C.put_books(before, _drafts(spark, sf_dir)), before.books.count())


CATALOGUE_AFTER_WRITES = f"""WITH e AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE o_orderkey + 100000000 END AS book_id, o_orderkey AS k FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 100 = 1),
r AS (SELECT * FROM ({BOOK_RELATIONS}) WHERE book_id % 7 <> 0 UNION ALL SELECT book_id, 'author', '0', 'New Author ' || (k % 11) FROM e UNION ALL SELECT book_id, 'author', '1', 'Second Hand' FROM e
  UNION ALL SELECT book_id, 'series', (k % 9)::VARCHAR, 'Series ' || (k % 5) FROM e WHERE k % 2 = 0 UNION ALL SELECT book_id, 'tag', NULL, unnest(['edited', 't' || (k % 3)]) FROM e
  UNION ALL SELECT book_id, 'identifier', 'isbn', k::VARCHAR FROM e UNION ALL SELECT book_id, 'identifier', 'order', (k % 500)::VARCHAR FROM e),
b AS (SELECT book_id, 'Edited ' || k AS title FROM e UNION ALL SELECT o_orderkey, {_TITLE} FROM orders WHERE o_orderkey % 7 <> 0)
SELECT book_id, kind, secondary, value, title FROM r JOIN b USING (book_id)"""


_ALL = (book_relations, book_page, book_lookups, counted_page, ordered_relations, books_by_identifier, files_with_metadata, best_variants, library_statistics, search_documents, catalogue_search, catalogue_after_writes, file_orphans, metadata_changes, scan_changes, scan_snapshot, scan_report, text_search, phrase_search)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES}
