"""Registered queries: markup, compatibility, reading order, linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions import text as T
from vellumine.operators import compat, linkage, markup, reader
from vellumine.plans.text import read


def page_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, title, links and remote references of each page."""
    pages = read(spark, sf_dir, "pages")
    links = markup.attributes(F.col("html"), "href")
    return pages.select("page_id", markup.head(F.col("html")).alias("h"), F.size(links).cast("long").alias("n_links"), F.size(F.filter(links, markup.is_remote)).cast("long").alias("n_remote"), F.contains(F.lower("html"), F.lit("<script")).alias("has_script")).select("page_id", "h.lang", "h.title", "n_links", "n_remote", "has_script")


PAGE_HEADS = r"""WITH p AS (SELECT *, regexp_extract_all(html, '(?i)(?:^|[\s"''])href\s*=\s*["'']([^"'']*)["'']', 1) AS links FROM pages)
SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<html[^>]*?\blang\s*=\s*["'']([^"'']*)["'']', 1)), '') AS lang, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title,
len(links) AS n_links, len(list_filter(links, lambda u: contains(u, '://') OR starts_with(u, '//') OR starts_with(u, 'data:'))) AS n_remote, contains(lower(html), '<script') AS has_script FROM p"""


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.tag_counts(read(spark, sf_dir, "pages"))


TAG_COUNTS = "SELECT tag, count(*) AS n_tags, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag"


_SCRIPTLESS = r"regexp_replace(regexp_replace(html, '(?is)(<script[^>]*>).*?</script>', '\1', 'g'), '(?s)<!--.*?-->', '', 'g')"


def page_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the pages by role and confidence, with some of each kind of mark added."""
    k = F.col("page_id")
    more = F.when(k % 2 == 0, '<section epub:type="x Chapter"><p epub:type="poem">v</p><p class="a separator">*</p><aside role="note" epub:type="FootNote">f</aside><figure></figure></section>').otherwise("")
    made = markup.semantic(markup.nodes(read(spark, sf_dir, "pages").withColumn("html", F.concat("html", more))))
    return made.groupBy("page_id", "role", "confidence").agg(F.count("*").alias("n"))


_ROLES = " ".join(f"WHEN tag IN ({', '.join(repr(t) for t in tags)}) THEN '{role}'" for role, tags in markup.ROLES.items())
PAGE_ROLES = f"""WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower({_SCRIPTLESS}), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages),
r AS (SELECT page_id, CASE {_ROLES} ELSE 'Generic' END AS role, CASE WHEN regexp_matches(tag, '^(h[1-6]|p|figure)$') THEN 'Explicit' ELSE 'StronglyInferred' END AS confidence FROM t
UNION ALL SELECT page_id, unnest(['Chapter', 'Poetry', 'SceneBreak', 'Footnote', 'Figure']), 'Explicit' FROM pages WHERE page_id % 2 = 0)
SELECT page_id, role, confidence, count(*) AS n FROM r GROUP BY ALL"""


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First heading of each page, from its tree."""
    return markup.first_heading(markup.nodes(read(spark, sf_dir, "pages")))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of each page, from its tree."""
    return markup.text_of(markup.nodes(read(spark, sf_dir, "pages")))


def _plain(html: str) -> str:
    """SQL for markup as text: tags out, the pages' entities decoded, white space collapsed."""
    for entity, text in (("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        html = f"replace({html}, '{entity}', '{text}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


_BARE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '<x>', 'g'), '(?is)<style[^>]*>.*?</style>', '<x>', 'g'), '(?s)<!--.*?-->', '<x>', 'g')"
PAGE_TITLES = rf"""SELECT page_id, {_plain("regexp_replace(regexp_extract(html, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), '<[^>]*>', ' ', 'g')")} AS title FROM pages WHERE regexp_matches(html, '(?i)<h[1-6][\s>]')"""
PAGE_TEXT = f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex({_BARE}, '<[^>]*>'), lambda x: {_plain("x")}), lambda x: x <> ''), ' ') AS text FROM pages"""


def page_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the pages, to some of which links without a target and repeated anchors are added."""
    k, mark = F.col("page_id"), F.col("page_id").cast("string")
    link = F.when(k % 3 == 0, F.concat(F.lit('<a href="#gone'), mark, F.lit('">x</a>'))).otherwise(F.concat(F.lit('<a href="#there'), mark, F.lit('">x</a>')))
    anchors = F.concat(F.lit('<p id="there'), mark, F.lit('">y</p>'))
    again = F.when(k % 5 == 0, anchors).otherwise("")
    pages = read(spark, sf_dir, "pages").withColumn("html", F.concat("html", link, anchors, again))
    return markup.integrity(markup.nodes(pages))


PAGE_INTEGRITY = """SELECT page_id, 'LINK-DANGLING' AS code, 'gone' || page_id AS subject FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id, 'ANCHOR-REPEATED', 'there' || page_id FROM pages WHERE page_id % 5 = 0"""


def compatibility_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compat.plan(compat.requests(read(spark, sf_dir, "pages")), "strict")
    return made.withColumn("worst", F.col("worst").cast("long"))


_TAGS = " ".join(f"WHEN '{t}' THEN '{f}'" for t, f in compat.TAG_FEATURES.items())
_MATRIX = ", ".join(f"('{f}', '{fmt}', '{row[i]}')" for f, row in compat.LEVELS.items() for i, fmt in enumerate(compat.FORMATS))
_COUNTS = ", ".join(f"sum(CASE WHEN rank = {i} THEN n ELSE 0 END)::BIGINT AS n_{name.lower()}" for i, name in enumerate(compat.OUTCOMES))
COMPATIBILITY_PLAN = f"""WITH r AS (SELECT page_id, CASE tag {_TAGS} END AS feature, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY ALL HAVING feature IS NOT NULL),
m AS (SELECT * FROM (VALUES {_MATRIX}) AS t(feature, format, level)),
i AS (SELECT page_id, format, n, CASE level WHEN 'Native' THEN 0 WHEN 'Compatible' THEN 1 WHEN 'Approximate' THEN 2 WHEN 'Flattenable' THEN 3 ELSE 4 END AS rank FROM r JOIN m USING (feature))
SELECT page_id, format, sum(n)::BIGINT AS n_items, max(rank)::BIGINT AS worst, {_COUNTS}, ['Exact', 'High', 'Compatible', 'Reduced', 'SevereLoss'][max(rank) + 1] AS overall, max(rank) > 1 AS blocked FROM i GROUP BY page_id, format"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reader.neighbours(read(spark, sf_dir, "conversations"), "conv_id", "turn", "turn")
    return made.withColumn("index", F.col("index").cast("long"))


READING_ORDER = """SELECT conv_id, turn, row_number() OVER w - 1 AS index, lag(turn) OVER w AS previous, lead(turn) OVER w AS next, min(turn) OVER (PARTITION BY conv_id) AS first, max(turn) OVER (PARTITION BY conv_id) AS last
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"""


def page_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads over conversations as books; every ninth turn stands alone."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.lit(None).cast("string").alias("side"), (F.col("turn") % 9 == 8).alias("single"))
    return reader.spreads(turns, "conv_id", "turn", "side", "single")


PAGE_SPREADS = """WITH t AS (SELECT conv_id, turn, turn % 9 = 8 OR row_number() OVER w = 1 AS alone FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(alone::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM t),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, run, alone ORDER BY turn) - 1) // 2 AS pair FROM r)
SELECT conv_id, min(turn) AS first, CASE WHEN count(*) > 1 THEN max(turn) END AS second FROM p GROUP BY conv_id, run, alone, pair"""


def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of their size and price, fitted to a viewport."""
    part = read(spark, sf_dir, "part")
    f = reader.fitted(F.col("p_size").cast("double"), F.col("p_retailprice"), (800.0, 600.0))
    return part.select("p_partkey", f.alias("f")).select("p_partkey", *[F.round(f"f.{c}", 6).alias(c) for c in ("scale", "x", "y")])


PAGE_GEOMETRY = """SELECT p_partkey, round(s, 6) AS scale, round((800 - p_size * s) / 2, 6) AS x, round((600 - p_retailprice * s) / 2, 6) AS y FROM (SELECT *, least(800.0::DOUBLE / p_size, 600.0::DOUBLE / p_retailprice) AS s FROM part)"""


def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's suppliers by names of mixed case with two numbers, some padded with zeros, in natural order."""
    k = F.col("s_suppkey")
    number = F.when(k % 3 == 0, F.concat(F.lit("00"), k)).otherwise(k.cast("string"))
    name = F.concat(F.when(k % 2 == 0, "SUPPLIER ").otherwise("Supplier "), k % 13, F.lit(" no"), number)
    named = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", name.alias("name"))
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(T.natural_key(F.col("name"))))
    return named.select("s_suppkey", "name", place.cast("long").alias("place"))


NATURAL_ORDER = """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'SUPPLIER ' ELSE 'Supplier ' END || (s_suppkey % 13) || ' no' || CASE WHEN s_suppkey % 3 = 0 THEN '00' ELSE '' END || s_suppkey AS name,
row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 13, s_suppkey) AS place FROM supplier"""


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names as output files; repeated ones are numbered."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".epub")).alias("path"))
    return reader.collision_free(part, "path", "p_partkey").select("p_partkey", "output")


OUTPUT_NAMES = "SELECT p_partkey, p_name || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '.epub' AS output FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k FROM part)"


def retained_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events as finished jobs: those of the last three days, 50 at most."""
    jobs = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("finished_at"))
    return reader.retained(jobs, F.lit("2024-01-30").cast("timestamp_ntz"), job="user_id", hours=72, most=50).select("user_id")


RETAINED_JOBS = "SELECT user_id FROM (SELECT user_id, max(ts) AS f FROM events GROUP BY 1) WHERE f > TIMESTAMP '2024-01-30' - INTERVAL 72 HOURS ORDER BY f DESC, user_id LIMIT 50"


def linkage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against an edited copy of themselves: confidence and merged names."""
    c = read(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    found = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 1, F.concat(name, F.lit(" jr"))).when(k % 4 == 2, F.lit("someone")).otherwise(F.concat(F.lit("  "), name))
    policy = F.when(k % 3 == 0, "append").when(k % 3 == 1, "replace").otherwise("keep")
    score = linkage.confidence(F.when(k % 11 != 0, name), F.col("c_mktsegment"), found, F.when(k % 2 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", score.alias("confidence"), linkage.merged_text(policy, name, T.collapse(found)).alias("merged"))


LINKAGE_SCORES = """WITH e AS (SELECT c_custkey AS k, c_name AS n, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || ' jr' WHEN 2 THEN 'someone' ELSE c_name END AS f FROM customer),
s AS (SELECT *, CASE WHEN k % 11 = 0 THEN 0.40 WHEN lower(n) = lower(f) THEN 0.92 WHEN contains(lower(n), lower(f)) OR contains(lower(f), lower(n)) THEN 0.76 ELSE 0.52 END AS b FROM e)
SELECT k AS c_custkey, round(least(b + CASE WHEN k % 2 = 0 THEN 0.06 ELSE 0 END, 0.98)::DOUBLE, 6) AS confidence,
CASE k % 3 WHEN 1 THEN f WHEN 0 THEN CASE WHEN lower(n) = lower(f) THEN n ELSE n || '; ' || f END ELSE n END AS merged FROM s"""

_ALL = (page_heads, tag_counts, page_roles, page_titles, page_text, page_integrity, compatibility_plan, reading_order, page_spreads, page_geometry, natural_order, output_names, retained_jobs, linkage_scores)
QUERIES = {f.__name__: f for f in _ALL}
SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
