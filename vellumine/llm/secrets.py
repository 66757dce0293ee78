"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are cast wide: private key blocks, values that are assigned to any
name, long runs of key characters. A random forest tells secrets from
look-alikes by length, transitions between kinds of characters, how much of a
candidate the corpus's own words cover, how path-like it is and the words
around it, hashed. It is trained on labelled findings: spans in texts of
their own that are known to be secrets or not. Without any of the caller's,
``planted`` makes some; their labels come from what was planted, not from
the features. All of it is DataFrame operations and Spark's own forest.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.llm.shared import BROADCAST_BYTES, keyed, saved, table_bytes

_KEY = "[A-Za-z0-9+/_-]"
#: A private key block; what is assigned to a name, six characters or more; a run of key characters,
#: twelve or more with a digit among them or twenty of any.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
    r"|(?<=[A-Za-z0-9_][\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?<![^\s:=\"'])[^\s\"',;<>(){}=]{6,}+"
    rf"|(?<!{_KEY})(?:(?=[A-Za-z+/_-]*[0-9]){_KEY}{{12,}}+|{_KEY}{{20,}}+)"
)
#: Code points before and after a candidate whose words are its neighbours, how many words of
#: either side count, and the hash buckets that a side's words fall in.
NEAR, NEIGHBOURS, BUCKETS = 80, 2, 24
#: Documents that have to hold a run of letters for it to be a dictionary word.
DICTIONARY_DOCS = 3
FEATURES = (
    "length", "digits", "capitals", "small", "marks", "other", "digit_letter", "letter_digit", "case_changes", "vowel_turns", "repeats",
    "hex", "groups", "coverage", "slashes", "dots", "in_path", "extension", "assigned", "quoted", "after_space", "block",
    *(f"before_{k}" for k in range(BUCKETS)), *(f"after_{k}" for k in range(BUCKETS)),
)
#: Labelled findings that a forest is trained on at most; beyond it a hash sample of about so many.
TRAIN_ROWS = 100_000
#: Labelled findings that ``planted`` makes where the caller has none.
PLANTED_ROWS = 6_000


#: Words that stand around planted findings.
_FILLER = "the we this then server config file value please note that our build when deploy user page read old new with from into after before line test system data list for and is run open check".split()
#: Planted findings: label, how the value is made, what stands before it and after it.
_PLANTS = (
    (1, "hex40", ("token = \"", "auth_token: ", "access token = \"", "api token: "), ("\"", " ", "\n")),
    (1, "hex64", ("secret = \"", "client_secret: ", "signing secret = '", "private key = "), ("\"", "'", "\n")),
    (1, "base64", ("api_key = \"", "secret_key: ", "apikey=", "encryption key: "), ("\"", " ", "\n")),
    (1, "aws", ("aws_access_key_id = ", "key ", "access key ", "credential "), (" ", "\n", ".")),
    (1, "github", ("token ", "git clone with ", "export TOKEN=", "bearer "), (" ", "\n", ".")),
    (1, "password", ("password = ", "passwd: ", "PWD=", "db password: \"", "login secret = '"), ("\n", " ", "\"", "'")),
    (1, "jwt", ("Authorization: Bearer ", "bearer ", "session token = \"", "jwt: "), ("\n", " ", "\"")),
    (1, "pem", ("", "\n", "key file:\n"), ("\n", " ")),
    (0, "hex40", ("commit ", "git revert ", "sha1: ", "revision = \""), (" ", "\n", "\"")),
    (0, "hex64", ("sha256: ", "checksum = ", "digest ", "image hash: "), (" ", "\n")),
    (0, "md5", ("md5 = ", "etag: \"", "hash ", "file digest: "), ("\"", " ", "\n")),
    (0, "uuid", ("id = ", "request ", "uuid: ", "trace id: "), (" ", "\n", ",")),
    (0, "digits", ("", "number ", "call ", "order ", "isbn: "), (" ", ", ", ".")),
    (0, "path", ("in ", "see ", "path = \"", "open "), (" ", "\"", "\n")),
    (0, "slug", ("https://example.org/", "url: ", "link = "), (" ", "\n")),
    (0, "words", ("", "called ", "name = \"", "mode: ", "color = \""), (" ", "\"", ".")),
    (0, "camel", ("call ", "function = ", "class ", "method: "), (" ", "(", "\n")),
    (0, "stamp", ("version = ", "date: ", "build ", "at "), (" ", "\n", ",")),
)


def planted(spark: SparkSession, n: int = PLANTED_ROWS, seed: int = 7) -> DataFrame:
    """(text, a, b, label): n texts, each with one planted value from code point a to b, secret (1) or not (0).

    Kinds of values, and the words before and after them, are drawn by a hash
    of the row's number and ``seed``.
    """
    i = F.col("id")

    def draw(j: int) -> Column:
        return F.xxhash64(i, F.lit(j), F.lit(seed))

    def pick(options, j: int) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in options]), (F.pmod(draw(j), F.lit(len(options))) + 1).cast("int"))

    def random_hex(j: int) -> Column:
        return F.sha2(F.concat_ws("-", i, F.lit(j), F.lit(seed)), 256)

    def letters(j: int) -> Column:
        return F.base64(F.unhex(random_hex(j)))

    def filler(j: int) -> Column:
        return F.concat_ws(" ", *[pick(_FILLER, 100 * j + k) for k in range(5)])

    alnum = F.translate(letters(1), "+/=", "aZ7")
    number = F.pmod(draw(11), F.lit(100_000)).cast("string")
    words = [pick(_FILLER, 20 + k) for k in range(5)]
    made = {
        "hex40": F.substring(random_hex(1), 1, 40),
        "hex64": random_hex(1),
        "md5": F.md5(random_hex(1)),
        "base64": letters(1),
        "aws": F.concat(F.lit("AKIA"), F.substring(F.translate(F.upper(alnum), "0189", "GHJK"), 1, 16)),
        "github": F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)),
        "password": F.concat(F.substring(alnum, 1, 5), pick("!@#$%&*?", 12), F.substring(alnum, 9, 4), number, pick("!.#?_", 13)),
        "jwt": F.concat_ws(".", F.concat(F.lit("eyJ"), F.substring(alnum, 1, 30)), F.translate(letters(2), "+/=", "_-q"), F.translate(letters(3), "+/=", "-_w")),
        "pem": F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), letters(1), F.lit("\n"), letters(2), F.lit("\n"), letters(3), F.lit("\n-----END RSA PRIVATE KEY-----")),
        "uuid": F.regexp_replace(F.substring(random_hex(1), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "digits": F.translate(F.substring(random_hex(1), 1, 16), "abcdef", "204861"),
        "path": F.concat_ws("/", F.lit(""), *words[:4], F.concat(words[4], F.lit("_"), number, pick((".py", ".txt", ".java", ".conf"), 14))),
        "slug": F.concat_ws("-", *words, number),
        "words": F.concat(*words[:4]),
        "camel": F.concat(words[0], *[F.initcap(w) for w in words[1:5]], number),
        "stamp": F.concat(F.lit("20"), F.substring(F.lpad(number, 5, "3"), 1, 2), F.lit("-0"), F.substring(F.lpad(number, 5, "3"), 3, 1), F.lit("-1"), F.substring(F.lpad(number, 5, "3"), 4, 1), pick(("T10:22:33Z", "-rc-build-12", ".12.0-beta-3"), 15)),
    }
    kind = F.pmod(draw(0), F.lit(len(_PLANTS)))
    value, before, after, label = (F.lit(None).cast(t) for t in ("string", "string", "string", "int"))
    for k, (is_secret, how, fronts, backs) in enumerate(_PLANTS):
        value, before = F.when(kind == k, made[how]).otherwise(value), F.when(kind == k, pick(fronts, 16)).otherwise(before)
        after, label = F.when(kind == k, pick(backs, 17)).otherwise(after), F.when(kind == k, is_secret).otherwise(label)
    parts = spark.range(n).select(F.concat(filler(1), F.lit(" "), before).alias("front"), value.alias("value"), F.concat(after, filler(2)).alias("back"), label.alias("label"))
    a = F.length("front")
    return parts.select(F.concat("front", "value", "back").alias("text"), a.alias("a"), (a + F.length("value")).alias("b"), "label")


def candidates(rows: DataFrame) -> DataFrame:
    """(doc_id, h, a, b, value, before, after) of each candidate in ``rows`` of ``keyed``."""
    text = F.coalesce("text", F.lit(""))
    found, between = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    start = F.struct(F.array().cast("array<struct<a:int,b:int,value:string>>").alias("out"), F.lit(0).alias("at"))
    paired = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("v")))

    def add(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        b = a + F.length(x["v"])
        return F.struct(F.concat(state["out"], F.array(F.struct(a.alias("a"), b.alias("b"), x["v"].alias("value")))).alias("out"), b.alias("at"))

    each = rows.where(text.rlike(CANDIDATE)).select("doc_id", "h", text.alias("text"), F.explode(F.aggregate(paired, start, add, lambda s: s["out"])).alias("c"))
    a, b = F.col("c.a"), F.col("c.b")
    before = F.col("text").substr(F.greatest(a - NEAR, F.lit(0)) + 1, F.least(a, F.lit(NEAR)))
    return each.select("doc_id", "h", "c.a", "c.b", "c.value", before.alias("before"), F.col("text").substr(b + 1, F.lit(NEAR)).alias("after"))


def _coverage(found: DataFrame, rows: DataFrame) -> DataFrame:
    """(value, covered): the characters of each value's letter runs that are words of the corpus."""
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{3,}+"), F.lit(0))).alias("word"))
    runs = saved(runs, "runs")
    wanted = saved(runs.select("word").distinct(), "wanted")
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    words = rows.select(F.explode(words).alias("word"))
    if table_bytes(wanted) <= BROADCAST_BYTES:
        counts = words.join(F.broadcast(wanted), "word").groupBy("word").count()
    else:  # count the vocabulary first: the shuffle then has a row for each word and task
        counts = words.groupBy("word").count().join(wanted, "word")
    dictionary = counts.where(F.col("count") >= DICTIONARY_DOCS).select("word")
    return runs.join(dictionary, "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered"))


def featured(found: DataFrame, rows: DataFrame) -> DataFrame:
    """``found`` with FEATURES, all doubles; the dictionary is that of ``rows``."""
    v, n = F.col("value"), F.length("value")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    def words(side: str) -> Column:
        return F.regexp_extract_all(F.lower(side), F.lit(r"\p{L}{2,}+"), F.lit(0))

    made = {
        "length": F.log(n.cast("double")),
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "small": share("[a-z]"),
        "marks": share("[+/_-]"),
        "other": share("[^A-Za-z0-9+/_-]"),
        "digit_letter": share("[0-9](?=[A-Za-z])"),
        "letter_digit": share("[A-Za-z](?=[0-9])"),
        "case_changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "vowel_turns": share("(?i)[aeiou](?=[b-df-hj-np-tv-z])|[b-df-hj-np-tv-z](?=[aeiou])"),
        "repeats": share(r"(.)(?=\1)"),
        "hex": v.rlike("^[0-9a-f]+$").cast("int"),
        "groups": F.regexp_count(v, F.lit("[-_]")),
        "coverage": F.coalesce("covered", F.lit(0)) / n,
        "slashes": share("/"),
        "dots": F.regexp_count(v, F.lit(r"\.")),
        "in_path": (F.col("before").rlike(r"[/.\\]$") | F.col("after").rlike(r"^[/\\]")).cast("int"),
        "extension": (v.rlike(r"\.[A-Za-z]{1,5}$") | F.col("after").rlike(r"^\.[a-z]{1,5}\b")).cast("int"),
        "assigned": F.col("before").rlike("[:=]\\s{0,3}[\"']?$").cast("int"),
        "quoted": F.col("before").rlike("[\"']$").cast("int"),
        "after_space": F.col("before").rlike(r"\s$").cast("int"),
        "block": v.startswith("-----BEGIN").cast("int"),
    }
    near = {"before": F.slice(F.reverse(words("before")), 1, NEIGHBOURS), "after": F.slice(words("after"), 1, NEIGHBOURS)}
    hashed = {side: F.transform(w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS))) for side, w in near.items()}
    covered = _coverage(found, rows)
    marked = found.join(covered, "value", "left").select(*found.columns, *[c.cast("double").alias(f) for f, c in made.items()], *[w.alias(f"{side}_words") for side, w in hashed.items()])
    buckets = [F.array_contains(f"{side}_words", F.lit(k).cast("long")).cast("double").alias(f"{side}_{k}") for side in near for k in range(BUCKETS)]
    return marked.select(*found.columns, *made, *buckets)


def _labelled(findings: DataFrame) -> DataFrame:
    """The candidates in the findings' texts that overlap a labelled span, with ``label``."""
    marks = findings.where("text IS NOT NULL AND label IS NOT NULL").select(F.xxhash64("text").alias("h"), F.col("a").cast("int").alias("x"), F.col("b").cast("int").alias("y"), F.col("label").cast("double").alias("label"), "text")
    texts = marks.select(F.lit(None).cast("long").alias("doc_id"), "h", "text").distinct()
    met = candidates(texts).join(marks.drop("text"), "h").where("a < y AND x < b")
    return met.groupBy("doc_id", "h", "a", "b", "value", "before", "after").agg(F.max("label").alias("label"))


def scan(docs: DataFrame, findings: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, trees: int = 60, depth: int = 8, seed: int = 11) -> DataFrame:
    """(doc_id, h, a, b, value, probability, is_secret): each candidate in ``docs``.

    ``findings`` are labelled ones: (text, a, b, label), a span of a text in
    code points and 1 for a secret, 0 for none; without any, ``planted``
    gives them. A candidate in such a text is labelled by the span that it
    overlaps, by the secret if it overlaps both kinds. A forest trained on at
    most about TRAIN_ROWS of them gives every candidate in ``docs`` its
    probability; if all labels agree, that label does; without labels it is
    null and nothing is a secret. Null and empty texts hold no candidate;
    repeated rows give each of their candidates again; an empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    rows = keyed(docs, doc_id, text)
    known = _labelled(saved(planted(spark) if findings is None else findings.select("text", "a", "b", "label"), "findings"))
    found = candidates(rows).withColumn("label", F.lit(None).cast("double")).withColumn("own", F.lit(True))
    both = saved(found.unionByName(known.withColumn("own", F.lit(False))), "candidates")
    marked = saved(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(both, rows)).drop(*FEATURES), "marked")
    train = marked.where("NOT own").select("features", "label", F.xxhash64("value", "before", "after").alias("key"))
    kinds = train.groupBy("label").count().orderBy("label").collect()  # two rows at most
    n = sum(r["count"] for r in kinds)
    if len(kinds) == 2:
        share = TRAIN_ROWS / n
        if share < 1:
            train = train.where(F.pmod("key", F.lit(1_000_003)) < int(share * 1_000_003))
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(train.orderBy("key"))
        scored = model.transform(marked.where("own")).withColumn("p", vector_to_array("probability")[1])
    else:
        scored = marked.where("own").withColumn("p", F.lit(kinds[0]["label"] if kinds else None).cast("double"))
    p = F.round("p", 6)
    return scored.select("doc_id", "h", "a", "b", "value", p.alias("probability"), F.coalesce(F.col("p") >= threshold, F.lit(False)).alias("is_secret"))
