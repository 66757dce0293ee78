"""Personal data: patterns, then information-theoretic sanitisation.

Patterns find the protected entities: mail addresses, IP addresses, card and
phone numbers. An entity is a value and also its kind, any value of it. The
corpus then tells which terms reveal one of them: with N documents, an entity
e and a term t near it, t reveals

    log(N n(e,t) / (n(e) n(t))) / log(N / n(e))

of e's information, 1 if t never stands without e. Terms beyond the
thresholds are generalised or removed wherever they occur. A term has to be
seen near the entity in several different contexts, so that copies of one
text prove nothing; rows that repeat one another count once. All of it is
DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.llm.shared import broadcast_if_small, joined, keyed, saved

_LOCAL = "[A-Za-z0-9._%+-]"
#: Patterns of the kinds, in order. A match can begin only where its first run does, or where the
#: last match ended; said so, long runs are read once. Possessive, they use no stack.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text has to hold for a kind to be looked for.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": "+"}
_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"
#: Words that may reveal an entity: three letters or more.
TERM = r"\p{L}{3,}+"
#: Code points on either side of an entity that are its context, and the terms next to it on
#: either side that tell one context from another: lightly edited copies show the same context.
CONTEXT, NEAREST = 200, 3

_SPAN = "struct<a:int,b:int,v:string>"


def _matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<a, b, v>>: the bounds in code points and the text of each match of a pattern."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    found, between = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    paired = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, v: F.struct(F.length(gap).alias("gap"), v.alias("v")))
    start = F.struct(F.array().cast(f"array<{_SPAN}>").alias("out"), F.lit(0).alias("at"))

    def add(state: Column, x: Column) -> Column:
        a = state["at"] + x["gap"]
        b = a + F.length(x["v"])
        return F.struct(F.concat(state["out"], F.array(F.struct(a.alias("a"), b.alias("b"), x["v"].alias("v")))).alias("out"), b.alias("at"))

    return F.aggregate(paired, start, add, lambda s: s["out"])


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        doubled = F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return total + doubled

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return v.rlike(_OCTETS)
    if kind == "card":
        return F.length(_digits(v)).between(14, 19) & _luhn(_digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(10, 15)
    return F.lit(True)


def _kept(kind: str):
    return lambda x: _valid(kind, x["v"])


def base_spans(text: Column) -> list[Column]:
    """A column for each kind: array<struct<a, b, v>> of its valid matches; empty for a null text."""
    out = []
    for kind, pattern in PATTERNS.items():
        hint = F.contains(text, F.lit(HINTS[kind])) if len(HINTS[kind]) == 1 else text.rlike(HINTS[kind])
        found = F.filter(_matches(text, pattern), _kept(kind))
        out.append(F.when(hint, found).otherwise(F.array().cast(f"array<{_SPAN}>")).alias(kind))
    return out


def find_base(rows: DataFrame) -> DataFrame:
    """``rows`` of ``keyed`` with a column of spans for each kind."""
    return rows.withColumn("text", F.coalesce("text", F.lit(""))).select("*", *base_spans(F.col("text")))


def _contexts(found: DataFrame) -> DataFrame:
    """(doc_id, h, kind, value, seen, terms): the terms around each entity; ``seen`` tells contexts apart."""
    def entity(kind: str):
        spelled = F.lower if kind == "email" else _digits if kind in ("card", "phone") else (lambda v: v)
        return lambda x: F.struct(F.lit(kind).alias("kind"), spelled(x["v"]).alias("value"), x["a"].alias("a"), x["b"].alias("b"))

    entities = F.concat(*[F.transform(k, entity(k)) for k in PATTERNS])
    each = found.where(" OR ".join(f"size({k}) > 0" for k in PATTERNS)).select("doc_id", "h", "text", F.explode(entities).alias("e"))
    a, b = F.col("e.a"), F.col("e.b")
    left = F.col("text").substr(F.greatest(a - CONTEXT, F.lit(0)) + 1, F.least(a, F.lit(CONTEXT)))
    right = F.col("text").substr(b + 1, F.lit(CONTEXT))
    # A word that the window cuts is no term.
    left = F.when(a > CONTEXT, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) == CONTEXT, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)

    def terms(side: Column) -> Column:
        return F.regexp_extract_all(F.lower(F.regexp_replace(side, PATTERNS["email"], " ")), F.lit(TERM), F.lit(0))

    sides = each.select("doc_id", "h", "e.kind", "e.value", terms(left).alias("left"), terms(right).alias("right"))
    seen = F.xxhash64(F.slice(F.reverse("left"), 1, NEAREST), F.slice("right", 1, NEAREST))
    both = F.explode(F.array("value", F.lit(None).cast("string"))).alias("value")  # null: the kind itself
    return sides.select("doc_id", "h", "kind", both, F.array_distinct(F.concat("left", "right")).alias("terms"), seen.alias("seen"))


def _once(found: DataFrame) -> DataFrame:
    """``found`` (a saved table with ``rid``, a number of its own for each row) with one row of those that share id and text."""
    same = found.groupBy("doc_id", "h").agg(F.min("rid").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = saved(same.withColumnsRenamed({"doc_id": "vq_id", "h": "vq_h"}), "repeated")
    if same.isEmpty():
        return found
    met = found["doc_id"].eqNullSafe(same["vq_id"]) & (found["h"] == same["vq_h"]) & (found["rid"] > same["first"])
    return found.join(broadcast_if_small(same), met, "left_anti")


def _term_rows(rows: DataFrame) -> DataFrame:
    """(doc_id, h, term): the terms that each document holds."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)
    return rows.select("doc_id", "h", F.explode(words).alias("term"))


def revealing_terms(found: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, contexts: int = 2) -> DataFrame:
    """(term, revealed, remove) of the terms beyond the thresholds; a saved table.

    ``revealed`` is the largest share of an entity's information that the
    term gives away. Counts are of documents over the whole corpus, rows that
    share id and text being one; a pair counts if the term stands near the
    entity in ``contexts`` different contexts at least.
    """
    found = _once(found)
    doc = F.struct("doc_id", "h")
    near = saved(_contexts(found), "contexts")
    entities = near.groupBy("kind", "value").agg(F.count_distinct(doc).alias("n_e")).withColumnsRenamed({"kind": "k", "value": "v"})
    pairs = near.select("doc_id", "h", "kind", "value", "seen", F.explode("terms").alias("term")).groupBy("kind", "value", "term")
    pairs = pairs.agg(F.count_distinct(doc).alias("n_et"), F.count_distinct("seen").alias("contexts")).where(F.col("contexts") >= contexts)
    pairs = saved(pairs.join(entities, (F.col("kind") == F.col("k")) & F.col("value").eqNullSafe(F.col("v"))).drop("k", "v"), "pairs")
    # Tasks add up their own counts, so what is shuffled follows the vocabulary, not the words.
    n_t = _term_rows(found).groupBy("term").agg(F.count("*").alias("n_t"))
    told = pairs.join(n_t, "term").withColumn("n_all", F.lit(found.select("h").count()))
    bits = F.when(F.col("n_e") < F.col("n_all"), F.log(F.col("n_all") * F.col("n_et") / (F.col("n_e") * F.col("n_t"))) / F.log(F.col("n_all") / F.col("n_e")))
    told = told.withColumn("revealed", bits).groupBy("term").agg(F.max("revealed").alias("revealed")).where(F.col("revealed") >= generalise_at)
    return saved(told.withColumn("remove", F.col("revealed") >= remove_at), "revealing")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", generalise_at: float = 0.8, remove_at: float = 0.95, contexts: int = 2) -> DataFrame:
    """(doc_id, h, text, email, ip, card, phone, terms) of each row of ``docs``.

    Each kind is array<struct<a, b, v>> of code-point bounds and text, sorted;
    ``terms`` holds the revealing terms' occurrences outside those, which also
    have ``remove``. Null text counts as empty. Repeated rows get the same
    result each, the one they had alone; an empty table gives an empty result.
    """
    # Patterns are searched once; what is counted and looked up again is read from the table.
    rows = saved(find_base(keyed(docs, doc_id, text)).withColumn("rid", F.monotonically_increasing_id()), "base")
    told = revealing_terms(rows, generalise_at, remove_at, contexts)
    held = _term_rows(rows).join(broadcast_if_small(told), "term").select("doc_id", "h", "term", "remove")
    listed = held.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.when(F.col("remove"), F.col("term"))).alias("out"), F.collect_list(F.when(~F.col("remove"), F.col("term"))).alias("wide"))
    marked = joined(rows.drop("rid"), broadcast_if_small(saved(listed, "listed")), "left")
    # Terms are letters only, so they are a pattern as they stand; it finds few matches in few texts.
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(F.concat("out", "wide"), "|"), F.lit(r")(?!\p{L})"))
    words = F.transform(_matches(F.col("text"), pattern), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["v"].alias("v"), F.array_contains("out", F.lower(x["v"])).alias("remove")))
    inside = [lambda x, k=k: F.exists(k, lambda p: (p["a"] < x["b"]) & (x["a"] < p["b"])) for k in PATTERNS]
    words = F.filter(words, lambda x: (x["remove"] | F.array_contains("wide", F.lower(x["v"]))) & ~(inside[0](x) | inside[1](x) | inside[2](x) | inside[3](x)))
    none = F.array().cast("array<struct<a:int,b:int,v:string,remove:boolean>>")
    return marked.withColumn("terms", F.when(F.col("out").isNotNull(), words).otherwise(none)).drop("out", "wide")


def listed(kinds: tuple[str, ...], names: tuple[str, ...] = ()) -> Column:
    """``kind:start:end`` of the spans in columns ``kinds``, by start, then kind as listed, comma-joined."""
    names = names or kinds

    def entry(i: int, name: str):
        return lambda x: F.struct(x["a"].alias("a"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(name), x["a"], x["b"]).alias("s"))

    parts = [F.transform(k, entry(i, name)) for i, (k, name) in enumerate(zip(kinds, names))]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: x["s"]), ",")


def sanitised(found: DataFrame) -> Column:
    """The text of a row of ``find`` with every span replaced by its kind in angle brackets, or by nothing."""

    def entry(kind: str):
        return lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.lit(f"<{kind}>").alias("by"))

    parts = [F.transform(k, entry(k)) for k in PATTERNS]
    parts.append(F.transform("terms", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.when(x["remove"], "").otherwise("<term>").alias("by"))))
    text = F.col("text")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(s: Column, x: Column) -> Column:
        """A span inside what is replaced already only moves its end."""
        fresh = x["a"] >= s["at"]
        out = F.when(fresh, F.concat(s["out"], text.substr(s["at"] + 1, x["a"] - s["at"]), x["by"])).otherwise(s["out"])
        return F.struct(out.alias("out"), F.greatest(s["at"], x["b"]).alias("at"))

    spans = F.array_sort(F.concat(*parts))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, add, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text)))))
