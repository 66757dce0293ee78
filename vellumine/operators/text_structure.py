"""Structure of plain text: paragraphs, headings, volumes, metadata.

A document is one row, so its ordered scans are folds over an array of its
lines: no shuffle, whatever the corpus's size. Results that are rows (headings,
paragraphs) are exploded at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import CJK, collapse, is_blank, let, lines, normal_newlines, number, utrim

#: Words that are a heading of their own, by kind; fixed values.
SPECIAL = {
    "Prologue": ("序", "序章", "序言", "前言", "引子", "楔子", "prologue"),
    "Epilogue": ("尾声", "终章", "終章", "epilogue"),
    "Afterword": ("后记", "後記", "afterword"),
    "Introduction": ("introduction", "引言"),
}
#: The same for whole Japanese lines; fixed values.
JAPANESE = {
    "Afterword": ("あとがき", "まえがき"),
    "Epilogue": ("終章",),
    "Prologue": ("序章",),
}
#: Marks after 第 and a number, with the detector that each counts as; fixed values.
MARKS = {
    "章": "cjk_explicit_chapter",
    "回": "chinese_novel_hui",
    "节": "cjk_explicit_section",
    "卷": "cjk_volume_detector",
    "部": "cjk_volume_detector",
    "篇": "cjk_explicit_essay",
    "幕": "cjk_explicit_act",
    "集": "cjk_explicit_episode",
}
_MARK = "^第([^" + "".join(MARKS) + "]*)([" + "".join(MARKS) + "])[ \t：:、—-]*+(.{0,50})$"
_KANA = "[\u3040-\u30ff\u31f0-\u31ff]"
_KANA_MARK = "^第([^章]*)章\\s*+(.{0,50})$"
_WORDED = r"(?i)^(chapter|part|book)(?=[ \t:：])[ \t:：]*([^ \t:：.—-]*)"


def with_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``lines``, the lines of ``text``."""
    return docs.withColumn("lines", lines(normal_newlines(F.coalesce(text, F.lit("")))))


def paragraph_starts(boundary: str = "blank") -> Column:
    """The indices of lines that begin a paragraph: after a blank line, or by ``indent`` a leading space too."""
    def begins(x: Column, i: Column) -> Column:
        first = (i == 0) | is_blank(F.get("lines", i - 1))
        return ~is_blank(x) & ((first | x.rlike("^[ \t　]")) if boundary == "indent" else first)

    marked = F.transform("lines", lambda x, i: F.when(begins(x, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def _joined(parts: Column) -> Column:
    """Lines put together with a space, but none between two CJK characters or after white space."""
    def add(out: Column, x: Column) -> Column:
        tight = (out.rlike(f"{CJK}$") & x.rlike(f"^{CJK}")) | out.rlike(r"\s$") | (out == "")
        return F.concat(out, F.when(tight, "").otherwise(" "), x)

    return F.aggregate(F.transform(parts, utrim), F.lit(""), add)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", boundary: str = "blank") -> DataFrame:
    """(key, paragraph, line, n_lines, text): one row for each paragraph, numbered from 0."""
    made = with_lines(docs, text).withColumn("starts", paragraph_starts(boundary))
    each = made.select(key, "lines", "starts", F.posexplode("starts").alias("paragraph", "line"))
    stop = F.coalesce(F.get("starts", F.col("paragraph") + 1), F.size("lines"))
    part = F.filter(F.slice("lines", F.col("line") + 1, stop - F.col("line")), lambda x: ~is_blank(x))
    return each.select(key, "paragraph", "line", F.size(part).alias("n_lines"), _joined(part).alias("text"))


def line_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Lengths of the lines that are not blank: count, upper median, share of 35 to 100, irregularity.

    ``pct_wrapped`` is a whole percentage; ``irregular`` says that a line
    differs from the first by over half of the longer. No lines: zeros.
    """
    return measured(with_lines(docs, text), key)


def measured(made: DataFrame, *kept: str) -> DataFrame:
    """``kept`` of ``made`` and the statistics of its ``lines``."""
    made = made.withColumn("full", F.filter("lines", lambda x: ~is_blank(x)))
    made = made.withColumn("n", F.transform("full", lambda x: F.length(x)))
    first = F.get("n", F.lit(0))
    return made.select(
        *kept,
        F.size("lines").alias("n_lines"),
        F.size("n").alias("n_full"),
        F.coalesce(F.get(F.array_sort("n"), F.floor(F.size("n") / 2).cast("int")), F.lit(0)).alias("median_length"),
        F.when(F.size("n") > 0, F.floor(100 * F.size(F.filter("n", lambda v: v.between(35, 100))) / F.size("n"))).otherwise(0).cast("int").alias("pct_wrapped"),
        F.coalesce(F.exists("n", lambda v: 2 * F.abs(v - first) > F.greatest(v, first)), F.lit(False)).alias("irregular"),
        F.size(F.filter("n", lambda v: v <= 42)).alias("n_short"),
        F.size(F.filter("full", lambda x: x.rlike("^[ \t　]"))).alias("n_indented"),
    )


def paragraph_mode(stats: DataFrame, requested: str = "auto") -> DataFrame:
    """``stats`` of ``line_statistics`` with ``mode``, ``confidence`` and ``protected``.

    ``requested`` is auto, every_line, indented, blank_line or hard_wrap; a
    text whose lines look like verse or code is never unwrapped.
    """
    n = F.greatest("n_full", F.lit(1))
    protected = (F.col("n_full") > 0) & (100 * F.col("n_short") >= 65 * n) & ((100 * F.col("n_indented") >= 10 * n) | F.col("irregular"))
    blank = F.col("n_lines") - F.col("n_full")
    wrapped = F.col("median_length").between(42, 90) & (F.col("pct_wrapped") >= 65) & (100 * blank < 12 * F.col("n_lines"))
    empty = F.col("n_full") == 0
    if requested == "auto":
        mode, sure = F.when(protected, "every_line").when(wrapped, "hard_wrap").otherwise("blank_line"), F.when(protected, 88).when(wrapped, 82).otherwise(76)
    elif requested == "hard_wrap":
        mode, sure = F.when(protected, "every_line").otherwise("hard_wrap"), F.when(protected, 92).when(wrapped, 86).otherwise(62)
    else:
        mode, sure = F.lit(requested), F.lit({"every_line": 100, "indented": 85, "blank_line": 90}[requested])
    return stats.select("*", F.when(empty, "blank_line").otherwise(mode).alias("mode"), F.when(empty, 100).otherwise(sure).alias("confidence"), (~empty & protected).alias("protected"))


_HEADING = "struct<kind:string,number:int,detector:string>"


def _found(kind: Column | str, n: Column, detector: Column | str) -> Column:
    kind, detector = (F.lit(x) if isinstance(x, str) else x for x in (kind, detector))
    return F.struct(kind.alias("kind"), n.cast("int").alias("number"), detector.alias("detector")).cast(_HEADING)


def _if_number(text: Column, kind: Column | str, detector: Column | str) -> Column:
    return let(number(text), lambda n: F.when(n.isNotNull(), _found(kind, n, detector)))


def _heading(line: Column) -> Column:
    """struct<kind, number, detector> of a trimmed line that is a heading; null for others."""
    none = F.lit(None).cast("int")
    fits = (line != "") & (F.length(line) <= 70) & ~line.rlike("[。！？!?；;]\\s*$")
    japanese = [F.when(line.isin(*ws), _found(kind, none, "japanese_detector")) for kind, ws in JAPANESE.items()]
    kana = F.when(line.rlike(_KANA) & line.rlike(_KANA_MARK), _if_number(F.regexp_extract(line, _KANA_MARK, 1), "Chapter", "japanese_detector"))
    mark = F.regexp_extract(line, _MARK, 2)
    detector = F.create_map(*[F.lit(v) for pair in MARKS.items() for v in pair])[mark]
    by_mark = _if_number(F.regexp_extract(line, _MARK, 1), F.when(mark.isin("卷", "部"), "Volume").otherwise("Chapter"), detector)
    extra = F.when(F.startswith(line, F.lit("番外")), _found("Supplement", number(F.substring(line, 3, 70)), "cjk_supplement"))
    word = F.lower(F.regexp_extract(line, _WORDED, 1))
    worded = F.when(word != "", _if_number(F.regexp_extract(line, _WORDED, 2), F.when(word == "chapter", "Chapter").otherwise("Volume"), F.concat(F.lit("english_"), word, F.lit("_detector"))))

    def named(bare: Column) -> Column:
        return F.coalesce(*[F.when(bare.isin(*ws), _found(kind, none, f"{kind.lower()}_detector")) for kind, ws in SPECIAL.items()])

    special = let(F.lower(F.regexp_replace(line, "^[ 　.:：—-]+|[ 　.:：—-]+$", "")), named)
    return F.when(fits, F.coalesce(*japanese, kana, F.when(F.startswith(line, F.lit("第")), by_mark).otherwise(F.coalesce(extra, special, worded))))


def _candidates() -> Column:
    """The lines of ``lines`` that may be headings: line, title, kind, number, detector and score, in order."""
    n = F.size("lines")

    def scored(x: Column, i: Column) -> Column:
        before = (i == 0) | is_blank(F.get("lines", i - 1))
        after = (i == n - 1) | is_blank(F.get("lines", i + 1))

        def score(h: Column) -> Column:
            size = F.length(h["title"])
            points = (
                F.when(h["head"]["number"].isNotNull(), 55).otherwise(50)
                + F.when(size <= 30, 12).when(size <= 60, 6).otherwise(0)
                + F.when(h["before"], F.when(h["line"] == 0, 8).otherwise(14)).otherwise(0)
                + F.when(h["after"], 8).otherwise(0)
                + F.when(~h["before"] & ~h["after"], -12).otherwise(0)
            )
            fields = {"kind": h["head"]["kind"], "number": h["head"]["number"], "detector": h["head"]["detector"]}
            made = F.struct(h["line"].alias("line"), h["title"].alias("title"), *[c.alias(k) for k, c in fields.items()], F.greatest(F.lit(0), F.least(F.lit(100), points)).alias("score"))
            return F.when(h["head"].isNotNull(), made)

        title = utrim(x)
        return let(F.struct(i.alias("line"), title.alias("title"), let(title, _heading).alias("head"), before.alias("before"), after.alias("after")), score)

    return F.filter(F.transform("lines", scored), lambda h: h.isNotNull())


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text", novel: bool = False) -> DataFrame:
    """One row for each heading that is accepted: line, kind, number, score, level, volume_line.

    A candidate's score rises with shortness and with blank lines around it,
    and again if its number follows the previous candidate's. It is accepted
    at 75 if the document as a whole looks structured (more than one
    candidate of 65, or the first is line 0 with 85), or always if ``novel``.
    ``volume_line`` is the line of the last volume before a chapter.
    """
    made = with_lines(docs, text)
    # Only headings leave their document's row: what follows is a window over few rows.
    each = made.select(F.col(key), F.explode(_candidates()).alias("h")).select(key, "h.*")
    w = Window.partitionBy(key).orderBy("line")
    numbered = F.col("number").isNotNull()
    before = F.last(F.when(numbered, F.struct("kind", "number", "detector")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("before", before)
    alike = numbered & (F.col("before.kind") == F.col("kind")) & (F.col("before.detector") == F.col("detector"))
    step = F.col("number") - F.col("before.number")
    moved = F.when(alike & (step == 1), F.least(F.lit(100), F.col("score") + 15)).when(alike & ((step <= 0) | (step > 4)), F.greatest(F.lit(0), F.col("score") - 18))
    each = each.withColumn("score", F.coalesce(moved, "score"))
    whole = Window.partitionBy(key)
    gate = (F.count_if(F.col("score") >= 65).over(whole) > 1) | (F.max((F.col("line") == 0) & (F.col("score") >= 85)).over(whole))
    kept = each.withColumn("gate", gate).where((F.col("score") >= 75) & (F.lit(novel) | F.col("gate")))
    is_volume = F.col("kind") == "Volume"
    volume = F.last(F.when(is_volume, F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return kept.select(key, "line", "title", "kind", "number", "detector", "score", F.when(is_volume, 1).otherwise(2).alias("level"), F.when(~is_volume, volume).alias("volume_line"))


def sections(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each paragraph with the heading line it stands under (null before the first)."""
    marks = found.groupBy(key).agg(F.collect_set("line").alias("marks"))
    each = paragraphs(docs, key, text).join(marks, key, "left")
    under = F.array_max(F.filter("marks", lambda m: m <= F.col("line")))
    return each.where(~F.coalesce(F.array_contains("marks", F.col("line")), F.lit(False))).select(key, "paragraph", "line", under.alias("section_line"), F.length("text").alias("n_chars"))


#: Marks that tell a preformatted line as code; fixed values.
CODE = ("{", "}", "=>", "fn ", "let ", "class ", "#include", "</")
#: Bytes of text that one document of an import holds at most.
DOCUMENT_BYTES = 32 << 20


def imported(docs: DataFrame, key: str = "doc_id", text: str = "text", requested: str = "auto", novel: bool = False, document_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """The nodes of imported texts: (key, node_id, document, line, kind, level, text, preformatted, code, confidence).

    Headings and paragraphs in the order of their lines, numbered from 0. A
    paragraph ends at a blank line or a heading; every line is one in the
    mode every_line, an indented line begins one in the mode indented. A text
    too long for one document goes on in the next at a node. Null text counts
    as empty and gives no nodes.
    """
    made = paragraph_mode(measured(with_lines(docs, text), key, "lines"), requested).select(key, "lines", "mode", "protected", "confidence")
    made = made.withColumn("found", _candidates()).withColumn("found", _accepted(novel))
    # Each line's mark, so that none is looked for among all headings.
    gaps = F.transform("found", lambda h, i: F.concat(F.array_repeat(F.lit(False), h["line"] - F.when(i == 0, 0).otherwise(F.get("found", i - 1)["line"] + 1)), F.array(F.lit(True))))
    made = made.withColumn("used", let(F.flatten(gaps), lambda marked: F.transform("lines", lambda x, i: ~is_blank(x) & ~F.coalesce(F.get(marked, i), F.lit(False)))))

    def begins(x: Column, i: Column) -> Column:
        first = (i == 0) | ~F.get("used", i - 1) | (F.col("mode") == "every_line") | ((F.col("mode") == "indented") & x.rlike("^[ \t　]"))
        return F.when(F.get("used", i) & first, i)

    made = made.withColumn("starts", F.array_compact(F.transform("lines", begins)))
    kept = F.col("protected") & F.col("mode").isin("every_line", "hard_wrap")

    def paragraph(line: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("starts", k + 1), F.size("lines"))
        part = F.filter(F.slice("lines", line + 1, stop - line), lambda x, i: F.get("used", line + i))
        body = F.when(kept & (F.col("mode") == "every_line"), F.get(part, F.lit(0))).otherwise(_joined(part))
        return let(body, lambda body: _node(line, "paragraph", F.lit(None).cast("int"), body, kept, kept & F.greatest(*[F.contains(body, F.lit(c)) for c in CODE]), F.col("confidence")))

    def heading(h: Column) -> Column:
        return _node(h["line"], "heading", F.when(h["kind"] == "Volume", 1).otherwise(2), h["title"], F.lit(False), F.lit(False), h["score"])

    nodes = F.array_sort(F.concat(F.transform("starts", paragraph), F.transform("found", heading)))
    # A document's row stays one until here; of the fold over sizes only the nodes that begin a document are kept.
    start = F.struct(F.array().cast("array<int>").alias("firsts"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("bytes"))

    def put(s: Column, x: Column) -> Column:
        size = F.octet_length(x["text"]).cast("long")
        more = (s["bytes"] > 0) & (s["bytes"] + size > document_bytes)
        return F.struct(F.when(more, F.concat(s["firsts"], F.array(s["n"]))).otherwise(s["firsts"]).alias("firsts"), (s["n"] + 1).alias("n"), F.when(more, size).otherwise(s["bytes"] + size).alias("bytes"))

    placed = made.select(key, nodes.alias("nodes")).withColumn("firsts", F.aggregate("nodes", start, put, lambda s: s["firsts"]))
    # Outer: else Spark asks for the nodes in a filter below too, and makes them once more for it.
    each = placed.select(key, "firsts", F.posexplode_outer("nodes").alias("node_id", "node")).where("node IS NOT NULL")
    document = F.size(F.filter("firsts", lambda f: f <= F.col("node_id")))
    return each.select(key, F.col("node_id").cast("long").alias("node_id"), document.alias("document"), *[F.col(f"node.{x}").alias(x) for x in ("line", "kind", "level", "text", "preformatted", "code")], F.when(F.col("node.confidence") >= 85, "StronglyInferred").otherwise("Heuristic").alias("confidence"))


def _node(line: Column, kind: str, level: Column, text: Column, preformatted: Column, code: Column, confidence: Column) -> Column:
    """A node of an import; nodes sort by line and kind."""
    fields = {"line": line, "kind": F.lit(kind), "level": level, "text": text, "preformatted": preformatted, "code": code, "confidence": confidence}
    return F.struct(*[c.alias(k) for k, c in fields.items()]).cast("struct<line:int,kind:string,level:int,text:string,preformatted:boolean,code:boolean,confidence:int>")


def _accepted(novel: bool) -> Column:
    """Of ``found``, the candidates of a document, those that ``headings`` accepts, with their final scores."""
    def moved(h: Column, before: Column) -> Column:
        alike, step = (before["kind"] == h["kind"]) & (before["detector"] == h["detector"]), h["number"] - before["number"]
        score = F.when(alike & (step == 1), F.least(F.lit(100), h["score"] + 15)).when(alike & ((step <= 0) | (step > 4)), F.greatest(F.lit(0), h["score"] - 18)).otherwise(h["score"])
        return h.withField("score", score)

    def gated(all_: Column) -> Column:
        gate = (F.size(F.filter(all_, lambda h: h["score"] >= 65)) > 1) | F.exists(all_, lambda h: (h["line"] == 0) & (h["score"] >= 85))
        return F.filter(all_, lambda h: (h["score"] >= 75) & (F.lit(novel) | gate))

    # The numbered candidate before a numbered one is its neighbour among them; the others keep their score.
    numbered = let(F.filter("found", lambda h: h["number"].isNotNull()), lambda ns: F.transform(ns, lambda h, i: F.when(i == 0, h).otherwise(moved(h, F.get(ns, i - 1)))))
    return let(F.array_sort(F.concat(numbered, F.filter("found", lambda h: h["number"].isNull()))), gated)


def file_name_guess(name: Column) -> Column:
    """struct<title, author> from a file name: 《title》作者：author, title[author] or title - author."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]{1,5}$", "")
    quoted = r"^《(.+?)》\s*(?:作者[:：]\s*(.+))?$"
    boxed = r"^(.+?)\s*[\[［【](.+?)[\]］】]$"
    dashed = r"^(.+) - (.+)$"

    def guess(pattern: str) -> Column:
        return F.when(stem.rlike(pattern), F.struct(collapse(F.regexp_extract(stem, pattern, 1)).alias("title"), collapse(F.regexp_extract(stem, pattern, 2)).alias("author")))

    return F.coalesce(guess(quoted), guess(boxed), guess(dashed), F.struct(collapse(stem).alias("title"), F.lit(None).cast("string").alias("author")))


def labelled_lines(text: str = "text") -> Column:
    """struct<title, author> from labels in the first eight lines; of several the last counts."""
    head = F.slice(lines(normal_newlines(F.coalesce(text, F.lit("")))), 1, 8)

    def last(pattern: str) -> Column:
        hits = F.filter(F.transform(head, lambda x: F.regexp_extract(x, pattern, 1)), lambda v: v != "")
        return collapse(F.get(hits, F.size(hits) - 1))

    return F.struct(last(r"(?i)^\s*(?:title|书名|標題|标题)\s*[:：]\s*(.+)$").alias("title"), last(r"(?i)^\s*(?:author|作者)\s*[:：]\s*(.+)$").alias("author"))


def metadata_guess(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """``docs`` with ``title`` and ``author``: labelled lines before the file name."""
    by_name, by_label = file_name_guess(F.col(name)), labelled_lines(text)
    return docs.withColumns({"title": F.coalesce(by_label["title"], by_name["title"]), "author": F.coalesce(by_label["author"], by_name["author"])})
