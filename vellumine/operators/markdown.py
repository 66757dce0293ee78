"""Markdown as rows: blocks, inlines, footnotes, front matter, navigation.

A line's class (what it could begin or continue) is one sign, so that a text
is a short string of signs and one regular expression over it cuts the blocks;
another one cuts a run of text into inlines. What is nested (quotes, marks
within marks) is cut again, level by level. A node's path orders the nodes;
node ids follow from the order in which they are made: an item, a row and a
cell come after what they hold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from vellumine.functions.text import WS, ascii_lower, let, lines, normal_newlines, utrim
from vellumine.session import checkpointed

#: Beyond the parts of a path that count inlines: nested lists and footnotes come after them; the end of a node's own children.
AFTER, END = 1 << 30, (1 << 31) - 1
#: Line classes, tried in this order: blank, footnote, heading, fence, rule, quote, bullet, number, tag line, tag, indented item, other.
CLASSES = "BFHCUQLMrtlo"
_W = WS.removesuffix("+")
_CELL = rf"{_W}*-+(?:{_W}+-+)?{_W}*"
#: A row of dashes between bars.
SEPARATOR = rf"^{_W}*\|*{_CELL}(?:\|{_CELL})*\|*{_W}*$"
_PATTERNS = {
    "B": rf"^{_W}*$",
    "H": rf"^{_W}*#{{1,6}} ",
    "C": rf"^{_W}*```",
    "U": rf"^{_W}*(?:---|\*\*\*|___){_W}*$",
    "Q": rf"^{_W}*>",
    "L": rf"^(?![ \t]){_W}*[-*+] ",
    "M": rf"^(?![ \t]){_W}*[0-9]+\. ",
    "r": rf"(?s)^{_W}*<.*>{_W}*$",
    "t": rf"^{_W}*<",
    "l": rf"^{_W}*(?:[-*+] |[0-9]+\. )",
}
FOOTNOTE = rf"(?s)^{_W}*\[\^((?:(?!\]:).)*)\]:(.*)$"


def _signs(classes: str, bar: tuple = (0, 1), ruled: tuple = (0, 1)) -> str:
    """The signs of lines of some classes, with or without a bar, with or without a separator below."""
    return "".join(chr(0x100 + 4 * CLASSES.index(c) + 2 * b + s) for c in classes for b in bar for s in ruled)


_TABLE, _MORE = _signs("rtlo", (1,), (1,)), _signs("Fto", (0, 1), (0,)) + _signs("Fto", (0,), (1,))
_TEXT = CLASSES.replace("B", "")
#: A block of signs, the alternatives in the order in which they are tried.
BLOCK = "|".join(
    [
        f"[{_signs('BFHU')}]",
        f"[{_signs('C')}][^{_signs('C')}]*+[{_signs('C')}]?",
        f"[{_signs('Q')}]++",
        f"[{_signs('L')}][{_signs('Ll')}]*+",
        f"[{_signs('M')}][{_signs('Ml')}]*+",
        f"[{_TABLE}].[{_signs(_TEXT, (1,))}]*+",
        f"[{_signs('r')}][{_signs('rt')}]*+",
        f"[{_signs(_TEXT)}][{_MORE}]*+",
    ]
)


def _sign(line: Column, below: Column) -> Column:
    found = F.when(line.rlike(_PATTERNS["B"]), 0).when((utrim(F.regexp_extract(line, FOOTNOTE, 1)) != ""), 1)
    for c, pattern in list(_PATTERNS.items())[1:]:
        found = found.when(line.rlike(pattern), CLASSES.index(c))
    number = found.otherwise(CLASSES.index("o")) * 4 + F.when(F.contains(line, F.lit("|")), 2).otherwise(0) + F.when(below, 1).otherwise(0)
    return F.substring(F.lit("".join(chr(0x100 + k) for k in range(4 * len(CLASSES)))), number + 1, F.lit(1))


def blocks(text_lines: Column) -> Column:
    """array<struct<kind, lines>> of an array of lines. Kinds are the classes, T for tables, R for tag lines, P for paragraphs."""
    ruled = F.transform(text_lines, lambda x: x.rlike(SEPARATOR))
    signs = let(ruled, lambda s: F.array_join(F.transform(text_lines, lambda x, i: _sign(x, F.coalesce(F.get(s, i + 1), F.lit(False)))), ""))
    kinds = {s: c for c in "BFHCUQLM" for s in _signs(c)} | {s: "P" for s in _signs("tlo")} | {s: "R" for s in _signs("r")} | {s: "T" for s in _TABLE}
    names = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    # a mark for each line: the kind where a block begins, else a blank
    marks = F.array_join(F.transform(F.regexp_extract_all(signs, F.lit(BLOCK), F.lit(0)), lambda b: F.concat(names[F.left(b, F.lit(1))], F.repeat(F.lit(" "), F.length(b) - 1))), "")
    marked = let(F.split(marks, ""), lambda m: F.array_join(F.transform(text_lines, lambda x, i: F.concat(F.get(m, i), x)), "\n"))
    # no line holds a line end, so a block begins at a kind behind one and nowhere else
    each = F.filter(F.split(marked, r"\n(?=[A-Z])"), lambda b: (b != "") & ~F.startswith(b, F.lit("B")))
    return F.transform(each, lambda b: F.struct(F.left(b, F.lit(1)).alias("kind"), F.split(F.substring(b, F.lit(2), F.length(b)), "\n ").alias("lines")))


def front_matter(text_lines: Column) -> Column:
    """How many lines the front matter takes with both its delimiters; 0 if there is none, -1 if it is not closed."""
    rest = F.slice(text_lines, F.lit(2), F.size(text_lines))
    end = F.array_position(F.transform(rest, lambda x: utrim(x).isin("---", "...")), F.lit(True))
    return F.when(utrim(F.get(text_lines, F.lit(0))) == "---", F.when(end > 0, end + 1).otherwise(-1)).otherwise(0).cast("int")


def _body(text_lines: Column) -> Column:
    return let(F.greatest(front_matter(text_lines), F.lit(0)), lambda n: F.slice(text_lines, n + 1, F.size(text_lines)))


def levels(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """``first`` and what ``step`` makes of each level until one is empty. Each level is a checkpoint."""
    found = [checkpointed(first)]
    while not found[-1].isEmpty():
        found.append(checkpointed(step(found[-1])))
    return found[:-1] or found


def _split(texts: DataFrame, key: str) -> DataFrame:
    """(key, path, kind, lines) of the blocks of ``texts`` (key, path, lines)."""
    each = texts.select(key, "path", F.posexplode(blocks(F.col("lines"))).alias("i", "b"))
    return each.select(key, F.concat("path", F.array("i")).alias("path"), "b.kind", "b.lines")


def all_blocks(books: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """(key, path, kind, lines) of every block, those in quotes too; a quote begins anew behind its mark."""
    whole = lines(normal_newlines(F.coalesce(F.col(text), F.lit(""))))
    start = books.select(key, F.array().cast("array<int>").alias("path"), whole.alias("l")).select(key, "path", _body(F.col("l")).alias("lines"))

    def inner(level: DataFrame) -> DataFrame:
        unmarked = F.transform("lines", lambda x: F.regexp_replace(x, rf"^{_W}*>{_W}*", ""))
        quoted = level.where("kind = 'Q'").select(key, "path", lines(F.array_join(unmarked, "\n")).alias("l"))
        return _split(quoted.select(key, "path", _body(F.col("l")).alias("lines")), key)

    return reduce(DataFrame.unionByName, levels(_split(start, key), inner))


#: Inlines that are more than text, in the order in which they are tried; and the texts between them.
MARKS = {
    "note": r"\[\^[^\]]+\]",
    "image": r"!\[(?:(?!\]\().)*\]\([^)]*\)",
    "link": r"\[(?:(?!\]\().)*\]\([^)]*\)",
    "strong": r"\*\*(?!\*\*).+?\*\*|__(?!__).+?__",
    "strike": r"~~(?!~~).+?~~",
    "emphasis": r"\*[^*]+\*|_[^_]+_",
    "code": r"`[^`]+`",
    "tag": r"<[^>]*>",
}
_ANY = "|".join(MARKS.values())
INLINE = rf"(?s){_ANY}|(?:(?!{_ANY}).)+"
_NODE = {"strong": "Strong", "emphasis": "Emphasis", "strike": "GenericInline", "link": "Link", "note": "Footnote", "image": "Image", "code": "Code", "tag": "GenericInline", "text": "Text"}
#: Tags that an inline keeps; others are spans. Fixed values.
INLINE_TAGS = "abbr b cite div i kbd q s small span sub sup time var address main".split()


def note_anchor(reference: Column) -> Column:
    return F.regexp_replace(F.concat(F.lit("fn-"), F.regexp_replace(reference, r"[^A-Za-z0-9\-_]", "-")), "-+$", "")


def note_label(reference: Column) -> Column:
    """A number without leading zeros, anything else as it is."""
    digits = F.regexp_extract(reference, r"^\+?0*([0-9]+)$", 1)
    return F.when((digits != "") & (F.length(digits) < 20), digits).otherwise(reference)


def inlines(runs: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, path, kind, tag, text, href, alt, label) of the inlines of ``runs`` (key, path, s), nested ones too."""

    def cut(level: DataFrame) -> DataFrame:
        each = level.where("s <> ''").select(key, "path", F.posexplode(F.regexp_extract_all("s", F.lit(INLINE), F.lit(0))).alias("i", "x"))
        kind = F.when(F.lit(False), "")
        for name, pattern in MARKS.items():
            kind = kind.when(F.col("x").rlike(f"(?s)^(?:{pattern})$"), name)
        each = each.select(key, F.concat("path", F.array("i")).alias("path"), "x", kind.otherwise("text").alias("k"))
        n = F.length("x")
        sides = F.when(F.col("k").isin("strong", "strike"), 2).when(F.col("k").isin("emphasis", "code"), 1)
        at = F.instr("x", "](")
        opened = F.when(F.col("k") == "image", 3).otherwise(2)
        linked, x = F.col("k").isin("image", "link"), F.col("x")
        inner = F.when(sides.isNotNull(), F.substring(x, sides + 1, n - 2 * sides)).when(linked, F.substring(x, opened, at - opened)).when(F.col("k") == "note", F.substring(x, F.lit(3), n - 3))
        target = utrim(F.substring(x, at + 2, n - at - 2))
        return each.withColumns({"inner": inner, "target": F.when(linked, target)})

    def step(level: DataFrame) -> DataFrame:
        return cut(level.where("k IN ('strong', 'strike', 'emphasis', 'link')").select(key, "path", F.col("inner").alias("s")))

    found = reduce(DataFrame.unionByName, levels(cut(runs), step))
    k, inner, none = F.col("k"), F.col("inner"), F.lit(None).cast("string")
    name = ascii_lower(F.regexp_extract("x", "^<+/*([A-Za-z0-9]*)", 1))
    tag = F.when(k == "strike", "s").when(k == "tag", F.when(name.isin(*INLINE_TAGS), name).otherwise("span"))
    nodes = found.select(
        key,
        "path",
        F.create_map(*[F.lit(v) for pair in _NODE.items() for v in pair])[k].alias("kind"),
        tag.alias("tag"),
        F.when(k == "text", F.col("x")).alias("text"),
        F.when(k == "note", F.concat(F.lit("markdown.xhtml#"), note_anchor(inner))).otherwise(F.col("target")).alias("href"),
        F.when(k == "image", inner).alias("alt"),
        F.when(k == "text", F.col("x")).when(k == "image", inner).when(k == "tag", F.col("x")).alias("label"),
    )
    child = F.when(k == "note", note_label(inner)).otherwise(inner)
    texts = found.where("k IN ('note', 'code')").select(key, F.concat("path", F.array(F.lit(0))).alias("path"), F.lit("Text").alias("kind"), none.alias("tag"), child.alias("text"), none.alias("href"), none.alias("alt"), child.alias("label"))
    return nodes.unionByName(texts)


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _item_places(indents: pd.Series, ordered: pd.Series) -> pd.Series:
    """The path of each item of a list within it: an item belongs to the last one before it that is less indented; siblings of another indent or kind begin another list."""

    def of_list(depths, kinds):
        out, open_ = [], [[-1, [], None, 0, -1]]  # indent, path, kind of the last child, lists, items
        for depth, kind in zip(depths, kinds):
            while len(open_) > 1 and open_[-1][0] >= depth:
                open_.pop()
            top = open_[-1]
            if len(open_) > 1 and top[2] != (depth, kind):
                top[2:] = [(depth, kind), top[3] + 1, -1]
            top[4] += 1
            out.append(top[1] + ([AFTER + top[3] - 1] if len(open_) > 1 else []) + [top[4]])
            open_.append([depth, out[-1], None, 0, -1])
        return out

    return pd.Series([of_list(d, k) for d, k in zip(indents, ordered)])


def _cells(line: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(utrim(line), r"^\|+|\|+$", ""), r"\|"), utrim)


def tag_text(raw: Column) -> Column:
    """The text of a run of tags, scripts left out."""
    return utrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, "(?is)<script.*?</script>", ""), "(?is)<script.*$", ""), "(?s)<[^>]*(?:>|$)", ""))


def nodes(books: DataFrame, key: str = "book_id", text: str = "text", images: DataFrame | None = None) -> DataFrame:
    """(key, node_id, parent_id, place, path, kind, level, tag, text, href, alt, role, label) of every node.

    ``place`` counts the nodes in document order, ``node_id`` in the order in
    which they are made. An image whose local path is not among ``images``
    (key, path), or that is remote, is an empty inline; without ``images``
    every local one is taken to be there. Null and empty texts have no nodes.
    """
    found = all_blocks(books, key, text)
    kind, path, first = F.col("kind"), F.col("path"), F.get("lines", F.lit(0))

    def node(at: Column, name, level=None, tag=None, body=None, late: bool = False) -> Column:
        typed = {"level": (level, "int"), "tag": (tag, "string"), "text": (body, "string"), "label": (body, "string")}
        more = [(F.lit(None) if v is None else v if isinstance(v, Column) else F.lit(v)).cast(t).alias(c) for c, (v, t) in typed.items()]
        return F.struct(at.alias("path"), F.lit(late).alias("late"), (F.lit(name) if isinstance(name, str) else name).alias("kind"), *more)

    def below(at: Column, k) -> Column:
        return F.concat(at, F.array(F.lit(k) if isinstance(k, int) else k))

    def run(at: Column, s: Column) -> Column:
        return F.struct(at.alias("path"), s.alias("s"))

    code = F.array_join(F.filter("lines", lambda x, i: (i > 0) & ((i < F.size("lines") - 1) | ~x.rlike(_PATTERNS["C"]))), "\n")
    heading = utrim(F.regexp_replace(first, rf"^{_W}*#+ ", ""))
    # lists: an item a line; a list is as its first item
    item = F.transform("lines", lambda x: F.struct(F.length(F.replace(F.regexp_extract(x, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    "))).alias("indent"), x.rlike(rf"^{_W}*[0-9]").alias("ordered"), utrim(F.regexp_replace(x, rf"^{_W}*(?:[-*+]|[0-9]+\.) ", "")).alias("s")))
    parted = found.withColumn("items", F.when(kind.isin("L", "M"), item).otherwise(F.array().cast("array<struct<indent:int,ordered:boolean,s:string>>")))
    parted = parted.withColumn("items", F.arrays_zip(_item_places(F.col("items.indent"), F.col("items.ordered")).alias("at"), F.col("items.ordered").alias("ordered"), F.col("items.s").alias("s")))
    # tables: the header, then the rows below the separator
    rows = F.transform(F.filter("lines", lambda x, i: i != 1), _cells)

    def of_item(x: Column) -> Column:
        own = node(F.concat(path, x["at"]), "ListItem", late=True)
        opens = node(F.concat(path, F.slice(x["at"], F.lit(1), F.size(x["at"]) - 1)), F.when(x["ordered"], "OrderedList").otherwise("UnorderedList"))
        return F.when(F.element_at(x["at"], -1) == 0, F.array(opens, own)).otherwise(F.array(own))

    def of_row(cells: Column, r: Column) -> Column:
        return F.concat(F.array(node(below(path, r), "TableRow", late=True)), F.transform(cells, lambda c, i: node(below(below(path, r), i), "TableCell", late=True)))

    made = (
        F.when(kind == "H", F.array(node(path, "Heading", level=F.length(F.regexp_extract(first, r"^[^#]*(#+)", 1)))))
        .when(kind == "P", F.array(node(path, "Paragraph")))
        .when(kind == "Q", F.array(node(path, "BlockQuote")))
        .when(kind == "U", F.array(node(path, "PageBreak")))
        .when(kind == "C", F.array(node(path, "Preformatted"), node(below(path, 0), "Text", body=code)))
        .when(kind == "R", F.array(node(path, "GenericBlock", tag="raw-html"), node(below(path, 0), "Text", body=tag_text(F.array_join("lines", "\n")))))
        .when(kind.isin("L", "M"), F.flatten(F.transform("items", of_item)))
        .when(kind == "T", F.concat(F.array(node(path, "Table")), F.flatten(F.transform(rows, of_row))))
    )
    inner = (
        F.when(kind == "H", F.array(run(path, heading)))
        .when(kind == "P", F.array(run(path, F.array_join(F.transform("lines", utrim), " "))))
        .when(kind.isin("L", "M"), F.transform("items", lambda x: run(F.concat(path, x["at"]), x["s"])))
        .when(kind == "T", F.flatten(F.transform(rows, lambda cells, r: F.transform(cells, lambda c, i: run(below(below(path, r), i), c)))))
    )
    parts, runs = parted.select(key, F.inline(made)), parted.select(key, F.inline(inner))

    # footnotes: the last definition of an id, in the order of ids, behind all blocks
    note = found.where("kind = 'F'").select(key, "path", utrim(F.regexp_extract(first, FOOTNOTE, 1)).alias("id"), F.regexp_replace(F.regexp_extract(first, FOOTNOTE, 2), rf"^{_W}+", "").alias("s"))
    note = note.groupBy(key, "id").agg(F.max_by("s", "path").alias("s"))
    note = note.withColumn("path", F.array((F.row_number().over(Window.partitionBy(key).orderBy("id")) + (AFTER - 1)).cast("int")))
    notes = note.select(key, "path", F.lit(False).alias("late"), F.lit("GenericBlock").alias("kind"), F.lit("aside").alias("tag"), note_anchor(F.col("id")).alias("anchor"))

    leaves = inlines(runs.unionByName(note.select(key, "path", "s")), key).withColumn("late", F.lit(False))
    if images is not None:
        there = images.select(key, F.col("path").alias("href")).distinct().withColumn("there", F.lit(True))
        leaves = leaves.join(there, [key, "href"], "left")
    else:
        leaves = leaves.withColumn("there", F.lit(True))
    gone = (F.col("kind") == "Image") & (F.contains("href", F.lit("://")) | F.startswith("href", F.lit("data:")) | F.col("there").isNull())
    shown = {"kind": "GenericInline", "tag": "img", "href": None, "alt": None}
    leaves = leaves.withColumn("gone", gone).select(key, "path", "late", "text", "label", *[F.when(F.col("gone"), F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in shown.items()])
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [parts, notes, leaves])

    by_book = Window.partitionBy(key)
    made_at = F.when(F.col("late"), F.concat("path", F.array(F.lit(END)))).otherwise(F.col("path"))
    numbered = every.withColumn("made_at", made_at).withColumns({"node_id": F.row_number().over(by_book.orderBy("made_at")) - 1, "place": F.row_number().over(by_book.orderBy("path")) - 1})
    parents = numbered.select(key, F.col("path").alias("above"), F.col("node_id").alias("parent_id"))
    placed = numbered.withColumn("above", F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).join(parents, [key, "above"], "left")
    roles = {"Heading": "Heading", "Paragraph": "Paragraph", "BlockQuote": "Quote", "OrderedList": "List", "UnorderedList": "List", "ListItem": "List", "Preformatted": "Code", "Table": "Table", "PageBreak": "SceneBreak", "Link": "Link", "Footnote": "Footnote", "Image": "Image"}
    role = F.when(F.col("tag") == "aside", "Footnote").otherwise(F.create_map(*[F.lit(v) for pair in roles.items() for v in pair])[F.col("kind")])
    return placed.select(key, "node_id", "parent_id", "place", "path", "kind", "level", "tag", "text", "href", "alt", role.alias("role"), "label", "anchor")


def navigation(tree: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, anchor, node_id, label, in_toc, title): an anchor for each heading, in order, then for each footnote; ``title`` is the first heading that stands in no other node."""
    tree = checkpointed(tree)  # read for headings, texts and footnotes
    heads = tree.where("kind = 'Heading'").select(key, "node_id", F.col("path").alias("head"), "place")
    inside = tree.where("label IS NOT NULL").select(key, "path", "place", "label").withColumn("head", F.explode(F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda n: F.slice("path", F.lit(1), n))))
    texts = heads.select(key, "head").join(inside, [key, "head"]).groupBy(key, "head").agg(F.array_sort(F.collect_list(F.struct("place", "label"))).alias("t"))
    named = heads.join(texts, [key, "head"], "left").withColumn("label", F.coalesce(F.array_join(F.transform("t", lambda x: x["label"]), ""), F.lit("")))
    number = F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1
    toc = named.select(key, F.concat(F.lit("md-heading-"), number).alias("anchor"), "node_id", "label", F.lit(True).alias("in_toc"), "head", "place")
    title = toc.where(F.size("head") == 1).groupBy(key).agg(utrim(F.min_by("label", "place")).alias("title"))
    notes = tree.where("anchor IS NOT NULL").select(key, "anchor", "node_id", F.lit(None).cast("string").alias("label"), F.lit(False).alias("in_toc"))
    return toc.drop("head", "place").unionByName(notes).join(title, key, "left")


#: Front matter keys by the field that they set.
SINGLE = {"title": ("title",), "subtitle": ("subtitle",), "language": ("language", "lang"), "publisher": ("publisher",), "date": ("date",), "series": ("series",), "description": ("description", "summary"), "rights": ("rights", "license")}
LISTS = {"authors": ("author", "authors"), "subjects": ("keywords", "subjects"), "identifiers": ("identifier", "isbn")}
INDEX = ("series_index", "series-index")


def metadata(books: DataFrame, key: str = "book_id", text: str = "text") -> DataFrame:
    """(key, fields of SINGLE and LISTS, series_index, n_without_value, n_unknown, is_open) from the front matter of each book.

    The last of a field counts, lists grow; keys are read without case, values
    without quotes, empty ones not at all. ``is_open``: it begins and does not
    end, and is text.
    """
    whole = books.select(key, lines(normal_newlines(F.coalesce(F.col(text), F.lit("")))).alias("l")).withColumn("n", front_matter(F.col("l")))
    inside = F.when(F.col("n") > 0, F.slice("l", F.lit(2), F.col("n") - 2)).otherwise(F.array().cast("array<string>"))
    at = lambda x: F.instr(x, ":")
    pair = lambda x: F.struct(ascii_lower(utrim(F.substring(x, F.lit(1), at(x) - 1))).alias("key"), F.regexp_replace(utrim(F.substring(x, at(x) + 1, F.length(x))), "^[\"']+|[\"']+$", "").alias("value"))
    split = whole.select(key, (F.col("n") < 0).alias("is_open"), inside.alias("inside"))
    split = split.withColumns({"pairs": F.filter(F.transform(F.filter("inside", lambda x: at(x) > 0), pair), lambda p: p["value"] != ""), "n_without_value": F.size(F.filter("inside", lambda x: (at(x) == 0) & ~x.rlike(_PATTERNS["B"]))).cast("long")})

    def values(names: tuple) -> Column:
        return F.transform(F.filter("pairs", lambda p: p["key"].isin(*names)), lambda p: p["value"])

    def parted(names: tuple) -> Column:
        return F.filter(F.transform(F.flatten(F.transform(values(names), lambda v: F.split(v, ","))), utrim), lambda v: v != "")

    numbers = F.filter(F.transform(values(INDEX), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
    known = [n for names in (*SINGLE.values(), *LISTS.values(), INDEX) for n in names]
    return split.select(
        key,
        *[F.try_element_at(values(names), F.lit(-1)).alias(c) for c, names in SINGLE.items()],
        F.array_distinct(parted(LISTS["authors"])).alias("authors"),
        parted(LISTS["subjects"]).alias("subjects"),
        F.array_distinct(values(LISTS["identifiers"])).alias("identifiers"),
        F.try_element_at(numbers, F.lit(-1)).alias("series_index"),
        "n_without_value",
        F.size(F.filter("pairs", lambda p: ~p["key"].isin(*known))).cast("long").alias("n_unknown"),
        "is_open",
    )
