"""FictionBook documents: nodes, resources, metadata and contents from rows of XML.

What an element is depends on the tags around it, which every row carries:
within blocks it is a block, below the first element that is none it is
inline. Notes and binaries are met by their ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import WS, collapse

#: Elements that hold blocks; elements that are left out; block and inline kinds by tag; roles by kind or tag. Fixed values.
HOLDERS = ("section", "epigraph", "cite", "poem", "stanza", "list", "list-item")
LEFT_OUT = ("annotation", "description", "document-info", "publish-info", "title-info", "coverpage", "keywords", "sequence")
BLOCKS = {"title": "Heading", "subtitle": "Heading", "p": "Paragraph", "epigraph": "BlockQuote", "cite": "BlockQuote", "list": "UnorderedList", "list-item": "ListItem", "empty-line": "PageBreak", "image": "Image", "section": "Section"}
POETRY = ("poem", "stanza", "v", "text-author")
INLINES = {"emphasis": "Emphasis", "strong": "Strong", "a": "Link", "image": "Image", "code": "Code", "#text": "Text"}
ROLES = {"Heading": "Heading", "Paragraph": "Paragraph", "BlockQuote": "Quote", "UnorderedList": "List", "ListItem": "List", "PageBreak": "SceneBreak", "Image": "Image", "Section": "Section", "Emphasis": "Emphasis", "Strong": "Strong", "Link": "Link", "Footnote": "Footnote"}
#: Bytes of a binary at most.
MAX_BINARY = 64 << 20
END = (1 << 31) - 1


def _named(table: dict) -> Column:
    return F.create_map(*[F.lit(v) for pair in table.items() for v in pair])


def inline_text(x: Column) -> Column:
    """White space collapsed, with one space kept at an end that has some."""
    inner = F.coalesce(collapse(x), F.lit(""))
    before, after = x.rlike(rf"^{WS}"), x.rlike(rf"{WS}$")
    return F.when(inner == "", F.when(before, " ").otherwise("")).otherwise(F.concat(F.when(before, " ").otherwise(""), inner, F.when(after, " ").otherwise("")))


def _parent() -> Column:
    return F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))


def _joined_texts(said: Column) -> Column:
    """The texts of ``said`` (at, text) in order, a space between, white space collapsed."""
    return collapse(F.array_join(F.transform(F.array_sort(said), lambda x: x["text"]), " "))


def resources(elements: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, resource_id, name, media_type, kind, size, is_cover, reason) of the binaries that have an id; ``reason`` if one is not Base64 or too large. Ids are dense in document order.

    A binary meets its text by equal paths and the cover by a window of its
    book: rows that are dealt out by the key stay where they are.
    """
    attrs = F.col("attrs")
    binary = (F.col("tag") == "binary") & (attrs["id"] != "")
    body = (F.col("tag") == "#text") & (F.get("above", F.size("above") - 1) == "binary")
    page = (F.col("tag") == "image") & F.array_contains("above", "coverpage") & attrs["href"].isNotNull()
    told = elements.where(binary | body | page).select(
        key,
        F.when(body, _parent()).otherwise(F.col("path")).alias("path"),
        F.when(binary, attrs["id"]).alias("name"),
        F.when(binary, F.coalesce(attrs["content-type"], F.lit("application/octet-stream"))).alias("media_type"),
        F.when(body, F.struct(F.col("path").alias("at"), "text")).alias("body"),
        F.when(page, F.regexp_replace(attrs["href"], "^#+", "")).alias("cover"),
    )
    met = told.groupBy(key, "path").agg(F.max("name").alias("name"), F.max("media_type").alias("media_type"), F.min("body")["text"].alias("body"), F.max("cover").alias("cover"))
    first = F.min(F.when(F.col("cover").isNotNull(), F.struct("path", "cover"))).over(Window.partitionBy(key))["cover"]
    met = met.withColumn("first", first).where("name IS NOT NULL").withColumn("bytes", F.try_to_binary(F.regexp_replace(F.coalesce("body", F.lit("")), r"[\s]+", ""), F.lit("base64")))
    lower, name = F.lower("media_type"), F.lower("name")
    kind = F.when(lower.isin("image/jpeg", "image/jpg"), "Jpeg").when(lower == "image/png", "Png").when(lower == "image/gif", "Gif").when(lower == "image/svg+xml", "Svg").when(name.rlike(r"\.jpe?g$"), "Jpeg").when(name.rlike(r"\.png$"), "Png").otherwise("Unknown")
    reason = F.when(F.col("bytes").isNull(), "invalid_base64").when(F.octet_length("bytes") > MAX_BINARY, "too_large")
    number = (F.row_number().over(Window.partitionBy(key).orderBy("path")) - 1).cast("int")
    return met.select(key, number.alias("resource_id"), "name", "media_type", kind.alias("kind"), F.octet_length("bytes").cast("long").alias("size"), F.coalesce(F.col("name") == F.col("first"), F.lit(False)).alias("is_cover"), reason.alias("reason"))


def nodes(elements: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, body, node_id, path, kind, level, tag, text, href, resource, role, anchor) of the nodes of each body.

    Node ids follow the order in which nodes are made: a heading, a list and
    an item around a paragraph come after what they hold, and an image in a
    line takes two. An image without a binary is a plain inline. ``path`` is
    that of the element; an item around a paragraph shares it. Elements are
    dealt out by the key once; windows and one aggregate tell the rest, so
    that there is no join whose side Spark might broadcast.
    """
    tag, attrs, around = F.col("tag"), F.col("attrs"), F.col("around")
    inner = [h for h in HOLDERS if h != "section"]
    s = inline_text(F.col("text"))
    is_body = (F.size("path") == 2) & (tag == "body")
    is_binary = (tag == "binary") & (attrs["id"] != "")
    rows = elements.withColumn("inside", (F.size("path") > 2) & (F.get("above", F.lit(1)) == "body")).where(F.col("inside") | is_body | is_binary)
    rows = rows.withColumn("around", F.when(F.col("inside"), F.slice("above", F.lit(3), F.size("above"))).otherwise(F.array().cast("array<string>")))
    # a holder of no blocks is read as a line
    held = F.forall("around", lambda t: t.isin(*HOLDERS))
    lone = F.col("inside") & held & tag.isin(*inner) & F.forall("holds", lambda t: t.isin("#text", *LEFT_OUT))
    # the first element that holds no blocks begins a line; what is left out, images and codes hold nothing
    outer = F.array_position(F.transform("around", lambda t: ~t.isin(*HOLDERS)), F.lit(True)).cast("int")
    begins = F.when(outer > 0, F.get("around", outer - 1)).otherwise(tag)
    left = begins.isin(*LEFT_OUT) | ((outer > 0) & begins.isin("image", "empty-line")) | (held & (tag == "#text"))
    empty = lambda t: t.isin("code", "image")
    # the first code or image within a line, by its place in ``around``: in any line, and in one that a block begins
    first = F.array_position(F.transform("around", empty), F.lit(True)).cast("int")
    after = F.when(outer > 0, F.array_position(F.transform(F.slice("around", outer + 1, F.size("around")), empty), F.lit(True)).cast("int")).otherwise(first)
    later = F.when(after > 0, after + F.when(outer > 0, outer).otherwise(0)).otherwise(0)
    href = attrs["href"]
    rows = rows.select(
        key, "path", "tag", "inside", is_body.alias("is_body"), is_binary.alias("is_binary"), F.when(is_body, F.lower(F.coalesce(attrs["name"], F.lit("")))).alias("b_name"),
        F.when(tag == "#text", s).alias("s"), href.alias("href"), attrs["id"].alias("id"), attrs["name"].alias("name"), (F.lower(attrs["type"]) == "note").alias("noted"),
        held.alias("held"), F.when(lone, F.col("path")).alias("lone"), left.alias("left"), first.alias("first"), later.alias("later"), (F.get("above", F.size("above") - 1) == "list").alias("listed"),
    ).where("tag <> '#text' OR s <> ''")
    # all that follows is by the key and less beside it: rows stay where this brings them
    rows = rows.repartition(key)
    upto = Window.partitionBy(key).orderBy("path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    rows = rows.withColumns({"body": (F.count_if("is_body").over(upto) - 1).cast("int"), "b_name": F.last("b_name", True).over(upto), "lone": F.last("lone", True).over(upto), "resource_id": (F.count_if("is_binary").over(upto) - 1).cast("int")})
    rows = rows.withColumn("notes", F.max(F.when(F.col("b_name") == "notes", F.col("body"))).over(whole))
    # holders of no blocks stand in none of their kind: of those that have begun the last one counts
    lined = (F.size("path") > F.size("lone")) & (F.slice("path", F.lit(1), F.size("lone")) == F.col("lone"))
    rows = rows.withColumn("lined", F.coalesce(lined, F.lit(False))).withColumn("block", F.col("held") & ~F.col("lined"))
    stop = F.when(F.col("lined"), F.col("first")).otherwise(F.col("later"))
    gone = ~F.col("inside") | (~F.col("lined") & F.col("left")) | (stop > 0)
    # an element meets what it names: a link its note, an image its binary, a code its texts
    target = F.when(F.startswith("href", F.lit("#")), F.expr("substring(href, 2)"))
    of_code = (tag == "#text") & F.col("inside") & (stop > 0) & (F.col("lined") | ~F.col("left"))
    named = F.when(tag == "a", F.concat(F.lit("n"), target)).when(tag == "image", F.concat(F.lit("b"), F.regexp_replace("href", "^#+", "")))
    carried = ("path", "tag", "s", "href", "name", "id", "noted", "body", "notes", "block", "listed")
    nothing = F.lit(None)

    def meet(by, place, own=None, note=None, binary=None, said=None) -> Column:
        return F.struct(
            (nothing if by is None else by).cast("string").alias("by"), (nothing if place is None else place).cast("array<int>").alias("at"), (F.struct(*carried) if own else nothing).alias("own"),
            (nothing if note is None else note).cast("boolean").alias("is_note"), (nothing if binary is None else binary).cast("int").alias("resource_id"), (nothing if said is None else said).alias("said"),
        )

    say = F.struct(F.col("path").alias("at"), F.col("s").alias("text"))
    claims = F.array_compact(
        F.array(
            F.when(~gone, meet(named, F.when(named.isNull(), F.col("path")), own=True)),
            F.when(F.col("inside") & (F.col("b_name") == "notes") & (F.col("id") != ""), meet(F.concat(F.lit("n"), "id"), None, note=F.lit(True))),
            F.when(F.col("is_binary"), meet(F.concat(F.lit("b"), "id"), None, binary=F.col("resource_id"))),
            F.when(of_code, meet(None, F.slice("path", F.lit(1), stop + 2), said=say)),
        )
    )
    met = rows.select(key, F.inline(claims)).groupBy(key, "by", "at").agg(F.collect_list("own").alias("own"), F.max("is_note").alias("is_note"), F.min("resource_id").alias("resource_id"), _joined_texts(F.collect_list("said")).alias("words"))
    met = met.select(key, "is_note", "resource_id", "words", F.inline("own")).withColumn("note", target)
    is_note = (tag == "a") & ~F.col("block") & (F.coalesce("noted", F.lit(False)) | F.coalesce("is_note", F.lit(False)))
    link = F.when(is_note & F.col("note").isNotNull() & F.col("notes").isNotNull(), F.concat(F.lit("body-"), F.col("notes") + 1, F.lit(".xhtml#"), F.col("note"))).otherwise(F.coalesce("href", F.lit("")))
    lost = (tag == "image") & F.col("resource_id").isNull()
    kinds = F.when(F.col("block"), F.coalesce(_named(BLOCKS)[tag], F.lit("GenericBlock"))).otherwise(F.coalesce(_named(INLINES)[tag], F.lit("GenericInline")))
    kind = F.when(lost, "GenericInline").when(is_note, "Footnote").otherwise(kinds)
    in_list = F.col("block") & (tag == "p") & F.col("listed")
    met = met.withColumns({"kind": kind, "in_list": in_list})
    none = F.lit(None).cast("string")
    own_tag = F.when(F.col("kind").isin("GenericBlock", "GenericInline"), F.when(tag == "v", "verse").when(tag == "strikethrough", "s").otherwise(tag))
    role = F.when(F.col("block") & tag.isin(*POETRY), "Poetry").when(lost, none).when(F.col("kind") == "GenericBlock", "Generic").otherwise(_named(ROLES)[F.col("kind")])
    level = F.when(F.col("kind") == "Heading", F.when(tag == "title", 2).otherwise(3))
    anchored = F.col("block") & tag.isin("p", "epigraph", "cite", "list-item", *POETRY) | (F.col("block") & (F.col("kind") == "GenericBlock"))
    anchor = F.when(anchored, F.nullif(F.coalesce("id", "name"), F.lit("")))
    late = (F.col("kind") == "Heading") | (F.col("block") & (tag == "list"))
    weight = F.when((tag == "image") & ~F.col("block"), 2).otherwise(1)
    own = F.struct(
        F.col("path").alias("place"),
        F.when(late, F.concat("path", F.array(F.lit(END)))).otherwise(F.col("path")).alias("made"),
        "kind", level.alias("level"), own_tag.alias("tag"), F.when(tag == "#text", F.col("s")).alias("text"), F.when(F.col("kind").isin("Link", "Footnote"), link).alias("href"), F.when(F.col("kind") == "Image", F.col("resource_id")).alias("resource"), role.alias("role"), anchor.alias("anchor"), weight.alias("weight"),
    )

    def plain(place: Column, made: Column, name: str, text: Column = none, role_name: str | None = None) -> Column:
        return F.struct(place.alias("place"), made.alias("made"), F.lit(name).alias("kind"), F.lit(None).cast("int").alias("level"), none.alias("tag"), text.alias("text"), none.alias("href"), F.lit(None).cast("int").alias("resource"), F.lit(role_name).cast("string").alias("role"), none.alias("anchor"), F.lit(1).alias("weight"))

    item = plain(F.col("path"), F.concat("path", F.array(F.lit(END))), "ListItem", role_name="List")
    code = plain(F.concat("path", F.array(F.lit(0))), F.concat("path", F.array(F.lit(0))), "Text", F.coalesce("words", F.lit("")))
    made = F.when(F.col("in_list"), F.array(own, item)).when(~F.col("block") & (tag == "code"), F.array(own, code)).otherwise(F.array(own))
    each = met.select(key, "body", F.inline(made))
    before = F.sum("weight").over(Window.partitionBy(key).orderBy("made"))
    return each.select(key, "body", (before - 1).cast("long").alias("node_id"), F.col("place").alias("path"), "kind", "level", "tag", "text", "href", "resource", "role", "anchor")


#: Elements with the metadata; parts of a name in their order; elements whose texts count. Fixed values.
INFO = ("title-info", "publish-info", "document-info")
PERSON = ("first-name", "middle-name", "last-name", "nickname")
WORDED = (*PERSON, "genre", "book-title", "lang", "annotation", "keywords", "date", "publisher", "isbn")


def metadata(elements: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, title, language, authors, translators, description, subjects, date, series, series_index, publisher, isbn) of the documents that have a description.

    Elements meet their texts, names their parts and books their fields in
    three aggregates, each by the key and less beside it: rows that are dealt
    out by the key stay where they are.
    """
    tag, attrs, is_info = F.col("tag"), F.col("attrs"), lambda t: t.isin(*INFO)
    none = F.lit(None).cast("string")
    said = F.struct(F.col("path").alias("at"), "text")
    # the first element with metadata above a node: what stands below it may be a field
    begins = F.array_position(F.transform("above", is_info), F.lit(True)).cast("int")
    upto = F.filter(F.sequence(begins + 1, F.greatest(F.size("above"), begins + 1)), lambda n: F.coalesce(F.get("above", n - 1).isin(*WORDED), F.lit(False)))
    each = lambda path, name, up, series, number, text: F.struct(path.alias("path"), name.alias("tag"), up.alias("up"), series.alias("series"), number.alias("number"), text.alias("said"))
    own = each(F.col("path"), tag, F.get("above", F.size("above") - 1), attrs["name"], attrs["number"], F.lit(None).cast("struct<at:array<int>,text:string>"))
    texts = F.transform(upto, lambda n: each(F.slice("path", F.lit(1), n), none, none, none, none, said))
    rows = elements.where(F.exists("above", is_info)).select(key, F.inline(F.when(tag == "#text", texts).otherwise(F.array(own))))
    rows = rows.groupBy(key, "path").agg(*[F.max(c).alias(c) for c in ("tag", "up", "series", "number")], F.collect_list("said").alias("said")).withColumn("words", _joined_texts(F.col("said")))
    part = F.col("tag").isin(*PERSON) & F.col("up").isin("author", "translator") & F.col("words").isNotNull()
    rows = rows.select(key, "path", F.when(part, _parent()).otherwise(F.col("path")).alias("whose"), "tag", "up", "series", "number", "words", part.alias("part"))
    names = [F.min(F.when(F.col("part") & (F.col("tag") == p), F.struct("path", "words")))["words"] for p in PERSON]
    others = [F.max(F.when(~F.col("part"), F.col(c))).alias(c) for c in ("tag", "up", "series", "number", "words")]
    rows = rows.groupBy(key, "whose").agg(F.max(F.when(F.col("part"), F.col("up"))).alias("person"), F.array_join(F.array(*names), " ").alias("name"), F.max(F.col("up") == "document-info").alias("has_document"), *others)
    lists = lambda up: F.when(F.count("person") > 0, F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("person") == up, F.struct("whose", "name")))), lambda x: x["name"])))

    def first(name: str, up: str, value: str = "words") -> Column:
        here = (F.col("tag") == name) & (F.col("up") == up)
        return F.min_by(F.when(here, F.col(value)), F.when(here, F.col("whose")))

    genres = F.transform(F.array_sort(F.collect_list(F.when((F.col("tag") == "genre") & (F.col("up") == "title-info") & F.col("words").isNotNull(), F.struct("whose", "words")))), lambda x: x["words"])
    found = rows.groupBy(key).agg(
        first("book-title", "title-info").alias("title"),
        first("lang", "title-info").alias("language"),
        lists("author").alias("authors"),
        lists("translator").alias("translators"),
        first("annotation", "title-info").alias("description"),
        first("keywords", "title-info").alias("k"),
        F.array_distinct(genres).alias("g"),
        first("date", "title-info").alias("title_date"),
        first("date", "document-info").alias("document_date"),
        F.max("has_document").alias("has_document"),
        first("sequence", "title-info", "series").alias("series"),
        first("sequence", "title-info", "number").try_cast("double").alias("series_index"),
        first("publisher", "publish-info").alias("publisher"),
        first("isbn", "publish-info").alias("isbn"),
    )
    words = F.filter(F.transform(F.split(F.coalesce("k", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    subjects = F.concat(words, F.filter("g", lambda x: ~F.array_contains(words, x)))
    date = F.when(F.col("has_document"), F.col("document_date")).otherwise(F.col("title_date"))
    return found.select(key, "title", "language", "authors", "translators", "description", subjects.alias("subjects"), date.alias("date"), "series", "series_index", "publisher", "isbn")
