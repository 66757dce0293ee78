"""Compatibility planning: features of documents against what formats can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("EPUB3", "KF7", "KF8", "KFX")
#: Level of each feature by format in FORMATS' order; fixed values.
LEVELS = {
    "Text": ("Native", "Native", "Native", "Native"),
    "Heading": ("Native", "Native", "Native", "Native"),
    "Navigation": ("Native", "Compatible", "Compatible", "Native"),
    "Image": ("Native", "Compatible", "Native", "Native"),
    "Svg": ("Native", "Approximate", "Native", "Native"),
    "EmbeddedFont": ("Native", "Approximate", "Native", "Native"),
    "Ruby": ("Native", "Approximate", "Compatible", "Native"),
    "Math": ("Native", "Approximate", "Approximate", "Native"),
    "VerticalWriting": ("Native", "Unsupported", "Compatible", "Native"),
    "ComplexTable": ("Native", "Flattenable", "Compatible", "Compatible"),
    "Float": ("Native", "Flattenable", "Compatible", "Native"),
    "FixedPosition": ("Native", "Flattenable", "Compatible", "Native"),
    "FixedLayout": ("Native", "Flattenable", "Compatible", "Native"),
    "Footnote": ("Native", "Approximate", "Compatible", "Native"),
    "Endnote": ("Native", "Approximate", "Compatible", "Native"),
    "PageBreak": ("Native", "Native", "Native", "Native"),
    "DropCap": ("Native", "Approximate", "Compatible", "Native"),
    "Poetry": ("Native", "Compatible", "Compatible", "Native"),
    "Aside": ("Native", "Approximate", "Compatible", "Native"),
    "Link": ("Native", "Compatible", "Native", "Native"),
    "SemanticStructure": ("Native", "Compatible", "Native", "Native"),
}
#: What a plan makes of a feature, by rank, and the overall quality of a plan with it; fixed values.
OUTCOMES = ("Exact", "Equivalent", "CompatibleApproximation", "StructuralFallback", "Drop")
OVERALL = ("Exact", "High", "Compatible", "Reduced", "SevereLoss")
#: The worst outcome that a mode allows.
MODES = {"strict": 1, "compatible": 3, "readable": 4}
#: The feature of a tag; other tags have none.
TAG_FEATURES = {"h1": "Heading", "h2": "Heading", "h3": "Heading", "img": "Image", "svg": "Svg", "ruby": "Ruby", "math": "Math", "table": "ComplexTable", "nav": "Navigation", "aside": "Aside", "a": "Link", "p": "Text", "li": "Text"}


def capabilities(spark: SparkSession) -> DataFrame:
    """(feature, format, level): the whole matrix, a table of fixed size."""
    return spark.createDataFrame([(f, fmt, row[i]) for f, row in LEVELS.items() for i, fmt in enumerate(FORMATS)], "feature string, format string, level string")


#: What comes of a feature step by step, by rank; fixed values. Features that are not named have the last chain.
CHAINS = {
    ("Ruby",): ((0, "native ruby"), (1, "inline parenthetical annotation"), (2, "plain base text plus annotation"), (4, "base text only")),
    ("Math",): ((0, "native MathML"), (2, "accessible mathematical text fallback"), (4, "alt text only")),
    ("Svg",): ((0, "native SVG"), (2, "deterministic raster image"), (3, "fallback image or alt text"), (4, "drop only without readable fallback")),
    ("EmbeddedFont",): ((0, "native embedded font"), (1, "compatible font encoding"), (2, "generic font family"), (4, "reader default font")),
    ("ComplexTable",): ((0, "native table"), (1, "simplified table"), (3, "linearized rows and cells"), (4, "plain structured text")),
    ("Float", "FixedPosition", "FixedLayout"): ((0, "native geometry"), (1, "simplified target layout"), (3, "inline flow order"), (4, "drop unsupported decoration only")),
    ("VerticalWriting",): ((0, "native vertical writing"), (2, "horizontal writing with preserved direction"), (4, "plain horizontal text")),
    ("Footnote", "Endnote"): ((0, "native note relation"), (1, "linked note marker"), (2, "legacy linked note marker"), (4, "note marker only")),
    ("DropCap",): ((0, "native drop cap"), (2, "first-letter compatible styling"), (4, "ordinary paragraph text")),
    (): ((0, "native target representation"), (1, "compatible target representation"), (2, "target-compatible visual approximation"), (3, "semantic structural fallback"), (4, "drop only as a last resort")),
}
#: The representation by feature where a target approximates or flattens; null: for others. Fixed values.
APPROXIMATE = {"Svg": "rasterized image, then accessible alt text", "Ruby": "inline annotation approximation", "Math": "accessible mathematical text fallback", "EmbeddedFont": "generic family with retained weight/style", "Footnote": "legacy linked note marker", "Endnote": "legacy linked note marker", "DropCap": "first-letter compatible styling", None: "target-compatible visual approximation"}
FLATTENED = {"ComplexTable": "linearized rows and cells", "Float": "inline flow order", "FixedPosition": "inline flow order", "FixedLayout": "reflowable document order", None: "structural semantic fallback"}


def chain(feature: Column) -> Column:
    """array<struct<rank, representation>>: the steps of a feature, best first."""
    steps = {f: F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(x).alias("representation")) for r, x in steps]) for f, steps in CHAINS.items()}
    found = F.when(F.lit(False), steps[()])
    for names, value in steps.items():
        if names:
            found = found.when(feature.isin(*names), value)
    return found.otherwise(steps[()])


def choice(feature: Column, level: Column, bare: Column, readable: Column, structural: Column, strip_fonts: bool = False, rasterize: bool = False) -> Column:
    """struct<rank, fallback, reason, alternatives>: what a target makes of a feature, the first rule that fits."""

    def told(rank: int, fallback, reason: str, *alternatives: str) -> Column:
        more = F.array(*[F.lit(a) for a in alternatives]) if alternatives else F.array().cast("array<string>")
        return F.struct(F.lit(rank).alias("rank"), (F.lit(fallback) if isinstance(fallback, str) else fallback).alias("fallback"), F.lit(reason).alias("reason"), more.alias("alternatives"))

    def by_feature(table: dict) -> Column:
        return F.coalesce(F.create_map(*[F.lit(v) for f, x in table.items() if f for v in (f, x)])[feature], F.lit(table[None]))

    svg, absent = feature == "Svg", level == "Unsupported"
    placeholder = "deterministic accessible image placeholder"
    return (
        F.when((feature == "EmbeddedFont") & F.lit(strip_fonts), told(2, "generic family with retained weight/style", "embedded font stripping was requested explicitly"))
        .when(level == "Native", told(0, "native target representation", "target natively expresses the semantic feature"))
        .when(level == "Compatible", told(1, "compatible target representation", "target representation differs internally but preserves reading meaning"))
        .when(svg & level.isin("Approximate", "Unsupported") & bare, told(3, placeholder, "the SVG has no alt text and a binary rasterizer is not enabled", "enable a future deterministic rasterizer"))
        .when(absent & (feature == "VerticalWriting"), told(2, "horizontal writing with preserved direction", "the target has no vertical writing primitive, so reading order and text are retained", "drop unsupported decoration"))
        .when(absent & svg, told(3, "accessible alt text or deterministic image placeholder", "the target cannot embed SVG directly", "drop unsupported decoration"))
        .when(absent & (feature == "FixedLayout"), told(3, "reflowable document order", "the target cannot express fixed-page geometry", "drop unsupported decoration"))
        .when(svg & (level == "Approximate"), told(2, "accessible alt text fallback", "a deterministic rasterizer is not enabled, so the image meaning is retained through alt text", "deterministic raster image when a rasterizer is available"))
        .when(level == "Approximate", told(2, by_feature(APPROXIMATE), "the target cannot retain every presentation detail, but a verified compatible form exists", "plain semantic text"))
        .when((level == "Flattenable") | structural, told(3, by_feature(FLATTENED), "the target cannot express the original layout, so readable structure is retained", "simplified native layout", "plain structured text"))
        .when(readable | F.lit(rasterize), told(2, "semantic text fallback", "a readable fallback is available even though native target support is absent", "drop feature"))
        .otherwise(told(4, "drop only as a last resort", "no readable target representation was found"))
    )


def requests(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, feature, bare, n): the features that a page's tags ask for; ``bare`` drawings have no text in their place."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<[a-z][a-z0-9]*(?:[^<>\"']|\"[^\"]*\"|'[^']*')*"), F.lit(0))
    names = F.create_map(*[F.lit(v) for pair in TAG_FEATURES.items() for v in pair])
    each = F.transform(found, lambda t: F.struct(names[F.lower(F.regexp_extract(t, "^<([A-Za-z0-9]+)", 1))].alias("feature"), (~t.rlike("(?i)aria-label\\s*=\\s*[\"'][^\"']")).alias("bare")))
    told = pages.select(key, F.inline(F.filter(each, lambda x: x["feature"].isNotNull())))
    return told.select(key, "feature", ((F.col("feature") == "Svg") & F.col("bare")).alias("bare")).groupBy(key, "feature", "bare").agg(F.count("*").alias("n"))


def plan(asked: DataFrame, mode: str = "compatible", key: str = "page_id") -> DataFrame:
    """(key, format, n_items, worst, overall, blocked) and a count of each outcome.

    The matrix is broadcast (fixed size); a feature that it lacks is
    unsupported.
    """
    matrix = capabilities(asked.sparkSession)
    formats = F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format")
    each = asked.select("*", formats).join(F.broadcast(matrix), ["feature", "format"], "left")
    readable = F.col("feature").isin("Ruby", "Footnote") | ((F.col("feature") == "Svg") & ~F.col("bare"))
    structural = F.col("feature").isin("ComplexTable", "Float", "FixedPosition", "FixedLayout")
    each = each.withColumn("rank", choice(F.col("feature"), F.coalesce("level", F.lit("Unsupported")), F.col("bare"), readable, structural)["rank"])
    counts = [F.sum(F.when(F.col("rank") == i, F.col("n")).otherwise(0)).alias(f"n_{name.lower()}") for i, name in enumerate(OUTCOMES)]
    worst = F.max("rank")
    out = each.groupBy(key, "format").agg(F.sum("n").alias("n_items"), worst.alias("worst"), *counts)
    names = F.array(*[F.lit(x) for x in OVERALL])
    return out.withColumn("overall", F.element_at(names, F.col("worst") + 1)).withColumn("blocked", F.col("worst") > MODES[mode])
