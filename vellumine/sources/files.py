"""Files as rows: discovery, limits, format detection, decoding."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of books that import takes; a fixed list.
IMPORT_EXTENSIONS = ("epub", "mobi", "azw", "azw3", "prc", "kfx", "txt", "text", "md", "markdown", "html", "htm", "xhtml", "htmlz", "fb2", "docx", "zip")
#: Candidates for text that is not Unicode, in the order of their names.
LEGACY = ("big5", "gb18030", "shift_jis", "windows-1252")


def files(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files under a folder, by Spark's binary reader.

    With ``most_bytes`` larger files are left out before their content is read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.where(F.col("length") <= most_bytes) if most_bytes is not None else found


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_supported(path: Column, extensions: tuple[str, ...] = IMPORT_EXTENSIONS) -> Column:
    return extension(path).isin(*extensions)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def byte_range(content: Column, offset: int, length: int) -> Column:
    return F.substring(content, offset + 1, length)


def detected_format(path: Column, content: Column) -> Column:
    """A file's format: signatures first, then markup, then its extension; ``unsupported`` if none fits.

    A ZIP has to hold what makes it an EPUB (its first entry), a DOCX or an
    HTMLZ; a file named for ZIP or text has to be that.
    """
    def starts(hexed: str) -> Column:
        return F.startswith(F.hex(F.substring(content, 1, 16)), F.lit(hexed))

    def holds(what: bytes) -> Column:
        return F.contains(content, F.lit(what))

    # The opening as text, whatever its encoding: bytes beyond ASCII count as question marks.
    pairs = F.regexp_extract_all(F.hex(F.substring(content, 1, 512)), F.lit("[0-9A-F]{2}"), F.lit(0))
    ascii_pairs = F.transform(pairs, lambda p: F.when(p.rlike("^[89A-F]|00"), "3F").otherwise(p))
    text = F.lower(F.decode(F.unhex(F.array_join(ascii_pairs, "")), "UTF-8"))
    ext = extension(path)
    epub = (F.hex(F.substring(content, 31, 8)) == b"mimetype".hex().upper()) & holds(b"application/epub+zip")
    zipped = F.when(epub, "epub").when(holds(b"[Content_Types].xml") & holds(b"word/document.xml"), "docx").when((ext == "htmlz") | holds(b"index.html"), "htmlz").otherwise("unsupported")
    marked = starts("EFBBBF") | starts("FFFE") | starts("FEFF")
    plain = F.when(marked | ~holds(b"\0") | F.contains(F.hex(F.substring(content, 1, 8)), F.lit("00")), True).otherwise(False)
    book = F.contains(text, F.lit("<fictionbook"))
    html = ext.isin("html", "htm", "xhtml") | text.rlike(r"^\s*(?:<!doctype html|<html|<head|<body)")
    # Record zero of a Palm database begins where the first entry of its list says.
    zero = F.conv(F.hex(F.substring(content, 79, 4)), 16, 10).cast("int")

    def record(offset: int) -> Column:
        return F.hex(content.substr(zero + offset + 1, F.lit(4)))

    mobi = F.when(record(16) != b"MOBI".hex().upper(), "unsupported").when(holds(b"BOUNDARY"), "kf7_kf8_combo").when((ext == "azw3") | (record(32) == "00000008"), "kf8").otherwise("kf7")
    return (
        F.when(starts("434F4E54"), "kfx")
        .when(starts("46464B4658000100"), "ffkfx")
        .when(starts("504B0304"), zipped)
        .when(ext.isin("epub", "zip"), "unsupported")
        .when(ext.isin("md", "markdown"), F.when(plain, "markdown").otherwise("unsupported"))
        .when(html & ~book, "html")
        .when((ext == "fb2") | book, F.when(F.is_valid_utf8(content.cast("string")), "fb2").otherwise("unsupported"))
        .when(ext.isin("txt", "text"), F.when(plain, "text").otherwise("unsupported"))
        .when(F.hex(F.substring(content, 61, 8)) == b"BOOKMOBI".hex().upper(), mobi)
        .otherwise("unsupported")
    )


def image_format(content: Column) -> Column:
    """png, jpeg, gif or webp by signature; null for others."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(F.startswith(head, F.lit("89504E470D0A1A0A")), "png")
        .when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
        .when(F.startswith(head, F.lit("47494638")), "gif")
        .when(head.rlike("^52494646.{8}57454250"), "webp")
    )


def _score(text: str) -> tuple[int, bool]:
    """Points for a legacy decoding, and whether its script speaks for it."""
    n = max(len(text), 1)
    if sum(ord(c) < 32 and c not in "\t\n\r\f" for c in text) * 100 > n or sum(c.isalnum() for c in text) * 100 < 35 * n:
        return -1, False
    kana = sum("぀" <= c <= "ヿ" for c in text)
    han = sum("一" <= c <= "鿿" for c in text)
    latin = sum("À" <= c <= "ɏ" for c in text)
    plain = sum(c.isascii() and c.isalpha() for c in text)
    return 50 + 2 * min(30, kana) + (8 if han * 2 > n else 0) + (2 * min(5, latin) if plain * 100 >= 45 * n else 0) - (20 if latin and han else 0), bool(kana or han * 2 > n or (latin and plain * 100 >= 45 * n))


def _decoded(data: bytes | None) -> tuple[str | None, str | None]:
    """(encoding, text) of bytes; nulls if they are no text or ambiguous."""
    if data is None:
        return None, None
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            try:
                return name, data[len(mark) :].decode(name)
            except UnicodeDecodeError:
                return None, None
    even, odd = data[0::2], data[1::2]
    if odd and len(data) % 2 == 0:
        for zeros, others, name in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
            if zeros.count(0) * 4 >= 3 * len(zeros) and others.count(0) * 10 <= len(others):
                return name, data.decode(name, "replace")
    if b"\0" in data:
        return None, None
    try:
        return "utf-8", data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    found = []
    for name in LEGACY:
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        points, speaks = _score(text)
        if points >= 0:
            found.append((points, speaks, name, text))
    found.sort(key=lambda x: (-x[0], x[2]))
    if not found or not found[0][1] or (len(found) > 1 and found[0][0] - found[1][0] < 12):
        return None, None
    return found[0][2], found[0][3]


def decoded(rows: DataFrame, content: str = "content") -> DataFrame:
    """``rows`` without ``content``, with ``encoding`` and ``text``; both null where bytes are no text.

    Marks first, then UTF-16 by its zeros, strict UTF-8, and legacy encodings
    where one leads clearly and its script speaks for it.
    """
    kept = [c for c in rows.columns if c != content]
    schema = rows.select(*kept).schema.add("encoding", "string").add("text", "string")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [_decoded(bytes(x) if x is not None else None) for x in f[content]]
            out = f[kept].copy()
            out["encoding"], out["text"] = [m[0] for m in made], [m[1] for m in made]
            yield out

    return rows.mapInPandas(decode, schema)
