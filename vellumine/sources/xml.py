"""XML as rows: one for each element and text, by a streaming parser; what the elements mean is left to column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements and texts of a document at most; one with more is refused.
MAX_NODES = 2_000_000
#: Rows of a frame that ``elements`` hands over; a document is handled whole.
FRAME_ROWS = 4000
SCHEMA = "path array<int>, tag string, above array<string>, attrs map<string,string>, text string, reason string, holds array<string>"


def _rows(content: bytes | str | None, most: int) -> list[tuple]:
    """(path, tag, tags above, attributes, text, reason, tags right below) in document order; names without prefix and in lower case. One row with a reason if it cannot be read."""
    out: list[tuple] = []
    tags: list[str] = []
    path: list[int] = []
    counts = [-1]
    held: list[str] = []
    holds: list[dict] = []

    def add(tag: str, attrs: dict | None, text: str | None) -> None:
        if len(out) >= most:
            raise OverflowError
        counts[-1] += 1
        if holds:
            holds[-1][tag] = None
        out.append(([*path, counts[-1]], tag, list(tags), attrs, text, None, None if attrs is None else {}))

    def flush() -> None:
        if held and tags:
            add("#text", None, "".join(held))
        held.clear()

    def start(name: str, attrs: dict) -> None:
        flush()
        local = name.rpartition(":")[2].lower()
        add(local, {k.rpartition(":")[2].lower(): v for k, v in attrs.items()}, None)
        path.append(counts[-1])
        counts.append(-1)
        tags.append(local)
        holds.append(out[-1][6])

    def end(_: str) -> None:
        flush()
        path.pop()
        counts.pop()
        tags.pop()
        holds.pop()

    def refuse(*_) -> None:
        raise ValueError("entity")

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler, parser.EntityDeclHandler = start, end, held.append, refuse
    try:
        parser.Parse(content or "", True)
    except expat.ExpatError as error:
        return [([], "", [], None, None, f"xml:{expat.ErrorString(error.code)}", None)]
    except OverflowError:
        return [([], "", [], None, None, "too_many_nodes", None)]
    except ValueError:
        return [([], "", [], None, None, "declares_entities", None)]
    return [(*r[:6], None if r[6] is None else list(r[6])) for r in out]


def elements(books: DataFrame, key: str = "book_id", content: str = "content", most: int = MAX_NODES) -> DataFrame:
    """(key, path, tag, above, attrs, text, reason, holds) of the documents in ``content`` (text or bytes).

    ``path`` holds the ordinals from the root (``[0]``), ``above`` the tags
    around a node, outermost first, ``holds`` the tags right below an element,
    each once; texts have the tag ``#text``. A document
    that is not well formed, declares entities, or has more than ``most``
    nodes has one row, which says so in ``reason``.
    """
    names = [key, *(c.split()[0] for c in SCHEMA.split(", "))]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for k, body in zip(frame[key], frame[content]):
                rows += [(k, *r) for r in _rows(body, most)]
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    kind = books.schema[key].dataType.simpleString()
    return books.select(F.col(key), F.col(content)).mapInPandas(read, f"{key} {kind}, {SCHEMA}")
