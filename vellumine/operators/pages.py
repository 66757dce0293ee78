"""Pages as pictures: their size from the first bytes, their place in a viewport, the side of a spread that they take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine.functions.text import let

#: Pixels of a side and of a picture at most; fixed values.
MAX_SIDE, MAX_PIXELS = 32_768, 32_000_000
#: Markers of a JPEG: frames that tell a size, markers without a length, ends of what can be read. Fixed values.
FRAMES = tuple(m for m in range(0xC0, 0xD0) if m not in (0xC4, 0xC8, 0xCC))
BARE, LAST = (0x01, *range(0xD0, 0xD9)), (0xD9, 0xDA)


def number(content: Column, at, n: int, little: bool = False) -> Column:
    """The unsigned number in ``n`` bytes from the offset ``at`` on, counted from 0; null past the end."""
    at = F.lit(at) if isinstance(at, int) else at
    whole = F.hex(F.substring(content, at + 1, F.lit(n)))
    if little:
        whole = F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(n))])
    return F.when(F.length(whole) == 2 * n, F.conv(whole, 16, 10).cast("long"))


def _jpeg(content: Column) -> Column:
    """struct<w, h> of a JPEG: a walk over its segments, each of which tells where the next begins; at most as many steps as there are bytes 255."""
    steps = F.regexp_count(F.decode(content, "ISO-8859-1"), F.lit("\\xFF"))
    state = lambda at, w, h, over: F.struct(at.cast("long").alias("at"), w.cast("long").alias("w"), h.cast("long").alias("h"), over.alias("over"))
    none = F.lit(None)

    def step(s: Column, _: Column) -> Column:
        return let(F.struct(number(content, s["at"].cast("int"), 1).alias("mark"), number(content, s["at"].cast("int") + 1, 1).alias("next"), number(content, s["at"].cast("int") + 2, 2).alias("size")), lambda r: chosen(s, r))

    def chosen(s: Column, r: Column) -> Column:
        mark, next_, size = r["mark"], r["next"], r["size"]
        h, w = (number(content, s["at"].cast("int") + k, 2) for k in (5, 7))
        return (
            F.when(s["over"], s)
            .when(F.coalesce(mark != 0xFF, F.lit(True)) | next_.isNull(), state(s["at"], none, none, F.lit(True)))
            .when(next_ == 0xFF, state(s["at"] + 1, none, none, F.lit(False)))
            .when(next_.isin(*FRAMES), state(s["at"], w, h, F.lit(True)))
            .when(next_.isin(*BARE), state(s["at"] + 2, none, none, F.lit(False)))
            .when(next_.isin(*LAST) | size.isNull() | (size < 2), state(s["at"], none, none, F.lit(True)))
            .otherwise(state(s["at"] + 2 + size, none, none, F.lit(False)))
        )

    return F.aggregate(F.sequence(F.lit(1), F.greatest(steps, F.lit(1))), state(F.lit(2), none, none, F.lit(False)), step, lambda s: F.struct(s["w"].alias("w"), s["h"].alias("h")))


def picture_size(content: Column) -> Column:
    """struct<format, width, height, reason> of PNG, GIF, WebP and JPEG bytes; ``reason``: undecodable, or invalid_geometry (nothing, too long a side, too many pixels)."""
    head = lambda hexed, at=0: F.hex(F.substring(content, F.lit(at + 1), F.lit(len(hexed) // 2))) == hexed
    webp = lambda kind: head("52494646") & head("57454250" + kind, 8)
    size = lambda w, h: F.struct(w.alias("w"), h.alias("h"))
    n = lambda at, k, little=True: number(content, at, k, little)
    bits = n(21, 4)
    found = (
        F.when(head("89504E470D0A1A0A"), F.struct(F.lit("png").alias("format"), size(n(16, 4, False), n(20, 4, False)).alias("s")))
        .when(head("474946383761") | head("474946383961"), F.struct(F.lit("gif").alias("format"), size(n(6, 2), n(8, 2)).alias("s")))
        .when(webp("56503820"), F.struct(F.lit("webp").alias("format"), size(n(26, 2) % 16384, n(28, 2) % 16384).alias("s")))
        .when(webp("5650384C"), F.struct(F.lit("webp").alias("format"), size(bits % 16384 + 1, F.shiftright(bits, 14) % 16384 + 1).alias("s")))
        .when(webp("56503858"), F.struct(F.lit("webp").alias("format"), size(n(24, 3) + 1, n(27, 3) + 1).alias("s")))
        .when(head("FFD8"), F.struct(F.lit("jpeg").alias("format"), _jpeg(content).alias("s")))
    )

    def told(f: Column) -> Column:
        w, h = f["s"]["w"], f["s"]["h"]
        bad = (w == 0) | (h == 0) | (w > MAX_SIDE) | (h > MAX_SIDE) | (w * h > MAX_PIXELS)
        reason = F.when(w.isNull() | h.isNull(), "undecodable").when(bad, "invalid_geometry")
        return F.struct(f["format"].alias("format"), F.when(reason.isNull(), w).alias("width"), F.when(reason.isNull(), h).alias("height"), reason.alias("reason"))

    return let(found, told)


def placed(width: Column, height: Column, room: tuple[float, float], mode: Column, scale: Column, pan: tuple[Column, Column]) -> Column:
    """struct<x, y, width, height, clipped>: a page in a viewport of ``room``, centred and moved by ``pan``; null where no size or scale is left.

    ``mode``: Fit shows it whole, Fill leaves no margin, ActualSize takes a
    pixel as it is.
    """
    sx, sy = F.lit(room[0]) / width, F.lit(room[1]) / height
    by = F.when(mode == "Fit", F.least(sx, sy)).when(mode == "Fill", F.greatest(sx, sy)).otherwise(1.0) * scale
    w, h = width * by, height * by
    x, y = (room[0] - w) / 2 + pan[0], (room[1] - h) / 2 + pan[1]
    clipped = (x < 0) | (y < 0) | (x + w > room[0]) | (y + h > room[1])
    return F.when((width > 0) & (height > 0) & (by > 0), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"), clipped.alias("clipped")))


def effective_side(own: Column, sibling: Column, slot: Column, members: Column, index: Column, rtl: Column) -> Column:
    """The side of a spread that a page takes: its own, the other of its sibling's, that of its slot; a first page alone stands where reading begins, any other in the centre."""
    opposite = F.when(sibling == "left", "right").when(sibling == "right", "left").otherwise(sibling)
    by_slot = F.when((slot == 0) != rtl, "left").otherwise("right")
    alone = F.when(index == 0, F.when(rtl, "left").otherwise("right")).otherwise("center")
    return F.coalesce(own, F.when(members == 2, F.coalesce(opposite, by_slot)).otherwise(alone))


def in_conflict(side: Column, hint: Column) -> Column:
    """Whether a page's side and its hint exclude each other: centred and in a pair, or on a side and alone."""
    return F.coalesce(((side == "center") & (hint == "pair")) | (side.isin("left", "right") & (hint == "single")), F.lit(False))
