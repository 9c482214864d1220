"""Text and scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a digest and its delimiters look like.
MARKER = "BOOKDATA_[0-9A-Z]{16}"
DIGEST_CHARS = 4000
#: White space as browsers see it.
WS = r"[\s﻿]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at the ends."""
    # a run is tried once, from its start, and not given back
    return F.regexp_replace(c(x), rf"(?U)^{WS}++|(?<!{WS}){WS}++$", "")


def collapsed(x: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c(x), rf"(?U){WS}+", " "))


def utf16_length(x: Column | str) -> Column:
    return (F.length(F.encode(c(x), "UTF-16LE")) / 2).cast("long")


def title_from(x: Column | str, most: int = 60) -> Column:
    """The text, or its first characters and an ellipsis."""
    s = collapsed(x)
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.left(s, F.lit(most - 3)), F.lit("…")))


def default_text(x: Column | str, default: str) -> Column:
    """A default for null and blank texts."""
    return F.coalesce(F.nullif(trimmed(x), F.lit("")), F.lit(default))


def slug(x: Column | str, default: str = "part", most: int = 48) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.left(F.when(s == "", default).otherwise(s), F.lit(most))


def half_up(x: Column | str) -> Column:
    """Rounding as floor(x + 0.5)."""
    return F.floor(c(x) + 0.5).cast("long")


def whole_seconds(x: Column | str) -> Column:
    x = c(x)
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.greatest(F.lit(0), F.floor(F.when(ok, x).otherwise(0.0)).cast("long")).cast("long")


def clock(x: Column | str) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    s = whole_seconds(x)
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def spoken(x: Column | str) -> Column:
    """Hours, minutes and seconds in words; what is zero is left out, but for 0 seconds."""
    s = whole_seconds(x)

    def unit(n: Column, name: str, zero: bool = False) -> Column:
        said = F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
        return F.when((n > 0) | ((s == 0) if zero else F.lit(False)), said)

    return F.concat_ws(" ", unit(F.floor(s / 3600).cast("long"), "hour"), unit(F.floor((s % 3600) / 60).cast("long"), "minute"), unit(s % 60, "second", True))


def duration(x: Column | str) -> Column:
    """1h 02m 03s, or 2m 03s."""
    s = c(x).cast("long")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor((s % 3600) / 60).cast("long"), s % 60
    return F.when(h > 0, F.format_string("%dh %02dm %02ds", h, m, r)).otherwise(F.format_string("%dm %02ds", m, r))


def clamped(x: Column | str, most: Column | float) -> Column:
    """Into 0 to most; 0 for what isn't a finite number."""
    x = c(x)
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    most = most if isinstance(most, Column) else F.lit(float(most))
    return F.when(ok, F.least(F.greatest(x, F.lit(0.0)), most)).otherwise(0.0)


def snapped(x: Column | str, pitch: float, most: float) -> Column:
    return F.least(F.floor(c(x) / pitch + 0.5) * pitch, F.lit(float(most)))


def without_markers(x: Column | str) -> Column:
    """Without delimiters: whole lines of them go, then those within lines, then what blanks they leave."""
    lines = F.filter(F.split(c(x), "\n", -1), lambda l: ~l.rlike(rf"(?U)^\s*(?:{MARKER}\s*)+$"))
    s = F.regexp_replace(F.array_join(lines, "\n"), MARKER, "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)(?<![^\S\n])[^\S\n]++\n", "\n"), r"\n{3,}", "\n\n")
    return trimmed(s)


def last_place(x: Column, mark: str) -> Column:
    """Characters before the last place of a mark, or -1."""
    back = F.locate(mark[::-1], F.reverse(x))
    return F.when(back > 0, F.length(x) - back - len(mark) + 1).otherwise(-1)


def once(x: Column, then) -> Column:
    """then(x) with x as a lambda's variable: however often it is used, x is computed once."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def digest(x: Column | str, most: int = DIGEST_CHARS) -> Column:
    """A stored digest: no delimiters, and cut at the last boundary past the middle if it is too long."""
    def end(head: Column) -> Column:
        """How much of the head stays: up to the last blank line, line, sentence end or space past the middle, else all."""
        places = [last_place(head, "\n\n"), last_place(head, "\n"), last_place(F.translate(head, "!?", ".."), "."), last_place(head, " ")]
        return F.coalesce(*[F.when(at > most / 2, at + 1) for at in places], F.lit(most))

    short = lambda head: F.concat(trimmed(F.left(head, end(head))), F.lit("…"))
    return once(without_markers(x), lambda clean: F.when(F.length(clean) <= most, clean).otherwise(once(F.left(clean, F.lit(most)), short)))


def fenced(token: Column, body: Column) -> Column:
    return F.concat_ws("\n", token, body, token)


def href_path(x: Column | str) -> Column:
    """A link without fragment and leading ./ or /."""
    return F.regexp_replace(F.substring_index(c(x), "#", 1), r"^\.?/", "")


def unescaped(x: Column | str) -> Column:
    """A link with its percent escapes decoded, or as it is if one of them is none; a plus sign stays one."""
    return F.coalesce(F.try_url_decode(F.replace(c(x), F.lit("+"), F.lit("%2B"))), c(x))


def href_fragment(x: Column | str) -> Column:
    """The decoded fragment, null if there is none."""
    raw = F.when(F.instr(c(x), "#") > 0, F.regexp_replace(c(x), "^[^#]*#", ""))
    return F.nullif(unescaped(raw), F.lit(""))


def normal_path(x: Column | str) -> Column:
    """A path with . and .. taken out."""
    def step(a: Column, p: Column) -> Column:
        back = (p == "..") & (F.size(a) > 0)
        return F.when(p.isin("", "."), a).when(back, F.slice(a, 1, F.size(a) - 1)).when(p == "..", a).otherwise(F.concat(a, F.array(p)))

    return F.array_join(F.aggregate(F.split(c(x), "/"), F.array().cast("array<string>"), step), "/")


def word_at(x: Column | str, place: Column) -> Column:
    """The word around a place between characters."""
    left = F.regexp_extract(F.left(c(x), place), r"\S*\z", 0)
    return F.concat(left, F.regexp_extract(F.substring(c(x), place + 1, F.length(c(x))), r"^\S*", 0))


def byte_range(header: Column | str, size: Column) -> Column:
    """(offset, length) that a header bytes=a-b, bytes=a- or bytes=-n asks for, or null."""
    h = c(header)
    a, b = (F.nullif(F.regexp_extract(h, r"^bytes=(\d*)-(\d*)$", i), F.lit("")) for i in (1, 2))
    a, b = a.try_cast("bigint"), b.try_cast("bigint")
    most = 9007199254740991
    form = h.rlike(r"^bytes=(\d+-\d*|-\d+)$")
    from_start = F.struct(a.alias("offset"), (F.least(F.coalesce(b, size - 1), size - 1) - a + 1).alias("length"))
    suffix = F.least(b, size)
    from_end = F.struct((size - suffix).alias("offset"), suffix.alias("length"))
    ok = form & (F.coalesce(a, F.lit(0)) <= most) & (F.coalesce(b, F.lit(0)) <= most)
    return F.when(ok & a.isNotNull() & (a < size) & (b.isNull() | (b >= a)), from_start).when(ok & h.startswith("bytes=-") & (b > 0) & (size > 0), from_end)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed digest in base64 for URLs, by two nested digests."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(k ^ x for k in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.regexp_replace(F.translate(F.base64(F.unhex(F.sha2(F.concat(pad(0x5C), inner), 256))), "+/", "-_"), "=+$", "")
