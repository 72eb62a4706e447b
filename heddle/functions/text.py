"""Column functions on text: tokens, identifier parts, token estimates, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[一-鿿]"


def terms(text: Column | str, least: int = 1) -> Column:
    """Lower-case runs of letters and digits of any script and underscores, at least `least` long."""
    size = "+" if least == 1 else f"{{{least},}}"
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[\p{{L}}\p{{N}}_]{size}"), F.lit(0))


def identifier_parts(name: Column | str, stop: tuple[str, ...] = ()) -> Column:
    """Lower-case parts of a camel or snake identifier, two letters or more, without stop words."""
    split = F.split(F.lower(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2")), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(split, lambda x: (F.length(x) >= 2) & ~x.isin(*stop) if stop else F.length(x) >= 2)))


def tokens_by_script(text: Column | str) -> Column:
    """Token estimate: 1.5 CJK characters or 4 others a token, plus one."""
    text = F.col(text) if isinstance(text, str) else text
    cjk = F.length(F.regexp_replace(text, r"[^一-鿿]", ""))
    return (F.floor(cjk / 1.5 + (F.length(text) - cjk) / 4) + 1).cast("bigint")


def tokens_by_bytes(text: Column | str) -> Column:
    """Token estimate: three UTF-8 bytes a token, rounded up."""
    return F.floor((F.octet_length(text) + 2) / 3).cast("bigint")


def short_id(*parts: Column | str, size: int = 20) -> Column:
    """The first characters of the SHA-1 of parts joined by `::`."""
    return F.substring(F.sha1(F.concat_ws("::", *parts).cast("binary")), 1, size)


def module_of(path: Column | str) -> Column:
    """A path's module: its directory, or the path itself where it has none."""
    path = F.col(path) if isinstance(path, str) else path
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)
