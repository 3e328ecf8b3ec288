"""String functions of the catalog and of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and the letters they stand for, longest first; the place in the list is the bit that allows one.
LIGATURES = [("ffi", "ﬃ"), ("ffl", "ﬄ"), ("ff", "ﬀ"), ("fi", "ﬁ"), ("fl", "ﬂ")]


def normalize_family(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def normalize_text(text: Column) -> Column:
    """Lower case with white space runs as single spaces, for comparing recognised text with the truth."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def segments(key: Column) -> Column:
    """The segments of a key after the first, without what stands in brackets."""
    return F.transform(F.slice(F.split(key, r"\|"), 2, 1000), lambda seg: F.split_part(seg, F.lit("["), F.lit(1)))


def key_version(key: Column) -> Column:
    """``|version=1.23`` -> 123: the first such segment, the minor part's first two digits, filled with zeros; 0 if missing."""
    version = F.regexp_extract(key, r"\|version=([^|\[]*)", 1)
    major = F.coalesce(F.split_part(version, F.lit("."), F.lit(1)).try_cast("int"), F.lit(0))
    minor = F.rpad(F.regexp_replace(F.regexp_replace(version, r"^[^.]*", ""), r"[^0-9]", ""), 2, "0")
    return (100 * major + minor.cast("int")).cast("int")


def key_weight_italic(key: Column) -> Column:
    """struct(weight, italic) of a trailing ``-700Italic`` of the first segment, or null."""
    head = F.split_part(key, F.lit("|"), F.lit(1))
    weight = F.regexp_extract(head, r"(?:^|-)([0-9]+)(?:Italic)?$", 1)
    return F.when(weight != "", F.struct(weight.try_cast("int").alias("weight"), head.endswith("Italic").alias("italic")))


def has_variant_tag(key: Column, tag: str) -> Column:
    """Whether a segment after the first, without what stands in brackets, is the tag."""
    return F.array_contains(segments(key), tag)


def strip_subset_prefix(name: Column) -> Column:
    return F.regexp_replace(name, r"^[^+]*\+", "")


def hash_hex(h: Column) -> Column:
    return F.lower(F.lpad(F.hex(h), 16, "0"))


def collapse_ligatures(text: Column, allowed: int = 31) -> Column:
    for bit, (letters, one) in enumerate(LIGATURES):
        if allowed >> bit & 1:
            text = F.replace(text, F.lit(letters), F.lit(one))
    return text


def expand_ligatures(text: Column) -> Column:
    for letters, one in LIGATURES:
        text = F.replace(text, F.lit(one), F.lit(letters))
    return text


def has_descenders(text: Column) -> Column:
    return text.rlike("[gjpqyQ]")


def is_sizing_anchor(text: Column) -> Column:
    """Two characters or more, a letter among them."""
    return (F.length(text) >= 2) & text.rlike(r"\p{L}")


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")


def classify_family(family: Column, hints: list[tuple[str, list[str]]]) -> Column:
    """The first class one of whose hints the lower-cased name holds, else ``unknown``."""
    out = F.lit("unknown")
    for name, words in reversed(hints):
        held = F.lit(False)
        for word in words:
            held = held | F.lower(family).contains(word)
        out = F.when(held, F.lit(name)).otherwise(out)
    return out


def utf16be_text(hexed: Column) -> Column:
    return F.decode(F.unhex(hexed), "UTF-16BE")
