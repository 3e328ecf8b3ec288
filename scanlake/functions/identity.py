"""Names and keys of font entries, and the small encodings that go with them, as string expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words and numbers that name a weight at the end of a name, longer ones first.
WEIGHT_WORDS = ("ExtraLight", "UltraLight", "ExtraBlack", "ExtraBold", "UltraBold", "SemiBold", "DemiBold", "Regular", "Roman", "Medium", "Black", "Heavy", "Bold", "Light", "Thin")
WEIGHT_NUMBERS = ("100", "200", "300", "400", "500", "600", "700", "800", "900")
#: The optical sizes that a family's name can end in.
SIZE_WORDS = ("Display", "Subhead", "SmText", "Caption")
#: The characters beyond Latin-1 that the Windows encoding has, with their bytes.
WINDOWS = {
    0x20AC: 0x80, 0x201A: 0x82, 0x0192: 0x83, 0x201E: 0x84, 0x2026: 0x85, 0x2020: 0x86, 0x2021: 0x87, 0x02C6: 0x88, 0x2030: 0x89,
    0x0160: 0x8A, 0x2039: 0x8B, 0x0152: 0x8C, 0x017D: 0x8E, 0x2018: 0x91, 0x2019: 0x92, 0x201C: 0x93, 0x201D: 0x94, 0x2022: 0x95,
    0x2013: 0x96, 0x2014: 0x97, 0x02DC: 0x98, 0x2122: 0x99, 0x0161: 0x9A, 0x203A: 0x9B, 0x0153: 0x9C, 0x017E: 0x9E, 0x0178: 0x9F,
}
#: Characters that are indexed: printable ASCII but blank and grave accent, dashes, quotes, the ellipsis and the ligatures.
INDEXED = "".join(chr(c) for c in range(33, 127) if c != 96) + "—–‘’“”…ﬀﬁﬂﬃﬄ"


def append_tags(key: Column, tags: Column) -> Column:
    """The key with each ``|``-parted tag appended that it doesn't end in already."""
    each = F.filter(F.split(tags, r"\|"), lambda t: t != "")
    return F.aggregate(each, key, lambda k, t: F.when(k.endswith(F.concat(F.lit("|"), t)), k).otherwise(F.concat(k, F.lit("|"), t)))


def full_key(name: Column, tags: Column, era: Column, variations: Column, version: Column) -> Column:
    """The identity of an entry: name, version (before any tag of the name), tags, variations (array of tag, value) in brackets, era."""
    head, rest = F.regexp_extract(name, r"^[^|]*", 0), F.regexp_replace(name, r"^[^|]*", "")
    versioned = F.when(F.coalesce(version, F.lit("")) != "", F.concat(head, F.lit("|version="), version, rest)).otherwise(name)
    number = lambda v: F.when(v == F.floor(v), v.cast("int").cast("string")).otherwise(v.cast("float").cast("string"))
    axes = F.array_join(F.transform(variations, lambda v: F.concat(v["tag"], F.lit("="), number(v["value"]))), ",")
    return F.concat(append_tags(versioned, tags), F.when(F.size(variations) > 0, F.concat(F.lit("["), axes, F.lit("]"))).otherwise(""), F.coalesce(F.concat(F.lit("|vintage="), era), F.lit("")))


def optical_size(key: Column) -> Column:
    """struct(base, opsz): a key that ends in ``|opsz`` and a number without that, and the number; else the key and null."""
    number = F.regexp_extract(key, r"(?s)^.*\|opsz([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$", 1)
    return F.when(number != "", F.struct(F.regexp_extract(key, r"(?s)^(.*)\|opsz", 1).alias("base"), number.cast("float").alias("opsz"))).otherwise(F.struct(key.alias("base"), F.lit(None).cast("float").alias("opsz")))


def sized_key(base: Column, opsz: Column) -> Column:
    """The key of an entry at another optical size, rounded half away from zero."""
    return F.concat(base, F.lit("|opsz"), F.round(opsz).cast("int").cast("string"))


def strip_weight(name: Column) -> Column:
    """A name without the weight words and numbers at its end; a bare word goes only if something is left, a number only after - or _."""
    words, numbers = "|".join(WEIGHT_WORDS), "|".join(WEIGHT_NUMBERS)
    return F.regexp_replace(name, rf"(?s)(?:[-_](?i:{words})|(?<=.)(?i:{words})|[-_](?:{numbers}))+$", "")


def is_italic_name(name: Column) -> Column:
    return F.lower(name).rlike("italic|oblique") | name.rlike("It$") | F.lower(name).endswith("-it")


def explicit_weight(name: Column, weight: Column) -> Column:
    """``Family-700Italic`` from any spelling of a name: slant and weight words at its end give way to the weight and one slant mark."""
    bare = F.regexp_replace(name, r"(?s)(?:[-_]?(?i:italic|oblique)|(?<=.)It|-(?:it|iT|IT))+$", "")
    trim = lambda c: F.regexp_replace(c, r"[-_]+$", "")
    core = trim(strip_weight(trim(bare)))
    own = F.concat(weight.cast("string"), F.when(is_italic_name(name), "Italic").otherwise(""))
    return F.when(name == "", name).when(name == "Arial-Black", F.concat(F.lit("ArialBlack-"), weight.cast("string"))).when(core == "", own).otherwise(F.concat(core, F.lit("-"), own))


def root_family(family: Column) -> Column:
    """A family's name without the optical size at its end."""
    return F.regexp_replace(family, rf" (?:{'|'.join(SIZE_WORDS)})$", "")


def is_major_difference(family: Column, italic: Column, other_family: Column, other_italic: Column) -> Column:
    """Whether two identities differ in root family or slant."""
    return (root_family(family) != root_family(other_family)) | (italic != other_italic)


def sequence_key(text: Column) -> Column:
    """``he`` -> ``0068_0065``."""
    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(F.ascii(c)), F.greatest(F.lit(4), F.length(F.hex(F.ascii(c)))), F.lit("0"))), "_")


def cut_bytes(text: Column, most: int) -> Column:
    """The longest start of a text with ``most`` UTF-8 bytes or fewer."""
    size = lambda c: F.octet_length(c)
    kept = F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("t"), F.lit(True).alias("on")), lambda s, c: F.struct(F.when(s["on"] & (size(s["t"]) + size(c) <= most), F.concat(s["t"], c)).otherwise(s["t"]).alias("t"), (s["on"] & (size(s["t"]) + size(c) <= most)).alias("on")))["t"]
    return F.when(size(text) <= most, text).otherwise(kept)


def windows_bytes(text: Column) -> Column:
    """A text in the Windows Latin encoding, ``?`` for what it lacks."""
    table = F.create_map(*[F.lit(x) for pair in WINDOWS.items() for x in pair])

    def byte(c: Column) -> Column:
        n = F.ascii(c)
        return F.when((n <= 0x7F) | n.between(0xA0, 0xFF), n).otherwise(F.coalesce(F.try_element_at(table, n), F.lit(0x3F)))

    return F.unhex(F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.lpad(F.hex(byte(c)), 2, "0")), ""))


def is_indexed(char: Column) -> Column:
    return (F.length(char) == 1) & (F.instr(F.lit(INDEXED), char) > 0)


def ends_narrow(text: Column) -> Column:
    """Whether a word ends in a narrow punctuation mark."""
    return text.rlike(r"(?s)[.,:;]$") & ~text.endswith("\n")


def log_probability(probability: Column) -> Column:
    """The logarithm with two decimals as text, empty without a positive probability."""
    return F.when(probability > 0, F.format_string("%.2f", F.log(probability))).otherwise("")


def manifest_sequences(header: Column, threshold: int, expected: int) -> Column:
    """The number of sequences that a cache's header names, if it is the expected one and the header has the ink threshold's tag; else null.

    ``seqs=N`` or ``v2 seqs=N`` must be all there is after the mark; in older headers any part may say it.
    """
    h = F.trim(F.regexp_replace(header, r"\s", " "))
    tagged = F.array_contains(F.split(h, " +"), f"th={threshold}")
    rest = F.when(h.startswith("seqs="), F.regexp_replace(h, "^seqs=", "")).when(h.startswith("v2 seqs="), F.regexp_replace(h, "^v2 seqs=", ""))
    number = F.when(rest.rlike(r"^\+?[0-9]+$"), rest.try_cast("bigint"))
    parts = F.transform(F.filter(F.split(h, " +"), lambda p: p.rlike(r"^seqs=\+?[0-9]+$")), lambda p: F.substring(p, 6, 30).try_cast("bigint"))
    old = F.array_contains(parts, F.lit(expected).cast("bigint"))
    return F.when(tagged & F.when(rest.isNotNull(), F.coalesce(number == expected, F.lit(False))).otherwise(old), F.lit(expected))


def concatenated(a: list[Column], b: list[Column]) -> list[Column]:
    """The product of two 2 x 3 matrices given as [a, b, c, d, e, f]."""
    return [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]]


def norm_gradient(z: Column, norm: Column, upstream: Column) -> Column:
    """The gradient of a vector's normalisation: (d - z (z . d) / norm^2) / norm, element by element."""
    dot = F.aggregate(F.zip_with(z, upstream, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.zip_with(z, upstream, lambda a, b: (b - a * dot / (norm * norm)) / norm)


def run_error(utility: Column, source: Column, output: Column, test: Column) -> Column:
    """What is missing for a run: an input, and an output unless it is a test; null for utility runs and complete ones."""
    return F.when(utility, None).when(source.isNull(), "Input file required").when(test.isNotNull() | output.isNotNull(), None).otherwise("Output path required (use -o / --output)")


def audit_path(folder: Column, output: Column) -> Column:
    """The audit file: in its folder, or beside the output under its stem."""
    place, stem = F.regexp_extract(output, r"^(.*/)?[^/]*$", 1), F.regexp_extract(output, r"^(?:.*/)?(\.?[^/]*?)(?:\.[^./]*)?$", 1)
    return F.coalesce(F.concat(F.regexp_replace(folder, "/$", ""), F.lit("/audit.json")), F.concat(place, stem, F.lit(".audit.json")))
