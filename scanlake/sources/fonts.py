"""Font files: names, weight, version, axes, character map, advances and kerning pairs, read from their tables."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlake.functions import identity as I

#: The name records that are read.
FAMILY, SUBFAMILY, FULL_NAME, POSTSCRIPT, TYPOGRAPHIC = 1, 2, 4, 6, 16
NAMES = {FAMILY: "family", SUBFAMILY: "subfamily", FULL_NAME: "full_name", POSTSCRIPT: "raw_name", TYPOGRAPHIC: "typographic_family"}
REGULAR = 400


class Font:
    """The tables of one font file's first face; what a table doesn't hold, or a file that is none, reads as empty."""

    def __init__(self, data: bytes):
        self.tables: dict[bytes, bytes] = {}
        start = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" and len(data) >= 16 else 0
        if len(data) < start + 12 or data[start : start + 4] not in (b"\0\1\0\0", b"OTTO", b"true"):
            return
        for k in range(struct.unpack_from(">H", data, start + 4)[0]):
            if start + 28 + 16 * k <= len(data):
                tag, _, at, size = struct.unpack_from(">4sIII", data, start + 12 + 16 * k)
                self.tables[tag] = data[at : at + size]

    def at(self, tag: bytes, place: int, form: str, default: int = 0) -> int:
        own = self.tables.get(tag, b"")
        return struct.unpack_from(">" + form, own, place)[0] if place + struct.calcsize(form) <= len(own) else default

    def names(self) -> dict[int, str]:
        """The first readable record of each kind: Unicode and Windows ones, and Macintosh Roman."""
        own, found = self.tables.get(b"name", b""), {}
        text = self.at(b"name", 4, "H")
        for k in range(self.at(b"name", 2, "H")):
            if 18 + 12 * k > len(own):
                break
            platform, encoding, _, kind, size, at = struct.unpack_from(">6H", own, 6 + 12 * k)
            code = "utf-16-be" if platform == 0 or (platform == 3 and encoding in (0, 1, 10)) else "mac_roman" if (platform, encoding) == (1, 0) else None
            raw = own[text + at : text + at + size]
            if kind in NAMES and kind not in found and code and raw:
                found[kind] = raw.decode(code, "replace")
        return found

    def weight(self) -> int:
        return self.at(b"OS/2", 4, "H", REGULAR)

    def italic(self) -> bool:
        """By the selection bits, or by the style bits of a file without them."""
        return bool(self.at(b"OS/2", 62, "H") & 0x201) if b"OS/2" in self.tables else bool(self.at(b"head", 44, "H") & 2)

    def version(self) -> str:
        """The revision with two decimals, rounded; empty without one."""
        if len(self.tables.get(b"head", b"")) < 8:
            return ""
        hundredths = int((self.at(b"head", 4, "I") & 0xFFFF) / 65536 * 100 + 0.5)
        major = self.at(b"head", 4, "I") >> 16
        return f"{major + 1}.00" if hundredths >= 100 else f"{major}.{hundredths:02}"

    def units(self) -> int:
        return self.at(b"head", 18, "H")

    def axes(self) -> list[tuple[str, float, float, float]]:
        """(tag, least, default, greatest) of each variation axis."""
        own, out = self.tables.get(b"fvar", b""), []
        start, n, size = self.at(b"fvar", 4, "H"), self.at(b"fvar", 8, "H"), self.at(b"fvar", 10, "H")
        for k in range(n):
            if size >= 16 and start + k * size + 16 <= len(own):
                tag, *limits = struct.unpack_from(">4s3i", own, start + k * size)
                out.append((tag.decode("latin-1"), *(x / 65536 for x in limits)))
        return out

    def characters(self) -> dict[int, int]:
        """Glyph of each code point, by the fullest Unicode map of formats 4 and 12."""
        own, best = self.tables.get(b"cmap", b""), {}
        for k in range(self.at(b"cmap", 2, "H")):
            if 12 + 8 * k > len(own):
                break
            platform, encoding, at = struct.unpack_from(">HHI", own, 4 + 8 * k)
            found: dict[int, int] = {}
            form = self.at(b"cmap", at, "H")
            if platform not in (0, 3):
                continue
            if form == 12:
                for g in range(self.at(b"cmap", at + 12, "I")):
                    if at + 28 + 12 * g > len(own):
                        break
                    first, last, glyph = struct.unpack_from(">3I", own, at + 16 + 12 * g)
                    found |= {c: glyph + c - first for c in range(first, min(last, first + 0xFFFF) + 1)}
            elif form == 4:
                n = self.at(b"cmap", at + 6, "H") // 2
                for g in range(n):
                    end, start = self.at(b"cmap", at + 14 + 2 * g, "H"), self.at(b"cmap", at + 16 + 2 * n + 2 * g, "H")
                    delta, place = self.at(b"cmap", at + 16 + 4 * n + 2 * g, "H"), at + 16 + 6 * n + 2 * g
                    offset = self.at(b"cmap", place, "H")
                    for c in range(start, end + 1):
                        glyph = (c + delta) & 0xFFFF if not offset else self.at(b"cmap", place + offset + 2 * (c - start), "H")
                        if offset and glyph:
                            glyph = (glyph + delta) & 0xFFFF
                        if glyph and c != 0xFFFF:
                            found[c] = glyph
            best = found if len(found) > len(best) else best
        return {c: g for c, g in best.items() if g}

    def advance(self, glyph: int) -> int:
        n = self.at(b"hhea", 34, "H")
        return self.at(b"hmtx", 4 * min(glyph, n - 1), "H") if n else 0

    def kerning(self) -> dict[tuple[int, int], int]:
        """Value of each glyph pair of the kern table's horizontal pair lists, later ones added."""
        out: dict[tuple[int, int], int] = {}
        at = 4
        for _ in range(self.at(b"kern", 2, "H") if self.at(b"kern", 0, "H", 1) == 0 else 0):
            size, cover = self.at(b"kern", at + 2, "H"), self.at(b"kern", at + 4, "H")
            if cover >> 8 == 0 and cover & 1:
                for k in range(self.at(b"kern", at + 6, "H")):
                    pair = (self.at(b"kern", at + 14 + 6 * k, "H"), self.at(b"kern", at + 16 + 6 * k, "H"))
                    out[pair] = out.get(pair, 0) + self.at(b"kern", at + 18 + 6 * k, "h")
            at += max(size, 6)
        return out

    def has_kerning(self) -> bool:
        """A pair in the kern table (or one of its other formats), or a kern feature with a lookup."""
        at = 4
        for _ in range(self.at(b"kern", 2, "H") if self.at(b"kern", 0, "H", 1) == 0 else 0):
            if self.at(b"kern", at + 4, "H") >> 8 or self.at(b"kern", at + 6, "H"):
                return True
            at += max(self.at(b"kern", at + 2, "H"), 6)
        own = self.tables.get(b"GPOS", b"")
        features = self.at(b"GPOS", 6, "H")
        for k in range(self.at(b"GPOS", features, "H") if own else 0):
            record = features + 2 + 6 * k
            if own[record : record + 4] == b"kern" and self.at(b"GPOS", features + self.at(b"GPOS", record + 4, "H") + 2, "H"):
                return True
        return False


ENTRY = "path string, family string, subfamily string, full_name string, raw_name string, typographic_family string, weight int, italic boolean, version string, units int, has_kern boolean, axes array<struct<tag: string, least: double, value: double, most: double>>"


def read_entries(files: DataFrame) -> DataFrame:
    """A row a font file (path, content): its names, weight, slant, version, units, axes and kerning, with its postscript name and key.

    Files are read one at a time in Arrow batches; one that is no font has empty names and the regular weight. The postscript
    name has an explicit weight; the key has the version and every axis at its default.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                f = Font(content.as_py() or b"")
                n = f.names()
                row = {"path": path, **{v: n.get(k, "") for k, v in NAMES.items()}, "weight": f.weight(), "italic": f.italic(), "version": f.version(), "units": f.units(), "has_kern": f.has_kerning(), "axes": [dict(zip(("tag", "least", "value", "most"), a, strict=True)) for a in f.axes()]}
                row["typographic_family"] = row["typographic_family"] or row["family"]
                yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    rows = files.select("path", "content").mapInArrow(run, ENTRY)
    rows = rows.withColumn("postscript_name", I.explicit_weight(F.col("raw_name"), F.col("weight")))
    return rows.withColumn("font_key", I.full_key(F.col("postscript_name"), F.lit(""), F.lit(None).cast("string"), F.col("axes"), F.col("version")))


SCHEMA = pa.schema([(c, pa.string()) for c in ("path", "family", "subfamily", "full_name", "raw_name", "typographic_family")] + [("weight", pa.int32()), ("italic", pa.bool_()), ("version", pa.string()), ("units", pa.int32()), ("has_kern", pa.bool_()), ("axes", pa.list_(pa.struct([("tag", pa.string()), ("least", pa.float64()), ("value", pa.float64()), ("most", pa.float64())])))])


def read_glyphs(files: DataFrame) -> DataFrame:
    """(path, code, glyph, advance): the characters of each font file, in font units."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                f = Font(content.as_py() or b"")
                found = sorted(f.characters().items())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([c for c, _ in found], pa.int32()), pa.array([g for _, g in found], pa.int32()), pa.array([f.advance(g) for _, g in found], pa.int32())], ["path", "code", "glyph", "advance"])

    return files.select("path", "content").mapInArrow(run, "path string, code int, glyph int, advance int")


def read_kerning(files: DataFrame) -> DataFrame:
    """(path, g1, g2, value): the glyph pairs of each font file's kern table."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = sorted(Font(content.as_py() or b"").kerning().items())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([a for (a, _), _ in found], pa.int32()), pa.array([b for (_, b), _ in found], pa.int32()), pa.array([v for _, v in found], pa.int32())], ["path", "g1", "g2", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, g1 int, g2 int, value int")


def weight_instances(entries: DataFrame, weights: tuple = (100, 200, 300, 400, 500, 600, 700, 800, 900)) -> DataFrame:
    """(path, instance): the weights that a file with a weight axis can take besides its default."""
    axis = F.get(F.filter("axes", lambda a: a["tag"] == "wght"), F.lit(0))
    d = entries.select("path", axis.alias("a")).where("a IS NOT NULL")
    return d.select("path", F.explode(F.filter(F.array(*map(F.lit, weights)), lambda w: (w >= F.col("a.least")) & (w <= F.col("a.most")) & (w != F.col("a.value")))).alias("instance"))
