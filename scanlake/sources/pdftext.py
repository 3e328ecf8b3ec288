"""Text of PDF fonts: character maps read and written, codes decoded, widths added up."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEX = re.compile(r"<([0-9A-Fa-f]*)>")


def unicode_of(digits: str) -> str:
    """The text of hexadecimal digits: by four, or as one code point where there are fewer; what is no character is left out."""
    found = [int(digits[k : k + 4], 16) for k in range(0, len(digits) - 3, 4)] or ([int(digits, 16)] if digits else [])
    return "".join(chr(c) for c in found if c < 0x110000 and not 0xD800 <= c < 0xE000)


def read_map(text: str) -> tuple[dict[int, str], int] | None:
    """A character map's codes, and the bytes of a code (1 or 2, by the first one written); None if it is empty."""
    codes: dict[int, str] = {}
    size = None
    for block in re.findall(r"beginbfchar(.*?)endbfchar", text, re.S):
        for line in block.splitlines():
            parts = HEX.findall(line)
            if len(parts) >= 2:
                size = size or (len(parts[0]) + 1) // 2 or None
                if parts[0] and int(parts[0], 16) <= 0xFFFF and (to := unicode_of(parts[1])):
                    codes[int(parts[0], 16)] = to
    for block in re.findall(r"beginbfrange(.*?)endbfrange", text, re.S):
        for line in block.splitlines():
            parts = HEX.findall(line)
            if len(parts) >= 3 and all(parts[:3]):
                size = size or (len(parts[0]) + 1) // 2
                first, last, to = (int(x, 16) for x in parts[:3])
                for code in range(first, min(last, 0xFFFF) + 1):
                    c = to + code - first
                    if c < 0x110000 and not 0xD800 <= c < 0xE000:
                        codes[code] = chr(c)
    return (codes, min(2, max(1, size or 2))) if codes else None


def code_size(raw: bytes) -> int:
    """Bytes of a code where no map tells: 2 for even lengths with a zero byte, else 1."""
    return 2 if raw and len(raw) % 2 == 0 and 0 in raw else 1


def decode(raw: bytes, known: tuple[dict[int, str], int] | None) -> str:
    """The text of a string of codes; of its bytes as UTF-8 without a map, or where the map knows none of them."""
    out = ""
    if known:
        codes, size = known
        out = "".join(codes.get(int.from_bytes(raw[k : k + size], "big"), "") for k in range(0, len(raw) - size + 1, size))
    return out or raw.decode("utf-8", "replace")


def width(parts: list[bytes | float], widths: list[float], first: int, size: float, scale: float, word_spacing: float) -> float:
    """Width in points of shown strings and the kerning between them (thousandths, to the left); a character without a width has the mean of all."""
    some = [w for w in widths if w > 0]
    mean = sum(some) / len(some) if some else 500.0
    total, blanks = 0.0, 0
    for part in parts:
        if isinstance(part, bytes):
            total += sum(widths[b - first] if 0 <= b - first < len(widths) and widths[b - first] > 0 else mean for b in part)
            blanks += part.count(b" ")
        else:
            total -= part
    return total / 1000 * abs(size) * scale + blanks * word_spacing * scale


#: What stands before and after the entries of a character map.
MAP_HEAD = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CIDSystemInfo << /Registry (Adobe) /Ordering (UCS) /Supplement 0 >> def\n/CMapName /Adobe-Identity-UCS def\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n"
MAP_TAIL = "endcmap\nCMapName currentdict /CMap defineresource pop\nend\nend\n"
CHUNK = 100


def character_maps(entries: DataFrame, font: str, code: str, char: str) -> DataFrame:
    """(font, cmap): each font's character map in text, its codes (code, char) in order, a hundred a block."""
    digits = lambda c: F.lpad(F.hex(c), F.greatest(F.lit(4), F.length(F.hex(c))), F.lit("0"))
    line = F.concat(F.lit("<"), digits(F.col(code)), F.lit("> <"), digits(F.ascii(char)), F.lit(">\n"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(code).alias("c"), line.alias("l")))), lambda x: x["l"])
    d = entries.groupBy(font).agg(rows.alias("r"))
    starts = F.sequence(F.lit(0), F.floor((F.size("r") - 1) / CHUNK).cast("int"))
    block = lambda k: F.transform(F.array(F.slice("r", k * CHUNK + 1, F.lit(CHUNK))), lambda s: F.concat(F.size(s).cast("string"), F.lit(" beginbfchar\n"), F.array_join(s, ""), F.lit("endbfchar\n")))[0]
    return d.select(font, F.concat(F.lit(MAP_HEAD), F.array_join(F.transform(starts, block), ""), F.lit(MAP_TAIL)).alias("cmap"))
