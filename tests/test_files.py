"""Font files and PDF text, on bytes made here."""

import struct

import pytest

from scanlake.sources import fonts, pdftext


def made_font(names, weight=400, selection=0, revision=0x00028000, axes=(), kern=(), gpos=b"", chars=((65, 1), (66, 2), (0x1F600, 3)), advances=(500, 600, 700, 800)):
    texts, records = b"", []
    for kind, text in names:
        raw = text.encode("utf-16-be")
        records.append(struct.pack(">6H", 3, 1, 0x409, kind, len(raw), len(texts)))
        texts += raw
    mac = b"Mac name"
    records.insert(0, struct.pack(">6H", 1, 5, 0, 1, len(mac), len(texts)))  # an encoding that can't be read
    texts += mac
    tables = {
        b"name": struct.pack(">3H", 0, len(records), 6 + 12 * len(records)) + b"".join(records) + texts,
        b"OS/2": struct.pack(">HhH", 4, 0, weight) + bytes(56) + struct.pack(">H", selection) + bytes(16),
        b"head": struct.pack(">II", 0x10000, revision) + bytes(10) + struct.pack(">H", 2048) + bytes(34),
        b"hhea": bytes(34) + struct.pack(">H", len(advances)),
        b"hmtx": b"".join(struct.pack(">Hh", a, 0) for a in advances),
    }
    low = [(c, g) for c, g in chars if c < 0x10000]
    segments = [(c, c, (g - c) & 0xFFFF) for c, g in low] + [(0xFFFF, 0xFFFF, 1)]
    n = len(segments)
    four = struct.pack(">7H", 4, 16 + 8 * n, 0, 2 * n, 0, 0, 0) + b"".join(struct.pack(">H", e) for _, e, _ in segments) + b"\0\0" + b"".join(struct.pack(">H", s) for s, _, _ in segments) + b"".join(struct.pack(">H", d) for _, _, d in segments) + bytes(2 * n)
    twelve = struct.pack(">HHIII", 12, 0, 16 + 12 * len(chars), 0, len(chars)) + b"".join(struct.pack(">3I", c, c, g) for c, g in chars)
    tables[b"cmap"] = struct.pack(">HH", 0, 2) + struct.pack(">HHI", 3, 1, 20) + struct.pack(">HHI", 3, 10, 20 + len(four)) + four + twelve
    if axes:
        tables[b"fvar"] = struct.pack(">IHHHHHH", 0x10000, 16, 2, len(axes), 20, 0, 0) + b"".join(struct.pack(">4s3iHH", t, *(int(x * 65536) for x in limits), 0, 0) for t, *limits in axes)
    if kern:
        tables[b"kern"] = struct.pack(">HH", 0, 1) + struct.pack(">3H4H", 0, 14 + 6 * len(kern), 1, len(kern), 0, 0, 0) + b"".join(struct.pack(">HHh", *k) for k in kern)
    if gpos:
        tables[b"GPOS"] = gpos
    head, body = struct.pack(">4H", len(tables), 0, 0, 0), b""
    at = 12 + 16 * len(tables)
    records = b""
    for tag, data in tables.items():
        records += struct.pack(">4sIII", tag, 0, at + len(body), len(data))
        body += data + bytes(-len(data) % 4)
    return b"\0\1\0\0" + head + records + body


def kern_feature(lookups):
    return struct.pack(">HHHHH", 1, 0, 0, 10, 0) + struct.pack(">H4sH", 1, b"kern", 8) + struct.pack(">HH", 0, lookups) + struct.pack(">H", 0) * lookups


def test_font_entries(spark):
    given = {
        "a": made_font([(1, "Foo"), (2, "Bold"), (4, "Foo Bold"), (6, "Foo-BoldItalic"), (16, "Foo Family")], 700, 1, 0x0002FFFF, [(b"wght", 300, 400, 900), (b"opsz", 8, 9.5, 60)], [(1, 2, -50), (2, 1, 30)]),
        "b": made_font([(1, "Bar"), (6, "Bar")], gpos=kern_feature(1)),
        "c": made_font([(6, "Baz")], gpos=kern_feature(0)),
        "d": b"no font at all",
        "e": made_font([(6, "Cut")])[:40],
        "f": None,
    }
    d = spark.createDataFrame([(k, v) for k, v in given.items()], "path string, content binary")
    got = {r["path"]: r for r in fonts.read_entries(d).collect()}
    a = got["a"]
    assert (a["family"], a["subfamily"], a["full_name"], a["raw_name"], a["typographic_family"], a["weight"], a["italic"], a["version"], a["units"], a["has_kern"]) == ("Foo", "Bold", "Foo Bold", "Foo-BoldItalic", "Foo Family", 700, True, "3.00", 2048, True)
    assert a["postscript_name"] == "Foo-700Italic" and a["font_key"] == "Foo-700Italic|version=3.00[wght=400,opsz=9.5]"
    assert got["b"]["typographic_family"] == "Bar" and got["b"]["has_kern"] and got["b"]["version"] == "2.50" and not got["c"]["has_kern"] and got["b"]["font_key"] == "Bar-400|version=2.50"
    assert [(got[k]["raw_name"], got[k]["weight"], got[k]["version"]) for k in "def"] == [("", 400, "")] * 3
    assert [r["instance"] for r in fonts.weight_instances(fonts.read_entries(d)).orderBy("instance").collect()] == [300, 500, 600, 700, 800, 900]
    assert [(r["code"], r["glyph"], r["advance"]) for r in fonts.read_glyphs(d.where("path = 'a'")).orderBy("code").collect()] == [(65, 1, 600), (66, 2, 700), (0x1F600, 3, 800)]
    assert [tuple(r)[1:] for r in fonts.read_kerning(d).orderBy("g1").collect()] == [(1, 2, -50), (2, 1, 30)]


def test_character_maps():
    text = "2 beginbfchar\n<41> <0042>\n<42> <D835DC00>\nendbfchar\n1 beginbfrange\n<61> <63> <0078>\nendbfrange\n1 beginbfchar <50> <00660069> endbfchar"
    codes, size = pdftext.read_map(text)
    assert size == 1 and codes == {0x41: "B", 0x61: "x", 0x62: "y", 0x63: "z", 0x50: "fi"}
    assert pdftext.read_map("begincmap endcmap") is None
    assert pdftext.read_map("beginbfchar\n<0041> <41>\nendbfchar") == ({0x41: "A"}, 2)
    assert pdftext.decode(b"\x41\x61\x50\xff", (codes, size)) == "Bxfi" and pdftext.decode(b"zz", (codes, size)) == "zz" and pdftext.decode(b"zz", None) == "zz"
    assert pdftext.decode(b"\0A\0a\0", ({0x41: "1", 0x61: "2"}, 2)) == "12"
    assert [pdftext.code_size(x) for x in (b"\0A", b"AB", b"A\0B", b"")] == [2, 1, 1, 1]


def test_widths():
    assert pdftext.width([b"AB", -120.0, b"C "], [500.0, 0.0, 250.0], 65, -10.0, 2.0, 0.3) == pytest.approx((500 + 375 + 120 + 250 + 375) / 1000 * 10 * 2 + 0.3 * 2)
    assert pdftext.width([b"A"], [], 0, 10.0, 1.0, 0.0) == 5.0


def test_written_maps_read_again(spark):
    entries = [(f, k, chr(0x4E00 + 7 * k + f)) for f in range(2) for k in range(230)] + [(1, 5000, "\U0001f600")]
    rows = pdftext.character_maps(spark.createDataFrame(entries, "font int, code int, ch string"), "font", "code", "ch").collect()
    for r in rows:
        codes, size = pdftext.read_map(r["cmap"])
        want = {k: c for f, k, c in entries if f == r["font"] and ord(c) < 0x10000}
        assert size == 2 and {k: v for k, v in codes.items() if k != 5000} == want and r["cmap"].count("100 beginbfchar") == 2
