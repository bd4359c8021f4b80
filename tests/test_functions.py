import base64
import random
import zlib

import numpy as np
import pytest

from quirelake.functions import colour, content, filters, geometry, jpeg, text
from quirelake.functions.pdf import Encrypted, Hex, Lexer, Name, PdfError, Ref, read, shown, write_classic, write_packed, _by_scan

from . import pdfs


@pytest.mark.parametrize("decoder, given, want", [
    (filters.ascii_hex, b"48 65 6C6c 6f>", b"Hello"),
    (filters.ascii_hex, b"7>", b"p"),
    (filters.ascii_hex, b"4g>", None),
    (filters.ascii85, b"z~>", b"\0\0\0\0"),
    (filters.ascii85, b"87cURD]j7BEbo80~>", b"Hello world!"),
    (filters.ascii85, b"8z~>", None),
    (filters.ascii85, b"8~>", None),
    (filters.run_length, b"\x02abc\xfed\x80", b"abcddd"),
    (filters.run_length, b"\x05ab", None),
    (filters.inflate, zlib.compress(b"x" * 999), b"x" * 999),
    (filters.inflate, zlib.compress(b"x" * 999)[:-5], None),
])
def test_filters(decoder, given, want):
    assert decoder(given) == want


def test_ascii85_round_trip():
    for n in range(20):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert filters.ascii85(base64.a85encode(data) + b"~>") == data


def test_inflate_is_bounded_and_falls_back_to_raw():
    assert filters.inflate(zlib.compress(b"0" * 1000), 999) is None
    raw = zlib.compress(b"hello")
    assert filters.inflate(b"\0\0" + raw[2:], lenient=True) == b"hello"


def _png(rows, step, kinds):
    out, above = b"", bytes(len(rows[0]))
    for row, kind in zip(rows, kinds, strict=True):
        line = []
        for i, v in enumerate(row):
            a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    return out


def test_predictors():
    rng = random.Random(1)
    rows = [bytes(rng.randrange(256) for _ in range(12)) for _ in range(5)]
    parms = {"Predictor": 15, "Colors": 3, "Columns": 4}
    assert filters.predicted(_png(rows, 3, range(5)), parms) == b"".join(rows)
    img = np.random.default_rng(0).integers(0, 256, (4, 5, 3), dtype=np.uint8)
    tiff = np.diff(img.astype(int), axis=1, prepend=0).astype(np.uint8)
    assert filters.predicted(tiff.tobytes(), {"Predictor": 2, "Colors": 3, "Columns": 5}) == img.tobytes()
    assert filters.predicted(b"123", {"Predictor": 2, "Colors": 3, "Columns": 5}) is None
    assert filters.predicted(b"", {"Predictor": 12, "Columns": 1 << 40}) is None


def test_lexer_values():
    v = Lexer(b"<< /A#20B 1 /C [ -.5 +3 (x\\(y\\)\\101\\n) <4a4B5> true null ] /R 5 0 R % note\n >>").value()
    assert v == {"A B": 1, "C": [-0.5, 3, b"x(y)A\n", Hex(b"JKP"), True, None], "R": Ref(5, 0)}
    assert shown(Name("A B")) == b"/A#20B" and shown(b"a(b\\") == b"(a\\(b\\\\)" and shown(0.25) == b"0.25"


@pytest.mark.parametrize("write", [write_classic, write_packed])
def test_files_round_trip(write):
    doc = read(pdfs.build([b"q Q", b"BT ET"], extra={50: {"A": [1, 2.5, None, True, Name("N"), b"s", Hex(b"h"), Ref(51, 0)]}}))
    again = read(write(doc))
    assert again.objects == doc.objects and again.trailer["Root"] == doc.trailer["Root"]
    assert _by_scan(write(doc)).objects == doc.objects


def test_broken_xref_is_scanned():
    data = pdfs.build([b"q Q"])
    cut = data[: data.rindex(b"startxref")] + b"startxref\n999999\n%%EOF"
    assert read(cut).objects == read(data).objects


def test_encrypted_and_garbage():
    with pytest.raises(Encrypted):
        read(pdfs.build([b""], trailer={"Encrypt": {"V": 1}}))
    for data in (b"", b"%PDF-1.7", b"nothing here", b"%PDF-1.4\n1 0 obj\n<<>>\nendobj"):
        with pytest.raises(PdfError):
            read(data)


def test_random_bytes_never_crash():
    rng = random.Random(7)
    good = pdfs.build([b"BT /F1 12 Tf (x) Tj ET"] * 3, packed=True)
    for _ in range(150):
        data = bytearray(good)
        for _ in range(rng.randrange(1, 30)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        try:
            doc = read(bytes(data))
            for p in content.pages(doc):
                content.operations(content.content_bytes(doc, p))
        except (PdfError, ValueError, TypeError, KeyError, IndexError, AttributeError, OverflowError, RecursionError):
            pass


def test_page_tree_inherits_and_rejects_cycles():
    doc = read(pdfs.build([b"", b""]))
    assert [p.inherited["MediaBox"] for p in content.pages(doc)] == [[0, 0, 612, 792]] * 2
    doc.objects[Ref(2, 0)]["Kids"].append(Ref(2, 0))
    with pytest.raises(PdfError):
        content.pages(doc)


def test_inline_images():
    body = b"(BI ID EI) Tj BI /W 2 /H 1 /CS /RGB ID abcdef EI q BI /IM true /W 8 /H 1 ID x\nEI Q % BI ID x EI\n"
    assert content.inline_images(body) == (2, 7, 1)


def test_placements_follow_the_stack():
    ops = content.operations(b"Q q 2 0 0 2 0 0 cm q 10 0 0 20 1 1 cm /A Do Q /B Do Q /C Do")
    found = {p.name: tuple(map(float, p.ctm)) for p in geometry.placements(ops)}
    assert found == {"A": (20, 0, 0, 40, 2, 2), "B": (2, 0, 0, 2, 0, 0), "C": (1, 0, 0, 1, 0, 0)}


def test_flatten_matrix():
    assert geometry.flatten_matrix([0, 0, 10, 20], (1, 0, 0, 1, 0, 0), [100, 100, 120, 120]) == (2, 0, 0, 1, 100, 100)
    assert geometry.flatten_matrix([0, 0, 0, 20], (1, 0, 0, 1, 0, 0), [0, 0, 5, 10])[0] == 1


def test_colour():
    assert colour.to_gray(np.array([[[255, 0, 0]]], np.uint8))[0, 0] == 77
    assert colour.from_cmyk(np.array([[[0, 0, 0, 0], [255, 0, 0, 0], [0, 0, 0, 255]]], np.uint8)).tolist() == [[[255] * 3, [0, 255, 255], [0, 0, 0]]]
    assert colour.from_cmyk(np.array([[[255, 128, 0, 255]]], np.uint8), adobe=True).tolist() == [[[255, 128, 0]]]
    assert colour.from_indexed(np.array([[0, 2]]), b"aaabbbccc", 3, 2).shape == (1, 2, 3)
    assert colour.from_indexed(np.array([[0, 3]]), b"aaabbbccc", 3, 2) is None
    assert colour.from_raw(b"123", 2, 2, 3) is None
    assert not colour.is_photo(np.zeros((500, 500), np.uint8)) and colour.is_photo(np.random.default_rng(0).integers(0, 256, (300, 300, 3), dtype=np.uint8))


@pytest.mark.parametrize("shape", [(64, 64, 3), (75, 101, 3), (33, 20)])
def test_jpeg_round_trip(shape):
    img = pdfs.picture(128, 1, 3 if len(shape) == 3 else 1)[: shape[0], : shape[1]]
    data = jpeg.encode(img, 92)
    assert colour.psnr(img, jpeg.decode(data)) > 30
    assert jpeg.frame(data)[:2] == (shape[1], shape[0]) and jpeg.components(data) == (3 if len(shape) == 3 else 1)
    assert jpeg.decode(data[:200]) is None and jpeg.decode(b"nothing") is None


def test_resize_keeps_flat_areas():
    img = np.full((40, 60, 3), 200, np.uint8)
    assert (colour.resized(img, 13, 7) == 200).all()


def test_cmap_and_encodings():
    cmap = b"2 beginbfchar <01> <0041> <02> <00420043> endbfchar 2 beginbfrange <10> <12> <0061> <20> <21> [<0078> <0079>] endbfrange"
    assert text.to_unicode(cmap) == {b"\1": "A", b"\2": "BC", b"\x10": "a", b"\x11": "b", b"\x12": "c", b" ": "x", b"!": "y"}
    doc = read(pdfs.build([b""]))
    assert text.simple_text(doc, {"Encoding": {"BaseEncoding": Name("WinAnsiEncoding"), "Differences": [65, Name("space"), Name("q")]}})[b"A"] == " "


def test_region_strings():
    assert text.parse_region("2:1,2,3,4", 0) == ("r1", 1, 1, 2, 3, 4)
    assert text.parse_region("name@1:0.5,2,3,4", 3)[:2] == ("name", 0)
    for bad in ("1:1,2,3", "0:1,2,3,4", "x", "1:a,2,3,4"):
        with pytest.raises(ValueError):
            text.parse_region(bad, 0)


def _program(n=6):
    """A TrueType program of n glyphs; glyph 4 is made of glyphs 1 and 2."""
    import struct

    from quirelake.functions import fonts

    simple = lambda g: struct.pack(">h", 1) + bytes([g] * 90)
    made = struct.pack(">h", -1) + bytes(8) + struct.pack(">HHbb", 0x20, 1, 0, 0) + struct.pack(">HHbb", 0, 2, 0, 0)
    glyphs = [made if g == 4 else simple(g) for g in range(n)]
    at = [0]
    for g in glyphs:
        at.append(at[-1] + len(g))
    head = bytes(50) + struct.pack(">h", 1) + bytes(2)
    tables = {"head": head, "maxp": struct.pack(">IH", 0x10000, n), "hhea": bytes(36), "hmtx": bytes(4 * n), "glyf": b"".join(glyphs), "loca": struct.pack(f">{n + 1}I", *at), "post": bytes(32), "junk": b"x" * 500}
    return fonts.assembled(tables), glyphs


def test_font_subset_keeps_what_is_drawn():
    import struct

    from quirelake.functions import fonts

    data, glyphs = _program()
    small = fonts.tables_of(fonts.subset(data, {4}))
    at = struct.unpack(">7I", small["loca"])
    kept = [small["glyf"][a:b] for a, b in zip(at, at[1:], strict=False)]
    assert [bool(k) for k in kept] == [True, True, True, False, True, False] and "junk" not in small
    assert all(k.startswith(glyphs[g]) for g, k in enumerate(kept) if k)
    assert fonts.subset(data[:60], {1}) is None and fonts.subset(b"OTTO" + data[4:], {1}) is None


def test_fonts_of_a_file_are_subset():
    from quirelake.functions import fonts
    from quirelake.functions.pdf import Stream

    data, _ = _program(60)
    extra = {
        40: {"Type": Name("Font"), "Subtype": Name("Type0"), "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(41, 0)]},
        41: {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "FontDescriptor": Ref(42, 0), "DW": 500},
        42: {"FontFile2": Ref(43, 0)},
        43: Stream({"Filter": Name("FlateDecode")}, zlib.compress(data)),
    }
    doc = read(pdfs.build([b"BT /F1 9 Tf <00030004> Tj ET"], fonts={"F1": Ref(40, 0)}, extra=extra))
    assert fonts.Usage(doc).used == {Ref(43, 0): {3, 4}}
    out = fonts.subset_fonts(doc)
    assert out["subset"] == 1 and out["after"] < out["before"]
    doc.objects[Ref(44, 0)] = {"Type": Name("Font"), "Subtype": Name("TrueType"), "FontDescriptor": Ref(42, 0)}
    assert fonts.subset_fonts(doc)["abstained"] == {"shared_with_unsupported": 1}
