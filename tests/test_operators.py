import zlib

import numpy as np
import pytest

from quirelake import api
from quirelake.functions import colour, content, edit, jpeg, text
from quirelake.functions.pdf import Name, Ref, Stream, read
from quirelake.operators import compress as C
from quirelake.operators import documents as D
from quirelake.operators import editing as E
from quirelake.operators import images as I
from quirelake.options import CompressOptions, EditOptions, Region
from quirelake.sources import bridge
from quirelake.sources.tables import facts, section

from . import pdfs

HOLA = b"BT /F1 12 Tf 10 10 Td (hola) Tj ET"
PAINT = b"q 144 0 0 144 0 0 cm /I0 Do Q"


def regions(spark, *rows, doc_id=0):
    return api.region_rows(spark, [Region(*r) for r in rows], doc_id)


def removed(data, *rows):
    keys = ("id", "page", "x", "y", "width", "height")
    return edit.remove(data, [dict(zip(keys, r, strict=True)) for r in rows], EditOptions())


def replaced(data, *rows):
    keys = ("id", "page", "x", "y", "width", "height", "text")
    return edit.replace(data, [dict(zip(keys, r, strict=True)) for r in rows], EditOptions())


def glyphs(data, page=0):
    doc = read(data)
    p = content.pages(doc)[page]
    return text.interpret(doc, p, content.operations(content.content_bytes(doc, p))).glyphs


def test_effective_dpi_and_plan(spark):
    data = pdfs.build([PAINT], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.jpeg_image(600)})
    found = facts(pdfs.table(spark, data), "images", "placements", "resources", "refs")
    images = section(found, "images")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    assert placed.first().dpi == 300
    none = images.select("doc_id", "num", "gen").where("false")
    row = I.image_plan(images, placed, none, none).first()
    assert (row.action, row.downsample, row.target_width, row.quality) == ("candidate", True, 300, 65)
    assert not I.image_plan(images, placed, none, none, CompressOptions(profile="printer")).first().downsample


@pytest.mark.parametrize("more, want", [
    ({"Filter": Name("JPXDecode")}, "jpx"), ({"Filter": Name("CCITTFaxDecode")}, "ccitt"), ({"Filter": Name("JBIG2Decode")}, "jbig2"), ({"Filter": Name("LZWDecode")}, "lzw"),
    ({"BitsPerComponent": 4}, "unsupported_bit_depth"), ({"ColorSpace": Name("Lab")}, "unsupported_color_space"), ({"Width": 0}, "invalid_dimensions"), ({"Height": 200_000}, "invalid_dimensions"),
    ({"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, b"aaabbb"], "BitsPerComponent": 1}, "indexed_sub_byte"),
    ({"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, b"aaabbb"]}, None), ({"SMask": Ref(99, 0)}, "soft_mask_uninspectable"), ({}, None),
])
def test_skip_reasons(spark, more, want):
    data = pdfs.build([PAINT], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.flate_image(np.zeros((8, 8, 3), np.uint8), **more)})
    found = facts(pdfs.table(spark, data), "images", "placements", "resources", "refs")
    images = section(found, "images")
    none = images.select("doc_id", "num", "gen").where("false")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    assert I.image_plan(images, placed, none, none).first().skip_reason == want


def test_batches_are_greedy(spark):
    rows = [(1, i, 0, w) for i, w in enumerate([5, 5, 1, 30, 2, 2, 2])]
    plan = spark.createDataFrame(rows, "doc_id long, num int, gen int, work long")
    got = [(r["first"], r["last"], r.work) for r in I.batches(plan, 10, 3).orderBy("batch").collect()]
    assert got == [(0, 1, 10), (2, 2, 1), (3, 3, 30), (4, 6, 6)]
    assert I.batches(plan, 0, 0).count() == 7


def test_signed_and_limits(spark):
    plain, signed = pdfs.build([HOLA]), pdfs.build([HOLA], page={"ByteRange": [0, 0, 0, 0]})
    form = pdfs.build([HOLA], catalog={"AcroForm": {"SigFlags": 2}})
    found = facts(pdfs.table(spark, plain, signed, form), "objects")
    assert {r.doc_id: r.is_signed for r in D.signed(found, section(found, "objects")).collect()} == {0: False, 1: True, 2: True}
    assert {r.doc_id: r.sig_flags for r in D.signature_indicators(found).collect()} == {0: False, 1: False, 2: False}
    none = spark.createDataFrame([], "doc_id long, work long")
    assert D.limit_rejections(found, none, CompressOptions(max_pages=1)).count() == 0
    assert D.limit_rejections(found, none, CompressOptions(max_pages=0, max_objects=1)).first().kind == "pages"


def test_bad_files_are_rows(spark):
    rows = facts(pdfs.table(spark, b"junk", pdfs.build([b""], trailer={"Encrypt": {"V": 1}}), pdfs.build([HOLA])), "pages").collect()
    assert [r.status for r in sorted(rows)] == ["parse_error", "encrypted", "ok"]


def test_same_result_for_any_partitioning(spark):
    docs = spark.createDataFrame([(i, "text " * (i * 7 % 90)) for i in range(40)], "doc_id long, text string")
    rows = [sorted(map(str, section(facts(bridge.files(docs.repartition(n)), "pages", "images"), "images").collect())) for n in (1, 4, 16)]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_removal_of_a_word():
    got = removed(pdfs.build([HOLA]), ("a", 0, 5, 5, 100, 20))
    assert got["regions"] == [{"id": "a", "page": 0, "status": "removed", "removed_glyphs": 4}] and got["modified"]
    assert glyphs(got["content"]) == []


@pytest.mark.parametrize("body", [
    b"BT /F1 10 Tf 10 10 Td (abcdefgh) Tj ET", b"BT /F1 10 Tf 10 10 Td [(abc) -120 (def) 30 (gh)] TJ ET", b"BT /F1 10 Tf 12 TL 10 22 Td (abcdefgh) ' ET", b"BT /F1 10 Tf 12 TL 10 22 Td 1 0.5 (abcdefgh) \" ET", b"BT /F1 10 Tf 80 Tz 1 Tc 10 10 Td <6162636465666768> Tj ET",
])
def test_the_rest_of_the_line_does_not_move(body):
    data = pdfs.build([body])
    before = glyphs(data)
    third, fifth = before[2], before[4]
    got = removed(data, ("a", 0, third.x, 0, fifth.x + fifth.advance - third.x, 30))
    assert got["regions"][0]["status"] == "removed" and got["regions"][0]["removed_glyphs"] == 3
    after = glyphs(got["content"])
    want = before[:2] + before[5:]
    assert [g.code for g in after] == [g.code for g in want] and all(abs(a.x - b.x) < 0.01 for a, b in zip(after, want, strict=True))


@pytest.mark.parametrize("more, region, want", [
    ({"page": {"Rotate": 90}}, ("a", 0, 5, 5, 100, 20), "skipped_page_geometry"), ({"media": (10, 0, 612, 792)}, ("a", 0, 5, 5, 100, 20), "skipped_page_geometry"),
    ({}, ("a", 0, 300, 300, 10, 10), "nothing_found"), ({}, ("a", 5, 5, 5, 10, 10), "skipped_invalid_region"), ({}, ("a", 0, 5, 5, -1, 10), "skipped_invalid_region"),
    ({"trailer": {"Encrypt": {"V": 1}}}, ("a", 0, 5, 5, 100, 20), "skipped_encrypted"),
])
def test_removal_statuses(more, region, want):
    data = pdfs.build([HOLA], **more)
    got = removed(data, region)
    assert got["regions"][0]["status"] == want and got["content"] == data and not got["modified"]


@pytest.mark.parametrize("body, want", [(b"BT 4 Tr /F1 12 Tf 10 10 Td (hola) Tj ET", "skipped_unsupported_text"), (b"BI /W 1 /H 1 ID x EI " + HOLA, "skipped_content"), (b"BT /F1 12 Tf 0 1 -1 0 20 10 Tm (hola) Tj ET", "skipped_unsupported_text")])
def test_text_that_cannot_be_removed(body, want):
    assert removed(pdfs.build([body]), ("a", 0, 0, 0, 100, 50))["regions"][0]["status"] == want


def test_shared_streams_and_risks():
    annots = {"Annots": [{"Subtype": Name("Link"), "Rect": [0, 0, 50, 50]}, Ref(999, 0)]}
    data = pdfs.build([HOLA, HOLA], shared=True, page=annots)
    got = removed(data, ("a", 0, 5, 5, 100, 20))
    assert [r["kind"] for r in got["residual_risks"]] == ["shared_content_stream", "annotation"]
    assert got["inspection_gaps"] == [{"reason": "broken_reference", "page": 0, "detail": "999 0 R"}]
    assert glyphs(got["content"], 0) == [] and len(glyphs(got["content"], 1)) == 4


def test_replacement_reuses_codes():
    data = pdfs.build([b"BT /F1 12 Tf 10 10 Td (hola) Tj ( mar) Tj ET"])
    first = glyphs(data)
    got = replaced(data, ("a", 0, 9, 5, first[3].x + first[3].advance - 9, 20, "loha"))
    row = got["replacements"][0]
    assert (row["status"], row["original_text"], row["replaced_glyphs"]) == ("replaced", "hola", 4)
    after = glyphs(got["content"])
    assert "".join(g.text for g in after) == "loha mar" and abs(after[4].x - first[4].x) < 0.01


@pytest.mark.parametrize("new, want", [("hxla", "skipped_no_reusable_code"), ("", "skipped_invalid_region"), ("olaholahola", "skipped_layout"), ("hal", "replaced")])
def test_replacement_statuses(new, want):
    assert replaced(pdfs.build([HOLA]), ("a", 0, 5, 5, 100, 20, new))["replacements"][0]["status"] == want


def test_replacement_is_sequential_and_spots_stale_selections():
    got = replaced(pdfs.build([HOLA]), ("a", 0, 5, 5, 100, 20, "aloh"), ("b", 0, 5, 5, 100, 20, "hola"))
    assert [r["status"] for r in got["replacements"]] == ["replaced", "skipped_stale_selection"]


def test_edits_as_tables(spark):
    files = pdfs.table(spark, pdfs.build([HOLA]), pdfs.build([HOLA]))
    out = E.exit_code(E.remove_text(files, regions(spark, ("a", 0, 5, 5, 100, 20), doc_id=1))).collect()
    assert [(r.doc_id, r.exit_code, r.modified) for r in out] == [(1, 0, True)]


def test_arrangement(spark):
    outline = {20: {"First": Ref(21, 0), "Last": Ref(22, 0)}, 21: {"Title": b"1", "Dest": [Ref(10, 0), Name("Fit")], "Next": Ref(22, 0)}, 22: {"Title": b"2", "Dest": [Ref(12, 0), Name("Fit")]}}
    link = {"Annots": [{"Subtype": Name("Link"), "Rect": [0, 0, 1, 1], "A": {"S": Name("GoTo"), "D": b"two"}}]}
    data = pdfs.build([b"(one) Tj", b"(two) Tj", b"(three) Tj"], page=link, catalog={"Outlines": Ref(20, 0), "Names": {"Dests": {"Names": [b"one", [Ref(10, 0)], b"two", [Ref(12, 0)]]}}, "PageLabels": {}}, extra=outline)
    plan = spark.createDataFrame([(0, 0, 2, 90), (0, 1, 0, 0)], "doc_id long, ord int, source int, rotate int")
    row = E.arrange_pages(pdfs.table(spark, data), plan).first()
    assert (row.error, row.pages_in, row.pages_out, row.outline_items_removed, row.links_removed, row.named_dests_removed, row.page_labels_dropped) == (None, 3, 2, 1, 1, 1, True)
    doc = read(bytes(row.content))
    pages = content.pages(doc)
    assert [p.inherited["Rotate"] for p in pages] == [90, 0] and [content.content_bytes(doc, p) for p in pages] == [b"(three) Tj", b"(one) Tj"]
    bad = spark.createDataFrame([(0, 0, 1, 0), (0, 1, 1, 0)], plan.schema)
    assert E.arrange_pages(pdfs.table(spark, data), bad).first().error == "a page is named twice"


def test_compress_shrinks_a_photo(spark):
    img = pdfs.picture(400)
    data = pdfs.build([PAINT], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.jpeg_image(400, quality=98)})
    row = C.compress(pdfs.table(spark, data)).first()
    assert row.status == "ok" and row.output_bytes < row.input_bytes and row.images[0].action == "downsampled"
    doc = read(bytes(row.content))
    image = next(v for v in doc.objects.values() if isinstance(v, Stream) and v.dict.get("Subtype") == "Image")
    out = jpeg.decode(image.raw)
    assert (image.dict["Width"], image.dict["Height"]) == (300, 300) == out.shape[:2]
    assert colour.psnr(colour.resized(img, 300, 300), out) > 25


def test_compress_policies(spark):
    form = Stream({"Type": Name("XObject"), "Subtype": Name("Form"), "BBox": [0, 0, 10, 10]}, b"0 0 10 10 re f")
    widget = {"Annots": [{"Subtype": Name("Widget"), "FT": Name("Sig"), "Rect": [10, 10, 30, 30], "AP": {"N": Ref(40, 0)}}]}
    data = pdfs.build([HOLA], page=widget, catalog={"AcroForm": {"SigFlags": 3, "Fields": []}}, extra={40: form})
    for policy, same, flat in (("strict", True, 0), ("flatten", False, 1), ("ignore", False, 0)):
        row = C.compress(pdfs.table(spark, data), CompressOptions(signatures=policy)).first()
        assert (bytes(row.content) == data) == same and row.flattened == flat, policy
        doc = read(bytes(row.content))
        body = content.content_bytes(doc, content.pages(doc)[0])
        assert (b"2 0 0 2 10 10 cm /Sig1 Do" in body) == (policy == "flatten")
        assert ("AcroForm" in doc.catalog) == (policy != "flatten")


def test_compress_grayscale_dedupe_and_report(spark):
    extra = {30: pdfs.flate_image(pdfs.picture(400, 1), Name=Name("A")), 31: pdfs.flate_image(pdfs.picture(400, 1), Name=Name("B"))}
    data = pdfs.build([PAINT + b" q 144 0 0 144 200 0 cm /I1 Do Q"], xobjects={"I0": Ref(30, 0), "I1": Ref(31, 0)}, extra=extra)
    done = C.compress(pdfs.table(spark, data), CompressOptions(grayscale=True, dedupe_images=True))
    row = done.first()
    assert row.gray == 2 and row.deduplicated == 1
    import json

    report = json.loads(C.report_json(done, "flatten").first().report)
    assert report["report_schema_version"] == 1 and report["images"]["total"] == 2 and report["output"]["bytes"] == row.output_bytes
    assert report["document"]["visual_appearance_preserved"] is True


def test_scan_evidence_and_analyze(spark):
    page = b"q 612 0 0 792 0 0 cm /I0 Do Q"
    data = pdfs.build([page], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.flate_image(np.zeros((400, 400), np.uint8))})
    rows = {r.doc_id: r for r in api.analyze(pdfs.table(spark, data, pdfs.build([HOLA]), b"x")).collect()}
    assert rows[0].has_scanned_pages and not rows[1].has_scanned_pages and rows[2].status == "parse_error"


def test_telemetry(spark):
    image = pdfs.flate_image(np.zeros((4, 4), np.uint8))
    form = Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"X": Ref(31, 0), "F": Ref(40, 0)}}}, b"/X Do /F Do")
    data = pdfs.build([b"/F Do /I Do BI /W 1 /H 1 ID abc EI"], xobjects={"F": Ref(40, 0), "I": Ref(30, 0)}, extra={30: image, 31: image, 40: form})
    row = api.structural_telemetry(pdfs.table(spark, data)).first()
    assert (row.inline_images, row.inline_bytes, row.form_only_images, row.form_depth, row.uninspectable) == (1, 3, 1, 1, 1)


def test_reachability(spark):
    data = pdfs.build([HOLA], extra={50: {"A": Ref(51, 0)}, 51: {"B": 1}})
    found = facts(pdfs.table(spark, data), "objects", "refs")
    assert {r.num for r in D.unreachable(section(found, "objects"), section(found, "refs")).collect()} == {50, 51}


def test_duplicate_streams_and_remap(spark):
    same = Stream({"K": 1}, zlib.compress(b"abc"))
    data = pdfs.build([HOLA], extra={50: same, 51: same, 52: {"A": Ref(51, 0)}})
    found = facts(pdfs.table(spark, data), "objects", "refs")
    twins = D.duplicate_streams(section(found, "objects"))
    assert [(r.num, r.canonical) for r in twins.collect()] == [(51, 50)]
    assert D.remapped(section(found, "refs"), twins).where("src_num = 52").first().dst_num == 50


def test_stream_ingest_equals_batch(spark, tmp_path):
    from quirelake.sources.tables import pdf_files
    from quirelake.streaming import ingest

    for i in range(5):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.pdf").write_bytes(pdfs.build([HOLA] * (i + 1)))
    query = ingest.profile_stream(ingest.arriving(spark, f"{tmp_path}/in", 2), f"{tmp_path}/out", f"{tmp_path}/cp", "pages")
    query.awaitTermination(60)
    batch = facts(pdf_files(spark, f"{tmp_path}/in"), "pages")
    pick = lambda df: sorted((r.doc_id, r.page_count) for r in df.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == pick(batch) and len(pick(batch)) == 5
    seen, progress = ingest.observed(batch)
    seen.write.format("noop").mode("overwrite").save()
    assert progress.get == {"files": 5, "failed": 0}


def test_cli(spark, tmp_path, capsys):
    from quirelake import cli

    source, target = tmp_path / "a.pdf", tmp_path / "b.pdf"
    source.write_bytes(pdfs.build([HOLA]))
    args = cli.parser().parse_args(["remove-text", str(source), str(target), "--region", "1:5,5,100,20", "--json"])
    code, report = cli.run(args, spark)
    assert code == 0 and report["regions"][0]["status"] == "removed" and glyphs(target.read_bytes()) == []
    assert cli.run(cli.parser().parse_args(["analyze", str(source)]), spark)[0] == 0
    assert cli.run(cli.parser().parse_args(["compress", str(source), str(target)]), spark)[0] == 0
    with pytest.raises(ValueError):
        cli.regions_of(["x@1:1,2,3,4", "x@1:1,2,3,4"])


def test_options():
    assert CompressOptions().resolved() == (150, 65) and CompressOptions(profile="screen", jpeg_quality=9).resolved() == (72, 9)
    with pytest.raises(ValueError):
        CompressOptions(profile="none")


def test_queries_have_names():
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {*sql} <= {*queries} and len(queries) >= 30


@pytest.mark.parametrize("width, height, want", [(8, 8, 1), (300, 300, 1), (301, 8, 0), (8, 301, 0)])
def test_small_stamps_of_any_filter_are_preserved(spark, width, height, want):
    data = pdfs.build([PAINT], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.flate_image(np.zeros((height, width, 3), np.uint8))})
    found = facts(pdfs.table(spark, data), "images")
    assert I.preserved(section(found, "images"), found).count() == want


def test_transcode_settings_stand_beside_the_plan(spark):
    data = pdfs.build([PAINT], xobjects={"I0": Ref(30, 0)}, extra={30: pdfs.flate_image(pdfs.picture(600, 1))})
    found = facts(pdfs.table(spark, data), "images", "placements", "resources", "refs")
    images = section(found, "images")
    placed = I.placed_images(section(found, "placements"), section(found, "resources"), images)
    none = images.select("doc_id", "num", "gen").where("false")
    row = I.image_plan(images, placed, none, none, CompressOptions(transcode_dpi=100, transcode_quality=40)).first()
    assert (row.lossless, row.target_width, row.quality, row.first_target_width, row.first_quality) == (True, 300, 65, 200, 40)


def test_colour_decides_whether_gray_is_written():
    from quirelake.functions import rewrite
    from quirelake.functions.pdf import Document

    doc = Document({}, {}, "1.4")
    plan = {"is_soft_mask": False, "lossless": True, "downsample": False, "first_downsample": False, "quality": 65, "first_quality": 65, "decode": None, "turns_gray": True}
    flat = pdfs.flate_image(np.full((1, 1, 3), 7, np.uint8))
    assert rewrite.reworked(doc, flat, plan, CompressOptions(grayscale=True))[:1] == ("kept",)
    photo = pdfs.flate_image(pdfs.picture(400, 1))
    action, _, new, gray, _ = rewrite.reworked(doc, photo, plan, CompressOptions(grayscale=True))
    assert action == "recompressed" and gray and new.dict["ColorSpace"] == "DeviceGray"
