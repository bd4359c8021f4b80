import pytest
from pyspark.sql import functions as F

from quirelake import api
from quirelake.operators import grayscale as G
from quirelake.operators import text as T
from quirelake.options import Region
from quirelake.plans.editing import glyph_rows

from . import pdfs

BODY = b"BT /F1 10 Tf 10 100 Td (abc) Tj 0 -20 Td (de) Tj ET"


def test_first_region_takes_a_glyph(spark):
    glyphs = glyph_rows(pdfs.table(spark, pdfs.build([BODY])))
    regions = api.region_rows(spark, [Region("a", 0, 0, 99, 300, 10), Region("b", 0, 0, 70, 300, 50), Region("bad", 0, 0, 0, -1, 5), Region("nan", 0, float("nan"), 0, 1, 5)])
    assert {r.id: r.glyphs for r in T.region_hits(glyphs, regions).collect()} == {"a": 3, "b": 2}


def test_gaps_and_codes(spark):
    glyphs = glyph_rows(pdfs.table(spark, pdfs.build([b"BT /F1 10 Tf 10 100 Td [(ab) -500 (a)] TJ ET"])))
    assert [round(r.gap, 3) for r in T.gaps(glyphs).orderBy("glyph").collect()] == [0, 5]
    assert {r.text: (r.codes, r.ambiguous) for r in T.code_inventory(glyphs).collect()} == {"a": (["61"], False), "b": (["62"], False)}


def test_scan_order(spark):
    pages = spark.createDataFrame([(0, i) for i in range(6)], "doc_id long, page_no int")
    targets = spark.createDataFrame([(0, 2)], "doc_id long, target int")
    assert [r.page_no for r in T.scan_order(pages, targets, 5).orderBy("place").collect()] == [2, 3, 1, 4, 0]


def test_annotation_overlap_is_strict(spark):
    rows = [(0, 0, i, r) for i, r in enumerate([[0.0, 0.0, 10.0, 10.0], [10.0, 10.0, 0.0, 0.0], [20.0, 20.0, 30.0, 30.0], [15.0, 15.0, 15.0, 99.0], None])]
    annotations = spark.createDataFrame(rows, "doc_id long, page_no int, position int, rect array<double>")
    regions = api.region_rows(spark, [Region("a", 0, 5, 5, 15, 15)])
    assert {(r.position, r.unreadable) for r in T.annotation_overlaps(annotations, regions).collect()} == {(0, False), (1, False), (4, True)}


@pytest.mark.parametrize("more, want", [({}, None), ({"decode": [1.0, 0.0] * 3}, "decode"), ({"decode": [0.0, 1.0] * 3}, None), ({"has_color_key": True}, "color_key_mask"), ({"filters": ["JPXDecode"]}, "image_unsupported"), ({"channels": 1, "color_space": "DeviceGray"}, "none"), ({"is_mask": True}, "none")])
def test_gray_eligibility(spark, more, want):
    row = {"doc_id": 0, "num": 1, "gen": 0, "is_mask": False, "channels": 3, "color_space": "DeviceRGB", "decode": None, "has_color_key": False, "filters": ["FlateDecode"], "bits": 8, "hival": None, "palette_bytes": None} | more
    images = spark.createDataFrame([row], "doc_id long, num int, gen int, is_mask boolean, channels int, color_space string, decode array<double>, has_color_key boolean, filters array<string>, bits int, hival int, palette_bytes long")
    none = images.select("doc_id", "num", "gen").where(F.lit(False))
    assert [r.residual for r in G.gray_plan(images, none, none).collect()] == ([] if want == "none" else [want])
    if want is None:
        assert G.gray_plan(images, images.select("doc_id", "num", "gen"), none).first().residual == "preserved_stamp"


def test_images_of_mask_groups(spark):
    import numpy as np

    from quirelake.functions.pdf import Name, Ref, Stream
    from quirelake.sources.tables import facts, section

    image = pdfs.flate_image(np.zeros((4, 4, 3), np.uint8))
    group = Stream({"Subtype": Name("Form"), "Resources": {"XObject": {"M": Ref(31, 0), "Self": Ref(40, 0)}}}, b"/M Do")
    state = {"ExtGState": {"G": {"SMask": {"S": Name("Luminosity"), "G": Ref(40, 0)}}}, "XObject": {"I": Ref(30, 0)}}
    data = pdfs.build([b"/G gs /I Do"], page={"Resources": state}, extra={30: image, 31: image, 40: group})
    found = facts(pdfs.table(spark, data), "images")
    images = section(found, "images")
    none = images.select("doc_id", "num", "gen").where(F.lit(False))
    plan = G.gray_plan(images, none, G.mask_groups(images, found))
    assert {r.num: r.residual for r in plan.collect()} == {30: None, 31: "mask_group"}
