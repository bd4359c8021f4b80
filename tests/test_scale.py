"""What keeps the work of the file queries in proportion to their input."""

import re

import pytest
from pyspark.sql import functions as F

from quirelake.functions import content, rewrite, text
from quirelake.functions.pdf import Lexer, Name, Ref, Stream, read, write_classic
from quirelake.operators import text as T
from quirelake.options import CompressOptions
from quirelake.plans import editing, inspection
from quirelake.plans import text as text_plans
from quirelake.sources import bridge
from quirelake.sources.tables import _wanted, facts

from . import pdfs


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents in one row group, so that its scan is one task."""
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(d, f"({d}) some\\text " * (1 + 700 * (d % 5 == 0)), "en", "s", 0) for d in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{out}/documents.parquet")
    return out


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["remove_first_line", "removed_text", "removal_exit_codes", "residual_risks", "replace_first_word", "arrange_drop_last", "arranged_rotation", "compress_actions", "compress_invariants", "strict_signatures", "region_first_wins", "glyph_gaps"])
def test_no_file_and_no_glyph_is_shuffled_or_sorted(spark, tables, name):
    """Joins and exchanges lie below the making of files (rows of documents) or above it without bytes and glyphs."""
    plan = plan_of((editing.QUERIES | text_plans.QUERIES)[name](spark, tables))
    above = plan.split("MapInArrow", 1)[0]
    assert "Join" not in above and "Window" not in above and "Sort" not in above
    for keys in re.findall(r"Exchange (\w+)", above):
        assert keys in ("hashpartitioning", "SinglePartition") and "HashAggregate" in above


def test_one_row_group_is_dealt_out_evenly(spark, tables):
    made = bridge.made(inspection.documents(spark, tables))
    sizes = [n for _, n in made.select("doc_id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == bridge.tasks(inspection.documents(spark, tables)) and max(sizes) <= 2 * 300 / len(sizes)


def test_equal_images_are_encoded_once_and_keep_their_own_references(monkeypatch):
    calls = []
    plain = rewrite.encoded
    monkeypatch.setattr(rewrite, "encoded", lambda *a: calls.append(1) or plain(*a))
    monkeypatch.setattr(rewrite, "_recent", rewrite.Recent(1 << 20))
    out = []
    for orphans, turned in ((0, False), (2, False), (0, True)):
        mask = pdfs.flate_image(pdfs.picture(60, colours=1))
        objects = {20 + orphans: mask, 30: pdfs.flate_image(pdfs.picture(60), SMask=Ref(20 + orphans, 0))}
        data = pdfs.build([b"/I Do"], xobjects={"I": Ref(30, 0)}, extra=objects)
        plan = {"num": 30, "gen": 0, "action": "candidate", "skip_reason": None, "stream_len": 0, "filters": ["FlateDecode"], "smask": "stream", "decode": None, "has_color_key": False, "is_soft_mask": False, "lossless": True, "downsample": True, "target_width": 20, "target_height": 20, "quality": 50, "first_downsample": True, "first_target_width": 20, "first_target_height": 20, "first_quality": 50, "turns_gray": turned}
        made = rewrite.compress(data, [plan], CompressOptions(), False)
        assert made["images"][0]["action"] == "downsampled"
        image = next(v for v in read(made["content"]).objects.values() if isinstance(v, Stream) and "SMask" in v.dict)
        out.append((image.raw, image.dict["SMask"], len(calls)))
    assert out[0][0] == out[1][0] and out[0][1] == Ref(20, 0) and out[1][1] == Ref(22, 0)
    assert out[0][2] == out[1][2] == 1 and out[2][2] == 3 and out[2][0] != out[0][0]


def test_recent_images_stay_within_their_bytes():
    kept = rewrite.Recent(4 * 1512)
    for i in range(10):
        kept.put(bytes([i]), rewrite.Encoded("recompressed", None, bytes(1000)))
    assert kept.held <= kept.most and kept.get(bytes([9])) and kept.get(bytes([0])) is None


def test_only_wanted_columns_are_worked_out(spark):
    found = facts(pdfs.table(spark, pdfs.build([b""])), "objects(num, kind)", keep=("content",))
    row = found.first()
    assert [f.name for f in found.schema["objects"].dataType.elementType] == ["num", "kind"] and row["objects"][0]["kind"] == "dict"
    assert bytes(row["content"]).startswith(b"%PDF") and list(_wanted("outline")[1]) == ["position", "dest_page"]


BODY = b"BT /F1 10 Tf 14 TL 2 Tc 3 Tw 90 Tz 1 Ts 50 700 Td (one two) Tj ( and) Tj T* [(th\\(ree) -250 <666f7572> 100 (x)] TJ 1 0.2 -0.1 1 20 30 Tm (five) Tj 0 Tc (si x) ' ET q 2 0 0 2 5 5 cm BT /F1 7 Tf 1 1 Td () Tj (seven) Tj ET Q"


def by_hand(ops, widths):
    """Places of the glyphs of BODY's operators, glyph by glyph."""
    times, out = text._times, []
    ctm, stack, s = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], {"Tc": 0.0, "Tw": 0.0, "TL": 0.0, "Ts": 0.0, "Tz": 100.0, "Tf": 0.0}
    for op in ops:
        name, v = op.operator, op.operands
        if name == "q":
            stack.append((ctm, dict(s)))
        elif name == "Q":
            ctm, s = stack.pop()
        elif name == "cm":
            ctm = times(tuple(map(float, v)), ctm)
        elif name == "Tf":
            s["Tf"] = float(v[1])
        elif name in s:
            s[name] = float(v[0])
        elif name == "BT":
            tm = line = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        elif name == "Tm":
            tm = line = tuple(map(float, v))
        elif name in ("Td", "T*", "'"):
            tm = line = times((1, 0, 0, 1, *(map(float, v) if name == "Td" else (0, -s["TL"]))), line)
        for x in v[0] if name == "TJ" else v if name in ("Tj", "'") else []:
            if isinstance(x, bytes):
                for c in x:
                    m = times(times((s["Tf"] * s["Tz"] / 100, 0, 0, s["Tf"], 0, s["Ts"]), tm), ctm)
                    own = (widths.get(c, 0.0) / 1000 * s["Tf"] + s["Tc"] + (s["Tw"] if c == 32 else 0.0)) * (s["Tz"] / 100)
                    out.append((bytes([c]), m[4], m[5], own))
                    tm = times((1, 0, 0, 1, own, 0), tm)
            else:
                tm = times((1, 0, 0, 1, -float(x) / 1000 * s["Tf"] * s["Tz"] / 100, 0), tm)
    return out


def test_glyphs_lie_where_they_lie_one_by_one():
    doc = read(pdfs.build([BODY]))
    page = content.pages(doc)[0]
    ops = content.operations(content.content_bytes(doc, page))
    seen = text.interpret(doc, page, ops)
    widths = next(iter(text.page_fonts(doc, page).values())).widths
    want = by_hand(ops, widths)
    assert [(g.code, g.x, g.y, g.own_advance) for g in seen.glyphs] == want
    assert seen.said_whole() == "one two andth(reefourxfivesi xseven" and len(want) == 35


def test_a_page_of_unlike_lines_takes_no_matrix_of_the_longest():
    doc = read(pdfs.build([b"BT /F1 1 Tf 1 TL (" + b"a" * 200_000 + b") Tj" + b" T* (b) Tj" * 400 + b" ET"]))
    page = content.pages(doc)[0]
    seen = text.interpret(doc, page, content.operations(content.content_bytes(doc, page)))
    assert len(seen.columns()["x"]) == 200_400 and seen.columns()["y"][-1] == -400


def test_gaps_need_no_window(spark):
    of = pdfs.table(spark, pdfs.build([BODY, b"BT /F1 10 Tf (x) Tj ET"]), b"junk")
    narrow = T.gaps(T.glyph_rows(of, "doc_id", "page_no", "glyph", "x", "y", "advance", "next_x", "next_y"))
    assert "Window" not in plan_of(narrow)
    rows = lambda df: sorted((r.page_no, r.glyph, r.gap) for r in df.collect())
    assert rows(narrow) == rows(T.gaps(T.glyph_rows(of))) and rows(narrow)


def test_regions_that_files_bring_along(spark):
    of = pdfs.table(spark, pdfs.build([BODY, BODY]), b"junk")
    regions = [(d, i, f"r{i}", p, 40.0 + 10 * i, 690.0, 30.0, 40.0) for d in (0, 1) for p in (0, 1) for i in (1, 0)] + [(0, 2, "none", 0, float("nan"), 0.0, 1.0, 1.0)]
    regions = spark.createDataFrame(regions, "doc_id long, ord int, id string, page int, x double, y double, width double, height double")
    items = regions.groupBy("doc_id").agg(F.collect_list(F.struct("ord", "id", "page", "x", "y", "width", "height")).alias("regions"))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(T.region_counts(of.join(items, "doc_id"))) == rows(T.region_hits(T.glyph_rows(of), regions)) and rows(T.region_counts(of.join(items, "doc_id")))


def test_shortcuts_read_what_tokens_read():
    """A comment between tokens keeps the lexer from its shortcuts."""
    tokens = [b"<<", b"/A", b"12", b"/B", b"-3", b"/C", b"+4", b"/D", b"5 0 R", b"/E", b"/F#20x", b"/G", b"[1 2", b"3]", b"/H", b"(a\\(b\\)\\\\)", b"/I", b"<<", b"/J", b"null", b">>", b"/K", b"1.5", b"/L", b"[", b"5 0 R", b"]", b"7", b"/M", b"/N", b">>"]
    quick, slow = Lexer(b" ".join(tokens)).value(), Lexer(b" %c\n".join(tokens)).value()
    assert quick == slow and list(map(type, quick.values())) == list(map(type, slow.values())) and quick["D"] == Ref(5, 0) and quick["E"] == "F x" and isinstance(quick["E"], Name)
    body = [b"q", b"1", b"-.5", b"0 0 1 5 cm", b"/I", b"Do", b"(x\\)y)", b"Tj", b"T*", b"[(a) -3 (b)]", b"TJ", b"true", b"/P", b"BDC", b"Q"]
    assert content.operations(b" ".join(body)) == content.operations(b" %c\n".join(body)) and content.operations(b" ".join(body))[3].operands == [b"x)y"]


def test_rows_of_the_cross_reference_are_read_at_once():
    doc = read(pdfs.build([b"BT ET"]))
    data = write_classic(doc)
    loose = data.replace(b" 00000 n \n", b"  00000 n\n")  # rows of the same length that are not of the usual form
    assert read(loose).objects.keys() == doc.objects.keys() == read(data).objects.keys()
