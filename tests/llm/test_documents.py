"""Operators on documents against brute force, on small tables with every oddity."""

import base64
import hashlib
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirelake.llm import byte_bpe, common, hash_ring, jaccard_join, language_id, license_scan, line_dedup, mixing, substring_dedup

from .common import crc, nothing, odd, odd_rows, prose


def test_substring_dedup_equals_brute_force(spark):
    rows = odd_rows()
    words = [(t or "").encode().split() for _, t, _, _ in rows]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = Counter()
    for (d, *_), w in zip(rows, words, strict=True):
        gone = {k for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    out = substring_dedup.remove_repeats(odd(spark))
    assert {"source", "size", "ids"} <= {*out.columns}
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()) == want
    assert substring_dedup.remove_repeats(nothing(spark)).count() == 0


def test_substring_dedup_partial_overlaps(spark):
    """Spans that overlap in part, at branching seeds and within one text."""
    p = prose("p", 90).split()
    texts = [" ".join(p), " ".join(p[10:60]), " ".join(["q"] + p[:40] + ["r"] + p[30:80]), " ".join(p[:34]), "again " * 50]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [t.encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = {}
    for d, w in enumerate(words):
        gone = {k for i in range(len(w) - 34) if starts[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        want[d] = len(gone)
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == want


@pytest.mark.parametrize("text, want", [
    ("Words.\nReleased under the MIT License.\nMore.", ["MIT"]),
    ("Licensed under the Apache License,\nversion 2.0.", ["Apache-2.0"]),
    ("This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", ["GPL-3.0", "CC-BY-NC-4.0"]),
    ("The MIT licence is nice.", []),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", []),
    (None, []),
    ("", []),
])
def test_licenses(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert license_scan.recognise(docs).first().licenses == want


def test_licenses_of_odd_tables(spark):
    assert license_scan.recognise(odd(spark)).count() == len(odd_rows())
    assert license_scan.recognise(nothing(spark)).count() == 0


def test_mixing_counts_and_shards(spark):
    out = mixing.mix(odd(spark), shards=5)
    rows = out.collect()
    assert len(rows) == len(odd_rows())
    total = sum(r["size"] for r in rows)
    targets = {r.source: r.target for r in rows}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += r["size"]
        assert len(r.draws) <= 2 and all(0 <= d.shard < 5 for d in r.draws)
        assert r["size"] == len((r.text or "").encode().split())
    for s, t in targets.items():
        assert t <= 2 * sizes[s] + 1e-9
    again = mixing.mix(odd(spark, parts=7), shards=5)
    key = lambda rs: sorted((str(r.doc_id), r["size"], str(r.draws)) for r in rs)
    assert key(rows) == key(again.collect())
    assert mixing.mix(nothing(spark)).count() == 0


def test_mixing_comes_near_targets(spark):
    rows = [(i, prose(i, 5 + i % 40), None, f"s{i % 4}" if i % 3 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mixing.mix(docs).select("source", "target", "size", (F.size("draws") * F.col("size")).alias("taken")).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    for r in out:
        assert abs(r.taken - r.target) <= 45, r


def test_splitting_tree_keeps_quotas(spark):
    quotas = spark.createDataFrame([("a", 100), ("b", 37), (None, 3), ("z", 0)], "source string, units long")
    rows = mixing.split(quotas, 6, "seed").collect()
    by = defaultdict(int)
    for r in rows:
        by[r.source] += r.units
        assert r.units >= 0
    assert dict(by) == {"a": 100, "b": 37, None: 3, "z": 0}
    shards = Counter()
    for r in rows:
        shards[r.shard] += r.units
    assert max(shards.values()) - min(shards.values()) <= 2


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = odd(spark)
    for r in byte_bpe.decode(byte_bpe.encode(docs, offsets=True)).collect():
        want = own.encode_ordinary(r.text or "")
        assert r.ids == struct.pack(f"<{len(want)}I", *want)
        assert r.decoded == (r.text or "").encode()
        spans = struct.unpack(f"<{2 * len(want)}I", r.ids_spans)
        assert not spans or spans[-1] == len(r.text)
    for r in byte_bpe.digest(docs).collect():
        assert r.n_tokens >= 0 and len(r.ids_sha256) == len(r.decoded_sha256) == 64
    assert byte_bpe.encode(nothing(spark)).count() == 0
    empty = byte_bpe.digest(docs.where("text IS NULL")).first()
    assert empty.n_tokens == 0 and empty.ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_bpe_pieces_that_recur_are_merged_once(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = byte_bpe.Codec(byte_bpe.default_ranks(), None), random.Random(4)
    texts = ["".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x3000), 32, 10, 39))) for _ in range(60)) for _ in range(50)]
    texts += ["", "it's \u0558\u0558a x\x1c\x85 y", "\0a\0", "word" * 500 + " " * 300, prose("pieces", 300)]
    want = [struct.pack(f"<{len(ids)}I", *ids) for ids in map(own.encode_ordinary, texts)]
    assert codec.encode_packed(texts) == want == codec.encode_packed(texts)
    merged, single = [], codec.single
    codec.single = type("", (), {"encode_batch_fast": lambda self, pieces, **kw: merged.extend(pieces) or single.encode_batch_fast(pieces, **kw)})()
    assert codec.encode_packed(texts) == want and all(len(p) > byte_bpe._SHORT for p in merged)
    monkeypatch.setattr(byte_bpe, "_REMEMBERED", 0)
    assert codec.encode_packed(texts) == want and len(merged) > 100


def test_hash_ring_is_balanced_and_gapless(spark):
    rows = [(i, prose(i, 3 + i % 30)) for i in range(2000)] + [(5, None), (None, "x"), (None, "x"), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = hash_ring.shard(docs, shards=8, cells=512, nodes=8).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 1, crc(t)) for d, t in rows)
    loads, slots = defaultdict(int), defaultdict(list)
    for r in out:
        loads[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values())
    assert hash_ring.shard(docs.where("false")).count() == 0


def test_hash_ring_moves_little(spark):
    """Without the bound, one shard more takes rows only into itself."""
    old, new = hash_ring.ring(8, 16, 1024), hash_ring.ring(9, 16, 1024)
    moved = [(a[0], b[0]) for a, b in zip(old, new, strict=True) if a[0] != b[0]]
    assert moved and {b for _, b in moved} == {8} and len(moved) < 1024 / 5


def _sets(rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def _components(rows, share=0.75):
    sets, ids = _sets(rows), [r[0] for r in rows]
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if None in (ids[i], ids[j]) or not sets[i] or not sets[j]:
                continue
            n = len(sets[i] & sets[j])
            if 100 * n >= 100 * share * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(ids[i]), root(ids[j])
                up[max(a, b)] = min(a, b)
    return Counter((d, len(s), None if d is None else root(d)) for d, s in zip(ids, sets, strict=True))


def test_jaccard_join_equals_brute_force(spark):
    rows = odd_rows()
    out = jaccard_join.cluster(odd(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == _components(rows)
    assert jaccard_join.cluster(nothing(spark)).count() == 0


def test_jaccard_join_on_families(spark, monkeypatch):
    """Families of copies at every distance, a passage that all share, and tokens dealt to several tasks."""
    import random

    rng, rows = random.Random(3), []
    shared = prose("shared", 30).split()
    for f in range(6):
        base = prose(f"family {f}", 60 + 10 * f).split()
        for k in range(25):
            own = list(base)
            for _ in range(k % 6):
                own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own + shared * (k % 2)), "en", "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = _components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect()) == want
    assert len({c for _, _, c in want}) < len(rows)


def test_parities_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 4000, n).astype(np.uint64)) for n in (0, 1, 7, 300, 300, 2500, 5000)]
    bounds = np.cumsum([0, *map(len, sets)])
    bits = jaccard_join.parities(bounds, np.concatenate(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart, most = jaccard_join.unlike(bits[i], bits[j]), len(np.setxor1d(a, b))
            assert apart <= most and (most - apart) % 2 == 0


def test_jaccard_salts_do_not_change_results(spark):
    """Rows of a token that the sketch deals to several tasks meet again."""
    rows = [(i, " ".join(["same"] * 3 + [f"w{j}" for j in range(40)] + [f"own{i}"]), "en", "s") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    old = jaccard_join.SALTED
    import pyspark.cloudpickle as cp

    cp.register_pickle_by_value(jaccard_join)
    jaccard_join.SALTED = 3
    try:
        got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect())
    finally:
        jaccard_join.SALTED = old
        cp.unregister_pickle_by_value(jaccard_join)
    assert got == _components(rows)


def test_line_dedup(spark):
    rows = [
        (1, "The first line is quite long enough here\nshort\n\nAnother line that stays where it is", "a"),
        (2, "THE FIRST line is quite long enough here!\nshort\nA third line of its very own words", "b"),
        (3, None, "c"),
        (4, "", "c"),
        (5, "Chapter 17 of the report on rainfall", "c"),
        (6, "Chapter 23 of the report on rainfall\n", "c"),
        (7, "Another line that stays where it is", "d"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert out[1].text == rows[0][1] and out[1].n_dropped == 0 and out[1].n_lines == 4
    assert out[2].text == "short\nA third line of its very own words"
    assert out[3].text is None and out[3].n_lines == 0 and out[4].text == ""
    assert out[5].text == rows[4][1] and out[6].text == "" and out[6].n_dropped == 1
    assert out[7].text == "" and out[7].n_lines == out[7].n_dropped == 1


def test_line_dedup_odd_tables(spark):
    out = line_dedup.dedup_lines(odd(spark))
    assert out.count() == len(odd_rows()) and "source" in out.columns
    assert line_dedup.dedup_lines(nothing(spark)).count() == 0


def test_edit_similarity_decides(spark):
    base = prose("line", 60)
    near, far = base.replace(base.split()[30], "changed", 1), prose("other", 60)
    one_more = base + " tail"
    rows = [(a, b, F) for a, b, F in ((base, near, True), (base, far, False), (base, one_more, True), ("", "", True), (base, base, True))]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    got = [r.c for r in df.select(line_dedup.close(F.col("a"), F.col("b"), F.lit(12)).alias("c")).collect()]
    assert got == [w for *_, w in rows]


def test_language_id_learns_and_is_defined(spark):
    en, fr = "the and of with this that there where".split(), "le et de avec cette que voilà où".split()
    import random

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(30)), "en" if i % 2 else "fr", "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = language_id.fit(docs.where("doc_id < 150"))
    out = language_id.predict(docs.where("doc_id >= 150"), model).collect()
    assert all(r.lang_pred == r.lang and 0.5 < r.score <= 1 for r in out)
    strange = language_id.predict(odd(spark), model).collect()
    assert len(strange) == len(odd_rows())
    for r in strange:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters), r.text
        assert 0 <= r.score <= 1
    nobody = language_id.fit(nothing(spark))
    assert {r.lang_pred for r in language_id.predict(odd(spark), nobody).collect()} == {"und"}


def test_language_id_backs_off_to_ngrams(spark):
    docs = spark.createDataFrame([(i, "ththth thththth" if i % 2 else "zzqzz zzqzzq", "aa" if i % 2 else "bb") for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.predict("thth", {})[0] == "aa" and model.predict("qzzqzzz", {})[0] == "bb"


def test_text_tag_and_kernel():
    import numpy as np

    words = common.Words([b"a b  c", b"", b"b c a b c"])
    assert words.first.tolist() == [0, 3, 3, 8]
    two = words.runs(2)
    assert two[1] == two[3] and two[0] != two[1] and two[3] == two[6]
    assert len(np.unique(words.hashes())) == len(np.unique(words.hashes(1))) == 3


def found_pairs(spark, pairs):
    """Share of the line pairs of which one goes; each line is a document."""
    docs = spark.createDataFrame([(2 * i + j, t) for i, p in enumerate(pairs) for j, t in enumerate(p)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_dropped > 0").select("doc_id").collect()}
    return [2 * i + 1 in gone for i in range(len(pairs))]


def variants(n_words, count, kind, seed, letters="abcdefghijklmnopqrstuvwxyz"):
    """Pairs of a random line and its variant at edit similarity 0.9 or more."""
    rng, out = random.Random(f"{n_words} {kind} {seed}"), []
    for _ in range(count):
        words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n_words)]
        line = " ".join(words)
        most = len(line) // 10
        other = [*line]
        for i in rng.sample(range(len(line)), {"letter": 1, "third": max(1, most // 3), "half": max(1, most // 2), "most": most}[kind]):
            other[i] = rng.choice(letters)
        other = "".join(other)
        out.append((line, other))
    return out


def test_line_dedup_recall_at_each_length(spark):
    """Against the pairs as made, which all reach edit similarity 0.9: letters changed at random, up to a tenth of the line."""
    least = {"letter": 0.97, "third": 0.97, "half": 0.9, "most": 0.4}
    cases = [(n, k) for n in (5, 8, 14, 20, 35, 60, 100, 150) for k in least]
    pairs = [p for n, k in cases for p in variants(n, 40, k, 1)]
    hit = found_pairs(spark, pairs)
    for at, (n, k) in enumerate(cases):
        share = sum(hit[40 * at : 40 * at + 40]) / 40
        assert share >= least[k], (n, k, share)


def test_line_dedup_short_and_unsegmented_lines(spark):
    rng = random.Random(2)
    cjk = [chr(0x4E00 + i) for i in range(800)]
    pairs = variants(3, 60, "letter", 2) + variants(4, 60, "letter", 2)
    for n in (12, 18, 30, 60):
        for line in ("".join(rng.choice(cjk) for _ in range(n)) for _ in range(20)):
            pairs.append((line, line[: n // 2] + "龜" + line[n // 2 + 1 :]))
    pairs = [(a, b) for a, b in pairs if len(a) >= 10]
    hit = found_pairs(spark, pairs + [("Terms of use and privacy", "Terms of use und privacy"), ("Licensed under the MIT License", "Licenced under the MIT License")])
    assert hit[-1] and hit[-2] and sum(hit) >= 0.95 * len(hit)


def test_line_dedup_word_put_into_a_very_long_line(spark):
    pairs = []
    for i, n in enumerate((130, 300, 1000, 2000) * 5):
        words = prose(f"very long {i}", n, 4000).split()
        pairs.append((" ".join(words), " ".join([*words[: 1 + i % 9], "insertion", *words[1 + i % 9 :]])))
    assert all(found_pairs(spark, pairs))


def test_line_dedup_repeated_line_of_short_words(spark):
    rng = random.Random(4)
    line = " ".join(rng.choice("abcdef") + rng.choice("abcdef") for _ in range(200))
    assert found_pairs(spark, [(line, line), ("00 11 22 " * 60, "00 11 22 " * 60)]) == [True, True]


def test_line_dedup_keeps_rows_that_differ_in_digits(spark):
    pairs = [("1234 5678 9012", "9876 5432 1098"), ("call 030 1234567 now", "call 089 7654321 now"), ("1234 5678 9013", "1234-5678-9013")]
    assert found_pairs(spark, pairs) == [False, False, True]


def twins(n):
    """Two words of n letters that polynomial hashes modulo a power of two take for one: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_simple_hashes_confuse_are_told_apart(spark, n):
    sides = [f"{prose('left', 20)} {w} {prose('right', 20)}" for w in twins(n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(sides)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs).collect()] == [0, 0]
    short = spark.createDataFrame([(i, f"one two three {w} five six seven") for i, w in enumerate(twins(n))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.cluster(short).collect()} == {(0, 0), (1, 1)}


def test_substring_dedup_of_many_rows_without_doc_id(spark):
    passage = prose("shared by all", 50)
    docs = spark.createDataFrame([(None, f"{prose(i, 40)} own{i} {passage}") for i in range(300)], "doc_id long, text string")
    assert {(r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()} == {(91, 50)}


def test_jaccard_join_of_groups_with_one_prefix(spark):
    """Sets that agree in prefix and size, but not in the rest: members of one group that must be told apart."""
    import numpy as np

    texts = [prose("one group", 80), prose("one group", 78) + " other end", prose("another", 80)]
    bounds, h = jaccard_join.sets_of([t.encode() for t in texts], 5)
    assert len(bounds) == 4 and len(np.unique(h)) <= len(h)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.cluster(docs).collect())
    assert got == _components(rows)


def test_walk_word_by_word_is_no_less_than_the_distance(spark):
    """Texts that take the longer way: what is accepted is within the distance, what is refused is not."""
    rng, rows = random.Random(9), []
    for i in range(30):
        words = prose(f"long {i}", 150, 4000).split()
        other = list(words)
        for _ in range(rng.randrange(25)):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = [f"new{rng.randrange(99)}"] * rng.randrange(2)
        rows.append((" ".join(words), " ".join(other)))
    df = spark.createDataFrame(rows, "a string, b string")
    most = F.lit(60)
    got = df.select(line_dedup.close(F.col("a"), F.col("b"), most).alias("c"), (F.levenshtein("a", "b") <= most).alias("d"), F.length("a").alias("n")).collect()
    assert all(r.c == r.d for r in got) and {r.c for r in got} == {True, False} and max(r.n for r in got) > line_dedup.SHORT_TEXT


def test_line_dedup_cuts_lines_once_and_deals_them_once(spark, monkeypatch):
    """The normal form is made in one place, and one exchange of the lines that meet serves their leaders too."""
    made, norm, stored = [], line_dedup.norm, common.stored
    monkeypatch.setattr(line_dedup, "norm", lambda text: made.append("norm") or norm(text))
    a = prose("dealt", 20)
    docs = spark.createDataFrame(list(enumerate([a, a.upper() + "!", prose("other", 20), a + " end"])), "doc_id long, text string")
    assert {r.doc_id for r in line_dedup.dedup_lines(docs).where("n_dropped > 0").collect()} == {1, 3} and made == ["norm"]
    met = stored(spark.createDataFrame([(1, 1, 0, 0, 20, 1), (1, 2, 0, 0, 20, 2)], "key long, line long, x long, y long, chars int, n long"), "dealt")
    monkeypatch.setattr(common, "stored", lambda df, *a: df)
    pairs = line_dedup.led(met, ["key"], 0.9)
    assert [(r.a, r.b) for r in pairs.collect()] == [(1, 2)]
    assert "ReusedExchange" in pairs._jdf.queryExecution().executedPlan().toString()
