"""Small tables with every oddity, and brute-force versions."""

import random
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag string, size string, marks string, ids string"


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    words = [f"{'bcdfghklmnprst'[i % 14]}{'aeiou'[i % 5]}{'lmnrst'[i % 6]}{i}x" for i in range(vocabulary)]
    return " ".join(rng.choice(words) for _ in range(n))


def odd_rows():
    """(doc_id, text, lang, source): nulls, empty, blank, very long, repeated, shared passages, near copies."""
    passage = prose("passage", 60)
    base = prose("base", 200).split()
    near = base[:50] + ["changed"] + base[51:]
    return [
        (1, prose(1, 120) + " " + passage, "en", "a"),
        (2, passage + "\n" + prose(2, 90), "en", "a"),
        (3, None, "en", "b"),
        (4, "", None, "b"),
        (5, " \t\n ", "fr", None),
        (6, " ".join(base), "fr", "a"),
        (7, " ".join(near), "fr", "c"),
        (8, " ".join(base), "fr", None),
        (8, " ".join(base), "fr", None),
        (None, prose(9, 50), "en", "c"),
        (None, passage, None, "c"),
        (10, prose("long", 20_000), "en", "d"),
        (11, "Three Short words", "en", "a"),
        (12, "three short WORDS", "en", "a"),
        (13, "tie " * 80, "en", "a"),
        (14, "日本語 テキスト ñandú x   y 😀", "es", "é"),
        (15, "$$$ 123 ½ ²", "en", "a"),
    ]


def odd(spark, parts=3):
    rows = [(d, t, l, s, len(t or ""), "clash", "clash", "clash", "clash") for d, t, l, s in odd_rows()]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def crc(text):
    return zlib.crc32((text or "").encode())
