import tracemalloc

import numpy as np

from recmill.llm.leakage import _windows, align, held_words, leaked
from recmill.llm.tex import source_words

LATIN = "the committee asked every member to explain in writing why the second measurement of 1887 differed so strongly from the first one".split()
CYRILLIC = "комитет попросил каждого участника письменно объяснить почему второе измерение так сильно отличалось от первого и кто его проводил".split()
KANJI = "委員会は各委員に第二の測定が第一の測定と大きく異なる理由を書面で説明するよう求めた"


def _found(spark, texts, passage, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'clash' as places")
    return {r["doc_id"]: r["stretches"] for r in leaked(docs, spark.createDataFrame([(1, passage)], "test_id int, text string"), **options).collect()}


def test_scripts(spark):
    filler = "и другие слова без связи с текстом " * 30
    assert set(_found(spark, [filler + " ".join(CYRILLIC).upper() + filler, filler, " ".join(CYRILLIC[:6])], " ".join(CYRILLIC))) == {0}
    assert set(_found(spark, ["序文。" * 40 + KANJI + "。以上。", "序文。" * 40], KANJI)) == {0}
    assert source_words("Nаïve x2 — 3,5 été") == ["nаive", "x2", "3", "5", "ete"]


def test_short_and_torn(spark):
    short = LATIN[:8]
    assert _found(spark, ["before " + " ".join(short) + " after"], " ".join(short)) == {}
    assert set(_found(spark, ["before " + " ".join(short) + " after"], " ".join(short), min_stretch=8)) == {0}
    gap = " ".join(f"filler{i}" for i in range(40))
    torn = f" {gap} ".join(" ".join(LATIN[a : a + 7]) for a in (0, 7, 14))
    assert _found(spark, [torn], " ".join(LATIN), min_stretch=6, stretches=None, min_share=0.9) == {0: 3}
    assert _found(spark, [torn], " ".join(LATIN), min_stretch=6, stretches=2, min_share=0.9) == {}


def test_windows_find_what_whole_texts_do():
    """Alignment around shared grams holds as many words as alignment with the whole text."""
    rng = np.random.default_rng(8)
    for _ in range(30):
        p = rng.integers(0, 300, 60).astype(np.int32)
        t = rng.integers(200, 500, 3_000).astype(np.int32)
        for a, at in ((0, 700), (30, 2_500)):
            piece = p[a : a + 30].copy()
            piece[rng.random(30) < 0.08] = 999
            t[at : at + 30] = piece
        grams = {tuple(p[i : i + 3]) for i in range(len(p) - 2)}
        places = np.array([i for i in range(len(t) - 2) if tuple(t[i : i + 3]) in grams])
        score, matched, _, _ = align(p, t)
        assert held_words(p, t, places)[0] >= len(matched) and score <= len(matched)
        assert held_words(p, t, places) == held_words(p, t)


def test_windows():
    got = _windows(np.array([5, 90, 5_000]), 50, 6_000)
    assert got == [(0, 141), (4_950, 5_051)]
    wide = _windows(np.arange(0, 2_000, 10), 50, 2_000)
    assert wide[0][0] == 0 and wide[-1][1] == 2_000 and all(z - a <= 200 for a, z in wide) and all(b[0] == a[0] + 100 for a, b in zip(wide[:-1], wide[1:], strict=True))


def test_long_text_in_bounded_memory():
    rng = np.random.default_rng(9)
    text = rng.integers(0, 50_000, 1_000_000).astype(np.int32)
    passage = rng.integers(0, 50_000, 1_000).astype(np.int32)
    text[600_000:601_000] = passage
    tracemalloc.start()
    got = held_words(passage, text, np.arange(600_000, 600_998, 3))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == (1_000, 1) and peak < 200e6
