import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from recmill.llm.cooccur import basket_pairs, counter_pairs
from recmill.llm.groupsplit import assign_splits, min_labels, people
from recmill.llm.leakage import held_words, leaked
from recmill.llm.mixing import mix
from recmill.llm.nearest import hilbert_key, nearest
from recmill.llm.reading import clear_levels, reading_levels
from recmill.llm.setjoin import distinct_sets, expand_pairs, similar_sets
from recmill.llm.tex import prose_sentences, source_words
from recmill.llm.topn import top_n

RNG = np.random.default_rng(1)


def test_people_and_splits(spark):
    acc = spark.createDataFrame([(1, "Ab_C1"), (2, " abc1\u200b"), (2, "xyz"), (3, "ＸＹＺ"), (4, "none"), (5, "N/A"), (6, None), (None, "xyz"), (7, "--")], "user_id int, steam_id string")
    t = dt.datetime(2020, 1, 1)
    ev = [(u, i, 3.0, t + dt.timedelta(days=i)) for u in (8, 9) for i in range(5)] + [(10, i, 3.0, t + dt.timedelta(days=i)) for i in range(4)] * 3 + [(11, None, 3.0, t)]
    log = spark.createDataFrame(ev, "user_id int, item_id int, rating double, timestamp timestamp_ntz").withColumn("entity", F.lit("clash")).withColumn("label", F.lit(1))
    got = {(r["user_id"], r["group_id"]) for r in people(acc, log).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (8, 8), (9, 8)}
    assert people(acc.where("false"), log.where("false")).count() == 0
    chain = spark.createDataFrame([(i, e) for i in range(40) for e in (i, i + 1)], "record int, entity long")
    assert {r["label"] for r in min_labels(chain).collect()} == {0}
    rows = spark.createDataFrame([(0 if i % 3 == 0 else i % 400, i % 4) for i in range(6000)] + [(None, 1)], "g int, l int")
    s = assign_splits(rows, "g", "l", {"train": 0.8, "test": 0.2}).collect()
    assert len(s) == len({r["g"] for r in s}) == 400 and {r["split"] for r in s} == {"train", "test"}


def test_nearest(spark):
    assert len(set(hilbert_key(np.array(list(itertools.product(range(4), repeat=2))), 2).tolist())) == 16
    v = RNG.standard_normal((400, 8)).astype(np.float32)
    v[5] = v[6]
    v[7] = 2 * v[8]
    rows = [("a", i, [float(x) for x in r]) for i, r in enumerate(v)] + [("a", 900, None), ("a", 901, [0.0] * 8), ("a", 902, [float("nan")] * 8), ("a", 903, [1.0])]
    vec = spark.createDataFrame(rows, "kind string, id int, vec array<float>").withColumn("probe", F.lit("clash"))
    probes = spark.createDataFrame([("a", i) for i in (0, 0, 5, 7, 900, 999)] + [(None, 1)], "kind string, id int")
    got = {(r["probe"], r["rank"]): r["id"] for r in nearest(vec, probes, 5, 8).collect()}
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {}
    for p in (0, 5, 7):
        s = np.round(u @ u[p], 6)
        s[p] = -9
        for k, i in enumerate(sorted(range(400), key=lambda i: (-s[i], i))[:5]):
            want[p, k + 1] = i
    assert len(got) == 15 and sum(got[k] == want[k] for k in want) >= 14
    assert nearest(vec.where("false"), probes, 5, 8).count() == 0


def test_nearest_of_copies(spark):
    """More copies of a vector, equal and proportional, than a window holds: the smallest ids count."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((700, 8)).astype(np.float32)
    v[200:450] = v[200]
    v[450:600] = np.float32(3) * v[200]
    vec = spark.createDataFrame([("a", i, [float(x) for x in r]) for i, r in enumerate(v)], "kind string, id int, vec array<float>")
    probes = spark.createDataFrame([("a", i) for i in (200, 330, 449, 520, 599)], "kind string, id int")
    got = {}
    for r in nearest(vec, probes, 5, 8).orderBy("rank").collect():
        got.setdefault(r["probe"], []).append(r["id"])
    assert got == {p: [i for i in range(200, 206) if i != p][:5] for p in (200, 330, 449, 520, 599)}


def test_similar_sets(spark):
    sets = {i: set(RNG.choice(60, RNG.integers(3, 15), replace=False).tolist()) for i in range(80)}
    sets[81], sets[82] = sets[3], sets[3]
    rows = [(i, [*s, *list(s)[:2], None]) for i, s in sets.items()] + [(90, []), (91, None), (92, [None]), (None, [1])]
    df = spark.createDataFrame(rows, "item int, users array<int>").withColumn("id", F.lit(7))
    s, copies = distinct_sets(df, "item", "users")
    got = {(r["record_a"], r["record_b"]) for r in expand_pairs(similar_sets(s, 0.3), copies).collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert got == want and (3, 81) in got


def test_pairs(spark, monkeypatch):
    import recmill.llm.cooccur as co

    monkeypatch.setattr(co, "BLOCK", 4)  # every basket of more items is cut into blocks
    rows = [(int(b), int(i)) for b in range(30) for i in RNG.choice(25, RNG.integers(1, 15), replace=False)]
    df = spark.createDataFrame([*rows, *rows[:9], (None, 1), (1, None)], "u int, i int").withColumn("g", F.lit("clash"))
    got = {(r["item_a"], r["item_b"]): r["n_both"] for r in basket_pairs(df, "u", "i").collect()}
    want = {}
    for b in range(30):
        for x, y in itertools.combinations(sorted({i for u, i in rows if u == b}), 2):
            want[x, y] = want.get((x, y), 0) + 1
    assert got == want
    c = spark.createDataFrame([(0, 1, 2, None), (0, 1, 2, None), (1, 2, 1, 4), (0, 3, 3, 9), (0, None, 1, 1)], "shard int, r int, c int, h int")
    assert [(r["item_a"], r["item_b"], r["hits"], r["hits_all"]) for r in counter_pairs(c, "r", "c", "h").collect()] == [(1, 2, 5, 5)]
    assert basket_pairs(df.where("false"), "u", "i").count() == 0


def test_basket_query_counts_every_pair(spark, tmp_path):
    from recmill.llm.q_cooccur import p5_basket_pairs

    spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0), (2, 1, 5.0), (2, 2, None), (2, 3, 1.0)], "user int, item int, rating float").write.parquet(f"{tmp_path}/topn_java_ratings.parquet")
    got = {(r["item_a"], r["item_b"]): (r["n_both"], r["n_a"], r["n_b"]) for r in p5_basket_pairs(spark, str(tmp_path)).collect()}
    assert got == {(1, 2): (2, 2, 2), (1, 3): (1, 2, 1), (2, 3): (1, 2, 1)}


def test_top_n(spark):
    rows = [("a", 1, i, s, 3) for i, s in enumerate([0.5, 0.5, None, float("nan"), 0.9, -0.0, 0.0, -1.5])]
    rows += [("a", 1, 4, 0.1, 3), ("b", 1, 5, 0.0, -1), ("b", 1, 6, -2.0, -1), ("c", 2, 5, 1.0, None), ("d", 1, 1, 1.0, 0), (None, 1, 1, 1.0, 3), ("a", 1, None, 5.0, 3)]
    rows += [("e", 1, int(i), float(x), 7) for i, x in enumerate(RNG.integers(0, 5, 3000) / 10)]
    df = spark.createDataFrame(rows, "k string, u int, i int, score float, n int").withColumn("code", F.lit(1)).withColumn("cutoff", F.lit(2))
    got = {}
    for r in top_n(df, ["k", "u"], "i", "score", "n").collect():
        got.setdefault(r["k"], set()).add(r["i"])
    e = sorted((r for r in rows if r[0] == "e"), key=lambda r: (-r[3], r[2]))[:7]
    assert got == {"a": {4, 0, 1}, "b": {5, 6}, "c": {5}, "e": {r[2] for r in e}}
    assert top_n(df.where("false"), ["k", "u"], "i", "score", "n").count() == 0


PASSAGE = "the careful voukoul records one hidden rating from regular protocol while our modest vlarudrad measures each breateal near central griatrem"


def test_words_and_prose():
    assert source_words("\\def\\sys{\\textsc{Alpha}}\n\\sys{} the ﬁl-\n% ter ca\\-r\\'eful~\\cite{r1} \\emph{x}\\footnote{See text.} $a+b$")[-5:] == ["alpha", "the", "filter", "careful", "x"]
    tex = "\\documentclass{article}\\title{No}\r\n\\begin{document}\\section{Head}\nOne \\emph{two} three (Fig.~\\ref{f}). %gone\n Four $x^2$ five.\n\\begin{equation}skip\\end{equation}\n\\begin{itemize}\\item Six seven.\\end{itemize}\\iffalse off. \\fi\n\\begin{comment}off\\end{comment}\\footnote{off.}\n\\begin{thebibliography}{9} off"
    assert [s.split()[0] for s in prose_sentences(tex)] == ["One", "Four", "Six"]
    assert prose_sentences("") == [] and prose_sentences("\\begin{document}\\end{document}") == []


def test_leaks(spark):
    w = PASSAGE.split()
    part = " ".join(w[:10])
    texts = [PASSAGE.upper(), "intro words here " + " ".join([*w[:11], *(["filler"] * 30), *w[11:]]), part, " ".join(w[:4]), None, "", "% " + PASSAGE.replace(" ", "~\n% "), " ".join(reversed(w)), "pad " * 50_000 + PASSAGE]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, PASSAGE), (0, PASSAGE.upper())], "doc_id long, text string").withColumn("grams", F.lit(1))
    tests = spark.createDataFrame([(1, PASSAGE), (2, ""), (3, None), (4, "too short")], "test_id int, text string")
    assert {r["doc_id"] for r in leaked(docs, tests).collect()} == {0, 1, 2, 6, 8}
    assert leaked(docs.where("false"), tests).count() == 0 and leaked(docs, tests.where("false")).count() == 0
    ids = np.arange(20)
    assert held_words(ids, np.concatenate([[90], ids[:12], [91]])) == (12, 1) and held_words(ids, ids[:5])[0] == 0


def test_mixture(spark):
    rows = [(i, "alpha beta gamma delta " * (20 if s == "A" else 5), s) for i, s in enumerate(["A"] * 10 + [" b\t"] * 10 + [None] * 4)] + [(99, None, "a"), (None, "x", "a"), (98, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit("clash"))
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    m = mix(docs, t)
    got = {r["source"]: r for r in m.sources.collect()}
    assert not got["a"]["falls_short"] and got["b"]["falls_short"]
    assert got["a"]["reached"] == pytest.approx(got["a"]["target"], rel=0.1)
    copies = m.documents.collect()
    assert len(copies) == 26 and all(0 <= r["rate"] <= 2 for r in copies)
    assert all(r["size"] == 0 for r in mix(docs.where("false"), t).sources.collect())


def test_reading(spark):
    short = "The red cat sat on a mat by the low wall. A big dog ran to the old pond. "
    long = "Phenomenological regularization circumscribes " + "electromagnetic heteroscedasticity " * 14 + "notwithstanding infinitesimal approximations. "
    docs = spark.createDataFrame([(i, (short if i % 2 else long) * 12) for i in range(40)] + [(90, None), (91, ""), (92, short), (None, short)], "doc_id long, text string").withColumn("level", F.lit("clash"))
    labels = spark.createDataFrame([(i, "r1", "plain" if i % 2 else "demanding") for i in range(30)] + [(31, None, None), (None, "r", "plain"), (3, "r2", "middle")], "doc_id long, rater string, level string")
    got = reading_levels(docs, labels)
    level = {r["doc_id"]: r["level"] for r in got.collect()}
    assert all(level[i] == ("plain" if i % 2 else "demanding") for i in range(30, 40)) and level[90] is None and level[91] is None  # held out
    clear = {r["doc_id"]: r["level"] for r in clear_levels(got).collect()}
    assert clear == {i: "plain" if i % 2 else "demanding" for i in range(40)}
    assert reading_levels(docs.where("false"), labels.where("false")).count() == 0
