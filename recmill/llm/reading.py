"""Problem 9: reading level of documents.

The prose of a document is cut into sentences. A character model and a word model, both regularised and
fitted on rated documents, give each sentence a distribution over levels; a document's sentences are
averaged and calibrated on rated documents that the sentence models did not see.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recmill.llm import hashed
from recmill.llm.tex import _LETTERS, prose_sentences
from recmill.session import spread

LEVELS = ["plain", "middle", "demanding"]
#: Rated documents that the models are fitted on, at most, and sentences of them.
MAX_RATED, MAX_SENTENCES = 2_000, 20_000
#: Share of the rated documents that is kept for calibration.
HELD_OUT = 0.4

Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def _sentence_levels(sentences: list[str], chars: np.ndarray, words: np.ndarray) -> np.ndarray:
    c, co, w, wo = hashed.features(sentences)
    n = len(sentences)
    return hashed.softmax(hashed.scores(chars, c, co, n) + hashed.scores(words, w, wo, n))


def _document_rows(levels: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Mean level distribution of each document's sentences, as logarithms."""
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    mean = np.stack([np.bincount(owner, weights=levels[:, c], minlength=n) for c in range(levels.shape[1])], 1) / size[:, None]
    return np.log(np.maximum(mean, 1e-6))


def fit_levels(documents: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> Model:
    """Fit on at most ``max_rated`` rated documents, chosen by hash; raters who differ make a shared label."""
    one = ratings.where(F.col("doc_id").isNotNull() & F.col("level").isin(LEVELS)).groupBy("doc_id").agg(*[F.sum((F.col("level") == x).cast("int")).alias(x) for x in LEVELS])
    chosen = one.orderBy(F.xxhash64("doc_id")).limit(max_rated)
    rows = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").collect()  # bounded by max_rated
    rows = [(prose_sentences(r["text"]), [r[x] for x in LEVELS]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    rows = [r for r in rows if r[0]]
    if not rows:
        k = len(LEVELS)
        return np.zeros((hashed.CHAR_BUCKETS, k)), np.zeros((hashed.WORD_BUCKETS, k)), np.zeros((k + 1, k))
    target = np.array([r[1] for r in rows], float)
    target /= target.sum(1, keepdims=True)
    held = np.arange(len(rows)) % 10 < 10 * HELD_OUT
    if held.all():
        held[:] = False
    texts = [s for r, h in zip(rows, held, strict=True) if not h for s in r[0]]
    of = np.repeat(np.flatnonzero(~held), [len(r[0]) for r, h in zip(rows, held, strict=True) if not h])
    if len(texts) > MAX_SENTENCES:
        take = np.random.default_rng(0).choice(len(texts), MAX_SENTENCES, replace=False)
        texts, of = [texts[i] for i in take], of[take]
    c, co, w, wo = hashed.features(texts)
    chars = hashed.fit(c, co, target[of], hashed.CHAR_BUCKETS)
    words = hashed.fit(w, wo, target[of], hashed.WORD_BUCKETS)
    kept = [(r, t) for r, t, h in zip(rows, target, held, strict=True) if h] or list(zip(rows, target, strict=True))
    sentences = [s for r, _ in kept for s in r[0]]
    owner = np.repeat(np.arange(len(kept)), [len(r[0]) for r, _ in kept])
    x = _document_rows(_sentence_levels(sentences, chars, words), owner, len(kept))
    return chars, words, hashed.fit_rows(x, np.array([t for _, t in kept]))


_SCHEMA = "doc_id long, n_sentences int, n_words int, n_letters long, p_plain double, p_middle double, p_demanding double"


def _scored(model: Model):
    chars, words, calibration = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for at in range(0, len(ids), 500):
                found = [prose_sentences(t) for t in texts[at : at + 500]]
                counts = np.zeros((len(found), 3), np.int64)
                for i, s in enumerate(found):
                    w = _LETTERS.findall("\n".join(s))
                    counts[i] = len(s), len(w), sum(map(len, w))
                flat, owner = [x for s in found for x in s], np.repeat(np.arange(len(found)), counts[:, 0])
                p = np.full((len(found), len(LEVELS)), np.nan)
                if flat:
                    x = _document_rows(_sentence_levels(flat, chars, words), owner, len(found))
                    p = hashed.softmax(np.hstack([x, np.ones((len(x), 1))]) @ calibration)
                    p[counts[:, 0] == 0] = np.nan
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[at : at + 500], pa.int64()), *(pa.array(counts[:, j], k) for j, k in enumerate((pa.int32(), pa.int32(), pa.int64()))), *(pa.array(p[:, j], pa.float64(), from_pandas=True) for j in range(3))],
                    names=[x.split()[0] for x in _SCHEMA.split(", ")],
                )

    return run


def reading_levels(documents: DataFrame, ratings: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, n_words, n_letters, p_plain, p_middle, p_demanding, level, difficulty) per document.

    ``level`` is the most probable one, ``difficulty`` the mean of the calibrated distribution from 0
    (plain) to 1 (demanding). A document without prose, or with a null or empty text, has counts of 0 and
    null level. Rows with a null doc_id are left out. Without usable ratings all levels are equally likely.
    """
    model = fit_levels(documents, ratings)
    docs = spread(documents.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    out = docs.mapInArrow(_scored(model), _SCHEMA)
    best = F.greatest("p_plain", "p_middle", "p_demanding")
    level = F.when(F.col("p_plain") == best, "plain").when(F.col("p_demanding") == best, "demanding").when(best.isNotNull(), "middle")
    return out.withColumn("level", level).withColumn("difficulty", F.col("p_middle") / 2 + F.col("p_demanding"))


#: Fixed values of the exact check: words a sentence, letters a word, words of prose.
PLAIN, DEMANDING, LEAST_WORDS = (14, 4.8), (24, 6.2), 100


def clear_levels(levels: DataFrame) -> DataFrame:
    """(doc_id, level): documents that the models call plain or demanding and whose counts confirm it."""
    wps, lpw = F.col("n_words") / F.col("n_sentences"), F.col("n_letters") / F.col("n_words")
    plain = (F.col("level") == "plain") & (wps < PLAIN[0]) & (lpw < PLAIN[1])
    hard = (F.col("level") == "demanding") & (wps > DEMANDING[0]) & (lpw > DEMANDING[1])
    return levels.where((F.col("n_words") >= LEAST_WORDS) & (plain | hard)).select("doc_id", "level")


def profile(levels: DataFrame, by: str) -> DataFrame:
    """Documents, words and mean difficulty per level and ``by``, with the level's share within ``by``."""
    n = levels.groupBy(by, "level").agg(F.count("*").alias("n_documents"), F.sum("n_words").alias("n_words"), F.round(F.avg("difficulty"), 6).alias("mean_difficulty"))
    return n.withColumn("share", F.round(F.col("n_documents") / F.sum("n_documents").over(Window.partitionBy(by)), 6))
