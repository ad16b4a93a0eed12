"""Problem 7: passages of evaluation texts within the documents of a corpus.

Every document is read once, as the words of its source (``tex.source_words``). Its three-word grams that
occur in a passage are noted and counted over the whole corpus; of every four consecutive grams of a
passage the rarest is a seed, so any six undisturbed words hold one. Documents that share two seeds with a
passage are aligned with it by Smith-Waterman around the places where they share grams, once for each
stretch that the passage may be torn into.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recmill.llm.tex import source_words
from recmill.session import cut, spread

#: Words in a gram; grams in a window of which the rarest is a seed; seeds that make a candidate.
GRAM, SEED_WINDOW, MIN_SEEDS = 3, 4, 2
#: Share of a passage's words that must be held, the shortest stretch that counts, and the stretches it may be in.
MIN_SHARE, MIN_STRETCH, STRETCHES = 0.4, 10, 2
#: Words of a passage that are aligned at once; a longer one is aligned in parts, whose held words add up.
PART_WORDS = 4_000
#: Words of evaluation text that one pass over the corpus handles; a larger set takes several passes.
WORDS_PER_PASS = 2_000_000


def align(passage: np.ndarray, text: np.ndarray) -> tuple[int, list[tuple[int, int]], tuple[int, int], tuple[int, int]]:
    """Best local alignment (match 1, mismatch and gap -1): score, matched places, and the ranges it spans in both."""
    n, m = len(passage), len(text)
    h = np.zeros((n + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    row = np.zeros(m + 1, np.int32)
    for i in range(1, n + 1):
        same = np.where(text == passage[i - 1], 1, -1)
        row[1:] = np.maximum(np.maximum(h[i - 1, :-1] + same, h[i - 1, 1:] - 1), 0)
        # a gap in the passage: the best earlier cell, less one for each word since
        h[i] = np.maximum.accumulate(row + ramp) - ramp
    i, j = (int(x) for x in np.unravel_index(h.argmax(), h.shape))
    score, end, matched = int(h[i, j]), (i, j), []
    while i and j and h[i, j] > 0:
        equal = text[j - 1] == passage[i - 1]
        if h[i, j] == h[i - 1, j - 1] + (1 if equal else -1):
            if equal:
                matched.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matched[::-1], (i, end[0]), (j, end[1])


def _windows(at: np.ndarray, reach: int, size: int) -> list[tuple[int, int]]:
    """Ranges of a text of ``size`` words that hold all places up to ``reach`` from one of ``at``, in tiles of at most
    4 * ``reach`` words of which neighbours overlap by 2 * ``reach``."""
    at = np.sort(at)
    first = np.flatnonzero(np.append(True, at[1:] - at[:-1] > 2 * reach))
    out = []
    for a, z in zip(at[first], at[np.append(first[1:], len(at)) - 1], strict=True):
        lo, hi = max(0, int(a) - reach), min(size, int(z) + reach + 1)
        while hi - lo > 4 * reach:
            out.append((lo, lo + 4 * reach))
            lo += 2 * reach
        out.append((lo, hi))
    return out


def held_words(passage: np.ndarray, text: np.ndarray, at: np.ndarray | None = None, min_stretch: int = MIN_STRETCH, stretches: int | None = STRETCHES) -> tuple[int, int]:
    """(words of the passage that the text holds, stretches they are in): at most ``stretches`` (None: any number)
    of ``min_stretch`` words or more.

    ``at`` names the places in the text where the two share a gram; without it all places may. A local alignment
    of positive score spans at most twice the passage on either side of a gram that it contains, so only
    windows of that reach are aligned, whatever the text's length.
    """
    if len(passage) > PART_WORDS:
        parts = [held_words(passage[a : a + PART_WORDS], text, at, min_stretch, stretches) for a in range(0, len(passage), PART_WORDS)]
        return sum(p[0] for p in parts), max(p[1] for p in parts)
    p, t, held, found = passage.copy(), text.copy(), 0, 0
    windows = _windows(np.arange(0, len(t), 2 * len(p)) if at is None else at, 2 * len(p), len(t)) if len(t) and len(p) else []
    while windows and (stretches is None or found < stretches):
        best = None
        for lo, hi in windows:
            score, matched, rows, cols = align(p, t[lo:hi])
            if best is None or score > best[0]:
                best = score, matched, rows, (cols[0] + lo, cols[1] + lo)
        _, matched, rows, cols = best
        if min(rows[1] - rows[0], cols[1] - cols[0]) < min_stretch:
            break
        held, found = held + len(matched), found + 1
        p[rows[0] : rows[1]], t[cols[0] : cols[1]] = -2, -3
    return held, found


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """Code of the gram that begins at each place; -1 where one of its words is unknown."""
    if len(ids) < GRAM:
        return np.zeros(0, np.int64)
    code, known = np.zeros(len(ids) - GRAM + 1, np.int64), np.ones(len(ids) - GRAM + 1, bool)
    for k in range(GRAM):
        part = ids[k : len(ids) - GRAM + 1 + k]
        code, known = code * size + part, known & (part >= 0)
    return np.where(known, code, -1)


def _scan(vocabulary: dict[str, int], codes: np.ndarray):
    """(doc_id, text) in; of documents with MIN_SEEDS known grams: their grams, one place of each after the other, and
    their words as numbers."""
    size = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            docs, grams, places, words = [], [], [], []
            for d, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([get(w, -1) for w in source_words(text)], np.int32)
                code = _grams(ids, size)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                on = np.flatnonzero(codes[at] == code)
                if len(np.unique(at[on])) >= MIN_SEEDS:
                    docs.append(d)
                    grams.append(at[on].astype(np.int32))
                    places.append(on.astype(np.int32))
                    words.append(ids)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), *(pa.array(x, pa.list_(pa.int32())) for x in (grams, places, words))], names=["doc_id", "grams", "places", "words"])

    return run


def _seeds(passages: dict[int, np.ndarray], codes: np.ndarray, seen: np.ndarray, size: int) -> dict[int, list[int]]:
    """Passages by seed (its place in ``codes``)."""
    out: dict[int, set[int]] = defaultdict(set)
    for t, ids in passages.items():
        at = np.searchsorted(codes, _grams(ids, size))
        for a in range(max(1, len(at) - SEED_WINDOW + 1) if len(at) else 0):
            w = at[a : a + SEED_WINDOW]
            out[int(w[np.argmin(seen[w])])].add(t)
    return {k: sorted(v) for k, v in out.items()}


def _aligned(seeds: dict[int, list[int]], own: dict[int, np.ndarray], passages: dict[int, np.ndarray], min_share: float, min_stretch: int, stretches: int | None):
    """``own``: the grams of every passage, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            words, grams, places = b.column("words"), b.column("grams"), b.column("places")
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                g, at = (x[i].values.to_numpy(zero_copy_only=False) for x in (grams, places))
                shared: dict[int, int] = defaultdict(int)
                for x in np.unique(g).tolist():
                    for t in seeds.get(x, ()):
                        shared[t] += 1
                for t, n in shared.items():
                    if n >= MIN_SEEDS:
                        held, found = held_words(passages[t], words[i].values.to_numpy(zero_copy_only=False), at[np.isin(g, own[t])], min_stretch, stretches)
                        if held >= min_share * len(passages[t]):
                            rows.append((d, t, held, len(passages[t]), found))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "test_id", "held", "words", "stretches"])

    return run


def leaked(documents: DataFrame, passages: DataFrame, words_per_pass: int = WORDS_PER_PASS, min_share: float = MIN_SHARE, min_stretch: int = MIN_STRETCH, stretches: int | None = STRETCHES) -> DataFrame:
    """(doc_id, test_id, held, words, stretches): the documents that hold ``min_share`` of a passage's words.

    ``documents(doc_id, text)``, ``passages(test_id, text)``. Words are runs of letters and digits of any script,
    ideographs and kana one by one. Passages are gathered ``words_per_pass`` words at a time, with a pass over
    the corpus for each; documents are read whole, in place, and never shuffled. Held words must lie in
    ``stretches`` (None: any number) of ``min_stretch`` words or more, so passages below ``min_stretch`` words are
    never held. Null ids and null or empty texts hold nothing; a repeated document row is reported once.
    """
    spark = documents.sparkSession
    docs = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    parts, now, n = [], {}, 0

    def one_pass(texts: dict[int, list[str]]) -> DataFrame:
        vocabulary = {w: i for i, w in enumerate(sorted({w for ws in texts.values() for w in ws}))}
        ids = {t: np.array([vocabulary[w] for w in ws], np.int32) for t, ws in texts.items()}
        codes = np.unique(np.concatenate([_grams(x, len(vocabulary)) for x in ids.values()]))
        noted = cut(docs.mapInArrow(_scan(vocabulary, codes), "doc_id long, grams array<int>, places array<int>, words array<int>"), "grams")
        # at most one row for each gram of the passages in this pass
        counts = noted.select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").count().collect()
        seen = np.zeros(len(codes), np.int64)
        for r in counts:
            seen[r["g"]] = r["count"]
        own = {t: np.unique(np.searchsorted(codes, _grams(x, len(vocabulary)))).astype(np.int32) for t, x in ids.items()}
        return noted.mapInArrow(_aligned(_seeds(ids, codes, seen, len(vocabulary)), own, ids, min_share, min_stretch, stretches), "doc_id long, test_id long, held int, words int, stretches int")

    for r in passages.where("test_id is not null and text is not null").select("test_id", "text").toLocalIterator():
        ws = source_words(r["text"])
        if len(ws) >= max(min_stretch, GRAM):
            now[r["test_id"]] = ws
            n += len(ws)
        if n >= words_per_pass:
            parts.append(one_pass(now))
            now, n = {}, 0
    if now:
        parts.append(one_pass(now))
    if not parts:
        return spark.createDataFrame([], "doc_id long, test_id long, held int, words int, stretches int")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
