"""Problem 8: a mixture of sources with target shares of all tokens.

Documents with a known source belong to it; for the others a classifier, fitted on labelled documents,
gives the probability of each source. Every document gets a rate, how often it is taken, between 0 and
the cap of its source. Distributed projected gradient steps fit the rates so that the expected tokens of
each source come as near to its target as the caps permit, in the sense of least squares. Documents of a
known source all have the same rate, so a step needs one number for each source beside a pass over the
documents without one. Rounded rates are the copies, and the shares that were reached are those of the copies.
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recmill.llm import hashed
from recmill.operators.skew import prefix_sum
from recmill.session import cut, drop_cut, spread

#: A public byte-level vocabulary; any other file of ranks may be named instead.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that goes with that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Labelled documents that the source classifier is fitted on, at most.
MAX_LABELLED = 2_000
#: Change of the expected tokens (relative to the targets) in a step that counts as converged, and steps at most;
#: whether it converged is reported.
ENOUGH, MAX_STEPS = 1e-7, 500
#: Steps after which the rates of documents without a source are written, so that a pass repeats no more of them.
KEPT_STEPS = 8


def plain_source(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^[\s\x{00a0}]+|[\s\x{00a0}]+$", ""))


def _encoder(name: str):
    """The encoder of the vocabulary file that was sent along under ``name``."""
    import tiktoken
    from pyspark import SparkFiles

    kept = sys.modules["tiktoken"].__dict__.setdefault("_recmill_kept", {})  # once for each worker process
    if name not in kept:
        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[name] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return kept[name]


def fit_sources(documents: DataFrame, n_sources: int, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Word model of the sources, fitted on at most ``max_labelled`` documents(doc_id, text, s), chosen by hash."""
    chosen = documents.where("s is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id")).limit(max_labelled)
    rows = sorted(documents.where("s is not null and text is not null").join(F.broadcast(chosen), "doc_id").select("doc_id", "s", "text").collect())  # bounded by max_labelled
    if not rows:
        return np.zeros((hashed.WORD_BUCKETS, n_sources))
    _, _, w, wo = hashed.features([r["text"] for r in rows])
    return hashed.fit(w, wo, np.eye(n_sources)[[r["s"] for r in rows]], hashed.WORD_BUCKETS)


def _measured(weights: np.ndarray, tokenizer: str):
    """(doc_id, s, text) in, ``tokenizer`` being the name of a file that was sent along; tokens and membership of every document out."""
    k = weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text").to_pylist()
            s = b.column("s").fill_null(-1).to_numpy(zero_copy_only=False)
            tokens = [len(enc.encode_ordinary(t)) for t in texts]
            member = np.zeros((len(texts), k))
            member[np.flatnonzero(s >= 0), s[s >= 0]] = 1
            soft = np.flatnonzero(s < 0)
            for a in range(0, len(soft), 500):
                at = soft[a : a + 500]
                _, _, w, wo = hashed.features([texts[i] for i in at])
                member[at] = hashed.softmax(hashed.scores(weights, w, wo, len(at)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("s"), pa.array(tokens, pa.int64()), pa.array(list(member.astype(np.float32)), pa.list_(pa.float32()))], names=["doc_id", "s", "tokens", "member"])

    return run


def _stepped(member: np.ndarray, rate: np.ndarray, caps: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after further steps: each goes against the mean relative residual of the document's sources."""
    cap = member @ caps
    for r in steps:
        rate = np.clip(rate - member @ r, 0, cap)
    return rate


def _members(b: pa.RecordBatch) -> np.ndarray:
    return b.column("member").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)


def _expected(caps: np.ndarray, steps: list[np.ndarray]):
    """(tokens, member, rate) in; the expected tokens of every source out, one sum for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(caps))
        for b in batches:
            if b.num_rows:
                m = _members(b)
                total += (_stepped(m, b.column("rate").to_numpy(), caps, steps) * b.column("tokens").to_numpy()) @ m
        yield pa.RecordBatch.from_arrays([pa.array(range(len(caps)), pa.int32()), pa.array(total)], names=["s", "t"])

    return run


def _moved(caps: np.ndarray, steps: list[np.ndarray]):
    """(doc_id, tokens, member, rate) in and out, the rate after further steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tokens"), b.column("member"), pa.array(_stepped(_members(b), b.column("rate").to_numpy(), caps, steps))], names=["doc_id", "tokens", "member", "rate"])

    return run


_RATED = "doc_id long, tokens long, member array<float>, rate double"


def fit_known(size: np.ndarray, target: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Rates of documents whose source is known: the same projected gradient steps, for which the sources' sizes suffice."""
    rate, before = np.minimum(1.0, caps), None
    for _ in range(MAX_STEPS):
        before, rate = rate, np.clip(rate - (rate * size - target) / np.maximum(size, 1), 0, caps)
        if np.abs(rate - before).max(initial=0) <= 1e-12:
            break
    return rate


class Mixture:
    """What :func:`mix` found: ``sources`` (a report, one row per source) and ``documents`` (rate and copies)."""

    def __init__(self, sources: DataFrame, documents: DataFrame):
        self.sources, self.documents = sources, documents


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, max_labelled: int = MAX_LABELLED) -> Mixture:
    """Mix ``documents(doc_id, text, source)`` to ``targets(source, weight, max_repeats)``.

    Sources agree apart from letter case and outer white space; targets are one row per source, few enough
    for the driver. A document whose source is not among the targets (null, misspelt) is a member of all
    of them by the classifier's probabilities. Null ids are left out, null texts have no tokens, null
    weights and repeats count as 0; an empty corpus gives sizes of 0.

    ``sources``: size (tokens of the source's own documents), soft_size (with the expected tokens of documents
    without a source), target, rate (fitted, of its own documents), falls_short (its own documents, fitted by
    themselves, stay below its target: they do where max_repeats * size < weight * total of all sizes), expected (tokens at the fitted rates), reached (tokens of the copies) and its share, steps and
    converged. ``documents``: rate, and copies, which are the rate rounded up or down.
    """
    spark = documents.sparkSession
    goal = sorted((r["source"], r["key"], float(r["weight"] or 0), float(r["max_repeats"] or 0)) for r in targets.where("source is not null").select("source", plain_source(F.col("source")).alias("key"), "weight", "max_repeats").collect())
    k = len(goal)
    if not k:
        raise ValueError("no target sources")
    caps, weight = np.array([g[3] for g in goal]), np.array([g[2] for g in goal])
    number = F.create_map(*[x for i, g in enumerate(goal) for x in (F.lit(g[1]), F.lit(i))])
    docs = documents.where("doc_id is not null").select("doc_id", number[plain_source(F.col("source"))].alias("s"), F.coalesce("text", F.lit("")).alias("text"))
    weights = fit_sources(docs, k, max_labelled)
    spark.sparkContext.addFile(tokenizer)
    known = cut(spread(docs).mapInArrow(_measured(weights, os.path.basename(tokenizer)), "doc_id long, s int, tokens long, member array<float>"), "members")
    size = np.zeros(k)
    for r in known.where("s is not null").groupBy("s").agg(F.sum("tokens").alias("t")).collect():
        size[r["s"]] = r["t"]
    target = weight * size.sum()
    cap = F.aggregate(F.zip_with("member", F.array(*map(F.lit, caps.tolist())), lambda m, c: m.cast("double") * c), F.lit(0.0), lambda a, x: a + x)
    soft = cut(known.where("s is null").select("doc_id", "tokens", "member", F.least(F.lit(1.0), cap).alias("rate")), "soft")
    steps: list[np.ndarray] = []

    def soft_tokens(at: DataFrame) -> np.ndarray:
        got = np.zeros(k)
        for r in at.mapInArrow(_expected(caps, steps), "s int, t double").groupBy("s").agg(F.sum("t").alias("t")).collect():
            got[r["s"]] = r["t"]
        return got

    soft_size = size + soft_tokens(soft.select("tokens", "member", F.lit(1.0).alias("rate")))
    # documents of a known source alone: what their fitted rates leave open is the shortfall
    own = fit_known(size, target, caps)
    short = own * size < target * (1 - 1e-9)
    got, converged, done = own * size + soft_tokens(soft), False, 0
    while not converged and done < MAX_STEPS:
        r = (got - target) / np.maximum(soft_size, 1)
        own = np.clip(own - r, 0, caps)
        steps.append(r)
        before, got, done = got, own * size + soft_tokens(soft), done + 1
        converged = bool(np.abs(got - before).sum() <= ENOUGH * max(target.sum(), 1))
        if len(steps) == KEPT_STEPS:
            moved = cut(soft.mapInArrow(_moved(caps, steps), _RATED), "soft")
            drop_cut(soft)
            soft, steps = moved, []
    rate_of = F.element_at(F.array(*map(F.lit, own.tolist())), F.col("s") + 1)
    rated = known.where("s is not null").select("doc_id", "s", "tokens", rate_of.alias("rate"), F.lit(None).cast("array<float>").alias("member"))
    rated = rated.unionByName(soft.mapInArrow(_moved(caps, steps), _RATED).withColumn("s", F.lit(None).cast("int")))
    # rates are rounded up or down so that along each source, in hash order, copies keep up with rates
    parted = rated.select("doc_id", F.coalesce("s", F.lit(-1)).alias("s"), "tokens", "member", "rate", (F.col("rate") - F.floor("rate")).alias("part"))
    laid = prefix_sum(parted, ["s"], F.col("doc_id"), "part", "before")
    out = cut(laid.select("doc_id", F.when(F.col("s") >= 0, F.col("s")).alias("s"), "tokens", "member", "rate", (F.floor("rate") + F.floor(F.col("before") + F.col("part") + 0.5) - F.floor(F.col("before") + 0.5)).cast("int").alias("copies")), "copies")
    taken = out.where("copies > 0").select("s", "member", (F.col("tokens") * F.col("copies")).cast("double").alias("t"))
    shared = taken.where("s is null").select(F.posexplode("member").alias("s", "m"), "t").select("s", (F.col("m") * F.col("t")).alias("t"))
    reached = np.zeros(k)
    for r in taken.where("s is not null").select("s", "t").unionByName(shared).groupBy("s").agg(F.sum("t").alias("t")).collect():
        reached[r["s"]] = r["t"]
    share = reached / max(reached.sum(), 1e-9)
    rows = [(g[0], g[2], int(g[3]), int(size[i]), float(soft_size[i]), float(target[i]), float(own[i]), bool(short[i]), float(got[i]), float(reached[i]), float(share[i]), done, converged) for i, g in enumerate(goal)]
    report = spark.createDataFrame(rows, "source string, weight double, max_repeats int, size long, soft_size double, target double, rate double, falls_short boolean, expected double, reached double, share double, steps int, converged boolean")
    return Mixture(report, out.select("doc_id", "tokens", "rate", "copies"))
