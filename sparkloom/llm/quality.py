"""Document quality by hierarchical empirical Bayes.

A logistic model over hashed text features gives every document a log likelihood ratio for two faults (low
quality, toxic).  It is fitted on at most ``train_rows`` labelled documents, those with the smallest hash of
their id.  How often each fault occurs at a host and at a path of that host is estimated from all documents by
grouped aggregation and shrunk: a path towards its host, a host towards the corpus, by a strength that the
spread between the groups sets.  The prior of a document comes from the others of its path, its posterior adds
its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.joins import join_lookup
from . import _text
from ._shared import fresh, keep

FAULTS = ("low_quality", "toxic")
PREFIXES = (5, 6, 7, 8, 10)
#: Bytes of text whose features are formed at one time; they take some 50 times as much memory.
BLOCK = 1 << 19
#: Least share of a text for each step of a shape feature.
STEPS = (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7)

_WORD = np.zeros(256, np.bool_)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_SIGN = ~_WORD
_SIGN[:0x21] = _SIGN[0x7F] = False
_UPPER = np.zeros(256, np.bool_)
_UPPER[0x41:0x5B] = True


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature hash), sorted and each once: words, word beginnings, sign runs, shape steps."""
    data = _text.LOWER[raw]
    texts = len(offsets) - 1
    sums = _text.prefix_sums(data)
    starts, ends, doc = _text.tokens(_WORD, data, offsets)
    whole = _text.span_hashes(sums, starts, ends)
    docs, hashes = [doc], [whole]
    for n in PREFIXES:
        long = ends - starts > n
        docs.append(doc[long])
        hashes.append(_text.span_hashes(sums, starts[long], starts[long] + n) ^ np.uint64(n * 0x9E3779B1))
    s, e, sign_doc = _text.tokens(_SIGN, data, offsets)
    docs.append(sign_doc)
    hashes.append(_text.span_hashes(sums, s, e) ^ np.uint64(0xC2B2AE3D27D4EB4F))
    words = np.maximum(np.bincount(doc, minlength=texts), 1)
    again = np.zeros(len(whole), np.bool_)
    again[1:] = (whole[1:] == whole[:-1]) & (doc[1:] == doc[:-1])
    upper = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    shares = [np.bincount(doc[again], minlength=texts) / words, np.diff(upper[offsets]) / np.maximum(np.diff(offsets), 1),
              np.bincount(sign_doc[e - s > 1], minlength=texts) / words, np.bincount(sign_doc, minlength=texts) / words]
    for i, share in enumerate(shares):
        for j, step in enumerate(STEPS):
            has = np.flatnonzero(share >= step)
            docs.append(has)
            hashes.append(np.full(len(has), 1 + i * len(STEPS) + j, np.uint64))
    docs, hashes = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), np.bool_)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    return docs[new], hashes[new]


@dataclass
class Model:
    """Features, their weights and the intercept of each fault.

    ``fitted`` tells for each fault whether labels of both kinds were there; where not, its evidence is 0 and it
    rejects nothing.
    """

    keys: np.ndarray
    weights: np.ndarray  # features x faults
    intercepts: np.ndarray
    rates: np.ndarray
    fitted: tuple[bool, ...] = (True, True)

    def evidence(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Log likelihood ratio of every text (rows) for each fault (columns)."""
        out = np.tile(self.intercepts, (len(offsets) - 1, 1))
        if len(self.keys):
            docs, hashes = _features(raw, offsets)
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            hit = self.keys[at] == hashes
            np.add.at(out, docs[hit], self.weights[at[hit]])
        return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept (not shrunk)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3

    def loss(w):
        margin = x @ w
        return np.logaddexp(0, margin).sum() - y @ margin + (shrink * w * w).sum() / 2

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(shrink), x.T @ (y - p) - shrink * w)
        size = 1.0
        while (new := loss(w + size * step)) > now and size > 1e-4:
            size /= 2
        if new >= now - 1e-9 * abs(now):
            break
        w, now = w + size * step, new
    return w


def _clean_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, low_quality, toxic) as 0 or 1; a document with several labels has the worst of each."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") <= 0).cast("int")).alias("low_quality"), F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))


def _gain(a: Column, n: Column, total: float, rows: int) -> Column:
    """Log likelihood that a feature with ``a`` of ``total`` faulty documents among its ``n`` explains."""

    def part(seen: Column, size: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (size * share))).otherwise(0.0)

    share, rest = total / rows, F.lit(float(rows)) - n
    return part(a, n, share) + part(n - a, n, 1 - share) + part(F.lit(float(total)) - a, rest, share) + part(rest - F.lit(float(total)) + a, rest, 1 - share)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 12_000, features: int = 300, seed: int = 3) -> Model:
    """Fit on at most ``train_rows`` labelled documents and ``features`` features for each fault.

    Rows with a null id or label and documents without text are not used; without usable labels the evidence is
    0 for every document and nothing is rejected; a fault of which only one kind is labelled rejects nothing.
    """
    chosen = _clean_labels(labels).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(train_rows)
    sample = keep(docs.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        F.broadcast(chosen), "doc_id").repartition(16, "doc_id"), "quality-sample")
    totals = sample.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in FAULTS]).first()
    n, bad = totals.n, np.array([totals[f] for f in FAULTS], float)
    rates = (bad + 0.5) / (n + 1)
    fitted = tuple(bool(0 < b < n) for b in bad)
    if not any(fitted):
        return Model(np.zeros(0, np.uint64), np.zeros((0, 2)), np.zeros(2), rates, fitted)

    def count(batches):
        for batch in batches:
            fault = np.stack([batch.column(i).to_numpy() for i in (2, 3)], axis=1)
            for lo, _, raw, offsets in _text.blocks(batch.column(1), BLOCK):
                doc, h = _features(raw, offsets)
                keys, at = np.unique(h, return_inverse=True)
                y = fault[lo + doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.bincount(at)),
                     *[pa.array(np.bincount(at, weights=y[:, c]).astype(np.int64)) for c in (0, 1)]], names=["h", "n", "a0", "a1"])

    counts = sample.mapInArrow(count, "h long, n long, a0 long, a1 long").groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "a0", "a1")])
    counts = keep(counts.where("n >= 5"), "quality-features")
    keys: set[int] = set()
    for c, total in enumerate(bad):
        if fitted[c]:
            z = _gain(F.col(f"a{c}").cast("double"), F.col("n").cast("double"), total, n)
            keys |= {r.h for r in counts.select("h", z.alias("z")).orderBy(F.desc("z"), "h").limit(features).collect()}
    found = np.sort(np.array(list(keys), np.int64).view(np.uint64))

    def rows(batches):
        for batch in batches:
            for lo, hi, raw, offsets in _text.blocks(batch.column(1), BLOCK):
                doc, h = _features(raw, offsets)
                at = np.minimum(np.searchsorted(found, h), len(found) - 1)
                hit = found[at] == h
                yield pa.RecordBatch.from_arrays(
                    [_text.list_array(at[hit].astype(np.int32), np.bincount(doc[hit], minlength=hi - lo), pa.int32()),
                     batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo)], names=["at", "low_quality", "toxic"])

    taken = sample.mapInArrow(rows, "at array<int>, low_quality int, toxic int").toArrow()
    sizes = np.diff(taken["at"].combine_chunks().offsets.to_numpy())
    x = np.zeros((taken.num_rows, len(found)))
    x[np.repeat(np.arange(taken.num_rows), sizes), taken["at"].combine_chunks().flatten().to_numpy()] = 1
    weights, intercepts = np.zeros((len(found), 2)), np.zeros(2)
    for c, fault in enumerate(FAULTS):
        if fitted[c]:
            w = _logistic(x, taken[fault].to_numpy().astype(float))
            weights[:, c], intercepts[c] = w[:-1], w[-1] - np.log(rates[c] / (1 - rates[c]))
    return Model(found, weights, intercepts, rates, fitted)


def with_evidence(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (all columns) with ``__low_quality`` and ``__toxic``: log likelihood ratios."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def score(batches):
        for batch in batches:
            parts = [np.zeros((0, 2))] + [shared.value.evidence(raw, offsets) for _, _, raw, offsets in _text.blocks(batch.column(place), BLOCK)]
            e = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(np.ascontiguousarray(e[:, c])) for c in (0, 1)]],
                                             names=[*batch.schema.names, "__low_quality", "__toxic"])

    schema = T.StructType([*docs.schema.fields, T.StructField("__low_quality", T.DoubleType()), T.StructField("__toxic", T.DoubleType())])
    return docs.mapInArrow(score, schema)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column, count: Column, total: Column, least: float = 10.0, most: float = 1e6) -> Column:
    """Pseudo-count of a beta prior from the spread of group means beyond binomial noise (method of moments)."""
    spread = F.sum(count * F.pow(total / count - mean, F.lit(2.0))) / F.sum(count)
    noise = F.sum(mean * (1 - mean)) / F.sum(count)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return groups.agg(F.coalesce(F.least(F.lit(most), F.greatest(F.lit(least), F.avg(mean * (1 - mean)) / between - 1)), F.lit(most)).alias("k")).scalar()


def site_posteriors(scored: DataFrame, rates: np.ndarray) -> DataFrame:
    """(host, path, n, and for each fault: its sum, host mean and the strength of the host's pull on a path)."""
    p = {f: _sigmoid(F.lit(float(np.log(r / (1 - r)))) + F.col(f"__{f}")) for f, r in zip(FAULTS, rates)}
    paths = keep(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), *[F.sum(p[f]).alias(f"s_{f}") for f in FAULTS]), "quality-paths")
    hosts = keep(paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{f}").alias(f"h_{f}") for f in FAULTS]), "quality-hosts")
    for f in FAULTS:
        overall = hosts.agg((F.sum(f"h_{f}") + 0.5) / (F.sum("hn") + 1.0)).scalar()
        pull = _strength(hosts, overall, F.col("hn"), F.col(f"h_{f}"))
        hosts = hosts.withColumn(f"m_{f}", (F.col(f"h_{f}") + pull * overall) / (F.col("hn") + pull))
    out = keep(paths.join(hosts.drop("hn", *[f"h_{f}" for f in FAULTS]), "host"), "quality-sites")
    for f in FAULTS:
        out = out.withColumn(f"k_{f}", _strength(out, F.col(f"m_{f}"), F.col("n"), F.col(f"s_{f}")))
    return out


def judge(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` (all columns) with p_low_quality, p_toxic and rejected.

    Null hosts and null paths are sites of their own, named by the empty text.  Null and empty texts are judged
    by their lack of features.  Repeated rows are judged each.  Input columns named like the added ones are replaced,
    all others are carried as they are.  A fault that the model was not fitted for rejects nothing.
    """
    docs = docs.drop(*[f"p_{f}" for f in FAULTS], "rejected")
    names = docs.columns
    none, = fresh(docs, "none")  # the text travels once, beside the struct of all other columns
    own = docs.select(
        F.struct(F.lit(0).alias(none), *[F.col(f"`{c}`") for c in names if c != "text"]).alias("row"), F.col("text").cast("string").alias("text"),
        F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    sites = keep(site_posteriors(with_evidence(own.drop("row"), model), model.rates), "quality-priors")
    sites = sites.withColumnsRenamed({c: f"__{c}" for c in sites.columns if c not in ("host", "path")})
    both = join_lookup(with_evidence(own, model), sites, ["host", "path"], "inner")
    faulty = F.lit(False)
    for f, rate in zip(FAULTS, model.rates):
        own = _sigmoid(F.lit(float(np.log(rate / (1 - rate)))) + F.col(f"__{f}"))
        prior = (F.col(f"__s_{f}") - own + F.col(f"__k_{f}") * F.col(f"__m_{f}")) / (F.col("__n") - 1 + F.col(f"__k_{f}"))
        prior = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
        both = both.withColumn(f"p_{f}", _sigmoid(_logit(prior) + F.col(f"__{f}")))
        faulty = faulty | (F.lit(model.fitted[FAULTS.index(f)]) & (F.col(f"p_{f}") >= 0.5))
    return both.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in names], *[f"p_{f}" for f in FAULTS], faulty.alias("rejected"))


def drop_rejected(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """``docs`` (all columns) without the rejected documents."""
    return judge(docs, fit(docs, labels), host, path).where("not rejected").select(*docs.columns)
