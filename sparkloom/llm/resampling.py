"""Importance resampling of documents towards a target distribution of hashed n-grams.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 text, so ``bytes.split`` yields the words.  The
hash of an n-gram is the crc32 of its words joined by one space; chained seeds extend it by a word without joining
anything.  Counters reduce the words of a batch (corpus counts) or of a document (its weight) to distinct ones
first.  Two passes over the texts: bucket counts, then weights by the gains of the buckets; only the counts of the
buckets, whose number is a parameter, reach the driver.

The draw is the Gumbel top-k: a score adds noise from a hash of the id to the weight.  Ranks come from one range
partitioning of the rows above a coarse histogram's cut: places inside a partition plus the sizes of those before.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import keep

#: Word bytes are 0-9, a-z and all beyond ASCII; A-Z become a-z, every other byte a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

BLOCK_ROWS = 256
#: Scores are counted in steps of this many to find where the drawn ones end.
STEP = 64


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def grams(found: list[bytes], n: int) -> Counter:
    """Counts of the crc32 of all runs of 1 to ``n`` words."""
    counts = _hashed(Counter(found))
    if n == 1:
        return counts
    joined, seeds = [b" " + w for w in found], list(map(crc32, found))
    for size in range(1, n):
        seeds = list(map(crc32, joined[size:], seeds))
        counts.update(seeds)
    return counts


def _hashed(each: Counter) -> Counter:
    counts = Counter()
    for word, c in each.items():
        counts[crc32(word)] += c
    return counts


def _texts(column) -> Iterator[list[bytes]]:
    column = pc.fill_null(column, "").cast(pa.binary())
    for lo in range(0, len(column), BLOCK_ROWS):
        yield column.slice(lo, BLOCK_ROWS).to_pylist()


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many n-grams of all texts fall in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for some in _texts(batch.column(0)):
                if n == 1:
                    all_words: Counter = Counter()
                    for text in some:
                        all_words.update(words(text))
                    counts = _hashed(all_words)
                else:
                    counts = Counter()
                    for text in some:
                        counts.update(grams(words(text), n))
                h = np.fromiter(counts.keys(), np.int64, len(counts)) % buckets
                total += np.bincount(h, np.fromiter(counts.values(), np.float64, len(counts)), buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "c"])

    found = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["c"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of the smoothed ratio of target to source share) of every bucket."""
    s_all, t_all, b = int(source.sum()), int(target.sum()), len(source)
    return [math.floor(1000 * math.log((t + 1) * (s_all + b) / ((s + 1) * (t_all + b)))) for s, t in zip(source.tolist(), target.tolist())]


def weights(docs: DataFrame, gain: list[int], n: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain over the n-grams of every document."""
    buckets = len(gain)

    def weigh(batches):
        for batch in batches:
            rows = []
            for some in _texts(batch.column(1)):
                for text in some:
                    found = words(text)
                    counts = grams(found, n)
                    features = counts.total()
                    total = sum([gain[h % buckets] * c for h, c in counts.items()])
                    rows.append((len(found), features, total // features if features else 0))
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def with_scores(weighed: DataFrame, seed: str) -> DataFrame:
    """Add ``score``: the weight plus Gumbel noise from the first 32 bits of a digest of seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return weighed.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def _ranks(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank`` from 1 by falling score and rising id, from one range partitioning."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("spread")]
    placed = rows.withColumn("spread", F.monotonically_increasing_id())  # equal rows can be parted as well
    placed = keep(placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("spread").withColumn("at", F.monotonically_increasing_id()), "resampling-order")
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("c"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))  # one row for each partition
    return placed.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn(
        "rank", F.col("offset") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "at", "offset")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20,
             seed: str = "2024") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) for every row of ``docs``; rank is null for what is not drawn.

    Of the documents with ``min_words`` words or more, ``percent`` of 100 (rounded down) with the highest scores are
    drawn, ties to the smaller id.  A null or empty text has no words and weight 0; a null id counts as an empty one
    and comes last among ties; repeated rows count and are drawn each.  An empty ``target`` gives the documents'
    common n-grams low gains, empty ``docs`` give no rows; other columns are ignored.
    """
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    scored = keep(with_scores(weights(docs, gain, n), seed), "resampling-scores")
    fit = F.col("n_words") >= min_words
    steps = scored.where(fit).groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(F.count(F.lit(1)).alias("c")).collect()  # a row for each step of the value range
    drawn, seen, cut = sum(r.c for r in steps) * percent // 100, 0, None
    for r in sorted(steps, reverse=True):
        if seen < drawn:
            cut = r.step * STEP
        seen += r.c
    if cut is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    high = fit & (F.col("score") >= cut)
    ranked = _ranks(scored.where(high)).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return scored.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``docs`` (all columns) restricted to the drawn ids; a null id is not drawn."""
    ids = resample(docs, target, **options).where("rank IS NOT NULL AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids, "doc_id", "left_semi").select(*docs.columns)
