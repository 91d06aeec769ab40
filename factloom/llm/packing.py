"""Packing into length buckets of least padding.

Sequence lengths are counted once; their histogram has at most `longest` + 1 rows, whatever the corpus. Dynamic programming over
it chooses the bucket bounds with the least total padding (a convex-hull scan per bucket, exact in integers). Inside a bucket,
batches take as many sequences as the token budget holds at the bucket's length. Places in a bucket are counted by slots of
bounded size and their running totals, so no bucket is sorted in one task.

A document longer than `longest` tokens gives several pieces; nothing is dropped. Null and empty texts make one piece of 0 tokens in the
first bucket. Repeated rows are packed one by one; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm._spark import Scratch

#: Pieces whose places one task numbers.
SLOT_ROWS = 100_000


@dataclass(frozen=True)
class Setting:
    """Most buckets, tokens of a batch with padding, tokens of the longest piece."""

    buckets: int = 16
    budget: int = 65_536
    longest: int = 8_192


def n_words(text: Column | str = "text") -> Column:
    """Words of a text: runs of bytes that are not ASCII white space."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def best_bounds(histogram: dict[int, int], buckets: int) -> list[int]:
    """Upper bounds of at most so many buckets with the least padding: sum of count * (bound - length)."""
    lengths = sorted(histogram)
    n = len(lengths)
    if n <= buckets:
        return lengths
    count, total = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        total.append(total[-1] + histogram[x] * x)
    # cost of a bucket (i, j]: lengths[j-1] * (count[j] - count[i]) - (total[j] - total[i])
    best = [lengths[j - 1] * count[j] - total[j] if j else 0 for j in range(n + 1)]
    came = []
    for k in range(2, buckets + 1):
        new, back = [0] * (n + 1), [0] * (n + 1)
        hull: list[int] = []  # lines y = -count[i] x + best[i] + total[i], slopes falling
        head = 0
        for j in range(k, n + 1):
            i = j - 1
            b = best[i] + total[i]
            while len(hull) - head >= 2:
                p, q = hull[-2], hull[-1]
                bp, bq = best[p] + total[p], best[q] + total[q]
                # q is never lowest if the new line meets p before q does
                if (b - bp) * (count[q] - count[p]) <= (bq - bp) * (count[i] - count[p]):
                    hull.pop()
                else:
                    break
            hull.append(i)
            x = lengths[j - 1]

            def value(i: int, x: int = x) -> int:
                return best[i] + total[i] - count[i] * x

            while len(hull) - head >= 2 and value(hull[head + 1]) <= value(hull[head]):
                head += 1
            back[j] = hull[head]
            new[j] = value(hull[head]) + x * count[j] - total[j]
        came.append(back)
        best = new
    bounds, j = [], n
    for back in reversed(came):
        bounds.append(lengths[j - 1])
        j = back[j]
    bounds.append(lengths[j - 1])
    return bounds[::-1]


def pack(docs: DataFrame, setting: Setting = Setting(), length: Column | None = None) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bucket, bucket_tokens, batch (within the bucket), place (in the batch), padding."""
    s, spark = setting, docs.sparkSession
    size = n_words("text") if length is None else length
    pieces = docs.select("doc_id", size.cast("long").alias("size"))
    last = F.greatest(F.ceil(F.col("size") / s.longest) - 1, F.lit(0))
    pieces = pieces.select("doc_id", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * s.longest).alias("first_token"), F.least(F.col("size") - F.col("piece") * s.longest, F.lit(s.longest)).alias("n_tokens"))
    pieces = Scratch(spark).store(pieces.withColumn("nth", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())))  # rows without id are dealt too
    histogram = {r.n_tokens: r["count"] for r in pieces.groupBy("n_tokens").count().collect()}  # at most longest + 1 rows
    bounds = best_bounds(histogram, s.buckets)
    rows = sum(histogram.values())
    slots = max(1, -(-rows // SLOT_ROWS))
    bucket = F.lit(None).cast("int")
    bound = F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, i).otherwise(bucket)
        bound = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bound)
    dealt = pieces.withColumns({"bucket": bucket, "bucket_tokens": bound, "slot": F.pmod(F.xxhash64("doc_id", "piece", "nth"), F.lit(slots))})
    counts = dealt.groupBy("bucket", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("bucket").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    turn = F.row_number().over(Window.partitionBy("bucket", "slot").orderBy("doc_id", "piece", "n_tokens"))
    placed = dealt.withColumn("turn", turn).join(offsets, ["bucket", "slot"]).withColumn("at", F.col("offset") + F.col("turn") - 1)
    holds = F.greatest(F.floor(F.lit(s.budget) / F.greatest("bucket_tokens", F.lit(1))), F.lit(1))
    return placed.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_tokens",
        F.floor(F.col("at") / holds).alias("batch"), (F.col("at") % holds).alias("place"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
