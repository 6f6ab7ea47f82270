"""Packing: optimal length buckets and token-budget batches.

The histogram of lengths is one aggregation with a row for each distinct length. Distinct lengths
add up to no more than all tokens, so there are at most the square root of twice the tokens: a few
thousand rows for a GB, some millions for 100 TB, which is the bound that makes it safe to collect.
Dynamic programming over it picks at most ``buckets`` upper bounds with the least padding in total,
exactly: in each round the best predecessor of a bound is the lowest of straight lines, whose lower
hull is kept while bounds ascend, so a round is linear in the distinct lengths. Ties go to the lesser
predecessor, so to fewer buckets. A bucket of length b takes max(1, budget // b) documents a batch.
Each bucket is dealt by a hash of doc_id and text over shards of about ``shard_docs`` documents, known
from the histogram, and numbered within each: a hot bucket spreads, and at most one batch a shard
stays short.

Lengths of null or empty texts are 0 and go to the first bucket. A document over the budget has a
batch of its own. A null doc_id is a value like any other. Repeated rows are packed each; equal ones are
told apart by nothing, so their order changes nothing. An empty table gives no rows. Texts of any
length count wholly. Only doc_id and text (and what `length` reads) are read, so further columns may
have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .mixing import word_count

BUCKETS, BUDGET, SHARD_DOCS = 8, 16384, 16384


def optimal_bounds(length: list[int], count: list[int], buckets: int) -> list[int]:
    """Upper bounds with the least padding, for distinct lengths that ascend.

    With C and S the running sums of counts and of tokens, a bucket of lengths i + 1 to j pads by
    length_j (C_j - C_i) - (S_j - S_i): for each i a line in length_j of slope -C_i.
    """
    n, c, s = len(length), [0], [0]
    for x, k in zip(length, count, strict=True):
        c.append(c[-1] + k)
        s.append(s[-1] + k * x)
    best: list[int | None] = [0] + [None] * n
    came = []
    for _ in range(min(buckets, n)):
        new: list[int | None] = [0] + [None] * n
        at, hull, front = [0] * (n + 1), [], 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                a, b = c[i], best[i] + s[i]
                # The last line goes if the new one passes the one before it no later than it does.
                while len(hull) - front > 1:
                    (a1, b1, _), (a2, b2, _) = hull[-2:]
                    if (b - b1) * (a2 - a1) > (b2 - b1) * (a - a1):
                        break
                    hull.pop()
                hull.append((a, b, i))
            x = length[j - 1]
            while len(hull) - front > 1 and hull[front + 1][1] - hull[front + 1][0] * x < hull[front][1] - hull[front][0] * x:
                front += 1
            a, b, at[j] = hull[front]
            new[j] = b - a * x + x * c[j] - s[j]
        best = new
        came.append(at)
    bounds, j = [], n
    for at in reversed(came):
        if j == 0:
            break
        bounds.append(length[j - 1])
        j = at[j]
    return sorted(bounds)


def pack(docs: DataFrame, length: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, shard, batch, slot, padding of each row of docs(doc_id, text).

    length: tokens of a row; words of the text unless given. (bucket, shard, batch) names a batch.
    """
    key = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    rows = docs.select("doc_id", (word_count(F.col("text")) if length is None else length).cast("long").alias("n_tokens"), key.alias("key"))
    found = rows.groupBy("n_tokens").agg(F.count("*").alias("c")).toArrow()
    order = np.argsort(found.column("n_tokens").to_numpy())
    top, count = (found.column(x).to_numpy()[order] for x in ("n_tokens", "c"))
    bounds = optimal_bounds(top.tolist(), count.tolist(), buckets)
    bucket, size, shards = F.lit(0), F.lit(0), F.lit(1)
    for i, b in reversed(list(enumerate(bounds))):
        held = int(count[(top <= b) & (top > (bounds[i - 1] if i else -1))].sum())
        inside = F.col("n_tokens") <= b
        bucket, size, shards = F.when(inside, i).otherwise(bucket), F.when(inside, b).otherwise(size), F.when(inside, -(-held // shard_docs)).otherwise(shards)
    shard = (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % shards).alias("shard")
    dealt = rows.select("doc_id", "n_tokens", "key", bucket.alias("bucket"), size.cast("long").alias("bucket_len"), shard)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_len"), F.lit(1)))).cast("long")
    at = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.asc_nulls_first("doc_id"), "n_tokens", "key")) - 1
    return dealt.withColumn("at", at).select("doc_id", "n_tokens", "bucket", "bucket_len", "shard", F.floor(F.col("at") / room).alias("batch"), (F.col("at") % room).alias("slot"), (F.col("bucket_len") - F.col("n_tokens")).alias("padding"))


def oracle(buckets: int = BUCKETS, budget: int = BUDGET, shard_docs: int = SHARD_DOCS) -> str:
    """The same in DuckDB SQL, with the dynamic programming over all pairs of bounds."""
    rounds, back = ["r0 AS (SELECT 0 j, 0::HUGEINT best, 0 i)"], [f"b{buckets} AS (SELECT max(j) j FROM h)"]
    for b in range(1, buckets + 1):
        cost = "best + x.n * (x.c - y.c) - (x.s - y.s)"
        rounds.append(f"r{b} AS MATERIALIZED (SELECT 0 j, 0::HUGEINT best, 0 i UNION ALL SELECT x.j, min({cost}), arg_min(y.j, ({cost}) * 1000000 + y.j) FROM h x, h0 y, r{b - 1} r WHERE y.j < x.j AND r.j = y.j GROUP BY x.j)")
    for b in range(buckets, 0, -1):
        back.append(f"b{b - 1} AS (SELECT coalesce((SELECT i FROM r{b}, b{b} WHERE r{b}.j = b{b}.j), 0) j)")
    ends = " UNION ".join(f"SELECT j FROM b{b}" for b in range(1, buckets + 1))
    return f"""
    WITH d AS MATERIALIZED (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) n, md5(concat_ws('|', doc_id::VARCHAR, md5(coalesce(text, '')))) k FROM documents),
    h AS MATERIALIZED (SELECT row_number() OVER w j, n, sum(count(*)) OVER w c, sum(count(*) * n) OVER w s FROM d GROUP BY n WINDOW w AS (ORDER BY n)),
    h0 AS MATERIALIZED (SELECT 0 j, 0::HUGEINT c, 0::HUGEINT s UNION ALL SELECT j, c, s FROM h),
    {", ".join(rounds)}, {", ".join(back)},
    e AS (SELECT row_number() OVER (ORDER BY h.j) - 1 bucket, n bucket_len, c - lag(c, 1, 0) OVER (ORDER BY h.j) held, coalesce(lag(n) OVER (ORDER BY h.j), -1) above FROM h WHERE j IN ({ends})),
    p AS (SELECT doc_id, n, k, bucket, bucket_len, ('0x' || substr(k, 1, 8))::BIGINT % ((held + {shard_docs - 1}) // {shard_docs})::BIGINT shard, greatest(1, {budget} // greatest(bucket_len, 1)) room FROM d JOIN e ON n <= bucket_len AND n > above),
    q AS (SELECT *, row_number() OVER (PARTITION BY bucket, shard ORDER BY doc_id NULLS FIRST, n, k) - 1 place FROM p)
    SELECT doc_id, n::BIGINT n_tokens, bucket::INT bucket, bucket_len::BIGINT bucket_len, shard::BIGINT shard, (place // room)::BIGINT batch, (place % room)::BIGINT slot, (bucket_len - n)::BIGINT padding FROM q"""
