"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows get global row numbers, a keyed permutation of [0, n) sends each number to a place, and place p lies in
shard p mod k at slot p div k. Shard and slot of any row number are computable without the data, shards
differ by one row at most, and slots have no gaps. All of it is Catalyst expressions.

Global numbers come from content, not from file layout: a row's bucket is a hash of its id and text, its number
is the count of rows in lower buckets plus its rank in the bucket. The table of bucket counts has at
most ``BUCKETS`` rows, whatever the input; only narrow rows (id, size, checksum) are shuffled, once.

Defined results: a null text has size 1 and checksum 0; a null id is sorted first; rows that repeat (equal
id and text) get places of their own, which of them gets which is immaterial; an empty table gives an empty
table; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Number of buckets of the global numbering: the bound of the broadcast table of counts.
BUCKETS = 4096
ROUNDS = 4
#: Steps of the cycle walk. A step leaves [0, n) with a chance under 3/4, so that 1e-24 of walks are longer; those raise an error.
WALK = 192

_M = 1 << 31
_A, _C, _A2 = 1103515245, 12345, 1597334677


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") % _M for i in range(ROUNDS)]


def _mixed(r: str, k: str) -> str:
    """The round function as SQL over integers below 2**31, so that no product overflows."""
    t = f"((({r} + {k}) % {_M}L * {_A}L + {_C}L) % {_M}L)"
    return f"shiftright(({t} ^ shiftright({t}, 13)) * {_A2}L % {_M}L, 7)"


def feistel_sql(x: str, half: str, seed: int, names: str = "") -> str:
    """SQL that permutes ``x`` in [0, 4**half)."""
    s, k = f"s{names}", f"k{names}"
    keys = ", ".join(f"{key}L" for key in round_keys(seed))
    mask = f"(shiftleft(1L, {half}) - 1L)"
    return (
        f"aggregate(array({keys}), named_struct('l', shiftright({x}, {half}), 'r', {x} & {mask}), "
        f"({s}, {k}) -> named_struct('l', {s}.r, 'r', {s}.l ^ ({_mixed(f'{s}.r', k)} & {mask})), "
        f"{s} -> shiftleft({s}.l, {half}) | {s}.r)"
    )


def permuted_sql(x: str, n: str, half: str, seed: int) -> str:
    """SQL for the place of row number ``x`` of ``n``: the permutation is applied until it falls below n."""
    walk = f"aggregate(sequence(1, {WALK}), {feistel_sql(x, half, seed, '0')}, (p, i) -> if(p < {n}, p, {feistel_sql('p', half, seed, '1')}))"
    return f"aggregate(array({walk}), 0L, (z, p) -> if(p < {n}, p, cast(raise_error('cycle walk too long: choose another seed') as bigint)))"


def permute(x: int, n: int, seed: int) -> int:
    """The same permutation for one number, without Spark: where row number ``x`` of ``n`` goes."""
    half = (len(bin(max(n - 1, 0))[2:]) + 1) // 2
    mask, keys = (1 << half) - 1, round_keys(seed)
    while True:
        left, right = x >> half, x & mask
        for key in keys:
            t = ((right + key) % _M * _A + _C) % _M
            left, right = right, left ^ (((t ^ (t >> 13)) * _A2 % _M >> 7) & mask)
        x = left << half | right
        if x < n:
            return x


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row_number from 0, n_rows)."""
    # NULL checks come first: crc32 and octet_length of null are null.
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    ).withColumn("bucket", F.pmod(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(0)) + F.col("text_crc32"), F.lit(BUCKETS)).cast("int"))
    counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    every = Window.orderBy("bucket")  # BUCKETS rows at most
    offsets = counts.select(
        "bucket",
        (F.sum("rows").over(every) - F.col("rows")).alias("before"),
        F.sum("rows").over(Window.partitionBy()).alias("n_rows"),
    )
    place = Window.partitionBy("bucket").orderBy("id", "text_crc32", "size")
    return (
        rows.withColumn("rank", F.row_number().over(place))
        .join(F.broadcast(offsets), "bucket")
        .select("id", "size", "text_crc32", (F.col("before") + F.col("rank") - 1).alias("row_number"), "n_rows")
    )


def shard(docs: DataFrame, n_shards: int = 8, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with its shard and its slot there (law ``rows``: counts at most one apart)."""
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    places = numbered(docs, id_col, text_col).withColumn("half", F.expr("cast((length(bin(n_rows - 1)) + 1) div 2 as int)"))
    return places.withColumn("place", F.expr(permuted_sql("row_number", "n_rows", "half", seed))).select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("place") % n_shards).cast("int").alias("shard"),
        F.expr(f"place div {n_shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
