"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each shingle of five words is hashed once (xxhash64 of the words); its top eight bits choose one of 256 bins, and a bin
keeps its least hash. An empty bin takes the value of the first filled bin in a sequence of bins that depends on its
own number only (optimal densification): a few fixed random tries, then the filled bin of least hash(bin, candidate).
The low eight bits of each bin are the fingerprint, as 512 hex digits; the share of equal bins, corrected for chance
agreement 2**-8, estimates the Jaccard similarity of two texts.

The next document in ascending doc_id comes from ranges of ids ("blocks") of nearly equal size: rows are dealt out by
block once, the last row of a block takes the first document of the next block that has any, and every later step
keeps that dealing, so texts are shuffled once.

Nulls: a null text is empty. Texts without words have the fingerprint '' and are alike (1.0) only to such texts.
A null doc_id sorts before all others; repeated doc_ids are ordered by text. The last document's next is the first,
a single document's next is itself. Very long texts are hashed whole. Empty tables give empty results; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, LOW_BITS, SHINGLE = 256, 8, 5
VALUE_BITS = 56
#: Documents in a block of ids where ids are densest, and in a partition.
BLOCK, PER_TASK = 128, 1200
#: Pseudo bins that carry a row's own facts through the aggregation.
CHARS, DIGEST = -5, -4
TRIES = [random.Random(100 + t).choices(range(BINS), k=BINS) for t in range(6)]


def words(text: Column) -> Column:
    """Lower-cased runs of bytes other than white space."""
    flat = F.trim(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " +"))


def block_width(docs: DataFrame) -> tuple[int, int, int]:
    """Least id, ids in a block so that the densest part of the ids fills about BLOCK rows, and the number of rows."""
    points = 40
    row = docs.agg(F.min("doc_id").alias("low"), F.count("doc_id").alias("n"), F.percentile_approx("doc_id", [i / points for i in range(points + 1)], 10000).alias("q"), F.count("*").alias("all")).first()
    if not row["n"]:
        return 0, 1, row["all"]
    per = row["n"] / points
    gaps = [b - a for a, b in zip(row["q"], row["q"][1:], strict=False) if b > a]
    return row["low"], max(1, int(min(gaps, default=1) / max(per, 1) * BLOCK)), row["all"]


def following(blocks: DataFrame) -> DataFrame:
    """blocks (block, first_id) -> (block, next_id): the first id of the next block; of the last: of the first."""
    wide = blocks.withColumn("far", F.floor(F.col("block") / 4096))
    near = wide.withColumn("next_id", F.lead("first_id").over(Window.partitionBy("far").orderBy("block")))
    far = wide.groupBy("far").agg(F.min_by("first_id", "block").alias("head"))
    order = Window.orderBy("far")
    far = far.withColumn("after", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    return near.join(far.select("far", "after"), "far").select("block", F.coalesce("next_id", "after").alias("next_id"))


def minima_by_bin(rows: DataFrame) -> DataFrame:
    """rows (block, rn, doc_id, variants) -> least hash by (block, rn, doc_id, variant, bin), with the pseudo bins."""
    one = rows.select("block", "rn", "doc_id", "n_chars", "digest", F.posexplode("variants").alias("variant", "text")).where("text is not null")
    worded = one.select("block", "rn", "doc_id", "variant", F.when(F.col("variant") == 0, F.col("n_chars")).alias("n_chars"), F.when(F.col("variant") == 0, F.col("digest")).alias("digest"), words(F.col("text")).alias("w"))
    n = F.size("w")
    placed = worded.select("block", "rn", "doc_id", "variant", "n_chars", "digest", "w", F.explode(F.sequence(F.lit(CHARS), F.when(n == 0, F.lit(-1)).otherwise(F.greatest(n - SHINGLE, F.lit(0))))).alias("i"))
    h = F.xxhash64(*[F.get("w", F.col("i") + k) for k in range(SHINGLE)])
    part = F.conv(F.substring("digest", (F.col("i") - DIGEST) * 16 + 1, F.lit(16)), 16, -10).cast("bigint")
    hashed = placed.select("block", "rn", "doc_id", "variant", "i", "n_chars", F.when((F.col("i") >= DIGEST) & (F.col("i") < 0), part).alias("part"), F.when(F.col("i") >= 0, h).alias("h"))
    low = F.lit((1 << VALUE_BITS) - 1).cast("bigint")
    bin_ = F.when(F.col("i") < 0, F.col("i").cast("bigint")).otherwise(F.shiftrightunsigned("h", VALUE_BITS))
    value = F.when(F.col("i") == CHARS, F.col("n_chars")).when(F.col("i") < 0, F.col("part")).otherwise(F.col("h").bitwiseAND(low))
    return hashed.groupBy("block", "rn", "doc_id", "variant", bin_.alias("bin")).agg(F.min(value).alias("v")).where("v is not null")


def _masks(k: int) -> list[Column]:
    """Which bins of variant k are filled, as four words of 64 bits."""
    bit = F.expr("shiftleft(1L, cast(bin & 63 as int))")
    return [F.bit_or(F.when((F.col("variant") == k) & (F.shiftright("bin", 6) == q), bit)).alias(f"m{k}_{q}") for q in range(BINS // 64)]


def _low_bits(k: int) -> str:
    """SQL of the packed low bits of variant k as an array of 256 numbers; null without shingles."""
    masks = [f"coalesce(m{k}_{q}, 0L)" for q in range(4)]
    before = ["0"] + [" + ".join(f"bit_count({m})" for m in masks[:q]) for q in range(1, 4)]
    tries = ", ".join(f"get(d, get(array({', '.join(map(str, t))}), j))" for t in TRIES)
    dense = f"transform(sequence(0, {BINS - 1}), j -> if(get(m, shiftright(j, 6)) & shiftleft(1L, j & 63) = 0, null, get(f, cast(get(c, shiftright(j, 6)) + bit_count(get(m, shiftright(j, 6)) & ~shiftleft(-1L, j & 63)) as int)).v))"
    # A value bound once is an array of one, unpacked by transform.
    inner = f"transform(d, (v, j) -> cast(coalesce(v, {tries}, array_min(transform(f, x -> struct(xxhash64(j, x.bin) as h, x.v as v))).v) & {(1 << LOW_BITS) - 1} as int))"
    with_d = f"get(transform(array({dense}), d -> {inner}), 0)"
    with_c = f"get(transform(array(array({', '.join(before)})), c -> {with_d}), 0)"
    with_m = f"get(transform(array(array({', '.join(masks)})), m -> {with_c}), 0)"
    return f"get(transform(array(array_sort(f{k})), f -> if(size(f) = 0, null, {with_m})), 0)"


def likeness(a: str, b: str) -> Column:
    chance = 1 / (1 << LOW_BITS)
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(BINS))
    value = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(F.col(a).isNull() & F.col(b).isNull(), 1.0).when(F.col(a).isNull() | F.col(b).isNull(), 0.0).otherwise(value)


def packed(bits: str) -> Column:
    return F.coalesce(F.concat_ws("", F.transform(bits, lambda v: F.lpad(F.hex(v), 2, "0"))), F.lit(""))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    low, width, total = block_width(base.select("doc_id"))
    id_or_least = F.coalesce("doc_id", F.lit(low - 1 if low > -(2**63) else low))
    base = base.withColumn("block", F.floor((id_or_least.cast("decimal(20,0)") - F.lit(low)) / F.lit(width)).cast("bigint"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_TASK))
    order = Window.partitionBy("block").orderBy("doc_id", "text")
    dealt = base.repartition(parts, "block").select("block", "doc_id", "text", F.row_number().over(order).alias("rn"), F.lead("text").over(order).alias("own_next"))
    heads = following(base.groupBy("block").agg(F.min(id_or_least).alias("first_id")))
    first_texts = base.select(id_or_least.alias("next_id"), "text").join(heads, "next_id").groupBy("block").agg(F.min("text").alias("head_text"))
    joined = dealt.join(first_texts, "block", "left")
    following_text = F.coalesce("own_next", "head_text")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    rows = joined.select("block", "rn", "doc_id", "text", following_text.alias("next_text"), F.col("own_next").isNull().alias("is_last")).select("block", "rn", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), F.when(F.col("is_last"), F.col("next_text")).alias("far_text"))
    rows = rows.select("block", "rn", "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("digest"), F.array("text", "edited", "far_text").alias("variants"))
    bins = minima_by_bin(rows)
    facts = [F.max(F.when((F.col("variant") == 0) & (F.col("bin") == CHARS), F.col("v"))).alias("n_chars")]
    facts += [F.max(F.when((F.col("variant") == 0) & (F.col("bin") == DIGEST + q), F.col("v"))).alias(f"s{q}") for q in range(4)]
    lists = [F.collect_list(F.when((F.col("variant") == k) & (F.col("bin") >= 0), F.struct("bin", "v"))).alias(f"f{k}") for k in range(3)]
    gathered = bins.groupBy("block", "rn", "doc_id").agg(*facts, *lists, *[m for k in range(3) for m in _masks(k)])
    digest = F.concat(*[F.lower(F.lpad(F.hex(f"s{q}"), 16, "0")) for q in range(4)])
    signed = gathered.select("block", "rn", "doc_id", "n_chars", digest.alias("edited_sha256"), *[F.expr(_low_bits(k)).alias(f"b{k}") for k in range(3)])
    by_order = Window.partitionBy("block").orderBy("rn")
    paired = signed.withColumn("more", F.lead("rn").over(by_order)).withColumn("next_bits", F.when(F.col("more").isNull(), F.col("b2")).otherwise(F.lead("b0").over(by_order)))
    return paired.select("doc_id", "n_chars", "edited_sha256", packed("b0").alias("fingerprint"), packed("b1").alias("edited_fingerprint"), likeness("b0", "b1").alias("near_edited"), likeness("b0", "next_bits").alias("near_next"))
