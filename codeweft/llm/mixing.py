"""Mixing sources to target weights by a low-discrepancy schedule.

The texts of each source are shuffled by a hash, laid end to end as tokens and
cut into blocks of ``block`` tokens (the last one may be shorter).  Slot i of the
mixture takes the point frac(i / golden ratio); where it falls among the
cumulative target weights decides the source, and the rank of the slot among
its source's slots decides the block, going round again when all are used.  Any
prefix of the schedule has nearly the target shares, and the schedule ends
before the first slot that would repeat a source more often than it may.

Offsets and ranks are prefix sums in two steps, over buckets and inside them,
so a source with any share of the rows is never sorted or counted in one task.
The driver keeps one row for each source of the targets.

Sources without a text cannot contribute: the shares are taken over those that
can, and the report lists the others with zero.  Blank and null texts have no
tokens and are left out; repeated rows of a doc_id count once; repeated targets
of a source are added up (the least max_repeats holds; null counts as 1); null or
non-positive shares are no targets.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeweft.storage import materialize

BLOCK = 512
BUCKET_ROWS = 50_000
CHUNK = 1 << 16
GOLDEN = 0.6180339887498949
#: a public byte-level vocabulary; any file of the same format may be named
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each document with at least one token."""

    def count(batches):
        encode = encoding(tokenizer).encode_ordinary
        for batch in batches:
            known: dict[str, int] = {}
            out = []
            for text in batch["text"]:
                n = known.get(text)
                if n is None:
                    n = known[text] = len(encode(text)) if text.strip() else 0
                out.append(n)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": out})

    counted = documents.select("doc_id", "source", "text").where("text is not null and source is not null and doc_id is not null")
    return counted.mapInPandas(count, "doc_id bigint, source string, tokens bigint").where("tokens > 0").dropDuplicates(["doc_id"])


def targets_of(mix: DataFrame) -> DataFrame:
    """(source, share, repeats), shares adding up to 1."""
    t = (
        mix.where("source is not null and target_share > 0").groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("repeats"))
        .where("repeats > 0")
    )
    return t.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy()))


def pieces_of(counts: DataFrame, block: int, seed: int) -> DataFrame:
    """(source, block, doc_id, first_token, end_token): where each document lies in the blocks."""
    n = counts.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    placed = counts.select("doc_id", "source", "tokens", F.xxhash64("doc_id", F.lit(seed)).alias("h")).withColumn(
        "bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)).cast("int")
    )
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    # one row for each bucket and source
    before = sums.select(
        "source", "bucket",
        (F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id")
    spans = placed.join(before, ["source", "bucket"]).select(
        "doc_id", "source", "tokens", (F.col("before") + F.sum("tokens").over(inside) - F.col("tokens")).alias("start")
    )
    cut = spans.select(
        "doc_id", "source", "tokens", "start",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("tokens") - 1) / block))).alias("block"),
    )
    return cut.select(
        "source", "block", "doc_id",
        F.greatest(F.lit(0), F.col("block") * block - F.col("start")).alias("first_token"),
        F.least("tokens", (F.col("block") + 1) * block - F.col("start")).alias("end_token"),
    )


def slots_of(spark, sources: list[tuple], total: int | None, block: int) -> DataFrame:
    """(slot, source, repeat, block) for sources of (name, share, repeats, tokens)."""
    schema = "slot bigint, source string, repeat bigint, block bigint"
    if not sources:
        return spark.createDataFrame([], schema)
    sources = sorted(sources)
    weight = sum(s[1] for s in sources)
    blocks = {name: -(-tokens // block) for name, _, _, tokens in sources}
    most = min(int(blocks[name] * repeats * weight / share) for name, share, repeats, _ in sources)
    n = most + 64 if total is None else min(most + 64, -(-total // block))
    cumulative, sum_ = [], 0.0
    for _, share, _, _ in sources[:-1]:
        sum_ += share / weight
        cumulative.append(sum_)
    names = F.array(*[F.lit(s[0]) for s in sources])
    point = F.pmod(F.col("slot") * F.lit(GOLDEN), F.lit(1.0))
    edges = F.array(*[F.lit(c) for c in cumulative]) if cumulative else F.array().cast("array<double>")
    slots = spark.range(n).select(
        F.col("id").alias("slot"), (F.col("id") / CHUNK).cast("bigint").alias("chunk")
    ).withColumn("source", F.element_at(names, F.size(F.filter(edges, lambda c: c <= point)) + 1))
    # ranks: slots of the source in earlier chunks, then inside the chunk
    sums = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = sums.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    size = F.create_map(*[x for s in sources for x in (F.lit(s[0]), F.lit(blocks[s[0]]))])
    limit = F.create_map(*[x for s in sources for x in (F.lit(s[0]), F.lit(s[2]))])
    ranked = slots.join(before, ["source", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    ranked = materialize(
        ranked.select(
            "slot", "source", F.floor(F.col("rank") / size[F.col("source")]).alias("repeat"),
            F.pmod("rank", size[F.col("source")]).alias("block"), limit[F.col("source")].alias("most"),
        )
    )
    end = ranked.where(F.col("repeat") >= F.col("most")).agg(F.min("slot")).first()[0]
    ranked = ranked.drop("most")
    return ranked if end is None else ranked.where(F.col("slot") < end)


def mixture(documents: DataFrame, mix: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 0, tokenizer: str = TOKENIZER):
    """(schedule, report) of the mixture.

    ``schedule`` has a row for each document piece of each slot: slot, source,
    repeat, block, doc_id, first_token, end_token.  ``total`` is the size wanted
    in tokens; by default it is the largest that keeps every share and cap.
    ``report`` has source, target_share, available_tokens, tokens, actual_share
    and most_repeats of every target.
    """
    spark = documents.sparkSession
    targets = materialize(targets_of(mix))
    wanted = documents.join(F.broadcast(targets.select("source")) if targets.count() <= 10_000 else targets.select("source"), "source", "left_semi")
    counts = materialize(token_counts(wanted, tokenizer))
    sizes = counts.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = targets.join(sizes, "source").select("source", "share", "repeats", "available").collect()
    slots = slots_of(spark, [tuple(r) for r in rows], total, block)
    schedule = slots.join(pieces_of(counts, block, seed), ["source", "block"]).select(
        "slot", "source", "repeat", "block", "doc_id", "first_token", "end_token"
    )
    used = schedule.groupBy("source").agg(
        F.sum(F.col("end_token") - F.col("first_token")).alias("tokens"), (F.max("repeat") + 1).alias("most_repeats")
    )
    report = (
        targets.join(sizes, "source", "left").join(used, "source", "left")
        .select(
            "source", F.col("share").alias("target_share"), F.coalesce("available", F.lit(0)).alias("available_tokens"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"),
        )
        .withColumn("actual_share", F.coalesce(F.try_divide("tokens", F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
    )
    return schedule, report
