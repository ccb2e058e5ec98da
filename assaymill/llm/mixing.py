"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Token counts come from a public tokenizer whose folder is a parameter; texts are counted whole, in batches.
2. The driver sees tokens per source, then per (source, shard): at most ``MAX_SHARDS`` x sources numbers, however many documents there are.
3. Blocks of equal token counts go to the sources by highest quotients (divisors 1, 3, 5, ...), computed in closed form by bisection on the divisor, never beyond
   what ``max_repeats`` allows. A block is at most ``BLOCK_TOKENS`` tokens, and small enough that the smallest available source still makes ``LEAST_BLOCKS``
   of them: no source is too small to count, whatever the size of the corpus.
4. A source's documents fall into shards by a seeded hash, into fewer for a smaller source. Its blocks go to its shards likewise; what is less than
   a block in one shard is taken up by the shards that have room, so that all of a source's tokens can be used.
5. In each (source, shard) the documents are laid out in seeded order on a token axis cut into blocks; whole passes and the
   leading blocks of the last pass fill the quota, and a document is repeated as often as its place is covered.

The total defaults to the largest at which every available source still holds its share within its repeats.
Defined cases: NULL and empty texts have no tokens and are not used; source names are compared trimmed, in lower case, with
``-`` and blanks as ``_``; a source without weight is not used; a weighted source without text is reported with no tokens
and its share falls to the others in proportion; repeated weight rows count once (the largest share, the
smallest repeats); negative and NULL shares count as 0, NULL repeats as 1; empty tables give an empty mix.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from assaymill.functions.ids import trimmed
from assaymill.session import settle, tokenizer_dir

BLOCK_TOKENS = 512
LEAST_BLOCKS = 256  #: blocks that the smallest available source makes at least, and a shard on average
DOCS_PER_SHARD = 100_000
MAX_SHARDS = 4096
#: Fixed value: the public pre-tokenization pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(folder: str, name: str):
    import tiktoken

    with open(f"{folder}/{name}", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, folder: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of documents with at least one token."""
    folder = folder or tokenizer_dir()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for b in batches:
            n = [len(e.encode_ordinary(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name("source").alias("source"), "text").filter("doc_id IS NOT NULL")
    return src.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint").filter("n_tokens > 0")


def source_name(c: str) -> Column:
    return F.nullif(F.regexp_replace(F.lower(trimmed(c)), r"[\s\-]+", "_"), F.lit(""))


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients w / (2 s + 1), ties to the earlier; nobody exceeds its cap, the rest goes on."""
    n = len(weights)
    seats = min(seats, sum(c for w, c in zip(weights, caps) if w > 0))
    got = [0] * n
    if seats <= 0:
        return got

    def at(divisor: float) -> list[int]:  # seats whose quotient exceeds the divisor
        return [min(c, max(0, math.ceil((w / divisor - 1) / 2))) if w > 0 else 0 for w, c in zip(weights, caps)]

    lo, hi = min(w for w in weights if w > 0) / (2 * max(caps) + 4), max(weights) * 2.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(at(mid)) > seats:
            lo = mid
        else:
            hi = mid
    got = at(hi)
    for _ in range(seats - sum(got)):  # the few seats that tie at the divisor
        i = max((i for i in range(n) if weights[i] > 0 and got[i] < caps[i]), key=lambda i: (weights[i] / (2 * got[i] + 1), -i))
        got[i] += 1
    return got


def block_size(supply: dict[str, int], weights: list[tuple[str, float, int]], most: int = BLOCK_TOKENS) -> int:
    """Tokens per block: ``most``, or less where a source that is wanted has too few tokens for LEAST_BLOCKS blocks."""
    have = [supply.get(s, 0) * r for s, w, r in weights if w > 0 and supply.get(s, 0) * r > 0]
    return max(1, min(most, min(have) // LEAST_BLOCKS)) if have else most


def source_quotas(supply: dict[str, int], weights: list[tuple[str, float, int]], total: int | None, block: int) -> dict[str, int]:
    """Blocks per source. ``supply``: tokens per source; ``weights``: (source, share, repeats); without a total the largest that all shares allow."""
    caps = {s: supply.get(s, 0) * r // block for s, _, r in weights}
    names = [(s, w) for s, w, _ in weights if w > 0 and caps[s] > 0]
    if not names:
        return {}
    norm = sum(w for _, w in names)
    seats = min(int(caps[s] / (w / norm)) for s, w in names) if total is None else total // block
    return dict(zip((s for s, _ in names), sainte_lague([w for _, w in names], seats, [caps[s] for s, _ in names])))


def shard_quotas(supply: list[int], repeats: int, tokens: int, block: int) -> list[int]:
    """Tokens per shard of one source, ``tokens`` in all unless its supply is less: blocks by highest quotients, then the rest into the room that is left."""
    room = [n * repeats for n in supply]
    got = [b * block for b in sainte_lague([float(n) for n in supply], tokens // block, [c // block for c in room])]
    left = tokens - sum(got)
    for i, c in enumerate(room):
        more = min(left, c - got[i])
        got[i] += more
        left -= more
    return got


def mix(docs: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK_TOKENS, seed: int = 7, folder: str | None = None) -> DataFrame:
    """(doc_id, source, shard, block, n_tokens, repeats) for every document used at least once."""
    spark = docs.sparkSession
    told = clean_weights(weights)
    goal = [(r["source"], r["target_share"], r["max_repeats"]) for r in told.orderBy("source").collect()]
    counted = settle(token_counts(docs, folder).join(F.broadcast(told.select("source")), "source"))
    sizes = {r["source"]: (r["n"], r["docs"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    supply = {s: n for s, (n, _) in sizes.items()}
    unit = block_size(supply, goal, block)
    blocks = source_quotas(supply, goal, total, unit)
    cuts = {s: max(1, min(MAX_SHARDS, math.ceil(d / DOCS_PER_SHARD), n // (LEAST_BLOCKS * unit))) for s, (n, d) in sizes.items()}
    shards = spark.createDataFrame([(s, n) for s, n in cuts.items()], "source string, shards int")
    laid = counted.join(F.broadcast(shards), "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("shard", F.pmod("h", F.col("shards")).cast("int")).drop("shards")
    per: dict[str, dict[int, int]] = {}
    for r in laid.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect():
        per.setdefault(r["source"], {})[r["shard"]] = r["n"]
    plan = []
    for s, _, repeats in goal:
        keys = sorted(per.get(s, {}))
        if blocks.get(s):
            for k, q in zip(keys, shard_quotas([per[s][k] for k in keys], repeats, blocks[s] * unit, unit)):
                plan.append((s, k, q, per[s][k]))
    quotas = spark.createDataFrame(plan, "source string, shard int, quota bigint, supply bigint")
    used = laid.join(F.broadcast(quotas), ["source", "shard"])  # at most MAX_SHARDS x sources rows
    w = Window.partitionBy("source", "shard").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = used.withColumn("start", F.coalesce(F.sum("n_tokens").over(w), F.lit(0)))
    passes, rest = F.floor(F.col("quota") / F.col("supply")), F.col("quota") % F.col("supply")
    repeats = passes + F.when(F.col("start") + F.col("n_tokens") / 2 <= rest, 1).otherwise(0)
    return placed.select(
        "doc_id", "source", "shard", F.floor(F.col("start") / unit).alias("block"), "n_tokens", repeats.cast("int").alias("repeats")
    ).filter("repeats > 0")


def clean_weights(weights: DataFrame) -> DataFrame:
    w = weights.select(source_name("source").alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("w"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("int").alias("r"))
    return w.filter("source IS NOT NULL").groupBy("source").agg(F.max("w").alias("target_share"), F.min("r").alias("max_repeats"))


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """Target and reached share of every weighted source."""
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("repeats").alias("most_repeats"))
    total = mixed.agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("total"))
    return (
        clean_weights(weights).join(used, "source", "left").crossJoin(F.broadcast(total))  # one row
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
                F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce(F.try_divide("tokens", "total"), F.lit(0.0)).alias("actual_share"))
    )


def gaps(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target, actual_share, gap, bound, within) of the sources that are used: their shares among each other against the targets.

    Documents are whole, so each shard misses its quota by at most half its largest document; the bound adds that up over shards, with one block.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    edge = mixed.groupBy("source", "shard").agg(F.max("n_tokens").alias("m")).agg((F.sum("m") / 2 + BLOCK_TOKENS).alias("edge"))
    all_ = used.join(clean_weights(weights), "source").filter("target_share > 0")
    norm = all_.agg(F.sum("tokens").alias("total"), F.sum("target_share").alias("norm"))
    met = all_.crossJoin(F.broadcast(norm)).crossJoin(F.broadcast(edge))  # one row each
    target, actual, bound = F.col("target_share") / F.col("norm"), F.col("tokens") / F.col("total"), F.col("edge") / F.col("total")
    return met.select("source", target.alias("target"), actual.alias("actual_share"), F.abs(actual - target).alias("gap"), bound.alias("bound"), (F.abs(actual - target) <= bound).alias("within"))
