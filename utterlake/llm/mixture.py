"""Mixing sources to target shares: Sainte-Laguë apportionment of equal-token blocks, then seeded selection of blocks."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from utterlake.session import stored

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how the byte-level vocabularies split a text before their merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 2048
#: Tokens of a source per shard, and the most shards of all sources: blocks are laid out shard by shard, never over a whole source.
SHARD_TOKENS, MAX_SHARDS = 64_000_000, 65_536
MAX_SOURCES = 10_000


def token_counter(folder: str = TOKENIZERS, vocabulary: str = "byte_bpe_multi_50k.tiktoken"):
    """A column function: tokens of a text under a public byte-level vocabulary; null for null. The vocabulary is read once per worker."""

    @F.arrow_udf(T.LongType())
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for texts in batches:
            yield pa.array([None if t is None else len(encode(t)) for t in texts.to_pylist()], pa.int64())

    return count


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 s + 1), none beyond its cap; ties go to the earlier. Fewer seats only if all caps are met.

    Most seats are given at once: with the divisor L every party has floor(weight / L + 1/2) seats at least, for an L slightly
    too large; the rest go one by one by quotient, so the result is that of the plain procedure at any number of seats.
    """
    w, cap = np.asarray(weights, dtype=float), np.asarray(caps, dtype=np.int64)
    seats = int(min(seats, cap[w > 0].sum())) if len(w) else 0
    if seats <= 0:
        return [0] * len(w)
    at = lambda inverse: np.minimum(np.floor(w * inverse + 0.5), cap).astype(np.int64)
    lo, hi = 0.0, 1.0
    while at(hi).sum() < seats:
        lo, hi = hi, hi * 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if at(mid).sum() > seats:
            hi = mid
        else:
            lo = mid
    own = at(lo * (1 - 1e-12)).tolist()
    queue = [(-w[i] / (2 * own[i] + 1), i) for i in range(len(w)) if own[i] < cap[i] and w[i] > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(own)):
        _, i = heapq.heappop(queue)
        own[i] += 1
        if own[i] < cap[i]:
            heapq.heappush(queue, (-w[i] / (2 * own[i] + 1), i))
    return own


class Mixture:
    """The plan of a mixture over documents (doc_id, source, text) and targets (source, target_share, max_repeats).

    The mixture is as large as all documents, those without a source in the targets included, measured in tokens. Documents are
    tokenized once and the counts are written down. Per source a seeded order and the running token count lay its documents out
    in equal blocks, in shards of bounded size; a document belongs to the block in which it begins. Null texts have 0 tokens, null sources belong to no target; documents without doc_id are left out.
    The last block of a shard may be short and takes a seat like any other. A source listed twice in the targets counts once, with its greatest share. Null shares count as 0, null max_repeats as 1.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, block_tokens: int = BLOCK_TOKENS, seed: int = 17, folder: str = TOKENIZERS, shard_tokens: int = SHARD_TOKENS):
        self.spark, self.block, self.seed = documents.sparkSession, block_tokens, seed
        docs = documents.where("doc_id is not null").select("doc_id", "source", F.coalesce(token_counter(folder)("text"), F.lit(0)).alias("tokens"))
        self.docs = stored(docs, "tokens")
        per_source = self.docs.groupBy("source").agg(F.sum("tokens").alias("tokens"))
        # the targets are a small fixed table; MAX_SOURCES bounds what comes to the driver
        rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source").limit(MAX_SOURCES + 1).collect()
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} target sources")
        names = [r.source for r in rows]
        supply = {r.source: r.tokens for r in per_source.where(F.col("source").isin(names)).collect()} if names else {}
        self.total = self.docs.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
        self.plan = [{"source": r.source, "share": r.share or 0.0, "repeats": 1 if r.repeats is None else max(0, r.repeats), "supply": supply.get(r.source, 0)} for r in rows]
        seats = round(self.total / self.block)
        shares = [p["share"] for p in self.plan]
        # a source is out of reach where its quota without caps comes within a pass of its cap, checked then to the token
        free = sainte_lague(shares, seats, [seats] * len(shares))
        for p, quota in zip(self.plan, free, strict=True):
            p["cap"] = p["repeats"] * -(-p["supply"] // self.block)
            p["short"] = quota + p["repeats"] + 1 >= p["cap"] and p["repeats"] * p["supply"] < p["share"] * self.total
            p["shards"] = min(max(1, MAX_SHARDS // len(self.plan)), max(1, -(-p["supply"] // shard_tokens)))

    def unreachable(self) -> DataFrame:
        """(source): targets that cannot reach their share even at max_repeats."""
        return self.spark.createDataFrame([(p["source"],) for p in self.plan if p["short"]], "source string")

    def _laid_out(self) -> DataFrame:
        """Documents of the target sources with their seeded order and shard."""
        head = self.spark.createDataFrame([(p["source"], p["shards"]) for p in self.plan], "source string, shards int")
        order = F.xxhash64(F.lit(self.seed), F.col("doc_id").cast("string"))
        return self.docs.join(F.broadcast(head), "source").withColumn("order", order).withColumn("shard", F.pmod(F.col("order"), F.col("shards")).cast("int"))

    def _quotas(self, docs: DataFrame) -> list[tuple[str, int, int, int]]:
        """(source, shard, passes, extra): every block of the shard is in so many passes, the first ``extra`` blocks in one more.

        Sources out of reach give every block as often as they may. What is then left of the size goes to the others by highest
        quotients, up to their blocks times their repeats, and within a source to its shards likewise.
        """
        own: dict[str, list[tuple[int, int]]] = {}
        for r in docs.groupBy("source", "shard").agg(F.sum("tokens").alias("tokens")).collect():  # at most MAX_SHARDS rows, or one per source
            own.setdefault(r.source, []).append((r.shard, r.tokens))
        blocks = {s: [-(-t // self.block) for _, t in sorted(shards)] for s, shards in own.items()}
        taken = sum(p["repeats"] * p["supply"] for p in self.plan if p["short"])
        others = [p for p in self.plan if not p["short"]]
        seats = max(0, round((self.total - taken) / self.block))
        given = sainte_lague([p["share"] for p in others], seats, [p["repeats"] * sum(blocks.get(p["source"], [])) for p in others])
        quota = {p["source"]: q for p, q in zip(others, given, strict=True)}
        out = []
        for p in self.plan:
            shards, n = sorted(own.get(p["source"], [])), blocks.get(p["source"], [])
            p["quota"] = p["repeats"] * sum(n) if p["short"] else quota[p["source"]]
            for (s, _), k, q in zip(shards, n, sainte_lague([t for _, t in shards], p["quota"], [p["repeats"] * k for k in n]), strict=True):
                if k:
                    out.append((p["source"], s, q // k, q % k))
        return out

    def selection(self) -> DataFrame:
        """(doc_id, source, tokens, copies): the mixture; copies says how often a document is in it."""
        docs = self._laid_out()
        quota = self.spark.createDataFrame(self._quotas(docs), "source string, shard int, passes int, extra int")
        running = Window.partitionBy("source", "shard").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        laid = docs.withColumn("block", F.floor((F.sum("tokens").over(running) - F.col("tokens")) / self.block))
        picked = laid.join(F.broadcast(quota), ["source", "shard"]).withColumn("copies", (F.col("passes") + F.when(F.col("block") < F.col("extra"), 1).otherwise(0)).cast("int"))
        return picked.where("copies > 0 and tokens > 0").select("doc_id", "source", "tokens", "copies")

    def shares(self) -> DataFrame:
        """Per target source: supply, quota in tokens, tokens in the mixture, share reached and whether it is out of reach."""
        chosen = self.selection()
        head = self.spark.createDataFrame(
            [(p["source"], p["share"], p["repeats"], p["supply"], p["quota"] * self.block, p["short"]) for p in self.plan],
            "source string, target_share double, max_repeats int, supply_tokens bigint, quota_tokens bigint, unreachable boolean",
        )
        got = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("copies"))
        both = head.join(F.broadcast(got), "source", "left").fillna(0, ["tokens", "copies"])
        return both.withColumn("share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy())), F.lit(0.0)))
