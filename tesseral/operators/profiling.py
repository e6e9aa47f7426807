"""Profiles of captures under a policy: refused before any work where a limit is passed."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import gates, geometry

#: No policy may ask for more than this.
HARD = {
    "max_capture_bytes": 8 << 30,
    "max_scalar_values": 64_000_000,
    "max_vectors": 4_000_000,
    "max_dimension": 16_384,
    "max_spectral_dimension": 16_384,
    "max_pairs": 10_000_000,
    "block_vectors": 65_536,
}
METADATA_BYTES, THRESHOLDS = 16 << 20, 32
#: Statuses from the least to the most telling; a report has that of its most telling group.
STATUSES = ("EXACT", "DETERMINISTIC_SAMPLE", "APPROXIMATE", "REFUSED")


@dataclass(frozen=True)
class Policy:
    partition: str = "layer-head-token"
    seed: int = geometry.SEED
    max_pairs: int = geometry.MOST_PAIRS
    exact_vector_threshold: int = geometry.EXACT_VECTORS
    max_capture_bytes: int = 8 << 30
    max_vectors: int = 4_000_000
    max_scalar_values: int = 32_000_000
    max_dimension: int = 16_384
    max_spectral_dimension: int = geometry.SPECTRAL_DIMENSION
    chunk_tokens: int = 256
    block_vectors: int = geometry.BLOCK
    near_duplicate_cosine: float = geometry.NEAR_DUPLICATE
    thresholds: tuple[float, ...] = (0.0,)

    def __post_init__(self) -> None:
        bounds = {**{k: getattr(self, k) for k in HARD}, "exact_vector_threshold": self.exact_vector_threshold, "chunk_tokens": self.chunk_tokens}
        if min(bounds.values()) <= 0:
            raise ValueError("every bound of a policy is positive")
        if over := [k for k in HARD if bounds[k] > HARD[k]]:
            raise ValueError(f"{over[0]} is above its hard limit")
        if not math.isfinite(self.near_duplicate_cosine) or abs(self.near_duplicate_cosine) > 1:
            raise ValueError("a cosine is within [-1, 1]")
        if len(self.thresholds) > THRESHOLDS or not all(map(math.isfinite, self.thresholds)):
            raise ValueError(f"at most {THRESHOLDS} finite thresholds")
        if self.partition not in ("layer-head-token", "layer-token", "layer-head-chunk"):
            raise ValueError(f"unknown partition mode {self.partition}")


def refusal(meta: dict, size: int, policy: Policy) -> str | None:
    """Why a capture isn't profiled under a policy, from its description alone; None if it is."""
    if size > policy.max_capture_bytes:
        return f"capture bytes {size} exceed policy maximum {policy.max_capture_bytes}"
    if sum(t["token_count"] * t["heads"] * t["dimension"] for t in meta["tensors"]) > policy.max_scalar_values:
        return f"capture scalar count exceeds policy maximum {policy.max_scalar_values}"
    whole = policy.partition == "layer-token"
    for t in meta["tensors"]:
        if t["dimension"] * (t["heads"] if whole else 1) > policy.max_dimension:
            return f"tensor {t['id']} partition dimension exceeds policy maximum {policy.max_dimension}"
    vectors = sum(t["token_count"] * (1 if whole else t["heads"]) for t in meta["tensors"])
    return f"partitioned vector count {vectors} exceeds policy maximum {policy.max_vectors}" if vectors > policy.max_vectors else None


def stated_pairs(unit: DataFrame, policy: Policy) -> DataFrame:
    """geometry.paired for a capture: of groups beyond the vectors or pairs that its policy states, a fixed sample of pairs."""
    sizes = unit.groupBy("group_id").agg(F.count("*").alias("_n"))
    full = (F.col("_n") <= policy.exact_vector_threshold) & (F.col("_n") * (F.col("_n") - 1) / 2 <= policy.max_pairs)
    small, large = (unit.join(sizes.where(which), "group_id", "left_semi") for which in (full, ~full))
    return geometry.paired(small, policy.near_duplicate_cosine).union(geometry.paired_in_sample(large, policy.max_pairs, policy.seed, policy.near_duplicate_cosine))


def profile_capture(spark: SparkSession, capture: str, metadata: str, policy: Policy = Policy()) -> DataFrame:
    """The geometry of each group of a capture; one row of status REFUSED, with its reason, where the policy refuses it."""
    text = spark.read.text(metadata, wholetext=True).first().value
    if len(text.encode()) > METADATA_BYTES:
        raise ValueError("a capture's description is at most 16 MiB long")
    meta = json.loads(text, object_pairs_hook=files._unique)
    size = spark.read.format("binaryFile").load(capture).select("length").first().length
    files.check_capture(meta, size)
    why = refusal(meta, size, policy)
    if why:
        return spark.createDataFrame([(meta["capture_id"], "REFUSED", why)], "capture_id string, status string, reason string")
    vectors = geometry.partitioned(files.read_capture(spark, capture, metadata), policy.partition, policy.chunk_tokens)
    pairs = stated_pairs(geometry.normalized(vectors), policy)
    report = geometry.profile(vectors, near=policy.near_duplicate_cosine, thresholds=policy.thresholds, spectral_dimension=policy.max_spectral_dimension, pairs=pairs)
    return report.withColumn("capture_id", F.lit(meta["capture_id"])).withColumn("reason", F.lit(None).cast("string"))


def aggregate(report: DataFrame) -> DataFrame:
    """(capture_id, status, counts of groups by status, and sums of vectors and pairs) of a report."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int")
    sums = [F.sum(c).alias(c) if c in report.columns else F.lit(0).cast("long").alias(c) for c in ("vector_count", "finite_vector_count", "evaluated_pairs")]
    names = (("exact_groups", "EXACT"), ("sampled_groups", "DETERMINISTIC_SAMPLE"), ("approximate_groups", "APPROXIMATE"), ("refused_groups", "REFUSED"))
    groups = F.count_if(F.col("reason").isNull())
    by = [F.count_if((F.col("status") == s) & F.col("reason").isNull()).alias(n) for n, s in names]
    out = report.groupBy("capture_id").agg(F.max(rank).alias("_r"), groups.alias("group_count"), *sums, *by)
    return out.select("capture_id", F.element_at(F.array(*map(F.lit, STATUSES)), F.col("_r")).alias("status"), *[c for c in out.columns if c not in ("capture_id", "_r")])


#: The ways to part a capture into groups.
PARTITIONS = ("layer-head-token", "layer-token", "layer-head-chunk")


def profile_corpus(spark: SparkSession, captures: dict[str, tuple[str, str]], partitions: tuple[str, ...] = PARTITIONS, policy: Policy = Policy()) -> DataFrame:
    """The profiles of all captures (name: capture and metadata file) under each partition, with both names."""
    out = None
    for name, (capture, metadata) in captures.items():
        for partition in partitions:
            found = profile_capture(spark, capture, metadata, replace(policy, partition=partition))
            found = found.select(F.lit(name).alias("case"), F.lit(partition).alias("partition"), "*")
            out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    if out is None:
        raise ValueError("a corpus has a capture at least")
    return out


def corpus_coverage(spark: SparkSession, report: DataFrame, cases: list[str], partitions: tuple[str, ...] = PARTITIONS) -> DataFrame:
    """Whether a corpus' report covers every case under every partition, and nothing else."""
    wanted = spark.createDataFrame([(c, p) for c in cases for p in partitions], "`case` string, partition string")
    return gates.coverage(wanted, report, ["case", "partition"])
