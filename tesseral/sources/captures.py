"""Captures from exported layer files: their layout, bundles of keys and of values, transposed values, conversion."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files

#: Element types by the names that exports give them, and tensor kinds (fixed values).
EXPORTED = {"f16le": "f16", "bf16le": "bf16"}
KINDS = {"k": "key", "v": "value"}
EXPORT_FORMAT = "qatq-llama-cpp-kv-v1"


def layout(listing: DataFrame, heads: int, *, layers: list[int] | None = None) -> DataFrame:
    """(id, layer, kind, offset_bytes, byte_length, token_count, heads, dimension, valid) of exported files (name, kind, dtype, embedding, active_cells, bytes).

    Files follow each other in one capture in the order of their names. A file is
    valid if its name ends in its layer, its rows part into heads, it is of a
    16-bit type and as long as it says.
    """
    found = listing.withColumn("layer", F.regexp_extract("name", r"_l(\d+)$", 1))
    found = found.withColumn("layer", F.when(F.col("layer") != "", F.col("layer").cast("int")))
    if layers is not None:
        found = found.where(F.col("layer").isin(layers))
    order = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a model has layers, twice
    at = F.coalesce(F.sum("bytes").over(order), F.lit(0).cast("long"))
    kind = F.when(F.col("kind") == "k", KINDS["k"]).when(F.col("kind") == "v", KINDS["v"])
    valid = F.col("layer").isNotNull() & (F.col("embedding") % heads == 0) & F.col("dtype").isin(*EXPORTED) & (F.col("bytes") == F.col("active_cells") * F.col("embedding") * 2)
    return found.select(
        F.col("name").alias("id"), "layer", kind.alias("kind"), at.alias("offset_bytes"), F.col("bytes").alias("byte_length"), F.col("active_cells").alias("token_count"),
        F.lit(heads).alias("heads"), F.floor(F.col("embedding") / heads).cast("long").alias("dimension"), valid.alias("valid"),
    )


def bundles(listing: DataFrame) -> DataFrame:
    """(bundle, name, offset_bytes, byte_length): where each file (name, kind, bytes) lies in the bundle of its kind and in that of all."""
    both = listing.select("name", "bytes", F.explode(F.array(F.when(F.col("kind") == "k", "keys").otherwise("values"), F.lit("all"))).alias("bundle"))
    order = Window.partitionBy("bundle").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    return both.select("bundle", "name", F.coalesce(F.sum("bytes").over(order), F.lit(0).cast("long")).alias("offset_bytes"), F.col("bytes").alias("byte_length"))


def write_bundles(contents: DataFrame, folder: str | Path, suffix: str) -> dict[str, int]:
    """Writes contents (name, kind, content) to one file for keys, one for values and one for all; a file's bytes are held at a time."""
    sizes = {}
    for bundle, kind in (("keys", "k"), ("values", "v"), ("all", None)):
        part = contents.where(F.col("kind") == kind) if kind else contents
        rows = (bytes(r.content) for r in part.select("name", "content").orderBy("name").toLocalIterator())
        first = next(rows, None)
        if first is None:
            raise ValueError(f"no file for the bundle of {bundle}")
        target = Path(folder) / f"cache_{bundle}_packed.{suffix}"
        files.write_atomic(target, itertools.chain([first], rows))
        sizes[bundle] = target.stat().st_size
    return sizes


def token_major(payloads: DataFrame, *, width: int = 2) -> DataFrame:
    """payloads (tensor_id, tokens, dimension, payload) whose values lie dimension by dimension, turned to lie token by token."""
    kind = payloads.schema["tensor_id"].dataType.simpleString()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, dimension, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if len(raw) != tokens * dimension * width:
                    raise ValueError("a payload doesn't fit its shape")
                out.append(np.frombuffer(raw, f"<u{width}").reshape(dimension, tokens).T.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["tensor_id", "tokens", "dimension", "payload"])

    rows = payloads.select("tensor_id", F.col("tokens").cast("long").alias("tokens"), F.col("dimension").cast("long").alias("dimension"), "payload")
    return rows.mapInArrow(turn, f"tensor_id {kind}, tokens long, dimension long, payload binary")


def convert(raw: str | Path, output: str | Path, *, heads: int, prompt: bytes, identity: dict[str, str], layers: set[int] | None = None, rope_stage: str = "unknown") -> dict:
    """A capture bundle from a folder of exported files and their manifest; what doesn't fit raises, what is there stays.

    identity gives capture_id, model, model_family, runtime, runtime_version and prompt_class.
    """
    raw, source = Path(raw), (Path(raw) / "manifest.json").read_bytes()
    listed = json.loads(source)
    if heads <= 0 or listed.get("format") != EXPORT_FORMAT:
        raise ValueError("an export of another format, or no heads")
    capture, tensors, dtypes = bytearray(), [], set()
    for entry in listed["tensors"]:
        m = re.search(r"_l(\d+)$", entry["name"])
        if not m or entry["dtype"] not in EXPORTED or int(entry["embedding"]) % heads:
            raise ValueError(f"{entry['name']}: no layer, another type, or rows that don't part into heads")
        if layers is not None and int(m[1]) not in layers:
            continue
        data, cells, width = (raw / entry["file"]).read_bytes(), int(entry["active_cells"]), int(entry["embedding"])
        if len(data) != cells * width * 2:
            raise ValueError(f"{entry['file']} has {len(data)} bytes")
        if entry.get("transposed"):
            data = np.frombuffer(data, "<u2").reshape(width, cells).T.tobytes()
        dtypes.add(EXPORTED[entry["dtype"]])
        stage = rope_stage if entry["kind"] == "k" else "not_applicable"
        tensors.append({"id": entry["name"], "offset_bytes": len(capture), "byte_length": len(data), "layer": int(m[1]), "kind": KINDS[entry["kind"]], "rope_stage": stage, "token_start": 0, "token_count": cells, "heads": heads, "dimension": width // heads, "layout": "token_head_dimension"})
        capture += data
    if len(dtypes) != 1:
        raise ValueError("no tensor, or tensors of several types")
    meta = {"schema_version": 1, **identity, "prompt_sha256": hashlib.sha256(prompt).hexdigest(), "context_length": max(t["token_count"] for t in tensors), "dtype": dtypes.pop(), "tensors": tensors}
    files.check_capture(meta, len(capture))
    text = (json.dumps(meta, indent=2) + "\n").encode()
    digests = {"source_manifest_sha256": source, "capture_sha256": bytes(capture), "metadata_sha256": text, "prompt_sha256": prompt}
    provenance = {"schema_version": 1} | {k: hashlib.sha256(v).hexdigest() for k, v in digests.items()}
    files.write_bundle(output, {"capture.kv": bytes(capture), "capture.json": text, "provenance.json": (json.dumps(provenance, indent=2) + "\n").encode()})
    return meta


def sweep(spark: SparkSession, **parameters: list[str]) -> DataFrame:
    """A row for each combination of parameter values, in their order, with its number as `case`."""
    names = list(parameters)
    rows = [(i, *values) for i, values in enumerate(itertools.product(*parameters.values()))]
    return spark.createDataFrame(rows, ", ".join(["case long", *(f"`{n}` string" for n in names)]))
