"""Raw tensor files, manifests, containers and capture bundles."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import tempfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec

SUFFIXES = {"f32le": "f32", "f16le": "f16", "bf16le": "bf16"}


def _dtype() -> F.Column:
    suffix = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    out = F.lit(None).cast("string")
    for name, dtype in SUFFIXES.items():
        out = F.when(suffix == name, dtype).otherwise(out)
    return out


def tensor_files(spark: SparkSession, path: str, *, dtype: str | None = None, max_values: int = 1 << 32) -> DataFrame:
    """(path, dtype, n, valid): the files at a path by their names and sizes alone; the type is that of the suffix.

    valid tells whether a file holds a whole number of elements, at most max_values.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    files = files.withColumn("dtype", F.lit(dtype) if dtype else _dtype()).where("dtype is not null")
    width = F.when(F.col("dtype") == "f32", 4).otherwise(2)
    whole = F.floor(F.col("length") / width)
    return files.select("path", "dtype", whole.alias("n"), ((F.col("length") % width == 0) & (whole <= max_values)).alias("valid"))


def read_tensors(spark: SparkSession, path: str, *, dtype: str | None = None, chunk_values: int = 1 << 18) -> DataFrame:
    """(tensor_id, chunk_id, dtype, payload): the tensors at a path in chunks; a file of a broken size raises."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("dtype", F.lit(dtype) if dtype else _dtype()).where("dtype is not null")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, content, kind in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(content) % codec.WIDTHS[kind]:
                    raise codec.CodecError(f"{path_} holds no whole number of {kind} elements")
                parts = codec.chunks(content, kind, chunk_values)
                columns = [pa.array([path_] * len(parts)), pa.array(range(len(parts)), pa.int64()), pa.array([kind] * len(parts)), pa.array(parts, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["tensor_id", "chunk_id", "dtype", "payload"])

    return files.select("path", "content", "dtype").mapInArrow(split, "tensor_id string, chunk_id long, dtype string, payload binary")


def parse_input(spec: str) -> tuple[str, str, str]:
    """label:dtype:path"""
    label, dtype, path = (spec.split(":", 2) + ["", ""])[:3]
    if not label or dtype not in codec.WIDTHS or not path:
        raise ValueError("an input is label:dtype:path")
    return label, dtype, path


def parse_named_input(spec: str) -> tuple[str, str]:
    """name:path"""
    name, _, path = spec.partition(":")
    if not name or not path:
        raise ValueError("an input is name:path")
    return name, path


#: Other names of the modes (fixed values).
MODE_NAMES = {
    "i4": "lossy-i4", "qatq-i4": "lossy-i4", "f32": "lossless-f32", "exact-f32": "lossless-f32",
    "standard-turboquant-q4": "turboquant-q4", "tq-q4": "turboquant-q4",
    "qatq-phase1": "phase1-q4", "qatq-q4": "phase1-q4", "quaternion-q4": "phase1-q4", "qatq-exact": "exact",
}


def parse_mode(text: str) -> str:
    """A mode by any of its names, in any case."""
    name = text.strip().lower()
    name = MODE_NAMES.get(name, name)
    if name not in codec.MODES or text.strip().lower() == "exact":
        raise ValueError(f"no mode {text!r}")
    return name


def parse_seed(text: str) -> int:
    """An unsigned number of 64 bits, decimal or, after 0x, hexadecimal."""
    m = re.fullmatch(r"0[xX]([0-9a-fA-F]+)|\+?([0-9]+)", text, re.ASCII)
    value = -1 if not m else int(m[1], 16) if m[1] else int(m[2])
    if not 0 <= value < 1 << 64:
        raise ValueError(f"no seed {text!r}")
    return value


# Manifests: blocks of key = "value" under [fixture].

#: The keys of a fixture in a manifest.
KEYS = ("group", "name", "path", "shape", "notes")


def parse_manifest(text: str, folder: str = "") -> list[dict[str, str | None]]:
    """The blocks of a manifest; relative paths are from its folder. What is not known or missing raises."""
    blocks: list[dict[str, str | None]] = []
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if line == "[fixture]":
            blocks.append({})
            continue
        m = re.fullmatch(r'(\w+)\s*=\s*(?:"(.*)"|(.*))', line)
        if not m or m[1] not in KEYS or not blocks or m[1] in blocks[-1]:
            raise ValueError(f"line {number} of a manifest: {line}")
        blocks[-1][m[1]] = m[2] if m[2] is not None else m[3]
    for b in blocks:
        if not b.get("name") or not b.get("path"):
            raise ValueError("a fixture needs a name and a path")
        path = PurePosixPath(b["path"])
        b["path"] = str(path if path.is_absolute() or not folder else PurePosixPath(folder) / path)
    return [{"group": "fixture", "shape": None, "notes": None} | b for b in blocks]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(group, name, path, shape, notes) of a manifest."""
    text = spark.read.text(path, wholetext=True).first()
    blocks = parse_manifest(text.value if text else "", str(PurePosixPath(path).parent))
    return spark.createDataFrame([tuple(b[k] for k in KEYS) for b in blocks], "`group` string, name string, path string, shape string, notes string")


def audit_fixtures(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """manifest with each file's n and sha256; a file that is missing raises."""
    paths = [r.path for r in manifest.select("path").collect()]  # a manifest is a small file
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", r"^file:/*", "/").alias("file"), "length", F.sha2("content", 256).alias("sha256"))
    both = manifest.join(F.broadcast(files), F.col("path") == F.col("file"), "left")
    there = F.assert_true(F.col("file").isNotNull(), F.concat(F.lit("missing: "), F.col("path")))
    return both.select(*KEYS, F.coalesce(there.cast("long"), F.floor(F.col("length") / 4)).alias("n"), "sha256")


# Single files.


def write_atomic(path: str | Path, parts: Iterator[bytes] | list[bytes]) -> None:
    """Writes beside the target and renames; a failure leaves what was there."""
    target = Path(path)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            for part in parts:
                out.write(part)
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def encode_file(source: str | Path, target: str | Path, *, dtype: str = "f32", chunk_values: int = 1 << 18, stride: int | None = None) -> int:
    """A container of a raw tensor file, which is read chunk by chunk; the number of chunks."""

    def parts() -> Iterator[bytes]:
        size = chunk_values * codec.WIDTHS[dtype]
        with open(source, "rb") as raw:
            part = raw.read(size)
            while True:
                yield codec.encode_exact(part, dtype, stride)
                part = raw.read(size)
                if not part:
                    return

    if not 0 < chunk_values <= codec.MOST_VALUES:
        raise codec.CodecError("a chunk's size is out of range")
    return _write_parts(parts(), target)


def container_payloads(path: str | Path, *, checked: bool = True) -> Iterator[bytes]:
    """The payloads of a container file, one held at a time.

    With `checked` the file is read twice: lengths, counts and checksum are
    settled before the first payload is given.
    """
    from ..functions.fnv import fnv1a64

    def walk() -> Iterator[bytes]:
        with open(path, "rb") as data:
            data.seek(32)
            for _ in range(many):
                head = data.read(4)
                payload = data.read(int.from_bytes(head, "big")) if len(head) == 4 else b""
                if len(head) < 4 or len(payload) != int.from_bytes(head, "big"):
                    raise codec.CodecError("a container breaks off")
                yield payload
            if data.read(1):
                raise codec.CodecError("bytes after the last chunk")

    with open(path, "rb") as data:
        total, many, checksum = codec.container_head(data.read(32))
    if checked:
        state, count, kinds = None, 0, set()
        for payload in walk():
            part = len(payload).to_bytes(4, "big") + payload
            state = fnv1a64(part) if state is None else fnv1a64(part, state)
            header, _, dtype = codec.describe(payload)
            count, kinds = count + header.count, kinds | {dtype}
        if state != checksum or count != total or len(kinds) != 1:
            raise codec.CodecError("a container's checksum, length or types differ")
    yield from walk()


def write_container(encoded: DataFrame, path: str | Path) -> None:
    """One container file of encoded chunks (chunk_id, encoded), in their order; a few chunks are held at a time."""
    rows = encoded.select("chunk_id", "encoded").orderBy("chunk_id").toLocalIterator()
    _write_parts((bytes(r.encoded) for r in rows), path)


def _write_parts(payloads: Iterator[bytes], path: str | Path) -> int:
    """A container file of payloads. The checksum comes before the chunks it is of, so the file is finished by writing it last."""
    from ..functions.fnv import fnv1a64

    target, many, total, state = Path(path), 0, 0, None
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=f".{target.name}.")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(b"\0" * 32)
            for payload in payloads:
                part = len(payload).to_bytes(4, "big") + payload
                state = fnv1a64(part) if state is None else fnv1a64(part, state)
                total, many = total + codec.read_header(payload, "exact").count, many + 1
                out.write(part)
            if not many:
                raise codec.CodecError("a container has a chunk at least")
            head = codec.CONTAINER_MAGIC + bytes((codec.CONTAINER_VERSION, codec.MODES["exact"], 0, 0))
            out.seek(0)
            out.write(head + total.to_bytes(8, "big") + many.to_bytes(4, "big") + b"\0\0\0\0" + state.to_bytes(8, "big"))
        os.replace(name, target)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return many


def container_rows(files: DataFrame, *, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(tensor_id, chunk_id, dtype, n, strategy, encoded) of container files, after each has been checked."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = codec.payloads(content)
                told = [codec.describe(p) for p in parts]
                columns = [[name] * len(parts), range(len(parts)), [t[2] for t in told], [t[0].count for t in told], [t[1] for t in told], parts]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["tensor_id", "chunk_id", "dtype", "n", "strategy", "encoded"])

    schema = "tensor_id string, chunk_id long, dtype string, n long, strategy string, encoded binary"
    return files.select(F.col(id_col).cast("string"), content_col).mapInArrow(split, schema)


def big_endian_number(data: F.Column, at: int, size: int) -> F.Column:
    """The unsigned number of `size` bytes at a place of a binary column, by Spark's own functions."""
    return F.conv(F.hex(F.substring(data, at + 1, size)), 16, 10).cast("long")


def container_header(content: F.Column) -> list[F.Column]:
    """version, mode, n and chunks of a container, from its first 20 bytes; what is no container raises."""
    magic = F.assert_true(F.substring(content, 1, 4) == F.lit(codec.CONTAINER_MAGIC), "not a container")
    version = F.coalesce(magic.cast("int"), big_endian_number(content, 4, 1).cast("int"))
    return [version.alias("version"), big_endian_number(content, 5, 1).cast("int").alias("mode"), big_endian_number(content, 8, 8).alias("n"), big_endian_number(content, 16, 4).alias("chunks")]


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    return container_rows(spark.read.format("binaryFile").load(path))


# Bundles: files, and a manifest of their sizes and digests.


def write_bundle(folder: str | Path, files: dict[str, bytes]) -> None:
    """A folder of files with manifest.json; one that is there is never overwritten."""
    target = Path(folder)
    if target.exists():
        raise FileExistsError(target)
    made = Path(tempfile.mkdtemp(dir=target.parent, prefix=f".{target.name}."))
    try:
        for name, data in files.items():
            (made / name).write_bytes(data)
        listed = [{"path": n, "bytes": len(d), "sha256": hashlib.sha256(d).hexdigest()} for n, d in sorted(files.items())]
        (made / "manifest.json").write_text(json.dumps({"schema_version": 1, "files": listed}, indent=2) + "\n")
        made.rename(target)
    except BaseException:
        shutil.rmtree(made, ignore_errors=True)
        raise


def verify_bundle(folder: str | Path) -> list[str]:
    """What differs from the bundle's manifest; nothing if all is well. Paths out of the folder are refused."""
    target, wrong = Path(folder), []
    for entry in json.loads((target / "manifest.json").read_text())["files"]:
        name = PurePosixPath(entry["path"])
        if name.is_absolute() or ".." in name.parts or len(name.parts) != 1:
            wrong.append(f"{name}: not a plain name")
            continue
        file = target / name
        data = file.read_bytes() if file.is_file() else None
        if data is None or len(data) != entry["bytes"] or hashlib.sha256(data).hexdigest() != entry["sha256"]:
            wrong.append(f"{name}: " + ("missing" if data is None else "differs"))
    return wrong


# Captures: tensors at offsets of one file, described by strict JSON.

#: The fields of a capture's description and of its tensors.
CAPTURE = {"schema_version", "capture_id", "model", "model_family", "runtime", "runtime_version", "prompt_class", "prompt_sha256", "context_length", "dtype", "tensors"}
TENSOR = {"id", "offset_bytes", "byte_length", "layer", "kind", "rope_stage", "token_start", "token_count", "heads", "dimension", "layout"}


def check_capture(meta: dict, size: int) -> None:
    """Raises where a capture's description is not whole or doesn't fit a file of this size."""
    if not isinstance(meta, dict) or meta.keys() != CAPTURE or meta["schema_version"] != 1:
        raise ValueError("a capture's fields or schema version")
    if not all(meta[k] for k in ("capture_id", "model", "model_family", "runtime", "prompt_class", "tensors")) or meta["dtype"] not in codec.WIDTHS:
        raise ValueError("a capture needs its identity, origin, type and tensors")
    if not re.fullmatch("[0-9a-fA-F]{64}", meta["prompt_sha256"]):
        raise ValueError("prompt_sha256 is 64 hexadecimal digits")
    seen = set()
    for t in meta["tensors"]:
        if t.keys() != TENSOR or t["id"] in seen or t["layout"] != "token_head_dimension" or t["kind"] not in ("key", "value"):
            raise ValueError("a tensor's fields, or its id twice")
        seen.add(t["id"])
        n = t["token_count"] * t["heads"] * t["dimension"]
        if n <= 0 or n * codec.WIDTHS[meta["dtype"]] != t["byte_length"] or t["offset_bytes"] < 0 or t["offset_bytes"] + t["byte_length"] > size:
            raise ValueError(f"tensor {t['id']} doesn't fit its shape or the file")


def read_capture(spark: SparkSession, capture: str, metadata: str) -> DataFrame:
    """(tensor_id, layer, kind, heads, dimension, token, vec): one row for each token of each tensor, its heads side by side."""
    text = spark.read.text(metadata, wholetext=True).first().value
    meta = json.loads(text, object_pairs_hook=_unique)
    files = spark.read.format("binaryFile").load(capture)
    check_capture(meta, files.select("length").first().length)
    dtype, tensors = meta["dtype"], meta["tensors"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()  # tensors are cut from it without a copy
                for t in tensors:
                    raw = np.frombuffer(data, "<u2" if dtype != "f32" else "<f4", t["byte_length"] // codec.WIDTHS[dtype], t["offset_bytes"])
                    values = raw.view("<f2").astype(np.float64) if dtype == "f16" else (raw.astype(np.uint32) << 16).view(np.float32).astype(np.float64) if dtype == "bf16" else raw.astype(np.float64)
                    tokens = values.reshape(-1, t["heads"] * t["dimension"])
                    n = len(tokens)
                    columns = [pa.array([t[k]] * n, kind) for k, kind in (("id", pa.string()), ("layer", pa.int32()), ("kind", pa.string()), ("heads", pa.int32()), ("dimension", pa.int32()))]
                    columns += [pa.array(range(n), pa.int64()), pa.array(tokens.tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["tensor_id", "layer", "kind", "heads", "dimension", "token", "vec"])

    return files.select("content").mapInArrow(rows, "tensor_id string, layer int, kind string, heads int, dimension int, token long, vec array<double>")


def capture_digests(spark: SparkSession, capture: str, metadata: str) -> DataFrame:
    """(capture_bytes, capture_sha256, metadata_sha256) of a capture and its description."""
    one = spark.read.format("binaryFile").load(capture).select(F.col("length").alias("capture_bytes"), F.sha2("content", 256).alias("capture_sha256"))
    two = spark.read.format("binaryFile").load(metadata).select(F.sha2("content", 256).alias("metadata_sha256"))
    return one.join(F.broadcast(two))  # one row each


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a field occurs twice")
    return out
