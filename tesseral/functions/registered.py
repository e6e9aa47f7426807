"""The codec, checksums and bounds as SQL functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import capacity, codec, fnv, lossy


def tensor_encode(payload: pd.Series, dtype: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else codec.encode_exact(p, t) for p, t in zip(payload, dtype, strict=True)])


def tensor_decode(encoded: pd.Series) -> pd.Series:
    return encoded.map(lambda p: None if p is None else codec.decode_exact(p)[0])


def tensor_strategy(encoded: pd.Series) -> pd.Series:
    return encoded.map(lambda p: None if p is None else codec.describe(p)[1])


def tensor_inspect(encoded: pd.Series) -> pd.DataFrame:
    told = [codec.describe(p) for p in encoded]
    return pd.DataFrame([(h.count, s, t, f"{h.checksum:016x}") for h, s, t in told], columns=["n", "strategy", "dtype", "checksum"])


def i4_quantize(vec: pd.Series) -> pd.Series:
    def levels(v):
        x = np.asarray(v, np.float32)
        return (lossy.nibbles_of(x, lossy.scale_of(x)).astype(int) - 8).tolist()

    return vec.map(lambda v: None if v is None else levels(v))


def tq_inner_product(payload: pd.Series, query: pd.Series) -> pd.Series:
    return pd.Series([float(codec.inner_product(p, np.asarray(q, np.float32))) for p, q in zip(payload, query, strict=True)])


def fnv1a64(data: pd.Series) -> pd.Series:
    return pd.Series([f"{h:016x}" for h in fnv.fnv1a64_many([bytes(d or b"") for d in data])])


def hamming_bound(n: pd.Series, distance: pd.Series) -> pd.Series:
    return pd.Series([str(capacity.hamming_bound(int(a), int(b))) for a, b in zip(n, distance, strict=True)])


def rankin_bound(n: pd.Series, inner_product: pd.Series) -> pd.Series:
    return pd.Series([capacity.rankin_bound(int(a), capacity.canonical_real(s)) for a, s in zip(n, inner_product, strict=True)])


def check_certificate(text: pd.Series) -> pd.Series:
    return text.map(lambda t: capacity.check_json(t or "")[0])


class ContainerChunks:
    def eval(self, data: bytes):
        for i, p in enumerate(codec.payloads(bytes(data))):
            header, strategy, _ = codec.describe(p)
            yield i, header.count, strategy, p


#: What each function returns.
FUNCTIONS = {
    tensor_encode: "binary",
    tensor_decode: "binary",
    tensor_strategy: "string",
    tensor_inspect: "n long, strategy string, dtype string, checksum string",
    i4_quantize: "array<int>",
    tq_inner_product: "float",
    fnv1a64: "string",
    hamming_bound: "string",
    rankin_bound: "long",
    check_certificate: "string",
}


def register(spark: SparkSession) -> None:
    """Makes all of them callable from SQL, and container_chunks as a table function."""
    for f, kind in FUNCTIONS.items():
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("container_chunks", F.udtf(ContainerChunks, returnType="chunk_id long, n long, strategy string, encoded binary"))
