"""Capacity requests and certificates as tables: one row in, one row out, no shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import capacity


def evaluate_requests(requests: DataFrame, *, id_col: str = "request_no", text_col: str = "request") -> DataFrame:
    """(id, outcome, exit_code, digest, upper_bound, certificate, reason) for each request; a null one is refused."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [capacity.evaluate(t or "") for t in batch.column(1).to_pylist()]
            names = ("outcome", "exit_code", "digest", "upper_bound", "certificate", "reason")
            kinds = [pa.int32() if n == "exit_code" else pa.string() for n in names]
            columns = [pa.array([f[n] for f in found], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, *names])

    kind = requests.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, outcome string, exit_code int, digest string, upper_bound string, certificate string, reason string"
    return requests.select(id_col, text_col).mapInArrow(evaluate, schema)


def check_certificates(certificates: DataFrame, *, id_col: str = "request_no", text_col: str = "certificate") -> DataFrame:
    """(id, verdict, why) for each certificate; a null one is INVALID."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [capacity.check_json(t or "") for t in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.string()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "verdict", "why"])

    kind = certificates.schema[id_col].dataType.simpleString()
    return certificates.select(id_col, text_col).mapInArrow(check, f"{id_col} {kind}, verdict string, why string")


def corpus(requests: DataFrame, *, id_col: str = "request_no", text_col: str = "request") -> DataFrame:
    """(id, digest, certificate, sha256) of the requests that are proved infeasible."""
    found = evaluate_requests(requests, id_col=id_col, text_col=text_col).where("certificate is not null")
    return found.select(id_col, "digest", "certificate", F.sha2(F.encode("certificate", "utf-8"), 256).alias("sha256"))


def reproduced(certificates: DataFrame, again: DataFrame, *, id_col: str = "request_no") -> DataFrame:
    """(id, verdict, outcome): certificates checked anew and joined by id with a second corpus.

    AGREE where both have the same bytes and the checker, which finds each number
    another way, says VALID; else DISAGREE, and MISSING where the second has none.
    """
    checked = check_certificates(certificates, id_col=id_col).select(id_col, "verdict")
    second = again.select(id_col, F.col("sha256").alias("_second"))
    both = certificates.select(id_col, "sha256").join(checked, id_col).join(second, id_col, "left")
    same = (F.col("sha256") == F.col("_second")) & (F.col("verdict") == "VALID")
    outcome = F.when(F.col("_second").isNull(), "MISSING").when(same, "AGREE").otherwise("DISAGREE")
    return both.select(id_col, "verdict", outcome.alias("outcome"))
