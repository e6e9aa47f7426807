"""Queries that hold the codec, the fixtures, the gates and the bounds against SQL: what goes in comes out, number for number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import capacity, codec, lossy, research
from ..operators import capacity as bounds
from ..operators import gates, geometry, retrieval, tensors
from ..sources import captures, files
from ..sources.fixtures import typed_words
from .queries import CHUNK, UNITS, WORDS, event_chunks, query, rounded, table, unit

#: Chunks of one container.
CONTAINED = 64


def word_sums(payloads: DataFrame, keys: list[str], width: int = 4) -> DataFrame:
    """keys, n, total, mixed: number, sum and XOR of the words of little-endian payloads."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (payloads.schema[k] for k in keys))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(p, f"<u{width}").astype(np.int64) for p in batch.column(len(keys)).to_pylist()]
            numbers = [[len(w) for w in own], [int(w.sum()) for w in own], [int(np.bitwise_xor.reduce(w)) for w in own]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *(pa.array(x, pa.int64()) for x in numbers)], names=[*keys, "n", "total", "mixed"])

    return payloads.select(*keys, "payload").mapInArrow(sums, f"{kinds}, n long, total long, mixed long")


SUMS = "sums AS (SELECT chunk_id, count(*) AS n, sum(word)::BIGINT AS total, bit_xor(word) AS mixed FROM words GROUP BY chunk_id)"
FORMS = codec.STRATEGIES[:9]


@query(f"WITH {WORDS}, {SUMS} SELECT strategy, chunk_id, n, total, mixed FROM sums, (VALUES {', '.join(f'({chr(39)}{s}{chr(39)})' for s in FORMS)}) f(strategy)")
def strategy_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exact form of each chunk, encoded and decoded."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(c, codec.describe(p)[1], codec.decode_exact(p)[0]) for c, raw in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for p in codec.encode_each(raw)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["chunk_id", "strategy", "payload"])

    back = event_chunks(spark, sf_dir).select("chunk_id", "payload").mapInArrow(each, "chunk_id long, strategy string, payload binary")
    return word_sums(back, ["strategy", "chunk_id"])


def half_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper halves of the events' words as chunks of 16-bit elements, once as bf16 and once as f16."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(np.frombuffer(p, "<u4") >> 16).astype("<u2").tobytes() for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["chunk_id", "payload"])

    halves = event_chunks(spark, sf_dir).select("chunk_id", "payload").mapInArrow(cut, "chunk_id long, payload binary")
    return halves.select(F.lit("t").alias("tensor_id"), "chunk_id", F.explode(F.array(F.lit("bf16"), F.lit("f16"))).alias("dtype"), "payload")


@query(
    f"WITH {WORDS}, halves AS (SELECT chunk_id, word >> 16 AS word FROM words), sums AS (SELECT chunk_id, count(*) AS n, sum(word)::BIGINT AS total, bit_xor(word) AS mixed FROM halves GROUP BY chunk_id)"
    " SELECT dtype, stride, chunk_id, n, total, mixed FROM sums, (VALUES ('bf16'), ('f16')) d(dtype), (VALUES (0::BIGINT), (16::BIGINT)) s(stride)"
)
def typed_roundtrips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16-bit chunks through the selector, without and with a hint of their stride."""
    chunks, out = half_chunks(spark, sf_dir), None
    for stride in (0, 16):
        encoded = tensors.encode_chunks(chunks, stride or None)
        back = tensors.decode_chunks(encoded).select("dtype", F.lit(stride).cast("long").alias("stride"), "chunk_id", "payload")
        out = back if out is None else out.union(back)
    return word_sums(out, ["dtype", "stride", "chunk_id"], 2)


def contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(container, content): the events' exact payloads in container files of CONTAINED chunks."""
    encoded = tensors.encode_chunks(event_chunks(spark, sf_dir))
    listed = encoded.groupBy(F.floor(F.col("chunk_id") / CONTAINED).alias("container")).agg(F.sort_array(F.collect_list(F.struct("chunk_id", "encoded"))).alias("parts"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [codec.container([x["encoded"] for x in parts.as_py()]) for parts in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["container", "content"])

    return listed.mapInArrow(pack, "container long, content binary")


@query(f"WITH {WORDS}, {SUMS} SELECT chunk_id // {CONTAINED} AS container, chunk_id, n, total, mixed FROM sums")
def container_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks into containers, out again after all checks, and decoded."""
    rows = files.container_rows(contained(spark, sf_dir), id_col="container")
    back = tensors.decode_chunks(rows.select("tensor_id", "chunk_id", "encoded"))
    back = back.select(F.col("tensor_id").cast("long").alias("container"), (F.col("tensor_id").cast("long") * CONTAINED + F.col("chunk_id")).alias("chunk_id"), "payload")
    return word_sums(back, ["container", "chunk_id"])


@query(f"SELECT event_id // {CHUNK} // {CONTAINED} AS container, 2 AS version, 4 AS mode, count(*) AS n, count(DISTINCT event_id // {CHUNK}) AS chunks FROM events GROUP BY 1")
def container_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a container's first 32 bytes tell, the body unread."""
    return contained(spark, sf_dir).select("container", *files.container_header(F.col("content")))


def big_endian_fnv(words: str) -> str:
    """SQL for FNV-1a over the bytes of a list of words, the highest byte first."""
    step = "(xor(h, (w >> {s}) & 255) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT"
    chain = "h"
    for s in (24, 16, 8, 0):
        chain = step.format(s=s).replace("xor(h,", f"xor({chain},")
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform({words}, lambda w: w::UHUGEINT)), lambda h, w: {chain})"


@query(f"WITH {WORDS}, lists AS (SELECT chunk_id, list(word ORDER BY event_id) AS ws FROM words GROUP BY chunk_id) SELECT chunk_id, len(ws) AS n, printf('%016x', {big_endian_fnv('ws')}::UBIGINT) AS checksum FROM lists")
def payload_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and checksum from the first 28 bytes of each exact payload, by Spark's own functions."""
    encoded = tensors.encode_chunks(event_chunks(spark, sf_dir))
    return encoded.select("chunk_id", files.big_endian_number(F.col("encoded"), 8, 8).alias("n"), F.lower(F.hex(F.substring("encoded", 21, 8))).alias("checksum"))


I4 = (
    f"v AS (SELECT event_id, event_id // {CHUNK} AS chunk_id, value::FLOAT AS x FROM events),"
    " s AS (SELECT event_id, chunk_id, x, CASE WHEN max(abs(x)) OVER w > 0 THEN (max(abs(x)) OVER w / 7.0::DOUBLE)::FLOAT ELSE 1::FLOAT END AS scale FROM v WINDOW w AS (PARTITION BY chunk_id)),"
    " q AS (SELECT event_id, chunk_id, x, scale, least(7, greatest(-7, round((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE)))::INT AS level FROM s)"
)


def i4_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [codec.encode(np.frombuffer(raw, "<f4"), "lossy-i4") for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["chunk_id", "encoded"])

    return event_chunks(spark, sf_dir).select("chunk_id", "payload").mapInArrow(encode, "chunk_id long, encoded binary")


@query(
    f"WITH {I4}, hexed AS (SELECT chunk_id, count(*) AS n, string_agg(printf('%x', level + 8), '' ORDER BY event_id) AS h FROM q GROUP BY chunk_id)"
    " SELECT chunk_id, n, sha256(unhex(CASE WHEN n % 2 = 1 THEN h || '0' ELSE h END)) AS body FROM hexed"
)
def i4_payload_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed four-bit levels of each chunk, byte for byte."""
    return i4_payloads(spark, sf_dir).select("chunk_id", files.big_endian_number(F.col("encoded"), 8, 8).alias("n"), F.sha2(F.expr("substring(encoded, 29)"), 256).alias("body"))


@query(
    f"WITH {I4} SELECT chunk_id, count(*) AS n, round(max(abs(x::DOUBLE - (level::DOUBLE * scale::DOUBLE)::FLOAT::DOUBLE)), 6) AS max_abs,"
    " round(sqrt(avg(pow(x::DOUBLE - (level::DOUBLE * scale::DOUBLE)::FLOAT::DOUBLE, 2))), 6) AS rmse FROM q GROUP BY chunk_id"
)
def positional_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded four-bit payloads joined with the originals by chunk and place."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                y = codec.decode(p)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), chunk)), pa.array(np.arange(len(y))), pa.array(y.astype(np.float32))], names=["chunk_id", "place", "decoded"])

    decoded = i4_payloads(spark, sf_dir).mapInArrow(decode, "chunk_id long, place long, decoded float")
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / CHUNK).alias("chunk_id"), "event_id", F.col("value").cast("float").alias("x"))
    rows = rows.withColumn("place", (F.row_number().over(Window.partitionBy("chunk_id").orderBy("event_id")) - 1).cast("long"))
    error = F.col("x").cast("double") - F.col("decoded").cast("double")
    both = rows.join(decoded, ["chunk_id", "place"]).groupBy("chunk_id")
    return rounded(both.agg(F.count("*").alias("n"), F.max(F.abs(error)).alias("max_abs"), F.sqrt(F.avg(error * error)).alias("rmse")), "max_abs", "rmse")


@query(
    f"WITH v AS (SELECT event_id // {CHUNK} AS chunk_id, CASE WHEN isfinite(value) THEN value::FLOAT ELSE 0::FLOAT END AS x FROM events),"
    " s AS (SELECT chunk_id, x, greatest(least(abs(x)::DOUBLE, 240), 0.015625) AS size FROM v),"
    " p AS (SELECT chunk_id, x, size, pow(2.0, greatest(-6, least(7, floor(log2(size))))) AS unit FROM s),"
    " y AS (SELECT chunk_id, x, CASE WHEN x = 0 THEN 0 ELSE sign(x) * unit * (1 + least(7, floor(((size / unit - 1) * 8 + 0.5)::FLOAT)) / 8) END AS decoded FROM p)"
    " SELECT chunk_id, round(max(abs(x::DOUBLE - decoded)), 6) AS max_abs, round(sqrt(avg(pow(x::DOUBLE - decoded, 2))), 6) AS rmse FROM y GROUP BY chunk_id"
)
def fp8_quantize_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1).to_pylist():
                x = np.frombuffer(raw, "<f4")
                e = lossy.finite(x).astype(np.float64) - lossy.eight_bit(x).astype(np.float64)
                rows.append((float(np.abs(e).max(initial=0)), float(np.sqrt(np.mean(e * e)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.float64()) for k in (0, 1))], names=["chunk_id", "max_abs", "rmse"])

    return rounded(event_chunks(spark, sf_dir).select("chunk_id", "payload").mapInArrow(measure, "chunk_id long, max_abs double, rmse double"), "max_abs", "rmse")


MIX = "(({x}) * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT"


def splitmix_sql(state: str) -> str:
    """SQL for the output of SplitMix64 after a state, as UHUGEINT."""
    one = f"(({state}) + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT"
    two = MIX.format(x=f"xor({one}, ({one}) >> 30)", c="13787848793156543929")
    three = MIX.format(x=f"xor({two}, ({two}) >> 27)", c="10723151780598845931")
    return f"xor({three}, ({three}) >> 31)"


@query(f"SELECT c_custkey, printf('%016x', ({splitmix_sql('c_custkey::UHUGEINT')})::UBIGINT) AS mixed FROM customer")
def splitmix_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = lossy.splitmix64(batch.column(0).to_numpy().astype(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{x:016x}" for x in out.tolist()])], names=["c_custkey", "mixed"])

    return table(spark, sf_dir, "customer").select("c_custkey").mapInArrow(mix, "c_custkey long, mixed string")


ORDERED = "CASE WHEN word >= 32768 THEN 65535 - word ELSE word + 32768 END"


@query(
    f"WITH {WORDS}, halves AS (SELECT event_id, chunk_id, word >> 16 AS word FROM words),"
    f" up AS (SELECT event_id, chunk_id, word, {ORDERED} AS u, lag({ORDERED}) OVER (PARTITION BY chunk_id ORDER BY event_id) AS near FROM halves),"
    " d AS (SELECT event_id, CASE WHEN near IS NULL THEN NULL ELSE (u - near + 98304) % 65536 - 32768 END AS apart, word FROM up)"
    " SELECT event_id, CASE WHEN apart IS NULL THEN word WHEN apart >= 0 THEN 2 * apart ELSE -2 * apart - 1 END::BIGINT AS residual FROM d"
)
def ordered_ulp_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of neighbouring 16-bit words in the order of the floats that they are, folded to small numbers."""
    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.frombuffer(raw, "<u2").astype(np.uint16)
                out = research.ulp_residuals(words, len(words)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(chunk * CHUNK + np.arange(len(out))), pa.array(out)], names=["event_id", "residual"])

    chunks = half_chunks(spark, sf_dir).where("dtype = 'bf16'").select("chunk_id", "payload")
    return chunks.mapInArrow(residuals, "event_id long, residual long")


TYPED = (
    "f AS (SELECT 'repeated-rows' AS fixture, i AS pos, (15616 + (i % 128) * 101) & 65535 AS word FROM range(65536) r(i)"
    " UNION ALL SELECT 'drifting-rows', i, (15616 + (i % 128) * 101 + i // 4096) & 65535 FROM range(65536) r(i)"
    " UNION ALL SELECT 'adjacent-smooth', i, (15616 + i // 4) & 65535 FROM range(65536) r(i)"
    " UNION ALL SELECT 'twice-each', i, i & 65535 FROM range(65536) r(i))"
)


@query(
    f"WITH {TYPED}, strides AS (SELECT unnest([1, 128]) AS stride),"
    " d AS (SELECT fixture, pos, word, xor(word, lag(word, 1, 0) OVER w) AS near, xor(word, lag(word, 128, 0) OVER w) AS far FROM f WINDOW w AS (PARTITION BY fixture ORDER BY pos)),"
    " r AS (SELECT fixture, stride, CASE WHEN stride = 1 THEN near ELSE far END AS residual FROM d, strides)"
    " SELECT fixture, stride::INT AS stride, count(*) AS n, sum(residual)::BIGINT AS total, count(*) FILTER (WHERE residual & 255 = 0) + count(*) FILTER (WHERE residual >> 8 = 0) AS zero_bytes FROM r GROUP BY fixture, stride"
)
def stride_fixture_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero bytes that neighbours and rows before leave in the 16-bit fixtures, which is what the gates look at."""
    words, out = typed_words(spark), None
    zero = F.count_if(F.col("residual").bitwiseAND(F.lit(255)) == 0) + F.count_if(F.shiftright("residual", 8) == 0)
    for stride in (1, 128):
        found = tensors.xor_residuals(words, "fixture", "pos", stride).groupBy("fixture")
        found = found.agg(F.lit(stride).alias("stride"), F.count("*").alias("n"), F.sum("residual").alias("total"), zero.alias("zero_bytes"))
        out = found if out is None else out.union(found)
    return out


DATASETS = {"events": ("events", "event_id", "value"), "orders": ("orders", "o_orderkey", "o_totalprice"), "lineitem": ("lineitem", "l_orderkey * 8L + l_linenumber", "l_extendedprice")}
FIXED_MODES = ["lossless-f32", "lossy-i4", "phase1-q4"]


def dataset_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, chunk_id, payload): the numbers of three tables as f32 chunks by their keys."""
    out = None
    for name, (source, key, value) in DATASETS.items():
        rows = table(spark, sf_dir, source).select(F.expr(key).alias("pos"), F.col(value).alias("value"))
        rows = rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
        chunks = tensors.float_chunks(rows, "chunk", "pos", "value").select(F.lit(name).alias("dataset"), "chunk_id", "payload")
        out = chunks if out is None else out.union(chunks)
    return out


def datasets_sql() -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS dataset, ({k.replace('8L', '8')}) // {CHUNK} AS chunk_id, {v}::FLOAT AS x FROM {s}" for n, (s, k, v) in DATASETS.items())


@query(
    f"WITH d AS ({datasets_sql()}), c AS (SELECT dataset, chunk_id, count(*) AS n FROM d GROUP BY ALL)"
    ' SELECT dataset, sum(28 + 4 * n)::BIGINT AS "lossless-f32", sum(28 + (n + 1) // 2)::BIGINT AS "lossy-i4",'
    ' sum(28 + 20 + 2 * ((n + 3) // 4) + ((n + 3) // 4 * 4 + 7) // 8)::BIGINT AS "phase1-q4" FROM c GROUP BY dataset'
)
def dataset_codec_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded bytes of three datasets by codec, measured on the payloads."""
    return gates.size_pivot(gates.payload_sizes(dataset_chunks(spark, sf_dir), FIXED_MODES), FIXED_MODES)


@query(
    f"WITH d AS ({datasets_sql()}) SELECT dataset, count(DISTINCT chunk_id) AS chunks, count(*) AS n, 4 * count(*) AS raw_bytes,"
    " sum(x::BIT::BIGINT & 4294967295)::BIGINT AS total, bit_xor(x::BIT::BIGINT & 4294967295) AS mixed FROM d GROUP BY dataset"
)
def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of three datasets, taken from their exact payloads."""
    chunks = dataset_chunks(spark, sf_dir).select(F.col("dataset").alias("tensor_id"), "chunk_id", F.lit("f32").alias("dtype"), "payload")
    back = tensors.decode_chunks(tensors.encode_chunks(chunks)).withColumnRenamed("tensor_id", "dataset")
    sums = word_sums(back, ["dataset", "chunk_id"]).groupBy("dataset")
    return sums.agg(F.count("*").alias("chunks"), F.sum("n").alias("n"), F.sum(F.col("n") * 4).alias("raw_bytes"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed"))


@query(
    "WITH w AS (SELECT DISTINCT p_partkey AS k FROM part), f AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity >= 25)"
    " SELECT (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM w ANTI JOIN f USING (k)) AS missing,"
    " (SELECT count(*) FROM f ANTI JOIN w USING (k)) AS extra, (SELECT count(*) FROM w ANTI JOIN f USING (k)) + (SELECT count(*) FROM f ANTI JOIN w USING (k)) = 0 AS equal"
)
def coverage_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    found = table(spark, sf_dir, "lineitem").where("l_quantity >= 25").select(F.col("l_partkey").alias("k"))
    return gates.coverage(wanted, found, ["k"])


GATED = (
    "SELECT l_orderkey, l_linenumber, l_tax < 0.08 AS exact_bits, CASE WHEN l_returnflag = 'N' THEN 'raw-bits' ELSE 'byte-plane-zstd' END AS strategy,"
    " l_discount * 10 AS ratio, l_quantity AS encode_us, l_quantity / 2 AS decode_us, l_suppkey AS n FROM lineitem"
)


@query(
    f"WITH r AS ({GATED}) SELECT l_orderkey, l_linenumber, exact_bits AND (strategy = 'raw-bits' OR (ratio <= 0.8 AND encode_us <= 40)) AS custom,"
    " exact_bits AND (strategy = 'raw-bits' OR decode_us * 1000 / greatest(n, 1) <= 50) AS production, exact_bits AND (strategy = 'raw-bits' OR decode_us <= 12) AS latency FROM r"
)
def gate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three policies over one table of results."""
    results = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_tax < 0.08D AS exact_bits", "if(l_returnflag = 'N', 'raw-bits', 'byte-plane-zstd') AS strategy",
        "l_discount * 10 AS ratio", "l_quantity AS encode_us", "l_quantity / 2 AS decode_us", "l_suppkey AS n",
    )
    custom = gates.limited(results, max_ratio=0.8, max_encode_us=40).withColumnRenamed("passed", "custom")
    production = gates.limited(custom, max_ns_per_value=50, policy="production-kv").withColumnRenamed("passed", "production")
    latency = gates.limited(production, max_decode_us=12, policy="latency-budget").withColumnRenamed("passed", "latency")
    return latency.select("l_orderkey", "l_linenumber", "custom", "production", "latency")


SLICED = "WITH r AS (SELECT vec_id, unnest(range(0, len(embedding) // 16)) AS slice, embedding FROM embeddings)"


@query(f"{SLICED} SELECT vec_id, slice::INT AS slice, round(sqrt(list_sum(list_transform(embedding[slice * 16 + 1 : slice * 16 + 16], lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM r")
def record_slice_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut into records of 16, with their norms."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return retrieval.record_slices(rows).select("vec_id", "slice", F.round(geometry.l2_norm(F.col("vec")), 6).alias("norm"))


@query(
    f"WITH {UNITS}, same AS (SELECT label AS group_id, v AS k, count(*) AS n FROM units GROUP BY 1, 2)"
    " SELECT group_id, count(*) FILTER (WHERE n > 1) AS classes, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS members FROM same GROUP BY group_id"
)
def duplicate_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of unit vectors that are the same in every element."""
    return geometry.classes(unit(spark, sf_dir), "vec")


# Power iteration, as many steps as the operator takes, over each group's covariance.
COVARIANCE = (
    f"{UNITS}, cells AS (SELECT label, vec_id, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM units),"
    " cov AS (SELECT a.label, a.i, b.i AS j, covar_pop(a.x, b.x) AS c FROM cells a JOIN cells b ON a.vec_id = b.vec_id GROUP BY a.label, a.i, b.i),"
    " line AS (SELECT label, i, list(c ORDER BY j) AS row FROM cov GROUP BY label, i), matrix AS (SELECT label, list(row ORDER BY i) AS m, sum(row[i]) AS trace FROM line GROUP BY label),"
)
POWER = (
    COVARIANCE + " power(label, step, v) AS (SELECT label, 0, list_transform(m, lambda r: 1 / sqrt(len(m))) FROM matrix UNION ALL"
    " SELECT label, step + 1, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) FROM"
    " (SELECT p.label, p.step, list_transform(q.m, lambda r: list_dot_product(r, p.v)) AS w FROM power p JOIN matrix q ON p.label = q.label WHERE p.step < 64)),"
    " top AS (SELECT p.label, list_dot_product(p.v, list_transform(q.m, lambda r: list_dot_product(r, p.v))) / q.trace AS fraction FROM power p JOIN matrix q ON p.label = q.label WHERE p.step = 64)"
)
TOP_EIGEN = f"WITH RECURSIVE {POWER} SELECT label AS group_id, round(fraction, 6) AS top_fraction FROM top"

# Floyd's sampling of pair numbers, step by step, for every group.
SAMPLED = (
    f"{UNITS}, sizes AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS g FROM units GROUP BY label),"
    " start AS (SELECT label, n, n * (n - 1) // 2 AS total, least(200, n * (n - 1) // 2) AS many, xor(42::UHUGEINT, (g::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT) AS state FROM sizes),"
    " drawn(label, n, total, many, state, step, chosen) AS (SELECT label, n, total, many, state, 0, []::BIGINT[] FROM start UNION ALL"
    " SELECT label, n, total, many, (state + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT, step + 1,"
    f" list_append(chosen, CASE WHEN list_contains(chosen, (({splitmix_sql('state')}) % (total - many + step + 1)::UHUGEINT)::BIGINT) THEN total - many + step ELSE (({splitmix_sql('state')}) % (total - many + step + 1)::UHUGEINT)::BIGINT END)"
    " FROM drawn WHERE step < many AND many < total),"
    " numbers AS (SELECT label, n, unnest(CASE WHEN many < total THEN chosen ELSE range(0, total) END) AS k FROM drawn WHERE step = many OR many = total),"
    " rows AS (SELECT label, n, i, i * (2 * n - i - 1) // 2 AS first FROM sizes, LATERAL (SELECT unnest(range(0, n - 1)) AS i)),"
    " places AS (SELECT k.label, r.i, r.i + 1 + k.k - r.first AS j FROM numbers k JOIN rows r ON k.label = r.label AND k.k >= r.first AND k.k < r.first + r.n - 1 - r.i),"
    " ranked AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i FROM units),"
    " cosines AS (SELECT p.label, greatest(-1.0, least(1.0, list_dot_product(a.v, b.v))) AS cosine FROM places p JOIN ranked a ON a.label = p.label AND a.i = p.i JOIN ranked b ON b.label = p.label AND b.i = p.j)"
)
SAMPLED_MEAN = (
    f"WITH RECURSIVE {SAMPLED}, got AS (SELECT label, count(*) AS m, avg(cosine) AS mean, stddev_samp(cosine) AS s FROM cosines GROUP BY label)"
    " SELECT g.label AS group_id, m AS pairs, round(mean, 6) AS mean, round(s / sqrt(m) * CASE WHEN total > 1 THEN sqrt(greatest((total - m) / (total - 1), 0)) ELSE 0 END, 6) AS standard_error"
    " FROM got g JOIN start t ON g.label = t.label"
)

PROFILE = (
    f"WITH RECURSIVE {POWER}, pairs AS (SELECT a.label, a.vec_id AS l, b.vec_id AS r, greatest(-1.0, least(1.0, list_dot_product(a.v, b.v))) AS cosine FROM units a JOIN units b ON a.label = b.label AND a.vec_id < b.vec_id),"
    " counted AS (SELECT label, count(*) AS vector_count, count(*) FILTER (WHERE norm > 0) AS finite_vector_count, count(*) FILTER (WHERE norm = 0) AS zero_vectors, 0::BIGINT AS non_finite_vectors FROM norms GROUP BY label),"
    " met AS (SELECT label, count(*) AS evaluated_pairs, count(*) FILTER (WHERE cosine >= 0.9999) AS near_duplicate_pairs, round(count(*) FILTER (WHERE cosine >= 0.9999) / count(*), 6) AS near_duplicate_rate, round(avg(cosine), 6) AS mean_cosine, round(max(cosine), 6) AS max_cosine FROM pairs GROUP BY label),"
    " best AS (SELECT label, pos, max(cosine) AS cosine FROM (SELECT label, l AS pos, cosine FROM pairs UNION ALL SELECT label, r, cosine FROM pairs) GROUP BY label, pos),"
    " near AS (SELECT label, round(avg(cosine), 6) AS mean_nearest_cosine FROM best GROUP BY label),"
    " spread AS (SELECT c.label, round(sum(c) FILTER (WHERE i = j), 6) AS trace, round(sum(c) FILTER (WHERE i = j) * sum(c) FILTER (WHERE i = j) / sum(c * c), 4) AS participation FROM cov c GROUP BY c.label),"
    " codes AS (SELECT label, v, list_transform(v, lambda x: x < 0) AS signs, list_transform(v, lambda x: x >= 0) AS bits FROM units),"
    + ",".join(
        f" {n} AS (SELECT label, count(*) FILTER (WHERE n > 1) AS classes, coalesce(sum(n) FILTER (WHERE n > 1), 0)::BIGINT AS members FROM (SELECT label, {k}, count(*) AS n FROM codes GROUP BY 1, 2) GROUP BY label)"
        for n, k in (("exact", "v"), ("sign", "signs"), ("threshold", "bits"))
    )
    + " SELECT c.label AS group_id, vector_count, finite_vector_count, zero_vectors, non_finite_vectors, exact.classes AS exact_duplicate_classes, exact.members AS exact_duplicate_vectors,"
    " evaluated_pairs, near_duplicate_pairs, near_duplicate_rate, mean_cosine, max_cosine, mean_nearest_cosine, trace, participation, round(fraction, 6) AS top_fraction,"
    " sign.classes AS sign_collision_classes, sign.members AS sign_colliding_vectors, threshold.classes AS threshold_0_collision_classes, threshold.members AS threshold_0_colliding_vectors, 'APPROXIMATE' AS status"
    " FROM counted c JOIN met USING (label) JOIN near USING (label) JOIN spread USING (label) JOIN top USING (label) JOIN exact USING (label) JOIN sign USING (label) JOIN threshold USING (label)"
)


@query(
    f"WITH {I4.replace(f'event_id // {CHUNK}', 'vec_id').replace('event_id', 'i').replace('value::FLOAT AS x FROM events', 'e::FLOAT AS x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS e FROM embeddings)')},"
    " decoded AS (SELECT chunk_id AS vec_id, list((level::DOUBLE * scale::DOUBLE)::FLOAT ORDER BY i) AS d FROM q GROUP BY chunk_id),"
    " scored AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.d), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(b.d, lambda x: x::DOUBLE * x::DOUBLE))), 12) AS score"
    " FROM embeddings a, decoded b WHERE a.vec_id % 20 = 0)"
    " SELECT query_id, vec_id, round(score, 6) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) = 1"
)
def top1_through_i4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all records after four-bit coding to each stated query as it is."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return rounded(retrieval.top1(queries, retrieval.through(rows, "lossy-i4")), "score")


def sphere_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each part: unit vectors of some dimension, states and largest inner product; some of them malformed."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS request_no", "cast(2 + p_partkey % 19 AS int) AS n", "cast(p_partkey % 21 AS int) AS k", "cast(1 + p_partkey % 60 AS int) AS states", "cast(p_partkey % 7 AS int) AS bad")
    real = F.when(F.col("k") == 0, F.lit("0.0")).otherwise(F.concat(F.lit("-0."), F.lpad(F.col("k").cast("string"), 2, "0"), F.lit("0")))
    model = F.struct(
        F.lit("spherical").alias("kind"), F.when(F.col("bad") == 1, 1).otherwise(F.col("n")).alias("ambient_dimension"), F.when(F.col("bad") == 2, F.lit("007")).otherwise(F.col("states").cast("string")).alias("required_states"),
        F.when(F.col("bad") == 3, F.lit("none")).otherwise(F.lit("unit_l2")).alias("normalization"), F.struct(F.when(F.col("bad") == 4, F.lit("1.5")).otherwise(real).alias("maximum_inner_product")).alias("separation"),
    )
    engine = F.when(F.col("bad") == 5, F.lit("some-other-engine")).otherwise(F.lit("finite-spherical-rankin"))
    asked = F.struct(F.lit(1).alias("schema_version"), F.concat(F.lit("s-"), F.col("request_no").cast("string")).alias("request_id"), model.alias("representation"), F.struct(F.array(F.lit("finite-spherical-rankin"), engine).alias("engines")).alias("bounds"))
    single = F.regexp_replace(F.to_json(asked), r'\["finite-spherical-rankin","finite-spherical-rankin"\]', '["finite-spherical-rankin"]')
    return rows.select("request_no", single.alias("request"))


SPHERES = (
    "r AS (SELECT p_partkey AS request_no, 2 + p_partkey % 19 AS n, p_partkey % 21 AS k, 1 + p_partkey % 60 AS states, p_partkey % 7 AS bad FROM part),"
    " b AS (SELECT *, CASE WHEN k = 0 THEN 2 * n ELSE 1 + 100 // k END AS bound FROM r),"
    " o AS (SELECT *, CASE WHEN bad BETWEEN 1 AND 5 THEN 'REFUSED' WHEN states > bound THEN 'INFEASIBLE_UNDER_MODEL' ELSE 'UNKNOWN' END AS outcome FROM b)"
)


@query(f"WITH {SPHERES} SELECT request_no, outcome, (CASE outcome WHEN 'REFUSED' THEN 3 WHEN 'UNKNOWN' THEN 2 ELSE 1 END)::INT AS exit_code, CASE WHEN outcome <> 'REFUSED' THEN bound::VARCHAR END AS upper_bound FROM o")
def spherical_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of spherical requests, the refused ones among them."""
    return bounds.evaluate_requests(sphere_requests(spark, sf_dir)).select("request_no", "outcome", "exit_code", "upper_bound")


@query(
    f"WITH {SPHERES}, c AS (SELECT request_no, request_no % 5 AS t FROM o WHERE outcome = 'INFEASIBLE_UNDER_MODEL')"
    " SELECT request_no, CASE t WHEN 0 THEN 'VALID' WHEN 4 THEN 'UNSUPPORTED' ELSE 'INVALID' END AS verdict FROM c"
)
def tampered_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Certificates as they are, with another bound, another digest, another number of states, and of an unknown theorem."""
    found = bounds.evaluate_requests(sphere_requests(spark, sf_dir)).where("certificate is not null")
    text, t = F.col("certificate"), F.col("request_no") % 5
    other = (
        F.when(t == 1, F.regexp_replace(text, r'"claimed_upper_bound":"\d+"', '"claimed_upper_bound":"1"'))
        .when(t == 2, F.regexp_replace(text, r'"request_digest":"....', '"request_digest":"zzzz'))
        .when(t == 3, F.regexp_replace(text, r'"required_states":"\d+","witness"', '"required_states":"999999","witness"'))
        .when(t == 4, F.regexp_replace(text, r'"theorem":"[^"]*"', '"theorem":"no-such-theorem"'))
        .otherwise(text)
    )
    return bounds.check_certificates(found.select("request_no", other.alias("certificate"))).select("request_no", "verdict")


@query(f"WITH {SPHERES} SELECT request_no, 'VALID' AS verdict, CASE WHEN request_no % 11 = 0 THEN 'MISSING' WHEN request_no % 13 = 0 THEN 'DISAGREE' ELSE 'AGREE' END AS outcome FROM o WHERE outcome = 'INFEASIBLE_UNDER_MODEL'")
def reproduced_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus of certificates against a second one from shuffled requests, of which some are gone and some are changed."""
    requests = sphere_requests(spark, sf_dir)
    again = bounds.corpus(requests.where("request_no % 11 <> 0").repartition(3))
    again = again.withColumn("sha256", F.when(F.col("request_no") % 13 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return bounds.reproduced(bounds.corpus(requests), again)


EXPORTS = (
    "x AS (SELECT 'cache_' || kind || '_l' || label AS name, kind, 'f16le' AS dtype, 64 AS embedding, count(*) AS cells, count(*) * 128 + CASE WHEN label = 3 THEN 2 ELSE 0 END AS bytes"
    " FROM embeddings, (VALUES ('k'), ('v')) k(kind) GROUP BY label, kind)"
)


def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as layers of an export, keys and values; the files of label 3 are of a broken length."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("active_cells"))
    rows = rows.withColumn("kind", F.explode(F.array(F.lit("k"), F.lit("v"))))
    name = F.concat(F.lit("cache_"), "kind", F.lit("_l"), F.col("label").cast("string"))
    size = F.col("active_cells") * 128 + F.when(F.col("label") == 3, 2).otherwise(0)
    return rows.select(name.alias("name"), "kind", F.lit("f16le").alias("dtype"), F.lit(64).alias("embedding"), "active_cells", size.alias("bytes"))


@query(
    f"WITH {EXPORTS} SELECT name AS id, regexp_extract(name, '_l([0-9]+)$', 1)::INT AS layer, CASE kind WHEN 'k' THEN 'key' ELSE 'value' END AS kind,"
    " coalesce(sum(bytes) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_bytes, bytes AS byte_length, cells AS token_count, 4 AS heads, 16::BIGINT AS dimension,"
    " bytes = cells * 128 AS valid FROM x"
)
def capture_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.layout(exported(spark, sf_dir), 4)


@query(
    f"WITH {EXPORTS}, b AS (SELECT CASE kind WHEN 'k' THEN 'keys' ELSE 'values' END AS bundle, name, bytes FROM x UNION ALL SELECT 'all', name, bytes FROM x)"
    " SELECT bundle, name, coalesce(sum(bytes) OVER (PARTITION BY bundle ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset_bytes, bytes AS byte_length FROM b"
)
def bundle_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures.bundles(exported(spark, sf_dir))


@query(
    "WITH t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS token, embedding FROM embeddings),"
    " w AS (SELECT label, token, i, (embedding[i + 1]::BIT::BIGINT & 4294967295) AS word FROM t, range(64) r(i))"
    " SELECT label, count(*) // 64 AS tokens, sum((token + 1) * (i + 1) * (word % 65536))::BIGINT AS weighed FROM w GROUP BY label"
)
def transposed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that lie dimension by dimension, turned round, weighed by token and dimension."""
    rows = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("rows"))

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.array([x["embedding"] for x in rows.as_py()], np.float32) for rows in batch.column(1)]
            columns = [pa.array([len(x) for x in own], pa.int64()), pa.array([x.shape[1] for x in own], pa.int64()), pa.array([x.T.astype("<f4").tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["tensor_id", "tokens", "dimension", "payload"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tokens, dimension, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = np.frombuffer(raw, "<u4").reshape(tokens, dimension).astype(np.int64) % 65536
                out.append(int((words * np.outer(np.arange(1, tokens + 1), np.arange(1, dimension + 1))).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int64())], names=["label", "tokens", "weighed"])

    laid = rows.mapInArrow(lay, "tensor_id int, tokens long, dimension long, payload binary")
    return captures.token_major(laid, width=4).mapInArrow(weigh, "label int, tokens long, weighed long")


@query("SELECT c_custkey, CASE WHEN c_acctbal = 0 THEN '0' ELSE rtrim(rtrim(printf('%.4f', -abs(c_acctbal) / 10000), '0'), '.') END AS canonical FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal FROM customer) WHERE abs(c_acctbal) < 10000")
def canonical_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals with zeros on both ends in their one canonical form."""
    def shortest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [capacity.canonical_real(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["c_custkey", "canonical"])

    whole = F.abs(F.col("c_acctbal")).cast("long")
    text = F.concat(F.lit("-000."), F.lpad(whole.cast("string"), 4, "0"), F.lit("00"))
    return table(spark, sf_dir, "customer").where(whole < 10000).select("c_custkey", text.alias("text")).mapInArrow(shortest, "c_custkey long, canonical string")


@query("SELECT event_type, count(*) AS events, round(sum(value), 4) AS total, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY event_type")
def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files, kept once each and summed by type; the sums are what the stream's state holds at its end."""
    import tempfile
    import uuid

    name = f"streamed_{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    sums = rows.groupBy("event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))
    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tesseral-stream-")
    writer = sums.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared}/{name}")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)
