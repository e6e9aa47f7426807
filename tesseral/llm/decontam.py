"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

A spaced seed hashes the tokens at the marked places of a fixed mask and ignores
those in between, so a substituted token only loses the seeds that look at it.
Hits of a benchmark's seeds in a document fall on diagonals (place in the
document less place in the item); each diagonal that is hit is compared token by
token, window by window, so the seeds decide where to look and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, small

#: Fixed masks: 1 looks at a token, 0 ignores it. In every way that 80 % of 13 or more tokens, or of an item of 9 to 12,
#: can agree, one of them hits (a longer window that agrees so holds one of at most 25 tokens that does).
MASKS = ("110001001", "001100101", "101011000")
SPAN = len(MASKS[0])
#: An overlap is at least so many tokens long, or as long as its item, and so much of it, in percent, agrees.
LEAST, AGREE = 13, 80
#: Seeds that are broadcast, at most: some 24 bytes each. More of them are met by a shuffle, behind a bitmap.
SEEDS_AT_ONCE = 200_000
#: 64-bit words of that bitmap: 8 MB, whatever the size of the benchmark.
BITMAP_WORDS = 1 << 20


def tokens(text: Column) -> Column:
    """The runs of letters and digits of a text, in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _with_seeds(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row (seed, place) for each mask and place of `words`, and for each run of one of `lengths` tokens, beside the other columns.

    Places are exploded first, so that the hashes of seeds are in generated code.
    """
    keep = [c for c in rows.columns if c != "words"]
    hashed = rows.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    looks = [[k for k, bit in enumerate(mask) if bit == "1"] for mask in MASKS]

    def seeded(span: int, parts: list[tuple[int, list[int]]]) -> DataFrame:
        placed = hashed.where(F.size("hashes") >= span)
        placed = placed.select(*keep, "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - span)).alias("place"))
        seeds = [F.xxhash64(F.lit(number), *[F.get("hashes", F.col("place") + k) for k in looked]) for number, looked in parts]
        return placed.select(*keep, "place", F.explode(F.array(*seeds)).alias("seed"))

    out = seeded(SPAN, list(enumerate(looks)))
    for n in lengths:
        out = out.union(seeded(n, [(len(MASKS) + n, list(range(n)))]))
    return out


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_id, item_place): the masks' seeds of items, and of those shorter than SPAN one for all their tokens."""
    long_ = _with_seeds(items.select("item_id", "words"), [])
    out = long_.select("seed", "item_id", F.col("place").alias("item_place"))
    for n in range(1, SPAN):
        own = items.where(F.size("words") == n)
        seed = F.xxhash64(F.lit(len(MASKS) + n), *[F.xxhash64(F.get("words", F.lit(k))) for k in range(n)])
        out = out.union(own.select(seed.alias("seed"), "item_id", F.lit(0).alias("item_place")))
    return out


def _in_bitmap(seeds: DataFrame, scratch: Scratch, seed: Column) -> Column:
    """Whether a bitmap of the seeds, of a fixed size, has a seed's bit: true for all of them and few others."""
    bits = BITMAP_WORDS * 64

    def word(x: Column) -> Column:
        return F.shiftrightunsigned(F.pmod(x, F.lit(bits)), 6).cast("int")

    def bit(x: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int"))

    own = seeds.select(word(F.col("seed")).alias("id"), bit(F.col("seed")).alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = seeds.sparkSession.range(BITMAP_WORDS).select(F.col("id").cast("int").alias("id"))
    every = every.join(own, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("x"))
    whole = every.agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["bits"]).alias("words"))
    bitmap = scratch.write(whole, "bitmap").scalar()  # one row of BITMAP_WORDS numbers
    return F.get(bitmap, word(seed)).bitwiseAND(bit(seed)) != 0


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least: int, agree: int) -> DataFrame:
    """The rows of `overlaps` with the document row's key beside its id."""
    scratch = Scratch(docs.sparkSession, "seeds")
    listed = benchmark.select(F.col(item_col).cast("long").alias("member"), tokens(F.col(item_text_col)).alias("words"))
    # equal items are one, by a hash of their tokens
    listed = scratch.write(listed.where("size(words) > 0").withColumn("item_id", F.xxhash64("words")), "items")
    items = listed.groupBy("item_id").agg(F.first("words").alias("words"))
    seeds = scratch.write(_item_seeds(items), "seeds")
    short = items.where(F.size("words") < SPAN).select(F.size("words").alias("n")).distinct()
    lengths = sorted(r.n for r in short.collect())  # numbers below SPAN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row", row_key(F.col("text")))
    placed = _with_seeds(rows.select("doc_id", "row", tokens(F.col("text")).alias("words")), lengths)
    if seeds.count() <= SEEDS_AT_ONCE:
        met = placed.join(F.broadcast(seeds), "seed")
    else:
        met = placed.where(_in_bitmap(seeds, scratch, F.col("seed"))).join(seeds.hint("merge"), "seed")
    hits = met.select("doc_id", "row", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct()
    hits = scratch.write(hits, "hits")
    # documents without a hit are left out before their texts are split again
    touched = small(scratch.write(hits.select("doc_id", "row").distinct(), "touched"))
    same_row = touched["doc_id"].eqNullSafe(rows["doc_id"]) & (touched["row"] == rows["row"])
    own = rows.join(touched, same_row, "left_semi").groupBy("doc_id", "row").agg(F.first("text").alias("text"))
    own = scratch.write(own.select(F.col("doc_id").alias("own_id"), F.col("row").alias("own_row"), tokens(F.col("text")).alias("ours")), "texts")
    # a document's words are cut for all of its hits at once, so no hit carries a whole document
    sized = hits.join(items.select("item_id", F.size("words").alias("many")), "item_id")
    listed_hits = sized.groupBy("doc_id", "row").agg(F.collect_list(F.struct("item_id", "diagonal", "many")).alias("hits"))
    both = listed_hits.join(own, listed_hits["doc_id"].eqNullSafe(own["own_id"]) & (listed_hits["row"] == own["own_row"]))

    def cut(hit: Column) -> Column:
        low = F.greatest(F.lit(0), -hit["diagonal"])
        n = F.least(hit["many"], F.size("ours") - hit["diagonal"]) - low
        need = F.least(F.lit(least), hit["many"])
        mine = F.when(n >= need, F.slice("ours", hit["diagonal"] + low + 1, F.greatest(n, F.lit(0))))
        return F.struct(hit["item_id"].alias("item_id"), hit["diagonal"].alias("diagonal"), low.alias("low"), n.alias("n"), need.alias("need"), mine.alias("mine"))

    both = both.select("doc_id", "row", F.explode(F.transform("hits", cut)).alias("x")).select("doc_id", "row", "x.*").where("mine is not null")
    both = both.join(items.withColumnRenamed("words", "theirs"), "item_id")
    other = F.slice("theirs", F.col("low") + 1, F.col("n"))
    same = F.zip_with("mine", other, lambda a, b: (a == b).cast("int"))
    percent = F.when(F.size("theirs") < SPAN, 100).otherwise(agree)
    both = both.select("doc_id", "row", "item_id", "diagonal", "low", "n", "need", percent.alias("percent"), same.alias("same"))
    enough = F.aggregate("same", F.lit(0), lambda s, x: s + x) * 100 >= F.col("need") * F.col("percent")
    sums = F.aggregate("same", F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    both = both.where(enough).withColumn("sums", sums)

    def agreeing(start: Column, length: Column) -> Column:
        return F.col("sums")[start + length] - F.col("sums")[start]

    def longest(start: Column) -> Column:
        lengths = F.sequence("need", F.least(F.col("need") * 2 - 1, F.col("n") - start))
        return F.array_max(F.filter(lengths, lambda k: agreeing(start, k) * 100 >= k * F.col("percent")))

    starts = F.sequence(F.lit(0), F.col("n") - F.col("need"))
    windows = F.transform(starts, lambda i: F.struct(i.alias("start"), (i + longest(i)).alias("end")))
    both = both.withColumn("windows", F.filter(windows, lambda w: w["end"].isNotNull())).where("size(windows) > 0")
    both = both.withColumn("start", F.col("windows")[0]["start"])
    both = both.withColumn("length", F.array_max(F.transform("windows", lambda w: w["end"])) - F.col("start"))
    found = both.select("doc_id", "row", F.col("item_id").alias("first"), (F.col("diagonal") + F.col("low") + F.col("start")).alias("start"), "length", agreeing(F.col("start"), F.col("length")).alias("agreeing"))
    # an item's copies under other ids overlap as it does
    found = found.join(listed.select(F.col("item_id").alias("first"), F.col("member").alias("item_id")), "first").drop("first")
    return scratch.write(found, "found")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, agree: int = AGREE) -> DataFrame:
    """(doc_id, item_id, start, length, agreeing): where documents overlap with benchmark items, in tokens.

    A window of one diagonal counts from `least` tokens, or the item's length
    where that is less, if `agree` percent of its tokens are the same, whatever
    the tokens around it; the row of a diagonal goes from its first window's start
    to its last one's end (windows of up to twice the least length are tried:
    each longer one holds one of these). Items of fewer than SPAN tokens count
    where all their tokens agree, in one place. Null and empty texts have no
    token, and items without any are never found; an item without an id is found
    under the null id. Rows of one id with different
    texts are compared each by itself; rows without an id are found under the null
    id; other columns are ignored. Either table may be empty. Seeds of distinct
    items are broadcast up to SEEDS_AT_ONCE; more are met by a shuffle, after a
    bitmap of fixed size has left out nearly all other places of docs. Documents
    are read once for either.
    """
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, least, agree)
    return found.select("doc_id", "item_id", "start", "length", "agreeing")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, agree: int = AGREE) -> DataFrame:
    """(doc_id, contaminated, n_items, items) for each row of docs; items lists the item ids, ascending."""
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, least, agree).groupBy("doc_id", "row")
    found = found.agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    found = found.select(F.col("doc_id").alias("id"), F.col("row").alias("own"), F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("items"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(F.col(text_col).cast("string")).alias("row"))
    out = rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["row"] == found["own"]), "left")
    return out.select("doc_id", F.col("own").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, agree: int = AGREE) -> DataFrame:
    """The documents without an overlap, with their own columns."""
    found = _overlaps(docs, benchmark, id_col, text_col, item_col, item_text_col, least, agree)
    found = found.select(F.col("doc_id").alias("_own_id"), F.col("row").alias("_own_row")).distinct()
    found = small(found)
    same = docs[id_col].cast("long").eqNullSafe(found["_own_id"]) & (row_key(docs[text_col].cast("string")) == found["_own_row"])
    return docs.join(found, same, "left_anti")


#: Candidates by three tokens in a row, which every window that counts has, in place of spaced seeds.
ORACLE_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
ours AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, w FROM docs WHERE len(w) >= 3),
theirs AS (SELECT item_id, unnest(range(1, len(w) - 1)) AS p, w FROM items WHERE len(w) >= 9),
hits AS (
  SELECT DISTINCT o.doc_id, t.item_id, o.p - t.p AS diagonal
  FROM (SELECT doc_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM ours) o
  JOIN (SELECT item_id, p, w[p] AS a, w[p + 1] AS b, w[p + 2] AS c FROM theirs) t ON o.a = t.a AND o.b = t.b AND o.c = t.c
), aligned AS (
  SELECT h.doc_id, h.item_id, least(13, len(i.w)) AS need,
         list_transform(range(greatest(1, 1 - diagonal), least(len(i.w), len(d.w) - diagonal) + 1), lambda k: (d.w[k + diagonal] = i.w[k])::INT) AS same
  FROM hits h JOIN docs d ON d.doc_id = h.doc_id JOIN items i ON i.item_id = h.item_id
), starts AS (
  SELECT doc_id, item_id, need, same, unnest(range(1, len(same) - need + 2)) AS s FROM aligned WHERE len(same) >= need AND list_sum(same) * 100 >= need * 80
), windows AS (
  SELECT doc_id, item_id, same[s : s + n - 1] AS part FROM (SELECT *, unnest(range(need, least(2 * need, len(same) - s + 2))) AS n FROM starts)
), found AS (
  SELECT DISTINCT doc_id, item_id FROM windows WHERE list_sum(part) * 100 >= len(part) * 80
  UNION
  SELECT d.doc_id, i.item_id FROM docs d JOIN items i ON len(i.w) BETWEEN 1 AND 8 AND contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(i.w, ' ') || ' ')
), listed AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS items FROM found GROUP BY doc_id)
SELECT d.doc_id, l.doc_id IS NOT NULL AS contaminated, coalesce(l.n, 0)::BIGINT AS n_items, coalesce(l.items, '') AS items
FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id
"""
