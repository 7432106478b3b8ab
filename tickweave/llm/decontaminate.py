"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A seed is a fixed mask over neighbouring words: the words at its positions are
hashed, those between are ignored. Hashes of all benchmark positions are joined
with those of all document positions, and around each hit document and item are
compared word by word along the hit's alignment. An item of W = WINDOW words or
more leaks if some WINDOW neighbouring words of it agree with the document but
for MISSES substitutions; shorter items are compared whole, with fewer. The masks
are chosen so that every such overlap has a hit: no overlap is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import table

#: Masks of weight six; each window with the allowed substitutions contains one of them unharmed.
MASKS = ((0, 1, 2, 3, 4, 6), (0, 1, 3, 4, 5, 6), (0, 2, 3, 5, 6, 7))
#: For items of SHORTEST to six words, which only count as a whole.
SHORT = (0, 1, 2, 3, 4)
SHORTEST = 5
WINDOW, MISSES = 16, 3
#: Words of all benchmark items up to which their seeds are broadcast (24 bytes each).
BROADCAST_WORDS = 400_000
#: Bits of the filter that documents pass in a larger benchmark: eight a seed, up to this many (48 MB as a broadcast table).
FILTER_BITS = 1 << 27
#: What separates words, as Java's and DuckDB's regular expressions write it.
SEPARATOR = r"[^\p{L}\p{N}]+"


def allowed(words: int) -> int:
    """Substitutions that a window of an item of so many words may have."""
    return MISSES if words >= WINDOW else 2 if words == 15 else 1 if words >= 8 else 0


def words_of(text: Column) -> Column:
    """Lower-case words of a text, between anything but letters and digits; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATOR), lambda w: w != "")


def _seed(words: Column, at: Column, number: int, mask: tuple[int, ...]) -> Column:
    """Hash of a mask at a position; null where it reaches beyond the text."""
    return F.when(at + mask[-1] < F.size(words), F.xxhash64(F.lit(number), *[F.get(words, at + o) for o in mask]))


def _allowed(words: Column) -> Column:
    return F.when(words >= WINDOW, MISSES).when(words == 15, 2).when(words >= 8, 1).otherwise(0)


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, item_id, matched (most equal words in a window), window: pairs of document and leaked item.

    Items of fewer than SHORTEST words, or without text, can't leak. Null and empty texts
    contain nothing; rows with the same id share their result, null ids too. Other
    columns, whatever their names, aren't read. Documents are read once, or, with a
    benchmark of more than BROADCAST_WORDS words, once for the seeds and once, where they
    had hits, for the verification; whole texts are never shuffled.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item"))
    items = items.withColumn("n", F.size("item")).where(F.col("n") >= SHORTEST)
    measured = items.agg(F.sum("n").alias("words"), F.min("n").alias("least")).first()
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if not measured["words"]:
        return text.select("doc_id").join(items.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0).alias("matched"), F.lit(0).alias("window"))
    masks = (*MASKS, SHORT) if measured["least"] < 7 else MASKS
    spots = items.select("item_id", "item", "n", F.posexplode("item").alias("spot", "word"))
    each = [F.when(F.col("n") < 7 if m == SHORT else F.lit(True), _seed(F.col("item"), F.col("spot"), i, m)) for i, m in enumerate(masks)]
    seeds = spots.select("item_id", "spot", F.posexplode(F.array(*each)).alias("mask", "seed")).where("seed is not null")
    if measured["words"] <= BROADCAST_WORDS:
        places = _places(text.select("doc_id", words_of(F.col("text")).alias("words")), ["doc_id", "words"], masks)
        hits = places.join(F.broadcast(seeds), "seed").join(F.broadcast(items), "item_id")
        # Of a run of hits along one alignment only the first goes on.
        offsets = F.element_at(F.array(*[F.array(*[F.lit(o) for o in m]) for m in masks]), F.col("mask") + 1)
        before = F.forall(offsets, lambda o: F.get("words", F.col("at") - 1 + o) == F.get("item", F.col("spot") - 1 + o))
        hits = hits.where((F.col("at") == 0) | (F.col("spot") == 0) | ~before).withColumn("shift", F.col("at") - F.col("spot"))
    else:
        hits = _filtered_hits(text, items, seeds, masks, measured["words"] * len(masks))
    return _verified(hits).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def _places(rows: DataFrame, kept: list[str], masks) -> DataFrame:
    """The columns ``kept``, and at and seed of every position of ``words`` and mask."""
    rows = rows.select(*dict.fromkeys([*kept, "words"]), F.posexplode("words").alias("at", "word"))
    return rows.select(*kept, "at", F.explode(F.array(*[_seed(F.col("words"), F.col("at"), i, m) for i, m in enumerate(masks)])).alias("seed")).where("seed is not null")


def _filtered_hits(text: DataFrame, items: DataFrame, seeds: DataFrame, masks, count: int) -> DataFrame:
    """doc_id, words, item_id, item, n, shift for a benchmark of any size.

    A table of 64-bit words of a bit filter, of bounded size, is broadcast. Seeds of
    documents that pass it are shuffled, without texts, to those of the benchmark;
    alignments with hits are joined back to the documents by id and hash of the text,
    and rows that share both are the same document.
    """
    bits = min(FILTER_BITS, max(1 << 10, 1 << (8 * count - 1).bit_length()))
    slot = F.pmod(F.col("seed"), F.lit(bits))
    bit = F.expr("shiftleft(1L, cast(pmod(seed, 64) as int))")
    table_ = seeds.select(F.shiftright(slot, 6).alias("cell"), bit.alias("bit"))
    table_ = table_.groupBy("cell").agg(F.bit_or("bit").alias("bits"))
    keyed = text.select("doc_id", F.xxhash64("text").alias("body"), words_of(F.col("text")).alias("words"))
    places = _places(keyed, ["doc_id", "body"], masks)
    places = places.withColumn("cell", F.shiftright(slot, 6)).join(F.broadcast(table_), "cell")
    places = places.where(F.col("bits").bitwiseAND(bit) != 0).select("doc_id", "body", "at", "seed")
    found = places.join(seeds, "seed").select(F.col("doc_id").alias("d"), F.col("body").alias("b"), "item_id", (F.col("at") - F.col("spot")).alias("shift")).distinct()
    back = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("body") == F.col("b")))
    return back.select("doc_id", "words", "item_id", "shift").join(items, "item_id")


def _verified(hits: DataFrame) -> DataFrame:
    """Alignments (shift) of document and item that agree in a window, word by word."""
    same = F.transform("item", lambda w, j: F.coalesce((F.get("words", F.col("shift") + j) == w).cast("int"), F.lit(0)))
    window = F.least("n", F.lit(WINDOW))
    sums = F.transform(F.sequence(F.lit(1), F.col("n") - window + 1), lambda s: F.aggregate(F.slice("same", s, window), F.lit(0), lambda a, x: a + x))
    best = hits.select("doc_id", "item_id", "n", window.alias("window"), same.alias("same")).select("doc_id", "item_id", "n", "window", F.array_max(sums).alias("matched"))
    return best.where(F.col("matched") >= F.col("window") - _allowed(F.col("n"))).select("doc_id", "item_id", "matched", "window")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` as a struct ``row``, and contaminated, n_items, item_id, matched, window.

    item_id is the leaked item with the most equal words in a window, of equal
    ones the smallest. Null and empty texts are clean; a null id's row can't be
    told from others and is clean; rows with the same id share their result.
    Whole texts are read. An empty benchmark leaves every document clean.
    """
    found = overlaps(docs, benchmark, id_col, text_col).where("doc_id is not null")
    found = found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.max(F.struct("matched", -F.col("item_id"))).alias("best"), F.max("window").alias("window"),
    )
    found = found.select(F.col("doc_id").alias("__id"), "n_items", (-F.col("best.col2")).alias("item_id"), F.col("best.matched").alias("matched"), "window")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("__key"))
    joined = rows.join(found, F.col("__key") == F.col("__id"), "left")
    return joined.select("row", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "item_id", "matched", "window")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """Whether each document contains a benchmark item, and which."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    found = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.max(F.struct("matched", -F.col("item_id"))).alias("best"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    return rows.select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        (-F.col("best.col2")).alias("item_id"), F.col("best.matched").cast("long").alias("matched"),
    )


#: The same by comparing all aligned words, without seeds.
OP10_SQL = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), items AS (
  SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM item_words WHERE len(w) >= 5
), docs AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM doc_words
), same AS (
  SELECT doc_id, item_id, n, p - i AS d, i FROM docs JOIN items USING (word)
), many AS (
  SELECT * FROM same QUALIFY count(*) OVER (PARTITION BY doc_id, item_id, d) >= 5
), windows AS (
  SELECT doc_id, item_id, n, least(n, 16) AS size,
         count(*) OVER (PARTITION BY doc_id, item_id, d ORDER BY i RANGE BETWEEN CURRENT ROW AND 15 FOLLOWING) AS matched FROM many
), leaked AS (
  SELECT doc_id, item_id, max(matched) AS matched FROM windows
  WHERE matched >= size - CASE WHEN n >= 16 THEN 3 WHEN n = 15 THEN 2 WHEN n >= 8 THEN 1 ELSE 0 END
  GROUP BY doc_id, item_id
), best AS (
  SELECT doc_id, count(*) AS n_items, max(matched) AS matched, arg_min(item_id, item_id - 1000000000 * matched) AS item_id FROM leaked GROUP BY doc_id
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, matched FROM documents LEFT JOIN best USING (doc_id)
"""
