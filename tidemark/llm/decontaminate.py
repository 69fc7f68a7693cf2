"""6. Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

DataFrame functions only. Texts are lower-cased words; shingles have ``size`` words (an item with fewer is one shingle).

1. Seeds. A window whose weighted shingle similarity with an item is at least ``percent`` holds, of any
   ``n - ceil(n t) + 1`` of the item's n shingles, at least one unchanged, however long the window. The seeds are found by their longest word:
   a join of all document words with the seeds' words, then a comparison of the whole shingle.
2. Windows of the item's length in words are laid at each seed hit, aligned with the item and shifted by up to the
   number of shingles that may differ; near a text's ends they move inside, and shorter texts are one window.
3. SimHash: 64 bits, each the sign of the sum of the window's shingle hashes' bits, weighted by occurrence.
   Fingerprints are cut into ``radius + 1`` blocks; windows and items of one length that agree in a block meet, which
   guarantees all pairs within ``radius`` bits. A window's pairs with the items whose seeds it was laid for stay at any
   distance, so that no pair is lost by chance.
4. The exact similarity, sum of minima by sum of maxima of shingle counts, decides.

Cases: null and empty texts and items match nothing; an empty benchmark gives an empty result; whole texts are searched;
repeated rows give one result for each (doc_id, item_id), the best of rows that repeat a doc_id with other texts;
``decontaminated`` judges each row by its own text, with or without a doc_id; other columns are ignored or kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BROADCAST_ROWS, SPACES, small, written

BITS = 64


def words(text: str) -> Column:
    """Lower-case words of a text column."""
    return F.filter(F.split(F.lower(text), SPACES), lambda w: w != "")


def shingled(array: str, size: Column | int) -> Column:
    """The shingles of a words column as strings; an array shorter than ``size`` is one shingle."""
    k = F.least(F.lit(size), F.size(array))
    return F.when(F.size(array) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(array) - k + 1), lambda i: F.array_join(F.slice(array, i, k), " ")))


def simhash(shingles: str) -> Column:
    """64-bit fingerprint of an array of shingles; repeated shingles weigh as often as they stand."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))

    def bit(b: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda acc, h: acc + F.when(F.getbit(h, b) == 1, 1).otherwise(-1))
        return F.when(votes > 0, 1).otherwise(0).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def blocks(fingerprint: str, radius: int) -> Column:
    """(block number, bits of the block) for ``radius + 1`` blocks that cover all bits."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("no"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def numbered(array: str) -> Column:
    """The shingles of an array made distinct: those after the first of a kind get their number (no word holds a line feed)."""
    seen = lambda s, i: F.size(F.filter(F.slice(array, F.lit(1), i), lambda v: v == s))
    told = F.transform(array, lambda s, i: F.when(i > 0, F.concat(s, F.when(seen(s, i) > 0, F.concat(F.lit("\n"), seen(s, i).cast("string"))).otherwise(""))).otherwise(s))
    return F.when(F.size(F.array_distinct(array)) == F.size(array), F.col(array)).otherwise(told)


def similarity(x: str, y: str) -> Column:
    """Sum of minima by sum of maxima of the counts of shingles in two arrays of numbered shingles."""
    common = F.size(F.array_intersect(x, y))
    return common / (F.size(x) + F.size(y) - common)


def benchmark_items(items: DataFrame, size: int) -> DataFrame:
    """``item_id, w, n_words, item_shingles`` of the items that have words."""
    out = items.select(F.col("item_id").cast("bigint").alias("item_id"), words("text").alias("w")).where("size(w) > 0")
    return out.select("item_id", "w", F.size("w").alias("n_words"), shingled("w", size).alias("item_shingles"))


def seeds(items: DataFrame, size: int, percent: int) -> DataFrame:
    """``word, seed, at, k, offset, item_id, n_words, slack``: which words to look for, and where the seed begins."""
    n = F.size("item_shingles")
    need = F.ceil(F.lit(2 * percent) * n / F.lit(100 + percent))
    spread = items.select("item_id", "n_words", F.least(F.lit(size), "n_words").alias("k"), (n - need).cast("int").alias("slack"), (n - F.ceil(F.lit(percent) * n / F.lit(100))).cast("int").alias("spare"), F.posexplode("item_shingles").alias("offset", "seed"))
    rare = F.aggregate(F.split("seed", " "), F.lit(""), lambda acc, w: F.when(F.length(w) > F.length(acc), w).otherwise(acc))
    # the middle shingles of an item are as good as any; at its ends neighbouring words differ more often
    first = ((F.col("n_words") - F.col("k") + 1 - F.col("spare") - 1) / 2).cast("int")
    chosen = spread.where((F.col("offset") >= first) & (F.col("offset") <= first + F.col("spare"))).withColumn("word", rare)
    return chosen.withColumn("at", (F.array_position(F.split("seed", " "), F.col("word")) - 1).cast("int"))


def seed_hits(source: DataFrame, seed: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The places of ``source`` (``doc_id, text_hash, w``) where a seed stands, with the seed's columns and ``begin``.

    Words meet the seeds that are to be found by them in broadcast joins, so that no text is shuffled; beyond ``rows``
    seeds there are several, each of a part of the seeds.
    """
    parts = -(-seed.count() // rows) or 1
    word = source.select("doc_id", "text_hash", "w", F.posexplode("w").alias("p", "word"))
    begin = F.col("p") - F.col("at")
    out = None
    for i in range(parts):
        mine = seed if parts == 1 else seed.where(F.pmod(F.xxhash64("seed"), F.lit(parts)) == i)
        met = word.join(F.broadcast(mine), "word").where((begin >= 0) & (begin + F.col("k") <= F.size("w"))).where(F.array_join(F.slice("w", begin + 1, F.col("k")), " ") == F.col("seed"))
        out = met if out is None else out.unionByName(met)
    return out.withColumn("begin", begin)


def matches(docs: DataFrame, items: DataFrame, size: int = 5, percent: int = 80, radius: int = 18) -> DataFrame:
    """``doc_id, text_hash, item_id, start_word, n_words, hamming, similarity`` of all windows that match an item."""
    bench = written(benchmark_items(items, size), "items")
    seed = written(seeds(bench, size, percent), "seeds")
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), words("text").alias("w"))
    hit = seed_hits(source, seed)

    length = F.least("n_words", F.size("w"))
    start = F.explode(F.sequence(-F.col("slack"), F.col("slack"))).alias("shift")
    laid = hit.select("doc_id", "text_hash", "w", "n_words", "item_id", (F.col("begin") - F.col("offset")).alias("begin"), start)
    inside = F.greatest(F.lit(0), F.least(F.col("begin") + F.col("shift"), F.size("w") - length))
    windows = laid.select("doc_id", "text_hash", "n_words", "item_id", inside.alias("start_word"), F.slice("w", inside + 1, length).alias("x"))
    windows = windows.groupBy("doc_id", "text_hash", "n_words", "start_word").agg(F.first("x").alias("x"), F.collect_set("item_id").alias("seeded"))
    windows = windows.withColumn("shingles", shingled("x", F.least(F.lit(size), F.col("n_words")))).drop("x")
    windows = written(windows.withColumns({"print": simhash("shingles"), "shingles": numbered("shingles"), "window": F.monotonically_increasing_id()}), "windows")

    marked = written(bench.select("item_id", "n_words", numbered("item_shingles").alias("item_shingles"), simhash("item_shingles").alias("item_print")), "prints")
    left = windows.select("window", "n_words", "print", F.explode(blocks("print", radius)).alias("b")).select("window", "n_words", "print", "b.no", "b.bits")
    right = marked.select("item_id", "n_words", "item_print", F.explode(blocks("item_print", radius)).alias("b")).select("item_id", "n_words", "item_print", "b.no", "b.bits")
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    near = left.join(right, ["n_words", "no", "bits"]).where(hamming <= radius).select("window", "item_id")
    near = near.union(windows.select("window", F.explode("seeded"))).distinct()
    full = near.join(windows.drop("seeded", "n_words"), "window").join(small(marked), "item_id").withColumn("hamming", hamming)
    exact = full.withColumn("similarity", similarity("shingles", "item_shingles")).where(F.col("similarity") * 100 >= percent)
    return exact.select("doc_id", "text_hash", "item_id", "start_word", "n_words", "hamming", "similarity")


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, hamming, similarity``: for each document and item its best window."""
    best = F.max_by(F.struct("start_word", "n_words", "hamming", "similarity"), F.struct(F.col("similarity"), -F.col("start_word"))).alias("best")
    return matches(docs, items, **options).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    gone = matches(docs, items, **options).select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(small(written(gone, "gone")), F.col("doc_id").cast("bigint").eqNullSafe(F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
