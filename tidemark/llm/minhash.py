"""4. MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

1. A document is the set of its word shingles. Documents with equal sets form a class; its smallest doc_id stands
   for it from here on, so groups of exact copies cost nothing more.
2. One permutation: the hash space is cut into bins and each bin keeps its smallest hash; an empty bin takes the
   value of a bin chosen by a hash of (bin, attempt). ``bands`` bands of ``rows`` bins make the buckets.
3. Star: in each bucket every member is paired with one center only, the member that shares most buckets, so pairs
   grow as members do. Full sets are compared: a pair's common shingles, and what the member has beside the center's.
   Confirmed pairs are links; components come from min-label spreading.
4. Pairs the stars can't show are few and found exactly. Let x and y be mates of a center c in different components.
   Shingles they share are shared with c too, at most min(|x & c|, |y & c|), or lie outside c. So a link needs enough
   outside shingles in common, or sets so small that the first term reaches the threshold alone, which a join on
   (center, set size) lists. Shingles that meet one component only don't count, and members that can't reach the
   threshold with those left are put aside first. Of the others' outside shingles, ordered from the rarest beside
   their center, only so many are joined that two sets with enough in common must share one of them (prefix filter).
   What passes is confirmed on full sets. So no link between bucket mates of different components is lost, whatever
   the size of a bucket.

Full sets meet a center at a time, in salted blocks of ``BLOCK`` mates: a center's text is sent once for each block.

Cases: null and empty texts have no shingles and link with nothing; a text with fewer words than a shingle is one
shingle; rows that repeat a doc_id each get the result of their own text, and all are kept if one stands for its group;
a null doc_id has a null component and is kept by ``deduplicated``; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import mix, removed, shingles, slices, small, words_of, written

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Mates that meet a center's text in one block, about.
BLOCK = 256


def densified(values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signature of a set of 64-bit hashes: each bin's minimum, empty bins filled by hashed donors."""
    spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    at = (spread % np.uint64(bins)).astype(np.int64)
    out = np.full(bins, _EMPTY, np.uint64)
    order = np.argsort(spread)
    bin_of, first = np.unique(at[order], return_index=True)
    out[bin_of] = spread[order][first]
    full = out != _EMPTY
    empty = np.flatnonzero(~full)
    attempt = np.zeros(len(empty), np.uint64)
    while len(empty):
        donor = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + attempt) % np.uint64(bins)).astype(np.int64)
        ok = full[donor]
        out[empty[ok]] = out[donor[ok]]
        empty, attempt = empty[~ok], attempt[~ok] + np.uint64(1)
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for i in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return out


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, n, key, bands`` of ``doc_id, text, text_hash``: set size, set digest and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, key, band = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingles(words_of(text), size)
                n.append(len(s))
                if len(s):
                    salt = np.arange(1, len(s) + 1, dtype=np.uint64)
                    a, b = mix(s + salt).sum(dtype=np.uint64), mix(s ^ mix(salt)).sum(dtype=np.uint64)
                    key.append(int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big"))
                    band.append(band_keys(densified(s, bands * rows), bands).view(np.int64))
                else:
                    key.append(None)
                    band.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "key", "bands"])

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, key binary, bands array<bigint>")


def measured(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """Distinct pairs ``a, b`` compared on full sets: ``n_a, n_b, common`` and the shingles ``outside``, in b but not in a.

    ``texts``: one ``doc, text`` for each member.
    """
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("salts"))
    dealt = pairs.join(salts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    heads = dealt.select("a", "salt").distinct().join(texts.withColumnRenamed("doc", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")
    mates = dealt.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "salt", "b", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = np.empty(0, np.uint64)  # the set of the center whose mates follow
        for batch in slices(batches):
            a, b, n_a, n_b, outside = [], [], [], [], []
            for x, y, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("text").to_pylist(), strict=True):
                v = shingles(words_of(text), size)
                if y is None:
                    u = v
                    continue
                a.append(x)
                b.append(y)
                n_a.append(len(u))
                n_b.append(len(v))
                outside.append(np.setdiff1d(v, u, assume_unique=True).view(np.int64))
            common = [n - len(o) for n, o in zip(n_b, outside, strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (a, b, n_a, n_b, common)), pa.array(outside, pa.list_(pa.int64()))], ["a", "b", "n_a", "n_b", "common", "outside"])

    # a center comes before its mates, as null sorts first
    rows = heads.union(mates).repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return rows.select("a", "b", "text").mapInArrow(run, "a bigint, b bigint, n_a bigint, n_b bigint, common bigint, outside array<bigint>")


def reaches(common: str, n_a: str, n_b: str, percent: int) -> Column:
    """Whether so many common shingles of sets of these sizes reach the threshold."""
    return F.expr(f"{100 + percent} * ({common}) >= {percent} * ({n_a} + {n_b})")


def sharing(shares: DataFrame, percent: int) -> DataFrame:
    """Distinct ``x, y`` beside one center, of different components, that share a shingle of their prefixes.

    ``shares``: ``a, b, n_b, common, label, n_min, shingle``, written. Any partner of b has ``n_min`` shingles or more,
    so the pair needs at least ``need`` outside shingles in common; b may leave out the last ``need - 1`` of its own.
    """
    rarity = shares.groupBy("a", "shingle").agg(F.count("*").alias("f"))
    by = Window.partitionBy("a", "b")
    need = F.greatest(F.lit(1), F.expr(f"cast(ceil({percent} * (n_b + greatest(n_min, ceil({percent} * n_b / 100))) / {100 + percent}) as bigint) - common"))
    ranked = shares.join(rarity, ["a", "shingle"]).withColumns({"at": F.row_number().over(by.orderBy("f", "shingle")), "s": F.count("*").over(by)})
    prefix = written(ranked.where(F.col("at") <= F.col("s") - need + 1).select("a", "shingle", "b", "n_b", "common", "s", "at", "label"), "prefixes")
    x, y = (prefix.toDF("a", "shingle", *(f"{c}_{v}" for c in ("id", "n", "common", "s", "at", "label"))) for v in ("x", "y"))
    met = x.join(y, ["a", "shingle"]).where("id_x < id_y and label_x <> label_y")
    # the first shingle in common leaves so many behind it at most
    first = met.groupBy("id_x", "id_y", "a").agg(*[F.any_value(c).alias(c) for c in ("n_x", "n_y", "common_x", "common_y")], F.max(F.least(F.expr("s_x - at_x"), F.expr("s_y - at_y"))).alias("behind"))
    return first.where(reaches("least(common_x, common_y) + 1 + behind", "n_x", "n_y", percent)).select(F.col("id_x").alias("x"), F.col("id_y").alias("y")).distinct()


def beyond_stars(star: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of mates of one center, in different components, that may reach the threshold (see 4 above)."""
    rows = star.join(labels.withColumnRenamed("doc", "b"), "b", "left").withColumn("label", F.coalesce("component", "b"))
    groups = rows.groupBy("a").agg(F.min("n_b").alias("n_min"), F.max("n_b").alias("n_max"), F.min("label").alias("l_min"), F.max("label").alias("l_max")).where("l_min <> l_max")
    rows = written(rows.join(small(written(groups.select("a", "n_min", "n_max"), "groups")), "a").select("a", "b", "n_a", "n_b", "common", "outside", "label", "n_min", "n_max"), "mixed")

    shares = rows.select("a", "b", "n_b", "common", "label", "n_min", F.explode("outside").alias("shingle"))
    for _ in range(2):
        meets = shares.groupBy("a", "shingle").agg(F.min("label").alias("l_min"), F.max("label").alias("l_max")).where("l_min <> l_max").select("a", "shingle")
        shares = shares.join(meets, ["a", "shingle"], "left_semi")
        left = shares.groupBy("a", "b").agg(F.any_value("n_b").alias("n_b"), F.any_value("common").alias("common"), F.any_value("n_min").alias("n_min"), F.count("*").alias("s"))
        alive = left.where(reaches("common + s", "n_b", f"greatest(n_min, ceil({percent} * n_b / 100))", percent)).select("a", "b")
        shares = written(shares.join(alive, ["a", "b"], "left_semi"), "shares")
    by_shingles = sharing(shares, percent)

    lo, hi = F.expr(f"greatest(n_min, ceil({percent} * n_b / 100))"), F.expr(f"least(n_max, floor({100 + percent} * common / {percent}) - n_b)")
    apart = rows.where(~reaches("common", "n_a", "n_b", percent)).select("a", F.col("b").alias("x"), F.col("n_b").alias("n_x"), F.col("common").alias("common_x"), F.col("label").alias("label_x"), lo.alias("lo"), hi.alias("hi"))
    apart = apart.where("lo <= hi").withColumn("n_y", F.explode(F.expr("sequence(cast(lo as bigint), cast(hi as bigint))")))
    sized = rows.select("a", F.col("b").alias("y"), F.col("n_b").alias("n_y"), F.col("common").alias("common_y"), F.col("label").alias("label_y"))
    by_sizes = apart.join(sized, ["a", "n_y"]).where("label_x <> label_y").where(reaches("least(common_x, common_y)", "n_x", "n_y", percent)).select("x", "y")
    return by_shingles.union(by_sizes).selectExpr("least(x, y) a", "greatest(x, y) b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``doc, component``: the smallest number reachable over undirected links ``a, b``, for those that have a link.

    Every round each takes the smallest label among itself and its neighbours, then the label of its label; the rounds
    end when no label changes. Labels are written to the shared folder each round, and the round before goes.
    """
    both = links.union(links.select("b", "a")).toDF("doc", "other").distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy("doc").agg(F.least("doc", F.min("other")).alias("component"), F.col("doc").alias("was")), "labels")
    while True:
        now = labels.select("doc", "component")
        near = edges.join(now.withColumnRenamed("doc", "other"), "other").groupBy("doc").agg(F.min("component").alias("near"))
        hop = now.join(near, "doc").select("doc", F.least("component", "near").alias("hop"), F.col("component").alias("was"))
        jump = now.select(F.col("doc").alias("hop"), F.col("component").alias("far"))
        new = written(hop.join(jump, "hop", "left").select("doc", F.least("hop", F.coalesce("far", "hop")).alias("component"), "was"), "labels")
        removed(labels)
        labels = new
        if new.where("component <> was").isEmpty():
            return new.select("doc", "component")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 36, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` of every row of ``docs`` (``doc_id, text``)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    table = written(signatures(source, size, bands, rows), "signatures")
    filled = table.where("n > 0")
    # a class has a number, and one of its texts stands for it: the one of the smallest doc_id
    first = F.struct("doc_id", "text_hash")
    classes = filled.groupBy("key").agg(F.min(first).alias("r"), F.min_by(F.struct("n", "bands"), first).alias("x"))
    reps = written(classes.select("key", F.monotonically_increasing_id().alias("doc"), F.col("r.doc_id").alias("rep"), F.col("r.text_hash").alias("rep_hash"), "x.*"), "classes")

    buckets = reps.select("doc", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    mates = written(buckets.join(small(written(shared, "shared")), "bucket"), "mates")
    central = mates.groupBy("doc").agg(F.sum("members").alias("shares"))
    centers = mates.select("bucket", "doc").join(central, "doc").groupBy("bucket").agg(F.max_by("doc", F.struct("shares", -F.col("doc"))).alias("center"))
    pairs = mates.join(centers, "bucket").where("doc <> center").select(F.col("center").alias("a"), F.col("doc").alias("b")).distinct()
    wanted = small(written(reps.join(central.select("doc"), "doc", "left_semi").select("doc", F.col("rep").alias("doc_id"), F.col("rep_hash").alias("text_hash")), "wanted"))
    texts = source.join(wanted, (source.doc_id.eqNullSafe(wanted.doc_id)) & (source.text_hash == wanted.text_hash)).select("doc", "text").dropDuplicates(["doc"])
    texts = written(texts, "texts").hint("merge")  # texts are read up to four times, and never broadcast
    star = written(measured(written(pairs, "pairs"), texts, size), "star")
    links = star.where(reaches("common", "n_a", "n_b", percent)).select("a", "b")
    labels = components(links)
    rest = written(beyond_stars(star, labels, percent), "rest")
    if not rest.isEmpty():
        more = written(measured(rest, texts, size).where(reaches("common", "n_a", "n_b", percent)).select("a", "b"), "more")
        if not more.isEmpty():
            labels = components(links.union(more))

    linked = reps.select("key", "doc", "rep").join(labels, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = linked.join(least, "component").select("key", "component_id")
    found = filled.select("doc_id", "text_hash", "n", "key").join(named, "key").select("doc_id", "text_hash", "n", "component_id")
    every = found.unionByName(table.where("n = 0").select("doc_id", "text_hash", "n", F.col("doc_id").alias("component_id")))
    shown = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return every.select("doc_id", F.col("n").alias("n_shingles"), shown.alias("component_id"), (shown == F.col("doc_id")).alias("kept"), "text_hash")


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group."""
    gone = near_duplicates(docs, **options).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(small(written(gone, "gone")), (F.col("doc_id").cast("bigint") == F.col("_gone")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
