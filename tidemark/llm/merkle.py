"""11. Merkle dataset manifest: nested-struct rollup over rank digits; a transform and an explode emit the proofs.

A row is a leaf. The leaves of a group (source) ascend by id; runs of three nodes have a parent until one is left, the
group's subroot, and the subroots of all groups give the root likewise. A leaf's rank in its group is written in base
three: its lower six digits are columns of their own and are grouped away one after the other, each grouping nesting
its children's structs in their parent's; so a block of at most 729 leaves becomes one row after one shuffle. The roots
of blocks are the leaves of the next tier, and so on. Downwards, one nested transform over a block's struct writes the
path of each of its leaves and one explode emits them, without joins; the path above a block reaches it by a grouping of
block rows and path rows, two for each block. No task holds more than blocks, whatever a group's size.

Cases: null columns are ``-`` in a leaf; rows that repeat an id stand by their leaves, and equal leaves are
interchangeable, each with a proof; null ids stand first, a null group is a group of its own and stands first; an empty
text is ``0:``; long texts are hashed where they are read and never shuffled; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, ranked, small, written

#: Children of a node, digits of a block, leaves of a block.
RUN, DIGITS = 3, 6
BLOCK = RUN**DIGITS
#: The fields of a leaf, in order. Fixed values.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<before: string, after: string>>"


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, each with its length in UTF-8 bytes; ``changed``: expressions in place of columns."""
    shown = [changed.get(c, F.col(c)).cast("string") for c in FIELDS]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in shown]), 256)


def _rolled(nodes: DataFrame) -> DataFrame:
    """``_key, _block, n, node`` of nodes (``_key, rank, n``: nodes of the key, ``hash``, ``item``): a nested struct for each block."""
    digits = [f"_d{i}" for i in range(DIGITS)]
    columns = [F.pmod(F.floor(F.col("rank") / RUN**i), F.lit(RUN)).cast("int").alias(d) for i, d in enumerate(digits)]
    out = nodes.select("_key", F.floor(F.col("rank") / BLOCK).alias("_block"), "n", *columns, F.struct("hash", "item").alias("node")).repartition("_key", "_block")
    for i, digit in enumerate(digits):
        kids = out.groupBy("_key", "_block", "n", *digits[i + 1 :]).agg(F.array_sort(F.collect_list(F.struct(digit, "node"))).alias("kids"))
        kids = kids.withColumn("kids", F.col("kids.node"))
        # where the level below has one node, that is the top
        told = F.when(F.col("n") > RUN**i, F.sha2(F.array_join("kids.hash", ""), 256)).otherwise(F.col("kids")[0]["hash"])
        out = kids.select("_key", "_block", "n", *digits[i + 1 :], F.struct(told.alias("hash"), "kids").alias("node"))
    return out


def _leaves_of(node: Column, path: Column, level: int) -> Column:
    """Array of (item, hash, path) of a nested struct's leaves; a path has the hashes before and after, lowest level first."""
    if not level:
        return F.array(F.struct(node["item"].alias("item"), node["hash"].alias("hash"), path.alias("path")))

    def kid(x: Column, i: Column) -> Column:
        hashes = node["kids"]["hash"]
        step = F.struct(F.array_join(F.slice(hashes, 1, i), "").alias("before"), F.array_join(F.slice(hashes, i + 2, RUN), "").alias("after"))
        steps = F.when(F.col("n") > RUN ** (level - 1), F.array(step)).otherwise(F.array().cast(_STEPS))
        return _leaves_of(x, F.concat(steps, path), level - 1)

    return F.flatten(F.transform(node["kids"], kid))


def _climbed(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The tiers above the nodes, of which a key has at most ``most``, each stored; each key has one block in the last."""
    tiers = [written(_rolled(nodes), "merkle")]
    while most > BLOCK:
        most = -(-most // BLOCK)
        up = tiers[-1].select("_key", F.col("_block").alias("rank"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("node.hash").alias("hash"), F.struct("_block").alias("item"))
        tiers.append(written(_rolled(up), "merkle"))
    return tiers


def _descended(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``item, hash, path, above`` of all leaves below the tiers. ``tops``: ``_key, path, above`` of each key's top."""
    paths = tops.select("_key", F.lit(0).cast("bigint").alias("_block"), "path", "above")
    for tier in reversed(tiers):
        both = tier.unionByName(paths, allowMissingColumns=True).groupBy("_key", "_block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "above")])
        out = both.select("_key", "above", F.explode(_leaves_of(F.col("node"), F.col("path"), DIGITS)).alias("x")).select("_key", "above", "x.*")
        if tier is not tiers[0]:
            paths = out.select("_key", F.col("item._block").alias("_block"), "path", "above")
    return out


def manifest(leaves: DataFrame, id_col: str, group: str) -> DataFrame:
    """``leaves`` (``id_col, group, leaf`` and other columns) with ``subroot``, ``root`` and ``path``, the proof's steps.

    A step has the joined hashes that stand before and after a node in its run; steps go from the leaf to the root.
    """
    key = F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit(""))
    placed = ranked(leaves.withColumn("_key", key), [id_col, "leaf"], "merkle-leaves")
    sizes = placed.groupBy("_key").agg(F.count("*").alias("n"))
    nodes = placed.join(small(sizes), "_key").select("_key", "rank", "n", F.col("leaf").alias("hash"), F.struct(*leaves.columns).alias("item"))
    tiers = _climbed(nodes, sizes.agg(F.max("n")).first()[0] or 0)
    groups = written(tiers[-1].select(F.col("_key").alias("item"), F.col("node.hash").alias("hash")), "merkle-groups")
    count = groups.count()
    ordered = ranked(groups.withColumn("_key", F.lit("")), ["item"], "merkle-groups")
    above = _climbed(ordered.select("_key", "rank", F.lit(count).cast("bigint").alias("n"), "hash", F.struct(F.col("item").alias("group")).alias("item")), count)
    root = above[-1].select("_key", F.array().cast(_STEPS).alias("path"), F.col("node.hash").alias("above"))
    tops = _descended(above, root).select(F.col("item.group").alias("_key"), "path", F.struct(F.col("hash").alias("subroot"), F.col("above").alias("root")).alias("above"))
    return _descended(tiers, tops).select("item.*", "above.subroot", "above.root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path give."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def manifest_report(docs: DataFrame) -> DataFrame:
    """Each document with its proof's digest, and the root that its tampered row folds to.

    Rows whose crc32 of the decimal id is even are tampered with: their texts lose all line feeds.
    """
    hit = F.coalesce(crc_mod("doc_id", 2) == 0, F.lit(False))
    changed = F.when(hit, leaf_digest(text=F.replace("text", F.lit("\n"), F.lit(""))))
    leaves = written(docs.select("doc_id", F.col("source"), leaf_digest().alias("leaf"), changed.alias("tampered")), "leaves")
    proved = manifest(leaves, "doc_id", "source")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
