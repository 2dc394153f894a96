"""Merkle manifest of a table: a directed graph of content-addressed records, from the digests of rows to one root.

Rows of a group are ordered by a key, and every eight consecutive digests become the digest of their texts, until one is left; the groups' roots, in
group order, likewise give the root. Each level is a table of records (digest, children); equal subtrees share a record. A proof for a row is
found by descent: from the root, each level's digests are looked up among the records, the digits (base eight) of the asked ranks pick
children, and the children that weren't picked make up a segment of the path. Rows that share a path's beginning descend together,
so a level is one join of at most one row a node, and segments are read in reverse at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphbatch.llm.common import write_and_reread

BITS = 3
ARITY = 1 << BITS


def content_hash(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the texts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def framed(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value: no two lists of values have the same text."""
    value = c.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def record_hash(*values: Column) -> Column:
    return content_hash(*map(framed, values))


def numbered(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``i`` and ``n``: each row's rank from 0 among the rows of its ``by``, and their number.

    Rows are sorted by ranges over all groups, so a large group is spread over tasks; a group's ranks continue from one
    partition to the next by counts, of which there is one a partition and group.
    """
    own = [c for c in rows.columns]
    at = write_and_reread(rows.orderBy(by, *order).withColumn("_at", F.monotonically_increasing_id()), "ranks")
    at = at.withColumn("_part", F.shiftright("_at", 33))  # the upper bits of the id are the partition
    counts = at.groupBy("_part", by).agg(F.min("_at").alias("_first"), F.count("*").alias("_c"))
    all_of = Window.partitionBy(by)
    before = F.coalesce(F.sum("_c").over(all_of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = write_and_reread(counts.select("_part", by, "_first", before.alias("_before"), F.sum("_c").over(all_of).alias("n")), "rank-counts")
    return at.join(counts, ["_part", by]).select(*own, (F.col("_before") + F.col("_at") - F.col("_first")).alias("i"), "n")


def height_of(n: Column, limit: int = 22) -> Column:
    """Levels above the leaves: the smallest h with 8^h >= n."""
    out = F.lit(limit)
    for h in range(limit - 1, -1, -1):
        out = F.when(n <= F.lit(min(ARITY**h, (1 << 63) - 1)), F.lit(h)).otherwise(out)
    return out


@dataclass
class Tree:
    """Trees of several groups: ``leaves`` (g, i, digest, height, ...), per height from 1 on the records (g, i, height, digest, children), and ``roots`` (g, digest, height)."""

    leaves: DataFrame
    levels: list[DataFrame]
    roots: DataFrame


def grow(leaves: DataFrame, label: str) -> Tree:
    """Trees over (g, i, digest, height): each level groups eight nodes at most; groups that are down to one node have their root."""
    top = leaves.agg(F.max("height").alias("h")).first()["h"]
    nodes, levels, roots = leaves.select("g", "i", "height", "digest"), [], leaves.where("height = 0").select("g", "digest", "height")
    for h in range(1, (top or 0) + 1):
        runs = nodes.where(F.col("height") >= h).groupBy("g", F.shiftright("i", BITS).alias("i"), "height").agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "digest"))).alias("run"))
        nodes = runs.select("g", "i", "height", F.transform("run", lambda r: r["digest"]).alias("children"))
        nodes = write_and_reread(nodes.withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{label}-{h}")
        levels.append(nodes)
        roots = roots.unionByName(nodes.where(F.col("height") == h).select("g", "digest", "height"))
    return Tree(leaves, levels, roots)


@dataclass
class Manifest:
    """``groups``: the trees of all groups, keyed by their rank in group order; ``top``: the one tree over their roots; ``root``: its digest, none for an empty table."""

    groups: Tree
    top: Tree
    root: str | None


def build(rows: DataFrame, group: str, key: str, digest: str) -> Manifest:
    """Manifest of rows with their digests. Groups are in UTF-8 order, the null group first; rows in the order of key (nulls first), then of the digest."""
    named = rows.withColumn("_g", F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")))
    leaves = numbered(named, "_g", key, digest).withColumnRenamed("_g", "g").withColumn("height", height_of(F.col("n"))).drop("n")
    groups = grow(write_and_reread(leaves.withColumn("digest", F.col(digest)), "leaves"), "tree")
    subroots = numbered(groups.roots.select(F.lit(0).alias("_all"), F.col("g").alias("name"), "digest"), "_all", "name")
    top = grow(write_and_reread(subroots.select(F.col("_all").alias("g"), "i", "name", "digest", height_of(F.col("n")).alias("height")), "subroots"), "top")
    found = top.roots.select("digest").collect()  # one row, or none
    return Manifest(groups, top, found[0]["digest"] if found else None)


def _segment(children: str, pos: str) -> Column:
    """The children that weren't picked, as the text left of the picked one and the text right of it."""
    side = lambda start, length: F.array_join(F.slice(children, start, length), "")
    return F.struct(side(F.lit(1), F.col(pos)).alias("left"), side(F.col(pos) + 2, F.lit(ARITY)).alias("right"))


def descend(tree: Tree, starts: DataFrame, wanted: DataFrame, to: int = 0, label: str = "descent") -> DataFrame:
    """(g, i, digest, path, subroot) of the nodes at height ``to`` above wanted nodes, found from the starts (g, digest, height, path, subroot) down.

    ``wanted`` is (g, i, height) at height ``to``. Each step looks digests up among the records of one level and follows the children that have
    wanted nodes below.
    """
    asked = {to: wanted.select("g", "i", "height").distinct()}
    for h in range(to + 1, len(tree.levels)):
        above = asked[h - 1].where(F.col("height") >= h).select("g", F.shiftright("i", BITS).alias("i"), "height").distinct()
        asked[h] = write_and_reread(above, f"{label}-asked")
    enter = starts.select("g", F.lit(0).cast("long").alias("i"), "digest", "path", "subroot", "height")
    front = enter.where(F.col("height") == max(to, len(tree.levels))).drop("height")
    for h in range(len(tree.levels), to, -1):
        records = tree.levels[h - 1].groupBy("digest").agg(F.first("children").alias("children"))  # equal digests have equal children
        opened = front.join(records, "digest").select("g", "i", "path", "subroot", "children", F.posexplode("children").alias("pos", "child"))
        below = opened.select("g", (F.shiftleft("i", BITS) + F.col("pos")).alias("i"), F.col("child").alias("digest"), F.concat("path", F.array(_segment("children", "pos"))).alias("path"), "subroot")
        below = write_and_reread(below.join(asked[h - 1].select("g", "i"), ["g", "i"], "left_semi"), label)
        front = below.unionByName(enter.where(F.col("height") == h - 1).drop("height"))
    return front


def prove(manifest: Manifest, requests: DataFrame, carry: list[str]) -> DataFrame:
    """(carry..., leaf, subroot, path) of the asked leaves; ``requests`` are rows of the manifest's leaves, and ``path`` lists segments (left, right) from the leaf up.

    The last step, which reaches as many nodes as there are requests, doesn't send paths to rows: rows of a run of eight travel together to
    the record above them.
    """
    top, groups = manifest.top, manifest.groups
    root = top.roots.select("g", "digest", "height", F.expr("CAST(array() AS array<struct<left:string,right:string>>)").alias("path"), F.lit("").alias("subroot"))
    ranks = top.leaves.select(F.col("name"), "i", F.lit(0).alias("g"), "height")
    asked_groups = requests.select("g").distinct().join(ranks.drop("g").withColumnRenamed("name", "g"), "g").select(F.lit(0).alias("g"), "i", "height")
    subroots = descend(top, root, asked_groups, label="top-descent")
    starts = subroots.select("i", "path", "digest").join(ranks.select("name", "i"), "i").join(groups.roots.select(F.col("g").alias("name"), "height"), "name")
    starts = write_and_reread(starts.select(F.col("name").alias("g"), "digest", "height", "path", F.col("digest").alias("subroot")), "starts")
    payload = F.struct(*(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    pos = F.col("i").bitwiseAND(F.lit(ARITY - 1)).cast("int")
    runs = requests.where("height > 0").select("g", F.shiftright("i", BITS).alias("i"), "height", F.struct(pos.alias("pos"), payload.alias("row")).alias("one"))
    runs = write_and_reread(runs.groupBy("g", "i", "height").agg(F.collect_list("one").alias("run")), "runs")  # ranks are distinct: eight at most
    done = requests.where("height = 0").select("g", payload.alias("row")).join(starts.select("g", F.col("digest").alias("leaf"), "subroot", "path"), "g").select("row", "leaf", "subroot", "path")
    if groups.levels:
        front = descend(groups, starts, runs, to=1)
        records = groups.levels[0].groupBy("digest").agg(F.first("children").alias("children"))
        met = front.join(records, "digest").join(runs.select("g", "i", "run"), ["g", "i"]).select("path", "subroot", "children", F.explode("run").alias("one"))
        met = met.select("path", "subroot", "children", F.col("one.row").alias("row"), F.col("one.pos").alias("pos"))
        leaf = F.element_at("children", F.col("pos") + 1)
        done = done.unionByName(met.select("row", leaf.alias("leaf"), "subroot", F.concat("path", F.array(_segment("children", "pos"))).alias("path")))
    return done.select(*(F.col(f"row.c{k}").alias(c) for k, c in enumerate(carry)), "leaf", "subroot", F.reverse("path").alias("path"))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the digests beside its path lead to."""
    return F.aggregate(path, leaf, lambda digest, s: content_hash(s["left"], digest, s["right"]))


CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def document_manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a manifest of all documents, grouped by lang, and a proof of each.

    Where 3 divides crc32(doc_id) the folded leaf is that of the text with A-Z lower-cased, so it verifies only if that changes nothing. Nulls are values of their own
    (``-``). Documents of one lang and doc_id (null ids first) are ordered by their digest, and equal rows are leaves of their own. An
    empty table has no root and no rows. Other columns than doc_id, source, lang, n_chars and text play no part.
    """
    names = ("doc_id", "source", "lang", "n_chars")
    hashed = lambda text: record_hash(*map(F.col, names), text)
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(touched, hashed(F.translate("text", CAPITALS, SMALL)))
    rows = write_and_reread(docs.select("doc_id", "lang", hashed(F.col("text")).alias("own"), changed.alias("changed")), "rows")
    manifest = build(rows, "lang", "doc_id", "own")
    proofs = prove(manifest, manifest.groups.leaves, ["doc_id", "changed"])
    out = proofs.select("doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_hash(F.col("path")).alias("proof_sha256"), fold(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
