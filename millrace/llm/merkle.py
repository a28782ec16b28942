"""Merkle manifest: a hash tree over the rows of a table, with a proof for each row.

Every row is a leaf. Leaves of a group are numbered in order, floor-divided by the
fanout, and each run of children is hashed into its parent, level by level, until
one node is left: the group's subroot. The subroots, in order of their groups, are
leaves of the same kind of tree, whose top is the root. Proofs are built on the way
back down: each level joins its runs with the proofs of their parents and puts the
siblings before them, so all levels together join half as many rows again as there
are leaves.

Rows are numbered within ranges of (group, order), so a group with a third of all
rows is many tasks' work, and only 32-byte digests are shuffled, never texts. What
is collected is the size of the largest group, the number of nodes of each level and
the root.

Defined cases: each null field is written ``-``, which no value is; an empty text has
a length of its own (``0:``); texts are hashed whole; a null group is a group of its
own and comes first; leaves sort by id, null ids first, ties by leaf, so repeated
rows are leaves of their own and take neighbouring places; a group of one leaf has
that leaf as its subroot; an empty table has no root and gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import shuffle_partitions, stage

FANOUT = 3
#: Levels of so many nodes at most are one task's work.
SMALL = 10_000
#: Columns of a document that its leaf covers, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A value as its length in UTF-8 bytes, a colon and itself, so no two rows are written alike; null as ``-``."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Binary digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_text(digests: Column) -> Column:
    """Hex of one digest, or of several in a row."""
    return F.lower(F.hex(digests))


def joined(digests: Column) -> Column:
    """Digests of an array, one after another."""
    return F.aggregate(digests, F.lit(b""), lambda acc, d: F.concat(acc, d))


def group_key(group: Column) -> Column:
    """The group as a text that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit(":"), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """Staged ``rows`` with ``idx``, their place within ``grp`` in the given order, and ``n``, the rows of their group.

    Rows are dealt by range; places within a range are numbered by ``row_number`` and
    ranges start where the counts of the earlier ones end.
    """
    keys = ["grp", *order, "row"]
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
    placed = stage(dealt.withColumn("part", F.spark_partition_id()), f"{label}-ranges")
    sizes = placed.groupBy("grp", "part").agg(F.count("*").alias("size"))
    group = Window.partitionBy("grp")
    before = group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("grp", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"), F.sum("size").over(group).alias("n"))
    within = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order, "row"))
    found = placed.join(starts.hint("merge"), ["grp", "part"]).withColumn("idx", F.col("start") + within - 1)
    return stage(found.drop("part", "row", "start"), f"{label}-leaves")


@dataclass
class Tree:
    """Levels from the leaves up. Each is staged: grp, parent, children (idx, digest, payload), n of the children's level, digest."""

    levels: list[DataFrame]
    #: Nodes of each level, over all groups.
    nodes: list[int]
    fanout: int = FANOUT

    def tops(self) -> DataFrame:
        """(grp, digest) of each group's last node."""
        found = None
        for level in self.levels:
            top = level.filter(F.col("n") <= self.fanout).select("grp", "digest")
            found = top if found is None else found.unionByName(top)
        return found


def in_few(df: DataFrame, nodes: int) -> DataFrame:
    return df.coalesce(1) if nodes <= SMALL else df


def grow(leaves: DataFrame, payload: list[str], label: str, fanout: int = FANOUT) -> Tree:
    """Hash numbered leaves (grp, idx, n, digest, payload) level by level; groups that have reached their top drop out."""
    largest = leaves.agg(F.max("n")).first()[0]
    widths = [1]  # how many leaves a node of each level covers
    while widths[-1] < (largest or 0):
        widths.append(widths[-1] * fanout)
    sums = [F.sum(F.when((F.col("n") > w // fanout) | (F.lit(w) == 1), F.ceil(F.col("n") / F.lit(w)))) for w in widths]
    totals = leaves.filter("idx = 0").agg(*sums).first()
    nodes = [int(n or 0) for n in totals]
    levels: list[DataFrame] = []
    below = leaves
    for k in range(max(1, len(widths) - 1)):
        children = F.sort_array(F.collect_list(F.struct("idx", "digest", *(payload if k == 0 else []))))
        runs = in_few(below, nodes[k]).groupBy("grp", F.floor(F.col("idx") / F.lit(fanout)).alias("parent")).agg(children.alias("children"), F.max("n").alias("n"))
        hashed = F.unhex(F.sha2(as_text(joined(F.col("children.digest"))), 256))
        # The only leaf of a group is its top as it is.
        levels.append(stage(runs.withColumn("digest", F.when(F.col("n") == 1, F.col("children")[0]["digest"]).otherwise(hashed)), f"{label}-level"))
        rest = levels[-1].filter(F.col("n") > fanout)
        below = rest.select("grp", F.col("parent").alias("idx"), F.ceil(F.col("n") / F.lit(fanout)).alias("n"), "digest")
    return Tree(levels, nodes, fanout)


def prove(tree: Tree, above: DataFrame, label: str) -> DataFrame:
    """Leaves with payload and proof, given what ``above`` (grp, proof, ...) says of each group's top.

    ``proof`` is one entry (before, after) a level: the digests of the siblings on either side.
    """
    carried = [c for c in above.columns if c not in ("grp", "proof")]
    parents = None
    for k in reversed(range(len(tree.levels))):
        level = in_few(tree.levels[k].drop("digest"), tree.nodes[k])
        found = level.filter(F.col("n") <= tree.fanout).join(above, "grp")
        if parents is not None:
            inner = level.filter(F.col("n") > tree.fanout).join(in_few(parents, tree.nodes[k]).hint("merge"), ["grp", "parent"])
            found = found.unionByName(inner)
        place = found.select("grp", F.posexplode("children").alias("at", "child"), F.col("children.digest").alias("run"), "n", "proof", *carried)
        sides = F.struct(joined(F.slice("run", F.lit(1), F.col("at"))).alias("before"), joined(F.slice("run", F.col("at") + 2, F.size("run"))).alias("after"))
        proof = F.when(F.col("n") == 1, F.col("proof")).otherwise(F.concat(F.array(sides), F.col("proof"))).alias("proof")
        if k == 0:
            return place.select("grp", "child.*", proof, *carried)
        parents = place.select("grp", F.col("child.idx").alias("parent"), proof, *carried)
        if tree.nodes[k] > SMALL:
            parents = stage(parents, f"{label}-proofs")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf (binary) leads to with a proof, in hex."""
    return F.aggregate(proof, as_text(leaf), lambda acc, s: F.sha2(F.concat(as_text(s["before"]), acc, as_text(s["after"])), 256))


def proof_hash(proof: Column) -> Column:
    """Digest of a proof's siblings in order, in hex."""
    return F.sha2(F.aggregate(proof, F.lit(""), lambda acc, s: F.concat(acc, as_text(s["before"]), as_text(s["after"]))), 256)


EMPTY_PROOF = "cast(array() as array<struct<before: binary, after: binary>>)"


def manifest(leaves: DataFrame, group: str, order: list[str], leaf: str = "leaf", fanout: int = FANOUT) -> DataFrame:
    """Each row's leaf, subroot, root and proof, beside its other columns; ``leaf`` holds binary digests.

    ``subroot`` and ``root`` are binary as well; ``folded`` and ``proof_hash`` say what a proof leads to.
    """
    payload = [c for c in leaves.columns if c not in (group, leaf)]
    named = leaves.select(group_key(F.col(group)).alias("grp"), F.col(leaf).alias("digest"), *payload)
    placed = numbered(stage(named, "merkle"), [*order, "digest"], "merkle")
    tree = grow(placed, payload, "merkle", fanout)
    # Subroots are numbered in order of their groups, as leaves of one group.
    tops = tree.tops().select(F.lit("").alias("grp"), F.col("grp").alias("of"), "digest")
    roof = grow(numbered(tops, ["of"], "merkle-groups"), ["of"], "merkle-groups", fanout)
    root = roof.tops().select("digest").first()
    start = leaves.sparkSession.range(1).select(F.lit("").alias("grp"), F.expr(EMPTY_PROOF).alias("proof"))
    above = prove(roof, start, "merkle-groups").select(F.col("of").alias("grp"), "proof", F.col("digest").alias("subroot"))
    proven = prove(tree, stage(above, "merkle-groups"), "merkle")
    return proven.select(*payload, F.col("digest").alias(leaf), "subroot", F.lit(bytes(root.digest) if root else None).cast("binary").alias("root"), "proof")


def document_leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, and the leaf of the tampered text: without newlines where the id's checksum is even."""
    fields = {c: F.col(c) for c in FIELDS}
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = leaf_hash(*{**fields, "text": F.replace("text", F.lit("\n"), F.lit(""))}.values())
    both = docs.select("source", "doc_id", leaf_hash(*fields.values()).alias("leaf"), F.when(hit, changed).alias("changed"))
    return both.withColumn("changed", F.coalesce("changed", "leaf"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of ``documents`` by source, each proof verified against what may have been tampered with."""
    proven = manifest(document_leaves(spark.read.parquet(f"{sf_dir}/documents.parquet")), "source", ["doc_id"])
    found = proven.withColumn("folded_root", folded(F.col("changed"), F.col("proof")))
    digests = [as_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return found.select("doc_id", *digests, proof_hash(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == as_text(F.col("root"))).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(octet_length(encode(CAST({value} AS VARCHAR))) || ':' || CAST({value} AS VARCHAR), '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in (*FIELDS[:-1], text)) + ")"


#: CRC-32 of an id's decimal digits, bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(doc_id::VARCHAR)),
    lambda k: CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1)) ELSE 0 END::BIGINT)),
    lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(xor(c, b) // 2, 3988292384::BIGINT) ELSE xor(c, b) // 2 END))"""
_SQL_TREE = """
  {name}(level, grp, idx, n, digest) AS (
    SELECT 0, grp, idx, n, digest FROM {leaves}
    UNION ALL
    SELECT level + 1, grp, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY level, grp, idx // 3, n
  ),
  {name}_runs AS (SELECT level, grp, idx // 3 AS parent, list(digest ORDER BY idx) AS run FROM {name} GROUP BY level, grp, idx // 3),
  {name}_walk(row, level, grp, idx, n, siblings, folded) AS (
    SELECT row, 0, grp, idx, n, {siblings}, {changed} FROM {leaves}
    UNION ALL
    SELECT w.row, w.level + 1, w.grp, w.idx // 3, (w.n + 2) // 3,
           siblings || array_to_string(run[1 : w.idx % 3], '') || array_to_string(run[w.idx % 3 + 2 :], ''),
           sha256(array_to_string(run[1 : w.idx % 3], '') || folded || array_to_string(run[w.idx % 3 + 2 :], ''))
    FROM {name}_walk w JOIN {name}_runs r ON w.level = r.level AND w.grp = r.grp AND w.idx // 3 = r.parent WHERE w.n > 1
  )"""
OP11_SQL = f"""
WITH RECURSIVE
  said AS (
    SELECT row_number() OVER () AS row, coalesce(':' || source, '') AS grp, doc_id, {_sql_leaf("text")} AS digest,
           CASE WHEN {_SQL_CRC} % 2 = 0 THEN {_sql_leaf("replace(text, chr(10), '')")} ELSE {_sql_leaf("text")} END AS changed
    FROM documents
  ),
  leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM said),
  {_SQL_TREE.format(name="tree", leaves="leaves", siblings="''", changed="changed")},
  subroots AS (SELECT grp AS of, '' AS grp, digest, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
  tops AS (SELECT w.row, s.grp, s.of, s.idx, s.n, s.digest, w.siblings, w.folded FROM tree_walk w JOIN subroots s ON w.grp = s.of WHERE w.n = 1),
  roof(level, grp, idx, n, digest) AS (
    SELECT 0, grp, idx, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, grp, idx // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM roof WHERE n > 1 GROUP BY level, grp, idx // 3, n
  ),
  roof_runs AS (SELECT level, idx // 3 AS parent, list(digest ORDER BY idx) AS run FROM roof GROUP BY level, idx // 3),
  climb(row, level, idx, n, siblings, folded) AS (
    SELECT row, 0, idx, n, siblings, folded FROM tops
    UNION ALL
    SELECT w.row, w.level + 1, w.idx // 3, (w.n + 2) // 3,
           siblings || array_to_string(run[1 : w.idx % 3], '') || array_to_string(run[w.idx % 3 + 2 :], ''),
           sha256(array_to_string(run[1 : w.idx % 3], '') || folded || array_to_string(run[w.idx % 3 + 2 :], ''))
    FROM climb w JOIN roof_runs r ON w.level = r.level AND w.idx // 3 = r.parent WHERE w.n > 1
  )
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.digest AS root, sha256(c.siblings) AS proof_sha256, c.folded AS folded_root, c.folded = r.digest AS verified
FROM leaves l JOIN subroots s ON l.grp = s.of JOIN climb c ON c.row = l.row AND c.n = 1 CROSS JOIN (SELECT digest FROM roof WHERE n = 1) r
"""
