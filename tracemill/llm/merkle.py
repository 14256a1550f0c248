"""A Merkle manifest of documents: leaves, trees by source, proofs, and their check (operator 11)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import discard, materialise, table

#: Children of a node; levels that are climbed over rows dealt once, so that a window holds FAN ** LEVELS rows at most.
FAN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: lowercase hex SHA-256 of the parts' bytes, one after the other; null parts are left out."""
    return F.sha2(F.concat(*(F.coalesce(p.cast("binary"), F.lit(b"")) for p in parts)), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its UTF-8 byte count, a colon, the value; a hyphen if null."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-").cast("binary")).otherwise(F.concat(F.concat(F.octet_length(s).cast("string"), F.lit(":")).cast("binary"), s.cast("binary")))


def leaf(text: Column) -> Column:
    """A document's leaf, with text as its text."""
    return digest(*(field(F.col(c)) for c in FIELDS[:-1]), field(text))


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree string, d string, and others), written with pos (from 0 in its tree by the columns of order) and n (nodes of the tree).

    Rows are sorted once over all trees; a row's place is its place in its
    partition and the rows of its tree in the partitions before, so that a large
    tree is numbered by many tasks.
    """
    placed = materialise(nodes.sort("tree", *(F.col(c).asc_nulls_first() for c in order)).withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    cells = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    by_part = Window.partitionBy("tree").orderBy("part")
    before = F.coalesce(F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(Window.partitionBy("tree")).alias("n"))
    return placed.join(cells, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "shift", "at")


def _nodes(n: Column, height: int) -> Column:
    """Nodes of a tree of n at this height."""
    return F.ceil(n / F.lit(FAN**height)).cast("long")


def climb(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (tree, pos, n, d) with up (what stands levels higher, at the first node below it) and l0, r0, l1, r1 ...: siblings to the left and right.

    A window holds the rows below one node of that height. At each level lag and
    lead at the level's own offset are the siblings, masked by the slot in the
    run and the run's length; the row of the first child then holds the parent.
    A level of a tree that has one node left is not hashed: siblings are null.
    """
    span = Window.partitionBy("tree", "block").orderBy("pos")
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / F.lit(FAN**levels)).cast("long"), "up": F.col("d")})
    for h in range(levels):
        step, count = FAN**h, _nodes(F.col("n"), h)
        slot = (F.floor(F.col("pos") / F.lit(step)) % FAN).cast("int")
        run = F.least(F.lit(FAN), count - FAN * F.floor(F.col("pos") / F.lit(step * FAN)))
        here = (F.col("pos") % step == 0) & (count > 1)
        seen = {f"_{'b' if off < 0 else 'a'}{abs(off)}": F.lag("up", -off * step).over(span) if off < 0 else F.lead("up", off * step).over(span) for off in (-2, -1, 1, 2)}
        rows = rows.withColumns(seen)
        left = F.concat(F.when(slot == 2, F.col("_b2")).otherwise(""), F.when(slot >= 1, F.col("_b1")).otherwise(""))
        right = F.concat(F.when(slot + 1 < run, F.col("_a1")).otherwise(""), F.when(slot + 2 < run, F.col("_a2")).otherwise(""))
        rows = rows.withColumns({f"l{h}": F.when(here, left), f"r{h}": F.when(here, right)})
        parent = F.when(count > 1, digest(F.col("up"), F.col(f"r{h}"))).otherwise(F.col("up"))
        rows = rows.withColumn("up", F.when(F.col("pos") % (step * FAN) == 0, parent)).drop(*seen)
    return rows


def descend(climbed: DataFrame, levels: int = LEVELS) -> DataFrame:
    """climbed with path: (left, right) of each level up to its height, the node's own level first; parents hand theirs to their children by lag."""
    span = Window.partitionBy("tree", "block").orderBy("pos")
    rows = climbed.withColumn("path", F.when(F.col("pos") % (FAN**levels) == 0, F.array().cast(PATH)))
    for h in range(levels - 1, -1, -1):
        step = FAN**h
        slot = (F.floor(F.col("pos") / F.lit(step)) % FAN).cast("int")
        seen = {f"_p{off}": F.lag("path", off * step).over(span) for off in (1, 2)}
        rows = rows.withColumns(seen)
        above = F.when(slot == 0, F.col("path")).when(slot == 1, F.col("_p1")).otherwise(F.col("_p2"))
        own = F.when(F.col(f"l{h}").isNotNull(), F.array(F.struct(F.col(f"l{h}").alias("left"), F.col(f"r{h}").alias("right")))).otherwise(F.array().cast(PATH))
        rows = rows.withColumn("path", F.when(F.col("pos") % step == 0, F.concat(own, above))).drop(*seen, f"l{h}", f"r{h}")
    return rows


def forest(nodes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, list[DataFrame]]:
    """The root of each tree, (tree, d), and the written levels of nodes below it, lowest first: nodes, then what stands levels higher, and so on."""
    floors = [nodes]
    while (floors[-1].agg(F.max("n")).first()[0] or 0) > 1:
        top = climb(floors[-1], levels).where(F.col("pos") % (FAN**levels) == 0)
        floors.append(materialise(top.select("tree", F.col("block").alias("pos"), _nodes(F.col("n"), levels).alias("n"), F.col("up").alias("d")), "merkle-floor"))
    return floors[-1].select("tree", "d"), floors


def proofs(floors: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The lowest of floors with path up to the root of its tree and on: above has tree, path and other columns, which each node gets."""
    if len(floors) == 1:
        return floors[0].join(above, "tree")
    rest = above.withColumn("block", F.lit(0).cast("long"))
    for floor in reversed(floors[:-1]):
        rows = descend(climb(floor, levels), levels).withColumnRenamed("path", "below").drop("up", "n")
        rest = rows.join(rest, ["tree", "block"]).withColumn("path", F.concat("below", "path")).drop("below", "block")
        if floor is not floors[0]:
            rest = materialise(rest.drop("d").withColumnRenamed("pos", "block"), "merkle-proofs")
    return rest


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(s["left"], d, s["right"]).cast("binary"), 256))


def manifest(docs: DataFrame, changed: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, other (the leaf with changed as text, null where changed is null), subroot, root, path: a row for each row of docs.

    Leaves ascend by doc_id within a source, null ids first, rows that repeat an
    id by their leaf, so that repeated rows have a defined place; rows alike in
    all are leaves of their own. A null source is a tree of its own, the first.
    Nulls are hyphens, texts are taken as their bytes, valid UTF-8 or not; other
    columns of docs are ignored. No rows give no rows.
    """
    changed = F.lit(None).cast("string") if changed is None else changed
    tree = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("."), F.col("source").cast("string")))
    rows = docs.select(*FIELDS, changed.alias("other_text"))
    # repeated rows are told apart by where they are read, so that a group of them can be cut into ranges
    leaves = rows.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("text").cast("string")).alias("d"), F.when(F.col("other_text").isNotNull(), leaf(F.col("other_text"))).alias("other"), F.monotonically_increasing_id().alias("copy"))
    written = materialise(leaves, "merkle-leaves")
    nodes = materialise(positions(written, ["doc_id", "d", "copy"]).drop("copy"), "merkle-nodes")
    subroots, floors = forest(nodes, levels)
    top_nodes = materialise(positions(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "d"), ["source_tree"]), "merkle-top")
    roots, top_floors = forest(top_nodes, levels)
    found = roots.first()
    root = found["d"] if found else None
    over = proofs(top_floors, roots.select("tree", F.array().cast(PATH).alias("path")), levels)
    over = materialise(over.select(F.col("source_tree").alias("tree"), F.col("d").alias("subroot"), "path"), "merkle-over")
    below = proofs(floors, over, levels)
    discard(written)
    return below.select("doc_id", F.col("d").alias("leaf"), "other", "subroot", F.lit(root).cast("string").alias("root"), "path")


def verified(found: DataFrame) -> DataFrame:
    """found (of manifest) with proof_sha256, folded_root (from other, else from the leaf) and verified, without other and path."""
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = found.withColumns({"proof_sha256": F.sha2(siblings.cast("binary"), 256), "folded_root": fold(F.coalesce("other", "leaf"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its proof; where its decimal id has an even CRC-32, the check is made on its text without line ends."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return verified(manifest(table(spark, sf_dir, "documents"), F.when(even, F.translate("text", "\n", ""))))


_FIELD = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE octet_length(encode(CAST({v} AS VARCHAR))) || ':' || {v} END"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
SQL = f"""
WITH RECURSIVE d AS (SELECT *, replace(text, chr(10), '') AS other_text, [ord(x) for x in string_split(CAST(doc_id AS VARCHAR), '')] AS digits FROM documents),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten([[x::BIGINT, 0, 0, 0, 0, 0, 0, 0] for x in digits])), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) AS c FROM d),
leaves AS (SELECT doc_id, coalesce('.' || source, '') AS tree, {_LEAF("text")} AS leaf, CASE WHEN c % 2 = 0 AND text IS NOT NULL THEN {_LEAF("other_text")} ELSE {_LEAF("text")} END AS other FROM crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER () AS rid FROM leaves),
up AS (SELECT tree, 0 AS h, pos, n, leaf AS d FROM placed UNION ALL SELECT tree, h + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY tree, h, pos // 3, n),
subs AS (SELECT tree, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS h, pos, n, subroot AS d FROM subs UNION ALL SELECT h + 1, pos // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY h, pos // 3, n),
nodes AS (SELECT 'tree' || tree AS tree, h, pos, n, d FROM up UNION ALL SELECT 'top', h, pos, n, d FROM top),
beside AS (SELECT a.tree, a.h, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM nodes a LEFT JOIN nodes b ON a.tree = b.tree AND a.h = b.h AND a.pos // 3 = b.pos // 3 AND a.pos <> b.pos WHERE a.n > 1 GROUP BY 1, 2, 3),
steps AS (SELECT rid, h, l, r FROM placed p JOIN beside b ON b.tree = 'tree' || p.tree AND b.pos = p.pos // CAST(3 ** b.h AS BIGINT)
  UNION ALL SELECT rid, 1000 + h, l, r FROM placed p JOIN subs s ON p.tree = s.tree JOIN beside b ON b.tree = 'top' AND b.pos = s.pos // CAST(3 ** b.h AS BIGINT)),
paths AS (SELECT rid, list(l || '|' || r ORDER BY h) AS path, string_agg(l || r, '' ORDER BY h) AS siblings FROM steps GROUP BY rid),
folded AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256, list_reduce(list_prepend(p.other, coalesce(path, [])), lambda c, x: sha256(split_part(x, '|', 1) || c || split_part(x, '|', 2))) AS folded_root
  FROM placed p JOIN subs s ON p.tree = s.tree LEFT JOIN paths USING (rid))
SELECT *, folded_root = root AS verified FROM folded
"""
