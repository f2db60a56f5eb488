"""Merkle manifest of a table, with inclusion proofs by pointer jumping.

Each row is a leaf.  The leaves of a group are ordered by id; every two consecutive nodes
become one node a level up, a lone last one too, until one is left, the subroot of the
group.  Subroots, ordered by group, are the leaves of the top tree, whose last node is the
root of the table.

1. Leaves are numbered without gathering a group: a range sort by (group, id), counts per
   group and partition, and running sums over those counts.
2. Trees are built eight levels at a time: 256 consecutive nodes meet in one row and give
   all nodes above them.  Nothing larger is ever gathered.
3. Proofs: each node holds the sibling on its way to an ancestor, at first its parent.  A
   self-join by ancestor doubles the distance and appends the ancestor's own segment, so
   after log2(height) joins every leaf holds all siblings up to the root.  Only nodes whose
   level the next joins still ask for are kept.
4. Folding a leaf with its siblings gives a root again, in the leaf's own row.

H of some values is the SHA-256 of their concatenation, digests as lowercase hex text.

Defined results: a null field is hashed as ``-``; null groups are a group of their own,
the first; null ids come first in their group, rows with equal ids are ordered by their
leaf, so repeated rows have equal leaves at places of their own; an empty text is hashed
as ``0:``; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilmark.llm.common import new_folder, small_side, written

#: Levels that are built in one go.
LEVELS = 8
#: The number of the top tree; trees of groups are numbered from 0.
TOP = -1

_SEGMENT = "array<binary>"
# One level up: H of each two neighbours, of the last one alone if it has none.
_UP = (
    "transform(sequence(0, (size({x}) + 1) div 2 - 1), "
    "_j -> sha2(concat(get({x}, 2 * _j), coalesce(get({x}, 2 * _j + 1), '')), 256))"
)
# The sibling of node _j: a byte that says whether it is the left (0) or right (1) one, then
# its digest; nothing for a lone node.
_SIBLING = (
    "CASE WHEN _j % 2 = 1 THEN concat(X'00', unhex(get({x}, _j - 1))) "
    "WHEN get({x}, _j + 1) IS NOT NULL THEN concat(X'01', unhex(get({x}, _j + 1))) ELSE X'' END"
)


def leaf_hash(fields):
    """H of columns or column names: ``-`` for null, else UTF-8 byte count, ``:``, value."""

    def framed(field):
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        counted = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(counted, F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(framed, fields)), 256))


def numbered(rows, group, order):
    """Add ``pos``, the place of each row in its group, from 0, and ``size``, its rows.

    Rows are sorted once, by range; what is summed up are counts per group and partition.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    # The last key lets a range end between equal rows.
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    by.append(F.col("_tie").asc())
    sorted_rows = spread.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    at = F.monotonically_increasing_id()
    placed = written(sorted_rows.select("*", F.spark_partition_id().alias("_part"), at.alias("_at")), "sorted")
    runs = placed.groupBy(*group, "_part").agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    names = ", ".join([*group]) or "1"
    runs = runs.select(
        *[F.col(c).alias(f"_{c}") for c in group],
        F.col("_part").alias("_run"),
        F.col("_low"),
        F.expr(f"sum(_n) OVER (PARTITION BY {names} ORDER BY _part) - _n").alias("_before"),
        F.expr(f"sum(_n) OVER (PARTITION BY {names})").alias("size"),
    )
    runs = small_side(written(runs, "runs"))
    same = placed["_part"] == runs["_run"]
    for c in group:
        same &= placed[c].eqNullSafe(runs[f"_{c}"])
    return placed.join(runs, same).select(
        *[placed[c] for c in rows.columns], (F.col("_at") - F.col("_low") + F.col("_before")).alias("pos"), "size"
    )


def height_of(size):
    """Levels above the leaves of a tree: 0 for one leaf."""
    return f"CASE WHEN {size} > 1 THEN length(bin({size} - 1)) ELSE 0 END"


def _above(leaves, tallest, carried):
    """The levels above the leaves of some trees.

    ``leaves``: tree, pos, height, digest and the ``carried`` columns.  Returns a table of all
    nodes but the last of each tree (tree, level, pos, height, sibling, carried columns, null
    above the leaves) and a table of the last nodes (tree, digest).
    """
    none = {c: f"cast(NULL AS {leaves.schema[c].dataType.simpleString()})" for c in carried}
    steps, roots = [], [leaves.where("height = 0").select("tree", "digest")]
    nodes = leaves.where("height > 0")
    for base in range(0, tallest, LEVELS):
        kept = carried if base == 0 else []
        member = F.struct("pos", F.lower(F.hex("digest")).alias("x"), *kept)
        blocks = nodes.groupBy("tree", "height", F.shiftright("pos", LEVELS).alias("block"))
        blocks = blocks.agg(F.array_sort(F.collect_list(member)).alias("members"))
        blocks = blocks.withColumn("x0", F.col("members.x"))
        for k in range(1, LEVELS + 1):
            blocks = blocks.withColumn(f"x{k}", F.expr(f"CASE WHEN height >= {base + k} THEN {_UP.format(x=f'x{k - 1}')} END"))

        def rows_of(k):
            held = "".join(
                f", '{c}', " + (f"get(members, _j).{c}" if k == 0 and c in kept else none[c]) for c in carried
            )
            row = (
                f"named_struct('level', {base + k}, 'pos', shiftleft(block, {LEVELS - k}) + _j, "
                f"'sibling', {_SIBLING.format(x=f'x{k}')}{held})"
            )
            rows = f"transform(sequence(0, size(x{k}) - 1), _j -> {row})"
            return f"CASE WHEN height > {base + k} THEN {rows} ELSE array() END"

        last = ", ".join(f"x{k}" for k in range(LEVELS, 0, -1))
        built = blocks.select(
            "tree", "height", "block",
            F.expr(f"concat({', '.join(map(rows_of, range(LEVELS)))})").alias("rows"),
            F.expr(f"unhex(get(coalesce({last}), 0))").alias("digest"),
        )
        built = written(built, "levels")
        rows = built.select("tree", "height", F.explode("rows").alias("r"))
        steps.append(rows.select("tree", "r.level", "r.pos", "height", "r.sibling", *[f"r.{c}" for c in carried]))
        over = built.select("tree", "height", F.col("block").alias("pos"), "digest")
        roots.append(over.where(F.col("height") <= base + LEVELS).select("tree", "digest"))
        nodes = over.where(F.col("height") > base + LEVELS)
    if not steps:  # trees of one leaf have no further nodes
        steps = [leaves.where("false").select(
            "tree", F.lit(0).alias("level"), "pos", "height", F.lit(b"").alias("sibling"), *carried
        )]
    return reduce(DataFrame.unionByName, steps), reduce(DataFrame.unionByName, roots)


def _jumped(nodes, hops, carried):
    """The leaves of the groups, with segments that end at the root.

    ``nodes``: tree, level, pos, the ancestor's a_tree, a_level, a_pos (null at the root),
    segment and the carried columns.  After r joins the ancestor is 2^r hops away.  What will
    still be asked for is then at levels that are multiples of 2^r: even multiples go on,
    odd ones are the ancestors of the next join.  The top tree is kept whole.
    """
    spark, reach = nodes.sparkSession, 1
    while reach < hops:
        step, reach = reach, 2 * reach
        role = (
            f"CASE WHEN tree = {TOP} THEN array('left', 'right') WHEN level % {reach} = 0 THEN array('left') "
            f"WHEN level % {reach} = {step} THEN array('right') ELSE array() END"
        )
        path = new_folder(spark, "segments")
        nodes.withColumn("role", F.explode(F.expr(role))).write.partitionBy("role").parquet(path)
        left, right = (_part(spark, nodes.schema, f"{path}/role={side}") for side in ("left", "right"))
        right = small_side(right).select(*[F.col(c).alias(f"r_{c}") for c in nodes.columns if c not in carried])
        moving = left.where("a_tree IS NOT NULL").join(
            right, F.expr("a_tree = r_tree AND a_level = r_level AND a_pos = r_pos")
        )
        nodes = moving.select(
            "tree", "level", "pos", *[F.col(f"r_{c}").alias(c) for c in ("a_tree", "a_level", "a_pos")],
            F.concat("segment", "r_segment").alias("segment"), *carried,
        ).unionByName(left.where("a_tree IS NULL"))
    return nodes.where(f"tree <> {TOP} AND level = 0")


def _part(spark, schema, path):
    """One folder of a partitioned table; it is missing if it would be empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def proofs(rows, group="lang", order="doc_id", leaf="leaf", carry=()):
    """The rows with their inclusion proofs: the columns ``group``, ``order``, ``leaf`` and
    ``carry``, then ``subroot``, ``root`` (digests) and ``proof``, the siblings from leaf to
    root, each a side byte and a digest, or nothing where a node had no sibling."""
    names = [group, order, leaf, *carry]
    own = [f"c{i}" for i in range(len(names))]
    rows = written(rows.select(*[F.col(c).alias(x) for c, x in zip(names, own)]), "leaves")
    placed = written(numbered(rows, ["c0"], ["c1", "c2"]), "placed")
    groups = written(placed.groupBy("c0").agg(F.count("*").alias("n")), "groups")
    groups = numbered(groups, [], ["c0"])
    groups = groups.select(
        F.col("c0").alias("grp"), F.col("pos").alias("tree"), F.expr(height_of("n")).alias("height"), "size"
    )
    groups = written(groups, "groups")
    tallest, width = groups.agg(F.coalesce(F.max("height"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    top = (width - 1).bit_length() if width else 0

    trees = small_side(groups.select("grp", "tree", "height"))
    leaves = placed.join(trees, placed["c0"].eqNullSafe(trees["grp"]))
    leaves = leaves.select("tree", "pos", "height", F.col("c2").alias("digest"), *own)
    nodes, subroots = _above(leaves, tallest, own)
    subroots = written(subroots, "subroots")
    crown = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(top).alias("height"), "digest")
    upper, root = _above(crown, top, [])
    root = root.first()
    root = F.lit(None).cast("binary") if root is None else F.lit(bytes(root.digest))

    # An ancestor above the last node of a group is that group's leaf in the top tree.
    out = f"level + 1 = height AND tree <> {TOP}"
    end = f"level + 1 = height AND tree = {TOP}" if top else "level + 1 = height"
    ancestor = [
        F.expr(f"CASE WHEN {end} THEN NULL WHEN {out} THEN {TOP}L ELSE tree END").alias("a_tree"),
        F.expr(f"CASE WHEN {end} THEN NULL WHEN {out} THEN 0 ELSE level + 1 END").alias("a_level"),
        F.expr(f"CASE WHEN {end} THEN NULL WHEN {out} THEN tree ELSE shiftright(pos, 1) END").alias("a_pos"),
    ]
    for c in own:
        upper = upper.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    nodes = nodes.unionByName(upper).select("tree", "level", "pos", *ancestor, F.array("sibling").alias("segment"), *own)
    # The one leaf of a group is that group's leaf in the top tree.
    known = "tree" if top else "NULL"
    alone = leaves.where("height = 0").select(
        "tree", F.lit(0).alias("level"), "pos",
        F.expr(f"{TOP}L" if top else "cast(NULL AS bigint)").alias("a_tree"),
        F.expr("0" if top else "cast(NULL AS int)").alias("a_level"),
        F.expr(f"cast({known} AS bigint)").alias("a_pos"),
        F.expr(f"cast(array() AS {_SEGMENT})").alias("segment"), *own,
    )
    found = _jumped(nodes.unionByName(alone), max(tallest, 1) + top, own)
    ends = small_side(subroots.select(F.col("tree").alias("r_tree"), "digest"))
    found = found.join(ends, found["tree"] == ends["r_tree"])
    return found.select(
        *[F.col(x).alias(c) for c, x in zip(names, own)], F.col("digest").alias("subroot"), root.alias("root"),
        F.col("segment").alias("proof"),
    )


def fold(leaf, proof="proof"):
    """The root that a leaf and the siblings of a proof give, as lowercase hex."""
    sibling = "lower(hex(substring(_s, 2)))"
    step = (
        f"CASE WHEN length(_s) = 0 THEN sha2(_d, 256) WHEN hex(substring(_s, 1, 1)) = '00' "
        f"THEN sha2(concat({sibling}, _d), 256) ELSE sha2(concat(_d, {sibling}), 256) END"
    )
    return F.expr(f"aggregate({proof}, lower(hex({leaf})), (_d, _s) -> {step})")


def proof_hash(proof="proof"):
    """H of the siblings of a proof, in order."""
    return F.expr(f"sha2(array_join(transform({proof}, _s -> lower(hex(substring(_s, 2)))), ''), 256)")
