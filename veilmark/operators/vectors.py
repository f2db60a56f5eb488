"""An inverted-file index of dense vectors: cells around centres, searched by equi-joins.

Centres are fitted by k-means on a bounded sample; every vector is assigned to the cell of its
nearest centre.  A query looks into the cells whose centres are nearest, and what they hold is
ranked exactly.  How many cells that takes is measured against the exact answer
(``calibrated``), or all cells are searched that can still hold a better vector (``exact``).

Cells are cut into blocks of bounded size and blocks are copied where many queries meet
them, so neither a cell with a third of all vectors nor one that a third of all queries
asks for is a single key.

Defined results: vectors without length are as far from everything as unrelated ones, and
kept in a cell of their own that every query looks into; rows without a vector are left
out; repeated ids count each; ties go to the smaller id; with an empty collection nothing is
found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilmark.operators.comply import RANK_DIGITS, RELEVANCE_DIGITS, cosine_topk
from veilmark.operators.nearest import nearest_of_groups
from veilmark.session import stored

#: Vectors that centres are fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Most centres; by default the square root of the number of vectors.
CELLS = 4096
#: Vectors of one block, and queries that meet one copy of it.
BLOCK_ROWS = 2048
COPY_QUERIES = 4096
#: Cells that a query looks into, unless measured.
PROBES = 8
#: Vectors whose exact neighbours are held against the index, and the recall aimed at.
TRIALS = 200
RECALL = 0.95
#: The cell of vectors without length.
NOWHERE = -1


@dataclass(frozen=True)
class VectorIndex:
    """``centres``: cell, vec; ``cells``: cell, n, radius (the widest angle to the centre),
    parts; ``rows``: id, vec, norm, cell, part."""

    centres: DataFrame
    cells: DataFrame
    rows: DataFrame
    probes: int = PROBES


def _norm(v):
    return f"sqrt(aggregate({v}, 0D, (_s, _x) -> _s + _x * _x))"


def _cosine(a, b):
    dot = f"aggregate(zip_with({a}.vec, {b}.vec, (_x, _y) -> _x * _y), 0D, (_s, _x) -> _s + _x)"
    return f"CASE WHEN {a}.norm * {b}.norm > 0 THEN {dot} / ({a}.norm * {b}.norm) ELSE 0D END"


def prepared(df, key):
    """A key, its vector as doubles and the vector's length."""
    vec = df.where("vec IS NOT NULL").select(key, F.col("vec").cast("array<double>").alias("vec"))
    return vec.withColumn("norm", F.expr(_norm("vec")))


def _angle(cosine):
    return f"acos(greatest(-1D, least(1D, {cosine})))"


def build(collection, cells=None, sample=SAMPLE, block_rows=BLOCK_ROWS, seed=7):
    """The index of ``collection`` (id, vec), stored in the shared folder."""
    known = prepared(collection, "id")
    count = known.count()
    wanted = cells or max(1, min(CELLS, math.isqrt(count)))
    chosen = known.where("norm > 0").select(array_to_vector("vec").alias("features"), F.xxhash64("id").alias("h"))
    chosen = stored(chosen.orderBy("h").limit(sample), "sample")
    session = collection.sparkSession
    if chosen.isEmpty():
        fitted, assigned = [], known.withColumn("cell", F.lit(NOWHERE))
    else:
        # One cell is not a choice that k-means has; of equal vectors it makes fewer.
        means = KMeans(k=max(2, min(wanted, chosen.count())), distanceMeasure="cosine", seed=seed, maxIter=10)
        model = means.fit(chosen.select("features"))
        fitted = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
        placed = model.setPredictionCol("cell").transform(
            known.where("norm > 0").withColumn("features", array_to_vector("vec"))
        ).drop("features")
        assigned = placed.unionByName(known.where("norm = 0").withColumn("cell", F.lit(NOWHERE)))
    centres = stored(session.createDataFrame(fitted, "cell INT, vec ARRAY<DOUBLE>"), "centres")

    # Centres are few and bounded; the far side of the join is.
    own = prepared(centres, "cell").select("cell", F.struct("vec", "norm").alias("c"))
    own = assigned.join(F.broadcast(own), "cell", "left").withColumn("v", F.struct("vec", "norm"))
    angle = F.when(F.col("c").isNotNull(), F.expr(_angle(_cosine("v", "c")))).otherwise(math.pi)
    rows = stored(own.select("id", "vec", "norm", "cell", angle.alias("angle")), "vectors")
    held = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    held = stored(held.withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")), "cells")
    dealt = rows.join(F.broadcast(held.select("cell", "parts")), "cell")
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    return VectorIndex(centres, held, dealt.select("id", "vec", "norm", "cell", part.alias("part")))


def _searched(index, asked, k):
    """The ``k`` best of each block: query_id, distance, id.  ``asked``: query_id, vec, norm, cell."""
    met = asked.groupBy("cell").agg(F.count("*").alias("asks"))
    shape = index.cells.join(met, "cell").select(
        "cell", "parts", F.ceil(F.col("asks") / COPY_QUERIES).cast("int").alias("copies")
    )
    shape = F.broadcast(stored(shape, "shape"))
    copy = F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("copy")
    queries = asked.join(shape, "cell").select(
        "query_id", "vec", "norm", "cell", copy,
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
    )
    blocks = index.rows.join(shape, "cell").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    blocks = blocks.select("cell", "part", "copy", "id", "vec", "norm")
    return nearest_of_groups(queries, blocks, ["cell", "part", "copy"], k, RANK_DIGITS)


def _first(found, k):
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cells_near(index, asked, probes):
    """query_id, rank, cell: the cells with the nearest centres."""
    near = cosine_topk(asked.select("query_id", "vec"), index.centres.select(F.col("cell").alias("id"), "vec"), probes)
    return near.select("query_id", "rank", F.col("id").alias("cell"))


def _with_nowhere(cells, asked):
    return cells.select("query_id", "cell").unionByName(asked.select("query_id", F.lit(NOWHERE).alias("cell")))


def search(index, queries, k, probes=None, exact=False):
    """``query_id, rank, id, relevance``: the ``k`` nearest vectors of each query.

    ``queries`` (query_id, vec), each id once.  The ``probes`` nearest cells are searched; with
    ``exact`` then also every cell that can hold a vector as near as the k-th found: the angle
    to its centre less the cell's radius bounds the angle to all it holds.
    """
    asked = stored(prepared(queries, "query_id"), "asked")
    probed = stored(_with_nowhere(_cells_near(index, asked, probes or index.probes), asked), "probed")
    # To a query without length all vectors are equally far: it looks everywhere.
    idle = asked.where("norm = 0").select("query_id")
    found = _first(_searched(index, asked.join(probed, "query_id"), k), k)
    if exact:
        found = stored(found.select("query_id", "distance", "id"), "found")
        kth = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        limit = F.when((F.col("n") >= k) & (F.col("norm") > 0), F.col("far")).otherwise(3.0)
        open_ = asked.join(kth, "query_id", "left").withColumn("limit", F.coalesce(limit, F.lit(3.0)))
        rest = _open_cells(index, open_).join(probed, ["query_id", "cell"], "left_anti")
        more = _searched(index, asked.join(rest, "query_id"), k)
        found = _first(found.unionByName(more), k)
    elif not idle.isEmpty():
        every = _open_cells(index, asked.where("norm = 0").withColumn("limit", F.lit(3.0)))
        every = every.join(probed, ["query_id", "cell"], "left_anti")
        more = _searched(index, asked.join(every, "query_id"), k)
        found = _first(found.select("query_id", "distance", "id").unionByName(more), k)
    return found.select(
        "query_id", "rank", "id", (F.round(1 - F.col("distance"), RELEVANCE_DIGITS) + 0.0).alias("relevance")
    )


def _open_cells(index, asked):
    """query_id, cell: cells that can hold a vector within ``limit`` of the query.

    Centres go to the queries as one bounded array, in blocks of ``BLOCK_ROWS``.
    """
    centres = prepared(index.centres, "cell").join(F.broadcast(index.cells), "cell")
    grouped = centres.groupBy(F.floor(F.col("cell") / BLOCK_ROWS).cast("int").alias("b")).agg(
        F.collect_list(F.struct("cell", "vec", "norm", "radius")).alias("block")
    )
    last = F.expr(f"{max(0, CELLS - 1) // BLOCK_ROWS}")
    nearest = f"greatest(0D, {_angle(_cosine('q', '_c'))} - _c.radius)"
    fits = f"filter(block, _c -> limit >= 2 OR 1 - cos({nearest}) <= limit + 1e-6)"
    spread = asked.select(
        "query_id", F.struct("vec", "norm").alias("q"), "limit", F.explode(F.sequence(F.lit(0), last)).alias("b")
    )
    met = spread.join(F.broadcast(grouped), "b")
    return met.select("query_id", F.explode(F.expr(f"transform({fits}, _c -> _c.cell)")).alias("cell"))


def exact_topk(queries, collection, k):
    """The same answer without an index: all blocks, see ``cosine_topk``."""
    return cosine_topk(queries, collection, k)


def calibrated(index, k, recall=RECALL, trials=TRIALS):
    """The index with the fewest probes that reach ``recall``, as measured on ``trials``
    of its vectors, those with the smallest hashes: their exact neighbours are looked up and
    the rank of each neighbour's cell is counted."""
    tried = index.rows.where("norm > 0").select("id", "vec", F.xxhash64("id", F.lit("trial")).alias("h"))
    tried = stored(tried.orderBy("h", "id").limit(trials).select(F.col("id").alias("query_id"), "vec"), "trials")
    tried = tried.dropDuplicates(["query_id"])
    true = cosine_topk(tried, index.rows.select("id", "vec"), k).select("query_id", "id")
    where = true.join(index.rows.select("id", "cell"), "id").where(f"cell <> {NOWHERE}")
    ranks = _cells_near(index, prepared(tried, "query_id"), CELLS)
    counted = where.join(ranks, ["query_id", "cell"]).groupBy("rank").agg(F.count("*").alias("n")).orderBy("rank")
    counts = [(r["rank"], r["n"]) for r in counted.collect()]
    total, seen = sum(n for _, n in counts), 0
    for rank, n in counts:
        seen += n
        if seen >= recall * total:
            return VectorIndex(index.centres, index.cells, index.rows, rank)
    return index


def recall_of(found, true):
    """The share of the true neighbours that were found."""
    hit = true.join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
