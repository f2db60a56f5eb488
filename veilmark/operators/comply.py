"""Compliance: from the types found to rules, relevance and exposure."""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Window, functions as F

from veilmark import vocab
from veilmark.functions.arrays import let, quoted, text_list
from veilmark.operators.nearest import nearest_of_groups
from veilmark.schemas import MATCH
from veilmark.session import stored
from veilmark.sources.rules import TERM, rule_documents, rule_list, rule_text, term_vectors

RELEVANCE_DIGITS = 3
# Relevance is compared at this precision, so that sums taken in another order
# cannot swap two equally relevant rules.
RANK_DIGITS = 9


def query_text_sql(types):
    """The search text of a set of types; null for an empty set."""
    return (
        f"CASE WHEN size({types}) > 0 "
        f"THEN concat({quoted(vocab.QUERY_PREFIX)}, array_join({types}, ', ')) END"
    )


def query_text(df, types="entity_types"):
    return df.withColumn("query_text", F.expr(query_text_sql(types)))


def distinct_sets(df, types="entity_types"):
    """The non-empty sets of types, each once.

    Empty sets go by way of the generator: a filter would be pushed below the
    detection and evaluate it again.
    """
    some = f"CASE WHEN size({types}) > 0 THEN array({types}) ELSE array() END"
    return df.select(F.explode(F.expr(some)).alias(types)).distinct()


# ---- exact match ----------------------------------------------------------
def _rule_structs(rules):
    def one(r):
        return (
            f"named_struct('id', {quoted(r['id'])}, 'framework', {quoted(r['framework'])}, "
            f"'rule', {quoted(r['rule'])}, 'description', {quoted(r['description'])}, "
            f"'entity_types', array({text_list(r['entity_types'])}), 'risk', {quoted(r['risk'])})"
        )

    return f"array({', '.join(map(one, rules))})"


def rules_by_type(df, rules=None, types="entity_types"):
    """Rules that name a found type, with the types they share; no shuffle."""
    matched = (
        f"transform(filter({_rule_structs(rule_list(rules))}, "
        f"_r -> arrays_overlap(_r.entity_types, {types})), _r -> named_struct('rule_id', _r.id, "
        "'framework', _r.framework, 'rule', _r.rule, 'risk', _r.risk, "
        f"'matched_types', array_sort(array_intersect(_r.entity_types, {types}))))"
    )
    return df.select("doc_id", F.inline(F.expr(matched)))


# ---- term vectors, rules held in the plan ---------------------------------
def terms_of(text):
    return re.findall(TERM, text.lower())


def inverse_frequency(n, df):
    return math.log((1 + n) / (1 + df)) + 1


def _type_table(rules):
    """Per type, in order: (products with every rule vector, products with every type).

    A search text is the fixed prefix and the names of its types, so its vector is
    the sum of theirs.  Its product with a rule is a sum over types, and its squared
    length a sum over pairs of types.  The prefix comes first, as the type "".
    """
    counts = [Counter(terms_of(rule_text(r))) for r in rules]
    df = Counter(t for c in counts for t in c)
    idf = {t: inverse_frequency(len(rules), n) for t, n in df.items()}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items())) for c in counts]
    names = sorted(set(vocab.CATEGORY_TABLE) | {k for r in rules for k in r["entity_types"]})
    parts = {"": Counter(terms_of(vocab.QUERY_PREFIX))}
    parts.update((name, Counter(terms_of(name))) for name in names)
    weighted = {
        name: {t: n * idf[t] for t, n in c.items() if t in idf} for name, c in parts.items()
    }
    return {
        name: (
            [sum(x * c[t] * idf[t] for t, x in w.items()) / n for c, n in zip(counts, norms)],
            [sum(x * other.get(t, 0) for t, x in w.items()) for other in weighted.values()],
        )
        for name, w in weighted.items()
    }


def ranked_sql(types, rules):
    """All rules for a set of types, best first: array of (rank, i, relevance).

    Works on the row's own set, so a set shared by very many documents is never
    gathered.  Rules without a common term count too, with relevance 0.  Types that
    neither the category table nor a rule lists add nothing.
    """

    def doubles(values):
        return f"array({', '.join(f'{float(v)!r}D' for v in values)})"

    table = ", ".join(
        f"{quoted(name)}, named_struct('i', {i}, 'by_rule', {doubles(by_rule)}, "
        f"'by_type', {doubles(by_type)})"
        for i, (name, (by_rule, by_type)) in enumerate(_type_table(rules).items())
    )
    parts = (
        "filter(transform(concat(array(''), _ty), _t -> try_element_at("
        f"map({table}), _t)), _t -> _t IS NOT NULL)"
    )
    square = (
        "aggregate(_pt, 0D, (_s, _u) -> _s + "
        "aggregate(_pt, 0D, (_m, _o) -> _m + get(_u.by_type, _o.i)))"
    )
    products = (
        f"aggregate(_pt, array_repeat(0D, {len(rules)}), "
        "(_s, _u) -> zip_with(_s, _u.by_rule, (_m, _w) -> _m + _w))"
    )
    scored = (
        "transform(_q.products, (_d, _i) -> named_struct('neg', "
        f"CASE WHEN _q.square > 0 THEN -round(_d / sqrt(_q.square), {RANK_DIGITS}) ELSE 0D END, "
        "'i', _i))"
    )
    best = (
        f"transform(array_sort({scored}), (_b, _k) -> named_struct('rank', _k + 1, 'i', _b.i, "
        f"'relevance', round(-_b.neg, {RELEVANCE_DIGITS}) + 0D))"
    )
    query = f"named_struct('products', {products}, 'square', {square})"
    body = let("_pt", parts, let("_q", query, best))
    nothing = "cast(array() AS array<struct<rank:int,i:int,relevance:double>>)"
    return let("_ty", types, f"CASE WHEN size(_ty) > 0 THEN {body} ELSE {nothing} END")


def matches_sql(ranked, rules, k):
    """The first ``k`` ranked rules in full."""
    full = _rule_structs(rules)
    row = let(
        "_f",
        f"get({full}, _z.i)",
        "named_struct('rank', _z.rank, 'id', _f.id, 'framework', _f.framework, 'rule', _f.rule, "
        "'description', _f.description, 'entity_types', _f.entity_types, 'risk', _f.risk, "
        "'relevance', _z.relevance)",
    )
    return f"cast(transform(slice({ranked}, 1, {k}), _z -> {row}) AS array<{MATCH}>)"


def exposure_sql(ranked, rules, k=None):
    """Exposure per framework, highest first: array of (framework, exposure, band).

    The worst rule counts: relevance x risk weight x 100, at most 100, one digit.  Only
    the ``k`` most relevant rules are looked at, all by default.
    """
    frameworks = sorted({r["framework"] for r in rules})
    by_rule = ", ".join(
        f"named_struct('fw', {quoted(r['framework'])}, 'w', "
        f"{vocab.RISK_WEIGHTS.get(r['risk'], vocab.RISK_WEIGHT_OTHER)}D)"
        for r in rules
    )
    scores = (
        f"transform(filter({ranked}, _z -> _z.rank <= {len(rules) if k is None else k}), "
        f"_z -> named_struct('r', get(array({by_rule}), _z.i), 'rel', _z.relevance))"
    )
    worst = (
        "array_max(transform(filter(_sc, _x -> _x.r.fw = _fw), _x -> _x.rel * _x.r.w * 100))"
    )
    capped = "CASE WHEN _mx > 100 THEN 100D ELSE _mx END"
    rows = (
        f"filter(transform(array({text_list(frameworks)}), _fw -> "
        + let("_mx", worst, f"named_struct('neg', -round({capped}, 1), 'framework', _fw)")
        + "), _x -> _x.neg IS NOT NULL)"
    )
    named = (
        f"transform(array_sort({rows}), _x -> named_struct('framework', _x.framework, "
        f"'exposure', -_x.neg, 'band', {band_sql('(-_x.neg)')}))"
    )
    return let("_sc", scores, named)


def band_sql(exposure):
    steps = " ".join(f"WHEN {exposure} > {limit} THEN '{name}'" for limit, name in vocab.BANDS)
    return f"CASE {steps} ELSE '{vocab.BAND_ELSE}' END"


def exposure_band(df, exposure="exposure"):
    return df.withColumn("band", F.expr(band_sql(exposure)))


def with_ranking(df, rules=None, types="entity_types"):
    """Add ``ranked``, all rules in order of relevance to the row's types."""
    return df.withColumn("ranked", F.expr(ranked_sql(types, rule_list(rules))))


def retrieve_rules(df, rules=None, k=vocab.TOP_RULES, types="entity_types"):
    """The ``k`` most relevant rules of every document, one row each."""
    listed = rule_list(rules)
    ranked = df.select("doc_id", F.expr(ranked_sql(types, listed)).alias("ranked"))
    return ranked.select("doc_id", F.inline(F.expr(matches_sql("ranked", listed, k))))


def exposure(df, rules=None, types="entity_types", k=None):
    """Exposure and band of every document and framework, from the ``k`` most relevant
    rules, all by default."""
    listed = rule_list(rules)
    ranked = df.select("doc_id", F.expr(ranked_sql(types, listed)).alias("ranked"))
    return ranked.select("doc_id", F.inline(F.expr(exposure_sql("ranked", listed, k))))


def rank_frameworks(df, rules=None, types="entity_types"):
    """Frameworks of every document by falling exposure, ties by name."""
    listed = rule_list(rules)
    ranked = df.select("doc_id", F.expr(ranked_sql(types, listed)).alias("ranked"))
    return ranked.select(
        "doc_id", F.posexplode(F.expr(exposure_sql("ranked", listed))).alias("pos", "x")
    ).select(
        "doc_id", (F.col("pos") + 1).alias("rank"), "x.framework", "x.exposure", "x.band"
    )


# ---- term vectors, rules as a table ---------------------------------------
# Copies of a term's rule vectors; queries that share a term are dealt out to them.
TERM_SALTS = 8


def term_cosine_topk(queries, documents, k=vocab.TOP_RULES, vectors=None):
    """Most similar rule documents of every query text, by TF-IDF cosine.

    ``queries`` (query_id, text), ``documents`` (rule_id, document); ``vectors`` may hold
    a table from ``rule_vectors`` that was written before.  Candidates come from an
    equi-join on terms, with each term in ``TERM_SALTS`` copies, so that one in every query
    is no single key; the products are summed before and after the shuffle, and only the
    best ``k`` of a query are gathered.  Documents without a common term fill the places
    left, in order of id.  Queries are read once: the square of a query's own weight
    travels with the products, as a row without rule.
    """
    unit = (term_vectors(documents) if vectors is None else vectors).select("term", "rule_id", "idf", "rw")
    own = unit.select("term", F.lit(None).cast("string").alias("rule_id"), "idf", F.col("idf").alias("rw")).distinct()
    known = unit.unionByName(own).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    asked = (
        queries.select("query_id", F.explode_outer(words).alias("term"))
        .groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    )
    products = (
        asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(TERM_SALTS)).cast("int"))
        .join(known, ["term", "salt"], "left")
        .withColumn("qw", F.col("qtf") * F.col("idf"))
        .groupBy("query_id", "rule_id")
        .agg(
            F.sum(
                F.when(F.col("rule_id").isNull(), F.col("qw") * F.col("qw"))
                .otherwise(F.col("qw") * F.col("rw"))
            ).alias("dot")
        )
    )
    whole = Window.partitionBy("query_id")
    scored = products.withColumn(
        "norm", F.sqrt(F.max(F.when(F.col("rule_id").isNull(), F.col("dot"))).over(whole))
    ).select(
        "query_id", "rule_id",
        F.when(
            F.col("rule_id").isNotNull(), -F.round(F.col("dot") / F.col("norm"), RANK_DIGITS)
        ).alias("neg"),
    )
    return ranked_and_filled(scored, documents, k)


def ranked_and_filled(scored, documents, k):
    """The ``k`` best rules of each query, of ``query_id, rule_id, neg`` (the falling score, and
    a row without rule for each query); the first ids fill the places left."""
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_first("neg"), "rule_id")
    best = (
        scored.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= k + 1)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("neg", "rule_id"))).alias("all"))
    )
    # The first ids are enough to fill up any query: at most k others precede.
    first_ids = documents.select("rule_id").orderBy("rule_id").limit(2 * k)
    filled = best.withColumn(
        "ids", first_ids.agg(F.array_sort(F.collect_list("rule_id"))).scalar()
    ).withColumn("hits", F.expr("filter(all, _h -> _h.rule_id IS NOT NULL AND _h.neg < 0)"))
    fill = (
        "transform(array_except(ids, transform(hits, _h -> _h.rule_id)), "
        "_i -> named_struct('neg', 0D, 'rule_id', _i))"
    )
    return filled.select(
        "query_id", F.posexplode(F.expr(f"slice(concat(hits, {fill}), 1, {k})")).alias("pos", "x")
    ).select(
        "query_id",
        (F.col("pos") + 1).alias("rank"),
        "x.rule_id",
        (F.round(-F.col("x.neg"), RELEVANCE_DIGITS) + 0.0).alias("relevance"),
    )


def _keyed(sets, types):
    """``doc_id`` and types, stored: findings that sets come from are looked for once, though
    the sets are read twice."""
    return stored(sets.select("doc_id", types), "sets")


def _by_table(sets, rules, k, types):
    """(query_id, rank, rule_id, relevance) of each distinct set of types."""
    asked = query_text(distinct_sets(sets, types), types).select(
        F.array_join(types, ", ").alias("query_id"), F.col("query_text").alias("text")
    )
    documents = rule_documents(rules).select(F.col("id").alias("rule_id"), "document")
    return term_cosine_topk(asked, documents, k)


def retrieve_table(sets, rules, k=vocab.TOP_RULES, types="entity_types"):
    """As ``retrieve_rules``, with a table of rules of any size."""
    sets = _keyed(sets, types)
    found = _by_table(sets, rules, k, types).join(rules.withColumnRenamed("id", "rule_id"), "rule_id")
    keyed = sets.select("doc_id", F.array_join(types, ", ").alias("query_id"))
    return keyed.join(found.withColumnRenamed(types, f"rule_{types}"), "query_id").drop("query_id")


def exposure_table(sets, rules, k, types="entity_types"):
    """As ``exposure``, with a table of rules of any size; the ``k`` most relevant rules
    of a set of types are looked at."""
    sets = _keyed(sets, types)
    weights = F.create_map(*[F.lit(x) for pair in vocab.RISK_WEIGHTS.items() for x in pair])
    weighed = rules.select(
        F.col("id").alias("rule_id"), "framework",
        F.coalesce(weights[F.col("risk")], F.lit(vocab.RISK_WEIGHT_OTHER)).alias("weight"),
    )
    worst = (
        _by_table(sets, rules, k, types).join(weighed, "rule_id")
        .groupBy("query_id", "framework")
        .agg(F.round(F.least(F.lit(100.0), F.max(F.col("relevance") * F.col("weight") * 100)), 1).alias("exposure"))
    )
    keyed = sets.select("doc_id", F.array_join(types, ", ").alias("query_id"))
    return exposure_band(keyed.join(worst, "query_id").select("doc_id", "framework", "exposure"))


# ---- dense vectors --------------------------------------------------------
# Bytes of vectors in one block of the collection, by Spark's estimate of its size.
BLOCK_BYTES = 16 << 20
# Bytes of queries that meet one copy of a block, by an estimate that may be far above them.
QUERY_BYTES = 128 << 20


def _norm(v):
    return f"sqrt(aggregate({v}, 0D, (_s, _x) -> _s + _x * _x))"


def cosine_topk(queries, collection, k, block_bytes=BLOCK_BYTES):
    """The ``k`` nearest vectors of ``collection`` for every query, by cosine.

    ``queries`` (query_id, vec), ``collection`` (id, vec).  The collection is cut into
    blocks of about ``block_bytes``, by number; each query meets each block once, dealt out
    over copies of it.  There are no more blocks than tasks while these stay within
    ``BLOCK_BYTES`` each.  Only the best ``k`` of a block leave a task, never all pairs.
    """

    def prepared(df, key):
        vec = df.select(key, F.col("vec").cast("array<double>").alias("vec"))
        return vec.withColumn("norm", F.expr(_norm("vec")))

    asked, known = prepared(queries, "query_id"), prepared(collection, "id")
    size = int(str(collection._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    blocks = max(1, math.ceil(size / block_bytes))
    session = queries.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    if size >= 1 << 60:  # Spark has no estimate for this source
        blocks = tasks
    else:
        blocks = min(blocks, max(tasks, math.ceil(size / BLOCK_BYTES)))
    held = int(str(queries._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    copies = max(math.ceil(tasks / blocks), math.ceil(held / QUERY_BYTES) if held < 1 << 60 else tasks)
    known = (
        known.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    )
    asked = (
        asked.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int"))
    )
    near = nearest_of_groups(asked, known, ["b", "salt"], k, RANK_DIGITS)
    near = near.select("query_id", F.struct("distance", "id").alias("x"))
    order = Window.partitionBy("query_id").orderBy("x.distance", "x.id")
    best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(
        "query_id", "rank", F.col("x.id").alias("id"),
        # Adding zero turns a negative zero into a plain one.
        (F.round(1 - F.col("x.distance"), RELEVANCE_DIGITS) + 0.0).alias("relevance"),
    )
