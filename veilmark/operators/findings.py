"""Operators on findings: union, filters, overlap scan, counts.

The in-row forms work on the ``hits`` array of a document; the table forms serve
findings that arrive by a join (dictionary terms, model output).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.arrays import empty, let, quoted, scan
from veilmark.functions.filters import filter_of, may_hold
from veilmark.operators.recognize import (
    ALL_LAYERS,
    category_of,
    hits_sql,
    inline_hits,
    is_denied,
)
from veilmark.schemas import FINDING_COLUMNS, HIT, LAYER_SPAN, LAYERS
from veilmark.session import fits_broadcast, stored


# ---- in-row forms ---------------------------------------------------------
def keep_listed(hits):
    """Drop denylisted values and types without a category."""
    return f"filter({hits}, _kl -> NOT ({is_denied('_kl.value')}) AND _kl.category <> 'Other')"


def resolve_hits(hits, ddl=HIT):
    """Overlap scan by (start, falling score, arrival).

    A hit that starts at or after the last accepted end is accepted.  Otherwise
    it replaces the last accepted hit if its score is strictly higher; the end is
    *not* moved then, so a longer winner may overlap the next accepted hit.
    """

    def step(s, h):
        opens = f"{h}.st >= {s}.le"
        state = (
            f"named_struct('le', CASE WHEN {opens} THEN {h}.en ELSE {s}.le END, "
            f"'top', CASE WHEN {opens} OR {h}.sc > {s}.top.sc THEN {h} ELSE {s}.top END)"
        )
        return state, f"{opens} AND {s}.top IS NOT NULL", f"{s}.top"

    def last(s):
        return f"CASE WHEN {s}.top IS NULL THEN {empty(ddl)} ELSE array({s}.top) END"

    zero = f"named_struct('le', -1, 'top', cast(NULL AS {ddl}))"
    # Hits that do not overlap are all accepted; -1 stands for any that do, or lack a place.
    whole = "_re >= 0 AND _x.st >= _re AND _x.en IS NOT NULL"
    apart = f"aggregate(_so, 0, (_re, _x) -> CASE WHEN {whole} THEN _x.en ELSE -1 END) >= 0"
    return let("_so", f"array_sort({hits})", f"CASE WHEN {apart} THEN _so ELSE {scan('_so', zero, step, ddl, last)} END")


def detect_sql(text, recognizers=None, more=None):
    """Findings of one text: recognize, drop denied and Other, resolve overlaps.

    ``more`` names a column of further hits, from ``attach_findings``.
    """
    wanted = ALL_LAYERS if recognizers is None else recognizers
    # A type outside the category table could only be dropped again.
    wanted = [
        r for r in wanted
        if r.entity_type is None
        or {r.entity_type, r.entity_type.lower()} & set(vocab.CATEGORY_TABLE)
    ]
    hits = hits_sql(text, wanted)
    return resolve_hits(keep_listed(f"concat({hits}, {more})" if more else hits))


def with_findings(docs, recognizers=None, text="text", more=()):
    """Add the column ``hits``: the resolved findings, in order of position.

    ``more`` holds findings tables from joins, as for ``detect``.
    """
    if not more:
        return docs.withColumn("hits", F.expr(detect_sql(text, recognizers)))
    joined = attach_findings(docs, reduce(lambda a, b: a.unionByName(b), map(in_order, more)), "_more")
    return joined.withColumn("hits", F.expr(detect_sql(text, recognizers, "_more"))).drop("_more")


def detect(docs, recognizers=None, more=()):
    """Table of findings of every document.

    ``more`` holds findings tables from joins; their sources say which layer they are of.
    Without them the
    scan is one pass with no exchange; with them only findings are shuffled, the
    text stays where it is.
    """
    if not more:
        return inline_hits(docs, detect_sql("text", recognizers))
    own = inline_hits(docs, hits_sql("text", recognizers), order=True)
    every = reduce(lambda a, b: a.unionByName(b), [own, *map(in_order, more)])
    return resolve_overlaps(drop_other(drop_denylisted(every)))


def in_order(findings):
    """A joined findings table with its place in the order of layers, by its source."""
    if "ord" in findings.columns:
        return findings.select(*FINDING_COLUMNS, "ord")
    layer = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])[F.col("source")]
    return findings.select(
        *FINDING_COLUMNS, (layer * F.lit(LAYER_SPAN) + F.lit(LAYER_SPAN // 2)).cast("long").alias("ord")
    )


def attach_findings(docs, findings, column="more"):
    """Put a findings table back on its documents, as an array of HIT structs per row.

    Findings are first cut to one per start, as in ``resolve_overlaps``, gathered by document
    and stored, so they are computed once and their size is known.  Where Spark would broadcast
    them, no text moves.  Beyond that, documents are held against a bit filter of the ids that
    have findings, sized by their number: those that pass are joined by a shuffle, the
    others, which can't have any, stay in their split.  A null id has no findings.
    """
    best = (
        in_order(findings).where("span_end > span_start").groupBy("doc_id", "span_start").agg(
            F.min(
                F.struct(
                    F.col("span_start").alias("st"), (-F.col("score")).alias("neg"), "ord",
                    F.col("span_end").alias("en"), F.col("score").alias("sc"), "entity_type", "category",
                    "value", "risk", "source", "reason",
                )
            ).alias("h")
        )
    )
    gathered = best.groupBy("doc_id").agg(F.collect_list(F.col("h").cast(HIT)).alias(column))
    gathered = stored(gathered, "findings")
    nothing = F.expr(empty(HIT))
    if fits_broadcast(gathered):
        joined = docs.join(F.broadcast(gathered), "doc_id", "left")
        return joined.withColumn(column, F.coalesce(column, nothing))
    count = gathered.count()
    passes = may_hold(filter_of(gathered.select("doc_id"), "doc_id", count), "doc_id", count)
    some = docs.where(passes).join(gathered, "doc_id", "left").withColumn(column, F.coalesce(column, nothing))
    return some.select(*docs.columns, column).unionByName(docs.where(~passes).withColumn(column, nothing))


# ---- table forms ----------------------------------------------------------
def categorize(df, entity_type="entity_type"):
    """Add category, risk and reason of a type column."""
    c = F.expr(category_of(entity_type))
    return df.withColumn("_c", c).select("*", "_c.category", "_c.risk", "_c.reason").drop("_c")


def drop_denylisted(findings):
    return findings.filter(f"NOT ({is_denied('value')})")


def drop_other(findings):
    return findings.filter(F.col("category") != "Other")


def min_score(hits, threshold=vocab.NER_THRESHOLD):
    return hits.filter(F.col("score") >= threshold)


def union_layers(*layers):
    """Concatenate findings tables; the order of the arguments is their rank."""
    ranked = []
    for i, layer in enumerate(layers):
        order = F.col("ord") if "ord" in layer.columns else F.lit(0).cast("long")
        ranked.append(
            layer.select(
                *FINDING_COLUMNS, F.lit(i).alias("layer_rank"), order.alias("ord")
            )
        )
    return reduce(lambda a, b: a.unionByName(b), ranked)


def ranked_layers(docs, recognizers=None):
    """The findings of all recognizers with the rank of their layer, from one scan."""
    found = inline_hits(docs, hits_sql("text", recognizers), order=True)
    return found.withColumn("layer_rank", F.floor(F.col("ord") / LAYER_SPAN).cast("int"))


def resolve_overlaps(findings):
    """Overlap scan over a findings table; same rule as ``resolve_hits``.

    Of hits with the same start only the first in order can ever be accepted
    (spans are not empty), so hits are first cut down to one per document and
    start, partly before the shuffle.  What is then gathered per document has at
    most one entry per character of its text, however many rows came in.
    """
    order = ["layer_rank", "ord"]
    payload = [c for c in findings.columns if c not in ("doc_id", "span_start", "score")]
    best = (
        findings.groupBy("doc_id", "span_start")
        .agg(
            F.min(
                F.struct(
                    (-F.col("score")).alias("neg"),
                    *[F.col(c) for c in order if c in findings.columns],
                    *[F.col(c) for c in payload if c not in order],
                )
            ).alias("b")
        )
        .select(
            "doc_id",
            F.struct(
                F.col("span_start").alias("st"),
                F.col("b.neg").alias("neg"),
                F.col("b.span_end").alias("en"),
                (-F.col("b.neg")).alias("sc"),
                F.col("b").alias("b"),
            ).alias("h"),
        )
    )
    gathered = best.groupBy("doc_id").agg(F.collect_list("h").alias("hits"))
    ddl = gathered.schema["hits"].dataType.elementType.simpleString()
    kept = gathered.select("doc_id", F.inline(F.expr(resolve_hits("hits", ddl))))
    return kept.select(
        *[
            F.col(c) if c == "doc_id"
            else F.col("st").alias(c) if c == "span_start"
            else F.col("sc").alias(c) if c == "score"
            else F.col(f"b.{c}").alias(c)
            for c in findings.columns
            if c not in order or c == "ord"
        ]
    )


# ---- counts ---------------------------------------------------------------
def counts_by(hits, field, names):
    """Map name -> number of hits, zero-filled."""
    pairs = ", ".join(
        f"{quoted(n)}, cast(size(filter({hits}, _f -> _f.{field} = {quoted(n)})) AS bigint)"
        for n in names
    )
    return f"map({pairs})"


def overall_risk(hits):
    """No finding at all is "Low"."""
    return (
        f"CASE WHEN exists({hits}, _f -> _f.risk = 'High') THEN 'High' "
        f"WHEN exists({hits}, _f -> _f.risk = 'Medium') THEN 'Medium' ELSE 'Low' END"
    )


def summary_of(hits):
    return (
        f"named_struct('total', cast(size({hits}) AS bigint), "
        f"'categories', {counts_by(hits, 'category', vocab.CATEGORIES)}, "
        f"'risks', {counts_by(hits, 'risk', vocab.RISKS)}, "
        f"'sources', {counts_by(hits, 'source', vocab.SOURCES)}, "
        f"'overall_risk', {overall_risk(hits)})"
    )


def summarize(df, hits="hits"):
    """One row per document: total, three maps of counts, overall risk."""
    return df.withColumn("_s", F.expr(summary_of(hits))).select("doc_id", "_s.*")


def summarize_table(docs, findings):
    """The same counts from a findings table; documents without a hit included."""

    def tally(column, names):
        return [F.count_if(F.col(column) == n).alias(f"{column}_{n}") for n in names]

    counted = findings.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        *tally("category", vocab.CATEGORIES),
        *tally("risk", vocab.RISKS),
        *tally("source", vocab.SOURCES),
    )

    def as_map(column, names):
        return F.create_map(
            *[
                x
                for n in names
                for x in (F.lit(n), F.coalesce(F.col(f"{column}_{n}"), F.lit(0).cast("long")))
            ]
        ).alias({"category": "categories", "risk": "risks", "source": "sources"}[column])

    return (
        docs.select("doc_id")
        .join(counted, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("total", F.lit(0).cast("long")).alias("total"),
            as_map("category", vocab.CATEGORIES),
            as_map("risk", vocab.RISKS),
            as_map("source", vocab.SOURCES),
            F.when(F.col("risk_High") > 0, "High")
            .when(F.col("risk_Medium") > 0, "Medium")
            .otherwise("Low")
            .alias("overall_risk"),
        )
    )


def corpus_summary(findings):
    """Findings per category and type over all documents, with subtotals."""
    return (
        findings.rollup("category", "entity_type")
        .agg(
            F.count("*").alias("total"),
            *[F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in vocab.RISKS],
            F.max("score").alias("top_score"),
        )
    )


def entity_set_of(hits):
    """Distinct types, sorted: a set has no order, so we fix one."""
    return f"array_sort(array_distinct(transform({hits}, _f -> _f.entity_type)))"


def entity_set(df, hits="hits"):
    return df.select("doc_id", F.expr(entity_set_of(hits)).alias("entity_types"))


def findings_schema():
    """Schema of a findings table, for reading one back."""
    texts = "entity_type STRING, category STRING, value STRING"
    return (
        f"doc_id BIGINT, {texts}, span_start INT, span_end INT, score DOUBLE, "
        "risk STRING, source STRING, reason STRING"
    )
