"""The registered queries: every operator on the given tables or views of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.text import pieces
from veilmark.operators import comply, findings as fd, layers, postings, recognize as rc, report, rewrite, summaries, vectors
from veilmark.plans.scan import scan_documents
from veilmark.session import shared_folder
from veilmark.sources import documents as src, rules as rl, sinks
from veilmark.streaming.scan import read_stream, scan_stream
from workload import fixtures as fx

QUERIES = {}


def query(name=None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        return fn

    return add


# ---- inputs ---------------------------------------------------------------
# The reader cuts tables into splits; a table within this many bytes is a single one.
ONE_SPLIT = 64 << 20
# Bytes of a table that one task gets where short rows become texts, which take far longer.
TASK_BYTES = 1 << 20


def estimated(docs):
    """Spark's estimate of a table's size; no file is listed on the driver."""
    return int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def dealt(docs):
    """Deal out a table of one split, so that its pattern search has more than one core.

    Pattern search is bound by the processor.  Anything larger is read in many splits and
    stays as it is.
    """
    small = estimated(docs) <= ONE_SPLIT
    return docs.repartition(docs.sparkSession.sparkContext.defaultParallelism) if small else docs


def spread(rows, table=None):
    """Deal out rows that become texts, by the size of the table they come from: as they are,
    there are as many tasks as files have row groups or a join leaves, however long each takes."""
    size, tasks = estimated(rows if table is None else table), rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(tasks, -(-size // TASK_BYTES)) if size < 1 << 60 else 8 * tasks)


def memo(spark, d):
    return fx.read(spark, d, fx.MEMO, spread)


def dossier(spark, d):
    return fx.read(spark, d, fx.DOSSIER, spread)


def documents(spark, d):
    return dealt(src.text_source(spark, f"{d}/documents.parquet"))


def notes(spark, d):
    return fx.read(spark, d, fx.NOTES, spread)


def model_hits(spark, d):
    return fx.read(spark, d, fx.MODEL_HITS)


def terms(spark, d):
    return fx.read(spark, d, fx.TERMS).select("term", "entity_type")


def flat(findings):
    return findings.select(
        "doc_id", "entity_type", "category", "value", "span_start", "span_end", "score", "risk",
        "source",
    )


# ---- recognizers ----------------------------------------------------------
def _register_find(name, table, recognizers):
    QUERIES[name] = lambda spark, d: flat(rc.find(table(spark, d), recognizers))


for _r in rc.REGEX_LAYER:
    _register_find(f"find_{_r.name}", memo, [_r])
_register_find("find_regex", memo, rc.REGEX_LAYER)
for _name, _table, _kinds in [
    ("find_email", documents, ["EMAIL_ADDRESS"]),
    ("find_phone", documents, ["PHONE_NUMBER"]),
    ("find_ip", documents, ["IP_ADDRESS"]),
    ("find_card", documents, ["CREDIT_CARD"]),
    ("find_ssn", memo, ["US_SSN"]),
    ("find_driver_license", dossier, ["US_DRIVER_LICENSE"]),
    ("find_passport", dossier, ["US_PASSPORT"]),
    ("find_date", dossier, ["DATE_TIME"]),
    ("find_ip_dossier", dossier, ["IP_ADDRESS"]),
    ("find_medical_license", dossier, ["MEDICAL_LICENSE"]),
    ("find_bank_number", dossier, ["US_BANK_NUMBER"]),
    ("find_iban", dossier, ["IBAN_CODE"]),
    ("find_card_dossier", dossier, ["CREDIT_CARD"]),
    ("find_email_dossier", dossier, ["EMAIL_ADDRESS"]),
]:
    _register_find(_name, _table, rc.by_type(*_kinds))
_register_find("find_rules", memo, rc.RULES_LAYER)
_register_find("find_fields", dossier, rc.LABEL_LAYER)


@query()
def find_dictionary(spark, d):
    return flat(layers.find_dictionary(memo(spark, d), terms(spark, d)))


@query()
def find_dictionary_dossier(spark, d):
    return flat(layers.find_dictionary(dossier(spark, d), terms(spark, d)))


@query()
def chunk_text(spark, d):
    return layers.chunk_text(documents(spark, d))


@query()
def normalize_label(spark, d):
    typed = layers.with_type(model_hits(spark, d))
    return typed.groupBy("label", "entity_type").agg(F.count("*").alias("n"))


@query()
def min_score(spark, d):
    return fd.min_score(model_hits(spark, d)).select("doc_id", "chunk", "label", "score")


@query()
def external_findings(spark, d):
    return flat(layers.external_findings(model_hits(spark, d)))


# ---- findings -------------------------------------------------------------
@query()
def categorize(spark, d):
    found = layers.external_findings(model_hits(spark, d))
    return found.groupBy("entity_type", "category", "risk", "reason").agg(F.count("*").alias("n"))


@query()
def drop_denylisted(spark, d):
    return flat(fd.drop_denylisted(layers.external_findings(model_hits(spark, d))))


@query()
def drop_other(spark, d):
    return flat(fd.drop_other(rc.find_regex(memo(spark, d))))


@query()
def union_layers(spark, d):
    return fd.ranked_layers(memo(spark, d)).select(
        "layer_rank", "doc_id", "entity_type", "category", "value", "span_start", "span_end",
        "score", "risk", "source",
    )


def spans(spark, d):
    return fx.read(spark, d, fx.SPANS).select(
        "doc_id", "ord", F.col("st").alias("span_start"), F.col("en").alias("span_end"),
        F.col("sc").alias("score"),
    )


@query()
def resolve_overlaps(spark, d):
    return fd.resolve_overlaps(spans(spark, d)).select(
        "doc_id", "ord", F.col("span_start").alias("st"), F.col("span_end").alias("en"),
        F.col("score").alias("sc"),
    )


@query()
def detect(spark, d):
    return flat(fd.detect(memo(spark, d)))


@query()
def detect_dossier(spark, d):
    return flat(fd.detect(dossier(spark, d)))


@query()
def detect_documents(spark, d):
    return flat(fd.detect(documents(spark, d)))


@query()
def detect_with_names(spark, d):
    docs = memo(spark, d)
    return flat(fd.detect(docs, more=[layers.find_dictionary(docs, terms(spark, d))]))


@query(name="scan_stream")
def stream_of_documents(spark, d):
    run = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = read_stream(spark, d, "documents.parquet")
    scan_stream(stream, f"{run}/findings", f"{run}/checkpoint")
    return flat(spark.read.schema(fd.findings_schema()).parquet(f"{run}/findings"))


@query()
def stored_findings(spark, d):
    """Findings written by category and read again."""
    path = f"{shared_folder(spark)}/findings-{uuid.uuid4().hex}"
    sinks.write_findings(fd.detect(documents(spark, d)), path)
    return flat(spark.read.schema(fd.findings_schema()).parquet(path))


def flat_summary(summary):
    return summary.select(
        "doc_id",
        "total",
        *[F.col("categories")[c].alias(f"n_{c.lower()}") for c in vocab.CATEGORIES],
        *[F.col("risks")[r].alias(f"n_{r.lower()}") for r in vocab.RISKS],
        *[F.col("sources")[s].alias(f"n_{s}") for s in vocab.SOURCES],
        "overall_risk",
    )


@query()
def summarize(spark, d):
    return flat_summary(fd.summarize(fd.with_findings(memo(spark, d))))


@query()
def summarize_table(spark, d):
    docs = dossier(spark, d)
    return flat_summary(fd.summarize_table(docs, fd.detect(docs)))


@query()
def headline_counts(spark, d):
    return report.headline_counts(fd.summarize(fd.with_findings(memo(spark, d))))


@query()
def corpus_summary(spark, d):
    return fd.corpus_summary(fd.detect(memo(spark, d)))


@query()
def corpus_summary_merged(spark, d):
    """The same from two batches that were summed up apart, the later one twice."""
    folder = f"{shared_folder(spark)}/summary-{uuid.uuid4().hex}"
    for batch in (0, 1, 1):
        summaries.write_partial(fd.detect(memo(spark, d).where(F.col("doc_id") % 2 == batch)), folder, batch)
    return summaries.read_summary(spark, folder).drop("n_documents", "n_values")


def sets(spark, d, table=memo):
    return fd.entity_set(fd.with_findings(table(spark, d)))


@query()
def entity_set(spark, d):
    return sets(spark, d).select("doc_id", F.array_join("entity_types", ", ").alias("types"))


# ---- compliance -----------------------------------------------------------
@query()
def query_text(spark, d):
    return comply.query_text(sets(spark, d)).select("doc_id", "query_text")


@query()
def rules_by_type(spark, d):
    return comply.rules_by_type(sets(spark, d)).withColumn(
        "matched_types", F.array_join("matched_types", ", ")
    )


@query()
def rule_documents(spark, d):
    """Rule texts, with the number of findings each rule speaks of."""
    rules = rl.rule_documents(rl.rules_source(spark))
    kinds = rules.select(F.col("id").alias("rule_id"), "document", F.explode("entity_types").alias("entity_type"))
    found = fd.detect(memo(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))
    return (
        kinds.join(found, "entity_type", "left")
        .groupBy("rule_id", "document").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("findings"))
    )


@query()
def rule_vectors(spark, d):
    """The terms of the rules that speak of found types, written and read again."""
    rules = rl.rules_source(spark)
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    rl.write_rule_vectors(rl.rule_vectors(rules), path)
    found = fd.detect(memo(spark, d)).groupBy("entity_type").agg(F.count("*").alias("n"))
    named = rules.select(F.col("id").alias("rule_id"), F.explode("entity_types").alias("entity_type")).join(found, "entity_type")
    named = named.groupBy("rule_id").agg(F.sum("n").alias("findings"))
    return rl.read_rule_vectors(spark, path).join(named, "rule_id").select(
        "rule_id", "term", F.round("idf", 6).alias("idf"), F.round("rw", 6).alias("rw"), "findings"
    )


@query()
def exposure_table(spark, d):
    """The exposure again, with the rules as a table."""
    return comply.exposure_table(sets(spark, d), rl.rules_source(spark), k=18)


@query()
def term_cosine_topk(spark, d):
    """Each distinct set of types is compared once, however many documents share it."""
    texts = comply.query_text(comply.distinct_sets(sets(spark, d))).select(
        F.array_join("entity_types", ", ").alias("query_id"), F.col("query_text").alias("text")
    )
    rules = rl.rule_documents(rl.rules_source(spark)).select(F.col("id").alias("rule_id"), "document")
    return comply.term_cosine_topk(texts, rules, vocab.TOP_RULES)


@query()
def similar_turns(spark, d):
    """The nearest turns, by their terms, of those of every fiftieth conversation."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select(
        "conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("rule_id"), F.col("text").alias("document")
    )
    asked = turns.where("conv_id % 50 = 0").select(
        F.col("rule_id").alias("query_id"), F.col("document").alias("text")
    )
    return postings.bounded_topk(asked, turns.select("rule_id", "document"), 5)


@query()
def retrieve_rules(spark, d):
    return comply.retrieve_rules(sets(spark, d)).withColumn(
        "entity_types", F.array_join("entity_types", ", ")
    )


@query()
def exposure(spark, d):
    return comply.exposure(sets(spark, d))


@query()
def rank_frameworks(spark, d):
    return comply.rank_frameworks(sets(spark, d))


@query()
def exposure_band(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    scores = events.select("event_id", F.round(F.col("value") * 2, 1).alias("exposure"))
    return comply.exposure_band(scores)


@query()
def cosine_topk(spark, d):
    """Nearest label centres of every vector."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    centres = (
        vectors.select("label", F.posexplode("vec").alias("dim", "x"))
        .groupBy("label", "dim").agg(F.avg("x").alias("c"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "c"))).alias("v"))
        .select(F.col("label").alias("id"), F.col("v.c").alias("vec"))
    )
    return comply.cosine_topk(vectors.select(F.col("vec_id").alias("query_id"), "vec"), centres, 5)


# ---- rewriting ------------------------------------------------------------
@query()
def redact(spark, d):
    return rewrite.redact(fd.with_findings(memo(spark, d))).select("doc_id", "redacted_text")


@query()
def mask(spark, d):
    return rewrite.mask(fd.with_findings(memo(spark, d))).select("doc_id", "masked_text")


@query()
def mask_dossier(spark, d):
    return rewrite.mask(fd.with_findings(dossier(spark, d))).select("doc_id", "masked_text")


@query()
def replace_values(spark, d):
    return rewrite.replace_values(fd.with_findings(dossier(spark, d))).select("doc_id", "replaced_text")


@query()
def redact_documents(spark, d):
    return rewrite.redact(fd.with_findings(documents(spark, d))).select("doc_id", "redacted_text")


def nested(spark, d, extra):
    """All spans of an order up to the fourth by place, as they are."""
    hit = F.struct(
        F.col("span_start").alias("st"), "ord", F.col("span_end").alias("en"),
        F.when(F.col("ord") % 3 == 0, "A").otherwise("B").alias("entity_type"), *extra,
    )
    rows = spans(spark, d).distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    return rows.withColumn("text", F.expr("repeat('ab  c d   ', 6)"))


def overlapping(spark, d):
    """Accepted spans of every order on a short text with blanks, as document rows."""
    kept = fd.resolve_overlaps(spans(spark, d))
    hit = F.struct(
        F.col("span_start").alias("st"),
        F.col("span_end").alias("en"),
        F.col("score").alias("sc"),
        F.when(F.col("ord") % 3 == 0, "A").otherwise("B").alias("entity_type"),
    )
    return kept.groupBy("doc_id").agg(F.collect_list(hit).alias("hits")).withColumn(
        "text", F.expr("repeat('ab  c d   ', 6)")
    )


@query()
def redact_overlaps(spark, d):
    return rewrite.redact(overlapping(spark, d)).select("doc_id", "redacted_text")


@query()
def mask_overlaps(spark, d):
    return rewrite.mask(overlapping(spark, d)).select("doc_id", "masked_text")


@query()
def merge_adjacent(spark, d):
    merged = rewrite.merge_adjacent("p", rewrite.drop_contained("hits"))
    return (
        overlapping(spark, d)
        .withColumn("p", F.expr(pieces("text")))
        .select("doc_id", F.inline(F.expr(merged)))
        .select("doc_id", F.col("st").alias("span_start"), F.col("en").alias("span_end"), "entity_type")
    )


@query()
def highlight_risk(spark, d):
    return rewrite.highlight_risk(fd.with_findings(dossier(spark, d))).select("doc_id", "highlighted_html")


@query()
def highlight_category(spark, d):
    return rewrite.highlight_category(fd.with_findings(memo(spark, d))).select("doc_id", "category_html")


@query()
def highlight_overlaps(spark, d):
    """Spans that overlap, on a short text, each with its order as its value."""
    extra = [
        F.concat(F.lit("v"), F.col("ord") % 97).alias("value"), F.lit("PII").alias("category"),
        F.when(F.col("ord") % 2 == 0, "High").otherwise("Low").alias("risk"), F.lit("regex").alias("source"),
    ]
    return rewrite.highlight_category(nested(spark, d, extra)).select("doc_id", "category_html")


@query()
def escape_html(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id",
        F.expr(rewrite.escape_html("html")).alias("escaped"),
        F.expr(rewrite.escape_html("html", False)).alias("escaped_text"),
    )


@query()
def redact_json(spark, d):
    done = rewrite.redact_json(fd.with_findings(notes(spark, d)))
    return done.select(
        "doc_id",
        "redacted_text",
        F.col("json").isNotNull().alias("parsed"),
        F.try_variant_get("json", "$.mail", "string").alias("mail"),
    )


@query()
def redact_json_values(spark, d):
    done = rewrite.redact_json_values(fd.with_findings(notes(spark, d)))
    return done.select(
        "doc_id",
        "redacted_text",
        F.col("json").isNotNull().alias("parsed"),
        F.try_variant_get("json", "$.mail", "string").alias("mail"),
        F.try_variant_get("json", "$.card", "string").alias("card"),
    )


# ---- reports --------------------------------------------------------------
@query()
def findings_view(spark, d):
    return report.findings_view(fd.detect(dossier(spark, d)))


@query()
def snippet(spark, d):
    docs = src.text_source(spark, f"{d}/documents.parquet")
    return report.snippet(docs).select("doc_id", "snippet")


def with_rules(docs):
    ranked = comply.with_ranking(
        docs.withColumn("types", F.expr(fd.entity_set_of("hits"))), types="types"
    )
    return ranked.withColumn(
        "compliance_rules",
        F.expr(comply.matches_sql("ranked", rl.rule_list(), vocab.TOP_RULES)),
    )


@query()
def report_lines(spark, d):
    return report.report_lines(with_rules(fd.with_findings(dossier(spark, d)))).withColumn(
        "frameworks", F.array_join("frameworks", ", ")
    )


@query()
def explanation_prompt(spark, d):
    docs = rewrite.redact(with_rules(fd.with_findings(dossier(spark, d))))
    return report.explanation_prompt(docs).select("doc_id", "prompt")


@query()
def finding_prompt(spark, d):
    asked = report.finding_prompt(fd.detect(memo(spark, d)))
    return asked.groupBy("entity_type", "prompt").agg(F.count("*").alias("n"))


@query()
def explanation_default(spark, d):
    docs = report.explanation_default(fd.with_findings(memo(spark, d)), use_reasoner=False)
    return docs.select("doc_id", "explanation")


# ---- sources and sinks ----------------------------------------------------
@query()
def cosine_topk_large(spark, d):
    """Nearest vectors among all, for those whose id is divisible by 50, in many blocks."""
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")
    )
    asked = vectors.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    return comply.cosine_topk(asked, vectors, 5, block_bytes=64 << 10)


def vectors_asked(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec")
    )
    return rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")


@query()
def index_topk_exact(spark, d):
    """The same through the index, and then every cell that bounds leave open."""
    rows, asked = vectors_asked(spark, d)
    return vectors.search(vectors.build(rows), asked, 5, exact=True)


@query()
def text_source(spark, d):
    return src.text_source(spark, f"{d}/documents.parquet")


@query()
def route_by_extension(spark, d):
    names = spark.read.parquet(f"{d}/pages.parquet").select(
        "page_id",
        F.expr(
            "url || CASE page_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.Txt' ELSE '' END"
        ).alias("path"),
    )
    return src.route_by_extension(names).select("page_id", "route")


@query()
def assemble_pages(spark, d):
    """A turn of a conversation stands for a page; its role for the OCR text."""
    pages = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.col("conv_id").alias("doc_id"),
        (F.col("turn") + 1).alias("page_num"),
        F.col("text").alias("embedded_text"),
        F.col("role").alias("ocr_text"),
    )
    return src.assemble_pages(pages)


@query()
def join_paragraphs(spark, d):
    paragraphs = spark.read.parquet(f"{d}/conversations.parquet").select(
        F.col("conv_id").alias("doc_id"), "role", F.col("turn").alias("para_num"), "text"
    )
    return src.join_paragraphs(paragraphs, ("doc_id", "role"))


@query()
def split_empty(spark, d):
    docs = src.text_source(spark, f"{d}/documents.parquet").withColumn(
        "text",
        F.expr(
            r"CASE WHEN doc_id % 7 = 0 THEN repeat(' \n', cast(doc_id % 5 AS int)) ELSE text END"
        ),
    )
    full, empty = src.split_empty(docs)
    kept = full.select(
        "doc_id", F.lit(None).cast("string").alias("overall_risk"),
        F.lit(None).cast("string").alias("explanation"), "text",
    )
    return kept.unionByName(
        empty.select("doc_id", "overall_risk", "explanation", F.col("original_text").alias("text"))
    )


@query()
def redacted_names(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select(
        "page_id", *[sinks.output_name(F.col("url"), m).alias(f"{m}_name") for m in vocab.REWRITE_MODES]
    )


@query()
def decode_text(spark, d):
    """A byte that begins nothing in front, a cut character at the end."""
    bad = F.concat(F.unhex(F.lit("FF")), F.encode("html", "UTF-8"), F.unhex(F.lit("C3")))
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", bad.alias("content"))
    return pages.select("page_id", src.decode_text("content").alias("text"))


# ---- the whole scan -------------------------------------------------------
def scan_rows(spark, d):
    return scan_documents(dossier(spark, d))


def model_findings(spark, d):
    """The outside model's hits, as findings on memos."""
    return layers.external_findings(model_hits(spark, d))


def brief(scanned):
    return scanned.select(
        "doc_id", "total", "overall_risk",
        *[F.coalesce(F.col("sources")[s], F.lit(0).cast("long")).alias(f"n_{s}") for s in vocab.SOURCES],
        "redacted_text", "masked_text",
    )


@query()
def scan_with_names(spark, d):
    docs = dossier(spark, d)
    return brief(scan_documents(docs, more=[layers.find_dictionary(docs, terms(spark, d))]))


@query()
def scan_with_model(spark, d):
    return brief(scan_documents(memo(spark, d), more=[model_findings(spark, d)]))


@query()
def redact_with_model(spark, d):
    found = fd.with_findings(memo(spark, d), more=[model_findings(spark, d)])
    return rewrite.redact(found).select("doc_id", "redacted_text")


@query()
def replace_with_names(spark, d):
    docs = dossier(spark, d)
    found = fd.with_findings(docs, more=[layers.find_dictionary(docs, terms(spark, d))])
    return rewrite.replace_values(found).select("doc_id", "replaced_text")


@query()
def detect_ties(spark, d):
    """Spans of all three layers with equal starts and scores: the layer decides."""
    rows = spans(spark, d).select(
        "doc_id", "span_start", "span_end", F.lit(1.0).alias("score"),
        F.concat(F.lit("t"), F.col("ord") % 5).alias("entity_type"), F.lit("PII").alias("category"),
        F.concat(F.lit("v"), F.col("ord")).alias("value"), F.lit("High").alias("risk"),
        F.element_at(F.array(F.lit("regex"), F.lit("ner"), F.lit("rules")), (F.col("ord") % 3 + 1).cast("int")).alias("source"),
        F.lit("").alias("reason"), "ord",
    ).distinct()
    layer = F.when(F.col("source") == "rules", 0).when(F.col("source") == "ner", 1).otherwise(2)
    ranked = fd.resolve_overlaps(rows.withColumn("layer_rank", layer))
    return ranked.select("doc_id", "span_start", "span_end", "value", "source")


@query()
def join_replies(spark, d):
    """Replies of a model to every third memo, an error to every seventh."""
    replies = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 = 0 OR o_orderkey % 7 = 0").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderkey") % 7 != 0, F.concat(F.lit("Reply "), "o_orderkey")).alias("reply"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("timeout")).alias("error"),
    )
    found = report.explanation_default(fd.with_findings(memo(spark, d))).withColumn(
        "warnings", F.array().cast("array<string>")
    )
    return report.with_replies(found, replies).select(
        "doc_id", "explanation", F.array_join("warnings", ",").alias("warnings")
    )


@query(name="scan_documents")
def flat_scan(spark, d):
    scanned = scan_rows(spark, d)
    return scanned.select(
        "doc_id",
        "total",
        F.col("categories")["PII"].alias("n_pii"),
        F.col("categories")["PHI"].alias("n_phi"),
        F.col("categories")["Financial"].alias("n_financial"),
        "overall_risk",
        F.expr("CASE WHEN total > 0 THEN array_join(compliance_rules.id, ',') END").alias("rule_ids"),
        F.expr("array_max(compliance_exposure.exposure)").alias("top_exposure"),
        "redacted_text",
        "masked_text",
        "original_text",
        F.col("highlighted_html"),
        F.when(F.col("total") > 0, F.col("prompt")).alias("prompt"),
        "explanation",
        *[F.col("risks")[r].alias(f"n_{r.lower()}") for r in vocab.RISKS],
        *[F.col("sources")[x].alias(f"n_{x}") for x in vocab.SOURCES],
        F.size("warnings").cast("long").alias("n_warnings"),
        F.expr(
            "array_join(transform(findings, _f -> concat(_f.entity_type, ':', _f.st, ':', _f.en)), ',')"
        ).alias("found"),
    )


def flagship(spark, d):
    """Documents with counts and overall risk, out of the regex layer."""
    hits = fd.with_findings(memo(spark, d), rc.REGEX_LAYER)
    return flat_summary(fd.summarize(hits))
