"""Findings that come from outside the text: dictionaries and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.arrays import empty, let, scan
from veilmark.functions.filters import filter_bits
from veilmark.functions.text import cut, find_all, pieces, place
from veilmark.operators.findings import categorize, min_score
from veilmark.operators.recognize import normalize_label
from veilmark.schemas import FINDING_COLUMNS, LAYER_SPAN
from veilmark.session import fits_broadcast, stored

# Letters with their marks and digits; one of a few signs may join two such runs.
WORD = r"[\p{L}\p{M}\p{N}]++(?:[_#.'’-][\p{L}\p{M}\p{N}]++)*+"
DICTIONARY_SCORE = 0.85
GRAM = "struct<st:int,en:int,gram:string>"

# Where a dictionary is too large to be broadcast, occurrences of a term are dealt out to
# this many copies of it, so that a word in every document is no single key.
SALTS = 16
# Largest filter of a dictionary: 2 MB, held in the plan.  Beyond about 1.6 million terms more
# runs of words leave their row than need to.
FILTER_BITS = 1 << 24


def grams_sql(text, lengths, held):
    """Runs of words with single spaces between, with offsets, that a dictionary may have.

    A word opens runs if it may be the first of a term, and only of as many words as terms
    that begin with it have, out of ``lengths``.  ``held`` tests a text against the filter.
    """
    run = (
        "named_struct('st', _w0.st, 'en', get(_wp, _wi + _n - 1).en, "
        "'gram', array_join(transform(slice(_wp, _wi + 1, _n), _x -> _x.value), ' '))"
    )
    # A run of n words spans their lengths and n - 1 blanks, if there is nothing else between.
    spaced = "length(_gr.gram) = _gr.en - _gr.st AND NOT exists(slice(_wf.gaps, _wi + 2, _n - 1), _g -> _g <> ' ')"
    whole = let("_gr", run, f"CASE WHEN {held('_gr.gram')} AND {spaced} THEN _gr END")
    opened = (
        f"filter(array({', '.join(map(str, lengths))}), "
        f"_n -> _n <= size(_wp) - _wi AND {held(_opening('_n', '_w0.value'))})"
    )
    runs = f"filter(transform({opened}, _n -> {whole}), _gr -> _gr IS NOT NULL)"
    grams = (
        f"flatten(transform(_wp, (_w0, _wi) -> CASE WHEN {held('_w0.value')} THEN {runs} ELSE {empty(GRAM)} END))"
    )
    body = let("_wp", place("_wf"), grams)
    return (
        f"coalesce({let('_wf', find_all(text, WORD), f'CASE WHEN _wf IS NOT NULL THEN {body} END')}, "
        f"{empty(GRAM)})"
    )


def _opening(n, head):
    """The key of a first word with a number of words."""
    return f"concat({n}, ' ', {head})"


def _places(key, bits):
    """Two places of a key in a filter, out of one hash."""
    return [f"({key} & {bits - 1}L)", f"(shiftrightunsigned({key}, 32) & {bits - 1}L)"]


def _filter(known, bits):
    """The test of a filter of terms, first words and their numbers of words, and the numbers
    that there are."""
    keys = f"array(term, words[0], {_opening('size(words)', 'words[0]')})"
    hashed = known.select(F.explode(F.expr(keys)).alias("k")).select(F.xxhash64("k").alias("h"))
    put = hashed.select(F.explode(F.expr(f"array({', '.join(_places('h', bits))})")).alias("p"))
    words = put.groupBy(F.shiftright("p", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(p & 63 AS int)))").alias("set")
    ).collect()
    longs = {r["at"]: r.set for r in words}
    # One text that the optimizer folds to a constant array; as many literals are slow to plan.
    bitmap = ",".join(str(longs.get(i, 0)) for i in range(bits // 64))

    def held(text):
        set_ = " AND ".join(
            f"shiftrightunsigned(get(_bf, cast(shiftright({p}, 6) AS int)), cast({p} & 63 AS int)) & 1L = 1L"
            for p in _places("_hh", bits)
        )
        return let("_hh", f"xxhash64({text})", set_)

    lengths = sorted(known.agg(F.collect_set(F.size("words"))).first()[0]) or [1]
    return f"cast(split('{bitmap}', ',') AS array<bigint>)", held, lengths


def _terms(dictionary):
    words = F.regexp_extract_all("term", F.lit(WORD), F.lit(0))
    return dictionary.select("term", "entity_type", words.alias("words"))


def unmatchable_terms(dictionary):
    """Terms that no text can hold by the word rule: other signs, or several blanks."""
    return _terms(dictionary).where(~F.coalesce(F.array_join("words", " ") == F.col("term"), F.lit(False))).select(
        "term", "entity_type"
    )


def find_dictionary(docs, dictionary, salts=SALTS, bits=None):
    """Findings for terms of ``dictionary`` (term, entity_type), whole words, as written.

    A term may have any number of words.  Words and runs are held against a filter of the
    dictionary inside their row, sized by the number of terms, so only likely ones leave it.  No
    side is forced to be broadcast: a small dictionary is, by its size, and a large one is
    joined by a shuffle with hot terms dealt out.
    """
    known = _terms(dictionary).where(F.array_join("words", " ") == F.col("term"))
    known = stored(known, "terms")
    bits = bits or min(FILTER_BITS, filter_bits(3 * known.count()))
    bitmap, held, lengths = _filter(known, bits)
    found = let("_bf", bitmap, grams_sql("text", lengths, held))
    grams = docs.select("doc_id", F.inline(F.expr(found)))
    terms = known.select(F.col("term").alias("gram"), "entity_type").distinct()
    keys = ["gram"]
    if not fits_broadcast(known):
        keys.append("salt")
        grams = grams.withColumn("salt", F.pmod(F.xxhash64("doc_id", "st"), F.lit(salts)).cast("int"))
        terms = terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = grams.join(terms, keys).select(
        "doc_id",
        "entity_type",
        F.col("gram").alias("value"),
        F.col("st").alias("span_start"),
        F.col("en").alias("span_end"),
        F.lit(DICTIONARY_SCORE).alias("score"),
        F.lit("rules").alias("source"),
        # After the recognizers of the layer; of terms that start together the longest first.
        (F.lit(LAYER_SPAN // 2) - (F.col("en") - F.col("st"))).alias("ord"),
    )
    return categorize(hits).select(*FINDING_COLUMNS, "ord")


def chunk_text(docs, size=vocab.NER_CHUNK_CHARS, overlap=0):
    """Windows of a text for an outside model: chunk number, start, text; each shares
    ``overlap`` characters with the one before it, by default none."""
    full = docs.filter(F.length("text") > 0)
    if not 0 <= overlap < size:
        raise ValueError("an overlap is at least 0 and smaller than the window")
    if not overlap:
        windows = pieces("text", size)
    else:
        step = size - overlap
        last = f"cast(greatest(0, length(text) - {overlap} - 1) div {step} AS int)"
        window = cut("_pc", f"_k * {step}", f"least(length(text), _k * {step} + {size})")
        windows = let("_pc", pieces("text"), f"transform(sequence(0, {last}), _k -> {window})")
    return full.select("doc_id", F.posexplode(F.expr(windows)).alias("chunk", "chunk_text")).select(
        "doc_id", "chunk", (F.col("chunk") * (size - overlap)).alias("chunk_start"), "chunk_text"
    )


def with_type(df, label="label"):
    """Add the type name of a model label."""
    return df.withColumn("entity_type", F.expr(normalize_label(label)))


_PART = "struct<st:int,en:int,sc:double,first:int,last:int,value:string>"


def stitched(hits):
    """Hits that two windows report, as one: doc_id, entity_type, value, span_start, span_end, score.

    ``hits`` also has the chunk of each.  Hits of one type that overlap and come from different
    windows are one, from the first start to the last end and with the best score; hits of the
    same window stay as the model gave them.  Equal hits are put together before anything is
    gathered, so what is gathered of a document is bounded by its length.
    """
    once = hits.groupBy("doc_id", "entity_type", "span_start", "span_end").agg(
        F.max("score").alias("sc"), F.min("chunk").alias("first"), F.max("chunk").alias("last"), F.min("value").alias("value")
    )
    part = F.struct(F.col("span_start").alias("st"), F.col("span_end").alias("en"), "sc", "first", "last", "value")

    def step(s, x):
        joins = f"{x}.st < {s}.en AND {x}.first <> {s}.last"
        grown = (
            f"named_struct('st', {s}.st, 'en', greatest({s}.en, {x}.en), 'sc', greatest({s}.sc, {x}.sc), "
            f"'first', {s}.first, 'last', greatest({s}.last, {x}.last), "
            f"'value', concat({s}.value, substring({x}.value, {s}.en - {x}.st + 1)))"
        )
        return f"CASE WHEN {joins} THEN {grown} ELSE {x} END", f"{s} IS NOT NULL AND NOT coalesce({joins}, false)", s

    found = once.groupBy("doc_id", "entity_type").agg(F.array_sort(F.collect_list(part.cast(_PART))).alias("parts"))
    merged = scan("parts", f"cast(NULL AS {_PART})", step, _PART, lambda s: f"array({s})")
    return found.select("doc_id", "entity_type", F.inline(F.expr(merged))).select(
        "doc_id", "entity_type", "value", F.col("st").alias("span_start"), F.col("en").alias("span_end"),
        F.col("sc").alias("score"),
    )


def external_findings(model_hits, size=vocab.NER_CHUNK_CHARS, overlap=0):
    """Findings out of model output (see schemas.MODEL_HITS), offsets moved to the document.

    Hits below the threshold and empty spans are left out.  With windows that overlap, what two
    of them report is one finding.
    """
    kept = min_score(model_hits).filter(F.col("span_end") > F.col("span_start"))
    base = F.col("chunk") * (size - overlap)
    moved = with_type(kept).select(
        "doc_id",
        "entity_type",
        "value",
        (F.col("span_start") + base).cast("int").alias("span_start"),
        (F.col("span_end") + base).cast("int").alias("span_end"),
        "score",
        "chunk",
    )
    whole = stitched(moved) if overlap else moved.drop("chunk")
    return categorize(whole.withColumn("source", F.lit("ner"))).select(*FINDING_COLUMNS)
