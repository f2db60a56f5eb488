"""Top-k by TF-IDF cosine with upper bounds: terms that nearly all texts share are looked
at only where they can still change the answer.

1. Each term has the largest weight that it has in any document, so a query term can add at
   most its own weight times that.
2. The ``k`` heaviest documents of each term of a query are scored in full.  The k-th best of them
   is a score that the answer has to reach.
3. Terms whose bounds together stay below that score can be left out, the commonest for
   their bound first: a document with none of the others can't be in the answer.
4. Documents of the terms that are left are summed up, and only those that reach the score
   with the bounds of the terms left out are scored in full.

Products are summed inside blocks of documents of bounded size, to which all queries are dealt
out: what is shuffled are the vectors and the best ``k`` of a query and block, never the products.
Inside a block words that many queries and documents share are summed as a product of two small
matrices, and sums of single precision, with a bound of their error, say which documents are
scored in full.

The rows are those of ``comply.term_cosine_topk``, which sums all products of shared terms.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilmark.functions.arrays import scan
from veilmark.operators.comply import RANK_DIGITS, TERM_SALTS, ranked_and_filled
from veilmark.operators.nearest import rounded
from veilmark.session import fits_broadcast, stored
from veilmark.sources.rules import TERM, inverse_frequencies, term_counts

#: Added to bounds, well above what rounding to RANK_DIGITS and sums in another order change.
SLACK = 1e-7
#: Weights of documents or of queries, and queries, that one task holds.
BLOCK_TERMS = 4_000_000
BLOCK_QUERIES = 65_536
#: Single-precision sums, and weights of common words, that it holds at once beside them.
SUMS = 4_000_000
COMMON = 16_000_000
#: A word is common if its share of the queries times (its share of the documents and this) is
#: above the second: below it, adding its documents one by one takes less time.
COMMON_EACH, COMMON_LEAST = 0.02, 0.01
#: Documents that are scored in full at once.
FULL = 8_192
_WEIGHED = "struct<order:double,term:string,w:double,ub:double,df:bigint>"


def _beside(rows, side, key, spread):
    """Join the many ``rows`` with a stored ``side`` on a key that may be hot among them: by
    broadcast if that is small, else with each of its keys in ``TERM_SALTS`` copies."""
    if fits_broadcast(side):
        return rows.join(F.broadcast(side), key)
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(TERM_SALTS)).cast("int"))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def unit_vectors(documents):
    """The vectors of ``term_vectors``, a row for each document (rule_id, terms, weights), and term, idf.

    Texts are read once: the numbers of their words are stored.
    """
    counts = stored(term_counts(documents), "counts")
    idf = stored(inverse_frequencies(counts, documents), "idf")
    weighted = _beside(counts.where("rule_id IS NOT NULL"), idf, "term", "rule_id").withColumn("w", F.col("tf") * F.col("idf"))
    whole = weighted.groupBy("rule_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("one")
    )
    weights = F.transform("one.w", lambda w: w / F.col("norm"))
    return whole.select("rule_id", F.col("one.term").alias("terms"), weights.alias("weights")), idf


def _pieces(terms):
    """Vectors by rows (rule_id, term, rw) as rows that hold one weight each."""
    return terms.select("rule_id", F.array("term").alias("terms"), F.array("rw").alias("weights"))


def _by_row(vectors):
    """rule_id, term, rw of ``vectors`` (rule_id, terms, weights)."""
    one = F.explode(F.arrays_zip("terms", "weights")).alias("one")
    return vectors.select("rule_id", one).select("rule_id", F.col("one.terms").alias("term"), F.col("one.weights").alias("rw"))


def weighed_queries(queries, terms):
    """query_id, norm and weighted, its known terms: weight, bound and number of documents."""
    known = terms.groupBy("term").agg(F.max("idf").alias("idf"), F.max("rw").alias("top"), F.count("*").alias("df"))
    return _weighed(queries, known)


def _weighed(queries, known):
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))
    asked = queries.select("query_id", F.explode(words).alias("term")).groupBy("query_id", "term").agg(
        F.count("*").alias("qtf")
    )
    asked = _beside(asked, stored(known, "terms"), "term", "query_id").withColumn("w", F.col("qtf") * F.col("idf"))
    # Commonest first for its bound: bound per document.
    bound = F.col("w") * F.col("top")
    one = F.struct((bound / F.col("df")).alias("order"), "term", "w", bound.alias("ub"), "df")
    return asked.groupBy("query_id").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.array_sort(F.collect_list(one)).alias("weighted")
    )


def heaviest(vectors, k):
    """Of each term, the ``k`` documents with its largest weight: rule_id, terms, weights, a row for each."""
    order = Window.partitionBy("term").orderBy(F.desc("rw"), "rule_id")
    best = _by_row(vectors).withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
    return _pieces(best)


class _Block:
    """The vectors of a block of documents, by term and by document."""

    def __init__(self, rows):
        lists, rules = rows.column("terms").combine_chunks(), rows.column("rule_id").combine_chunks().dictionary_encode()
        words = lists.flatten().dictionary_encode()
        weight = rows.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.ids, self.words = rules.dictionary, words.dictionary
        self.place = np.empty(len(self.ids), np.int64)
        self.place[pc.sort_indices(self.ids).to_numpy()] = np.arange(len(self.ids))
        sizes = pc.list_value_length(lists).to_numpy()
        rule, word = np.repeat(rules.indices.to_numpy(), sizes), words.indices.to_numpy()
        heavy = np.repeat(rows.column("heavy").to_numpy(), sizes)
        self.by_rule = self._cut(rule[~heavy], len(self.ids), word[~heavy], weight[~heavy])
        self.heavy = self._cut(word[heavy], len(self.words), rule[heavy], weight[heavy])
        self.own, self.order = np.zeros(len(self.words)), np.zeros(len(self.words), np.int64)

    @staticmethod
    def _cut(key, n, other, weight):
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(n + 1)), other[order], weight[order]

    def ready(self, asked):
        """What ``sums`` needs, for queries that name each word as often as ``asked`` says."""
        starts, word, weight = self.by_rule
        sizes = np.diff(starts)
        starts, rule, weight = self._cut(word, len(self.words), np.repeat(np.arange(len(self.ids)), sizes), weight)
        self.by_word = starts, rule, weight.astype(np.float32)
        lengths = np.bincount(rule, weight * weight, len(self.ids))
        self.longest = float(np.sqrt(lengths.max(initial=0.0)))
        self.tops = np.zeros(len(self.words))
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            self.tops[some] = np.maximum.reduceat(weight, starts[some])
        gain = asked * (np.diff(starts) / max(1, len(self.ids)) + COMMON_EACH)
        common = np.argsort(-gain, kind="stable")[: COMMON // max(1, len(self.ids))]
        common = common[gain[common] > COMMON_LEAST]
        self.column = np.full(len(self.words), -1)
        self.column[common] = np.arange(len(common))
        self.common = np.zeros((len(common), len(self.ids)), np.float32)
        for row, w in zip(self.common, common):
            row[rule[starts[w]:starts[w + 1]]] = weight[starts[w]:starts[w + 1]]

    def seeds(self, words):
        starts, rule, _ = self.heavy
        some = words[starts[words + 1] > starts[words]]
        found = [rule[a:b] for a, b in zip(starts[some].tolist(), starts[some + 1].tolist())]
        return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)

    def reaching(self, sums, words, weights, needed, least, norm, k):
        """Documents whose products can come up to ``least``, of the best ``k`` here if that is known.

        ``sums`` has the products of the common words; those of the other ``needed`` words are added,
        and those of all others where more than ``k`` documents, or any, are left.
        """
        rare = self.column[words] < 0
        must, left = rare & needed, rare & ~needed
        rest = float(weights[left] @ self.tops[words[left]])
        self._add(sums, words[must], weights[must])
        # Products are not negative, so this bounds the error of all the sums in single precision.
        slack = SLACK * max(norm, 1.0) + (len(words) + 8) * 2.0**-22 * norm * self.longest
        found = self._least(sums, least - slack - rest)
        if len(found) <= (k or 0):
            return found
        self._add(sums, words[left], weights[left])
        total = sums[found]
        if k is not None:
            kth = float(np.partition(total, len(total) - k)[len(total) - k])
            least = max(least, kth - slack)
        return found[total >= np.float32(least - slack)]

    def _add(self, sums, words, weights):
        starts, rule, weight = self.by_word
        for a, b, x in zip(starts[words].tolist(), starts[words + 1].tolist(), weights.astype(np.float32)):
            sums[rule[a:b]] += x * weight[a:b]

    @staticmethod
    def _least(sums, reach):
        return np.flatnonzero(sums >= np.float32(reach) if reach > 0 else sums > 0)

    def dots(self, rules, words, weights):
        """Products with the whole of each document, summed in the order of the query's words."""
        self.own[words], self.order[words] = weights, np.arange(1, len(words) + 1)
        parts = [self._dots(rules[at:at + FULL]) for at in range(0, len(rules), FULL)]
        self.order[words] = 0
        return np.concatenate(parts)

    def _dots(self, rules):
        starts, word, weight = self.by_rule
        sizes = starts[rules + 1] - starts[rules]
        row = np.repeat(np.arange(len(rules)), sizes)
        at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[rules], sizes)
        known = self.order[word[at]] > 0
        at, row = at[known], row[known]
        by_word = np.argsort(self.order[word[at]], kind="stable")
        at, row = at[by_word], row[by_word]
        return np.bincount(row, self.own[word[at]] * weight[at], len(rules))


def _lists(queries, column, words):
    """Bounds of the list of each query, and all its words as places in ``words``."""
    lists = queries.column(column).combine_chunks()
    flat = pc.fill_null(pc.index_in(lists.flatten(), words), -1).to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]), flat


def _reaching(queries, block, bounds, words, weights, norms, k):
    """For each query in turn, the documents that can reach its score."""
    needed_bounds, needed = _lists(queries, "needed", block.words)
    least = queries.column("least").to_numpy()
    row = np.repeat(np.arange(len(queries)), np.diff(bounds))
    block.ready(np.bincount(words[words >= 0], minlength=len(block.words)) / max(1, len(queries)))
    column = np.where(words >= 0, block.column[words], -1)
    is_needed = np.zeros(len(block.words), bool)
    step = max(1, SUMS // max(1, len(block.ids)))
    for first in range(0, len(queries), step):
        some = range(first, min(first + step, len(queries)))
        own = slice(bounds[some.start], bounds[some.stop])
        common = column[own] >= 0
        left = np.zeros((len(some), len(block.common)), np.float32)
        left[row[own][common] - first, column[own][common]] = weights[own][common]
        sums = left @ block.common
        for q in some:
            must = needed[needed_bounds[q]:needed_bounds[q + 1]]
            must = must[must >= 0]
            is_needed[must] = True
            own = slice(bounds[q], bounds[q + 1])
            known = words[own] >= 0
            own_words = words[own][known]
            yield block.reaching(
                sums[q - first], own_words, weights[own][known], is_needed[own_words], least[q] * norms[q], norms[q], k
            )
            is_needed[must] = False


def _scored(queries, rows, k):
    """query_id, rule_id, score of the seeds of each query, or of the documents that can reach
    the score if that is known; the best ``k``, or all if that is None."""
    block = _Block(rows)
    bounds, words = _lists(queries, "terms", block.words)
    weights = queries.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    norms = queries.column("norm").to_numpy()
    reaching = _reaching(queries, block, bounds, words, weights, norms, k) if "needed" in queries.column_names else None
    at, found, scores = [], [], []
    for q in range(len(queries)):
        own = slice(bounds[q], bounds[q + 1])
        known = words[own] >= 0
        own_words, own_weights = words[own][known], weights[own][known]
        rules = block.seeds(own_words) if reaching is None else next(reaching)
        if not len(rules):
            continue
        score = block.dots(rules, own_words, own_weights) / norms[q]
        if k is not None and len(rules) > k:
            best = np.lexsort((block.place[rules], -rounded(score, RANK_DIGITS)))[:k]
            rules, score = rules[best], score[best]
        at.append(np.full(len(rules), q))
        found.append(rules)
        scores.append(score)
    at, found, scores = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, found, scores))
    return pa.table({
        "query_id": queries.column("query_id").take(pa.array(at, pa.int64())),
        "rule_id": block.ids.take(pa.array(found, pa.int64())), "score": pa.array(scores, pa.float64()),
    })


def _blocks(number, size):
    return -(-(number or 0) // size)


def _in_blocks(asked, rows, k):
    """``_scored`` of every block of queries with every block of documents."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    blocks = max(cores, _blocks(rows.agg(F.sum(F.size("terms"))).first()[0], BLOCK_TERMS))
    queries, weights = asked.agg(F.count("*"), F.sum(F.size("terms"))).first()
    parts = max(1, _blocks(queries, BLOCK_QUERIES), _blocks(weights, BLOCK_TERMS))
    left = asked.where("query_id IS NOT NULL").withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    left = left.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = rows.withColumn("_b", F.pmod(F.xxhash64("rule_id"), F.lit(blocks)))
    right = right.withColumn("_q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def both(queries, vectors):
        if len(queries) and len(vectors):
            return _scored(queries, vectors, k)
        return empty

    kinds = (asked.schema["query_id"].dataType.simpleString(), rows.schema["rule_id"].dataType.simpleString())
    schema = f"query_id {kinds[0]}, rule_id {kinds[1]}, score double"
    empty = to_arrow_schema(StructType.fromDDL(schema)).empty_table()
    return left.groupBy("_b", "_q").cogroup(right.groupBy("_b", "_q")).applyInArrow(both, schema)


def needed_terms(asked):
    """Add ``needed``, the terms that an answer must have one of, and ``rest``, what all other
    terms can add at most.  ``asked`` has ``least``, the score to reach."""
    fits = "{s} + {x}.ub < least * norm - " + repr(SLACK)

    def step(s, x):
        out = fits.format(s=s, x=x)
        return f"CASE WHEN {out} THEN {s} + {x}.ub ELSE {s} END", f"NOT ({out})", x

    needed = scan("weighted", "0D", step, _WEIGHED)
    total = "aggregate({a}, 0D, (_s, _x) -> _s + _x.ub)"
    return asked.withColumn("needed", F.expr(needed)).withColumn(
        "rest", F.expr(f"{total.format(a='weighted')} - {total.format(a='needed')}")
    )


def candidates(asked, terms, k=None):
    """query_id, rule_id, score of the documents that can reach the score, or the best ``k`` of
    them in each block.  ``terms`` has vectors by rows (rule_id, term, rw) or whole."""
    needed = needed_terms(asked).select(
        "query_id", "norm", "least", F.col("weighted.term").alias("terms"), F.col("weighted.w").alias("weights"),
        F.col("needed.term").alias("needed"),
    )
    vectors = terms if "terms" in terms.columns else _pieces(terms)
    return _in_blocks(needed, vectors.withColumn("heavy", F.lit(False)), k)


def bounded_topk(queries, documents, k, vectors=None):
    """Most similar documents of every query text, as ``comply.term_cosine_topk``.

    ``queries`` (query_id, text), each id once; ``documents`` (rule_id, document).
    """
    if vectors is None:
        units, idf = unit_vectors(documents)
        units = stored(units, "postings")
        known = _by_row(units).groupBy("term").agg(F.max("rw").alias("top"), F.count("*").alias("df")).join(idf, "term")
        weighed = _weighed(queries, known)
    else:
        terms = stored(vectors.select("term", "rule_id", "idf", "rw"), "postings")
        units, weighed = _pieces(terms), weighed_queries(queries, terms)
    asked = stored(weighed, "asked")

    heavy = stored(heaviest(units, k), "heaviest")
    both = units.withColumn("heavy", F.lit(False)).unionByName(heavy.withColumn("heavy", F.lit(True)))
    spread = asked.select("query_id", "norm", F.col("weighted.term").alias("terms"), F.col("weighted.w").alias("weights"))
    seeds = stored(_in_blocks(spread, both, k), "seeds")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rule_id")
    kth = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") == k)
    asked = asked.join(kth.select("query_id", F.col("score").alias("least")), "query_id", "left")
    asked = stored(asked.withColumn("least", F.coalesce("least", F.lit(0.0))), "reach")

    scored = candidates(asked, units, k)
    rows = scored.select("query_id", "rule_id", (-F.round("score", RANK_DIGITS)).alias("neg"))
    every = queries.select("query_id", F.lit(None).cast("string").alias("rule_id"), F.lit(None).cast("double").alias("neg"))
    return ranked_and_filled(rows.unionByName(every), documents, k)
