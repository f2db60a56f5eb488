"""Rewriting a text by its findings: redact, mask, replace, mark up.

All of it happens inside the document's row.  A text is cut at the findings and
put together once, so the cost grows with the text, not with text x findings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from veilmark import vocab
from veilmark.functions.arrays import constant_map, let, quoted, scan
from veilmark.functions.text import cut, find_all, ordered_cuts, pieces, place, splice

SPAN = "struct<st:int,en:int,entity_type:string>"


def drop_contained(hits):
    """Spans, by position, without those that lie inside another one."""
    keyed = (
        f"array_sort(transform({hits}, (_h, _i) -> named_struct('st', _h.st, 'neg', -_h.en, "
        "'low', -_h.sc, 'i', _i, 'kind', _h.entity_type)))"
    )

    def step(reach, x):
        span = f"named_struct('st', {x}.st, 'en', -{x}.neg, 'entity_type', {x}.kind)"
        return f"greatest({reach}, -{x}.neg)", f"-{x}.neg > {reach}", span

    return scan(keyed, "-1", step, SPAN)


def merge_adjacent(parts, spans):
    """Make one span of same-type neighbours that overlap or have only spaces between.

    ``parts`` is the text as ``pieces``.
    """

    def step(s, x):
        gap = cut(parts, f"{s}.en", f"{x}.st")
        joins = (
            f"coalesce({s}.entity_type = {x}.entity_type AND "
            f"({x}.st < {s}.en OR rlike({gap}, '^ +$')), false)"
        )
        wider = (
            f"named_struct('st', {s}.st, 'en', greatest({s}.en, {x}.en), "
            f"'entity_type', {s}.entity_type)"
        )
        state = f"CASE WHEN {joins} THEN {wider} ELSE {x} END"
        return state, f"{s} IS NOT NULL AND NOT {joins}", s

    def last(s):
        return f"filter(array({s}), _n -> _n IS NOT NULL)"

    return scan(spans, f"cast(NULL AS {SPAN})", step, SPAN, last)


def _replacement(mode, kind, value):
    if mode == "redact":
        return f"concat('[', {kind}, ']')"
    if mode == "mask":
        shown = " ".join(f"WHEN {quoted(k)} THEN {n}" for k, n in vocab.MASK_CHARS.items())
        return let(
            "_mk",
            f"named_struct('v', {value}, 'n', CASE {kind} {shown} ELSE length({value}) END)",
            "concat(repeat('*', least(_mk.n, length(_mk.v))), substring(_mk.v, _mk.n + 1))",
        )
    return (
        f"coalesce(try_element_at({constant_map(vocab.STAND_INS)}, {kind}), "
        f"{quoted(vocab.STAND_IN_OTHER)})"
    )


def spans_sql(text, hits):
    """The spans to rewrite, in order: none inside another, neighbours merged."""
    return let("_src", pieces(text), merge_adjacent("_src", drop_contained(hits)))


def rewrite_sql(text, hits, mode, spans=None):
    """The text with every finding rewritten.

    Where two findings of different types overlap, the left one ends at the start
    of the right one, so both replacements appear and nothing shows through.
    ``spans`` names a column that already holds ``spans_sql``; masking does not use it.
    """
    if mode not in vocab.REWRITE_MODES:
        raise ValueError(f"unknown rewrite mode {mode!r}, expected one of {vocab.REWRITE_MODES}")
    end = "least(_sp.en, coalesce(get(_all, _j + 1).st, _sp.en))"
    new = _replacement(mode, "_sp.entity_type", cut("_src", "_sp.st", end))
    edits = f"transform(_all, (_sp, _j) -> named_struct('st', _sp.st, 'en', {end}, 'new', {new}))"
    if mode == "mask":
        # Each finding shows its own tail, so neighbours are masked one by one.
        merged = drop_contained(hits)
    else:
        merged = spans or merge_adjacent("_src", drop_contained(hits))
    changed = let("_src", pieces(text), let("_all", merged, splice("_src", edits, text)))
    return f"CASE WHEN coalesce(size({hits}), 0) <= 0 THEN {text} ELSE {changed} END"


def rewrite(df, mode, out=None, text="text", hits="hits"):
    """Add the rewritten text; the mode is checked when the plan is built."""
    return df.withColumn(out or f"{mode}ed_text", F.expr(rewrite_sql(text, hits, mode)))


def redact(df, **kw):
    return rewrite(df, "redact", "redacted_text", **kw)


def mask(df, **kw):
    return rewrite(df, "mask", "masked_text", **kw)


def replace_values(df, **kw):
    return rewrite(df, "replace", "replaced_text", **kw)


def redact_json(df, mode="redact", text="text", hits="hits"):
    """Rewrite JSON text and parse it again.

    ``json`` is null where the result is no JSON any more; ``redacted_text`` is
    always there.
    """
    done = rewrite(df, mode, "redacted_text", text, hits)
    return done.withColumn("json", F.try_parse_json("redacted_text"))


# Strings and numbers of a JSON text; all that stands between them is punctuation and constants.
JSON_TOKEN = r'"(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+'


def json_rewrite_sql(text, hits, mode):
    """JSON text with every finding rewritten, that is JSON again.

    Strings are rewritten inside their quotes.  A number with a finding becomes a string; so does
    a string whose rewriting would cut an escape.  A key also gets its place in the text, so that
    rewritten keys stay different.  Text that is no JSON is rewritten as it stands.
    """
    kind = "get(_in, 0).entity_type"
    end = "least(_s.en, coalesce(get(_in, _j + 1).st, _s.en), _tk.en - 1)"
    start = "greatest(_s.st, _tk.st + 1)"
    part = cut("_src", start, end)
    inner = (
        f"filter(transform(_in, (_s, _j) -> named_struct('st', {start} - _tk.st, 'en', {end} - _tk.st, "
        f"'new', {_replacement(mode, '_s.entity_type', part)})), _e -> _e.en > _e.st)"
    )
    string = let("_own", pieces("_tk.value"), splice("_own", inner, "_tk.value"))
    number = f"concat('\"', {_replacement(mode, kind, '_tk.value')}, '\"')"
    whole = f"concat('\"[', {kind}, ']\"')"
    fresh = f"CASE WHEN startswith(_tk.value, '\"') THEN {string} ELSE {number} END"
    valid = let("_nw", fresh, f"CASE WHEN try_parse_json(_nw) IS NULL THEN {whole} ELSE _nw END")
    key = "startswith(ltrim(get(_ft.gaps, _ti + 1)), ':')"
    told = let("_vl", valid, f"CASE WHEN {key} THEN concat(left(_vl, length(_vl) - 1), ' ', _ti, '\"') ELSE _vl END")
    edit = let(
        "_in", "filter(_all, _s -> _s.st < _tk.en AND _s.en > _tk.st)",
        f"CASE WHEN size(_in) > 0 THEN named_struct('st', _tk.st, 'en', _tk.en, 'new', {told}) END",
    )
    edits = f"filter(transform({place('_ft')}, (_tk, _ti) -> {edit}), _e -> _e IS NOT NULL)"
    merged = drop_contained(hits) if mode == "mask" else merge_adjacent("_src", drop_contained(hits))
    changed = let("_src", pieces(text), let("_all", merged, let("_ft", find_all(text, JSON_TOKEN), splice("_src", edits, text))))
    plain = rewrite_sql(text, hits, mode)
    return (
        f"CASE WHEN coalesce(size({hits}), 0) <= 0 THEN {text} "
        f"WHEN try_parse_json({text}) IS NULL THEN {plain} ELSE {changed} END"
    )


def redact_json_values(df, mode="redact", text="text", hits="hits"):
    """As ``redact_json``, but token by token, so that JSON stays JSON.  Findings are those of the
    text as it is written, with its escapes."""
    if mode not in vocab.REWRITE_MODES:
        raise ValueError(f"unknown rewrite mode {mode!r}, expected one of {vocab.REWRITE_MODES}")
    done = df.withColumn("redacted_text", F.expr(json_rewrite_sql(text, hits, mode)))
    return done.withColumn("json", F.try_parse_json("redacted_text"))


# ---- marked-up views ------------------------------------------------------
def escape_html(value, quotes=True):
    """The ampersand first, as the other entities contain one."""
    out = value
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quotes else [])
    for char, entity in pairs:
        out = f"replace({out}, '{char}', '{entity}')"
    return out


def _marked(text, hits, span, before, plain_before, after, quotes, escape_all):
    mark = f"transform({hits}, _h -> named_struct('st', _h.st, 'en', _h.en, 'new', {span}))"
    if escape_all:
        # Cut overlapping spans short, as the gaps are rewritten too.
        kept = (
            f"transform(_mm, (_h, _i) -> named_struct('st', _h.st, 'en', "
            "least(_h.en, coalesce(get(_mm, _i + 1).st, _h.en)), 'new', _h.new))"
        )
        whole = splice("_src", kept, text, lambda t: escape_html(t, quotes))
        body = let("_src", pieces(text), let("_mm", mark, whole))
    else:
        body = let("_src", pieces(text), splice("_src", ordered_cuts(mark, text), text))
    return (
        f"CASE WHEN coalesce(size({hits}), 0) <= 0 "
        f"THEN concat({plain_before}, {escape_html(text, quotes)}, '{after}') "
        f"ELSE concat({before}, {body}, '{after}') END"
    )


def highlight_risk_sql(text, hits, escape_all=False):
    def colours(risk):
        bg, fg, border = vocab.RISK_COLOURS[risk]
        return quoted(
            vocab.RISK_SPAN.format(bg=bg, fg=fg, border=border)
        )

    style = (
        f"CASE _h.risk WHEN 'High' THEN {colours('High')} "
        f"WHEN 'Medium' THEN {colours('Medium')} ELSE {colours('Low')} END"
    )
    span = (
        f"concat({style}, _h.entity_type, ' | ', _h.category, ' | ', _h.risk, "
        f"' risk | via ', _h.source, '\">', {escape_html('_h.value')}, '</span>')"
    )
    return _marked(
        text, hits, span, quoted(vocab.PRE_MARKED), quoted(vocab.PRE_PLAIN), "</pre>", True,
        escape_all,
    )


def highlight_category_sql(text, hits, escape_all=False):
    css = (
        f"coalesce(try_element_at({constant_map(vocab.CATEGORY_CLASSES)}, _h.category), "
        f"'{vocab.CATEGORY_CLASS_OTHER}')"
    )
    span = (
        f"concat('<span class=\"', {css}, '\" title=\"', _h.entity_type, ' · ', _h.category, "
        f"' · ', _h.risk, ' risk · ', _h.source, '\">', {escape_html('_h.value', False)}, "
        "'</span>')"
    )
    wrap = "'<div class=\"hl-wrap\">'"
    return _marked(text, hits, span, wrap, wrap, "</div>", False, escape_all)


def highlight_risk(df, text="text", hits="hits", escape_all=False):
    """Spans coloured by risk.  Text outside the spans stays as it is unless
    ``escape_all`` is set or nothing was found."""
    return df.withColumn("highlighted_html", F.expr(highlight_risk_sql(text, hits, escape_all)))


def highlight_category(df, text="text", hits="hits", escape_all=False):
    """Spans classed by category; otherwise as ``highlight_risk``."""
    return df.withColumn("category_html", F.expr(highlight_category_sql(text, hits, escape_all)))
