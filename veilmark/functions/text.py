"""SQL snippets for text: blanks, pieces and offsets in code points."""

from __future__ import annotations

from veilmark.functions.arrays import empty, let, raw, scan

# ``substring`` walks from the first byte, so cutting a long text many times is
# quadratic.  Long texts are first split into pieces of this many code points.
PIECE = 4096

PLACED = "struct<st:int,en:int,value:string,label:string>"


def strip(value):
    """Remove blanks of every kind at both ends, not only the space."""
    return f"regexp_replace({value}, {raw(r'(?U)^\s+|\s+$')}, '')"


def is_blank(value):
    return f"NOT rlike(coalesce({value}, ''), {raw(r'(?U)\S')})"


def pieces(text, size=PIECE):
    """The text as an array of pieces of ``size`` code points."""
    pattern = raw(rf"(?s).{{1,{size}}}")
    return (
        f"CASE WHEN length({text}) <= {size} THEN array({text}) "
        f"ELSE regexp_extract_all({text}, {pattern}, 0) END"
    )


def cut(parts, start, end):
    """Code points ``[start, end)`` of the text behind ``pieces``."""
    lo = f"greatest(_be.b - _p * {PIECE}, 0)"
    hi = f"least(_be.e - _p * {PIECE}, {PIECE})"
    span = f"sequence(cast(_be.b div {PIECE} AS int), cast((_be.e - 1) div {PIECE} AS int))"
    joined = (
        f"array_join(transform({span}, "
        f"_p -> substring(get({parts}, _p), {lo} + 1, {hi} - {lo})), '')"
    )
    body = f"CASE WHEN _be.e > _be.b THEN {joined} ELSE '' END"
    return let("_be", f"named_struct('b', {start}, 'e', {end})", body)


def splice(parts, edits, text, outside=lambda t: t):
    """Put ``new`` in place of ``[st, en)`` for ordered edits without overlap.

    ``parts`` are the ``pieces`` of ``text``; ``outside`` is applied to the
    stretches between the edits.
    """
    begin = "coalesce(get(_ed, _i - 1).en, 0)"
    head = f"transform(_ed, (_e, _i) -> concat({outside(cut(parts, begin, '_e.st'))}, _e.new))"
    tail = outside(cut(parts, "coalesce(get(_ed, size(_ed) - 1).en, 0)", f"length({text})"))
    return let("_ed", edits, f"concat(array_join({head}, ''), {tail})")


CUT = "struct<st:int,en:int,new:string>"


def ordered_cuts(edits, text):
    """Ordered edits that may overlap, as edits without overlap that give the same text as
    applying them from the last to the first.

    An earlier edit also covers the head of what a later one wrote: what its span has left
    after the text up to the next edit is taken from the next replacement, and on from
    there.  One pass over the edits, so the cost does not grow with text times edits.
    """

    def step(eaten, x):
        over = f"greatest(0, {eaten} - length({x}.new))"
        want = f"({x}.en - {x}.st + {over})"
        taken = f"least({x}.gap, {want})"
        edit = (
            f"named_struct('st', {x}.st, 'en', {x}.st + {taken}, "
            f"'new', substring({x}.new, {eaten} + 1))"
        )
        return f"{want} - {taken}", "true", edit

    rows = (
        "transform(_rl, (_e, _i) -> named_struct('st', _e.st, 'en', _e.en, 'new', _e.new, "
        f"'gap', greatest(0, coalesce(get(_rl, _i + 1).st, length({text})) - _e.st)))"
    )
    return let("_rl", edits, scan(rows, "0", step, CUT))


def find_all(text, pattern, value_group=0, label_group=None):
    """All matches of ``pattern``, as one struct for ``place``; null if none.

    A text without a match is read once, any other text twice.
    """
    p = raw(pattern)
    values = f"regexp_extract_all({text}, {p}, {value_group})" if value_group else "_w"
    labels = (
        f"regexp_extract_all({text}, {p}, {label_group})"
        if label_group
        else "cast(NULL AS array<string>)"
    )
    found = (
        f"named_struct('whole', _w, 'gaps', split({text}, {p}, -1), "
        f"'values', {values}, 'labels', {labels})"
    )
    body = f"CASE WHEN size(_w) > 0 THEN {found} END"
    return let("_w", f"regexp_extract_all({text}, {p}, 0)", body)


def place(found):
    """Matches from ``find_all`` with offsets, as ``array<PLACED>``.

    Offsets are running sums of code-point lengths over gaps and matches.  A
    value taken from a group is the tail of its match.
    """

    def step(pos, x):
        end = f"{pos} + {x}.gap + {x}.size"
        hit = (
            f"named_struct('st', {end} - length({x}.value), 'en', {end}, "
            f"'value', {x}.value, 'label', {x}.label)"
        )
        return end, "true", hit

    rows = (
        f"transform({found}.whole, (_v, _n) -> named_struct("
        f"'gap', length(get({found}.gaps, _n)), 'size', length(_v), "
        f"'value', get({found}.values, _n), 'label', get({found}.labels, _n)))"
    )
    # Most often there is one match, whose place needs no fold.
    end = f"length(get({found}.gaps, 0)) + length(get({found}.whole, 0))"
    value = f"get({found}.values, 0)"
    single = (
        f"cast(array(named_struct('st', {end} - length({value}), 'en', {end}, 'value', {value}, "
        f"'label', get({found}.labels, 0))) AS array<{PLACED}>)"
    )
    return (
        f"CASE WHEN {found} IS NULL THEN {empty(PLACED)} WHEN size({found}.whole) = 1 THEN {single} "
        f"ELSE {scan(rows, '0', step, PLACED)} END"
    )


#: Stands between the pieces of a marked text; a text that holds it is searched otherwise.
MARK = "\x1f"


def find_parts(text, pattern, value_group=0, label_group=0):
    """Matches as one array, out of one reading: the gap before a match, the match, its value and
    label group, the next gap and so on.  A text without a match is one gap.

    The text may not hold ``MARK``; ``find_parts_slowly`` takes any text.
    """
    marked = "".join(f"{MARK}${group}" for group in (0, value_group, label_group)) + MARK
    return f"split(regexp_replace({text}, {raw(pattern)}, '{marked}'), '{MARK}', -1)"


def find_parts_slowly(text, pattern, value_group=0, label_group=0):
    """The same in a text that may hold ``MARK``."""
    parts = "array(get(_f.gaps, _n), _v, get(_f.values, _n), coalesce(get(_f.labels, _n), ''))"
    body = f"concat(flatten(transform(_f.whole, (_v, _n) -> {parts})), array(element_at(_f.gaps, -1)))"
    found = find_all(text, pattern, value_group, label_group)
    return let("_f", found, f"CASE WHEN _f IS NULL THEN array({text}) ELSE {body} END")


def place_parts(parts):
    """Matches from ``find_parts`` with offsets, as ``array<PLACED>``, as from ``place``."""

    def step(pos, i):
        part = f"get({parts}, {i} * 4 + {{}})".format
        end = f"{pos} + length({part(0)}) + length({part(1)})"
        hit = (
            f"named_struct('st', {end} - length({part(2)}), 'en', {end}, "
            f"'value', {part(2)}, 'label', {part(3)})"
        )
        return end, "true", hit

    single = step("0", "0")[2]
    return (
        f"CASE WHEN size({parts}) = 5 THEN cast(array({single}) AS array<{PLACED}>) "
        f"ELSE {scan(f'sequence(0, (size({parts}) - 1) div 4 - 1)', '0', step, PLACED)} END"
    )
