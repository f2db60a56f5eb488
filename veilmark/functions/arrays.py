"""SQL snippets for arrays held inside one row.

The helpers of this folder return Spark SQL text.  A scan is one large
expression; as text it is parsed in one call, where the same tree built call by
call from Python takes seconds.
"""

from __future__ import annotations

# A fold that appends to an array copies it on every step.  Working in blocks
# keeps those copies short, so the cost stays linear in the array length.
BLOCK = 256


def quoted(value):
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def raw(pattern):
    """A literal whose backslashes stand for themselves, for patterns."""
    return f'r"{pattern}"' if "'" in pattern else f"r'{pattern}'"


def let(name, value, body):
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"try_element_at(transform(array({value}), {name} -> {body}), 1)"


def empty(ddl):
    return f"cast(array() AS array<{ddl}>)"


def constant_map(mapping):
    """A literal map; Catalyst folds it into one constant."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items())
    return f"map({pairs})"


def text_list(values):
    return ", ".join(quoted(v) for v in values)


def scan(arr, zero, step, ddl, last=None):
    """Left fold over ``arr`` that also emits elements of type ``ddl``.

    ``step(state, x)`` returns ``(new_state, emit_now, element)``; ``last(state)``
    returns an array to add after the final element.
    """
    state, emit, element = step("_a.s", "_x")
    grown = "_a.m" if emit == "false" else f"array_append(_a.m, {element})"
    if emit not in ("true", "false"):
        grown = f"CASE WHEN {emit} THEN {grown} ELSE _a.m END"
    inner = (
        f"aggregate(_b, named_struct('s', _acc.s, 'm', {empty(ddl)}), "
        f"(_a, _x) -> named_struct('s', {state}, 'm', {grown}), "
        "_a -> named_struct('s', _a.s, 'out', array_append(_acc.out, _a.m)))"
    )
    blocks = (
        f"transform(sequence(0, (size(_arr) - 1) div {BLOCK}), "
        f"_k -> slice(_arr, cast(_k * {BLOCK} + 1 AS int), {BLOCK}))"
    )
    out = "flatten(_acc.out)"
    if last is not None:
        out = f"concat({out}, {last('_acc.s')})"
    fold = (
        f"aggregate({blocks}, named_struct('s', {zero}, 'out', {empty(f'array<{ddl}>')}), "
        f"(_acc, _b) -> {inner}, _acc -> {out})"
    )
    return let("_arr", arr, fold)
