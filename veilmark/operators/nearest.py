"""The nearest vectors of groups of queries and groups of vectors that Spark puts together.

A group is bounded by its caller.  Products of a whole group find the few vectors that can be
among the nearest; their distances are then summed in order of the dimensions and rounded as
Spark does it, so that ties and digits do not depend on the way of summing.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Products held at once.
PAIRS = 1 << 21
_SLACK = 4e-9


def rounded(values, digits):
    """Half up as Spark rounds doubles: values close to a half by their decimal digits."""
    scale = 10.0**digits
    y = values * scale
    low = np.floor(y)
    out = np.floor(y + 0.5) / scale + 0.0
    for i in np.flatnonzero(np.abs(y - low - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(values[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _matrix(table, width):
    """Vectors and lengths; vectors without a known length are zero.  None if others than
    vectors of ``width`` finite numbers are left."""
    norms = table.column("norm").combine_chunks()
    known = pc.is_valid(norms)
    vecs = table.column("vec").combine_chunks().filter(known)
    if pc.any(pc.not_equal(pc.list_value_length(vecs), width)).as_py():
        return None
    rows = np.zeros((len(table), width))
    rows[known.to_numpy(zero_copy_only=False)] = vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), width)
    lengths = pc.fill_null(norms, 0.0).to_numpy(zero_copy_only=False)
    return (rows, lengths) if np.isfinite(rows).all() and np.isfinite(lengths).all() else None


def _one_by_one(queries, known, k, digits):
    """The same for vectors of any kind: of other widths (no distance, first) or not finite (last)."""
    right = list(zip(known.column("vec").to_pylist(), known.column("norm").to_pylist()))
    for q, (vec, norm) in enumerate(zip(queries.column("vec").to_pylist(), queries.column("norm").to_pylist())):
        best = []
        for c, (other, length) in enumerate(right):
            distance = 1.0
            if norm is not None and length is not None and not norm * length <= 0:
                if len(vec) != len(other):
                    best.append(((0, 0.0), c, None))
                    continue
                dot = 0.0
                for x, y in zip(vec, other):
                    dot += x * y
                distance = 1 - dot / (norm * length)
            if math.isfinite(distance):
                distance = float(rounded(np.array([distance]), digits)[0])
            best.append(((2, 0.0) if math.isnan(distance) else (1, distance), c, distance))
        for _, c, distance in sorted(best, key=lambda x: x[:2])[:k]:
            yield q, c, distance


def nearest(queries, known, k, digits):
    """``query_id, distance, id`` of the ``k`` nearest of ``known`` (id, vec, norm) to each of
    ``queries`` (query_id, vec, norm), ties to the smaller id."""
    if not len(queries) or not len(known):
        return _rows(queries, known, (), (), pa.array([], pa.float64()))
    known = known.take(pc.sort_indices(known, sort_keys=[("id", "ascending")], null_placement="at_start"))
    widths = pc.list_value_length(queries.column("vec").combine_chunks()).drop_null()
    width = widths[0].as_py() if len(widths) else 0
    left, right = _matrix(queries, width), _matrix(known, width)
    if left is None or right is None:
        found = list(_one_by_one(queries, known, k, digits))
        places, cols, distances = zip(*found) if found else ((), (), ())
        return _rows(queries, known, places, cols, pa.array(distances, pa.float64()))
    (q, qn), (v, vn) = left, right
    step = max(1, PAIRS // len(v))
    out = []
    for at in range(0, len(q), step):
        lengths = qn[at : at + step, None] * vn[None, :]
        far = 1 - np.divide(q[at : at + step] @ v.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)
        if len(v) > k:
            row, col = np.nonzero(far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k] + _SLACK)
        else:
            row, col = (x.ravel() for x in np.indices(far.shape))
        dot = np.zeros(len(row))
        for j in range(width):
            dot += q[at + row, j] * v[col, j]
        length = lengths[row, col]
        exact = rounded(1 - np.divide(dot, length, out=np.zeros_like(dot), where=length > 0), digits)
        order = np.lexsort((col, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < k
        out.append((at + row[kept], col[kept], exact[kept]))
    places, cols, distances = map(np.concatenate, zip(*out))
    return _rows(queries, known, places, cols, pa.array(distances))


def _rows(queries, known, places, cols, distances):
    ids = known.column("id").take(pa.array(cols, pa.int64()))
    return pa.table({
        "query_id": queries.column("query_id").take(pa.array(places, pa.int64())), "distance": distances, "id": ids,
    })


def nearest_of_groups(queries, known, keys, k, digits):
    """``nearest`` for each value of ``keys``, columns of both tables, as a DataFrame."""
    kinds = (queries.schema["query_id"].dataType.simpleString(), known.schema["id"].dataType.simpleString())

    def both(left, right):
        return nearest(left, right, k, digits)

    schema = f"query_id {kinds[0]}, distance double, id {kinds[1]}"
    return queries.groupBy(*keys).cogroup(known.groupBy(*keys)).applyInArrow(both, schema)
