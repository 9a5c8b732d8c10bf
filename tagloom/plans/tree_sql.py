"""Check SQL that grows a decision tree by exhaustive search, level by level, and reads results off it.

A node is numbered by its path: 1 is the root, 2n and 2n + 1 are what passes and fails the test of n. Every split between two
neighbouring values of a feature is tried. The best gain wins, the earlier feature and the lower threshold among equals. Two leaves
of one prediction are joined to their parent, as the library does.
"""

from __future__ import annotations

from collections.abc import Sequence


def _gini(prefix: str, weight: str, classes: int) -> str:
    squares = " + ".join(f"{prefix}{c} * {prefix}{c}" for c in range(classes))
    return f"(1e0 - ({squares}) / ({weight} * {weight}))"


def grown(rows: str, inputs: Sequence[str], classes: int, depth: int, min_gain: float) -> list[str]:
    """Common tables ``rows0`` (given: id, inputs, code, w), ``node`` (one row per node) and ``leaf`` (id, node after joining leaves)."""
    features = [f"f{i}" for i in range(len(inputs))]
    made = ", ".join(f"CAST({x} AS DOUBLE) AS {f}" for x, f in zip(inputs, features))
    ctes = [f"rows0 AS MATERIALIZED (SELECT id, code, w, CAST(1 AS BIGINT) AS node, {made} FROM ({rows}))"]
    sums = lambda over="": ", ".join(f"sum(CASE WHEN code = {c} THEN w ELSE 0e0 END){over} AS c{c}" for c in range(classes))
    parts = []
    for d in range(depth + 1):
        ctes.append(f"n{d} AS MATERIALIZED (SELECT node, sum(w) AS w, {sums()} FROM rows{d} GROUP BY node)")
        impurity = _gini("c", "w", classes)
        if d == depth:
            parts.append(f"SELECT node, w, {', '.join(f'c{c}' for c in range(classes))}, CAST(NULL AS INT) AS feature, CAST(NULL AS DOUBLE) AS threshold, CAST(NULL AS DOUBLE) AS gain FROM n{d}")
            break
        long = " UNION ALL ".join(f"SELECT node, {i} AS feature, {f} AS v, code, w FROM rows{d}" for i, f in enumerate(features))
        window = "OVER (PARTITION BY node, feature ORDER BY v)"
        ctes.append(f"v{d} AS (SELECT node, feature, v, sum(w) AS w, {sums()} FROM ({long}) GROUP BY ALL)")
        left = ", ".join(f"sum(c{c}) {window} AS l{c}" for c in range(classes))
        ctes.append(f"u{d} AS (SELECT node, feature, (v + lead(v) {window}) / 2e0 AS threshold, sum(w) {window} AS lw, {left} FROM v{d})")
        right = ", ".join(f"n.c{c} - l{c} AS r{c}" for c in range(classes))
        ctes.append(f"s{d} AS (SELECT u.*, n.w, n.w - lw AS rw, {', '.join(f'n.c{c}' for c in range(classes))}, {right} FROM u{d} u JOIN n{d} n USING (node) WHERE threshold IS NOT NULL)")
        gain = f"{impurity} - lw / w * {_gini('l', 'lw', classes)} - rw / w * {_gini('r', 'rw', classes)}"
        ctes.append(
            f"b{d} AS MATERIALIZED (SELECT node, feature, threshold, gain FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(gain, 11) DESC, feature, threshold) AS rn "
            f"FROM (SELECT node, feature, threshold, {gain} AS gain FROM s{d})) WHERE rn = 1 AND gain >= {min_gain!r} AND gain > 1e-13)"
        )
        parts.append(f"SELECT n.node, w, {', '.join(f'c{c}' for c in range(classes))}, feature, threshold, gain FROM n{d} n LEFT JOIN b{d} b USING (node)")
        value = "CASE feature " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(features)) + " END"
        ctes.append(f"rows{d + 1} AS MATERIALIZED (SELECT id, code, w, 2 * node + CASE WHEN {value} <= threshold THEN 0 ELSE 1 END AS node, {', '.join(features)} FROM rows{d} JOIN b{d} USING (node))")
    most = f"list_position([{', '.join(f'c{c}' for c in range(classes))}], greatest({', '.join(f'c{c}' for c in range(classes))})) - 1"
    ctes.append(f"all_nodes AS MATERIALIZED (SELECT *, {most} AS prediction FROM ({' UNION ALL '.join(parts)}))")
    # joined from the lowest level up: a node whose two children are leaves of one prediction is a leaf
    ctes.append(f"j{depth} AS (SELECT node, w, feature, threshold, gain, prediction, {', '.join(f'c{c}' for c in range(classes))}, feature IS NULL AS is_leaf FROM all_nodes)")
    for d in range(depth - 1, -1, -1):
        ctes.append(
            f"j{d} AS MATERIALIZED (SELECT p.* REPLACE (p.is_leaf OR (p.node >= {2**d} AND p.node < {2 ** (d + 1)} AND coalesce(l.is_leaf AND r.is_leaf AND l.prediction = r.prediction, false)) AS is_leaf) "
            f"FROM j{d + 1} p LEFT JOIN j{d + 1} l ON l.node = 2 * p.node LEFT JOIN j{d + 1} r ON r.node = 2 * p.node + 1)"
        )
    ancestors = " AND ".join(f"NOT coalesce((SELECT is_leaf FROM j0 a WHERE a.node = j0.node >> {k}), false)" for k in range(1, depth + 1))
    ctes.append(f"node AS MATERIALIZED (SELECT * FROM j0 WHERE {ancestors})")
    deepest = " UNION ALL ".join(f"SELECT id, node FROM rows{d}" for d in range(depth + 1))
    ctes.append(f"leaf AS MATERIALIZED (SELECT id, node.* FROM ({deepest}) JOIN node USING (node) WHERE is_leaf)")
    return ctes


def importances(ctes: list[str], names: Sequence[str], digits: int = 6) -> str:
    listed = ", ".join(f"({i}, '{n}')" for i, n in enumerate(names))
    return (
        f"WITH {', '.join(ctes)}, g AS (SELECT feature, sum(gain * w) AS g FROM node WHERE NOT is_leaf GROUP BY feature) "
        f"SELECT name AS feature, round(coalesce(g, 0e0) / (SELECT sum(g) FROM g), {digits}) + 0e0 AS importance FROM (VALUES {listed}) v(i, name) LEFT JOIN g ON g.feature = i"
    )
