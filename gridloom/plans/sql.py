"""Pieces of SQL that the queries' second versions are made of. They share no code with the operators."""

from __future__ import annotations

PX = "px AS MATERIALIZED (SELECT CAST(vec_id AS INTEGER) AS y, CAST(i - 1 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) AS t(i))"
UNIT = PX + ", mm AS MATERIALIZED (SELECT min(v) AS lo, max(v) AS hi FROM px), ux AS MATERIALIZED (SELECT y, x, (v - lo) / (hi - lo) AS v FROM px, mm)"
HALVE = "(VALUES (0, -0.01171875), (1, -0.03515625), (2, 0.11328125), (3, 0.43359375), (4, 0.43359375), (5, 0.11328125), (6, -0.03515625), (7, -0.01171875)) AS k(n, t)"


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def symmetric(i: str, n: str) -> str:
    p = f"((({i}) % (2 * {n}) + 2 * {n}) % (2 * {n}))"
    return f"least({p}, 2 * {n} - 1 - {p})"


def reflect(i: str, n: str) -> str:
    p = f"((({i}) % (2 * {n} - 2) + 2 * {n} - 2) % (2 * {n} - 2))"
    return f"least({p}, 2 * {n} - 2 - {p})"


def edge(i: str, n: str) -> str:
    return f"greatest(0, least({i}, {n} - 1))"


def size(src: str, to: str = "hw") -> str:
    return f"{to} AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM {src})"


def axis(src: str, to: str, taps: str, at: str, n: str, which: str) -> str:
    """Weighted sums along y or x: at and n are expressions of r, k.n and the size m."""
    other, m = ("x", "h") if which == "y" else ("y", "w")
    return (
        f"{to}_n AS (SELECT max({which}) + 1 AS m FROM {src}), {to}_r AS (SELECT unnest(range(0, CAST({n} AS BIGINT))) AS r, m FROM {to}_n), "
        f"{to}_g AS MATERIALIZED (SELECT r.r, k.t, {at} AS at FROM {to}_r r CROSS JOIN {taps}), {to} AS MATERIALIZED (SELECT CAST(g.r AS INTEGER) AS {which}, s.{other}, sum(g.t * s.v) AS v FROM {to}_g g JOIN {src} s ON s.{which} = g.at GROUP BY 1, 2)"
    )


def halve(src: str, to: str) -> str:
    at = edge("2 * r.r - 3 + k.n", "r.m")
    return axis(src, f"{to}_y", HALVE, at, "(m + 1) // 2", "y") + ", " + axis(f"{to}_y", to, HALVE, at, "(m + 1) // 2", "x")


def values(taps: list[float], name: str = "k") -> str:
    return "(VALUES " + ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(taps)) + f") AS {name}(n, t)"


def same(src: str, to: str, taps: list[float], which: str, centre: int | None = None) -> str:
    """Correlation with symmetric borders."""
    c = len(taps) // 2 if centre is None else centre
    return axis(src, to, values(taps), symmetric(f"r.r + k.n - {c}", "r.m"), "m", which)


def summary(src: str) -> str:
    """Of feature images (y, feat, x, v): what the feature queries return."""
    return f"SELECT y, feat, {r6('sum(v)')} AS total, {r6('max(v)')} AS peak, {r6('sum(v * (x + 1))')} AS moment FROM {src} GROUP BY y, feat"
