"""Slopes of SQL expressions with respect to parameters, by the chain rule.

Spark's own parser gives the tree of an expression; each node's slope follows from its children's values and slopes, and is a SQL
expression again, so it runs in generated code beside the formula and is exact to rounding. Parts that no parameter
reaches have no slope and cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

# Slope of f(u) over the slope of u, by function name; {u} is the argument and {f} the function's value.
ONE = {
    "exp": "{f}", "ln": "(1D / {u})", "log": "(1D / {u})", "log10": "(1D / ({u} * ln(10D)))", "log2": "(1D / ({u} * ln(2D)))",
    "log1p": "(1D / (1D + {u}))", "expm1": "({f} + 1D)", "sqrt": "(0.5D / {f})", "sin": "cos({u})", "cos": "(-sin({u}))",
    "tan": "(1D + {f} * {f})", "atan": "(1D / (1D + {u} * {u}))", "sinh": "cosh({u})", "cosh": "sinh({u})", "tanh": "(1D - {f} * {f})",
    "abs": "sign({u})", "negative": "(-1D)", "positive": "1D",
}


class NoSlope(ValueError):
    """The expression holds something that no rule is known for."""


def slopes(spark: SparkSession, formula: str, parameters: Sequence[str]) -> dict[str, str]:
    """For each parameter the slope of ``formula``, a SQL expression; ``0D`` where it does not matter."""
    tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(formula)
    names = {p.lower(): p for p in parameters}
    _, found = _walk(tree, names)
    return {p: found.get(p, "0D") for p in parameters}


def _children(node) -> list:
    nodes = node.children()
    return [nodes.apply(i) for i in range(nodes.size())]


def _walk(node, names: dict[str, str]) -> tuple[str, dict[str, str]]:
    """(value, slopes of the parameters that reach it), both SQL."""
    kind = node.nodeName()
    if kind == "UnresolvedAttribute":
        value = node.sql()
        own = names.get(node.name().lower())
        return value, {own: "1D"} if own else {}
    parts = [_walk(c, names) for c in _children(node)]
    if not any(d for _, d in parts):
        return node.sql(), {}
    values = [v for v, _ in parts]
    if kind == "UnresolvedFunction":
        name = node.nameParts().apply(node.nameParts().size() - 1).lower()
    else:
        name = {"UnaryMinus": "negative", "UnaryPositive": "positive", "Cast": "cast"}.get(kind, kind.lower())
    value = node.sql()
    if name in ("add", "subtract") and len(parts) == 2:
        sign = "+" if name == "add" else "-"
        return f"({values[0]} {sign} {values[1]})", _sum(parts, ["1D", "1D" if name == "add" else "-1D"])
    if name == "multiply":
        return f"({values[0]} * {values[1]})", _sum(parts, [values[1], values[0]])
    if name == "divide":
        quotient = f"({values[0]} / {values[1]})"
        return quotient, _sum(parts, [f"(1D / {values[1]})", f"(-{quotient} / {values[1]})"])
    if name in ("power", "pow"):
        base, to = values
        over_base = f"({to} * power({base}, {to} - 1D))" if parts[0][1] else "0D"
        # 0 ** x does not change with x
        over_to = f"(CASE WHEN {base} = 0D THEN 0D ELSE power({base}, {to}) * ln({base}) END)" if parts[1][1] else "0D"
        return value, _sum(parts, [over_base, over_to])
    if name in ("if", "casewhen") and not any(parts[i][1] for i in range(0, len(parts) - 1, 2) if i + 1 < len(parts)):
        return value, _chosen(parts)
    if name in ("greatest", "least") and len(parts) == 2:
        first = f"{values[0]} {'>=' if name == 'greatest' else '<='} {values[1]}"
        return value, {p: f"(CASE WHEN {first} THEN {parts[0][1].get(p, '0D')} ELSE {parts[1][1].get(p, '0D')} END)" for p in {**parts[0][1], **parts[1][1]}}
    if name in ONE and len(parts) == 1:
        return value, _sum(parts, [ONE[name].format(u=values[0], f=value)])
    raise NoSlope(f"no slope of {value}")


def _sum(parts: list, factors: list[str]) -> dict[str, str]:
    out: dict[str, list[str]] = {}
    for (_, slope), factor in zip(parts, factors, strict=True):
        for p, d in slope.items():
            out.setdefault(p, []).append(factor if d == "1D" else d if factor == "1D" else f"({factor} * {d})")
    return {p: terms[0] if len(terms) == 1 else "(" + " + ".join(terms) + ")" for p, terms in out.items()}


def _chosen(parts: list) -> dict[str, str]:
    """The slope of the branch that is taken; parts are condition, value, condition, value, ..., value or no value."""
    names = {p for _, d in parts for p in d}
    out = {}
    for p in names:
        pairs = [f"WHEN {parts[i][0]} THEN {parts[i + 1][1].get(p, '0D')}" for i in range(0, len(parts) - 1, 2)]
        other = parts[-1][1].get(p, "0D") if len(parts) % 2 else "CAST(NULL AS DOUBLE)"
        out[p] = f"(CASE {' '.join(pairs)} ELSE {other} END)"
    return out
