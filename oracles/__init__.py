"""DuckDB SQL for every registered job, written independently of the Spark code.

Each entry is one SELECT; entries refer to each other by name and are rendered
as a WITH chain.  Decimal literals are turned into doubles, because the engine
under test computes in doubles.
"""

from __future__ import annotations

import re

DEFS: dict[str, str] = {}
AS_OF = "DATE '2001-12-31'"


def _doubles(sql: str) -> str:
    parts = re.split(r"('(?:[^']|'')*')", sql)
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts[::2]]
    return "".join(parts)


def oracle(name: str, sql: str) -> None:
    DEFS[name] = _doubles(sql.replace("$AS_OF", AS_OF).strip())


def needs(name: str) -> list[str]:
    words = set(re.findall(r"[a-z_][a-z0-9_]*", re.sub(r"'(?:[^']|'')*'", "", DEFS[name])))
    return [d for d in DEFS if d != name and d in words]


def render(name: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in needs(n):
            if d not in order:
                visit(d)
        if n not in order:
            order.append(n)

    visit(name)
    chain = ",\n".join(f"{n} AS ({DEFS[n]})" for n in order)
    return f"WITH {chain}\nSELECT * FROM {name}"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return v[1:] if v.startswith("=") else "'" + v.replace("'", "''") + "'"
    return str(v)


def L(x: str, op: str, steps, rest) -> str:
    """CASE ladder; a text value starting with = is an SQL expression."""
    return "CASE " + " ".join(f"WHEN {x} {op} {lit(b)} THEN {lit(v)}" for b, v in steps) + f" ELSE {lit(rest)} END"


def M(x: str, table: dict, rest=None) -> str:
    return L(x, "=", table.items(), rest)


def S(x: str, where: str | None = None, digits: int = 2) -> str:
    flt = f" FILTER (WHERE {where})" if where else ""
    return f"(coalesce(sum(round(({x}) * {10**digits})::BIGINT){flt}, 0) / {10**digits}.0)"


def A(x: str, where: str | None = None, digits: int = 2) -> str:
    flt = f" FILTER (WHERE {where})" if where else ""
    return f"(sum(round(({x}) * {10**digits})::BIGINT){flt}::DOUBLE / count({x}){flt} / {10**digits}.0)"


def SD(x: str, digits: int = 4) -> str:
    """Twin of ``exact_stddev``: exact fixed-point moments, then double."""
    s = f"round(({x}) * {10**digits})::BIGINT::HUGEINT"
    return f"(CASE WHEN count({x}) > 1 THEN sqrt((count({x})::HUGEINT * sum({s} * {s}) - sum({s}) * sum({s}))::DOUBLE / (count({x}) * (count({x}) - 1))::DOUBLE) / {float(10**digits)} END)"


def CORR(y: str, x: str, y_digits: int = 0, x_digits: int = 2) -> str:
    """Twin of ``exact_corr``."""
    both = f"({x}) IS NOT NULL AND ({y}) IS NOT NULL"
    a, b = (f"CASE WHEN {both} THEN round(({v}) * {10**d})::BIGINT::HUGEINT END" for v, d in ((x, x_digits), (y, y_digits)))
    n = f"count({a})::HUGEINT"
    sxy, sxx, syy = (f"({n} * sum({p} * {q}) - sum({p}) * sum({q}))" for p, q in ((a, b), (a, a), (b, b)))
    return f"(CASE WHEN {sxx} > 0 AND {syy} > 0 THEN {sxy}::DOUBLE / sqrt({sxx}::DOUBLE * {syy}::DOUBLE) END)"


def N(where: str) -> str:
    return f"count(*) FILTER (WHERE {where})"


def R(num: str, den: str, scale=None, digits=None, empty="NULL") -> str:
    q = f"({num})::DOUBLE / ({den})"
    if scale is not None:
        q = f"{q} * {float(scale)}"
    if digits is not None:
        q = f"round({q}, {digits})"
    return f"CASE WHEN ({den}) > 0 THEN {q} ELSE {empty}::DOUBLE END"


def RD(x: str, digits: int) -> str:
    """Round half up on the decimal value, as Spark does."""
    return f"round((({x})::DOUBLE)::VARCHAR::DECIMAL(38,18), {digits})::DOUBLE"


QUARTER_AS_OF = "'Q' || quarter($AS_OF) || ' ' || year($AS_OF)"

from oracles import base, billing, commercial, customer, forecast, ingest, models, monitor, pipeline, reports, sales, telemetry, territory  # noqa: E402,F401
