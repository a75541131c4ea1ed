"""Name -> (query, oracle SQL) of the engine's own operators.

Plans register themselves with @query; importing the plan modules fills the registry.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
PLANS = ("market", "battle", "alliance", "character", "graphs", "profiles", "spy", "incremental", "inquiries", "landing", "theaters", "behavior")


def half_up(sql: str) -> str:
    """round(x, k) written as floor(x * 10^k + 0.5) / 10^k, the form that kernels.rnd has: both engines then agree on every tie."""
    out, at = [], 0
    while (i := sql.find("round(", at)) >= 0:
        if i and (sql[i - 1].isalnum() or sql[i - 1] == "_"):
            out.append(sql[at : i + 6])
            at = i + 6
            continue
        depth, j, comma = 1, i + 6, -1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        k = 10 ** int(sql[comma + 1 : j - 1])
        out.append(f"{sql[at:i]}(floor(CAST({half_up(sql[i + 6 : comma])} AS DOUBLE) * {k} + 0.5) / {k})")
        at = j
    return "".join(out) + sql[at:]


def exact_casts(sql: str) -> str:
    """CAST(x AS DECIMAL(20,4)) with x rounded by the same rule first, as kernels.exact_sum has it."""
    mark, at = " AS DECIMAL(20,4))", 0
    while (i := sql.find(mark, at)) >= 0:
        depth, j = 1, i
        while depth:
            j -= 1
            depth += {")": 1, "(": -1}.get(sql[j], 0)
        inner = f"round({sql[j + 1 : i]}, 4)"
        sql = sql[: j + 1] + inner + sql[i:]
        at = j + 1 + len(inner) + len(mark)
    return sql


def query(name: str, oracle: str | None = None):
    """Register fn(spark, sf_dir) -> DataFrame, with the SQL that DuckDB holds it against."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = half_up(exact_casts(oracle))
        return fn

    return add


def _load() -> None:
    for p in PLANS:
        import_module(f"lodestar.plans.{p}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
