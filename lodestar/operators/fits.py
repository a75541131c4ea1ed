"""Greedy, order-bound operators: fit families, canonical modules, one-to-one matching. Each has a total order; groups run apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.relational import top_k

MERGE_AT = 0.80


def merge_local(fits: list[tuple[str, frozenset, int]], at: float = MERGE_AT) -> dict[str, str]:
    """Family of each fingerprint: the largest first, each joins the first family whose founder it matches by Jaccard."""
    founders: list[tuple[str, frozenset]] = []
    out = {}
    for name, modules, _ in sorted(fits, key=lambda f: (-f[2], f[0])):
        for lead, other in founders:
            union = len(modules | other)
            if (len(modules & other) / union if union else 1.0) >= at:
                out[name] = lead
                break
        else:
            founders.append((name, modules))
            out[name] = name
    return out


def merge_families(fits: DataFrame, at: float = MERGE_AT) -> DataFrame:
    """hull, fingerprint, modules (array), n -> hull, fingerprint, n, family. Fingerprints are distinct first, so a hull's group holds no repeats."""
    kind = fits.schema["hull"].dataType.simpleString()

    def run(pdf):
        fam = merge_local([(f, frozenset(m), n) for f, m, n in zip(pdf.fingerprint, pdf.modules, pdf.n)], at)
        return pdf.assign(family=pdf.fingerprint.map(fam))[["hull", "fingerprint", "n", "family"]]

    return fits.groupBy("hull").applyInPandas(run, f"hull {kind}, fingerprint string, n long, family string")


def canonical_modules(members: DataFrame, share: float = 0.80) -> DataFrame:
    """family, fit, module, qty -> family, module, qty: modules in `share` of a family's fits, with the rounded mean quantity."""
    n = members.groupBy("family").agg(F.countDistinct("fit").alias("fits"))
    m = members.groupBy("family", "module").agg(F.countDistinct("fit").alias("c"), F.sum("qty").alias("q")).join(n, "family")
    return m.where(F.col("c") >= share * F.col("fits")).select("family", "module", F.greatest(F.lit(1), F.bround(F.col("q") / F.col("fits"), 0).cast("int")).alias("qty"))


def match_greedy(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """One-to-one matching by score: pairs that are best for both ends are taken, their ends go, again until none is left.

    That gives the pairs the sequential greedy choice would (order: score, then a, then b), without one task seeing all pairs.
    """
    from lodestar.operators.graph import cut

    left, out = cut(pairs.select("a", "b", "score")), None
    for _ in range(rounds):
        order = [F.desc("score"), "a", "b"]
        best = top_k(left, ["a"], order, 1).drop("rn").join(top_k(left, ["b"], order, 1).drop("rn"), ["a", "b", "score"])
        best = cut(best)
        if not best.limit(1).count():
            return left if out is None else out
        out = best if out is None else out.union(best)
        left = cut(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti").select("a", "b", "score"))
    raise RuntimeError("pairs were left over")
