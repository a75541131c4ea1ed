"""Queries that SQL cannot express, against plain loops over the same rows."""

import datetime as dt

import numpy as np

from lodestar.plans import battle, landing, registry
from lodestar.sources import views as V

SF = "/root/testdata/sf0.001"
Q = registry.queries()


def test_fit_families_merge_in_order(spark):
    fits = {}
    for r in landing.fitted_hulls(spark, SF).collect():
        fits.setdefault(r.hull, {}).setdefault(r.fingerprint, [0, set(r.modules)])[0] += 1
    want = {}
    for hull, by in fits.items():
        founders = []
        for name, (n, modules) in sorted(by.items(), key=lambda x: (-x[1][0], x[0])):
            lead = next((f for f, m in founders if len(m & modules) >= 0.8 * len(m | modules)), None)
            if lead is None:
                founders.append((name, modules))
            want[hull, name] = (n, lead or name)
    got = {(r.hull, r.fingerprint): (r.n, r.family) for r in Q["fit_family_merge"](spark, SF).collect()}
    assert got == want and any(k[1] != f for k, (_, f) in got.items())


def test_matches_are_the_greedy_choice(spark):
    es = V.event_stream(spark, SF).toPandas()
    pilots = {}
    for r in es.itertuples():
        first = r.side_key in ("click", "view")
        if first or r.side_key in ("error", "purchase"):
            day = (r.ts.date() - dt.date(2024, 1, 1)).days
            pilots.setdefault((day, None if first else r.system_id), set()).add(r.character_id)
    pairs = [(len(p & pilots[d, None]), d, s) for (d, s), p in pilots.items() if s is not None and (d, None) in pilots]
    used_a, used_b, want = set(), set(), []
    for n, a, b in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
        if n and a not in used_a and b not in used_b:
            want.append((a, b, float(n)))
            used_a.add(a)
            used_b.add(b)
    assert sorted(map(tuple, Q["one_to_one_matches"](spark, SF).select("a", "b", "score").collect())) == sorted(want) and want


def test_escalation_chains(spark):
    """Battles of six hours of an area, in order, each to the first open chain that shares a tenth of the smaller side's pilots with a member."""
    rows = battle.with_battle(V.event_stream(spark, SF), 6 * 3600).toPandas()
    want = []
    for area, some in rows.groupby("system_id"):
        fights = sorted((g.ts.min(), b, g.ts.max(), set(g.character_id)) for b, g in some.groupby("battle_id"))
        chains = []
        for s, b, e, pilots in fights:
            for c in chains:
                near = (s - max(m[2] for m in c)).total_seconds() <= 72 * 3600
                if near and any(len(pilots & m[3]) >= 0.1 * max(1, min(len(pilots), len(m[3]))) for m in c):
                    c.append((s, b, e, pilots))
                    break
            else:
                chains.append([(s, b, e, pilots)])
        want += [(area, len(c), c[0][0], max(m[2] for m in c), max(len(m[3]) for m in c)) for c in chains if len(c) > 1]
    got = [(r.area, r.battles, r.started_at, r.ended_at, r.peak) for r in Q["escalation_chains"](spark, SF).collect()]
    assert sorted(got) == sorted(want) and want


def test_shadow_model_ranks_held_out_documents(spark):
    """Documents past the training ids: those of label 1 score higher than those of label 0 in most pairs, and none is trained on."""
    sf = "/root/testdata/sf0.01"
    got = Q["shadow_model"](spark, sf).toPandas()
    labels = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id").collect())
    assert got.doc_id.min() > labels[int(np.ceil(0.8 * len(labels))) - 1] and len(got) > 40
    good, bad = got.score[got.label == 1].to_numpy(), got.score[got.label == 0].to_numpy()
    auc = (good[:, None] > bad[None]).mean()
    assert auc > 0.8, auc


def test_stored_model_scores_like_the_fitted_one(spark):
    sf = "/root/testdata/sf0.01"
    got = Q["stored_model_scores"](spark, sf).toPandas().set_index("doc_id")
    fitted = Q["shadow_model"](spark, sf).toPandas().set_index("doc_id")
    assert (got.score[fitted.index] - fitted.score).abs().max() < 2e-6 and got.index.is_unique
    assert (got.reused == (got.index % 2 == 0)).all() and set(got.top_feature) <= {"chars", "upper", "marks"} and got.top_feature.nunique() > 1
