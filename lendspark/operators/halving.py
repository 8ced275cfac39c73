"""Model search by successive halving.

Every candidate is tried on a small stratified sample first; the best share by AUC goes on
to a sample ``eta`` times larger, until the last rung trains on all training rows. Samples
are nested (the first rows of each class in hash order) and so the search is
repeatable; at equal work many more candidates are looked at than by full fits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendspark.operators import evaluate as ev
from lendspark.operators.models import add_balanced_weights, draw_params, get_model, with_probability
from lendspark.operators.prep import RANDOM_STATE, stratified_split
from lendspark.session import cut_spread

HISTORY = "rung int, candidate int, model string, n_train long, auc_roc double, promoted boolean"


def draw_candidates(spaces: dict[str, dict], per_model: int, seed: int = RANDOM_STATE) -> list[tuple[str, dict]]:
    """(model, parameters): ``per_model`` seeded draws of every model's space, in turn."""
    draws = {m: draw_params(s, per_model, seed) for m, s in spaces.items()}
    return [(m, draws[m][k]) for k in range(per_model) for m in spaces]


def rung_sizes(n_candidates: int, eta: int, rungs: int) -> list[tuple[int, float]]:
    """(candidates, share of the training rows) of every rung."""
    out, left = [], n_candidates
    for r in range(rungs):
        out.append((left, float(eta) ** (r + 1 - rungs)))
        left = math.ceil(left / eta)
    return out


def successive_halving(df: DataFrame, preprocessor: Pipeline, candidates: Sequence[tuple[str, dict]],
                       label: str = "TARGET", id_col: str = "SK_ID_CURR", eta: int = 3, rungs: int = 3,
                       test_size: float = 0.2, seed: int = RANDOM_STATE) -> tuple[tuple[str, dict, float, PipelineModel], DataFrame]:
    """((model, parameters, AUC, fitted pipeline) of the best candidate of the last rung,
    history). The AUC is that of the held-out ``test_size`` of the rows, exact, for all
    candidates of a rung in one job; ties go to the earlier candidate. The preprocessor
    is fitted anew on every rung's sample, with each candidate. ``history``: (rung,
    candidate, model, n_train, auc_roc, promoted)."""
    if not candidates or eta < 2 or rungs < 1:
        raise ValueError("successive_halving needs candidates, eta of 2 or more and a rung.")
    spark = df.sparkSession
    n_rows = df.count()
    split = cut_spread(stratified_split(df.where(F.col(label).isNotNull()), label, id_col, test_size, seed), n_rows)
    train, val = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    alive, history, fitted = list(range(len(candidates))), [], {}
    for rung, (n, share) in enumerate(rung_sizes(len(candidates), eta, rungs)):
        assert len(alive) == n
        rows = train
        if share < 1:
            part = stratified_split(train, label, id_col, share, seed + 1, out="_part")
            rows = part.where(F.col("_part") == "test").drop("_part")
        rows = cut_spread(add_balanced_weights(rows, label), n_rows)
        n_train = rows.count()
        scored = None
        for k in alive:
            name, params = candidates[k]
            est = get_model(name, label_col=label, **params)
            fitted[k] = Pipeline(stages=list(preprocessor.getStages()) + [est]).fit(rows)
            one = with_probability(fitted[k].transform(val)).select(F.lit(k).alias("candidate"), F.col(label).alias("label"), "score")
            scored = one if scored is None else scored.unionByName(one)
        auc = {r["candidate"]: float(r["auc_roc"]) for r in
               ev.evaluate(scored, "label", "score", groups=["candidate"]).collect()}        # one row a candidate
        ranked = sorted(alive, key=lambda k: (-auc[k], k))
        keep = ranked[:math.ceil(n / eta)] if rung < rungs - 1 else ranked[:1]
        history += [(rung, k, candidates[k][0], n_train, auc[k], k in keep) for k in alive]
        fitted = {k: fitted[k] for k in keep}
        alive = sorted(keep)
    best = alive[0]
    return ((*candidates[best], next(h[4] for h in reversed(history) if h[1] == best), fitted[best]),
            spark.createDataFrame(history, HISTORY))
