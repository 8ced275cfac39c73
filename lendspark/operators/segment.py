"""Segmentation and anomaly flags.

K-means and PCA are Spark ML built-ins. Isolation forest has no Spark
built-in (Liu, Ting & Zhou, 2008): each tree grows on a sub-sample of at most
256 rows, so training is ``groupBy(tree).applyInPandas`` over ~trees x 256
sampled rows; scoring walks the (small, broadcast) trees inside an
Arrow-batched ``mapInPandas`` over all rows. The contamination threshold is
an exact distributed percentile of the scores.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendspark.operators.ordered import exact_quantiles
from lendspark.session import cut_lineage, ship_package

N_CLUSTERS = 5
RANDOM_STATE = 42
CONTAMINATION = 0.05
N_TREES = 100
MAX_SAMPLES = 256


def to_vector(df: DataFrame, columns: Sequence[str] | str, out: str = "features") -> DataFrame:
    """Numeric columns (or one array column) -> ML vector."""
    if isinstance(columns, str):
        return df.withColumn(out, array_to_vector(F.col(columns).cast("array<double>")))
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(df)


def segment_customers(df: DataFrame, features_col: str = "features", k: int = N_CLUSTERS,
                      seed: int = RANDOM_STATE, out: str = "cluster"):
    """K-means labels aligned to rows (returns (frame, model))."""
    model = KMeans(k=k, seed=seed, featuresCol=features_col, predictionCol=out).fit(df)
    return model.transform(df).withColumn(out, F.col(out).cast("int")), model


def pca_2d(df: DataFrame, features_col: str = "features", k: int = 2):
    """Projection on the first ``k`` principal components of the centred
    data, with the explained-variance ratios. Returns (frame with ``pc1``,
    ``pc2``..., list of ratios)."""
    centred = StandardScaler(inputCol=features_col, outputCol="_centred", withMean=True,
                             withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="_centred", outputCol="_pca").fit(centred)
    proj = model.transform(centred).withColumn("_arr", vector_to_array("_pca"))
    proj = proj.select(*df.columns, *[F.col("_arr")[i].alias(f"pc{i + 1}") for i in range(k)])
    return proj, [float(v) for v in model.explainedVariance.toArray()]


# ---------------------------------------------------------------------------
# Isolation forest
# ---------------------------------------------------------------------------

def _c(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    """Grow one isolation tree as flat arrays (feature, threshold, left,
    right, size); leaves have feature -1."""
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(int(len(idx)))
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    # adj: expected remaining path length below each leaf, c(size)
    return {"feature": feat, "threshold": thr, "left": left, "right": right, "size": size,
            "adj": [_c(v) for v in size], "depth": limit}


def _path_lengths(x: np.ndarray, tree: dict) -> np.ndarray:
    """Path length of every row in one tree: fixed-depth vector steps over
    all rows (leaves point to themselves), then the leaf's size correction."""
    feat = np.asarray(tree["feature"])
    thr = np.asarray(tree["threshold"])
    left = np.asarray(tree["left"])
    right = np.asarray(tree["right"])
    adj = np.asarray(tree["adj"]) if "adj" in tree else np.array([_c(v) for v in tree["size"]])
    inner = feat >= 0
    f_safe = np.where(inner, feat, 0)
    rows = np.arange(len(x))
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    for _ in range(int(tree.get("depth", 64))):
        live = inner[node]
        if not live.any():
            break
        go_left = x[rows, f_safe[node]] < thr[node]
        node = np.where(live, np.where(go_left, left[node], right[node]), node)
        depth += live
    return depth + adj[node]


class IsolationForestModel:
    def __init__(self, trees: list[dict], n_features: int, sample_size: int, threshold: float | None):
        self.trees, self.n_features, self.sample_size, self.threshold = trees, n_features, sample_size, threshold

    def score(self, df: DataFrame, features_col: str = "features", out: str = "anomaly_score") -> DataFrame:
        """Anomaly score s = 2^(-E[h(x)] / c(psi)) in (0, 1]; higher = more
        isolated. Trees travel once per executor as a broadcast variable.
        Vector columns are not carried to the output (ids and other columns are)."""
        from pyspark.ml.linalg import VectorUDT
        ship_package(df.sparkSession)
        sc = df.sparkSession.sparkContext
        b_trees = sc.broadcast(json.dumps(self.trees))
        cpsi = _c(self.sample_size)
        keep = [f for f in df.schema.fields if not isinstance(f.dataType, VectorUDT)]
        names = [f.name for f in keep]
        # one double column per feature: columnar Arrow batches, no per-row arrays
        arr = vector_to_array(features_col)
        xcols = [f"_x{i}" for i in range(self.n_features)]
        src = df.select(*[F.col(f"`{c}`") for c in names],
                        *[arr[i].alias(c) for i, c in enumerate(xcols)])
        schema = T.StructType(keep + [T.StructField(out, T.DoubleType())])

        def run(batches):
            trees = json.loads(b_trees.value)
            for pdf in batches:
                res = pdf[names].copy()
                x = pdf[xcols].to_numpy(dtype=float)
                h = np.zeros(len(pdf))
                for t in trees:
                    h += _path_lengths(x, t)
                h /= max(len(trees), 1)
                res[out] = np.power(2.0, -h / cpsi) if cpsi > 0 else np.full(len(pdf), 0.5)
                yield res

        return src.mapInPandas(run, schema)

    def predict(self, df: DataFrame, features_col: str = "features", out: str = "anomalia",
                scored: DataFrame | None = None) -> DataFrame:
        """1 = normal, -1 = anomaly (score above the fitted threshold)."""
        s = scored if scored is not None else self.score(df, features_col)
        return s.withColumn(out, F.when(F.col("anomaly_score") > F.lit(self.threshold), F.lit(-1))
                            .otherwise(F.lit(1)).cast("int"))


def fit_isolation_forest(df: DataFrame, features_col: str = "features", n_trees: int = N_TREES,
                         max_samples: int = MAX_SAMPLES, contamination: float = CONTAMINATION,
                         seed: int = RANDOM_STATE, id_col: str | None = None,
                         with_threshold: bool = True) -> IsolationForestModel:
    """Grow ``n_trees`` trees on independent sub-samples of size
    ~``max_samples`` (a row joins a tree with probability max_samples / n, by
    seeded hashes; no row expansion before the filter), then (unless
    ``with_threshold`` is False) set the threshold at the (1 - contamination)
    quantile of the training scores."""
    ship_package(df.sparkSession)
    n = df.count()
    psi = min(max_samples, n)
    p = psi / max(n, 1)
    key = F.col(id_col) if id_col else F.monotonically_increasing_id()
    # One hash per row decides how many trees it joins: the expected n_trees * p,
    # rounded up or down by the hash; a second hash then draws that many different
    # trees (a rotation of tree ids in steps coprime to n_trees).
    uniform = lambda salt: (F.pmod(F.xxhash64(key, F.lit(seed), F.lit(salt)), F.lit(1 << 30))
                            / F.lit(float(1 << 30)))
    joins = F.floor(F.lit(n_trees * p) + uniform("count")).cast("int")
    first = F.pmod(F.xxhash64(key, F.lit(seed), F.lit("tree")), F.lit(n_trees))
    steps = [k for k in range(1, n_trees + 1) if math.gcd(k, n_trees) == 1]
    step = F.element_at(F.array(*[F.lit(k) for k in steps]),
                        (F.pmod(F.xxhash64(key, F.lit(seed), F.lit("step")), F.lit(len(steps))) + 1).cast("int"))
    sampled = (df.select(vector_to_array(features_col).alias("_x"), joins.alias("_j"), first.alias("_f"),
                         step.alias("_s"))
                 .where(F.col("_j") > 0)
                 .select("_x", "_f", "_s", F.explode(F.sequence(F.lit(0), F.least("_j", F.lit(n_trees)) - 1))
                         .alias("_i"))
                 .select("_x", F.pmod(F.col("_f") + F.col("_i") * F.col("_s"), F.lit(n_trees))
                         .cast("int").alias("tree_id")))
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tid = int(pdf["tree_id"].iloc[0])
        x = np.vstack(pdf["_x"].to_numpy()).astype(float)
        tree = _grow(x, np.random.default_rng(seed + tid), limit)
        return pd.DataFrame({"tree_id": [tid], "tree": [json.dumps(tree)], "n": [len(x)]})

    grown = sampled.groupBy("tree_id").applyInPandas(grow, "tree_id int, tree string, n long")
    rows = grown.orderBy("tree_id").collect()  # n_trees small trees (<= 2 * psi nodes each)
    trees = [json.loads(r["tree"]) for r in rows]
    n_features = len(df.select(features_col).first()[0])
    model = IsolationForestModel(trees, n_features, psi, None)
    if with_threshold:
        fit_threshold(model, model.score(df.select(features_col), features_col), contamination)
    return model


def fit_threshold(model: IsolationForestModel, scored: DataFrame,
                  contamination: float = CONTAMINATION) -> float:
    """(1 - contamination) quantile of the training scores, exact and
    distributed."""
    thr = exact_quantiles(scored, "anomaly_score", [1.0 - contamination], names=["t"]).first()["t"]
    model.threshold = float(thr)
    return model.threshold


def detect_anomalies(df: DataFrame, features_col: str = "features",
                     contamination: float = CONTAMINATION, seed: int = RANDOM_STATE,
                     id_col: str | None = None) -> DataFrame:
    """L18 as one call: fit on ``df`` and flag its rows (1 normal, -1 anomaly).
    Rows are scored once; the scored frame is written to the shared folder for
    the threshold job and the output."""
    model = fit_isolation_forest(df, features_col, contamination=contamination, seed=seed,
                                 id_col=id_col, with_threshold=False)
    scored = cut_lineage(model.score(df, features_col))
    fit_threshold(model, scored, contamination)
    return model.predict(df, features_col, scored=scored)
