"""Stacked ensemble: training-data preparation, two-phase stacked training,
and batch / single-row scoring, all as Spark plans.

prepare:  zero-as-missing -> drop rows missing required columns -> exact
          stratified split -> IQR bounds from train, filter both -> chained
          boosted-tree imputation (fit on train, apply to both) -> min-max fit
          on train, apply to both -> 50/50 hash split of train into train1/train2
train:    base learners on train1 -> base score stack (decision values
          min-max normalised per scored frame) -> fuzzy c-means phase 1
          (train1, m=5) -> memberships (m=2) -> meta MLP phase 1 -> c-means
          final on train1 + 2 x train2 -> meta MLP phase 2, warm-started from
          phase 1, on train1 + train2 with sample weights 1 : 5 (replication)
score:    zero-as-missing -> impute -> scale -> base scores -> memberships ->
          meta probability -> ``p > 0.5``
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LinearSVCModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import clean, fuzzy, impute, learners, outliers, scale, split
from tessera.operators.stack import normalize_scores, replicate_by_weight, score_range, weighted_union
from tessera.functions.numeric import threshold
from tessera.session import cut_lineage


@dataclass
class StackConfig:
    features: list[str]
    key: str
    label: str
    zero_missing: list[str]
    required: list[str]
    impute_specs: list[dict]
    test_fraction: float = 0.2
    seed: int = 42
    knn_k: int = 22
    gbt: dict = field(default_factory=lambda: dict(max_iter=400, step_size=0.01, max_depth=7, min_instances=3,
                                                   subsampling=0.7))
    lsvm: dict = field(default_factory=lambda: dict(C=2.0))
    rsvm: dict = field(default_factory=lambda: dict(C=8.5317, gamma=0.6952, D=256, max_iter=500, tol=0.1))
    ann: dict = field(default_factory=lambda: dict(hidden=[32, 256, 128, 256], max_iter=100,
                                                   class_copies="balanced"))
    meta_hidden: list[int] = field(default_factory=lambda: [512, 512, 256, 128, 128, 16])
    meta_iter: tuple[int, int] = (20, 15)
    fcm_phase1: dict = field(default_factory=lambda: dict(m=5.0, error=1e-4, maxiter=1000))
    fcm_final: dict = field(default_factory=lambda: dict(m=2.0, error=1e-8, maxiter=1000))
    train2_weight: int = 5
    train2_fcm_copies: int = 2
    score_mode: str = "batch"


@dataclass
class Artifacts:
    cfg: StackConfig
    bounds: dict = None
    imputers: dict = None
    scaler: dict = None
    base: list = None
    score_ranges: dict = None
    centers_phase1: list = None
    centers: list = None
    meta: learners.Fitted = None
    meta_phase1: learners.Fitted = None

    @property
    def score_names(self) -> list[str]:
        return [b.name for b in self.base]

    @property
    def meta_features(self) -> list[str]:
        return self.cfg.features + self.score_names + ["u0", "u1"]


def prepare(df: DataFrame, cfg: StackConfig) -> tuple[dict, Artifacts]:
    """Returns (parts, artifacts with bounds, imputers, scaler).

    Parts: ``train_set``, ``test_set``, ``train1``, ``train2``, and the rows
    as they were before imputation and scaling, ``train_given`` and
    ``test_given`` (for :func:`evaluate_imputers`)."""
    art = Artifacts(cfg)
    z = clean.zero_as_missing(df, cfg.zero_missing)
    # written once: the split and the bounds pass over it many times, and the columns may be costly to make
    z = cut_lineage(clean.drop_missing(z, cfg.required))
    s = split.stratified_split(z, cfg.key, cfg.label, cfg.test_fraction, cfg.seed)
    train, test = s.where("split = 'train'").drop("split"), s.where("split = 'test'").drop("split")
    art.bounds = outliers.bounds_dict(outliers.iqr_bounds(train, cfg.features))
    # written once: the imputers' many jobs read these tables, not the split behind them
    train, test = cut_lineage(outliers.outlier_filter(train, art.bounds)), cut_lineage(outliers.outlier_filter(test, art.bounds))
    train_i, art.imputers = impute.chained_impute(train, cfg.impute_specs)
    test_i = test
    for spec in cfg.impute_specs:
        test_i = impute.apply_imputer(test_i, art.imputers[spec["target"]], spec["target"])
    art.scaler = scale.stats_dict(scale.minmax_fit(train_i, cfg.features))
    # the prepared tables are written once to the shared checkpoint folder:
    # every later fit reads them instead of re-running split, filter and
    # imputers, and a lost executor only loses cached blocks, not the lineage
    train_s = cut_lineage(scale.minmax_transform(train_i, art.scaler, cfg.features))
    test_s = cut_lineage(scale.minmax_transform(test_i, art.scaler, cfg.features))
    halves = split.hash_split(train_s, cfg.key, 0.5, cfg.seed, names=("train1", "train2"))
    parts = {"train_set": train_s, "test_set": test_s, "train_given": train, "test_given": test,
             "train1": halves.where("split = 'train1'").drop("split"),
             "train2": halves.where("split = 'train2'").drop("split")}
    return parts, art


def fit_base(train1: DataFrame, art: Artifacts) -> None:
    cfg = art.cfg
    f, y, k = cfg.features, cfg.label, cfg.key
    art.base = [
        learners.fit_mlp(train1, f, y, k, "ANN", seed=cfg.seed, **cfg.ann),
        learners.fit_knn(train1, f, y, k, "KNN", k=cfg.knn_k),
        learners.fit_gbt(train1, f, y, k, "LightGBM", seed=cfg.seed, **cfg.gbt),
        learners.fit_rbf_svm(train1, f, y, k, "RSVM", seed=cfg.seed, **cfg.rsvm),
        learners.fit_linear_svm(train1, f, y, k, "LinearSVM", **cfg.lsvm),
    ]


def base_scores(df: DataFrame, art: Artifacts, mode: str | None = None) -> DataFrame:
    """Five score columns; decision values normalised (batch: over ``df``)."""
    out = df
    for b in art.base:
        out = b.score(out)
    dec = [b.name for b in art.base if b.kind == "decision"]
    mode = mode or art.cfg.score_mode
    if mode == "batch":
        return normalize_scores(out, dec, "batch")
    return normalize_scores(out, dec, "fitted", {c: art.score_ranges[c] for c in dec})


def train(parts: dict, art: Artifacts, path: str | None = None) -> Artifacts:
    """Both phases.  With ``path``, the artifacts are saved there after phase 1;
    artifacts that hold phase 1 (see ``load_artifacts``) resume with phase 2."""
    t1, t2 = parts["train1"], parts["train2"]
    if art.base is None:
        fit_base(t1, art)
    s1 = base_scores(t1, art, "batch").persist()
    s2 = base_scores(t2, art, "batch").persist()
    if art.meta_phase1 is None:
        _phase1(t1, s1, art)
        if path is not None:
            save_artifacts(art, path)
    _phase2(s1, s2, art)
    s1.unpersist()
    s2.unpersist()
    return art


def _phase1(t1: DataFrame, s1: DataFrame, art: Artifacts) -> None:
    cfg = art.cfg
    dec = [b.name for b in art.base if b.kind == "decision"]
    # training ranges of raw decision values, for fitted-mode scoring of single rows
    raw1 = t1
    for b in art.base:
        if b.kind == "decision":
            raw1 = b.score(raw1)
    art.score_ranges = score_range(raw1, dec)
    comb = cfg.features + art.score_names
    c1, _, _ = fuzzy.fcm_fit(s1, comb, cfg.key, c=2, seed=cfg.seed, **cfg.fcm_phase1)
    art.centers_phase1 = c1
    m1 = fuzzy.memberships(s1, comb, c1, 2.0)
    art.meta_phase1 = learners.fit_mlp(m1, art.meta_features, cfg.label, cfg.key, "meta",
                                       hidden=cfg.meta_hidden, max_iter=cfg.meta_iter[0], seed=cfg.seed)


def _phase2(s1: DataFrame, s2: DataFrame, art: Artifacts) -> None:
    cfg = art.cfg
    comb = cfg.features + art.score_names
    fcm_in = weighted_union([(s1, 1.0), (s2, float(cfg.train2_fcm_copies))])
    c2, _, _ = fuzzy.fcm_fit(fcm_in, comb, cfg.key, c=2, weight="w", seed=cfg.seed, **cfg.fcm_final)
    art.centers = c2
    meta_in = weighted_union([(fuzzy.memberships(s1, comb, c2, 2.0), 1.0),
                              (fuzzy.memberships(s2, comb, c2, 2.0), float(cfg.train2_weight))])
    meta_in = meta_in.withColumn("w", F.col("w").cast("int"))
    art.meta = learners.fit_mlp(replicate_by_weight(meta_in, "w"), art.meta_features, cfg.label, cfg.key, "meta",
                                hidden=cfg.meta_hidden, max_iter=cfg.meta_iter[1], seed=cfg.seed,
                                initial_weights=learners.mlp_weights(art.meta_phase1))


def score(df: DataFrame, art: Artifacts, mode: str | None = None, raw: bool = True) -> DataFrame:
    """Full scoring plan. ``raw=True``: df holds unscaled features with zeros for missing."""
    cfg = art.cfg
    out = df
    if raw:
        out = clean.zero_as_missing(out, [c for c in cfg.zero_missing if c in cfg.features])
        for spec in cfg.impute_specs:
            out = impute.apply_imputer(out, art.imputers[spec["target"]], spec["target"])
        out = scale.minmax_transform(out, art.scaler, cfg.features)
    out = base_scores(out, art, mode)
    comb = cfg.features + art.score_names
    out = fuzzy.memberships(out, comb, art.centers, 2.0)
    out = art.meta.score(out).withColumnRenamed("meta", "p_meta")
    return out.withColumn("pred", threshold("p_meta"))


def evaluate(df: DataFrame, art: Artifacts, mode: str | None = None, raw: bool = False) -> DataFrame:
    """Per-model metrics on a scored frame: neural and meta by ``p > 0.5``,
    the others by their own class prediction (margins: sign of the decision
    value, not the normalised score).  One grouped aggregate over the long form."""
    cfg = art.cfg
    scored = score(df, art, mode, raw)
    cols = [F.col(cfg.label).alias("label")]
    preds = {}
    for b in art.base:
        if b.name in ("ANN",) or b.extra.get("family") in ("knn", "mlp"):
            preds[b.name] = threshold(b.name)
    long = scored
    for b in art.base:
        if b.name not in preds:
            long = b.predict(long, f"__pred_{b.name}")
            preds[b.name] = F.col(f"__pred_{b.name}")
    preds["meta"] = F.col("pred")
    stacked = long.select(*cols, F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), e.cast("int").alias("pred")) for n, e in preds.items()])).alias("s"))
    from tessera.operators.metrics import binary_metrics
    return binary_metrics(stacked.select("label", "s.model", "s.pred"), "label", "pred", group=["model"])


def evaluate_imputers(train: DataFrame, val: DataFrame, art: Artifacts) -> DataFrame:
    """R^2 / MSE of each imputer on rows where its target is known, on train
    (outliers removed) and validation (as given); earlier targets are filled
    first, as in scoring.  Adds the overfit bucket of the R^2 gap.

    Both frames hold raw units and their own gaps (``train_given`` and
    ``test_given`` of :func:`prepare`); frames that were filled before are
    refused, since their fills would pass for known values."""
    from tessera.operators.metrics import overfit_bucket, regression_metrics
    filled = [s["target"] for s in art.cfg.impute_specs for f in (train, val) if impute.flag_name(s["target"]) in f.columns]
    if filled:
        raise ValueError(f"imputed before: {', '.join(sorted(set(filled)))}")
    out = None
    for split_name, frame in (("train", outliers.outlier_filter(train, art.bounds)), ("val", val)):
        cur = frame
        for spec in art.cfg.impute_specs:
            t = spec["target"]
            model = art.imputers[t]
            pred = model.transform(cur.where(F.col(t).isNotNull())).select(F.col(t).alias("y"), F.col("__pred").alias("p"))
            m = regression_metrics(pred, "y", "p", digits=None).select(
                F.lit(t).alias("target"), F.lit(split_name).alias("split"), "n", "mse", "r2")
            out = m if out is None else out.unionByName(m)
            cur = impute.apply_imputer(cur, model, t)
    wide = out.groupBy("target").pivot("split", ["train", "val"]).agg(F.first("r2"))
    return out.join(wide.select("target", overfit_bucket(F.col("train") - F.col("val")).alias("overfit")), "target")


def save_artifacts(art: Artifacts, path: str) -> None:
    """Fitted pieces under one folder: ML models with their own writers,
    configuration and small statistics as one JSON document, KNN training rows
    as Parquet.  Phase 2 may be missing."""
    meta = {"cfg": asdict(art.cfg), "models": [], "bounds": art.bounds, "scaler": art.scaler, "score_ranges": art.score_ranges,
            "centers": art.centers, "centers_phase1": art.centers_phase1, "base": []}
    for t, m in (art.imputers or {}).items():
        m.write().overwrite().save(f"{path}/imputer_{t}")
    for b in art.base:
        entry = {"name": b.name, "kind": b.kind, "features": b.features, "key": b.key,
                 "extra": {k: v for k, v in b.extra.items()}}
        if b.extra.get("family") == "knn":
            b.model.write.mode("overwrite").parquet(f"{path}/base_{b.name}")
        elif b.model is not None:
            b.model.write().overwrite().save(f"{path}/base_{b.name}")
        meta["base"].append(entry)
    for name, m in (("meta", art.meta), ("meta_phase1", art.meta_phase1)):
        if m is not None:
            m.model.write().overwrite().save(f"{path}/{name}")
            meta["models"].append(name)
    ss = SparkSession.getActiveSession()
    ss.createDataFrame([(json.dumps(meta),)], "doc STRING").coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def _config(saved: dict) -> StackConfig:
    cfg = StackConfig(**saved)
    cfg.meta_iter = tuple(cfg.meta_iter)
    if isinstance(cfg.ann.get("class_copies"), dict):        # JSON keys are strings
        cfg.ann["class_copies"] = {int(c): n for c, n in cfg.ann["class_copies"].items()}
    return cfg


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    meta = json.loads(spark.read.json(f"{path}/stats").first()["doc"])
    cfg = _config(meta["cfg"])
    art = Artifacts(cfg)
    art.bounds = {k: tuple(v) for k, v in meta["bounds"].items()}
    art.scaler = {k: tuple(v) for k, v in meta["scaler"].items()}
    art.score_ranges = {k: tuple(v) for k, v in (meta["score_ranges"] or {}).items()}
    art.centers, art.centers_phase1 = meta["centers"], meta["centers_phase1"]
    art.imputers = {s["target"]: PipelineModel.load(f"{path}/imputer_{s['target']}") for s in cfg.impute_specs}
    art.base = []
    for e in meta["base"]:
        fam = e["extra"].get("family")
        if fam == "knn":
            model = spark.read.parquet(f"{path}/base_{e['name']}")
        elif fam == "rff":
            model = LinearSVCModel.load(f"{path}/base_{e['name']}")
        elif fam == "given":
            model = None
        else:
            model = PipelineModel.load(f"{path}/base_{e['name']}")
        art.base.append(learners.Fitted(e["name"], e["kind"], e["features"], e["key"], model, e["extra"]))
    for name in meta["models"]:
        setattr(art, name, learners.Fitted("meta", "probability", art.meta_features, cfg.key, PipelineModel.load(f"{path}/{name}"), {"family": "mlp"}))
    return art
