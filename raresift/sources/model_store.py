"""Save fitted models: a JSON description beside the pyspark.ml models and tables it names."""

from __future__ import annotations

import importlib
import json

from pyspark.sql import SparkSession

from raresift.operators import models as M
from raresift.operators import trees
from raresift.operators.features import FeatureSteps
from raresift.operators.search import Fitted


def _save_ml(model, path: str) -> dict:
    model.write().overwrite().save(path)
    return {"path": path, "type": f"{type(model).__module__}.{type(model).__name__}"}


def _load_ml(spec: dict):
    module, _, name = spec["type"].rpartition(".")
    return getattr(importlib.import_module(module), name).load(spec["path"])


def _describe(scorer, path: str) -> dict:
    if isinstance(scorer, M.MLScorer):
        return {"kind": "ml", "model": _save_ml(scorer.model, f"{path}/model")}
    if isinstance(scorer, trees.TreesScorer):
        return {"kind": "trees", **{k: v for k, v in vars(scorer).items() if k not in ("kind", "trees")}, "of": scorer.kind,
                "trees": [vars(t) for t in scorer.trees]}
    if isinstance(scorer, M.MarginScorer):
        lift = scorer.lift
        kind = {M.FourierLift: "fourier", M.PolynomialLift: "poly"}.get(type(lift))
        return {"kind": "margin", "model": _save_ml(scorer.model, f"{path}/model"), "platt": scorer.platt,
                "lift": {"kind": kind, **vars(lift)} if lift else None}
    scorer.data.write.mode("overwrite").parquet(f"{path}/rows")
    spec = {k: v for k, v in vars(scorer).items() if k != "data"}
    return {"kind": "neighbours", "rows": f"{path}/rows", **spec}


def _restore(spark: SparkSession, spec: dict):
    kind = spec["kind"]
    if kind == "trees":
        return trees.TreesScorer(spec["of"], [trees.Tree(**t) for t in spec["trees"]], spec["start"], spec["scale"])
    if kind == "ml":
        return M.MLScorer(_load_ml(spec["model"]))
    if kind == "margin":
        lift = spec["lift"]
        if lift:
            lift = {**lift}
            lift = {"fourier": M.FourierLift, "poly": M.PolynomialLift}[lift.pop("kind")](**lift)
        return M.MarginScorer(_load_ml(spec["model"]), tuple(spec["platt"]), lift)
    return M.NeighbourScorer(spark.read.parquet(spec["rows"]), spec["columns"], spec["k"], spec["weights"], spec["p"],
                             spec["label"], spec["row_id"])


def save_model(spark: SparkSession, fitted: Fitted, path: str) -> None:
    spec = {"name": fitted.name, "params": {k: str(v) for k, v in fitted.params.items()}, "steps": vars(fitted.steps),
            "scorer": _describe(fitted.scorer, path)}
    spark.createDataFrame([(json.dumps(spec),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load_model(spark: SparkSession, path: str) -> Fitted:
    spec = json.loads(spark.read.text(f"{path}/spec").first()["value"])
    steps = spec["steps"]
    steps = FeatureSteps(steps["columns"], {c: tuple(v) for c, v in steps["stats"].items()}, steps["selected"])
    return Fitted(spec["name"], steps, _restore(spark, spec["scorer"]), spec["params"])
