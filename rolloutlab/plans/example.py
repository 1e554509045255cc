"""The whole run on generated episodes: policies, evaluation, sensitivities and all files, as one entry.

``python -m rolloutlab.plans.example --out DIR [--seed N]`` writes them.
"""

from __future__ import annotations

import argparse
import json
import platform
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EPISODE
from ..sources.files import file_digests, json_safe, write_artifacts, write_csv, write_json
from ..sources.synthetic import generate
from .evaluate import build_policies, evaluate_policies, predictions, refit_sensitivity, seed_sensitivity, settings_of
from .roles import training_roles

#: The settings of the published example, in the names of a configuration file.
CONFIG = {
    "experiment": {"seed": 41, "horizon": 3, "gamma": 1.0, "policy_development_fraction": 0.6, "bootstrap_resamples": 200, "bootstrap_confidence": 0.95, "behavior_probability_floor": 0.001,
                   "importance_ratio_caps": [2.0, 10.0, 50.0], "primary_importance_ratio_cap": 10.0, "primary_q_learner": "hist_gradient_boosting", "q_learner_sensitivity": "ridge",
                   "winner_gates": {"max_fallback_rate": 0.02, "min_mean_overlap": 0.5, "max_low_support_mass": 0.05, "min_terminal_raw_ess": 10, "max_episode_weight_share": 0.2}},
    "behavior_model": {"c_grid": [0.1, 1.0], "group_folds": 3},
    "fqe": {"hist_gradient_boosting": {"max_iter": 25, "min_samples_leaf": 5, "max_leaf_nodes": 7, "learning_rate": 0.1, "l2_regularization": 1.0}, "ridge": {"alpha": 5.0}},
}


def run_example(spark: SparkSession, root: str, config: Mapping = CONFIG, data: Mapping[str, DataFrame] | None = None, sensitivity: bool = True) -> dict:
    """Runs everything and writes it under ``root``: tables, verdict, configuration, receipt, input manifest, predictions. Returns the verdict."""
    settings = settings_of(config)
    tables = data or generate(spark, settings.seed)
    policies, receipt = build_policies(tables["train"], settings)
    result = evaluate_policies(tables["train"], tables["validation"], policies, settings)
    more: dict[str, DataFrame] = {}
    report = {"verdict": result.verdict, "receipt": result.receipt, "behavior": result.behavior}
    if sensitivity:
        more["provider_sensitivity"], report["provider_behavior"] = refit_sensitivity(tables["train"], tables["validation"], policies, settings, ("hospital_id", "provider_id"))
        more["seed_sensitivity"] = seed_sensitivity(tables["train"], tables["validation"], policies, settings, result.episodes)
    roles = training_roles(tables["train"], settings.fraction, settings.seed).withColumn("manifest_sha256", F.lit(receipt["role_manifest_sha256"]))
    write_artifacts(result, roles, root, more)
    write_json(spark, report, f"{root}/metrics")
    for split, df in tables.items():
        write_csv(df, f"{root}/synthetic_{split}", "\n")
    if "test" in tables:
        write_csv(predictions(tables["test"], policies["llm_improved"], settings.observed), f"{root}/predictions", "\n")
    manifest = {"seed": settings.seed, "data_origin": "fresh_generator" if data is None else "caller_supplied", "test_outcomes_used": False,
                "runtime_versions": {"python": platform.python_version(), "spark": spark.version},
                "splits": {split: {"rows": df.count(), "episodes": df.select(EPISODE).distinct().count(),
                                   "sha256": file_digests(spark, f"{root}/synthetic_{split}/part-*").first()["sha256"]} for split, df in tables.items()}}
    for name, value in (("policy_build", receipt), ("input_manifest", manifest), ("config", dict(config))):
        write_json(spark, value, f"{root}/{name}")
    return json_safe(result.verdict)


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--out", required=True)
    parser.add_argument("--seed", type=int, default=41)
    args = parser.parse_args()
    spark = SparkSession.builder.getOrCreate()
    config = {**CONFIG, "experiment": {**CONFIG["experiment"], "seed": args.seed}}
    print(json.dumps(run_example(spark, args.out, config), indent=2))


if __name__ == "__main__":
    main()
