"""The public API: verdicts for cases, their combination with a scorer, and runs of mutants."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfold.operators import cascade, fold
from stepfold.operators.normalise import normalise
from stepfold.operators.rules import BASELINES, MUTANTS

SCORES = "case_id string, model string, p_fail double"


def verify(steps: DataFrame, with_trace: bool = False, off: Iterable[str] = ()) -> DataFrame:
    """case_id, prediction, final_rule_id, n_steps and, if asked, trace, for each case of `steps`.

    steps: case_id, step_idx, input, output (JSON text). A case without a step has no row here; see
    `with_empty_cases`. Columns that nobody selects, the trace above all, are not computed.
    """
    return cascade.judge(fold.state(normalise(steps)), with_trace, frozenset(off))


def verify_case(spark: SparkSession, records: list | dict | str, with_trace: bool = False) -> dict:
    """The verdict of one case, given as records or as their JSON text."""
    from stepfold.sources.trajectories import steps_of

    case = spark.createDataFrame([("case", records if isinstance(records, str) else json.dumps(records))], "case_id string, raw string")
    return with_empty_cases(verify(steps_of(case), with_trace), case).drop("case_id").first().asDict(recursive=True)


def with_empty_cases(verdicts: DataFrame, ids: DataFrame) -> DataFrame:
    """The verdicts of all ids: a case without steps fails, as one that cannot be parsed."""
    out = ids.select("case_id").distinct().join(verdicts, "case_id", "left")
    return out.na.fill({"prediction": "fail", "final_rule_id": "PARSE_FINAL_COMMAND", "n_steps": 0})


def predict(spark: SparkSession, cases: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """case_id, prediction of all cases (see `sources.trajectories.cases_from_json`); a scorer may correct the rules."""
    from stepfold.sources.trajectories import steps_of

    out = with_empty_cases(verify(steps_of(cases)), cases)
    return (ensemble(out, scores) if scores is not None else out).select("case_id", "prediction")


def ensemble(verdicts: DataFrame, scores: DataFrame) -> DataFrame:
    """Verdicts corrected by a model's labels (case_id, model): it may fail what passed, and may pass what failed
    only because of an unexplained error status. Cases without a score keep their verdict."""
    d = verdicts.join(scores.select("case_id", F.col("model").alias("_model")), "case_id", "left")
    label = F.coalesce("_model", "prediction")
    fixed = (
        F.when((F.col("prediction") == "pass") & (label == "fail"), "fail")
        .when((F.col("prediction") == "fail") & (label == "pass") & (F.col("final_rule_id") == "UNEXPECTED_ERROR_STATUS"), "pass")
        .otherwise(F.col("prediction"))
    )
    return d.withColumns({"rule": F.col("prediction"), "model": F.col("_model"), "prediction": fixed}).drop("_model")


def score(prompts: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> DataFrame:
    """Labels of prompts (case_id, prompt) by a model that `load` brings up once a worker, in Arrow batches.

    A model that cannot be loaded scores nothing: the rules then stand alone.
    """

    def run(batches):
        import pandas as pd

        try:
            model = load()
        except Exception:  # noqa: BLE001  any failure to load means that there is no model
            return
        for b in batches:
            got = model(list(b["prompt"]))
            yield pd.DataFrame({"case_id": b["case_id"], "model": [x for x, _ in got], "p_fail": [float(p) for _, p in got]})

    return prompts.select("case_id", "prompt").mapInPandas(run, SCORES)


def mutants(steps: DataFrame, with_rules: bool = False) -> DataFrame:
    """mutant_id, case_id, prediction of every case under every mutant of the rules, in one job; with_rules: and as the
    rules are, as the mutant ''."""
    spark = steps.sparkSession
    every = spark.createDataFrame([*MUTANTS.items(), *([("", "")] if with_rules else [])], "mutant_id string, switch string")
    states = fold.state(normalise(steps)).crossJoin(F.broadcast(every))  # a fixed handful of rows
    judged = cascade.judge(states.withColumn("case_id", F.struct("mutant_id", "case_id")), switch=F.col("switch"))
    return judged.select("case_id.mutant_id", "case_id.case_id", "prediction")


def mutation_runs(steps: DataFrame) -> DataFrame:
    """mutant_id, case_id, prediction, was: each mutant's verdict beside that of the rules, from one pass over the cases."""
    own = F.max(F.when(F.col("mutant_id") == "", F.col("prediction"))).alias("was")
    g = mutants(steps, with_rules=True).groupBy("case_id").agg(own, F.collect_list(F.when(F.col("mutant_id") != "", F.struct("mutant_id", "prediction"))).alias("m"))
    return g.select("case_id", "was", F.explode("m").alias("m")).select("m.mutant_id", "case_id", "m.prediction", "was")


def kill_report(runs: DataFrame) -> DataFrame:
    """mutant_id, n_changed, killed, is_baseline of `mutation_runs`."""
    changed = F.count_if(~F.col("prediction").eqNullSafe(F.col("was")))
    return runs.groupBy("mutant_id").agg(changed.alias("n_changed"), (changed > 0).alias("killed")).withColumn("is_baseline", F.col("mutant_id").isin(BASELINES))


def mutation_report(original: DataFrame, mutated: DataFrame) -> DataFrame:
    """mutant_id, is_baseline, n_changed, killed: how many predictions each mutant changes."""
    return kill_report(mutated.join(original.select("case_id", F.col("prediction").alias("was")), "case_id"))


def score_deltas(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """mutant_id, n_correct, delta: how many labelled cases (case_id, label) each mutant judges right, and how many more than the rules do."""
    right = lambda c: F.count_if(F.col(c) == F.col("label"))
    return runs.join(labels, "case_id").groupBy("mutant_id").agg(right("prediction").alias("n_correct"), (right("prediction") - right("was")).alias("delta"))


def mutation_score(report: DataFrame) -> DataFrame:
    """The share of mutants, baselines left out, that are killed."""
    return report.where(~F.col("is_baseline")).agg(F.count("*").alias("n_mutants"), F.count_if("killed").alias("n_killed"), F.coalesce(F.avg(F.col("killed").cast("double")), F.lit(0.0)).alias("mutation_score"))
