"""Physical-plan properties of catalog queries on the large driver tables.

* every exchange into a single partition carries aggregated rows (a global
  aggregate or the small bucket-offset table), never raw rows for a window;
* no Python evaluation outside projection / scoring.
"""

import re

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
PYTHON_OPS = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroupsInPandas", "PythonUDF")
NO_PYTHON = [
    "eval_report", "roc_points", "roc_points_ties", "roc_auc_ties", "threshold_metrics_ties", "cohort_cells",
    "label_pack_recode", "incomplete_filter", "group_split", "zscore_apply", "zscore_wide", "class_weights",
    "batch_numbers", "epoch_shuffle",
]
AGG = re.compile(r"(HashAggregate|ObjectHashAggregate|SortAggregate|AQEShuffleRead|ShuffleQueryStage|LocalTableScan)")


def _final_plan(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_plan_properties(spark, name):
    plan = _final_plan(spark, name)
    assert not any(op in plan for op in PYTHON_OPS), plan
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1] if i + 1 < len(lines) else ""
            assert AGG.search(child), f"single-partition exchange over non-aggregated rows in {name}:\n{plan}"


def test_split_is_a_subquery_not_a_join(spark):
    # the distinct-id exchange is reused by both uses inside the cutoff; the cutoff is one
    # scalar subquery, so the study rows are not joined at all
    df = E.queries()["group_split"](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(set(re.findall(r"Subquery subquery#(\d+)", plan))) == 1, plan  # one cutoff subquery
    assert "ReusedExchange" in plan and "SortMergeJoin" not in plan and "NestedLoopJoin" not in plan


EVALUATIONS = ["roc_auc", "roc_points", "roc_trapezoid", "eval_report", "results_write", "modal_eval_report", "modal_eval_roc"]


ACTIONS = ("collect", "count", "isEmpty", "approxQuantile", "toArrow", "toLocalIterator")


@pytest.fixture
def action_plans(monkeypatch):
    """The plans of all frames that an action runs on, while building a query and after."""
    from pyspark.sql import DataFrameWriter
    from pyspark.sql.classic.dataframe import DataFrame

    seen = []

    def log(frame):
        seen.append(frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])

    def wrapped(method, frame_of):
        def run(self, *args, **kw):
            log(frame_of(self))
            return method(self, *args, **kw)

        return run

    for name in ACTIONS:
        monkeypatch.setattr(DataFrame, name, wrapped(getattr(DataFrame, name), lambda x: x))
    monkeypatch.setattr(DataFrameWriter, "parquet", wrapped(DataFrameWriter.parquet, lambda x: x._df))
    return seen


@pytest.mark.parametrize("name", EVALUATIONS)
def test_scores_are_read_once_over_all_jobs(spark, name, action_plans):
    E.queries()[name](spark, SF).collect()
    scoring = [p for p in action_plans if "MapInArrow" in p] if name.startswith("modal") else [p for p in action_plans if "labels.parquet" in p]
    assert len(scoring) == 1, action_plans
    assert scoring[0].count("MapInArrow") == name.startswith("modal")


@pytest.mark.parametrize("name", ["modal_eval_report", "modal_eval_roc"])
def test_every_row_is_scored_once(spark, name, monkeypatch):
    """Counted in the scorer itself, over all jobs of the query."""
    from mmcohort.plans import training as TR

    rows = spark.sparkContext.accumulator(0)
    make = TR.fixture_scorer()

    def counting():
        predict = make()

        def run(seq):
            rows.add(len(seq))
            return predict(seq)

        return run

    monkeypatch.setattr(TR, "fixture_scorer", lambda: counting)
    E.queries()[name](spark, SF).collect()
    val = TR.modal_split(spark, SF).where("split = 'val'").count()
    assert rows.value == val > 0


@pytest.mark.parametrize("name", ["loss_combined", "epoch_loss", "loss_isolated", "history_append", "decode_mse"])
def test_no_codes_in_any_table(spark, name, action_plans):
    E.queries()[name](spark, SF).collect()
    assert action_plans and not any("code_" in p or "recon_" in p for p in action_plans)


@pytest.mark.parametrize("name", ["pipeline_report", "loss_combined"])
def test_scratch_scope_leaves_nothing(spark, name):
    import glob

    from mmcohort.session import ensure_checkpoint_dir, scratch_scope

    base = ensure_checkpoint_dir(spark).removeprefix("file:").rstrip("/")
    before = set(glob.glob(f"{base}/mmcohort/*"))
    with scratch_scope(spark):
        rows = E.queries()[name](spark, SF).collect()
        assert set(glob.glob(f"{base}/mmcohort/*")) > before
    assert rows and set(glob.glob(f"{base}/mmcohort/*")) == before


def test_unset_shared_folder_is_an_error_beyond_one_machine():
    from mmcohort.session import shared_folder

    assert shared_folder("hdfs://x/y", "yarn") == "hdfs://x/y"
    assert shared_folder(None, "local[4]") and shared_folder(None, "local")
    for master in ("yarn", "spark://h:7077", "k8s://h", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(None, master)
