"""Campaigns against their manifests: planted faults are failed rows and withhold the numbers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from driftline.operators import contracts
from driftline.plans import gated, scoring, transfer
from driftline.sources import events as ev
from driftline.sources import files
from tests.test_end_to_end import SOURCE_KINDS, TARGET_KINDS, run_rows, write


@pytest.fixture(scope="module")
def campaign(spark, tmp_path_factory):
    """Twelve run files, two of them with a column less, and what their manifest should say."""
    root = tmp_path_factory.mktemp("campaign")
    told = []
    for run in range(3):
        for kind in TARGET_KINDS:
            rows = list(run_rows("site_b", "dom_", run, kind))
            if kind == "normal":
                rows = [{k: v for k, v in r.items() if k != "rudder_angle"} for r in rows]
            name = f"{kind}{run}.csv"
            write(root / name, rows)
            told.append((f"{kind}-{run}", len(rows), name, hashlib.sha256((root / name).read_bytes()).hexdigest()))
    target = ev.scan_campaign(spark, [str(root)]).withColumn("output", F.element_at(F.split("file", "/"), -1))
    return target, told, files.file_inventory(spark, str(root))


def failed(spark, campaign, change):
    target, told, inventory = campaign
    manifest = spark.createDataFrame(change(list(told)), "run string, rows long, output string, output_sha256 string")
    checks = contracts.campaign_contract(
        target, manifest, inventory, ("flow", "modbus"), ("normal", "fault", "attack"), ("normal", "fault", "manipulation", "recon")
    )
    return checks, {(r.check_name, r.subject) for r in checks.filter("not passed").collect()}


def swap(told, at, **new):
    row = dict(zip(("run", "rows", "output", "sha"), told[at]), **new)
    return [*told[:at], tuple(row.values()), *told[at + 1:]]


@pytest.mark.parametrize("change, expected", [
    (lambda t: t, set()),
    (lambda t: swap(t, 0, sha="0" * 64), {("file_hash", "normal0.csv")}),
    (lambda t: swap(t, 1, rows=19), {("run_rows", "fault-0"), ("total_rows", "count")}),
    (lambda t: swap(t, 2, run="other-0"), {("single_run_id", "other-0")}),
    (lambda t: t[1:], {("file_listed", "normal0.csv"), ("run_rows", "normal0.csv"), ("single_run_id", "normal0.csv"), ("total_rows", "count")}),
    (lambda t: [*t, ("ghost", 5, "ghost.csv", "1" * 64)],
     {("file_listed", "ghost.csv"), ("file_hash", "ghost.csv"), ("run_rows", "ghost"), ("single_run_id", "ghost"), ("total_rows", "count")}),
    (lambda t: swap(t, 3, sha=None), {("file_hash", "recon0.csv")}),
], ids=["right", "hash", "rows", "run", "undeclared", "missing", "no hash"])
def test_each_fault_is_a_failed_row(spark, campaign, change, expected):
    assert failed(spark, campaign, change)[1] == expected


def test_a_fault_withholds_the_numbers_before_anything_is_scored(spark, campaign, tmp_path):
    src = [r for run in range(8) for k in SOURCE_KINDS for r in run_rows("site_a", "", run, k)]
    source = ev.number_events(ev.scan_events(spark, write(tmp_path / "source.csv", src)))
    target = ev.number_events(campaign[0])
    bad, _ = failed(spark, campaign, lambda t: swap(t, 0, sha="0" * 64))

    def never(train, schema, seed):
        raise AssertionError("scored")

    exp = transfer.Experiment(seeds=(1, 2), schemas=("flow", "protocol"), replicates=50, minimum_normals=1)
    out = transfer.transfer_experiment(source, target, never, exp, bad).filter("schema <> ''").collect()
    assert len(out) == 24 and all(r.value is None and not r.ready and r.n_reasons == 1 for r in out)
    good, _ = failed(spark, campaign, lambda t: t)
    out = transfer.transfer_schema(source, target, "flow", scoring.rule_scorer(), exp, good).collect()
    listed = {(r.section, r.metric) for r in transfer.withheld(spark, "flow", exp, 1).collect()}
    # This source has no fault runs, so nothing is said of stress.
    assert {(r.section, r.metric) for r in out} == {x for x in listed if x[1] not in transfer.STRESS_METRICS}
    report = gated.gated_eval(source, target, "flow", None, seeds=(1,), replicates=20, inputs=bad).first()
    assert report.mode == "contract" and report.threshold is None


def test_layouts_are_parsed_in_one_scan(spark, campaign):
    target, told, _ = campaign
    assert {(r.output, r.n) for r in target.groupBy("output").agg(F.count(F.lit(1)).alias("n")).collect()} == {(t[2], t[1]) for t in told}
    assert target.filter(F.col("output").startswith("normal") & F.col("rudder_angle").isNotNull()).count() == 0
    assert target.filter(F.col("output").startswith("fault") & F.col("rudder_angle").isNotNull()).count() == 21
    plan = target._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1
