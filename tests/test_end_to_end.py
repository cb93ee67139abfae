"""Both plans on CSV files written for the purpose: two domains, scripted runs, sparse sensors."""

import csv

import pytest
from pyspark.sql import functions as F

from driftline.plans import gated, scoring, transfer
from driftline.sources import events as ev

START = 1_700_000_000
SOURCE_KINDS, TARGET_KINDS = ("normal", "manipulation"), ("normal", "fault", "manipulation", "recon")


def stamp(second):
    minutes, s = divmod(second, 60)
    return f"2023-11-14T{22 + (13 + minutes) // 60:02d}:{(13 + minutes) % 60:02d}:{s:02d}+00:00"


def run_rows(site, prefix, run, kind, rows=20, warmup=4, step=5):
    """Twenty rows per run; the first four are warm-up and always normal."""
    label = {"normal": "normal", "fault": "fault"}.get(kind, "attack")
    for i in range(rows):
        write = i % 2 == 1
        yield {
            "source_dataset": site, "run_id": f"{kind}-{run}", "scenario": f"{prefix}{kind}",
            "label": "normal" if i < warmup else label, "phase": "warmup" if i < warmup else "act",
            "event_type": "flow" if i % 5 == 0 else "modbus", "timestamp": stamp(20 + i * step),
            "pkts_toserver": i % 3 if label != "attack" or i < warmup else 5 + i,
            "modbus_function": 6 if write else 3, "modbus_access": "WRITE" if write else "READ",
            "rudder_angle": (run * 3 + i * 2) if i % 3 == 0 else "",
        }


def write(path, rows):
    with path.open("w", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("runs")
    src = [r for run in range(8) for k in SOURCE_KINDS for r in run_rows("site_a", "", run, k)]
    source = ev.number_events(ev.scan_events(spark, write(d / "source.csv", src)))
    files = [write(d / f"{k}{run}.csv", list(run_rows("site_b", "dom_", run, k))) for run in range(3) for k in TARGET_KINDS]
    return source, ev.number_events(ev.scan_campaign(spark, files))


def entries(spark, runs, only=None):
    rows = [(r, "baseline", stamp(20)) for r in runs] + [(r, "act", stamp(40)) for r in runs]
    df = spark.createDataFrame([r for r in rows if only is None or r[0] in only], "run_id string, phase string, timestamp string")
    return df.withColumn("name", F.lit(None).cast("string"))


RUNS = [f"{k}-{i}" for k in TARGET_KINDS for i in range(3)]


def test_numbers_are_unique(tables):
    source, target = tables
    assert source.count() == 320 and source.select("event_id").distinct().count() == 320
    assert target.count() == 240 and target.filter("file is null").count() == 0


def test_masks_and_episode_basis(spark, tables):
    source, target = tables
    args = dict(seeds=(42,), force=True, replicates=50)
    phased = gated.gated_eval(source, target, "physical_proxy", entries(spark, RUNS), **args).first()
    assert phased.n_manipulation_attack_rows == 3 * 16 and phased.n_recon_attack_rows == 48
    assert phased.episode_basis_manipulation == "ground_truth_phase"
    partly = gated.gated_eval(source, target, "flow", entries(spark, RUNS, only={"recon-0", "recon-1", "recon-2"}), **args).first()
    assert (partly.episode_basis_manipulation, partly.episode_basis_recon) == ("phase_column", "ground_truth_phase")
    bare = gated.gated_eval(source, target.drop("phase"), "flow", None, **args).first()
    assert bare.episode_basis_recon == "run_id" and bare.n_episodes_recon == 3
    assert bare.recall_episode_recon_lo <= bare.recall_episode_recon <= bare.recall_episode_recon_hi


def test_gate_names_the_missing_fault_class(spark, tables):
    """The source has no fault runs and too few negatives, so the headline is refused."""
    source, target = tables
    row = gated.gated_eval(source, target, "flow", entries(spark, RUNS), seeds=(42,), replicates=50).first()
    assert row["mode"] == "contract" and row.n_reasons >= 2 and row.recall_event_recon is None


def test_multiseed_spread(spark, tables):
    source, target = tables
    per_seed = gated.gated_eval(source, target, "physical_proxy", entries(spark, RUNS), seeds=(1, 2, 3), force=True, replicates=50)
    assert sorted(r.seed for r in per_seed.collect()) == [1, 2, 3]
    summary = gated.multiseed_summary(per_seed).collect()
    assert len(summary) == 6 and all(s["min"] <= s["mean"] <= s["max"] for s in summary)


def test_transfer_result_is_complete(spark, tables):
    source, target = tables
    exp = transfer.Experiment(seeds=(42, 43), schemas=("flow", "physical_proxy"), replicates=40, force=True)
    rows = transfer.transfer_experiment(source, target, scoring.forest_scorer(5, 4), exp).collect()
    primary = [r for r in rows if r.section == "primary_ensemble"]
    assert len(primary) == 8 and all(0 <= r.lo <= r.hi <= 1 for r in primary)
    auc = [r for r in rows if r.metric == "source_validation_auc"]
    assert len(auc) == 2 and all(r.n == 2 and r.min <= r.value <= r.max for r in auc)
    fpr = [r for r in rows if r.metric == "source_validation_fpr"]
    assert all(r.max <= 0.01 for r in fpr)
    audit = {(r.section, r.metric): r.value for r in rows if r.section.startswith("audit_")}
    assert audit[("audit_raw", "n_rows")] == 320 and audit[("audit_target", "n_runs")] == 12
