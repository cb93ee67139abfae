"""Data contracts as queries: every check is a row, and failed checks withhold results.

Rows are ``(check_name, subject, expected, actual, passed)``, all text but the last, optionally
preceded by key columns such as ``seed``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.catalog import OTHER
from driftline.operators.ordered import checkpointed
from driftline.operators.pools import rows_of, with_family
from driftline.operators.splits import TRAIN, VALIDATION

MIN_REPEATS = 3
MIN_DURATION_SEC = 60
MIN_CLASS_RUNS = 2
COLUMNS = ["check_name", "subject", "expected", "actual", "passed"]


class ContractError(ValueError):
    """At least one contract check failed."""


def _text(value: Column | str | int) -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast("string")


def check(
    df: DataFrame, name: str, subject, expected, actual, passed: Column, keys: Sequence[str] = ()
) -> DataFrame:
    return df.select(
        *keys,
        F.lit(name).alias("check_name"),
        _text(subject).alias("subject"),
        _text(expected).alias("expected"),
        _text(actual).alias("actual"),
        F.coalesce(passed, F.lit(False)).alias("passed"),
    )


def union_checks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def assert_all(checks: DataFrame, show: int = 20) -> None:
    """Raise with the first failed checks; a passing contract returns nothing."""
    failed = checks.filter(~F.col("passed")).limit(show).collect()
    if failed:
        raise ContractError("; ".join(f"{r.check_name}[{r.subject}]: {r.actual} (expected {r.expected})" for r in failed))


def checks_from_aggregate(row: DataFrame, specs: Sequence[tuple], keys: Sequence[str] = ()) -> DataFrame:
    """Several checks over one aggregate row: ``(name, subject, expected, actual, passed)`` each."""
    structs = [
        F.struct(
            F.lit(n).alias("check_name"),
            _text(s).alias("subject"),
            _text(e).alias("expected"),
            _text(a).alias("actual"),
            F.coalesce(p, F.lit(False)).alias("passed"),
        )
        for n, s, e, a, p in specs
    ]
    return row.select(*keys, F.explode(F.array(*structs)).alias("c")).select(*keys, "c.*")


def set_check(
    df: DataFrame, column: str, name: str, expected: Sequence, subset: bool = False
) -> DataFrame:
    """Distinct values against an expected set, counted on both sides instead of collected."""
    wanted = sorted({str(v) for v in expected})
    values = df.select(F.col(column).cast("string").alias("v")).distinct()
    known = F.coalesce(F.col("v").isin(wanted), F.lit(False))
    row = values.agg(
        F.count(F.when(known, 1)).alias("hit"), F.count(F.when(~known, 1)).alias("extra")
    )
    good = F.col("extra") == 0
    if not subset:
        good = good & (F.col("hit") == len(wanted))
    actual = F.concat(F.col("hit"), F.lit(" known, "), F.col("extra"), F.lit(" other"))
    return check(row, name, column, f"{len(wanted)} known, 0 other", actual, good)


def value_profile(df: DataFrame, columns: Sequence[str], times: bool = False) -> DataFrame:
    """Row counts per combination of the contract columns present, checkpointed.

    Contracts look at a table from many sides; this is the one pass over its rows. Combinations of
    run, scenario, label and type are few next to the events.
    """
    have = [c for c in columns if c in df.columns]
    aggs = [rows_of(df).alias("n_rows")]
    if times and "t_us" in df.columns:
        aggs += [F.min("t_us").alias("lo"), F.max("t_us").alias("hi")]
    return checkpointed(df.groupBy(*have).agg(*aggs))


def readiness_checks(
    test: DataFrame,
    entries: DataFrame | None,
    min_repeats: int = MIN_REPEATS,
    min_duration: int = MIN_DURATION_SEC,
) -> DataFrame:
    """Is the test domain fit for headline numbers? Checks whose columns are absent are left out."""
    have = set(test.columns)
    seen = value_profile(test, ["run_id", "scenario", "label"], times=True)
    parts = []
    if "run_id" in have:
        per_run = seen.groupBy("run_id").agg(
            F.sum("n_rows").alias("n_rows"),
            *([F.count_distinct("label").alias("n_labels")] if "label" in have else []),
            *([F.min("lo").alias("lo"), F.max("hi").alias("hi")] if "t_us" in have else []),
        )
        parts.append(_phase_check(per_run, entries))
        if "label" in have:
            row = per_run.agg(
                F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("n_labels") > 1, 1)).alias("mixed")
            )
            passed = (F.col("n") == 0) | (F.col("mixed") > 0)
            parts.append(check(row, "phase_level_labels", "runs with several labels", ">=1", F.col("mixed"), passed))
        if "t_us" in have:
            seconds = F.floor((F.col("hi") - F.col("lo")) / 1000000)
            short = F.coalesce(F.col("hi") - F.col("lo") < min_duration * 1000000, F.lit(False))
            actual = F.coalesce(seconds.cast("string"), F.lit("no time"))
            parts.append(check(per_run, "run_duration_sec", F.col("run_id"), f">={min_duration}", actual, ~short))
    if "scenario" in have:
        row = with_family(seen.select("scenario").distinct()).agg(
            F.count(F.when(F.col("family") == OTHER, 1)).alias("n")
        )
        parts.append(check(row, "scenario_mapped", "unmapped scenario names", 0, F.col("n"), F.col("n") == 0))
        if "run_id" in have:
            runs = with_family(seen).groupBy("family").agg(F.count_distinct("run_id").alias("n"))
            parts.append(
                check(runs, "family_repeats", F.col("family"), f">={min_repeats}", F.col("n"), F.col("n") >= min_repeats)
            )
    return union_checks(*parts)


def _phase_check(per_run: DataFrame, entries: DataFrame | None) -> DataFrame:
    """Any run with a non-empty phase list, its own or the run-less one."""
    if entries is None:
        row = per_run.agg(F.lit(0).alias("n"))
    else:
        filled = F.max(F.coalesce("phase", "name", "timestamp").isNotNull().cast("int"))
        lists = entries.groupBy("run_id").agg(filled.alias("filled"))
        own = lists.filter(F.col("run_id").isNotNull())
        # The run-less document answers for runs that are not mapped; it is at most one row.
        shared = lists.filter(F.col("run_id").isNull()).agg(F.max("filled").alias("filled")).first()["filled"] or 0
        joined = per_run.select("run_id").join(own, "run_id", "left")
        row = joined.agg(F.coalesce(F.sum(F.coalesce("filled", F.lit(shared))), F.lit(0)).alias("n"))
    return check(row, "ground_truth_phases", "runs with phases", ">=1", F.col("n"), F.col("n") > 0)


def split_checks(profile: DataFrame, max_fpr: float) -> DataFrame:
    """Can the threshold be trusted? ``profile`` comes from :func:`splits.split_profile`.

    An empty validation side stops the later checks of its seed, as nothing can be counted.
    """
    need = ceil(1.0 / max_fpr) if max_fpr > 0 else 0
    validation = F.col("side") == VALIDATION
    row = profile.groupBy("seed").agg(
        F.max("basis").alias("basis"),
        _rows(validation).alias("n_val"),
        _rows(validation & (F.col("label") != "attack")).alias("n_neg"),
    )
    both = row.join(_shared_runs(profile), "seed")
    stop = F.col("n_val") == 0
    return checks_from_aggregate(
        both,
        [
            ("split_basis", "basis", "run", F.col("basis"), F.col("basis") == "run"),
            ("validation_rows", "rows", ">=1", F.col("n_val"), ~stop),
            ("run_overlap", "shared runs", 0, F.col("shared"), stop | (F.col("shared") == 0)),
            ("validation_negatives_present", "rows", ">=1", F.col("n_neg"), stop | (F.col("n_neg") > 0)),
            (
                "validation_negatives_enough", "rows", f">={need}", F.col("n_neg"),
                stop | (F.col("n_neg") == 0) | (F.col("n_neg") >= need),
            ),
        ],
        ["seed"],
    )


def _rows(mask: Column) -> Column:
    return F.coalesce(F.sum(F.when(mask, F.col("n_rows"))), F.lit(0))


def _shared_runs(profile: DataFrame) -> DataFrame:
    sides = profile.groupBy("seed", "run_id").agg(F.count_distinct("side").alias("sides"))
    return sides.groupBy("seed").agg(F.count(F.when(F.col("sides") > 1, 1)).alias("shared"))


def class_composition(
    profile: DataFrame, test: DataFrame, seeds: Sequence[int], minimum: int = MIN_CLASS_RUNS
) -> DataFrame:
    """Every negative test label must occur in enough independent runs of both sides, per seed.

    Runs count, not rows. An absent class and a thin one are separate reasons.
    """
    negatives = test.filter(F.col("label") != "attack").select("label").distinct()
    wanted = negatives.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds]))).withColumn(
        "side", F.explode(F.array(F.lit(TRAIN), F.lit(VALIDATION)))
    )
    counts = profile.groupBy("seed", "side", "label").agg(F.count_distinct("run_id").alias("n"))
    full = wanted.join(counts, ["seed", "side", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    subject = F.concat_ws("/", "side", "label")
    return checks_from_aggregate(
        full,
        [
            ("class_present", subject, ">=1", F.col("n"), F.col("n") > 0),
            ("class_runs", subject, f">={minimum}", F.col("n"), (F.col("n") == 0) | (F.col("n") >= minimum)),
        ],
        ["seed"],
    )


def expect(df: DataFrame, aggregates: Mapping[str, tuple[Column, object]]) -> DataFrame:
    """Equality checks of aggregates against declared values: ``{name: (aggregate, expected)}``."""
    row = df.agg(*[a.alias(name) for name, (a, _) in aggregates.items()])
    return checks_from_aggregate(
        row,
        [(n, "count", e, F.col(n), F.col(n) == F.lit(e)) for n, (_, e) in aggregates.items()],
    )


def source_contract(raw: DataFrame, main: DataFrame, stress: DataFrame, expected: Mapping) -> DataFrame:
    """Row counts, run sets, label counts and leak checks of the source pools.

    A non-numeric run id makes the strict cast fail, as the contract demands.
    """
    required = [c for c in ("run_id", "label", "scenario", "event_type") if c not in raw.columns]
    if required:
        raise ContractError(f"required columns missing: {required}")
    columns = ["run_id", "label", "scenario", "event_type"]
    seen, kept, held = (value_profile(df, columns) for df in (raw, main, stress))
    total = F.coalesce(F.sum("n_rows"), F.lit(0))
    accepted = F.col("event_type").isin(list(expected["event_types"]))
    fault_runs = seen.filter(accepted & (F.col("label") == "fault"))
    leak = kept.filter(
        F.col("run_id").isin(list(expected["fault_runs"]))
        | ~F.col("label").isin(list(expected["labels"]))
        | ~accepted
    )

    def of_label(label: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n_rows"))), F.lit(0))

    return union_checks(
        expect(seen.withColumn("_run", F.col("run_id").cast("int")), {
            "raw_rows": (total, expected["raw_rows"]),
            "raw_runs": (F.count_distinct("_run"), expected["raw_runs"]),
        }),
        set_check(fault_runs, "run_id", "fault_run_set", expected["fault_runs"]),
        expect(kept, {
            "main_rows": (total, expected["main_rows"]),
            "main_normal_rows": (of_label("normal"), expected["main_normal_rows"]),
            "main_attack_rows": (of_label("attack"), expected["main_attack_rows"]),
        }),
        set_check(kept, "run_id", "main_run_set", expected["main_runs"]),
        set_check(kept, "label", "main_label_set", expected["labels"]),
        expect(leak, {"main_leaked_rows": (total, 0)}),
        expect(held, {
            "stress_rows": (total, expected["stress_rows"]),
            "stress_cells": (F.count_distinct("run_id", "scenario"), expected["stress_cells"]),
        }),
        set_check(held, "run_id", "stress_run_set", expected["fault_runs"]),
        set_check(held, "scenario", "stress_scenario_set", expected["stress_scenarios"]),
    )


def target_contract(
    target: DataFrame, declared: DataFrame, event_types: Sequence[str], labels: Sequence[str],
    families: Sequence[str], repeats: int = MIN_REPEATS,
) -> DataFrame:
    """Every declared run file against what was read, and the campaign's sets.

    ``declared`` is ``(run, rows)``; ``target`` carries ``run`` (the file a row came from) and ``run_id``.
    """
    seen = with_family(value_profile(target, ["run", "run_id", "scenario", "label", "event_type"]))
    actual = seen.groupBy("run").agg(F.sum("n_rows").alias("n"), F.count_distinct("run_id").alias("ids"))
    files = declared.join(actual, "run", "full_outer")
    runs = seen.groupBy("family").agg(F.count_distinct("run_id").alias("n"))
    return union_checks(
        check(files, "run_rows", F.col("run"), F.coalesce(F.col("rows").cast("string"), F.lit("none")),
              F.coalesce(F.col("n").cast("string"), F.lit("none")), F.col("rows") == F.col("n")),
        check(files, "single_run_id", F.col("run"), 1, F.coalesce("ids", F.lit(0)), F.col("ids") == 1),
        set_check(seen, "event_type", "event_type_set", event_types, subset=True),
        set_check(seen, "family", "family_set", families),
        set_check(seen, "label", "label_set", labels),
        check(runs, "family_runs", F.col("family"), repeats, F.col("n"), F.col("n") == repeats),
    )


def file_checks(declared: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """Each declared or found file: is it on both sides, and has it the declared hash?

    ``declared`` is ``(path, sha256)`` of a manifest, ``inventory`` what was found. Both sides are joined in
    full, so that an undeclared file is a failed row as well.
    """
    d = declared.select(F.col(path).alias("_path"), F.col("sha256").alias("_declared"), F.lit(True).alias("_d"))
    a = inventory.select(F.col("path").alias("_found"), F.col("sha256").alias("_actual"), F.lit(True).alias("_a"))
    both = d.join(a, F.col("_path") == F.col("_found"), "full_outer")
    subject = F.coalesce("_path", "_found")
    told, seen = (F.coalesce(c, F.lit(False)) for c in ("_d", "_a"))
    same = F.coalesce(F.col("_declared") == F.col("_actual"), F.lit(False))
    return union_checks(
        check(both, "file_listed", subject, "declared and found", F.when(told & seen, "declared and found").when(told, "missing").otherwise("undeclared"), told & seen),
        check(both.where(told), "file_hash", subject, "same", F.when(same, "same").when(seen, "other").otherwise("none"), same),
    )


def campaign_contract(
    target: DataFrame, manifest: DataFrame, inventory: DataFrame, event_types: Sequence[str], labels: Sequence[str],
    families: Sequence[str], repeats: int = MIN_REPEATS,
) -> DataFrame:
    """A campaign against its own manifest: files, hashes, rows and run of each file, totals, and the sets.

    ``manifest`` is ``(run, rows, output, output_sha256)``; ``target`` carries ``output``, the file a row
    came from, and ``run_id``; ``inventory`` is ``(path, bytes, sha256)``.
    """
    seen = with_family(value_profile(target, ["output", "run_id", "scenario", "label", "event_type"]))
    actual = seen.groupBy("output").agg(F.sum("n_rows").alias("n"), F.count_distinct("run_id").alias("ids"), F.min("run_id").alias("id"))
    files = checkpointed(manifest.select("run", "rows", "output").join(actual, "output", "full_outer"))
    subject, none = F.coalesce("run", "output"), F.lit("none")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), none)
    runs = seen.groupBy("family").agg(F.count_distinct("run_id").alias("n"))
    totals = files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return union_checks(
        file_checks(manifest.select(F.col("output").alias("path"), F.col("output_sha256").alias("sha256")), inventory),
        check(files, "run_rows", subject, shown("rows"), shown("n"), F.col("rows") == F.col("n")),
        check(files, "single_run_id", subject, shown("run"), F.when(F.col("ids") > 1, "several").otherwise(shown("id")), (F.col("ids") == 1) & (F.col("id") == F.col("run"))),
        check(totals, "total_rows", "count", F.col("rows"), F.col("n"), F.col("rows") == F.col("n")),
        set_check(seen, "event_type", "event_type_set", event_types, subset=True),
        set_check(seen, "family", "family_set", families),
        set_check(seen, "label", "label_set", labels),
        check(runs, "family_runs", F.col("family"), repeats, F.col("n"), F.col("n") == repeats),
    )


def failures(checks: DataFrame) -> int:
    """Number of failed checks."""
    return checks.agg(F.count(F.when(~F.coalesce("passed", F.lit(False)), 1))).first()[0]


def split_contract(
    profile: DataFrame, labels: Sequence[str], minimum_runs: int = 2, minimum_normals: int = 100
) -> DataFrame:
    """Disjoint sides, runs per label and side, and validation normals, per seed."""
    aggs = [_rows((F.col("side") == VALIDATION) & (F.col("label") == "normal")).alias("normals")]
    for label in labels:
        for side in (TRAIN, VALIDATION):
            hit = F.when((F.col("label") == label) & (F.col("side") == side), F.col("run_id"))
            aggs.append(F.count_distinct(hit).alias(f"{side}_{label}"))
    row = profile.groupBy("seed").agg(*aggs).join(_shared_runs(profile), "seed")
    specs = [("run_overlap", "shared runs", 0, F.col("shared"), F.col("shared") == 0)]
    for label in labels:
        for side in (TRAIN, VALIDATION):
            n = F.col(f"{side}_{label}")
            specs.append(("runs_per_label_side", f"{side}/{label}", f">={minimum_runs}", n, n >= minimum_runs))
    normals = F.col("normals")
    specs.append(("validation_normals", "rows", f">={minimum_normals}", normals, normals >= minimum_normals))
    return checks_from_aggregate(row, specs, ["seed"])


def metric_preconditions(scored: DataFrame, keys: Sequence[str], families: Sequence[str]) -> DataFrame:
    """What must hold before metrics mean anything: classes, strata, masks and finite scores.

    ``scored`` has events, or cells of them with ``n_rows`` and ``n_bad``, as :func:`thresholds.seed_counts` makes.
    """
    y, fam = F.col("y"), F.col("family")
    if "n_bad" in scored.columns:
        bad, n_rows = F.sum("n_bad"), F.sum("n_rows")
    else:
        score = F.col("score")
        finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < F.lit(float("inf")))
        bad, n_rows = F.count(F.when(~finite, 1)), F.count(F.lit(1))
    masks = {
        "normal_negatives": (fam == "normal") & (y == 0),
        "fault_negatives": (fam == "fault") & (y == 0),
        "manipulation_positives": (fam == "manipulation") & (y == 1),
        "recon_positives": (fam == "recon") & (y == 1),
    }
    # Counting cells first keeps the distinct counts below off the raw rows.
    cells = scored.groupBy(*keys, "family", "run_id", "y").agg(
        bad.alias("bad"), n_rows.alias("n_rows")
    )
    row = cells.groupBy(*keys).agg(
        F.count_distinct("y").alias("classes"),
        F.sum("bad").alias("bad"),
        *[F.coalesce(F.sum(F.when(m, F.col("n_rows"))), F.lit(0)).alias(n) for n, m in masks.items()],
        *[F.count_distinct(F.when(fam == f, F.col("run_id"))).alias(f"runs_{f}") for f in families],
    )
    specs = [
        ("both_classes", "classes", 2, F.col("classes"), F.col("classes") == 2),
        ("finite_scores", "not finite", 0, F.col("bad"), F.col("bad") == 0),
    ]
    specs += [("mask_not_empty", n, ">=1", F.col(n), F.col(n) > 0) for n in masks]
    specs += [("stratum_runs", f, ">=2", F.col(f"runs_{f}"), F.col(f"runs_{f}") >= 2) for f in families]
    return checks_from_aggregate(row, specs, list(keys))


def refusal_mode(
    readiness: DataFrame, per_seed: DataFrame, seeds: Sequence[int], force: bool = False
) -> DataFrame:
    """``(seed, ready, mode, n_reasons)``: any failed check refuses the seed unless forced."""
    every = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    failed = F.count(F.when(~F.col("passed"), 1)).alias("n")
    general = readiness.agg(failed).select(every, "n")
    own = per_seed.groupBy("seed").agg(failed)
    reasons = general.unionByName(own).groupBy("seed").agg(F.sum("n").alias("n_reasons"))
    ready = F.col("n_reasons") == 0
    mode = F.when(ready, "headline").when(F.lit(force), "forced").otherwise("contract")
    return reasons.select("seed", ready.alias("ready"), mode.alias("mode"), "n_reasons")


def gate(metrics: DataFrame, modes: DataFrame) -> DataFrame:
    """Metrics of refused seeds become null; the seed keeps its row."""
    values = [c for c in metrics.columns if c != "seed"]
    shown = modes.join(metrics, "seed", "left")
    return shown.select(
        *modes.columns, *[F.when(F.col("mode") != "contract", F.col(c)).alias(c) for c in values]
    )


def result_contract(
    validation: DataFrame, intervals: DataFrame, seeds: Sequence[int], max_fpr: float
) -> DataFrame:
    """All seeds present once, validation rate within budget, each point inside its interval.

    ``validation`` is ``(seed, validation_fpr)``; ``intervals`` is ``(metric, value, lo, hi)``. The list of seeds
    must be in order: results are reported by it.
    """
    listed = F.col("seed").isin(list(seeds))
    row = validation.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.when(listed, F.col("seed"))).alias("hit"),
        F.array_join(F.sort_array(F.collect_list("seed")).cast("array<string>"), ",").alias("order"),
        F.count(F.when(~F.coalesce(F.col("validation_fpr") <= F.lit(max_fpr), F.lit(False)), 1)).alias("over"),
    )
    inside = (F.col("lo") <= F.col("value")) & (F.col("value") <= F.col("hi"))
    shown = F.when(inside, "inside").otherwise("outside")
    return union_checks(
        checks_from_aggregate(row, [
            ("seeds_complete", "seeds", len(seeds), F.col("hit"), (F.col("hit") == len(seeds)) & (F.col("n") == len(seeds))),
            ("seed_list", "in order", ",".join(map(str, seeds)), F.col("order"), F.col("order") == ",".join(map(str, seeds))),
            ("validation_fpr_within_budget", "seeds over budget", 0, F.col("over"), F.col("over") == 0),
        ]),
        check(intervals, "interval_holds_point", F.col("metric"), "inside", shown, inside),
    )
