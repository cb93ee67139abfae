"""Contracts, splits, the gate, audits and plan shape."""

import pytest
from pyspark.sql import functions as F

from driftline.operators import audit, contracts, pools, splits, thresholds
from driftline.operators.ordered import Split
from driftline.plans import gated, registry, scoring, transfer
from driftline.plans.registry import QUERIES, source, target
from driftline.session import materialize, shared_dir


def failures(checks):
    return {(r.check_name, r.subject) for r in checks.filter("not passed").collect()}


def test_assert_all_raises_with_reasons(spark):
    df = spark.createDataFrame([("c", "s", "1", "2", False), ("d", "s", "1", "1", True)], "check_name string, subject string, expected string, actual string, passed boolean")
    with pytest.raises(contracts.ContractError, match=r"c\[s\]: 2 \(expected 1\)"):
        contracts.assert_all(df)
    contracts.assert_all(df.filter("passed"))


def test_short_unphased_runs_are_refused(spark):
    rows = [(f"r{i}", "strange", "fault", i * 1000000 + j) for i in range(2) for j in range(5)]
    df = spark.createDataFrame(rows, "run_id string, scenario string, label string, t_us long")
    got = failures(contracts.readiness_checks(df, None))
    assert got == {
        ("ground_truth_phases", "runs with phases"), ("phase_level_labels", "runs with several labels"),
        ("scenario_mapped", "unmapped scenario names"), ("family_repeats", "other"),
        ("run_duration_sec", "r0"), ("run_duration_sec", "r1"),
    }


def test_absent_columns_skip_checks(spark):
    df = spark.createDataFrame([("r1",)], "run_id string")
    assert [r.check_name for r in contracts.readiness_checks(df, None).collect()] == ["ground_truth_phases"]


def test_single_run_is_split_by_rows_and_refused(spark, sf):
    one = source(spark, sf).withColumn("run_id", F.lit(1))
    rows = splits.split_with_basis(one, [42, 43])
    assert rows.select("basis").distinct().collect() == [("row",)]
    n = one.count()
    sizes = {(r.seed, r.side): r["count"] for r in rows.groupBy("seed", "side").count().collect()}
    assert sizes[(42, "train")] == int(n * 0.7) and sizes[(42, "train")] + sizes[(42, "validation")] == n
    bad = failures(contracts.split_checks(splits.row_split_profile(rows), 0.01))
    assert ("split_basis", "basis") in bad and ("run_overlap", "shared runs") in bad


@pytest.mark.parametrize("limit", [10**6, 3])
def test_row_split_ranks_the_cell_of_the_cut_only(spark, monkeypatch, limit):
    from hashlib import md5

    ranked = []
    real = splits.running_sum
    monkeypatch.setattr(splits, "running_sum", lambda df, *a, **k: ranked.append(df.count()) or real(df, *a, **k))
    ids = [7 * i for i in range(1500)] + [0, 0, None]
    df = spark.createDataFrame([(1, i) for i in ids], "run_id int, event_id long").repartition(3)
    rows = splits.split_with_basis(df, [5, 6], split=Split(limit=limit))
    order = lambda s: sorted((int(md5(f"{s}|{i}".encode()).hexdigest()[:8], 16), i) for i in ids if i is not None)
    for seed in (5, 6):
        none = int(md5(str(seed).encode()).hexdigest()[:8], 16)
        wanted = sorted([*order(seed), (none, -1)])[:int(len(ids) * 0.7)]
        got = rows.filter((F.col("seed") == seed) & (F.col("side") == splits.TRAIN)).select("event_id").collect()
        assert sorted(-1 if r.event_id is None else r.event_id for r in got) == sorted(i for _, i in wanted)
    assert max(ranked) < len(ids)  # before, every row of every seed was ranked
    few = splits.split_with_basis(df.limit(1), [5]).collect()
    assert [r.side for r in few] == [splits.VALIDATION]


def test_run_split_is_clamped_and_stable(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2)], "run_id int")
    got = {r.side for r in splits.split_by_run(df, [7], 0.999).collect()}
    assert got == {"train", "validation"}
    many = spark.createDataFrame([(i,) for i in range(50)], "run_id int")
    a = {tuple(r) for r in splits.split_by_run(many, [1, 2]).collect()}
    b = {tuple(r) for r in splits.split_by_run(many.repartition(7), [1, 2], split=Split(limit=10)).collect()}
    assert a == b


def test_thin_class_is_refused(spark):
    profile = spark.createDataFrame(
        [(1, "train", "a", "normal", 9), (1, "train", "b", "normal", 9), (1, "train", "c", "fault", 999), (1, "validation", "d", "normal", 9)],
        "seed int, side string, run_id string, label string, n_rows long",
    )
    test = spark.createDataFrame([("normal",), ("fault",), ("attack",)], "label string")
    assert failures(contracts.class_composition(profile, test, [1])) == {
        ("class_runs", "train/fault"), ("class_present", "validation/fault"), ("class_runs", "validation/normal"),
    }


def test_empty_mask_is_null_or_refused(spark):
    df = spark.createDataFrame([(1, "normal", 0, 1, "r", 0.5), (1, "recon", 1, 0, "q", 0.5)], "k int, family string, y int, pred int, run_id string, score double")
    r = thresholds.event_rates(df, ["k"]).first()
    assert (r.fpr_normal, r.fpr_fault, r.n_fault, r.recall_event_recon) == (1.0, None, 0, 0.0)
    assert ("mask_not_empty", "fault_negatives") in failures(contracts.metric_preconditions(df, ["k"], ("normal", "recon")))


def test_main_pool_drops_whole_runs(spark):
    rows = [(1, "flow", "normal"), (1, "flow", "fault"), (2, "flow", "attack"), (2, "alert", "normal"), (3, "alert", "fault"), (3, "modbus", "normal")]
    df = spark.createDataFrame(rows, "run_id int, event_type string, label string")
    assert {tuple(r) for r in pools.main_pool(df).select("run_id", "label").collect()} == {(2, "attack"), (3, "normal")}
    assert pools.stress_pool(df).count() == 1


def test_refused_run_has_no_numbers(spark, sf):
    src = source(spark, sf).withColumn("run_id", F.col("run_id").cast("string"))
    got = gated.gated_eval(src, target(spark, sf), "flow", None, seeds=(42, 43), replicates=20)
    rows = got.collect()
    assert {r["mode"] for r in rows} == {"contract"} and all(r.fpr_normal is None and r.threshold is None for r in rows)
    forced = gated.gated_eval(src, target(spark, sf), "physical_proxy", None, seeds=(42, 43), force=True, replicates=20)
    rows = forced.collect()
    assert {r["mode"] for r in rows} == {"forced"} and all(r.episode_basis_recon == "phase_column" for r in rows)
    for s in gated.multiseed_summary(forced).collect():
        assert s["min"] <= s["mean"] <= s["max"]
    state = gated.seeds_state(forced).first()
    assert (state.ready, state["mode"], state.n_seeds) == (False, "forced", 2)


def test_single_run_training_is_refused_end_to_end(spark, sf):
    one = source(spark, sf).withColumn("run_id", F.lit("solo"))
    got = gated.gated_eval(one, target(spark, sf), "flow", registry.ground_truth(spark, sf), seeds=(42,), replicates=20)
    assert got.first()["mode"] == "contract"


def test_forest_invariants(spark, sf):
    """Scores are probabilities, one per event and seed, and thresholds keep the budget."""
    main, tgt = pools.main_pool(source(spark, sf)), target(spark, sf)
    sp = materialize(splits.split_by_run(main.select(F.col("run_id").cast("string").alias("run_id")), [42, 43]), "splits")
    scores = transfer.score_seeds(
        main, pools.stress_pool(source(spark, sf)), tgt, sp, "physical_proxy", scoring.forest_scorer(5, 4), [42, 43]
    )
    long = scoring.by_seed(scores["target"], [42, 43])
    r = long.agg(F.min("score"), F.max("score"), F.count("*"), F.count_distinct("seed", "event_id")).first()
    assert 0 <= r[0] <= r[1] <= 1 and r[2] == r[3] == 2 * tgt.count()
    thr = thresholds.threshold_at_fpr(scores["validation"], ["seed"], 0.01)
    fpr = thresholds.validation_fpr(thresholds.apply_threshold(scores["validation"], thr, ["seed"]), ["seed"])
    assert all(x.validation_fpr <= 0.01 for x in fpr.collect())


def test_unseen_category_is_all_zero(spark):
    from driftline.catalog import feature_schema

    ddl = "event_id long, pkts_toserver double, pkts_toclient double, bytes_toserver double, bytes_toclient double, flow_state string"
    train = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, "new"), (2, 0.0, 0.0, 0.0, 0.0, "closed")], ddl)
    test = spark.createDataFrame([(3, 0.0, 0.0, 0.0, 0.0, "new"), (4, 0.0, 0.0, 0.0, 0.0, "odd")], ddl)
    got = {r.event_id: (len(r.features), sum(r.features)) for r in scoring.onehot_features(train, test, feature_schema("flow"), ["event_id"]).collect()}
    assert got == {3: (6, 1.0), 4: (6, 0.0)}


def test_any_estimator_scores(spark, sf):
    from pyspark.ml.classification import LinearSVC, LogisticRegression

    from driftline.catalog import feature_schema

    train = transfer.prepare(pools.main_pool(source(spark, sf)), "flow")
    soft = scoring.estimator_scorer(lambda seed: LogisticRegression(labelCol="y", maxIter=3))(train, feature_schema("flow"), 1)
    hard = scoring.estimator_scorer(lambda seed: LinearSVC(labelCol="y", maxIter=3))(train, feature_schema("flow"), 1)
    assert soft(train, "s").agg(F.max("s")).first()[0] <= 1
    assert {r[0] for r in hard(train, "s").select("s").distinct().collect()} <= {0.0, 1.0}


# --- audit -----------------------------------------------------------------------------------


def test_reconcile_statuses(spark):
    ddl = "path string, bytes long, sha256 string"
    d = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "x"), ("d", 1, "x")], ddl)
    a = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "y"), ("e", 1, "x")], ddl)
    got = {r.path: r.status for r in audit.reconcile(d, a).collect()}
    assert got == {"a": "ok", "b": "size mismatch", "c": "hash mismatch", "d": "missing", "e": "unexpected"}


def test_path_and_content_rules(spark):
    df = spark.createDataFrame([("edge/a.txt",), ("x/secret.PCAP",), ("ok.txt",), ("exact.yml",)], "path string")
    got = {(r.path, r.rule) for r in audit.path_rules(df, ["edge/"], ["exact.yml"]).collect()}
    assert got == {("edge/a.txt", "prefix"), ("x/secret.PCAP", "extension"), ("exact.yml", "exact path")}
    token = "ghp_" + "a1" * 12
    texts = [(1, "C:\\Users\\me"), (2, f"x {token}"), (3, "AKIA" + "A1B2" * 4), (4, "-----BEGIN EC " + "PRIVATE KEY-----"), (5, "clean"), (6, "padding " * 50_000 + token)]
    df = spark.createDataFrame([(i, bytearray(t.encode("latin-1"))) for i, t in texts], "doc_id int, content binary")
    got = {(r.doc_id, r.rule) for r in audit.scan_files(df, keep=["doc_id"]).collect()}
    assert got == {(1, "host user path"), (2, "GitHub access token"), (3, "AWS access key"), (4, "private key"), (6, "GitHub access token")}


def test_nested_diff_is_type_strict(spark):
    a = spark.createDataFrame([("k", '{"a": {"b": [1, 2.5, "x"]}, "n": 1, "z": null, "t": true}')], "id string, doc string")
    b = spark.createDataFrame([("k", '{"a": {"b": [1, 2.5, "y"]}, "n": 1.0, "z": null, "t": true}')], "id string, doc string")
    diff = audit.result_diff(audit.flatten_json(a, "id", "doc"), audit.flatten_json(b, "id", "doc"), ["id", "path"])
    assert {(r.path, r.difference) for r in diff.collect()} == {("$.a.b[2]", "value"), ("$.n", "type")}
    assert audit.first_difference(diff).first().path == "$.a.b[2]"
    same = audit.result_diff(audit.flatten_json(a, "id", "doc"), audit.flatten_json(a, "id", "doc"), ["id", "path"])
    assert same.count() == 0
    assert audit.first_difference(same).count() == 0


def test_nested_diff_has_no_limits(spark):
    deep = lambda v: '{"d":' * 300 + v + "}" * 300
    pairs = {
        "deep": (deep("1"), deep("2"), ["$" + ".d" * 300]),
        "paths": ('{"a.b":1,"a":{"b":2}}', '{"a.b":1,"a":{"b":3}}', ["$.a.b"]),
        "digits": ("[12345678901234567890]", "[12345678901234567891]", ["$[0]"]),
        "order": ("[0,1,2,3,4,5,6,7,8,9,10]", "[0,1,9,3,4,5,6,7,8,9,9]", ["$[2]", "$[10]"]),
        "names": ('{"a-b":1,"a":{"z":1}}', '{"a-b":2,"a":{"z":2}}', ["$.a.z", '$["a-b"]']),
        "same": ('{"x":[{},[],null,-0.0,1e3]}', '{"x":[{},[],null,0.0,1000.0]}', []),
    }
    flat = lambda side: audit.flatten_json(
        spark.createDataFrame([(k, v[side]) for k, v in pairs.items()] + [("none", None)], "id string, doc string"), "id", "doc"
    )
    diff = audit.result_diff(flat(0), flat(1), ["id", "path"])
    got = {k: [r.path for r in diff.filter(f"id = '{k}'").orderBy("steps").collect()] for k in pairs}
    assert got == {k: v[2] for k, v in pairs.items()}
    assert {r.id: r.path for r in audit.first_difference(diff, ["id"]).collect()} == {k: v[2][0] for k, v in pairs.items() if v[2]}


def test_variants_flatten_as_json_does(spark):
    docs = [
        ("deep", '{"d":' * 20 + "[1]" + "}" * 20), ("names", '{"a.b":1,"a":{"b":2},"":0,"q\\"x":{"é":[]},"x y":{}}'),
        ("numbers", "[0,-1,1.0,1.50,1e3,-0.0,0.1,9223372036854775807,9223372036854775808,12345678901234567890,99999999999999999999999999999999999999]"),
        ("scalars", '[null,true,false,"","a\\"b\\\\","é\\n",[],{},[[]],[{}]]'), ("top", "7"), ("word", '"[1]"'), ("nothing", "null"), ("none", None),
        ("long", "[" + ",".join(f'{{"i":{i}}}' for i in range(300)) + "]"),
    ]
    df = spark.createDataFrame(docs, "id string, doc string")
    rows = [sorted(map(str, f(df, "id", "doc").collect())) for f in (audit.flatten_json, audit.flatten_variant)]
    assert rows[0] == rows[1]
    assert audit.flatten_variant(df.limit(0), "id", "doc").count() == 0


def test_pairs_of_variants_differ_as_their_nodes_do(spark):
    """Opened together and pruned, or flattened in full and joined: the same rows."""
    deep = lambda v: '{"d":' * 20 + v + "}" * 20
    pairs = [
        (deep("1"), deep("2")), (deep("1"), deep("1.0")), ("[1.0,1e3]", "[1,1e3]"), ("[1,1.0]", "[1.0,1]"), ('["x",1.0]', '["x",1]'), ('{"x":[1.50,-0.0]}', '{"x":[1.5,0.0]}'),
        ('{"a":null,"b":1}', '{"b":1}'), ('{"a":null}', '{"a":"null"}'), ('{"a":[1,[2,{}]]}', '{"a":{"0":1}}'), ("[[1,2],3]", "[[1]]"),
        ('{"a.b":1,"a":{"b":2}}', '{"a.b":2,"a":{"b":2,"c":[]}}'), ("7", '"7"'), ("null", "[]"), (None, '{"a":[true]}'), ("[false]", None), (None, None),
        ("[12345678901234567890]", "[12345678901234567891]"), ('{"DECIMAL":[1]}', '{"DECIMAL":[2]}'), ('{"same":[1,{"x":"y"}],"z":0}', '{"z":0, "same":[1,{"x":"y"}]}'),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, e string, a string")
    columns = ["id", *audit.FOUND]
    flat = [audit.flatten_variant(df, "id", c) for c in ("e", "a")]
    want = sorted(map(str, audit.result_diff(*flat, ["id", "path"]).select(*columns).collect()))
    found = audit.variant_diff(df, "id", "e", "a")
    assert sorted(map(str, found.select(*columns).collect())) == want and len(want) > 30
    assert audit.variant_diff(df.limit(0), "id", "e", "a").count() == 0
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_variants_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("k", '{"a":[1]}')], "id string, doc string")
    flat = audit.flatten_variant(df, "id", "doc")
    plan = audit.first_difference(audit.result_diff(flat, flat, ["id", "path"]), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_seed_list_must_be_in_order(spark):
    found = spark.createDataFrame([(3, 0.0), (1, 0.0), (2, 0.0)], "seed int, validation_fpr double")
    inside = spark.createDataFrame([("auc", 0.5, 0.4, 0.6)], "metric string, value double, lo double, hi double")
    failed = lambda seeds, rows=found: {r.check_name for r in contracts.result_contract(rows, inside, seeds, 0.01).filter("not passed").collect()}
    assert failed([1, 2, 3]) == set()
    assert failed([2, 1, 3]) == {"seed_list"}
    assert failed([1, 2]) == {"seed_list", "seeds_complete"}
    assert failed([1, 2, 3], found.unionByName(found.filter("seed = 2"))) == {"seed_list", "seeds_complete"}


def test_pools_of_a_counted_table_are_the_counts_of_pools(spark):
    rows = [(r, "s", l, t) for r in (1, 2, 3) for l in ("normal", "attack", "fault") for t in ("flow", "alert") if (r, l) != (1, "fault")] * 3
    df = spark.createDataFrame(rows, "run_id int, scenario string, label string, event_type string")
    found = []
    for src in (df, pools.counted(df)):
        stages = {"raw": src, "main": pools.main_pool(src), "stress": pools.stress_pool(src), "none": src.limit(0)}
        found.append(sorted(map(tuple, pools.pool_audit(stages).collect())))
    assert found[0] == found[1] and ("none", "n_rows", 0) in found[0] and ("main", "n_rows", 6) in found[0]


# --- plan shape ------------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 10")
    text = plan(audit.sensitive_scan(rows, "text", keep=["doc_id"]))
    assert "PushedFilters: [IsNotNull(n_chars), GreaterThan(n_chars,10)]" in text
    text = plan(QUERIES["label_counts"](spark, sf))
    assert "props" not in text


def test_phase_join_does_not_shuffle_events(spark, sf):
    df = QUERIES["asof_phase"](spark, sf)
    text = plan(df)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_shared_folder_is_required_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="shared"):
        shared_dir(Session())
