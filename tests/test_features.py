"""Features, phases, labelling and scans on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from driftline.catalog import DEFAULT_ROLES, FEATURE_SCHEMAS, PROPULSION, RUDDER, feature_schema
from driftline.functions.scalar import epoch_micros, role_value, safe_double, scenario_family
from driftline.operators import episodes, features, labelling
from driftline.operators.ordered import Split
from driftline.sources import events as ev
from driftline.sources import files

ROWS = [
    # event, site, run, second, rudder, rpm, left, right, function
    (1, "site_b", "r1", 0, 35.0, None, 0.4, None, 6),
    (2, "site_b", "r1", 1, None, None, None, 0.6, 3),
    (3, "site_b", "r1", 2, 70.0, None, 0.2, 0.4, 6),
    (4, "site_b", "r1", 2, 35.0, None, None, None, 16),
    (5, "site_b", "r2", 0, 7.0, None, 1.5, None, 5),
    (6, "site_a", "r3", 0, None, 1200.0, None, None, 6),
    (7, "site_a", "r3", 9, None, 600.0, None, None, None),
    (8, "other_site", "r4", 0, None, 1200.0, None, None, 6),
]
DDL = (
    "event_id long, source_dataset string, run_id string, sec int, rudder_angle double, rpm_command double, "
    "throttle_command_left double, throttle_command_right double, modbus_function int"
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, DDL).withColumn("t_us", F.col("sec").cast("long") * 1000000)


def by_id(df, *columns):
    return {r.event_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_roles_follow_the_domain_of_each_row(table):
    got = by_id(table.select("event_id", role_value(DEFAULT_ROLES, PROPULSION, table.columns).alias("v")), "v")
    assert got == {1: 0.4, 2: 0.6, 3: pytest.approx(0.3), 4: None, 5: 1.5, 6: 1.0, 7: 0.5, 8: 1.0}


@pytest.mark.parametrize("split", [Split(), Split(limit=2)])
def test_rate_skips_unsampled_rows(table, split):
    """Samples of r1 are rows 1, 3, 4: one change over two seconds, then a zero time step."""
    out = features.build_features(table, "physical_strict", split=split)
    got = by_id(out, "rudder_rate")
    assert got == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.0, 5: 0.0, 6: 0.0, 7: 0.0, 8: 0.0}


def test_bands_use_the_raw_value(table):
    out = by_id(features.build_features(table, "physical_proxy"), "rudder_band", "propulsion_band")
    assert out == {
        1: ("in_band", "in_band"), 2: ("na", "na"), 3: ("out_of_band", "in_band"), 4: ("in_band", "unknown"),
        5: ("in_band", "out_of_band"), 6: ("unknown", "in_band"), 7: ("na", "na"), 8: ("unknown", "in_band"),
    }


def test_presence_tells_absent_from_zero(table):
    out = by_id(features.build_features(table, "physical_strict"), RUDDER, f"{RUDDER}_present")
    assert out[1] == (1.0, 1) and out[2] == (0.0, 0)


def test_absent_columns_fall_back(table):
    out = features.build_features(table.drop("modbus_function"), "protocol").first()
    assert (out.flow_state, out.modbus_function, out.modbus_access, out.pkts_toserver) == ("unknown", "na", "na", 0.0)
    present = features.build_features(table, "protocol")
    assert set(by_id(present, "modbus_function").values()) == {"6.0", "3.0", "16.0", "5.0", "na"}


def test_schemas_carry_no_identity(table):
    for name, fs in FEATURE_SCHEMAS.items():
        out = features.build_features(table, name)
        assert out.columns == ["event_id", *fs.numeric, *fs.categorical] or set(out.columns) == {"event_id", *fs.numeric, *fs.categorical}
        features.assert_no_leakage([c for c in out.columns if c != "event_id"])
    assert PROPULSION not in feature_schema("physical_strict").numeric
    assert PROPULSION in feature_schema("physical_proxy").numeric
    with pytest.raises(features.LeakageError):
        features.assert_no_leakage(["pkts_toserver", "dest_port"])
    with pytest.raises(features.LeakageError):
        features.assert_no_leakage(["vendor_decoded"])
    with pytest.raises(ValueError):
        feature_schema("unknown")


def test_scalars(spark):
    df = spark.createDataFrame([(" Dom_RECON ",), ("recon",), ("prerecon",), ("x_fault_y",), ("a_normal",), (None,)], "s string")
    assert [r[0] for r in df.select(scenario_family("s")).collect()] == ["recon", "recon", "other", "other", "normal", "other"]
    df = spark.createDataFrame([("1.5",), ("NaN",), ("x",), (None,), ("-2",)], "s string")
    assert [r[0] for r in df.select(safe_double("s")).collect()] == [1.5, None, None, None, -2.0]
    df = spark.createDataFrame([("2023-11-14T22:13:20+00:00",), ("2023-11-14T23:13:20+01:00",), ("2023-11-14T22:13:20.5Z",), ("2023-11-14T22:13:20",), ("x",)], "s string")
    base = 1700000000000000
    assert [r[0] for r in df.select(epoch_micros("s")).collect()] == [base, base, base + 500000, base, None]


def test_stamps_do_not_depend_on_the_session(spark):
    df = spark.createDataFrame([("2023-11-14T22:13:20",), ("2023-11-14 22:13:20.25",), ("2023-11-14T22:13:20Z",), ("2023-11-14T17:13:20-05:00",), ("2023-11-14",), ("",)], "s string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = [r[0] for r in df.select(epoch_micros("s")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = 1700000000000000
    assert got == [base, base + 250000, base, base, 1699920000000000, None]


# --- phases and episodes ---------------------------------------------------------------------

T0 = 1_700_000_000_000_000


def seconds(n):
    return None if n is None else T0 + n * 1_000_000


def timeline_of(spark, rows):
    return spark.createDataFrame([(r, seconds(t), n) for r, t, n in rows], "run_id string, t_us long, name string")


@pytest.mark.parametrize("dense,split", [(64, Split()), (0, Split()), (0, Split(limit=2))])
def test_asof_rules(spark, dense, split):
    lines = timeline_of(spark, [("a", 10, "x"), ("a", 10, "y"), ("a", 20, "act"), ("b", 5, "x")])
    rows = [(1, "a", 9), (2, "a", 10), (3, "a", 19), (4, "a", 20), (5, "a", None), (6, "b", 99), (7, "c", 1), (8, "a", 10**6)]
    df = spark.createDataFrame([(i, r, seconds(t)) for i, r, t in rows], "event_id long, run_id string, t_us long")
    got = by_id(episodes.asof_phase(df, lines, dense=dense, split=split), "phase_name")
    assert got == {1: "pre-phase", 2: "y", 3: "y", 4: "act", 5: "pre-phase", 6: "x", 7: "pre-phase", 8: "act"}


def test_latency_and_load(spark):
    lines = timeline_of(spark, [("r1", 0, "act")])
    df = spark.createDataFrame([(1, "r1", seconds(2), 0, "m"), (2, "r1", seconds(4), 1, "m"), (3, "r1", seconds(7), 0, "m")], "event_id long, run_id string, t_us long, pred int, g string")
    eps = episodes.episode_summary(episodes.with_episode(df, lines, ["g"]), ["g"])
    r = episodes.detection_latency(eps, ["g"]).first()
    assert (r.median_sec, r.n_detected, r.n_missed) == (2.0, 1, 0)
    load = episodes.alarm_load(df, ["g"]).first()
    assert (load.n_runs, load.alarms_per_run_mean, load.alarms_per_run_max) == (1, 1.0, 1)
    assert load.alarms_per_hour == pytest.approx(720.0)


def test_latency_without_times(spark):
    """An alarm without a time is neither detected nor missed; without any time it is missed."""
    df = spark.createDataFrame(
        [("g", "r1", "e", seconds(1), 0), ("g", "r1", "e", None, 1), ("g", "r2", "e", None, 1), ("g", "r3", "e", seconds(1), 0)],
        "g string, run_id string, episode string, t_us long, pred int",
    )
    r = episodes.detection_latency(episodes.episode_summary(df, ["g"]), ["g"]).first()
    assert (r.median_sec, r.n_detected, r.n_missed) == (None, 0, 2)


def test_basis_is_all_or_nothing(spark):
    lines = timeline_of(spark, [("r1", 0, "act")])
    df = spark.createDataFrame([(1, "r1", seconds(1), "g", "p"), (2, "r2", seconds(1), "g", "p"), (3, "r1", seconds(1), "h", "q")], "event_id long, run_id string, t_us long, g string, phase string")
    out = episodes.with_episode(df, lines, ["g"], "phase")
    assert by_id(out, "basis", "episode") == {1: ("phase_column", "p"), 2: ("phase_column", "p"), 3: ("ground_truth_phase", "act")}
    out = episodes.with_episode(df, lines, ["g"])
    assert by_id(out, "basis", "episode")[1] == ("run_id", "")


def test_repeated_phase_is_one_episode(spark):
    lines = timeline_of(spark, [("r", 0, "a"), ("r", 10, "b"), ("r", 20, "a")])
    df = spark.createDataFrame([(i, "r", seconds(t), "g", int(t == 25)) for i, t in enumerate([1, 11, 25])], "event_id long, run_id string, t_us long, g string, pred int")
    eps = {r.episode: r.hit for r in episodes.episode_summary(episodes.with_episode(df, lines, ["g"]), ["g"]).collect()}
    assert eps == {"a": 1, "b": 0}


def test_backdating(spark):
    lines = timeline_of(spark, [("r", 0, "base"), ("r", 100, "act"), ("q", 50, "act")])
    rows = [
        (1, "r", 0, 6.0, 7.0), (2, "r", 40, 3.0, 7.0), (3, "r", 60, 6.0, 7.0), (4, "r", 90, 16.0, 7.0),
        (5, "r", 101, 6.0, 7.0), (6, "q", 50, 6.0, 7.0), (7, "q", 20, 6.0, 8.0),
    ]
    df = spark.createDataFrame([(i, r, seconds(t), f, v) for i, r, t, f, v in rows], "event_id long, run_id string, t_us long, modbus_function double, v double")
    points = spark.createDataFrame([("act", 7.0)], "name string, setpoint double")
    got = {(r.run_id, r.name): (r.start_us, r.anchor, r.backdated) for r in labelling.phase_backdate(df, lines, points, "v").collect()}
    assert got == {
        ("r", "base"): (seconds(0), "marker", False),
        ("r", "act"): (seconds(60), "setpoint", True),
        ("q", "act"): (seconds(50), "setpoint", False),
    }


def test_flow_spans_any_boundary(spark):
    lines = timeline_of(spark, [("r", 10, "a"), ("r", 20, "b")])
    rows = [(1, "r", "flow", 5, 9), (2, "r", "flow", 5, 10), (3, "r", "flow", 10, 15), (4, "r", "flow", 5, 25), (5, "r", "modbus", 5, 25)]
    df = spark.createDataFrame([(i, r, e, seconds(s), seconds(t)) for i, r, e, s, t in rows], "event_id long, run_id string, event_type string, flow_start_us long, t_us long")
    r = labelling.flow_boundary_span(df, lines).first()
    assert (r.flow_rows, r.flow_rows_spanning_boundary) == (4, 2)


# --- scans -----------------------------------------------------------------------------------


def test_csv_scan_is_strict_and_aligned(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("run_id,event_id,label,rudder_angle\nr1,1,normal,2.5\nr1,2,attack,\n")
    df = ev.scan_events(spark, str(good))
    assert df.filter("label = 'attack'").select("event_id", "rudder_angle", "rpm_command").first() == (2, None, None)
    bad = tmp_path / "bad.csv"
    bad.write_text("run_id,event_id\nr1,one\n")
    with pytest.raises(Exception, match="(?i)malformed|parse|cast|FAILFAST"):
        ev.scan_events(spark, str(bad)).collect()


def test_campaign_merges_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("event_id,run_id,rpm_command\n1,a,10\n")
    (tmp_path / "b.csv").write_text("event_id,run_id,throttle_command_left\n2,b,0.5\n")
    df = ev.scan_campaign(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    got = {r.run_id: (r.rpm_command, r.throttle_command_left, r.file.rsplit("/", 1)[1]) for r in df.collect()}
    assert got == {"a": (10.0, None, "a.csv"), "b": (None, 0.5, "b.csv")}


def test_ground_truth_files(spark, tmp_path):
    p = tmp_path / "gt.json"
    p.write_text(
        '{"r1": {"phases": [{"phase": " act ", "timestamp": "2023-11-14T22:13:20Z"}, {"name": "", "timestamp": "2023-11-14T22:13:20Z"}, {"name": "z"}]},'
        ' "r2": {"phases": []}}'
    )
    entries = ev.scan_ground_truth(spark, str(p), per_run=True)
    assert {tuple(r) for r in ev.phase_timeline(entries).collect()} == {("r1", T0, "act")}
    g = tmp_path / "global.json"
    g.write_text('{"phases": [{"name": "all", "timestamp": "2023-11-14T22:13:20Z"}]}')
    both = entries.unionByName(ev.scan_ground_truth(spark, str(g), per_run=False))
    runs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "run_id string")
    lines = episodes.run_timeline(runs, both, ev.phase_timeline(both)).collect()
    assert {tuple(r) for r in lines} == {("r1", T0, "act"), ("r3", T0, "all")}


def test_inventory_and_manifest(spark, tmp_path):
    import hashlib

    root = tmp_path / "art"
    (root / "sub").mkdir(parents=True)
    (root / "__pycache__").mkdir()
    (root / "a.txt").write_bytes(b"abc")
    (root / "sub" / "b.bin").write_bytes(bytes(range(256)))
    (root / "__pycache__" / "c.pyc").write_bytes(b"x")
    (root / files.MANIFEST_FILE).write_text("{}")
    inv = files.file_inventory(spark, str(root))
    got = {r.path: (r.bytes, r.sha256) for r in inv.collect()}
    assert got == {
        "a.txt": (3, hashlib.sha256(b"abc").hexdigest()),
        "sub/b.bin": (256, hashlib.sha256(bytes(range(256))).hexdigest()),
    }
    files.write_manifest(inv, str(tmp_path / "out"), "demo")
    summary = spark.read.json(str(tmp_path / "out/summary")).first()
    assert (summary.file_count, summary.total_bytes, summary.release_eligible) == (2, 259, True)
    assert spark.read.json(str(tmp_path / "out/files")).count() == 2


@pytest.mark.parametrize("size", [0, 1, 6, 7, 8, 14, 15, 700])
def test_files_are_hashed_in_chunks(spark, tmp_path, size):
    import hashlib

    data = bytes(i % 251 for i in range(size))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f").write_bytes(data)
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}/"):
        got = files.file_inventory(spark, root, chunk=7).collect()
        assert [tuple(r) for r in got] == [("d/f", size, hashlib.sha256(data).hexdigest())]


def test_a_chunk_is_all_that_is_read_at_once(tmp_path, monkeypatch):
    (tmp_path / "f").write_bytes(b"x" * 100)
    reads = []

    class File:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def seek(self, at):
            self.at = at

        def read(self, n):
            reads.append((self.at, n))
            return b"x" * n

    class Store:
        def open_input_file(self, path):
            return File()

    reader = files.HashedFileReader(str(tmp_path), 32, 1000)
    monkeypatch.setattr(files, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda uri: (Store(), uri))}))
    assert [r[:2] for r in reader.read(files.FileGroup([(f"{tmp_path}/f", 100)]))] == [("f", 100)]
    assert reads == [(0, 32), (32, 32), (64, 32), (96, 4)]


def test_files_are_grouped_by_size(tmp_path):
    for i, size in enumerate((5, 5, 5, 40, 1, 1)):
        (tmp_path / f"f{i}").write_bytes(b"x" * size)
    groups = files.HashedFileReader(str(tmp_path), 7, 12).partitions()
    assert [[s for _, s in g.files] for g in groups] == [[5, 5], [5], [40], [1, 1]]
    (tmp_path / "none").mkdir()
    assert [g.files for g in files.HashedFileReader(str(tmp_path / "none"), 7, 12).partitions()] == [[]]


def test_result_documents(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.12345678, None), ("b", 0.0000005, 1.0)], "metric string, value double, lo double")
    docs = {r.document for r in files.result_documents(df, ["metric", "value", "lo"]).collect()}
    assert docs == {'{"metric":"a","value":0.123457,"lo":null}', '{"metric":"b","value":0.0,"lo":1.0}'}
    files.write_result(df, str(tmp_path / "r"), "parquet")
    assert spark.read.parquet(str(tmp_path / "r")).filter("metric = 'a'").first().value == 0.123457


def test_specs_and_campaign_manifest(spark, tmp_path):
    p = tmp_path / "spec.json"
    p.write_text('{"schema": "spec/v1", "main": {"seeds": [42, 43]}}')
    spec = files.scan_spec(spark, str(p), "spec/v1").first()
    assert spec.tag_ok and list(spec.main.seeds) == [42, 43]
    assert not files.scan_spec(spark, str(p), "spec/v2").first().tag_ok
    m = tmp_path / "campaign.json"
    m.write_text('{"runs": [{"run": "fault-r01", "rows": 3, "phases": ["a"], "phase_row_counts": {"a": 2, "pre-phase": 1}}, {"run": "x", "rows": 1}]}')
    runs = {r.run: r for r in files.scan_campaign_manifest(spark, str(m)).collect()}
    assert runs["fault-r01"].phase_row_counts == {"a": 2, "pre-phase": 1} and runs["x"].phases is None
    f = tmp_path / "manifest.json"
    f.write_text('{"schema": "m/v1", "files": [{"path": "a", "bytes": 1, "sha256": "00"}]}')
    assert files.scan_manifest(spark, str(f)).first().path == "a"


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1, float("nan"))], "event_id long, pkts_toserver double")
    assert not math.isnan(features.build_features(df, "flow").first().pkts_toserver)
