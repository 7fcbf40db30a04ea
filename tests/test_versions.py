"""Saved tables of several layouts and content identity."""

import hashlib

import pytest

from stipple.sources import versions as vs

LAYOUTS = [
    vs.Layout("b", "/new/", "id bigint, v double", {"id": "id", "v": "v"}, ["id", "v"]),
    vs.Layout("a", "/old/", "id bigint, w double", {"id": "id", "v": "w * 2"}, ["id"]),
]


def test_folder_of_three_versions_is_one_table(spark, tmp_path):
    for name, lines in {
        "new": ['{"id": 1, "v": 0.5, "schema_version": "b"}', '{"id": 2, "v": "text", "schema_version": "b"}', "{broken",
                '{"id": 3, "schema_version": "b"}', '{"id": 4, "w": 1.0, "schema_version": "a"}', '{"id": 5, "v": 1.0}'],
        "old": ['{"id": 6, "w": 4.0, "schema_version": "a"}', '{"id": 7, "schema_version": "a"}', '{"id": 8, "v": 1.0, "schema_version": "z"}'],
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "part.json").write_text("\n".join(lines) + "\n")
    rows, failures = vs.read_layouts(spark, str(tmp_path), LAYOUTS)
    assert sorted((r.id, r.v) for r in rows.collect()) == [(1, 0.5), (6, 8.0), (7, None)]
    found = {(r.path.rsplit("/", 2)[1], r.schema_version, r.reason): r.rows_n for r in failures.collect()}
    assert found == {
        ("new", "b", "unreadable"): 1, ("new", None, "unreadable"): 1, ("new", "b", "missing_fields"): 1,
        ("new", "a", "version_and_file_disagree"): 1, ("new", None, "unsupported_schema"): 1, ("old", "z", "unsupported_schema"): 1}


def test_one_field_of_two_types_is_refused(spark):
    other = vs.Layout("c", "/c/", "id string", {"id": "id"})
    with pytest.raises(ValueError):
        vs.union_schema(spark, [*LAYOUTS, other])


def test_older_rows_only_where_the_newer_are_absent(spark):
    rows = spark.createDataFrame([("b", 1, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("z", 3, 4.0)], "schema_version string, id int, v double")
    saved = vs.newest_saved(rows, ["id"], ["b", "a"])
    again = spark.createDataFrame([(1, 9.0), (3, 7.0)], "id int, v double")
    assert sorted(tuple(r) for r in vs.completed(saved, again, ["id"]).select("id", "v", "origin").collect()) == [
        (1, 1.0, "b"), (2, 3.0, "a"), (3, 7.0, "recomputed")]


def test_grids_name_what_is_wrong(spark):
    nan = float("nan")
    rows = [("fine", 0, 0.0, 1.0, 1.0), ("fine", 1, 1.0, 2.0, 1.0), ("short", 0, 0.0, 1.0, 1.0), ("twice", 0, 0.0, 1.0, 1.0), ("twice", 0, 1.0, 2.0, 1.0),
            ("gap", 0, 0.0, 1.0, 1.0), ("gap", 1, 1.5, 2.0, 1.0), ("nan", 0, 0.0, 1.0, nan), ("nan", 1, 1.0, 2.0, None)]
    df = spark.createDataFrame(rows, "k string, bin int, left_um double, right_um double, v double")
    got = {r.k: r.message for r in vs.grid_failures(df, ["k"], n_bins=2, values=["v"]).collect()}
    assert got == {"fine": "", "short": "bin_count", "twice": "bin_count", "gap": "edges_not_adjacent", "nan": "values_not_finite"}


def test_identity_hashes_blocks_in_order(spark, tmp_path):
    contents = {"empty": b"", "exact": bytes(range(256)) * 2, "rest": b"\x00\xff" * 333, "swapped": bytes(range(256))[::-1] * 2}
    for name, data in contents.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in vs.content_identity(spark, str(tmp_path), block_bytes=256).collect()}
    assert "empty.bin" not in got  # the reader passes over it
    for name, data in list(contents.items())[1:]:
        blocks = "".join(hashlib.sha256(data[i : i + 256]).hexdigest() for i in range(0, len(data), 256))
        assert got[f"{name}.bin"] == (len(data), hashlib.sha256(blocks.encode()).hexdigest())


def test_replicas_of_an_empty_and_a_faulty_group(spark):
    schema = ("g int, id string, schema_version string, tau int, parameter_tau int, dt double, edges array<double>, sha256 string, length bigint, "
              "recorded_sha256 string, recorded_length bigint")
    a, b = "a" * 64, "b" * 64
    rows = [(1, "x", "v", 1, 1, 0.1, [0.0, 1.0], a, 5, a.upper(), 5), (1, "y", "v", 1, 1, 0.1, [0.0, 1.0], b, 5, b, 5),
            (2, "x", "v", None, None, None, [0.0], a, 5, None, None), (2, "y", "v", 1, 2, float("nan"), None, a, 5, a, 5)]
    check = lambda df: vs.replica_violations(df, ["g"], replica="id", schema="v", config=["tau"], calibration=["dt"], positive=["dt"])
    got = {(r.g, r.id): r.message.split(";") for r in check(spark.createDataFrame(rows, schema)).collect()}
    assert got == {
        (2, "x"): ["incomplete_config", "invalid_calibration", "invalid_sha256", "sha256_mismatch", "size_mismatch", "duplicate_input", "invalid_edges"],
        (2, "y"): ["incompatible_config", "parameter_mismatch", "invalid_calibration", "incompatible_calibration", "duplicate_input",
                   "invalid_edges", "incompatible_edges"]}
    assert check(spark.createDataFrame([], schema)).count() == 0
