import json
from datetime import datetime, timedelta

from heliovox.operators import schema_drift as D
from heliovox.queries import pipeline

T0 = datetime(2024, 1, 1)


def files(*contents, series=1, days=40):
    """Rows of files in order of time, their ids in another order."""
    rows = []
    for n, records in enumerate(contents):
        for k, body in enumerate(records):
            rows.append((series, (n * 7 + 3) % 100 + series * 100, T0 + timedelta(days=n * days), k, body if body is None or isinstance(body, str) else json.dumps(body)))
    return rows


def run(spark, rows):
    df = spark.createDataFrame(rows, "series_id int, file_id int, at timestamp, line int, body string").selectExpr("*", "1 as series", "2 as file", "3 as name", "4 as kind")
    args = dict(series="series_id", file="file_id", at="at", body="body")
    return {tuple(r) for r in D.changes(df, **args).collect()}, df, args


def planes(n=6, **extra):
    return [{"id": i, "tilt_deg": 10.0 + i * 7.1, "orientation": ["wall", "floor", "roof"][i % 3], **{k: f(i) for k, f in extra.items()}} for i in range(n)]


def test_changes_of_every_kind(spark):
    first = planes(w=lambda i: i + 0.5, gone=lambda i: i * 3.3, kept=lambda i: None)
    second = [{"id": f"PL-{p['id']:03}", "TiltRad": p["tilt_deg"] * 0.017453292519943295, "orientation": p["orientation"], "w": str(p["w"]), "kept": None, "fresh": 10000 + p["id"]} for p in first]
    third = [{("facing" if k == "orientation" else k): v for k, v in p.items()} for p in second]
    got, _, _ = run(spark, files(first, [*second, second[0], '{"id": 1, "cut', None, "", "[1, 2]"], third))
    ids = {r[1] for r in files(first, second, third)}
    a, b, c = (3 + 100, 10 + 100, 17 + 100)
    assert ids == {a, b, c}
    assert got == {
        (b, "renamed", "tilt_deg", "TiltRad"), (b, "retyped", "w", ""), (b, "retyped", "id", ""), (b, "removed", "gone", ""), (b, "added", "fresh", ""), (c, "renamed", "orientation", "facing"),
    }


def test_values_decide_not_names(spark):
    first = planes(height=lambda i: 2.0 + i)
    other = [{**{k: v for k, v in p.items() if k != "height"}, "height_m": 50.0 - 3 * p["id"]} for p in first]
    got, _, _ = run(spark, files(first, other))
    assert {(k, f) for _, k, f, _ in got} == {("removed", "height"), ("added", "height_m")}


def test_same_month_other_series_and_empty(spark):
    rows = files(planes(2), planes(2, a=lambda i: i), planes(2, a=lambda i: i, b=lambda i: "x"), days=2) + files(planes(1), series=2) + files(["nonsense", None], planes(1), series=3)
    got, df, args = run(spark, rows)
    assert {(k, f) for f_, k, f, _ in got if f_ < 200} == {("added", "a"), ("added", "b")}
    assert {(k, f) for f_, k, f, _ in got if f_ >= 300} == {("added", "id"), ("added", "tilt_deg"), ("added", "orientation")}
    assert not [g for g in got if 200 <= g[0] < 300]
    assert D.changes(df.limit(0), **args).count() == 0


def test_union_table(spark):
    first = planes(4)
    second = [{"id": str(p["id"]), "tilt": f"{p['tilt_deg']}".replace(".", ",") + " deg", "orientation": p["orientation"], "at": {"x": 1.0, "y": 2.5}} for p in first]
    third = [{"id": p["id"], "tilt_rad": p["tilt_deg"] * 0.017453292519943295, "orientation": p["orientation"], "at": [1.0, 2.5]} for p in first]
    _, df, args = run(spark, files(first, second, third))
    out = D.union_table(df, **args, keep=["line"]).orderBy("file_id", "line").collect()
    assert [round(r["tilt"], 9) for r in out] == [round(p["tilt_deg"], 9) for p in first] * 3
    assert [r["id"] for r in out] == [0, 1, 2, 3] * 3
    assert out[-1]["at"] == [1.0, 2.5] and out[0]["at"] is None
    assert D.promote({"double", "double[]"}) == "array<double>" and D.promote({"boolean", "double"}) == "string" and D.promote({"double", "bigint"}) == "double"


def test_nothing_is_lost_in_the_union(spark):
    first = [{"id": 9007199254740993, "day": "2024-01-15", "corners": [[1, 2], [3, 4.5]], "it's \"odd\"": "a", "code": "007", "mixed": 1, "flag": True, "who": {"name": "wall"}, "w": "1 2.5", "tags": ["a"]}]
    second = [{"id": 9007199254740995, "day": "2024-02-01T10:30:00Z", "corners": [[5, 6]], "it's \"odd\"": None, "code": "12", "mixed": [2, 3], "flag": None, "who": "roof", "w": [3, 4], "tags": []}]
    _, df, args = run(spark, files(first, second))
    out = D.union_table(df, **args, keep=["line"]).orderBy("file_id")
    assert dict(out.dtypes)["id"] == "bigint" and dict(out.dtypes)["day"] == "timestamp" and dict(out.dtypes)["tags"] == "array<string>"
    rows = {r["id"]: r.asDict() for r in out.collect()}
    a, b = rows[9007199254740993], rows[9007199254740995]
    assert a["corners"] == [[1.0, 2.0], [3.0, 4.5]] and b["corners"] == [[5.0, 6.0]]
    assert a["it's \"odd\""] == "a" and (a["code"], b["code"]) == ("007", "12")
    assert (a["mixed"], b["mixed"]) == ([1], [2, 3]) and (a["flag"], b["flag"]) == (True, None)
    assert (a["who"], b["who"]) == ('{"name":"wall"}', "roof") and (a["w"], b["w"]) == ([1.0, 2.5], [3.0, 4.0]) and (a["tags"], b["tags"]) == (["a"], [])


def test_promotion_lattice():
    kinds = ["bigint", "double", "boolean", "timestamp", "string", "bigint[]", "double[][]", "string[]", "object", "numbers", "void[]", "object[]"]
    for a in kinds:
        for b in kinds:
            assert D.promote({a, b}) == D.promote({b, a})
    assert D.promote({"bigint[]", "double"}) == "array<double>" and D.promote({"bigint", "double[][]"}) == "array<array<double>>"
    assert D.promote({"timestamp", "string"}) == "string" and D.promote({"timestamp"}) == "timestamp" and D.promote({"numbers", "double[]"}) == "array<double>"
    assert D.promote({"void[]", "bigint[]"}) == "array<bigint>" and D.promote({"string[]", "string"}) == "string" and D.promote({"numbers"}) == "string"


def test_plane_tables(spark, tmp_path):
    tilted = "1L as plane_uid, 1L as series_id, 0 as id, {} as orientation, 88.5D as tilt_deg, cast(null as double) as angle_deg, array(1D, 0D, 0D) as normal, timestamp'2024-01-01' as exported_at"
    plain = "{0}L as plane_uid, 2L as series_id, {0} as id, {1} as angle_deg, array(0D, 0D, 1D) as normal, timestamp'2024-01-02' as exported_at"
    spark.sql("select " + tilted.format("cast(null as string)") + " union all select " + tilted.format("'Wall'").replace("1L as plane_uid", "2L as plane_uid").replace("cast(null as double)", "7.25D")).write.parquet(f"{tmp_path}/planes.parquet")
    texts = ["'18,5'", "'-4.5°'", "' 3'", "cast(null as string)"]
    spark.sql(" union all ".join("select " + plain.format(n, x) for n, x in enumerate(texts))).write.parquet(f"{tmp_path}/planes_notilt.parquet")
    body = json.dumps({"id": 0, "angle_deg": 7.25, "orientation": "wall"})
    spark.createDataFrame([(9, 5, 1, "planes", T0 + timedelta(days=9), 0, body)], "record_id long, file_id long, series_id long, family string, exported_at timestamp, line_no int, body string").write.parquet(f"{tmp_path}/plane_records.parquet")
    out = pipeline.p4_planes(spark, str(tmp_path)).collect()
    assert sorted((r["family"], r["plane_uid"] or 0, r["angle_deg"]) for r in out if r["angle_deg"] is not None) == [("planes", 0, 7.25), ("planes", 2, 7.25), ("planes_notilt", 0, 18.5), ("planes_notilt", 1, -4.5), ("planes_notilt", 2, 3.0)]
    assert len(out) == 7 and {r["tilt_deg"] for r in out if r["family"] == "planes_notilt"} == {None} and {r["plane_record_id"] for r in out} == {9, None}
    assert {r["orientation"] for r in out if r["plane_uid"] == 1 and r["family"] == "planes"} == {None}
    got = {tuple(r) for r in pipeline.p4_tables(spark, str(tmp_path)).collect()}
    assert got == {("planes", "added", "orientation", ""), ("planes", "added", "tilt_deg", ""), ("planes", "retyped", "angle_deg", "")}


def test_union_of_nothing_and_of_nothing_readable(spark):
    _, df, args = run(spark, files(planes(2), ["nonsense", None, "[1]"]))
    assert D.union_table(df.limit(0), **args, keep=["line"]).count() == 0
    assert D.union_table(df.where("file_id = 110"), **args, keep=["line", "name"]).count() == 0
    assert D.union_table(df, **args, keep=["line", "kind"]).count() == 2
