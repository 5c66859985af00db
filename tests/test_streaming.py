import json
import os

from lexforge.sources.tables import VersionedTable
from lexforge.streaming import state as S


def stream(spark, tmp_path, schema, rows):
    names = [x.split()[0] for x in schema.split(", ")]
    (tmp_path / "in").mkdir()
    for i, part in enumerate(rows):
        file = tmp_path / "in" / f"{i}.json"
        file.write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in part))
        os.utime(file, (1_700_000_000 + 60 * i,) * 2)  # files come in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))


def result(tmp_path, df, mode):
    found = []
    S.write_to(df, str(tmp_path / "check"), lambda b: found.extend(tuple(r) for r in b.collect()), mode).awaitTermination()
    return found


def test_running_lengths(spark, tmp_path):
    df = stream(spark, tmp_path, "stream long, step long, ids array<int>", [[(0, 0, [1, 5, 5]), (1, 0, [1, 5, 0])], [(0, 1, [5, 5, 1]), (1, 1, [5, 5, 5])], [(0, 2, [5, 0, 0])]])
    assert sorted(result(tmp_path, S.running_lengths(df), "append")) == [(0, 0, 0), (0, 1, 3), (0, 2, 1), (1, 0, 0), (1, 1, 2)]


def test_affinities(spark, tmp_path):
    df = stream(spark, tmp_path, "a string, b string, place long, score double", [[("x", "y", 0, 1.0)], [("x", "y", 1, 1.0)]])
    assert [round(r[2], 6) for r in result(tmp_path, S.affinities(df), "update")] == [0.1, 0.19]


def test_candidates_fall_three_times(spark, tmp_path):
    df = stream(spark, tmp_path, "word string, place long, score double", [[("w", 0, 5.0), ("w", 1, 4.0), ("w", 2, 3.0)], [("w", 3, 2.0)]])
    assert [r[2] for r in result(tmp_path, S.candidate_scores(df), "update")] == [True, False]


def test_upserting_sink_and_routes(spark, tmp_path):
    table = VersionedTable(spark, f"{tmp_path}/table", "k long, v string")
    df = stream(spark, tmp_path, "k long, v string", [[(1, "a"), (2, "b")], [(1, "c")]])
    S.write_to(df, str(tmp_path / "check"), lambda b: table.upsert(b, ["k"])).awaitTermination()
    assert sorted(tuple(r) for r in table.read().collect()) == [(1, "c"), (2, "b")]
    assert [r.route for r in S.routed(table.read().sort("k"), {"one": "k = 1", "small": "k < 5"}).collect()] == ["one", "small"]


def test_windows_close_by_watermark(spark, tmp_path):
    df = stream(spark, tmp_path, "ts timestamp, event_type string, value double", [[("2024-01-01T00:10:00", "a", 1.0), ("2024-01-01T00:50:00", "a", 2.0)], [("2024-01-01T05:00:00", "a", 1.0)], [("2024-01-01T05:05:00", "a", 1.0)], [("2024-01-01T00:20:00", "a", 9.0)]])
    assert [(r[2], r[3]) for r in result(tmp_path, S.windowed_counts(df), "append")][:1] == [(2, 3.0)]
