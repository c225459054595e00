"""Files of mixed layouts and the registry."""

import datetime
import json
import threading

import pytest

from barline.sources import bars as sources
from barline.sources import csv_files, registry

WANTED = ["code", "timestamps", "close", "name"]


@pytest.mark.parametrize(
    ("content", "rows"),
    [
        (b"timestamps,close\n2020-01-01,1\n", [(None, "2020-01-01", "1", None)]),
        (b"\xef\xbb\xbfclose,timestamps,name\r\n1,d,\"a, b\"\r\n,d,\r\n", [(None, "d", "1", "a, b"), (None, "d", None, None)]),
        (b'"timestamps","close","close"\n"d","1","2"\n', [(None, "d", "1", None)]),
        (b"close,other\n1,2\n", []),
        (b"", []),
        (b"timestamps,close\n", []),
        (b"timestamps,close\nd\nd,1,7\n\nd,2\n", [(None, "d", None, None), (None, "d", "1", None), (None, "d", "2", None)]),
        ("\n name , timestamps\nü,d\n".encode(), [(None, "d", None, "ü")]),
        (b"timestamps,name\nd,\xff\n", [(None, "d", None, "�")]),
    ],
)
def test_parse(content, rows):
    assert [tuple(r.values()) for r in csv_files.parse(content, WANTED, "timestamps").to_pylist()] == rows


def test_many_files_of_mixed_layouts(spark, tmp_path):
    """Files of several headers in folders: every row comes once, under the right names."""
    layouts = (("timestamps", "close", "vol"), ("vol", "code", "close", "timestamps"), ("close", "x", "timestamps"), ("x", "y"))
    expected = []
    for i in range(400):
        names, rows = layouts[i % 4], []
        for j in range(i % 5):
            day = datetime.date(2020, 1, 1) + datetime.timedelta(days=j)
            cell = {"timestamps": day.isoformat(), "close": f"{i}.5", "vol": str(j), "code": str(i), "x": "7", "y": "8"}
            rows.append(",".join(cell[n] for n in names))
            if "close" in names:
                expected.append((f"{i:06d}", day, i + 0.5, float(j) if "vol" in names else None, f"{i:06d}.csv"))
        (tmp_path / f"{i:06d}.csv").write_text("\n".join([",".join(names), *rows]) + "\n")
    got = sources.read_csv_bars(spark, str(tmp_path), with_file=True)
    assert sorted(map(repr, map(tuple, got.select("code", "ts", "close", "vol", "file").collect()))) == sorted(map(repr, expected))
    assert "collect_set" not in got._jdf.queryExecution().toString()
    spans = sources.covering_files(got, got.where("code = '000003' or code = '000006'").groupBy("code").agg({"ts": "min"}).selectExpr("code", "`min(ts)` as start", "`min(ts)` as end"))
    assert [tuple(r)[0::3] for r in spans.collect()] == [("000006", "000006.csv")]


def test_preferred_source(spark):
    d = datetime.date
    bars = spark.createDataFrame([("a", d(2020, 1, k), f) for f, n in (("f1", 9), ("f2", 5), ("f3", 9)) for k in range(1, n + 1)], "code string, ts date, file string")
    ranges = spark.createDataFrame([("a", d(2020, 1, 2), d(2020, 1, 4)), ("a", d(2020, 1, 2), d(2020, 1, 8))], "code string, start date, end date")
    names = lambda **k: [r.file for r in sources.covering_files(bars, ranges, **k).orderBy("end").collect()]
    assert names() == ["f1", "f1"] and names(prefer=("f2", "f3")) == ["f2", "f3"]
    assert names(prefer=("f2",), only=True) == ["f2"]


def test_known_indexes(spark, tmp_path):
    (tmp_path / "000001.json").write_text(json.dumps([["2020-01-02", 1, 2, 1.5, 1.2, 9], ["bad", 1, 2, 1.5, 1.2, 9]]))
    assert [r.close for r in sources.read_index(spark, str(tmp_path), "000001").where("ts is not null").collect()] == [1.5]
    assert sources.read_index(spark, str(tmp_path), "000300").collect() == []


MODES = [
    {"index": "m1", "name": "one", "lines": ["MA4"], "modeFolder": "f", "selectedFactor": "a", "selectedFactor2": "b", "photoOption": ["p"], "savedBrushTimeRanges": [{"code": "1", "startDate": "x", "endDate": "y", "saveTime": 5}], "recentNDaysValue": "20"},
    {"index": "m2", "name": "two", "photoOption": []},
]


def test_registry_keeps_all_fields(spark, tmp_path):
    (tmp_path / "modes.json").write_text(json.dumps(MODES))
    rows = sources.read_registry(spark, str(tmp_path / "modes.json"))
    sources.write_registry(rows, str(tmp_path / "again"))
    whole = lambda path: sorted((r.asDict(True) for r in registry.read_modes(spark, path).collect()), key=lambda r: r["index"])
    first, again = whole(str(tmp_path / "modes.json")), whole(str(tmp_path / "again"))
    assert first[0] == {**MODES[0]} and first[0] == again[0]
    assert {k: v for k, v in again[1].items() if v} == {"index": "m2", "name": "two"}
    new = spark.createDataFrame([("m3", "b"), ("m3", "a"), ("m1", "again")], "index string, name string")
    assert sorted((r["index"], r["name"]) for r in sources.add_modes(rows, new).collect()) == [("m1", "one"), ("m2", "two"), ("m3", "a")]


def test_two_writers(spark, tmp_path):
    folder = str(tmp_path / "registry")
    a, b = registry.Registry(spark, folder), registry.Registry(spark, folder)
    assert a.version() == 0 and a.modes().collect() == []
    one = lambda name, index="x": spark.createDataFrame([(index, name)], "index string, name string")
    seen = a.version()
    b.insert(one("b"))
    with pytest.raises(registry.Conflict):
        a.save(one("a"), seen)
    a.insert(one("a"))
    assert [(r["index"], r["name"]) for r in a.modes().collect()] == [("x", "b")]
    threads = [threading.Thread(target=lambda k=k: registry.Registry(spark, folder).insert(one(f"t{k}", f"y{k % 2}"))) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r["index"] for r in a.modes().collect()) == ["x", "y0", "y1"]
    assert [(r["index"], r["name"]) for r in a.modes(1).collect()] == [("x", "b")]  # older versions stay
