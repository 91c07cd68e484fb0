"""Layers, links, scripts, publishing, streams."""

import json
import threading
import urllib.request

import pytest
from annospark.operators.local import default_shader, extract_annotations, local_layer, standardize
from annospark.sources import links, publish, video
from annospark.streaming.extract import layer_counts

STATE = {
    "layers": [
        {"type": "annotation", "name": "a", "annotations": [{"type": "point", "id": "1", "point": [1, 2, 3]}, {"type": "ellipsoid", "id": "2", "point": [4, 5, 6], "radii": [1, 1, 2]}]},
        {"type": "annotation", "name": "b", "visible": False, "annotations": [{"type": "line", "id": "3", "description": "d", "pointA": [0, 0, 0.5], "pointB": [1, 1, 1]}]},
        {"type": "annotation", "name": "c"}, {"type": "segmentation", "name": "s"},
    ]
}


def test_extract(spark):
    df = extract_annotations(spark, links.encode_link("https://v", STATE), link_index=4)
    assert df.columns == ["link_index", "layer", "type", "x", "y", "z", "rx", "ry", "rz", "xa", "ya", "za", "xb", "yb", "zb", "id", "description"]
    assert df.count() == 3
    seen = extract_annotations(spark, STATE, visible_only=True)
    assert "xa" not in seen.columns and dict(seen.dtypes)["x"] == "bigint" and dict(seen.dtypes)["rx"] == "double"


def test_local_layer(spark):
    df = spark.createDataFrame([("p", 1.0, 2.0, 3.0, None, [5, 6], "#ff0000"), ("e", 1.0, 2.0, 3.0, 9.0, [7], "#00ff00")], "id string, x double, y double, z double, rx double, segments array<long>, tone string").withColumns({})
    from pyspark.sql import functions as F

    df = df.withColumn("ry", F.col("rx")).withColumn("rz", F.col("rx"))
    layer = local_layer(df, linked_layer="seg", properties=["tone"], order_col="id")
    assert [a["type"] for a in layer["annotations"]] == ["ellipsoid", "point"]
    assert layer["annotations"][1] == {"type": "point", "id": "p", "point": [1.0, 2.0, 3.0], "segments": ["5", "6"], "props": ["#ff0000"]}
    assert layer["annotationProperties"] == [{"id": "tone", "type": "rgb"}] and layer["filterBySegmentation"] == ["segments"]
    back = extract_annotations(spark, {"layers": [layer]})
    assert sorted(r.id for r in back.collect()) == ["e", "p"]
    ids = standardize(df.drop("id")).select("id")
    assert ids.distinct().count() == 2
    with pytest.raises(Exception, match="every row needs"):
        standardize(df.withColumn("x", F.lit(None).cast("double"))).collect()
    assert "setLineColor" in default_shader(["line"]) and "setPointMarkerSize" not in default_shader(["line"])


def test_links():
    assert links.parse_link(links.encode_link("https://v", STATE)) == STATE
    assert links.state_url("gs://b/x.json") == "https://storage.googleapis.com/b/x.json"
    assert links.state_url("https://b/x.json") == "https://b/x.json"
    assert links.layer(STATE, "a")["name"] == "a" and list(links.layers(STATE)) == ["a", "b", "c", "s"]
    for bad in (lambda: links.layer(STATE, "[ab]"), lambda: links.layer(STATE, "zz"), lambda: links.state_url("ftp:x"), lambda: links.parse_link("no")):
        with pytest.raises(ValueError):
            bad()


def test_video():
    a = {"layers": [{"name": "a", "p": [1, 2.5, True], "q": ["1", "2"], "s": 'x"y'}, {"b": {}}], "z": 1}
    b = {"layers": [{"name": "a", "p": [1], "q": ["x"], "s": "k"}], "y": 2, "z": 1}
    text = f"# hi\n{links.encode_link('https://v', a)}\n\n2.5\n{links.encode_link('https://v', b)}\n"
    items = video.align(video.read_script(text))
    assert [json.loads("\n".join(i.aligned)) for i in items] == [a, b] and items[1].duration == 2.5
    assert len({len(i.aligned) for i in items}) == 1
    again = video.read_script(video.from_sheet(video.to_sheet(items), "v"))
    assert [i.state for i in again] == [a, b] and again[0].comment == "# hi\n"
    assert video.merge_keys([1, 2, 3], [2, 4, 3]) == [1, 2, 4, 3]
    for bad in (lambda: video.merge_keys([1, 2], [2, 1]), lambda: video.read_script("what"), lambda: video.read_script("1\n2\n"), lambda: video.nested_keys({"a": None})):
        with pytest.raises(ValueError):
            bad()


def test_publish(spark, tmp_path):
    n = publish.upload_states(spark.createDataFrame([("a", "{}"), ("b", "[1]")], "name string, state string"), str(tmp_path))
    assert n == 2 and json.loads((tmp_path / "b.json").read_text()) == [1]
    server = publish.serve(str(tmp_path), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}/b.json"
    with urllib.request.urlopen(urllib.request.Request(at, headers={"Range": "bytes=1-1"})) as r:
        assert r.status == 206 and r.read() == b"1" and r.headers["Access-Control-Allow-Origin"] == "*"
    with urllib.request.urlopen(at) as r:
        assert r.read() == b"[1]"
    server.shutdown()


def test_stream(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", json.dumps(STATE)), ("2024-01-01 00:20:00", json.dumps(STATE)), ("2024-01-01 02:00:00", json.dumps(STATE))]
    df = spark.createDataFrame(rows, "ts string, state string").selectExpr("cast(ts as timestamp) as ts", "state")
    df.write.parquet(str(tmp_path / "in"))
    stream = layer_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "ts")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.layer, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("a", 4), ("b", 1), ("b", 2)]


def test_color_shader(spark):
    """The shader's arithmetic, done here, gives the engine's colours."""
    from annospark.functions.colors import K1, K2, STEP, color_shader, with_color
    from pyspark.sql import functions as F

    text, m = color_shader(3), (1 << 32) - 1
    assert all(f"{k:#x}u" in text for k in (K1, K2, STEP)) and "default=3" in text and text.count("{") == text.count("}")

    def stirred(state, word):
        word = word * K1 & m
        state ^= ((word << 15 | word >> 17) & m) * K2 & m
        return ((state << 13 | state >> 19) & m) * 5 + STEP & m

    ids = [0, 1, 77, 12345, 4294967295]
    got = {r.s: r.color for r in with_color(spark.createDataFrame([(i,) for i in ids], "s long"), F.col("s"), seed=3).collect()}
    for i in ids:
        h = stirred(stirred(3, i), 0)
        hue, sat = 6 * (h & 255) / 255, 0.5 + 0.5 * (h >> 8 & 255) / 255
        pure = [min(1, max(0, abs((hue + k) % 6 - 3) - 1)) for k in (0, 4, 2)]
        want = [255 * (1 - sat + sat * p) for p in pure]
        assert all(abs(int(got[i][1 + 2 * k : 3 + 2 * k], 16) - w) <= 0.51 for k, w in enumerate(want))


def test_local_address():
    assert publish.local_address().count(".") == 3


def test_link_columns(spark):
    from pyspark.sql import functions as F

    states = [json.dumps(STATE), '{"layers": [{"name": "a b/~*+é%", "type": "x"}]}', None]
    df = spark.createDataFrame([(s,) for s in states], "s string").select("s", links.encoded("https://v", F.col("s")).alias("l"))
    for r in df.select("s", "l", links.decoded(F.col("l")).alias("back"), F.size(links.layer_array(F.col("s"))).alias("n")).collect():
        assert r.back == r.s and (r.s is None or links.parse_link(r.l) == json.loads(r.s) and r.l == links.encode_link("https://v", json.loads(r.s)) or not json.dumps(json.loads(r.s)) == r.s)
    with pytest.raises(Exception, match="layers match"):
        df.select(links.one_layer(F.col("s"), "[ab]").alias("x")).collect()
