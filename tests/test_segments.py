import pytest
from annospark.operators import segprops
from annospark.operators.segprops import segment_properties, segment_table
from annospark.operators.select import compile_expression, select_properties, template_names, with_expressions

#: Plots of a wood: id, name, zone, soil, irrigated, young and grown trees.
ROWS = [
    (31, "oak-1", "valley", "loam", True, 12, 40), (7, "oak-2", "ridge", "chalk", False, 705, 90), (52, "elm", "valley", None, True, 3, 801), (18, "birch", "marsh", "peat bog", True, 260, 1200),
    (44, "oak-3", "valley", "chalk", False, 99, 15), (5, "alder", "marsh", None, False, 840, 2), (90, "yew", "ridge", "loam", True, 101, 800), (63, "lime", "valley", "peat bog", True, 700, 799),
]


@pytest.fixture(scope="module")
def plots(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "pos int, segment long, plot string, zone string, soil string, irrigated boolean, young long, grown long")


@pytest.fixture(scope="module")
def info(plots):
    return segment_properties(plots, "plot", tags=["zone", "soil", "irrigated"], sort_tags=True, order_col="pos", tag_descriptions={"marsh": "wet ground"}, col_descriptions={"plot": "t"})


def test_document(info):
    p = {x["id"]: x for x in info["inline"]["properties"]}
    assert info["inline"]["ids"] == [str(r[0]) for r in ROWS]
    assert list(p) == ["plot", "young", "grown", "tags"] and p["plot"]["type"] == "label" and p["plot"]["description"] == "t"
    assert p["young"]["data_type"] == "int32" and p["young"]["values"] == [r[5] for r in ROWS]
    assert p["tags"]["tags"] == ["irrigated", "soil:chalk", "soil:loam", "soil:peat_bog", "zone:marsh", "zone:ridge", "zone:valley"]
    assert p["tags"]["values"] == [[0, 2, 6], [1, 5], [0, 6], [0, 3, 4], [1, 6], [4], [0, 2, 5], [0, 3, 6]]
    assert p["tags"]["tag_descriptions"] == ["irrigated", "soil:chalk", "soil:loam", "soil:peat_bog", "wet ground", "zone:ridge", "zone:valley"]


def test_round_trip(spark, info):
    t = segment_table(spark, info)
    tag = lambda x: x and x.replace(" ", "_")
    assert [(r.segment, r.plot, r.zone, r.soil, r.irrigated, r.young, r.grown) for r in t.collect()] == [(*r[:3], tag(r[3]), "irrigated" if r[4] else None, *r[5:]) for r in ROWS]
    flags = segment_table(spark, info, consolidate=False)
    assert flags.where("`zone:ridge`").count() == 2


def test_rules(spark):
    df = spark.createDataFrame([(1, "", "a b", "a_b", False), (2, None, "x", "x", True), (3, "", "", None, False)], "segment long, note string, p string, q string, f boolean")
    assert [r.segment for r in segprops.drop_empty(df).orderBy("segment").collect()] == [1, 2]
    tags = lambda mode, **kw: segment_properties(df, tags=["p", "q", "f"], tag_prefix_mode=mode, **kw)["inline"]["properties"][-1]
    assert tags("all")["tags"] == ["p:a_b", "p:x", "q:a_b", "q:x", "f"]
    assert tags("disambiguate")["tags"] == ["p:a_b", "p:x", "q:a_b", "q:x", "f"]
    assert tags(None)["values"] == [[0, 0], [1, 1, 2]] and tags(None, distinct_codes=True)["values"] == [[0], [1, 2]]
    one = spark.createDataFrame([(1, "n")], "segment long, name string")
    assert segment_properties(one)["inline"]["properties"][0]["type"] == "label"
    for bad in [{"numbers": ["p"]}, {"tags": ["none"]}, {"tags": ["p", "p"]}, {}]:
        with pytest.raises(ValueError):
            segment_properties(df, **bad)


def test_number_types(spark):
    df = spark.createDataFrame([(1, -5, 3 << 30, 1 << 40, 0.5, float("nan"))], "segment long, a long, b long, c long, d double, e double")
    assert segprops.number_types(df, ["a", "b", "d"]) == {"a": "int32", "b": "uint32", "d": "float32"}
    for c in "ce":
        with pytest.raises(ValueError):
            segprops.number_types(df, [c])


def test_expressions(spark, info):
    full = segment_table(spark, info)
    new = with_expressions(full, {"label": "{plot}_{soil}", "big": "young > 100 and grown >= 800", "sum": "young + grown", "twice": "sum * 2", "kind": "zone", "pick": "plot in ('elm', 'lime') or not (young < 700)"}, ["segment"]).collect()
    assert [r.label for r in new] == [f"{r[1]}_{(r[3] or '').replace(' ', '_')}".strip() for r in ROWS]
    assert [r.big for r in new] == [False, False, False, True, False, False, True, False]
    assert [r.twice for r in new] == [2 * (r[5] + r[6]) for r in ROWS] and [r.kind for r in new] == [r[2] for r in ROWS]
    assert [r.pick for r in new] == [False, True, True, False, False, True, False, True]
    df = spark.createDataFrame([(1, "~", ""), (2, "a", "~")], "segment long, u string, v string")
    got = with_expressions(df, {"label": "{u}{v}", "copy": "u", "same": "u == ''"}, ["segment"]).collect()
    assert [(r.label, r.copy, r.same) for r in got] == [("~", "~", True), ("a", "a", False)]
    assert template_names("{a}-{b:3}") == ["a", "b"] and template_names("a{") == []
    for bad in ("__import__('os')", "a.b", "f(1)", "[x for x in y]", "1 +", "lambda: 1", "zzz + 1"):
        with pytest.raises(ValueError):
            compile_expression(bad, {"a": None})
    with pytest.raises(ValueError):
        with_expressions(df, {"x": "{nope}"}, ["segment"])


def test_select(spark, info):
    subset = ["_all_tags", "young"]
    out = select_properties(spark, info, subset, {"label": "{plot}!"}, {"heavy": "young > 700"})
    assert subset == ["_all_tags", "young"]
    p = {x["id"]: x for x in out["inline"]["properties"]}
    assert p["label"]["values"][0] == "oak-1!" and p["young"]["values"][0] == 12 and "grown" not in p
    assert "heavy" in p["tags"]["tags"] and "zone:marsh" in p["tags"]["tags"]
    with pytest.raises(ValueError):
        select_properties(spark, info, ["nope"])


def test_document_as_a_table(spark, plots, tmp_path, monkeypatch):
    """A document that stays a table: its file, its dict and its table are those of the collected one, and a selection collects no rows."""
    import json

    from pyspark.sql import DataFrame

    given = dict(tags=["zone", "soil", "irrigated"], sort_tags=True, order_col="pos", tag_descriptions={"marsh": "wet ground"}, col_descriptions={"plot": "t"})
    doc, info = segprops.segment_document(plots, "plot", **given), segment_properties(plots, "plot", **given)
    doc.write(str(tmp_path))
    assert doc.to_dict() == info == json.loads((tmp_path / "info").read_text()) and list(json.loads((tmp_path / "info").read_text())["inline"]["properties"][0]) == list(info["inline"]["properties"][0])
    assert segment_table(spark, doc).collect() == segment_table(spark, info).collect()
    ask = (["_all_tags", "young"], {"label": "{plot}!"}, {"heavy": "young > 700"})
    collected, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: collected.append(self.columns) or collect(self))
    new = select_properties(spark, doc, *ask)
    assert isinstance(new, segprops.Document) and all(c == ["pos", "value", "tag", "code"] for c in collected)
    monkeypatch.undo()
    assert new.to_dict() == select_properties(spark, info, *ask)


def test_rows_with_one_id(spark):
    """Repeated ids: each row has its own tags, and is there once."""
    df = spark.createDataFrame([(1, "n", "a"), (1, "m", "b"), (2, "o", None)], "segment long, name string, p string")
    info = segment_properties(df, "name", tags=["p"], order_col="name")["inline"]
    assert info["ids"] == ["1", "1", "2"] and [p["values"] for p in info["properties"]] == [["m", "n", "o"], [[1], [0], []]]


def test_documents_of_few_tasks(spark, tmp_path):
    """A table that one task reads is dealt to more, and its tags are made distinct before anything sorts them, in one read."""
    spark.range(500).selectExpr("id AS segment", "concat('n', id) AS name", "concat('z ', id % 3) AS zone", "id % 2 = 0 AS even").coalesce(1).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert df.rdd.getNumPartitions() == 1
    doc = segprops.segment_document(df, "name", tags=["zone", "even"])
    assert doc.rows.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    dictionary = segprops.tag_dictionary(df, ["zone", "even"])
    plan = dictionary._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("HashAggregate") >= 2 and "SortAggregate" not in plan
    assert [(r.tag, r.code) for r in dictionary.orderBy("code").collect()] == [("zone:z_0", 0), ("zone:z_1", 1), ("zone:z_2", 2), ("even", 3)]
    assert [r.segment for r in segment_table(spark, doc).collect()] == list(range(500))
