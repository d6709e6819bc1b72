import json

from pyspark.sql import functions as F

from driftline.operators.storage import Storage
from driftline.sources import readers, shred, sinks


def nested(spark):
    docs = [
        {"doc": 1, "abstract": {"text": "a"}, "inventor": [{"name": {"first": "A", "last": "B"}, "tag": [{"t": "x"}, {"t": "y"}]}, {"name": {"first": "C", "last": None}}], "keyword": ["k", "l"], "one": [{"v": 7}]},
        {"doc": 2, "abstract": None, "inventor": [{"name": {"first": "D", "last": "E"}}], "keyword": None, "one": [{"v": 8}]},
        {"doc": 3},
    ]
    schema = "doc long, abstract struct<text:string>, inventor array<struct<name:struct<first:string,last:string>,tag:array<struct<t:string>>>>, keyword array<string>, one array<struct<v:long>>, empty string"
    return spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(d) for d in docs]))


def test_tables_by_repeated_path(spark):
    t = shred.shred(nested(spark), "doc")
    assert set(t) == {"/", "/inventor/", "/inventor/tag/"}
    root = {r.doc: r for r in t["/"].collect()}
    assert root["1"]["/abstract/text/"] == "a" and root["2"]["/abstract/text/"] is None and root["1"]["/keyword/"] == ["k", "l"]
    assert root["1"]["/one/v/"] == 7 and root["3"]["/one/v/"] is None
    people = {r.id: (r.doc, r.parent, r["/inventor/name/first/"]) for r in t["/inventor/"].collect()}
    assert people == {"1.inventor.0": ("1", "1", "A"), "1.inventor.1": ("1", "1", "C"), "2.inventor.0": ("2", "2", "D")}
    tags = [(r.id, r.doc, r.parent) for r in t["/inventor/tag/"].orderBy("id").collect()]
    assert tags == [("1.inventor.0.tag.0", "1", "1.inventor.0"), ("1.inventor.0.tag.1", "1", "1.inventor.0")]


def test_options(spark):
    assert "/one/" in shred.shred(nested(spark), "doc", shred.Options(flatten_single=False))
    assert set(shred.shred(nested(spark), "doc", shred.Options(only=["/inventor/name"]))) == {"/", "/inventor/"}
    last = shred.shred(nested(spark), "doc", shred.Options(last_scalar=True))["/"].where("doc = '1'").first()
    assert last["/keyword/"] == "l"
    assert "/empty/" not in shred.drop_empty(shred.shred(nested(spark), "doc")["/"]).columns


def test_aliases():
    got = shred.aliases(["/a/name/", "/b/name/", "/b/c/name/", "/name1/", "/x/name/name/", "/id/"])
    assert len(set(got.values())) == 6 and got["/name1/"] == "name" and got["/id/"] not in ("id", "doc")


def test_melt(spark):
    t = shred.ingest(nested(spark), "doc")
    s = Storage("repo", t, {"inventor": {"first": ["firstnames", "x"], "last": ["lastnames"]}, "root": {"keyword": ["x"]}})
    assert sorted((r.doc, r.value) for r in s.melt("firstnames").collect()) == [("1", "A"), ("1", "C"), ("2", "D")]
    assert sorted(r.value for r in s.melt("x").collect()) == ["A", "C", "D", "k", "l"]
    assert [r.value for r in s.melt("lastnames").orderBy("value").collect()] == ["B", "E"]
    none = s.melt("nothing")
    assert none.columns == ["repo", "frame", "col", "doc", "id", "value", "assignement"] and none.isEmpty()
    assert s.docs().count() == 3
    one = s.of_docs(spark.createDataFrame([("2",)], "doc string"))
    assert one["inventor"].count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j/a.json").write_text('{"data": [{"x": 1}, {"x": 2}]}')
    assert readers.json_list(spark, str(tmp_path / "j")).count() == 2
    assert readers.json_documents(spark, str(tmp_path / "j")).count() == 1
    (tmp_path / "x").mkdir()
    (tmp_path / "x/123456.xml").write_text("<?xml version='1.0'?><r><p><a>1</a><b>u</b></p></r>\n<?xml version='1.0'?><r><p><a>2</a><b>v</b></p></r>")
    assert readers.split_xml(spark, str(tmp_path / "x")).count() == 2
    (tmp_path / "y").mkdir()
    (tmp_path / "y/123456.xml").write_text("<r><p><a>1</a><b>u</b></p><p><a>2</a></p></r>")
    rows = readers.xml_documents(spark, str(tmp_path / "y"), "p").orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "u"), (2, None)] and rows[0].filename.endswith("123456.xml")
    (tmp_path / "g.csv").write_text("gid,type,city,gmina,powiat,wo,lat,lon\n1,miasto,Łódź,g,p,w,51.7,19.4\n")
    (g,) = readers.gazetteer_csv(spark, str(tmp_path / "g.csv"), województwo="wo").collect()
    assert g.city == "Łódź" and g.lat == 51.7 and g["województwo"] == "w"


def test_citations_must_have_documents(spark, tmp_path):
    (tmp_path / "c.csv").write_text('P,query\n111111,"PL 123456"\n222222,x\n')
    known = spark.createDataFrame([("111111", "d1"), ("222222", "d2")], "code string, doc string")
    rows = readers.citations_csv(spark, str(tmp_path / "c.csv"), known).orderBy("entry").collect()
    assert [tuple(r) for r in rows] == [(0, "d1", "PL 123456"), (1, "d2", "x")]
    try:
        readers.citations_csv(spark, str(tmp_path / "c.csv"), known.limit(1)).collect()
    except Exception as e:
        assert "no document has code" in str(e)
    else:
        raise AssertionError


def test_regions_and_statistics(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]
    feature = lambda g, kind, c: {"type": "Feature", "properties": {"id": g, "n": "Opolskie", "t": "w"}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "r.json").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("1", "Polygon", [ring]), feature("2", "MultiPolygon", [[ring], [ring]])]}))
    got = {r.gid: len(r.edges) for r in readers.regions_geojson(spark, str(tmp_path / "r.json"), "id", "n", "t").collect()}
    assert got == {"1": 5, "2": 10}
    (tmp_path / "s.csv").write_text("region,subject,section,name,var,year,value\nOPOLSKIE,a,b,c,d,2013,4.5\nELSEWHERE,a,b,c,d,2013,1\n")
    regions = spark.createDataFrame([("1", "Opolskie")], "gid string, name string")
    assert [tuple(r) for r in readers.statistics_csv(spark, str(tmp_path / "s.csv"), regions).collect()] == [("1", 2013, "a/b/c/d", 4.5)]


def test_gml_places(spark, tmp_path):
    from driftline.functions.geo import to_transverse_mercator

    n, e = to_transverse_mercator(52.0, 20.0)
    (tmp_path / "p.xml").write_text(f"<c><m><name>A</name><pos>{n} {e}</pos></m><m><name>B</name><pos>{n} {e}</pos></m></c>")
    rows = readers.gazetteer_gml(spark, str(tmp_path / "p.xml"), "m", "pos", {"city": "name"}).collect()
    assert {r.city for r in rows} == {"A", "B"} and abs(rows[0].lat - 52) < 1e-6 and abs(rows[0].lon - 20) < 1e-6


def test_microdata():
    page = """<div itemscope itemtype="t/P"><h1 itemprop="name">A <b>B</b></h1><meta itemprop="no" content="7">
      <ul><li itemprop="inventor" itemscope><span itemprop="name">X</span></li><li itemprop="inventor" itemscope><a itemprop="url" href="/u">z</a></li></ul>
      <time itemprop="day" datetime="2010-01-02">then</time><span itemprop="a b">both</span></div><p itemprop="lost">no</p>"""
    (item,) = readers.microdata_items(page)
    p = item["properties"]
    assert item["type"] == "t/P" and p["name"] == ["A B"] and p["no"] == ["7"] and p["day"] == ["2010-01-02"] and p["a"] == p["b"] == ["both"]
    assert [i["properties"] for i in p["inventor"]] == [{"name": ["X"]}, {"url": ["/u"]}]
    assert readers.microdata_items(None) == [] and readers.microdata_items("<div itemscope><p itemprop=x>1")[0]["properties"] == {"x": ["1"]}


def test_microdata_column(spark):
    df = spark.createDataFrame([("<i itemscope><b itemprop='n'>1</b></i>",), (None,)], "value string")
    rows = readers.microdata(df).select(F.from_json(F.get("root", F.lit(0)), "properties struct<n: array<string>>").alias("r")).collect()
    assert rows[0].r.properties.n == ["1"] and rows[1].r is None


def test_masterfile_and_html(spark):
    df = spark.createDataFrame([("01jan2010", "bad", "US1234567B2", "123.0")], "a_dt string, b_dt string, pubno string, appl_id string")
    r = readers.masterfile(df).first()
    assert (str(r.a_dt), r.b_dt, r.jurisdiction, r.kind, r.number, r.appl_id) == ("2010-01-01", None, "US", "B2", "1234567", "123")
    html = spark.createDataFrame([("<p>a<script>x</script> <!-- c --><b>b</b>\n c</p>",)], "h string")
    assert html.select(readers.html_text(F.col("h"))).first()[0] == "a b c"


def test_sinks(spark, tmp_path):
    path, made = str(tmp_path / "m"), []

    def make():
        made.append(1)
        return spark.range(3)

    assert sinks.memoised(spark, path, make).count() == 3 and sinks.memoised(spark, path, make).count() == 3 and len(made) == 1
    sinks.memoised(spark, path, make, refresh=True)
    assert len(made) == 2
    tables = {"t": spark.createDataFrame([(1, "1", "x")], "id int, doc string, city string")}
    sinks.write_blank_bindings(tables, str(tmp_path / "b.yaml"))
    assert sinks.read_bindings(str(tmp_path / "b.yaml")) == {"t": {"city": []}}
    (tmp_path / "c.yaml").write_text("t:\n  city: [city, city-inventor]\n  name: names\n")
    assert sinks.read_bindings(str(tmp_path / "c.yaml"))["t"] == {"city": ["city", "city-inventor"], "name": ["names"]}
    tex = sinks.latex_table(spark.createDataFrame([("a&b", 0.5)], "n_x string, v double"))
    assert r"a\&b & 0.500 \\" in tex and r"n\_x & v \\" in tex


def test_growing_index(spark, tmp_path):
    from driftline.operators.index import word_index
    from driftline.streaming.incremental import grow_index, read_index

    schema = "repo string, frame string, col string, doc string, id string, value string, assignement string"
    rows = [("r", "f", "c", str(k), "1", "alpha beta alpha", "name") for k in range(4)]
    for part in range(2):
        spark.createDataFrame(rows[2 * part : 2 * part + 2], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        grow_index(stream, word_index, str(tmp_path / "idx"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(map(tuple, read_index(spark, str(tmp_path / "idx")).collect()))
    assert got == sorted(map(tuple, word_index(spark.createDataFrame(rows, schema)).collect()))
