import pytest
from tablelens.plans import charts, planner, report
from tablelens.sources import readers, sampling


def test_csv_and_tsv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,2,3\n4,5,6\n")
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n3\t4\n")
    c = readers.load_dataset(spark, str(tmp_path / "a.csv"))
    t = readers.load_dataset(spark, str(tmp_path / "b.tsv"))
    assert (c.count(), len(c.columns)) == (2, 3) and (t.count(), len(t.columns)) == (2, 2)


def test_txt_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a,b\n1,2\n")
    with pytest.raises(readers.UnsupportedFile):
        readers.load_dataset(spark, str(tmp_path / "a.txt"))


def test_latin1_and_bom(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("name,city\ncafé,Zürich\n".encode("latin-1"))
    (tmp_path / "u.csv").write_bytes("﻿ id ,v\n1,2\n".encode("utf-8"))
    l1 = readers.load_dataset(spark, str(tmp_path / "l.csv"))
    assert readers.detect_encoding(spark, str(tmp_path / "l.csv")) == "ISO-8859-1"
    assert l1.first()["city"] == "Zürich"
    assert readers.load_dataset(spark, str(tmp_path / "u.csv")).columns == ["id", "v"]


def test_read_documents(spark, tmp_path):
    (tmp_path / "b.md").write_text("# B\ntext")
    (tmp_path / "a.txt").write_text("plain")
    d = readers.read_documents(spark, str(tmp_path)).orderBy("kind", "source").collect()
    assert [(r["source"], r["kind"]) for r in d] == [("b", 0), ("a", 1)]


def test_sample_exact_size(spark):
    df = spark.range(1000)
    assert sampling.sample_exact(df, 0.1).count() == 100
    assert sampling.sample_fraction(df, 2.0).count() == 1000


def test_fingerprint_order_insensitive(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "a long, b string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "a long, b string").repartition(3)
    assert a.transform(sampling.fingerprint).first() == b.transform(sampling.fingerprint).first()


def _schema(spark, types):
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(types.items())],
                                 "pos long, column string, semantic_type string")


def test_planner_skip_rules(spark):
    p = {r["tool"]: r["run"] for r in planner.build_plan(
        _schema(spark, {"a": "NUMERIC", "b": "CATEGORICAL", "c": "DATETIME"})).collect()}
    assert p["analyze_time_series"] and p["analyze_comparison"] and not p["analyze_sentiment"]
    assert not p["analyze_relationships"]


def test_chart_rules(spark):
    sch = _schema(spark, {"x": "NUMERIC", "y": "CURRENCY", "c": "CATEGORICAL", "d": "DATETIME"})
    r = {(row["x"], row["y"]): row["chart"] for row in charts.chart_rules(sch).collect()}
    assert r[("x", "y")] == "scatter" and r[("c", "x")] == "bar" and r[("d", "x")] == "line"
    assert r[("x", None)] == "histogram"


def test_findings_padded(spark):
    f = report.findings([], spark).collect()
    assert len(f) == 5 and all(r["text"] == report.PAD for r in f)


def test_parse_sections(spark):
    md = "intro\n## One\na\nb\n## Two\nc"
    df = spark.createDataFrame([("d", md)], "doc string, text string")
    s = {r["section"]: r["body"] for r in report.parse_sections(df, "doc", "text").collect()}
    assert s == {"One": "a\nb\n", "Two": "c\n"}


def test_report_bundle_has_every_row(spark):
    small, wide = spark.range(3).withColumnRenamed("id", "x"), spark.createDataFrame([("a", None)], "`p.q` string, r int")
    rows = sorted((r["name"], r["json"]) for r in report.report_bundle({"small": small, "wide": wide}).collect())
    assert rows == [("small", '{"x":0}'), ("small", '{"x":1}'), ("small", '{"x":2}'), ("wide", '{"p.q":"a"}')]


def test_analysis_status_comes_from_execution(small_df, monkeypatch):
    from pyspark.sql import functions as F

    from tablelens.plans import auto

    def late(a):  # fails when it runs, not when it is planned
        return a.table("cleaned").select(F.raise_error(F.lit("broken " + "x" * 400)).cast("int").alias("n"))

    for name, build in (("growth", late), ("chart_rules", lambda a: a.table("growth"))):
        monkeypatch.setitem(auto.STEPS, name, auto.Step(name, auto.STEPS[name].tool, build))
    a = auto.Analysis(small_df, freq="W")
    got = a.run()
    status = {r["step"]: r for r in a.status().collect()}
    assert status["growth"]["status"] == "error" and "x" * 400 in status["growth"]["message"]
    assert status["chart_rules"]["status"] == "skipped" and status["univariate_text"]["status"] == "not applicable"
    assert "growth" not in got and status["trend"]["status"] == "ok"
    for name, t in got.items():
        if name != "status":
            assert (status[name]["rows"], status[name]["columns"]) == (t.count(), len(t.columns)), name
    assert status["rolling_mean"]["rows"] == 2 * status["time_series"]["rows"] / 2
    assert {r["metric"] for r in got["trend"].collect()} == {"amount", "pieces"}
    assert status["trend"]["missing"] == 0 and status["bundle"]["rows"] > 100


def test_only_the_steps_that_are_needed_run(small_df):
    from tablelens.plans import auto
    a = auto.Analysis(small_df)
    assert a.table("missing").count() == len(small_df.columns)
    assert [r["step"] for r in a.status().collect()] == ["cleaned", "missing"]


def test_types_are_detected_once_and_the_bundle_runs_its_steps_at_once(small_df, monkeypatch):
    import threading

    from tablelens.operators import schema
    from tablelens.plans import auto
    calls, threads, detect, run = [], set(), schema.detect_schema, auto.Analysis._run
    monkeypatch.setattr(schema, "detect_schema", lambda *a: calls.append(1) or detect(*a))
    monkeypatch.setattr(auto.Analysis, "_run", lambda self, s: threads.add(threading.get_ident()) or run(self, s))
    a = auto.Analysis(small_df, freq="W")
    assert a.table("bundle").count() > 100
    assert len(calls) == 2 and len(threads) > 2  # the frame and the cleaned frame; the caller's thread and others


def test_written_sections(small_df, spark):
    from tablelens.plans import auto
    a = auto.Analysis(small_df, freq="W")
    lines = a.table("insights").collect()
    assert list(dict.fromkeys(r["section"] for r in lines)) == report.SECTIONS
    parsed = report.parse_sections(a.table("report_text"), "doc", "text").collect()
    assert [r["section"] for r in sorted(parsed, key=lambda r: r["pos"])] == report.SECTIONS
    empty = spark.createDataFrame([("a",), ("b",)], "c string")
    bare = auto.Analysis(empty)
    said = {(r["section"], r["text"]) for r in bare.table("insights").collect()}
    assert ("Trends", report.NOTHING["Trends"]) in said and ("Risks", report.NOTHING["Risks"]) in said


def test_quoted_fields_round_trip(spark, tmp_path):
    from tablelens.sources.readers import load_dataset
    from tablelens.sources.sinks import export_cleaned
    rows = [(1, 'he said "hi", ok', 5), (2, "two\nlines", 6), (3, "plain", 7)]
    path = export_cleaned(spark.createDataFrame(rows, "a int, b string, c int"), str(tmp_path), "quoted")
    assert sorted(tuple(r) for r in load_dataset(spark, path).collect()) == rows
