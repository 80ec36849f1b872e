from pyspark.sql import functions as F

from pagemill.sources import seeds, sheets, sinks


def test_workbook_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & <b>", ["x", "y"]), (2, None, [])], "id long, name string, tags array<string>")
    data = sinks.workbook({"Summary": df, "Rest": df.limit(1)})
    assert sheets.looks_like_xlsx(data[:4])
    (tmp_path / "x.xlsx").write_bytes(data)
    rows = [r["cells"] for r in sheets.read_xlsx(spark, str(tmp_path / "x.xlsx")).orderBy("row").collect()]
    assert rows == [["id", "name", "tags"], ["1", "a & <b>", "x; y"], ["2", "", ""]]
    assert sheets.read_xlsx(spark, str(tmp_path / "x.xlsx"), "Rest").count() == 2
    assert list(sheets.read_sheet(data, "none")) == []


def test_quoted_csv_bytes(spark, tmp_path):
    sinks.write_quoted_csv(spark.createDataFrame([('a "q"', 1)], "t string, n long").coalesce(1), str(tmp_path / "o"))
    assert next((tmp_path / "o").glob("*.csv")).read_bytes() == b'"t","n"\r\n"a ""q""","1"\r\n'


def test_seed_file(spark, tmp_path):
    (tmp_path / "s.csv").write_text('Uni,Web-site,Remarks\n"A\nB",a.org,"x ""y"""\n,b.org,\nC,,\n')
    good, bad = seeds.read_seeds(spark, str(tmp_path / "s.csv"))
    assert [tuple(r) for r in good.select("name", "base_url", "notes").collect()] == [("A\nB", "https://a.org", 'x "y"')]
    assert sorted(r["fault"] for r in bad.collect()) == ["no address", "no name"]


def test_names_without_headers(spark):
    df = spark.createDataFrame([("12", "University of Somewhere", "http://a.org"), ("13", "College B", "http://b.org")], "c1 string, c2 string, link string")
    assert sorted(r["name"] for r in seeds.with_roles(df).collect()) == ["College B", "University of Somewhere"]


def test_robots(spark):
    files = spark.createDataFrame([("h", "User-agent: x\nDisallow: /\nUser-agent: *\nUser-agent: y\nDisallow: /a/*.pdf$\nAllow: /a/b\nDisallow: /a\n")], "host string, text string")
    rules = seeds.robots_rules(files)
    assert rules.count() == 3
    paths = spark.createDataFrame([("h", "/a/x.pdf"), ("h", "/a/b/x"), ("h", "/z"), ("g", "/a")], "host string, path string")
    assert {(r["host"], r["path"]): r["allowed"] for r in seeds.robots_decisions(paths, rules).collect()} == {
        ("h", "/a/x.pdf"): False, ("h", "/a/b/x"): True, ("h", "/z"): True, ("g", "/a"): True,
    }


def test_state_and_logs(spark, tmp_path):
    assert seeds.read_state(spark, str(tmp_path / "none.json"), "k string, n int").count() == 0
    (tmp_path / "s.json").write_text('{"k": "a", "n": 1}\nbroken\n')
    assert [tuple(r) for r in seeds.read_state(spark, str(tmp_path / "s.json"), "k string, n int").collect()] == [("a", 1)]
    lines = spark.createDataFrame([("An ERROR",), ("fine",)], "value string")
    assert [tuple(r) for r in seeds.log_counts(lines, ["error", "warn"]).collect()] == [("error", 1)]


def test_report_and_audit(spark):
    df = spark.createDataFrame([("g", "b"), ("g", "a")], "g string, v string")
    assert [r["value"] for r in sinks.markdown_lines(df, "g", F.col("v")).collect()] == ["## g (2)", "- a", "- b"]
    assert sinks.audit({"rows": df}).first()["audit"] == '{"rows":2}'


def test_a_file_is_searched_once_not_once_a_location(spark, capsys):
    loc = "<url><loc> https://a.org/%d </loc></url>"
    files = spark.createDataFrame([("a", "".join(loc % i for i in range(3))), ("b", "<sitemapindex><loc>c</loc>"), ("n", None)], "file string, text string")
    found = seeds.sitemap_locations(files.repartition(2))
    assert sorted(map(tuple, found.collect())) == [*(("a", f"https://a.org/{i}", False) for i in range(3)), ("b", "c", True)]
    found.explain()
    plan = capsys.readouterr().out
    assert "Generate" in plan and plan.index("Generate explode") < plan.index("Contains(")
