from pyspark.sql import functions as F

from pagemill.functions import coverage as C


def test_pages_that_answer_though_gone(spark):
    rows = [
        ("https://a.org/b/c", "https://a.org/", 200, "fine", True), ("https://a.org/b/c/d", "https://a.org/x", 200, "fine", True), ("https://a.org/b", "https://a.org/", 200, "fine", False),
        ("https://a.org/b/c", "https://a.org/b/c", 200, "<title>Page Not Found</title>", True), ("https://a.org/b/c", "https://a.org/b/c", 200, "<script>page not found</script>ok", False),
        ("https://a.org/b", "https://a.org/b", 200, "x" * 5000 + "page not found", False), ("https://a.org/b/c", "https://a.org/", 404, "page not found", False), ("nonsense", None, 200, None, False), ("https://a.org/b/c", "https://a.org/", None, "", False),
    ]
    df = spark.createDataFrame(rows, "u string, f string, s int, h string, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", C.soft_not_found(F.col("u"), F.col("f"), F.col("s"), F.col("h"))).collect())
    states = spark.createDataFrame([(None, True), (403, True), (410, False), (200, True), (200, False)], "s int, soft boolean").select(C.link_status(F.col("s"), F.col("soft"))).collect()
    assert [r[0] for r in states] == [None, "BLOCKED", "BROKEN_LINK", "BROKEN_LINK", None]


def test_rungs_of_coverage(spark):
    courses = [(1, "a", "https://a.org/p.html", "QUEUED", 404), (2, "a", "https://a.org/p.html", "QUEUED", 200), (3, "a", "https://a.org/Q", "VALID_COURSE_PAGE", None), (4, "a", "https://a.org/r", "QUEUED", None), (5, "b", "https://b.org/r", None, None), (6, "b", "https://b.org/entry-requirements", None, None)]
    working = [("a", "https://a.org/p/entry/?q"), ("a", "https://A.org/p/admissions"), ("a", "https://a.org/Q/none"), ("b", None), ("b", "https://a.org/r/entry")]
    shared = [("a", "https://a.org/z", 3.0), ("a", "https://a.org/y", 3.0), ("a", "https://a.org/x", None), ("b", None, 9.0)]
    got = C.ladder(
        spark.createDataFrame(courses, "link_id long, site string, url string, status string, http_status int"), spark.createDataFrame(working, "site string, url string"), spark.createDataFrame(shared, "site string, url string, score double")
    )
    assert {r["link_id"]: (r["status"], r["requirements_url"], r["confidence"]) for r in got.collect()} == {
        1: ("NOT_FOUND", "", 0.3), 2: ("FOUND", "https://A.org/p/admissions", 0.97), 3: ("FOUND", "https://a.org/Q", 0.9), 4: ("SHARED", "https://a.org/y", 0.7), 5: ("NEEDS_REVIEW", "", 0.3),
        6: ("FOUND", "https://b.org/entry-requirements", 0.9),
    }


def test_when_to_look_deeper(spark):
    rows = [(True, 0, 3, 5, 0, None, True), (False, 0, 3, 5, 0, None, False), (True, 3, 3, 5, 0, None, False), (True, 0, 3, 20, 1, 10, False), (True, 0, 3, 20, 1, 1001, True), (True, 0, 3, 800, 50, 0, True), (True, 0, 3, 30, 5, 0, False), (True, 0, 3, 0, 4, 5000, False)]
    df = spark.createDataFrame(rows, "e boolean, p int, m int, s int, v int, l int, want boolean")
    assert all(r[0] == r[1] for r in df.select("want", C.look_deeper(*map(F.col, "epmsvl"))).collect())
