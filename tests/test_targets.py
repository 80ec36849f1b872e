from pyspark.sql import functions as F

from pagemill.functions import targets as T

COURSE, LONG = "Bachelor of Arts. ", "x " * 400


def verdicts(spark, rows, column):
    df = spark.createDataFrame(rows, "i int, class string, url string, title string, text string, anchor boolean, facts int")
    return [(r["v"]["outcome"], r["v"]["reason"], r["v"]["confidence"]) for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_courses(spark):
    c = F.col
    rows = [
        (1, "COURSE_PAGE", "u", "", None, True, 0), (2, "COURSE_PAGE", "u", "", " \n", True, 0), (3, "FUNDING_PAGE", "u", "", "text", True, 0),
        (4, "COURSE_PAGE", "u", "", COURSE + "Home students pay less. IELTS", True, 0), (5, "COURSE_PAGE", "u", "", "IELTS 6.5", True, 0), (6, "COURSE_PAGE", "u", "", "IELTS 6.5, full-time; modules", False, 0),
        (7, "COURSE_PAGE", "u", "MSc Physics", "nothing", True, 0), (8, "COURSE_PAGE", "u", "", COURSE, False, 3), (9, "COURSE_PAGE", "u", "", LONG + COURSE, False, 1), (10, "ADMISSIONS_PAGE", "u", "", COURSE + "IELTS", True, 0),
        (11, "OTHER", "u", "", COURSE, True, 0), (12, "COURSE_PAGE", "u", "", "Bachelor.\nEntry_requirements apply", False, 0), (13, "COURSE_PAGE", "u", "mastery embassy", "pteropod toeflike", True, 0),
    ]
    assert verdicts(spark, rows, T.course_target(c("class"), c("title"), c("text"), c("anchor"), c("facts"))) == [
        ("REJECTED", "no page text", 0.0), ("REJECTED", "no page text", 0.0), ("REJECTED", "scholarship page", 0.0), ("DISCOVERY_ONLY", "for residents only", 0.2),
        ("DISCOVERY_ONLY", "no course identity", 0.2), ("VALIDATED_TARGET", "requirements in the text", 0.9), ("VALIDATED_TARGET", "requirements behind an anchor", 0.7),
        ("DISCOVERY_ONLY", "no requirements", 0.4), ("DISCOVERY_ONLY", "no course identity", 0.2), ("DISCOVERY_ONLY", "general admissions page", 0.3), ("REJECTED", "irrelevant", 0.0),
        ("VALIDATED_TARGET", "requirements in the text", 0.9), ("DISCOVERY_ONLY", "no course identity", 0.2),
    ]
    everyone = T.course_target(c("class"), c("title"), c("text"), c("anchor"), c("facts"), all_audiences=True)
    assert verdicts(spark, rows[3:4], everyone) == [("VALIDATED_TARGET", "requirements in the text", 0.9)]


def test_scholarships(spark):
    c, u = F.col, "https://a.edu.au/scholarships/merit-award"
    twice = "A scholarship and one more scholarship."
    rows = [
        (1, "SCHOLARSHIP_PAGE", u, "Merit", f"{twice} Deadline: May.", False, 0), (2, "SCHOLARSHIP_PAGE", u, "Merit", twice, False, 0), (3, "SCHOLARSHIP_PAGE", u, "Merit", "One scholarship, deadline", False, 0),
        (4, "SCHOLARSHIP_PAGE", u, " General ", f"{twice} Deadline", False, 0), (5, "SCHOLARSHIP_PAGE", "https://a.edu.au/scholarships/equity.html", "Merit", f"{twice} Deadline", False, 0),
        (6, "COURSE_PAGE", u, "Merit", twice, False, 0), (7, "FUNDING_PAGE", u, "x", twice, False, 0), (8, "SCHOLARSHIP_PAGE", "https://a.edu.au/x", "x", f"{twice} Deadline", False, 0), (9, "UNKNOWN", u, "x", "y", False, 0),
    ]
    assert [v[:2] for v in verdicts(spark, rows, T.scholarship_target(c("class"), c("url"), c("title"), c("text")))] == [
        ("VALIDATED_TARGET", "scholarship in the text"), ("DISCOVERY_ONLY", "no substance"), ("DISCOVERY_ONLY", "too little about funding"), ("DISCOVERY_ONLY", "label of a category"),
        ("DISCOVERY_ONLY", "no scholarship: listing"), ("REJECTED", "course page"), ("DISCOVERY_ONLY", "scholarship listing"), ("DISCOVERY_ONLY", "too little about funding"), ("DISCOVERY_ONLY", "navigation page"),
    ]


def test_addresses_of_no_scholarship(spark):
    rows = [
        ("https://a.edu/s.pdf?x", "file, news or event"), ("https://a.edu/scholarship/apply", "login or search"), ("nonsense", "malformed"), ("https://b.org/scholarships/x", "external"), ("https://news.a.edu/s", "article"),
        ("https://a.edu/tag/x", "article"), ("https://a.edu/scholarship/fees", "fees"), ("https://a.edu/find-scholarship/any-year/", "listing"), ("https://a.edu/scholarships/applied-merit", None), (None, "malformed"),
    ]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r[0] == r[1] for r in df.select("want", T.no_scholarship(F.col("url"), F.lit("a.edu"))).collect())


def test_main_pages(spark):
    rows = [("a", "https://a.org/international/entry-requirements", False), ("a", "https://a.org/admissions", True), ("a", "https://a.org/entry-requirements/x", True), ("a", "https://a.org/entry-requirements", True), ("b", "https://b.org/", None), ("b", None, True)]
    got = {r["g"]: r["main_page"] for r in T.main_pages(spark.createDataFrame(rows, "g string, u string, w boolean"), "g", "u", "w").collect()}
    assert got == {"a": "https://a.org/entry-requirements", "b": "https://b.org/"}


def test_course_names(spark):
    from pagemill.functions import courses as C

    rows = [
        ("https://a.edu/courses/bsc-nursing-of-a-kind.html", None, True, "BSc Nursing of a Kind", "BSc Nursing of a Kind"), ("https://a.edu/course/723AA/6/2024.pdf", "x", True, "723AA", "723AA"),
        ("https://a.edu/course/2024/1", "Physics", False, "", "Physics"), ("https://a.edu/courses/master-physics", "Bachelor of Physics | a", True, "Master Physics", "Master Physics"),
        ("https://a.edu/courses/master-physics", "Physics (MSc) 2025/26 - a", True, "Master Physics", "Physics (MSc)"), ("https://a.edu/programs/", "Programmes", False, "", ""),
        ("https://a.edu/courses/art?x=1", "Art", False, "ART", "Art"), ("https://a.edu/courses/yacht-design/admission-requirements", "Admission requirements for all", True, "Yacht Design", "Yacht Design"),
        ("https://a.edu/courses/withdrawal-form", "", False, "Withdrawal Form", "Withdrawal Form"), (None, None, False, "", ""),
    ]
    df = spark.createDataFrame(rows, "url string, title string, real boolean, by_url string, name string")
    for r in df.select("*", C.is_real_course(F.col("url")).alias("a"), C.name_from_url(F.col("url")).alias("b"), C.course_name(F.col("title"), F.col("url")).alias("c")).collect():
        assert (r["a"], r["b"], r["c"]) == (r["real"], r["by_url"], r["name"]), r["url"]


def test_links_are_admitted_step_by_step(spark):
    from pagemill.functions import admission as A

    rows = [
        (1, "https://a.edu/courses/x", "COURSE_PAGE", "SKIP", 5, True), (2, "https://A.edu/courses/x/#y", "COURSE_PAGE", "SKIP", 5, True), (3, "https://a.edu/2023/z", "UNKNOWN", "EXTRACT", 5, True),
        (4, "https://a.edu/2024/z", "UNKNOWN", "EXTRACT", 5, True), (5, "https://a.edu/about", "UNKNOWN", "SKIP", 2, True), (6, "https://a.edu/about2", "UNKNOWN", "SKIP", 1, True), (7, "https://a.edu/faculty/of/arts", None, None, None, True),
        (8, "https://a.edu/courses/y", "COURSE_PAGE", "EXTRACT", 1, False), (9, "nonsense", "UNKNOWN", "SKIP", 9, True), (10, None, None, None, None, True),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, class string, disposition string, depth int, allowed boolean")
    got = {r["page_id"]: r["step"] for r in A.admitted_links(df).collect()}
    assert [got[i] for i in range(1, 11)] == ["queued", "duplicate", "older_edition", "queued", "out_of_scope", "queued", "queued", "class", "out_of_scope", "out_of_scope"]
    everything = {r["page_id"]: r["step"] for r in A.admitted_links(df, by_catalogue=False).collect()}
    assert everything[5] == everything[9] == "queued"


def test_fetches_and_candidates(spark):
    from pagemill.functions import admission as A

    rows = [(False, 200, False, 900, "network"), (None, 200, False, 900, "network"), (True, 503, True, 900, "challenge"), (True, 429, False, 0, "blocked"), (True, 404, False, 0, None), (True, 200, None, 399, "thin"), (True, 301, False, 400, None)]
    df = spark.createDataFrame(rows, "r boolean, s int, c boolean, n int, want string")
    assert all(r[0] == r[1] for r in df.select("want", A.fast_enough(F.col("r"), F.col("s"), F.col("c"), F.col("n"))).collect())
    found = spark.createDataFrame([("https://a.org/p/AIG.html?x#y",), ("https://a.org/p/AIG/",)], "u string").select(A.requirement_candidates(F.col("u"))).collect()
    assert [len(r[0]) for r in found] == [39, 26] and found[0][0][:3] == [f"https://a.org/p/AIG/admission-requirements{x}" for x in (".html", "", "/")]
    live = spark.createDataFrame([(200, "https://a.org/entry"), (200, "https://a.org/"), (404, "https://a.org/entry"), (None, None)], "s int, u string")
    assert [r[0] for r in live.select(A.still_there(F.col("s"), F.col("u"))).collect()] == [True, False, False, False]
