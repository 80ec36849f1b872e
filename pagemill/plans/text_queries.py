"""Queries over texts: word lists, fields, sentences, fingerprints, classes, link scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import classify as C
from pagemill.functions import text as X
from pagemill.functions import urls
from pagemill.plans import sqltext as S

VOCABULARY = {"common": ("the", "of the", "that"), "french": ("les", "des", "une"), "legal": ("license", "licensed under", "copyright")}
#: Host texts have few admission fields, so the rules read each whole text behind a line built from the document's number.
LINE = (
    "concat('Minimum ', 50 + doc_id % 50, '% and GPA ', 1 + doc_id % 4, '.', doc_id % 10, '. ', if(doc_id % 3 = 0, 'IELTS 6.5 and TOEFL 90. ', ''),"
    " if(doc_id % 4 = 0, 'Mathematics and Physics are required. ', ''), if(doc_id % 5 = 0, 'The SAT is taken. ', ''),"
    " if(doc_id % 7 = 0, 'Bachelor of Science. ', ''), coalesce(text, ''))"
)
SQL_LINE = (
    "'Minimum ' || (50 + doc_id % 50) || '% and GPA ' || (1 + doc_id % 4) || '.' || (doc_id % 10) || '. ' || case when doc_id % 3 = 0 then 'IELTS 6.5 and TOEFL 90. ' else '' end ||"
    " case when doc_id % 4 = 0 then 'Mathematics and Physics are required. ' else '' end || case when doc_id % 5 = 0 then 'The SAT is taken. ' else '' end ||"
    " case when doc_id % 7 = 0 then 'Bachelor of Science. ' else '' end || coalesce(text, '')"
)


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.expr(LINE).alias("line"))


def g1_keyword_flags(spark, sf_dir):
    """One flag a vocabulary."""
    return _t(spark, sf_dir, "documents").select("doc_id", *[X.has_any(F.col("text"), w).alias(k) for k, w in VOCABULARY.items()])


def g2_course_key(spark, sf_dir):
    """G2 G3."""
    return _t(spark, sf_dir, "part").select("p_partkey", X.name_key(F.concat_ws(" - ", "p_name", "p_brand")).alias("name_key"))


def g8_field_extract(spark, sf_dir):
    """G7 to G13."""
    t = F.col("line")
    return _lines(spark, sf_dir).select(
        "doc_id", X.minimum_marks(t).alias("marks"), X.gpa(t).alias("gpa"), F.array_join(X.subjects(t), ",").alias("subjects"),
        X.entrance_exam(t).alias("exam"), X.english_requirement(t).alias("english"), X.degree_level(t).alias("level"),
    )


def g14_best_sentence(spark, sf_dir):
    """G14 G17."""
    t = F.col("line")
    return _lines(spark, sf_dir).select("doc_id", X.best_sentence(t).alias("best"), X.snippet_around(t, "GPA", 10, 20).alias("snippet"))


def g15_eligibility_fields(spark, sf_dir):
    """Evidence by field, and 25 points for each that is there."""
    t = F.col("line")
    fields = {"academic": ("minimum", "gpa"), "english": ("ielts", "toefl"), "subjects": ("mathematics", "physics"), "exams": ("sat",)}
    found = {k: X.evidence_sentences(t, w) for k, w in fields.items()}
    points = sum((F.when(v.isNotNull(), 25).otherwise(0) for v in found.values()), F.lit(0))
    return _lines(spark, sf_dir).select("doc_id", *[v.alias(k) for k, v in found.items()], points.alias("points"))


def g22_html_text(spark, sf_dir):
    """Title, links and length of the text of a page."""
    h = F.col("html")
    return _t(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract(h, "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count(h, F.lit("<a href=")).cast("long").alias("n_links"),
        F.length(X.html_text(h)).cast("long").alias("text_length"),
    )


def c1_classify_url(spark, sf_dir):
    """Class and reason of a URL by ordered rules, and what each purpose may read."""
    u = F.col("url")
    rows = _t(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.element_at(F.array(*map(F.lit, C.SAMPLE_TAILS)), (F.col("page_id") % len(C.SAMPLE_TAILS) + 1).cast("int"))).alias("sample"))
    seen = C.page_class(F.col("sample"))
    rows = rows.select("page_id", "sample", seen["page_class"].alias("page_class"), seen["reason"].alias("reason"))
    return rows.withColumn("eligibility_allowed", F.col("page_class").isin(*C.ALLOWED["ELIGIBILITY"])).withColumn("scholarship_allowed", F.col("page_class").isin(*C.ALLOWED["SCHOLARSHIP"]))


def c3_link_score(spark, sf_dir):
    """Additive score of a link and what to do with it."""
    tail = F.element_at(F.array(*map(F.lit, C.SAMPLE_TAILS)), (F.col("page_id") % len(C.SAMPLE_TAILS) + 1).cast("int"))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", r"[?#].*$", ""), tail).alias("sample"))
    score = C.link_score(F.col("sample"))
    return rows.select("page_id", score.alias("score"), C.disposition(score).alias("disposition"))


def c7_page_status(spark, sf_dir):
    """Status of a fetched page by ordered rules on its text."""
    text = X.html_text(F.col("html"))
    rows = _t(spark, sf_dir, "pages").select("page_id", F.length(text).alias("n"), text.alias("t"))
    return rows.select("page_id", C.page_status(F.col("t"), F.col("n")).alias("status"))


def c10_validity_tally(spark, sf_dir):
    """A status code made from each event, its verdict, counted."""
    code = F.when(F.col("event_type") == "error", 500).when(F.col("event_id") % 17 == 0, 404).when(F.col("event_id") % 13 == 0, 301).otherwise(200)
    rows = _t(spark, sf_dir, "events").select(C.verdict(code).alias("verdict"))
    return rows.groupBy("verdict").agg(F.count("*").alias("n"))


def c13_review_status(spark, sf_dir):
    """Duplicate before missing evidence before doubt before confidence."""
    dup = F.row_number().over(Window.partitionBy("text").orderBy("doc_id")) > 1
    rows = _t(spark, sf_dir, "documents").join(_t(spark, sf_dir, "labels"), "doc_id", "left").withColumn("dup", dup)
    status = F.when(F.col("dup"), "DUPLICATE").when(F.col("quality").isNull(), "NEEDS_EVIDENCE").when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "APPROVED").otherwise("PENDING_REVIEW")
    return rows.groupBy(status.alias("review_status")).agg(F.count("*").alias("n"))


def c16_candidate_filter(spark, sf_dir):
    """Chunks with a signal are candidates with a hint of 0.2 to 1; the share that the filter keeps away."""
    rows = _t(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("chunk")).filter("trim(chunk) != ''")
    course, criteria = X.has_any(F.col("chunk"), ("licensed", "released")), X.has_any(F.col("chunk"), ("license", "the"))
    hint = F.least(F.lit(1.0), F.lit(0.2) + F.when(course, 0.3).otherwise(0.0) + F.when(criteria, 0.3).otherwise(0.0))
    rows = rows.withColumn("candidate", course | criteria).withColumn("hint", F.round(hint, 2))
    return rows.groupBy("source").agg(F.count("*").alias("chunks"), F.count_if("candidate").alias("candidates"), F.max(F.when(F.col("candidate"), F.col("hint"))).alias("best_hint")).withColumn(
        "filter_rate", F.round(1 - F.col("candidates") / F.nullif(F.col("chunks"), F.lit(0)), 6)
    )


def c18_ordinal(spark, sf_dir):
    """Rank points of orders, summed and cut to a confidence."""
    o = _t(spark, sf_dir, "orders")
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    score = rank * 10 + F.when(F.col("o_totalprice") > 150000, 3).otherwise(0) + F.when(F.col("o_orderpriority").like("1-%"), 2).otherwise(0)
    return o.select("o_orderkey", score.alias("score"), F.least(F.lit(85), F.lit(70) + F.floor(score / 12)).cast("long").alias("confidence"))


def d8_fingerprints(spark, sf_dir):
    """Content hash of the squeezed lower-case ASCII text and hash of its sentences with a signal."""
    t = F.regexp_replace(F.col("text"), r"[^\x21-\x7E]+", " ")
    words = F.concat_ws("|", F.filter(F.split("text", r"\n"), lambda s: s.rlike("(?i)licen[sc]ed?")))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(t, 256).alias("content_hash"), F.substring(F.sha2(words, 256), 1, 32).alias("evidence_hash"))


def d6_embedded_values(spark, sf_dir):
    """Keys and values of the events' JSON, counted by key."""
    rows = _t(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))


def e2_rule_records(spark, sf_dir):
    """A record for each line with a course or criteria, its URL always its source's."""
    t = F.col("line")
    rows = _lines(spark, sf_dir)
    course = F.nullif(F.regexp_extract(t, r"Bachelor of [A-Z][A-Za-z]+", 0), F.lit(""))
    marks, gpa, subj, exam, english = X.minimum_marks(t), X.gpa(t), X.subjects(t), X.entrance_exam(t), X.english_requirement(t)
    sure = X.confidence([marks.isNotNull() | gpa.isNotNull(), F.size(subj) > 0, exam.isNotNull(), english.isNotNull(), course.isNotNull()])
    keep = rows.filter(course.isNotNull() | X.has_any(t, X.CRITERIA))
    return keep.select("doc_id", F.coalesce(course, F.lit("Unknown Course")).alias("course"), F.coalesce(marks, gpa).alias("minimum_marks"), sure.alias("confidence"), F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("criteria_url"))


QUERIES = {
    f.__name__: f
    for f in (
        g1_keyword_flags, g2_course_key, g8_field_extract, g14_best_sentence, g15_eligibility_fields, g22_html_text, c1_classify_url, c3_link_score,
        c7_page_status, c10_validity_tally, c13_review_status, c16_candidate_filter, c18_ordinal, d6_embedded_values, d8_fingerprints, e2_rule_records,
    )
}


def _re(words) -> str:
    found = "|".join(sorted({w.strip().lower() for w in words}, key=lambda w: (-len(w), w))).replace(".", r"\.")
    return f"(?i)(^|[^A-Za-z0-9_])({found})([^A-Za-z0-9_]|$)"


def _any(col: str, words) -> str:
    return f"regexp_matches({col}, '{_re(words)}')"


_FIELDS = {"academic": ("minimum", "gpa"), "english": ("ielts", "toefl"), "subjects": ("mathematics", "physics"), "exams": ("sat",)}
_SENT = r"list_filter(string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0)"
_HTML = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?s)<[^>]*>', ' ', 'g'), '[\s\x{00A0}]+', ' ', 'g'), '^ | $', '', 'g')"""
_TAILS = "[" + S.quoted(C.SAMPLE_TAILS) + "]"
_SAMPLE = f"(select page_id, regexp_replace(url, '[?#].*$', '') || {_TAILS}[page_id % {len(C.SAMPLE_TAILS)} + 1] as sample from pages)"
_L = f"(select doc_id, {SQL_LINE} as line from documents)"
SQL = {
    "g1_keyword_flags": "select doc_id, " + ", ".join(f"{_any('text', w)} as {k}" for k, w in VOCABULARY.items()) + " from documents",
    "g2_course_key": r"""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' - ' || p_brand), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) as name_key from part""",
    "g8_field_extract": rf"""select doc_id, nullif(regexp_extract(line, '(?i)(\d\d\d?)\s*%', 1), '') || '%' as marks,
        'GPA ' || nullif(regexp_extract(line, '(?i)GPA[^0-9]{{0,8}}(\d(\.\d\d?)?)', 1), '') as gpa,
        array_to_string(list_filter([{S.quoted(X.SUBJECTS)}], lambda s: regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])' || s || '([^A-Za-z0-9_]|$)')), ',') as subjects,
        list_filter([{S.quoted(X.EXAMS)}], lambda s: regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])' || s || '([^A-Za-z0-9_]|$)'))[1] as exam,
        nullif(concat_ws(', ', 'IELTS ' || nullif(regexp_extract(line, '(?i)IELTS[^0-9]{{0,8}}(\d(\.\d)?)', 1), ''), 'TOEFL ' || nullif(regexp_extract(line, '(?i)TOEFL[^0-9]{{0,12}}(\d\d\d?)', 1), ''),
            'PTE ' || nullif(regexp_extract(line, '(?i)PTE[^0-9]{{0,8}}(\d\d\d?)', 1), ''), 'Duolingo ' || nullif(regexp_extract(line, '(?i)Duolingo[^0-9]{{0,8}}(\d\d\d?)', 1), '')), '') as english,
        case when {_any('line', ('diploma',))} then 'Diploma' when {_any('line', X.COURSES)} then 'Bachelor' else 'Other' end as level from {_L}""",
    "g14_best_sentence": rf"""select doc_id, trim(s.s)[1:500] as best, substr(line, greatest(pos - 10, 1), pos - greatest(pos - 10, 1) + 20) as snippet from (
        select doc_id, line, instr(line, 'GPA') as pos, list_max(list_transform({_SENT}, lambda s, i: {{'n': case when length(s) >= 25 then len(regexp_extract_all(s, '(?i)\d+%|GPA|IELTS|TOEFL|grade|minimum|require')) else -1 end, 'i': -i, 's': s}})) as s from {_L})""",
    "g15_eligibility_fields": "select *, "
    + " + ".join(f"case when {k} is not null then 25 else 0 end" for k in _FIELDS)
    + " as points from (select doc_id, "
    + ", ".join(f"nullif(array_to_string(list_slice(list_filter({_SENT}, lambda s: {_any('s', w)}), 1, 3), ' | '), '') as {k}" for k, w in _FIELDS.items())
    + f" from {_L})",
    "g22_html_text": f"""select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, (length(html) - length(replace(html, '<a href=', ''))) // 8 as n_links,
        length({_HTML}) as text_length from pages""",
    "c1_classify_url": C.sql_page_class(_SAMPLE),
    "c3_link_score": C.sql_link_score(_SAMPLE),
    "c7_page_status": f"select page_id, {C.sql_page_status('t')} as status from (select page_id, {_HTML} as t from pages)",
    "c10_validity_tally": f"""select {C.SQL_VERDICT} as verdict, count(*) as n from (select case when event_type = 'error' then 500 when event_id % 17 = 0 then 404
        when event_id % 13 = 0 then 301 else 200 end as code from events) group by 1""",
    "c13_review_status": """select case when dup then 'DUPLICATE' when quality is null then 'NEEDS_EVIDENCE' when toxic = 1 then 'REJECTED' when quality = 1 then 'APPROVED'
        else 'PENDING_REVIEW' end as review_status, count(*) as n from (select *, row_number() over (partition by text order by doc_id) > 1 as dup
        from documents left join labels using (doc_id)) group by 1""",
    "c16_candidate_filter": f"""select source, count(*) as chunks, count(*) filter (where a or b) as candidates,
        max(round(least(1.0, 0.2 + case when a then 0.3 else 0 end + case when b then 0.3 else 0 end), 2)) filter (where a or b)::double as best_hint,
        round(1 - count(*) filter (where a or b) / count(*)::double, 6) as filter_rate from (
        select source, {_any('chunk', ('licensed', 'released'))} as a, {_any('chunk', ('license', 'the'))} as b
        from (select source, unnest(string_split(text, chr(10))) as chunk from documents) where trim(chunk) <> '') group by 1""",
    "c18_ordinal": """select o_orderkey, score, cast(least(85, 70 + floor(score / 12)) as bigint) as confidence from (select o_orderkey,
        case o_orderstatus when 'F' then 30 when 'P' then 20 else 10 end + case when o_totalprice > 150000 then 3 else 0 end
        + case when o_orderpriority like '1-%' then 2 else 0 end as score from orders)""",
    "d6_embedded_values": """select key, count(*) as n, count(distinct value) as n_values from (select unnest(json_keys(props)) as key, props from events),
        lateral (select json_extract_string(props, '$."' || key || '"') as value) group by 1""",
    "d8_fingerprints": r"""select doc_id, sha256(regexp_replace(text, '[^\x21-\x7E]+', ' ', 'g')) as content_hash,
        substr(sha256(array_to_string(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '(?i)licen[sc]ed?')), '|')), 1, 32) as evidence_hash from documents""",
    "e2_rule_records": rf"""select doc_id, coalesce(course, 'Unknown Course') as course, coalesce(marks, gpa) as minimum_marks,
        round(least(0.75, 0.5 + 0.1 * ((marks is not null or gpa is not null)::int + subj::int + exam::int + english::int + (course is not null)::int)), 2)::double as confidence,
        'doc://' || doc_id as criteria_url from (select doc_id, line, nullif(regexp_extract(line, 'Bachelor of [A-Z][A-Za-z]+', 0), '') as course,
        nullif(regexp_extract(line, '(?i)(\d\d\d?)\s*%', 1), '') || '%' as marks, 'GPA ' || nullif(regexp_extract(line, '(?i)GPA[^0-9]{{0,8}}(\d(\.\d\d?)?)', 1), '') as gpa,
        {_any('line', X.SUBJECTS)} as subj, {_any('line', X.EXAMS)} as exam, regexp_matches(line, '(?i)IELTS[^0-9]{{0,8}}\d|TOEFL[^0-9]{{0,12}}\d\d|PTE[^0-9]{{0,8}}\d\d|Duolingo[^0-9]{{0,8}}\d\d') as english
        from {_L}) where course is not null or {_any('line', X.CRITERIA)}""",
}
