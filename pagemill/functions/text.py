"""Text functions as column expressions: normal forms, keyword patterns, fields of entry requirements, evidence sentences."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabularies and patterns of the field rules.
SUBJECTS = ("Mathematics", "Calculus", "Physics", "Chemistry", "Biology", "English", "Economics", "Accounting", "Statistics", "Computer Science")
EXAMS = ("SAT", "ACT", "UCAT", "BMAT", "JEE", "NEET", "entrance exam", "entrance test")
CRITERIA = (
    "must", "minimum", "required", "eligibility", "eligible", "entry requirement", "admission requirement", "academic requirement", "grade",
    "percentage", "marks", "gpa", "grade 12", "a-level", "ib", "sat", "act", "ielts", "toefl", "pte", "duolingo", "cambridge english",
    "c1 advanced", "c2 proficiency", "cae", "cpe", "mathematics", "physics", "chemistry", "biology", "english",
)
COURSES = ("Bachelor of", "BSc", "B.Sc", "BEng", "B.Eng", "BTech", "B.Tech", "BBA", "LLB", "MBBS", "Major in", "Program in", "Programme in", "Degree in")
SIGNAL = r"(?i)\d+%|GPA|IELTS|TOEFL|grade|minimum|require"
TESTS = (("IELTS", r"(?i)IELTS[^0-9]{0,8}(\d(?:\.\d)?)"), ("TOEFL", r"(?i)TOEFL[^0-9]{0,12}(\d{2,3})"), ("PTE", r"(?i)PTE[^0-9]{0,8}(\d{2,3})"), ("Duolingo", r"(?i)Duolingo[^0-9]{0,8}(\d{2,3})"))

BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
MARKS = rf"(?i)(\d{{2,3}})\s*(?:%|percent{AFTER})"
GPA = rf"(?i){BEFORE}GPA{AFTER}[^0-9]{{0,8}}(\d(?:\.\d{{1,2}})?)|(\d(?:\.\d{{1,2}})?)\s*GPA{AFTER}"


def keyword_pattern(words, guarded: bool = True, loose: bool = False) -> str:
    """An alternation of plain words, longest first, that doesn't match inside longer ASCII words; none never match.

    loose: the words of a phrase may also be joined by a hyphen, an underscore or nothing, as in addresses and ids.
    """
    found = "|".join(re.escape(w).replace(r"\ ", r"[\s_-]?" if loose else " ") for w in sorted({w.strip().lower() for w in words if w.strip()}, key=lambda w: (-len(w), w)))
    return f"(?i){BEFORE}(?:{found}){AFTER}" if found and guarded else f"(?i)(?:{found})" if found else r"(?!)"


def has_any(text: Column, words) -> Column:
    return text.rlike(keyword_pattern(words))


def squeeze(text: Column) -> Column:
    """White space made single and trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"[\s ]+", " "), "^ | $", "")


def name_key(name: Column) -> Column:
    """Lower-case letters and digits of a name, single spaces between."""
    return squeeze(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "))


def titleized(slug: Column) -> Column:
    return F.initcap(F.regexp_replace(slug, "[-_]+", " "))


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def mentions(text: Column, *words: str) -> Column:
    """Whether a text has any of some lower-case ASCII words, in any case and place: a plain search, for patterns that cost more."""
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in words])


def minimum_marks(text: Column) -> Column:
    return F.when(mentions(text, "%", "percent"), F.concat(_group(text, MARKS), F.lit("%")))


def gpa(text: Column) -> Column:
    return F.when(mentions(text, "gpa"), F.concat(F.lit("GPA "), F.coalesce(_group(text, GPA), _group(text, GPA, 2))))


def subjects(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(mentions(text, s.lower()) & text.rlike(f"(?i){BEFORE}{s}{AFTER}"), F.lit(s)) for s in SUBJECTS]))


def entrance_exam(text: Column) -> Column:
    return F.coalesce(*[F.when(mentions(text, e.lower()) & text.rlike(f"(?i){BEFORE}{e}{AFTER}"), F.lit(e)) for e in EXAMS])


def english_requirement(text: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.when(mentions(text, n.lower()), F.concat(F.lit(f"{n} "), _group(text, p))) for n, p in TESTS]), F.lit(""))


def degree_level(text: Column) -> Column:
    return F.when(mentions(text, "diploma") & text.rlike(f"(?i){BEFORE}diploma{AFTER}"), "Diploma").when(
        mentions(text, *[w.lower() for w in COURSES]) & has_any(text, COURSES), "Bachelor"
    ).otherwise("Other")


def confidence(fields: list[Column]) -> Column:
    """0.5 and 0.1 for each field that is there, 0.75 at most."""
    return F.round(F.least(F.lit(0.75), F.lit(0.5) + sum((F.when(f, 0.1).otherwise(0.0) for f in fields), F.lit(0.0))), 2)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.length(F.trim(s)) > 0)


def best_sentence(text: Column) -> Column:
    """The sentence of 25 characters or more with the most signals, the first of equals, 500 characters at most."""
    scored = F.transform(sentences(text), lambda s, i: F.struct(F.when(F.length(s) >= 25, F.regexp_count(s, F.lit(SIGNAL))).otherwise(F.lit(-1)).alias("n"), (-i).alias("i"), s.alias("s")))
    return F.substring(F.trim(F.array_max(scored)["s"]), 1, 500)


def snippet_around(text: Column, pattern: str, before: int = 50, after: int = 90) -> Column:
    """The first match with what stands round it; null without a match."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at - start + after))


def evidence_sentences(text: Column, words, most: int = 3) -> Column:
    """The first sentences that speak of any of the words, as one string; null for none."""
    found = F.slice(F.filter(sentences(text), lambda s: s.rlike(keyword_pattern(words))), 1, most)
    return F.nullif(F.array_join(found, " | "), F.lit(""))


def html_text(page: Column) -> Column:
    bare = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", " ")
    return squeeze(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def bigrams(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.when(F.length(plain) > 1, F.transform(F.sequence(F.lit(1), F.length(plain) - 1), lambda i: F.substr(plain, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


# The pattern of A-level grades, of a course's name in a heading, and of the part of a text that names it.
A_LEVELS = r"(?i)A[- ]?levels?[^A-E]{0,12}([A-E]{2,4}\*?)"
COURSE_NAME = rf"(?i){BEFORE}(Bachelor of|B\.?Sc|B\.?A{AFTER}|B\.?Eng|B\.?Tech|B\.?E{AFTER}|BBA|LLB|MBBS|Major in|Programme? in|Degree in)"
COURSE_HINT = rf"{BEFORE}(Bachelor of [A-Z][\w &]+|B\.?Sc\.?[\w. ]*|B\.?A\.?[\w. ]*|B\.?Tech[\w. ]*|BBA|LLB|MBBS)"


def a_levels(text: Column) -> Column:
    return F.concat(F.lit("A-levels "), _group(text, A_LEVELS))


def course_hint(text: Column, heading: Column) -> Column:
    """The heading where it names a course, else the first course that the text names; null for none."""
    return F.when(heading.rlike(COURSE_NAME), F.trim(heading)).otherwise(F.trim(_group(text, COURSE_HINT)))
