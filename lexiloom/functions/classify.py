"""Classifiers as ordered rules over substrings, built from the tables of ``rules``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from . import rules, text as T


def has_any(blob: Column, words: Sequence[str]) -> Column:
    return reduce(or_, (blob.contains(w) for w in words)) if words else F.lit(False)


def first_match(cases: Sequence[tuple[Column, str | Column]], default: str | Column) -> Column:
    """The value of the first case that holds. A condition that is null does not hold."""
    out = None
    for condition, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    default = F.lit(default) if isinstance(default, str) else default
    return default if out is None else out.otherwise(default)


def by_table(blob: Column, table: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first category of the table that has a word in ``blob``. Any vocabulary will do."""
    return first_match([(has_any(blob, words), name) for name, words in table.items()], default)


def tags(blob: Column, *tables: Mapping[str, Sequence[str]]) -> Column:
    """All tags whose words occur, in table order."""
    named = [F.when(has_any(blob, words), F.lit(tag)) for table in tables for tag, words in table.items()]
    return F.array_distinct(F.filter(F.array(*named), lambda t: t.isNotNull()))


def _blob(*parts: Column | str) -> Column:
    return F.lower(F.concat_ws(" ", *(F.coalesce(F.col(p) if isinstance(p, str) else p, F.lit("")) for p in parts)))


def modality(text: Column | str, url: Column | str | None = None) -> Column:
    return tags(_blob(*([] if url is None else [url]), text), rules.MODALITIES)


def program_tags(text: Column | str, url: Column | str | None = None) -> Column:
    return tags(_blob(*([] if url is None else [url]), text), rules.MODALITIES, rules.PROGRAM_TAGS)


def is_person_name(c: Column | str) -> Column:
    def fits(t: Column) -> Column:
        words = F.size(F.split(t, " "))
        return F.length(t).between(4, 80) & ~t.contains("?") & words.between(2, 6) & t.rlike(r"^\p{Lu}") & ~has_any(F.lower(t), rules.NOT_IN_NAMES)

    return T.let(T.clean_text(c), fits)


def is_course_title(c: Column) -> Column:
    """For a lower-case heading."""
    return F.length(c).between(8, 140) & ~c.endswith("?") & ~has_any(c, rules.NOT_COURSE_TITLES) & has_any(c, rules.COURSE_TITLES)


def content_type(text: Column | str, page_title: Column | str, section_title: Column | str, url: Column | str) -> Column:
    """The first type that fits; only the start of the text is read."""
    col = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    body = F.lower(F.substring(col(text), 1, 2500))
    link, heading = F.lower(col(url)), F.lower(col(section_title))
    def of(body: Column, both: Column) -> Column:
        words = lambda *w: has_any(both, w)
        about_course = body.contains("course:") | link.contains("course-progressions") | has_any(heading, rules.COURSE_SUBJECTS)
        cases = [
            (link.contains("/faqs") | body.startswith("question:") | body.startswith("q:"), "faq"),
            (words("tuition", "financial aid", "fees") | both.rlike(r"(?U)\$\s?\d"), "tuition"),
            (words("deadline", "application round", "apply by"), "deadline"),
            (words("stem") & words("opt"), "stem_opt"),
            (words("visa", "toefl", "ielts", "cpt", "international student"), "visa"),
            (words("capstone"), "capstone"),
            (about_course & has_any(both, rules.COURSE_SUBJECTS), "course"),
            (about_course, "curriculum"),
            ((link.contains("instructors-staff") | body.startswith("faculty:")) & is_person_name(section_title), "faculty_bio"),
            *((has_any(both, w), name) for name, w in rules.LATE_CONTENT_TYPES.items()),
            (F.length(body) > 250, "overview"),
        ]
        return first_match(cases, "unknown")

    both = F.struct(body.alias("body"), F.concat_ws(" ", _blob(page_title, section_title, url), body).alias("both"))
    return T.let(both, lambda x: of(x["body"], x["both"]))


def fallback_content_type(kind: Column | str, route_url: Column | str, page_title: Column | str, section_title: Column | str, text: Column | str) -> Column:
    """A type for what would be unknown."""
    kind, text = (F.col(c) if isinstance(c, str) else c for c in (kind, text))
    blob = _blob(route_url, page_title, section_title, F.substring(F.coalesce(text, F.lit("")), 1, 1200))

    def of(blob: Column) -> Column:
        cases = [
            (has_any(blob, ("/events/", "q&a", "admission", "apply")), "admissions"),
            (blob.contains("/news/") & has_any(blob, ("staff", "student", "alumni", "speaker")), "career"),
            (has_any(blob, ("speaker", "current masters", "enrollment management")), "admissions"),
            (has_any(blob, ("faculty", "instructor", "staff")), "faculty"),
        ]
        return first_match(cases, "overview")

    return F.when(kind != "unknown", kind).otherwise(T.let(blob, of))


def program_type(text: Column | str, page_title: Column | str, section_title: Column | str, url: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    blob = _blob(page_title, section_title, url, F.substring(F.coalesce(text, F.lit("")), 1, 1200))

    def of(b: Column) -> Column:
        online, there = b.contains("online"), has_any(b, rules.IN_PERSON)
        special = [(has_any(b, rules.PROGRAM_TAGS[name]), name) for name in ("mba_ms", "thesis_track")]
        return first_match([*special, (online & ~there, "online"), (there & ~online, "in_person")], "general")

    return T.let(blob, of)


def faq_category(question: Column | str, answer: Column | str) -> Column:
    return by_table(_blob(question, answer), rules.FAQ_CATEGORIES, "General")


def course_type(heading: Column | str) -> Column:
    return by_table(_blob(heading), rules.COURSE_TYPES, "elective")


def is_question(c: Column) -> Column:
    """For a clean text: a question of some length that doesn't call to act."""
    return c.contains("?") & F.length(c).between(18, 260) & ~has_any(F.lower(c), rules.CTA_QUESTIONS)


def role_line(line: Column) -> tuple[Column, Column]:
    """(academic, industry): divided at a semicolon, else by the words of academic roles."""
    academic = has_any(F.lower(line), rules.ACADEMIC_ROLES)
    left, right = F.trim(F.split(line, ";", 2)[0]), F.trim(F.get(F.split(line, ";", 2), F.lit(1)))
    return F.when(line.contains(";"), left).when(academic, line).otherwise(""), F.when(line.contains(";"), right).when(academic, "").otherwise(line)
