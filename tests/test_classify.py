import pytest
from pyspark.sql import functions as F

from lexiloom.functions import classify as C

# (text, page title, section title, url, type)
TYPES = [
    ("anything", "", "", "http://x/faqs/1", "faq"), ("Question: why?", "", "", "", "faq"), ("q: why", "", "", "", "faq"),
    ("fees apply", "", "", "", "tuition"), ("it is $ 5", "", "", "", "tuition"), ("the Deadline", "", "", "", "deadline"), ("a system option", "", "", "", "stem_opt"),
    ("TOEFL", "", "", "", "visa"), ("capstone", "", "", "", "capstone"), ("course: x with NLP", "", "", "", "course"), ("course: cooking", "", "", "", "curriculum"),
    ("", "", "Time Series", "", "course"), ("x", "", "", "http://x/course-progressions", "curriculum"), ("faculty: she", "", "Ada Lovelace", "", "faculty_bio"),
    ("faculty: she", "", "Our Staff", "", "faculty"), ("a degree", "", "", "", "admissions"), ("elective", "", "", "", "curriculum"), ("a professor", "", "", "", "faculty"),
    ("outcome", "", "", "", "career"), ("online", "", "", "", "program_format"), ("combat", "", "", "", "mba_ms"), ("z" * 251, "", "", "", "overview"),
    ("z" * 250, "", "", "", "unknown"), ("z" * 2499 + " visa", "", "", "", "overview"), ("z" * 2496 + "visa", "", "", "", "visa"),
]


def test_content_type(spark):
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(TYPES)], "k int, t string, p string, s string, u string, want string")
    for r in df.select("*", C.content_type("t", "p", "s", "u").alias("got")).collect():
        assert r.got == r.want, r


@pytest.mark.parametrize("text,want", [("MBA", "mba_ms"), ("2-year", "thesis_track"), ("online", "online"), ("NBC Tower", "in_person"), ("online, in person", "general"), ("gleacher", "general"), ("z" * 1200 + "online", "general")])
def test_program_type(one, text, want):
    assert one(lambda x: C.program_type(x, F.lit(None), F.lit(""), F.lit(None)), text) == want


@pytest.mark.parametrize("text,want", [("gre", "Application Process"), ("opt", "International Students"), ("synchronous", "Online Program"), ("gleacher", "In-Person Program"), ("booth", "MBA/MS Program"), ("18 course", "2-Year Thesis Track"), ("elective", "Curriculum"), ("scholarship", "Tuition & Financial Aid"), ("job", "Career"), ("zzz", "General"), (None, "General")])
def test_faq_category(one, text, want):
    assert one(lambda x: C.faq_category(x, F.lit("")), text) == want


@pytest.mark.parametrize("text,want", [("Career Seminar core course", "career_seminar"), ("Noncredit", "foundational"), ("Core Courses", "core"), ("zzz", "elective"), (None, "elective")])
def test_course_type(one, text, want):
    assert one(C.course_type, text) == want


def test_tags(one):
    both = lambda x: F.struct(C.modality(x).alias("m"), C.program_tags(x).alias("p"))
    r = one(both, "Online, part time, gleacher; system visa thesis")
    assert (r.m, r.p) == (["online", "in_person", "part_time"], ["online", "in_person", "part_time", "thesis_track", "stem_opt", "international"])


@pytest.mark.parametrize("kind,url,text,want", [("visa", "", "apply", "visa"), ("unknown", "", "Q&A", "admissions"), ("unknown", "/news/1", "alumni", "career"), ("unknown", "", "a speaker", "admissions"), ("unknown", "", "staff", "faculty"), ("unknown", "", "z", "overview"), ("unknown", "", "z" * 1200 + "staff", "overview")])
def test_fallback(one, kind, url, text, want):
    assert one(lambda x: C.fallback_content_type(F.lit(kind), F.lit(url), F.lit(""), F.lit(None), x), text) == want


@pytest.mark.parametrize("text,want", [("Ada Lovelace", True), ("ada Lovelace", False), ("Ada", False), ("Ada Lovelace?", False), ("Élise Du Pont", True), ("Program Overview", False), ("A B C D E F G", False), ("A" * 40 + " " + "B" * 40, False), ("", False), (None, False)])
def test_person_name(one, text, want):
    assert one(C.is_person_name, text) is want


@pytest.mark.parametrize("text,want", [("How long does the program take?", True), ("Short one?", False), ("Are you ready to apply soon, or later?", False), ("No question here at all, none", False), ("x" * 261 + "?", False)])
def test_question(one, text, want):
    assert one(C.is_question, text) is want


def test_course_titles(one):
    assert one(C.is_course_title, "machine learning i") and not one(C.is_course_title, "machine learning schedule") and not one(C.is_course_title, "machine learning?")


def test_roles(one):
    role = lambda x: tuple(one(lambda c: F.struct(*C.role_line(c)), x))
    assert role("Professor; Head; Data") == ("Professor", "Head; Data")
    assert role("Adjunct of things") == ("Adjunct of things", "") and role("Engineer") == ("", "Engineer")


def test_any_vocabulary(one):
    assert one(lambda x: C.by_table(x, {"a": ("x",), "b": ("y",)}, "c"), "y x") == "a"
