import pytest
from pyspark.sql import functions as F

from lexiloom.functions import html as H, urls as U
from lexiloom.operators import nodes
from tests import page_loops
from tests.conftest import DATA

URLS = [
    ("http://a.b/c/", "d", "http://a.b/c/d"), ("http://a.b/c", "//X.y/z/", "http://X.y/z"), ("http://a.b", "mailto:x@y.z", None), ("http://a.b", "#top", "http://a.b"),
    ("http://a.b", "/p?UTM_x=1&q=2#f", "http://a.b/p?q=2"), ("http://a.b", "/p?e=", "http://a.b/p"), ("http://a.b", "/p%2520q", "http://a.b/p%20q"),
    ("http://a.b", "/p/%2520/", "http://a.b/p"), ("HTTP://A.b", "", None), ("http://a.b", None, None), ("http://a.b", "/x y", "http://a.b/x y"), ("http://a.b", " /q ", "http://a.b/q"),
    ("http://a.b", "http://[bad", None),
]


def test_normalize(spark):
    df = spark.createDataFrame(URLS, "base string, href string, want string")
    for r in df.select("*", U.normalize_url("base", "href").alias("got")).collect():
        assert r.got == r.want, r


def test_canonicalize_and_allowed(one):
    assert one(U.canonicalize_url, "ftp://x/y/") == "ftp://x/y" and one(U.canonicalize_url, "http://X.y/?utm_a=1") == "http://X.y"
    ok = lambda u: one(lambda x: U.is_allowed_url(x, ("www.s.edu",), ("faq", "apply")), u)
    assert ok("https://WWW.s.edu/FAQs/x") and not ok("https://t.s.edu/faq") and not ok("https://s.edu/other?faq") and not ok(None)
    assert one(U.has_skipped_suffix, "http://x/y.PDF") and not one(U.has_skipped_suffix, "http://x/y.pdf?z")


LONG = "A sentence that fills the section with enough words to count as text. " * 3
Q = "What does the program cost today?"
A = "It depends on several things, above all on the number of courses. " * 3
LAYOUTS = {
    "dl": f"<dl><dt>{Q}</dt><dd>{A}</dd></dl>", "details": f"<details><summary>{Q}</summary><p>{A}</p></details>",
    "control": f"<div><button aria-controls=z>{Q}</button><span><i id=z>{A}</i></span></div>", "siblings": f"<h3>{Q}</h3><p>{A}</p><h3>Other heading</h3><p>no</p>",
    "container": f"<div><p>{A}</p><h4>{Q}</h4></div>", "lines": f"<div><span>{Q}</span><span>{A}</span><span>Learn more</span></div>",
}
GENERIC = f"<title>T</title><nav><h2>Menu</h2></nav><div class='side-menu'><h2>Gone</h2></div><h1>Top</h1><p>{LONG}<h2 id=a>One</h2><p>{LONG}<b>bold<p>more</p><h3>Sub</h3><div>{LONG}</div><h2>Short</h2><p>no</p><h2>{'t' * 161}</h2><p>{LONG}</p>"
COURSES = f"<h2>Core Courses</h2><h3>Machine Learning I</h3><p>{LONG}</p><h3>machine learning i</h3><h2>Elective Courses</h2><h4 id=q>Bayesian Methods</h4><p>tiny</p>"
CARDS = f"<article><h3>Ada Lovelace</h3><p>Professor; Head of Engines</p><p>{LONG}</p></article><article><h3>Apply Now Please</h3></article>"
L2 = "Something long is told here so that the text of this part reaches the least length of all sections, which is some hundred and twenty characters."
Q2 = "What courses does the program have for us?"
A2 = "It has a great many courses of all kinds and levels for you."
B, FAQ, C, N = "http://x/", "http://x/faqs", "http://x/course-progressions", "http://x/instructors-staff"
PAGES = [
 (C, f"<h2>Core Courses</h2><h3>Machine Learning I</h3><p>x</p>", None), (C, f"<h2>Core Courses{'x' * 80}</h2><h3>Machine Learning I</h3><p>x</p>", None),
 (FAQ, "<h3>Where would I find more of this?</h3><p>Please get in touch with any of us here</p>", None), (FAQ, "<h3>Where would I find more of this?</h3><p>In the library, on the second floor.</p>", None),
 (B, None, None), (B, "", "Given"), (B, f"<p>{L2}</p>", None), (B, "<p>short", None),
 (B, f"<h1>One</h1><p>{L2}</p><h2>Two</h2>bare {L2}<div>{L2}<h3>Three</h3><p>{L2}</p></div><h3>Four</h3><p>{L2} x</p><h2>Five</h2><p>{L2}</p><h2>Five</h2><p>{L2}</p>", None),
 (B, f"<title> T  t </title><nav><h1>Nav</h1>{L2}</nav><h2 id=a>Two</h2><div class='x site-menu'>{L2}</div><p aria-hidden=true>{L2}</p><p class='share'>{L2}</p><p>{L2}</p><h4>{'t' * 161}</h4><p>{L2}</p>", None),
 (B, f"<h1></h1><h1>Second</h1><p>{L2}", "Gi  ven Read More"),
 (B, f"<h2>A</h2><section><h3>B</h3><p>{L2}</p></section><section><h1>C</h1><h4>D</h4><p>{L2}</p></section>", None),
 (FAQ, f"<dl><dt>{Q2}</dt><dd>{A2}</dd></dl>", None), (FAQ, f"<dl><dt>{Q2}</dt><p>x</p><dd>{A2}</dd><dd>no</dd></dl>", None),
 (FAQ, f"<details><summary>{Q2}</summary><p>{A2}</p> bare</details>", None), (FAQ, f"<h3>{Q2}</h3><p>{A2}</p>bare<p>more</p><h3>Next</h3><p>{A2}</p>", None),
 (FAQ, f"<div><button aria-controls='p'>{Q2}</button><i>x</i><p id='p'>{A2}</p></div>", None), (FAQ, f"<div><button aria-controls='q'>{Q2}</button><i>{A2}</i></div>", None),
 (FAQ, f"<div><p>{A2}</p><button>{Q2}</button></div>", None), (FAQ, f"<div>{A2} <span><button>other one</button></span><button>{Q2}</button></div>", None), (FAQ, f"<button><button>{Q2}</button></button>{A2}", None),
 (FAQ, f"<h3>{Q2}</h3><p>Please get in touch with us about it.</p><h3>{Q2}</h3><p>{A2}</p><h3>{Q2.upper()}</h3><p>{A2} two</p>", None),
 (FAQ, f"<p>{Q2}</p><p>{A2}</p><p>Read more</p><p>abc</p><p>line\n{Q2} \n {A2}</p>" + "".join(f"<p>line {k} of the text</p>" for k in range(12)), None),
 (FAQ, f"<p>{Q2}<p>tiny<h2>Head</h2><p>{L2}</p>", None), (FAQ, f"<h2>{Q2}</h2><h5>Ha</h5><p>{A2}</p>", None), (FAQ, f"<h2>{Q2}</h2><h5></h5><p>{A2}</p><button>Or?</button><p>z</p>", None),
 (B, f"<h1>FAQ of all</h1><h3>{Q2}</h3><p>{A2}</p>", None), (B, f"<p>{L2}</p>", "The faculty"),
 (C, "<h1>Courses</h1><h2>Core Courses</h2><h3>Machine Learning One</h3><p>short</p><h3>Bayesian things</h3><p>" + L2 + "</p><h2>Elective Courses</h2><h3>machine learning one</h3><h4>Time Series now</h4><p>It is long enough to be the body of a course.</p><h2>Capstone</h2><h3>NLP and more of it</h3>", None),
 (C, f"<h2>Nothing</h2><p>{L2}</p>", None), (C, f"<h3>Machine Learning first of all</h3>text<h2>Foundational work</h2><div><h4>Big Data and so on</h4><p>{L2}</p></div>", None),
 ("http://x/ms-in-applied-data-science/online-program", f"<h2>Machine Learning Two</h2><p>{L2}</p><h2>Other</h2><p>{L2}</p>", None),
 ("http://x/news/ms-in-applied-data-science/online-program", f"<h2>Machine Learning Two</h2><p>{L2}</p>", None),
 (N, f"<div class='people-grid__item x'><h3>Ada Lovelace</h3><p>Professor; Head of Data</p><p>{L2}</p><p></p><p>End</p></div><div class='people-grid__item'><h3>Our staff</h3></div><div class=person><strong>Bob Bee</strong></div>", None),
 (N, f"<article><strong>Ada Lovelace</strong><p>Senior Lecturer</p><div><p>{L2}</p></div></article><article><h2>Bo Li</h2><p>x</p></article>", None),
 (N, f"<h2>Ada Lovelace</h2><p>Engineer</p><p>{L2}</p><h2>Grace Hopper</h2><div><p>Manager</p> of <p>{L2}</p></div><h5>x</h5><h3>Alan Turing</h3>", None),
 (N, f"<div class='the-faculty-x'><p>{L2}</p></div><h2>Ada Lovelace</h2><p>Professor</p><p>{L2}</p>", None),
 (N, f"<div class=team-member><h2>Nobody</h2></div><h4>Title here</h4><p>{L2}</p>", None),
 (B, "<div>" * 300 + f"<h2>Deep</h2><p>{L2}</p>", None), (B, f"<h2>A<br>b <b>c</b></h2><p>Learn More {L2} Read   More</p><p>Click</p><p>Here {L2}</p>", None),
]

NAMED = {
    "generic": (B, GENERIC), "main": (B, f"<p>{LONG}</p>"), "short": (B, "<p>short"), "none": (B, None), "courses": (C, COURSES), "cards": (N, CARDS),
    "people": (N, f"<h2>Ada Lovelace</h2><p>Engineer</p><p>{LONG}</p>"), "calls": (FAQ, f"<dl><dt>{Q}</dt><dd>Please get in touch with us about it.</dd></dl><h4>Ready to apply to us now?</h4>"),
    **{name: (FAQ, html) for name, html in LAYOUTS.items()},
}
FIELDS = ["title", "content", "heading_path", "heading_level", "anchor_id", "faq_category", "question", "answer", "course_name", "course_type", "faculty_name", "academic_title", "industry_role", "retrieval_priority"]


@pytest.fixture(scope="module")
def read(spark):
    """(pages by key, sections by key): all pages of this file and the smallest table's, read at once."""
    pages = {k: (u, h, t) for k, (u, h, t) in enumerate(PAGES)} | {1000 + k: (*p, None) for k, p in enumerate(NAMED.values())}
    pages |= {2000 + r.page_id: (r.url, r.html, None) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = spark.createDataFrame([(k, *p) for k, p in pages.items()], "key long, route_url string, html string, page_title string").repartition(3)
    found = nodes.sections(rows.select(F.monotonically_increasing_id().alias("page"), F.struct("key", "route_url", "page_title").alias("meta"), "html")).select("meta.key", "page_title", "section_seq", *FIELDS).collect()
    sections = {k: [] for k in pages}
    for r in sorted(found, key=lambda r: (r.key, r.section_seq)):
        assert r.section_seq == len(sections[r.key])
        sections[r.key].append(r.asDict())
    return pages, sections


def named(read, name):
    return read[1][1000 + list(NAMED).index(name)]


def test_sections_like_loops(read):
    """Each page's sections, in order and in every field, as loops over its tree find them."""
    for key, (url, html, given) in read[0].items():
        title, found = page_loops.page_sections(html, url, given)
        want = [{"page_title": title} | {f: s.get(f) for f in FIELDS} for s in found]
        assert [{f: s[f] for f in ("page_title", *FIELDS)} for s in read[1][key]] == want, (key, url, html)


def test_generic(read):
    found = named(read, "generic")
    assert [(s["page_title"], s["title"]) for s in found] == [("Top", "Top"), ("Top", "One"), ("Top", "Sub")]
    assert found[1]["heading_path"] == ["Top", "One"] and found[2]["heading_path"] == ["Top", "One", "Sub"] and found[1]["anchor_id"] == "a"
    assert "bold more" in found[1]["content"] and found[1]["content"].count("A sentence") == 6 and found[2]["heading_level"] == 3
    assert named(read, "main")[0]["title"] == "Main Content" and named(read, "main")[0]["page_title"] == "Untitled Page" and named(read, "short") == named(read, "none") == []


@pytest.mark.parametrize("layout", LAYOUTS)
def test_faq_layouts(read, layout):
    found = named(read, layout)
    assert [(s["question"], s["answer"]) for s in found] == [(Q, A.strip())]
    assert found[0]["content"] == f"Question: {Q}\nAnswer: {A.strip()}" and found[0]["faq_category"] == "Curriculum" and found[0]["retrieval_priority"] == 95


def test_faq_rejects_calls_to_act(read):
    assert named(read, "calls") == []


def test_courses(read):
    found = named(read, "courses")
    assert [(s["course_name"], s["course_type"]) for s in found] == [("Machine Learning I", "core"), ("Bayesian Methods", "elective")]
    assert found[1]["content"] == "Course: Bayesian Methods\nCourse type: elective\n\nBayesian Methods" and found[1]["heading_path"] == ["Elective Courses", "Bayesian Methods"]


def test_faculty_cards_and_headings(read):
    assert [(x["faculty_name"], x["academic_title"], x["industry_role"]) for x in named(read, "cards")] == [("Ada Lovelace", "Professor", "Head of Engines")]
    assert named(read, "people")[0]["content"].startswith("Faculty: Ada Lovelace\nIndustry role: Engineer\nA sentence")


def test_titles(spark, read):
    rows = spark.createDataFrame([(k, h, t) for k, (u, h, t) in read[0].items()], "key long, html string, page_title string")
    got = nodes.page_titles(rows.select(F.col("key").alias("page"), F.struct("key", "page_title").alias("meta"), "html")).collect()
    assert {r.page: r.page_title for r in got} == {k: page_loops.page_sections(h, u, t)[0] for k, (u, h, t) in read[0].items()}


def test_nodes_are_intervals(spark):
    rows = nodes.node_table(spark.createDataFrame([(7, ("m",), "<div>a<p>b<i>c</i></p> <b></b></div>d")], "page long, meta struct<x:string>, html string")).orderBy("pre").collect()
    assert [(r.tag, r.pre, r.post, r.parent, r.first, r.past, r.text) for r in rows] == [
        ("document", 0, 8, -1, 0, 4, None), ("div", 1, 7, 0, 0, 3, None), ("#text", 2, 2, 1, 0, 1, "a"), ("p", 3, 6, 1, 1, 3, None), ("#text", 4, 4, 3, 1, 2, "b"), ("i", 5, 6, 3, 2, 3, None),
        ("#text", 6, 6, 5, 2, 3, "c"), ("b", 7, 7, 1, 3, 3, None), ("#text", 8, 8, 0, 3, 4, "d"),
    ]
    assert [r.meta for r in rows][1:] == [None] * 8 and rows[0].meta.x == "m" and {r.page for r in rows} == {7}


def test_deep_nesting_and_links():
    assert len(H.node_rows(H.parse("<div>" * 5000 + "x"))) == 5002
    assert H.links("<a href='/a'>x</a><a>y</a><a href=b>") == ["/a", "b"]
    head = H.head_metadata("<title> A  b </title><link rel='canonical' href='/c'><meta name=description content=' d '>")
    assert head == {"page_title": "A b", "canonical": "/c", "meta_description": "d"}


def test_references_without_a_semicolon_are_text(spark):
    page = "<h1>A &amp;&amp; b&amp</h1><p>&copy; &quot;q&quot &ampx; &nosuch; &#65;</p><a href='?a=1&copy=2&amp;b'>y</a><script>a &amp; &b</script>"
    assert list(H.parse(page).strings()) == ["A && b&amp", '© "q&quot &ampx; &nosuch; A', "y", "a &amp; &b"] and H.links(page) == ["?a=1&copy=2&b"]
    titles = nodes.page_titles(spark.createDataFrame([(1, (None,), page)], "page long, meta struct<page_title: string>, html string"))
    assert titles.first().page_title == "A && b&amp"


def test_work_of_a_page_grows_with_it(spark):
    """No frame is gone through anew for each row, and no array of the page is beside what is exploded of it."""
    plan = nodes._placed(nodes._elements(nodes.node_table(spark.createDataFrame([(1, (None,), "<p>x")], "page long, meta struct<page_title: string>, html string"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing" not in plan and "posexplode" not in plan and "inline(transform(elements" in plan


def test_strings_of_a_page_are_gathered_once(spark):
    """``first`` beside a list copies what it holds at each row of the page."""
    pages = spark.createDataFrame([(1, (None, None), "<p>x")], "page long, meta struct<route_url: string, page_title: string>, html string")
    plan = nodes.sections(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert "first(texts" not in plan and "collect_list(texts" in plan


def test_pages_of_many_parts_are_not_put_together(spark):
    """The parts keep their number: put together for their size on disk, they would hold more pages than memory does."""
    table = nodes.node_table(spark.createDataFrame([(1, (None,), "<p>x")], "page long, meta struct<page_title: string>, html string"))
    plan = nodes._elements(table, apart=True)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") == 1


def test_cleaned_again(one):
    from lexiloom.functions import text as T

    for x in (None, "", " a  b ", "Learn Learn More More x", "L\u200bearn More\u00a0y", "Clic\u212a Here z", "ä  Read Read More More"):
        got, first = one(T.cleaned_again, x), one(T.clean_text, x)
        assert (got.once, got.again) == (first, one(T.clean_text, first)), x


def test_assembled_section(spark):
    from lexiloom.operators.sections import extract_sections, invalid_sections

    pages = spark.createDataFrame(
        [("http://x/faqs/", f"<h1>FAQ</h1><dl><dt>{Q}</dt><dd>{A}</dd></dl>", 0), ("http://x/instructors-staff", f"<h2>Ada Lovelace</h2><p>Engineer</p><p>{LONG}</p>", 1), ("http://x/e", "", 2)], "url string, html string, page_seq long"
    )
    assert invalid_sections(extract_sections(pages)).count() == 0
    faq, bio = extract_sections(pages).orderBy("page_seq").collect()
    assert faq.content_type == "faq" and faq.url == "http://x/faqs" and faq.chunk_id == faq.doc_id and faq.heading_path == ["FAQs", "Curriculum", Q] and faq.content_valid
    assert bio.content_type == "faculty_bio" and bio.retrieval_priority == 80 and bio.content.startswith("Faculty: Ada Lovelace Industry role") and bio.token_count > 30


def test_name_found_by_heading_gets_label_without_separator(spark):
    from lexiloom.operators.sections import assemble, read_sections

    pages = spark.createDataFrame([("http://x/instructors-staff-more", f"<h2>Ada Lovelace</h2><div>{LONG}</div>", 0)], "url string, html string, page_seq long")
    raw = read_sections(pages).withColumn("faculty_name", F.lit(None).cast("string")).withColumn("content", F.lit(LONG))
    row = assemble(raw).first()
    assert row.content_type == "faculty_bio" and row.content.startswith("Faculty: Ada LovelaceA sentence") and row.faculty_name == "Ada Lovelace"
