"""Pages as a table of nodes, and sections read off it.

Python parses a page and emits its nodes, nothing more: an element's number in document order and that of the last node
in it, so that what is inside is an interval; its parent; and which of the page's strings it holds. All else is
relational: noise is what lies in a marked interval, a heading's path is the last heading of each level, its section runs
to the next sibling of its level, a course's kind is the last label above it. Pages are shuffled once, by page; all windows and
groups are within pages, and a page is bounded as its HTML is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import classify as C, html as H, rules, text as T

_NODE = (
    "pre int, post int, parent int, parent_post int, tag string, parent_tag string, text string, class string, hidden boolean, id string, controls string, "
    "first int, past int, parent_first int, parent_past int"
)
_FIELDS = [f.split()[0] for f in _NODE.split(", ")]
#: Elements whose own text is read.
_READ = ("h1", "h2", "h3", "h4", "h5", "h6", "title", "dt", "button", "summary")
_ASKING = ("h2", "h3", "h4", "h5", "dt", "button", "summary")
LONGEST_TITLE, SHORTEST_COURSE, SHORTEST_ANSWER, SHORTEST_BIO, LAST_LINES = 160, 40, 25, 60, 7


def _worked_out(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with ``columns`` worked out here, once: what uses them later doesn't take their expressions in."""
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def node_table(pages: DataFrame) -> DataFrame:
    """(page, meta, and the columns of a node) for ``pages`` (page, meta, html): meta is on a page's first node, the document, alone.

    ``pre`` and ``post`` are the first and the last number inside, strings are nodes of the tag ``#text``; ``first`` and ``past`` say
    which of the page's strings an element holds, those with the prefix parent_ the same of its parent.
    """
    kind = pages.select("page", "meta").schema
    schema = to_arrow_schema(pages.select("page", "meta", *(F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _NODE.split(", ")))).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 16) for at in range(0, whole.num_rows, 16)):
                page, meta, rows = [], [], []
                for at, html in enumerate(batch.column(2).to_pylist()):
                    own = H.node_rows(H.parse(html))
                    rows += own
                    page += [at] * len(own)
                    meta += [at] + [None] * (len(own) - 1)
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(page)), batch.column(1).take(pa.array(meta, pa.int64())), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True))], schema=schema)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return pages.select("page", "meta", "html").mapInArrow(run, f"{ddl}, {_NODE}")


def _is_noise() -> Column:
    """By tag, class or hidden state."""
    kinds = F.split(F.coalesce("class", F.lit("")), r"\s+")
    parts = F.lower(F.array_join(kinds, " "))
    return F.col("tag").isin(*rules.REMOVED_TAGS) | F.coalesce("hidden", F.lit(False)) | C.has_any(parts, rules.REMOVED_CLASS_PARTS) | F.arrays_overlap(kinds, F.array(*map(F.lit, rules.REMOVED_CLASSES)))


def _strings(texts: Column, first: Column, past: Column, without: Column | None = None) -> Column:
    """The strings from ``first`` to ``past``, joined; those right in the element ``without`` are left out."""
    # By place: ``slice`` would read the page's whole array for each element.
    at = F.when(past > first, F.sequence(first, past - 1)).otherwise(F.array().cast("array<int>"))
    some = F.filter(F.transform(at, lambda k: F.get(texts, k)), lambda x: x["text"] != "" if without is None else (x["text"] != "") & (x["parent"] != without))
    return F.array_join(F.transform(some, lambda x: x["text"]), " ")


def _elements(nodes: DataFrame, apart: bool = False) -> DataFrame:
    """A row for each element that isn't noise, with its text if it is of a kind that is read; meta and all strings of the page on the first."""
    if apart:  # As many parts as the session has, none put together: the lists of all pages of a part are in memory at once.
        nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page")
    up_to = Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.coalesce(F.max(F.when((F.col("tag") != "#text") & _is_noise(), F.col("post"))).over(up_to) >= F.col("pre"), F.lit(False))
    is_text = F.col("tag") == "#text"
    element = F.struct(*(c for c in _FIELDS if c not in ("text", "hidden")))
    pages = nodes.withColumn("gone", gone).groupBy("page").agg(
        F.first("meta", ignorenulls=True).alias("meta"),
        F.sort_array(F.collect_list(F.when(is_text, F.struct("pre", "parent", F.when(F.col("gone"), "").otherwise(F.col("text")).alias("text"))))).alias("texts"),
        F.sort_array(F.collect_list(F.when(~is_text & ~F.col("gone"), element))).alias("elements"),
    )
    own = lambda e: F.when(e["tag"].isin(*_READ), T.clean_text(_strings(F.col("texts"), e["first"], e["past"])))
    # What is exploded has the page's columns on its first row already: carried beside it they would be in every row's buffer.
    of_page = lambda nth: (F.when(nth == 0, F.col(c)).alias(c) for c in ("meta", "texts"))
    rows = pages.select("page", F.inline(F.transform("elements", lambda e, nth: F.struct(*(e[c].alias(c) for c in _FIELDS if c not in ("text", "hidden")), own(e).alias("text"), *of_page(nth)))))
    return rows.withColumn("level", F.when(F.col("tag").rlike("^h[1-6]$"), F.substring("tag", 2, 1).cast("int")))


def _placed(elements: DataFrame) -> DataFrame:
    """``elements`` with what follows from their order: where the section and the answer of each end, its path of headings, the label above it."""
    # What follows is read backwards: a frame without an end would be gone through anew for each row.
    after = Window.partitionBy("page", "parent").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    beside = Window.partitionBy("page", "parent").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("page").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    up_to = before.rowsBetween(Window.unboundedPreceding, 0)
    level, tag, text = F.col("level"), F.col("tag"), F.col("text")
    next_ = lambda condition, value: F.last(F.when(condition, value), ignorenulls=True).over(after)
    here = F.struct("first", "past")
    stops = (tag.isin("h2", "h3", "h4", "h5", "dt", "summary") & (text != "")) | ((tag == "button") & text.contains("?"))
    rows = elements.withColumns({
        **{f"next_{k}": next_(level == k, F.col("first")) for k in range(1, 7)},
        **{f"last_{k}": F.last(F.when((level == k) & (text != ""), text), ignorenulls=True).over(before) for k in range(1, 6)},
        "answer_past": F.coalesce(next_(stops, F.col("first")), F.col("parent_past")),
        "next_dd": next_(tag == "dd", here),
        "next_person": next_(tag.isin("h2", "h3", "h4"), F.col("pre")),
        "summary": F.first(F.when(tag == "summary", here), ignorenulls=True).over(beside),
    })
    past = C.first_match([(level == k, F.least("parent_past", *(f"next_{j}" for j in range(1, k + 1)))) for k in range(1, 7)], F.lit(None).cast("int"))
    above = F.filter(F.array(*(F.when(level > k, F.col(f"last_{k}")) for k in range(1, 6))), lambda x: x.isNotNull())
    rows = rows.withColumns({"section_past": past, "path": F.when(level.isNotNull(), F.concat(above, F.array(text)))}).drop(*(f"next_{k}" for k in range(1, 7)), *(f"last_{k}" for k in range(1, 6)))
    label = level.between(2, 4) & C.has_any(F.lower(text), rules.COURSE_LABELS) & (F.length(text) < 80)
    rows = rows.withColumn("is_label", F.coalesce(label, F.lit(False)))
    return rows.withColumn("course_label", F.last(F.when(F.col("is_label"), F.struct(C.course_type(text).alias("kind"), "path")), ignorenulls=True).over(up_to))


_SECTION = "title string, raw string, rest string, path array<string>, level int, anchor string, kind string, parts array<string>"


def _section(how: str, turn: Column | int, title: Column, raw: Column | None = None, **more: Column) -> Column:
    """What may be a section, its texts not cleaned yet; ``rest`` is what answers if ``raw`` has no text."""
    given = {"title": title, "raw": raw, **more}
    types = [f.split() for f in _SECTION.split(", ")]
    turn = F.lit(turn) if isinstance(turn, int) else turn
    return F.struct(F.lit(how).alias("how"), turn.alias("turn"), *((given[n] if given.get(n) is not None else F.lit(None)).cast(t).alias(n) for n, t in types))


def _candidates(page: DataFrame) -> DataFrame:
    """``page`` (one row each) with all that may be sections, by what the page is: of those of the first turn that any is good, all good ones count."""
    texts, all_ = F.col("texts"), F.col("elements")
    within = lambda e, x: (x["pre"] > e["pre"]) & (x["pre"] <= e["post"])
    own = lambda e: _strings(texts, e["first"], e["past"])
    below = lambda e: _strings(texts, e["past"], e["section_past"], e["parent"])
    headings = F.filter(all_, lambda e: e["level"].between(1, 4))
    lower = F.filter(headings, lambda e: e["level"] >= 2)

    generic = F.transform(headings, lambda e: _section("generic", 3, e["text"], below(e), path=e["path"], level=e["level"], anchor=e["id"]))
    main = F.array(_section("main", 3, F.lit("Main Content"), own(all_[0]), path=F.array(F.lit("Main Content")), level=F.lit(1)))
    generic = F.when(F.size(headings) > 0, generic).otherwise(main)

    turn = F.when(F.col("route") == "courses", 1).otherwise(3)
    named = F.filter(lower, lambda e: ~e["is_label"] & C.is_course_title(F.lower(e["text"])))
    under = lambda e: F.concat(F.coalesce(e["course_label"]["path"], F.array(F.lit("Course Progressions"))), F.array(e["text"]))
    kind = lambda e: F.coalesce(e["course_label"]["kind"], F.lit("elective"))
    courses = F.transform(named, lambda e: _section("course", turn, e["text"], below(e), path=under(e), level=e["level"], anchor=e["id"], kind=kind(e)))

    def without(e: Column, x: Column) -> Column:
        """The parent's strings but those of ``x``."""
        return F.concat_ws(" ", F.nullif(_strings(texts, e["parent_first"], x["first"]), F.lit("")), F.nullif(_strings(texts, x["past"], e["parent_past"]), F.lit("")))

    inside = lambda e, x: (x["pre"] > e["parent"]) & (x["pre"] <= e["parent_post"])
    target = lambda e: F.when(F.coalesce(e["controls"], F.lit("")) != "", F.get(F.filter(all_, lambda x: (x["id"] == e["controls"]) & inside(e, x)), F.lit(0)))
    alike = lambda e: F.get(F.filter(all_, lambda x: (x["tag"] == e["tag"]) & inside(e, x)), F.lit(0))

    def answer(e: Column) -> Column:
        """By definition list, details, control, or position; else what the parent holds besides its first element of the kind."""
        by_list = F.when((e["tag"] == "dt") & e["next_dd"].isNotNull(), own(e["next_dd"])).when((e["tag"] == "summary") & (e["parent_tag"] == "details"), without(e, e["summary"]))
        named = F.coalesce(by_list, T.let(target(e), lambda x: F.when(x.isNotNull(), own(x))))
        rest = F.when(named.isNull() & (e["parent_tag"] != e["tag"]), T.let(alike(e), lambda x: F.when(x.isNotNull(), without(e, x))))
        return _section("faq", 1, e["text"], F.coalesce(named, _strings(texts, e["past"], e["answer_past"], e["parent"])), rest=rest)

    asked = F.filter(all_, lambda e: e["tag"].isin(*_ASKING) & C.is_question(e["text"]))
    questions = F.transform(asked, answer)

    # Lines of visible text: those from one question to the next answer it.
    lines = F.split(F.array_join(F.transform(F.filter(texts, lambda x: x["text"] != ""), lambda x: x["text"]), "\n"), "\n")
    lines = F.filter(F.transform(lines, lambda x: T.clean_text(x)), lambda x: F.length(x) > 3)

    def of_lines(all_lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(all_lines)), lambda k: F.coalesce(C.is_question(F.get(all_lines, k)), F.lit(False)))

        def one(at: Column) -> Column:
            def said(k: Column, nth: Column) -> Column:
                upto = F.get(at, nth + 1)
                some = F.slice(all_lines, k + 2, F.coalesce(upto - k - 1, F.lit(LAST_LINES)))
                return _section("line", 2, F.get(all_lines, k), F.array_join(F.filter(some, lambda x: ~C.has_any(F.lower(x), rules.NOISE_LINES)), " "))

            return F.transform(at, said)

        return T.let(at, one)

    kinds = [F.filter(all_, _is_card(*selector)) for selector in rules.CARD_SELECTORS]
    cards = C.first_match([(F.size(x) > 0, x) for x in kinds[:-1]], kinds[-1])
    name = lambda e: F.get(F.filter(all_, lambda x: x["tag"].isin("h2", "h3", "h4", "strong") & within(e, x)), F.lit(0))
    paragraphs = lambda e: F.transform(F.filter(all_, lambda x: (x["tag"] == "p") & within(e, x)), own)
    people = F.transform(cards, lambda e: _section("card", 1, T.let(name(e), own), parts=paragraphs(e)))
    beside = lambda e: F.filter(all_, lambda x: (x["parent"] == e["parent"]) & (x["pre"] > e["pre"]) & (x["pre"] < F.coalesce(e["next_person"], F.lit(2**31 - 1))))
    headed = F.transform(lower, lambda e: _section("person", 2, e["text"], parts=F.transform(beside(e), own)))

    none = F.array().cast(f"array<struct<how:string,turn:int,{','.join(f.replace(' ', ':') for f in _SECTION.split(', '))}>>")
    only = lambda condition, made: F.when(condition, made).otherwise(none)
    is_ = lambda kind: F.col("route") == kind
    found = F.concat(only(is_("faq"), F.concat(questions, T.let(lines, of_lines))), only(is_("faculty"), F.concat(people, headed)), only(is_("courses") | F.col("open"), courses), generic)
    return page.select("page", "meta", "page_title", F.posexplode(found).alias("nth", "s"))


#: Special pages: words in the address, words in the title; the first that fits.
_ROUTES = (("faq", ("faq",), ("faq",)), ("courses", ("course-progressions",), ("course progression",)), ("faculty", ("instructors-staff",), ("faculty", "instructor")))


def _routed(pages: DataFrame) -> DataFrame:
    """``pages`` (meta, page_title) with the kind of special page that each is, and whether courses may be found on it by the way."""
    link, titles = F.lower(F.coalesce("meta.route_url", F.lit(""))), F.lower(F.concat_ws(" ", "page_title", F.coalesce("meta.page_title", F.lit(""))))
    route = C.first_match([(C.has_any(link, urls) | C.has_any(titles, words), kind) for kind, urls, words in _ROUTES], "")
    return _worked_out(pages, **{"route": route, "open": C.has_any(link, rules.COURSE_PATHS) & ~C.has_any(link, rules.NO_COURSE_PATHS)})


def _is_card(tag: str, kind: str | None, part: str | None):
    def fits(e: Column) -> Column:
        given = F.coalesce(e["class"], F.lit(""))
        out = e["tag"] == tag
        if kind:
            out = out & F.array_contains(F.split(given, r"\s+"), kind)
        return out & given.contains(part) if part else out

    return fits


def _title() -> Column:
    """The first h1 with text, else what the page is said to be called, else its title element."""
    first = lambda tag: F.get(F.filter("elements", lambda e: e["tag"] == tag), F.lit(0))["text"]
    given = F.col("meta.page_title")
    return C.first_match([(F.coalesce(first("h1"), F.lit("")) != "", first("h1")), (F.coalesce(given, F.lit("")) != "", T.clean_text(given))], F.coalesce(first("title"), F.lit("Untitled Page")))


def page_titles(pages: DataFrame) -> DataFrame:
    """(page, meta, page_title) for ``pages`` (page, meta, html)."""
    rows = _elements(node_table(pages)).groupBy("page").agg(F.first("meta", ignorenulls=True).alias("meta"), F.sort_array(F.collect_list(F.when(F.col("tag").isin("h1", "title"), F.struct("pre", "tag", "text")))).alias("elements"))
    return rows.select("page", "meta", _title().alias("page_title"))


def sections(pages: DataFrame, least: int = 120, apart: bool = False) -> DataFrame:
    """The sections of ``pages`` (page, meta, html) in document order: page, meta, page_title, section_seq and the fields of a raw section.

    meta holds route_url and page_title at least. Pages without sections give no row.
    ``apart`` is for few, large pages: their parts are not put together. Of many small ones each part would cost more than its pages.
    """
    rows = _placed(_elements(node_table(pages), apart))
    kept = [c for c in rows.columns if c not in ("page", "meta", "texts", "pre")]
    # Lists of one: beside a list, the buffer of ``first`` is copied at each row, so a page's strings once for each of its elements.
    only = lambda c: F.get(F.collect_list(c), F.lit(0)).alias(c)
    by_page = rows.groupBy("page").agg(only("meta"), only("texts"), F.sort_array(F.collect_list(F.struct("pre", F.struct(*kept).alias("own")))).alias("elements"))
    by_page = by_page.withColumn("elements", F.transform("elements", lambda e: F.struct(e["pre"].alias("pre"), *(e["own"][c].alias(c) for c in kept))))
    found = _candidates(_routed(_worked_out(by_page, page_title=_title()))).select("page", "meta", "page_title", "nth", "s.*")

    how = F.col("how")
    # Texts are cleaned for the strings of an element, and again for what they make together.
    none = F.array().cast("array<string>")
    found = _worked_out(found, read=F.transform(F.array("raw", "title", "rest"), lambda x: T.cleaned_again(x)), parts=F.transform(F.coalesce("parts", none), lambda x: T.clean_text(x)))
    at = lambda k: F.get("read", F.lit(k))
    title = F.when(how == "card", at(1)["once"]).otherwise(F.col("title"))
    body = F.when(at(0)["once"] != "", at(0)["again"]).when(F.lower(at(2)["once"]) != F.lower("title"), at(2)["again"]).otherwise("")
    found = _worked_out(found, title=title, body=body, parts=F.filter("parts", lambda p: p != "")).drop("raw", "rest", "read")
    person, faq, course = how.isin("card", "person"), how.isin("faq", "line"), how == "course"
    academic, industry = C.role_line(F.coalesce(F.get("parts", F.lit(0)), F.lit("")))
    of_person = {"bio": T.clean_text(F.array_join(F.slice("parts", 2, 2**31 - 2), " ")), "academic": academic, "industry": industry}
    found = _worked_out(found, category=F.when(faq, C.faq_category("title", "body")), **{n: F.when(person, c) for n, c in of_person.items()})
    labelled = [F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c))) for label, c in (("Faculty: ", "title"), ("Academic role: ", "academic"), ("Industry role: ", "industry"), ("", "bio"))]
    category = F.col("category")
    # Not a column of the rows that are sorted: it would hold most texts twice.
    content = C.first_match([
        (faq, F.concat(F.lit("Question: "), "title", F.lit("\nAnswer: "), "body")),
        (course, F.concat(F.lit("Course: "), "title", F.lit("\nCourse type: "), "kind", F.lit("\n\n"), F.when(F.length("body") >= SHORTEST_COURSE, F.col("body")).otherwise(F.col("title")))),
        (person, F.concat_ws("\n", *labelled)),
    ], F.col("body"))
    said = F.lower(F.concat_ws(" ", "title", "body"))
    calls = (F.length("body") < 180) & C.has_any(said, rules.CTA_ANSWERS)
    good = C.first_match([
        (faq, (F.length("body") >= SHORTEST_ANSWER) & ~calls),
        (person, C.is_person_name("title") & (F.length(content) >= SHORTEST_BIO) & ((how == "card") | (F.size("parts") > 0))),
        (course, F.lit(True)),
    ], (F.col("title") != "") & (F.length("title") <= LONGEST_TITLE) & (F.length("body") >= least))
    whole = Window.partitionBy("page")
    found = found.where(good).withColumn("turns", F.min("turn").over(whole)).where(F.col("turn") == F.col("turns"))
    key = T.sha256(C.first_match([(course | (how == "faq"), F.lower("title"))], F.lower(F.concat_ws("|", F.col("title"), content))))
    found = found.withColumn("same", F.row_number().over(Window.partitionBy("page", F.when(course, "course").otherwise("other"), key).orderBy("nth"))).where("same = 1")
    seq = F.row_number().over(whole.orderBy("nth")) - 1
    question, name = F.when(faq, F.col("title")), F.when(person, F.col("title"))
    path = C.first_match([(faq, F.array(F.lit("FAQs"), category, F.col("title"))), (person, F.array(F.lit("Faculty, Instructors & Staff"), F.col("title")))], F.col("path"))
    return found.select(
        "page", "meta", "page_title", seq.alias("section_seq"), F.when(faq, F.substring("title", 1, 140)).otherwise(F.col("title")).alias("title"), content.alias("content"), path.alias("heading_path"),
        F.when(faq, 4).otherwise(F.col("level")).alias("heading_level"), F.col("anchor").alias("anchor_id"), F.when(faq, category).alias("faq_category"), question.alias("question"), F.when(faq, F.col("body")).alias("answer"),
        F.when(course, F.col("title")).alias("course_name"), F.when(course, F.col("kind")).alias("course_type"), name.alias("faculty_name"), F.when(person, F.col("academic")).alias("academic_title"),
        F.when(person, F.col("industry")).alias("industry_role"), C.first_match([(faq, F.lit(95)), (course, F.lit(90)), (person, F.lit(80))], F.lit(None).cast("int")).alias("retrieval_priority"),
    )
