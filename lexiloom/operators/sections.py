"""Pages to sections: structure is read off the table of nodes, all labels are expressions.

Order is semantic, so it is carried: page_seq, section_seq and, after chunking, chunk_index.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import classify as C, html as H, rules, text as T, urls as U
from . import nodes

_META = ("route_url", "canonical", "last_modified", "page_title")


def read_sections(pages: DataFrame, min_text_length: int = 120, apart: bool = False) -> DataFrame:
    """Rows of ``pages`` (url, html, page_title, canonical_url, final_url, last_modified, page_seq) exploded into raw sections.

    Columns but url and html may be absent. Pages without sections give no row.
    """
    for name in ("page_title", "canonical_url", "final_url", "last_modified"):
        if name not in pages.columns:
            pages = pages.withColumn(name, F.lit(None).cast("string"))
    first = lambda *names: F.coalesce(*(F.nullif(F.col(n), F.lit("")) for n in names))
    out = pages.withColumn("route_url", U.canonicalize_url("url"))
    out = out.withColumn("canonical", U.canonicalize_url(first("canonical_url", "final_url", "url")))
    keep = [c for c in ("page_seq",) if c in pages.columns]
    found = nodes.sections(out.select(F.monotonically_increasing_id().alias("page"), F.struct(*keep, *_META).alias("meta"), "html"), min_text_length, apart)
    fields = [c for c in found.columns if c not in ("page", "meta", "page_title", "section_seq")]
    return found.select(*(F.col(f"meta.{c}").alias(c) for c in keep), "section_seq", *(F.col(f"meta.{c}").alias(c) for c in _META[:3]), "page_title", *fields)


def assemble(raw: DataFrame) -> DataFrame:
    """Raw sections with all their labels: the full section schema.

    The type follows from rules, then from what the section is (a question, a course, a person); the
    last such fact wins. A biography found by its heading gets a label put in front of it.
    """
    empty = F.expr("cast(array() AS array<string>)")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    out = raw.withColumn("body", T.clean_text("content"))
    kind = C.first_match(
        [(has("faculty_name"), "faculty_bio"), (has("course_name"), "course"), (has("question") & has("answer"), "faq")],
        C.content_type("body", "page_title", "title", "route_url"),
    )
    out = out.withColumn("_kind", kind).withColumn("content_type", C.fallback_content_type("_kind", "route_url", "page_title", "title", "body"))
    named = (F.col("content_type") == "faculty_bio") & ~has("faculty_name") & C.is_person_name("title")
    course = (F.col("content_type") == "course") & ~has("course_name") & C.is_course_title(F.lower("title"))
    out = out.withColumn("faculty_name", F.when(named, F.col("title")).otherwise(F.col("faculty_name")))
    out = out.withColumn("course_type", F.when(course, F.coalesce("course_type", F.lit("unknown"))).otherwise(F.col("course_type")))
    out = out.withColumn("_courses", F.when(course, F.array("title")).when(has("course_name"), F.array("course_name")).otherwise(empty))
    labelled = (F.col("content_type") == "faculty_bio") & has("faculty_name") & ~F.lower("body").startswith("faculty:")
    out = out.withColumn("body", F.when(labelled, T.clean_text(F.concat(F.lit("Faculty: "), "faculty_name", "body"))).otherwise(F.col("body")))
    doc_id = T.sha256(F.lower(F.concat_ws("|", "route_url", "title", "body")))
    null = lambda kind: F.lit(None).cast(kind)
    order = [c for c in ("page_seq", "section_seq") if c in raw.columns]
    return out.select(
        *order,
        doc_id.alias("doc_id"), null("string").alias("parent_doc_id"), doc_id.alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_count"),
        F.col("route_url").alias("url"), F.col("canonical").alias("canonical_url"), F.lit(rules.ALLOWED_DOMAINS[0]).alias("source_domain"),
        F.lit(rules.SOURCE_NAME).alias("source"), "page_title", F.col("title").alias("section_title"),
        F.coalesce("heading_path", F.array("page_title", "title")).alias("heading_path"), "heading_level", "anchor_id",
        F.col("body").alias("content"), F.col("body").alias("content_clean"), T.summary("body").alias("content_summary"), T.bullets("content").alias("bullet_points"),
        T.token_count("body").alias("token_count"), F.length("body").alias("char_count"),
        "content_type", C.program_type("body", "page_title", "title", "route_url").alias("program_type"),
        C.program_tags("body", "route_url").alias("program_tags"), C.modality("body", "route_url").alias("modality"),
        null("string").alias("degree_track"), null("string").alias("audience_type"),
        "faq_category", "question", "answer", "course_name", "course_type", "faculty_name", "academic_title", "industry_role",
        T.keywords(F.concat_ws(" ", "page_title", "title", "body")).alias("keywords"), T.titlecase("body").alias("entities"), T.dates("body").alias("dates"),
        T.emails("body").alias("emails"), F.array_distinct(F.concat("_courses", T.course_names("body"))).alias("course_names"), T.money("body").alias("tuition_mentions"),
        F.coalesce("retrieval_priority", F.lit(50)).alias("retrieval_priority"), F.lit(False).alias("is_chunk"), null("string").alias("duplicate_of"),
        F.current_timestamp().alias("last_scraped_at"), F.col("last_modified").alias("page_last_modified"),
        (F.col("body") != "").alias("content_valid"),
    )


def extract_sections(pages: DataFrame, min_text_length: int = 120) -> DataFrame:
    return assemble(read_sections(pages, min_text_length))


def invalid_sections(sections: DataFrame) -> DataFrame:
    """Sections without content or with a label that isn't one of the declared values: none, if all is well."""
    declared = {"content_type": rules.CONTENT_TYPES, "program_type": rules.PROGRAM_TYPES, "course_type": rules.COURSE_TYPE_NAMES}
    wrong = ~F.col("content_valid")
    for name, values in declared.items():
        wrong = wrong | (F.col(name).isNotNull() & ~F.col(name).isin(*values))
    return sections.where(wrong)


def extract_links(pages: DataFrame, base: str = "url", *, domains: tuple[str, ...] | None = rules.ALLOWED_DOMAINS, path_words: tuple[str, ...] = rules.ALLOWED_PATH_WORDS) -> DataFrame:
    """``pages`` (html and the column ``base``) exploded: link, link_seq. Normalised, distinct, no binaries, allowed ones.

    ``domains=None`` allows any.
    """

    @F.pandas_udf("array<string>")
    def hrefs(html: pd.Series, at: pd.Series) -> pd.Series:
        found: Iterator[list[str | None]] = ([U.normalized(b, h) for h in H.links(x)] for x, b in zip(html, at, strict=True))
        return pd.Series([list(dict.fromkeys(u for u in urls if u)) for urls in found])

    out = pages.select(*(c for c in pages.columns if c != "html"), F.posexplode(hrefs("html", base)).alias("link_seq", "link"))
    good: Column = ~U.has_skipped_suffix("link")
    return out.where(good if domains is None else good & U.is_allowed_url("link", domains, path_words))
