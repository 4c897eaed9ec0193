"""Rule tables: vocabularies and ordered categories that the classifiers are made from.

Every table is a default; functions that use one take another in its place.
"""

from __future__ import annotations

# Word lists, patterns and limits that results depend on. Matching is by lower-case
# substring unless a function says otherwise.

STOPWORDS = (
    "and", "applied", "are", "chicago", "course", "courses", "data", "for", "from", "has", "have", "into", "master", "masters", "our",
    "program", "science", "students", "that", "the", "their", "this", "university", "will", "with", "you", "your",
)

UI_JUNK = ("Learn More", "Read More", "Click Here", "Apply today", "Loading…", "Share this", "Back to top")

DATE_PATTERN = (
    r"\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\s+\d{1,2},\s+\d{4}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\bAutumn\s+\d{4}\b"
)
EMAIL_PATTERN = r"[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+"
MONEY_PATTERN = r"\$\s?\d[\d,]*(?:\.\d+)?"
TITLECASE_PATTERN = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,4}\b"
COURSE_NAMES = (
    "Machine Learning I{0,2}", "Time Series Analysis and Forecasting", "Statistical Models for Data Science",
    "Data Engineering Platforms for Analytics", "Big Data and Cloud Computing", "Leadership and Consulting for Data Science",
    "Data Science Capstone Project", "Python for Data Science", "R for Data Science", "Advanced Linear Algebra for Machine Learning",
    r"Generative AI[:\w\s\-]*", "Machine Learning Operations", "Data Visualization Techniques",
)

IN_PERSON = ("in-person", "in person", "nbc tower")
#: Tag: words any of which gives it, in the order in which tags are listed.
MODALITIES = {
    "online": ("online",),
    "in_person": (*IN_PERSON, "gleacher"),
    "full_time": ("full-time", "full time"),
    "part_time": ("part-time", "part time"),
}
PROGRAM_TAGS = {
    "mba_ms": ("mba", "booth", "joint degree"),
    "thesis_track": ("thesis", "18-course", "18 course", "2-year"),
    "stem_opt": ("stem", "opt"),
    "international": ("visa", "international"),
}

COURSE_SUBJECTS = (
    "machine learning", "time series", "statistical models", "data engineering", "generative ai", "nlp", "visualization",
    "capstone project", "linear algebra", "python for data science", "r for data science",
)
#: Content types that follow from a word anywhere, in order, after the types that need more than a word.
LATE_CONTENT_TYPES = {
    "admissions": ("admission", "apply", "application", "recommendation", "transcript", "gre", "gmat"),
    "curriculum": ("curriculum", "core courses", "elective", "foundational", "course progression"),
    "faculty": ("faculty", "instructor", "professor"),
    "career": ("career", "employment", "outcome", "internship", "employer"),
    "program_format": ("online", "in-person", "full-time", "part-time", "program format"),
    "mba_ms": ("mba", "booth", "joint degree"),
}

FAQ_CATEGORIES = {
    "Application Process": ("admission", "apply", "recommend", "transcript", "gre", "gmat", "deadline"),
    "International Students": ("visa", "toefl", "ielts", "international", "opt", "stem", "cpt"),
    "Online Program": ("online program", "synchronous", "asynchronous", "immersion weekend"),
    "In-Person Program": ("in-person program", "nbc tower", "gleacher"),
    "MBA/MS Program": ("mba", "booth", "joint degree"),
    "2-Year Thesis Track": ("2-year", "thesis track", "18 course", "18-course", "thesis"),
    "Curriculum": ("course", "elective", "core", "curriculum", "capstone"),
    "Tuition & Financial Aid": ("tuition", "fees", "scholarship", "financial aid", "cost"),
    "Career": ("career", "job", "employer", "internship", "placement"),
}
COURSE_TYPES = {
    "career_seminar": ("career seminar",),
    "independent_study": ("independent study",),
    "foundational": ("foundational", "noncredit", "pre-quarter"),
    "capstone": ("capstone",),
    "core": ("core course", "required course"),
    "elective": ("elective", "sample elective"),
}

NOT_IN_NAMES = (
    "course", "program", "curriculum", "apply", "tuition", "capstone", "career", "overview", "faculty", "instructor", "staff", "online",
    "in-person", "mba",
)
CTA_QUESTIONS = ("ready to apply", "want more information", "have questions", "start your application", "learn more", "get in touch")
CTA_ANSWERS = ("start my app", "schedule an appointment", "get in touch", "submit your request", "download the pdf", "learn more")
NOISE_LINES = (
    "master's in applied data science", "learn more", "read more", "start my app", "apply today", "schedule an appointment",
    "university of chicago", "data science institute",
)
COURSE_TITLES = (
    "machine learning", "data engineering", "time series", "statistical models", "leadership and consulting", "capstone project",
    "generative ai", "nlp", "bayesian", "reinforcement learning", "mlops", "machine learning operations", "data visualization",
    "marketing analytics", "computer vision", "supply chain", "quantitative finance", "real time intelligent",
    "optimization and simulation", "healthcare", "causal models", "advanced machine learning", "applied generative", "next-gen nlp",
    "deep reinforcement", "r for data science", "python for data science", "introduction to statistical", "advanced linear algebra",
    "cloud computing", "big data", "data science capstone", "data science for",
)
NOT_COURSE_TITLES = (
    "application", "deadline", "tuition", "financial aid", "program overview", "start your application", "schedule", "faculty", "staff",
)
COURSE_LABELS = (
    "core course", "elective course", "sample elective", "capstone", "foundational", "noncredit", "career seminar", "independent study",
)
ACADEMIC_ROLES = ("professor", "instructor", "lecturer", "clinical", "adjunct", "senior")

NO_COURSE_PATHS = ("/news/", "/events/", "/capstone-projects", "/capstone-project-archive")
COURSE_PATHS = (
    "/ms-in-applied-data-science/course-progressions", "/ms-in-applied-data-science/in-person-program",
    "/ms-in-applied-data-science/online-program",
)
REMOVED_TAGS = ("nav", "footer", "script", "style", "noscript", "form", "svg", "aside")
REMOVED_CLASSES = ("screen-reader-text", "breadcrumb", "breadcrumbs", "share", "social", "menu", "navbar", "site-footer", "site-header")
REMOVED_CLASS_PARTS = ("menu", "nav", "footer", "sidebar", "breadcrumb", "share", "social", "cookie")
#: Faculty cards: (tag, class, part of the class attribute), the first that matches anything.
CARD_SELECTORS = (
    ("div", "people-grid__item", None), ("article", None, None), ("div", None, "person"), ("div", None, "faculty"),
    ("div", None, "instructor"), ("div", None, "team-member"),
)

#: Beginnings of query parameters that say where a visitor came from. Fixed value.
TRACKED_PARAMETERS = ("utm_",)
SKIPPED_SUFFIXES = (
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".zip", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".mp4",
)
ALLOWED_DOMAINS = ("datascience.uchicago.edu",)
ALLOWED_PATH_WORDS = (
    "ms-in-applied-data-science", "masters-programs", "faculty", "admissions", "capstone", "faqs", "online", "in-person", "curriculum",
    "courses", "course-progressions", "instructors-staff", "apply", "how-to-apply", "tuition", "our-students", "career-outcomes",
    "international-students",
)

METADATA_SCALARS = (
    "url", "canonical_url", "source", "page_title", "section_title", "content_type", "program_type", "chunk_index", "chunk_count",
    "is_chunk", "last_scraped_at", "page_last_modified", "retrieval_priority", "faq_category", "question", "course_name", "course_type",
    "faculty_name", "academic_title", "industry_role", "token_count", "char_count",
)
METADATA_LISTS = ("program_tags", "modality", "keywords", "dates", "emails", "course_names")

SOURCE_NAME = "official_uchicago_site"
CONTENT_TYPES = (
    "overview", "admissions", "faq", "tuition", "deadline", "curriculum", "course", "faculty", "faculty_bio", "career", "capstone", "visa",
    "stem_opt", "program_format", "mba_ms", "contact", "unknown",
)
PROGRAM_TYPES = ("online", "in_person", "mba_ms", "thesis_track", "general", "unknown")
COURSE_TYPE_NAMES = ("core", "elective", "capstone", "foundational", "career_seminar", "independent_study", "unknown")
