"""Sections of a page by loops over its tree: what the relational reading is held against."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lexiloom.functions import rules
from lexiloom.functions.html import HEADINGS, Node, parse

_JUNK = [re.compile(rf"\b{p}\b", re.IGNORECASE) for p in rules.UI_JUNK]


def clean(t: str) -> str:
    t = " ".join((t or "").replace("\u200b", "").split())
    for phrase in _JUNK:
        t = phrase.sub("", t)
    return " ".join(t.split())


def strings(node: Node, skip: Node | None = None) -> Iterator[str]:
    todo = list(reversed(node.children))
    while todo:
        one = todo.pop()
        if isinstance(one, str):
            yield one
        elif one is not skip:
            todo += reversed(one.children)


def text(node: Node, skip: Node | None = None) -> str:
    return clean(" ".join(s.strip() for s in strings(node, skip) if s.strip()))


def following(node: Node) -> Iterator[Node]:
    beside = node.parent.children if node.parent else []
    at = next((k for k, c in enumerate(beside) if c is node), len(beside))
    return (c for c in beside[at + 1 :] if isinstance(c, Node))


def remove(node: Node) -> None:
    if node.parent:
        node.parent.children = [c for c in node.parent.children if c is not node]
        node.parent = None


def remove_noise(root: Node) -> Node:
    """Without navigation, scripts, forms and the like, by tag, class and hidden state."""
    for node in list(root.walk()):
        kinds = node.attrs.get("class", "").split()
        marked = any(part in " ".join(kinds).lower() for part in rules.REMOVED_CLASS_PARTS)
        if node.tag in rules.REMOVED_TAGS or node.attrs.get("aria-hidden") == "true" or marked or not set(kinds).isdisjoint(rules.REMOVED_CLASSES):
            remove(node)
    return root


def page_title(root: Node, given: str | None) -> str:
    for heading in root.all("h1")[:1]:
        if said := text(heading):
            return said
    if given:
        return clean(given)
    return next((text(t) for t in root.all("title")), "Untitled Page")


def heading_path(root: Node, heading: Node) -> list[str]:
    """The nearest earlier heading of each higher level, then this one."""
    level, found = HEADINGS.get(heading.tag, 7), {}
    for node in root.walk():
        if node is heading:
            break
        if (own := HEADINGS.get(node.tag)) and own < level and (said := text(node)):
            found[own] = said
    return [found[k] for k in sorted(found)] + [text(heading)]


def below(heading: Node) -> str:
    """The text of the elements after a heading, up to the next one of its level or higher."""
    level, parts = HEADINGS.get(heading.tag, 6), []
    for node in following(heading):
        if HEADINGS.get(node.tag, 7) <= level:
            break
        parts.append(text(node))
    return clean(" ".join(p for p in parts if p))


def _distinct(sections: list[dict]) -> list[dict]:
    first: dict[str, dict] = {}
    for s in sections:
        first.setdefault(f"{s['title']}|{s['content']}".lower(), s)
    return list(first.values())


def generic_sections(root: Node, least: int = 120, longest_title: int = 160) -> list[dict]:
    headings = root.all("h1", "h2", "h3", "h4")
    if not headings:
        body = text(root)
        return [{"title": "Main Content", "content": body, "heading_path": ["Main Content"], "heading_level": 1}] if len(body) >= least else []
    out = []
    for h in headings:
        title, body = text(h), below(h)
        if title and len(title) <= longest_title and len(body) >= least:
            out.append({"title": title, "content": body, "heading_path": heading_path(root, h), "heading_level": HEADINGS[h.tag], "anchor_id": h.attrs.get("id")})
    return _distinct(out)


def _has(t: str, words: tuple[str, ...]) -> bool:
    return any(w in t for w in words)


def is_question(t: str) -> bool:
    return "?" in t and 18 <= len(t) <= 260 and not _has(t.lower(), rules.CTA_QUESTIONS)


def _is_cta(question: str, answer: str) -> bool:
    return len(answer) < 180 and _has(f"{question} {answer}".lower(), rules.CTA_ANSWERS)


def category(table: dict[str, tuple[str, ...]], t: str, default: str) -> str:
    return next((name for name, words in table.items() if _has(t.lower(), words)), default)


def answer_to(tag: Node) -> str:
    """The answer that belongs to a question's element: by definition list, details, control, position or container."""
    if tag.tag == "dt" and (found := next((n for n in following(tag) if n.tag == "dd"), None)):
        return text(found)
    if tag.tag == "summary" and tag.parent and tag.parent.tag == "details":
        return text(tag.parent, next(iter(tag.parent.all("summary"))))
    if (target := tag.attrs.get("aria-controls")) and tag.parent:
        if found := next((n for n in tag.parent.walk() if n.attrs.get("id") == target), None):
            return text(found)
    parts = []
    for node in following(tag):
        said = text(node)
        if not said:
            continue
        if node.tag in ("h2", "h3", "h4", "h5", "dt", "summary") or (node.tag == "button" and "?" in said):
            break
        parts.append(said)
    if not parts and tag.parent:
        # A clone of the container would have the container itself as a first match.
        first = tag.parent if tag.parent.tag == tag.tag else next(iter(tag.parent.all(tag.tag)), None)
        rest = "" if first is tag.parent else text(tag.parent, first)
        if rest.lower() != text(tag).lower():
            parts.append(rest)
    return clean(" ".join(parts))


def _faq(question: str, answer: str) -> dict:
    kind = category(rules.FAQ_CATEGORIES, f"{question} {answer}", "General")
    return {
        "title": question[:140], "content": f"Question: {question}\nAnswer: {answer}", "faq_category": kind, "question": question, "answer": answer,
        "heading_path": ["FAQs", kind, question], "heading_level": 4, "retrieval_priority": 95,
    }


def faq_sections(root: Node, shortest_answer: int = 25) -> list[dict]:
    found: dict[str, dict] = {}
    for tag in root.all("h2", "h3", "h4", "h5", "dt", "button", "summary"):
        question = text(tag)
        if not is_question(question) or question.lower() in found:
            continue
        answer = answer_to(tag)
        if len(answer) >= shortest_answer and not _is_cta(question, answer):
            found[question.lower()] = _faq(question, answer)
    return _distinct(list(found.values()) or _faq_lines(root, shortest_answer))


def _faq_lines(root: Node, shortest_answer: int, longest: int = 7) -> list[dict]:
    """Questions among the lines of visible text; each is answered by the lines up to the next."""
    shown = "\n".join(s.strip() for s in strings(root) if s.strip())
    lines = [line for line in map(clean, shown.split("\n")) if len(line) > 3]
    asked = [k for k, line in enumerate(lines) if is_question(line)]
    out = []
    for at, upto in zip(asked, [*asked[1:], None], strict=True):
        answer = clean(" ".join(x for x in lines[at + 1 : at + 1 + longest if upto is None else upto] if not _has(x.lower(), rules.NOISE_LINES)))
        if len(answer) >= shortest_answer and not _is_cta(lines[at], answer):
            out.append(_faq(lines[at], answer))
    return out


def is_course_title(lower: str) -> bool:
    return 8 <= len(lower) <= 140 and not lower.endswith("?") and not _has(lower, rules.NOT_COURSE_TITLES) and _has(lower, rules.COURSE_TITLES)


def course_sections(root: Node, shortest: int = 40) -> list[dict]:
    kind, path, found = "elective", ["Course Progressions"], {}
    for h in root.all("h2", "h3", "h4"):
        name = text(h)
        lower = name.lower()
        if _has(lower, rules.COURSE_LABELS) and len(lower) < 80:
            kind, path = category(rules.COURSE_TYPES, name, "elective"), heading_path(root, h)
        elif is_course_title(lower) and lower not in found:
            body = below(h)
            found[lower] = {
                "title": name, "content": f"Course: {name}\nCourse type: {kind}\n\n{body if len(body) >= shortest else name}", "course_name": name,
                "course_type": kind, "heading_path": [*path, name], "heading_level": HEADINGS[h.tag], "anchor_id": h.attrs.get("id"), "retrieval_priority": 90,
            }
    return _distinct(list(found.values()))


def is_person_name(t: str) -> bool:
    return 4 <= len(t) <= 80 and "?" not in t and 2 <= len(t.split()) <= 6 and t[0].isupper() and not _has(t.lower(), rules.NOT_IN_NAMES)


def role_line(line: str) -> tuple[str, str]:
    if ";" in line:
        academic, _, industry = line.partition(";")
        return academic.strip(), industry.strip()
    return (line, "") if _has(line.lower(), rules.ACADEMIC_ROLES) else ("", line)


def _faculty(name: str, paragraphs: list[str], shortest: int = 60) -> dict | None:
    academic, industry = role_line(paragraphs[0] if paragraphs else "")
    labelled = (("Faculty: ", name), ("Academic role: ", academic), ("Industry role: ", industry), ("", clean(" ".join(paragraphs[1:]))))
    content = "\n".join(label + value for label, value in labelled if value)
    if len(content) < shortest:
        return None
    return {
        "title": name, "content": content, "faculty_name": name, "academic_title": academic, "industry_role": industry,
        "heading_path": ["Faculty, Instructors & Staff", name], "retrieval_priority": 80,
    }


def faculty_sections(root: Node) -> list[dict]:
    cards: list[Node] = []
    for tag, kind, part in rules.CARD_SELECTORS:
        cards = [n for n in root.all(tag) if (kind is None or kind in n.attrs.get("class", "").split()) and (part is None or part in n.attrs.get("class", ""))]
        if cards:
            break
    found = []
    for card in cards:
        name = next((text(n) for n in card.all("h2", "h3", "h4", "strong")), "")
        if is_person_name(name):
            found.append(_faculty(name, [t for p in card.all("p") if (t := text(p))]))
    if not any(found):
        for h in root.all("h2", "h3", "h4"):
            paragraphs = []
            for node in following(h):
                if node.tag in ("h2", "h3", "h4"):
                    break
                paragraphs.append(text(node))
            if is_person_name(text(h)) and (paragraphs := [p for p in paragraphs if p]):
                found.append(_faculty(text(h), paragraphs))
    return _distinct([f for f in found if f])


#: Special pages: words in the address, words in the title, and what reads them; the first that fits.
_ROUTES = (
    (("faq",), ("faq",), faq_sections),
    (("course-progressions",), ("course progression",), course_sections),
    (("instructors-staff",), ("faculty", "instructor"), faculty_sections),
)


def page_sections(html: str | None, route_url: str, given_title: str | None = None, least: int = 120) -> tuple[str, list[dict]]:
    """(page title, sections in document order). ``route_url`` is the address that was asked for."""
    root = remove_noise(parse(html))
    title, link = page_title(root, given_title), route_url.lower()
    titles = f"{title} {given_title or ''}".lower()
    read = next((f for urls, words, f in _ROUTES if _has(link, urls) or _has(titles, words)), None)
    found = read(root) if read else []
    if not found:
        courses = course_sections(root) if _has(link, rules.COURSE_PATHS) and not _has(link, rules.NO_COURSE_PATHS) else []
        found = courses + generic_sections(root, least)
    return title, found
