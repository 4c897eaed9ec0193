"""DuckDB SQL for the registered queries, put together from fragments that state the same rules anew."""

from __future__ import annotations

from ..functions import rules

_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_LEX = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+|[^\p{L}\p{M}\p{Nd}\p{Pc}\s]"
#: Unicode's word characters, letters in circles and joiners among them.
_WORD = r"\p{L}\p{M}\p{Nl}\p{Nd}\p{Pc}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
_WORD_LEX = rf"[{_WORD}]+|[^{_WORD}{_WS[1:-2]}]"
_EMAIL = rf"[{_WORD}.+\-]+@[{_WORD}\-]+(?:\.[{_WORD}\-]+)+"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def clean(x: str) -> str:
    out = squeeze(f"replace(coalesce({x}, ''), chr(8203), '')")
    for phrase in rules.UI_JUNK:
        out = f"regexp_replace({out}, {lit(rf'(?i)\b{phrase}\b')}, '', 'g')"
    return squeeze(out)


def tokens(x: str, lexeme: str = _LEX) -> str:
    return f"greatest(1, floor(len(regexp_extract_all({x}, '{lexeme}')) / 0.75)::INT)"


def sentences(cleaned: str) -> str:
    cut = rf"string_split(regexp_replace({cleaned}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: trim(s)), lambda s: s <> '')"


def ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def any_of(blob: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({blob}, {lit(w)})" for w in words) + ")"


def table(blob: str, categories: dict[str, tuple[str, ...]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(blob, w)} THEN {lit(k)}" for k, w in categories.items()) + f" ELSE {lit(default)} END"


def tag_list(blob: str, *tables: dict[str, tuple[str, ...]]) -> str:
    each = ", ".join(f"CASE WHEN {any_of(blob, w)} THEN {lit(tag)} END" for t in tables for tag, w in t.items())
    return f"array_to_string(list_filter([{each}], lambda t: t IS NOT NULL), ',')"


_DOCS = f"WITH d AS (SELECT *, {clean('text')} AS body FROM documents)"
_SENT = f"{_DOCS}, s AS (SELECT *, {sentences('body')} AS sents FROM d)"


def _content_type(page_title: str, section_title: str, url: str) -> str:
    """The type of ``body`` by rules, those for the address included."""
    body = "lower(body[1:2500])"
    both, link = f"lower({page_title} || ' ' || {section_title} || ' ' || {url}) || ' ' || {body}", f"lower({url})"
    course = f"(contains({body}, 'course:') OR contains({link}, 'course-progressions') OR {any_of(f'lower({section_title})', rules.COURSE_SUBJECTS)})"
    return f"""CASE
  WHEN contains({link}, '/faqs') OR starts_with({body}, 'question:') OR starts_with({body}, 'q:') THEN 'faq'
  WHEN {any_of(both, ('tuition', 'financial aid', 'fees'))} OR regexp_matches({both}, '\\$\\s?[0-9]') THEN 'tuition'
  WHEN {any_of(both, ('deadline', 'application round', 'apply by'))} THEN 'deadline'
  WHEN contains({both}, 'stem') AND contains({both}, 'opt') THEN 'stem_opt'
  WHEN {any_of(both, ('visa', 'toefl', 'ielts', 'cpt', 'international student'))} THEN 'visa'
  WHEN contains({both}, 'capstone') THEN 'capstone'
  WHEN {course} AND {any_of(both, rules.COURSE_SUBJECTS)} THEN 'course'
  WHEN {course} THEN 'curriculum'
  {" ".join(f"WHEN {any_of(both, w)} THEN {lit(k)}" for k, w in rules.LATE_CONTENT_TYPES.items())}
  WHEN length({body}) > 250 THEN 'overview' ELSE 'unknown' END"""


def _program_type(heads: str) -> str:
    short = f"lower({heads} || ' ' || body[1:1200])"
    return f"""CASE WHEN {any_of(short, rules.PROGRAM_TAGS['mba_ms'])} THEN 'mba_ms' WHEN {any_of(short, rules.PROGRAM_TAGS['thesis_track'])} THEN 'thesis_track'
  WHEN contains({short}, 'online') AND NOT {any_of(short, rules.IN_PERSON)} THEN 'online'
  WHEN {any_of(short, rules.IN_PERSON)} AND NOT contains({short}, 'online') THEN 'in_person' ELSE 'general' END"""


def _fallback(heads: str) -> str:
    short = f"lower({heads} || ' ' || body[1:1200])"
    return f"""CASE WHEN kind <> 'unknown' THEN kind WHEN {any_of(short, ('/events/', 'q&a', 'admission', 'apply'))} THEN 'admissions'
  WHEN contains({short}, '/news/') AND {any_of(short, ('staff', 'student', 'alumni', 'speaker'))} THEN 'career'
  WHEN {any_of(short, ('speaker', 'current masters', 'enrollment management'))} THEN 'admissions'
  WHEN {any_of(short, ('faculty', 'instructor', 'staff'))} THEN 'faculty' ELSE 'overview' END"""


_CONTENT_TYPE, _PROGRAM_TYPE, _FALLBACK = _content_type("source", "lang", "''"), _program_type("source || ' ' || lang || ' '"), _fallback("source || ' ' || lang || ' '")


def _fold(before: str, texts: str) -> str:
    """The chunks c (doc_id, chunk_index, chunk_count, content) of ``texts``, a table expression with doc_id and body."""
    return _FOLD.replace("@BEFORE@", before).replace("@TEXTS@", texts)


_FOLD = f"""WITH RECURSIVE @BEFORE@ d AS (@TEXTS@),
s0 AS (SELECT doc_id, body, {sentences('body')} AS ss, {tokens('body')} AS total FROM d),
s AS (SELECT *, list_transform(ss, lambda x: {tokens('x')}) AS ks FROM s0 WHERE total > 690),
f AS (
  SELECT doc_id, 0 AS i, []::VARCHAR[] AS done, []::VARCHAR[] AS open, 0 AS n FROM s
  UNION ALL
  SELECT f.doc_id, i + 1,
    CASE WHEN ks[i + 1] > 690 THEN list_concat(CASE WHEN len(open) > 0 THEN list_append(done, array_to_string(open, ' ')) ELSE done END,
           list_transform(range(0, len(string_split(ss[i + 1], ' ')), 379), lambda p: array_to_string(string_split(ss[i + 1], ' ')[p + 1 : p + 379], ' ')))
         WHEN len(open) > 0 AND n + ks[i + 1] > 690 THEN list_append(done, array_to_string(open, ' ')) ELSE done END,
    CASE WHEN ks[i + 1] > 690 THEN [] WHEN len(open) > 0 AND n + ks[i + 1] > 690 THEN [open[-1], ss[i + 1]] ELSE list_append(open, ss[i + 1]) END,
    CASE WHEN ks[i + 1] > 690 THEN 0 WHEN len(open) > 0 AND n + ks[i + 1] > 690 THEN ks[i] + ks[i + 1] ELSE n + ks[i + 1] END
  FROM f JOIN s ON f.doc_id = s.doc_id WHERE i < len(ss)),
packed AS (SELECT f.doc_id, CASE WHEN len(open) > 0 THEN list_append(done, array_to_string(open, ' ')) ELSE done END AS parts FROM f JOIN s ON f.doc_id = s.doc_id WHERE i = len(ss)),
all_parts AS (
  SELECT doc_id, parts FROM packed UNION ALL SELECT doc_id, [body] FROM s0 WHERE total <= 690),
c AS (SELECT doc_id, unnest(range(0, len(parts)))::INT AS chunk_index, len(parts)::INT AS chunk_count, unnest(parts) AS content FROM all_parts)"""
_CHUNKS = _fold("", f"SELECT doc_id, {clean('text')} AS body FROM documents")

_URL = "rtrim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])utm_[^&]*', '\\1', 'g'), '&+', '&', 'g'), '\\?&?$|&$', ''), '/')"
_UNESCAPE = "replace(replace(replace(replace({x}, '&quot;', '\"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;', '&')"
_PAGE = f"""WITH p AS (SELECT page_id, {clean(_UNESCAPE.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))} AS title,
  {clean(_UNESCAPE.format(x="regexp_replace(regexp_extract(html, '(?s)</h1>(.*?)</article>', 1), '<[^>]*>', ' ', 'g')"))} AS body FROM pages)"""

_SECTIONS = f"""{_PAGE.removeprefix('WITH ')}, u AS (SELECT page_id, {_URL} AS url FROM pages),
s9 AS (SELECT page_id AS page_seq, url, title, body, sha256(lower(url || '|' || title || '|' || body)) AS section_id FROM p JOIN u USING (page_id) WHERE length(body) >= 120 AND length(title) BETWEEN 1 AND 160
  QUALIFY row_number() OVER (PARTITION BY url, sha256(lower(body)) ORDER BY page_id) = 1),"""
_INGEST = f"""{_fold(_SECTIONS, "SELECT page_seq AS doc_id, body FROM s9")},
k AS (SELECT *, {_content_type("title", "title", "url")} AS kind FROM s9),
l AS (SELECT *, {_fallback("url || ' ' || title || ' ' || title")} AS content_type, {_program_type("title || ' ' || title || ' ' || url")} AS program_type FROM k),
w1 AS (SELECT page_seq, lower(unnest(regexp_extract_all(title || ' ' || title || ' ' || body, '[A-Za-z][A-Za-z\\-]{{2,}}'))) AS word FROM s9),
w2 AS (SELECT page_seq, word, row_number() OVER (PARTITION BY page_seq ORDER BY count(*) DESC, word) AS nth FROM w1 WHERE length(word) >= 4 AND word NOT IN ({', '.join(map(lit, rules.STOPWORDS))}) GROUP BY page_seq, word),
w3 AS (SELECT page_seq, string_agg(word, ',' ORDER BY nth) AS keywords FROM w2 WHERE nth <= 18 GROUP BY page_seq),
o AS (SELECT l.page_seq, 0 AS section_seq, chunk_index, chunk_count, CASE WHEN {tokens('body')} > 690 THEN sha256(lower(section_id || '|chunk|' || chunk_index || '|' || content)) ELSE section_id END AS doc_id,
  url, title AS section_title, content_type, program_type, {tokens('content')} AS token_count, coalesce(keywords, '') AS keywords, content FROM l JOIN c ON c.doc_id = l.page_seq LEFT JOIN w3 USING (page_seq))
SELECT * EXCLUDE (content) FROM o QUALIFY row_number() OVER (PARTITION BY sha256(lower(content)) ORDER BY page_seq, section_seq, chunk_index) = 1"""

_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"
_ASKED = "WITH q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0)"
_HITS = f"""{_ASKED}, h0 AS (SELECT q.query_id, e.vec_id AS id, {_COS} AS score, e.label FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM h0)"""
_DISTINCT = f"{_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label, id % 3 ORDER BY score DESC, id) AS nth FROM h WHERE rank <= 20)"



def _words(x: str) -> str:
    return rf"regexp_extract_all(lower(coalesce({x}, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]+')"


_SAID = "t AS (SELECT conv_id AS query_id, coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'user'), '') AS expected, coalesce(string_agg(text, ' ' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS answer FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)"


def _sets(x: str) -> str:
    """The sets of words of the sentences of a text."""
    return f"list_filter(list_transform({sentences(clean(x))}, lambda s: list_distinct({_words('s')})), lambda s: len(s) > 0)"


def _covered(a: str, by: str) -> str:
    return f"coalesce(list_max(list_transform({by}, lambda y: len(list_intersect({a}, y)) / len({a}))), 0.0)"


def _overlap(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


_BM25 = f"""{_DISTINCT}, w AS (SELECT doc_id, text, {_words('text')} AS ws FROM documents),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS word FROM w) GROUP BY word),
z AS (SELECT count(*) AS n_all, avg(len(ws)) AS mean FROM w),
g AS (SELECT k.query_id, k.id, k.score, a.ws, a.text FROM k JOIN w a ON a.doc_id = k.id JOIN w b ON b.doc_id = k.query_id WHERE nth = 1 AND score >= 0.35),
qw0 AS (SELECT query_id, unnest(list_distinct(w.ws)) AS word FROM (SELECT DISTINCT query_id FROM g) JOIN w ON doc_id = query_id),
qw AS (SELECT query_id, word, ln(1 + (n_all - n + 0.5) / (n + 0.5)) AS weight FROM qw0 JOIN df USING (word), z),
tf AS (SELECT query_id, id, word, long, count(*) AS times FROM (SELECT query_id, id, len(ws) AS long, unnest(ws) AS word FROM g) GROUP BY ALL),
sc AS (SELECT query_id, id, sum(weight * times * 2.2 / (times + 1.2 * (0.25 + 0.75 * long / mean))) AS s FROM tf JOIN qw USING (query_id, word), z GROUP BY ALL),
f AS (SELECT g.*, round(coalesce(s, 0), 9) AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 9) DESC, score DESC, id)::INT AS rank FROM g LEFT JOIN sc USING (query_id, id) QUALIFY rank <= 5)"""
_EXTRACTIVE = f"""{_BM25}, l0 AS (SELECT query_id, rank, {sentences(clean('text'))} AS ss FROM f),
l1 AS (SELECT query_id, rank, unnest(ss) AS sentence, unnest(range(0, len(ss))) AS place FROM l0),
l AS (SELECT *, list_distinct({_words('sentence')}) AS set FROM l1),
r AS (SELECT query_id, rank, place, sum(weight) AS s FROM (SELECT query_id, rank, place, unnest(set) AS word FROM l) JOIN qw USING (query_id, word) GROUP BY ALL),
v AS (SELECT l.*, round(s / whole, 9) AS relevance FROM l JOIN r USING (query_id, rank, place) JOIN (SELECT query_id, sum(weight) AS whole FROM qw GROUP BY 1) USING (query_id)
  WHERE round(s / whole, 9) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(s / whole, 9) DESC, rank, place) <= 20),
p1 AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * relevance, 9) DESC, rank, place) = 1),
v2 AS (SELECT v.*, {_overlap('v.set', 'p1.set')} AS near FROM v JOIN p1 USING (query_id) WHERE NOT (v.rank = p1.rank AND v.place = p1.place)),
p2 AS (SELECT * FROM v2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * relevance - 0.3 * near, 9) DESC, rank, place) = 1),
v3 AS (SELECT v2.* EXCLUDE (near), greatest(v2.near, {_overlap('v2.set', 'p2.set')}) AS near FROM v2 JOIN p2 USING (query_id) WHERE NOT (v2.rank = p2.rank AND v2.place = p2.place)),
p3 AS (SELECT * FROM v3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * relevance - 0.3 * near, 9) DESC, rank, place) = 1),
p AS (SELECT query_id, rank, sentence, 1 AS nth FROM p1 UNION ALL SELECT query_id, rank, sentence, 2 FROM p2 UNION ALL SELECT query_id, rank, sentence, 3 FROM p3)
SELECT query_id, string_agg(sentence || ' [Source ' || rank || ']', ' ' ORDER BY nth) AS said FROM p GROUP BY query_id"""
_ALIGNED = f"""WITH t AS (SELECT *, lag(text) OVER w AS question, first(text) OVER w AS reference, list(text) FILTER (text IS NOT NULL) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, {_sets('question')} AS q, {_sets('text')} AS a, {_sets('reference')} AS r, list_transform(coalesce(before, []), lambda c: {_sets('c')}) AS cs FROM t WHERE role = 'assistant'),
g AS (SELECT *, list_transform(cs, lambda c: len(list_filter(r, lambda x: {_covered('x', 'c')} >= 0.5)) > 0) AS good FROM s)
SELECT conv_id AS query_id, turn,
  round(CASE WHEN len(a) > 0 THEN len(list_filter(a, lambda x: {_covered('x', 'flatten(cs)')} >= 0.5)) / len(a) ELSE 0.0 END, 6) AS faithfulness,
  round(CASE WHEN len(q) > 0 THEN list_sum(list_transform(q, lambda x: {_covered('x', 'a')})) / len(q) ELSE 0.0 END, 6) AS response_relevancy,
  round(CASE WHEN len(list_filter(good, lambda x: x)) > 0 THEN list_sum(list_transform(good, lambda x, i: CASE WHEN x THEN len(list_filter(good[1:i], lambda y: y)) / i ELSE 0.0 END)) / len(list_filter(good, lambda x: x)) ELSE 0.0 END, 6) AS context_precision FROM g"""


def _found(pattern: str, name: str) -> str:
    all_ = f"regexp_extract_all(text, {lit(pattern)})"
    return f"SELECT doc_id, array_to_string({ordered_distinct(all_)}, '|') AS {name} FROM documents WHERE len({all_}) > 0"


_DATES = rules.DATE_PATTERN
_BLOCK = """'[Source ' || rank || ']' || chr(10) || 'URL: Unknown URL' || chr(10) || 'Page title: ' || coalesce(d.source, 'Unknown page') || chr(10)
  || 'Section title: ' || coalesce(d.lang, 'Unknown section') || chr(10) || 'Content type: ' || h.label || chr(10) || chr(10) || coalesce(d.text, '')"""

_NAMED = "['Machine Learning II', 'Machine Learning I', 'Time Series Analysis and Forecasting', 'Python for Data Science', 'Data Visualization Techniques']"

ORACLES: dict[str, str] = {
    "token_stats_by_lang": f"{_DOCS} SELECT lang, count(*) AS n_docs, sum({tokens('body')})::BIGINT AS n_tokens, max({tokens('body')}) AS max_tokens, round(avg({tokens('body')}), 6) AS mean_tokens FROM d GROUP BY lang",
    "clean_text": f"{_DOCS} SELECT doc_id, body AS content_clean FROM d",
    "token_count": f"SELECT doc_id, {tokens('text')} AS token_count FROM documents",
    "sentence_count": f"{_SENT} SELECT doc_id, len(sents)::INT AS n_sentences FROM s",
    "summary": f"{_SENT} SELECT doc_id, rtrim((CASE WHEN len(sents) > 0 THEN array_to_string(sents[1:2], ' ') ELSE body END)[1:420]) AS summary FROM s",
    "bullets": "WITH l AS (SELECT doc_id, list_transform(regexp_split_to_array(text, '[\\n\\r]+'), lambda x: trim(x, ' -•' || chr(9))) AS lines FROM documents), "
    f"b AS (SELECT doc_id, list_transform(list_filter(lines, lambda x: length(x) BETWEEN 8 AND 220), lambda x: {clean('x')}) AS bs FROM l) SELECT doc_id, array_to_string({ordered_distinct('bs')}[1:12], '|') AS bullets FROM b",
    "doc_hash": "SELECT doc_id, sha256(text) AS hash FROM documents",
    "keywords_top18": "WITH w AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z\\-]{2,}'))) AS word FROM documents), "
    f"c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) >= 4 AND word NOT IN ({', '.join(map(lit, rules.STOPWORDS))}) GROUP BY ALL) "
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, word)::INT AS rank FROM c QUALIFY rank <= 18",
    "entities_email": _found(r"[\p{L}\p{M}\p{Nd}\p{Pc}.+\-]+@[\p{L}\p{M}\p{Nd}\p{Pc}\-]+(?:\.[\p{L}\p{M}\p{Nd}\p{Pc}\-]+)+", "emails"),
    "entities_date": _found(f"(?i){_DATES}", "dates"),
    "entities_money": _found(rules.MONEY_PATTERN, "money"),
    "dedupe_exact_global": f"WITH f AS (SELECT doc_id, sha256(lower({clean('text')})) AS fp FROM documents) SELECT min(doc_id) AS doc_id, fp AS fingerprint FROM f GROUP BY fp",
    "dedupe_within_source": f"WITH f AS (SELECT doc_id, source, sha256(lower({clean('text')})) AS fp FROM documents) SELECT min(doc_id) AS doc_id, source FROM f GROUP BY source, fp",
    "duplicate_of": f"WITH f AS (SELECT doc_id, source, sha256(lower({clean('text')})) AS fp FROM documents), "
    "g AS (SELECT *, min(doc_id) OVER (PARTITION BY source, fp) AS first_id FROM f) SELECT doc_id, first_id AS duplicate_of FROM g WHERE doc_id <> first_id",
    "dedupe_any_order": f"""WITH RECURSIVE n AS (SELECT doc_id, source, sha256(lower({clean('text')})) AS fp, lower(concat_ws('|', source, lang, coalesce(nullif({clean('text')}, ''), text))) AS key FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY doc_id) AS i FROM n),
f AS (SELECT fp, i, doc_id, source AS last, [key] AS keys, true AS kept FROM o WHERE i = 1
  UNION ALL SELECT o.fp, o.i, o.doc_id, CASE WHEN list_contains(keys, key) THEN last ELSE source END,
    CASE WHEN list_contains(keys, key) OR source IS NOT DISTINCT FROM last THEN keys ELSE list_append(keys, key) END, NOT (list_contains(keys, key) OR source IS NOT DISTINCT FROM last) FROM f JOIN o ON o.fp = f.fp AND o.i = f.i + 1)
SELECT f.doc_id, o.source FROM f JOIN o USING (doc_id) WHERE kept""",
    "chunks": f"{_CHUNKS} SELECT doc_id, chunk_index, chunk_count, {tokens('content')} AS token_count, sha256(content) AS hash FROM c",
    "chunk_stats": f"{_CHUNKS} SELECT (chunk_count > 1) AS is_chunk, count(*) AS n, sum({tokens('content')})::BIGINT AS n_tokens, max({tokens('content')}) AS max_tokens FROM c GROUP BY 1",
    "chunk_dedupe": f"{_CHUNKS} SELECT doc_id, chunk_index FROM c QUALIFY row_number() OVER (PARTITION BY sha256(lower(content)) ORDER BY doc_id, chunk_index) = 1",
    "content_type": f"{_DOCS}, k AS (SELECT *, {_CONTENT_TYPE} AS kind FROM d) SELECT doc_id, kind AS content_type, {_FALLBACK} AS final_type FROM k",
    "program_type": f"{_DOCS} SELECT doc_id, {_PROGRAM_TYPE} AS program_type FROM d",
    "modality_tags": f"{_DOCS} SELECT doc_id, {tag_list('lower(body)', rules.MODALITIES)} AS modality, {tag_list('lower(body)', rules.MODALITIES, rules.PROGRAM_TAGS)} AS program_tags FROM d",
    "faq_category": f"{_DOCS} SELECT doc_id, {table('lower(body)', rules.FAQ_CATEGORIES, 'General')} AS faq_category, {table('lower(body)', rules.COURSE_TYPES, 'elective')} AS course_type FROM d",
    "rule_classifier_generic": "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '***') OR contains(lower(text), ' | ') THEN 'noise' "
    "WHEN contains(lower(text), 'trash') OR contains(lower(text), 'stupid') THEN 'abuse' ELSE 'prose' END AS kind FROM documents",
    "url_normalize": f"SELECT page_id, {_URL} AS url FROM pages",
    "url_allowed": "WITH p AS (SELECT page_id, replace(lower(regexp_extract(url, '^https?://([^/?#]*)', 1)), 'www.', '') AS host, lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS path FROM pages) "
    "SELECT page_id, host IN ('blog.tionsh.example.net', 'thther.example.org', 'cheap-pills.example.com') AND (contains(path, '/fr/') OR contains(path, '/en/') OR contains(path, '/buy')) AS allowed FROM p",
    "crawl_bfs": f"WITH u AS (SELECT min(page_id) AS page_id FROM (SELECT page_id, {_URL} AS address FROM pages) GROUP BY address) SELECT page_id, row_number() OVER (ORDER BY page_id) - 1 AS page_seq, 0 AS depth FROM u",
    "crawl_tree": "SELECT s_suppkey AS page_id, s_suppkey AS page_seq, floor(log2(s_suppkey + 1))::INT AS depth FROM supplier",
    # RE2's \b is ASCII's: words are marked at both ends instead.
    "entities_titlecase": f"WITH m AS (SELECT doc_id, regexp_replace(text, '([\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]+)', chr(1) || '\\1' || chr(2), 'g') AS text FROM documents), "
    f"f AS (SELECT doc_id, list_transform(regexp_extract_all(text, '\\x01[A-Z][a-z]+\\x02(?:{_WS}\\x01[A-Z][a-z]+\\x02){{1,4}}'), lambda x: translate(x, chr(1) || chr(2), '')) AS found FROM m) SELECT doc_id, array_to_string({ordered_distinct('found')}[1:25], '|') AS entities FROM f WHERE len(found) > 0",
    "entities_course": _found(rf"\b(?:{'|'.join(rules.COURSE_NAMES)})\b", "course_names"),
    "dates_and_sums": "SELECT o_orderkey, strftime(o_orderdate, '%B %-d, %Y') || '|' || strftime(o_orderdate, '%-m/%-d/%Y') || '|AUTUMN ' || strftime(o_orderdate, '%Y') AS dates, format('${:,.2f}', o_totalprice) || '|$ 5' AS sums FROM orders",
    "courses_named": f"WITH n AS (SELECT p_partkey, {_NAMED}[p_partkey % 5 + 1] AS a, {_NAMED}[(2 * p_partkey + 1) % 5 + 1] AS b FROM part) SELECT p_partkey, CASE WHEN a = b THEN a ELSE a || '|' || b END AS courses FROM n",
    "faq_pages": f"WITH q AS (SELECT item_id AS page_seq, 'What does item ' || item_id || ' of the set say?' AS question, {clean('text')} AS answer FROM benchmark WHERE length({clean('text')}) >= 25), "
    f"k AS (SELECT *, {table("lower(question || ' ' || answer)", rules.FAQ_CATEGORIES, 'General')} AS faq_category FROM q) "
    "SELECT page_seq, question, sha256(answer) AS answer_hash, faq_category, sha256('Question: ' || question || chr(10) || 'Answer: ' || answer) AS content_hash, 'FAQs|' || faq_category || '|' || question AS path, 95 AS retrieval_priority FROM k",
    "course_pages": """WITH c AS (
  SELECT p_partkey AS page_seq, 'Machine Learning for a ' || p_name AS course_name, 'core' AS course_type, p_brand || ' of the kind ' || p_type || ' in size ' || p_size || ' and more' AS body, 'Core Courses' AS above FROM part
  UNION ALL SELECT p_partkey, 'Bayesian ' || p_name, 'elective', p_type, 'Elective Courses' FROM part)
SELECT page_seq, course_name, course_type, 'Course: ' || course_name || chr(10) || 'Course type: ' || course_type || chr(10) || chr(10) || CASE WHEN length(body) >= 40 THEN body ELSE course_name END AS content,
  'Courses|' || above || '|' || course_name AS path, 3 AS heading_level FROM c""",
    "faculty_pages": """WITH s AS (SELECT s_suppkey AS page_seq, 'Ada ' || s_name AS faculty_name, CASE s_suppkey % 3 WHEN 0 THEN 'Professor' WHEN 1 THEN 'Senior Lecturer' ELSE '' END AS academic_title,
  CASE s_suppkey % 3 WHEN 0 THEN 'Head of Data' WHEN 1 THEN '' ELSE 'Manager of things' END AS industry_role, 'Lives in nation ' || s_nationkey || ' and has written of many things there.' AS bio FROM supplier)
SELECT page_seq, faculty_name, academic_title, industry_role, 'Faculty: ' || faculty_name || chr(10) || CASE WHEN academic_title <> '' THEN 'Academic role: ' || academic_title || chr(10) ELSE '' END
  || CASE WHEN industry_role <> '' THEN 'Industry role: ' || industry_role || chr(10) ELSE '' END || bio AS content FROM s""",
    "eval_turn_scores": """WITH t AS (SELECT *, lag(text) OVER w AS expected, lag(role) OVER w AS asker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT *, list_filter(string_split_regex(lower(expected), '\\s+'), lambda x: x <> '') AS words FROM t WHERE role = 'assistant' AND asker = 'user' AND text IS NOT NULL AND trim(expected) <> ''),
c AS (SELECT conv_id AS query_id, turn, len(list_filter(words, lambda x: contains(lower(text), x))) / len(words) AS share, CASE WHEN contains(text, '[Source') THEN 1.0 ELSE 0.0 END::DOUBLE AS groundedness FROM v)
SELECT query_id, turn, round(share, 9) AS correctness, groundedness, round(0.5 * share + 0.2 * groundedness, 9) AS final_score FROM c""",
    "eval_answer_scores": f"""{_HITS}, r AS (SELECT query_id, avg(score) AS retrieval FROM h WHERE rank <= 5 GROUP BY query_id),
{_SAID},
w AS (SELECT *, list_filter(string_split_regex(lower(expected), '\\s+'), lambda x: x <> '') AS words FROM t WHERE answer <> ''),
c AS (SELECT w.query_id, len(list_filter(words, lambda x: contains(lower(answer), x))) / len(words) AS correctness, CASE WHEN contains(answer, '[Source') THEN 1.0 ELSE 0.0 END::DOUBLE AS groundedness, coalesce(retrieval, 0.0) AS retrieval FROM w LEFT JOIN r USING (query_id) WHERE len(words) > 0)
SELECT query_id, round(correctness, 6) AS correctness, groundedness, round(retrieval, 6) AS retrieval, round(0.5 * correctness + 0.2 * groundedness + 0.3 * retrieval, 6) AS final_score FROM c""",
    "links": """WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS site, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages),
l AS (SELECT page_id, rtrim(site || replace(unnest(hrefs), '&amp;', '&'), '/') AS link FROM p) SELECT DISTINCT page_id, link FROM l""",
    "page_title": f"{_PAGE} SELECT page_id, title AS page_title FROM p",
    "page_sections": f"{_PAGE} SELECT page_id, title AS section_title, 1 AS heading_level, length(body) AS char_count, sha256(body) AS hash FROM p WHERE length(body) >= 120 AND length(title) BETWEEN 1 AND 160",
    "ingest_pages": _INGEST,
    "topk_cosine": f"{_HITS} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM h WHERE rank <= 20",
    "topk_cosine_filtered": f"{_HITS}, f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM h WHERE label = 3) SELECT query_id, id, round(score, 6) AS score, rank FROM f WHERE rank <= 5",
    "topk_inverted_exact": f"{_HITS} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM h WHERE rank <= 10",
    "topk_batch": f"{_HITS} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM h WHERE rank <= 10",
    "topk_batch_filtered": f"{_HITS}, f AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM h WHERE label = 3) SELECT query_id, id, round(score, 6) AS score, rank FROM f WHERE rank <= 5",
    "threshold": f"{_HITS} SELECT query_id, id, round(score, 6) AS score FROM h WHERE rank <= 20 AND score >= 0.35",
    "dedupe_hits": f"{_DISTINCT} SELECT query_id, id, round(score, 6) AS score FROM k WHERE nth = 1",
    "two_stage": f"{_DISTINCT} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM k WHERE nth = 1 AND score >= 0.35 QUALIFY rank <= 5",
    "two_stage_bm25": f"{_BM25} SELECT query_id, id, round(score, 6) AS score, round(rerank_score, 6) AS rerank_score, rank FROM f",
    "answer_extractive": _EXTRACTIVE,
    "eval_alignment": _ALIGNED,
    "labelled_courses": """WITH p AS (SELECT *, p_partkey % 20 AS page_seq, (p_partkey // 20) % 4 AS kind FROM part)
      SELECT page_seq, (row_number() OVER (PARTITION BY page_seq ORDER BY kind, p_partkey) - 1)::INT AS section_seq, 'Machine Learning in part ' || p_partkey AS course_name, ['core', 'elective', 'capstone', 'career_seminar'][kind + 1] AS course_type,
        'All|' || ['Core Courses', 'Core Courses|Sample Elective', 'Capstone', 'Capstone|Career Seminar'][kind + 1] || '|Machine Learning in part ' || p_partkey AS path,
        'Course: Machine Learning in part ' || p_partkey || chr(10) || 'Course type: ' || ['core', 'elective', 'capstone', 'career_seminar'][kind + 1] || chr(10) || chr(10)
          || CASE WHEN length(p_name || ' by ' || p_brand) >= 40 THEN p_name || ' by ' || p_brand ELSE 'Machine Learning in part ' || p_partkey END AS content FROM p""",
    "nested_sections": """WITH o AS (SELECT o_custkey, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderkey, o_orderstatus, ' is told here at some length, so that what stands under each heading has as many letters as a section needs at the least, and some.' AS l FROM orders WHERE o_custkey IS NOT NULL),
      h AS (
        SELECT o_custkey, y, m, o_orderkey AS k, 4 AS heading_level, 'Order ' || o_orderkey AS section_title, 'Order of state ' || o_orderstatus || l AS own, 'Customer ' || o_custkey || '|Year ' || y || '|Month ' || m AS above FROM o
        UNION ALL SELECT DISTINCT o_custkey, y, m, -1, 3, 'Month ' || m, 'Bare ones aside, this' || l, 'Customer ' || o_custkey || '|Year ' || y FROM o
        UNION ALL SELECT DISTINCT o_custkey, y, -1, -1, 2, 'Year ' || y, 'Bare ones aside, this' || l, 'Customer ' || o_custkey FROM o
        UNION ALL SELECT DISTINCT o_custkey, -1, -1, -1, 1, 'Customer ' || o_custkey, 'Bare ones aside, this' || l, NULL FROM o),
      n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y, m, k) AS nth FROM h),
      b AS (SELECT a.o_custkey, a.nth, string_agg(CASE WHEN d.nth = a.nth THEN d.own ELSE d.section_title || ' ' || d.own END, ' ' ORDER BY d.nth) AS body FROM n a JOIN n d ON d.o_custkey = a.o_custkey
        AND (a.heading_level = 1 OR d.y = a.y AND (a.heading_level = 2 OR d.m = a.m AND (a.heading_level = 3 OR d.k = a.k))) GROUP BY ALL),
      r AS (SELECT n.*, body, row_number() OVER (PARTITION BY n.o_custkey, lower(section_title || '|' || body) ORDER BY n.nth) AS same FROM n JOIN b ON b.o_custkey = n.o_custkey AND b.nth = n.nth)
      SELECT o_custkey AS page_seq, (row_number() OVER (PARTITION BY o_custkey ORDER BY nth) - 1)::INT AS section_seq, section_title, heading_level, concat_ws('|', above, section_title) AS path, sha256(body) AS hash FROM r WHERE same = 1""",
    "faq_lines": f"""WITH t AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN 'What is said in turn ' || turn || ' of this?' ELSE {clean("'It is said that ' || regexp_replace(text, '[?\\s<&]+', ' ', 'g')")} END AS line FROM conversations),
      s AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS asked, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS last_asked FROM t),
      a AS (SELECT conv_id, asked, coalesce(string_agg(line, ' ' ORDER BY turn) FILTER (role <> 'user' AND (asked < last_asked OR turn <= asked + 7)), '') AS answer FROM s WHERE asked IS NOT NULL GROUP BY conv_id, asked),
      q AS (SELECT conv_id AS page_seq, 'What is said in turn ' || asked || ' of this?' AS question, {clean("answer")} AS answer FROM a)
      SELECT page_seq, question, sha256(answer) AS answer_hash, 95 AS retrieval_priority FROM q WHERE length(answer) >= 25""",
    "word_associations": f"""WITH l AS (SELECT doc_id, {_words("text")} AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS at FROM l),
v AS (SELECT word FROM u WHERE length(word) <= 64 GROUP BY word HAVING count(DISTINCT doc_id) >= 3 ORDER BY count(DISTINCT doc_id) DESC, word LIMIT 65536),
t AS (SELECT * FROM u SEMI JOIN v USING (word)),
c AS (SELECT x.word, y.word AS other, count(*) AS n FROM t x JOIN t y ON x.doc_id = y.doc_id AND x.at <> y.at AND abs(x.at - y.at) <= 4 GROUP BY ALL),
s AS (SELECT word, sum(n)::DOUBLE AS s FROM c GROUP BY word),
p AS (SELECT c.word, c.other, n, round(ln(n * (SELECT sum(s) FROM s) / (a.s * b.s)), 6) AS pmi, ln(n * (SELECT sum(s) FROM s) / (a.s * b.s)) > 0 AS good FROM c JOIN s a ON a.word = c.word JOIN s b ON b.word = c.other WHERE n >= 3)
SELECT word, other, n, pmi, row_number() OVER (PARTITION BY word ORDER BY pmi DESC, n DESC, other)::INT AS rank FROM p WHERE good QUALIFY rank <= 5""",
    "vector_store": "SELECT vec_id AS id, (CASE WHEN vec_id % 6 = 0 THEN 'third ' WHEN vec_id % 3 = 0 THEN 'second ' ELSE 'first ' END) || vec_id AS document, CASE WHEN vec_id % 6 = 0 THEN -1 ELSE label END AS label, len(embedding)::INT AS dims FROM embeddings",
    "index_docs": f"SELECT doc_id::VARCHAR AS id, {clean('''concat('Page title: ', source, chr(10), 'Section title: ', lang, chr(10), 'Content type: overview', chr(10), 'Program type: general', chr(10), chr(10), text)''')} AS document FROM documents",
    "index_metadata": f"{_DOCS} SELECT doc_id::VARCHAR AS id, source AS page_title, lang AS section_title, {tokens('text', _WORD_LEX)} AS token_count, nullif(array_to_string({ordered_distinct(f"regexp_extract_all(body, '{_EMAIL}')")}, ', '), '') AS emails FROM d",
    "context_blocks": f"{_HITS} SELECT h.query_id, sha256(string_agg(regexp_replace({_BLOCK}, '\\s+$', ''), chr(10) || chr(10) ORDER BY rank)) AS context_hash, count(*)::INT AS n_sources, 'Source ' || count(*) AS last_source FROM h LEFT JOIN documents d ON d.doc_id = h.id WHERE rank <= 5 GROUP BY h.query_id",
    "eval_hit_rate": f"{_HITS}, c AS (SELECT q.query_id, bool_or(h.label = q.label) AS type_hit, bool_or(contains(lower(coalesce(d.text, '') || ' ' || h.label), 'ing')) AS keyword_hit FROM q JOIN h ON h.query_id = q.query_id AND rank <= 5 LEFT JOIN documents d ON d.doc_id = h.id GROUP BY q.query_id) "
    "SELECT query_id, type_hit, keyword_hit, type_hit AND keyword_hit AS success FROM c",
    "eval_final_score": f"""WITH {_SAID},
w AS (SELECT *, list_filter(string_split_regex(lower(expected), '\\s+'), lambda x: x <> '') AS words FROM t WHERE answer <> '')
SELECT query_id, round(len(list_filter(words, lambda x: contains(lower(answer), x))) / len(words), 9) AS correctness,
  CASE WHEN contains(answer, '[Source') THEN 1.0 ELSE 0.0 END::DOUBLE AS groundedness, round(0.5 * len(list_filter(words, lambda x: contains(lower(answer), x))) / len(words) + 0.2 * CASE WHEN contains(answer, '[Source') THEN 1 ELSE 0 END, 9) AS final_score
FROM w WHERE len(words) > 0""",
}
