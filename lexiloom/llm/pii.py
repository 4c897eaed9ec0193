"""Information-theoretic sanitisation of personal data.

Known forms (addresses, numbers) are protected entities. The words of their documents are judged by
what the corpus says: with P from document counts, a term's disclosure of an entity is

    PMI(entity; term) / IC(entity),  PMI = log P(entity, term) / (P(entity) P(term)),  IC = -log P(entity)

which is 1 when the term occurs only where the entity does. From ``generalise`` on the term is
replaced by a more general one wherever a document holds the entity, from ``remove`` on it goes. The general
terms are what the corpus has that begins alike: the longest beginning of at most ``PREFIX`` letters that occurs in so many
documents that it discloses none of the entities; above all of them is any word. A pair that occurs in ``support``
different texts is judged by its counts. Personal data is mostly in one text alone, so rarer pairs are
judged too where the term is a name by its shape, written with a capital in each of its places. Their
P(entity | term) shrinks to P(entity): seen in r different texts, the counts are trusted as r / (r + 1),
and such a term is generalised at most, however many documents there are: one sight of it is no proof. Copies of one text do not add to r.
Words that are no names by shape, or of a script without capitals, need ``support`` texts.

Texts stay where they are scanned, and those with an entity are stored once: entities, terms and
counts are shuffled, never whole groups. A fixed-size bitmap of the terms in question keeps the document
counts to those. As n(entity, term) <= n(entity), a term in over n(entity)^g * N^(1 - g) of the N
documents is below ``generalise`` = g for sure, so pairs are made of rarer terms only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .store import dropped, saved
from .text import masked

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
BITMAP_BITS = 1 << 20
#: Letters of the longest beginning that a term is generalised to.
PREFIX = 4

# The forms of the contract. A run of digits that fails at its start fails at each later
# digit, so runs are entered at their start alone; what follows never lets a possessive run give back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]+")

#: (start, kind, end, what is protected)
Span = tuple[int, int, int, str]


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, 0, end, text[start:end].lower()
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def known_entities(text: str | None) -> list[Span]:
    """Spans of the known forms, by start, then kind; leftmost and non-overlapping within a kind."""
    text = text or ""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end(), m[0]))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end(), digits))
        if "+" in text:
            for m in _PHONE.finditer(text):
                digits = "".join(_DIGIT.findall(m[0]))
                if 10 <= len(digits) <= 15:
                    out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def free_terms(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) for the words that none of the spans, which are in order of their starts, covers a part of."""
    at, end = 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while at < len(spans) and spans[at][0] < e:
            end, at = max(end, spans[at][1]), at + 1
        if end <= s:
            yield m[0].lower(), s, e


_SPANS = "array<struct<start:int,rank:int,end:int,into:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("into", pa.string())]))
_FOUND = f"row long, doc_id long, content long, known {_SPANS}, entities array<string>, held string"


def _spans(found: list[list[tuple[int, int, int, str | None]]]) -> pa.Array:
    return pa.array([[{"start": s, "rank": k, "end": e, "into": into} for s, k, e, into in x] for x in found], _SPAN)


def _scan(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            spans = [known_entities(text.as_py()) for text in batch.column("text")]
            columns = [
                pa.array(np.arange(row, row + len(batch))), batch.column("doc_id"), batch.column("content"),
                _spans([[(*x[:3], None) for x in found] for found in spans]),
                pa.array([sorted({f"{KINDS[k]}:{what}" for _, k, _, what in found}) for found in spans], pa.list_(pa.string())),
                pa.array([text.as_py() if found else None for text, found in zip(batch.column("text"), spans, strict=True)], pa.string()),
            ]
            row += len(batch)
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "content", "known", "entities", "held"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("content"), "text").mapInArrow(run, _FOUND)


def _terms(holders: DataFrame) -> DataFrame:
    """(row, term, name): each word outside the entities once for a document that holds some; whether each of its places begins with a capital."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, known in zip(batch.column("row").to_pylist(), batch.column("held"), batch.column("known"), strict=True):
                body, names = text.as_py(), {}
                for term, start, _ in free_terms(body, [(x["start"], x["end"]) for x in known.as_py()]):
                    names[term] = names.get(term, True) and body[start].isupper()
                terms = sorted(names)
                columns = [pa.array([row] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array([names[t] for t in terms], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "term", "name"])

    return holders.select("row", "held", "known").mapInArrow(run, "row long, term string, name boolean")


def _marked(telling: DataFrame) -> DataFrame:
    """(row, told): every place of the terms that tell, for rows of (row, held, known, terms array<struct<term, rank, into>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, known, terms in zip(*(batch.column(c) for c in ("held", "known", "terms")), strict=True):
                told = {x["term"]: (x["rank"], x["into"]) for x in terms.as_py()}
                out.append([(s, told[t][0], e, told[t][1]) for t, s, e in free_terms(text.as_py(), [(x["start"], x["end"]) for x in known.as_py()]) if t in told])
            yield pa.RecordBatch.from_arrays([batch.column("row"), _spans(out)], names=["row", "told"])

    return telling.select("row", "held", "known", "terms").mapInArrow(run, f"row long, told {_SPANS}")


def _slot(term: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(term) % BITMAP_BITS


def beginnings(term: str) -> list[str]:
    """A term's beginnings as terms of their own, marked by a star: ``ab*`` for all that begins with ab."""
    return [f"{term[:k]}*" for k in range(1, min(len(term), PREFIX) + 1)]


def _document_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): over all documents, how many hold the term; for these terms and their beginnings, and a few more."""
    spark = docs.sparkSession

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_slot(x) for t in batch.column(0).to_pylist() for x in (t, *beginnings(t))], pa.int32())], names=["slot"])

    bitmap = np.zeros(BITMAP_BITS, bool)  # as many slots at most, whatever the number of terms
    taken = terms.mapInArrow(slots, "slot int").distinct().toArrow()
    bitmap[taken.column(0).to_numpy()] = True
    wanted = spark.sparkContext.broadcast(np.packbits(bitmap))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known, found = np.unpackbits(wanted.value).astype(bool), {}, Counter()
        begun = {k: Counter() for k in range(PREFIX, 0, -1)}

        def counted() -> pa.RecordBatch:
            for k, own in begun.items():
                found.update({f"{x}*": n for x, n in own.items() if len(x) == k and bits[_slot(f"{x}*")]})
                own.clear()
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                words = {w.lower() for w in set(_TERM.findall(text.as_py() or ""))}
                for w in words.difference(known):
                    known[w] = bool(bits[_slot(w)])
                found.update(w for w in words if known[w])
                some = words
                for k, own in begun.items():
                    some = {w[:k] for w in some}
                    own.update(some)
            if len(known) > 150_000:
                known.clear()
            if len(found) + len(begun[PREFIX]) > 100_000:
                yield counted()
        yield counted()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def find_personal_data(docs: DataFrame, *, generalise: float = 0.7, remove: float = 0.9, support: int = 3) -> DataFrame:
    """(row, doc_id, content, spans array<struct<kind, start, end, into>>) for each row of ``docs`` (doc_id, text).

    Spans are code points of the whole text, end exclusive, by start, then kind as in ``KINDS``; those
    of the last two kinds are terms that disclose an entity of their document too well, ``into`` being what these become. A null text counts as
    empty; texts without an entity have no span; repeated rows are found each. An empty table gives
    no row. Other columns are not read. ``content`` is a hash of the text.
    """
    docs = docs.select("doc_id", "text")
    rows = saved(_scan(docs))
    holders = rows.where("held IS NOT NULL")
    found = rows.select("row", "doc_id", "content", "known")
    kinds = F.array(*(F.lit(k) for k in KINDS))
    if not holders.isEmpty():
        n_docs = rows.count()
        of_row = holders.select("row", "content", F.explode("entities").alias("entity"))
        n_entity = saved(of_row.groupBy("entity").agg(F.count("*").alias("n_entity")))
        of_row = of_row.join(n_entity, "entity")
        # Entities of one and the same document have equal counts with each term: one stands for all.
        alone = of_row.where("n_entity = 1").groupBy("row", "content", "n_entity").agg(F.min("entity").alias("entity"))
        of_row = saved(of_row.where("n_entity > 1").unionByName(alone))
        most = lambda n: F.pow(n, F.lit(generalise)) * F.lit(float(n_docs) ** (1 - generalise) * (1 + 1e-9))
        terms = saved(_terms(holders))
        counts = saved(_document_counts(docs, terms.select("term").distinct()))
        n_term = counts.where(~F.col("term").endswith("*")).withColumnRenamed("n", "n_term")
        n_term = saved(n_term.where(F.col("n_term") <= most(F.lit(n_entity.agg(F.max("n_entity")).first()[0]))))
        both = saved(terms.join(n_term, "term").join(of_row, "row").where(F.col("n_term") <= most(F.col("n_entity"))))
        texts = both.groupBy("entity", "term", "content").agg(F.count("*").alias("n"), F.bool_and("name").alias("name"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
        judged = texts.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.bool_and("name").alias("name"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
        known_well = F.col("texts") >= support
        judged = judged.where(known_well | F.col("name"))
        content = -F.log2(F.col("n_entity") / n_docs)
        told, base = F.col("n_both") / F.col("n_term"), F.col("n_entity") / n_docs
        told = F.when(known_well, told).otherwise((F.col("texts") * told + base) / (F.col("texts") + 1))
        mutual = F.log2(told / base)
        judged = judged.withColumn("disclosure", F.when(content > 0, mutual / content).otherwise(0.0)).where(F.col("disclosure") >= generalise)
        judged = judged.select("entity", "term", "n_entity", F.when(known_well & (F.col("disclosure") >= remove), 5).otherwise(4).alias("rank"))
        telling = both.select("row", "entity", "term").join(judged, ["entity", "term"])
        telling = saved(telling.groupBy("row", "term").agg(F.max("rank").alias("rank"), F.max("n_entity").alias("n_entity")))
        kinds_of = telling.where("rank = 4").select("term", "n_entity").distinct()
        upward = kinds_of.select("term", "n_entity", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("term"), F.lit(PREFIX))), lambda k: F.concat(F.substring("term", F.lit(1), k), F.lit("*")))).alias("general"))
        upward = upward.join(counts.select(F.col("term").alias("general"), "n"), "general").where(F.col("n") > most(F.col("n_entity")))
        upward = saved(upward.groupBy("term", "n_entity").agg(F.max_by("general", F.length("general")).alias("into")))
        telling = telling.join(upward, ["term", "n_entity"], "left").select("row", "term", "rank", F.when(F.col("rank") == 4, F.coalesce("into", F.lit("[word]"))).otherwise("").alias("into"))
        telling = saved(telling.groupBy("row").agg(F.collect_list(F.struct("term", "rank", "into")).alias("terms")))
        found = found.join(saved(_marked(holders.join(telling, "row"))), "row", "left")
        dropped(n_entity, of_row, terms, counts, n_term, both, upward, telling)
    else:
        found = found.withColumn("told", F.lit(None).cast(_SPANS))
    spans = F.array_sort(F.concat("known", F.coalesce("told", F.expr(f"cast(array() AS {_SPANS})"))))
    named = F.transform(spans, lambda s: F.struct(F.get(kinds, s["rank"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["into"].alias("into")))
    return found.select("row", "doc_id", "content", named.alias("spans"))


def replaced(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets, terms by what they become, removed ones by nothing; spans that overlap are one place."""
    return masked(text, spans, lambda x: F.coalesce(x["into"], F.concat(F.lit("["), x["kind"], F.lit("]"))))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """``docs``, all its columns, with the personal data in ``text`` replaced. Only rows that hold some are looked up."""
    found = find_personal_data(docs, **options).where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content"), F.col("spans").alias("_spans"))
    found = found.dropDuplicates(["_id", "_content"])
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("_own"))
    out = rows.join(found.hint("merge"), F.col("doc.doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_content")), "left")
    new = F.when(F.col("_spans").isNull(), F.col("doc.text")).otherwise(replaced(F.col("doc.text"), F.col("_spans")))
    return out.select(*(new.alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
