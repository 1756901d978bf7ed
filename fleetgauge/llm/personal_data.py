"""Personal data: fixed patterns, and terms that give a protected entity away.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Each distinct value is a protected entity. Over
the whole corpus, with D documents, it is counted in how many documents an entity (n e), a term (n t) and both
together (n et) occur, a term being any word of a document outside its base spans. An entity carries ``log(D / n e)`` of
information; a term reveals ``log(D P / n e)`` of it, where P is the lower confidence bound of the share ``n et / n t`` of
the term's documents that hold the entity (Wilson's, one-sided). Where it reveals at least ``disclosure`` of the entity's
information, the term is generalised wherever it stands in a document with the entity. One joint document is no
estimate: what stands together once only is never judged. Documents without an entity never change.

Entities of the same documents are one class, judged once. A term can disclose a class only if ``n t`` is at most
``n e ^ disclosure * D ^ (1 - disclosure)``, so frequent words drop out before they meet the classes of their documents.
Counts are made in each task first; a hot entity or word costs one row per task. Terms travel as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, hash_bitmap, leading_bits, per_batch, written

# Fixed patterns of the base kinds, in the order they are listed; the first two are read without going back over a run.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

DISCLOSURE = 0.9
CONFIDENCE = 0.8
# Leading hash bits in the bitmap of asked words: 2 MB, whatever the corpus.
FILTER_BITS = 24
_WORD = re.compile(r"\w+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int

    def __str__(self) -> str:
        return f"{self.kind}:{self.start}:{self.end}"


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> list[tuple[int, int]]:
    """Each ``@`` with a domain behind it ends a local part, which goes back to the last match or a strange character."""
    out = []
    free = 0
    at = text.find("@")
    while at >= 0:
        stop = at + 1
        if domain := DOMAIN.match(text, stop):
            begin = at
            while begin > free and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < at:
                out.append((begin, domain.end()))
                free = stop = domain.end()
        at = text.find("@", stop)
    return out


def _is_octet(part: str) -> bool:
    """Whether digits are at most 255; of any length, though ``int`` refuses more than 4300."""
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; leftmost, not overlapping within a kind."""
    out = [Span("email", *s) for s in _emails(text)]
    out += [Span("ip", *m.span()) for m in IP.finditer(text) if all(map(_is_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(Span("card", *m.span()))
    if "+" in text:
        out += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


def term_hash(word: str) -> int:
    return _hash(word.lower())


def entity_hash(kind: str, value: str) -> int:
    return _hash(f"{kind}\0{value}")


def words_outside(text: str, base: list[Span]) -> Iterator[re.Match]:
    """The words that no base span touches, in order."""
    taken = sorted((s.start, s.end) for s in base)
    at = reach = 0
    for m in _WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if m.start() >= reach:
            yield m


def entity_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, entity`` of every base span's value."""

    def entities(text: str) -> set[int]:
        return {entity_hash(s.kind, text[s.start : s.end]) for s in base_spans(text)}

    return _hash_rows(docs, "entity", entities)


def term_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, term`` of every word outside base spans."""

    def terms(text: str) -> set[int]:
        return {_hash(w) for w in {m[0].lower() for m in words_outside(text, base_spans(text))}}

    return _hash_rows(docs, "term", terms)


def _hash_rows(docs: DataFrame, name: str, hashes: Callable[[str], set[int]]) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            owner: list[int] = []
            found: list[int] = []
            for at, text in enumerate(batch.column("text").to_pylist()):
                own = hashes(text) if text else ()
                owner += [at] * len(own)
                found += own
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            return pa.record_batch({"doc_id": ids, name: pa.array(found, pa.int64())})

        return step

    return per_batch(docs.select("doc_id", "text"), f"doc_id {dict(docs.dtypes)['doc_id']}, {name} bigint", make)


def word_counts(docs: DataFrame, asked: np.ndarray) -> DataFrame:
    """``term, n``: in how many documents of the corpus a word occurs, for words in the bitmap.

    The bitmap only keeps most words that nobody asks about out of the shuffle; those it lets through are dropped later.
    """

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for text in batch.column("text").to_pylist():
                counts.update({w.lower() for w in _WORD.findall(text)} if text else ())
            terms = np.array([_hash(w) for w in counts], np.int64)
            n = np.fromiter(counts.values(), np.int64, len(counts))
            kept = asked[leading_bits(terms, FILTER_BITS)]
            return pa.record_batch({"term": pa.array(terms[kept]), "n": pa.array(n[kept])})

        return step

    return per_batch(docs.select("text"), "term bigint, n bigint", make).groupBy("term").agg(F.sum("n").alias("n"))


def entity_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class, n_entity``: the classes of entities in each document, without entities of one document."""
    rows = written(entity_rows(docs).distinct(), "entities")
    found = rows.groupBy("entity").agg(
        F.count("*").alias("n_entity"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("documents")
    )
    shared = found.filter("n_entity > 1").selectExpr("entity", "xxhash64(n_entity, documents) AS class", "n_entity")
    return rows.join(shared, "entity").select("doc_id", "class", "n_entity").distinct()


def lower_share(n_both: str, n_term: str, confidence: float) -> str:
    """SQL for Wilson's lower bound of the share ``n_both / n_term``."""
    z = NormalDist().inv_cdf(confidence)
    share = f"({n_both} / {n_term})"
    spread = f"{z!r}D * sqrt({share} * (1 - {share}) / {n_term} + {z * z / 4!r}D / ({n_term} * {n_term}))"
    return f"(({share} + {z * z / 2!r}D / {n_term} - {spread}) / (1 + {z * z!r}D / {n_term}))"


def document_terms(docs: DataFrame, disclosure: float = DISCLOSURE, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, terms``: the terms to generalise in each document that holds an entity they give away.

    A list holds no more than the document's own words.
    """
    held = docs.filter("doc_id IS NOT NULL")
    classes = written(entity_classes(_may_hold(held)), "classes")
    documents = float(docs.count())
    own = written(term_rows(_may_hold(held).join(classes.select("doc_id").distinct(), "doc_id", "left_semi")), "terms")
    asked = own.groupBy("term").agg(F.count("*").alias("n")).filter("n > 1").select("term")
    counts = word_counts(docs, hash_bitmap(asked, FILTER_BITS)).filter("n > 1").withColumnRenamed("n", "n_term")
    # a share is at most n_entity / n_term; the margin keeps rounding from deciding here
    most = f"1.000001D * pow(n_entity, {disclosure!r}D) * pow({documents!r}D, {1 - disclosure!r}D)"
    largest = classes.agg(F.max(F.expr(most)).alias("most")).first()["most"] or 0.0
    met = own.join(counts.filter(F.col("n_term") <= largest), "term").join(classes, "doc_id")
    met = written(met.filter(f"n_term <= {most}").select("doc_id", "class", "n_entity", "term", "n_term").distinct(), "met")
    judged = met.groupBy("class", "n_entity", "term", "n_term").agg(F.count("*").alias("n_both")).filter("n_both > 1")
    information = f"ln({documents!r}D / n_entity)"
    revealed = f"ln({documents!r}D * {lower_share('n_both', 'n_term', confidence)} / n_entity)"
    found = judged.filter(f"{information} > 0 AND {revealed} >= {disclosure!r}D * {information}").select("class", "term")
    return met.join(found, ["class", "term"], "left_semi").groupBy("doc_id").agg(F.collect_set("term").alias("terms"))


def _may_hold(docs: DataFrame) -> DataFrame:
    """Every base span has an @ or a digit: the rest is passed by without leaving the JVM."""
    return docs.filter("text RLIKE '[0-9@]'")


def term_spans(text: str, terms: set[int], base: list[Span]) -> list[Span]:
    """Every place of the terms in the text that no base span covers."""
    return [Span(TERM, *m.span()) for m in words_outside(text, base) if term_hash(m[0]) in terms]


def sanitised(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= at:
            out += [text[at : span.start], f"[{span.kind.upper()}]"]
        at = max(at, span.end)
    out.append(text[at:])
    return "".join(out)


def base_digest(spans: list[Span]) -> str:
    return hashlib.sha256(",".join(map(str, spans)).encode()).hexdigest()


def find_personal_data(
    docs: DataFrame,
    disclosure: float = DISCLOSURE,
    confidence: float = CONFIDENCE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Spans and sanitised text of every row of ``docs(doc_id, text)``.

    Columns ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, clean_text`` and those named in ``keep``. Spans are
    ``kind:start:end`` in code points, base kinds first, then terms. A null text has no spans and stays null. Rows with a
    null id get base spans only. Rows with one id are one document with all their words and entities, though word counts
    count rows, so that a repeated id can only weaken a term. Equal texts under two ids are two documents. Columns named in
    ``keep`` must not have the name of an output column; other columns are ignored. An empty table gives no rows.
    """
    if clash := set(keep) & {"doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "clean_text"}:
        raise ValueError(f"names of output columns cannot be kept: {sorted(clash)}")
    configure(docs.sparkSession)
    terms = written(document_terms(docs, disclosure, confidence), "disclosing")
    rows = docs.select("doc_id", "text", *keep)
    # only rows that may hold an entity meet the terms; the others need no shuffle
    both = _may_hold(rows).join(terms, "doc_id", "left")
    rest = rows.filter("NOT coalesce(text RLIKE '[0-9@]', false)").withColumn("terms", F.lit(None).cast("array<bigint>"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
                base = base_spans(text) if text else []
                spans = base + term_spans(text, set(found), base) if found and text else base
                counts = Counter(s.kind for s in base)
                clean = sanitised(text, spans) if spans else text
                rows.append((*(counts[k] for k in KINDS), base_digest(base), ",".join(map(str, spans)), clean))
            columns = list(zip(*rows)) if rows else [[]] * 7
            out = {"doc_id": batch.column("doc_id")}
            out |= {f"n_{k}": pa.array(columns[i], pa.int64()) for i, k in enumerate(KINDS)}
            out |= {n: pa.array(columns[4 + i], pa.string()) for i, n in enumerate(("base_sha256", "spans", "clean_text"))}
            return pa.record_batch(out | {k: batch.column(k) for k in keep})

        return step

    kinds = dict(docs.dtypes)
    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    kept = "".join(f", {k} {kinds[k]}" for k in keep)
    schema = f"doc_id {kinds['doc_id']}, {counts}, base_sha256 string, spans string, clean_text string{kept}"
    found = per_batch(both, schema, make)
    none = rest.select(
        "doc_id",
        *[F.lit(0).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.lit(base_digest([])).alias("base_sha256"),
        F.lit("").alias("spans"),
        F.col("text").alias("clean_text"),
        *keep,
    )
    return found.unionByName(none)
