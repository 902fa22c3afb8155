"""Personal data: formats found by pattern, and the words near them that reveal them.

A value found by pattern is a protected entity, and so are the parts that it shares with others of its kind: an email's
domain and name, an IP's first three numbers, a card's first six digits, a phone number without its last four. So values
seen once are judged by those like them. How much a word tells about an entity is their pointwise mutual information
over all documents, PMI(c; t) = log(N n(c,t) / (n(c) n(t))), as a share of all there is to know about the entity,
log(N / n(c)). Words whose share reaches a threshold, and whose meeting with the entity is no chance, are sanitised
wherever they stand in a document with the entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.llm.words import CACHE_WORDS, map_batches
from tableloom.session import materialise

KINDS = ("email", "ip", "card", "phone", "term")
DISCLOSURE = 0.8
SUPPORT = 1  # documents with both word and entity
CHANCE = 0.01  # with which any pair at all may be taken that only meets by chance
HELD = 300_000  # counts a task holds before it hands them on
SCREENED = 500_000  # most frequent words that are sent to the tasks: 8 MB, whatever the corpus

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

Span = tuple[int, int, str]  # start and end in code points, and the value in one spelling


def _emails(text: str) -> Iterator[Span]:
    """From each @ back to the start of its run, so that a long run without one costs nothing."""
    free = 0
    for match in _DOMAIN.finditer(text):
        low = max(free, text.rfind("@", free, match.start()) + 1)
        before = text[low : match.start()]
        start = low + len(before.rstrip(_LOCAL))
        if start < match.start():
            free = match.end()
            yield start, free, text[start:free].lower()


def _ips(text: str) -> Iterator[Span]:
    for match in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in match[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield match.start(), match.end(), ".".join(parts)


def _passes_luhn(digits: str) -> bool:
    doubled = "0246813579"  # the digit sum of twice each digit
    return (sum(map(int, digits[-1::-2])) + sum(int(doubled[int(d)]) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _cards(text: str) -> Iterator[Span]:
    for match in _CARD.finditer(text):
        if 14 <= len(digits := _digits(match[0])) <= 19 and _passes_luhn(digits):
            yield match.start(), match.end(), digits


def _phones(text: str) -> Iterator[Span]:
    for match in _PHONE.finditer(text):
        if 10 <= len(digits := _digits(match[0])) <= 15:
            yield match.start(), match.end(), digits


def base_spans(text: str) -> list[tuple[str, Span]]:
    """All matches of the four patterns, by start, then kind; leftmost and non-overlapping within a kind."""
    found: list[tuple[str, Span]] = []
    if "@" in text:
        found += (("email", s) for s in _emails(text))
    found += (("ip", s) for s in _ips(text))
    found += (("card", s) for s in _cards(text))
    if "+" in text:
        found += (("phone", s) for s in _phones(text))
    return sorted(found, key=lambda x: (x[1][0], KINDS.index(x[0])))


def _hash(value: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(value.encode("utf-8", "surrogatepass")), "big", signed=True)


def _parts(kind: str, value: str) -> list[str]:
    """The spelling of a value and of what it shares with others."""
    if kind == "email":
        name, _, domain = value.rpartition("@")
        parts = [f"domain:{domain}", f"name:{name}"]
    elif kind == "ip":
        parts = [f"net:{value.rpartition('.')[0]}"]
    elif kind == "card":
        parts = [f"issuer:{value[:6]}"]
    else:
        parts = [f"area:{value[:-4]}"]
    return [f"{kind}:{value}", *parts]


def _free_words(text: str, spans: list[tuple[str, Span]]) -> Iterator[tuple[int, int, int]]:
    """Word, start and end of all words that don't touch an entity."""
    starts: list[int] = []  # of the stretches that entities take up
    ends: list[int] = []
    for start, end, _ in (s for _, s in spans):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for match in _WORD.finditer(text):
        at = bisect_left(starts, match.end()) - 1  # the last stretch that starts before the word ends
        if len(match[0]) > 1 and (at < 0 or ends[at] <= match.start()):
            yield _hash(match[0].lower()), match.start(), match.end()


def _describe(batches: Iterator[dict]) -> Iterator[dict]:
    for batch in batches:
        spans, entities, words = [], [], []
        for x in batch["text"]:
            text = x.as_py() or ""
            found = base_spans(text)
            spans.append([{"kind": k, "start": s[0], "end": s[1]} for k, s in found])
            entities.append(list({_hash(part) for k, s in found for part in _parts(k, s[2])}))
            words.append([{"term": t, "start": a, "end": b} for t, a, b in _free_words(text, found)] if found else [])
        yield {c: batch[c] for c in ("row", "doc_id", "copy")} | {"spans": spans, "entities": entities, "words": words}


def _most_documents(with_entity: int, total: int, threshold: float) -> float:
    """A word in more documents than this cannot reveal ``threshold`` of an entity, even if it is in all of the entity's."""
    return total * (with_entity / total) ** threshold * (1 + 1e-9)


def _pair_counts(batches: Iterator[dict], frequent: tuple[np.ndarray, np.ndarray], total: int, threshold: float) -> Iterator[dict]:
    """In how many of the task's documents entity and word meet, handed on whenever many are held.

    ``frequent`` are words with their documents; those too frequent for an entity are no pair with it.
    """
    words, documents = frequent
    counts: dict[tuple[int, int], int] = {}

    def hand_on() -> dict:
        made = {"entity": [e for e, _ in counts], "term": [t for _, t in counts], "n": list(counts.values())}
        counts.clear()
        return made

    for batch in batches:
        for entities, terms in zip(batch["entities"], batch["terms"], strict=True):
            found = np.array(terms.as_py(), np.int64)
            at = np.minimum(np.searchsorted(words, found), max(0, len(words) - 1))
            often = np.where(words[at] == found, documents[at], 0) if len(words) else np.zeros(len(found))
            for entity, with_entity in ((e["entity"], e["with_entity"]) for e in entities.as_py()):
                for term in found[often <= _most_documents(with_entity, total, threshold)].tolist():
                    counts[entity, term] = counts.get((entity, term), 0) + 1
                if len(counts) >= HELD:
                    yield hand_on()
    yield hand_on()


def _term_counts(batches: Iterator[dict]) -> Iterator[dict]:
    """In how many of the task's documents each word occurs, handed on whenever many are held."""
    counts: dict[str, int] = {}
    terms: dict[str, frozenset[str]] = {}

    def split(token: str) -> frozenset[str]:
        if len(terms) >= CACHE_WORDS:
            terms.clear()
        found = terms[token] = frozenset(w for w in _WORD.findall(token.lower()) if len(w) > 1)
        return found

    def hand_on() -> dict:
        made = {"term": [_hash(t) for t in counts], "n": list(counts.values())}
        counts.clear()
        return made

    for batch in batches:
        for x in batch["text"]:
            seen: set[str] = set()
            for token in set((x.as_py() or "").split()):
                known = terms.get(token)
                seen |= split(token) if known is None else known
            for term in seen:
                counts[term] = counts.get(term, 0) + 1
            if len(counts) >= HELD:
                yield hand_on()
    yield hand_on()


def disclosures(described: DataFrame, texts: DataFrame, threshold: float, support: int) -> DataFrame:
    """``entity, term, share``: the pairs whose words reveal at least ``threshold`` of the entity's information.

    The chance that so many of the rarer one's documents hold the other is at most exp(-n D(k / n, q)), D the relative
    entropy and q the other's share of documents; times the number of meetings in all documents it must stay below
    ``CHANCE``. A single meeting has a chance of at least 1 / N, so where that is too much entities of one document
    aren't paired. Words are counted first: one that is too frequent to reveal enough of an entity is not paired with it.
    """
    terms_of = F.array_distinct("words.term")
    meetings = F.sum(F.size("entities").cast("double") * F.size(terms_of))
    total, tests = described.agg(F.count(F.lit(1)), F.coalesce(meetings, F.lit(0.0))).first()
    fewest = max(support, 1 if tests <= CHANCE * total else 2)
    linked = described.select("row", F.explode("entities").alias("entity"))
    values = materialise(linked.groupBy("entity").agg(F.count(F.lit(1)).alias("with_entity")), "entities")
    one = F.struct("entity", "with_entity")
    asked = linked.join(values.filter(F.col("with_entity") >= fewest), "entity").groupBy("row").agg(F.collect_list(one).alias("entities"))
    terms = map_batches(texts.select("text"), _term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("with_term"))
    terms = materialise(terms.filter(F.col("with_term") >= fewest), "terms")
    often = terms.filter(F.col("with_term") > _most_documents(fewest, max(total, 1), threshold)).orderBy(F.desc("with_term"), "term").limit(SCREENED)
    often = often.toArrow().sort_by("term")  # at most SCREENED rows; pairs of words beyond are dropped by the share alone
    sent = texts.sparkSession.sparkContext.broadcast((often["term"].to_numpy(), often["with_term"].to_numpy()))
    met = described.filter(F.size("words") > 0).select("row", terms_of.alias("terms")).join(asked, "row")
    pairs = map_batches(
        met.select("entities", "terms"), lambda batches: _pair_counts(batches, sent.value, total, threshold), "entity long, term long, n long"
    )
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("both")).filter(F.col("both") >= fewest)
    pairs = materialise(pairs, "pairs")
    known = pairs.join(values, "entity").join(terms, "term").filter((F.col("with_entity") < total) & (F.col("with_term") < total))
    information = F.log(F.lit(float(total)) / F.col("with_entity"))
    shared = F.log(F.lit(float(total)) * F.col("both") / (F.col("with_entity") * F.col("with_term")))
    share = F.when(F.col("with_entity") < total, shared / information)
    n, k = F.least("with_entity", "with_term"), F.col("both")
    q = F.greatest("with_entity", "with_term") / F.lit(float(total))
    without = F.when((k < n) & (q < 1), (n - k) * F.log((n - k) / (n * (1 - q)))).otherwise(0.0)
    sure = (shared > 0) & (k * F.log(k / (n * q)) + without >= log(max(tests, 1.0) / CHANCE))
    return known.filter(sure).select("entity", "term", share.alias("share")).filter(F.col("share") >= threshold)


def find_personal_data(
    docs: DataFrame, threshold: float = DISCLOSURE, support: int = SUPPORT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, copy, spans``: an array of (kind, start, end) in code points, by start, then kind, for every row.

    Kinds are email, ip, card and phone by pattern, and ``term`` for words that reveal such a value in the same text. Whole texts are
    searched; NULL and empty texts have no spans. Documents are counted by row, repeated rows and copies included.
    ``copy`` is a hash of the text. Other columns are ignored.

    Plan: one pass finds the values and, in documents with any, the places of all words as hashes, from which pairs and
    values are counted; a second counts documents per word. Both counts are combined in each task. Of each document
    the entities and words of any pair over the threshold meet again, and then the pairs. Texts never shuffle.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("copy"), "text"
    )
    id_type = docs.schema[doc_id].dataType.simpleString()
    span = "array<struct<kind:string,start:int,end:int>>"
    words = "array<struct<term:bigint,start:int,end:int>>"
    schema = f"row long, doc_id {id_type}, copy long, spans {span}, entities array<bigint>, words {words}"
    described = materialise(map_batches(rows, _describe, schema), "described")
    revealing = materialise(disclosures(described, rows, threshold, support), "disclosures")
    held = described.select("row", F.explode("entities").alias("entity"))
    held = held.join(revealing.select("entity").distinct(), "entity", "left_semi")
    found = described.select("row", F.explode("words").alias("x")).select("row", "x.*")
    found = found.join(revealing.select("term").distinct(), "term", "left_semi").join(held, "row")
    found = found.join(revealing.select("entity", "term"), ["entity", "term"])
    one = F.struct(F.lit("term").alias("kind"), F.col("start"), F.col("end"))
    added = found.groupBy("row").agg(F.collect_set(one).alias("added"))
    joined = described.drop("entities", "words").join(added, "row", "left")
    both = F.concat("spans", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    keyed = F.transform(both, lambda s: F.struct(s["start"].alias("start"), _rank(s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("doc_id", "copy", ordered.alias("spans"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``: values become their kind in brackets; revealing words become NAME if capitalised, else go.

    ``found`` comes from ``find_personal_data`` on the same rows. Overlapping spans are replaced as one, by the kind of
    the first.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("copy", F.xxhash64("text"))
    spans = found.dropDuplicates(["doc_id", "copy"]).withColumnsRenamed({"doc_id": "_id", "copy": "_copy"})
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            pairs = zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True)
            texts = [None if text is None else _replaced(text, spans or []) for text, spans in pairs]
            yield {"doc_id": batch["doc_id"], "text": pa.array(texts, pa.string())}

    id_type = docs.schema[doc_id].dataType.simpleString()
    return map_batches(joined.select("doc_id", "text", "spans"), run, f"doc_id {id_type}, text string")


def _replaced(text: str, spans: list[dict]) -> str:
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out.append(text[done : span["start"]])
            word = text[span["start"] : span["end"]]
            out.append(f"[{span['kind'].upper()}]" if span["kind"] != "term" else "[NAME]" if word[:1].isupper() else "")
        done = max(done, span["end"])
    return "".join([*out, text[done:]])
