"""Personal data: patterned spans, and terms that disclose them, in DataFrame functions only.

Base spans of four kinds are found by pattern, each kind on its own. They are the protected entities.
All words of a document outside its base spans are candidate terms of its entities. How strongly a term t
reveals an entity e is its pointwise mutual information as a share of the entity's information,

    disclosure = log2(p(e, t) / (p(e) p(t))) / -log2 p(e) = 1 + log2(c(e, t) / c(t)) / log2(N / c(e)),

with document counts c over the whole corpus: 1 for a term that occurs only near e, 0 for an independent
one. Terms with `remove_at` or more are removed, terms with `generalise_at` or more are replaced by their
class (a number, a name, a word), wherever they occur outside base spans, in documents without base spans,
too. Pairs seen in fewer than `min_support` documents are no evidence, so an entity of fewer documents has no
terms; `left_out` counts these entities.

Null texts count as empty, empty ones have no spans.
Several rows of one `doc_id` are judged one by one. Offsets are code points, ends are exclusive. Where
spans of different kinds overlap, the redacted text has one mark for their union, of the first kind.

The patterns never look at a character again once a match cannot start there, so long runs cost no more
than linear time, and repeated groups are possessive, so they need no stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import lookup
from ..session import materialize
from .common import key_bits, may_hold

KINDS = ("email", "ip", "card", "phone")

#: Java patterns that match what the plain patterns of the contract match. A possible start inside a run
#: is skipped, as a match would have begun at the run's start; \G keeps starts right behind a match.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_WORD = r"[\p{L}\p{N}]+"
_NO_WORD = r"[^\p{L}\p{N}]+"
_SPAN = "array<struct<kind:string,start:bigint,end:bigint,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(lengths: Column) -> Column:
    """For each entry of an array the sum of all entries before it, by blocks of 256 entries."""
    zero = F.lit(0).cast("long")
    add = lambda a, b: a + b
    total = lambda values, start, count: F.aggregate(F.slice(values, start, count), zero, add)
    block = lambda i: F.floor(i / 256).cast("int")

    def of(values: Column) -> Column:
        blocks = F.sequence(F.lit(0), block(F.size(values) - 1))
        sums = F.transform(blocks, lambda b: total(values, b * 256 + 1, F.lit(256)))
        heads = lambda s: F.transform(blocks, lambda b: total(s, F.lit(1), b))
        return let(
            let(sums, heads),
            lambda h: F.transform(
                values, lambda _, i: F.get(h, block(i)) + total(values, block(i) * 256 + 1, i - block(i) * 256)
            ),
        )

    return F.when(F.size(lengths) > 0, let(lengths, of)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str | Column, kind: str) -> Column:
    """Spans of all matches."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    length = lambda s: F.length(s).cast("long")

    def of(found: Column) -> Column:
        def spans(pieces: Column) -> Column:
            widths = F.transform(found, lambda m, i: length(m) + length(F.get(pieces, i)))
            return let(
                sums_before(widths),
                lambda before: F.transform(
                    found,
                    lambda m, i: F.struct(
                        F.lit(kind).alias("kind"),
                        (F.get(before, i) + length(F.get(pieces, i))).alias("start"),
                        (F.get(before, i) + length(F.get(pieces, i)) + length(m)).alias("end"),
                        m.alias("value"),
                    ),
                ),
            )

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), spans)).otherwise(F.array().cast(_SPAN))

    return let(F.regexp_extract_all(text, pattern, 0), of)


def _luhn(digits: Column) -> Column:
    def weighted(reverse: Column) -> Column:
        values = F.transform(
            F.sequence(F.lit(1), F.length(reverse)),
            lambda i: F.substr(reverse, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2),
        )
        return F.aggregate(values, F.lit(0), lambda total, v: total + F.when(v > 9, v - 9).otherwise(v))

    return let(F.reverse(digits), weighted) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by kind as listed, then start."""

    def of_kind(kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind], kind), lambda s: _valid(kind, s["value"]))
        needs = _NEEDS[kind]
        guard = text.rlike("[0-9]") if needs is None else F.contains(text, F.lit(needs))
        return F.when(guard, found).otherwise(F.array().cast(_SPAN))

    return F.concat(*[of_kind(kind) for kind in KINDS])


def spans_text(spans: Column) -> Column:
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")


def _entity(span: Column) -> Column:
    value = F.when(span["kind"] == "email", F.lower(span["value"])).otherwise(
        F.regexp_replace(span["value"], "[^0-9.]", "")
    )
    return F.concat(span["kind"], F.lit(":"), value)


def _words(text: Column, spans: Column) -> Column:
    """All words outside base spans: (word, start, end)."""
    touches = lambda m: F.exists(spans, lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
    return F.transform(
        F.filter(matches(text, _WORD, "term"), lambda m: ~touches(m)),
        lambda m: F.struct(m["value"].alias("word"), m["start"].alias("start"), m["end"].alias("end")),
    )


def _with_spans(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    id_and_text = F.concat_ws("\u0001", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text)
    key = F.unhex(F.substring(F.sha2(id_and_text, 256), 1, 32))
    return docs.withColumn("_text", text).withColumn("_spans", base_spans(F.col("_text"))).withColumn("_key", key)


def _lower(words: Column) -> Column:
    return F.array_distinct(F.transform(words, F.lower))


def _hits(found: DataFrame) -> DataFrame:
    return materialize(found.where(F.size("_spans") > 0).select("_key", "_text", "_spans"), "pii-hits")


def _entities(hits: DataFrame) -> DataFrame:
    """`_key` and `entity`, once for each document that has the entity."""
    spans = hits.select("_key", F.explode("_spans").alias("span"))
    return spans.select("_key", _entity(F.col("span")).alias("entity")).distinct()


def left_out(docs: DataFrame, min_support: int = 2) -> DataFrame:
    """Per kind, the number of `entities` and of those `left_out`: too few documents to tell their terms."""
    counted = _entities(_hits(_with_spans(docs.select("doc_id", "text")))).groupBy("entity").count()
    return counted.groupBy(F.substring_index("entity", ":", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("entities"), F.sum((F.col("count") < min_support).cast("long")).alias("left_out")
    )


def disclosing_terms(
    found: DataFrame,
    hits: DataFrame,
    generalise_at: float = 0.75,
    remove_at: float = 0.95,
    min_support: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """The terms that disclose an entity, each with whether it is to be `removed`, and all terms' counts, both written."""
    words = materialize(
        hits.select("_key", F.explode(_lower(_words(F.col("_text"), F.col("_spans"))["word"])).alias("term")).distinct(),
        "pii-words",
    )
    owners = materialize(_entities(hits), "pii-entities")
    entities = owners.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).where(F.col("n_entity") >= min_support)
    # Pairs are counted for whole documents; entities below the support can have no pair above it.
    together = (
        owners.join(entities, "entity", "left_semi")
        .join(words, "_key")
        .groupBy("entity", "term")
        .agg(F.count(F.lit(1)).alias("n_both"))
        .where(F.col("n_both") >= min_support)
    )
    # All terms are counted before any join: tasks' counts are far fewer rows than the words.
    plain = found.where(F.size("_spans") == 0).select(F.explode(_lower(F.split("_text", _NO_WORD))).alias("term"))
    terms = plain.unionByName(words.select("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    terms = materialize(terms, "pii-terms")
    total = found.count()
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    disclosure = F.when(
        information > 0, 1 + F.log2(F.least(F.col("n_both") / F.col("n_term"), F.lit(1.0))) / information
    ).otherwise(0.0)
    telling = (
        together.join(entities, "entity")
        .join(terms, "term")
        .withColumn("disclosure", disclosure)
        .where(F.col("disclosure") >= generalise_at)
        .groupBy("term")
        .agg((F.max("disclosure") >= remove_at).alias("removed"))
    )
    return materialize(telling, "pii-telling"), terms


def _any_of(words: Column) -> Column:
    """A pattern for these words as whole words, null if there are none; words are letters and digits only."""
    return F.when(
        F.size(words) > 0,
        F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])")),
    )


def _with_terms(docs: DataFrame, **thresholds) -> DataFrame:
    """`docs` with `_spans` and every occurrence of a disclosing term outside of them (`_terms`).

    A document's distinct words meet the terms as rows. Those that disclose something come back as a pattern of its own for each
    document, so no other word ever gets offsets.
    """
    found = _with_spans(docs)
    telling, counts = disclosing_terms(found, _hits(found), **thresholds)
    words = found.select("_key", F.explode(F.array_distinct(F.split("_text", _NO_WORD))).alias("word"))
    # Most words tell nothing and go no further.
    words = words.withColumn("term", F.lower("word")).where(may_hold(key_bits(telling, "term"), "term"))
    # A term is in as many documents as it likes; `lookup` spreads the frequent ones.
    counts = counts.withColumnRenamed("n_term", "n")
    met = lookup(words, telling, ["term"], spread="_key", counts=counts, measure=False)
    chosen = lambda removed: _any_of(F.collect_set(F.when(F.col("removed") == removed, F.col("word"))))
    marked = materialize(
        met.groupBy("_key").agg(chosen(True).alias("_removed"), chosen(False).alias("_general")), "pii-marked"
    )
    empty = F.array().cast(_SPAN)

    def occurrences(pattern: str) -> Column:
        return F.when(F.col(pattern).isNotNull(), matches(F.col("_text"), F.col(pattern), pattern)).otherwise(empty)

    def term(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("word"), (m["kind"] == "_removed").alias("removed")
        )

    free = lambda m: ~F.exists("_spans", lambda s: (s["start"] < m["end"]) & (s["end"] > m["start"]))
    terms = F.transform(F.filter(F.concat(occurrences("_removed"), occurrences("_general")), free), term)
    # Texts without any such word are not shuffled.
    bits = key_bits(marked, "_key")
    without = found.where(~may_hold(bits, "_key")).withColumn("_terms", F.lit(None))
    met = found.where(may_hold(bits, "_key")).join(marked, "_key", "left").withColumn("_terms", F.sort_array(terms))
    met = met.drop("_removed", "_general")
    return met.unionByName(without.withColumn("_terms", F.array().cast(met.schema["_terms"].dataType)))


def find_pii(docs: DataFrame, **thresholds) -> DataFrame:
    """One row per row of `docs` (`doc_id`, `text`): counts per kind, all spans, and what terms disclose.

    Columns: `doc_id`, `n_email`, `n_ip`, `n_card`, `n_phone`, `n_term`, `base_sha256`, `spans`.
    """
    found = _with_terms(docs.select("doc_id", "text"), **thresholds)
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = spans_text(F.col("_spans"))
    extra = spans_text(
        F.transform("_terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    )
    return found.select(
        "doc_id",
        *[count(kind) for kind in KINDS],
        F.size("_terms").cast("long").alias("n_term"),
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("_spans") > 0, base), F.when(F.size("_terms") > 0, extra)).alias("spans"),
    )


def _redacted(text: Column, spans: Column, terms: Column) -> Column:
    """The text with marks in place of its spans; `spans` and `terms` are sorted together by start."""
    general = lambda word: (
        F.when(word.rlike(r"\p{N}"), "[NUMBER]").when(word.rlike(r"^\p{Lu}"), "[NAME]").otherwise("[WORD]")
    )
    item = lambda start, end, mark: F.struct(start.alias("start"), end.alias("end"), mark.alias("mark"))
    marks = F.concat(
        F.transform(spans, lambda s: item(s["start"], s["end"], F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))),
        F.transform(terms, lambda t: item(t["start"], t["end"], F.when(t["removed"], "").otherwise(general(t["word"])))),
    )

    def joined(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        merged = item(last["start"], F.greatest(last["end"], s["end"]), last["mark"])
        return F.when(
            F.when(F.size(done) > 0, s["start"] < last["end"]).otherwise(False),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(merged)),
        ).otherwise(F.concat(done, F.array(s)))

    empty = F.array().cast("array<struct<start:bigint,end:bigint,mark:string>>")

    def built(parts: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.get(parts, i - 1)["end"]).otherwise(0).cast("int")
        pieces = F.transform(
            parts,
            lambda s, i: F.concat(F.substr(text, upto(i) + 1, s["start"].cast("int") - upto(i)), s["mark"]),
        )
        return F.concat(F.array_join(pieces, ""), F.substr(text, upto(F.size(parts)) + 1))

    return let(F.aggregate(F.sort_array(marks), empty, joined), built)


def redact(docs: DataFrame, **thresholds) -> DataFrame:
    """`docs` with personal data marked in `text` (and `n_chars`, if present, counted again).

    Rows without base spans and disclosing terms stay as they are. The columns stay the same.
    """
    found = _with_terms(docs, **thresholds)
    touched = (F.size("_spans") > 0) | (F.size("_terms") > 0)
    changed = found.withColumn("_touched", touched).withColumn(
        "text", F.when(F.col("_touched"), _redacted(F.col("_text"), F.col("_spans"), F.col("_terms"))).otherwise(F.col("text"))
    )
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", F.when(F.col("_touched"), counted).otherwise(F.col("n_chars")))
    return changed.select(*docs.columns)
