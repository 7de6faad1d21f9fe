"""Information-theoretic sanitisation of personal data; DataFrame functions only.

Patterns find the protected entities.  The corpus then says which words give them away: for a term t and an
entity e, the share of documents with t that also hold e, p(e|t), and the information log2(p(e|t) / p(e)).  A
term is a run of letters and digits outside entities, of any length and anywhere in the text.  One that passes
both thresholds in enough different texts is a disclosing term: wherever it stands, in whatever document, it is
generalised to a mark, or removed if it nearly always means that entity.  An entity that stands in fewer than ``LEAST_TEXTS``
different texts gives no evidence of what discloses it; it is marked itself, but no term is for its sake.

Patterns are written so that a search takes time in proportion to the text: quantifiers do not give back
what they took, and a run of characters that cannot start a match is tried only at its beginning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumicell.llm.shared import any_names, cut, free_name

#: Kinds in the order of their spans: pattern, a cheap test that a text may hold it, and what a match must pass.
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({text}, '@')", "true"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"{text} rlike r'[0-9]\.[0-9]++\.[0-9]'", rf"x.m rlike r'^{_OCTET}(\.{_OCTET}){{3}}$'"),
    "card": (
        r"[0-9](?:[\x20-]?[0-9])++",
        r"{text} rlike r'[0-9](?:[\x20-]?[0-9]){11}'",
        "CASE WHEN length(translate(x.m, ' -', '')) BETWEEN 12 AND 19 THEN aggregate(transform(split(reverse(translate(x.m, ' -', '')), ''), "
        "(d, i) -> CASE WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN 2 * int(d) - 9 ELSE 2 * int(d) END), 0, (a, d) -> a + d) % 10 = 0 ELSE false END",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({text}, '+')", "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15"),
}
TERM = "term"
_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"
_WORD, _GAP = r"[\p{L}\p{N}]++", r"[^\p{L}\p{N}]+"
#: The most disclosing terms that are broadcast.
_SENT = 1 << 18
#: A disclosing term: least p(e|t), least information in bits, least number of different texts; and p(e|t) from which it is removed.
LEAST_SHARE, LEAST_BITS, LEAST_TEXTS, REMOVE_SHARE = 0.5, 3.0, 3, 0.9


def matches(text: str, pattern: str, kind: int, possible: str, passes: str) -> str:
    """SQL for the spans of one kind: leftmost non-overlapping matches that pass, by code points, end exclusive.

    The pieces between matches and the matches themselves add up to the positions.
    """
    literal = "r'" + pattern + "'"
    pieces = f"transform(split({text}, {literal}, -1), p -> length(p))"  # one more than there are matches
    found = f"zip_with(regexp_extract_all({text}, {literal}, 0), {pieces}, (m, gap) -> named_struct('m', m, 'gap', gap))"
    placed = (
        f"aggregate({found}, named_struct('at', 0L, 'out', cast(array() AS array<{_SPAN}>)), (a, x) -> CASE WHEN x.m IS NULL THEN a ELSE named_struct("
        f"'at', a.at + x.gap + length(x.m), "
        f"'out', CASE WHEN {passes} THEN array_append(a.out, named_struct('start', a.at + x.gap, 'kind', {kind}, 'end', a.at + x.gap + length(x.m), 'value', x.m)) ELSE a.out END) END, a -> a.out)"
    )
    return f"CASE WHEN {possible.replace('{text}', text)} THEN {placed} ELSE cast(array() AS array<{_SPAN}>) END"


def base_spans(text: str = "text") -> str:
    """SQL for all base spans of a text column, by start, then kind."""
    each = [matches(text, pattern, kind, possible, passes) for kind, (pattern, possible, passes) in enumerate(KINDS.values())]
    return f"array_sort(concat({', '.join(each)}))"


def find(documents: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_key, base, rest)``: base spans, and the text with spaces in their place."""
    text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    based = text.withColumn("text_key", F.xxhash64("text")).withColumn("base", F.expr(base_spans()))
    rest = (
        "CASE WHEN size(base) = 0 THEN text ELSE aggregate(base, named_struct('at', 0L, 'out', ''), (a, s) -> CASE WHEN s.end <= a.at THEN a ELSE named_struct('at', s.end, "
        "'out', concat(a.out, substring(text, int(a.at) + 1, int(greatest(s.start - a.at, 0L))), repeat(' ', int(s.end - greatest(s.start, a.at))))) END, a -> concat(a.out, substring(text, int(a.at) + 1))) END"
    )
    return based.select("doc_id", "text_key", "base", F.expr(rest).alias("rest"))


def terms(found: DataFrame, *names: str) -> DataFrame:
    """Rows ``(*names, term)``: the distinct terms of each document."""
    words = F.array_distinct(F.transform(F.split("rest", _GAP), F.lower))
    return found.select(*names, F.explode(F.filter(words, lambda w: w != "")).alias("term"))


def disclosures(found: DataFrame) -> DataFrame:
    """Rows ``(entity, term, share, bits)`` for every disclosing term, from counts over all documents.

    Only entities and terms that can still pass are paired: both need enough texts, p(e) is at most
    2^-LEAST_BITS, and as share is at most with_entity / with_term, a term is not much more frequent than its entity.
    """
    held = F.array_distinct(F.transform("base", lambda s: F.concat(s.kind.cast("string"), F.lit(":"), F.lower(s.value))))
    entity_docs = cut(found.select("text_key", F.explode(held).alias("entity")).groupBy("text_key", "entity").agg(F.count("*").alias("docs")))
    total = max(1, found.count())
    entities = entity_docs.groupBy("entity").agg(F.sum("docs").alias("with_entity"), F.count("*").alias("texts"))
    entities = cut(entities.filter((F.col("texts") >= LEAST_TEXTS) & (F.col("with_entity") <= total * 2.0**-LEAST_BITS)).select("entity", "with_entity"))
    most = entities.agg(F.max("with_entity")).first()[0] or 0
    frequency = terms(found).groupBy("term").agg(F.count("*").alias("with_term")).filter(f"with_term >= {LEAST_TEXTS} and with_term * {LEAST_SHARE} <= {most}")
    of = entity_docs.join(entities, "entity").groupBy("text_key").agg(F.collect_list(F.struct("entity", "with_entity")).alias("entities"), F.max("docs").alias("docs"))  # one text's entities
    texts = found.filter("size(base) > 0").join(of, "text_key").dropDuplicates(["text_key"])
    pairs = terms(texts, "entities", "docs").join(frequency, "term").select("term", "with_term", "docs", F.explode("entities").alias("e")).select("term", "with_term", "docs", "e.*")
    pairs = pairs.filter(f"with_term * {LEAST_SHARE} <= with_entity")
    joint = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.sum("docs").alias("both"), F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    counted = joint.withColumn("share", F.col("both") / F.col("with_term"))
    counted = counted.withColumn("bits", F.log2(F.col("share") / (F.col("with_entity") / total)))
    return counted.filter((F.col("share") >= LEAST_SHARE) & (F.col("bits") >= LEAST_BITS)).select("entity", "term", "share", "bits")


def personal_data(documents: DataFrame) -> DataFrame:
    """Rows ``(doc_id, text_key, base, extra)``, one for each document: base spans and every place of a disclosing term.

    ``extra`` holds ``(start, end, term, share)``; a term of several entities counts with its largest share.
    A null or empty text has no spans; repeated rows have the same; an empty table gives no rows; other
    columns are ignored.
    """
    found = find(documents)
    telling = cut(disclosures(found).groupBy("term").agg(F.max("share").alias("share")))
    few = F.broadcast(telling) if telling.count() <= _SENT else telling
    met = terms(found, "text_key").join(few, "term").groupBy("text_key", "term").agg(F.max("share").alias("share"))
    hits = met.groupBy("text_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))  # one text's terms
    places = matches("rest", _WORD, 0, "true", "map_contains_key(shares, lower(x.m))")
    extra = (
        f"CASE WHEN shares IS NULL THEN cast(array() AS array<struct<start:bigint,end:bigint,term:string,share:double>>) ELSE transform({places}, "
        "t -> named_struct('start', t.start, 'end', t.end, 'term', lower(t.value), 'share', shares[lower(t.value)])) END"
    )
    return found.join(hits, "text_key", "left").select("doc_id", "text_key", "base", F.expr(extra).alias("extra"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, from ``personal_data``."""
    names = list(KINDS)
    kind = F.array(*[F.lit(k) for k in [*names, TERM]])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.kind.alias("kind"), s.end.alias("end")))
    extra = F.transform("extra", lambda s: F.struct(s.start.alias("start"), F.lit(len(names)).alias("kind"), s.end.alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s.kind == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(names)],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat(base, extra))).alias("spans"),
        F.size("extra").cast("long").alias("n_term"),
    )


@any_names
def sanitise(documents: DataFrame) -> DataFrame:
    """``documents`` with their texts sanitised: entities become ``[EMAIL]`` and so on, disclosing terms ``[TERM]`` or nothing.

    Where spans overlap, the one that starts first is replaced and what overlaps it is left out.
    """
    found = personal_data(documents)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    base = F.transform("base", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.element_at(marks, s.kind + 1).alias("mark")))
    extra = F.transform("extra", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.when(s.share >= REMOVE_SHARE, "").otherwise("[TERM]").alias("mark")))
    key, doc, of_text, at = (free_name(documents, n) for n in ("pii_key", "pii_doc", "pii_text", "pii_spans"))
    spans = found.select(F.col("doc_id").alias(doc), F.col("text_key").alias(of_text), F.array_sort(F.concat(base, extra)).alias(at)).dropDuplicates([doc, of_text])
    keyed = documents.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    met = keyed.join(spans, keyed.doc_id.cast("long").eqNullSafe(spans[doc]) & (keyed[key] == spans[of_text]))
    step = (
        f"aggregate({at}, named_struct('at', 0L, 'out', ''), (a, s) -> CASE WHEN s.start < a.at THEN a ELSE named_struct('at', s.end, "
        "'out', concat(a.out, substring(text, int(a.at) + 1, int(s.start - a.at)), s.mark)) END, a -> concat(a.out, substring(text, int(a.at) + 1)))"
    )
    return met.withColumn("text", F.expr(step)).select(*documents.columns)
