"""Personal data: fixed kinds by pattern, and terms that give them away, in built-in functions only.

The protected entities are the values the patterns find. How much a term t in the documents of an entity c reveals
of it is their pointwise mutual information over the corpus as a share of the information c itself
carries: log(p(c|t) / p(c)) / log(1 / p(c)), with p(c) = n(c) / N and n counting different documents
of all N. p(c|t) = (n(c,t) + m p(c)) / (n(t) + m) is shrunk to p(c) by ``prior`` m documents, so the
share is defined for a pair seen once too and nears 1 with the evidence if t occurs only where c
does. Terms whose share reaches ``disclosure`` are generalised wherever they stand in the documents
that hold the entity. An entity that all documents hold carries no information, so nothing gives it
away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Stash, fresh, let

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _NAME = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A pattern cannot start inside a run that it failed on (unless the last match ended there), and
# repeats never give back, so that long runs of one character class cost linear time.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_NAME}]++(?:\.[{_NAME}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# A match must hold the character, which is cheaper to look for than the pattern.
_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
DISCLOSURE = 0.8
PRIOR = 2.0
# Rows that a side of a join may have to be broadcast; beyond it the join is shuffled.
BROADCAST_ROWS = 500_000
TERM = r"[\p{L}\p{N}]{3,}"
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string of at most 19 digits is a multiple of ten."""

    def value(d: Column, i: Column) -> Column:
        n = d.cast("int")
        doubled = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.when(i % 2 == 1, doubled).otherwise(n)

    total = F.aggregate(
        F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), 0), value), F.lit(0), lambda a, n: a + n
    )
    return total % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    size = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
    return (
        F.when(kind == "ip", value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
        .when(kind == "card", F.when(size.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", size.between(9, 15))
        .otherwise(True)
    )


def _pieces(text: Column, kind: str) -> Column:
    """Matches of a kind, each with the length of the text between it and the one before."""
    pattern = F.lit(PATTERNS[kind])
    needs = text.rlike("[0-9]") if kind == "card" else F.contains(text, F.lit(_NEEDS[kind]))

    def row(gaps: Column, value: Column, i: Column) -> Column:
        gap = F.get(gaps, i)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("place"),
            F.length(gap).cast("bigint").alias("gap"),
            value.alias("value"),
        )

    rows = let(
        F.regexp_extract_all(text, pattern, 0),
        lambda found: let(
            F.split(text, PATTERNS[kind], -1),
            lambda gaps: F.transform(found, lambda value, i: row(gaps, value, i)),
        ),
    )
    return F.when(needs, rows)


def entities(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for every valid match of every different (doc_id, text), with its place.

    Offsets are code points, end exclusive. The text before a match and between matches is measured
    in the row that holds it; only the matches themselves are shuffled.
    """
    whole = F.col(text)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("_t"))
    found = rows.select(
        "doc_id",
        "h",
        F.explode(
            F.filter(F.array(*[_pieces(F.col("_t"), k) for k in KINDS]), lambda x: x.isNotNull())
        ).alias("all"),
    ).select("doc_id", "h", F.inline("all"))
    # repeated rows count once
    found = found.groupBy("doc_id", "h", "kind", "place").agg(
        F.min(F.struct("gap", "value")).alias("m")
    ).select("doc_id", "h", "kind", "place", "m.*")
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("place")
    end = F.sum(F.col("gap") + F.length("value")).over(order)
    return (
        found.withColumn("end", end)
        .withColumn("start", F.col("end") - F.length("value"))
        .filter(valid(F.col("kind"), F.col("value")))
        .select("doc_id", "h", "kind", "start", "end", "value")
    )


def _terms(text: Column) -> Column:
    """Different terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), 0), F.lower))


def _small(side: DataFrame) -> DataFrame:
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def term_counts(stash: Stash, df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(term, n_term) over different texts, and one row for each of these.

    Texts are not moved: rows of a text with c copies are counted by c, and their number is divided
    by c, which leaves no rest.
    """
    rows = df.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).filter("t is not null")
    copies = stash.keep(rows.groupBy("h").agg(F.count("*").alias("copies")), "copies")
    again = copies.filter("copies > 1")
    words = rows.join(_small(again), "h", "left").select(
        F.explode(_terms(F.col("t"))).alias("term"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    by_copies = words.groupBy("term", "copies").agg(F.count("*").alias("rows"))
    of_term = by_copies.groupBy("term").agg(F.sum(F.expr("rows div copies")).alias("n_term"))
    return of_term, copies


def _placed(texts: DataFrame, marks: DataFrame, found: DataFrame) -> DataFrame:
    """h, start and end of marked terms in different texts (h, t), but for terms that start inside an entity."""

    def row(both: Column) -> Column:
        word = F.regexp_extract(both, f"({TERM})$", 1)
        size = F.length(both).cast("bigint")
        return F.struct(size.alias("size"), F.lower(word).alias("term"), F.length(word).alias("width"))

    steps = F.regexp_extract_all("t", F.lit(rf"(?s)(.*?)({TERM})"), 0)
    words = texts.select("h", F.posexplode(F.transform(steps, row)).alias("place", "w")).select("h", "place", "w.*")
    end = F.sum("size").over(Window.partitionBy("h").orderBy("place"))
    words = words.withColumn("end", end).select("h", "term", (F.col("end") - F.col("width")).alias("start"), "end")
    marked = words.join(marks, ["h", "term"]).select("h", "start", "end", F.lit(1).alias("word"))
    own = found.select("h", "start", "end").distinct().join(_small(marks.select("h").distinct()), "h", "left_semi")
    both = marked.unionByName(own.withColumn("word", F.lit(0)))
    # entities come before words that start with them
    before = Window.partitionBy("h").orderBy("start", "word").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.when(F.col("word") == 0, F.col("end"))).over(before)
    return both.withColumn("reach", reach).filter("word = 1 and coalesce(reach, 0) <= start").select("h", "start", "end")


def disclosing(
    stash: Stash,
    df: DataFrame,
    found: DataFrame,
    text: str,
    disclosure: float,
    prior: float,
) -> DataFrame:
    """Spans of terms in the whole texts of the entities that they give away: h, start, end.

    Terms of a text meet its entities only if their counts let the share reach ``disclosure``, were
    they together as often as the rarer of them is seen; no pair that reaches it is lost by that.
    """
    of_term, copies = term_counts(stash, df, text)
    total = copies.count()
    size = float(max(total, 1))
    holders = found.select("kind", F.lower("value").alias("value"), "h").distinct()
    # entities of the same texts have the same counts with every term, so they go as one: a list of
    # addresses meets each word of its text once
    same = {c: F.bit_xor(F.xxhash64("h", F.lit(c))) for c in ("x", "y")}
    of_entity = holders.groupBy("kind", "value").agg(F.count("*").alias("n_entity"), *[v.alias(c) for c, v in same.items()])
    held = holders.join(of_entity, ["kind", "value"]).filter(F.col("n_entity") < total)
    held = stash.keep(held.select("h", "x", "y", "n_entity").distinct(), "held")
    most = held.agg(F.max("n_entity")).first()[0]
    whole = _small(found.select("h").distinct())
    texts = df.select(F.xxhash64(text).alias("h"), F.col(text).alias("t")).join(whole, "h", "left_semi")
    if most is None:
        return held.select("h", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))

    def reached(both: Column, n_term: Column, n_entity: Column) -> Column:
        """The share reaches disclosure, without logarithms."""
        own = n_entity / F.lit(size)
        return (both + prior * own) / (n_term + prior) >= F.pow(own, F.lit(1 - disclosure))

    # what the most frequent entity admits, every rarer one does too; a little room for rounding
    limit = (most + prior * most / size) / (most / size) ** (1 - disclosure) * 1.000001
    rare = of_term.filter(F.col("n_term") <= limit)
    words = texts.select("h", F.explode(_terms(F.col("t"))).alias("term")).distinct().join(rare, "term")
    n_term, n_entity = F.col("n_term"), F.col("n_entity")
    pairs = words.join(held, "h").filter(reached(F.least(n_term, n_entity), n_term, n_entity))
    pairs = stash.keep(pairs, "pairs")
    stash.drop(copies, held)
    together = pairs.groupBy("x", "y", "term").agg(
        F.count("*").alias("n_both"), F.min("n_term").alias("n_term"), F.min("n_entity").alias("n_entity")
    )
    revealing = together.filter(reached(F.col("n_both"), n_term, n_entity)).select("x", "y", "term")
    marks = stash.keep(pairs.join(revealing, ["x", "y", "term"]).select("h", "term").distinct(), "marks")
    stash.drop(pairs)
    marked = texts.join(_small(marks.select("h").distinct()), "h", "left_semi").dropDuplicates(["h"])
    return _placed(marked, marks, found)


def find(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    disclosure: float = DISCLOSURE,
    prior: float = PRIOR,
) -> DataFrame:
    """doc_id, h (hash of the text) and spans, one row for each different row with a span.

    ``spans`` is an array of (kind, start, end): the fixed kinds as listed, then terms, each by
    start. Null and empty texts have no spans; rows that share doc_id and text share one result; a
    null doc_id is a key like any other; an empty table gives an empty result.
    """
    stash = Stash(df.sparkSession, "pii")
    found = stash.keep(entities(df, doc_id, text), "entities")
    terms = disclosing(stash, df, found, text, disclosure, prior)
    of_text = terms.groupBy("h").agg(F.collect_list(F.struct(F.lit("term").alias("kind"), "start", "end")).alias("s"))
    owners = found.select("doc_id", "h").distinct()
    terms = owners.join(of_text, "h").select("doc_id", "h", F.inline("s"))
    spans = found.select("doc_id", "h", "kind", "start", "end").unionByName(terms)
    order = F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), F.col("kind"))
    ordered = F.array_sort(
        F.collect_list(F.struct(order.alias("o"), "start", "end", "kind"))
    )
    return spans.groupBy("doc_id", "h").agg(ordered.alias("spans"))


def attach(df: DataFrame, found: DataFrame, doc_id: str, text: str, name: str = "spans") -> DataFrame:
    """Add the spans to every row of ``df``; an empty array where there are none."""
    made = [c for c in df.columns if c != name]
    # names that no column of the rows has
    own, of, its, their, given = (fresh(df, c) for c in ("_id", "_text_hash", "_found_id", "_found_hash", "_found_spans"))
    keyed = df.select(
        *[F.col(f"`{c}`") for c in made], F.col(doc_id).alias(own), F.xxhash64(F.col(text)).alias(of)
    )
    right = found.select(F.col("doc_id").alias(its), F.col("h").alias(their), F.col("spans").alias(given))
    none = F.array().cast(found.schema["spans"].dataType)
    return (
        keyed.join(right, (F.col(of) == F.col(their)) & F.col(own).eqNullSafe(F.col(its)), "left")
        .withColumn(name, F.coalesce(given, none))
        .drop(own, of, its, their, given)
    )


def redact(text: Column, spans: Column) -> Column:
    """Text with every run of overlapping spans replaced by the masks of the first of them."""
    masks = F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv])
    by_start = F.array_sort(
        F.transform(
            spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("e"), s["kind"].alias("kind"))
        )
    )
    state = F.struct(
        F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")
    )

    def step(a: Column, s: Column) -> Column:
        end = -s["e"]
        gap = F.substr(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        taken = F.concat(a["out"], F.array(gap, F.element_at(masks, s["kind"])))
        inside = s["start"] < a["at"]
        return F.struct(
            F.greatest(a["at"], end).alias("at"),
            F.when(inside, a["out"]).otherwise(taken).alias("out"),
        )

    def finish(a: Column) -> Column:
        rest = F.substr(text, (a["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(a["out"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(by_start, state, step, finish)).otherwise(text)
