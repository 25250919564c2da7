"""Personal data: spans by pattern, and terms that reveal them by co-occurrence.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone
numbers. The values found are the protected entities of the corpus. A term (a
run of letters, marks and digits outside all base spans, in the line of an entity
or at most ``window`` lines above or below) is measured by how much of the
entity's information it discloses:

    disclosure(t, e) = PMI(t; e) / IC(e)
    PMI(t; e) = ln(N * n(t, e) / (n(t) * n(e)))      IC(e) = ln(N / n(e))

with counts of documents over the whole corpus: ``n(t, e)`` those with the term
near the entity, ``n(t)`` those with the term anywhere. The value is 1
when the term occurs only with the entity, and 0 when they are independent.
Terms at ``generalise_at`` or more become a class name, at ``remove_at`` or more
they go. Pairs need ``min_support`` documents, and an entity that all documents
hold carries no information. Every count is one of distinct texts, so exact copies
under other ids are no evidence; near copies still are. With ``copies_count=True`` each
different id counts. Words of fewer than ``min_chars`` characters are no terms;
by default words of any length are. ``WHOLE`` names these defaults.

Positions of matches, lines and replacements are summed up and cut in blocks, so a text with very many
of them takes time by little more than its length. A line with many entities that occur in ``min_support`` texts
makes a row per entity and word of it.

Defined cases: null and empty texts have no spans and stay as they are. Equal
rows give equal results; ids may repeat or be null. Other columns pass through.
An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import row_key, stored
from batchloom.llm.spans import as_text, blanked, labelled, let, matches, matches_if, replaced, sums_before

KINDS = ["email", "ip", "card", "phone"]

# Matches begin where a run of characters begins, or where the last match ended:
# that is where the leftmost match begins too, and long runs are read once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{M}\p{N}]+"
TERM_GAP = r"[^\p{L}\p{M}\p{N}]+"

TERM_SPAN = "struct<start:int,end:int,disclosure:double,term:string>"

#: Options by which no word is left out and no copy is evidence.
WHOLE = {"min_chars": 1, "copies_count": False}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right check digit."""

    def add(total: Column, x: Column) -> Column:
        return total + F.when(x > 9, x - 9).otherwise(x)

    doubled = F.transform(
        F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int"))
    )
    return F.aggregate(F.filter(doubled, lambda x: x.isNotNull()), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    plain = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(plain) <= 3) & (plain.cast("int") <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, as an array column per kind."""
    email = matches_if(text.contains("@"), text, EMAIL)
    ip = F.filter(
        matches_if(text.rlike(r"[0-9]\.[0-9]"), text, IP), lambda s: F.forall(F.split(s["value"], r"\."), _small)
    )

    def is_card(s: Column) -> Column:
        n = F.length(_digits(s["value"]))
        return n.between(16, 19) & luhn(_digits(s["value"]))

    card = F.filter(matches_if(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), text, CARD), is_card)
    phone = F.filter(
        matches_if(text.contains("+"), text, PHONE), lambda s: F.length(_digits(s["value"])).between(8, 15)
    )
    return {"email": email, "ip": ip, "card": card, "phone": phone}


def unit(copies_count: bool) -> Column:
    """What is counted: each different (doc_id, text), or each different text."""
    return row_key("doc_id", "text") if copies_count else row_key("text")


def with_base(docs: DataFrame, *keep: str) -> DataFrame:
    """Key, kept columns, and one array of spans per kind, for every document."""
    source = docs.select(row_key("doc_id", "text").alias("key"), *keep, "text")
    return source.select("key", *keep, "text", *[c.alias(k) for k, c in base_spans(F.col("text")).items()])


def _with_value(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["value"].alias("part"))


def _entity(s: Column) -> Column:
    plain = F.when(s["kind"].isin("card", "phone"), _digits(s["value"])).otherwise(F.lower(s["value"]))
    return F.concat_ws(":", s["kind"], plain)


def words(text: Column, min_chars: int = 1) -> Column:
    """The different words of a text, each lower-cased by itself."""
    found = F.filter(F.split(text, TERM_GAP, -1), lambda w: F.length(w) >= min_chars)
    return F.array_distinct(F.transform(found, F.lower))


def with_blanks(found: DataFrame, *keep: str) -> DataFrame:
    """Texts with an entity, blanked, and the words that only blanking lays bare.

    Such a word is what lies outside a span of a longer one, as in ``éa@b.co``.
    Texts without an entity become null.
    """
    spans = F.concat(*[F.transform(k, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS])
    given = found.select("*", spans.alias("all_spans"))
    both = given.select(*keep, *KINDS, "text", F.when(F.size("all_spans") > 0, blanked(F.col("text"), F.col("all_spans"))).alias("blanked"))
    bare = F.when(F.col("blanked").isNotNull(), F.array_except(words(F.col("blanked")), words(F.col("text"))))
    return both.select(*keep, *KINDS, F.col("blanked").alias("text"), bare.alias("bare"))


def entity_lines(found: DataFrame, min_support: int, window: int) -> DataFrame:
    """A row per line near an entity: key, unit, line_start, line (blanked), entities with counts.

    Entities of fewer than ``min_support`` texts cannot have pairs of as many, and
    are left out before any text is cut into lines.
    """
    spans = F.concat(*[labelled(k, F.transform(F.col(k), _with_value)) for k in KINDS])
    texts = found.where(F.col("text").isNotNull())
    each = texts.select("key", "unit", F.explode(spans).alias("s")).select("key", "unit", F.col("s.start").alias("start"), _entity(F.col("s")).alias("entity"))
    counts = (
        each.select("entity", "unit").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
        .where(F.col("n_entity") >= min_support)
    )
    marks = each.join(counts, "entity").groupBy("key").agg(F.collect_set(F.struct("start", "entity", "n_entity")).alias("marks"))

    def placed(parts: Column) -> Column:
        starts = sums_before(F.transform(parts, lambda line: F.length(line) + 1))
        return F.arrays_zip(starts.alias("line_start"), parts.alias("line"))

    cut = texts.select("key", "unit", "text").dropDuplicates(["key"]).join(marks, "key").select(
        "key", "unit", "marks", let(F.split("text", "\n", -1), placed).cast("array<struct<line_start:int,line:string>>").alias("rows")
    )

    def around(row: Column, i: Column) -> Column:
        first = F.get("rows", F.greatest(i - window, F.lit(0)))
        last = F.get("rows", F.least(i + window, F.size("rows") - 1))
        end = last["line_start"] + F.length(last["line"])
        return F.struct(row["line_start"].alias("line_start"), row["line"].alias("line"), first["line_start"].alias("first"), end.alias("last"))

    lines = cut.select("key", "unit", "marks", F.explode(F.transform("rows", around)).alias("row")).select("key", "unit", "marks", "row.*")
    near = F.filter("marks", lambda m: (m["start"] >= F.col("first")) & (m["start"] <= F.col("last")))
    entities = F.array_distinct(F.transform(near, lambda m: F.struct(m["entity"].alias("entity"), m["n_entity"].alias("n_entity"))))
    return lines.select("key", "unit", "line_start", "line", entities.alias("entities")).where(F.size("entities") > 0)


def line_terms(lines: DataFrame, min_chars: int) -> DataFrame:
    """Words near entities: key, unit, line_start, entity, n_entity, term; once per line."""
    each = lines.select("key", "unit", "line_start", words(F.col("line"), min_chars).alias("terms"), F.explode("entities").alias("e"))
    return each.select("key", "unit", "line_start", "e.entity", "e.n_entity", F.explode("terms").alias("term"))


def term_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Number of counted texts that hold each term, by the term's hash."""
    inside = texts.select(F.explode(words(F.col("text"))).alias("t"))
    bare = found.where(F.size("bare") > 0).dropDuplicates(["unit"]).select(F.explode("bare").alias("t"))
    return inside.unionAll(bare).groupBy(F.xxhash64("t").alias("term_hash")).agg(F.count("*").alias("n_term"))


def disclosures(
    texts: DataFrame, found: DataFrame, lines: DataFrame, threshold: float, min_support: int = 3, min_chars: int = 1
) -> DataFrame:
    """Pairs (entity, term) that disclose at least ``threshold``, with their value.

    Counts cover the whole corpus. A pair is first reduced to one row per counted
    text, so an entity in a third of all is added up before the shuffle.
    """
    n_docs = found.select("unit").distinct().select(F.count("*").alias("n_docs"))
    pairs = (
        line_terms(lines, min_chars)
        .select("entity", "n_entity", "term", "unit")
        .distinct()
        .groupBy("entity", "n_entity", "term")
        .agg(F.count("*").alias("n_pair"))
        .where(F.col("n_pair") >= min_support)
        .withColumn("term_hash", F.xxhash64("term"))
    )
    measured = pairs.join(term_counts(texts, found), "term_hash")
    n = n_docs.scalar().cast("double")
    pmi = F.log(n * F.col("n_pair") / (F.col("n_term").cast("double") * F.col("n_entity")))
    information = F.log(n / F.col("n_entity"))
    value = F.when(information > 0, pmi / information)
    return measured.select("entity", "term", value.alias("disclosure")).where(F.col("disclosure") >= threshold)


def term_spans(lines: DataFrame, pairs: DataFrame, min_chars: int) -> DataFrame:
    """Spans of disclosing terms in the lines near their entities, one row per key."""
    hits = line_terms(lines, min_chars).join(pairs, ["entity", "term"])
    one = hits.groupBy("key", "line_start", "term").agg(F.max("disclosure").alias("disclosure"))
    with_hits = lines.join(one.select("key", "line_start").distinct(), ["key", "line_start"], "left_semi")
    each = with_hits.select("key", "line_start", F.explode(matches(F.col("line"), TERM)).alias("w"))
    each = each.select(
        "key", "line_start", F.lower("w.value").alias("term"),
        (F.col("line_start") + F.col("w.start")).alias("start"), (F.col("line_start") + F.col("w.end")).alias("end"),
    )
    found = each.where(F.col("end") - F.col("start") >= min_chars).join(one, ["key", "line_start", "term"])
    span = F.struct("start", "end", "disclosure", "term")
    return found.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("terms"))


class Sanitiser:
    """Spans and sanitised texts of one corpus."""

    def __init__(
        self, docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, min_support: int = 3,
        window: int = 5, min_chars: int = 1, copies_count: bool = False,
    ):
        self.docs, self.remove_at = docs, remove_at
        rows = docs.select("doc_id", "text", unit(copies_count).alias("unit"))
        self.base = stored(with_blanks(with_base(rows, "doc_id", "unit"), "key", "doc_id", "unit"), "pii-found")
        self.lines = stored(entity_lines(self.base, min_support, window), "pii-lines")
        texts = rows.groupBy("unit").agg(F.first("text").alias("text"))
        pairs = disclosures(texts, self.base, self.lines, generalise_at, min_support, min_chars)
        self.terms = term_spans(self.lines, pairs, min_chars)

    def spans(self) -> DataFrame:
        """A row per document: key, doc_id, an array per kind, and ``terms``."""
        terms = F.coalesce("terms", F.array().cast(f"array<{TERM_SPAN}>"))
        return self.base.drop("unit", "text", "bare").join(self.terms, "key", "left").withColumn("terms", terms)

    def texts(self) -> DataFrame:
        """The documents with sanitised texts; all columns in their order.

        Entities become ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``, terms become
        ``[TERM]`` or nothing. ``n_chars``, where there is one, follows the new text.
        """
        # Kinds are named so that of two spans at one start the entity comes first.
        term = F.transform(
            "terms",
            lambda s: F.struct(
                F.when(s["disclosure"] >= self.remove_at, F.lit("removed")).otherwise(F.lit("term")).alias("kind"),
                s["start"].alias("start"), s["end"].alias("end"), s["term"].alias("value"),
            ),
        )
        spans = F.concat(*[labelled(k, F.col(k)) for k in KINDS], term).alias("spans")
        changes = self.spans().select(F.col("key").alias("__key"), spans).where(F.size("spans") > 0)
        changes = changes.groupBy("__key").agg(F.first("spans").alias("__spans"))

        def mark(s: Column) -> Column:
            return F.when(s["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

        names = self.docs.columns
        out = self.docs.withColumn("__key", row_key("doc_id", "text")).join(changes, "__key", "left")
        text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("__spans"), mark))
        out = out.withColumn("text", text)
        if "n_chars" in names:
            out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
        return out.select(*[F.col(f"`{c}`") for c in names])


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """Documents without personal data and without the terms that reveal them."""
    return Sanitiser(docs, **options).texts()


def digest(docs: DataFrame, **options) -> DataFrame:
    """Counts, a hash of the base spans, and all spans of every document."""
    base = F.concat(*[as_text(k, F.col(k)) for k in KINDS])
    joined = F.concat(base, F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"])))
    return Sanitiser(docs, **options).spans().select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(joined, ",").alias("spans"),
    )
