"""Secrets: spans by pattern, told apart by who holds the same value.

Base spans are assignments to secret-like names, access keys and long hex
texts. Their values, and other high-entropy tokens, are the candidates. The
hash of each candidate is counted over the whole corpus: in how many
repositories (documents) and by how many owners (sources) it occurs.

* ``example``: held by ``example_owners`` owners or more; widely copied.
* ``live``: random, held by at most ``live_owners`` owners, and in at most
  ``live_repos`` repositories: a token in more texts of one owner than that is
  its boilerplate rather than a credential.
* ``unclear``: what lies between, or is not random.

Random means letters and digits, ``distinct_chars`` different characters, and

* bits per character (those of equal pairs, which have no bias in short texts)
  within one bit of the alphabet's: 4 for hex, 5.17 for one case and digits, 5.95
  for both cases and digits;
* not made of words: less than ``READABLE`` percent of its letters stand in letter
  pairs that are usual in words. Paths, file names and identifiers do. Hex texts
  have too few letters for that and are not asked.

Base spans stay whatever their class. The method adds a span of kind ``owned``
for every other token that is live.

Defined cases: null and empty texts have no spans. A null source counts as one
owner. Equal rows give equal results; ids may repeat or be null, and a repeated id
of one source is one repository. A count that equals a limit is within it. An
empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import row_key, stored
from batchloom.llm.spans import labelled, matches_if, replaced

KINDS = ["assign", "access", "hex"]

_NAMES = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
ASSIGN = rf"""(?:{_NAMES})["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
# A match of the shorter form that fails its length holds no other match that
# would not fail too, so the lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"
# Usual pairs of letters in words; fixed values.
LETTER_PAIRS = (
    "ab ac ad ag ai al am an ap ar as at ay be bl bo bu by ca ce ch ci co ct cu de di do ea ec "
    "ed ee ef ei el em en ep er es et ev ex fa fe fi fo fr ge gh gr ha he hi ho ia ic id ie if "
    "ig il im in io ir is it iv ke la ld le li ll lo ly ma me mi mo mp na nc nd ne ng ni no ns "
    "nt oc od of ol om on oo op or os ot ou ov ow pa pe pl po pr ra rd re ri rm rn ro rs rt ry "
    "sa se sh si so sp ss st su ta te th ti to tr ts tt tu ty uc ui ul un ur us ut ve vi wa we "
    "wh wi wo "

).split()
# Percent of the letters in such pairs from which a token is words. Of random tokens
# of 20 characters 11% (both cases) and 5% (one case) reach it, of 40 characters 1%.
READABLE = 55


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind, as an array column per kind; ``part`` is the value."""
    assign = matches_if(text.rlike(_NAMES), text, ASSIGN, 1)
    return {
        "assign": F.filter(assign, lambda s: F.length(s["part"]) >= 8),
        "access": matches_if(text.contains("AKIA"), text, ACCESS),
        "hex": matches_if(text.rlike(HEX), text, HEX),
    }


def is_random(value: Column, distinct_chars: int) -> Column:
    """Whether a value looks drawn from its alphabet rather than written in words."""
    chars = F.array_distinct(F.split(value, ""))
    n = F.length(value).cast("long")

    def pairs_of(c: Column) -> Column:
        count = n - F.length(F.replace(value, c, F.lit("")))
        return count * (count - 1)

    equal = F.aggregate(chars, F.lit(0).cast("long"), lambda total, c: total + pairs_of(c))
    is_hex = value.rlike("^([0-9a-f]+|[0-9A-F]+)$")
    both = value.rlike("[a-z]") & value.rlike("[A-Z]")
    alphabet = F.when(is_hex, 16).when(both, 62).otherwise(36)
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    lower = F.lower(value)
    paired = F.length(lower) - F.length(F.regexp_replace(lower, "|".join(LETTER_PAIRS), ""))
    return (
        value.rlike("[A-Za-z]")
        & value.rlike("[0-9]")
        & (F.size(chars) >= distinct_chars)
        & (equal * alphabet <= 2 * n * (n - 1))
        & (is_hex | (100 * paired < READABLE * letters))
    )


def with_candidates(docs: DataFrame, distinct_chars: int) -> DataFrame:
    """Spans per kind and ``tokens``, the random tokens that touch no base span."""
    source = docs.select(row_key("doc_id", "source", "text").alias("key"), "doc_id", "source", "text")
    text = F.col("text")
    tokens = F.filter(matches_if(text.rlike(TOKEN), text, TOKEN), lambda s: is_random(s["value"], distinct_chars))
    found = source.select(
        "key", "doc_id", "source", *[c.alias(k) for k, c in base_spans(text).items()], tokens.alias("tokens")
    )
    base = F.concat(*[F.col(k) for k in KINDS])
    free = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.withColumn("tokens", free)


def ownership(found: DataFrame) -> DataFrame:
    """Repositories and owners per candidate hash.

    Rows are counted per hash and owner first, then per hash: a value that a
    third of all documents hold is added up before each shuffle.
    """
    spans = F.concat(*[F.transform(k, lambda s: F.xxhash64(s["part"])) for k in [*KINDS, "tokens"]])
    each = found.select("doc_id", "source", F.explode(F.array_distinct(spans)).alias("hash")).distinct()
    per_owner = each.groupBy("hash", "source").agg(F.count("*").alias("n"))
    return per_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def classified(
    docs: DataFrame, live_owners: int = 1, example_owners: int = 3, live_repos: int = 20, distinct_chars: int = 10
) -> DataFrame:
    """A row per document: ids, an array of spans per kind, and ``owned``.

    Every span carries its class and counts.
    """
    found = stored(with_candidates(docs, distinct_chars), "secrets-found")
    counts = ownership(found)
    spans = F.concat(*[labelled(k, F.col(k)) for k in [*KINDS, "tokens"]])
    each = found.select("key", F.explode(spans).alias("s")).distinct().withColumn("hash", F.xxhash64("s.value"))
    joined = each.join(counts, "hash")
    held = (F.col("n_owners") <= live_owners) & (F.col("n_repos") <= live_repos)
    kind = (
        F.when(F.col("n_owners") >= example_owners, "example")
        .when(held & is_random(F.col("s.value"), distinct_chars), "live")
        .otherwise("unclear")
    )
    span = F.struct("s.start", "s.end", "s.kind", "s.value", kind.alias("class"), "n_repos", "n_owners")
    per_doc = joined.groupBy("key").agg(F.sort_array(F.collect_list(span)).alias("all"))
    out = found.select("key", "doc_id", "source").join(per_doc, "key", "left")

    def of_kind(k: str) -> Column:
        return F.coalesce(F.filter("all", lambda s: s["kind"] == k), F.array()).alias(k)

    owned = F.filter("all", lambda s: (s["kind"] == "tokens") & (s["class"] == "live"))
    return out.select("key", "doc_id", "source", *[of_kind(k) for k in KINDS], F.coalesce(owned, F.array()).alias("owned"))


def redacted(docs: DataFrame, **options) -> DataFrame:
    """Documents with live and base secrets replaced by ``[SECRET]``.

    Widely copied examples stay readable. All columns in their order.
    """
    names = docs.columns
    found = classified(docs, **options)
    all_spans = F.concat(*[F.filter(k, lambda s: s["class"] != "example") for k in [*KINDS, "owned"]])
    spans = F.transform(
        all_spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))
    )
    changes = found.select(F.col("key").alias("__key"), spans.alias("__spans")).where(F.size("__spans") > 0)
    changes = changes.groupBy("__key").agg(F.first("__spans").alias("__spans"))
    out = docs.withColumn("__key", row_key("doc_id", "source", "text")).join(changes, "__key", "left")
    new = replaced(F.col("text"), F.col("__spans"), lambda s: F.lit("[SECRET]"))
    out = out.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(new))
    return out.select(*[F.col(f"`{c}`") for c in names])


def digest(docs: DataFrame, **options) -> DataFrame:
    """Counts, a hash of the base spans, all spans, and how many are of which class."""
    found = classified(docs, **options)
    place = {k: i for i, k in enumerate([*KINDS, "owned"])}

    def tagged(k: str) -> Column:
        def one(s: Column) -> Column:
            text = F.concat_ws(":", F.lit(k), s["start"], s["end"])
            return F.struct(s["start"].alias("start"), F.lit(place[k]).alias("place"), text.alias("text"))

        return F.transform(k, one)

    def in_order(kinds: list[str]) -> Column:
        spans = F.sort_array(F.concat(*[tagged(k) for k in kinds]))
        return F.array_join(F.transform(spans, lambda x: x["text"]), ",")

    def of_class(name: str) -> Column:
        return F.size(F.filter(F.concat(*KINDS, "owned"), lambda s: s["class"] == name)).cast("long")

    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(in_order(KINDS), 256).alias("base_sha256"),
        in_order([*KINDS, "owned"]).alias("spans"),
        of_class("live").alias("n_live"),
        of_class("example").alias("n_example"),
    )
