"""Jaccard join of documents on sets of word n-grams, with set-relation skipping.

A document's set holds the hashes (64 bits) of its distinct ``n``-word shingles.
Two documents link when 100 * |X and Y| >= percent * |X or Y|.

1. Equal sets are one node; what follows works on nodes.
2. Index lists: tokens are put in one order, rare ones first, and only the first
   |X| - ceil(percent * |X| / 100) + 1 tokens of a set are listed, with their
   positions; sets that link share one of them. The order is: tokens with hashes
   below ``SHARE`` of the range, by document frequency; then the others by hash.
   So frequencies are counted for these tokens only, over all documents. A set
   whose first tokens are all its own links with nothing and is dropped here.
3. Answers of a list's leader (the set with the fewest tokens of its own): its
   overlap with the sets of the list is computed. A set meets the leader of most of
   its lists first; other leaders only if they are not near the same one, so in a group of
   near copies it meets one.
4. Answers of all others are derived from these. Of sets near the same leader
   only the differences to it are looked at: what two sets share of these, with
   their overlaps with the leader, is what they share at all. An index of the
   differences finds the pairs that can still link; in a group of near copies
   these are few, however large the group is. Other pairs of a list: with
   overlaps c(X), c(Y) with its leader, |X and Y| is at least
   c(X) + c(Y) - |leader| and at most c(X) + |Y| - c(Y) and c(Y) + |X| - c(X), which
   proves or rules out most. Pairs already connected are not looked at.
   Of the pairs of a set and a component, the likeliest is compared first; if it links,
   the others say no more.
5. For these, lists are cut into blocks by size, position and overlap, of about
   ``BLOCK_ROWS`` entries, and blocks meet blocks of the sizes that can link. A pair of
   blocks is skipped when their sizes, their positions (what is left behind them
   is too short), their overlaps or their one common component rule out all pairs.

Only connected components are returned, so links inside a component need no row.

Hashes: two different shingles of one pair of sets fall together with a chance
of about |X| * |Y| / 2^64, two nodes of a corpus of N sets with N^2 / 2^65.

Defined cases: null, empty and blank texts have an empty set and link with
nothing. With fewer words than ``n`` the whole sequence is the one shingle. Equal
rows are linked; ids may repeat, and a null id is larger than any other. An empty
table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm import textscan
from batchloom.llm.common import map_batches, row_key, stored
from batchloom.llm.components import components
from batchloom.session import release, written_alone

SHARE = 0.25
_LIMIT = int(SHARE * 2**64)
_TABLE = textscan.byte_table(textscan.not_blank, lower=True)
BLOCK_ROWS = 64  # entries of a block, about
EARLIER = 8  # listed tokens before an entry's own that it carries
NEAR_PERCENT = 50  # similarity from which a set's differences to its leader are listed
SECOND_LEADERS = 2  # more leaders that sets near a leader, but not linked, are compared with
FILTER_WORDS = 1 << 20  # 64-bit words of the node filter: 8 MB, whatever the corpus


def prefix_length(size: int, percent: int) -> int:
    return size - (percent * size + 99) // 100 + 1


def _sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = textscan.Words(texts, _TABLE)
    hashes = words.hashes()
    at, keys = words.windows(hashes, n)
    first = np.searchsorted(at, words.first)
    out = []
    for i, count in enumerate(words.count):
        if count >= n:
            out.append(np.unique(keys[first[i] : first[i + 1]]))
        elif count:
            begin = words.first[i]
            short = hashlib.blake2b(words.window_bytes(int(begin), int(count)), digest_size=8).digest()
            out.append(np.frombuffer(short, dtype=np.uint64).copy())
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _node(tokens: np.ndarray) -> int | None:
    if not len(tokens):
        return None
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _first_tokens(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch):
                sets = _sets(textscan.utf8(part.column("text")), n)
                few = [
                    s[: max(int(np.searchsorted(s, np.uint64(_LIMIT))), prefix_length(len(s), percent))] if len(s) else s
                    for s in sets
                ]
                sizes = pa.array([len(s) for s in sets], pa.int64())
                nodes = pa.array([_node(s) for s in sets], pa.int64())
                ends = np.concatenate(([0], np.cumsum([len(s) for s in few]))).astype(np.int32)
                flat = np.concatenate(few).view(np.int64) if few else np.empty(0, dtype=np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), part.column("doc_id"), sizes, nodes, tokens], ["key", "doc_id", "size", "node", "tokens"]
                )

    return run


def _bits(node: np.ndarray) -> list[np.ndarray]:
    """Two positions in the filter; nodes are digests, so their bits are even."""
    mask = np.uint64(FILTER_WORDS * 64 - 1)
    return [node & mask, (node >> np.uint64(26)) & mask]


def _whole_sets(n: int, wanted):
    """Sets of the texts whose node passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            for part in textscan.slices(batch):
                sets = [(s, _node(s)) for s in _sets(textscan.utf8(part.column("text")), n)]
                sets = [(s, k) for s, k in sets if k is not None]
                keys = np.array([k for _, k in sets], dtype=np.int64).view(np.uint64)
                good = np.ones(len(keys), dtype=bool)
                for bit in _bits(keys):
                    good &= (table[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                kept = [sets[i] for i in np.flatnonzero(good)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for _, k in kept], pa.int64()), pa.array([s.view(np.int64) for s, _ in kept], pa.list_(pa.int64()))],
                    ["node", "tokens"],
                )

    return run


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size; at most ``FILTER_WORDS`` rows reach the driver.

    When nodes fill it up it lets more rows through, which the exact joins drop.
    """
    mask = F.lit(FILTER_WORDS * 64 - 1).cast("long")
    bits = F.array(F.col("node").bitwiseAND(mask), F.shiftrightunsigned("node", 26).bitwiseAND(mask))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = (
        nodes.select(F.explode(bits).alias("bit"))
        .groupBy(F.shiftrightunsigned("bit", 6).alias("word"))
        .agg(F.bit_or(one).alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_WORDS, dtype=np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def needed(size_a: Column, size_b: Column, percent: int) -> Column:
    """Least overlap with which two sets of these sizes link."""
    # A quotient of whole numbers: ceil(percent * (a + b) / (100 + percent)).
    total = F.lit(percent) * (size_a + size_b) + F.lit(100 + percent - 1)
    return F.floor(total / F.lit(100 + percent)).cast("long")


def sizes_fit(size_a: Column, size_b: Column, percent: int) -> Column:
    return 100 * F.least(size_a, size_b) >= percent * F.greatest(size_a, size_b)


def index_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """Entries (token, node, size, pos, own, before) of the sets that may link.

    ``nodes`` has node, size, tokens. ``pos`` is the place of the token in the
    set's order, ``own`` the number of listed tokens that no other set has, ``before``
    the up to ``EARLIER`` tokens that the set has listed just before this one.
    Frequencies are combined before the shuffle; joining them back can be split,
    so a token of a third of all sets stays spread out.
    """
    each = nodes.select("node", "size", F.explode("tokens").alias("token"))
    shared = each.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    # Hashes are unsigned: those below the limit are the non-negative ones below it.
    in_share = (F.col("token") >= 0) & (F.col("token") < _LIMIT)
    later = F.when(in_share, F.lit(0)).otherwise(F.lit(1))
    rank = F.struct(later.alias("later"), F.when(in_share, F.col("df")).otherwise(F.lit(0)).alias("df"), "token")
    per_node = each.join(shared, "token").groupBy("node").agg(F.sort_array(F.collect_list(rank)).alias("ranked"))
    rest = nodes.select(
        "node", "size", F.size(F.filter("tokens", lambda t: (t >= 0) & (t < _LIMIT))).cast("long").alias("n_share")
    )
    prefix = F.col("size") - F.floor((F.lit(percent) * F.col("size") + 99) / 100).cast("long") + 1
    known = F.size(F.filter("ranked", lambda x: x["later"] == 0))
    own = F.col("n_share") - known
    length = F.when(F.col("n_share") >= prefix, F.greatest(prefix - own, F.lit(0))).otherwise(F.size("ranked"))
    listed = (
        per_node.join(rest, "node")
        .withColumn("own", own)
        .withColumn("first", F.slice("ranked", F.lit(1), length.cast("int")))
        .where(F.size("first") > 0)
    )

    def entry(x: Column, i: Column) -> Column:
        before = F.array(*[F.get("first", i - k)["token"] for k in range(1, EARLIER + 1)])
        return F.struct(x["token"].alias("token"), F.array_compact(before).alias("before"))

    at = listed.select("node", "size", "own", F.posexplode(F.transform("first", entry)).alias("i", "x"))
    return at.select(F.col("x.token").alias("token"), "node", "size", (F.col("own") + F.col("i")).alias("pos"), "own", F.col("x.before").alias("before"))


def _with_sets(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    left = whole.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    right = whole.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    return pairs.join(left, "b").join(right, "a")


def _overlap() -> Column:
    return F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long")


def overlaps(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with the size of their intersection, ``overlap``."""
    return _with_sets(pairs, whole).select(*pairs.columns, _overlap().alias("overlap"))


def most_differing(size: Column, percent: int) -> Column:
    """Most tokens that a set and any set that links to it do not share."""
    other = F.floor(100 * size / percent).cast("long")
    return size + other - 2 * needed(size, other, percent)


def leader_answers(lists: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Overlaps of leaders of lists with sets of their lists, each pair once; written.

    Columns a (leader), rank_a, b, size_a, size_b, overlap, near and delta. For a set
    near its leader, ``delta`` holds the tokens that tell the two apart.
    Leaders are the same in most lists of a group of near copies, since they are
    ranked by the share of tokens of their own. A set is first compared with the leader
    of most of its lists. Of its other leaders, those near the same leader are left
    out: their pairs with the set are found by the differences to that one.
    """
    leaders = lists.groupBy("token").agg(F.min(_rank()).alias("lead"))
    met = (
        lists.join(leaders, "token")
        .where((F.col("node") != F.col("lead.node")) & sizes_fit(F.col("size"), F.col("lead.size"), percent))
        .groupBy(
            F.col("lead.node").alias("a"), F.col("lead.share").alias("rank_a"), F.col("node").alias("b"),
            F.col("lead.size").alias("size_a"), F.col("size").alias("size_b"),
        )
        .agg(F.count("*").alias("votes"))
    )
    met = stored(met, "leader-meetings")
    most = F.min(F.struct((-F.col("votes")).alias("less"), "rank_a", "a"))
    chosen = met.groupBy(F.col("b").alias("__b")).agg(most["a"].alias("__a"))
    marked = met.join(chosen, met["b"] == chosen["__b"]).withColumn("chosen", F.col("a") == F.col("__a"))
    marked = marked.drop("__a", "__b", "votes")
    first = stored(_answered(marked.where("chosen").drop("chosen"), whole), "first-answers")
    home = homes(first)
    others = marked.where(~F.col("chosen")).drop("chosen")
    for side in ("a", "b"):
        of = home.select(F.col("node").alias(side), F.col("home").alias(f"home_{side}"))
        others = others.join(of, side, "left").withColumn(f"home_{side}", F.coalesce(f"home_{side}", side))
    others = others.where(F.col("home_a") != F.col("home_b")).drop("home_a", "home_b")
    return first.unionByName(stored(_answered(others, whole), "other-answers"))


def _answered(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    delta = F.concat(F.array_except("tokens_b", "tokens_a"), F.array_except("tokens_a", "tokens_b"))
    found = _with_sets(pairs, whole).select(*pairs.columns, _overlap().alias("overlap"), delta.alias("delta"))
    near = 100 * F.col("overlap") >= NEAR_PERCENT * (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    return found.withColumn("near", near).withColumn("delta", F.when(near, F.col("delta")))


def homes(answers: DataFrame) -> DataFrame:
    """The first, in one order of all leaders, of the leaders near a set and itself if it is one: node, home."""
    leader = F.struct(F.col("rank_a").alias("rank"), F.col("a").alias("a"))
    near = answers.where("near").select(F.col("b").alias("node"), leader.alias("leader"))
    own = answers.select(F.col("a").alias("node"), leader.alias("leader")).distinct()
    return near.unionByName(own).groupBy("node").agg(F.min("leader")["a"].alias("home"))


def _rank() -> Column:
    return F.struct((F.col("own") / F.col("size")).alias("share"), F.col("node").alias("node"), F.col("size").alias("size"))


def first_leaders(links: DataFrame) -> DataFrame:
    """The first leader that a node links to, itself included if it leads: node, mid.

    ``links`` has a (leader), rank_a, b. Leaders have one order, so the sets of a
    group of near copies have few first leaders.
    """
    leader = F.struct(F.col("rank_a").alias("rank"), F.col("a").alias("a"))
    own = links.select(F.col("a").alias("node"), leader.alias("leader"))
    every = own.unionByName(links.select(F.col("b").alias("node"), leader.alias("leader")))
    return every.groupBy("node").agg(F.min("leader")["a"].alias("mid"))


def star_labels(first: DataFrame) -> DataFrame:
    """A label per linked node, so that nodes of one label are connected: node, label.

    It is the first leader of the first leader: less than components, and one join.
    """
    above = first.select(F.col("node").alias("mid"), F.col("mid").alias("label"))
    return first.join(above, "mid").select("node", "label")


def spanning(links: DataFrame, first: DataFrame) -> DataFrame:
    """Fewer links that connect the same nodes: a, b.

    Each node keeps its first leader; its other leaders are linked with that one,
    each pair of leaders once.
    """
    to_first = first.where(F.col("node") != F.col("mid")).select(F.col("node").alias("a"), F.col("mid").alias("b"))
    of_b = first.select(F.col("node").alias("b"), "mid")
    leaders = links.join(of_b, "b").where(F.col("a") != F.col("mid")).select(F.col("mid").alias("a"), F.col("a").alias("b"))
    return to_first.unionByName(leaders.distinct())


def labelled_answers(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Near answers of leaders whose near sets are not all in one component."""
    label = labels.select(F.col("node").alias("b"), "label")
    near = answers.where("near").join(label, "b", "left").withColumn("label", F.coalesce("label", "b"))
    mixed = near.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    return near.join(mixed.where(F.col("low") != F.col("high")).select("a"), "a")


def pairs_by_delta(near: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components near one leader that may link: a, b, sizes.

    With c the overlap with the leader L, the overlap of X and Y is that of their
    differences to L, less |L| - c(X) - c(Y). Two sets that link, of which one
    does not link with L, share a token of these differences, and at the first
    they share, enough is left behind it on both sides. First in the order come
    tokens that no two components share, which pairs cannot have in common, then
    the others by their number of holders in the group. So sets that differ from
    L in their own ways never meet, and few lists are long.
    """
    near = stored(near, "near-answers")
    each = near.select(
        F.col("a").alias("leader"), F.col("b").alias("node"), "label", F.explode("delta").alias("token")
    )
    shared = each.groupBy("leader", "token").agg(
        F.count("*").alias("holders"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    shared = shared.where(F.col("low") != F.col("high")).drop("low", "high")
    useful = (
        each.join(shared, ["leader", "token"])
        .groupBy("leader", "node")
        .agg(F.sort_array(F.collect_list(F.struct("holders", "token"))).alias("useful"))
    )
    sets = near.select(
        F.col("a").alias("leader"), F.col("b").alias("node"), F.col("size_a").alias("lead_size"), F.col("size_b").alias("size"),
        "overlap", "label",
    )
    n_delta = F.col("size") + F.col("lead_size") - 2 * F.col("overlap")
    own = n_delta - F.size("useful")
    first = F.slice("useful", F.lit(1), F.greatest(most_differing(F.col("size"), percent) + 1 - own, F.lit(0)).cast("int"))
    listed = sets.join(useful, ["leader", "node"]).withColumn("behind", n_delta - own).withColumn("first", first)
    entries = listed.select("leader", "lead_size", "node", "size", "overlap", "label", "behind", F.posexplode("first").alias("i", "x"))
    entries = entries.select(
        "leader", F.col("x.token").alias("token"), "lead_size",
        F.struct("node", "size", "overlap", "label", (F.col("behind") - F.col("i")).alias("left")).alias("p"),
    )
    entries = stored(entries, "differences")
    y = entries.select("leader", "token", F.col("p").alias("q"))
    p, q = F.col("p"), F.col("q")
    wanted = needed(p["size"], q["size"], percent) + F.col("lead_size") - p["overlap"] - q["overlap"]
    met = entries.alias("x").join(
        y.alias("y"),
        (F.col("x.leader") == F.col("y.leader")) & (F.col("x.token") == F.col("y.token")) & (p["node"] < q["node"])
        & (p["label"] != q["label"]) & sizes_fit(p["size"], q["size"], percent) & (F.least(p["left"], q["left"]) >= wanted),
    )
    return met.select(
        p["node"].alias("a"), q["node"].alias("b"), (p["size"] + q["size"]).alias("sizes"),
        p["label"].alias("label_a"), q["label"].alias("label_b"), (p["overlap"] + q["overlap"] - F.col("lead_size")).alias("sure"),
    ).groupBy("a", "b", "sizes", "label_a", "label_b").agg(F.max("sure").alias("sure"))


def list_blocks(entries: DataFrame) -> DataFrame:
    """Blocks of about ``BLOCK_ROWS`` entries of one list, near in size, position and overlap with the leader.

    Those of one home lie together: a home with more entries in a cell than a block
    holds has blocks of its own, the others share blocks by the hash of their home. A cell of
    R entries has about R / ``BLOCK_ROWS`` blocks.
    """
    cell = entries.select(
        "*",
        F.floor(F.log2(F.col("size")) * 4).cast("int").alias("size_class"),
        F.floor(F.log2(F.col("pos") + 1)).cast("int").alias("pos_class"),
        F.coalesce(F.floor(10 * F.col("overlap") / F.col("size")).cast("int"), F.lit(-1)).alias("overlap_class"),
    )
    classes = ["token", "size_class", "pos_class", "overlap_class"]
    own = cell.groupBy(*classes, "home").agg(F.count("*").alias("own_rows"))
    shared = F.sum(F.when(F.col("own_rows") <= BLOCK_ROWS, F.col("own_rows")))
    rest = own.groupBy(*classes).agg(F.ceil(shared / BLOCK_ROWS).alias("parts"))
    large = F.col("own_rows") > BLOCK_ROWS
    placed = cell.join(own, [*classes, "home"]).join(rest, classes).select(
        *cell.columns,
        F.when(large, F.col("home")).alias("of_home"),
        F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("own_rows") / BLOCK_ROWS)))
        .otherwise(F.pmod(F.xxhash64("home"), F.col("parts"))).alias("part"),
    )
    blocks = placed.groupBy(*classes, "of_home", "part", "lead_size").agg(
        F.collect_list(F.struct(*[c for c in entries.columns if c not in ("token", "lead_size")])).alias("rows"),
        F.min("size").alias("low"), F.max("size").alias("high"), F.min("pos").alias("pos"),
        F.min("label").alias("label_low"), F.max("label").alias("label_high"),
        F.min("home").alias("home_low"), F.max("home").alias("home_high"),
        F.max("overlap").alias("held"), F.max(F.col("size") - F.col("overlap")).alias("away"),
    )
    return blocks.withColumn("id", F.struct("size_class", "pos_class", "overlap_class", "of_home", "part"))


def pairs_by_block(lists: DataFrame, answers: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components and without a common home: a, b, sizes, linked.

    ``linked`` is true if the leader's answers prove the link. Sets of a group of near
    copies have one home (``homes``), even those that lead a list. Pairs of one home
    are left to ``pairs_by_delta``.
    """
    entries = (
        lists.join(labels.select("node", "label"), "node", "left")
        .join(homes(answers), "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
        .withColumn("home", F.coalesce("home", "node"))
    )
    entries = stored(entries, "list-entries")
    # Lists of one component, or of one home, have no more to say.
    whole_lists = entries.groupBy("token").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("home").alias("home_low"), F.max("home").alias("home_high"),
        F.min(_rank()).alias("lead"),
    )
    whole_lists = whole_lists.where((F.col("low") != F.col("high")) & (F.col("home_low") != F.col("home_high"))).select("token", "lead")
    known = answers.select(F.col("a").alias("leader"), F.col("b").alias("node"), "overlap")
    entries = (
        entries.join(whole_lists, "token")
        .withColumn("leader", F.col("lead.node"))
        .join(known, ["leader", "node"], "left")
        .withColumn("overlap", F.when(F.col("node") == F.col("leader"), F.col("size")).otherwise(F.col("overlap")))
        .select("token", "node", "size", "pos", "label", "home", "overlap", "before", F.col("lead.size").alias("lead_size"))
    )
    blocks = stored(list_blocks(entries), "list-blocks")
    # Blocks meet those of their own size class and of the next ones that can link.
    reach = int(4 * math.log2(100 / percent)) + 1
    x = blocks.withColumn("with", F.explode(F.sequence(F.col("size_class"), F.col("size_class") + reach))).alias("x")
    y = blocks.drop("lead_size").alias("y")

    def one(name: str) -> Column:
        low, high = F.col(f"x.{name}_low"), F.col(f"x.{name}_high")
        return (low == high) & (F.col(f"y.{name}_low") == low) & (F.col(f"y.{name}_high") == low)

    # What is left behind the positions, and what the leader's answers allow,
    # bound the overlap of all pairs of two blocks from above.
    room = F.least(
        F.col("x.high") - F.col("x.pos"), F.col("y.high") - F.col("y.pos"),
        F.col("x.held") + F.col("y.away"), F.col("y.held") + F.col("x.away"),
    )
    skip = (
        one("label") | one("home") | (room < needed(F.col("x.low"), F.col("y.low"), percent))
        | (100 * F.col("x.high") < percent * F.col("y.low")) | (100 * F.col("y.high") < percent * F.col("x.low"))
    )
    met = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.with") == F.col("y.size_class")) & (F.col("x.id") <= F.col("y.id")) & ~skip)

    def possible(p: Column, q: Column) -> Column:
        at_most = F.least(
            p["size"] - p["pos"], q["size"] - q["pos"],
            p["overlap"] + q["size"] - q["overlap"], q["overlap"] + p["size"] - p["overlap"],
        )
        # A block meets itself too: each pair of it once. A pair that links is possible in the first
        # list that it shares, as all sets list their tokens in one order; it is left out of later ones.
        once = (F.col("x.id") != F.col("y.id")) | (p["node"] < q["node"])
        return (
            once & (p["label"] != q["label"]) & (p["home"] != q["home"]) & sizes_fit(p["size"], q["size"], percent)
            & (at_most >= needed(p["size"], q["size"], percent)) & ~F.arrays_overlap(p["before"], q["before"])
        )

    def pair(p: Column, q: Column) -> Column:
        at_least = F.coalesce(p["overlap"] + q["overlap"] - F.col("lead_size"), F.lit(0).cast("long"))
        in_order = p["node"] < q["node"]
        return F.struct(
            F.least(p["node"], q["node"]).alias("a"), F.greatest(p["node"], q["node"]).alias("b"), (p["size"] + q["size"]).alias("sizes"),
            F.when(in_order, p["label"]).otherwise(q["label"]).alias("label_a"),
            F.when(in_order, q["label"]).otherwise(p["label"]).alias("label_b"),
            at_least.alias("sure"), (at_least >= needed(p["size"], q["size"], percent)).alias("linked"),
        )

    def with_others(p: Column) -> Column:
        return F.transform(F.filter(F.col("y.rows"), lambda q: possible(p, q)), lambda q: pair(p, q))

    pairs = met.select(F.explode(F.flatten(F.transform(F.col("x.rows"), with_others))).alias("pair")).select("pair.*")
    return pairs.groupBy("a", "b", "sizes", "label_a", "label_b").agg(F.max("sure").alias("sure"), F.max("linked").alias("linked"))


def linked_nodes(nodes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Component (smallest node) of every node that has a link: node, label."""
    spark = docs.sparkSession
    lists = stored(index_lists(nodes, percent), "index-lists")
    wanted = spark.sparkContext.broadcast(node_filter(lists.select("node").distinct()))
    texts = docs.select("text").where(F.col("text").isNotNull())
    whole = map_batches(texts, _whole_sets(n, wanted), "node bigint, tokens array<bigint>").dropDuplicates(["node"])
    whole = stored(whole.join(lists.select("node").distinct(), "node"), "whole-sets")
    release(spark)
    answers = leader_answers(lists, whole, percent)
    release(spark)
    link = F.col("overlap") >= needed(F.col("size_a"), F.col("size_b"), percent)
    links = stored(answers.where(link).select("a", "rank_a", "b"), "leader-links")
    tried = links.select(F.col("a").alias("node")).limit(0)
    for k in range(SECOND_LEADERS):
        found, leads = second_links(answers, links, tried, whole, percent, 2.0 + k)
        links, tried = links.unionByName(found), tried.unionByName(leads)
    release(spark)
    first = stored(first_leaders(links), "first-leaders")
    labels = stored(star_labels(first), "star-labels")
    near = pairs_by_delta(labelled_answers(answers, labels), percent).withColumn("linked", F.lit(False))
    far = pairs_by_block(lists, answers.drop("delta"), labels, percent)
    pairs = stored(far.unionByName(near), "derived-pairs")
    release(spark)
    proved = pairs.where("linked").select("a", "b")
    open_pairs = pairs.where(~F.col("linked")).groupBy("a", "b", "sizes", "label_a", "label_b").agg(F.max("sure").alias("sure"))
    judged = stored(compared_pairs(best_pairs(open_pairs), whole, percent), "best-pairs")
    best = judged.where("linked")
    rest = still_open(open_pairs, best).join(judged.select("a", "b"), ["a", "b"], "left_anti")
    more = compared_pairs(rest, whole, percent).where("linked")
    release(spark)
    links = spanning(links, first).unionByName(proved).unionByName(best.select("a", "b")).unionByName(more.select("a", "b"))
    return components(links)


def second_links(
    answers: DataFrame, links: DataFrame, tried: DataFrame, whole: DataFrame, percent: int, rank: float
) -> tuple[DataFrame, DataFrame]:
    """Links of one more leader per first leader, and these leaders.

    Sets that are near a leader but link with none may well link with each other. Of
    those the nearest is compared with the others, so that most get one label before
    pairs are looked at. Second leaders rank behind all first ones.
    """
    done = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).unionByName(tried)
    left = answers.where("near").select("a", F.col("b").alias("node"), F.col("size_b").alias("size"), "overlap")
    left = left.join(done.distinct(), "node", "left_anti")
    lead = left.groupBy("a").agg(F.max(F.struct("overlap", "node", "size")).alias("lead"))
    pairs = (
        left.join(lead, "a")
        .where((F.col("node") != F.col("lead.node")) & sizes_fit(F.col("size"), F.col("lead.size"), percent))
        .select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.size").alias("size_a"), F.col("size").alias("size_b"))
        .distinct()
    )
    linked = F.col("overlap") >= needed(F.col("size_a"), F.col("size_b"), percent)
    found = overlaps(pairs, whole).where(linked).select("a", F.lit(rank).alias("rank_a"), "b")
    return stored(found, "second-links"), stored(lead.select("lead.node").distinct(), "second-leaders")


def compared_pairs(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """The pairs, and by comparing their sets whether they link: a, b, label_a, label_b, linked."""
    least = F.floor((F.lit(percent) * F.col("sizes") + F.lit(100 + percent - 1)) / F.lit(100 + percent)).cast("long")
    found = overlaps(pairs.select("a", "b", "sizes", "label_a", "label_b"), whole)
    return found.select("a", "b", "label_a", "label_b", (F.col("overlap") >= least).alias("linked"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Per set and component the pair that the leader's answers say most of."""
    columns = ["sure", "a", "b", "sizes", "label_a", "label_b"]
    best = F.max(F.struct(*columns)).alias("best")
    of_a, of_b = pairs.groupBy("a", "label_b").agg(best), pairs.groupBy("b", "label_a").agg(best)
    return of_a.select("best.*").unionByName(of_b.select("best.*")).distinct()


def still_open(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs of a set and a component that no linked pair has connected."""
    known = linked.select(F.col("a").alias("node"), F.col("label_b").alias("label")).unionByName(
        linked.select(F.col("b").alias("node"), F.col("label_a").alias("label"))
    ).distinct()
    of_a = known.select(F.col("node").alias("a"), F.col("label").alias("label_b"))
    of_b = known.select(F.col("node").alias("b"), F.col("label").alias("label_a"))
    return pairs.join(of_a, ["a", "label_b"], "left_anti").join(of_b, ["b", "label_a"], "left_anti")


def joined(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """A row per document: key, doc_id, n_shingles, component_id, first_key.

    ``component_id`` is the smallest id reachable by links, ``first_key`` the key
    of the document that stands for the component.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(row_key("doc_id", "text").alias("key"), "doc_id", "text")
    sets = map_batches(rows, _first_tokens(n, percent), f"key binary, doc_id {id_type}, size bigint, node bigint, tokens array<bigint>")
    sets = stored(sets, "shingle-sets")
    nodes = sets.where(F.col("node").isNotNull()).select("node", "size", "tokens").dropDuplicates(["node"])
    nodes = stored(nodes, "nodes")
    labels = written_alone(docs.sparkSession, "components", lambda: linked_nodes(nodes, docs, n, percent))
    placed = sets.select("key", "doc_id", "size", "node").join(labels, "node", "left")
    placed = placed.withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = (
        placed.where(F.col("label").isNotNull())
        .groupBy("label")
        .agg(F.min("doc_id").alias("least"), F.min(order).alias("first"))
        .select("label", "least", F.col("first.key").alias("first"))
    )
    return placed.join(first, "label", "left").select(
        "key",
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        F.coalesce("first", "key").alias("first_key"),
    )


def deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near copies; all columns in their order.

    The one with the smallest id stays. Equal rows of that id are one document;
    documents without words are never copies of each other.
    """

    def first_keys() -> DataFrame:
        found = joined(docs, n, percent).where(F.col("key") == F.col("first_key"))
        return found.groupBy(F.col("key").alias("__key")).agg(F.max("n_shingles").alias("__size"))

    kept = written_alone(docs.sparkSession, "first-keys", first_keys)
    rows = docs.withColumn("__key", row_key("doc_id", "text")).join(kept, "__key")
    again = rows.where(F.col("__size") > 0).dropDuplicates(["__key"])
    return again.unionByName(rows.where(F.col("__size") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """Components at 85 percent of distinct 4-word shingles."""
    return joined(docs, n=4, percent=85).select("doc_id", "n_shingles", "component_id")
