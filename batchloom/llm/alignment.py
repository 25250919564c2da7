"""Token alignment of two tokenizers by divide and conquer at shared cuts.

A space and the text is encoded by a byte-level BPE (A), the text by a sentence-piece
model that adds the space itself (B). Where a token of either side ends at the same
byte, the text can be cut. In every interval the A ends around the middle are looked up
among the B ends by bisection, in a window that doubles until one is shared; the
interval is cut at the one nearest to the middle, and both halves go on alike. An interval without
a shared end becomes a group with the cut behind it. All intervals of some MB of texts take
a step together, as arrays.

The tokens on both sides of a cut's left are a link. They end at one byte, so one
of them is a tail of the other: the vocabularies alone bound the pairs that can
ever be linked (``Alphabet.pairs``, some bytes per token), whatever the texts are.
Each task adds up links per pair, Spark adds up the tasks, and the counts, of which there
are at most so many, are broadcast for the figures of each document.

Defined cases: texts that are null or empty, or whose tokens' bytes are not those of
the space and the text on one side, have no tokens, no groups and no links. Equal
texts give equal groups, and their links count each time. Ties of a B token's best
count all are best. Texts of any length are taken whole: they are encoded in pieces cut where no
token of either side can lie across, if they have such places. Empty tables give no rows.
Columns that are not looked at may have any name.
"""

from __future__ import annotations

import hashlib
import json
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from batchloom.llm import textscan
from batchloom.llm.byte_bpe import Codec, Vocabulary
from batchloom.llm.common import map_batches, stored

SPACE = "▁"
PIECE = 1 << 19  # bytes of text that are aligned at once
LONG = 1 << 18  # characters that are encoded at once
# Between two characters that are neither blank nor the sign for a blank: no token goes across.
_GAP = regex.compile(rf"(?<=[^\s{SPACE}]) (?=[^\s{SPACE}])")
_RUN = regex.compile(r"\S{2000}|\s{2000}")


def read_merges(path: str) -> dict[bytes, int]:
    """The ranks of a byte-level BPE that is stored as vocabulary and merges in JSON."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    # The printable stand-ins of bytes: printable Latin-1 for itself, the rest from 256 on.
    itself = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in itself]
    byte_of = {chr(b): b for b in itself} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in model["vocab"].items() if all(c in byte_of for c in token)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in pairs] != sorted(model["vocab"][a + b] for a, b in pairs):
        raise ValueError("the ids of the vocabulary do not follow its merges")
    return ranks


class Alphabet:
    """Both vocabularies, and all pairs of tokens of which one is a tail of the other."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.a, self.model = Vocabulary(ranks, pattern), model
        pieces = self.pieces()
        places: dict[bytes, list[int]] = {}
        for b, piece in enumerate(pieces):
            places.setdefault(piece, []).append(b)
        self.n_b = len(pieces)
        found = set()
        for token, a in ranks.items():
            for i in range(len(token)):
                found.update(a * self.n_b + b for b in places.get(token[i:], ()))
        for piece, ids in places.items():
            for i in range(1, len(piece)):
                a = ranks.get(piece[i:])
                if a is not None:
                    found.update(a * self.n_b + b for b in ids)
        self.pairs = np.array(sorted(found), dtype=np.int64)

    def pieces(self) -> list[bytes]:
        """The bytes of every B token."""
        import sentencepiece

        found = sentencepiece.SentencePieceProcessor(model_proto=self.model)
        return [
            bytes([int(p[1:-1], 16)]) if found.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(found.id_to_piece(list(range(found.vocab_size()))))
        ]


def _bytes_and_sizes(tokens: dict[int, bytes] | list[bytes]) -> tuple[list[bytes], np.ndarray]:
    pieces = tokens if isinstance(tokens, list) else [tokens.get(i, b"") for i in range(max(tokens) + 1)]
    return pieces, np.fromiter(map(len, pieces), np.int64, len(pieces))


def _printed(n: int, last: str) -> np.ndarray:
    """Per id its digits and a comma, or what follows the last token of its side of a group."""
    return np.array([[f"{i},", f"{i}{last}"] for i in range(n)], dtype=object)


class Tokenizers:
    """Both tokenizers, ready to encode; a worker makes them once."""

    def __init__(self, alphabet: Alphabet):
        import sentencepiece
        import tiktoken

        v = alphabet.a
        self.linear = Codec(v)
        self.fast = tiktoken.Encoding("a", pat_str=v.pattern, mergeable_ranks=v.ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=alphabet.model)
        self.a_bytes, self.a_sizes = _bytes_and_sizes(v.bytes_of)
        self.b_bytes, self.b_sizes = _bytes_and_sizes(alphabet.pieces())
        self.a_printed, self.b_printed = _printed(len(self.a_bytes), "|"), _printed(len(self.b_bytes), ";")
        # A text can be cut in front of a single space if no B token has a blank behind another character.
        self.can_cut = not any(b" " in p.lstrip(b" ") for p in self.b_bytes)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both sides; none where bytes differ from those of the text."""
        if not text:
            return None
        a, b = [], []
        for part in self._parts(f" {text}"):
            # Merging a long run of letters or blanks takes the library time by its square.
            a.append(self.linear.encode(part) if _RUN.search(part) else self.fast.encode_to_numpy(part, disallowed_special=()))
            b.append(np.array(self.b.encode(part[1:], num_threads=1), dtype=np.int64))
            want = part.encode()
            # A joins bytes and changes none, so their number tells; B may normalise a text.
            if self.a_sizes[a[-1]].sum() != len(want) or b"".join(map(self.b_bytes.__getitem__, b[-1].tolist())) != want:
                return None
        return np.concatenate(a).astype(np.int64), np.concatenate(b)

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while self.can_cut and len(text) - begin > LONG:
            gap = _GAP.search(text, begin + LONG)
            if gap is None:
                break
            yield text[begin : gap.start()]
            begin = gap.start()
        yield text[begin:]


_MADE: weakref.WeakKeyDictionary[Alphabet, Tokenizers] = weakref.WeakKeyDictionary()


def tokenizers_of(shared) -> Tokenizers:
    alphabet = shared.value
    if alphabet not in _MADE:
        _MADE[alphabet] = Tokenizers(alphabet)
    return _MADE[alphabet]


def shared_cuts(a_ends: np.ndarray, b_ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B ends are shared, as places; both are increasing.

    ``low`` and ``high`` bound the intervals of A ends to start with.
    """
    cut_a, cut_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    reach = np.zeros(len(low), dtype=np.int64)
    while True:
        open_ = low < high
        low, high, reach = low[open_], high[open_], reach[open_]
        if not len(low):
            return np.concatenate(cut_a), np.concatenate(cut_b)
        middle = (low + high) // 2
        begin, end = np.maximum(low, middle - reach), np.minimum(high, middle + reach + 1)
        # All A ends in the windows around the middles, looked up among the B ends.
        sizes = end - begin
        of = np.repeat(np.arange(len(low)), sizes)
        tried = np.arange(len(of)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        place = np.searchsorted(b_ends, a_ends[tried])
        hit = b_ends[np.minimum(place, len(b_ends) - 1)] == a_ends[tried]
        of, tried, place = of[hit], tried[hit], place[hit]
        if reach.any() and len(of):  # the hit nearest to the middle, the left one of two
            order = np.lexsort((tried, np.abs(tried - middle[of]), of))
            of, tried, place = of[order], tried[order], place[order]
            first = np.concatenate(([True], of[1:] != of[:-1]))
            of, tried, place = of[first], tried[first], place[first]
        cut_a.append(tried)
        cut_b.append(place)
        at = np.full(len(low), -1, dtype=np.int64)
        at[of] = tried
        whole = (begin == low) & (end == high)
        split, go_on = at >= 0, (at < 0) & ~whole
        # Halves of what was cut, and intervals whose window grows, in the order of the text.
        keep = split | go_on
        low_2 = np.stack([low, at + 1], 1)[keep]
        high_2 = np.stack([np.where(split, at, high), np.where(split, high, at)], 1)[keep]
        reach_2 = np.where(split, 0, 2 * reach + 1)[keep]
        low, high, reach = low_2.ravel(), high_2.ravel(), np.repeat(reach_2, 2)


class Aligned:
    """Groups and links of some texts."""

    def __init__(self, tokenizers: Tokenizers, texts: list[str | None]):
        both = [tokenizers.encode(text) for text in texts]
        none = np.empty(0, dtype=np.int64)
        self.a, self.b = (np.concatenate([none, *[x[side] for x in both if x]]) for side in (0, 1))
        self.n_a, self.n_b = (np.array([len(x[side]) if x else 0 for x in both], dtype=np.int64) for side in (0, 1))
        self.a_stop, self.b_stop = np.cumsum(self.n_a), np.cumsum(self.n_b)
        a_ends, b_ends = np.cumsum(tokenizers.a_sizes[self.a]), np.cumsum(tokenizers.b_sizes[self.b])
        # The last ends of each text are shared; between them the search goes on.
        low, high = self.a_stop - self.n_a, np.maximum(self.a_stop - 1, 0)
        cut_a, cut_b = shared_cuts(a_ends, b_ends, low, high)
        some = self.n_a > 0
        self.a_cut, self.b_cut = np.zeros(len(self.a), dtype=bool), np.zeros(len(self.b), dtype=bool)
        self.a_cut[cut_a], self.a_cut[self.a_stop[some] - 1] = True, True
        self.b_cut[cut_b], self.b_cut[self.b_stop[some] - 1] = True, True
        self.at_a, self.at_b = np.flatnonzero(self.a_cut), np.flatnonzero(self.b_cut)
        self.stop = np.searchsorted(self.at_a, self.a_stop)  # of each text's groups
        self.n_groups = np.diff(self.stop, prepend=0)

    def links(self, alphabet: Alphabet) -> np.ndarray:
        """The number of the pair of tokens at every cut."""
        return np.searchsorted(alphabet.pairs, self.a[self.at_a] * alphabet.n_b + self.b[self.at_b])

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of either side in every group."""
        return np.diff(self.at_a, prepend=-1), np.diff(self.at_b, prepend=-1)

    def printed(self, tokenizers: Tokenizers) -> Iterator[str]:
        """The groups of each text: ``a1,a2|b1;a3|b2,b3``."""
        a_group = np.cumsum(self.a_cut) - self.a_cut
        b_group = np.cumsum(self.b_cut) - self.b_cut
        out = np.empty(len(self.a) + len(self.b), dtype=object)
        # In front of an A token stand the B tokens of earlier groups, in front of a B token the A tokens up to its group.
        out[np.arange(len(self.a)) + np.concatenate(([0], self.at_b + 1))[a_group]] = tokenizers.a_printed[self.a, self.a_cut.view(np.int8)]
        out[np.arange(len(self.b)) + (self.at_a + 1)[b_group]] = tokenizers.b_printed[self.b, self.b_cut.view(np.int8)]
        begin = 0
        for stop in (self.a_stop + self.b_stop).tolist():
            yield "".join(out[begin:stop].tolist())[:-1]
            begin = stop


def _lists(values: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], stops)), pa.int32()), pa.array(values, pa.int32()))


class Aligner:
    """Alignment of tables by one pair of tokenizers."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str, model: bytes):
        self.alphabet = Alphabet(ranks, pattern, model)
        self.shared = spark.sparkContext.broadcast(self.alphabet)

    def groups(self, docs: DataFrame) -> DataFrame:
        """doc_id, the ids of both sides, and how many of each every group takes, in order."""
        shared, names = self.shared, ["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in textscan.slices(batch, PIECE):
                    found = Aligned(tokenizers_of(shared), part.column("text").to_pylist())
                    a_sizes, b_sizes = found.sizes()
                    lists = [_lists(found.a, found.a_stop), _lists(found.b, found.b_stop), _lists(a_sizes, found.stop), _lists(b_sizes, found.stop)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names)

        id_type = docs.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {id_type}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
        return map_batches(docs.select("doc_id", "text"), run, schema)

    def scanned(self, docs: DataFrame) -> DataFrame:
        """Rows of two kinds: a document with its links, and the links of a task per pair (pair, n)."""
        shared = self.shared
        names = ["doc_id", "n_a", "n_b", "groups_sha256", "links", "pair", "n"]
        id_type = docs.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokenizers, pairs = tokenizers_of(shared), len(shared.value.pairs)
            total = np.zeros(pairs, dtype=np.int64)
            ids = None
            for batch in batches:
                ids = batch.schema.field("doc_id").type
                for part in textscan.slices(batch, PIECE):
                    found = Aligned(tokenizers, part.column("text").to_pylist())
                    links = found.links(shared.value)
                    total += np.bincount(links, minlength=pairs)
                    hashes = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in found.printed(tokenizers)]
                    no = pa.nulls(part.num_rows, pa.int32())
                    columns = [
                        part.column("doc_id"), pa.array(found.n_a), pa.array(found.n_b), pa.array(hashes, pa.string()),
                        _lists(links, found.stop), no, no.cast(pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names)
            if ids is not None:
                seen = np.flatnonzero(total)
                no = pa.nulls(len(seen), pa.int64())
                columns = [
                    pa.nulls(len(seen), ids), no, no, no.cast(pa.string()), pa.nulls(len(seen), pa.list_(pa.int32())),
                    pa.array(seen, pa.int32()), pa.array(total[seen]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names)

        schema = f"doc_id {id_type}, n_a bigint, n_b bigint, groups_sha256 string, links array<int>, pair int, n bigint"
        return map_batches(docs.select("doc_id", "text"), run, schema)

    @staticmethod
    def _summed(scan: DataFrame) -> DataFrame:
        return scan.where(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("n"))

    def _counts(self, scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Links per pair, and whether a pair has the most links of its B token.

        The driver reads one row per linked pair, and the vocabularies bound these.
        """
        table = self._summed(scan).toArrow()
        counts = np.zeros(len(self.alphabet.pairs), dtype=np.int64)
        counts[table["pair"].to_numpy()] = table["n"].to_numpy()
        b = self.alphabet.pairs % self.alphabet.n_b
        most = np.zeros(self.alphabet.n_b, dtype=np.int64)
        np.maximum.at(most, b, counts)
        return counts, (counts == most[b]) & (counts > 0)

    def pair_counts(self, docs: DataFrame) -> DataFrame:
        """How often tokens are linked over all documents: a_id, b_id, n, best."""
        counts, best = self._counts(self.scanned(docs))
        seen = np.flatnonzero(counts)
        a, b = np.divmod(self.alphabet.pairs[seen], self.alphabet.n_b)
        table = pa.table({"a_id": a, "b_id": b, "n": counts[seen], "best": best[seen]})
        return docs.sparkSession.createDataFrame(table, "a_id bigint, b_id bigint, n bigint, best boolean")

    def digest(self, docs: DataFrame) -> DataFrame:
        """Figures of the groups and links of every document."""
        scan = stored(self.scanned(docs), "alignment")
        counts = docs.sparkSession.sparkContext.broadcast(self._counts(scan))
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, best = counts.value
            for batch in batches:
                links = batch.column("links")
                pairs = links.flatten().to_numpy()
                stops = np.cumsum(pc.list_value_length(links).to_numpy())
                sums = []
                for values in (best.astype(np.int64), n):
                    before = np.concatenate(([0], np.cumsum(values[pairs])))
                    sums.append(np.diff(before[np.concatenate(([0], stops))]))
                n_groups = np.diff(stops, prepend=0)
                numbers = [pa.array(x, pa.int64()) for x in (n_groups, n_groups, *sums)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_a"), batch.column("n_b"), *numbers, batch.column("groups_sha256")], names
                )

        id_type = docs.schema["doc_id"].dataType.simpleString()
        schema = ", ".join([f"doc_id {id_type}", *[f"{c} bigint" for c in names[1:-1]], "groups_sha256 string"])
        rows = scan.where(F.col("n_a").isNotNull()).select("doc_id", "n_a", "n_b", "links", "groups_sha256")
        return map_batches(rows, run, schema)
