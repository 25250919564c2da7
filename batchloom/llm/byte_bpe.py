"""Byte-level BPE by prefix dynamic programming, with exact appends and edits.

A text is cut into the matches of a pattern, and each match is encoded on its own.
For every prefix of a match the table keeps one number: the last token of that
prefix's encoding. It is unique, and follows from shorter prefixes: token ``t``
ending at a byte is the last one exactly if the border between it and the last
token before it holds, that is if the merges of the two tokens' bytes never join
across that border. Walking back from the end gives the ids. So

* appended bytes only add entries: nothing before them changes;
* after an edit the table is filled anew from the edit on, and the old entries
  behind it hold again as soon as as many new ones as the longest token has
  bytes equal the old ones.

A vocabulary is a map from bytes to ranks. It needs all 256 single bytes. A match
that is a token as a whole becomes that token; a token that the merges of its own
bytes do not give is used for nothing else.

Defined cases: a null text counts as empty, and an empty text has no tokens. Texts
of any length are taken whole; the time grows with their bytes, also where one
match is the whole text, and ids are hashed in blocks. Equal rows give equal
results; empty tables give none. Other columns pass through ``encoded``, ``decoded``
and ``edited``, whose own columns (``ids``, ``ends``, ``last``, ``decoded``) replace
columns of these names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from batchloom.llm.common import map_batches

MEMO = 400_000  # words, and pairs of tokens, that a task remembers
REACH = 3  # characters behind a match that can decide where it ends ('ll)
BLOCK = 1 << 16  # matches that are encoded at once
# Classes that the pattern names; libraries differ in the version of Unicode.
_NEVER = float("inf")
_SHORT = (2, 1)
CLASSES = (r"\p{L}", r"\p{N}")
UNASSIGNED = "\u0378"  # neither a letter, a number nor a blank in any version


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file with a token in base64 and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def unlike_letters(pattern: str) -> str:
    """Characters that this library counts to a class of the pattern and the tokenizer's does not.

    The text is cut as the tokenizer's library cuts it, so these count as unassigned.
    """
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    out: set[str] = set()
    for name in CLASSES:
        if name in pattern:
            theirs = tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={})
            out |= set(regex.findall(name, every)) ^ set(theirs.decode(theirs.encode_ordinary(every)))
    return "".join(sorted(out))


class Vocabulary:
    """Ranks and the tables behind them; made once on the driver and broadcast."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.unlike = unlike_letters(pattern)
        # Per token: the parts at its right and left edge, from a byte to the token itself.
        # A part ends with the merge that makes the next one, so that one's rank is its end.
        self.right: dict[int, tuple[int, ...]] = {}
        self.left: dict[int, tuple[int, ...]] = {}
        lengths: dict[bytes, set[int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.right[rank] = self.left[rank] = (rank,)
                continue
            parts = _merged(token, ranks, rank)
            if len(parts) != 2 or any(ranks[p] not in self.right for p in parts):
                continue  # its own bytes do not merge to it
            self.left[rank] = (*self.left[ranks[parts[0]]], rank)
            self.right[rank] = (*self.right[ranks[parts[1]]], rank)
            lengths.setdefault(token[-3:], set()).add(len(token))
        self.reachable = {self.bytes_of[rank]: rank for rank in self.right}
        # Lengths of the tokens with the same last three bytes, longest first.
        self.lengths = {end: (*sorted(found - {2}, reverse=True), *_SHORT) for end, found in lengths.items() if len(end) == 3}
        self.longest = max(map(len, self.reachable))


def _merged(data: bytes, ranks: dict[bytes, int], below: float = _NEVER) -> list[bytes]:
    """Lowest rank first, leftmost first, merges below a rank only."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class _Memo(dict):
    """Results of a function, as many as fit the bound."""

    def __init__(self, fn):
        super().__init__()
        self.fn = fn

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        out = self[key] = self.fn(key)
        return out


class Codec:
    """Encodes and decodes texts; one per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._split = regex.compile(vocabulary.pattern)
        self._unlike = dict.fromkeys(map(ord, vocabulary.unlike), UNASSIGNED)
        self._holds = _Memo(self._border_holds)
        self._packed = _Memo(self._pack)
        self._shift = max(vocabulary.bytes_of) + 1

    # -- one match ---------------------------------------------------------

    def _border_holds(self, pair: int) -> bool:
        """Whether two tokens side by side stay as they are when their bytes are merged.

        Both sides grow from the border outwards, a part at a time, in order of rank. A
        merge across the border comes first if its rank is below the one that ends the
        left part, or not above the one that ends the right part: equal ranks merge from the left.
        """
        before, token = divmod(pair, self._shift)
        right, left = self.v.right[before], self.v.left[token]
        ranks, bytes_of = self.v.ranks, self.v.bytes_of
        i = j = 0
        while True:
            a_ends = right[i + 1] if i + 1 < len(right) else _NEVER
            b_ends = left[j + 1] if j + 1 < len(left) else _NEVER
            across = ranks.get(bytes_of[right[i]] + bytes_of[left[j]])
            if across is not None and across < a_ends and across <= b_ends:
                return False
            if a_ends <= b_ends:
                if a_ends == _NEVER:
                    return True
                i += 1
            else:
                j += 1

    def fill(self, data: bytes, last: list[int], begin: int, end: int) -> None:
        """Set ``last[begin:end]``; entry ``i`` is the last token of ``data[: i + 1]``."""
        reachable, lengths, holds, shift = self.v.reachable, self.v.lengths, self._holds, self._shift
        for i in range(begin + 1, end + 1):
            for n in lengths.get(data[i - 3 : i], _SHORT) if i > 2 else _SHORT:
                token = reachable.get(data[i - n : i]) if n < i else reachable.get(data[:i])
                if token is not None and (n >= i or holds[last[i - n - 1] * shift + token]):
                    last[i - 1] = token
                    break

    def table(self, data: bytes) -> list[int]:
        """The last token of every prefix of a match."""
        last = [0] * len(data)
        self.fill(data, last, 0, len(data))
        return last

    def refill(self, data: bytes, old: list[int], keep: int, behind: int) -> list[int]:
        """The table of a match of which the first ``keep`` and the last ``behind`` bytes are those of ``old``."""
        n, shift = len(data), len(data) - len(old)
        last = old[:keep] + [0] * (n - keep)
        same, at = 0, keep
        while at < n:
            self.fill(data, last, at, at + 1)
            if at >= n - behind and last[at] == old[at - shift]:
                same += 1
                if same >= self.v.longest:
                    last[at + 1 :] = old[at + 1 - shift :]
                    break
            else:
                same = 0
            at += 1
        return last

    def walked(self, last: list[int], data: bytes) -> list[int]:
        """The ids that a match's table stands for."""
        whole = self.v.ranks.get(data)
        if whole is not None:
            return [whole]
        out, i, bytes_of = [], len(last), self.v.bytes_of
        while i:
            token = last[i - 1]
            out.append(token)
            i -= len(bytes_of[token])
        return out[::-1]

    def piece_ids(self, data: bytes) -> list[int]:
        whole = self.v.ranks.get(data)
        return [whole] if whole is not None else self.walked(self.table(data), data)

    def _pack(self, piece: str) -> bytes:
        ids = self.piece_ids(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- texts -------------------------------------------------------------

    def like(self, text: str) -> str:
        """The text with characters whose class differs between libraries taken as unassigned."""
        if text.isascii() or self._unlike.keys().isdisjoint(map(ord, set(text))):
            return text
        return text.translate(self._unlike)

    def pieces(self, text: str, begin: int = 0) -> Iterator[str]:
        """The matches of the pattern from a place on."""
        like = self.like(text)
        if like is text:
            for found in self._split.finditer(text, begin):
                yield found[0]
        else:
            for found in self._split.finditer(like, begin):
                yield text[found.start() : found.end()]

    def blocks(self, text: str | None) -> Iterator[bytes]:
        """The ids as little-endian 32-bit integers, some matches at a time."""
        text = text or ""
        if len(text) <= BLOCK and self.like(text) is text:
            yield b"".join(map(self._packed.__getitem__, self._split.findall(text)))
            return
        some: list[bytes] = []
        for piece in self.pieces(text):
            some.append(self._packed[piece] if len(piece) < 256 else self._pack(piece))
            if len(some) == BLOCK:
                yield b"".join(some)
                some = []
        yield b"".join(some)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.blocks(text)), dtype="<u4")

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.v.bytes_of.__getitem__, ids))


class EncodedText:
    """A text with its matches and their tables, for appends and edits."""

    def __init__(self, codec: Codec, text: str, ends: list[int] | None = None, last: list[int] | None = None):
        self.codec, self.text = codec, text
        if ends is None:
            self.pieces = list(codec.pieces(text))
            if sum(map(len, self.pieces)) != len(text):
                raise ValueError("the pattern leaves out characters")
            self.tables = [codec.table(p.encode()) for p in self.pieces]
        else:
            self.pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
            self.tables, at = [], 0
            for piece in self.pieces:
                n = len(piece.encode())
                self.tables.append(last[at : at + n])
                at += n

    def ends(self) -> list[int]:
        """Where the matches end, in characters."""
        return np.cumsum([len(p) for p in self.pieces], dtype=np.int64).tolist()

    def last(self) -> list[int]:
        """The last token of every byte prefix, match after match."""
        return [t for table in self.tables for t in table]

    def ids(self) -> list[int]:
        return [t for p, table in zip(self.pieces, self.tables) for t in self.codec.walked(table, p.encode())]

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, begin: int, end: int, new: str) -> None:
        """Put ``new`` in the place of ``text[begin:end]``.

        Matches well before the edit stay; those behind it stay from the first place on
        where an old and a new match begin together.
        """
        if not 0 <= begin <= end <= len(self.text):
            raise ValueError("the edit lies outside the text")
        text = self.text[:begin] + new + self.text[end:]
        grown, stop = len(new) - (end - begin), begin + len(new)
        starts = [0, *self.ends()]
        first = max(int(np.searchsorted(starts, begin - REACH, side="right")) - 1, 0)
        old_of = {at + grown: k for k, at in enumerate(starts) if at >= end}
        at, made, rest = starts[first], [], len(self.pieces)
        for piece in self.codec.pieces(text, at):
            if at >= stop and at in old_of:
                rest = old_of[at]
                break
            made.append((at, piece))
            at += len(piece)
        tables = []
        for at, piece in made:
            data = piece.encode()
            k = int(np.searchsorted(starts, at, side="right")) - 1
            old = self.pieces[k].encode() if at <= begin and k < len(self.pieces) and starts[k] == at else None
            if old is None:
                tables.append(self.codec.table(data))
            else:  # as far as both have the same bytes at their ends, the table is that of before
                keep, behind, least = 0, 0, min(len(old), len(data))
                keep = _same(old, data, least)
                behind = _same(old[::-1], data[::-1], least - keep)
                tables.append(self.codec.refill(data, self.tables[k], keep, behind))
        self.pieces[first:rest] = [piece for _, piece in made]
        self.tables[first:rest] = tables
        self.text = text


def _same(a: bytes, b: bytes, most: int) -> int:
    """Length of the common beginning, ``most`` at most."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


# -- tables ----------------------------------------------------------------

_CODECS: weakref.WeakKeyDictionary[Vocabulary, Codec] = weakref.WeakKeyDictionary()


def codec_of(shared) -> Codec:
    """The codec of a broadcast vocabulary; a worker makes it once."""
    vocabulary = shared.value
    if vocabulary not in _CODECS:
        _CODECS[vocabulary] = Codec(vocabulary)
    return _CODECS[vocabulary]


class ByteBpe:
    """Encoding and decoding of tables by one vocabulary."""

    def __init__(self, spark, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks, pattern)
        self.shared = spark.sparkContext.broadcast(self.vocabulary)

    def _mapped(self, df: DataFrame, used: list[str], fn, columns: list[tuple[str, pa.DataType, str]]) -> DataFrame:
        """``df`` with columns that ``fn(codec, *values of a row)`` gives, in place of any of these names."""
        shared, names = self.shared, [name for name, _, _ in columns]
        kept = [c for c in df.columns if c not in names]
        inputs = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(used)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = codec_of(shared)
            for batch in batches:
                for i in range(batch.num_rows):  # a long text's arrays fill a batch of their own
                    row = batch.slice(i, 1)
                    values = fn(codec, *[row.column(f"__{k}")[0].as_py() for k in range(len(used))])
                    made = [pa.array([value], kind) for value, (_, kind, _) in zip(values, columns)]
                    yield pa.RecordBatch.from_arrays([*[row.column(c) for c in kept], *made], [*kept, *names])

        fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept]
        return map_batches(inputs, run, ", ".join([*fields, *[f"{name} {sql}" for name, _, sql in columns]]))

    def encoded(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the ids of each text, and its table: ends of matches, last token per byte prefix."""

        def run(codec: Codec, value: str | None):
            found = EncodedText(codec, value or "")
            return found.ids(), found.ends(), found.last()

        return self._mapped(docs, [text], run, _TABLE)

    def edited(self, table: DataFrame, begin: Column, end: Column, new: Column, text: str = "text") -> DataFrame:
        """A table of ``encoded`` with ``new`` in place of the characters ``begin`` to ``end`` of each text.

        Only what lies near the edit is encoded again. With begin and end at the text's
        length (null: there) it is an append.
        """
        length = F.coalesce(F.length(text), F.lit(0))
        wanted = table.withColumns({"__begin": F.coalesce(begin, length), "__end": F.coalesce(end, length), "__new": F.coalesce(new, F.lit(""))})

        def run(codec: Codec, value, ends, last, at, till, put):
            found = EncodedText(codec, value or "", ends, last)
            found.edit(at, till, put)
            return found.text, found.ids(), found.ends(), found.last()

        out = self._mapped(wanted, [text, "ends", "last", "__begin", "__end", "__new"], run, [(text, pa.string(), "string"), *_TABLE])
        return out.select(*[F.col(f"`{c}`") for c in table.columns])

    def decoded(self, table: DataFrame, ids: str = "ids") -> DataFrame:
        """``table`` with the bytes of its ids; null ids are no ids."""
        return self._mapped(table, [ids], lambda codec, value: (codec.decode(value or ()),), [("decoded", pa.binary(), "binary")])

    def digest(self, docs: DataFrame) -> DataFrame:
        """Number and hash of the ids of every text, and the hash of what they decode to."""
        shared = self.shared
        id_type = docs.schema["doc_id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = codec_of(shared)
            for batch in batches:
                counts, hashes, decoded = [], [], []
                for text in batch.column("text"):
                    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for block in codec.blocks(text.as_py()):
                        n += len(block) // 4
                        of_ids.update(block)
                        of_bytes.update(codec.decode(np.frombuffer(block, dtype="<u4").tolist()))
                    counts.append(n)
                    hashes.append(of_ids.hexdigest())
                    decoded.append(of_bytes.hexdigest())
                columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        schema = f"doc_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
        return map_batches(docs.select("doc_id", "text"), run, schema)


_TABLE = [
    ("ids", pa.list_(pa.int32()), "array<int>"),
    ("ends", pa.list_(pa.int32()), "array<int>"),
    ("last", pa.list_(pa.int32()), "array<int>"),
]
