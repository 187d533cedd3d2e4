"""Exact byte-pair encoding of texts with a public vocabulary.

For a byte string, the encoding of every prefix ends in exactly one token, and
the encoding of the whole is found by following these last tokens backwards. An
automaton with suffix links over the vocabulary (Aho-Corasick) lists, while it
reads the string once, all tokens that are a suffix of the prefix read so far.
Of these, the last token is the one that is compatible with the last token of
the prefix before it: the pair, joined and encoded, gives the same two tokens
again. That takes time in proportion to the matches, however long the string,
where merging by rank is quadratic.

Texts are split by the vocabulary's pattern, and the merges never cross a
piece, so encodings of pieces, and of the words they lie in, are remembered by
each worker up to a fixed number; forgetting costs time, not exactness.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tideline.session import spread

#: Ranks of the tokens, one line each: the token in base 64, its id.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# White space of Unicode, as the pattern of the vocabulary means it.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# The pattern of the vocabulary, with its white space spelled out.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE + r"\p{L}\p{N}]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
)
#: Words: unions of whole pieces, since a piece never goes on after a last blank.
WORDS = r" ?[^" + WHITE + r"]+|[" + WHITE + r"]+(?![^" + WHITE + r"])|[" + WHITE + r"]+"
#: The same on ASCII, where a small set is faster.
ASCII_WORDS = r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"

#: Rows whose ids a worker holds at a time.
ROWS = 1024
#: Entries that a worker remembers of each kind, and the longest word it remembers.
REMEMBERED = 1 << 18
LONGEST_WORD = 64


class Memo(dict):
    """Results of a function by argument; emptied when it holds too many."""

    def __init__(self, f: Callable, limit: int = REMEMBERED):
        self.f, self.limit = f, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.f(key)
        return value


class Encoder:
    """Encodes texts; ids come as the bytes of little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"a vocabulary needs a token for every byte; it has none for {missing}")
        self.ranks = ranks
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.token = {rank: token for token, rank in ranks.items()}
        self.halves = Memo(self._halves)
        self.compatible = Memo(self._compatible, 1 << 20)
        self.piece = Memo(self._piece)
        self.words = Memo(self._word)
        self._pieces = regex.compile(PIECES).findall
        self._words = re.compile(WORDS).findall
        self._ascii_words = re.compile(ASCII_WORDS).findall

    def merge(self, text: bytes) -> list[int]:
        """The definition: join the adjacent pair of least rank, the leftmost of equals, until none is a token."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose join made a token; None for a single byte."""
        raw = self.token[rank]
        if len(raw) == 1:
            return None
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 2:
            at = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _compatible(self, pair: tuple[int, int]) -> bool:
        """Whether merge(left + right) == [left, right], without merging.

        Walks back in time. The border between the two survives if at no time
        the parts beside it could be joined before the next join inside one of
        them. That next join has its rank as its time; of equal ranks the
        leftmost is first, so a join across the border loses a tie with one on
        its left and wins a tie with one on its right.
        """
        left, right = pair
        ranks, token, halves = self.ranks, self.token, self.halves
        before = 1 << 60
        while True:
            if ranks.get(token[left] + token[right], 1 << 60) < before:
                return False
            # Undo whichever of the two was made last: of equals, the right one.
            if left > right and halves[left] is not None:
                before, left = left, halves[left][1]
            elif halves[right] is not None:
                before, right = right + 1, halves[right][0]
            elif halves[left] is not None:
                before, left = left, halves[left][1]
            else:
                return True

    def prefixes(self, text: bytes) -> list[int]:
        """Ids of a byte string, by the last token of every prefix."""
        last, length = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        compatible = self.compatible
        for end, (rank, size) in self.automaton.iter(text.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            start = end - size
            if not start or compatible[last[start], rank]:
                last[end], length[end] = rank, size
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= length[at]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.ranks.get(raw)  # a token is its own encoding
        return np.array(self.prefixes(raw) if whole is None else [whole], "<i4").tobytes()

    def _word(self, word: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self._pieces(word)))

    def encode(self, text: str) -> bytes:
        words = (self._ascii_words if text.isascii() else self._words)(text)
        if len(words) and max(map(len, words)) > LONGEST_WORD:
            known, piece = self.words, self._word_unremembered
            return b"".join(known[w] if len(w) <= LONGEST_WORD else piece(w) for w in words)
        return b"".join(map(self.words.__getitem__, words))

    def _word_unremembered(self, word: str) -> bytes:
        known = self.piece
        return b"".join(known[p] if len(p) <= LONGEST_WORD else self._piece(p) for p in self._pieces(word))


def read_ranks(content: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: bytes) -> Encoder:
    """The encoder of a vocabulary file's content; a process makes each once."""
    name = hashlib.sha256(content).hexdigest()
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(read_ranks(content))
    return _ENCODERS[name]


def _content(spark: SparkSession, vocabulary: str):
    """A vocabulary, read once by the driver and sent to the executors: of fixed size, below 1 MB."""
    with open(vocabulary, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def _with_encoding(df: DataFrame, text: str, name: str, kind: T.DataType, vocabulary: str, column: Callable) -> DataFrame:
    if name.lower() == text.lower():
        raise ValueError("the result needs a name other than the text's")
    rest = df.drop(name)
    content = _content(df.sparkSession, vocabulary)
    schema = T.StructType([*rest.schema.fields, T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value).encode
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                yield part.append_column(name, column([encode(x.as_py()) if x.is_valid else b"" for x in part.column(text)]))

    return spread(rest).mapInArrow(run, schema)


def _ids_column(ids: list[bytes]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def _counts_column(ids: list[bytes]) -> pa.Array:
    return pa.array([len(x) // 4 for x in ids], pa.int64())


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the token ids of a text column, an array of integers.

    No special tokens are added or recognised. Null and empty texts both give
    the empty list; blank texts are encoded as they are, texts of any length
    whole. A column that has the name of the result is replaced; all others
    stay. Rows are independent: no shuffle, an empty table stays empty.
    """
    return _with_encoding(df, text, ids, T.ArrayType(T.IntegerType()), vocabulary, _ids_column)


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """df with the number of tokens of a text column; 0 for null and empty texts. See encode."""
    return _with_encoding(df, text, tokens, T.LongType(), vocabulary, _counts_column)
