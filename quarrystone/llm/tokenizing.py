"""Encoding of a corpus with a public byte-level BPE vocabulary.

Instead of merging pairs until nothing can be merged, the last token of the encoding of every prefix is
stored: each prefix has exactly one. A candidate is a vocabulary entry that is a suffix of the prefix
(all of them come from one automaton pass), and it is right if it may stand behind the last token of what
precedes it, i.e. if no merge would have joined bytes across their border earlier. The ids are read back
from the end. Work is linear in the length of a piece, also for pieces of millions of bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

#: Distinct pieces a worker remembers before it starts anew.
CACHE_PIECES = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the vocabulary file for the 256 bytes: printable Latin-1 for itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixEncoder:
    """Exact ids by dynamic programming over prefixes."""

    def __init__(self, path: str, pattern: str | None = None):
        import ahocorasick
        import public_tokenizers
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _alphabet()
        vocab = model["vocab"]
        # Strings of one Latin-1 character a byte, which the automaton takes as they are.
        to_bytes = lambda s: "".join(chr(letters[c]) for c in s)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for order, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if (a, b) not in self.joined:
                self.joined[a, b] = c
            if c not in self.halves:
                self.halves[c], self.rank[c] = (a, b), order + 1
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.automaton = ahocorasick.Automaton()
        for word, i in vocab.items():
            if len(word) > 1 and i not in self.halves:
                continue  # special tokens: their text is plain text
            if i in self.halves and not self._compatible(*self.halves[i], self.rank[i]):
                continue  # no encoding ever yields it
            text = to_bytes(word)
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.pieces = regex.compile(pattern or public_tokenizers.PATTERN).findall
        encoder = self

        class Memory(dict):
            def __missing__(self, piece: str) -> list[int]:
                if len(self) >= CACHE_PIECES:
                    self.clear()
                ids = encoder.encode_piece(piece.encode("utf-8", "surrogatepass").decode("latin-1"))
                if len(piece) <= 64:
                    self[piece] = ids
                return ids

        self.memory = Memory()

    def _compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether ``right`` may follow ``left`` in an encoding.

        Walks back through the merges that made the two, latest first, looking at the tokens that met at the
        border at each time. If any such pair has a merge of its own that came before the later of the two
        was made, the border would have been closed. ``before`` bounds the ranks at the start.
        """
        rank, halves, joined = self.rank, self.halves, self.joined
        limit = before if before is not None else len(joined) + 2
        while True:
            merged = joined.get((left, right))
            if merged is not None and rank[merged] < limit:
                return False
            made_left, made_right = rank.get(left, 0), rank.get(right, 0)
            if not made_left and not made_right:
                return True
            # The later one did not exist before its own merge; equal merges are made from the left on.
            if made_left > made_right:
                limit, left = made_left, halves[left][1]
            else:
                limit, right = made_right + 1, halves[right][0]

    def encode_piece(self, data: str) -> list[int]:
        """Ids of one piece, given as a string of one Latin-1 character a byte."""
        n = len(data)
        last: list[tuple[int, int] | None] = [None] * (n + 1)
        compatible = self.compatible
        for end, (token, size) in self.automaton.iter(data):
            if last[end + 1] is None:
                start = end + 1 - size
                if not start or ((before := last[start]) and compatible(before[0], token)):
                    last[end + 1] = (token, size)
        ids, at = [], n
        while at:
            token, size = last[at]
            ids.append(token)
            at -= size
        return ids[::-1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces(text))))


@lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def encode_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id_col, ids array<int>)`` of every row: the ids of its text, without special tokens.

    Null and empty texts give an empty list, repeated rows one row each, text that looks like a special
    token is plain text, an empty table an empty result. Further columns of any name are not read.
    No shuffle: a scan of two columns and one Arrow stage.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    src = docs.select(id_col, text_col)
    kind = src.schema[id_col].dataType.simpleString()
    return src.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` bigint of every row; null and empty texts have 0."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            n = [len(enc.encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    from pyspark.sql import types as T

    src = docs.select(*keep, text_col)
    return src.mapInArrow(run, T.StructType([*src.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))
