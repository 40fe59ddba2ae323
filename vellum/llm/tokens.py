"""Encoding of texts as ids of a byte-level vocabulary, by a lazily determinised transducer.

A vocabulary of merges is compiled into a finite-state transducer over bytes. A state
is the token before the pending bytes with the pending bytes themselves; reading a byte
moves to a state with the token ends that are still possible and emits every token that
all of them share, so output lags input by less than the longest token. States and moves
are made when first met and then kept. Texts are cut into words by the vocabulary's
pattern first, and the path of a whole word is kept as one move.

Defined results: a null or empty text has an empty list of ids, never null. Strings that
look like special tokens are ordinary text. A lone surrogate cannot occur in a Spark
string. Repeated rows each come out; extra columns are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import base64
import codecs
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources.tables import table

#: Folder of the public vocabularies; a parameter of every function that reads one.
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: Words and states kept in a worker; beyond that the table starts anew, results stay the same.
KEPT_WORDS, KEPT_STATES = 400_000, 300_000


#: The vocabulary's word pattern (fixed value).
WORDS = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens with their ids from a file of base64 token and id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Transducer:
    """Bytes to token ids. ``ranks``: every single byte, and merged tokens by rising priority."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.starts: set[bytes] = {t[:n] for t in ranks for n in range(1, len(t))}  # what a longer token begins with
        self.pairs: dict[tuple[int, int], bool] = {}
        self.moves: dict[tuple[int, bytes], dict[int, tuple[tuple[int, bytes], list[int]]]] = {}
        self.chains: dict[tuple[int, bytes], list[list[int] | None]] = {}
        self.words: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """The ids of ``data`` by applying merges one by one; the transducer's definition, and its test."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            at = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            known = [r for r in at if r is not None]
            if not known:
                break
            i = at.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``: their bytes together are encoded as just these two."""
        found = self.pairs.get((left, right))
        if found is None:
            found = left < 0 or self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
            self.pairs[left, right] = found
        return found

    def _chains(self, state: tuple[int, bytes]) -> list[list[int] | None]:
        """For each prefix of the pending bytes its tokens after the state's token; None where there are none."""
        found = self.chains.get(state)
        if found is None:
            before, pending = state
            found = [[]]
            for end in range(1, len(pending) + 1):
                chain = None
                for begin in range(end):
                    head = found[begin]
                    token = self.ranks.get(pending[begin:end])
                    if token is None or head is None:
                        continue
                    if self.adjacent(head[-1] if head else before, token):
                        chain = [*head, token]
                        break
                found.append(chain)
            self.chains[state] = found
        return found

    def _move(self, state: tuple[int, bytes], byte: int) -> tuple[tuple[int, bytes], list[int]]:
        before, pending = state[0], state[1] + bytes([byte])
        chains = self._chains((before, pending))
        # A token end stays possible where the bytes after it begin a longer token, or nothing follows it.
        live = [c for i, c in enumerate(chains) if c is not None and (i == len(pending) or pending[i:] in self.starts)]
        shared = 0
        while all(len(c) > shared for c in live) and len({c[shared] for c in live}) == 1:
            shared += 1
        out = live[0][:shared]
        if shared:
            length = sum(len(self.tokens[t]) for t in out)
            before, pending = out[-1], pending[length:]
        return (before, pending), out

    def encode_bytes(self, data: bytes) -> list[int]:
        """Runs the transducer over the bytes of one word."""
        state: tuple[int, bytes] = (-1, b"")
        out: list[int] = []
        for byte in data:
            moves = self.moves.get(state)
            if moves is None:
                if len(self.moves) >= KEPT_STATES:
                    self.moves.clear(), self.chains.clear(), self.pairs.clear()
                moves = self.moves[state] = {}
            move = moves.get(byte)
            if move is None:
                move = moves[byte] = self._move(state, byte)
            state, made = move
            if made:
                out += made
        return out + self._chains(state)[-1]

    def encode_word(self, word: str) -> list[int]:
        ids = self.encode_bytes(word.encode("utf-8"))
        if len(self.words) >= KEPT_WORDS:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known, extend, make = self.words.get, out.extend, self.encode_word
        for word in WORDS.findall(text):
            extend(known(word) or make(word))
        return out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text piece by piece: a UTF-8 state machine holds back characters cut by token ends."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            if piece := machine.decode(self.tokens[i]):
                yield piece
        if rest := machine.decode(b"", True):
            yield rest


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    """The transducer of a vocabulary file, made once a worker."""
    return Transducer(read_ranks(path))


def encoded(df: DataFrame, id_col: str, text_col: str, vocabulary: str = BYTE_BPE_50K, folder: str = VOCABULARIES) -> DataFrame:
    """``(row_id, ids)`` of every row; the files must lie at the same path on every worker."""
    path = os.path.join(folder, vocabulary)

    def run(batches):
        import pyarrow as pa

        encode = transducer(path).encode
        for batch in batches:
            flat: list[int] = []
            ends = [0]
            for text in batch.column(1).to_pylist():
                flat += encode(text)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["row_id", "ids"])

    rows = df.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["row_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(run, schema)


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("row_id", "doc_id")
