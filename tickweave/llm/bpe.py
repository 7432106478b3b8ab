"""Byte-level BPE by backtracking over longest matches.

Bytes are mapped to Latin-1 characters so that an Aho-Corasick automaton over
strings finds every vocabulary entry that begins at a position. From the longest match at each
position the encoder goes forward as long as neighbouring tokens are compatible,
that is, as the merges of their joined bytes give just these two tokens; else it
tries the next shorter entry and, when none is left, steps back. A position that
was left backwards is never entered again, so the time is linear in the length
of a piece. Sequences whose neighbours are all compatible are the ones that the
merges by rank produce.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.runtime import give_back, kept_for, ship_package, table, thrifty

#: Bounds of the memos of a worker, in entries (pieces: of each of two generations), and the longest piece that is kept.
PIECES, PAIRS, LONGEST = 200_000, 300_000, 64
#: Texts above this many characters are cut at safe places, so that memory is bounded.
CUT = 1 << 20
#: Characters that one output batch takes; results don't depend on it, but ids, decoded bytes and their copies take a multiple in every worker.
BATCH = 1 << 20


class _Memo(dict):
    """Piece -> ids as packed 32-bit integers; computes what is missing.

    Of two generations of entries the older goes when the younger is full; what is
    used again moves to the younger, so frequent pieces stay.
    """

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array("i", self.make(piece.encode())).tobytes()
        if len(piece) <= LONGEST:
            if len(self) >= PIECES:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder for a rank file (base64 bytes and rank on each line)."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {r: b for b, r in self.rank.items()}
        self.size_of = {r: len(b) for b, r in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.width = max(map(len, self.rank))
        #: The longest vocabulary entry that is a proper prefix of a token.
        self.shorter = {r: next((self.rank[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.rank), None) for b, r in self.rank.items()}
        self._fits: dict[int, bool] = {}
        self._ids = _Memo(self.encode_piece)

    def merges(self, piece: bytes) -> list[int]:
        """The merges by rank, done plainly; only pairs of tokens are short enough to be merged so."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens may stand next to each other."""
        key = left << 32 | right
        out = self._fits.get(key)
        if out is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            out = self._fits[key] = self.merges(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return out

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        letters, n = piece.decode("latin-1"), len(piece)
        longest, size_of, shorter, known, fits, width = self.automaton.iter_long, self.size_of, self.shorter, self._fits, self.fits, self.width
        closed: set[int] = set()  # positions that were left backwards
        ids: list[int] = []
        at = 0
        token: int | None = next(longest(letters[:width]))[1]
        while True:
            while token is not None:
                to = at + size_of[token]
                if to not in closed:
                    if not ids:
                        break
                    fit = known.get(ids[-1] << 32 | token)
                    if fit or fit is None and fits(ids[-1], token):
                        break
                token = shorter[token]
            if token is not None:
                ids.append(token)
                if to == n:
                    return ids
                at = to
                token = next(longest(letters[at : at + width]))[1]
            elif ids:
                closed.add(at)
                last = ids.pop()
                at -= size_of[last]
                token = shorter[last]
            else:
                raise ValueError("the vocabulary lacks a byte of this text")

    def chunks(self, text: str):
        """Parts of a long text. Between a character and a single space that follows it, no match of the pattern goes on."""
        start = 0
        while len(text) - start > CUT:
            at = text.find(" ", start + CUT)
            while at > 0 and (text[at - 1].isspace() or at + 1 < len(text) and text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            yield text[start:at]
            start = at
        yield text[start:] if start else text

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as packed 32-bit integers; null is empty."""
        return b"".join(chain.from_iterable(map(self._ids.__getitem__, self.find(part)) for part in self.chunks(text or "")))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null is empty."""
        return np.frombuffer(self.encode_packed(text), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@kept_for("bpe")
@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again: doc_id, ids (array<int>), decoded (binary).

    ``path`` is a rank file that every worker can read (part of the installed
    vocabulary package). A null text counts as empty and gives no ids; ids may be
    null or repeated; empty tables give no rows. Texts of any length are encoded whole;
    very long ones in parts that end where no match can go on. Other columns, whatever
    their names, aren't read. No row is shuffled; a task holds a batch of input and a few
    MB of output at a time.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = codec(path, pattern)
        for batch in batches:
            texts, keys, start = batch.column(1), batch.column(0), 0
            while start < len(texts):
                ids, decoded, stop, taken = [], [], start, 0
                while stop < len(texts) and taken < BATCH:
                    text = texts[stop].as_py()
                    found = own.encode_packed(text)
                    ids.append(found)
                    decoded.append(own.decode(np.frombuffer(found, np.int32).tolist()))
                    taken += len(text or "") + 64
                    stop += 1
                offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(start, stop - start), lists, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])
                start = stop
                ids = decoded = lists = None
                give_back()

    return rows.mapInArrow(thrifty(run, "bpe"), f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    import public_tokenizers

    return digests(encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))
