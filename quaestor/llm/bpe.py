"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is what the merges give for its bytes exactly if each two neighbours are: encoding their joined
bytes gives the two again. So a text's encoding is accepted by a finite-state machine that knows the last finished
token and how far the next one has been read. Reading it with all choices open (a set of such hypotheses) makes it
deterministic; sets are made when first met and kept with their transitions. Each prefix has one encoding, so at most
one token ends validly at a place; tokens go out once no other hypothesis is open. A hypothesis lives no longer than
the longest token, which bounds the lookahead.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_parts

#: A worker keeps at most so many sets with transitions, beyond which it starts anew, and so many encoded matches, of
#: which those go that were not met lately.
MAX_STATES, MAX_MATCHES = 200_000, 600_000
#: Of what a worker keeps by default, the share that it keeps where texts and ids stay in memory beside it.
FEWER = 0.2
#: Longer matches are encoded without being kept.
KEPT_BYTES = 48


def load_ranks(path: str) -> dict[bytes, int]:
    """The file's tokens and ranks: a line has a token's bytes in base 64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes the bytes of one match at a time by the ranks."""

    def __init__(self, ranks: dict[bytes, int], max_states: int):
        self.max_states = max_states
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                down = self.trie[node]
                if b not in down:
                    down[b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = down[b]
            self.token_at[node] = rank
        self._spines: dict[int, tuple[list, list]] = {}
        self._stay: dict[int, bool] = {}
        self._forget()

    def _forget(self) -> None:
        #: A set is a sorted tuple of hypotheses: last finished token and 1 (0: none), then, in the lower 32 bits, the
        #: place in the trie of the one being read; place 0 is the start.
        self.sets: list[tuple] = [(0,)]
        self.number = {self.sets[0]: 0}
        #: By set and byte: the next set, the token that ends with the byte (-1: none), and whether no other reading is open.
        self.steps: list[dict[int, tuple[int, int, bool]]] = [{}]

    def _merges(self, raw: bytes) -> list[bytes]:
        """The bytes by plain merging; used on single tokens only."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _edges(self, token: int) -> tuple[list, list]:
        """What stands at a token's left and at its right end while it is merged: [(bytes, rank of the merge that takes them)]."""
        found = self._spines.get(token)
        if found is None:
            raw = self.bytes_of[token]
            parts = [raw[i : i + 1] for i in range(len(raw))]
            left, right = [], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if rank == 1 << 60:
                    break
                if i == 0:
                    left.append((parts[0], rank))
                if i == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            left.append((parts[0], 1 << 61))
            right.append((parts[-1], 1 << 61))
            found = self._spines[token] = left, right
        return found

    def stays(self, a: int, b: int) -> bool:
        """Whether the merges leave a boundary between the tokens a and b: at no time does a merge across it come first.

        Of merges of one rank the leftmost comes first: one inside `a` before one across, one across before one in `b`.
        """
        known = self._stay.get(a << 32 | b)
        if known is None:
            right, left, i, j, known = self._edges(a)[1], self._edges(b)[0], 0, 0, True
            while True:
                (x, x_ends), (y, y_ends) = right[i], left[j]
                across = self.ranks.get(x + y)
                if across is not None and across < x_ends and across <= y_ends:
                    known = False
                    break
                if x_ends == y_ends == 1 << 61:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self._stay) > 4 * self.max_states:
                self._stay.clear()
            self._stay[a << 32 | b] = known
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int, bool]:
        moved, ended, trie, stay = [], -1, self.trie, self._stay
        for hypothesis in self.sets[state]:
            node = trie[hypothesis & 0xFFFFFFFF].get(byte)
            if node is None:
                continue
            last = hypothesis >> 32
            if trie[node]:
                moved.append(last << 32 | node)
            token = self.token_at[node]
            if token >= 0 and ended < 0:
                if last:
                    known = stay.get(last - 1 << 32 | token)
                    if not (self.stays(last - 1, token) if known is None else known):
                        continue
                ended = token
        if ended >= 0:
            moved.append(ended + 1 << 32)
        moved.sort()
        new = tuple(moved)
        target = self.number.get(new)
        if target is None:
            target = self.number[new] = len(self.sets)
            self.sets.append(new)
            self.steps.append({})
        out = self.steps[state][byte] = target, ended, len(new) == 1 and ended >= 0
        return out

    def encode(self, raw: bytes) -> list[int]:
        """The ids of one match. Where only one reading is left, its tokens go out and the rest starts from there."""
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        if len(self.sets) > self.max_states:
            self._forget()
        out: list[int] = []
        ends: list[int] = []
        steps, state = self.steps, 0
        for byte in raw:
            step = steps[state].get(byte)
            state, ended, sure = self._step(state, byte) if step is None else step
            ends.append(ended)
            if sure:
                out += self._back(ends)
                ends = []
        return out + self._back(ends) if ends else out

    def _back(self, ends: list[int]) -> list[int]:
        """The tokens that lead to the last place, found from there backwards."""
        found, at = [], len(ends)
        while at:
            found.append(ends[at - 1])
            at -= len(self.bytes_of[ends[at - 1]])
        found.reverse()
        return found


class Utf8:
    """An incremental UTF-8 state machine: takes bytes in any pieces, gives the characters that are complete.

    Bytes that can't belong to a character become U+FFFD, one for each longest part that could still have become one.
    """

    def __init__(self) -> None:
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, bytearray()

    def feed(self, raw: bytes) -> str:
        out: list[str] = []
        for b in raw:
            if self.need:
                if self.low <= b <= self.high:
                    self.held.append(b)
                    self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                    if not self.need:
                        out.append(self.held.decode())
                        self.held.clear()
                    continue
                out.append(self.end())
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xF4:
                self.need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
                self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(b, 0x80)
                self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(b, 0xBF)
                self.held.append(b)
            else:
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """What an unfinished character gives; the machine starts anew."""
        left = "�" if self.held else ""
        self.__init__()
        return left


class Streams:
    """Decodes tokens by the UTF-8 machine, whose runs over a token are kept.

    A place is the machine's unfinished bytes; from each place a token leads to a text and to the next place. Both are
    found by the machine when first met. Most tokens are whole characters: those are read off as they come.
    """

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {}
        self.whole: dict[int, str] = {}
        for i in bytes_of:
            text, held = self._run(b"", i)
            if not held:
                self.whole[i] = text

    def _run(self, held: bytes, token: int) -> tuple[str, bytes]:
        machine = Utf8()
        machine.feed(held)
        return machine.feed(self.bytes_of[token]), bytes(machine.held)

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        """After each id, the characters that are complete by then."""
        held = b""
        for i in ids:
            moves = self.moves.setdefault(held, {})
            move = moves.get(i)
            if move is None:
                move = moves[i] = self._run(held, i)
            held = move[1]
            if move[0]:
                yield move[0]
        if held:
            yield "\ufffd"

    def text(self, ids: list[int]) -> str:
        """All pieces joined; stretches of whole tokens need no machine."""
        read = list(map(self.whole.get, ids))
        if None not in read:
            return "".join(read)
        out, at = [], 0
        while at < len(read):
            try:
                broken = read.index(None, at)
            except ValueError:
                broken = len(read)
            out += read[at:broken]
            held, at = b"", broken
            while at < len(read) and (held or read[at] is None):
                moves = self.moves.setdefault(held, {})
                move = moves.get(ids[at])
                if move is None:
                    move = moves[ids[at]] = self._run(held, ids[at])
                held, at = move[1], at + 1
                out.append(move[0])
            if held:
                out.append("\ufffd")
        return "".join(out)


class Codec:
    """Encodes and decodes texts; keeps the ids of the matches that it has met."""

    def __init__(self, path: str, pattern: str, share: float = 1.0):
        self.max_matches = int(share * MAX_MATCHES)
        self.transducer = Transducer(load_ranks(path), int(share * MAX_STATES))
        self.streams = Streams(self.transducer.bytes_of)
        self.pattern = regex.compile(pattern)
        #: By match its ids as bytes of 32-bit numbers: those met lately, and those before.
        self.kept: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, match: str) -> bytes:
        ids = self.before.get(match)
        if ids is None:
            ids = array("i", self.transducer.encode(match.encode("utf-8", "replace"))).tobytes()
            if len(match) > KEPT_BYTES:
                return ids
        if len(self.kept) >= self.max_matches // 2:
            self.kept, self.before = {}, self.kept
        self.kept[match] = ids
        return ids

    def encode_array(self, text: str | None) -> np.ndarray:
        """The ids of each match of the pattern, one after another (None: of an empty text)."""
        matches = self.pattern.findall(text or "")
        found = list(map(self.kept.get, matches))
        if None in found:
            found = [self._ids(m) if ids is None else ids for m, ids in zip(matches, found, strict=True)]
        return np.frombuffer(b"".join(found), dtype=np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of ids as they come: after each id, the characters that are complete by then."""
        return self.streams.pieces(ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, decoded as a stream."""
        return self.streams.text(ids)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """This worker's codec for a vocabulary file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", to: str = "ids") -> DataFrame:
    """docs with the token ids of `text` as array<int>, as whole texts (null: no ids); a column named `to` is replaced."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for t in texts:
            yield pd.Series([c.encode_array(x) for x in t], dtype="object")

    return docs.withColumn(to, ids(text))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """docs with the text of an array of ids, decoded as a stream; a column named `to` is replaced."""

    @F.pandas_udf("string")
    def texts(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(path, pattern)
        for s in series:
            yield pd.Series([None if x is None else c.decode(x.tolist()) for x in s], dtype="object")

    return docs.withColumn(to, texts(ids))


def encode_and_check(docs: DataFrame, path: str, pattern: str, rows: int = 200) -> DataFrame:
    """docs with n_tokens, ids (array<int>) and round_trip: whether the ids, decoded as a stream, give the text (null: the empty one).

    Results leave a worker in batches of a few rows, so that it never holds the ids of many texts; what it keeps goes
    when its task ends. Columns of these names are replaced.
    """
    docs = docs.drop("n_tokens", "ids", "round_trip")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = Codec(path, pattern, FEWER)
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.iloc[at : at + rows]
                ids = [c.encode_array(t) for t in part["text"]]
                same = [c.decode(i.tolist()) == (t or "") for i, t in zip(ids, part["text"], strict=True)]
                yield part.assign(n_tokens=[len(i) for i in ids], ids=ids, round_trip=same)

    kinds = ", ".join(f"`{n}` {k}" for n, k in docs.dtypes)
    return map_parts(docs, run, f"{kinds}, n_tokens long, ids array<int>, round_trip boolean")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """For each row of docs its doc_id, n_tokens, and the SHA-256 of its ids (decimal, joined by commas) and of the bytes they decode to.

    Null and empty texts have no tokens and the digests of nothing. Repeated rows each give a row.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, valid_utf8 boolean")
    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path, pattern)
        decimal = {i: str(i) for i in c.transducer.bytes_of}.__getitem__
        for t in texts:
            out = []
            for x in t:
                ids = c.encode_array(x).tolist()
                decoded = c.decode(ids)
                out.append((len(ids), hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), decoded == (x or "")))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256", "valid_utf8"])

    return docs.select("doc_id", digests("text").alias("d")).select("doc_id", "d.*")
