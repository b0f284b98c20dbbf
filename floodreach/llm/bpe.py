"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if the encoding of every two neighbours' bytes is those two
neighbours: no merge ever crosses a boundary between tokens that does not cross it when the two stand alone. So the encoder is
an automaton over bytes whose nondeterministic states are (tokens so far, place inside the token in progress); a token may
be completed only behind a neighbour it is stable with. Exactly one state of each set has no token in progress: the encoding
of the bytes read so far. Sets of states are determinised on first use; what all states of a set agree on is emitted at once,
so lookahead is bounded by the longest token.

Scale: one pass over the texts, no shuffle. The vocabulary travels once, as the bytes of its file. Each worker keeps at most
``STATES`` sets, ``PAIRS`` neighbours and twice ``PIECES`` encoded pieces and starts afresh beyond that.

Defined cases: null is encoded as the empty text; repeated rows are encoded each on its own; ids unknown to the vocabulary
cannot be decoded and raise an error."""
from __future__ import annotations

import base64
import gc
import sys
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from . import scan

STATES, PAIRS, PIECES, SHORT = 1 << 17, 1 << 19, 1 << 18, 64
CHUNK = 1 << 14  # ids decoded at a time
_NEVER, _NODE_BITS = 1 << 62, 20
_NODE, _ASKED = (1 << _NODE_BITS) - 1, (1 << 21) - 1


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    """The lines of a rank file: base64 of the token, its id."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Transducer:
    """A set of states is a tuple: the token emitted last (-1: none), then its members as ``held << NODE_BITS | node``, where
    ``node`` is a place in the trie of tokens and ``held`` numbers the sequence of tokens held back (0: none). The member
    without a token in progress, at the trie's root, comes last."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        child: dict[int, int] = {}  # node << 8 | byte -> node
        ends, inner = [-1], [True]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                inner[node] = True
                to = child.get(node << 8 | b)
                if to is None:
                    to = child[node << 8 | b] = len(ends)
                    ends.append(-1)
                    inner.append(False)
                node = to
            ends[node] = rank
        if len(ends) >= 1 << _NODE_BITS:
            raise ValueError("vocabulary too large")
        # node << 8 | byte -> node << 8 of the node below, whether tokens go on below that, the token that ends there (-1: none)
        self.down = {key: (to << 8, inner[to], ends[to]) for key, to in child.items()}
        self.pairs: dict[int, bool] = {}
        self.histories: dict[int, tuple] = {}
        self.fresh = _Pieces(self, {})
        self._restart()

    def _restart(self) -> None:
        """Forget all determinised sets; the first is the empty encoding."""
        self.number: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.held: list[tuple[int, ...]] = [()]
        self.longer: dict[int, int] = {}  # held << _NODE_BITS | token -> held
        self.asked = bytearray(_ASKED + 1)  # hashed transitions asked for once
        self._set((-1, 0))

    def _set(self, key: tuple) -> int:
        at = self.number.setdefault(key, len(self.sets))
        if at == len(self.sets):
            self.sets.append(key)
        return at

    def _append(self, held: int, token: int) -> int:
        key = held << _NODE_BITS | token
        at = self.longer.get(key)
        if at is None:
            at = self.longer[key] = len(self.held)
            self.held.append((*self.held[held], token))
        return at

    def _without(self, code: int, n: int) -> int:
        """A member less its first ``n`` tokens held back."""
        at = 0
        for token in self.held[code >> _NODE_BITS][n:]:
            at = self._append(at, token)
        return at << _NODE_BITS | code & _NODE

    def _history(self, token: int) -> tuple:
        """How BPE builds a token alone: whether it does, whether merges come in rank order, and the parts that stood at its left
        and its right edge, each with the rank that made it and the rank that absorbed it."""
        found = self.histories.get(token)
        if found is not None:
            return found
        data = self.tokens[token]
        parts = [data[i:i + 1] for i in range(len(data))]
        edges = ([[parts[0], -1, _NEVER]], [[parts[-1], -1, _NEVER]])
        orderly, before = True, -1
        while len(parts) > 1:
            rank, at = min([(self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)])
            if rank == _NEVER:
                break
            orderly, before = orderly and rank >= before, rank
            for edge, touched in zip(edges, (at == 0, at == len(parts) - 2)):
                if touched:
                    edge[-1][2] = rank
                    edge.append([parts[at] + parts[at + 1], rank, _NEVER])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        found = self.histories[token] = (len(parts) == 1, orderly, *edges)
        return found

    def _merged(self, data: bytes) -> list[bytes]:
        """BPE by its definition."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min([(self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)])
            if rank == _NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' bytes gives these two tokens (``left`` below 0: none)."""
        found = self.pairs.get(left << _NODE_BITS | right)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left << _NODE_BITS | right] = self._stable(left, right)
        return found

    def _stable(self, left: int, right: int) -> bool:
        whole, orderly, begins, _ = self._history(right)
        if left < 0 or not whole:
            return whole
        whole, too, _, finishes = self._history(left)
        if not (whole and orderly and too):
            return self._merged(self.tokens[left] + self.tokens[right]) == [self.tokens[left], self.tokens[right]]
        for x, x_made, x_gone in finishes:
            for y, y_made, y_gone in begins:
                rank = self.ranks.get(x + y)
                if rank is not None:  # a merge across the border comes about if both parts stand when its turn comes
                    both = max(x_made, y_made)
                    if rank >= both and rank < x_gone and rank <= y_gone or rank < both and both < x_gone and both < y_gone:
                        return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        members = self.sets[state]
        last, down = members[0], self.down
        after, whole = [last], -1
        for code in members[1:]:
            node = code & _NODE
            found = down.get(node << 8 | byte)
            if found is not None:
                to, more, token = found
                if more:
                    after.append(code - node + (to >> 8))
                if token >= 0 and whole < 0:
                    held = code >> _NODE_BITS
                    if self.stable(self.held[held][-1] if held else last, token):
                        whole = self._append(held, token)
        out: tuple[int, ...] = ()
        if len(after) == 1:
            out, after = self.held[whole], [self.held[whole][-1], 0]
        else:
            first = self.held[after[1] >> _NODE_BITS]
            after.append(whole << _NODE_BITS)
            if first:
                sequences = [self.held[code >> _NODE_BITS] for code in after[1:]]
                shared = 0
                while shared < len(first) and all([len(s) > shared and s[shared] == first[shared] for s in sequences]):
                    shared += 1
                if shared:
                    out = first[:shared]
                    after = [out[-1], *[self._without(code, shared) for code in after[1:]]]
        result = self.steps[state << 8 | byte] = self._set(tuple(after)), out
        return result

    def _rest(self, state: int, rest: bytes) -> tuple[int, ...]:
        """Ids still to come after ``state``, without determinising the sets on the way: for the ends of rare pieces."""
        last, *codes = self.sets[state]
        down, pairs, whole = self.down.get, self.pairs.get, None
        members = [(self.held[code >> _NODE_BITS], (code & _NODE) << 8) for code in codes]
        for byte in rest:
            after, whole = [], None
            for held, node in members:
                found = down(node | byte)
                if found is not None:
                    to, more, token = found
                    if more:
                        after.append((held, to))
                    if whole is None and token >= 0:
                        left = held[-1] if held else last
                        fits = pairs(left << _NODE_BITS | token)
                        if self.stable(left, token) if fits is None else fits:
                            whole = (*held, token)
            after.append((whole, 0))
            members = after
        return whole

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece of the split pattern. A piece that is a token stands for itself.

        A transition is determinised when it is asked for a second time; the first time, a short piece is read to its end as is."""
        alone = self.ranks.get(piece)
        if alone is not None:
            return (alone,)
        if len(self.sets) > STATES:
            self._restart()
        state, ids, steps, asked = 0, [], self.steps, self.asked
        short = len(piece) <= SHORT
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                if short and not asked[key * 0x9E3779B1 >> 7 & _ASKED]:
                    asked[key * 0x9E3779B1 >> 7 & _ASKED] = 1
                    return (*ids, *self._rest(state, piece[at:]))
                step = self._step(state, byte)
            state = step[0]
            if step[1]:
                ids.extend(step[1])
            if len(self.sets) > 2 * STATES:  # only inside one very long piece
                key, held = self.sets[state], self.held
                self._restart()
                steps, codes = self.steps, []
                for code in key[1:]:
                    at = 0
                    for token in held[code >> _NODE_BITS]:
                        at = self._append(at, token)
                    codes.append(at << _NODE_BITS | code & _NODE)
                state = self._set((key[0], *codes))
        ids.extend(self.held[self.sets[state][-1] >> _NODE_BITS])
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        if len(self.fresh) >= PIECES:
            self.fresh = _Pieces(self, self.fresh)
        return list(chain.from_iterable(map(self.fresh.__getitem__, self.split.findall(text))))


class _Pieces(dict):
    """Ids of pieces, encoded when first asked for; what the table before this one knew is taken over on use."""

    def __init__(self, machine: Transducer, before: dict):
        super().__init__()
        self.machine, self.before = machine, dict(before)

    def __missing__(self, piece: str) -> tuple[int, ...]:
        own = self.before.get(piece) or self.machine.encode_piece(piece.encode())
        if len(piece) <= SHORT and len(self) < 2 * PIECES:
            self[piece] = own
        return own


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


# Lead bytes of UTF-8 with how many bytes follow and the range of the first of them
_LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
          (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
_LEAD = {b: (n, low, high) for first, end, n, low, high in _LEADS for b in range(first, end + 1)}


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes may be cut anywhere. A malformed sequence becomes one U+FFFD for each of its longest
    well-formed beginnings."""

    def __init__(self):
        self.open, self.need, self.low, self.high = b"", 0, 0x80, 0xBF

    def _advance(self, byte: int) -> str | None:
        """Text that is certain after one more byte."""
        out = ""
        if self.need:
            if self.low <= byte <= self.high:
                self.open += bytes([byte])
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                if self.need:
                    return ""
                done, self.open = self.open, b""
                return done.decode()
            out, self.open, self.need = "�", b"", 0
        if byte < 0x80:
            return out + chr(byte)
        if byte not in _LEAD:
            return out + "�"
        self.open = bytes([byte])
        self.need, self.low, self.high = _LEAD[byte]
        return out

    def feed(self, data: bytes) -> str:
        out, at = [], 0
        while self.need and at < len(data):
            out.append(self._advance(data[at]))
            at += 1
        cut = len(data)
        for back in range(1, min(3, cut - at) + 1):  # a sequence begun in the last three bytes may be unfinished
            lead = data[cut - back]
            if lead >= 0xC0:
                cut -= back if _LEAD.get(lead, (0,))[0] >= back else 0
                break
            if lead < 0x80:
                break
        try:
            out.append(data[at:cut].decode())
        except UnicodeDecodeError:
            out.extend(map(self._advance, data[at:cut]))
        out.extend(map(self._advance, data[cut:]))
        return "".join(out)

    def close(self) -> str:
        out = "�" if self.need else ""
        self.__init__()
        return out


def decode_stream(ids: list[int], tokens: list[bytes | None] | dict[int, bytes], chunk: int = CHUNK) -> Iterator[tuple[bytes, str]]:
    """The bytes and the certain text of each chunk of ids."""
    machine = Utf8Stream()
    for at in range(0, len(ids), chunk):
        data = b"".join(map(tokens.__getitem__, ids[at:at + chunk]))
        yield data, machine.feed(data)
    yield b"", machine.close()


def _shared(df: DataFrame, path: str):
    with open(path, "rb") as f:  # a vocabulary file is small and of fixed size
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The id column and ``ids``: the text's token ids as little-endian unsigned 32-bit integers in one binary value."""
    raw, key = _shared(docs, path), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        gc.disable()  # the tables hold millions of small tuples; the one cycle goes when the next stage lets the table go
        machine = scan.held(("bpe", hash((raw.value, pattern))), lambda: Transducer(parse_ranks(raw.value), pattern))
        for batch in batches:
            _, offsets = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                out = [packed(machine.encode(t or "")) for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(out, pa.binary())], ["doc_id", ids])
    return scan.small_batches(docs).select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {key}, {ids} binary")


def _table(raw: bytes) -> list[bytes | None]:
    ranks = parse_ranks(raw)
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def _decoded(values, tokens: list[bytes | None] | dict[int, bytes]) -> list[pa.Array]:
    """Bytes and number of characters of each id sequence."""
    data, chars = [], []
    for ids in values:
        pieces = list(decode_stream(ids, tokens))
        data.append(b"".join([p[0] for p in pieces]))
        chars.append(sum([len(p[1]) for p in pieces]))
    return [pa.array(data, pa.binary()), pa.array(chars, pa.int64())]


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded`` (the bytes the ids stand for) and ``n_decoded_chars`` (code points of their text)."""
    raw = _shared(encoded, path)

    def run(batches):
        tokens = _table(raw.value)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            _, offsets = scan.buffers(batch.column(at))
            for a, b in scan.slices(offsets):
                part = batch.slice(a, b - a)
                found = _decoded((np.frombuffer(v or b"", "<u4").tolist() for v in part.column(at).to_pylist()), tokens)
                yield pa.record_batch([*part.columns, *found], [*part.schema.names, "decoded", "n_decoded_chars"])
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return scan.small_batches(encoded).mapInArrow(run, f"{kinds}, decoded binary, n_decoded_chars bigint")


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """doc_id, ids, decoded and n_decoded_chars in one pass, by the same encoder and decoder."""
    raw, key = _shared(docs, path), docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        gc.disable()  # the tables hold millions of small tuples; the one cycle goes when the next stage lets the table go
        machine = scan.held(("bpe", hash((raw.value, pattern))), lambda: Transducer(parse_ranks(raw.value), pattern))
        tokens = machine.tokens
        for batch in batches:
            _, offsets = scan.buffers(batch.column(1))
            for a, b in scan.slices(offsets):
                ids = [machine.encode(t or "") for t in batch.column(1).slice(a, b - a).to_pylist()]
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([packed(x) for x in ids], pa.binary()), *_decoded(ids, tokens)], ["doc_id", "ids", "decoded", "n_decoded_chars"])
    return scan.small_batches(docs).select("doc_id", F.col(text).cast("string")).mapInArrow(run, f"doc_id {key}, ids binary, decoded binary, n_decoded_chars bigint")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and n_chars of every document row."""
    out = round_trip(docs, path, pattern)
    return out.select("doc_id", F.expr("cast(octet_length(ids) / 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"), F.col("n_decoded_chars"))
