"""Byte-level BPE: encoding by a lazily determinised transducer, decoding by an incremental UTF-8 state machine.

**Encoder.**  Byte-pair merging never joins across a cut that is in its final result, so the encoding of a prefix ends where a
token of the whole ends, and every prefix has one last token.  After reading the bytes p, the token that crosses the end of p
must start at a position j for which p[j:] is a proper prefix of a token (or empty); all futures pass through one of these
hypotheses.  Cuts that the encodings of all p[:j] share are final: the tokens before the last shared cut are emitted and
dropped.  What remains (a bounded residue: the hypotheses reach back no further than the longest token) is the state.  States
and transitions are made when first needed and kept; the determinisation is lazy and its table is bounded.

**Decoder.**  Tokens are byte strings that may end inside a character.  The state says which bytes may follow and how many
bytes of an unfinished character are pending; (state, token) transitions are made when first needed.

Defined results: null text encodes as empty text to no tokens; an empty table gives no rows; unknown ids raise ``KeyError``;
repeated rows each get a row; a very long text or pre-token takes memory in proportion to its own length, the transducer's table
stays within its bound; extra columns, of any name, are carried along by ``keep`` or ignored.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .chunks import PATTERN, PartTable, part_starts, text_starts
from .common import map_rows, remembered


def load_ranks(path: str) -> dict[bytes, int]:
    """A public rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class MergeTransducer:
    """Encodes one pre-token at a time, byte by byte."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no rank")
        self.ranks, self.max_states = ranks, max_states
        self.prefixes = {token[:n] for token in ranks for n in range(1, len(token))}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[bytes, int] = {b"": 0}
        self.residue: list[bytes] = [b""]
        self.last: list[tuple[int, ...]] = [(0,)]  # last[i]: length of the last token of residue[:i]
        self.moves: list[dict[int, tuple[tuple[int, ...], int]]] = [{}]
        self.ends: list[tuple[int, ...] | None] = [()]

    def last_token(self, data: bytes) -> int:
        """The length of the last token of ``data``: pair merging, lowest rank first, leftmost on ties."""
        ranks = self.ranks
        cuts = list(range(len(data) + 1))
        none = len(ranks) + (1 << 31)
        costs = [ranks.get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == none:
                break
            i = costs.index(best)
            del cuts[i + 1], costs[i]
            if i < len(costs):
                costs[i] = ranks.get(data[cuts[i] : cuts[i + 2]], none)
            if i > 0:
                costs[i - 1] = ranks.get(data[cuts[i - 1] : cuts[i + 1]], none)
        return cuts[-1] - cuts[-2]

    def _tokens(self, data: bytes, last: tuple[int, ...], end: int) -> list[int]:
        out = []
        while end:
            start = end - last[end]
            out.append(self.ranks[data[start:end]])
            end = start
        return out[::-1]

    def _grow(self, state: int, byte: int) -> tuple[tuple[int, ...], int]:
        data = self.residue[state] + bytes([byte])
        size = len(data)
        last = (*self.last[state], self.last_token(data))
        shared: set[int] | None = None
        for j in range(size, -1, -1):
            if j == size or data[j:] in self.prefixes:
                cuts, at = {j}, j
                while at:
                    at -= last[at]
                    cuts.add(at)
                shared = cuts if shared is None else shared & cuts
        cut = max(shared) if shared else 0
        emitted = tuple(self._tokens(data, last, cut))
        rest, kept = data[cut:], (0, *last[cut + 1 :])
        target = self.ids.get(rest)
        if target is None and len(self.residue) >= self.max_states:
            self._reset()  # within a piece as well: the state that is reached is all that the rest of it needs
            target, state = self.ids.get(rest), None
        if target is None:
            target = self.ids[rest] = len(self.residue)
            self.residue.append(rest)
            self.last.append(kept)
            self.moves.append({})
            self.ends.append(None)
        if state is not None:
            self.moves[state][byte] = (emitted, target)
        return emitted, target

    def encode(self, piece: bytes) -> list[int]:
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves[state].get(byte)
            if move is None:
                move = self._grow(state, byte)
                moves = self.moves
            emitted, state = move
            if emitted:
                out += emitted
        end = self.ends[state]
        if end is None:
            data = self.residue[state]
            end = self.ends[state] = tuple(self._tokens(data, self.last[state], len(data)))
        out += end
        return out


def _follow(byte: int) -> tuple[int, int, int] | None:
    """After a lead byte: (continuation bytes, least and greatest next byte); None if it can't lead."""
    if byte < 0x80:
        return 0, 0, 0
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


class Utf8Machine:
    """State: (continuation bytes left, least next, greatest next, bytes pending).  ``START`` is between characters."""

    START = (0, 0, 0, 0)

    @classmethod
    def step(cls, state: tuple[int, int, int, int], byte: int) -> tuple[int, int, int, int]:
        left, low, high, pending = state
        if left and low <= byte <= high:
            return cls.START if left == 1 else (left - 1, 0x80, 0xBF, pending + 1)
        follow = _follow(byte)  # an unfinished character before it is broken off
        return cls.START if not follow or not follow[0] else (*follow, 1)


class StreamingDecoder:
    """Feed ids in any portions; whole characters come out as soon as they are complete.

    Between characters, tokens that end there again change nothing, so only the others are stepped through.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.states: list[tuple[int, int, int, int]] = [Utf8Machine.START]
        self.number = {Utf8Machine.START: 0}
        self.moves: list[dict[int, int]] = [{}]
        self.kinds = np.zeros(max(tokens, default=0) + 1, np.int8)  # between characters: 1 stays there, 2 does not, 0 not yet known
        self.reset()

    def reset(self) -> None:
        self.state, self.rest = 0, b""

    def _grow(self, state: int, token: int) -> int:
        now = self.states[state]
        for byte in self.tokens[token]:
            now = Utf8Machine.step(now, byte)
        target = self.number.get(now)
        if target is None:
            target = self.number[now] = len(self.states)
            self.states.append(now)
            self.moves.append({})
        self.moves[state][token] = target
        return target

    def _leaving(self, ids: np.ndarray) -> list[int]:
        """The places of the tokens that, begun between characters, end within one."""
        kinds = self.kinds[ids]
        if not kinds.all():
            for token in set(ids[kinds == 0].tolist()):
                self.kinds[token] = 1 if self._grow(0, token) == 0 else 2
            kinds = self.kinds[ids]
        return np.flatnonzero(kinds == 2).tolist()

    def feed(self, ids: Iterable[int]) -> bytes:
        """The bytes of all characters completed by these ids."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        data = self.rest + b"".join(map(self.tokens.__getitem__, ids))  # unknown ids raise
        state, moves, at = self.state, self.moves, 0
        for place in [0, *self._leaving(np.array(ids, np.int64))]:
            at = max(at, place)
            while at < len(ids) and (state or at == place):
                target = moves[state].get(ids[at])
                state = target if target is not None else self._grow(state, ids[at])
                at += 1
        self.state = state
        pending = self.states[state][3]
        self.rest = data[len(data) - pending :] if pending else b""
        return data[: len(data) - pending] if pending else data

    def finish(self) -> bytes:
        rest, _ = self.rest, self.reset()
        return rest


class ByteBpe:
    """Pattern split, transducer, decoder; one instance per Python worker."""

    PORTION = 8192
    #: Bytes of text that are encoded together: less than for the store, as the pipeline's executors have less to spare.
    TEXT_PORTION = 1 << 20
    #: Bound of the remembered parts; each takes some 200 bytes.
    MOST_PARTS = 500_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces = regex.compile(pattern).findall
        self.public = pattern == PATTERN
        self.transducer = MergeTransducer(ranks)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.names = np.array([b"%d," % i for i in range(max(self.tokens) + 1)])  # filled with zero bytes
        self.table = PartTable(self._encode_parts, self.MOST_PARTS, part_starts if self.public else text_starts, self.TEXT_PORTION)

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of each part as 32-bit numbers.  In the public pattern letters, with a blank before them or none, are one match."""
        encode, out = self.transducer.encode, []
        for part in parts:
            text = part.decode("utf-8")
            if self.public and (text[1:] if text[:1] == " " else text).isalpha():
                ids = encode(part)
            else:
                ids = [i for piece in self.pieces(text) for i in encode(piece.encode("utf-8"))]
            out.append(array("I", ids).tobytes())
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) end to end, and where each text's ids end."""
        return self.table.encode(texts)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids as decimals, comma-joined."""
        held = self.names[ids].view(np.uint8)
        return held[held != 0][:-1].tobytes()

    def decode(self, ids: list[int] | np.ndarray) -> Iterator[bytes]:
        decoder = getattr(self, "decoder", None) or StreamingDecoder(self.tokens)
        self.decoder = decoder
        decoder.reset()
        for at in range(0, len(ids), self.PORTION):
            yield decoder.feed(ids[at : at + self.PORTION])
        yield decoder.finish()


_of_this_worker: dict[tuple[str, str], ByteBpe] = remembered("bpe")


def worker_bpe(path: str, pattern: str) -> ByteBpe:
    """The transducer and its learned states outlive a task: Python workers are reused."""
    if (path, pattern) not in _of_this_worker:
        _of_this_worker.clear()
        _of_this_worker[path, pattern] = ByteBpe(load_ranks(path), pattern)
    return _of_this_worker[path, pattern]


def share_file(df: DataFrame, path: str) -> str:
    """Send a vocabulary file to every executor; returns its name for ``SparkFiles.get``."""
    df.sparkSession.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str, outputs: list[str], key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per document with the columns ``keep`` (default: the key) and the wanted ``outputs``:

    ``ids`` array<int>, ``n_tokens``, ``ids_sha256`` of the comma-joined decimal ids, ``decoded`` (the decoded bytes),
    ``decoded_sha256``.  Encoding and decoding are one pass over the texts; the decoder sees nothing but ids.
    """
    kinds = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}
    unknown = set(outputs) - set(kinds)
    if unknown:
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    keep = keep or [key]
    name = share_file(docs, ranks_path)
    fields = list(docs.select(*keep).schema)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + ", ".join(f"{o} {kinds[o]}" for o in outputs)
    decodes = any(o.startswith("decoded") for o in outputs)

    def run(batches):
        bpe = worker_bpe(SparkFiles.get(name), pattern)
        for batch in batches:
            every, ends = bpe.encode_batch(batch.column("text"))
            bounds = np.concatenate([[0], ends]).astype(np.int32)
            found: dict[str, object] = {o: [] for o in outputs}
            if "ids" in found:
                found["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(every.astype(np.int32)))
            if "n_tokens" in found:
                found["n_tokens"] = np.diff(bounds)
            if "ids_sha256" in found:
                found["ids_sha256"] = [hashlib.sha256(bpe.decimals(every[a:b])).hexdigest() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            if decodes:
                for start, end in zip(bounds.tolist(), bounds[1:].tolist()):
                    digest, whole = hashlib.sha256(), []
                    for data in bpe.decode(every[start:end]):
                        digest.update(data)
                        if "decoded" in found:
                            whole.append(data)
                    if "decoded_sha256" in found:
                        found["decoded_sha256"].append(digest.hexdigest())
                    if "decoded" in found:
                        found["decoded"].append(b"".join(whole))
            types = {"n_tokens": pa.int64(), "decoded": pa.binary()}
            columns = [found[o] if o == "ids" else pa.array(found[o], types.get(o, pa.string())) for o in outputs]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, [*keep, *outputs])

    return map_rows(docs.select(*keep, *([] if "text" in keep else ["text"])), run, schema, "bpe")
