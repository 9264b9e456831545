"""SentencePiece encoding and decoding with source offsets.

Normalisation is done here: at each place the longest prefix that the model's compiled character map (a double
array trie) knows is replaced, and every normalised character keeps the byte place it came from. The library
then only merges pieces over normalised text, and each piece is projected back to a span of original bytes.

Where no piece of the vocabulary has a line feed, or a word mark after another character, and no character is unknown, merges
never cross a line end or pass from a word into the mark of the next one, so a long text is merged in parts that end there and
memory follows the part. Otherwise a text is merged as a whole. Decoding is the library's rule: marks become spaces, runs of
byte pieces become UTF-8, the dummy prefix and control pieces vanish; all pieces of a text are put together at once.

Spans: a piece begins and ends where its first normalised byte and the one after its last came from; the pieces of one
replaced character share its place, so all but the last are empty; a byte piece has its own byte.

Defined results: a null text is empty, and an empty text has the end id only and decodes to an empty text; white
space, marks and control characters of a text pass as the model says; whole texts of any length; repeated rows
each get the same row; an empty table gives an empty table; only the columns named in ``keep`` are carried.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL_BYTES = 64 << 20  # a larger model file is refused, since it is broadcast
PART = 1 << 14  # characters of a long text that are merged at once, up to the next boundary
_BOUNDARY = re.compile(f"(?<=[^{MARK}\n])[{MARK}\n]")


class CharMap:
    """Longest-prefix replacement by a compiled character map: length of the trie, its units, then the replacements."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes matched, replacement) of the longest known prefix of ``text[at:]``."""
        if not self.units:
            return None
        units, best = self.units, None
        node = self._offset(units[0])
        for p in range(at, len(text)):
            c = text[p]
            if c == 0:
                break
            node ^= c
            if node >= len(units) or (units[node] & ((1 << 31) | 0xFF)) != c:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if (unit >> 8) & 1:
                start = units[node] & 0x7FFFFFFF
                best = (p + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return best


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.trims, self.escapes = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models with the word mark as a suffix are not supported")
        kinds = [p.type for p in proto.pieces]
        self.whole = any(MARK in p.piece.lstrip(MARK) or "\n" in p.piece for p in proto.pieces) or 4 in kinds or proto.trainer_spec.model_type != 2 or not self.escapes or not proto.trainer_spec.byte_fallback
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.merger = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.eos, self.unk = self.merger.eos_id(), self.merger.unk_id()
        self.bytes_of = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.surface = {i: "" if p.type == 3 else (proto.trainer_spec.unk_surface if p.type == 2 else p.piece.replace(MARK, " ")) for i, p in enumerate(proto.pieces) if p.type != 6}
        self.pieces = [p.piece for p in proto.pieces]
        self.names = list(map(str, range(len(self.pieces))))
        self.sizes = np.array([1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces])
        said = [bytes([self.bytes_of[i]]) if i in self.bytes_of else self.surface[i].encode() for i in range(len(self.pieces))]
        self.said, self.said_sizes = np.frombuffer(b"".join(said), np.uint8), np.array([len(x) for x in said])
        self.said_at = np.cumsum(self.said_sizes) - self.said_sizes

    @property
    def plain(self) -> bool:
        """True if normalising only marks spaces and adds the dummy prefix."""
        return not self.map.units and not self.trims and self.escapes

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its bytes and its end, the byte of the source it came from."""
        source = text.encode()
        if self.plain:  # every byte stays, but a space becomes a mark of three bytes
            if not source:
                return "", np.zeros(1, np.int64)
            size = np.where(np.frombuffer(source, np.uint8) == 0x20, np.uint8(len(MARK.encode())), np.uint8(1))
            align = np.repeat(np.arange(len(source)), size)
            before = len(MARK.encode()) if self.prefix else 0
            return MARK * self.prefix + text.replace(" ", MARK), np.concatenate((np.zeros(before, np.int64), align, [len(source)]))
        mark = MARK.encode() if self.escapes else b" "
        at = 0

        def longest() -> tuple[int, bytes]:
            found = self.map.longest(source, at)
            if found is None:
                size = 1 if source[at] < 0x80 else 2 if source[at] < 0xE0 else 3 if source[at] < 0xF0 else 4
                return size, source[at : at + size]
            return found

        while self.trims and at < len(source) and (found := longest())[1] == b" ":
            at += found[0]
        pending: list[tuple[bytes, int]] = [(mark, at)] if self.prefix and at < len(source) else []
        blank = self.trims  # at the start, or a space just before
        while at < len(source):
            size, new = longest()
            if blank:
                new = new.lstrip(b" ")
            pending += [(mark if c == " " else c.encode(), at) for c in new.decode()]
            blank = self.trims and (new.endswith(b" ") if new else blank)
            at += size
        end = len(source)
        while self.trims and pending and pending[-1][0] == mark:
            end = pending.pop()[1]
        align: list[int] = []
        for piece, where in pending:
            own = source[where : where + len(piece)] == piece  # bytes that stay as they are keep their own places
            align += range(where, where + len(piece)) if own else [where] * len(piece)
        return b"".join([piece for piece, _ in pending]).decode(), np.array([*align, end])

    def _spelled(self, ids: np.ndarray) -> str:
        """What pieces say one after the other."""
        size = self.said_sizes[ids]
        at = np.repeat(self.said_at[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        some = self.said[at].tobytes()
        try:
            return some.decode()
        except UnicodeDecodeError:  # runs of byte pieces that are no UTF-8
            is_byte = np.isin(ids, list(self.bytes_of))
            cut = np.flatnonzero(np.diff(is_byte)) + 1
            return "".join([self._from_bytes(bytes(self.bytes_of[i] for i in part.tolist())) if part[0] in self.bytes_of else self._spelled(part) for part in np.split(ids, cut)])

    @staticmethod
    def _from_bytes(some: bytes) -> str:
        """UTF-8; each byte that is no part of a valid character becomes U+FFFD."""
        out, at = [], 0
        while at < len(some):
            for size in (1, 2, 3, 4):
                try:
                    out.append(some[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def _lead(self, ids: Iterable[int]) -> int:
        """Spaces at the start of the decoded text that stand for the dummy prefix or for trimmed white space."""
        n = 0
        for i in ids if self.prefix or self.trims else ():
            if i in self.bytes_of or i == self.unk:
                break
            if not self.surface[i]:
                continue  # a control piece
            n += self.pieces[i].startswith(MARK)
            if not self.trims or self.pieces[i] != MARK:
                break
        return n

    def decode(self, ids: list[int]) -> str:
        """Text of ids as the library decodes them."""
        return self._spelled(np.array(ids, np.int64))[self._lead(ids) :]

    def _merge(self, normal: str) -> list[int]:
        """Ids of a normalised text."""
        if self.whole or len(normal) <= PART:
            return self.merger.encode(normal) if normal else []
        ids, at = [], 0
        while at < len(normal):
            cut = _BOUNDARY.search(normal, at + PART)
            to = cut.start() if cut else len(normal)
            ids += self.merger.encode(normal[at:to])
            at = to
        return ids

    def _encoded(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids, and the span [begin, end) of source bytes of every piece, the end id's included."""
        normal, align = self.normalise(text)
        ids = self._merge(normal)
        if not self.bytes_of and self.unk in ids:  # a row of unknown characters is one piece
            sizes = np.array([len(p.surface.encode()) for p in self.merger.encode(normal, return_type="proto").pieces])
        else:
            sizes = self.sizes[np.array(ids, np.int64)]
        to = np.cumsum(sizes)
        if len(align) - 1 != (to[-1] if len(to) else 0):
            raise ValueError("the pieces do not cover the normalised text")
        ends = np.append(align[to], len(text.encode()))
        begins = np.concatenate((align[:1], ends[:-1])) if len(to) else ends.copy()
        begins[-1] = ends[-1]
        return [*ids, self.eos], begins, ends

    def digest(self, text: str) -> tuple[int, str, str, str]:
        """(number of ids with the end id, SHA-256 of the ids, of the decoded text, and of the spans as pairs of 32-bit numbers)."""
        ids, begins, ends = self._encoded(text)
        sha = hashlib.sha256
        spans = np.empty((len(ends), 2), "<u4")
        spans[:, 0], spans[:, 1] = begins, ends
        return len(ids), sha(" ".join([self.names[i] for i in ids]).encode()).hexdigest(), sha(self.decode(ids).encode()).hexdigest(), sha(spans).hexdigest()

    def encode(self, text: str) -> tuple[list[int], list[int], list[int], list[str]]:
        """Ids with the end id, byte spans [begin, end) of the source for each, and the pieces."""
        ids, begins, ends = self._encoded(text)
        return ids, begins.tolist(), ends.tolist(), [self.pieces[i] for i in ids]


def read_model(path: str) -> bytes:
    if (size := Path(path).stat().st_size) > MODEL_BYTES:
        raise ValueError(f"{path}: {size} bytes are more than the {MODEL_BYTES} that may be broadcast")
    return Path(path).read_bytes()


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model)
    return _codecs[key]


def _apply(df: DataFrame, model_path: str, text_col: str, keep: tuple[str, ...], fields: str, make) -> DataFrame:
    held = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    types = [kinds[x.split()[1]] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            rows = [make(codec, t or "") for t in batch.column(batch.num_columns - 1).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*keep, *names])

    return df.select(*keep, F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"{schema}, {fields}" if schema else fields)


def encode(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, ids, begins, ends, pieces): ids with the end id and the original byte span of every piece."""
    return _apply(df, model_path, text_col, keep, "ids array<int>, begins array<int>, ends array<int>, pieces array<string>", Codec.encode)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, text): ids back to text; null ids are empty."""
    held = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(held.value)
        for batch in batches:
            texts = [codec.decode(ids or []) for ids in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "text"])

    return df.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, f"{schema}text string")


def digests(df: DataFrame, model_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_tokens, ids_sha256, decoded_sha256, spans_sha256): encode with spans and decode in one pass, keeping digests only."""
    return _apply(df, model_path, text_col, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string", Codec.digest)
