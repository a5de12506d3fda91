"""SentencePiece encoding that keeps offsets, and decoding.

Normalisation is our own: the model's compiled character map (a double-array trie over UTF-8 with the replacements
behind it) is matched longest prefix first, and every normalised byte keeps the place of the source bytes it came from.
The library's pieces lie end to end on the normalised bytes, so each is projected to a span of original bytes; the
decoded text is put together from the same pieces.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from conjunct.llm.shared import boxed, unboxed, whole_text_batches
from conjunct.llm.units import cache, opened, slices

SPACE = "▁"
INTS = ArrayType(IntegerType())
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


class CharacterMap:
    """The precompiled map of a SentencePiece model: u32 size of the trie, the trie's u32 units, replacements ended by NUL."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.replacements = blob[4 + size :] if size else b""

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map that starts at data[at], and what replaces it."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units) or self.units[node] & 0x800000FF != data[i]:
                break
            leaf = self.units[node] >> 8 & 1
            node ^= self._offset(self.units[node])
            if leaf:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Pieces:
    """A model with its normaliser."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        self.sp = opened("sentencepiece", path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        self.map = CharacterMap(n.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.own = sorted((p.piece.encode() for p in model.pieces if p.type == p.USER_DEFINED), key=len, reverse=True)
        self.surface = [self._surface(p) for p in model.pieces]
        #: Units can be cut before a blank that follows another character if no piece reaches over that place.
        self.cuttable = self.dummy and self.escape and not (self.squeeze or self.suffix or self.own or self.map.units) and not any(re.search(f"[^{SPACE}]{SPACE}", p.piece) for p in model.pieces)
        #: Nothing is replaced but blanks: see _simply().
        self.simple = not (self.squeeze or self.own or self.map.units or (self.dummy and self.suffix))
        self.lengths = np.array([-1 if x is None else len(x) for x in self.surface], np.int64)
        self.decimal = [b" %d" % i for i in range(len(self.surface))]
        self.end = self.sp.eos_id()

    @staticmethod
    def _surface(p) -> bytes | None:
        if p.type == p.BYTE:
            return bytes([int(_BYTE.match(p.piece)[1], 16)])
        return None if p.type == p.UNKNOWN else b"" if p.type == p.CONTROL else p.piece.encode()

    def normalize(self, text: str, first: bool = True) -> tuple[bytes, list[int]]:
        """Normalised bytes, and for each the offset of its source byte, then the length of the source.

        first: whether the text's start is that of a whole text, which may get a blank before it.
        """
        if self.simple:
            normal, source = self._simply(text, first)
            return normal, source.tolist()
        data, space = text.encode(), SPACE.encode() if self.escape else b" "
        out, source = bytearray(), []

        def put(piece: bytes, at: int) -> None:
            out.extend(piece)
            source.extend([at] * len(piece))

        at = 0
        steps = []
        while at < len(data):
            if own := next((u for u in self.own if data.startswith(u, at)), None):
                size, new = len(own), own
            elif hit := self.map.longest(data, at):
                size, new = hit
            else:
                size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                new = data[at : at + size]
            steps.append((at, new))
            at += size
        if self.squeeze:
            while steps and not steps[0][1].strip(b" "):
                steps.pop(0)
        if not steps:
            return b"", [len(data)]
        if first and self.dummy and not self.suffix:
            put(space, steps[0][0])
        blank = self.squeeze
        for at, new in steps:
            if blank:
                new = new.lstrip(b" ")
            put(new.replace(b" ", space), at)
            if new:
                blank = self.squeeze and new.endswith(b" ")
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        if self.dummy and self.suffix:
            put(space, len(data))
        return bytes(out), [*source, len(data)]

    def _simply(self, text: str, first: bool) -> tuple[bytes, np.ndarray]:
        """normalize() of a model that maps no characters and drops no blanks: every character is its own longest prefix,
        so the whole text is aligned at once."""
        raw = text.encode()
        if not raw:
            return b"", np.zeros(1, np.int64)
        data, space = np.frombuffer(raw, np.uint8), SPACE.encode() if self.escape else b" "
        places = np.arange(len(data))
        character = np.maximum.accumulate(np.where(data & 0xC0 != 0x80, places, 0))  # where each byte's character begins
        source = np.repeat(character, np.where(data == 0x20, len(space), 1))
        lead = len(space) if first and self.dummy else 0
        return space * bool(lead) + raw.replace(b" ", space), np.concatenate([np.zeros(lead, np.int64), source, [len(data)]])

    def _projected(self, text: str, ids: list[int], first: bool) -> tuple[list[tuple[int, int]], bytes]:
        """Byte span in the source of each piece of its normalised form, by the alignment of normalize(); the normalised bytes."""
        normal, source = self.normalize(text, first)
        out, at = [], 0
        surfaces = [self.surface[i] for i in ids]
        if None in surfaces:  # unknown characters stand for themselves
            surfaces = [p.encode() for p in self.sp.encode(text if first else text[1:], out_type=str)]
        for surface in surfaces:
            if normal[at : at + len(surface)] != surface:
                raise ValueError(f"piece {surface!r} is not at byte {at} of the normalised text")
            out.append((source[at], source[at + len(surface)]))
            at += len(surface)
        if at != len(normal):
            raise ValueError(f"pieces end at byte {at} of {len(normal)}")
        return out, normal

    def encode(self, text: str) -> list[tuple[int, int, int]]:
        """(id, from, to) for each piece; from and to are byte offsets in the original text."""
        ids = self.sp.encode(text)
        return [(i, a, b) for i, (a, b) in zip(ids, self._projected(text, ids, True)[0], strict=True)]

    def units(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """For each unit, with the blank before it: its ids in decimal, each after a blank; its bytes decoded; its pieces'
        spans (32-bit from, to) counted from that blank."""
        found = self.sp.encode(texts, num_threads=1)
        lengths = self.lengths[np.fromiter(chain.from_iterable(found), np.int64)]
        if not (self.simple and self.escape) or (lengths < 0).any() or any(not t or " " in t or SPACE in t for t in texts):
            return [self._unit(t, ids) for t, ids in zip(texts, found, strict=True)]
        # all units at once, as one text: each with its blank, each piece projected from where it lies on the whole
        whole = " " + " ".join(texts)
        normal, source = self._simply(whole, False)
        if b"".join([self.surface[i] for i in chain.from_iterable(found)]) != normal:
            raise ValueError("pieces are not the normalised units")
        ends = np.cumsum(lengths)
        counts = np.array([len(ids) for ids in found])
        sizes = np.array([len(t.encode()) + 1 for t in texts])
        base = np.cumsum(sizes) - sizes  # of each unit's blank
        last = np.cumsum(counts)
        if not np.array_equal(source[ends[last - 1]], base + sizes):
            raise ValueError("a piece reaches over a unit's end")
        spans = np.stack([source[ends - lengths], source[ends]], 1) - np.repeat(base, counts)[:, None]
        spans, decoded = spans.astype("<i4").tobytes(), whole.encode()
        cuts, decimal = (8 * last).tolist(), self.decimal
        return [
            (b"".join([decimal[i] for i in ids]), decoded[a : a + n], spans[i:j])
            for ids, a, n, i, j in zip(found, base.tolist(), sizes.tolist(), [0, *cuts], cuts)
        ]

    def _unit(self, text: str, ids: list[int]) -> tuple[bytes, bytes, bytes]:
        """units() of one."""
        spans, normal = self._projected(" " + text, ids, False)
        return b"".join([self.decimal[i] for i in ids]), normal.replace(SPACE.encode(), b" "), np.asarray(spans, "<i4").tobytes()

    def digest(self, text: str) -> tuple[int, str, str, int, int]:
        """Ids with an end id, decoded text and spans of one whole text, without units."""
        pieces = self.encode(text)
        ids = [i for i, _, _ in pieces]
        decoded = self.sp.decode([*ids, self.end])
        spans = np.asarray([p[1:] for p in pieces], "<i4").reshape(-1, 2)
        return len(ids) + 1, hashlib.sha256(" ".join(map(str, [*ids, self.end])).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *_told(spans)


def _told(spans: np.ndarray) -> tuple[int, int]:
    """Source bytes that pieces span, and crc32 of the spans as 32-bit little-endian numbers."""
    return int((spans[:, 1] - spans[:, 0]).sum(dtype=np.int64)), zlib.crc32(np.ascontiguousarray(spans, "<i4").tobytes())


_MODELS: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces(path)
    return _MODELS[path]


def digests(texts: list[str | None], path: str) -> list[tuple[int, str, str, int, int]]:
    """digest() of each text, by units where the model allows it."""
    m, out = model(path), []
    known = cache(("pieces", path), m.units)
    end = b" %d" % m.end
    for i, j in slices(texts):
        cut = []
        for x in texts[i:j]:
            x = x or ""
            plain = m.cuttable and x and "  " not in x and SPACE not in x and x[0] != " " and x[-1] != " "
            cut.append(x.split(" ") if plain else None)
        known.learn({u for c in cut if c for u in c})
        for x, c in zip(texts[i:j], cut, strict=True):
            if c is None:
                out.append(m.digest(x or ""))
                continue
            got = list(map(known.__getitem__, c))
            ids = b"".join([g[0] for g in got]) + end
            decoded = b"".join([g[1] for g in got])[1:]
            # a unit's spans move by the place of its blank; the first unit has none, so its first piece starts at 0
            spans = np.frombuffer(b"".join([g[2] for g in got]), "<i4").reshape(-1, 2)
            blank = np.cumsum([0, *[len(g[1]) for g in got[:-1]]]) - 1
            spans = np.maximum(spans + np.repeat(blank, [len(g[2]) >> 3 for g in got])[:, None], 0)
            out.append((ids.count(b" "), hashlib.sha256(ids[1:]).hexdigest(), hashlib.sha256(decoded).hexdigest(), *_told(spans)))
    return out


def encode_texts(df: DataFrame, text: str, path: str) -> DataFrame:
    """df with ids array<int>, starts and ends array<int> (byte offsets of each piece in the original text) and decoded string.

    No begin or end id. Null and empty texts have empty arrays; texts of any length are encoded whole; repeated rows are
    encoded each; an empty table gives no rows. Columns of df may have any names, those of the new names are replaced.
    """

    def rows(texts):
        m = model(path)
        found = [m.encode(x or "") for x in texts]
        return [*([[p[k] for p in r] for r in found] for k in range(3)), [m.sp.decode([p[0] for p in r]) for r in found]]

    ints = pa.list_(pa.int32())
    return _with(df, text, rows, {"ids": (INTS, ints), "starts": (INTS, ints), "ends": (INTS, ints), "decoded": ("string", pa.string())})


def encode_digests(df: DataFrame, text: str, path: str) -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of its texts with an end id, spanned_bytes (source bytes that pieces
    span) and spans_crc32 (of each piece's from and to, little-endian 32-bit).

    Null and empty texts have the end id alone; texts of any length are encoded whole; repeated rows are encoded each; an
    empty table gives no rows. Columns of df may have any names, those of the new names are replaced.
    """
    rows = lambda texts: [list(c) for c in zip(*digests(texts, path))]
    longs, strings = ("long", pa.int64()), ("string", pa.string())
    return _with(df, text, rows, {"n_tokens": longs, "ids_sha256": strings, "decoded_sha256": strings, "spanned_bytes": longs, "spans_crc32": longs})


def _with(df: DataFrame, text: str, rows, new: dict[str, tuple]) -> DataFrame:
    """df with new columns (name -> types for Spark and Arrow), whose values rows(texts) gives column by column."""
    whole_text_batches(df.sparkSession)
    kept = boxed(df, None, text=F.col(f"`{text}`")).select("text", "row")
    schema = kept.drop("text").schema
    for name, (kind, _) in new.items():
        schema = schema.add(name, kind)

    def run(batches):
        for b in batches:
            found = rows(b.column(0).to_pylist()) if b.num_rows else [[]] * len(new)
            cols = [pa.array(c, t) for c, (_, t) in zip(found, new.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(1), *cols], ["row", *new])

    return kept.mapInArrow(run, schema).select(*unboxed(df.columns, tuple(new)), *new)
