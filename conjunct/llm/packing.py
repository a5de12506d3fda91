"""Sum-of-squares online packing of token ids into windows of fixed length.

Each task reads its documents in order. A document's full windows are cut off; the rest goes to the fill level that makes
the sum of squared counts of partially filled windows least, the counts being held in an array by level. Documents may
be cut, so windows that stay partly filled at a task's end are merged by cutting, and so are, across tasks, the single
windows that tasks leave. Padding is thus at most one window for each 256 tasks. A task that holds more open windows than
fit in memory fills its fullest ones with pieces of its emptiest until half are left; the others keep their levels, and
every document is placed by the sum of squares all along.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.llm.shared import materialize, whole_text_batches
from conjunct.llm.units import CACHE_ENTRIES, CACHED_LENGTH, cache, held, opened, slices, trim

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_length long, ids binary"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64()] * 8 + [pa.binary()]


def _word_ids(path: str):
    tok = opened("tokenizers", path)
    return lambda units: [np.asarray(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(units, add_special_tokens=False)]


#: A split where a run of letters is one word, whatever stands beside it, and a run of marks another.
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of plain texts, which composing leaves as they are and whose lower case is one character: Latin letters (IN_LOWER
#: with those that are their lower case), digits, and marks of ASCII, Latin-1 and general punctuation.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
IN_LOWER = LATIN + "\u0250-\u02af\u2c65\u2c66"
MARKS = "!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab\u00ac\u00ae-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2010-\u2027\u2030-\u205e\u20ac"
PLAIN = re.compile(f"[\t-\r 0-9{LATIN}{MARKS}]*+")
#: _LETTERS for plain texts in lower case.
PLAIN_WORD = re.compile(f"[{IN_LOWER}]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[{MARKS}]+")
#: Ids of words and of runs of marks, in lower case, by tokenizer; texts and units share them. About 85 MB at most.
_WORDS: dict[str, dict[str, bytes]] = {}
WORD_ENTRIES = 450_000
#: Units, and words with runs of marks, that a worker remembers before it starts afresh.
REMEMBERED = CACHE_ENTRIES, WORD_ENTRIES
held("units", _WORDS)
#: A unit of LATIN letters with marks after them or none.
_WORD = re.compile(f"([{LATIN}]+)([!-&(-/:-@\\[-`{{-~]*)")


def _ends(path: str) -> np.ndarray | None:
    """Which ids end a word, of a tokenizer that marks them and makes words of letters; None of any other."""
    told = json.loads(opened("tokenizers", path).to_str())
    model, pre = told["model"], told["pre_tokenizer"] or {}
    first, *others = pre.get("pretokenizers") or [{}]
    plain = first.get("type") == "Split" and first["pattern"] == {"Regex": _LETTERS} and first["invert"] and first["behavior"] == "Removed"
    plain = plain and [(o["type"], o.get("add_prefix_space"), o.get("use_regex")) for o in others] == [("ByteLevel", False, False)]
    steps = [(x["type"], x.get("pattern")) for x in (told["normalizer"] or {}).get("normalizers", [])]
    plain = plain and steps == [("NFC", None), ("Replace", {"Regex": r"\s+"}), ("Lowercase", None)]
    plain = plain and not any(t["normalized"] for t in told["added_tokens"])
    if not (plain and model.get("type") == "BPE" and (suffix := model.get("end_of_word_suffix")) and not model.get("dropout")):
        return None
    out = np.zeros(max(model["vocab"].values()) + 1, bool)
    out[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
    return out


def _row_ids(path: str, ends: np.ndarray):
    """_word_ids() for words in lower case, runs of marks among them, each of which the tokenizer leaves whole: encoded in one row,
    a blank between them, and the ids cut after each that ends a word; where these aren't as many as the words, each alone.
    A row goes to the tokenizer's model without the steps before it, which would change nothing but cut at the blanks."""
    from tokenizers import Tokenizer, pre_tokenizers

    alone, tok = _word_ids(path), Tokenizer(opened("tokenizers", path).model)
    tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def words(row: list[str]) -> list[bytes]:
        ids = np.asarray(tok.encode_batch_fast([" ".join(row)], add_special_tokens=False)[0].ids, "<u4")
        if len(ids) and ids.max() >= len(ends):
            return alone(row)
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) != len(row) or cuts[-1] != 4 * len(ids):
            return alone(row)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts)]

    return words


def _known(path: str, entries: int) -> dict[str, bytes]:
    known = _WORDS.setdefault(path, {})
    if len(known) > entries:
        known.clear()
    return known


def _unit_ids(path: str, at_once: int = 1000, entries: int = WORD_ENTRIES):
    """_word_ids() for units: words of letters, with marks at the end or none, are looked up without case and marks. Those
    not known are encoded in rows of `at_once`."""
    alone, ends = _word_ids(path), _ends(path)
    if ends is None:
        return alone
    words = _row_ids(path, ends)

    def encode(units: list[str]) -> list[bytes]:
        if len(units) < 2:
            return alone(units)
        cut = [m.groups() if (m := _WORD.fullmatch(u)) else None for u in units]
        known = _known(path, entries)
        wanted = [c[0].lower() if c else "" for c in cut]
        fresh = list({w for w in wanted if w and w not in known})
        for i in range(0, len(fresh), at_once):
            known.update(zip(fresh[i : i + at_once], words(fresh[i : i + at_once]), strict=True))
        marks = [m for m in {c[1] for c in cut if c} if m and m not in known]
        known.update(zip(marks, alone(marks), strict=True))
        others = iter(alone([u for u, c in zip(units, cut, strict=True) if not c]))
        return [next(others) if not c else known[w] + known[c[1]] if c[1] else known[w] for c, w in zip(cut, wanted, strict=True)]

    return encode


def _plain_ids(path: str, at_once: int = 1000, entries: int = WORD_ENTRIES):
    """Ids of whole plain texts in lower case, from the ids of their words; None where words can't be told by their ids."""
    if (ends := _ends(path)) is None:
        return None
    words = _row_ids(path, ends)

    def encode(texts: list[str]) -> list[bytes]:
        known = _known(path, entries)
        cut = [PLAIN_WORD.findall(x) for x in texts]
        got = [list(map(known.get, c)) for c in cut]
        gaps = [_gaps(x) for x in got]
        fresh = list({c[k] for c, gap in zip(cut, gaps, strict=True) for k in gap})
        short = [w for w in fresh if len(w) <= CACHED_LENGTH]
        for i in range(0, len(short), at_once):
            known.update(zip(short[i : i + at_once], words(short[i : i + at_once]), strict=True))
        long = {w: words([w])[0] for w in fresh if len(w) > CACHED_LENGTH}
        for c, x, gap in zip(cut, got, gaps, strict=True):
            for k in gap:
                x[k] = known[c[k]] if len(c[k]) <= CACHED_LENGTH else long[c[k]]
        return list(map(b"".join, got))

    return encode


@functools.cache
def _opened_ids(path: str, entries: int):
    return _unit_ids(path, entries=entries)


@functools.cache
def _opened_plain(path: str, entries: int):
    return _plain_ids(path, entries=entries)


@functools.cache
def _blank_ends_tokens(path: str) -> bool:
    """Whether white space is normalised to one blank and dropped, so that texts can be cut at blanks."""
    tok = opened("tokenizers", path)
    a, b = (tok.encode(x, add_special_tokens=False).ids for x in ("of  the\n\nend ", "of the end"))
    return a == b == sum((tok.encode(x, add_special_tokens=False).ids for x in ("of", "the", "end")), [])


def _gaps(found: list) -> list[int]:
    """Where a list has None."""
    out, k = [], -1
    try:
        while True:
            k = found.index(None, k + 1)
            out.append(k)
    except ValueError:
        return out


def token_ids(texts: list[str | None], path: str, remembered: tuple[int, int] = REMEMBERED) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers, without added special tokens."""
    if not _blank_ends_tokens(path):
        return _word_ids(path)([x or "" for x in texts])
    units, words = remembered
    known, plain, out = cache(("ids", path, remembered), _opened_ids(path, words), entries=units), _opened_plain(path, words), []
    added = [t.content for t in opened("tokenizers", path).get_added_tokens_decoder().values()]
    collecting = gc.isenabled()
    gc.disable()  # lists and caches of strings have no cycles, and looking for these takes as long as splitting the texts
    try:
        for i, j in slices(texts):
            whole = [bool(plain and x and PLAIN.fullmatch(x) and not any(t in x for t in added)) for x in texts[i:j]]
            of_plain = iter(plain([x.lower() for x, w in zip(texts[i:j], whole, strict=True) if w]) if plain else [])
            of_others = iter(_by_units([x for x, w in zip(texts[i:j], whole, strict=True) if not w], known))
            out.extend(next(of_plain if w else of_others) for w in whole)
    finally:
        if collecting:
            gc.enable()
    return out


def _by_units(texts: list[str | None], known) -> list[bytes]:
    cut = [x.replace("\n", " ").split(" ") if x else [] for x in texts]  # an empty unit has no ids
    got = [list(map(known.get, c)) for c in cut]
    gaps = [_gaps(x) for x in got]
    known.learn({c[k] for c, gap in zip(cut, gaps, strict=True) for k in gap})
    for c, x, gap in zip(cut, got, gaps, strict=True):
        for k in gap:
            x[k] = known[c[k]]
    return list(map(b"".join, got))


class Window:
    """Pieces (doc_id, start, ids, doc_tokens) laid end to end."""

    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill, self.pieces = 0, []

    def put(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total))
        self.fill += len(ids) // 4


class SumOfSquares:
    """The packer of one task. close(window, last) takes windows that are done."""

    def __init__(self, size: int, close, max_open: int = 16_384):
        self.size, self.close, self.max_open = size, close, max_open
        self.count = np.zeros(size + 1, np.int64)  # open windows by level; level 0 is a new window, level size a full one
        self.at: list[list[Window]] = [[] for _ in range(size + 1)]
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level whose choice makes the sum of squares least; the fullest of equal ones."""
        n = self.count
        grown = 2 * n[size:] + 1  # for target levels size..full
        grown[-1] = 0
        change = grown[: self.size - size + 1].copy()
        change[1:] += np.where(n[1 : self.size - size + 1] > 0, 1 - 2 * n[1 : self.size - size + 1], 1 << 60)
        return int(len(change) - 1 - np.argmin(change[::-1]))

    def add(self, doc, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.size:
            w = Window()
            w.put(doc, start, ids[4 * start : 4 * (start + self.size)], total)
            self.close(w, False)
            start += self.size
        if rest := total - start:
            level = self.level_for(rest)
            w = self.at[level].pop() if level else Window()
            self.count[level] -= bool(level)
            self.open -= bool(level)
            w.put(doc, start, ids[4 * start :], total)
            self._keep(w)
            if self.open > self.max_open:
                self.merge(self.max_open // 2)

    def _keep(self, w: Window) -> None:
        if w.fill == self.size:
            self.close(w, False)
        else:
            self.at[w.fill].append(w)
            self.count[w.fill] += 1
            self.open += 1

    def merge(self, leave: int) -> None:
        """Fill the fullest windows with pieces cut from the emptiest until at most `leave` are open."""
        left = deque(w for level in self.at for w in level)
        self.at, self.open = [[] for _ in range(self.size + 1)], 0
        self.count[:] = 0
        fill_up(left, self.size, lambda w: self.close(w, False), leave)
        for w in left:
            self._keep(w)

    def finish(self) -> None:
        self.merge(1)
        for level in self.at:
            for w in level:
                self.close(w, True)


def fill_up(windows: deque, size: int, close, leave: int = 1) -> None:
    """Close windows, the fullest first, with pieces cut from the emptiest (first in the deque), until at most `leave` are left."""
    while len(windows) > leave:
        w = windows.pop()
        while w.fill < size and windows:
            source = windows[0]
            doc, start, ids, total = source.pieces.pop()
            if (room := size - w.fill) < len(ids) // 4:
                source.pieces.append((doc, start, ids[: len(ids) - 4 * room], total))
                start, ids = start + len(ids) // 4 - room, ids[len(ids) - 4 * room :]
            source.fill -= len(ids) // 4
            w.put(doc, start, ids, total)
            if not source.pieces:
                windows.popleft()
        if w.fill < size:
            windows.append(w)
            return
        close(w)


def _rows(w: Window, sequence: int, size: int, tail: bool):
    at, padded = 0, w.fill if w.fill & (w.fill - 1) == 0 else size
    for doc, start, ids, total in w.pieces:
        yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, at, padded, ids if tail else None
        at += len(ids) // 4


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES)], _NAMES)


def pack(df: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, tails_at_once: int = 256, remembered: tuple[int, int] = REMEMBERED) -> DataFrame:
    """Pieces of df(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and padded_length.

    Null and empty texts are the end id alone; repeated rows and equal doc_ids are packed each by themselves; a null
    doc_id stays null; texts of any length are packed whole; other columns of df, whatever their names, are ignored; an
    empty table has no pieces. padded_length is size, or the
    sequence's own length where that is a power of two. What a task packs depends on its rows alone, so a task that runs
    again gives the same rows; tails go by the number of the task that left them. remembered bounds what a Python worker
    keeps of units and of words: fewer take less memory and more time, and change no id; a worker with fewer than REMEMBERED
    gives freed memory back before each batch, too.
    """
    spark = df.sparkSession
    whole_text_batches(spark)
    sparing = remembered < REMEMBERED

    def run(batches):
        task, done, rows = TaskContext.get().partitionId(), 0, []

        def close(w: Window, tail: bool) -> None:
            nonlocal done
            rows.extend(_rows(w, (task << 32) + done, size, tail))
            done += 1

        packer = SumOfSquares(size, close)
        end = np.asarray([end_id], "<u4").tobytes()
        for b in batches:
            if sparing:
                trim()
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in slices(texts):
                for doc, ids in zip(docs[i:j], token_ids(texts[i:j], tokenizer, remembered), strict=True):
                    packer.add(doc, ids + end)
                yield _batch(rows)
                rows.clear()
        packer.finish()
        yield _batch(rows)

    first = materialize(df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA), "packing")
    tails = first.filter(F.col("ids").isNotNull())
    tasks = tails.select("sequence_id").distinct().count()
    groups = -(-tasks // tails_at_once) or 1

    def again(key, frame):
        rows: list[tuple] = []
        windows: dict[int, Window] = {}
        for r in frame.sort_values(["sequence_id", "offset"]).itertuples():
            windows.setdefault(r.sequence_id, Window()).put(None if r.doc_id != r.doc_id or r.doc_id is None else int(r.doc_id), r.start, r.ids, r.doc_tokens)
        left = deque(sorted(windows.values(), key=lambda w: w.fill))
        base, done = (1 << 62) + (int(key[0]) << 32), 0

        def close(w: Window) -> None:
            nonlocal done
            rows.extend(_rows(w, base + done, size, False))
            done += 1

        fill_up(left, size, close)
        for w in left:
            close(w)
        import pandas as pd

        out = pd.DataFrame(rows, columns=_NAMES)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    merged = tails.withColumn("_group", F.pmod(F.shiftright("sequence_id", 32), F.lit(groups))).groupBy("_group").applyInPandas(again, SCHEMA)
    return first.filter(F.col("ids").isNull()).unionByName(merged).drop("ids")
