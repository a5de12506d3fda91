"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt into chunks. A chunk's n-grams are exploded and summed inside the chunk, and go, as sorted runs of
64-bit hashes, to the partitions of the count tables, which are cut by hash. There the runs are joined with the totals;
the totals return to their chunk, where each document's n-grams are scored and summed. What crosses the network is one
number out and one back for each distinct n-gram of a chunk, however often it occurs.

Words and bigrams go in the first round, each longer order in a round of its own. An n-gram occurs no more often than
the two shorter ones inside it, so only those go whose both parts reach `least`; the others are sure to back off.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conjunct.llm.shared import utf8, whole_text_batches
from conjunct.llm.shingles import mix, words_at

BACKOFF, MIN_COUNT = 0.4, 2
#: The order of the registered query: contexts of up to two words.
ORDER = 3
#: Bytes of text of a chunk and of what a partition of the count tables serves.
CHUNK, PARTITION = 4_000_000, 24_000_000
#: Bytes of text that a task holds before it sends them.
HELD = 32_000_000
#: The key under which each chunk counts its words, so that its total is the corpus's.
ALL = np.uint64(0)


def _grams(data: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each word of the texts in order: its key, the key of it and its predecessor and so on up to `order` words (ALL
    where the text has fewer words before it), and its text."""
    words, at = words_at(b"\n".join(data))
    ends = np.cumsum([len(d) + 1 for d in data])
    doc = np.searchsorted(ends, at, side="right")
    before = np.arange(len(doc)) - np.searchsorted(doc, doc)
    grams = [mix(words + np.uint64(1))]
    for n in range(1, order):
        longer = np.zeros(len(words), np.uint64)
        longer[1:] = mix(grams[-1][:-1] * np.uint64(0x2545F4914F6CDD1D) + words[1:])
        longer[before < n] = ALL
        grams.append(longer)
    return grams, doc


def _keys(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of words and bigrams, ascending, with their counts; ALL counts the words."""
    keys, counts = np.unique(np.concatenate([g[g != ALL] if i else g for i, g in enumerate(grams[:2])]), return_counts=True)
    return np.concatenate([[ALL], keys]), np.concatenate([[len(grams[0])], counts])


def _hopeful(gram: np.ndarray, shorter: np.ndarray, least: int) -> np.ndarray:
    """Whether an n-gram can reach `least`: shorter has the totals of the (n-1)-grams that end at each word."""
    return (gram != ALL) & (shorter >= least) & (np.concatenate([[0], shorter[:-1]]) >= least)


def counted(grams: list[np.ndarray], rounds: list[np.ndarray], least: int) -> tuple[int, list[np.ndarray]]:
    """The corpus's words, and each word's total by order as far as the rounds go; 0 for n-grams that were not sent."""
    keys, _ = _keys(grams)
    found = [np.where(g != ALL, rounds[0][np.searchsorted(keys, g)], 0) if i else rounds[0][np.searchsorted(keys, g)] for i, g in enumerate(grams[:2])]
    for gram, totals in zip(grams[2:], rounds[1:]):
        sent = _hopeful(gram, found[-1], least)
        sums = np.zeros(len(gram), rounds[0].dtype)
        own, back = np.unique(gram[sent], return_inverse=True)
        sums[sent] = totals[: len(own)][back]
        found.append(sums)
    return int(rounds[0][0]), found


def _cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each partition's run of sorted keys begins and ends."""
    edges = np.array([(p << 64) // parts for p in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, all second bytes and so on. High bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _pack(batches):
    """(chunk, ids, sizes, packed): the texts of a task that go to one chunk, compressed together, for texts shuffle and
    compress the better the more there are."""
    codec = pa.Codec("zstd", 6)
    held: dict[int, tuple[list, list[bytes]]] = {}
    size = 0

    def rows():
        chunks = sorted(held)
        data = [b"".join(held[c][1]) for c in chunks]
        cols = [
            pa.array(chunks, pa.int32()),
            pa.array([held[c][0] for c in chunks], pa.list_(pa.int64())),
            pa.array([[len(x) for x in held[c][1]] for c in chunks], pa.list_(pa.int32())),
            pa.array([codec.compress(d, asbytes=True) if d else b"" for d in data], pa.binary()),
        ]
        held.clear()
        return pa.RecordBatch.from_arrays(cols, ["chunk", "ids", "sizes", "packed"])

    for b in batches:
        for doc, chunk, text in zip(b.column("doc_id").to_pylist(), b.column("chunk").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids, texts = held.setdefault(chunk, ([], []))
            ids.append(doc)
            texts.append(text.encode())
            size += len(texts[-1])
        if size > HELD:
            yield rows()
            size = 0
    yield rows()


def _texts(t: pa.Table) -> list[bytes]:
    codec, out = pa.Codec("zstd", 6), []
    for sizes, packed in zip(t.column("sizes").to_pylist(), t.column("packed").to_pylist(), strict=True):
        data, at = codec.decompress(packed, sum(sizes), asbytes=True) if packed else b"", 0
        for n in sizes:
            out.append(data[at : at + n])
            at += n
    return out


def scores(grams: list[np.ndarray], total: int, found: list[np.ndarray], backoff: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """log of the stupid-backoff score of each word, and whether it backed off."""
    logs = np.log(found[0] / total)
    backed = np.zeros(len(logs), np.int64)
    for n in range(1, len(grams)):
        inner = grams[n] != ALL
        seen = inner & (found[n] >= least)
        at = np.flatnonzero(seen)
        logs[at] = np.log(found[n][at] / found[n - 1][at - 1])
        backed = np.where(seen, 0, backed + inner)
    return logs + backed * np.log(backoff), backed > 0


def stupid_backoff(df: DataFrame, backoff: float = BACKOFF, least: int = MIN_COUNT, chunk: int = CHUNK, partition: int = PARTITION, order: int = 2) -> DataFrame:
    """(doc_id, n_words, log_score, per_word, n_backoff) for each row of df(doc_id, text).

    Model of n-grams up to `order` words over all rows (words as in the shingles: runs without ASCII white space, A-Z
    lower-cased): a word whose n-gram, of the longest order that its place in the text allows, occurs at least `least`
    times scores count(n-gram) / count(n-gram without the word), else backoff * its score by the next shorter order; a
    single word scores count(word) / words. log_score sums natural logarithms, per_word is their mean (null without
    words), n_backoff counts the words that backed off. Null and empty texts have 0 words and log_score 0. Repeated rows
    count and are scored each; null doc_ids are documents of their own. Texts of any length are scored whole. An empty table
    gives no rows; other columns of df, whatever their names, are ignored.
    """
    if order < 1:
        raise ValueError("order must be at least 1")
    whole_text_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    chunks, parts = max(64, -(-size // chunk)), max(64, -(-size // partition))
    place = F.xxhash64("doc_id", "text")  # rows that share an id or a text don't meet in one chunk for that
    docs = docs.select("doc_id", F.pmod(place, F.lit(chunks)).cast("int").alias("chunk"), "text").mapInArrow(_pack, "chunk int, ids array<bigint>, sizes array<int>, packed binary")

    def runs_of(keys: np.ndarray, counts: np.ndarray, chunk: int, level: int) -> pa.Table:
        """A row for each partition that some key goes to, so the rows grow with the input, however many partitions there are."""
        at = _cuts(keys, parts)
        runs = np.flatnonzero(np.diff(at)).tolist()
        return pa.table(
            {
                "level": pa.array([level] * len(runs), pa.int32()),
                "part": pa.array(runs, pa.int32()),
                "chunk": pa.array([chunk] * len(runs), pa.int32()),
                "keys": pa.array([planes(np.diff(keys[at[p] : at[p + 1]], prepend=np.uint64(0))) for p in runs], pa.binary()),
                "counts": pa.array([planes(counts[at[p] : at[p + 1]].astype("<u4")) for p in runs], pa.binary()),
            }
        )

    def returned(back: pa.Table, levels: int) -> list[np.ndarray]:
        """Totals of each round in the order of their keys."""
        rows = sorted(zip(back.column("level").to_pylist(), back.column("part").to_pylist(), back.column("totals").to_pylist()))
        return [np.concatenate([np.zeros(0, "<u8"), *[from_planes(t, "<u8") for at, _, t in rows if at == level]]) for level in range(levels)]

    def gather(t: pa.Table) -> pa.Table:
        grams, _ = _grams(_texts(t), min(order, 2))
        return runs_of(*_keys(grams), t.column("chunk")[0].as_py(), 0)

    def gather_longer(level: int):
        def gather(mine: pa.Table, back: pa.Table) -> pa.Table:
            grams, _ = _grams(_texts(mine), level + 2)
            _, found = counted(grams[:-1], returned(back, level), least)
            keys, counts = np.unique(grams[-1][_hopeful(grams[-1], found[-1], least)], return_counts=True)
            return runs_of(keys, counts, mine.column("chunk")[0].as_py(), level)

        return gather

    def total(t: pa.Table) -> pa.Table:
        runs = [np.cumsum(from_planes(x, "<u8"), dtype=np.uint64) for x in t.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(x, "<u4") for x in t.column("counts").to_pylist()])
        _, back = np.unique(np.concatenate(runs), return_inverse=True)
        sums = np.bincount(back, weights=counts).astype("<u8")[back] if len(back) else np.zeros(0, "<u8")
        ends = np.cumsum([len(r) for r in runs])
        found = [planes(sums[e - len(r) : e]) for e, r in zip(ends, runs)]
        return pa.table({"level": t.column("level"), "chunk": t.column("chunk"), "part": t.column("part"), "totals": pa.array(found, pa.binary())})

    def judge(mine: pa.Table, back: pa.Table) -> pa.Table:
        texts = _texts(mine)
        grams, doc = _grams(texts, order)
        logs, off = scores(grams, *counted(grams, returned(back, max(1, order - 1)), least), backoff, least)
        n = np.bincount(doc, minlength=len(texts))
        sums = np.bincount(doc, weights=logs, minlength=len(texts))
        return pa.table(
            {
                "doc_id": pa.array([i for ids in mine.column("ids").to_pylist() for i in ids], pa.int64()),
                "n_words": pa.array(n, pa.int64()),
                "log_score": pa.array(sums, pa.float64()),
                "per_word": pa.array([s / k if k else None for s, k in zip(sums.tolist(), n.tolist())], pa.float64()),
                "n_backoff": pa.array(np.bincount(doc, weights=off, minlength=len(texts)).astype(np.int64), pa.int64()),
            }
        )

    sent, added = "level int, part int, chunk int, keys binary, counts binary", "level int, chunk int, part int, totals binary"
    by_chunk = docs.groupBy("chunk")
    totals = by_chunk.applyInArrow(gather, sent).groupBy("part").applyInArrow(total, added)
    for level in range(1, order - 1):
        longer = by_chunk.cogroup(totals.groupBy("chunk")).applyInArrow(gather_longer(level), sent)
        totals = totals.unionByName(longer.groupBy("part").applyInArrow(total, added))
    return by_chunk.cogroup(totals.groupBy("chunk")).applyInArrow(judge, "doc_id long, n_words long, log_score double, per_word double, n_backoff long")
