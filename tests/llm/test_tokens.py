"""Token counts, SentencePiece and packing against the libraries themselves."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conjunct.llm import packing, pieces, token_counts

ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "a   b", "x \n y", "x\n \n y", "<|endoftext|>", "a <|endoftext|> b", "é́ x", "▁a", "a▁ b", "\0", "日本 語", "😀 x", "</s> <0x41>", "Don't we've 12 3.5", "aaa " * 3000, "same", "same"]


def noisy(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(" ab▁\n\té日😀<s>'t1 ") for _ in range(r.randrange(1, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    return ODD + noisy(3000)


def frame(spark, texts, **extra):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_counts(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df = frame(spark, texts).withColumn("n_tokens", F.lit("clash")).withColumn("_text", F.lit(None))
    got = {r.doc_id: r for r in token_counts.token_counts(df, "text", path, limit=512).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512), repr(t)


def test_counts_of_nothing(spark):
    df = frame(spark, ["a"]).filter("doc_id < 0")
    assert token_counts.token_counts(df, "text", public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pieces(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode_digests(frame(spark, texts), "text", path).collect()}
    for i, t in enumerate(texts):
        ids = [*sp.encode(t or ""), 2]
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest(), len((t or "").encode()))
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256, got[i].spanned_bytes) == want, repr(t)


def test_spans(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for r, t in zip(sorted(pieces.encode_texts(frame(spark, texts[:400]), "text", path).collect()), texts):
        data = (t or "").encode()
        assert b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data
        assert r.starts == sorted(r.starts)


def trie(entries):
    """A double array for a small map, built the plain way: offsets far apart."""
    keys = sorted(entries)
    units = [0] * 65536
    free = [256]

    def place(node, prefix):
        labels = sorted({k[len(prefix)] for k in keys if k.startswith(prefix) and len(k) > len(prefix)})
        base = free[0]
        free[0] += 256
        offset = node ^ base
        units[node] |= offset << 10
        if prefix in entries:
            units[node] |= 1 << 8
            units[base] = entries[prefix] | 1 << 31
        for c in labels:
            units[base ^ c] |= c
            place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    return units[: free[0]]


def test_character_map():
    replacements = b"A\0BB\0\0"
    units = trie({b"a": 0, b"ab": 2, b"zz": 5})
    blob = struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + replacements
    m = pieces.CharacterMap(blob)
    assert m.longest(b"xab", 1) == (2, b"BB")
    assert m.longest(b"ac", 0) == (1, b"A")
    assert m.longest(b"zz", 0) == (2, b"")
    assert m.longest(b"z", 0) is None
    model = pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))
    model.map, model.squeeze = m, True
    normal, source = model.normalize("  ab zz a ")
    assert normal.decode() == "▁BB▁A"
    assert source[3:5] == [2, 2] and source[-1] == 10 and source[-2] == 8


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark, texts), path).collect()
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(ids, "<u4").tobytes())
    assert by_doc.keys() == want.keys()
    for d, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(want[d])
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) <= 2048
    assert sum(sum(r.length for r in own) < 2048 for own in by_sequence.values()) <= 1


def test_sum_of_squares_choice():
    p = packing.SumOfSquares(8, lambda w, last: None)
    p.count[[3, 5]] = 4, 1
    brute = {}
    for level in range(0, 7):
        if level and not p.count[level]:
            continue
        n = p.count.copy()
        n[level] -= level > 0
        n[level + 2] += level + 2 < 8
        brute[level] = int((n[1:8] ** 2).sum())
    assert brute[p.level_for(2)] == min(brute.values())
    assert p.level_for(5) == 3


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, ["a"]).filter("doc_id < 0"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_null_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (7, "a b"), (7, "a b")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).collect()) == ["7", "7", "None", "None"]


def test_workers_keep_one_operators_caches():
    from conjunct.llm import language, toxicity, units

    toxicity._WORDS["word"] = 1
    language.opened("m", ["aa"], np.zeros((language.ROWS, 1)))
    assert not toxicity._WORDS and language._MODELS
    units.cache("k", lambda u: u).learn(["a"])
    assert not language._MODELS and units._CACHES
    units.claim("near_dups")
    assert not units._CACHES


def test_workers_give_memory_back(monkeypatch):
    from conjunct.llm import units

    done = []
    monkeypatch.setattr(units, "_TRIM", done.append)
    units.cache("k", lambda u: u).learn(["a"])
    done.clear()
    units.claim("units")
    assert not done
    units.claim("near_dups")
    assert done


def test_packing_remembers_as_much_as_it_is_told():
    """Few units and words stay in a worker, and the ids are the library's all the same."""
    from conjunct.llm import units

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, most = Tokenizer.from_file(path), 0
    packing._WORDS.clear()
    for k in range(40):
        texts = [" ".join(f"w{chr(97 + k % 26)}{'x' * (k // 26)}{chr(97 + i)}{chr(97 + j)}, same" for j in range(10)) for i in range(10)]
        got = packing.token_ids(texts, path, (300, 300))
        assert got == [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        most = max(most, len(units._CACHES["ids", path, (300, 300)]), len(packing._WORDS[path]))
    assert 300 < most <= 300 + 102


def test_frequent_pretokens_are_of_all_rows(spark):
    """The table's pre-tokens are the corpus's most frequent ones, whatever tasks they are in."""
    import collections

    texts = [f"common word{i % 7} w{i} " + "hot " * (i % 5) for i in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    seen = collections.Counter(u for t in texts if t for u in token_counts.PRETOKEN.findall(t))
    got = token_counts.frequent_pretokens(df, "text", 12, 1 << 19)
    assert sorted(got[:12], key=lambda u: (-seen[u], u)) == sorted(seen, key=lambda u: (-seen[u], u))[:12]


def test_tables_round_trip():
    units = [" the", "é", "日本", "\n\n"]
    assert token_counts.opened_table(*token_counts.table_of(units, [1, 2, 300, 4])) == dict(zip(units, [1, 2, 300, 4]))


def test_long_texts_in_pieces():
    text = "some words and 12 numbers, " * 300
    assert [u for part in token_counts.pretokens(text, 100) for u in part] == token_counts.PRETOKEN.findall(text)


def test_plain_texts_are_cut_by_their_own_pattern():
    """PLAIN_PRETOKEN finds what PRETOKEN finds, for every plain character beside every kind of neighbour; plain texts go by it."""
    r = random.Random(4)
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and token_counts.PLAIN.fullmatch(chr(c))]
    some = ["a", "B", "é", "日", "1", "²", ".", "'", "'s", "'re", "'S", " ", "  ", "\n", "\t", "\xa0", "\r\n"]
    texts = [f"{a}{c}{b}{c}{c} {c}" for c in chars for a, b in [("", ""), ("a", "'ll"), ("1", " "), (" ", "."), ("\n", "\xa0")]]
    texts += ["".join(r.choice(some if r.random() < 0.7 else chars) for _ in range(r.randrange(1, 30))) for _ in range(6000)]
    for x in texts:
        assert token_counts.PLAIN_PRETOKEN.findall(x) == token_counts.PRETOKEN.findall(x), repr(x)
    assert len(chars) > 30_000 and all(map(token_counts.PLAIN.fullmatch, texts))
    odd = ["é́ x", "a\x1cb", "क़ क", "x\u2028 y"]
    assert [list(token_counts.pretokens(x)) for x in odd] == [[token_counts.PRETOKEN.findall(x)] for x in odd]


def odd_units(n: int) -> list[str]:
    r, letters = random.Random(3), "abzAZȺǄéßﬁÀİıΣςक़한文ªʰ9٣'’.,;!?:-\u0301\u0307\ufffd😀"
    found = ["".join(r.choice(letters) for _ in range(r.randrange(1, 9))) for _ in range(n)]
    return [*found, "İ!", "क़.", "it's", "end.", "...", "İ", "word", "Word?!", "éa,"]


def test_units_are_aligned_together(monkeypatch):
    """Units are normalised and their pieces projected in one go, with what each alone gives."""
    m = pieces.model(public_tokenizers.path("piece_bpe_32k.model"))
    units = [u for u in odd_units(2000) if " " not in u] + ["a\nb", "\t"]
    want = [m._unit(u, ids) for u, ids in zip(units, m.sp.encode(units), strict=True)]
    plain = [u for u, ids in zip(units, m.sp.encode(units), strict=True) if (m.lengths[ids] >= 0).all()]
    assert m.units(units) == want and len(plain) > 500
    monkeypatch.setattr(m, "_projected", lambda *a: pytest.fail("a unit by itself"))
    assert m.units(plain) == [x for x, u in zip(want, units, strict=True) if u in set(plain)]


def test_spans_of_units_are_those_of_whole_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    m = pieces.model(path)
    for t in ["one two three", "é 日本 x😀y", "a", "Don't we've 12 3.5"]:
        whole = np.asarray([p[1:] for p in m.encode(t)], "<i4")
        assert pieces.digests([t], path)[0][3:] == (len(t.encode()), zlib.crc32(whole.tobytes()))


@pytest.mark.parametrize("most", [8, 1 << 20])
def test_open_windows(most):
    """On either side of the limit every id is packed once, and levels stay counted."""
    r, out = random.Random(2), []
    p = packing.SumOfSquares(64, lambda w, last: out.append(w), most)
    docs = {i: np.arange(i * 1000, i * 1000 + r.randrange(33, 60), dtype="<u4").tobytes() for i in range(300)}
    for i, ids in docs.items():
        p.add(i, ids)
        assert p.open <= most and p.open == p.count.sum() == sum(map(len, p.at))
    p.finish()
    got = {}
    for w in out:
        assert w.fill == sum(len(x[2]) // 4 for x in w.pieces) <= 64
        for doc, start, ids, _ in w.pieces:
            got.setdefault(doc, []).append((start, ids))
    assert {i: b"".join(ids for _, ids in sorted(x)) for i, x in got.items()} == docs
    assert sum(w.fill < 64 for w in out) <= 1


def test_clashing_names(spark):
    names = ["row", "text_", "ids", "a.b", "unit", "start", "length"]
    df = spark.createDataFrame([(1, "some text")], "doc_id long, text string").withColumns({n: F.lit("mine") for n in [*names, "n_tokens", "spanned_bytes"]})
    a = token_counts.token_counts(df, "text", public_tokenizers.path("byte_bpe_50k.json")).first()
    b = pieces.encode_digests(df, "text", public_tokenizers.path("piece_bpe_32k.model")).first()
    assert a.n_tokens == 2 and b.n_tokens > 2 and b.spanned_bytes == 9 and all(r[n] == "mine" for r in (a, b) for n in names)
    assert packing.pack(df, public_tokenizers.path("word_bpe_49k.json")).count() == 1


def test_words_of_letters_are_encoded_in_rows(monkeypatch):
    """Ids of units are the library's, and words of letters aren't sent to it one by one."""
    path = public_tokenizers.path("word_bpe_49k.json")
    alone = packing._word_ids(path)
    units = odd_units(4000)
    assert packing._unit_ids(path)(units) == alone(units)
    sent = []
    monkeypatch.setattr(packing, "_word_ids", lambda path: lambda units: sent.extend(units) or alone(units))
    packing._WORDS.clear()
    words = ["some", "Wörds", "of.", "letters,", "x9", "OF"]
    assert packing._unit_ids(path)(words) == alone(words) and set(sent) <= {"x9", ".", ","}
    assert packing._ends(public_tokenizers.path("byte_bpe_50k.json")) is None


def test_plain_texts_are_cut_into_words(monkeypatch):
    """Ids of plain texts, of every plain character, are the library's; words are looked up without case and marks, not by unit."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, r = Tokenizer.from_file(path), random.Random(8)
    chars = [chr(c) for c in range(0x2100) if packing.PLAIN.fullmatch(chr(c))]
    some = ["", "ab", "don't", "'s", "'S", "12", " ", "\n", "x'salad", ").", "'", "Ⱥ", "ŉ", "<|", "</w>"]
    texts = [f"{a}{c}{b} {c}{c}" for c in chars for a, b in [("", ""), ("a", "b"), ("1", "'s"), (".", " ")]]
    texts += ["".join(r.choice(some if r.random() < 0.5 else chars) for _ in range(r.randrange(1, 40))) for _ in range(6000)]
    want = [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    packing._WORDS.clear()
    monkeypatch.setattr(packing, "_by_units", lambda texts, known: [pytest.fail("by units") if t else b"" for t in texts])
    assert len(chars) > 500 and packing.token_ids(texts, path) == want
    assert {"ab", "."} <= set(packing._WORDS[path]) and not any(w != w.lower() or " " in w for w in packing._WORDS[path])
    monkeypatch.undo()
    odd = ["a <|endoftext|> b", "x<|endoftext|>y", "İ a", "é́ x", "日本 a", "w" * 200 + " a " + "!" * 200, "ª ² a"]
    assert packing.token_ids(odd, path) == [np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
