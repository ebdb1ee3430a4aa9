"""Encoding, wavelet files and packing: round trips and plain versions."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorespan.llm import encoding, packing, token_files, wavelet

BYTE, WORD = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))
ODD = ["\x1c", "\r\n", "<|endoftext|>", "<|", "\n\n", "\x85", "​", "　", "ſ", "ﬁ", "ǅ", "İ", "Σ", "́"]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    own, library, rng = encoding.Encoder(open(path, "rb").read()), Tokenizer.from_file(path), random.Random(2)
    parts = list("ab  \n\téñ☃0 1日,.'ÀA") + ["the", "'s", "'re", " in", *ODD]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(3000)] + ["", " ", "a ", "<|startoftext|> A", "<|ENDOFTEXT|>", "a\nb", "\na", "word " * 2000]
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_words_with_symbols_go_to_the_model_by_pieces(monkeypatch):
    """Check of op9, round 3: words with digits or symbols went to the library whole, at several times the time of a word of letters."""
    own, library, rng = encoding.Encoder(open(WORD, "rb").read()), Tokenizer.from_file(WORD), random.Random(5)
    signs = [chr(c) for c in range(0x100) if not chr(c).isspace() and chr(c) != "'"]
    words = ["a$$$", "eathha.%%%", "Çpa!!", "x1y22z", "½a²", *signs, *("".join(rng.choices(signs, k=rng.randint(2, 8))) for _ in range(5000))]
    expected = {w: library.encode(w, add_special_tokens=False).ids for w in words}
    monkeypatch.setattr(own, "_library", lambda text: pytest.fail(f"asked whole: {text!r}"))
    for w in words:
        if "<|" not in w:
            assert np.frombuffer(own.encode(w), "<u4").tolist() == expected[w], repr(w)


@pytest.mark.parametrize("n,levels", [(0, 3), (1, 1), (7, 3), (511, 9), (512, 4), (3000, 16)])
def test_wavelet_matrix(n, levels):
    rng = np.random.default_rng(n)
    values = rng.integers(0, min(1 << levels, 40), n)
    made = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values, levels).to_bytes())
    assert made.decode().tolist() == values.tolist()
    for i in range(0, n, max(1, n // 25)):
        assert made.access(i) == values[i]
        where = np.flatnonzero(values == values[i])
        assert made.count(int(values[i])) == len(where)
        assert made.count(int(values[i]), 0, i) == (where < i).sum()
        assert [made.occurrence(int(values[i]), j) for j in (0, len(where) - 1)] == [where[0], where[-1]]
    assert made.occurrence(0, n + 1) == -1


def rows(spark):
    texts = [None, "", "Hello, world!", "Hello, world!", "x " * 3000, "naïve café", "<|endoftext|> tail"]
    return [(10 - i, t, i) for i, t in enumerate(texts)] + [(None, "no id", 0), (3, "same id", 1)]


def test_token_files_round_trip(spark, tmp_path):
    data = rows(spark)
    docs = spark.createDataFrame(data, "doc_id long, text string, start long")
    path = str(tmp_path / "ids")
    token_files.write_token_files(docs, path, WORD, 1, shard_tokens=50)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    library = Tokenizer.from_file(WORD)
    ids = lambda t: library.encode(t or "", add_special_tokens=False).ids + [1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((d or -1, len(ids(t)), crc(ids(t))) for d, t, _ in data)
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    shards = spark.read.parquet(path)
    assert shards.count() > 1
    token_files.write_token_files(docs.limit(0), str(tmp_path / "none"), WORD, 1)
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_lookups_open_the_files(spark, tmp_path):
    from decimal import Decimal

    texts = ["the first text", None, "the second text and the third", "the " * 40]
    path = str(tmp_path / "files")
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id smallint, text string"), path, WORD, 1, shard_tokens=12)
    library = Tokenizer.from_file(WORD)
    ids = [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
    asked = [(p,) for p in (0, 3, len(ids) - 1, 3, len(ids), -1, None)]
    got = sorted((-9 if r.position is None else r.position, r.token) for r in token_files.token_at(spark, path, spark.createDataFrame(asked, "position long"), bucket=7).collect())
    assert got == sorted((-9 if p is None else p, ids[p] if p is not None and 0 <= p < len(ids) else None) for (p,) in asked)
    the = ids[-3]
    assert {r.token: r.n for r in token_files.count_tokens(spark, path, [the, 1, 48000]).collect()} == {t: ids.count(t) for t in (the, 1, 48000)}
    assert sorted(r.position for r in token_files.find_tokens(spark, path, [the]).collect()) == [i for i, t in enumerate(ids) if t == the]
    for odd in (Decimal("1.50"), b"key"):  # ids of any type
        docs = spark.createDataFrame([(odd, "a text")], f"doc_id {'decimal(5,2)' if isinstance(odd, Decimal) else 'binary'}, text string")
        token_files.write_token_files(docs, str(tmp_path / type(odd).__name__), WORD, 1)
        assert token_files.read_token_files(spark, str(tmp_path / type(odd).__name__)).first().doc_id == odd


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(free) if r >= n]
        if fits:
            i = min(fits, key=lambda i: free[i])
            free[i] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


def test_plan_equals_best_fit_per_document():
    rng = random.Random(4)
    for capacity in (1, 7, 10, 64):
        for _ in range(120):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
            counts = [(n, lengths.count(n)) for n in set(lengths)]
            bins = {}
            for length, _, number, first, offset in packing.plan_bins(counts, capacity):
                for i in range(number):
                    bins.setdefault(first + i, []).append((offset, length))
            for parts in bins.values():
                parts.sort()
                assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
            assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == plain_best_fit(lengths, capacity)


def test_pack_documents(spark):
    docs = spark.createDataFrame(rows(spark), "doc_id long, text string, offset long")
    got = packing.pack_documents(docs, BYTE, 0, capacity=64).collect()
    library = Tokenizer.from_file(BYTE)
    want = []
    for doc_id, text, _ in rows(spark):
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        edges = [0] + list(range(min(first, len(ids)), len(ids) + 1, 64))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want.append((doc_id or -1, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 64
    assert len(bins) == len(plain_best_fit([r.length for r in got], 64))
    assert packing.pack_documents(docs.limit(0), BYTE, 0).count() == 0
