"""SentencePiece ids and texts against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lorespan.llm import piece_codec

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
CODEC = piece_codec.PieceCodec(open(MODEL, "rb").read())
PARTS = list("ab  \n\té☃01日,.'À▁ſﬁ\x00\x85 　́😀𐍈<>xX_-") + ["the", "ing", "<s>", "<0x41>", "</s>", "<unk>", " ", "aaa", "    ", "return", "------", "===="]


def ids(data: bytes) -> list[int]:
    return np.frombuffer(data, "<i4").tolist()


def test_ids_equal_the_library():
    rng = random.Random(1)
    pieces = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(300, 32000)]
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(2000)]
    texts += ["".join(rng.choices(pieces, k=150)).replace(" ", "") for _ in range(60)]
    texts += ["".join(rng.choices("aeinorst", k=rng.randint(1, 300))) for _ in range(200)]
    texts += ["".join(rng.choices("=-_*a", k=rng.randint(1, 100))) for _ in range(200)] + ["", " ", "a" * 20000, "x" * 70 + " y" * 3000]
    assert [ids(x) for x in CODEC.encode(texts)] == LIBRARY.encode(texts, num_threads=1)


def test_a_full_memory_starts_anew():
    small = piece_codec.PieceCodec(open(MODEL, "rb").read(), cache_entries=3)
    for text in ("one two three", "four five six seven", "one " + "w" * 100, "one two"):
        assert ids(small.encode([text])[0]) == LIBRARY.encode(text)
        assert not any(len(w) > 64 for w in small.cache)


def test_merges_that_overtake_wait():
    """A model in which merging all places of a pair at once would be wrong."""
    toy = object.__new__(piece_codec.PieceCodec)
    # a b -> 3 has rank 1, and 3 followed by a makes a piece of rank 0
    names = {"a": 0, "b": 1, "c": 2, "ab": 3, "aba": 4, "bc": 5}
    made = {0 << 22 | 1: 3, 3 << 22 | 0: 4, 1 << 22 | 2: 5}
    rank = {3: 1, 4: 0, 5: 2}
    toy._keep_pairs(made, rank)

    def slow(word):
        sym = list(word)
        while True:
            found = [(rank[names[sym[i] + sym[i + 1]]], i) for i in range(len(sym) - 1) if sym[i] + sym[i + 1] in names]
            if not found:
                return [names[s] for s in sym]
            i = min(found)[1]
            sym[i : i + 2] = [sym[i] + sym[i + 1]]

    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(300)]
    flat = np.array([names[c] for w in words for c in w])
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    sym, at = toy._rounds(flat, owner)
    assert [sym[at == i].tolist() for i in range(len(words))] == [slow(w) for w in words]


def test_texts_equal_the_library():
    rng = random.Random(2)
    rows = [[rng.choice([0, 1, 2, 28705, 300, 259, *range(3, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 8))] for _ in range(2000)]
    flat, starts = np.array([i for r in rows for i in r]), np.cumsum([0] + [len(r) for r in rows])
    assert CODEC.decode(flat, starts) == [LIBRARY.decode(r) for r in rows]
    with pytest.raises(ValueError):
        CODEC.decode(np.array([32000]), np.array([0, 1]))


def test_frames(spark):
    texts = [None, "", " two  spaces ", "same", "same", "naïve 😀 ▁ \x00", "long " * 4000]
    data = [(i if i else None, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(data, "doc_id long, text string, ids int")
    coded = piece_codec.encode_pieces(docs, MODEL)
    got = {r.doc_id or 0: list(r.ids) for r in coded.collect()}
    assert got == {i: LIBRARY.encode(t or "") for i, t in enumerate(texts)}
    both = piece_codec.encode_pieces(docs, MODEL, decoded_col="text").collect()
    assert {r.doc_id or 0: r.text for r in both} == {i: LIBRARY.decode(got[i]) for i in got}
    back = {r.doc_id or 0: r.text for r in piece_codec.decode_pieces(coded, MODEL).collect()}
    assert back == {i: LIBRARY.decode(got[i]) for i in got}
    odd = spark.createDataFrame([(1, None), (2, [None, 300]), (3, [])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.text for r in piece_codec.decode_pieces(odd, MODEL, carry=("ids",)).collect()} == {1: "", 2: LIBRARY.decode([300]), 3: ""}
    assert [len(x) for x in piece_codec._runs(["a" * (1 << 20), "b", "c" * (1 << 20), "d"])] == [1, 2, 1]
    assert piece_codec.decode_pieces(piece_codec.encode_pieces(docs.limit(0), MODEL), MODEL).count() == 0


def test_query(spark, sf):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        i = LIBRARY.encode(r.text or "")
        want.add((r.doc_id, len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i))))
    assert {tuple(r) for r in piece_codec.op12_piece_codec(spark, sf).collect()} == want
