"""The Jaccard join against all pairs, and the stage that keeps one document of each group."""

import random
import re

import numpy as np

from lorespan.llm import jaccard_join as J


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, s) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, len(s), i if not s else least[find(k)]) for k, (i, s) in enumerate(sets))


def test_shingles_are_counted_as_words_are_cut():
    rng = random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice(["a", "b", "A", "é", " ", "\t", "\n", " ", "c", " "]) for _ in range(rng.randint(0, 60)))
        assert len(J.shingles(t)) == len(shingle_set(t)), t
    assert J.set_key(J.shingles("A b c d e f")) == J.set_key(J.shingles("a  B c\nd e F"))
    assert len(J.shingles("w " * 100000)) == 1


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for n in [4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 50, 80, 200, 500]:
        for _ in range(120 if n < 200 else 30):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            differ = int(rng.integers(0, 2 * n // 9 + 2))
            drop = min(int(rng.integers(0, differ + 1)), n - 1)
            b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, differ - drop, dtype=np.uint64))))
            common = len(np.intersect1d(a, b))
            if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
                same = np.intersect1d(J.signatures(a), J.signatures(b))
                assert len(same), (n, len(a), len(b))
                # in one of the two kinds of bands they share as many as either set asks for
                sides = [int((same & np.uint64(1) == k).sum()) for k in (0, 1)]
                need = [max(J.shared_at_least(a)[k], J.shared_at_least(b)[k]) for k in (0, 1)]
                assert any(s >= c for s, c in zip(sides, need, strict=True)), (sides, need)


def test_fallback_signatures_find_what_equal_segments_miss(monkeypatch):
    """With hardly any segments to spare, sets lean on one-deletion neighbourhoods and blocks."""
    real = J.bands
    monkeypatch.setattr(J, "bands", lambda percent, most: tuple((lo, hi, 2 * hi * (100 - percent) // (100 + percent) + 1) for lo, hi, _ in real(percent, most)))
    rng = np.random.default_rng(6)
    for _ in range(1500):
        n = int(rng.integers(5, 40))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate((a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64))))
        common = len(np.intersect1d(a, b))
        if 100 * common >= 80 * (len(a) + len(b) - common) and common < max(len(a), len(b)):
            assert len(np.intersect1d(J.signatures(a), J.signatures(b))), (len(a), len(b))


def edited(rng, words, share):
    return [rng.choice("xyzuvw") + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def test_components_equal_all_pairs(spark):
    rng = random.Random(8)
    texts = []
    for size in (6, 9, 14, 40, 120):
        for _ in range(3):
            words = [f"w{rng.randint(0, 400)}" for _ in range(size)]
            texts += [" ".join(edited(rng, words, s)) for s in (0, 0, 0.01, 0.02, 0.03, 0.05)] + [" ".join(words[: size - 1]), " ".join(words + ["tail"])]
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage + [f"own{k}{i}" for i in range(12 + k)]) for k in range(12)]
    texts += ["", None, "  \n", "one", "ONE", "a b", "a b c d", "a b c d e", texts[0]]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, key string, sig int")
    got = J.link_documents(docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    kept = J.deduplicate(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _, c in plain_components(rows) if i == c}


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(20000))
    data = [(1, long), (1, long), (None, "only here alone as it is"), (None, long + " end"), (2, long + " end"), (3, None), (3, None), (7, long.upper())]
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in data], "doc_id long, text string, comp double")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in J.link_documents(docs).collect())
    n = 19996
    assert got == sorted([("1", n, "1"), ("1", n, "1"), ("None", 2, "None"), ("None", n + 1, "1"), ("2", n + 1, "1"), ("3", 0, "3"), ("3", 0, "3"), ("7", n, "1")])
    kept = sorted((str(r.doc_id), r.text is None) for r in J.deduplicate(docs).collect())
    assert kept == sorted([("1", False), ("3", True), ("None", False)])
    assert J.link_documents(docs.limit(0)).count() == 0 and J.deduplicate(docs.limit(0)).count() == 0


def test_links_of_every_class_are_counted_whole(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(24):  # mutually similar, all different
        words = list(base)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(100, rows[0][1]), (101, " ".join(f"y{i}" for i in range(80))), (102, None)]
    sets = {i: frozenset(J.shingles(t or "").tolist()) for i, t in rows}
    classes = {s for s in sets.values() if s}
    want = {i: sum(s != o and 100 * len(s & o) >= J.PERCENT * len(s | o) for o in classes) if s else 0 for i, s in sets.items()}
    assert max(want.values()) == 23
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in J.link_documents(docs).collect()} == want
    assert {r.doc_id: r.n_links for r in J.link_documents(docs, block=5).collect()} == want


def test_null_ids_carry_links(spark):
    """A and B are linked through N only, whose id may be null; repeated ids with different texts stay apart."""
    words = [f"w{i}" for i in range(120)]
    texts = {"A": words[:105], "N": words[6:112], "B": words[13:120]}
    texts = {k: " ".join(v) for k, v in texts.items()}
    sets = {k: shingle_set(t) for k, t in texts.items()}
    alike = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    assert alike("A", "N") and alike("N", "B") and not alike("A", "B")
    for middle in (5, None):
        docs = spark.createDataFrame([(1, texts["A"]), (middle, texts["N"]), (2, texts["B"]), (None, "quite another text of its own kind")], "doc_id long, text string")
        got = {(r.doc_id, r.n_shingles): (r.component_id, r.n_links) for r in J.link_documents(docs).collect()}
        assert got[1, len(sets["A"])] == (1, 1) and got[middle, len(sets["N"])] == (1, 2) and got[2, len(sets["B"])] == (1, 1)
        assert sorted((r.doc_id is None, r.text[:5]) for r in J.deduplicate(docs).collect()) == [(False, "w0 w1"), (True, "quite")]
    twice = spark.createDataFrame([(1, texts["A"]), (1, "another text of id number one"), (2, texts["N"])], "doc_id long, text string")
    assert sorted(r.text[:5] for r in J.deduplicate(twice).collect()) == ["anoth", "w0 w1"]
    nulls = spark.createDataFrame([(None, texts["A"]), (None, texts["N"]), (None, texts["N"])], "doc_id long, text string")
    assert {r.component_id for r in J.link_documents(nulls).collect()} == {None} and J.deduplicate(nulls).count() == 1


def test_a_passage_common_to_all(spark):
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(70)]
    rows = [(k, " ".join(passage + [f"own{rng.randint(0, 9999)}" for _ in range(rng.choice((2, 4, 7, 12, 40)))])) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (7, J.BLOCK):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.link_documents(docs, block=block).collect())
        assert got == plain_components(rows)


def test_bit_maps_bound_intersections():
    rng = np.random.default_rng(3)
    for _ in range(300):
        common = rng.integers(0, 1 << 63, int(rng.integers(0, 300)), dtype=np.uint64)
        sets = [np.unique(np.concatenate((common, rng.integers(0, 1 << 63, int(rng.integers(1, 300)), dtype=np.uint64)))) for _ in range(4)]
        maps = J._bit_rows([J.bit_map(s) for s in sets])
        spare = np.array([len(s) for s in sets]) - np.bitwise_count(maps).sum(axis=1)
        exact = J.intersections([s.view(np.int64) for s in sets])
        for i in range(4):
            for j in range(4):
                true = len(np.intersect1d(sets[i], sets[j]))
                assert int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(spare[i], spare[j]) >= true
                assert i == j or exact[i, j] == true
    many = [np.unique(rng.integers(0, 60, 40)) for _ in range(30)]
    exact = J.intersections(many)
    assert all(exact[i, j] == len(np.intersect1d(many[i], many[j])) for i in range(30) for j in range(30) if i != j)
