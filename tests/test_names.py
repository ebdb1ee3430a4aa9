"""Words within a few edits, contained aliases, the cascade and the scan of aliases, against plain versions."""

import random

from lorespan.operators import names as N


def distance(a, b):
    rows = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            rows[i][j] = min(rows[i - 1][j] + 1, rows[i][j - 1] + 1, rows[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                rows[i][j] = min(rows[i][j], rows[i - 2][j - 2] + 1)
    return rows[-1][-1]


def words(rng, n, letters="abc", longest=9):
    return ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(n)]


def test_near_words_equal_the_whole_matrix(spark):
    rng = random.Random(1)
    left, right = set(words(rng, 150)), set(words(rng, 150))
    a, b = spark.createDataFrame([(w,) for w in left] + [(None,), ("",)], "a string"), spark.createDataFrame([(w,) for w in right] + [(None,)], "b string")
    for most in (1, 2):
        want = {(x, y, k) for x in left for y in right if x[0] == y[0] and (k := distance(x, y)) <= most}
        assert {tuple(r) for r in N.near_words(a, b, most).collect()} == want and len(want) > 50
    plan = N.near_words(a, b)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_aliases(spark):
    rng = random.Random(2)
    parts = ["the", "the", "the", "cat", "Catalogue", "c++", "C", "é", "图", "知识", "a_b", "-", "1", "."]
    texts = [(i % 90, " ".join(rng.choices(parts, k=rng.randint(0, 7)))) for i in range(100)] + [(200, None), (201, "c"), (202, "图")]
    aliases = [" ".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(60)] + ["c", "图", "", None, "THE  cat", "the", "cat cat", "++"]
    t, a = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in aliases], "alias string")
    got = N.containment_join(t, a)
    want = t.crossJoin(a.distinct()).filter(N.holds_name(t["text"], a["alias"])).select("id", "alias")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert N.containment_join(t.limit(0), a).count() == N.containment_join(t, a.limit(0)).count() == 0


def test_fuzzy_matches_equal_the_whole_matrix(spark):
    rng = random.Random(3)
    base = words(rng, 40, "abcdefgh", 12)
    edit = lambda w: (lambda i: rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcxyz") + w[i:], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]]))(rng.randint(1, len(w)))
    queries = [(i, " ".join(edit(edit(w)) if rng.random() < 0.5 else edit(w) for w in rng.choices(base, k=5))) for i in range(60)]
    aliases = list(enumerate(sorted(set(base))))
    got = {(r.query_id, r.alias_id): (r.distance, r.similarity) for r in N.match_aliases(spark.createDataFrame(queries, "query_id int, text string"), spark.createDataFrame(aliases, "alias_id int, alias string")).filter("mode = 'LATIN_FUZZY'").collect()}
    want = {}
    for q, text in queries:
        for k, alias in aliases:
            ws = text.split()
            joined = {"".join(ws[i:j]) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + 8) + 1)}
            if alias in ws or (len(alias) >= 3 and alias in joined):
                continue
            near = [(d, -s) for w in ws if 5 <= len(w) and 5 <= len(alias) and w[0] == alias[0] and (d := distance(alias, w)) <= (1 if len(alias) <= 8 else 2) and ((s := round(1 - d / max(len(alias), len(w)), 6)) >= 0.88 or len(alias) < 9)]
            if near:
                want[q, k] = (min(near)[0], -min(near)[1])
    assert got == want and len(want) > 20


def test_scan_of_aliases(spark):
    queries = spark.createDataFrame([(1, "r", "Who made Postgresql at the EIB"), (2, "s", "who made it"), (3, "x", "who"), (4, "many", "a0")], "query_id int, reader string, text string")
    aliases = [(10, "postgressql"), (10, "Who"), (11, "European Investment Bank"), (12, "made"), (13, "Who"), *[(100 + i, f"a{i}") for i in range(5)]]
    evidence = [(10, "postgressql", 1, 7), (10, "postgressql", 2, 8), (10, "who", 3, 7), (11, "European  Investment Bank", 4, 8), (12, "made", 5, 9), (13, "who", 6, 7), (13, "who", 7, 7), *[(100 + i, f"a{i}", 50 + i, 20) for i in range(5)]]
    visible = [("r", 7), ("r", 8), ("s", 9), ("many", 20)]
    got, outcomes = N.alias_scan(queries, spark.createDataFrame(aliases, "entity_id int, alias string"), spark.createDataFrame(evidence, "entity_id int, alias string, mention_id int, doc_id int"), spark.createDataFrame(visible, "reader string, doc_id int"), limit=2, most_aliases=4)
    rows = [tuple(r) for r in got.orderBy("query_id", "rank").collect()]
    # entity 10 matches by two aliases: its evidence is the larger, its documents those of both; 11 is third and cut
    assert rows == [(1, 1, 10, "Who", "EXACT_ALIAS", 0, 1.0, 2, [7, 8]), (1, 2, 13, "Who", "EXACT_ALIAS", 0, 1.0, 2, [7]), (2, 1, 12, "made", "EXACT_ALIAS", 0, 1.0, 1, [9])]
    assert {tuple(r) for r in outcomes.collect()} == {(1, "MEASURED", 3, True), (2, "MEASURED", 1, False), (3, "MEASURED", 0, False), (4, N.TOO_MANY_ALIASES, 0, False)}


def test_similar_names_equal_all_pairs(spark):
    from lorespan.operators import similarity as S

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(7)
    names = sorted(set(words(rng, 120, "abé", 8) + words(rng, 60, "abcd", 14)))
    df = spark.createDataFrame([(n,) for n in names] + [("",), (None,), (names[0],)], "name string").repartition(3)
    for least in (0.5, 0.7, 0.9):
        want = {(a, b, round(v, 6)) for i, a in enumerate(names) for b in names[i + 1 :] if a[0] == b[0] and abs(len(a) - len(b)) <= 3 and (v := 1 - edits(a, b) / max(len(a), len(b))) >= least}
        assert {(r.a, r.b, r.similarity) for r in S.name_pairs(df, least).collect()} == want
    assert "NestedLoop" not in S.name_pairs(df, 0.7)._jdf.queryExecution().toString()
