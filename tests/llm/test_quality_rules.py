"""Rules against plain counts; the language model's distributions; bands."""

import math
import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lorespan.llm import quality_rules as R

sys.path.insert(0, str(Path(__file__).resolve().parent))
import plain_kneser_ney as K  # noqa: E402


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_measures_equal_plain_counts():
    rng = random.Random(3)
    parts = ["a", "b", "é", " ", " ", "\n", "\n", "\t", "#", "|", "\x85", "\x1c", "a b a b ", "　"]
    for _ in range(3000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        words = t.encode().split()
        assert (len(words), *R.base_measures(t, words)) == plain(t), repr(t)


def test_model_is_a_distribution(spark):
    docs = spark.createDataFrame([("abra cadabra abracadabra bar", "en"), ("barra cab", "en"), ("zug zag", "de"), (None, None)], "text string, lang string")
    named = K.kneser_ney(R.word_counts(docs))
    values = {r["name"]: r.value for r in named.collect()}
    slots, made = K.hash_arrays(named)
    assert (slots[1:] > slots[:-1]).all() and len(slots) == len(values)
    scorer = K.NgramScorer(slots, made, R.ORDER, K.SLOT_BITS)
    seen = {n.split(":", 2)[2] for n in values if n.startswith("p1:en:")}
    for context in ("\x02\x02\x02", "abr", "bra", "zzz"):
        known = sum(math.exp(scorer.gram("en", context + c)) for c in seen)
        unseen = math.exp(scorer.gram("en", context + "Q"))
        assert abs(known + unseen - 1) < 1e-5, context
    assert scorer.log_perplexity("en", [b"abra"]) < scorer.log_perplexity("en", [b"qqqq"])
    assert scorer.log_perplexity("xx", [b"abra"]) > 0 and scorer.log_perplexity("en", []) == 0.0


def plain_kneser_ney(words, order=4):
    """Interpolated probabilities of all n-grams of the highest order, by the formulas of modified Kneser-Ney."""
    level = Counter()
    for w, c in Counter(words).items():
        marked = "\x02" * (order - 1) + w + "\x03"
        for i in range(len(marked) - order + 1):
            level[marked[i : i + order]] += c
    levels = {order: level}
    for k in range(order - 1, 0, -1):
        level = levels[k] = Counter(g[1:] for g in level)  # distinct characters before it

    def discounts(counts):
        n = [sum(c == k for c in counts.values()) for k in range(5)]
        y = n[1] / (n[1] + 2 * n[2] + 1e-9)
        out = []
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[k + 1] / n[k] if n[1] and n[2] and n[k] else 0
            out.append(min(d, k - 0.01) if d > 0 else k / (k + 1))
        return out

    lower = None
    for k in range(1, order + 1):
        counts, d = levels[k], discounts(levels[k])
        by_context = {}
        for g, c in counts.items():
            by_context.setdefault(g[:-1], []).append(c)
        now = {}
        for g, c in counts.items():
            same = by_context[g[:-1]]
            left, total = sum(d[min(x, 3) - 1] for x in same), sum(same)
            rest = left / (len(same) + 1) if lower is None else left * lower[g[1:]]
            now[g] = (c - d[min(c, 3) - 1] + rest) / total
        lower = now
    return lower


def test_model_equals_plain_kneser_ney(spark):
    rng = random.Random(14)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(400)] + ["the"] * 30 + ["of"] * 12
    other = ["".join(rng.choices("xyz", k=3)) for _ in range(50)]
    docs = spark.createDataFrame([(" ".join(words[:200]), "en"), (" ".join(words[200:]), "en"), (" ".join(other), "de")], "text string, lang string")
    probs = {(r["lang"], r["g"]): r["p"] for r in R.level_probabilities(R.word_counts(docs))[-1][0].collect()}
    want = {("en", g): p for g, p in plain_kneser_ney(words).items()} | {("de", g): p for g, p in plain_kneser_ney(other).items()}
    assert probs.keys() == want.keys() and all(abs(probs[k] - p) < 1e-9 for k, p in want.items())


def test_marks_between_words_do_not_hide_junk(spark):
    """Perplexity is over words of two characters or more; where a text has none, over all; lang may hold any character."""
    rng = random.Random(15)
    syllables = ["ba", "ko", "ri", "lu", "te", "mo", "sa"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    rows = [(i, " ".join(word() for _ in range(100)), "e:n\x00") for i in range(120)]
    rows += [(200 + i, " | ".join("".join(rng.choices("bkrltmsaoiue", k=9)) for _ in range(60)), "e:n\x00") for i in range(8)]
    rows += [(300, "a b " * 40, "zz"), (301, " ".join("abcdefghij"[i % 10] for i in range(60)), "zz")]
    got = {r.doc_id: r for r in R.score_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(120)) and not any(got[200 + i].kept for i in range(8))
    assert got[301].log_perplexity > 0 and got[0].lang == "e:n\x00"


def test_rules_reject_gibberish_and_keep_clean(spark):
    rng = random.Random(6)
    syllables = ["ba", "ko", "ri", "lu", "te"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    rows = [(i, " ".join(word() for _ in range(120)), "en") for i in range(60)]
    rows += [(100, " ".join("".join(rng.choices("qxzjkvw0987", k=9)) for _ in range(120)), "en")]
    rows += [(101, None, "en"), (102, "", None), (103, "same three words " * 60, "en"), (None, rows[0][1], "en"), (104, rows[1][1], None), (104, rows[1][1], None)]
    docs = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "doc_id long, text string, lang string, kept int")
    got = R.score_rules(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].kept for i in range(60)) and not by_id[100].kept and not by_id[100].base_failed
    assert by_id[101].base_failed and by_id[102].n_words == 0 and by_id[103].base_failed and not by_id[103].kept
    assert by_id[None].kept and by_id[104].kept and by_id[104].lang == "und"
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
    assert R.score_rules(docs.limit(0)).count() == 0


def test_every_ngram_keeps_its_own_value(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60)), "en") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    named = K.kneser_ney(R.word_counts(docs))
    slots, made = K.hash_arrays(named)
    assert len(slots) == named.count() > 50_000  # about a hundred of these would share a slot of 2 ** 24
    scorer = K.NgramScorer(slots, made, R.ORDER, K.SLOT_BITS)
    want = {i: scorer.log_perplexity("en", text.encode().split()) for i, text, _ in rows}
    for hot in (0, 500, R.HOT_GRAMS):
        got = {r.doc_id: r.log_perplexity for r in R.score_rules(docs, hot=hot).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want), hot


def test_a_third_of_junk_does_not_widen_the_band(spark):
    rng = random.Random(9)
    syllables = ["ba", "ko", "ri", "lu", "te", "mo", "sa", "ne", "vi", "du"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    gibberish = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(3, 10)))
    template = [word() for _ in range(30)]
    rows = [(i, " ".join(word() for _ in range(100)), lang) for lang, at in (("en", 0), ("de", 1000), ("fr", 2000)) for i in range(at, at + 200)]
    rows += [(i, " ".join(gibberish() for _ in range(100)), "en") for i in range(3000, 3100)]
    rows += [(i, " ".join(gibberish() for _ in range(100)), "de") for i in range(4000, 4005)]
    rows += [(i, " ".join(rng.choices(template, k=100)), "fr") for i in range(5000, 5100)]
    got = R.score_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    judged = [r for r in got if not r.base_failed]
    assert sum(r.doc_id >= 3000 for r in judged) > 150
    assert not any(r.kept for r in judged if r.doc_id >= 3000)
    assert all(r.kept for r in judged if r.doc_id < 3000)


@pytest.mark.parametrize("order", [2, 4, 5])
def test_texts_sum_what_their_words_hold(order, monkeypatch):
    """Sums and other n-grams equal those of a plain dictionary, whatever is remembered."""
    import random

    import xxhash

    rng = random.Random(order)
    words = ["".join(rng.choices("abcé日😀\x02", k=rng.randint(1, 6))).encode() for _ in range(300)] + [b"\xff\xfe", b"x" * 80, b"a", b"b"]
    mark = lambda w: R._START * (order - 1) + w.decode("utf-8", "replace") + R._END
    cut = lambda w: [mark(w)[i : i + order] for i in range(len(mark(w)) - order + 1)]
    model = {(lang, g): -rng.random() for lang in "xy" for w in words for g in cut(w) if rng.random() < 0.7}
    name = lambda lang, g: xxhash.xxh64_intdigest(g.encode(), seed=xxhash.xxh64_intdigest(lang.encode(), seed=42))
    pairs = sorted((name(*k), v) for k, v in model.items())
    scorer = R.TextScorer(np.array([k for k, _ in pairs], np.uint64), np.array([v for _, v in pairs]), order)
    monkeypatch.setattr(R, "CACHE_ENTRIES", 60)
    for _ in range(6):
        batch = [(rng.choice("xy"), rng.choices(words, k=rng.randint(0, 40))) for _ in range(10)] + [("x", [b"a", b"b", b"a"]), ("z", [b"abc"]), ("x", [])]
        for (lang, ws), (total, n, others) in zip(batch, scorer.texts(batch), strict=True):
            long = [w for w in ws if len(w.decode("utf-8", "replace")) > 1] or ws
            grams = [g for w in long for g in cut(w)]
            assert n == len(long)
            assert abs(total - sum(model.get((lang, g), 0.0) for g in grams)) < 1e-9
            assert others == {g: grams.count(g) for g in grams if (lang, g) not in model}


def test_more_characters_than_numbers():
    scorer = R.TextScorer(np.zeros(0, np.uint64), np.zeros(0), 3)
    words = [chr(i).encode() for i in range(0x100, 0xD800)] + [chr(i).encode() for i in range(0x10000, 0x14000)]
    assert len(words) > 0xFFFF
    assert [o for _, _, o in scorer.texts([("x", words[-2:]), ("x", words)])][0] == {R._START * 2 + words[-2].decode(): 1, R._START + words[-2].decode() + R._END: 1, R._START * 2 + words[-1].decode(): 1, R._START + words[-1].decode() + R._END: 1}
