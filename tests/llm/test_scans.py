"""Token counts, personal data, licences and decontamination against plain versions."""

import hashlib
import random
import re

import public_tokenizers
import pytest
import sentencepiece

from lorespan.llm import decontaminate, license_scan, pii, token_count

ROWS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, w string, items string"


def frame(spark, texts, first=0):
    rows = [(i + first if t != "NOID" else None, t if t != "NOID" else "some text", "en", None, None, 1.0, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ROWS)


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library():
    counter = token_count.PieceCounter(open(MODEL, "rb").read(), cache_entries=50)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(3)
    parts = list("ab  \n\t▁éñ☃①0 1日本语") + ["the", "in", " er", "<s>", "</s>", "<0x41>", "<unk>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(2000)] + ["", " ", "  ", "a ", "▁", "a" * 500, "word " * 3000]
    for t in texts:
        assert counter.count(t) == len(library.encode(t)), t


def test_count_tokens_rows(spark):
    got = token_count.count_tokens(frame(spark, [None, "", "héllo wörld", "héllo wörld", "NOID", "a " * 5000]), MODEL).collect()
    assert [(r.n_bytes, r.n_tokens) for r in got[:2]] == [(0, 0), (0, 0)]
    assert got[2].n_bytes == 13 and got[2][1:] == got[3][1:]
    assert got[4].doc_id is None and got[4].n_tokens > 0
    assert got[5].over_limit and not got[2].over_limit
    assert token_count.count_tokens(frame(spark, []), MODEL).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def valid(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and pii.luhn(digits)
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), m.end(), k) for k, e in BASE.items() for m in re.finditer(e, text) if valid(k, m[0])]
    return sorted(found, key=lambda s: (s[0], list(BASE).index(s[2])))


def test_base_spans_equal_the_expressions():
    finder, rng = pii.Finder(), random.Random(5)
    parts = list("0123456789" * 2 + "..-- ()++@@ab.İé ") + ["4111 1111 1111 1111", "10.0.0.1", "a@b.co", "account ", "iban: "]
    for _ in range(5000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        assert [s for s in finder.spans(t) if s[2] in BASE] == base_spans(t), t


def test_method_adds_spans_and_redacts():
    text = "See https://ex.org/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account number 12-345678, not accounts 999999; a@b.co"
    spans = pii.Finder().spans(text)
    got = {k: text[a:b] for a, b, k in spans}
    assert got["url"] == "https://ex.org/a?b=1" and got["iban"] == "DE89 3704 0044 0532 0130 00" and got["account"] == "12-345678"
    assert "[EMAIL]" in pii.redact(text, spans) and "a@b.co" not in pii.redact(text, spans)
    assert pii.Finder().spans("Clean text without any of it.") == []


def test_find_pii_rows(spark):
    got = pii.find_pii(frame(spark, [None, "", "mail a@b.co", "NOID", "x " * 20000 + "+1 (017) 555-7713"])).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert got[0].base_sha256 == got[1].base_sha256 == empty and got[0].spans == ""
    assert got[2].n_email == 1 and got[2].spans == "email:5:11"
    assert got[3].doc_id is None and got[4].n_phone == 1
    assert pii.find_pii(frame(spark, [])).count() == 0
    docs = frame(spark, [None, "mail a@b.co", "clean"])
    out = pii.redact_documents(docs).collect()
    assert pii.redact_documents(docs).columns == docs.columns
    assert [r.text for r in out] == [None, "mail [EMAIL]", "clean"] and out[1].n_chars == 12


def test_very_long_digit_runs(spark):
    """Numbers of more digits than Python reads as one are parsed like others."""
    zeros, n = "0" * 10000, 10000
    texts = [zeros + ".1.1.1", "1.2.3." + zeros + "255", "1.2." + "9" * n + ".4", zeros, "4111 " * 3000, "+" + zeros, "+1 " + "(0) " * 4000 + "5", zeros + ".1.1.1 a@b.co"]
    finder = pii.Finder()
    value = lambda p: int(p.lstrip("0")[:4] or "0")
    for t in texts:
        want = [(m.start(), m.end(), "ip") for m in re.finditer(BASE["ip"], t) if all(value(p) <= 255 for p in m[0].split("."))]
        assert [s for s in finder.spans(t) if s[2] == "ip"] == want
        assert [s for s in finder.spans(t) if s[2] in ("card", "phone")] == [s for s in base_spans(re.sub(r"[.]", " a ", t)) if s[2] in ("card", "phone") and "." not in t]
    assert [r.n_ip for r in pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()] == [1, 1, 0, 0, 0, 0, 0, 1]
    assert [r.text for r in pii.redact_documents(frame(spark, [texts[0], texts[7]])).collect()] == ["[IP]", "[IP] [EMAIL]"]


def test_licence_scan_against_plain_search():
    auto = license_scan.LicenseAutomaton(license_scan.TEMPLATES, license_scan.PHRASES, 3, 4)
    rng = random.Random(7)
    vocabulary = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "the", "under", "licensed", "x"]
    templates = [license_scan.words_of(t) for t in [*license_scan.TEMPLATES.values(), *license_scan.PHRASES]]
    for _ in range(400):
        words = [w.encode() for w in rng.choices(vocabulary, k=rng.randint(0, 30))]
        base, matches = auto.scan(words)
        want = sorted((i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == [w.encode() for w in p.split()])
        assert sorted(base) == want
        inside = lambda s, e: any(words[s:e] == t[i : i + e - s] for t in templates for i in range(len(t)))
        longest = [max((e - s for s in range(e) if inside(s, e)), default=0) for e in range(1, len(words) + 1)]
        ends = {e: n for e, n in enumerate(longest, 1) if n >= 3 and (e == len(words) or longest[e] <= n)}
        assert {m[1]: m[3] for m in matches} == ends


def test_licence_rows(spark):
    mit = license_scan.TEMPLATES["mit-text"]
    got = license_scan.scan_licenses(frame(spark, [None, "", "Released under the MIT License.", "intro words " + mit + " more", "NOID", mit[: len(mit) // 3]])).collect()
    assert (got[0].n_words, got[0].first_word, got[0].labels, got[0].score) == (0, None, "", 0.0)
    assert got[2].base_labels == "mit" and got[2].first_word == got[2].last_word == 3 and got[2].labels == "mit"
    assert got[3].labels == "mit-text" and got[3].n_base == 0 and got[3].score == 1.0
    assert got[5].labels == "" and 0.2 < got[5].score < 0.6
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0


def hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    doc, places, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(len(w), 13)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(doc) - n + 1) if w else ():
            if tuple(doc[i : i + n]) in windows:
                places |= set(range(i, i + n))
                found.add(str(item))
    return len(doc), len(places), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most, broadcast", [(4 << 20, 0), (0, 1 << 28), (0, 0)])
def test_contamination_against_plain_search(spark, most, broadcast):
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choices(["A", "b", "é", "c1"], k=n))
    items = [(i, text(rng.randint(0, 18))) for i in range(12)] + [(50, None), (51, "!!"), (None, "a b")]
    texts = [text(rng.randint(0, 60)) for _ in range(25)] + [None, "", "?!", items[3][1] + " tail", "NOID", "a b c1 é " * 600]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(frame(spark, texts), bench, max_set_bytes=most, max_broadcast_bytes=broadcast, carry=("score",)).collect()
    want = [hits(t if t != "NOID" else "some text", [i for i in items if i[0] is not None]) for t in texts]
    assert sorted((r.n_words, r.n_hit, r.items_sha256) for r in got) == sorted(want)
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)


def test_decontaminate_keeps_columns_and_clean_rows(spark):
    passage = " ".join(f"word{i}" for i in range(20))
    docs = frame(spark, ["Keep, me: whole.", f"Start... {passage}! End.", None, ""])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {0: "Keep, me: whole.", 1: "Start... End.", 2: None, 3: ""}
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == 4
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_every_quoted_copy_of_a_licence_has_its_span(spark):
    mit = license_scan.TEMPLATES["mit-text"]
    n = len(license_scan.words_of(mit))
    short = " ".join(mit.split()[:-3])
    apart = ("between these copies stand words of nothing else " * 3).strip()
    gap = len(apart.split())
    texts = [" ".join([mit, apart] * 3), f"{mit} {mit}", f"{short} {mit}", f"{mit} {apart} {mit[: len(mit) // 3]}"]
    got = [r.spans.split(",") for r in license_scan.scan_licenses(frame(spark, texts)).collect()]
    assert got[0] == [f"mit-text:{i * (n + gap)}:{i * (n + gap) + n}" for i in range(3)]
    assert got[1] == [f"mit-text:0:{n}", f"mit-text:{n}:{2 * n}"]
    assert got[2] == [f"mit-text:0:{n - 3}", f"mit-text:{n - 3}:{2 * n - 3}"]
    assert got[3] == [f"mit-text:0:{n}"]


def test_chains_cover_templates_that_edits_interrupt():
    """Against plain search: of a template cut into pieces, those in order and near enough count, each word once."""
    templates = {"one": " ".join(f"a{i}" for i in range(40)), "two": " ".join(f"b{i}" for i in range(30))}
    auto = license_scan.LicenseAutomaton(templates, {}, 3, 4)
    one, two = (t.split() for t in templates.values())
    noise = [f"x{i}" for i in range(50)]

    def spans(words, least=0.8):
        return auto.chains(auto.scan([w.encode() for w in words])[1], least)

    rng = random.Random(31)
    for _ in range(300):
        words, want, at = noise[: rng.randint(0, 9)], 0, 0
        begin = len(words)
        while at < 40:  # pieces of one template, each followed by a few words that replace others or are put between
            size = min(rng.randint(3, 15), 40 - at)
            words = words + one[at : at + size]
            want += size
            end, at = len(words), at + size
            if at < 40:
                words, at = words + noise[20 : 20 + rng.randint(1, 4)], at + rng.choice((0, 1, 4))
                if 40 - at < 3:
                    break
        [(label, s, e, coverage)] = spans(words + noise[40:])
        assert (label, s, e) == ("one", begin, end) and abs(coverage - want / 40) < 1e-9
    far = one[:20] + noise[:5] + one[20:]
    assert [(x[0], x[3]) for x in spans(far)] == [("one", 0.5)]
    mixed = two + one[10:13] + noise[:10] + one
    assert [(x[0], x[1], x[2]) for x in spans(mixed)] == [("one", 43, 83), ("two", 0, 30)]
    assert spans(one[20:] + one[:20])[0][3] == 0.5 and spans(noise) == []


def test_cue_words_in_any_case():
    text = "Account Number: 12345678, ACCOUNT NO. AB-1234567 and account number: 87654321"
    assert [text[a:b] for a, b, k in pii.Finder().spans(text) if k == "account"] == ["12345678", "AB-1234567", "87654321"]
