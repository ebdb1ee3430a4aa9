"""Quality rules with n-gram perplexity under a modified Kneser-Ney model.

Spark counts words by language, then character n-grams of the distinct words, then the
continuation counts and context sums of every order; joins give interpolated probabilities
and back-off weights. Nothing is folded: the model holds every n-gram. As it counts all texts,
it has each n-gram of a text at the highest order. Scoring tasks know the most frequent ones
by themselves, as a sorted array of hashes; the others go, counted by text, through a join. A document's
perplexity is per word, over words of two characters or more: marks and bullets that stand alone are
easy to foretell and would hide what stands between them. Each language has a band around its densest
half, as wide as that half asks, and documents above or below it are rejected, beside those that fail
the plain rules.
"""

from __future__ import annotations

import uuid
from collections import Counter
from operator import itemgetter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import map_texts, materialize, table

ORDER = 4
#: Scoring tasks know at most so many n-grams, the most frequent ones; all others are joined.
HOT_GRAMS = 1 << 16
#: A language's band lies around the shortest interval that holds half of its documents, BAND times as wide and BAND_FLOOR nats to
#: each side at least, more where fewer documents than BAND_FEW tell little. Junk of less than half, above or below, doesn't widen it.
BAND, BAND_FLOOR, BAND_FEW = 8.0, 1.0, 20
CACHE_ENTRIES = 500_000
#: Characters of text whose words are looked up together.
TOGETHER = 1 << 20
_START, _END = "\x02", "\x03"
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_NO_LANG = "und"


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, word, c): every word of every text, counted by language; a null language is 'und'."""
    words = F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+")
    flat = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANG)).alias("lang"), F.explode(words).alias("word"))
    return flat.filter("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("c"))


def level_probabilities(counts: DataFrame, order: int = ORDER) -> list[tuple[DataFrame, DataFrame]]:
    """Of each order from 1: (lang, g, c, p) of every n-gram, and (lang, ctx, total, value) with each context's back-off weight.

    Words are padded with order - 1 start marks and an end mark. Discounts D1, D2, D3+ of an order come
    from its counts of counts, by language; where those leave a discount undefined it is n / (n + 1) of it.
    """
    marked = F.concat(F.lit(_START * (order - 1)), "word", F.lit(_END))
    grams = counts.select("lang", "c", marked.alias("m"))
    grams = grams.select("lang", "c", F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - (order - 1)), lambda i: F.col("m").substr(i, F.lit(order)))).alias("g"))
    level = materialize(grams.groupBy("lang", "g").agg(F.sum("c").alias("c")), "grams")
    levels = {order: level}
    for k in range(order - 1, 0, -1):  # below the highest order a count is the number of distinct characters before it
        level = level.groupBy("lang", F.substring("g", 2, k).alias("g")).agg(F.count("*").alias("c"))
        levels[k] = level = materialize(level, f"grams{k}")
    lower, out = None, []
    for k in range(1, order + 1):
        now = levels[k]
        coc = now.groupBy("lang").agg(*[F.sum(F.when(F.col("c") == n, 1).otherwise(0)).alias(f"n{n}") for n in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2") + 1e-9)
        d = [F.lit(n) - (n + 1) * y * F.col(f"n{n + 1}") / F.col(f"n{n}") for n in (1, 2, 3)]
        d = [F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{n}") > 0) & (x > 0), F.least(x, F.lit(n - 0.01))).otherwise(F.lit(n / (n + 1))) for n, x in zip((1, 2, 3), d, strict=True)]
        coc = coc.select("lang", *[x.alias(f"d{n}") for n, x in zip((1, 2, 3), d, strict=True)])
        ctx = F.substring("g", 1, k - 1) if k > 1 else F.lit("")
        here = now.withColumn("ctx", ctx).join(F.broadcast(coc), "lang")  # one row a language
        disc = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        here = here.withColumn("kept", F.col("c") - disc).withColumn("disc", disc)
        ctxs = here.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("disc").alias("left"), F.count("*").alias("kinds"))
        here = here.join(ctxs, ["lang", "ctx"])
        if lower is None:  # characters never seen share what the discounts leave, as one more character
            p = (F.col("kept") + F.col("left") / (F.col("kinds") + 1)) / F.col("total")
            here = here.withColumn("p", p)
        else:
            here = here.withColumn("s", F.substring("g", 2, k - 1)).join(lower, ["lang", "s"])
            here = here.withColumn("p", F.col("kept") / F.col("total") + F.col("left") / F.col("total") * F.col("lp"))
        back = ctxs.withColumn("value", F.col("left") / F.col("total") if k > 1 else F.col("left") / F.col("total") / (F.col("kinds") + 1))
        here = materialize(here.select("lang", "g", "c", "p"), f"probs{k}")
        lower = here.select("lang", F.col("g").alias("s"), F.col("p").alias("lp"))
        out.append((here, back))
    return out


def hot_grams(probs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes and log probabilities of the most frequent n-grams, and the count from which n-grams are among them."""
    step = F.floor(F.log2("c") * 8)
    at, held = None, 0
    for r in probs.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect():  # at most 8 rows a bit of a count
        held += r.n
        if held > most:
            break
        at = r.least
    if at is None:
        return np.zeros(0, np.uint64), np.zeros(0), 1 << 62
    got = probs.filter(F.col("c") >= at).select(F.xxhash64("lang", "g").alias("h"), F.log("p").alias("lp")).toArrow()
    hashes, values = got.column("h").to_numpy().view(np.uint64), got.column("lp").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], values[order], at


class TextScorer:
    """Sums the log probabilities of the n-grams it knows, in sorted hash arrays, and counts the others; remembers words.

    Of each word it keeps: what the word adds to a text's sum and to its number of words, its other n-grams, and the same sum and n-grams
    for a text of short words only. Words of one character add nothing but there.
    """

    def __init__(self, hashes: np.ndarray, values: np.ndarray, order: int):
        import xxhash

        self.hashes, self.values, self.order, self.digest = hashes, values, order, xxhash.xxh64_intdigest
        #: 16 bits a character, given out as characters appear; 0: none yet
        self.numbers, self.alphabet = np.zeros(0x110000, dtype=np.uint16), 0
        self.grams: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.words: dict[str, dict[bytes, tuple]] = {}

    def _look(self, lang: str, grams: list[str]) -> np.ndarray:
        """Log probabilities of n-grams, not a number where it knows none."""
        seed = self.digest(lang.encode(), seed=42)
        hashes = np.fromiter((self.digest(g.encode(), seed=seed) for g in grams), np.uint64, len(grams))
        if not len(self.hashes):
            return np.full(len(grams), np.nan)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], np.nan)

    def _packed(self, chars: np.ndarray, places: np.ndarray) -> np.ndarray | None:
        """Each n-gram as one whole number of 64 bits; None if characters or orders are too many for that."""
        if self.order > 4:
            return None
        new = np.flatnonzero(np.bincount(chars, minlength=0x110000)[: len(self.numbers)] > 0)
        new = new[self.numbers[new] == 0]
        if self.alphabet + len(new) > 0xFFFF:
            return None
        self.numbers[new] = np.arange(self.alphabet + 1, self.alphabet + 1 + len(new), dtype=np.uint16)
        self.alphabet += len(new)
        numbers = self.numbers[chars].astype(np.uint64)
        packed = numbers[places]
        for k in range(1, self.order):
            packed = packed << np.uint64(16) | numbers[places + k]
        return packed

    def learn(self, lang: str, words: list[bytes]) -> dict[bytes, tuple]:
        """What to keep of each word; the n-grams of all are looked up together."""
        n, texts = self.order, [w.decode("utf-8", "replace") for w in words]
        lead = _START * (n - 1)
        joined = "".join([f"{lead}{t}{_END}" for t in texts])
        chars = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + n)
        inside = np.ones(len(chars), dtype=bool)
        for k in range(1, n):
            inside[ends - k] = False
        places = np.flatnonzero(inside)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        packed = self._packed(chars, places)
        if packed is None:
            kinds: dict[str, int] = {}
            at = np.fromiter((kinds.setdefault(joined[i : i + n], len(kinds)) for i in places.tolist()), np.int64, len(places))
            found = self._look(lang, list(kinds))[at]
        else:
            kinds, first, at = np.unique(packed, return_index=True, return_inverse=True)
            keys, values = self.grams.get(lang, (np.zeros(0, np.uint64), np.zeros(0)))
            if len(keys) >= CACHE_ENTRIES:
                keys, values = keys[:0], values[:0]
            there = np.minimum(np.searchsorted(keys, kinds), max(0, len(keys) - 1))
            known = keys[there] == kinds if len(keys) else np.zeros(len(kinds), dtype=bool)
            if not known.all():
                new = np.flatnonzero(~known)
                keys = np.concatenate([keys, kinds[new]])
                values = np.concatenate([values, self._look(lang, [joined[i : i + n] for i in places[first[new]].tolist()])])
                order = np.argsort(keys)
                keys, values = keys[order], values[order]
            self.grams[lang] = keys, values
            found = values[np.searchsorted(keys, kinds)][at]
        cold = np.isnan(found)
        totals = np.add.reduceat(np.where(cold, 0.0, found), firsts).tolist()
        out = {w: (t, 1, (), t, ()) if size > 1 else (0.0, 0, (), t, ()) for w, t, size in zip(words, totals, sizes.tolist(), strict=True)}
        for i in np.flatnonzero(np.logical_or.reduceat(cold, firsts)).tolist():
            mine = range(firsts[i], firsts[i] + sizes[i] + 1)
            others = tuple(joined[places[j] : places[j] + n] for j in mine if cold[j])
            out[words[i]] = (totals[i], 1, others, totals[i], others) if sizes[i] > 1 else (0.0, 0, (), totals[i], others)
        return out

    def texts(self, batch: list[tuple[str, list[bytes]]]) -> list[tuple[float, int, dict[str, int]]]:
        """Of each text (lang, words): log probability of the known n-grams of words of two characters or more, number of these words,
        and how often each other n-gram occurs in them; of all words if none is so long. New words are learnt for the whole batch at once."""
        by_lang: dict[str, set[bytes]] = {}
        for lang, words in batch:
            by_lang.setdefault(lang, set()).update(words)
        known = {}
        for lang, words in by_lang.items():
            memo = self.words.setdefault(lang, {})
            if len(memo) >= CACHE_ENTRIES:
                memo.clear()
            new = list(words.difference(memo))
            fresh = self.learn(lang, new) if new else {}
            long = {w: x for w, x in fresh.items() if len(w) > 64}
            memo.update(fresh if not long else {w: x for w, x in fresh.items() if len(w) <= 64})
            known[lang] = memo if not long else memo | long
        out = []
        for lang, words in batch:
            found = list(map(known[lang].__getitem__, words))
            n = sum(map(_SCORED, found))
            total, cold = (sum(map(_SUM, found)), _COLD) if n else (sum(map(_WHOLE_SUM, found)), _WHOLE_COLD)
            others: dict[str, int] = {}
            for x in filter(cold, found):
                for g in cold(x):
                    others[g] = others.get(g, 0) + 1
            out.append((total, n or len(found), others))
        return out


_SUM, _SCORED, _COLD, _WHOLE_SUM, _WHOLE_COLD = map(itemgetter, range(5))


def base_measures(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return chars, symbols, len(lines) - len(set(lines)), repeated


_scorers: dict[str, TextScorer] = {}


def score_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, band: float = BAND, floor: float = BAND_FLOOR, hot: int = HOT_GRAMS) -> DataFrame:
    """Plain rules and perplexity band for every whole text.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    lang, log_perplexity (nats a word), one row per row of ``docs``. Null and empty texts have no words and fail the plain
    rules. The model counts all texts; bands come from all documents that pass the plain rules; a
    language of which no document does needs no band.
    """
    spark = docs.sparkSession
    probs = level_probabilities(materialize(word_counts(docs, text_col, lang_col), "words"), order)[-1][0]
    hashes, values, known_from = hot_grams(probs, hot)
    model = spark.sparkContext.broadcast((hashes, values))  # bounded by HOT_GRAMS: 16 bytes each
    model_id = uuid.uuid4().hex
    with_lang = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(_NO_LANG)).alias("lang"), F.monotonically_increasing_id().alias("row"))
    packed = with_lang.select("id", "row", F.concat(F.length("lang").cast("string"), F.lit(":"), "lang", F.coalesce("text", F.lit(""))).alias("both"), "lang")

    def compute(texts: list[str]) -> list:
        if model_id not in _scorers:
            _scorers.clear()
            _scorers[model_id] = TextScorer(*model.value, order)
        scorer, rows, held, size = _scorers[model_id], [], [], 0

        def flush() -> None:
            scored = scorer.texts([(lang, words) for lang, _, words in held])
            for (_, text, words), (total, n, others) in zip(held, scored, strict=True):
                rows.append((len(words), *base_measures(text, words), total, n, list(others), list(others.values())))
            held.clear()

        for both in texts:
            length, _, rest = both.partition(":")
            lang, text = rest[: int(length)], rest[int(length) :]
            held.append((lang, text, text.encode().split()))
            size += len(text)
            if size >= TOGETHER:
                flush()
                size = 0
        flush()
        return [[r[i] for r in rows] for i in range(9)]

    fields = [(n, "long") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("known", "double"), ("n_scored", "long"), ("others", "array<string>"), ("times", "array<long>")]
    measured = materialize(map_texts(packed, compute, fields, "id", "both", carry=("lang", "row")), "measured")
    others = measured.select("row", "lang", F.explode(F.arrays_zip("others", "times")).alias("o")).select("row", "lang", F.col("o.others").alias("g"), F.col("o.times").alias("times"))
    rest = others.join(probs.filter(F.col("c") < known_from).select("lang", "g", F.log("p").alias("lp")), ["lang", "g"])
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.col("lp")).alias("rest"))
    total = F.col("known") + F.coalesce("rest", F.lit(0.0))
    log_perplexity = F.when(F.col("n_scored") > 0, F.round(-total / F.col("n_scored"), 9)).otherwise(F.lit(0.0))
    scored = measured.drop("others", "times").join(rest, "row", "left").withColumn("log_perplexity", log_perplexity).drop("row", "known", "rest", "n_scored")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = materialize(scored.withColumn("base_failed", failed), "scored")
    steps = 40
    # exact quantiles of perplexities to four places: counts of these are few, and the same in every run
    near = scored.filter(~F.col("base_failed")).groupBy("lang", F.round("log_perplexity", 4).alias("v")).agg(F.count("*").alias("times"))
    q = F.percentile("v", [i / steps for i in range(steps + 1)], F.col("times"))
    bands = near.groupBy("lang").agg(q.alias("q"), F.sum("times").alias("n"))
    halves = F.transform(F.sequence(F.lit(0), F.lit(steps // 2)), lambda i: F.struct((F.get("q", i + steps // 2) - F.get("q", i)).alias("width"), F.get("q", i).alias("low")))
    bands = bands.select("n", F.array_min(halves).alias("half"), "lang")
    middle = F.col("half.low") + F.col("half.width") / 2
    half: Column = F.greatest(F.lit(floor) * (1 + F.lit(BAND_FEW) / F.col("n")), F.lit(band) * F.col("half.width") / 2)
    bands = bands.select("lang", (middle - half).alias("low"), (middle + half).alias("high"))
    judged = scored.join(F.broadcast(bands), "lang", "left")  # one row a language
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(table(spark, sf_dir, "documents"))
