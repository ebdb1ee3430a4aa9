"""Licence scans by a generalised suffix automaton of licence words.

The words of all templates and base phrases form one automaton. A text is streamed through it
word by word; at each word the state gives the longest run of words, ending there, that stands
in some template (matching statistics). Long matches are chained, in template order and with
small gaps, into the spans that cover most of a template; coverage is the covered share of its words.
Base phrases are the states reached by whole phrases.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lorespan.llm.common import map_texts, table
from lorespan.llm.license_texts import TEMPLATES

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    """Words of a text, A to Z in lower case, as UTF-8."""
    return _WORD.findall(text.encode().lower())


class LicenseAutomaton:
    """Generalised suffix automaton over template words."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str], min_match: int, max_gap: int):
        self.min_match, self.max_gap = min_match, max_gap
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.labels = list(templates)
        self.sizes = [len(words_of(t)) for t in templates.values()]
        #: per state: (template, end) places of its words; filled for first visits, carried up the links
        self.places: list[set[tuple[int, int]]] = [set()]
        for t, text in enumerate(templates.values()):
            last = 0
            for end, word in enumerate(words_of(text), 1):
                last = self._extend(last, word)
                self.places[last].add((t, end))
        phrase_words = [(words_of(p), label) for p, label in phrases.items()]
        for words, _ in phrase_words:
            last = 0
            for word in words:
                last = self._extend(last, word)
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            self.places[self.link[v]] |= self.places[v]
        #: per state: phrases that end where it ends, as (words, label); the current length decides which stand
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        whole = {}
        for words, label in phrase_words:
            v = 0
            for word in words:
                v = self.next[v][word]
            whole.setdefault(v, []).append((len(words), label))
        for v in sorted(range(1, len(self.next)), key=lambda v: self.length[v]):
            self.phrases[v] = self.phrases[self.link[v]] + tuple(whole.get(v, ()))

    def _extend(self, last: int, word: bytes) -> int:
        """Append a word after state ``last``; texts share states, so it may be there already."""
        nxt, link, length = self.next, self.link, self.length
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = self._state(length[last] + 1, {})
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        twin = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def _state(self, length: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.places.append(set())
        return len(self.next) - 1

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Base places (start, label), and maximal matches (start, end, state, length) of at least ``min_match`` words."""
        nxt, link, length, phrases, least = self.next, self.link, self.length, self.phrases, self.min_match
        root = nxt[0]
        base, matches = [], []
        v = size = 0
        for i, word in enumerate(words):
            if not v:  # most words stand in no template
                v = root.get(word, 0)
                size = 1 if v else 0
                if v and phrases[v]:
                    base += [(i + 1 - n, label) for n, label in phrases[v] if n <= size]
                continue
            before, had = v, size
            while v and word not in nxt[v]:
                v = link[v]
                size = length[v]
            u = nxt[v].get(word)
            if u is None:
                v = size = 0
            else:
                v, size = u, size + 1
            if size <= had and had >= least:  # the match that ended at the word before could not grow
                matches.append((i - had, i, before, had))
            if v and phrases[v]:
                base += [(i + 1 - n, label) for n, label in phrases[v] if n <= size]
        if size >= least:
            matches.append((len(words) - size, len(words), v, size))
        return base, matches

    def chains(self, matches: list[tuple[int, int, int, int]], min_coverage: float = 0.8) -> list[tuple[str, int, int, float]]:
        """Spans (label, start, end, coverage) of each template: chains of matches that cover most, which don't overlap.

        A chain goes forward in text and template, with gaps of ``max_gap`` words at most in either; of words that
        two of its matches share in text or template, one counts. The best chain of a template is taken first,
        then the best of the matches outside it, down to ``min_coverage``; the best of all is returned even if it covers less.
        """
        anchors: dict[int, list[tuple[int, int, int, int]]] = {}  # template -> (start, end, template start, template end)
        for start, end, state, size in matches:
            for t, at in self.places[state]:
                anchors.setdefault(t, []).append((start, end, at - size, at))
        out = []
        for t, found in anchors.items():
            least = min_coverage * self.sizes[t]
            chained = self._best_chains(sorted(found))
            free: list[tuple[int, int]] = []
            for covered, start, end in sorted(chained, key=lambda c: (-c[0], c[1], c[2])):
                if free and covered < least:
                    break
                if all(end <= a or start >= b for a, b in free):
                    free.append((start, end))
                    out.append((self.labels[t], start, end, min(1.0, covered / self.sizes[t])))
        return sorted(out)

    def _best_chains(self, anchors: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
        """(covered words, start, end) of the best chain that ends in each anchor."""
        best: list[tuple[int, int]] = []  # covered words, start
        recent: list[int] = []  # anchors that end near enough to be continued
        for j, (start, end, low, high) in enumerate(anchors):
            covered, begun = end - start, start
            recent = [i for i in recent if start - anchors[i][1] <= self.max_gap]
            for i in recent:
                before_start, before_end, before_low, before_high = anchors[i]
                if end > before_end and high > before_high and low - before_high <= self.max_gap and start > before_start and low > before_low:
                    fresh = min(end - max(start, before_end), high - max(low, before_high))
                    if fresh > 0 and best[i][0] + fresh > covered:
                        covered, begun = best[i][0] + fresh, best[i][1]
            best.append((covered, begun))
            recent.append(j)
        return [(c, s, anchors[j][1]) for j, (c, s) in enumerate(best)]


_automata: dict[tuple, LicenseAutomaton] = {}


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    min_match: int = 3,
    max_gap: int = 4,
    min_coverage: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licences named in, or quoted by, every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels (with those of templates
    covered by ``min_coverage`` or more), score (1 with a base place, else the best coverage) and spans
    (label:start:end of every covered template span in words, end exclusive), one row per row of ``docs``. Null,
    empty and wordless texts have no places: counts 0, first and last null, labels empty, score 0. The
    templates are parameters of the job, not data, and are built into the automaton once in each worker.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    key = (tuple(templates.items()), tuple(phrases.items()), min_match, max_gap)

    def compute(texts: list[str]) -> list:
        if key not in _automata:
            _automata[key] = LicenseAutomaton(templates, phrases, min_match, max_gap)
        automaton, rows = _automata[key], []
        for text in texts:
            words = words_of(text)
            base, matches = automaton.scan(words)
            chained = automaton.chains(matches, min_coverage)
            spans = [c for c in chained if c[3] >= min_coverage]
            starts, labels = [b[0] for b in base], {b[1] for b in base}
            score = 1.0 if base else max((c[3] for c in chained), default=0.0)
            rows.append(
                (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {c[0] for c in spans})), score, ",".join(f"{c[0]}:{c[1]}:{c[2]}" for c in spans))
            )
        return [[r[i] for r in rows] for i in range(8)]

    fields = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", "string")]
    return map_texts(docs, compute, fields, id_col, text_col)


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
