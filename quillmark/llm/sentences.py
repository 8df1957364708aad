"""Sentence boundaries across languages and scripts, by a hidden-event n-gram language model.

Between two words there may be a hidden event, the boundary. The model knows, for the words around a possible boundary,
how often it happens after them (P(E | word before last, last word, mark), backed off from the pair of words to the word, its
shape and the mark) and what follows with and without it (P(next | E), P(next | no E, last word, mark)). Its counts are taken
over all documents. Nothing is labelled by hand: the ends of paragraphs and texts show events, and lower-case letters or
commas after a mark show their absence; expectation maximisation fills in the rest. Forward-backward posteriors over each
text then decide, with a further probability for the length of a sentence in words. Thai, which has blanks but neither
marks nor case, and texts without marks at line ends go through the same model: there the blank or line break is the mark.
Where no mark stands for STRETCH words (BARE_STRETCH in a text without any), every blank may hide the event: then the last word before and the first word after
decide, by how often each ends and begins what is known to end and begin, against how often it stands elsewhere.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.session import materialize, read_table, spread

#: EM rounds.
ROUNDS = 3
#: Words without any possible boundary from which on every blank is one, in texts with end marks and in those without any; the
#: share of blanks that are, before the words around are known; fields in which the counts of words are kept, whatever the data.
STRETCH, BARE_STRETCH, BLANK_SHARE, FIELDS = 100, 20, 0.05, 1 << 18
#: Prior odds, beyond those of any word, that a listed abbreviation ends no sentence.
PRIOR = 40.0

#: Common abbreviations of the languages served, a prior the counts can overrule.
ABBREVIATIONS = frozenset(
    "approx art bd ca cf ch col dept dev dr ed eds e.g eq eqs est etal fig figs gen i.e jr lt mr mrs ms no nos nr op p pp prof ref refs resp sect sr st suppl tab tabs viz vol vols vs "
    "abb bzw d h evtl ggf inkl min sog tel usf vgl z zzgl "
    "aprox av dra ej fig núm pág sra srta "
    "c.-à-d cf env ex m mm mme p "
    "г гг др ед ок проф рис см стр т табл тыс "
    "βλ εικ κ κα π.χ "
    "डॉ د ดร".split()
)
_DENSE_END = "。！？．｡"
#: The marks whose meaning depends on what follows, and end marks that Unicode's Sentence_Terminal lacks.
_LATIN_END, _MORE_END = ".!?‼⁇⁈⁉‽․", "…।॥།༎"
_END = "".join(sorted({chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000 and regex.match(r"\p{Sentence_Terminal}", chr(i))} | set(_LATIN_END + _MORE_END)))
#: Marks that end sentences whatever follows, with or without a blank.
_UNCASED_END = "".join(c for c in _END if c not in _LATIN_END + "…")
_CLOSE = "\"'”’»)]}）】』」〉》›＂＇］｝"
_QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", "‹": "›", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】"}
_BRACKETS = "(（[【"
_THAI, _LAO = "฀-๿", "຀-໿"
_DENSE = "぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
_GREEK = "Ͱ-Ͽἀ-῿"

_MARKER = r"(?:\[\d+(?:\s*[,;–-]\s*\d+)*\]|\(\d{1,3}(?:\s*[,;–-]\s*\d{1,3})*\)|[¹²³⁰-⁹]+(?:[,˒][¹²³⁰-⁹]+)*)"
#: A possible end: marks, closing quotes and brackets, and what follows of citation markers.
_MARK_RE = re.compile(
    rf"(?P<m>(?:[{re.escape(_END)}]+|(?<=[{_GREEK}]);))(?P<c>[{re.escape(_CLOSE)}]*)(?P<k>[ \t]*{_MARKER}|(?<=[^\W\d_][.!?…])\d{{1,3}}(?:[,–-]\d{{1,3}})*(?=\s|$)|)"
)
_PARAGRAPH = re.compile(r"[^\S\n\r]*(?:\r\n?|\n)(?:[^\S\n\r]*(?:\r\n?|\n))+\s*")
_THAI_BLANK = re.compile(rf"(?<=[{_THAI}{_LAO}\w)%”\"]) +(?=\S)")
_NEWLINE = re.compile(r"[^\S\n\r]*(?:\r\n?|\n)[^\S\n\r]*")
_BETWEEN = re.compile(r"(?<=\w)\s+(?=\w)")
_LAST = re.compile(r"\S+$")
#: The mark of a gap between two words where none stands.
BLANK = "·"
_IS_DENSE, _HAS_DENSE = re.compile(f"[{_DENSE}]").match, re.compile(f"[{_DENSE}]").search
_IS_THAI, _HAS_THAI = re.compile(f"[{_THAI}{_LAO}]").match, re.compile(f"[{_THAI}{_LAO}]").search
_BLANKS, _LINE, _TOKEN, _BREAK = re.compile(r"\s*").match, re.compile(r"[^\r\n]*").match, re.compile(r"\S*").match, re.compile(r"\s*(?:\r|\n)").match


def _lower_word(text: str, at: int) -> bool:
    """Whether a word in lower case throughout stands there, which begins no sentence; codes like mRNA9 and p53-like may."""
    end = at
    while end < len(text) and text[end].lower() != text[end].upper():
        end += 1
    if end == at or not text[at:end].islower():
        return False
    rest = text[end:end + 2]
    return not (rest[:1].isdigit() or rest[:1] == "-" and rest[1:].isdigit())


def shape(w: str) -> str:
    """The kind of a word: script, case and length class."""
    if not w:
        return "<>"
    c = w[0]
    if any(x.isdigit() for x in w):
        return "<9a>" if any(x.isalpha() for x in w) else "<9>"
    if not any(x.isalpha() for x in w):
        return "<.>"
    if _IS_DENSE(w[-1]):
        return "<dense>"
    if _IS_THAI(w[-1]):
        return "<thai>"
    if c.lower() == c.upper():
        return "<uncased>"
    if len(w) == 1:
        return "<A>" if c.isupper() else "<a>"
    if w.isupper():
        return "<AA>"
    return ("<Aa" if c.isupper() else "<aa") + ("+>" if len(w) > 6 else ">")


def _literal(w: str, most: int) -> str:
    """A word itself, if it is short enough to be a recurring one, else its shape."""
    if not w or any(x.isdigit() for x in w):
        return shape(w)
    if _IS_DENSE(w[-1]):
        return w
    if w[0].lower() == w[0].upper():
        return w[-30:]
    return w if len(w) <= most else shape(w)


def _next_kind(s: str) -> str:
    """The kind of what follows a possible boundary."""
    if not s:
        return "<end>"
    c = s[0]
    if c in ",;:%，；：、،؛–—" or c in _CLOSE.replace('"', ""):
        return "<,>"
    if c in "“„«「『‹《\"¿¡":
        return "<q>"
    if c in _BRACKETS:
        return "<(>"
    m = re.match(r"[^\s,;:.!?]+", s)
    w = m.group(0) if m else c
    if c.isalpha() and c.lower() == c.upper():
        return c if _IS_DENSE(c) else w[:30]
    return shape(w)


class Gap:
    """A possible boundary: where the sentence before would end, where the next would begin, and its context."""

    __slots__ = ("end", "start", "w2", "w1", "mark", "nxt", "label")

    def __init__(self, end, start, w2, w1, mark, nxt, label):
        self.end, self.start, self.w2, self.w1, self.mark, self.nxt, self.label = end, start, w2, w1, mark, nxt, label


def _enclosed(text: str) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """The spans inside quotes and brackets that close within their paragraph, and where the span closing at a place opened."""
    spans, opened_at = [], {}
    stack: list[tuple[str, int]] = []
    for m in re.finditer(r"[“”„«»「」『』‹›《》()（）\[\]【】\"]|\n\s*\n|\r\n\s*\r\n", text):
        c, at = m.group(0), m.start()
        if len(c) > 1:
            stack.clear()
        elif c == '"':
            if stack and any(o == '"' for o, _ in stack):
                while stack[-1][0] != '"':
                    stack.pop()
                _, a = stack.pop()
                spans.append((a, at))
                opened_at[at] = a
            elif at == 0 or not text[at - 1].isalnum() or (at + 1 < len(text) and text[at + 1].isalnum()):
                stack.append((c, at))
        elif stack and any(c in _QUOTES.get(o, "") for o, _ in stack):
            while c not in _QUOTES.get(stack[-1][0], ""):
                stack.pop()
            _, a = stack.pop()
            spans.append((a, at))
            opened_at[at] = a
        elif c in _QUOTES:
            stack.append((c, at))
    return sorted(spans), opened_at


def _words_before(text: str, at: int) -> tuple[str, str]:
    """The last two words before a place, without opening marks."""
    piece = text[max(0, at - 80):at].rstrip(" \t   ")
    if piece and _IS_DENSE(piece[-1]):
        return piece[-5:-2] or "<nl>", piece[-2:]
    m = _LAST.search(piece)
    w1 = m.group(0) if m else ""
    rest = piece[: m.start()] if m else ""
    if "\n" in rest[-3:] or not rest.strip():
        w2 = "<nl>"
    else:
        m2 = _LAST.search(rest.rstrip())
        w2 = m2.group(0) if m2 else "<nl>"
    if not w1.isascii() or "." in w1 or "?" in w1 or "!" in w1:  # a sentence may follow another without a blank
        w1 = re.split(r"(?<=[^\W_]{2}[.!?])(?=[^\W\d_a-z])", w1)[-1]
    strip = "(\"“„«¿¡'‘[「『（—-"
    return w2.strip(strip).rstrip(",;:") or "<.>", w1.lstrip(strip).rstrip(_CLOSE + "".join(_END)) or "<.>"


def _bare_mark(text: str, at: int) -> str:
    """The kind of a gap at which no mark stands, by the script before it."""
    if _HAS_THAI(text[max(0, at - 12):at]):
        return "TH"
    return "NLd" if _IS_DENSE(text[at - 1:at]) else "NL"


def group(w1: str, mark: str) -> str:
    """The script a context belongs to; what begins a sentence is compared within one."""
    if mark[0] in "。！？．｡" or w1 == "<dense>" or _IS_DENSE(w1[-1]):
        return "dense"
    if mark == "TH" or _IS_THAI(w1[-1]):
        return "thai"
    c = next((c for c in w1 if c.isalpha()), "a")
    if mark[0] in _UNCASED_END or (not w1.startswith("<") and c.lower() == c.upper()):
        return "uncased"
    return "cased"


def gaps(text: str) -> list[Gap]:
    """The possible boundaries of a text, in order. Those inside quotes and brackets are none."""
    n = len(text)
    spans, opened_at = _enclosed(text)
    starts = [a for a, _ in spans]
    ends = list(accumulate((b for _, b in spans), max))  # the furthest end of the spans up to each

    def inside(at: int) -> bool:
        k = bisect_left(starts, at)
        return k > 0 and at < ends[k - 1]

    found: dict[int, Gap] = {}
    bare = _MARK_RE.search(text) is None
    paragraphs = {m.start(): m.end() for m in _PARAGRAPH.finditer(text)}
    for m in _MARK_RE.finditer(text):
        first, end = m.start("m"), m.end()
        if first == 0 and not m.group("c") or inside(first) and not (m.group("c") and not inside(m.end("c") - 1 + 1)):
            continue
        if inside(end) or first >= 1 and inside(first) and not m.group("c"):
            continue
        mark, close = m.group("m"), m.group("c")
        after = _BLANKS(text, end)
        start = after.end()
        blank = after.group(0)
        label: int | None = None
        nxt = _next_kind(text[start:start + 40])
        if start >= n or blank.count("\n") > 1 or blank.count("\r") > 1 and "\n" not in blank:
            label = 1
        if not blank and start < n:
            dense = mark[-1] in _DENSE_END or _IS_DENSE(text[start]) is not None or mark in ("……", "…") and _HAS_DENSE(text[max(0, first - 2):first]) is not None
            two = text[start:start + 2]
            opens = two[:1] in "“„«¿¡「『" or two[:1].isupper() and (len(two) < 2 or not two[1:].isdigit())
            if not dense and mark[-1] not in _UNCASED_END and not (opens and (first == 0 or text[first - 1] not in _END)):
                continue
            if not dense and re.match(r"[A-Z]\.", two) and text[first - 1:first].isupper():
                continue
        if label is None and (nxt == "<,>" or (_lower_word(text, start) and mark[-1] not in _UNCASED_END and not m.group("k").strip())):
            label = 0
        w2, w1 = _words_before(text, first)
        kind = mark if len(mark) == 1 else "…" if set(mark) <= {"…", "."} else mark[-1]
        if close:
            opened = opened_at.get(m.end("c") - 1)
            if opened is not None:
                lead = text[:opened].rstrip()
                initial = not lead or lead[-1] in _END or lead[-1] in _CLOSE and len(lead) > 1 and lead[-2] in _END or "\n" in text[len(lead):opened] or lead[-1] == ";" and text[max(0, len(lead) - 2)] > "Ͱ"
                bracket = text[opened] in _BRACKETS
                kind += ("(" if bracket else "“") + ("0" if initial else "1")
            else:
                kind += ")"
        found[end] = Gap(end, start, w2, w1, kind, nxt, label)
    # line breaks without a mark before them
    lines = [0, *[m.end() for m in re.finditer(r"\r\n?|\n", text)], n]
    for m in _NEWLINE.finditer(text):
        at, start = m.start(), m.end()
        if at in found or at == 0 or start >= n or inside(at):
            continue
        if m.start() in paragraphs or _BREAK(text[start:start + 3]):
            # a paragraph ends whatever stands before it
            p = _BLANKS(text, at)
            if p.end() < n and at not in found:
                w2, w1 = _words_before(text, at)
                found[at] = Gap(at, p.end(), w2, w1, _bare_mark(text, at), _next_kind(text[p.end():p.end() + 40]), 1)
            continue
        if any(e <= at and g.start >= start for e, g in ((e, found[e]) for e in range(max(0, at - 3), at + 1) if e in found)):
            continue
        lo = text.rfind("\n", 0, at) + 1
        line = text[lo:at].strip()
        before = text[:lo].rstrip()
        hi = _LINE(text, start).end()
        following = text[start:hi]
        word = _TOKEN(following).group(0)
        w2, w1 = _words_before(text, at)
        nxt = _next_kind(text[start:start + 40])
        opens = not before or before[-1] in _END + _CLOSE + "0123456789;" + "".join("¹²³⁰⁴⁵⁶⁷⁸⁹") or text[len(before):lo].count("\n") > 1
        dense = _IS_DENSE(text[at - 1]) is not None or _IS_DENSE(text[start]) is not None
        heading = opens and line and len(line.split()) <= 8 and len(line) <= 80 and not _lower_word(line, 0) and not _lower_word(text, start) and line[-1] not in ",;:-–—"
        block = re.split(r"\r?\n[^\S\n]*\r?\n", text[start:start + 400], maxsplit=1)[0]
        longest = max((len(x) for x in re.split(r"[\r\n]+", block)[:3]), default=0)
        filled = len(line) + 1 + len(word) > 0.85 * longest
        label = 0 if _lower_word(text, start) and not dense or nxt == "<,>" or following[:1] in "…" or line[-1:] in ",;-–—" else None
        thai = _HAS_THAI(line) is not None
        mark = "TH" if thai else "NLd" if dense else "NLh" if heading and not filled else "NLb" if bare and not filled else "NLw"
        key = "L:" + re.sub(r"\d+", "9", line[:40]) if mark == "NLh" else w2
        found[at] = Gap(at, start, key, w1, mark, nxt, label)
    last = len(text.rstrip())
    if last and not any(g.end >= last for g in found.values()) and _bare_mark(text, last) != "NL":
        w2, w1 = _words_before(text, last)
        found[last] = Gap(last, n, w2, w1, _bare_mark(text, last), "<end>", 1)
    # blanks in Thai and Lao
    if _HAS_THAI(text):
        for m in _THAI_BLANK.finditer(text):
            at, start = m.start(), m.end()
            if at in found or inside(at) or any(g.end <= at < g.start for g in (found[e] for e in range(max(0, at - 6), at + 1) if e in found)):
                continue
            w2, w1 = _words_before(text, at)
            nxt = _next_kind(text[start:start + 40])
            if not (_HAS_THAI(w1 + nxt)) or text[at - 1] in _END:
                continue
            found[at] = Gap(at, start, w2, w1, "TH", nxt, 0 if nxt == "<,>" else None)
    # long stretches without any of these
    known, most = sorted(k for k in found if found[k].label != 0), BARE_STRETCH if bare else STRETCH
    for a, b in zip([0, *(found[k].start for k in known)], [*known, last]):
        if b - a > 2 * most and len(text[a:b].split()) > most and not _HAS_DENSE(text[a:b]) and not _HAS_THAI(text[a:b]):
            for m in _BETWEEN.finditer(text, a, b):
                if m.start() > a and m.start() not in found and not inside(m.start()):
                    found[m.start()] = Gap(m.start(), m.end(), "", _word_at(text, m.start(), -1), BLANK, _word_at(text, m.end(), 1), None)
    return [found[k] for k in sorted(found)]


def _word_at(text: str, at: int, side: int) -> str:
    """The word before (-1) or after (1) a place, without case and marks."""
    piece = text[max(0, at - 60):at].split()[-1:] if side < 0 else text[at:at + 60].split(None, 1)[:1]
    return "".join(c for c in (piece[0] if piece else "").casefold() if c.isalnum())


def _kind(g: Gap) -> tuple[str, str, str, str]:
    if g.mark == BLANK:
        return "", g.w1, BLANK, g.nxt
    w2 = g.w2 if g.mark == "NLh" else _literal(g.w2, 5)
    return w2, _literal(g.w1, 8), g.mark, g.nxt


#: The kinds of contexts in the discrete prior: never, sometimes and regularly the end of a sentence.
_NEVER, _MIXED, _REGULAR = 0.01, 0.5, 0.98


class Model:
    """The probabilities of the hidden event and of what follows, by kind of context.

    A share of all events, known per script from question and exclamation marks, stands at the ends of paragraphs, where
    they show. The number of shown events among a context's gaps therefore tells how often the event happens there: a
    posterior over _NEVER, _MIXED and _REGULAR, with the next more general context as its prior.
    """

    def __init__(self, kinds: list[tuple[str, str, str, str, int | None, float]], words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        """kinds: (w2, w1, mark, next, label, count). words: counts of all words, of those that end and of those that begin
        paragraphs, by field."""
        self.words = words
        self.shown: dict[tuple, list[float]] = defaultdict(lambda: [0.0, 0.0])
        strong: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for w2, w1, mark, nxt, label, c in kinds:
            if label == 0:
                continue
            for key in self._keys(w2, w1, mark)[:2]:
                r = self.shown[key]
                r[0] += c * (label == 1)
                r[1] += c
            if mark[0] in _TELLING and len(mark) == 1:
                for g in (group(w1, mark), ""):
                    strong[g][0] += c * (label == 1)
                    strong[g][1] += c
        # a shape stands for words not seen: every word counts about alike, however frequent
        for (w1, mark), (e, n) in [(k, v) for k, v in self.shown.items() if len(k) == 2]:
            for key in self._keys("", w1, mark)[2:]:
                r = self.shown[key]
                r[0] += e * min(1.0, PER_WORD / n)
                r[1] += min(n, PER_WORD)
        whole = strong.get("", [0.0, 0.0])
        base = (whole[0] + 2) / (whole[1] + 15)
        self.share = {g: min(0.6, max(0.02, (e + 20 * base) / (n + 20))) for g, (e, n) in strong.items()}
        self.base = min(0.6, max(0.02, base))
        self.shown = dict(self.shown)
        self._events: dict[tuple, float] = {}
        self.follow: dict[tuple, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        for w2, w1, mark, nxt, label, c in kinds:
            if mark in _BARE and label is None:
                self.follow[w1, mark][nxt] += c
        self.follow = {k: dict(v) for k, v in self.follow.items()}
        self.nexts: dict[tuple, dict[str, float]] = {}
        self.totals: dict[tuple, float] = {}
        for _ in range(ROUNDS):
            self._fit_next(kinds)

    @staticmethod
    def _keys(w2: str, w1: str, mark: str) -> list[tuple]:
        g = group(w1, mark)
        return [(w2, w1, mark), (w1, mark), (shape(w1) if not w1.startswith("<") else w1, mark, g), (mark, g)]

    @staticmethod
    def _start(mark: str) -> float:
        if mark in _START:
            return _START[mark]
        return next((p for end, p in _START_CLOSED.items() if mark.endswith(end)), 0.98 if mark in _PLAIN else 0.95)

    def event(self, w2: str, w1: str, mark: str) -> float:
        """P(event | words before, mark)."""
        if (w2, w1, mark) in self._events:
            return self._events[w2, w1, mark]
        a = self._start(mark)
        if mark in ("NL", "NLh", "NLw", "NLb"):  # no paragraph's end shows these; a line that recurs is a heading
            return 0.97 if mark == "NLh" and self.shown.get((w2, w1, mark), (0, 0))[1] >= 3 else a
        if w2 == "<nl>" and mark == "." and shape(w1) in ("<9>", "<A>", "<a>"):
            return 0.02  # a number or letter at the start of a line numbers what follows
        if mark in _PLAIN:  # marks that end sentences only; what follows may still speak against one
            return a
        share = self.share.get(group(w1, mark), self.base)
        for level, key in reversed(list(enumerate(self._keys(w2, w1, mark)))):
            e, n = self.shown.get(key, (0.0, 0.0))
            prior = np.array([1 - a, 0.06, a])
            if level == 1 and w1.casefold() in ABBREVIATIONS:
                prior *= (PRIOR, 1.0, 1.0)
            # kinds of sentences differ in how often they end a paragraph, and general contexts mix them: bounded evidence
            if n > EVIDENCE:
                e, n = e * EVIDENCE / n, EVIDENCE
            logs = np.array([e * math.log(x * share) + (n - e) * math.log(1 - x * share) for x in (_NEVER, _MIXED, _REGULAR)])
            if level == 1 and mark in _BARE:
                x = self._follows(w1, mark)
                logs = logs + np.array([-x / 2, 0.0, x / 2])
            post = np.maximum(prior, 1e-3) * np.exp(logs - logs.max())
            post /= post.sum()
            a = float(post @ (_NEVER, _MIXED, _REGULAR))
        if len(self._events) > 500_000:
            self._events.clear()
        self._events[w2, w1, mark] = a
        return a

    def _follows(self, w1: str, mark: str) -> float:
        """How much what follows a context looks like what begins sentences of its script: bounded log odds."""
        g, f = group(w1, mark), self.follow.get((w1, mark), {})
        n = sum(f.values())
        if not n or ("E", g) not in self.nexts:
            return 0.0
        e, x, te, tx = self.nexts["E", g], self.nexts["N", g], self.totals["E", g] + 5, self.totals["N", g] + 5
        total = sum(c * max(-2.0, min(2.0, math.log((e.get(k, 0.0) + 0.5) / te * tx / (x.get(k, 0.0) + 0.5)))) for k, c in f.items())
        return max(-12.0, min(12.0, total / n * min(n, 15.0)))

    def _fit_next(self, kinds) -> None:
        nexts: dict = defaultdict(lambda: defaultdict(float))
        for w2, w1, mark, nxt, label, c in kinds:
            if nxt == "<end>":
                continue
            p = float(label) if label is not None else self.posterior(w2, w1, mark, nxt)
            g = group(w1, mark)
            nexts["E", g][nxt] += c * p
            nexts["N", g][nxt] += c * (1 - p)
            nexts[w1, mark][nxt] += c * (1 - p)
        self.nexts = {k: dict(v) for k, v in nexts.items()}
        self.totals = {k: sum(v.values()) for k, v in self.nexts.items()}
        self._events.clear()

    def between(self, w1: str, nxt: str) -> float:
        """P(event | the words around a blank)."""
        odds = math.log(BLANK_SHARE / (1 - BLANK_SHARE))
        if self.words is not None:
            elsewhere, ends, begins = self.words
            for word, counts in ((w1, ends), (nxt, begins)):
                k = zlib.crc32(word.encode()) % FIELDS
                usual = (elsewhere[k] + 0.5) / (elsewhere.sum() + FIELDS / 2)
                odds += max(-4.0, min(4.0, math.log((counts[k] + 20 * usual) / (counts.sum() + 20) / usual)))
        return 1 / (1 + math.exp(-odds))

    def posterior(self, w2: str, w1: str, mark: str, nxt: str) -> float:
        """P(event | context and what follows), of one gap by itself."""
        if mark == BLANK:
            return self.between(w1, nxt)
        a = self.event(w2, w1, mark)
        g = group(w1, mark)
        if nxt == "<end>" or ("E", g) not in self.nexts:
            return a
        kinds = len(self.nexts["E", g]) + 1
        e = (self.nexts["E", g].get(nxt, 0.0) + 2.0 / kinds) / (self.totals["E", g] + 2.0)
        back = (self.nexts["N", g].get(nxt, 0.0) + 2.0 / kinds) / (self.totals["N", g] + 2.0)
        x = (self.nexts.get((w1, mark), {}).get(nxt, 0.0) + 3.0 * back) / (self.totals.get((w1, mark), 0.0) + 3.0)
        if self.nexts["E", g].get(nxt, 0.0) + self.nexts["N", g].get(nxt, 0.0) < 3:
            return a
        ratio = min(RATIO, max(1 / RATIO, e / x))
        return a * ratio / (a * ratio + 1 - a)


#: Probability of the event by mark before anything is counted: line breaks by their layout, blanks of scripts
#: without marks, ends inside (0) or not inside (1) a quote or bracket that opened with the sentence.
_START = {"NL": 1.0, "NLh": 0.6, "NLw": 0.02, "NLb": 0.8, "NLd": 0.3, "TH": 0.3}
_START_CLOSED = {"“1": 0.9, "“0": 0.3, "(0": 0.9, "(1": 0.1}
#: Marks that end nothing but sentences, where no quote or bracket closes after them.
_PLAIN = frozenset(_END) - frozenset(".…․")
#: Marks from whose share at paragraph ends the share of all events there is known.
_TELLING = frozenset(_UNCASED_END + "?!")
#: Gaps at which no mark stands: those that show events in scripts without marks, and all.
_BARE, _BARE_MARKS = frozenset(["TH", "NLd"]), frozenset(["TH", "NL", "NLd", "NLh", "NLw", "NLb", BLANK])
#: Most gaps of a context that count as evidence.
EVIDENCE = 80.0
#: Most gaps by which one word speaks for its shape.
PER_WORD = 3.0
#: Most the word that follows may weigh for or against an event.
RATIO = 8.0


#: Log probability of a sentence of one, two, three or more words, against one of any length.
_LENGTH = {1: math.log(0.05), 2: math.log(0.35)}


def decide(text: str, found: list[Gap], model: Model, cache: dict) -> list[tuple[int, int]]:
    """The sentences of a text: the gaps whose forward-backward posterior of an event reaches one half divide it."""
    return spans(*context(text, found), model, cache)


def context(text: str, found: list[Gap]) -> tuple[int, int, list[tuple]]:
    """What the decision needs of a text: where its letters begin and end, and the gaps with the words since the gap before
    (0: not counted)."""
    out, begin = [], 0
    for g in found:
        piece = text[begin:g.end]
        counted = g.mark not in ("NL", "NLh", "NLb", "TH") and not _HAS_DENSE(piece)
        out.append((g.end, g.start, *_kind(g), -1 if g.label is None else g.label, len(piece.split()) if counted else 0))
        begin = g.start
    return len(text) - len(text.lstrip()), len(text.rstrip()), out


def spans(first: int, last: int, found: list[tuple], model: Model, cache: dict) -> list[tuple[int, int]]:
    """The sentences between the first and the last letter of a text, from its gaps with their contexts."""
    chain = [g for g in found if g[1] < last]
    n = len(chain)
    if not n:
        return [(first, last)] if first < last else []
    p = np.empty(n)
    for i, (_, _, w2, w1, mark, nxt, label, _) in enumerate(chain):
        if label >= 0:
            p[i] = label
        else:
            k = w2, w1, mark, nxt
            if k not in cache:
                if len(cache) > 200_000:
                    cache.clear()
                cache[k] = model.posterior(*k)
            p[i] = cache[k]
    p = np.clip(p, 1e-9, 1 - 1e-9)
    yes, no = np.log(p).tolist(), np.log1p(-p).tolist()
    few = [_LENGTH.get(g[7], 0.0) for g in chain]  # of a sentence between the gap and an event at the one before
    yes[0] += few[0]
    if not any(few[1:]):  # then the gaps do not depend on each other
        post = [y - x for x, y in zip(no, yes)]
    else:
        f, b = [(no[0], yes[0])], [(0.0, 0.0)]
        for i in range(1, n):
            x, y = f[-1]
            both = _add(x, y)
            f.append((no[i] + both, yes[i] + _add(x, y + few[i])))
        for i in range(n - 1, 0, -1):
            x, y = b[-1]
            b.append((_add(no[i] + x, yes[i] + y), _add(no[i] + x, yes[i] + y + few[i])))
        post = [y + v - x - u for (x, y), (u, v) in zip(f, reversed(b))]
    out, at = [], first
    for g, z in zip(chain, post):
        if z >= 0 and g[0] > at:
            out.append((at, g[0]))
            at = g[1]
    return [*out, (at, last)] if at < last else out


def _add(x: float, y: float) -> float:
    """log(exp(x) + exp(y))"""
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


_GAPS = "array<struct<end:int,start:int,w2:string,w1:string,mark:string,nxt:string,label:int,words:int>>"


def gap_table(documents: DataFrame, key: str, text: str, keep_text: bool = False) -> DataFrame:
    """(key, first, last, gaps, ends, begins): the possible boundaries of every document with their contexts, read once; the
    words that end and begin its paragraphs. keep_text: the text itself, too."""
    kind = documents.schema[key].dataType.simpleString()
    extra = [text] if keep_text else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, s in zip(pdf[key], pdf[text]):
                if not s:
                    continue
                found = gaps(s)
                first, last, chain = context(s, found)
                shown = [g for g in found if g.label == 1]
                names = ("end", "start", "w2", "w1", "mark", "nxt", "label", "words")
                rows.append((k, first, last, [dict(zip(names, g)) for g in chain], [_word_at(s, g.end, -1) for g in shown if g.mark not in _BARE_MARKS], [_word_at(s, g.start, 1) for g in shown if g.start < last], *([s] if keep_text else [])))
            yield pd.DataFrame(rows, columns=[key, "first", "last", "gaps", "ends", "begins", *extra])

    schema = f"`{key}` {kind}, first int, last int, gaps {_GAPS}, ends array<string>, begins array<string>" + (f", `{text}` string" if keep_text else "")
    return spread(documents.select(key, text).filter(F.col(text).isNotNull())).mapInPandas(run, schema)


def _fields(words: DataFrame, column: str) -> np.ndarray:
    """How often each word stands in a column, by field."""
    field = F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(FIELDS))
    out = np.zeros(FIELDS)
    for r in words.filter(F.col(column) != "").groupBy(field.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("c")).collect():  # at most FIELDS rows
        out[r.k] = r.c
    return out


def word_counts(table: DataFrame, documents: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all words of all documents, of those that end and of those that begin paragraphs, by field."""
    every = documents.select(F.explode(F.split(F.lower(text), r"(?U)[^\p{L}\p{N}]*\s+[^\p{L}\p{N}]*")).alias("w"))
    return _fields(every, "w"), _fields(table.select(F.explode("ends").alias("w")), "w"), _fields(table.select(F.explode("begins").alias("w")), "w")


def estimate(table: DataFrame, documents: DataFrame, text: str, words: bool | None = None) -> Model:
    """The model, from the counts of all documents and all kinds of contexts, the rare ones too.

    The driver gets every kind. The word before last is left out where the model never asks for it (shown absence of an
    event, marks whose event depends on no word), which merges kinds without changing a count that is used. words: whether to
    count the words for blanks; by default if any document has a stretch without marks.
    """
    if words is None:
        words = not table.filter(F.exists("gaps", lambda g: g.mark == BLANK)).isEmpty()
    g = table.select(F.explode("gaps").alias("g")).select("g.*").filter(F.col("mark") != BLANK)
    unasked = (F.col("label") == 0) | F.col("mark").isin(*_PLAIN, "NL", "NLw", "NLb")
    g = g.withColumn("w2", F.when(unasked, "").otherwise(F.col("w2")))
    kinds = g.groupBy("w2", "w1", "mark", "nxt", "label").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "w1", "w2", "mark", "nxt", "label")
    rows = [(r.w2, r.w1, r.mark, r.nxt, None if r.label < 0 else int(r.label), float(r.c)) for r in kinds.toPandas().itertuples(index=False)]
    return Model(rows, word_counts(table, documents, text) if words else None)


def train(documents: DataFrame, text: str = "text") -> Model:
    """The model of these documents, for any texts."""
    keyed = documents.select(F.lit(0).alias("_key"), text)
    return estimate(materialize(gap_table(keyed, "_key", text), "gaps"), documents, text, words=True)


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None, keep_text: bool = False) -> DataFrame:
    """(key, sent_no, start_pos, end_pos): the sentences of every document, offsets in code points, the end exclusive.

    NULL, empty and blank texts have no sentences; a text without any boundary is one sentence; repeated rows come out
    repeated; whole texts are read, however long. The model is trained on the documents themselves unless one is given.
    keep_text: the sentence itself, too.
    """
    table = gap_table(documents, key, text, keep_text)
    if model is None:
        table = materialize(table, "gaps")
        model = estimate(table, documents, text)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = documents.schema[key].dataType.simpleString()
    extra = [text] if keep_text else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for pdf in batches:
            pdf["spans"] = [spans(a, b, [tuple(g.values()) for g in found], shared.value, cache) for a, b, found in zip(pdf["first"], pdf["last"], pdf["gaps"])]
            pdf["spans"] = [[{"start_pos": x, "end_pos": y} for x, y in found] for found in pdf["spans"]]
            yield pdf[[key, "spans", *extra]]

    decided = table.select(key, "first", "last", "gaps", *extra).mapInPandas(run, f"`{key}` {kind}, spans array<struct<start_pos:bigint,end_pos:bigint>>" + (f", `{text}` string" if keep_text else ""))
    each = decided.select(key, *extra, F.posexplode("spans").alias("p", "s")).select(key, (F.col("p") + 1).alias("sent_no"), "s.*", *extra)
    if keep_text:
        each = each.withColumn("sentence", F.substring(F.col(text), (F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - F.col("start_pos")).cast("int"))).drop(text)
    return each


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(read_table(spark, d, "documents")).select("doc_id", "start_pos", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences themselves, with their number in the document."""
    return split_sentences(read_table(spark, d, "documents"), keep_text=True).select("doc_id", "sent_no", "sentence")


def p9_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the letters and digits of every document, put together from its sentences in order."""
    s = p9_sentences(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sent_no", "sentence"))).alias("s"))
    letters = F.regexp_replace(F.array_join(F.transform("s", lambda x: x.sentence), ""), r"[^\p{L}\p{N}]+", "")
    return s.filter(letters != "").select("doc_id", F.sha2(letters, 256).alias("digest"))


QUERIES = {"p9_found": p9_found, "p9_sentences": p9_sentences, "p9_roundtrip": p9_roundtrip}
SQL = {"p9_roundtrip": r"""SELECT doc_id, sha256(x) AS digest FROM (SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g') AS x FROM documents) WHERE x <> ''"""}
