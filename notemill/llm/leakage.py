"""Problem 7: evaluation texts leaking into training text.

Test items are indexed by BM25 impacts, each divided by the least score that a leak of that item
can have, so one threshold of 1 is exact for all items.  Terms are pairs of neighbouring words, of
which a replaced, missing or added word spoils two at most.  Every document is cut into overlapping
passages; block-max WAND retrieves the items that reach the threshold, and a word-level
approximate match verifies them, on the item's passage and on its question.

An item is an instruction (mostly none), a passage and a question, its last sentence.  The whole
item is indexed; an instruction only tells which matches are none: those with fewer than ``OWN``
words beyond it.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from notemill.operators.spread import spread

RUN, EDITS = 12, 2
PASSAGE, STRIDE = 32, 16  # a leak spans at most RUN + EDITS words, so it lies within some passage
BLOCK = 32
OWN = RUN * 3 // 4  # words that a match must have beyond an instruction
SHARERS = 5  # passages that an instruction is put before, at least
MAX_ITEMS = 200_000

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(
    "аеорсухіјѕһԁԛԝкмтвнгзαβεικνορτυχγω",
    "aeopcyxijshdqwkmtbhr3aseiknoptuxyw",
)


class _Bare(dict):
    """Translation that drops combining marks and replaces look-alikes; letters are added as they come."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.combining(chr(code)) else code
        return self[code]


_BARE = _Bare(LOOKALIKES)
#: Marks that are seen by no reader.
INVISIBLE = re.compile("[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufe00-\ufe0f\ufeff]")
FOOTNOTE = re.compile(r"<sup>\s*\[?\d+\]?\s*</sup>|\[\^?\d{1,4}\]")
COMMENT = re.compile(r"<!--.*?-->", re.S)
INLINE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|span|font|a|sub|sup|code|mark|small|big|tt|kbd|del|ins|q|abbr)\b[^<>]*>", re.I)
OTHER_TAG = re.compile(r"</?[a-z][a-z0-9]*\b[^<>]*>", re.I)
LATEX = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?(?=\{)|\\(?:begin|end)\{[^}\n]*\}")
LINK = re.compile(r"(?<=\])\([^()\s]*(?:\s+\"[^\"\n]*\")?\)")
HYPHENATED = re.compile(r"(?<=[^\W\d_])[-\u2010]\s*\n\s*(?=[^\W\d_])")
DOTTED = re.compile(r"\b(?:[^\W\d_]\.){2,}")
ASCII_WORD = re.compile(r"[a-z0-9]+(?:'[a-z0-9]+)?")  # what WORD comes to in lower-case ASCII
SENTENCE_END = re.compile(r"(?<=[.!?:؟।])[\"'”’»)\]]*\s+|(?<=[。！？：])|\n+")
WORD = re.compile(r"[\u0e00-\u0e7f]+|[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]|(?:(?![\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff])[^\W_])+(?:['’](?=[^\W_])(?:[^\W_])+)?")


def words_of(text: str) -> list[str]:
    """The words of a text as a reader takes them: no markup, marks, case, accents or look-alikes."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if not t.isascii():
        t = INVISIBLE.sub("", unicodedata.normalize("NFKC", t))
    if "<" in t:
        t = OTHER_TAG.sub(" ", INLINE_TAG.sub("", FOOTNOTE.sub("", COMMENT.sub(" ", t))))
    if "[" in t:
        t = LINK.sub("", FOOTNOTE.sub("", t))
    if "\\" in t:
        t = LATEX.sub("", t)
    if "-" in t or "\u2010" in t:
        t = HYPHENATED.sub("", t)
    t = DOTTED.sub(lambda m: m.group().replace(".", ""), t).casefold()
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).translate(_BARE)
    # emphasis within a word leaves nothing between its parts
    words = (ASCII_WORD if t.isascii() else WORD).findall(t.replace("*", "") if "*" in t else t)
    return [w.replace("'", "").replace("’", "") for w in words] if "'" in t or "’" in t else words


def sentence_ends(text: str, words: list[str]) -> list[int]:
    """Numbers of words after which a sentence of the item ends, its last word included."""
    ends = {len(words)}
    for m in SENTENCE_END.finditer(text):
        own = words_of(text[: m.start()])
        if own and own == words[: len(own)]:
            ends.add(len(own))
    return sorted(ends)


def instruction_words(items: dict[int, tuple[list[str], list[int]]], least: int = SHARERS) -> dict[int, int]:
    """Number of leading words of each item (words, sentence ends) that are a standard instruction.

    That is the longest run of whole sentences after which ``least`` or more different sentences
    follow in the items that begin with it, only such counting that are no question and leave, the
    question apart, the words of a match.  A passage that many items share is none, as nothing but
    their questions follows it.
    """
    after: dict[int, set[int]] = defaultdict(set)
    begins: dict[int, list[tuple[int, int]]] = {}
    for item, (words, ends) in items.items():
        question = ends[-2] if len(ends) > 1 else len(words)
        begins[item] = []
        for at, following in zip(ends, ends[1:], strict=False):
            if question - at >= RUN:
                key = hash(tuple(words[:at]))
                begins[item].append((at, key))
                after[key].add(hash(tuple(words[at:following])))
    return {item: max((at for at, key in own if len(after[key]) >= least), default=0) for item, own in begins.items()}


class ItemIndex:
    """Inverted index with block maxima over items (words, words of instruction, words before the question)."""

    def __init__(self, items: dict[int, tuple[list[str], int, int]], k1: float = 1.2, b: float = 0.75) -> None:
        # runs may begin where at least OWN of their words are the item's own
        kept = {i: (w, max(0, cut - RUN + OWN) if cut else 0, q) for i, (w, cut, q) in sorted(items.items()) if len(w) - cut >= OWN and len(w) >= RUN}
        self.ids = list(kept)
        self.first = [first for _, first, _ in kept.values()]
        self.question = [q for _, _, q in kept.values()]
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        self.words = [array("i", [number.setdefault(x, len(number)) for x in w]) for w, _, _ in kept.values()]
        n, width = len(kept), len(number)
        pairs = [[x * width + y for x, y in zip(w, w[1:], strict=False)] for w in self.words]
        self.codes = np.unique(np.array([c for own, first in zip(pairs, self.first, strict=True) for c in own[first:]], dtype=np.int64))
        term = {c: t for t, c in enumerate(self.codes.tolist())}
        df = Counter(c for own, first in zip(pairs, self.first, strict=True) for c in set(own[first:]))
        mean = sum(map(len, pairs)) / max(n, 1)
        self.docs = [array("i") for _ in term]
        self.impacts = [array("d") for _ in term]
        for at, (own, first) in enumerate(zip(pairs, self.first, strict=True)):
            tf = Counter(own[first:])
            norm = k1 * (1 - b + b * len(own) / mean)
            score = {c: math.log(1 + (n - df[c] + 0.5) / (df[c] + 0.5)) * f * (k1 + 1) / (f + norm) for c, f in tf.items()}
            least = min(sum(sorted((score[c] for c in set(own[p : p + RUN - 1])), reverse=True)[2 * EDITS :]) for p in range(first, len(own) - RUN + 2))
            for c, x in score.items():
                self.docs[term[c]].append(at)
                self.impacts[term[c]].append(x / max(least, 1e-9))
        self.blocks = [array("d", [max(s[k : k + BLOCK]) for k in range(0, len(s), BLOCK)]) for s in self.impacts]
        self.most = np.array([max(s) for s in self.impacts], dtype=np.float64)
        self.masks: dict[int, dict[int, int]] = {}

    def retrieve(self, terms: set[int]) -> Iterator[tuple[int, float]]:
        """Block-max WAND: all items whose score reaches 1, with the score."""
        lists = [[0, t] for t in terms]
        limit = 1 - 1e-9
        while lists:
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            total, pivot = 0.0, -1
            for k, (_, t) in enumerate(lists):
                total += self.most[t]
                if total >= limit:
                    pivot = k
                    break
            if pivot < 0:
                return
            doc = self.docs[lists[pivot][1]][lists[pivot][0]]
            while pivot + 1 < len(lists) and self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]] == doc:
                pivot += 1
            bound, skip_to = 0.0, None
            for at, t in lists[: pivot + 1]:
                own = self.docs[t]
                pos = bisect_left(own, doc, at)
                if pos < len(own):
                    block = pos // BLOCK
                    bound += self.blocks[t][block]
                    last = own[min(len(own), (block + 1) * BLOCK) - 1]
                    skip_to = last + 1 if skip_to is None else min(skip_to, last + 1)
            if bound >= limit:
                score = 0.0
                for entry in lists[: pivot + 1]:
                    own = self.docs[entry[1]]
                    entry[0] = bisect_left(own, doc, entry[0])
                    if entry[0] < len(own) and own[entry[0]] == doc:
                        score += self.impacts[entry[1]][entry[0]]
                        entry[0] += 1
                if score >= limit:
                    yield doc, score
            else:
                target = skip_to if skip_to is not None else doc + 1
                if pivot + 1 < len(lists):
                    target = min(target, self.docs[lists[pivot + 1][1]][lists[pivot + 1][0]])
                target = max(target, doc + 1)
                for entry in lists[: pivot + 1]:
                    entry[0] = bisect_left(self.docs[entry[1]], target, entry[0])
            lists = [x for x in lists if x[0] < len(self.docs[x[1]])]

    def masks_of(self, at: int) -> dict[int, int]:
        """For each word of an item the places it has in the item's runs, as bits; made when first asked for."""
        if at not in self.masks:
            w, first = self.words[at], self.first[at]
            masks: dict[int, int] = defaultdict(int)
            for p in range(first, len(w) - RUN + 1):
                for k in range(RUN):
                    masks[w[p + k]] |= 1 << (p * RUN + k)
            self.masks[at] = dict(masks)
        return self.masks[at]

    def matched_runs(self, at: int, passage: list[int]) -> int:
        """Bit p*RUN+RUN-1 is set if the item's words p .. p+RUN-1 occur in the passage within EDITS edits."""
        masks, runs = self.masks_of(at), len(self.words[at]) - RUN + 1
        start = sum(1 << (p * RUN) for p in range(self.first[at], runs))
        final = start << (RUN - 1)
        rows = [0] * (EDITS + 1)
        for d in range(1, EDITS + 1):
            rows[d] = rows[d - 1] << 1 | start
        hit = 0
        for word in passage:
            mask = masks.get(word, 0)
            before = rows[0]
            rows[0] = (before << 1 | start) & mask
            for d in range(1, EDITS + 1):
                old = rows[d]
                rows[d] = ((old << 1 | start) & mask) | (before << 1 | start) | before | (rows[d - 1] << 1 | start)
                before = old
            hit |= rows[EDITS] & final
        return hit

    def leaks(self, words: list[str]) -> dict[int, tuple[float, int]]:
        """Verified items of a document: position in the index -> (best score, runs found)."""
        found: dict[int, tuple[float, int]] = {}
        if len(words) < RUN - EDITS or not self.ids:
            return found
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        codes = ids[:-1] * len(self.vocabulary) + ids[1:]
        terms = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        terms[(self.codes[terms] != codes) | (ids[:-1] < 0) | (ids[1:] < 0)] = -1
        # a leak lies within RUN + EDITS words, whose list maxima add up to the threshold or more
        sums = np.concatenate([[0.0], np.cumsum(np.where(terms < 0, 0.0, self.most[terms]))])
        reach = min(RUN + EDITS - 1, len(terms))
        enough = np.flatnonzero(sums[reach:] - sums[: len(sums) - reach] >= 1 - 1e-6)
        for part in np.unique(enough // STRIDE).tolist():
            passage = ids[part * STRIDE : part * STRIDE + PASSAGE].tolist()
            own = set(terms[part * STRIDE : part * STRIDE + PASSAGE - 1].tolist()) - {-1}
            for at, score in self.retrieve(own):
                if hit := self.matched_runs(at, passage):
                    best, runs = found.get(at, (0.0, 0))
                    found[at] = (max(best, score), runs | hit)
        return found

    def coverage(self, at: int, runs: int) -> tuple[int, float, float]:
        """Words of the item that lie in matched runs, and the shares of its passage and of its question."""
        n, q, covered = len(self.words[at]), self.question[at], set()
        for p in range(n - RUN + 1):
            if runs >> (p * RUN + RUN - 1) & 1:
                covered.update(range(p, p + RUN))
        asked = sum(k >= q for k in covered)
        own = q - self.first[at]
        return len(covered), (len(covered) - asked) / own if own else 0.0, asked / (n - q) if q < n else 0.0


def item_index(texts: dict[int, str]) -> ItemIndex:
    """The index of items by their texts: instruction and question are found by sentences."""
    items = {i: (w, sentence_ends(t, w)) for i, t in texts.items() if (w := words_of(t))}
    cuts = instruction_words(items)
    return ItemIndex({i: (w, cuts[i], ends[-2] if len(ends) > 1 else len(w)) for i, (w, ends) in items.items()})


SCHEMA = "doc_id long, item_id long, score double, n_words long, item_share double, passage_share double, question_share double"


def find_leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Documents (doc_id, text) that hold a passage of items (item_id, text).

    A leak is a run of at least 12 words of the item, of which at most two are replaced, missing
    or added; where it begins within a standard instruction, at least ``OWN`` of its words lie
    beyond that.  Returns (doc_id, item_id, score, n_words, item_share, passage_share,
    question_share): the best passage score (1 = least that a leak can have), how many of the
    item's words lie in matched runs, their share, and the shares of its passage and of its question.
    Items are a bounded query set (at most ``MAX_ITEMS``, more are refused); documents are taken
    apart once.  Null and empty texts and items of fewer than 12 words match nothing; repeated
    rows give repeated results once per row; other columns are ignored.
    """
    rows = items.select("item_id", "text").where("text is not null and item_id is not null").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} test items; call find_leaks on parts of them")
    index = documents.sparkSession.sparkContext.broadcast(item_index({r["item_id"]: r["text"] for r in sorted(rows)}))
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = index.value
        for batch in batches:
            found = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for at, (score, runs) in own.leaks(words_of(text)).items():
                    n, passage, question = own.coverage(at, runs)
                    found.append((doc_id, own.ids[at], score, n, n / len(own.words[at]), passage, question))
            yield pd.DataFrame(found, columns=columns)

    return spread(documents.select("doc_id", "text").where("text is not null")).mapInPandas(search, SCHEMA)
