"""Problem 3: natural language hidden inside code.

Comments and string literals come from the chunked lexer; machine text and disabled code are
ruled out by their form; the language is found by multinomial logistic regression on hashed
character n-grams, trained here on labelled documents and windows of shuffled function words, with
code lines as a class of their own.
Every chunk is lexed and labelled where it lies; only spans that may go on over its ends are
brought together.
"""

from __future__ import annotations

import ast
import math
import re
import unicodedata
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.lexer import CODE, Span, cut, edges, effects, lex, prefix_starts, stitch
from notemill.operators.current import current_rows
from notemill.operators.spread import spread
from notemill.session import materialize

LANGUAGES = ["de", "en", "es", "fr", "ja", "ko", "pt", "ru", "zh"]
CHUNK = 1 << 16
DIM = 1 << 15
MIN_WORDS, MIN_SIGNS = 4, 6
#: Bounds of the training sample: documents of a language, notebooks, samples of a class, and the
#: longest document and code that are taken into it.
DOCS_A_LANGUAGE, CODE_RECORDS, SAMPLES_A_CLASS, LONGEST_SAMPLE = 400, 400, 600, 50_000
WINDOW = 5  # words of a sample as short as phrases in code mostly are

# Articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of the languages in Latin script.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber sondern denn nicht kein keine keinen ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll sollen darf dürfen will ich du er sie es wir ihr man mich mir uns sich sein seine ihre unser auf in im ins an am aus bei mit nach von vom vor zu zum zur über unter für durch gegen ohne um neben zwischen hinter bis seit wenn weil dass ob als wie wo was wer wann warum hier dort dann erst nur noch auch schon sehr mehr weniger immer alle alles jede jeder jedes diese dieser dieses einige viele",
    "en": "the a an and or but nor so not no is are was were be been being has have had do does did can could may might must shall should will would i you he she it we they me him her us them my your his its our their this that these those who what which when where why how on in at by for from to with without of about into over under between through during before after until since if because while although than as there here only also just very all each every some any more less most few both",
    "es": "el la los las un una unos unas y e o u pero sino ni no es son era eran fue fueron ser está están estar ha han hay había se me te nos le les lo su sus mi mis tu nuestro nuestra yo tú él ella ellos ellas nosotros usted ustedes este esta estos estas ese esa esos esas aquel de del a al en con sin por para sobre entre hasta desde hacia según durante contra que si porque cuando donde como quien cual cuyo aunque mientras aquí allí ya solo sólo también muy más menos todo toda todos todas cada algún alguna otro otra antes después junto luego siempre nunca",
    "fr": "le la les l un une des du de d et ou mais donc ni car ne pas plus est sont était étaient été être a ont avait avoir fut sera on je tu il elle nous vous ils elles me te se lui leur leurs mon ma mes ton ta son sa ses notre nos votre ce cet cette ces qui que quoi dont où à au aux en y dans avec sans par pour sur sous entre chez vers depuis pendant jusque contre si quand comme parce puisque lorsque ici là seulement aussi très moins tout toute tous toutes chaque quelque quelques autre avant après ensuite puis toujours jamais",
    "pt": "o a os as um uma uns umas e ou mas nem não é são era eram foi foram ser está estão estar há tem têm havia se me te nos lhe lhes seu sua seus suas meu minha nosso nossa eu tu ele ela eles elas você vocês este esta estes estas esse essa isso isto aquele de do da dos das em no na nos nas ao à aos às com sem por pelo pela pelos pelas para sobre entre até desde durante contra que se porque quando onde como quem qual cujo embora enquanto aqui ali já só apenas também muito mais menos todo toda todos todas cada algum alguma outro outra antes depois junto logo sempre nunca",
}

_FIELD = re.compile(r"(?<!\{)\{(?!\{)[^{}]*\}")
_ESCAPE = re.compile(r"\\(\r?\n|[0-7]{1,3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|N\{[^}]*\}|.)", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
_CJK = re.compile(r"[\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uff66-\uff9f]")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*[.,;:!?…]*$")
_LETTER = re.compile(r"[^\W\d_]")
#: Text for machines by its form, whatever its words.
_MACHINE = re.compile(
    r"^\s*(?:%|!|\$ |>>>|\.\.\. )|://|-\*-|^\s*(?:type|noqa|pylint|pragma|fmt|mypy|isort|nosec|flake8|coding|vim|yapf|pyright|ruff)\b\s*[:=]|\bnoqa\b|^\s*(?:@|\+\+|<[/!a-z])"
    r"|(?i:^\s*(?:select\b.+\bfrom|insert\s+into|update\b.+\bset|delete\s+from|create\s+(?:table|view|index)|alter\s+table|drop\s+table|with\b.+\bas\s*\()\b)"
    r"|(?:[\w.~-]*/){2,}|^[A-Za-z0-9_./\\-]+$|\w\((?!s\))|\w\[[^\]]|\w+\.\w+\(|\\[dwsbDWSB][+*]|\[[^\]]+\][+*?]|</?\w+[^>]*>|[{};]\s*$"
    r"|(?:^|\s)(?:[=<>!+*/%&|^-]=|=|->|=>|&&|\|\||<-|:=|\+=|\*\*|<<|>>)(?:\s|$)|^\s*(?:pip|conda|apt|git|cd|ls|mkdir|curl|wget|sudo|export|chmod|docker)\s+[-\w./]+(?:\s|$)(?=.*(?:-|/|\.|==))"
)


def literal_value(span: Span) -> str:
    """The value that Python gives the literal; fields of an f-string become blanks."""
    text = span.text
    if "r" not in span.prefix and "\\" in text:

        def unescape(m: re.Match[str]) -> str:
            code = m.group(1)
            try:
                if code[0] in "\r\n":
                    return ""
                if code[0] in "01234567":
                    return chr(int(code, 8))
                if code[0] in "xuU" and len(code) > 1:
                    return chr(int(code[1:], 16))
                if code[0] == "N" and len(code) > 1:
                    return unicodedata.lookup(code[2:-1])
            except (ValueError, KeyError, OverflowError):
                return m.group()
            return _SIMPLE.get(code, m.group())

        text = _ESCAPE.sub(unescape, text)
    if "f" in span.prefix:
        text = _FIELD.sub(" ", text).replace("{{", "{").replace("}}", "}")
    return text


Piece = tuple[int, int, str]  # start, end, text


def units(spans: list[Span]) -> Iterator[tuple[str, list[Piece]]]:
    """(found_in, pieces): comments, those on consecutive lines of their own together, and literals, adjacent ones as one piece."""
    k = 0
    while k < len(spans):
        span = spans[k]
        if span.kind == "comment":
            j = k + 1
            while j < len(spans) and span.own_line and spans[j].kind == "comment" and spans[j].own_line and spans[j].gap == 1:
                j += 1
            yield "comment", [(c.start, c.end, c.text) for c in spans[k:j]]
            k = j
            continue
        text, end = literal_value(span), span.end
        j = k + 1
        while j < len(spans):
            between = j
            while between < len(spans) and spans[between].kind == "comment" and span.depth:
                between += 1
            if between >= len(spans) or spans[between].kind != "string":
                break
            if any(s.gap < 0 or s.gap and not span.depth for s in spans[j : between + 1]):
                break
            for c in spans[j:between]:
                yield "comment", [(c.start, c.end, c.text)]
            text += literal_value(spans[between])
            end, j = spans[between].end, between + 1
        yield "string", [(span.start, end, text)]
        k = j


def is_disabled_code(text: str) -> bool:
    """Python would take the text as code that does something, so it is no sentence."""
    bare = text.strip()
    for form in (bare, bare + "\n    pass" if bare.endswith(":") else "", bare[1:].strip() if bare[:1] in "-" else ""):
        if not form:
            continue
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                tree = ast.parse(form)
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            continue
        for node in ast.walk(tree):
            if isinstance(node, (ast.Call, ast.Attribute, ast.Subscript, ast.Assign, ast.AugAssign, ast.AnnAssign, ast.BinOp, ast.Import, ast.ImportFrom, ast.Return, ast.For, ast.While, ast.If, ast.FunctionDef, ast.ClassDef, ast.With, ast.Try, ast.Raise, ast.Assert, ast.Delete, ast.Global, ast.Dict, ast.List, ast.Lambda, ast.Yield)):
                return True
        return len(bare.split()) <= 1 and bare.isascii()
    return False


def phrases(text: str) -> Iterator[str]:
    """Candidate phrases of a comment or string: its lines without decoration, parted at ``#``."""
    for line in text.splitlines():
        for part in re.split(r"(?:^|(?<=\s))#+\d*(?=\s|$|:)|^#+", line):
            bare = re.sub(r"^[\s#:!*>=~•·–—-]+|[\s#*=~-]+$", "", part)
            bare = re.sub(r"^(?::?(?:param|returns?|type|rtype|raises|arg|yields?|note|todo|fixme|xxx|hack)\b[^:]{0,40}:\s*|@\w+\s+\w+\s+)", "", bare, flags=re.I)
            bare = re.sub(r"^[\s#:!*>-]+|[\s:]+$", "", bare)
            if bare:
                yield bare


def is_natural(text: str) -> bool:
    """At least four words (six signs where there are no blanks), most of them plain, no code or machine text."""
    signs = len(_CJK.findall(text))
    letters = sum(map(str.isalpha, text))
    if signs >= MIN_SIGNS and signs >= 0.4 * letters:
        return not _MACHINE.search(text) and not is_disabled_code(text)
    words = [w for w in text.split() if _LETTER.search(w)]
    plain = [w for w in words if _WORD.match(re.sub(r"^[\"'“”„«»(\[]+|[\"'“”„«»)\]]+(?=[.,;:!?…]*$)", "", w))]
    if len(words) < MIN_WORDS or len(plain) < max(3, 0.6 * len(text.split())):
        return False
    if sum(len(w) == 1 for w in plain) > len(plain) / 2 or len({w.lower() for w in plain}) < 3:
        return False
    return not _MACHINE.search(text) and not is_disabled_code(text)


def features(text: str) -> np.ndarray:
    """Hashed words and character n-grams (1 to 4 signs) of the lower-cased text."""
    out = []
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        if len(word) > 40:
            word = word[:40]
        framed = f"<{word}>"
        out.append("w" + word)
        for n in (1, 2, 3, 4):
            out += [framed[k : k + n] for k in range(len(framed) - n + 1)]
    return np.array([zlib.crc32(g.encode()) % DIM for g in out], dtype=np.int64)


def plain_letters(text: str) -> str:
    """The text without accents, as many write it."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


class LanguageModel:
    """Multinomial logistic regression on hashed n-grams; the last class is code."""

    def __init__(self, samples: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> None:
        self.classes = [*LANGUAGES, "code"]
        rows = [(features(t), self.classes.index(c)) for t, c in samples]
        rows = [(x, y) for x, y in rows if len(x)]
        size = np.bincount([y for _, y in rows], minlength=len(self.classes)).astype(float)
        weight = size.sum() / np.maximum(size, 1) / len(self.classes)
        self.w = np.zeros((DIM, len(self.classes)), dtype=np.float32)
        moment = np.full_like(self.w, 1e-4)
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in order.permutation(len(rows)):
                x, y = rows[k]
                p = self._soft(x)
                p[y] -= 1
                own, n = np.unique(x, return_counts=True)
                grad = np.outer(n / math.sqrt(len(x)), p * min(weight[y], 5)).astype(np.float32)
                moment[own] += grad * grad
                self.w[own] -= rate * grad / np.sqrt(moment[own])

    def _soft(self, x: np.ndarray) -> np.ndarray:
        z = self.w[x].sum(axis=0) / math.sqrt(len(x))
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str) -> tuple[str, float]:
        """Best class and its probability; the script settles what letters cannot be confused."""
        letters = [c for c in text if c.isalpha()]
        if letters:
            if any("\u3041" <= c <= "\u30ff" for c in letters):
                return "ja", 1.0
            if sum("\uac00" <= c <= "\ud7a3" for c in letters) > 0.4 * len(letters):
                return "ko", 1.0
            if sum("\u3400" <= c <= "\u9fff" for c in letters) > 0.4 * len(letters):
                return "zh", 1.0
        x = features(text)
        if not len(x):
            return "code", 1.0
        p = self._soft(x)
        k = int(p.argmax())
        return self.classes[k], float(p[k])


def _draw(texts: set[str], n: int) -> list[str]:
    """``n`` of the texts by their hashes; all if there are no more."""
    return sorted(texts, key=lambda t: (zlib.crc32(t.encode()), t))[:n]


def training_samples(documents: DataFrame, nb_contents: DataFrame) -> list[tuple[str, str]]:
    """Bounded sample for the model: sentences, and windows of ``WINDOW`` words, of about
    ``DOCS_A_LANGUAGE`` documents of each language, and lines of the code of ``CODE_RECORDS``
    notebooks, all chosen by hashes; at most ``SAMPLES_A_CLASS`` of each class."""
    code = F.lower(F.substring_index(F.regexp_replace(F.trim("lang"), "_", "-"), "-", 1))
    fit = F.length("text") <= LONGEST_SAMPLE
    labelled = documents.where("text is not null").where(fit).select("doc_id", "text", code.alias("lang")).where(F.col("lang").isin(LANGUAGES))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.col("n") * (F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    rows = labelled.join(F.broadcast(counts), "lang").where(share < DOCS_A_LANGUAGE).select("lang", "text").collect()
    by: dict[str, set[str]] = {lang: set() for lang in LANGUAGES}
    for r in rows:
        for piece in re.split(r"[\n.!?。！？]+", re.sub(r"```.*?```|~~~.*?~~~", "", r["text"], flags=re.S)):
            words = piece.split()
            if len(piece.strip()) > 8:
                by[r["lang"]].add(" ".join(words))
                at = zlib.crc32(piece.encode()) % max(1, len(words) - WINDOW + 1)
                by[r["lang"]].add(" ".join(words[at : at + WINDOW]))
    samples = [(t, lang) for lang in LANGUAGES for t in _draw(by[lang], SAMPLES_A_CLASS)]
    for lang, words in FUNCTION_WORDS.items():
        for k, own in enumerate([words.split()] * 10):
            own = sorted(own, key=lambda w, k=k: zlib.crc32(f"{k} {w}".encode()))
            samples += [(" ".join(own[at : at + WINDOW]), lang) for at in range(0, len(own) - WINDOW + 1, WINDOW)]
    samples += [(plain_letters(t), c) for t, c in samples if c in FUNCTION_WORDS and not t.isascii()]
    own = nb_contents.where("code is not null").where(F.length("code") <= LONGEST_SAMPLE)
    total = own.agg(F.count("*").alias("n"))
    pick = F.col("n") * (F.pmod(F.xxhash64(F.lit(12), "notebook_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    lines = set()
    for r in own.select("notebook_id", "code").crossJoin(F.broadcast(total)).where(pick < CODE_RECORDS).select("code").collect():
        text = r["code"]
        for span in sorted(lex(text), key=lambda s: -s.start):
            text = text[: span.start] + text[span.end :]
        lines.update(ln.strip() for ln in text.splitlines() if len(ln.strip()) > 8)
    return samples + [(ln, "code") for ln in _draw(lines, SAMPLES_A_CLASS)]


def train(documents: DataFrame, nb_contents: DataFrame) -> LanguageModel:
    """Train the language model on its bounded sample."""
    return LanguageModel(training_samples(documents, nb_contents))


def paragraphs(pieces: list[Piece]) -> Iterator[list[Piece]]:
    """Lines of pieces between blank ones, each with the place of its piece."""
    run: list[Piece] = []
    for start, end, text in pieces:
        for line in text.splitlines() or [""]:
            if line.strip(" \t#*=-"):
                run.append((start, end, line))
            elif run:
                yield run
                run = []
    if run:
        yield run


def found_phrases(model: LanguageModel, spans: list[Span]) -> list[tuple[str, str, int, int, str]]:
    """(lang, found_in, start, end, phrase) of all natural-language phrases among the spans.

    Where no line of a paragraph has a phrase, its lines are tried as one sentence."""
    out = []
    for found_in, pieces in units(spans):
        for run in paragraphs(pieces):
            candidates = [(start, end, p) for start, end, line in run for p in phrases(line) if is_natural(p)]
            if not candidates and len(run) > 1:
                whole = " ".join(part for _, _, line in run for part in phrases(line))
                candidates = [(run[0][0], run[-1][1], p) for p in phrases(re.sub(r"\s+", " ", whole)) if is_natural(p)]
            for start, end, phrase in candidates:
                lang, _ = model.predict(phrase)
                if lang != "code":
                    out.append((lang, found_in, start, end, phrase))
    return out


COLUMNS = ["notebook_id", "lang", "found_in", "start_pos", "end_pos", "phrase", "code_chars"]
SCHEMA = "notebook_id long, lang string, found_in string, start_pos long, end_pos long, phrase string, code_chars long"
_CHUNK = "k int, n int, at long, text string"
_SPAN = "array<struct<kind string, start long, `end` long, text string, prefix string, depth int, `left` boolean, `right` boolean, own_line boolean, gap int>>"
_EDGE = f"spans {_SPAN}, tail int, some boolean"


def language_in_code(nb_contents: DataFrame, documents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Natural-language phrases in the current ``code`` of ``nb_contents`` (notebook_id, code, scraped_at).

    Returns (notebook_id, lang, found_in, start_pos, end_pos, phrase, code_chars), positions being
    those of the comments or the joined literals in the stored code.  Every file is cut into chunks of
    about ``chunk`` characters, most into one, whose start is known; the starts of the chunks of
    others follow from a prefix over their transition functions.  Chunks are lexed and their phrases
    labelled in separate tasks; per file only spans at chunk ends come together, and a literal over
    several chunks is one value.  Null and empty code has no phrase; other columns are ignored;
    repeated rows give one result; an empty table gives none.  ``documents`` (doc_id, text, lang)
    trains the model.
    """
    current = current_rows(nb_contents, ["notebook_id"], "scraped_at", ["code"]).where("code is not null")
    model = current.sparkSession.sparkContext.broadcast(train(documents, current))

    def cut_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for notebook_id, code in zip(batch["notebook_id"], batch["code"], strict=True):
                parts = cut(code, chunk)
                if len(parts) == 1:
                    rows += [(notebook_id, *found, len(code), None, None, None, None) for found in found_phrases(model.value, lex(code))]
                else:
                    rows += [(notebook_id, *[None] * 5, len(code), k, len(parts), at, text) for k, (at, text) in enumerate(parts)]
            yield pd.DataFrame(rows, columns=[*COLUMNS, "k", "n", "at", "text"]).astype({c: "Int64" for c in ("start_pos", "end_pos", "k", "n", "at")})

    def functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"notebook_id": batch["notebook_id"], "k": batch["k"], "f": [[x for own in effects(t) for x in own] for t in batch["text"]]})

    def prefix(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        starts = prefix_starts([np.reshape(f, (-1, 3)) for f in group["f"]], CODE)
        return pd.DataFrame({"notebook_id": group["notebook_id"], "k": group["k"], "start": [s for s, _ in starts], "depth": [d for _, d in starts]})

    def lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                spans = lex(r.text, int(r.start), int(r.at), int(r.depth))
                within, open_ends, tail = edges(r.text, spans, int(r.at), r.k == 0, r.k == r.n - 1)
                rows += [(r.notebook_id, *found, r.code_chars, r.k, None, None, None) for found in found_phrases(model.value, within)]
                rows.append((r.notebook_id, *[None] * 5, r.code_chars, r.k, [tuple(vars(s).values()) for s in open_ends], tail, bool(spans)))
            yield pd.DataFrame(rows, columns=[*COLUMNS, "k", "spans", "tail", "some"]).astype({c: "Int64" for c in ("start_pos", "end_pos", "k", "tail")})

    def joined(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("k")
        spans = stitch([([Span(**s) for s in own], int(tail), bool(some)) for own, tail, some in zip(group["spans"], group["tail"], group["some"], strict=True)])
        rows = [(key[0], *found, group["code_chars"].iloc[0]) for found in found_phrases(model.value, spans)]
        return pd.DataFrame(rows, columns=COLUMNS)

    files = materialize(spread(current).mapInPandas(cut_files, f"{SCHEMA}, {_CHUNK}"), chunks=F.count("k"))
    whole = files.where("k is null").select(*COLUMNS)
    if not files.counts["chunks"]:
        return whole
    cuts = files.where("k is not null").select("notebook_id", "code_chars", "k", "n", "at", "text")
    starts = cuts.repartition("notebook_id", "k").mapInPandas(functions, "notebook_id long, k int, f array<long>").groupBy("notebook_id").applyInPandas(prefix, "notebook_id long, k int, start int, depth long")
    parts = materialize(cuts.join(starts, ["notebook_id", "k"]).mapInPandas(lexed, f"{SCHEMA}, k int, {_EDGE}"))
    ends = parts.where("tail is not null").select("notebook_id", "code_chars", "k", "spans", "tail", "some")
    return whole.unionByName(parts.where("tail is null").select(*COLUMNS)).unionByName(ends.groupBy("notebook_id").applyInPandas(joined, SCHEMA))


def language_shares(found: DataFrame) -> DataFrame:
    """Per notebook, language and place: number of phrases, their characters and share of the code.

    A comment or literal with several phrases counts each; shares are of the stored code's length.
    """
    return (
        found.groupBy("notebook_id", "lang", "found_in")
        .agg(F.count("*").alias("n_phrases"), F.sum(F.length("phrase")).alias("n_chars"), F.max("code_chars").alias("code_chars"))
        .withColumn("share", F.col("n_chars") / F.greatest(F.col("code_chars"), F.lit(1)))
    )
