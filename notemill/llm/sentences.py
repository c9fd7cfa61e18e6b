"""Problem 9: sentence boundaries across languages and scripts.

A text is first cut into blocks (fenced code dropped, headings and list items set apart,
paragraphs at blank lines).  Within a paragraph every possible stop is decided by cascading
tables of ordered rules, each a pair of patterns for what stands before and after the stop:
the table of the language, then the common one with that of its writing style in it; the first
rule that matches decides.  Each rule says what may stand right before and after a stop that it
applies to, so that only few of them need be tried at any one stop.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from notemill.operators.spread import spread

STOP = ".!?…。！？．｡؟۔।॥։።"
CLOSE = "\"'”’»›)\\]}」』）】》〉］｣"
EMOTE = r"(?:[:;=][-'^o]?[()\[\]DPpOo|/\\*](?![\w(])|[:;]-?3(?!\w)|<3|\^_\^|[\U0001F000-\U0001FAFF☀-➿]️?(?:‍[\U0001F000-\U0001FAFF☀-➿]️?)*)"
CJK = r"぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ"
CASELESS = rf"{CJK}가-힯؀-ۿऀ-ॿ฀-๿֐-׿"

# Abbreviations that never end a sentence when something follows them.
TITLES = "dr|mr|mrs|ms|prof|st|sr|sra|srta|mme|mlle|mm|messrs|hr|fr|frl|gen|col|capt|lt|sgt|rev|hon|pres|gov|dra|profa|dipl|ing|проф|акад|д-р|г-н|г-жа|डॉ|श्री|د|أ"
POINTERS = {
    "en": "vs|cf|approx|fig|figs|sec|secs|eq|eqs|ch|vol|pp|p|ed|eds|resp|ca|std|dev|min|max|avg|est|dept|al|v|i\\.e|e\\.g|i\\.\\s?e|e\\.\\s?g|viz|ver|ref|refs|tab|app|art|incl|temp|hr|hrs|jan|feb|mar|apr|jun|jul|aug|sept?|oct|nov|dec|mon|tue|wed|thu|fri|sat|sun",
    "de": "abb|bzw|vgl|ca|d\\.\\s?h|z\\.\\s?b|u\\.\\s?a|i\\.\\s?d\\.\\s?r|o\\.\\s?ä|u\\.\\s?u|v\\.\\s?a|s\\.\\s?o|s\\.\\s?u|ggf|evtl|inkl|exkl|min|max|std|sek|nr|kap|abs|art|bd|hrsg|tab|s|str|tel|sog|allg|bsp|jan|feb|mär|apr|jun|jul|aug|sept?|okt|nov|dez|mio|mrd|gem|lt|zzgl|mind|einschl",
    "fr": "cf|env|fig|p|pp|éd|vol|chap|art|n°|no|janv|févr|fév|avr|juil|sept|oct|nov|déc|c\\.-à-d|c\\.\\s?à\\s?d|p\\.\\s?ex|ex|av|apr|m|mm|st|ste|tél|réf|resp|min|max|tab",
    "es": "p\\.\\s?ej|ej|fig|figs|aprox|pág|págs|cap|núm|nº|vol|art|ene|feb|mar|abr|may|jun|jul|ago|sept?|oct|nov|dic|av|ud|uds|vs|cf|máx|mín|tel|ref|d|dña|tab",
    "pt": "p\\.\\s?ex|ex|fig|figs|aprox|pág|págs|cap|núm|nº|n|vol|art|jan|fev|mar|abr|mai|jun|jul|ago|set|out|nov|dez|av|vs|cf|máx|mín|tel|ref|tab",
    "ru": "т\\.\\s?е|т\\.\\s?к|т\\.\\s?н|т\\.\\s?ч|и\\.\\s?о|ок|см|ср|рис|табл|гл|стр|с|г|гг|в|вв|н\\.\\s?э|напр|проф|акад|им|ул|д|кв|тел|руб|коп|млн|млрд|тыс|мин|сек|янв|февр|фев|апр|авг|сент|окт|нояб|дек|рис",
}
# Abbreviations that may end a sentence; they do before a new beginning only.
ENDERS = {
    "en": "etc|a\\.m|p\\.m|inc|ltd|corp|co|u\\.s|u\\.k|e\\.u|jr|sr|ph\\.\\s?d|b\\.c|a\\.d",
    "de": "usw|etc|u\\.\\s?v\\.\\s?m|usf|uhr",
    "fr": "etc",
    "es": "etc|s\\.\\s?a|ee\\.\\s?uu|a\\.\\s?m|p\\.\\s?m",
    "pt": "etc|s\\.\\s?a|ltda",
    "ru": "и\\s?т\\.\\s?д|и\\s?т\\.\\s?п|и\\s?др|и\\s?пр",
}
# Words that begin a sentence far more often than they continue one after a stop.
OPENERS = (
    "the|this|that|these|those|a|an|we|i|you|he|she|they|it|it's|i'm|my|our|his|her|their|your|there|here|what|why|how|who|when|where|which|did|does|do|has|have|had|is|are|was|were|can|could|should|would|"
    "will|let|please|thanks|thank|nothing|nobody|everybody|everyone|someone|no|not|yes|use|set|see|for|in|on|at|by|from|to|with|as|if|once|after|before|while|since|although|though|because|according|"
    "honestly|sadly|luckily|finally|however|moreover|also|then|next|now|today|wait|as|near|"
    "der|die|das|ein|eine|wir|ich|sie|er|es|wer|was|warum|wie|wo|wann|siehe|laut|am|im|danach|niemand|"
    "le|la|les|un|une|nous|je|il|elle|qui|pourquoi|comment|voir|quelle|quel|on|el|los|las|una|uno|después|qué|por|quién|cómo|véase|o|os|as|um|uma|depois|quem|veja|que"
)
SPEECH = "wrote|said|asked|says|writes|asks|replied|answered|added|noted|shouted|explained|told|schrieb|sagte|fragte|écrit|dit|demande|escribió|dijo|preguntó|escreveu|disse|perguntou"
EXTENSION = "csv|txt|json|gz|tar|zip|png|jpe?g|gif|svg|pdf|py|ipynb|parquet|md|html?|xml|ya?ml|toml|ini|log|js|ts|java|cpp|h|r|sql|sh|exe|docx?|xlsx?|pptx?|h5|pkl|npy|npz|feather|com|org|net|edu|io|example|nan|inf|shape|columns|index|values|dtype|mean|sum|std|min|max|head|tail|fit|predict|loc|iloc"


#: What stands before a stop: a single letter, a word that ends an abbreviation, another word, a digit,
#: a sign other than a letter that may end an abbreviation, anything else;
#: and after it: white space, a comma or colon, a closing mark, a letter or digit, anything else.
PREVIOUS, NEXT = "iwldcx", "spqao"
#: Stops: one dot, none with a dot in it, others.
STOPS = ".!m"
_NEXT_CLASS = {**dict.fromkeys(",;:", "p"), **dict.fromkeys("\"'”’»›)]}」』）】》〉］｣", "q")}


@dataclass(frozen=True)
class Rule:
    """Break or not where ``before`` matches up to the stop's end and ``after`` from there.

    ``previous``, ``following`` and ``stops`` are the classes of neighbours and stops without which
    it cannot match.
    """

    breaks: bool
    before: re.Pattern[str]
    after: re.Pattern[str]
    previous: str = PREVIOUS
    following: str = NEXT
    stops: str = STOPS


def rule(breaks: bool, before: str, after: str, flags: int = 0, previous: str = PREVIOUS, following: str = NEXT) -> Rule:
    stops = next((kinds for end, kinds in ENDINGS.items() if before.endswith(end)), STOPS)
    return Rule(breaks, re.compile(rf"(?:{before})\Z", flags), re.compile(after, flags), previous, following, stops)


#: The stops of a rule by the end of its pattern.
ENDINGS = {r"\.\.\.|…": "m", r"\.\.+|…+": "m", r"…+|\.\.\.+|⋯+": "m", "[!?]+": "!m", "[。！？．｡]": "!m", "[؟۔।॥!?…]": "!m", r"\.)": ".m", r"\.": ".m", r"\.+": ".m", "[.]": ".m"}


CLOSERS = rf"(?:[   ]?[»›]|[{CLOSE}])*(?:\[\d+\])*"
GAP = rf"{CLOSERS}(?:\s*{EMOTE})*\s+"
START = rf"[\"'“”„«‹(\[¿¡「『（《*_#-]*\s?"
UPPER = rf"{START}[^\W\d_a-zß-öø-ÿа-яё{CASELESS}]"  # begins with a capital of any script
EDGE = r"(?<![\w.])"


#: A noun and its number, as a subject in front.
NUMBERED_NOUN = r"(?!(?:until|about|around|over|under|between|than|plus)\b)[a-z]{4,}\s(?:no\.\s?)?\d"
ABBREVIATED = "iwc"  # classes before the stop of an abbreviation


def _word_rules(lang: str) -> list[Rule]:
    rules = []
    if lang in POINTERS:
        rules.append(rule(False, rf"{EDGE}(?:{POINTERS[lang]})\.", rf"{CLOSERS}\s*\S", re.I, ABBREVIATED))
    if lang in ENDERS:
        enders = rf"{EDGE}(?:{ENDERS[lang]})\."
        rules.append(rule(True, rf"(?i:{enders})", rf"{GAP}(?:{UPPER}|\([^()]*[.!?]\)|[\"“„«][^\W\d_])", previous=ABBREVIATED))
        if lang == "en":
            rules.append(rule(True, enders, rf"{GAP}{START}(?!(?:{CONTINUERS})\b)(?:{OPENERS}|mr|mrs|ms|dr|prof)\b", re.I, ABBREVIATED))
            rules.append(rule(True, enders, rf"{GAP}{NUMBERED_NOUN}", re.I, ABBREVIATED))
            # an adverbial in front of its sentence, set apart by a comma
            rules.append(rule(True, enders, rf"{GAP}(?:in|on|at|by|for|after|before|once|as|to)\s[^.!?,;:]+,", re.I, ABBREVIATED))
        rules.append(rule(False, enders, rf"{CLOSERS}\s*\S", re.I, ABBREVIATED))
    return rules


def _script_rules(lang: str, letters: str) -> list[Rule]:
    """Rules of a script without capitals: abbreviations, and quotations and dots after which the sentence goes on."""
    rules = [rule(False, rf"{EDGE}(?:{CASELESS_ABBREVIATIONS[lang]})\.", r"\s*\S", re.I)] if lang in CASELESS_ABBREVIATIONS else []
    return [
        *rules,
        rule(False, rf"[{STOP}]+", rf"[\"'”’»」』]+\s?[{letters}]", following="q"),
        rule(False, r"…+|\.\.\.+|⋯+", rf"\s?[{letters}]", following="sa"),
    ]


# Words that continue a sentence after an abbreviation that may end one.
CONTINUERS = "in|on|at|by|from|to|with|for|as|if|before|after|while|since|because|that|which|when|where|is|are|was|were|has|have|had|can|will|would|could|should|o|os|un|la|le|y|e|et|und|and|or|der|die|das|am|im"
# Abbreviations of languages without capitals.
CASELESS_ABBREVIATIONS = {
    "zh": "no|vol|fig|约|第\\d+",
    "ja": "no|vol|fig|第\\d+",
    "ko": "no|vol|fig|제\\d+",
    "hi": "डॉ|श्री|श्रीमती|प्रो|कु|पं|ई\\.\\s?पू|रु|कि\\.\\s?मी|सं",
    "ar": "د|أ|م|ص\\.\\s?ب|ق\\.\\s?م|ص|ج",
    "th": "พ\\.\\s?ศ|ค\\.\\s?ศ|ดร|ผศ|รศ|ศ|นพ|พญ|กม|ซม|กก|ม\\.\\s?ค|ก\\.\\s?พ|มี\\.\\s?ค|เม\\.\\s?ย|พ\\.\\s?ค|มิ\\.\\s?ย|ก\\.\\s?ค|ส\\.\\s?ค|ก\\.\\s?ย|ต\\.\\s?ค|พ\\.\\s?ย|ธ\\.\\s?ค",
}
#: The cascade of each language; every list is in order.
LANGUAGE: dict[str, list[Rule]] = {
    "en": [rule(False, rf"{EDGE}no\.", r"\s+\d", re.I, "w", "s"), *_word_rules("en")],
    "de": [*_word_rules("de"), rule(False, r"(?<![\d.,])\d{1,2}\.", r"\s+(?:[a-zäöü]|[A-ZÄÖÜ][a-zäöüß])", 0, "d", "s")],
    "fr": [rule(False, r"(?<![\w.])M\.", r"\s+\S", 0, "i", "s"), *_word_rules("fr")],
    "es": _word_rules("es"),
    "pt": _word_rules("pt"),
    "ru": [
        rule(False, rf"{EDGE}\d{{3,4}}\s*г\.", r"\s+[а-яё\d]", 0, "i", "s"),
        rule(True, rf"{EDGE}\d{{3,4}}\s*гг?\.", rf"{GAP}[«„(]*[А-ЯЁ]", 0, "iw"),
        *_word_rules("ru"),
    ],
    "zh": _script_rules("zh", "㐀-鿿豈-﫿"),
    "ja": _script_rules("ja", CJK),
    "ko": _script_rules("ko", "가-힯"),
    "hi": _script_rules("hi", "ऀ-ॿ"),
    "ar": _script_rules("ar", "؀-ۿ"),
    "th": _script_rules("th", "฀-๿"),
}
GLUED, SPACED, QUOTED = "qao", "spqo", "sq"
#: Texts without capitals: what follows a stop says little, so openers and speech words decide.
LOWER_STYLE = [
    rule(False, rf"[{STOP}]+", rf"[  ]?[{CLOSE}]+,?\s+(?:{SPEECH})\b", following=QUOTED),
    rule(False, r"\.\.\.|…", r"\s+[a-zà-ÿа-яё]", following="s"),
    rule(False, rf"[{STOP}]+", rf"[  ]?[{CLOSE}]+\s*[–—-]\s", following=QUOTED),
    rule(False, r"[!?]+", r"\)\s+[a-zà-ÿа-яё]", following="q"),
    rule(False, r"[.!?]", r"[\"”»’']+\s+(?:and|but|or|und|aber|et|mais|y|e|mas|и|а|но)\b", following="q"),
    rule(True, r"[.!?]", rf"{GAP}\S", following=SPACED),
]
#: Texts in ordinary case.
CASED_STYLE = [
    rule(False, r"\.\.+|…+", rf"{CLOSERS}\s+{START}[a-zà-ÿа-яё]", following="sqo"),
    rule(False, rf"[{STOP}]+", rf"[  ]?[{CLOSE}]+[,;:]?\s*(?:[–—-]\s*)?[a-zà-ÿа-яё]", following=QUOTED),
    rule(True, r"(?:[^\W\d_]{3,}|\d|[)\]%])[.]", rf"{GAP}(?:{OPENERS})\b", 0, "wldcx", SPACED),
    rule(True, r"(?:[^\W\d_]{5,}|(?<![.,\d])\d+)[.]", rf"{GAP}[a-zà-ÿа-яё]", 0, "wldcx", SPACED),
    rule(False, r"\.", rf"{CLOSERS}\s+[a-zà-ÿа-яё]", following="sqo"),
    rule(True, r"[!?]+", rf"\s+{START}[a-zà-ÿа-яё]", following="s"),
]
#: The common table, for every language: what comes before the rules of style ...
COMMON = [
    # parts of numbers, names, paths, addresses and marks such as ``(really!)``
    rule(False, r".", r"[,;:]", re.S, PREVIOUS, "p"),
    rule(True, r"(?:[a-zà-ÿа-яё]{2,}|\d|[)\"”»])[.!?…]+", rf"[(\"“„«¿¡]*[A-ZÀ-ÖØ-ÞА-ЯЁ](?:[a-zà-ÿа-яё]+|)(?:[\s',]|\.\.\.)", 0, "wldcx", GLUED),
    rule(True, r"(?:[a-zà-ÿа-яё]{2,}|\d{2,}|[)\"”»])[.!?]+", rf"(?!(?:{EXTENSION})\b)(?:{OPENERS})(?:[\s',]|\.\.\.)", 0, "wldcx", "a"),
    rule(True, r"[a-z]{2,}[.!?]+", rf"(?!(?:{EXTENSION})\b){NUMBERED_NOUN}", 0, "wl", "a"),
    rule(True, r"[a-zà-ÿа-яё]{2,}[!?]+", r"[^\W\d_]", 0, "wlcx", "a"),
    rule(False, r"\.+", r"[\w/\\-]", 0, PREVIOUS, "ao"),
    rule(False, r"[!?]+", r"[\w=]", 0, PREVIOUS, "ao"),
    # initials and titles
    rule(False, rf"{EDGE}(?:{TITLES})\.", r"\s+\S", re.I, ABBREVIATED, "s"),
    rule(False, r"(?<![\w'’])(?![a-zà-ÿа-яё])[^\W\d_]\.", r"\s+\S", 0, "i", "s"),
    rule(False, r"(?<![\w'’])[^\W\d_]\.\s[^\W\d_]\.|\b(?:by|mr\.|dr\.|ms\.)\s[^\W\d_]\.", r"\s+\S", 0, "i", "s"),
    rule(False, r"(?<![\w'’])[^\W\d_]\.", r"\s+[^\W\d_]\.", 0, "i", "s"),
    rule(False, r"(?:^|[\s(])(?:[^\W\d_]\.)+[^\W\d_]\.", r"\s+[^\W\d_]\.", 0, "i", "s"),
    # a number that begins the paragraph is its mark
    rule(False, r"\A\s*\(?\d{1,3}\.", r"\s+\S", 0, "d", "s"),
    # a quotation that goes on in a script without capitals
    rule(False, rf"[{STOP}]+", rf"[\"'”’»」』]+\s?[{CASELESS}]", following="q"),
    rule(False, r"…+|\.\.\.+|⋯+", rf"\s?[{CASELESS}]", following="sao"),
]
#: ... and what comes after them.
LAST = [
    rule(True, rf"[{STOP}]", rf"{GAP}", following=SPACED),
    rule(True, r"[。！？．｡]", r""),
    rule(True, r"[؟۔।॥!?…]", rf"{CLOSERS}[^\W\d_]", following=GLUED),
]
THAI = re.compile(r"(?:นะครับ|นะคะ|ครับผม|ครับ|ค่ะ|คะ|จ้ะ|จ๊ะ)(?=\s)")
CANDIDATE = re.compile(rf"[{STOP}]+")
MAY_EMOTE = re.compile(r"\s[:;=<^\U0001F000-\U0001FAFF☀-➿]")
EMOTE_ONLY = re.compile(rf"(?<=\s){EMOTE}(?=\s)")
AFTER_STOP = re.compile(rf"{CLOSERS}(?:\s*{EMOTE})*")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")
ITEM = re.compile(r"\s*(?:[-*+•‣◦▪·–—]\s+|\(?\d{1,3}(?:\.\d{1,3})*[.)]\s+|\(?[a-zA-Z][)]\s+|[-*+]?\s*\[[ xX]\]\s+)\S")
HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s+|$)")
NUMBERED = re.compile(r"\s*\d{1,2}(?:\.\d{1,2})*\.?\s+\S")
ENDS = re.compile(rf"(?:[{STOP}:;,]|{EMOTE})[{CLOSE}]*(?:\[\d+\])*\s*$")
OPEN_END = re.compile(r"[,;(–—-]\s*$")

_WORDS = {
    "de": "der die das und nicht ist mit von für den im ein eine zu auf wurde wer siehe nach sinkt".split(),
    "fr": "le la les et est une des du que pour dans qui sur pas cette ensuite la perte".split(),
    "es": "el los las y una del que para con por qué se es no tras archivo columna".split(),
    "pt": "o os as e uma do da que para com por se é não após arquivo coluna depois".split(),
    "en": "the and of is a to in for that it was with on this are not as be".split(),
}
_SCRIPTS = [("ja", re.compile(r"[぀-ヿ]")), ("ko", re.compile(r"[가-힯]")), ("zh", re.compile(r"[㐀-鿿]")), ("ru", re.compile(r"[а-яё]", re.I)), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")), ("th", re.compile(r"[฀-๿]"))]


class _ScriptOf(dict):
    """Script of a sign and whether it is a letter, found once for each sign."""

    def __missing__(self, sign: str) -> tuple[str | None, bool]:
        self[sign] = next((k for k, p in _SCRIPTS if p.match(sign)), None), sign.isalpha()
        return self[sign]


_SCRIPT_OF = _ScriptOf()


def language_of(text: str, lang: str | None) -> str:
    """The language whose tables apply: the label if it names one of them, else by script and words."""
    code = (lang or "").strip().lower().replace("_", "-").split("-")[0]
    if code in LANGUAGE and code not in ("en",):
        return code
    if not text.isascii():
        letters, own = 0, Counter()
        for sign, n in Counter(text).items():
            script, letter = _SCRIPT_OF[sign]
            letters += n if letter else 0
            if script:
                own[script] += n
        for key, _ in _SCRIPTS if own else ():
            if own[key] > (0.1 if key == "ja" else 0.3) * max(1, letters):
                return key
    if code == "en":
        return code
    words = Counter(text.lower().split())
    return max(_WORDS, key=lambda k: sum(words[w] for w in _WORDS[k])) if words else "en"


def cascade(lang: str, lower: bool) -> list[Rule]:
    """Tables in the order in which they decide; foreign abbreviations come after the own ones."""
    others = [r for k in POINTERS if k != lang for r in _FOREIGN[k]]
    return LANGUAGE[lang] + _TITLES + others + COMMON + (LOWER_STYLE if lower else CASED_STYLE) + LAST


_TITLES = [rule(False, rf"{EDGE}(?:{TITLES})\.", r"\s+\S", re.I, ABBREVIATED, "s")]
# of other languages only abbreviations that are no words anywhere
_SAFE = {
    "en": "i\\.e|e\\.g|approx|vs|cf|fig|u\\.s", "de": "bzw|vgl|d\\.\\s?h|z\\.\\s?b|abb|ca", "fr": "env|p\\.\\s?ex|janv", "es": "p\\.\\s?ej|aprox", "pt": "p\\.\\s?ex|aprox", "ru": "т\\.\\s?е|см|рис",
}
_FOREIGN = {k: [rule(False, rf"{EDGE}(?:{v})\.", r"\s*[^\W_]", re.I, ABBREVIATED)] for k, v in _SAFE.items()}
#: The last words of all abbreviations, in lower case.
_ABBREVIATIONS = {re.search(r"[^\W\d_]*$", form).group() for table in (TITLES, "no", *POINTERS.values(), *ENDERS.values(), *_SAFE.values(), *CASELESS_ABBREVIATIONS.values()) for w in table.split("|") for form in {w.replace("?", ""), w[:-2] if w.endswith("?") else w}}
#: Abbreviations of four letters and more: after any other such word, a stop before a capital ends the sentence in all tables.
_LONG_ABBREVIATIONS = {w for w in _ABBREVIATIONS if len(w) > 3}


def _by_neighbours(rules: list[Rule]) -> dict[str, list[Rule]]:
    """The rules that can match at a stop, in order, by the classes of its neighbours."""
    return {a + b + c: [r for r in rules if a in r.previous and b in r.following and c in r.stops] for a in PREVIOUS for b in NEXT for c in STOPS}


_CASCADES = {(k, low): _by_neighbours(cascade(k, low)) for k in LANGUAGE for low in (False, True)}


def word_before(body: str, s: int) -> int:
    """Where the letters that end at ``s`` begin."""
    k = s
    while k and body[k - 1].isalpha():
        k -= 1
    return k


def neighbours(body: str, k: int, s: int, e: int) -> str:
    """Classes of what stands before the stop at ``s``, letters from ``k`` on, and after its end ``e``."""
    if k < s:
        before = "i" if s - k == 1 else "w" if body[k:s].lower() in _ABBREVIATIONS else "l"
    else:
        sign = body[s - 1 : s]
        before = "d" if sign.isdigit() else "x" if sign.isascii() or sign != "°" and unicodedata.category(sign)[0] != "M" else "c"
    following = body[e : e + 1]
    stop = "." if e - s == 1 and body[s] == "." else "m" if "." in body[s:e] or "…" in body[s:e] else "!"
    return before + ("s" if following.isspace() or not following else _NEXT_CLASS.get(following) or ("a" if following.isalnum() or following == "_" else "o")) + stop


def decide(rules: list[Rule], tail: str, body: str, e: int) -> bool:
    """The first rule that matches ``tail`` before and ``body`` from ``e`` on decides."""
    for r in rules:
        if r.after.match(body, e) and r.before.search(tail):
            return r.breaks
    return False


def tail_of(body: str, last: int, s: int, e: int, plain: bool) -> str:
    """What the rules see before the end of a stop: the last three words of the sentence that begins
    at ``last``; of a ``plain`` word, no abbreviation, the end is enough."""
    return body[max(last, s - 8) : e] if plain else " ".join(body[last:e].rsplit(None, 3)[-3:])


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole): blocks of a text in order; a whole one is one unit (heading, list item)."""
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    width = max((len(ln.rstrip()) for _, ln in lines), default=0)
    fence = ""
    group: list[tuple[int, str]] = []

    def flush() -> Iterator[tuple[int, int, bool]]:
        if group:
            yield from paragraph(group, width)
            group.clear()

    for start, line in lines:
        mark = FENCE.match(line)
        if fence:
            if mark and mark.group(1)[0] == fence[0] and len(mark.group(1)) >= len(fence) and not line[mark.end() :].strip():
                fence = ""
            continue
        if mark and not (mark.group(1)[0] == "`" and "`" in line[mark.end() :]):
            yield from flush()
            fence = mark.group(1)
        elif not line.strip():
            yield from flush()
        elif HEADING.match(line):
            yield from flush()
            yield start, start + len(line), True
        else:
            group.append((start, line))
    yield from flush()


def paragraph(group: list[tuple[int, str]], width: int) -> Iterator[tuple[int, int, bool]]:
    """Split the lines of one paragraph into list items, an unmarked heading and running text."""
    k, n = 0, len(group)
    if n > 1 and set(group[1][1].strip()) in ({"="}, {"-"}) and len(group[1][1].strip()) >= 3:
        yield group[0][0], group[0][0] + len(group[0][1]), True
        k = 2
    elif is_title(group, width):
        yield group[0][0], group[0][0] + len(group[0][1]), True
        k = 1
    while k < n:
        start, line = group[k]
        fresh = k == 0 or ENDS.search(group[k - 1][1]) or ITEM.match(group[k - 1][1]) or k == 1 or not wrapped(group[k - 1][1], line, width)
        if ITEM.match(line) and fresh:
            end = k + 1
            while end < n and not ITEM.match(group[end][1]) and (group[end][1][:1] in " \t" or wrapped(group[end - 1][1], group[end][1], width) and not ENDS.search(group[end - 1][1])):
                end += 1
            yield start, group[end - 1][0] + len(group[end - 1][1]), True
            k = end
            continue
        end = k + 1
        while end < n and not (ITEM.match(group[end][1]) and (ENDS.search(group[end - 1][1]) or not wrapped(group[end - 1][1], group[end][1], width))):
            end += 1
        yield start, group[end - 1][0] + len(group[end - 1][1]), False
        k = end


def wrapped(line: str, following: str, width: int) -> bool:
    """The break after ``line`` is one that filling lines to ``width`` would make."""
    first = following.split(maxsplit=1)[0] if following.strip() else ""
    if re.match(rf"[{CJK}฀-๿]", first):
        first = first[:1]
    return len(line.rstrip()) + 1 + len(first) > min(width, 100) - 1


def is_title(group: list[tuple[int, str]], width: int) -> bool:
    """The first line of a paragraph is an unmarked heading: short, without a stop, not a wrapped line."""
    if len(group) < 2:
        return False
    line, following = group[0][1], group[1][1]
    text = line.strip()
    if ENDS.search(text) or OPEN_END.search(text) or len(text) > 70 or len(text.split()) > 9 or ITEM.match(line) and not NUMBERED.match(line):
        return False
    if wrapped(line, following, int(width * 0.8)):
        return False
    if NUMBERED.match(line) and ITEM.match(following):
        return False
    # breaks at random places in the rest mean that this one is random too
    for (_, a), (_, b) in zip(group[1:-1], group[2:], strict=True):
        if not ENDS.search(a) and not ITEM.match(b) and not ITEM.match(a) and not wrapped(a, b, width):
            return False
    begins = following.lstrip("\"'“„«¿¡([*_ 「『　")
    return not (text[:1].isupper() and begins[:1].islower() and re.match(r"[^\W\d_]+(?:\s|$)", begins))


def sentences(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """Sentence spans of a text in code points, end exclusive, without outer white space."""
    return sentences_in(text, language_of(text, lang))


def sentences_in(text: str, own: str) -> list[tuple[int, int]]:
    """``sentences`` by the tables of the language ``own``."""
    out = []
    for start, end, whole in blocks(text):
        if whole:
            cuts = []
        else:
            cuts = list(_cuts(text, start, end, own))
        for a, b in zip([start, *cuts], [*cuts, end], strict=True):
            piece = text[a:b]
            lead = len(piece) - len(piece.lstrip())
            if lead < len(piece):
                out.append((a + lead, a + len(piece.rstrip())))
    return out


def is_lower(part: str) -> bool:
    """Hardly any capital: at most one in 250 small letters, and at least one of these."""
    if len(part) < 250 or part == part.lower():
        return part == part.lower() and part != part.upper()
    if part.isascii():
        signs = np.frombuffer(part.encode(), np.uint8)
        low, cased = int(((signs >= 97) & (signs <= 122)).sum()), int(((signs >= 65) & (signs <= 90)).sum())
    else:
        low, cased = sum(map(str.islower, part)), sum(map(str.isupper, part))
    return low > 0 and cased <= 0.004 * low


def _cuts(text: str, start: int, end: int, lang: str) -> Iterator[int]:
    body = text[start:end].rstrip()
    lower = is_lower(body)
    cascades = _CASCADES[lang, lower]
    spots = [(m.start(), m.end(), 0) for m in CANDIDATE.finditer(body)]
    extra = [(m.start(), m.end(), 1) for m in EMOTE_ONLY.finditer(body)] if MAY_EMOTE.search(body) else []
    if lang == "th":
        extra += [(m.start(), m.end(), 2) for m in THAI.finditer(body)]
    if extra:
        spots = sorted(spots + extra)
    last, straight = 0, '"' in body
    for s, e, kind in spots:
        if s < last:
            continue
        if kind == 2:
            cut = AFTER_STOP.match(body, e).end()
        elif kind == 1:
            rest = body[e:].lstrip()
            if not rest or not (lower or re.match(UPPER, rest) or re.match(rf"{START}[{CASELESS}\d]", rest)):
                continue
            cut = e
        else:
            k = word_before(body, s)
            odd = straight and body.count('"', last, e) % 2 == 1
            if e - s == 1 and not odd and _plain_end(body, k, s, e):
                yield start + e
                last = e
                continue
            # a straight quote after the stop closes only if one is open
            following = body[e : e + 1]
            opens = following == '"' and not odd or following == "“" and (lang in ("zh", "ja") or "„" not in body[last:e])
            # inside a quotation that goes on: only its end may end the sentence
            if odd and following.isspace() and _inside(body, last, e):
                continue
            near = neighbours(body, k, s, e)
            tail = tail_of(body, last, s, e, near[0] == "l")
            if not (decide(cascades[near[0] + "s" + near[2]], tail, " " + body[e:], 0) if opens else decide(cascades[near], tail, body, e)):
                continue
            cut = e if opens else AFTER_STOP.match(body, e).end()
        if cut >= len(body):
            break
        yield start + cut
        last = cut


def _plain_end(body: str, k: int, s: int, e: int) -> bool:
    """A long word from ``k``, no abbreviation, one stop, blanks and a capital: every cascade breaks here."""
    if s - k < 4 or body[s] not in ".!?" or not body[e : e + 1].isspace():
        return False
    if k and (body[k - 1] in "._/\\@#" or body[k - 1].isdigit()) or body[k:s].lower() in _LONG_ABBREVIATIONS:
        return False
    n = e + 1
    while body[n].isspace():
        n += 1
    return body[n].isupper()


def _inside(body: str, last: int, at: int) -> bool:
    """The stop stands in a straight quotation that still has text before its end."""
    opened = body.rfind('"', last, at)
    return 0 <= opened and body.find('"', at) >= 0 and not body[opened + 1 : opened + 2].isspace()


SCHEMA = "doc_id long, start_pos long, end_pos long, lang_used string"


def _spans(documents: DataFrame, texts: bool) -> DataFrame:
    """A row for each sentence, with its text if ``texts``; made in Arrow, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, starts, ends, langs, found = [], [], [], [], []
            for row, (text, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True)):
                own = language_of(text, lang)
                langs.append(own)
                for a, b in sentences_in(text, own):
                    at.append(row)
                    starts.append(a)
                    ends.append(b)
                    if texts:
                        found.append(text[a:b])
            where = pa.array(at, pa.int64())
            columns = [batch.column("doc_id").take(where), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(langs, pa.string()).take(where)]
            names = ["doc_id", "start_pos", "end_pos", "lang_used"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(found, pa.string())] * texts, names=names + ["sentence"] * texts)

    return spread(documents.select("doc_id", "text", "lang").where("text is not null")).mapInArrow(run, SCHEMA + ", sentence string" * texts)


def split_sentences(documents: DataFrame) -> DataFrame:
    """Sentences of ``documents`` (doc_id, text, lang) as (doc_id, start_pos, end_pos, lang_used).

    Positions count code points from 0, end exclusive.  A null, empty or blank text has no
    sentence; a null or unknown lang is found from script and words.  Whole texts are processed;
    other columns are ignored, repeated rows give their sentences again, an empty table none.
    """
    return _spans(documents, False)


def sentence_texts(documents: DataFrame) -> DataFrame:
    """``split_sentences`` with the text of each sentence, cut where the spans are made."""
    return _spans(documents, True)
