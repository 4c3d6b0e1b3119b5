"""Sentence boundaries across languages and scripts, by cascading segmentation rule tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from types import ModuleType

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.pages import without_headers

# ------------------------------------------------------------------ fixed values: abbreviations and common words by language

#: never the last word of a sentence, in each language of the Latin script and beyond them
ABBREVIATIONS = {
    "shared": "Mr Mrs Ms Messrs Dr Prof Mme Mlle MM Dña Sra Sres Hrn Sgt Capt viz i.e e.g vs v cf Cf vgl Vgl approx incl Esk Rep Nos Cass\\.\\s*(?:com|civ|soc|crim)",
    "en": "Rev Hon Col Gen Lt Maj St Mt Rd Ave ed eds c ca",
    "de": "Hr Fr Urt Beschl ca bzw z d i u m w o Str Tsd Mio Mrd ff f sog gem einschl usw Anm",
    "fr": "M Me Pr St Ste Cass c C éd et\\s+al par\\s+ex p\\.\\s*ex",
    "es": "Sr Srta D Da Ud Uds Excmo Ilmo p\\.\\s*ej",
    "ru": "т п с см См Пост пост ст др тыс млн млрд гр ул д г им проч пр стр абз гл ч Ст ред обл р",
    "ar": "د ص م ج أ",
    "hi": "डॉ पृ आ आ.नि श्री सं प्रो क्र",
}
#: words of their own otherwise: abbreviations only before a number, a bracket or something blacked out
BEFORE_NUMBERS = "No no nos Nr Nrn núm núms Núm n p pp pág págs Pág s S ss r rr ex exh H Hs h t Fig Figs fig App Apps Sch sch para paras Para Paras Art art arts Abs Az Bl Rn Rdnr Ziff lit Buchst Cl al vol Vol ch chap apdo Exh"
#: those of them that letters number as well
BEFORE_LETTERS = "Fig Figs fig App Apps Sch sch Art art Cl Exh exh ex Vol vol chap lit Buchst"
#: take a number after them, but end a sentence before a capital
NUMBERED = "yrs hrs A.L.R a.m p.m"
#: name endings: may close a sentence before a capital, never before a small letter, bracket or number
COMPANIES = "Ltd Inc Co Corp Bros plc S.A S.L SARL SAS e.K"
GERMAN_MONTHS = "Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember"
#: frequent words that tell a language of the Latin script
COMMON = {
    "en": "the of and to that was is with by it be which from has this are or were had not court shall he she they his their for",
    "de": "der das und dem den vom von zu mit ist nicht für ein eine einer sich auch wird wurde hat bei nach im als dass die er sie",
    "fr": "le les du et dans qui par pour sur au aux une pas il elle ont été sont ne ce cette son des est",
    "es": "el los las del y una con por se lo fue ha sido como al su sus este esta ante",
}

# ------------------------------------------------------------------ scripts and characters

THAI, CJK = r"฀-๿", r"぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
# blanks between Thai letters are positions too: see THAI_BLANK
PAIRS = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "«": "»", "“": "”", "„": "“", "【": "】", "‹": "›", "‚": "‘"}
CLOSERS = set(PAIRS.values()) | {'"', "“"}
WIDE = set("。！？｡")
TERMINALS = set(".!?…。！？｡؟।॥۔")
TOKENS = re.compile(rf'[.!?…。！？｡؟।॥۔]+|[()\[\]（）［］「」『』《》«»“”„【】‹›‚‘"]|(?<=[{THAI}])[ \t ​]+(?=[{THAI}])')
OPENER = re.compile("[" + re.escape("".join(PAIRS)) + '"]')
BREAK = r"(?:\r\n|\n|\r(?!\n))"
BLOCK_END = re.compile(rf"{BREAK}(?:[ \t\x0b\x0c ]*{BREAK})+")
MARKER = re.compile(r"\s*(?:¶\s*\d+\.?|[(（]\d+[)）]|\[\d+\]|\d+[.)](?!\d)|§+\s*\d+\.|[IVXLC]+\.|[A-Z][.)])(?=\s)\s*")


def _words(text: str) -> str:
    """Alternatives, longest first; words with a backslash are patterns already."""
    return "|".join(w if "\\" in w else re.escape(w) for w in sorted(text.split(), key=len, reverse=True))


@dataclass(frozen=True)
class Rule:
    """A pair of patterns: what precedes a position (ending there) and what follows it, blanks left out; None fits all."""

    breaks: bool
    before: re.Pattern[str] | None
    after: re.Pattern[str] | None
    own: bool = False  # of one language among those of a script


def rule(breaks: bool, before: str, after: str = "", engine: ModuleType = re, own: bool = False) -> Rule:
    return Rule(breaks, engine.compile(rf"(?:{before})\Z") if before else None, engine.compile(after) if after else None, own)


W0 = r"(?<![^\W_])"  # a word begins here
NUMBERS = r"[\d(█*\[§]"

#: Tables cascade: that of a language or script comes first, the shared one last; the first rule that fits decides.
_LATIN_FIRST = [
    rule(False, r"", r"[,;:）)\]，、；：]|[–—-]\s"),
    rule(False, r"", r"[a-zß-öø-ÿœ]"),
    # names of companies and closing formulas of citations
    rule(False, r"\./\.|/\.", r""),
    rule(False, r"(?<!\w)e\.", r"[KV]\."),
    rule(True, rf"{W0}(?:m\.\s*w\.\s*N|d\.\s*A|e\.\s*K|p\.\s*a)\.", r"[^\W\d_]|[„“\"«¿¡█*\[]"),
    rule(False, rf"{W0}(?:{_words(COMPANIES)})\.", r"[(\d&]"),
    rule(True, rf"{W0}(?:{_words(COMPANIES)})\.", r""),
    rule(False, rf"{W0}(?:{_words(NUMBERED)}|per\s+cent)\.", r"[\d(█*\[]"),
    rule(True, rf"{W0}(?:{_words(NUMBERED)})\.", r""),
]
_GERMAN_DAYS = [
    rule(False, r"(?<!\d)\d{1,2}\.", rf"(?:{_words(GERMAN_MONTHS)}|M\S{{1,3}}rz|J\S{{1,3}}nner)(?!\w)", own=True),
    rule(False, r"(?<!\w)(?:[Aa]m|[Zz]um|[Vv]om|[Dd]em|[Dd]en)\s+\d{1,2}\.", r"[█*\[]|[A-Z]\.", own=True),
]
_REFERENCE = rule(False, rf"{W0}(?:{_words(BEFORE_NUMBERS)})\.", NUMBERS)
_LATIN_LAST = [
    rule(False, rf"{W0}(?:{_words(BEFORE_LETTERS)})\.", r"(?:[IVXLC]{1,6}|[A-Z])(?![^\W_])"),
    rule(False, r"(?<!\w)[A-ZÀ-ÖØ-Þ]\.", r""),  # initials, and X. for a name taken out
    rule(False, r"\s(?:\.\.\.|…)", r"[█*\[\d]"),  # a gap in a quotation
]


def _latin(*languages: str) -> list[Rule]:
    own = " ".join(ABBREVIATIONS[x] for x in languages)
    return [*_LATIN_FIRST[:2], rule(False, rf"{W0}(?:{_words(ABBREVIATIONS['shared'])})\.", r""), _REFERENCE, *_LATIN_FIRST[2:], *(_GERMAN_DAYS if "de" in languages else []), rule(False, rf"{W0}(?:{_words(own)})\.", r"", own=True), *_LATIN_LAST]


#: by language; "" where no language can be told
LATIN = {**{x: _latin(x) for x in COMMON}, "": _latin(*COMMON)}
CYRILLIC = [
    rule(False, r"", r"[,;:）)\]]|[–—-]\s"),
    rule(False, r"", r"[а-яёa-z]"),
    rule(True, r"\d\s*г\.", r"[А-ЯЁ«\[█*\d]"),
    rule(True, r"(?<!\w)руб\.", r""),
    rule(True, r"(?<!\w)и (?:др|пр|проч)\.", r"[А-ЯЁ«]"),
    rule(False, rf"(?<!\w)(?:{_words(ABBREVIATIONS['ru'])})\.", r""),
    rule(False, r"(?<!\w)[А-ЯЁ]\.", r""),
]
ARABIC = [rule(False, r"", r"[,;:،؛)\]]"), rule(False, rf"(?<!\w)(?:{_words(ABBREVIATIONS['ar'])})\.", r"")]
INDIC = [rule(False, r"", r"[,;:)\]]"), rule(False, rf"(?:{_words(ABBREVIATIONS['hi'])})\.", r"")]
THAI_RULES = [rule(False, r"", r"[,;:)\]]"), rule(False, rf"[{THAI}]\.", r"")]
WIDE_RULES = [rule(False, r"", r"[，、；：)）」』”]"), rule(False, r"(?:…|\.\.\.)+", r"")]
SHARED = [rule(False, r"", r"[,;:)\]]"), rule(True, r"", r"")]
#: blanks between Thai letters
THAI_BLANK = [rule(True, rf"[{THAI}]", rf"[{THAI}]"), rule(False, r"", r"")]

_BRACKET = r"[(\[（［【《]"
#: After a quotation or bracket whose last sentence is complete. Before: ^ if it opens the sentence around it, else ~,
#: and its opener; after: what follows, blanks kept as one.
QUOTED = [
    rule(False, r"", r" ?(?:[,;:，、；：،؛]|[–—-]\s)", regex),
    rule(False, r"", r" ?\p{Ll}", regex),
    rule(True, r"\^" + _BRACKET, r" ?(?:\p{Lu}|\P{L})", regex),
    rule(False, _BRACKET, r"", regex),
    rule(True, r"", r" ?\p{Lu}", regex),
    rule(True, r"~.", r" ?[(\[（［「『《«“„【‹‚\"]", regex),
    rule(True, r"", r" [(\[（［「『《«“„【‹‚\"]", regex),
    rule(False, r"", r"[(\[（［「『《«“„【‹‚\"]", regex),
    rule(False, r"[「『]", r" ?[とっのがをにはもで]", regex),
    rule(True, r"~.", rf" ?[{CJK}]", regex),
    rule(False, r"", rf" ?[{CJK}]", regex),
    rule(True, r"~.", r" \p{L}", regex),  # scripts without case: a quotation that opens a sentence is attributed after it
    rule(False, r"", r" ?\p{L}", regex),
    rule(True, r"", r" ", regex),
    rule(False, r"", r"", regex),
]
#: after a terminal with lost blanks: only what surely begins anew
JOINED = [
    rule(True, r"", r"[¿¡«“„\"「—]", regex),
    rule(True, r"", r"\p{Lu}(?!\p{Lu})|[\p{Lo}\p{Lt}\p{Lm}]", regex),
    rule(False, r"", r"", regex),
]

#: words that pairs speak of, by script; where a position follows another word of letters, only pairs that look no
#: farther back than it can fit
FINAL = {
    id(table): frozenset(re.findall(r"[^\W\d_]+", " ".join([*words, *(ABBREVIATIONS[x] for x in languages)]).replace("\\s", " ")))
    for table, words, languages in ((LATIN[""], [BEFORE_NUMBERS, NUMBERED, COMPANIES, "cent"], ["shared", *COMMON]), (CYRILLIC, ["руб др пр проч"], ["ru"]))
}
_TABLES = (LATIN[""], CYRILLIC, ARABIC, INDIC, THAI_RULES, WIDE_RULES)


def _after_only(rules: list[Rule]) -> list[Rule]:
    return [r for r in rules if r.before is None and r.after is not None and not r.breaks]


#: what goes on after any word: pairs that look only ahead; they lead each table, so that those of the table come first
AHEAD = {id(t): re.compile("|".join(r.after.pattern for r in _after_only(t))) for t in _TABLES}
GOES_ON = {id(t): re.compile("|".join(r.after.pattern for r in _after_only([*t, *SHARED]))) for t in _TABLES}

MISREAD = re.compile("Ã([\x80-\xbf])")  # UTF-8 read as Latin-1
#: in a block without capitals, small letters begin sentences, but not after these
SMALL_LETTERS = [rule(False, rf"(?<!\w)(?:\w|{_words(' '.join(ABBREVIATIONS.values()).lower())})\.", r"[^\W\d_]")]
_LANGUAGE_OF = {w: x for x, words in COMMON.items() for w in words.split()}
_LATIN_WORD = re.compile(r"[a-zà-öø-ÿ]+")


def language_of(text: str) -> str | None:
    """The language of the Latin script whose common words are most frequent, None if there are none or two tie."""
    votes = dict.fromkeys(COMMON, 0)
    for w in _LATIN_WORD.findall(text.lower()):
        x = _LANGUAGE_OF.get(w)
        if x:
            votes[x] += 1
    first, second = sorted(votes.values(), reverse=True)[:2]
    return max(votes, key=votes.__getitem__) if first > second else None


class Tongue:
    """The language of a block, told from it, else from the whole text, else from its label; looked up once needed."""

    def __init__(self, text: str, hint: str | None) -> None:
        self.text, self.hint, self.whole, self.block = text, hint, None, ("", 0, 0, None)

    def of(self, lo: int, hi: int) -> str:
        if self.block[1:3] != (lo, hi):
            self.block = ("", lo, hi, self._told(lo, hi))
        return self.block[3]

    def _told(self, lo: int, hi: int) -> str:
        if x := language_of(self.text[lo:hi]):
            return x
        if self.whole is None:
            label = (self.hint or "").strip().lower()[:2]
            self.whole = language_of(self.text) or (label if label in COMMON else "")
        return self.whole


def table_for(ch: str) -> list[Rule]:
    """The cascade for a position, by the script of the character before its punctuation."""
    o = ord(ch)
    if 0x400 <= o < 0x530:
        return CYRILLIC
    if 0x600 <= o < 0x780:
        return ARABIC
    if 0x900 <= o < 0x980:
        return INDIC
    if 0xE00 <= o < 0xE80:
        return THAI_RULES
    if 0x3000 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x40000:
        return WIDE_RULES
    return LATIN[""]


def _written(t: str) -> str:
    """A stretch of context with composed accents and the commonest mis-decoding undone."""
    if t.isascii():
        return t
    if "Ã" in t:
        t = MISREAD.sub(lambda m: chr(ord(m.group(1)) + 64), t)
    return unicodedata.normalize("NFC", t)


SIGHT = 24  # no rule looks further, blanks counted as one


def _before(text: str, lo: int, end: int) -> str:
    """What precedes a position, runs of blanks and line breaks as one blank, however long they are."""
    n = SIGHT
    while True:
        w = text[max(lo, end - n) : end]
        c = " ".join(w.split())
        if len(c) >= SIGHT or end - n <= lo:
            return _written(c[-SIGHT:])
        n *= 2


def _after(text: str, nxt: int, hi: int) -> str:
    n = SIGHT
    while True:
        w = text[nxt : min(hi, nxt + n)]
        c = " ".join(w.split())
        if len(c) >= SIGHT or nxt + n >= hi:
            return _written(c[:SIGHT])
        n *= 2


def first_fit(before: str, after: str, *tables: list[Rule]) -> Rule | None:
    """The first rule whose pair fits; None if none does."""
    for rules in tables:
        for r in rules:
            if (r.after is None or r.after.match(after)) and (r.before is None or r.before.search(before)):
                return r
    return None


def breaks(before: str, after: str, rules: list[Rule]) -> bool:
    r = first_fit(before, after, rules)
    return r is not None and r.breaks


class Block:
    """What the decisions of one block share: its bounds, its language, and whether it has no capitals at all."""

    def __init__(self, text: str, lo: int, hi: int, start: int, tongue: Tongue) -> None:
        self.text, self.lo, self.hi, self.start, self.tongue, self.small = text, lo, hi, start, tongue, None

    def without_capitals(self) -> bool:
        if self.small is None:
            own = self.text[self.start : self.hi]
            self.small = own == own.lower() and own != own.upper()
        return self.small

    def _plain(self, end: int, table: list[Rule]) -> bool:
        """Whether no pair that looks back can fit, as after most words."""
        text, lo, k = self.text, self.lo, end - 1
        if text[k] != ".":
            return text[k] != "…"
        final = FINAL.get(id(table))
        if final is None:
            return False
        while k > lo and text[k - 1].isalpha():
            k -= 1
        w = text[k : end - 1]
        if len(w) > 3:
            return w not in final and "Ã" not in w and (k == lo or text[k - 1].isspace())
        return not w and text[end - 4 : end - 1].isdigit() and end - 4 >= lo

    def decides(self, end: int, nxt: int, script: str) -> bool:
        """Whether a unit ends at ``end``: the first rule whose pair fits there decides."""
        text, c = self.text, self.text[nxt]
        table = table_for(script)
        if c != "Ã" and not (c.islower() and self.without_capitals()):
            if AHEAD[id(table)].match(text, nxt):
                return False
            if self._plain(end, table):
                return not GOES_ON[id(table)].match(text, nxt)
        before, after = _before(text, self.lo, end), _after(text, nxt, self.hi)
        if c.islower() and self.without_capitals():  # small letters may begin sentences
            if first_fit(before, after, SMALL_LETTERS):
                return False
            after = (after[:1].upper() if len(after[:1].upper()) == 1 else after[:1]) + after[1:]
        r = first_fit(before, after, table, SHARED)
        if r.own:  # so a language of the script says: is it the block's?
            r = first_fit(before, after, LATIN[self.tongue.of(self.lo, self.hi)], SHARED)
        return r.breaks


def _pairs(text: str, found: list[re.Match[str]]) -> dict[int, int]:
    """Positions of openers to those of their closers; quotes and brackets without a partner are left out."""
    out, stack = {}, []
    for m in found:
        c, at = m.group(), m.start()
        if c[0] in TERMINALS or len(c) > 1 or c.isspace():
            continue
        if c == '"':
            k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == '"'), -1)
            if k >= 0:
                out[stack[k][1]] = at
                del stack[k:]
            else:
                stack.append(('"', at))
            continue
        k = next((i for i in range(len(stack) - 1, -1, -1) if PAIRS.get(stack[i][0]) == c), -1)
        if k >= 0:
            out[stack[k][1]] = at
            del stack[k:]
        elif c in PAIRS:
            stack.append((c, at))
    return out


def _skip(text: str, at: int, hi: int) -> int:
    while at < hi and text[at].isspace():
        at += 1
    return at


def block_units(text: str, lo: int, hi: int, tongue: Tongue | None = None) -> Iterator[int]:
    """Ends of the units of one block, text[lo:hi]."""
    while hi > lo and (text[hi - 1].isspace() or text[hi - 1] in "​﻿"):
        hi -= 1
    lo = _skip(text, lo, hi)
    if lo >= hi:
        return
    tongue = tongue or Tongue(text, None)
    m = MARKER.match(text, lo, hi)
    start = m.end() if m else lo  # where the running sentence begins, paragraph number aside
    found = list(TOKENS.finditer(text, start, hi))
    pairs = _pairs(text, found) if found and OPENER.search(text, start, hi) else {}
    inside = start
    block = Block(text, lo, hi, start, tongue)
    for f in found:
        at, end = f.span()
        c = text[at]
        if at < inside:
            continue
        if c not in TERMINALS:
            if c.isspace():
                if breaks(text[at - 1], text[end], THAI_BLANK):
                    yield at
                    start = inside = end
            elif at in pairs:
                close = pairs[at]
                inside = close + 1
                last = close - 1
                while last > at and text[last].isspace():
                    last -= 1
                while last > at and text[last] in CLOSERS:
                    last -= 1
                if text[last] not in TERMINALS or not any(x.isalpha() for x in text[at + 1 : last]):
                    continue
                end = close + 1
                while end < hi and text[end] in CLOSERS and end not in pairs:
                    end += 1
                nxt = _skip(text, end, hi)
                if nxt >= hi:
                    continue  # the end of the block ends it
                if text[nxt] in TERMINALS:  # the sentence goes on to its own full stop
                    continue
                around = ("^" if _skip(text, start, at) == at else "~") + c
                if breaks(around, (" " if nxt > end else "") + text[nxt : nxt + 2], QUOTED):
                    yield end
                    start = inside = nxt
            continue
        # a terminal outside quotations and brackets, with what closes after it
        while True:
            nxt = _skip(text, end, hi)
            if nxt < hi and text[nxt] in CLOSERS and nxt not in pairs and (nxt == end or text[nxt] == "»"):
                end = nxt + 1
                continue
            break
        if nxt >= hi:
            break
        wide = text[at] in WIDE or text[f.end() - 1] in WIDE
        if nxt == end and not wide and (text[nxt].isdigit() or not breaks("", text[nxt : nxt + 2], JOINED)):
            continue
        if at == start:  # nothing but punctuation so far
            continue
        script = text[at - 1]
        k = at - 1
        while k > start and not script.isalpha() and not script.isdigit():
            k -= 1
            script = text[k]
        if script.isdigit() and c == "." and not wide:
            script = "a" if text[nxt] < "Ѐ" else text[nxt]
        if block.decides(f.end(), nxt, script):
            yield end
            start = inside = nxt
    yield hi


def unit_ends(text: str | None, hint: str | None = None) -> list[int]:
    """Code points from the start of the text to the end of each of its sentence units."""
    if not text:
        return []
    t = without_headers(text, fill=True)
    tongue = Tongue(t, hint)
    out: list[int] = []
    at = 0
    for m in BLOCK_END.finditer(t):
        out.extend(block_units(t, at, m.start(), tongue))
        at = m.end()
    out.extend(block_units(t, at, len(t), tongue))
    return out


def sentence_units(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """(key, end_pos) of every sentence unit of every text.

    Blocks (parted by blank lines) end units; within a block the rule tables decide each position after
    sentence punctuation, and blanks between Thai letters. The table is that of the block's language, told from
    its common words, else from the text's; a label in ``lang``, if there is one, helps where neither tells. Quotations and brackets are passed over whole; running
    page headers count as blanks. NULL, empty and blank texts have no rows; texts are read whole.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            ends = [unit_ends(t, x if isinstance(x, str) else None) for t, x in zip(pdf[text], pdf["hint_"])]
            counts = [len(e) for e in ends]
            yield pd.DataFrame({key: pdf[key].to_numpy().repeat(counts), "end_pos": np.fromiter((x for e in ends for x in e), np.int32, sum(counts))})

    hint = F.col(lang) if lang in docs.columns else F.lit(None)
    return docs.select(key, text, hint.cast("string").alias("hint_")).mapInPandas(run, f"{key} {kind}, end_pos int")
