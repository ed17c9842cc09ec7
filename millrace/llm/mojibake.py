"""Problem 9: garbled text from wrong character encoding.

For every pair (encoding written, encoding read) the garbled form of each letter and
sign that texts are made of is computed beforehand. UTF-8 read as something else, once to
three times, gives forms of several characters; of scripts written with three bytes a
letter the first two make the form. One single-byte encoding read as another gives forms
of one character, which become patterns together with the neighbours that no sound text
puts beside them: a symbol, a capital or a letter of another script within a word; of
scripts that aren't Latin, two letters make a pattern. Two-byte encodings of Chinese,
Korean and Japanese read as Western ones give pairs of characters. One multi-pattern
automaton finds all of them.

A match proposes its pairs. UTF-8 runs and two-byte encodings are written back sequence by
sequence: what isn't a whole sequence stays as it is, so that no character is dropped or
made up. Single-byte pairs replace the words that hold a match, if the word as it stands
fits no language and becomes sound, and with them words between or beside them on the
line that the same encoding must have garbled. A pair counts only with evidence: several
words, or a word with several letters garbled. What is found but can't be read back for
sure is left as it stands. Rounds go on until nothing changes.

What stands between backticks is a quotation and left alone. U+FFFD marks what a decoder
has thrown away: such a text is found, but can't be restored.

Texts are read in Arrow batches where they lie: nothing is shuffled.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame

# Letters beyond ASCII of the languages known here, in lower case.
LETTERS = {
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíñóúü",
    "pt": "àáâãçéêíóôõú",
    "it": "àèéìíòóù",
    "pl": "ąćęłńóśźż",
    "cs": "áčďéěíňóřšťúůýž",
    "tr": "çğıöşüâî",
    "is": "áæéíðóöþúý",
    "sv": "åäöé",
    "da": "æøåé",
    "hu": "áéíóöőúüű",
    "ro": "ăâîșțşţ",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "uk": "абвгґдеєжзиіїйклмнопрстуфхцчшщьюя",
    "el": "αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ",
}
# Letters of further languages; words of these are sound as they stand, but nothing is restored to them by single-byte pairs.
MORE_LETTERS = {
    "sk": "áäčďéíĺľňóôŕšťúýž",
    "hr": "čćđšž",
    "lt": "ąčęėįšųūž",
    "lv": "āčēģīķļņšūž",
    "et": "äõöüšž",
    "fi": "åäöšž",
    "no": "æøåàéèêóòôü",
    "nl": "áàéèëêíïóöôúü",
    "ca": "àçèéíïòóúü",
    "cy": "âêîôûŵŷáéíóúẃýàèìòùẁỳäëïöüẅÿ",
    "mt": "ċġħżàèìòù",
    "sq": "çë",
    "vi": "àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ",
    "az": "çəğıöşü",
    "eo": "ĉĝĥĵŝŭ",
    "fo": "áðíóúýæø",
    "af": "áäèéêëîïôöûúý",
    "gd": "àèìòùáéó",
    "yo": "àáèéìíòóùúẹọṣǹńḿ",
    "ha": "ɓɗƙƴ",
    "mi": "āēīōū",
    "haw": "āēīōūʻ",
    "be": "абвгдеёжзійклмнопрстуўфхцчшыьэюя",
    "bg": "абвгдежзийклмнопрстуфхцчшщъьюяѝ",
    "sr": "абвгдђежзијклљмнњопрстћуфхцчџш",
    "mk": "абвгдѓежзѕијклљмнњопрстќуфхцчџшѐѝ",
    "kk": "аәбвгғдеёжзийкқлмнңоөпрстуұүфхһцчшщъыіьэюя",
    "mn": "абвгдеёжзийклмноөпрстуүфхцчшщъыьэюя",
}
# Letters and vowel signs of scripts written from legacy encodings, the commonest first, and these encodings.
SCRIPTS = {
    "ru": ("оеаинтсрвлкмдпуяыьзбгчйхжшюцщэф", ("cp1251", "koi8-r", "cp866", "mac_cyrillic", "iso8859-5")),
    "el": ("αοιετσνηυρπκμλωςγδθχφβξζψάίόέήύώ", ("cp1253", "iso8859-7")),
    "he": ("יוהלארתבשמנםעדקחכפטגןצסזךףץ", ("cp1255", "iso8859-8")),
    "ar": ("اليمنوتربعدهفسقكحجةشصطخأذىزضثغإءئظآؤ", ("cp1256", "iso8859-6")),
    "th": ("านรอกเงมยลวดทสตะปบคหแจพชขใไผโถศซณธภญฐษฟฉฎฏฑฒฆฌฮฝ่้ีิัืุู์ำ็ๆฯ๊๋", ("cp874",)),
}
# Encodings as which those of SCRIPTS other than Cyrillic are read.
READ_SCRIPTS = ("cp1252", "latin-1", "mac_roman", "cp1250", "cp437", "cp850")
# Letters of scripts with two bytes a letter in UTF-8, besides Latin, Greek and Cyrillic.
TWO_BYTES = [[*range(0x5D0, 0x5EB)], [*range(0x621, 0x63B), *range(0x641, 0x653), 0x67E, 0x686, 0x698, 0x6A9, 0x6AF, 0x6CC, 0x60C, 0x61F], [*range(0x561, 0x588)]]
# Lines drawn in trees and tables, and the encodings that have their signs.
BOXES = ("├──", "└──", "┌──", "──┐", "──┘", "│├", "│└", "╠══", "╚══")
BOX_WRITTEN = ("cp437", "cp850", "cp866")
# Signs that go with any language.
SIGNS = "\u3000‘’‚“”„–—―…•·×÷°©®™±§«»¡¿€£→←↑↓≈≤≥≠√∞½¼¾⅓²³µ  ​‍️﻿─│└├┌┐■▪✓✔✅❌⚠ªº¹"
# Encodings as which UTF-8 is read, and single-byte encodings taken for one another.
READ_AS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "cp1254", "iso8859-15", "cp1253", "cp1257", "cp437", "cp850", "cp852", "mac_roman", "koi8-r", "cp866")
SINGLE = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "mac_cyrillic", "mac_roman", "cp437", "cp850", "cp1254", "cp1253")
# Encodings of other scripts as which UTF-8 is read; here a run of characters must be UTF-8 as a whole.
READ_AS_STRICT = ("iso8859-5", "iso8859-7", "cp1255", "cp1256", "cp874")
# Two-byte encodings of Japanese, Chinese and Korean, and those as which they are read.
EAST_ASIAN = ("cp932", "euc_jp", "gbk", "big5", "cp949")
READ_EAST_ASIAN = ("cp1252", "latin-1", "mac_roman")
# What the first two bytes of kana become in East Asian encodings.
KANA_LEADS = {"cp932": "縺繧繝", "gbk": "銇銈銉", "big5": "", "cp949": ""}
# Encodings of Chinese, Korean and Japanese as which UTF-8 is read.
EAST_READ_AS = ("gbk", "cp932", "big5", "cp949")
# Marks and forms that normal writing sets beside letters: combining accents, ligatures.
MARKS = "".join(map(chr, (0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x30A, 0x30B, 0x30C, 0x327, 0x328, *range(0xFB00, 0xFB07))))
EMOJI = "😀🙂🚀📦🔁🚦🧵🏁👩💻🎉🔥🐛🇫🇷"


@cache
def table(codec: str) -> str:
    """The 256 characters of a single-byte encoding; unused bytes are read as control characters, as browsers do."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@cache
def reverse(codec: str) -> dict[str, int]:
    return {c: b for b, c in enumerate(table(codec))}


def read_wrongly(raw: bytes, codec: str) -> str:
    t = table(codec)
    return "".join(t[b] for b in raw)


def write_back(text: str, codec: str) -> bytes | None:
    r = reverse(codec)
    try:
        return bytes(r[c] for c in text)
    except KeyError:
        # A run read by Windows' table may hold control characters of Latin-1, and the other way round.
        if codec in ("cp1252", "latin-1"):
            other = reverse("latin-1" if codec == "cp1252" else "cp1252")
            if all(c in r or c in other for c in text):
                return bytes(r[c] if c in r else other[c] for c in text)
        return None


_RUSSIAN = re.compile(r"[а-яёА-ЯЁ]+$")
_CYRILLIC = re.compile(r"[Ѐ-ӿ]")


def _repertoire() -> str:
    lower = "".join([*LETTERS.values(), *MORE_LETTERS.values()])
    kana = "".join(map(chr, [*range(0x3041, 0x3097), *range(0x30A1, 0x30FB), *range(0x3001, 0x3003), 0x30FC]))
    doubled = "".join(map(chr, [*range(0x1D538, 0x1D56C), *range(0x1F300, 0x1F650), *range(0x1F680, 0x1F6C6), *range(0x1F9D0, 0x1FA00)]))
    return "".join(dict.fromkeys(lower + lower.upper() + SIGNS + MARKS + kana + EMOJI + doubled))


def is_sound_word(word: str) -> bool:
    """Whether the letters of a word fit one language and one way of using capitals, without symbols between them."""
    return _sound(word.strip(_EDGES))


def may_stand(word: str) -> bool:
    """Whether a word is to be left as it stands: sound, also in languages to which nothing is restored, a formula's sign before a letter or two, or a list of letters."""
    return _stands(word.strip(_EDGES))


_EDGE = list("()[]{}<>.,;:!?\"'`*_#|/\\-+=~@%&^$") + list("²³¹½¼¾ªº‘’‚“”„–—…«»·•→×°©®™±≈√  │├└─✅⚠¡¿")
_SPLIT = re.compile(r"[\s\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e0-9‘’‚“”„–—…·•→×  │├└─]+")


_EDGES = "".join(_EDGE)


@lru_cache(maxsize=200_000)
def _sound(word: str) -> bool:
    return all(part.isascii() or _fits(part, _sets()) for part in _SPLIT.split(word))


def _fits(part: str, sets: list[frozenset[str]]) -> bool:
    """Whether a part of a word without signs fits one of the languages."""
    letters = {c for c in part.lower() if not c.isascii()} - {"\u0307"}
    if not any(letters <= s for s in sets):
        return False
    if _NOT_LATIN.search(part):
        if re.search("[A-Za-zÀ-ɏ]", part):
            return False
        if not re.search("[Ͱ-ӿ]", part):
            return len(part) >= 2  # without capitals
    if not (part.islower() or part.isupper() or part[:1].isupper() and part[1:].islower() or re.search(r"[a-z][A-Z]", part)):
        return False
    return len(part) < 3 or bool(_NOT_LATIN.search(part)) or bool(re.search("[A-Za-z]", part))  # no Latin word is made of accented letters alone


@lru_cache(maxsize=200_000)
def _stands(word: str) -> bool:
    for part in _SPLIT.split(word):
        if part.isascii() or _fits(part, _sets()) or _fits(part, _more_sets()):
            continue
        letters = [c for c in part if c.isalpha()]
        if len(letters) == len(part) == len(set(part)) and not any(c.isascii() for c in part):
            if list(part) == sorted(part) or not _NOT_LATIN.search(part) and any(set(part.lower()) <= s for s in _sets() + _more_sets()):
                continue  # a list of letters
        bare = part.strip(_FORMULA)
        if (bare.isascii() or _stands_alone(bare)) and (len(bare) <= 2 or len(part) == len(bare) or part[0] in _OPERATORS):
            continue
        if not letters or re.fullmatch("[Ͱ-Ͽ][A-Za-z]*", part):
            continue
        return False
    return True


def _stands_alone(part: str) -> bool:
    return not part or _fits(part, _sets()) or _fits(part, _more_sets())


# Signs of formulas and lists that stand before or after letters.
_FORMULA = "∂∑∏∫∆√∞≈≠≤≥π◊±×÷¬µ°•■□▪▫►◄▲▼○●★☆✓✔✗♥→←↑↓"
_OPERATORS = "∂∑∏∫∆√∞≈≠≤≥"
_NOT_LATIN = re.compile(r"[Ͱ-ӿ\u0590-\u06ff\u0e00-\u0e7f]")


@cache
def _more_sets() -> list[frozenset[str]]:
    return [frozenset(v) for v in MORE_LETTERS.values()]


@cache
def _sets() -> list[frozenset[str]]:
    return [frozenset(v) for v in LETTERS.values()] + [frozenset(SCRIPTS[k][0]) for k in ("he", "ar", "th")]


def _plausible(form: str) -> bool:
    """Whether sound text of one script that isn't Latin could hold this."""
    if not form.isalpha():
        return False
    one = all("Ѐ" <= c <= "ӿ" for c in form) or all("Ͱ" <= c <= "Ͽ" for c in form)
    caseless = all("\u0590" <= c <= "\u06ff" for c in form) or all("\u0e00" <= c <= "\u0e7f" for c in form)
    return caseless or one and (form.islower() or form.isupper() or form[:1].isupper() and form[1:].islower())


# Rows of the common letters, syllables and ideographs of two-byte encodings: first bytes, second bytes.
EAST_ROWS = {
    "gbk": [(range(0xB0, 0xD8), range(0xA1, 0xFF))],
    "cp949": [(range(0xB0, 0xC9), range(0xA1, 0xFF))],
    "euc_jp": [(range(0xA4, 0xA6), range(0xA1, 0xF7)), (range(0xB0, 0xD0), range(0xA1, 0xFF))],
    "big5": [(range(0xA4, 0xC7), [*range(0x40, 0x7F), *range(0xA1, 0xFF)])],
    "cp932": [(range(0x82, 0x84), [*range(0x40, 0x7F), *range(0x80, 0xF2)]), (range(0x88, 0x99), [*range(0x40, 0x7F), *range(0x80, 0xFD)])],
}
# Punctuation of two-byte encodings.
EAST_SIGNS = {"gbk": "，。、；：！？（）“”《》", "cp949": "", "euc_jp": "、。「」ー・", "big5": "，。、；：！？（）「」", "cp932": "、。「」ー・"}
_EAST_SEQUENCE = {
    "gbk": re.compile(rb"[\x81-\xfe][\x40-\x7e\x80-\xfe]"),
    "cp949": re.compile(rb"[\xa1-\xfe][\xa1-\xfe]"),
    "euc_jp": re.compile(rb"[\xa1-\xfe][\xa1-\xfe]|\x8e[\xa1-\xdf]"),
    "big5": re.compile(rb"[\xa1-\xf9][\x40-\x7e\xa1-\xfe]"),
    "cp932": re.compile(rb"[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|[\xa1-\xdf]"),
}


@cache
def _common_codes(e: str) -> frozenset[bytes]:
    """The two-byte codes of common letters and of punctuation."""
    codes = [bytes((a, b)) for firsts, seconds in EAST_ROWS[e] for a in firsts for b in seconds]
    return frozenset([x for x in codes if _decoded(x, e)] + [c.encode(e) for c in EAST_SIGNS[e]])


def _decoded(raw: bytes, e: str) -> str | None:
    try:
        return raw.decode(e)
    except UnicodeDecodeError:
        return None


@cache
def _automaton():
    """The automaton over all garbled forms; its values are the form and its kinds with their encodings."""
    import ahocorasick

    found: dict[str, dict[str, set]] = {}

    def add(form: str, kind: str, pair: tuple[str, ...]) -> None:
        found.setdefault(form, {}).setdefault(kind, set()).add(pair)

    letters = set("".join(LETTERS.values()))
    letters |= {c.upper() for c in letters if len(c.upper()) == 1}
    rare = set("".join(MORE_LETTERS.values())) - letters  # their forms count only with a sign in them
    rare |= {c.upper() for c in rare} | set(MARKS)
    for c in _repertoire():
        raw = c.encode()
        for d in READ_AS:
            once = read_wrongly(raw, d)
            if not _RUSSIAN.match(once):
                if not (c in rare and once.isalpha()):
                    add(once, "utf8", (d,))
            elif not _CYRILLIC.match(c):  # could be Russian, but for the Latin letters beside it
                for a in "abcdefghijklmnopqrstuvwxyz":
                    add(a + once, "utf8", (d,))
                    add(once + a, "utf8", (d,))
            if d in ("cp1252", "latin-1"):
                for e in ("cp1252", "latin-1"):
                    twice = read_wrongly(once.encode(), e)
                    add(twice, "utf8", (e,))
                    add(read_wrongly(twice.encode(), e), "utf8", (e,))
        for d in READ_AS_STRICT:
            once = read_wrongly(raw, d)
            if not _plausible(once):
                add(once, "utf8", (d,))
    for letters_of in TWO_BYTES:
        for d in (*READ_AS, *READ_AS_STRICT):
            forms = [read_wrongly(chr(k).encode(), d) for k in letters_of]
            for x in forms:
                for y in forms:
                    if not _plausible(x + y):
                        add(x + y, "utf8", (d,))
    for lead in range(0xE0, 0xF0):  # letters of three bytes: Thai, Indian and Ethiopian scripts, Georgian, ideographs, Korean syllables
        for second in range(0xA0 if lead == 0xE0 else 0x80, 0xC0):
            for d in (*READ_AS, *READ_AS_STRICT):
                form = read_wrongly(bytes([lead, second]), d)
                if not _plausible(form):
                    add(form, "utf8 of three", (d,))
    for e in EAST_ASIAN:
        for d in READ_EAST_ASIAN:
            for code in _common_codes(e):
                form = read_wrongly(code, d)
                if not form[1].isascii():  # a letter before an ASCII one is too common
                    add(form, "east", (e, d))
    for codec, leads in KANA_LEADS.items():
        for c in leads:
            add(c, "kana", (codec,))
    for e in SINGLE:
        for d in SINGLE:
            if e == d:
                continue
            back, there = reverse(e), table(d)
            forms = {c: there[back[c]] for c in letters | set("‘’“”„–—…") if c in back and back[c] >= 0x80}
            for c, g in forms.items():
                if g == c:
                    continue
                latin = c.lower() not in LETTERS["ru"] + LETTERS["el"]
                if latin and c in letters and (not g.isalpha() or _CYRILLIC.match(g) or "Ͱ" <= g <= "Ͽ" or c.islower() and g.isupper()):
                    for a in "abcdefghijklmnopqrstuvwxyz":
                        add(a + g, "single", (e, d))
                        add(g + a, "single", (e, d))
                    if "\x80" <= g <= "\x9f":  # a control character needs no neighbour to be out of place
                        add(g, "single", (e, d))
                elif latin and g in "ýþð":
                    add(g, "weak", (e, d))
    for e in BOX_WRITTEN:
        for d in READ_SCRIPTS[:4]:
            for drawn in BOXES:
                form = read_wrongly(drawn.encode(e), d)
                if e != d and form != drawn:
                    add(form, "single", (e, d))
    for script, (order, written) in SCRIPTS.items():
        for e in written:
            for d in SINGLE if script == "ru" else READ_SCRIPTS:
                back, there = reverse(e), table(d)
                common = [there[back[c]] for c in order if c in back]
                if e == d or len(common) < 20:
                    continue
                for x in common:
                    for y in common:
                        if not _RUSSIAN.match(x + y) or (x + y).isupper():
                            add(x + y, "run" if script in ("ru", "el") else "late run", (e, d))
    a = ahocorasick.Automaton()
    for form, kinds in found.items():
        if not form.isascii():
            a.add_word(form, (len(form), tuple((kind, tuple(sorted(pairs))) for kind, pairs in kinds.items())))
    a.make_automaton()
    return a


_QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


#: Where garbled forms can be: characters beyond ASCII, with at most one ASCII character between two of them.
_REGION = re.compile(r"[^\x00-\x7f](?:[\x00-\x7f]?[^\x00-\x7f])*")


def _matches(text: str) -> dict[str, list[tuple[int, int, tuple]]]:
    """Matches outside quotations by kind: start, end, pairs. Only regions with characters beyond ASCII, and one beside them, are read."""
    quoted = [m.span() for m in _QUOTED.finditer(text)] if "`" in text else []
    out: dict[str, list[tuple[int, int, tuple]]] = {}
    iterate, n = _automaton().iter, len(text)
    for region in _REGION.finditer(text):
        s, e = region.span()
        for end, (size, kinds) in iterate(text, s - 1 if s else 0, e + 1 if e < n else n):
            end += 1
            start = end - size
            if not (quoted and any(a <= start and end <= b for a, b in quoted)):
                for kind, pairs in kinds:
                    out.setdefault(kind, []).append((start, end, pairs))
    return out


def _utf8_run(run: str, codec: str) -> tuple[int, str]:
    """How many characters of a run its UTF-8 sequences take up when written back by ``codec``, and the run with these decoded."""
    raw = _bytes_of(run, codec)  # what the encoding hasn't can't be part of a sequence
    pieces, at, taken = [], 0, 0
    for m in _UTF8.finditer(raw):
        pieces += [run[at : m.start()], m[0].decode()]
        at = m.end()
        taken += len(m[0])
    return taken, "".join([*pieces, run[at:]])


_RUN = re.compile(r"[^\x00-\x7f]+")
_OF_THREE = re.compile(rb"(?:[\xe0-\xef][\x80-\xbf]{2}){2}")


def _bytes_of(text: str, codec: str) -> bytes:
    """The characters written back one by one; what the encoding hasn't becomes a zero byte."""
    return codecs.charmap_encode(text, "millrace.zero", _codes(codec))[0]


codecs.register_error("millrace.zero", lambda e: (b"\0" * (e.end - e.start), e.end))


@cache
def _codes(codec: str) -> dict[int, int]:
    """Bytes by code point; Windows' table and Latin-1 stand in for one another where one has no character."""
    other = {"cp1252": "latin-1", "latin-1": "cp1252"}.get(codec)
    return {ord(c): b for c, b in ((reverse(other) if other else {}) | reverse(codec)).items()}


def _is_run(run: str, codec: str, sure: set[str], inside: bool) -> bool:
    """Whether a run can be UTF-8 read by ``codec``: the encodings of other scripts must make it whole, and it be long or ``inside`` a word of ASCII letters; letters of three bytes count in twos."""
    if codec in READ_AS_STRICT:
        return (len(run) >= 4 or inside) and _utf8_run(run, codec)[0] == len(run)
    return codec in sure or bool(_OF_THREE.search(_bytes_of(run, codec)))


def _utf8_once(text: str, hits: dict[str, list[tuple[int, int, tuple]]]) -> str:
    """Runs of characters with matches of UTF-8's garbled forms, decoded once by the encoding that makes most of each whole."""
    votes = Counter(p[0] for _, _, pairs in hits.get("utf8", ()) for p in pairs)
    at = sorted((start + text[start].isascii(), k == "utf8", tuple(p[0] for p in pairs)) for k in ("utf8", "utf8 of three") for start, _, pairs in hits.get(k, ()))
    out, done, k = [], 0, 0
    for m in _RUN.finditer(text):
        ways: set[str] = set()
        sure: set[str] = set()
        while k < len(at) and at[k][0] < m.end():
            if at[k][0] >= m.start():
                ways.update(at[k][2])
                if at[k][1]:
                    sure.update(at[k][2])
            k += 1
        inside = bool(re.match("[A-Za-z]", text[m.start() - 1 : m.start()] or " ") or re.match("[A-Za-z]", text[m.end() : m.end() + 1]))
        ways = {c for c in ways if _is_run(m[0], c, sure, inside)}
        if ways:
            order = (*READ_AS, *READ_AS_STRICT)
            best = max(ways, key=lambda c: (_utf8_run(m[0], c)[0], votes[c], -order.index(c)))
            taken, new = _utf8_run(m[0], best)
            if taken and (best in sure or all(c.isalpha() or unicodedata.category(c)[0] in "MP" for c in new if not c.isascii() and c not in m[0])):
                out += [text[done : m.start()], new]
                done = m.end()
    out.append(text[done:])
    return "".join(out)


def _chains(text: str, hits: list[tuple[int, int, tuple]]) -> dict[tuple[str, str], list[tuple[int, int]]]:
    """Per pair, the spans of three two-byte forms or more in a row that aren't UTF-8."""
    length: dict[tuple, dict[int, tuple[int, int]]] = {}
    starts = {start for start, _, _ in hits}
    for start, end, pairs in hits:
        if end in starts or start - 2 in starts:  # alone it is no chain
            for p in pairs:
                ends = length.setdefault(p, {})
                begun, n = ends.pop(start, (start, 0))
                ends[end] = (begun, n + 1)
    found = {p: spans for p, ends in length.items() if (spans := sorted((a, b) for b, (a, n) in ends.items() if n >= 3 and not _is_list(text[a:b])))}
    return {p: spans for p, spans in found.items() if not any(_is_utf8(text, spans, d) for d in READ_EAST_ASIAN)}


def _is_list(chain: str) -> bool:
    """Whether letters stand in the order of an alphabet."""
    return chain.isalpha() and list(chain) == sorted(chain)


def _is_utf8(text: str, spans: list[tuple[int, int]], codec: str) -> bool:
    """Whether the runs of characters beyond ASCII that the spans touch are UTF-8, but for what was lost of it."""
    taken = total = k = 0
    for m in _RUN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            taken += _utf8_run(m[0], codec)[0]
            total += len(m[0])
    return taken >= 0.8 * total


def _east_read(word: str, e: str, d: str) -> tuple[str, int, int]:
    """A word written back by ``d`` and decoded sequence by sequence; how many of its characters are common codes, and how many of two-byte sequences or beyond ASCII there are. What is no sequence stays."""
    raw, common = _bytes_of(word, d), _common_codes(e)
    out, at, good = [], 0, 0
    beyond = sum(not c.isascii() for c in word)
    for m in _EAST_SEQUENCE[e].finditer(raw):
        new = None if 0 in m[0] else _decoded(m[0], e)
        if new is None or m[0].isascii():
            continue
        out += [word[at : m.start()], new]
        at = m.end()
        if m[0] in common:
            good += sum(not c.isascii() for c in word[m.start() : m.end()])
    return "".join([*out, word[at:]]), good, beyond


_KANA = re.compile(r"[\u3040-\u30ff]")
_WORD = re.compile(r"[^ \t\r\n\v\f\"]+")


def _east_once(text: str, chains: dict[tuple[str, str], list[tuple[int, int]]]) -> str:
    """Words with chains of two-byte forms, decoded by the pair of which most are common codes; nothing is replaced where none fits well."""
    spans = sorted({s for found in chains.values() for s in found})
    touched, k = [], 0
    for m in _WORD.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k += 1
        if k < len(spans) and spans[k][0] < m.end():
            touched.append(m)

    if not touched:
        return text
    near, lines = {m.start() for m in touched}, {text.rfind("\n", 0, m.start()) for m in touched}
    words = [m for m in _WORD.finditer(text) if not m[0].isascii() and text.rfind("\n", 0, m.start()) in lines]

    def rank(p: tuple[str, str]) -> tuple:
        read = [_east_read(m[0], *p) for m in words if m.start() in near or 0 not in _bytes_of(m[0], p[1])]
        good, beyond = sum(r[1] for r in read), sum(r[2] for r in read)
        new = "".join(r[0] for r in read)
        kana = len(_KANA.findall(new))
        short = len(new) <= 6 * len(read)  # Korean words are short, Chinese isn't divided
        habit = {"euc_jp": kana * 5 >= len(new), "cp932": kana * 5 >= len(new), "cp949": short, "gbk": not short}.get(p[0], False)
        return round(good / max(beyond, 1), 1), habit, good, -EAST_ASIAN.index(p[0]), -READ_EAST_ASIAN.index(p[1])

    ranks = {p: rank(p) for p in chains}
    best = max(ranks, key=ranks.__getitem__)
    if ranks[best][0] < 0.8:
        return text
    out, done = [], 0
    for m in words:
        new, good, beyond = _east_read(m[0], *best)
        if m.start() in near or good and good == beyond and _EAST.search(new):
            out += [text[done : m.start()], new]
            done = m.end()
    out.append(text[done:])
    return "".join(out)


_EAST = re.compile(r"[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff00-\uff9f]")


_EAST_RUN = re.compile(r"[^\x00-\x7f\ufffd]+")
_EAST_LETTER = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3\uff61-\uff9f]")


@cache
def _known() -> frozenset[str]:
    return frozenset(_repertoire())


def _east_read_back(run: str, codec: str) -> str | None:
    """A run of characters written back by an East Asian encoding and decoded as UTF-8; None if it wasn't UTF-8 of known letters and signs."""
    try:
        new = run.encode(codec).decode()
    except UnicodeError:
        return None
    beyond = [c for c in new if not c.isascii()]
    return new if beyond and new != run and all(c in _known() or _EAST_LETTER.match(c) for c in beyond) else None


def _utf8_read_east(text: str) -> str:
    """UTF-8 read as Chinese, Korean or Japanese, decoded rightly.

    Sound text of these languages hardly ever is valid UTF-8 when written back. A run
    counts by itself if it gives a word of three letters or more, two ideographs, kana or
    syllables from three characters, or stands within a word of ASCII letters; runs
    that give less are decoded too once others of the same encoding have counted.
    """
    if not _EAST_LETTER.search(text):
        return text
    quoted = [m.span() for m in _QUOTED.finditer(text)] if "`" in text else []
    sure: Counter[str] = Counter()
    options: list[tuple[re.Match, dict[str, str]]] = []
    for m in _EAST_RUN.finditer(text):
        if not _EAST_LETTER.search(m[0]) or any(a <= m.start() and m.end() < b for a, b in quoted):
            continue
        ways = {c: new for c in EAST_READ_AS if (new := _east_read_back(m[0], c)) is not None}
        if not ways:
            continue
        options.append((m, ways))
        before, after = text[m.start() - 1 : m.start()] if m.start() else "", text[m.end() : m.end() + 1]
        for c, new in ways.items():
            beyond = [x for x in new if not x.isascii()]
            east = sum(bool(_EAST_LETTER.match(x)) for x in beyond)
            word = "".join(beyond)
            if east >= 2 and len(m[0]) >= 3 or not east and len(beyond) >= 3 and len(m[0]) >= 3 and word.isalpha() and is_sound_word(word):
                sure[c] += len(beyond)
            elif not east and re.match("[a-z]", before) and (re.match("[a-z]", after) or re.match("[a-z]", new[-1])) and is_sound_word(before + new + after):
                sure[c] += 1
    if not sure:
        return text
    best = max(sure, key=lambda c: (sure[c], -EAST_READ_AS.index(c)))
    out, done = [], 0
    for m, ways in options:
        if best in ways:
            out += [text[done : m.start()], ways[best]]
            done = m.end()
    out.append(text[done:])
    return "".join(out)


_SPACES = " \t\r\n\v\f"  # a no-break space may be a garbled letter
_TOKEN = re.compile(f"[^{_SPACES}]+")
_SPACE = re.compile(f"[{_SPACES}]")


def _single(text: str, hits: dict[str, list[tuple[int, int, tuple]]], kinds: tuple[str, ...], later: bool = False) -> tuple[str, bool]:
    """With ``later``, scripts without capitals that fit best are left for another time. Words around matches of one-character forms, read by the pair that makes most of them sound, and with them the words of their line that it makes sound too."""
    relevant = [(start, end, k == "weak", pairs) for k in kinds for start, end, pairs in hits.get(k, ())]
    if not relevant:
        return text, False
    proposed: dict[tuple[int, int], set] = {}
    weak: dict[tuple[int, int], set] = {}
    span, stands = (0, 0), False
    for start, end, is_weak, pairs in sorted(relevant, key=lambda h: h[:2]):
        if start >= span[1]:
            at = start
            while at and text[at - 1] not in _SPACES:
                at -= 1
            after = _SPACE.search(text, start)
            span = (at, after.start() if after else len(text))
            word = text[span[0] : span[1]]
            stands = may_stand(word) or "run" in kinds and len(word) > 2 and not word.strip(_BOX_READ)  # drawn lines are no words
        if end <= span[1] and not (stands and not is_weak):
            (weak if is_weak else proposed).setdefault(span, set()).update(pairs)
    changed: dict[tuple[int, int], dict[tuple[str, str], str]] = {}
    for spans in (proposed, weak):
        for span, pairs in spans.items():
            word = text[span[0] : span[1]]
            if spans is weak and is_sound_word(word):
                continue
            is_utf8: dict[str, bool] = {}
            mixed = bool(re.search("[A-Za-z]", word))
            for e, d in pairs:
                new = _reread(word, e, d)
                if new is None or new == word or not is_sound_word(new) or mixed and _least(new) == 8:
                    continue
                if d not in is_utf8:
                    is_utf8[d] = _utf8_run(word, d)[0] >= 0.8 * sum(not c.isascii() for c in word)
                if not is_utf8[d]:
                    changed.setdefault(span, {})[e, d] = new
    if weak:
        for line in re.finditer(r"[^\n]+", text):
            inside = [s for s in weak if line.start() <= s[0] and s[1] <= line.end()]
            if not inside:
                continue
            letters = {c for c in line[0].lower() if c.isalpha() and not c.isascii()}
            if any(letters <= s for s in _sets() + _more_sets()):
                continue
            for e, d in set.union(*(weak[s] for s in inside)):
                new = {_reread(c, e, d) for c in letters}
                if None not in new and any({c.lower() for c in new} <= s for s in _sets()):
                    for s in inside:
                        fixed = _reread(text[s[0] : s[1]], e, d)
                        if fixed and fixed != text[s[0] : s[1]]:
                            changed.setdefault(s, {})[e, d] = fixed
    weight: Counter[tuple[str, str]] = Counter()  # letters garbled, by pair
    distinct: dict[tuple[str, str], set[str]] = {}
    for span, options in changed.items():
        beyond = [c for c in text[span[0] : span[1]] if not c.isascii()]
        for p in options:
            weight[p] += len(beyond)
            distinct.setdefault(p, set()).update(beyond)
    for span in list(changed):
        options = {p: new for p, new in changed[span].items() if (len(distinct[p]) if _least(new) == 8 else weight[p]) >= _least(new)}
        if options:
            changed[span] = options
        else:
            del changed[span]
    if not changed:
        return text, False
    votes = Counter(p for options in changed.values() for p in options)
    letters = {p: {c for options in changed.values() if p in options for c in options[p].lower() if c.isalpha() and not c.isascii()} for p in votes}
    around = set(text.lower())
    usual = {p: _usual("".join(options[p] for options in changed.values() if p in options)) for p in votes}

    def rank(p: tuple[str, str]) -> tuple:
        """The pair that mends most words; then the one whose letters are those of one language, the usual ones of it, and those of the text around."""
        return round(votes[p] / most, 1) if far_off else votes[p], any(letters[p] <= s for s in _sets()), usual[p], votes[p], len(letters[p] & around), -(_order(p[0]) + _order(p[1]))

    most, far_off = max(votes.values()), any(usual.values())
    if later:
        first = max(votes, key=rank)
        if any(_least(options[first]) == 8 for options in changed.values() if first in options):
            return text, False

    final = {span: options[max(options, key=rank)] for span, options in changed.items()}
    for line in re.finditer(r"[^\n]+", text):
        inside = [s for s in changed if line.start() <= s[0] and s[1] <= line.end()]
        if inside:
            e, d = max((p for s in inside for p in changed[s]), key=rank)
            far = any(_is_far(final[s]) for s in inside)
            quoted = [m.span() for m in _QUOTED.finditer(line[0])]
            for m in _TOKEN.finditer(line[0]):
                span = (line.start() + m.start(), line.start() + m.end())
                if span in final or m[0].isascii() or any(s < m.end() and m.start() < t for s, t in quoted):
                    continue
                new = _reread(m[0], e, d)
                if new is None or new == m[0] or not is_sound_word(new):
                    continue
                # Words of another script are garbled as a whole; of Latin words those that don't stand, or not in the line's language.
                drawn = bool(_BOX.search(new)) and any(_BOX.search(final[s]) for s in inside) and not re.search(r"[^\W\d_]", m[0].strip(_BOX_READ))
                if drawn or not may_stand(m[0]) or (not re.search("[A-Za-z]", m[0]) if far else _is_foreign(m[0], new, "".join(letters[e, d]), "".join(final[s] for s in inside))):
                    final[span] = new
    out, done = [], 0
    for (s, e), new in sorted(final.items()):
        out += [text[done:s], new]
        done = e
    out.append(text[done:])
    return "".join(out), True


_BOX = re.compile("^[─-╬]+$")
_BOX_READ = "".join({read_wrongly(c.encode(e), d) for c in "│├└─┌┐┘║╠╚═" for e in BOX_WRITTEN for d in READ_SCRIPTS[:4]})


def _is_foreign(word: str, new: str, mended: str, beside: str) -> bool:
    """Whether a word fits none of the languages of the words mended in the text, or else on its line, and its new reading does."""
    beyond = lambda x: {c for c in x.lower() if c.isalpha() and not c.isascii()}
    fitting = [s for s in _sets() if beyond(mended) <= s] or [s for s in _sets() if beyond(beside) <= s]
    sign = any(not c.isalpha() and new[k].isalpha() and (word[k - 1 : k].isalpha() or word[k + 1 : k + 2].isalpha()) for k, c in enumerate(word) if not c.isascii())
    return any(beyond(new) <= s for s in fitting) and (sign or not any(beyond(word) <= s for s in fitting))


def _least(new: str) -> int:
    """How many garbled letters must speak for a single-byte pair that reads ``new``: fewest for Latin, most for scripts without capitals."""
    return 1 if not _is_far(new) else 4 if re.search("[Ͱ-ӿ]", new) else 8


def _is_far(word: str) -> bool:
    return bool(_NOT_LATIN.search(word))


def _order(codec: str) -> int:
    return SINGLE.index(codec) if codec in SINGLE else len(SINGLE)


def _usual(text: str) -> float:
    """How usual the letters of a text are in its script, 0 for Latin."""
    low = [c for c in text.lower() if not c.isascii()]
    scores = [sum(1 / (2 + order.find(c)) for c in low if c in order) for order, _ in SCRIPTS.values()]
    return round(max(scores) / max(len(low), 1), 2) if _is_far(text) else 0.0


@cache
def _own_codes(codec: str) -> dict[int, int]:
    return {ord(c): b for c, b in reverse(codec).items()}


@lru_cache(maxsize=200_000)
def _reread(word: str, e: str, d: str) -> str | None:
    """A word written back by ``d`` and read by ``e``; None if ``d`` hasn't all of its characters."""
    try:
        return codecs.charmap_decode(codecs.charmap_encode(word, "strict", _own_codes(d))[0], "strict", table(e))[0]
    except UnicodeEncodeError:
        return None


def restore(text: str | None) -> tuple[bool, str | None]:
    """Whether a text is garbled, wholly or in places, and the text restored as far as can be; null, empty and ASCII texts are sound."""
    if not text or text.isascii():
        return False, text
    now = _utf8_read_east(text)
    garbled = now != text
    seen = {now}
    while True:
        hits = _matches(now)
        if not hits:
            break
        if len(hits.get("kana", ())) >= 2:
            garbled = True
        before = now
        if "run" in hits:  # whole words of one script, before their letters are taken for bytes
            now, did = _single(now, hits, ("run", "late run"), later=True)
            garbled |= did
        if now == before and len(hits.get("east", ())) >= 3 and (chains := _chains(now, hits["east"])):
            garbled = True
            now = _east_once(now, chains)
        if now == before:
            now, did = _single(now, hits, ("run", "late run")) if "late run" in hits else (now, False)
            garbled |= did
        if now == before and ("utf8" in hits or "utf8 of three" in hits):
            now = _utf8_once(now, hits)
            garbled |= now != before
        if now == before:
            now, did = _single(now, hits, ("single", "weak"))
            garbled |= did
        if now in seen:
            break
        seen.add(now)
    if not garbled and "\ufffd" in _QUOTED.sub("", text):
        garbled = True
    return garbled, now


def repaired(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``restored`` of each garbled document; sound ones give no row, nor do null and empty texts. Repeated rows are judged one by one."""

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, new) for i, text in zip(batch["doc_id"], batch["text"], strict=True) for bad, new in [restore(text)] if bad]
            yield pd.DataFrame(rows, columns=["doc_id", "restored"])

    return documents.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").mapInPandas(repair, "doc_id bigint, restored string")
