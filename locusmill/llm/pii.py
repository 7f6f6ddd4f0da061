"""Personal data in mails: found by labelers that vote, weighed by EM, decided by a trained classifier.

1. A gazetteer of given and family names comes from the display names of all mail headers (a grouped
   count in Spark).
2. One scan of every whole text proposes candidate spans and lets the labelers of the kind vote on each:
   shapes (regular expressions), the gazetteer, and the words and signs around the span. Votes are +, 0
   (abstains) and -. Beside the votes the scan notes how the span itself looks: the shape of its letters, the
   words and signs beside it, header or body. The scan ends in a row per mail with its spans.
3. Vote patterns are counted over the whole corpus. EM on these counts (a few hundred rows at any corpus
   size: at most 3 ** labelers per kind and shape) estimates how each labeler votes on true and false
   spans.
4. EM's soft labels train a logistic span classifier for each kind on the looks of a bounded sample of spans (``SAMPLE``). It judges
   every span together with its votes, so what a span looks like may overrule its labelers.

``start_pos`` counts code points of the stored text; ``flat`` maps escapes, quote marks and line ends.

Defined results: null and empty texts have no spans, their redacted text is the text itself; each
repetition is a span; names, addresses and numbers may be of any length; ids in Message-ID, In-Reply-To and References are no mail addresses; base64 is
not decoded; spans that overlap are replaced by one placeholder, the one that begins first.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.llm.flat import Flat
from locusmill.session import cut, small

KINDS = ("email", "phone", "id_number", "address", "name")
GAZETTEER = 200_000  # most names that are broadcast; with more, each mail gets the names that its words can make
SLICE = 500  # mails that share a scanner then
SAMPLE = 100_000  # most labelled spans that the classifier is fitted on
LOOKS, LOOKS_EACH = 4096, 4  # numbers that a span's looks are hashed to, and how many it has
CERTAIN = 0.001  # least doubt that votes leave

# Words that never end a name, beside a given name at the start of a sentence or line.
NO_FAMILY = frozenset(
    "the a an our my your we i it he she they this that these those every no both if in on at to of for from with without and or but not as is was "
    "were are be please dear hi hello hallo hola bonjour liebe lieber guten thanks cheers best kind regards br mfg merci saludos cordialement viele un una "
    "someone again over under beside within across against beyond despite before after near above below between while when where who which during "
    "am im die der das den dem ein eine unsere unser keine kein bitte nach vor neben zwischen und oder ist war mit ohne auf aus bei von zu wer sie "
    "la le les une notre nos aucune aucun dans avec sans pour par sur sous et ou est sont selon malgre nuestra nuestro ninguna ningun el los las en con "
    "sin por para segun bajo tras contra y o es mon tue wed thu fri sat sun jan feb mar apr may jun jul aug sep oct nov dec wrote schrieb "
    "escribio ecrit sent subject date cc bcc re fwd aw wg tel telefon telephone phone mobile fax t run model order version institute ltd gmbh inc is has "
    "signed needs says said asks asked called steadily suddenly clearly usually rarely apparently twice later only evenly partly fully barely quietly quickly".split()
)
ORGANISATION = frozenset(
    "ltd limited gmbh inc llc plc ag sa bv co corp company institute institut university pharmacy apotheke hospital clinic lab labs laboratories bioworks "
    "instruments systems group partners street st road rd avenue ave blvd lane close court square park plaza weg strasse straße building hall centre "
    "center station protocol method test score index buffer medium plan scale reagent mixer kit assay sons bros brothers consulting solutions services".split()
)
_NO_GIVEN = NO_FAMILY | ORGANISATION | frozenset("dr prof mr ms mrs miss mx sir herr frau hr fr mme mlle sr sra srta senor senora dra doctor professor dipl".split())
TLDS = frozenset(
    "com org net edu gov int mil info biz io ai dev app eu uk de fr es it nl be ch at se no dk fi pl cz pt ie ca us au jp cn in br example invalid test local".split()
)
TITLES = "dr|prof|mr|ms|mrs|miss|mx|sir|herr|frau|hr|fr|mme|mlle|m|sr|sra|srta|señor|señora|dra|doctor|professor|dipl"
STREETS = "street|st|road|rd|avenue|ave|blvd|boulevard|lane|ln|drive|close|court|ct|way|place|pl|square|sq|terrace|crescent|row|gardens|grove|hill|mews|walk"

_S = r"(?: \n?|\n ?)"
_L = r"[^\W\d_]"
_PART = rf"(?:(?:van|von|de|der|den|del|della|di|da|dos|du|la|le|el|al|bin|ten|ter|zu){_S}|[oOdD]['’])"
_FAMILY = rf"{_PART}{{0,3}}{_L}[^\W\d_'’\-]*(?:['’\-]{_L}+)*"
_AFTER = re.compile(rf"((?:{_S}[A-Za-z]\.)?{_S})({_FAMILY})", re.I)
_BEFORE = re.compile(rf"({_FAMILY}),{_S}\Z", re.I)
_BEFORE_PLAIN = re.compile(rf"(?:^|(?<=[\s(\"'>:;,]))({_FAMILY}){_S}\Z", re.I)
_WORD_BACK = re.compile(r"[^\W\d_]+")
_FIRST_BACK = re.compile(r"[ \n]{1,2}(?:(\.[A-Za-z]\b)|([^\W\d_]+))")
_PARTS = frozenset("van von de der den del della di da dos du la le el al bin ten ter zu".split())
_GIVEN_BACK = re.compile(rf"(?:[ \n]{{1,2}}(\.[A-Za-z]))?[ \n]{{1,2}}({_L}+(?:['’\-]{_L}+)*)(?![\w'’@.])")
_GIVEN_NEXT = re.compile(rf"(,?){_S}({_L}+(?:['’\-]{_L}+)*)(?![\w'’@])")
_INITIAL = re.compile(rf"[A-Z]\.{_S}?(?:[A-Z]\.{_S}?)?({_FAMILY})")
_INITIAL_BEFORE = re.compile(rf"(?<![\w.])[A-Za-z]\.{_S}?(?:[A-Za-z]\.{_S}?)?(?:{_PART})*\Z")
_INITIAL_AFTER = re.compile(rf",{_S}[A-Z]\.(?![A-Za-z])")
_TITLE = re.compile(rf"(?:^|\W)(?:{TITLES})\.?[ \n]*[\"'“„]?\Z", re.I)
_CUE = re.compile(
    r"(?:participant|present:|teilnehmer|anwesend:|cc|contact(?:er)?|ask|pregunta a|écrire à|ecrire a|escribe a|write to|frag|frage|fragen sie|by|from|from:|to:|cc:|von:|an:|and|with|,|:|-|–)[ \n]*[\"']?\Z", re.I
)
_FOLLOW = re.compile(r"[\"']?(?:[ \n]*[<(\[]|[ \n]+(?:wrote|schrieb|escribió|a écrit|ist unter|is at|signed|please)\b|:|,[ \n]*(?:SSN|Passport|passport|tax|driver|ID|national|personal|NI|social)|[ \n]*\Z|\n)")
_WORDAFTER = re.compile(rf"[ \n]+(?:and{_S}{_L}+{_S})?({_L}+)")

_NOT_LOCAL = re.compile(r"[^\w.!#$%&'*+/=?^`{|}~-]")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_DODGE = re.compile(
    r"(?:[(\[{<] ?at ?[)\]}>]|[ \n]at[ \n]|＠|[(\[{<]@[)\]}>])[ \n]*"
    r"([A-Za-z0-9-]+(?:(?:\.|[ \n]*[(\[{<] ?dot ?[)\]}>][ \n]*|[ \n]dot[ \n])[A-Za-z][A-Za-z0-9-]*)+)", re.I
)
_ID_LOCAL = re.compile(r"[0-9a-f]{6,}\.\w+(?:\.\w+)*")
_AT = (  # every way that _DODGE can begin, in lower case
    *(a + x + "at" + y + b for a in "([{<" for b in ")]}>" for x in ("", " ") for y in ("", " ")),
    *(a + "at" + b for a in " \n" for b in " \n"), "＠", *(a + "@" + b for a in "([{<" for b in ")]}>"),
)
ID_HEADERS = ("message-id:", "in-reply-to:", "references:", "content-id:")
_LOCAL_BACK = re.compile(r"[ \n]*([\w.+-]+)")
_ID_HEADER = re.compile(r"^[>| \t]*(?:message-id|in-reply-to|references|content-id|x-message-id|resent-message-id):(?:[^\n]|\n[ \t])*", re.I | re.M)

_NUMBER = re.compile(
    r"(?<![\w@])(?<![\d][.\-/:])(?:"
    r"(?P<ssn>\d{3}(?:-\s?\d{2}-\s?|(?: \n?|\n ?)\d{2}(?: \n?|\n ?))\d{4})|(?P<national>\d{2}\.\d{2}\.\d{2}-\s?\d{3}\.\d{2})|(?P<personal>\d{6}[-+]\s?\d{4})|"
    r"(?P<tax>\d{2}(?: \n?|\n ?)\d{3}(?: \n?|\n ?)\d{3}(?: \n?|\n ?)\d{3})|"
    r"(?P<plus>\+\d{1,3}(?:[ \n]{0,2}[-./(]{0,2}[ \n]{0,2}\d{1,6}\)?){2,7})|(?P<trunk>00\d{2}(?:[ \n./-]{1,3}\(?\d{1,6}\)?){2,6})|"
    r"(?P<nanp>(?:1[-. ]{1,2})?(?:\(\d{3}\)[ \n]{0,2}|\d{3}(?:[ \n]{0,2}[-./][ \n]{0,2}|(?: \n?|\n ?)))\d{3}(?:[ \n]{0,2}[-.][ \n]{0,2}|(?: \n?|\n ?))\d{4})|"
    r"(?P<zero>\(?0\d{1,4}\)?(?:[ \n./-]{1,3}\d{2,8}){1,5})|(?P<compact>0\d{9,10}|1[2-9]\d{9}|[2-9]\d{2}[2-9]\d{6})"
    r")(?![\w@])(?![.\-/:]\d)"
)
_LETTERED = re.compile(
    r"(?<![\w@.-])(?:(?P<card>[A-Z]-\s?\d{8}-\s?[A-Z])|(?P<licence>[A-Z]\d{3}-\s?\d{4}-\s?\d{2})|(?P<ni>[A-Z]{2}[ \n]{0,2}\d{2}[ \n]{0,2}\d{2}[ \n]{0,2}\d{2}[ \n]{0,2}[A-D])|"
    r"(?P<passport>[A-Z]{1,2}\d{7}))(?![\w@-])"
)
_ID_CUE = re.compile(r"(?:ssn|social security(?: number)?|sozialversicherung\w*|passport|reisepass|passeport|pasaporte|tax id|steuer-?id|tin|licen[cs]e|f(?:ü|u)hrerschein|id card|ausweis|national id|personal id|ni number|nino|identity|badge|registro|dni|personnummer)\b[^\w]{0,4}(?:no\.?|number|nr\.?|num\.?|#)?[\s:.#>|=-]*\Z|(?:my number is|registration needs)\s*\Z", re.I)
_NOT_ID = re.compile(r"\b(?:order|bestell\w*|catalog(?:ue)?(?: no\.?)?|lot|invoice|ref|version|run|plate|ticket|serial|batch|part|doi|isbn|pmid|ip|port|build|md5|sha|model|gse|chr\w*|commit|case|job|flow cell|n|p|rho)\b[\s:.#=-]*\Z", re.I)
_PHONE_CUE = re.compile(r"(?:phone|tel|telephone|téléphone|telefon|teléfono|mobile|mobil|handy|fax|cell|call|ring|rings at|reach|t|m|☎|📞|unter|mine is|dial|ruf\w*|llama\w*)[\s.:=>|]*(?:me|us|at|on|unter|au|al|is)?[\s:.]*\Z|☎\s*\Z", re.I)
_STREET_A = re.compile(rf"(?<![\w.,:/-])\d{{1,5}}(?:[ ]?[A-Za-z](?=[ \n,]))?,?{_S}(?:{_L}[\w'’.-]*{_S}){{1,3}}(?:{STREETS})\b\.?", re.I)
_STREET_B = re.compile(rf"(?<![\w.,:/-])\d{{1,5}}(?:[ ]?(?:bis|ter|quater|[A-Za-z]))?,?{_S}(?:rue|avenue|boulevard|chemin|all[ée]e|impasse|quai|route|cours|place){_S}(?:(?:de la|de|du|des){_S}|de l['’]|d['’])?{_L}[\w'’-]+", re.I)
_STREET_C = re.compile(rf"(?<![\w-])(?:calle|avenida|avda\.?|paseo|plaza|camino|carrera|via|viale|corso|piazza|rua){_S}(?:(?:de la|de los|de|del|las|los){_S})?{_L}[\w'’-]+(?:{_S}{_L}[\w'’-]+)?,?{_S}(?:n[ºo°]\.?[ ]?)?\d{{1,5}}\b", re.I)
_STREET_D = re.compile(rf"(?<![\w-]){_L}[\w'’-]*(?:stra(?:ß|ss)e|str\.|weg|allee|platz|gasse|ufer|damm|chaussee|steig|laan|straat)\.?{_S}\d{{1,5}}(?:[ ]?[a-z]\b)?", re.I)
_TOWN = re.compile(rf"[ ]?[a-z]?,[ \n]{{1,2}}(?:\d{{4,5}}{_S})?[A-ZÀ-Þ]{_L}+|\n\d{{4,5}} ")
_LIVE = re.compile(r"(?:live at|lives at|ship to|deliver\w* to|moved to|address|adresse|anschrift|dirección|direccion|an|to|at|nach|à|a|in|home|geht an|wohne?n?)[\s:,]*\Z", re.I)
_UNIT = re.compile(r"(?:of|the|a|an|and|for|with|than|about|x|n|=)[ \n]*\Z", re.I)


_DIGITS = re.compile(r"\d+")
_NOT_WORD = re.compile(r"[^\w'’-]")
_REGION = re.compile(r"\d(?:[ .\-/()\n]{0,5}\d){5,}")
_WORD_START = re.compile(r"[\w'’-]*")
RUES = ("rue", "avenue", "boulevard", "chemin", "allee", "allée", "impasse", "quai", "route", "cours", "place")
CALLES = ("calle", "avenida", "avda", "paseo", "plaza", "camino", "carrera", "via", "viale", "corso", "piazza", "rua")
SUFFIXES = ("straße", "strasse", "str.", "weg", "allee", "platz", "gasse", "ufer", "damm", "chaussee", "steig", "laan", "straat")
PHONES = ("plus", "trunk", "nanp", "zero", "compact")


def _street(t: str, s: int, e: int, code: str) -> tuple[str, int, int, str]:
    x, before = t[s:e], t[max(0, s - 25) : s]
    proper = bool(re.search(r"[\d\s][A-ZÀ-Þ]", x)) if code in "ABC" else x[0].isupper()
    v = code + _vote(proper, not proper) + _vote(_TOWN.match(t, e)) + _vote(_LIVE.search(before) or before[-1:] in ("\n", ""), _UNIT.search(before))
    return "address", s, e, v + _vote(False, "\n" in x and len(x.split()) > 5)


@functools.lru_cache(maxsize=100_000)
def folded(word: str) -> str:
    w = word.lower().translate({0x142: "l", 0xF8: "o", 0xDF: "ss", 0xE6: "ae", 0x111: "d", 0x2019: "'"})
    return w if w.isascii() else "".join(c for c in unicodedata.normalize("NFKD", w) if not unicodedata.combining(c))


def _left(t: str, s: int, width: int, words: int) -> str:
    """What stands before s: ``width`` characters, and more until it holds ``words`` words or the text begins."""
    a = s - width
    if a <= 0:
        return t[:s]
    while a and len((x := t[a:s]).split()) <= words + (not x[:1].isspace()):
        a = max(0, a - (s - a))
    return t[a:s]


def _look(kind: str, t: str, s: int, e: int, head: int) -> int:
    """How a span looks, as ``LOOKS_EACH`` numbers of 12 bits: the shape of its characters, the words before and behind it, and the signs beside it
    with its being in the header or the body. (The words are looked for within 24 characters: they are features, no limits to what is found.)"""
    before, after = t[max(0, s - 24) : s][::-1], t[e : e + 24]  # read away from the span
    word, follow = _NEXT_WORD.match(before), _NEXT_WORD.match(after)
    return (
        _hashed(kind, _shape(t[s:e])) | _hashed(kind, "<" + word[1].lower() if word else "<") << 12
        | _hashed(kind, ">" + follow[1].lower() if follow else ">") << 24 | _hashed(kind, f"[{before[:1]}{after[:1]}{s < head}") << 36
    )


def unpacked(looks: np.ndarray) -> np.ndarray:
    """The numbers of each look, a row per span."""
    return (looks.astype(np.int64)[:, None] >> (12 * np.arange(LOOKS_EACH))) & (LOOKS - 1)


def _shape(x: str) -> str:
    """Case, size, ends and signs of a span."""
    return f"{x.islower():d}{x.isupper():d}{x[:1].isupper():d}{x[:1].isdigit():d}{x[-1:].isalnum():d}{len(x).bit_length()} {x.count(' ')} {x.count('.')} {x.count('-')}{chr(10) in x:d}{'@' in x:d}"


_NEXT_WORD = re.compile(r"[\W_]*([^\W_]+)")


@functools.lru_cache(maxsize=200_000)
def _hashed(kind: str, look: str) -> int:
    return zlib.crc32(f"{kind}{look}".encode("utf-8", "surrogatepass")) % LOOKS


def _vote(yes: object, no: object = False) -> str:
    return "+" if yes else "-" if no else "0"


class Scanner:
    """Candidate spans of one text with their vote patterns; built once per task from the gazetteer."""

    def __init__(self, given: list[str], family: list[str], pairs: Iterable[str] = ()):
        """pairs: 'Given Family' of header names whose given name isn't in ``given``."""
        self.given, self.family = {folded(w) for w in given}, {folded(w) for w in family}
        self.pairs = {tuple(folded(w) for w in x.split(" ")) for x in pairs}
        self.a = ahocorasick.Automaton()
        words: dict[str, int] = {}
        for names, flag in ((given, 1), (family, 2), ({x.split(" ")[1] for x in pairs}, 2)):
            for w in names:
                for form in {w.lower(), folded(w)}:
                    if len(form) > 1:
                        words[form] = words.get(form, 0) | flag
        for group, flag in ((STREETS.split("|"), 4), (RUES, 8), (CALLES, 16), (SUFFIXES, 32), (_AT, 64), (ID_HEADERS, 128)):
            for w in group:
                words[w] = words.get(w, 0) | flag
        for w, flag in words.items():
            self.a.add_word(w, (len(w), flag))
        self.a.make_automaton()

    def spans(self, stored: str) -> list[tuple[str, int, int, str, int]]:
        """Kind, place in the stored text, votes and hashed looks of each candidate."""
        f = Flat(stored)
        t = f.text
        low = t.lower()
        if len(low) != len(t):  # a few letters change length in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
        hits = [(e - n + 1, e + 1, flag) for e, (n, flag) in self.a.iter(low)]
        emails = self._emails(f, t, stored, hits)
        out = emails + self._numbers(t) + self._streets(t, hits)
        locals_ = "\n".join(t[s:e].partition("@")[0].lower() for _, s, e, _ in emails)
        out += self._names(t, hits, [(s, e) for _, s, e, _ in out], locals_)
        head = t.find("\n\n")
        return [(k, f.at(s), f.end(e), v, _look(k, t, s, e, head)) for k, s, e, v in out]

    @staticmethod
    def _ids(f: Flat, stored: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
        """Places of the headers that hold ids, in the stored text; looked for where the name of one stands."""
        starts = sorted({stored.rfind("\n", 0, f.at(s)) + 1 for s, _, flag in hits if flag & 128})
        return [m.span() for k in starts if (m := _ID_HEADER.match(stored, k))]

    def _emails(self, f: Flat, t: str, stored: str, hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, str]]:
        out = []
        ids: list[tuple[int, int]] | None = None
        i = t.find("@")
        while i >= 0:
            width = 70
            while not (cut_ := _NOT_LOCAL.search(t[max(0, i - width) : i][::-1])) and width < i:
                width *= 4
            s = i - cut_.start() if cut_ else 0
            right = _DOMAIN.match(t, i + 1)
            if s < i and right:
                e = right.end()
                while t[s] in ".'`=/?&|{}*!#$%^~-" and s < i - 1:
                    s += 1
                local = t[s:i]
                hexed = bool(_ID_LOCAL.fullmatch(local))
                if ids is None:
                    ids = self._ids(f, stored, hits)
                inside = False
                if ids:
                    place = f.at(s)
                    k = bisect_right(ids, (place, len(stored))) - 1
                    inside = k >= 0 and place < ids[k][1]
                tld = t[i:e].rpartition(".")[2]
                v = "@" + _vote(tld.lower() in TLDS, not tld.isalpha()) + _vote(False, inside) + _vote(not inside and t[s - 1 : s] in "<(:\n ") + _vote(False, hexed or inside)
                out.append(("email", s, e, v))
            i = t.find("@", i + 1)
        for k in sorted({s for s, _, flag in hits if flag & 64}):
            if m := _DODGE.match(t, k):
                width = 70
                while (back := _LOCAL_BACK.match(t[max(0, m.start() - width) : m.start()][::-1].replace("\r", ""))) and back.end() >= width and width < m.start():
                    width *= 4
                if not back:
                    continue
                s, local = m.start() - back.end(), back[1][::-1]
                while local and not local[0].isalnum():
                    s, local = s + 1, local[1:]
                bracket = t[m.start()] in "([{<" or bool(re.search(r"[(\[{<] ?dot", m[0], re.I))
                tld = re.split(r"[^A-Za-z0-9]+", m[1])[-1]
                spelled = bool(re.search(r"\sdot\s", m[0]))
                v = "o" + _vote(tld.lower() in TLDS, len(tld) < 2) + _vote(bracket or spelled) + _vote(re.search(r"[._+\d-]", local) or bracket) + "0"
                out.append(("email", s, m.end(), v))
        return out

    @staticmethod
    def _numbers(t: str) -> list[tuple[str, int, int, str]]:
        """Phones and ids: looked for where at least six digits stand with little between them."""
        out: list[tuple[str, int, int, str]] = []
        done = 0  # numbers may not overlap
        for region in _REGION.finditer(t):
            for run in _DIGITS.finditer(t, region.start(), region.end()):
                s = run.start()
                prev = t[s - 1] if s else "\n"
                if s < done or prev.islower() or prev in "_@=" or prev in ".-/:" and t[s - 2 : s - 1].isdigit():
                    continue  # inside a word, a time or a number that was looked at from its start
                if prev.isalpha() or prev in "- \n" and s > 1:
                    for k in (1, 2, 3):
                        at = s - k
                        if at >= 0 and t[at].isupper() and (at == 0 or not (t[at - 1].isalnum() or t[at - 1] in "@.-")) and (m := _LETTERED.match(t, at)):
                            before = t[max(0, at - 40) : at]
                            out.append(("id_number", at, m.end(), m.lastgroup[0].upper() + _vote(_ID_CUE.search(before), _NOT_ID.search(before)) + "0" + _vote(t[at - 1 : at] in " \n(", t[at - 1 : at] in "\t;,=")))
                            done = m.end()
                            break
                    if s < done:
                        continue
                if prev.isalnum():
                    continue
                at = s - 1 if prev in "+(" else s
                if at and t[at] == "(" and t[at - 1] == "+":
                    at -= 1
                m = _NUMBER.match(t, at) or (at < s and _NUMBER.match(t, s)) or None
                if not m:
                    continue
                shape, x, at = m.lastgroup, m[0], m.start()
                if "\n" in x and (part := _NUMBER.fullmatch(x[: x.index("\n")])) and part.lastgroup in PHONES and sum(map(str.isdigit, part[0])) > 9:
                    x, shape = part[0], part.lastgroup  # the number ends with its line
                digits = "".join(filter(str.isdigit, x))
                if len(digits) < 9:
                    continue
                done = at + len(x)
                before, edge = t[max(0, at - 40) : at], t[at - 1 : at]
                idcue, phonecue, other = _ID_CUE.search(before), _PHONE_CUE.search(before), _NOT_ID.search(before)
                if shape in PHONES:
                    if shape == "zero" and len(digits) < 10:
                        continue
                    enough = 9 <= len(digits) <= 15
                    sound = {"plus": enough, "trunk": len(digits) >= 11, "nanp": digits[-10:-9] in tuple("23456789") and digits[-7] != "0", "zero": enough and len(digits) <= 12, "compact": True}[shape]
                    out.append(("phone", at, done, shape[0].upper() + _vote(phonecue, idcue or other) + _vote(sound, not sound) + _vote(edge in " \n(" and not other, edge in "\t;,=")))
                else:
                    good = True
                    if shape in ("personal", "national"):
                        good = 1 <= int(digits[2:4]) <= 12 and 1 <= int(digits[4:6]) <= 31
                    out.append(("id_number", at, done, shape[0] + _vote(idcue, phonecue or other) + _vote(good, not good) + _vote(edge in " \n(", edge in "\t;,=")))
        return out

    @staticmethod
    def _streets(t: str, hits: list[tuple[int, int, int]]) -> list[tuple[str, int, int, str]]:
        """Streets: looked for beside the words and endings that name one."""
        found = set()
        for s, e, flag in hits:
            if not flag & 60 or t[e : e + 1].isalpha():
                continue
            if flag & 32 and t[e : e + 1] in (" ", "\n", "."):
                k = s - _WORD_START.match(_left(t, s, 40, 1)[::-1]).end()
                if m := _STREET_D.match(t, k):
                    found.add((k, m.end(), "D"))
            if s and (t[s - 1].isalpha() or t[s - 1] in "_-"):
                continue
            if flag & 16 and (m := _STREET_C.match(t, s)):
                found.add((s, m.end(), "C"))
            if flag & 12:
                for run in _DIGITS.finditer(t, s - len(_left(t, s, 80, 5)), s):  # the number, a letter and three words at most
                    k = run.start()
                    if run.end() - k <= 5 and t[k - 1 : k] in ("", " ", "\n", "(", ">", '"', "'"):
                        for code, rx in (("A", _STREET_A), ("B", _STREET_B)):
                            if m := rx.match(t, k):
                                found.add((k, m.end(), code))
                                break
        out, last = [], 0
        for s, e, code in sorted(found):
            if s >= last:
                out.append(_street(t, s, e, code))
                last = e
        return out

    def _beside(self, t: str, s: int, e: int, offer: Callable[[int, int, str, str, str, str], None]) -> None:
        """Offers what stands before the known family name at s, and behind it after a comma or as a header has the two.

        A given name in the gazetteer makes its own offer."""
        k, g, first, initial = s, "", s, None  # first: where the family name begins with its particles
        for _ in range(4):
            m = _GIVEN_BACK.match(_left(t, k, 45, 3)[::-1])
            if not m:
                break
            k, g, initial = k - m.end(), m[2][::-1], m[1]
            if folded(g) not in _PARTS:
                break
            first = k
        front = folded(g)
        if front in self.given:
            return
        fam = folded(t[s:e])
        word = len(front) > 1 and front not in _NO_GIVEN and front not in _PARTS
        if word and (fam in self.family and not initial or (front, fam) in self.pairs) and (m := _AFTER.match(t, k + len(g))) and m.end() >= e:
            offer(k, m.end(), "f", g, m[2], m[0])
        m = _GIVEN_NEXT.match(t, e)
        if not m or (back := folded(m[2])) in self.given or len(back) < 2 or back in _NO_GIVEN:
            return
        if (back, fam) in self.pairs:
            offer(first, m.end(), "F", m[2], t[first:e], t[first : m.end()])
        elif m[1] and fam in self.family and not (word and g[0].isupper()) and m[2][0].isupper() and t[s].isupper():
            offer(first, m.end(), "F", m[2], t[first:e], t[first : m.end()])

    def _names(self, t: str, hits: list[tuple[int, int, int]], taken: list[tuple[int, int]], locals_: str) -> list[tuple[str, int, int, str]]:
        mask = sorted(taken)
        found: list[tuple[int, int, int, str]] = []  # start, end, score, votes, in order of start

        def free(s: int, e: int) -> bool:
            k = bisect_left(mask, (e, 0))
            return not (k and s < mask[k - 1][1] or k > 1 and s < mask[k - 2][1])

        def offer(s: int, e: int, shape: str, g: str, w: str, joint: str) -> None:
            fw = folded(w)
            last = fw.replace("\n", " ").rpartition(" ")[2]
            last = last.rpartition("'")[2] or last
            if last in NO_FAMILY or last in ORGANISATION or len(last) < 3 or not free(s, e):
                return
            bare = last.rpartition("'")[2]
            whole = fw.replace("\n", " ").rpartition(" ")[2]
            paired = bool(self.pairs) and (folded(g), whole) in self.pairs
            known = paired or fw.replace("\n", " ") in self.family or last in self.family or fw.replace("'", "") in self.family
            known_given = paired or folded(g) in self.given
            gc, wc = g[:1].isupper(), w[-len(last) :][:1].isupper()
            caps = (gc and wc) if not (g.isupper() ^ w.isupper()) or len(g) < 3 else False
            org = t[e : e + 1] in (" ", "\n") and bool((nxt := _WORDAFTER.match(t, e)) and folded(nxt[1]) in ORGANISATION)
            if org and shape in "fF" and not known_given:
                return  # a company
            before = t[max(0, s - 30) : s]
            cue = s == 0 or t[s - 1] in "\n\"(" or bool(_FOLLOW.match(t, e) or _TITLE.search(before) or _CUE.search(before))
            article = before[-4:].lower().replace("\n", " ") in ("the ", "die ", "der ", "das ") or before[-3:].lower().replace("\n", " ") in ("la ", "le ", "el ")
            mailed = len(bare) > 3 and bare in locals_
            # an unknown word beside a known family name speaks against itself if it's written small, here or elsewhere in the text
            common = shape in "fF" and not known_given and (not gc or f" {g.lower()} " in t)
            v = shape + _vote(known_given, common) + _vote(known) + _vote(caps, not caps and (not known or shape in "fF" and gc != wc)) + _vote(False, org or article)
            v += _vote(cue) + _vote(mailed) + _vote(False, "\n" in joint and not known)
            score = v.count("+") - v.count("-")
            k = bisect_left(found, (s, 0))
            near = [x for x in found[max(0, k - 3) : k + 3] if x[0] < e and s < x[1]]
            if any((x[2], x[1] - x[0]) >= (score, e - s) for x in near):
                return
            for x in near:
                found.pop(bisect_left(found, x))
            found.insert(bisect_left(found, (s, 0)), (s, e, score, v))

        for s, e, flag in hits:
            if not flag & 3:
                continue
            if s and (t[s - 1].isalpha() or t[s - 1] in "'’_@.") and not t[s - 1] == "\n" or e < len(t) and (t[e].isalpha() or t[e] in "'’_@"):
                continue
            if flag & 1:
                g = t[s:e]
                if m := _AFTER.match(t, e):
                    offer(s, m.end(), "g", g, m[2], m[0])
                if s > 2 and t[s - 1] in " \n":
                    gap = 2 if t[s - 2] in " \n" else 1
                    comma = t[s - gap - 1] == ","
                    word = _WORD_BACK.match(_left(t, s - gap - comma, 40, 1)[::-1])
                    if word and (comma or folded(word[0][::-1]) in self.family):
                        left = _left(t, s, 45, 4)
                        m = (_BEFORE if comma else _BEFORE_PLAIN).search(left)
                        if m and comma and (x := _FIRST_BACK.match(left[: m.start(1)][::-1])) and (x[1] or folded(x[2][::-1]) in self.given):
                            m = None  # the family name belongs to the given name before it
                        if m:
                            offer(s - len(left) + m.start(1), e, "," if comma else "w", g, m[1], m[0])
            if flag & 2:
                left = t[max(0, s - 20) : s]
                if (last := left.split()[-1:]) and folded(last[0]) in _PARTS:
                    left = _left(t, s, 60, 6)
                if "." in left and (m := _INITIAL_BEFORE.search(left)):
                    k = s - len(left) + m.start()
                    offer(k, e, "i", t[k], t[s:e], m[0])
                if t[e : e + 1] == "," and (m := _INITIAL_AFTER.match(t, e)):
                    offer(s, m.end(), "I", t[m.end() - 2], t[s:e], m[0])
                self._beside(t, s, e, offer)
        for m in _INITIAL.finditer(t):
            before = t[m.start() - 1 : m.start()]
            if before.isalnum() or before in ("_", "."):
                continue
            offer(m.start(), m.end(), "i", m[0][0], m[1], m[0])
        return [("name", s, e, v) for s, e, _, v in found]


_ADDRESSES = re.compile(r"^(?:from|to|cc|reply-to|sender):[ \t]*((?:[^\n]|\n[ \t])*)", re.I | re.M)
_SHOWN = re.compile(r'(?:"([^"<>@,]+), ([^"<>@,]+)"|([^"<>@,()=:\s][^"<>@,()=:]*?)"?)\s*<|\(([^()@<>=]+)\)')
_LETTERS = re.compile(r"[^\W\d_](?:[^\W\d_]|['’-])*")


def gazetteer(docs: DataFrame, text: str = "text", least: int = 3) -> DataFrame:
    """word, role (given, family or pair), n: from the display names of mail headers.

    A given name stands with at least ``least`` different family names and more often first than last.
    Names whose first word isn't such a given name stay whole: role pair, word 'Given Family'.
    """
    head = F.substring_index(F.substring_index(text, "\n\n", 1), "\r\n\r\n", 1)

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, str]] = Counter()
            for h in batch.column(0).to_pylist():
                for line in _ADDRESSES.findall(h):
                    for last, first, plain, after in _SHOWN.findall(line):
                        w = (f"{first} {last}" if last else plain or after).split()
                        if 2 <= len(w) and _LETTERS.fullmatch("".join(w)):
                            seen[w[0], w[-1]] += 1
            g, f = zip(*seen) if seen else [[]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(f, pa.string()), pa.array(list(seen.values()), pa.int64())], names=["g", "f", "n"])

    pairs = docs.where(F.col(text).isNotNull()).select(head).mapInArrow(shown, "g string, f string, n long").groupBy("g", "f").agg(F.sum("n").alias("n"))
    pairs = cut(pairs)  # read several times below
    first = pairs.groupBy(F.col("g").alias("word")).agg(F.countDistinct("f").alias("partners"), F.sum("n").alias("first"))
    last = pairs.groupBy(F.col("f").alias("word")).agg(F.sum("n").alias("last"))
    both = first.join(last, "word", "full").na.fill(0)
    is_given = (F.col("partners") >= least) & (F.col("first") > F.col("last"))
    words = both.select("word", F.when(is_given, "given").otherwise("family").alias("role"), F.greatest("first", "last").alias("n")).where(
        is_given | (F.col("last") > 0)
    )
    whole = pairs.join(both.where(is_given).select(F.col("word").alias("g")), "g", "left_anti")
    return words.unionByName(whole.select(F.concat_ws(" ", "g", "f").alias("word"), F.lit("pair").alias("role"), "n"))


_RUN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")


def _pieces(t: str) -> list[str]:
    """Words by which a name can be looked up in a text: each run of letters small and folded, and runs with apostrophes joined."""
    out = []
    for run in _RUN.findall(t.lower()):
        parts = [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
        if len(parts) > 1:  # a name that holds no apostrophe can stand for one that does
            parts += ["".join(parts[i:]) for i in range(len(parts) - 1)]
        for p in parts:
            out += [p] if p.isascii() else [p, *("".join(c if c.isalpha() else " " for c in folded(p)).split())]
    return list(dict.fromkeys(out))


SPANS = "array<struct<kind: string, start_pos: long, end_pos: long, votes: string, looks: long>>"
_KINDS = pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("votes", pa.string()), ("looks", pa.int64())])


def candidates(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", limit: int = GAZETTEER, keep_text: bool = False) -> DataFrame:
    """doc_id, spans (and text): every candidate span of every whole text, a row per mail."""
    roles = ("given", "family", "pair")
    out = "doc_id long, " + "text string, " * keep_text + "spans " + SPANS
    docs = docs.select(F.col(key).cast("long").alias("__key"), F.col(text).alias("__text"))

    def found(scanner: Scanner, keys: list, texts: list) -> pa.RecordBatch:
        spans = [scanner.spans(t) if t else [] for t in texts]
        flat = [s for own in spans for s in own]
        columns = [pa.array(c, kind.type) for c, kind in zip(zip(*flat) if flat else [[]] * 5, _KINDS)]
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, spans)]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_KINDS)))
        kept = [pa.array(texts, pa.string())] * keep_text
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *kept, lists], names=["d", *["t"] * keep_text, "s"])

    if small(names, limit):
        kept = names.collect()
        lists = docs.sparkSession.sparkContext.broadcast([[r["word"] for r in kept if r["role"] == role] for role in roles])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(*lists.value)
            for batch in batches:
                yield found(scanner, *(c.to_pylist() for c in batch.columns))

        return docs.mapInArrow(run, out)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(*(c.to_pylist() for c in batch.columns)):
                words = sorted(_pieces(Flat(t).text)) if t else []
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(words), pa.int64()), pa.array(words, pa.string())], names=["k", "w"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                keys, texts, own = (c.to_pylist() for c in batch.slice(i, SLICE).columns)
                mine = {x for n in own for x in n or ()}
                yield found(Scanner(*[[x[1:] for x in mine if x[0] == role[0]] for role in roles]), keys, texts)

    first = F.udf(lambda name: sorted({p for w in name.split(" ") for form in (w.lower(), folded(w)) for p in _pieces(form)[:1]}), "array<string>")
    by_word = names.select(F.explode(first("word")).alias("w"), F.concat(F.substring("role", 1, 1), "word").alias("name"))
    own = docs.mapInArrow(tokens, "k long, w string").join(by_word, "w").groupBy("k").agg(F.collect_set("name").alias("names"))
    return docs.join(own, F.col("__key").eqNullSafe(F.col("k")), "left").select("__key", "__text", "names").mapInArrow(scan, out)


def _em(votes: np.ndarray, n: np.ndarray, rounds: int = 50, strength: float = 0.05) -> np.ndarray:
    """Probability that a span is true for each vote pattern, by EM over pattern counts.

    votes: patterns x labelers in {0: -, 1: 0, 2: +}. The starting belief (a labeler is rather right than
    wrong) stays as pseudo-counts of ``strength`` times the corpus.
    """
    belief = np.array([[0.60, 0.35, 0.05], [0.05, 0.35, 0.60]])  # votes on false and on true spans
    weight = strength * n.sum() + 1
    table = np.repeat(belief[:, None, :], votes.shape[1], axis=1)
    prior = 0.7
    onehot = np.eye(3)[votes]
    for _ in range(rounds):
        log = np.array([np.log(table[y][np.arange(votes.shape[1]), votes]).sum(axis=1) for y in (0, 1)])
        odds = log[1] - log[0] + np.log(prior / (1 - prior))
        p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        for y, q in enumerate((1 - p, p)):
            count = np.einsum("i,ijk->jk", q * n, onehot) + weight * belief[y]
            table[y] = count / count.sum(axis=1, keepdims=True)
        prior = np.clip((p @ n + 0.7 * weight) / (n.sum() + weight), 0.05, 0.95)
    return p


class Judge:
    """Span classifier of one kind. A logistic model of the looks alone learns EM's labels, so it sees the spans from another
    side than the labelers; its log odds over the share of true spans are added to those of the votes."""

    def __init__(self, patterns: dict[str, float]):
        """patterns: probability of each vote pattern by EM."""
        odds = {v: min(max(p, CERTAIN), 1 - CERTAIN) for v, p in patterns.items()}
        self.votes = {v: float(np.log(p / (1 - p))) for v, p in odds.items()}
        self.looks, self.base, self.prior = np.zeros(LOOKS), 0.0, 0.0

    def looked(self, looks: np.ndarray) -> np.ndarray:
        return self.base + self.looks[looks].sum(axis=1)

    def score(self, votes: pd.Series, looks: np.ndarray) -> np.ndarray:
        """Log odds that the span is true."""
        return votes.map(self.votes).fillna(0.0).to_numpy(dtype=float) + self.looked(looks) - self.prior

    def fit(self, looks: np.ndarray, p: np.ndarray, rounds: int = 150, ridge: float = 2.0) -> None:
        """Steps of Adagrad on all labelled spans at once; ``ridge`` draws every weight to 0, so rare looks say little."""
        share = float(np.clip(p.mean(), CERTAIN, 1 - CERTAIN))
        self.base = self.prior = float(np.log(share / (1 - share)))
        seen, last = np.full(LOOKS, 1e-3), 1e-3
        for _ in range(rounds):
            miss = 1 / (1 + np.exp(-np.clip(self.looked(looks), -30, 30))) - p
            step, all_ = np.bincount(looks.ravel(), np.repeat(miss, looks.shape[1]), LOOKS) + ridge * self.looks, float(miss.sum())
            seen, last = seen + step * step, last + all_ * all_
            self.looks -= 0.5 * step / np.sqrt(seen)
            self.base -= 0.5 * all_ / last**0.5


def soft_labels(counts: pd.DataFrame) -> pd.DataFrame:
    """kind, votes, p from kind, votes, n: what EM makes of the labelers' votes, kind by kind."""
    out = []
    for kind, c in counts.groupby("kind"):
        votes = np.array([["-0+".index(ch) for ch in v[1:]] for v in c["votes"]])
        out.append(pd.DataFrame({"kind": kind, "votes": c["votes"].to_numpy(), "p": _em(votes, c["n"].to_numpy(dtype=float))}))
    return pd.concat(out) if out else pd.DataFrame({"kind": [], "votes": [], "p": []})


def train(labels: pd.DataFrame, sample: pd.DataFrame) -> dict[str, Judge]:
    """A classifier for each kind. labels: kind, votes, p; sample: spans with kind, votes, looks."""
    out = {k: Judge(dict(zip(c["votes"], c["p"]))) for k, c in labels.groupby("kind")}
    for kind, c in sample.merge(labels, on=["kind", "votes"]).groupby("kind"):
        out[kind].fit(unpacked(c["looks"].to_numpy()), c["p"].to_numpy(dtype=float))
    return out


def _judged(judges: dict[str, Judge], kinds: pd.Series, votes: pd.Series, looks: np.ndarray) -> np.ndarray:
    """Probability of each span."""
    p = np.zeros(len(kinds))
    for kind, judge in judges.items():
        own = np.flatnonzero(kinds.to_numpy() == kind)
        if len(own):
            p[own] = 1 / (1 + np.exp(-np.clip(judge.score(votes.iloc[own], unpacked(looks[own])), -30, 30)))
    return p


def _flat(spans: DataFrame) -> DataFrame:
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.*")


def fit(spans: DataFrame, sample: int = SAMPLE) -> dict[str, Judge]:
    """The classifiers for a written table of candidates. The driver gets the counts of vote patterns and at most about ``sample`` spans."""
    flat = _flat(spans)
    counts = flat.groupBy("kind", "votes").agg(F.count("*").alias("n")).toPandas()
    kinds = counts.groupby("kind")["n"].sum()
    share = max(1, len(kinds))
    every = F.create_map(*[F.lit(x) for k, n in kinds.items() for x in (k, max(1, -(-int(n) * share // sample)))]) if len(kinds) else F.create_map(F.lit(""), F.lit(1))
    rows = flat.where(F.pmod(F.xxhash64("doc_id", "start_pos"), every[F.col("kind")]) == 0).select("kind", "votes", "looks").toPandas()
    return train(soft_labels(counts), rows) if len(rows) else {}


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind, start_pos, end_pos, p of every personal span. Writes the candidates to the shared folder."""
    spans = cut(candidates(docs, gazetteer(docs, text), key, text))
    shared = docs.sparkSession.sparkContext.broadcast(fit(spans))

    @F.pandas_udf("double")
    def judged(kind: pd.Series, votes: pd.Series, looks: pd.Series) -> pd.Series:
        return pd.Series(_judged(shared.value, kind, votes, looks.to_numpy()))

    return _flat(spans).withColumn("p", judged("kind", "votes", "looks")).where("p >= 0.5").select("doc_id", "kind", "start_pos", "end_pos", "p")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with ``[KIND]`` in place of every span. The texts are written beside their candidates, so no text is shuffled."""
    spans = cut(candidates(docs, gazetteer(docs, text), key, text, keep_text=True))
    shared = docs.sparkSession.sparkContext.broadcast(fit(spans))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat, ends = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            kind, start, stop, votes = (flat.field(i).to_pandas() for i in range(4))
            looks = flat.field(4).to_numpy(zero_copy_only=False)
            true = _judged(shared.value, kind, votes, looks) >= 0.5
            out = []
            for i, t in enumerate(batch.column(1).to_pylist()):
                own = [j for j in range(ends[i], ends[i + 1]) if true[j]]
                if t is None or not own:
                    out.append(t)
                    continue
                parts, at = [], 0
                for j in sorted(own, key=lambda j: (start[j], -stop[j])):
                    if start[j] >= at:
                        parts += [t[at : start[j]], f"[{kind[j].upper()}]"]
                    at = max(at, stop[j])
                out.append("".join(parts) + t[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["d", "t"])

    return spans.select("doc_id", "text", "spans").mapInArrow(replaced, "doc_id long, text string")
