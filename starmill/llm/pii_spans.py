"""Candidate spans of personal data in a text, each with the votes of labelers.

A candidate finder is a wide regular expression; a labeler looks at a candidate and its line and votes 1 (is
personal data of the kind), -1 (is not) or 0.  Nothing here decides: see pii.py.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

KINDS = ("email", "phone", "id_number", "address", "name")
#: Labelers of the text itself; pii.py adds those of the gazetteers.
LABELERS = ("form", "before", "after", "line", "prose", "trap")

# ---------------------------------------------------------------- email

_EMAIL = re.compile(r"@(?=[^\W_][\w-]*\.[\w.-]*[^\W\d_]{2})(?<=[\w%+-]@)")
_EMAIL_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_SPELT = re.compile(
    r"(?<![\w.+%-])([^\W_][\w.+%-]*+)(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?| at | AT )([^\W_](?:[\w-]*[^\W_])?(?:(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?| dot | DOT |\.)[^\W_](?:[\w-]*[^\W_])?)+)"
)
_SPELT_HINT = tuple(f"{x}at{y}" for x, y in ("  ", "()", "[]", "{}", "<>")) + tuple(f"{x} at" for x in "([{<") + tuple(f"{x}@" for x in "([{<") + tuple(f"{x} @" for x in "([{<")
_ROBOT = re.compile(r"no-?reply|bot", re.I)
_MAIL_CUE = re.compile(r"(?:<|mail(?:to)?\W{0,3}|contact\W{0,2}|\w:\s|\b(?:ask|notify|cc|by|from|to|at|via|write|reach|tell)\W{1,2}|[|;,\t'\"(\[]\s?)$", re.I)

# ---------------------------------------------------------------- numbers

# patterns begin with their first character, looked back from, so that the engine skips to where it can stand
_NUMBER = re.compile(r"[+(\d](?:(?<![\w.-].)|(?<=^-.))(?:(?<=\d)|(?<=[+(])[\d(])[\d ()./+-]{5,30}[\dA-Za-z](?![\w])", re.M)
_NUMBER_PARTS = (
    re.compile(r"\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}$"),  # international with plus
    re.compile(r"00\d{1,3}(?:[ .-]?\d{1,4}){2,6}$"),  # international with zeros
    re.compile(r"0\d{2,4}[ /-]\d{2,4}(?:[ -]\d{2,4})*$"),  # national with trunk zero
    re.compile(r"(?:\+?1[ .-])?(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}$"),  # north american
)
_PHONE_CUE = re.compile(r"(?:\b(?:tel|phone|telefon|téléphone|teléfono|fon|fax|mob|mobile|mobil|móvil|cell|call|ring|desk|reach(?:able|ed)?|under|unter|anrufen|rufnummer|numéro|número|pager|number|nummer|dial|text|sms|whatsapp|t|back|on|at|au|al)\b[\W_]{0,6}(?:on|under|at|is|no|me|us)?[\W_]{0,4})$", re.I)
_PHONE_AFTER = re.compile(r"^(?:\W{0,2}$|\s?[|;\t<'\"),.!?]|\s?[\r\n])", re.I)
_ID_FORMS = (
    re.compile(r"\d{3}-\d{2}-\d{4}$"),
    re.compile(r"\d{2} \d{3} \d{3} \d{3}$"),
    re.compile(r"\d{8}-?[A-Za-z]$"),
    re.compile(r"\d{6}[-+]?\d{4}[0-9A-Za-z]?$"),
    re.compile(r"\d{9,13}$"),
)
_LETTERED = re.compile(r"[A-Z](?<!\w.)(?:[A-Z]?\d{6,9}|[A-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D])\b")
_ID_LABEL = re.compile(
    r"(?:\b(?:ssn|social security(?: (?:no\.?|number|nr\.?))?|tin|tax(?:payer)? (?:id|no\.?|number)|steuer-?id(?:nr\.?)?|idnr\.?|dni|nie|nif|documento|pesel|personal (?:code|no\.?|number)|national (?:id|insurance)(?: (?:no\.?|number))?"
    r"|passport(?: (?:no\.?|number|nr\.?))?|reisepass(?: ?-?nr\.?)?|passeport(?: (?:no|n°|nº)\.?)?|pasaporte|ni number|nino|insee|cpf|bsn|personnummer|personalausweis|identity(?: (?:no\.?|number|card))?|id (?:no\.?|number|card))\b\.?\"?\s?(?:[:=#]|is|was|ist|est|es)?\s?\"?'?)$",
    re.I,
)
_NOT_ID = re.compile(r"(?:\b(?:build|run_id|sum|rows|release|supersedes|version|port|pixel\w*|id|chunk|commit|index|offset)\b\W{0,3})$", re.I)
_DATE = re.compile(r"[+(]?\d{4}-\d\d-\d\d(?: \d+)?|\d{1,3}(?:\.\d{1,3}){3}|[+(]?\d+\.\d+")

# ---------------------------------------------------------------- address

_EN_TYPES = r"(?:Road|Rd|Street|St|Lane|Ln|Way|Drive|Dr|Terrace|Ter|Close|Cl|Crescent|Cres|Avenue|Ave|Court|Ct|Square|Sq|Place|Pl|Row|Walk|Hill|Gardens|Gdns|Grove|Park|Mews|Boulevard|Blvd|Parade|Rise|Quay)"
_FR_WORDS = ("rue", "impasse", "avenue", "boulevard", "place", "chemin", "allée", "quai", "route", "cours", "square", "passage", "sentier")
_DE_ENDS = ("straße", "strasse", "str.", "str", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig", "hof")
_ES_WORDS = ("Calle", "C/", "Avenida", "Avda.", "Avda", "Av.", "Plaza", "Paseo", "Carrera", "Camino", "Ronda", "Travesía", "Viale", "Piazza", "Rua", "Largo")
_MARKS = "\u0300-\u036f"  # letters may be decomposed
_CAP = rf"[A-ZÀ-Þ][\w'’{_MARKS}]*"
_NUM = r"\d{1,5}[A-Za-z]?"
_any = lambda words: "|".join(re.escape(w) for w in words)
_EN_ADDRESS = re.compile(rf"(?<![\w./-]){_NUM},? (?:(?:{_CAP}\.?|of|the|upon)[ -]){{1,4}}{_EN_TYPES}\b\.?")
_FR_ADDRESS = re.compile(
    rf"(?<![\w./-])\d{{1,5}}[A-Za-z]?(?: (?:bis|ter|quater))?,? (?i:{_any(_FR_WORDS)}) (?:(?:de la|de l['’]|de|du|des|d['’]|la|le|les|aux?)(?<=[\w'’]) ?)?{_CAP}(?:-{_CAP}){{0,4}}(?:(?: (?:de la|de|du|des|la|le))?[ -]{_CAP}){{0,6}}"
)
_DE_ADDRESS = re.compile(rf"(?<![\w-])(?:(?:Alte|Neue|Am|An der|Auf der|Im|In der|Zum|Zur|Obere|Untere|Große|Kleine)[ -])?[A-ZÀ-Þ][\w{_MARKS}-]*?(?i:{_any(_DE_ENDS)}) \d{{1,5}}(?: ?[a-z](?![\w]))?(?!\w)")
_ES_ADDRESS = re.compile(
    rf"(?<![\w])(?i:{_any(_ES_WORDS)})(?: (?:de los|de las|de la|del|de|do|da|dos|das))?(?: {_CAP}(?: de (?:los |las |la )?{_CAP}){{0,3}}){{1,6}},? (?:n[º°] ?)?\d{{1,5}}[A-Za-z]?(?!\w)"
)
_EN_HINT = re.compile(r"\d[A-Za-z]?,? (?=[A-ZÀ-Þ])")
#: What a text has to hold, in lower case, to be searched for addresses of a language: every alternative of its pattern.
_FR_HINT, _DE_HINT, _ES_HINT = (tuple(f"{w.lower()} " for w in words) for words in (_FR_WORDS, _DE_ENDS, _ES_WORDS))
_ADDRESS_CUE = re.compile(r"(?:\b(?:liv(?:e|es|ed|ing) at|address|adresse|anschrift|street|straße|moved to|ship\w*|send|sent|deliver\w*|visit\w*|wohn\w*|domicilio|at|to|in|near|from)\W{0,3}|[|;\t]\s?|\w[:=]\s?[\"']?)$", re.I)
_ADDRESS_AFTER = re.compile(r"^(?:,? [A-ZÀ-Þ]|,? (?:in|near|with|and|for) |[.,]?\s*$|[.,]?\s*[\r\n]|[|;\t]|\"|'|[.,] )")

# ---------------------------------------------------------------- name

_PARTICLE = r"(?:(?:van der|van den|van|von der|von|de la|del|della|der|den|da|di|dos|du|ten|ter|bin|ibn|de) )?(?:(?:al|el|ben|abu)-)?(?:[DOdo]['’])?"
_LETTER = rf"(?:[^\W\d_]|[{_MARKS}])"
_HEAD = "[A-ZÀ-ÞŁŚŻĆŠŽČ]"
_TAIL = rf"{_LETTER}+(?:(?:-|['’](?!s(?![^\W\d_]))){_LETTER}+)*"
_TOKEN = _HEAD + _TAIL
_FAMILY = re.compile(rf"{_PARTICLE}{_TOKEN}")
_NAME = re.compile(rf"({_HEAD}(?<![\w@./\\-].){_TAIL})(?: [A-Z]\.)? (?=({_PARTICLE}{_TOKEN})(?![\w@{_MARKS}]))")
_NAME_WHOLE = re.compile(rf"({_TOKEN})((?: [A-Z]\.)?) ({_PARTICLE}{_TOKEN})(?![\w@{_MARKS}])")
_NAME_TURNED = re.compile(rf"(?<![\w@./\\-])({_PARTICLE}{_TOKEN}), ({_TOKEN}(?: [A-Z]\.)?)(?![\w@{_MARKS}])")
_TURNED_HINT = re.compile(rf", {_HEAD}")
#: Any case, in quotes or after cues only.
_ANY = rf"{_LETTER}{{2,}}(?:[-'’]{_LETTER}+)*"
_NAME_LOWER = re.compile(rf"\"({_ANY})((?: [A-Za-z]\.)?),? ({_PARTICLE}{_ANY})(?=\")", re.I)
_LOWER_BEFORE = re.compile(r"(?:\b(?:user|name|holder|owner|author|person|contact|patient|client|customer|member)\"?[ :=]{1,2})$")
#: Words that are no part of a name: those that stand before names or begin sentences, and capitals of queries.
_STOP = frozenset(
    "a an the this that these those as at by for from in into of on or and but if when while with to is are was were be not no we you he she it they i my our your his her its their all any each every some please dear hi hello hey "
    "thanks thank regards cheers sincerely best kind see ask call contact meet mr mrs ms miss dr prof sir madam herr frau mme monsieur madame señor señora sr sra der die das ein eine im und oder mit für von bei nach bitte danke liebe lieber "
    "le la les un une des du et ou avec pour par merci bonjour el los las una y o con por gracias hola null select where group order join into values set "
    "neither either nor both so yet then than there here who whom which what how why whether because since until unless although though however therefore thus also only even never always now suppose let such".split()
)
#: Capitals in prose that name something else: days, months, institutions and parts of place names.
_ELSE = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march july september october november december university college institute school hospital company corporation inc ltd llc gmbh "
    "ministry department committee council group team project north south east west new united republic kingdom states city county river lake mount street road avenue lane square park bank airport station church museum".split()
)
_GERMAN = re.compile(r"\b(?:der|die|das|den|dem|und|oder|ist|sind|im|ein|eine|einen|nicht|mit|für|zu|zum|zur|auf|aus|bei|nach|von|jetzt|wird|wurde|auch|sich)\b")
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Mme|Mlle|M|Monsieur|Madame|Sr|Sra|Señora?|Don|Doña"
#: Before a name: a title, a label and its colon, a greeting, a preposition or verb that takes persons, a mark of code.
_NAME_BEFORE = re.compile(
    rf"(?:\b(?:{_TITLES})\.? |\b[\w-]+[\"']?\s?[:=]\s?[\"'(]?|@\w+ |\b[A-Z]{{3,}}\(|\b(?:user|owner|author|name|named|called|is|am|I'm|dear|hi|hello|hey|bonjour|hola|liebe|lieber|bitte|regards|sincerely|cheers|thanks|merci|danke|gracias|by|with|from|to|for|via"
    r"|von|mit|durch|an|par|avec|à|pour|a|por|con|contact|ask|asked|call|called|meet|met|tell|told|email|notify|invite|invited|thank|saw|see|as|and|soy|suis|bin|heiße|Mein Name ist),? ?[\"']?|[;|\t]\s?)$",
    re.I,
)
#: After a name: an address or number, a verb of persons, a possessive, the end of a field.
_NAME_AFTER = re.compile(
    r"^(?:\s?<[^>\n]{0,60}(?:@|\(at\)|\[at\]| at )|['’]s\b|,? (?:said|says|asked|asks|wrote|writes|called|calls|told|tells|pointed|points|noted|reported|replied|answered|approved|agreed|confirmed|joined|left|lives|lived|works|worked|was|is|has|had|will|would|can|who|whose|reachable|reach|sent|born|and|or|at|for|from|in"
    r"|see|ask|anrufen|hat|ist|war|schrieb|sagte|fragte|pour|est|demande|es|dijo|preguntó)\b|\)?[:,]|\s?\((?:[A-Za-z]|\d)|\"|'|[.!?]?\s*$|[;|\t])"
)
_NAME_STRONG_BEFORE = re.compile(r"(?:@author |\b(?:holder|owner|author)\": \"|__author__ = [\"']|\b(?:TODO|FIXME)\(|^[A-Z][a-z]+(?:-[a-z]+)+: |\buser \"|\b(?:" + _TITLES + r")\.? )$")


def _line(text: str, a: int, b: int) -> tuple[int, int]:
    start = max(text.rfind("\n", 0, a), text.rfind("\r", 0, a)) + 1
    ends = [e for e in (text.find("\n", b), text.find("\r", b)) if e >= 0]
    return start, min(ends) if ends else len(text)


def _sides(text: str, a: int, b: int, reach: int = 48) -> tuple[str, str, int]:
    s, e = _line(text, a, b)
    return text[max(s, a - reach) : a], text[b : min(e, b + reach)], s


def _codeish(text: str, a: int, b: int) -> bool:
    s, e = _line(text, a, b)
    if text.startswith(("diff ", "index ", "@@ ", "--- a", "+++ b"), s):
        return True
    return bool(re.search(r"[{}]$|\);$|->|\(\)|==|:=", text[max(s, a - 200) : min(e, b + 200)]))


def emails(text: str) -> Iterator[tuple[int, int, str, dict[str, int]]]:
    """As (start, end, domain with dots, votes)."""
    spans = []
    if "@" in text:
        for m in _EMAIL.finditer(text):
            a = m.start()
            while a and (text[a - 1].isalnum() or text[a - 1] in "_.+%-"):  # the runs before two at-signs never overlap
                a -= 1
            while a < m.start() and not text[a].isalnum():
                a += 1
            domain = _EMAIL_DOMAIN.match(text, m.end())
            if a < m.start() and domain:
                spans.append((a, domain.end(), text[a : m.start()], domain[0], False))
    low = text.lower()
    if any(h in low for h in _SPELT_HINT):
        for m in _SPELT.finditer(text):
            spans.append((m.start(), m.end(), m[1], m[2], True))
    for a, b, local, domain, spelt in spans:
        before, after, _ = _sides(text, a, b)
        loose = spelt and not re.search(r"[\[({<]", text[a:b])  # only " at " and " dot "
        last = re.split(r"\W+", domain)[-1]
        form = -1 if last.isdigit() or len(last) < 2 or (loose and " dot " not in text[a:b].lower()) else 1
        trap = -1 if _ROBOT.search(local) or "://" in before[-40:].rpartition(" ")[2] or (local == "git" and after[:1] in (":", "/")) or after[:2] == ":/" or re.match(r":[\w.-]+/[\w.-]", after) else 0
        dotted = re.sub(r"\s*(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]| dot )\s*", ".", domain.lower())
        yield a, b, dotted, {"form": form, "before": 1 if _MAIL_CUE.search(before) else 0, "after": 1 if re.match(r"^[>|;,\t'\")\] ]|^$", after) else 0, "line": -1 if _codeish(text, a, b) and form < 0 else 0, "prose": 0, "trap": trap}


def _number_votes(text: str, a: int, b: int) -> Iterator[tuple[str, int, int, dict[str, int]]]:
    raw = text[a:b]
    before, after, start = _sides(text, a, b)
    digits = sum(c.isdigit() for c in raw)
    odd = -1 if _DATE.fullmatch(raw) or _NOT_ID.search(before) or re.search(r"[\d.][-+]?$|,\s?$", before) and re.match(r"\s?,", after) else 0
    labelled = _ID_LABEL.search(before)
    phone = raw
    pa = a
    if a == start and re.match(r"\+(?:0|\(|\d{3}-\d{3}-\d{4}$)", raw):
        phone, pa = raw[1:], a + 1  # the plus is a diff mark
    if phone[-1].isdigit() and any(p.match(phone) for p in _NUMBER_PARTS) and 8 <= digits <= 15:
        cue = _PHONE_CUE.search(before)
        strict = _NUMBER_PARTS[0].match(phone) or _NUMBER_PARTS[3].match(phone) or phone.startswith("0")
        yield "phone", pa, b, {"form": 1 if strict else 0, "before": -1 if labelled else 1 if cue or re.search(r"[;|\t'\">=]\s?$", before) else 0, "after": 1 if _PHONE_AFTER.match(after) else 0, "line": -1 if re.search(r"[{}]$|0x", text[start : b + 20]) else 0, "prose": 0, "trap": -1 if text[b : b + 1].isalpha() else odd}
    if any(p.match(raw) for p in _ID_FORMS):
        yield "id_number", a, b, {"form": 1 if any(p.match(raw) for p in _ID_FORMS[:4]) else 0, "before": 1 if labelled else -1, "after": 1 if re.match(r"^[)\",.; ]|^$", after) else -1, "line": 0, "prose": 0, "trap": -1 if odd and not labelled else 0}


def numbers(text: str) -> Iterator[tuple[str, int, int, dict[str, int]]]:
    for m in _NUMBER.finditer(text):
        a, b = m.span()
        raw = m[0]
        if _DATE.fullmatch(raw):
            continue
        while b > a and not text[b - 1].isalnum():
            b -= 1
        if text[b - 1].isalpha() and not any(p.match(text[a:b]) for p in _ID_FORMS):
            b -= 1
            while b > a and not text[b - 1].isalnum():
                b -= 1
        if raw[0] == "(" and ")" not in text[a:b]:
            a += 1
        if b - a >= 7:
            yield from _number_votes(text, a, b)
    for m in _LETTERED.finditer(text):
        before, after, _ = _sides(text, *m.span())
        labelled = _ID_LABEL.search(before)
        yield "id_number", m.start(), m.end(), {"form": 1 if len(m[0]) in (8, 9, 13) else 0, "before": 1 if labelled else -1, "after": 1 if re.match(r"^[)\",.; ]|^$", after) else -1, "line": 0, "prose": 0, "trap": 0}


def addresses(text: str) -> Iterator[tuple[int, int, dict[str, int]]]:
    finders = []
    if _EN_HINT.search(text):
        finders.append((_EN_ADDRESS, "en"))
    low = text.lower()
    if any(h in low for h in _FR_HINT):
        finders.append((_FR_ADDRESS, "fr"))
    if any(h in low for h in _DE_HINT):
        finders.append((_DE_ADDRESS, "de"))
    if any(h in low for h in _ES_HINT):
        finders.append((_ES_ADDRESS, "es"))
    for finder, kind in finders:
        for m in finder.finditer(text):
            a, b = m.span()
            if "\n" in m[0] or "\r" in m[0]:
                continue
            if kind == "en" and m[0].endswith(".") and re.match(r"^(?:\s*$|\s*[\r\n])", text[b : b + 2]) and not re.search(r"\b(?:Rd|St|Ave|Dr|Ln|Ter|Cl|Cres|Ct|Sq|Pl|Blvd|Gdns)\.$", m[0], re.I):
                b -= 1
            elif m[0].endswith(".") and kind == "en" and not re.search(r"\b(?:Rd|St|Ave|Dr|Ln|Ter|Cl|Cres|Ct|Sq|Pl|Blvd|Gdns)\.$", m[0], re.I):
                b -= 1
            before, after, _ = _sides(text, a, b)
            words = [w for w in re.split(r"[\s,]+", text[a:b]) if w[:1].isalpha()]
            capital = sum(w[:1].isupper() for w in words)
            yield a, b, {"form": 1 if capital >= 1 + (kind == "en") or (kind in "defr" and capital) else -1, "before": 1 if _ADDRESS_CUE.search(before) else 0, "after": 1 if _ADDRESS_AFTER.match(after) else 0, "line": -1 if _codeish(text, a, b) else 0, "prose": 0, "trap": 0}


def names(text: str) -> Iterator[tuple[int, int, str, str, dict[str, int]]]:
    """As (start, end, given, family, votes)."""
    spans: dict[tuple[int, int], tuple[str, str]] = {}
    for m in _NAME.finditer(text):
        whole = _NAME_WHOLE.match(text, m.start())
        if whole:
            spans[whole.span()] = (whole[1], whole[3])
    for m in _NAME_TURNED.finditer(text) if _TURNED_HINT.search(text) else ():
        spans[m.span()] = (m[2].split(" ")[0], m[1])
    if '"' in text:
        for m in _NAME_LOWER.finditer(text):
            if _LOWER_BEFORE.search(text[max(0, m.start() - 10) : m.start()]):
                spans[(m.start() + 1, m.end())] = (m[3], m[1]) if "," in m[0] else (m[1], m[3])
    for (a, b), (given, family) in spans.items():
        words = {w.casefold() for w in (given, *family.split(" "))}
        if given.casefold() in _STOP or family.rpartition(" ")[2].casefold() in _STOP:
            continue
        before, after, start = _sides(text, a, b, 64)
        _, end = _line(text, a, b)
        lone = a - start < 40 and end - b < 40 and not text[start:a].strip("+-#/* \t") and not text[b:end].strip()
        strong = _NAME_STRONG_BEFORE.search(before)
        capitals = given.isupper() and family.isupper() and len(given) > 1
        form = -1 if words & _ELSE or capitals else 1 if _FAMILY.fullmatch(family) or given.islower() else 0
        yield a, b, given, family, {"form": form, "before": 1 if strong or _NAME_BEFORE.search(before) else 0, "after": 1 if _NAME_AFTER.match(after) else 0, "line": 1 if lone or strong else -1 if _codeish(text, a, b) else 0, "prose": _prose(before, after), "trap": 0}


def _prose(before: str, after: str) -> int:
    """1: capitals within a sentence, where only proper nouns have them; -1: in German, where all nouns have."""
    if _GERMAN.search(before) or _GERMAN.search(after):
        return -1
    return 1 if re.search(r"[^\W\d_A-ZÀ-Þ] $", before) or (re.match(r" [a-zß-ÿ]{2,} [a-zß-ÿ]", after) and not re.search(r"[\w)]$", before)) else 0


def candidates(text: str | None) -> Iterator[tuple[str, int, int, str, str, dict[str, int]]]:
    """(kind, start, end, first key, last key, votes) of every candidate of a text.

    The keys are what gazetteers are looked up by: given and family name, domain of an address, and so on.
    """
    if not text:
        return
    fold = lambda w: unicodedata.normalize("NFC", w).casefold()
    for a, b, domain, v in emails(text):
        yield "email", a, b, "", domain, v
    for kind, a, b, v in numbers(text):
        yield kind, a, b, "", re.sub(r"\d", "9", text[a:b])[:6], v
    taken = []
    for a, b, v in addresses(text):
        taken.append((a, b))
        street = re.sub(r"[\d,]+", " ", text[a:b]).split()
        yield "address", a, b, street[0].casefold(), street[-1].casefold().rstrip("."), v
    taken.sort()
    reach = list(accumulate((y for _, y in taken), max))
    for a, b, given, family, v in names(text):
        k = bisect_left(taken, (b,))
        if k and reach[k - 1] > a:  # some address that begins before the name's end ends after its start
            v["trap"] = -1
        yield "name", a, b, fold(given), fold(family.rpartition(" ")[2].rpartition("-")[2]), v
