"""Problem 5: personal information inside free text.

Regular expressions propose spans; checksums (Luhn-like keys, mod 97, mod 511) confirm them; words nearby move their
score. A proposal whose score reaches ``LEAST`` is a finding. What one text cannot tell is left to the corpus: which
words are given names and which are street names is counted over all confident findings, and proposals
without context of their own are joined with these counts.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.batches import sliced
from veilspan.llm.forms import ORDINARY, applied, character_edits, look_alikes
from veilspan.llm.secrets import _parsed, leaves, redacted_json
from veilspan.sources.shared import shared_folder
from veilspan.sources.tables import table

LEAST = 0.5
_ODD = re.compile(f"[^{ORDINARY[2:-3]}]")
Proposal = tuple[str, int, int, float]

# --- names -----------------------------------------------------------------------------------------------------------
_UP, _LOW = "A-ZÀ-ÖØ-ÞŒ", "a-zß-öø-ÿœ"
_CAP = rf"[{_UP}][{_LOW}]+(?:['’][{_UP}][{_LOW}]+)?"
_WORD = rf"(?:{_CAP}(?:-(?:{_CAP}|[{_UP}]{{2,}}))*|[{_UP}]{{2,}}(?:-[{_UP}]{{2,}})*)(?![\w])"
_INITIAL = rf"[{_UP}]\.(?:-?[{_UP}]\.)*"
_PARTICLE = r"(?:(?:de la|de|du|des|van der|van den|van|von|Le|La|De|Du|Van|Von|di|da|dos|el|ben) |d['’])"
_FULL = rf"(?:{_INITIAL} ?{_PARTICLE}?{_WORD}|{_WORD} (?:{_INITIAL} )?{_PARTICLE}?{_WORD})"
_NAME = rf"(?:{_FULL}|{_WORD})"
_PIECE = rf"(?:{_INITIAL}|{_WORD})"
#: A run of capitalised words, initials and the particles between them.
_RUN = re.compile(rf"(?<![\w@./<\-+'’]){_PIECE}(?:[ ]{_PARTICLE}?{_PIECE})*")
_PIECES = re.compile(rf"({_PARTICLE})?({_PIECE})")
# Titles, relations and phrases before a name, in French, English and German.
_TITLES = frozenset("M. MM. Mme Mmes Mlle Me Dr Dr. Pr Pr. Prof Prof. Madame Monsieur Mademoiselle Maître Docteur Docteure Professeur Mr Mr. Mrs Mrs. Ms Ms. Miss Doctor Professor Sir Herr Herrn Frau".split())
_OPENERS = frozenset("Merci Thanks Dear Cher Chère Bonjour Hello Hi".split())
_BEFORE_TITLE = re.compile(r"(?:(?<![\w])(?:Mr|Dr|Pr|Mrs|Ms|Prof|St)\. |(?:le docteur|la docteure|docteur|professeur|professeure|maître|madame|monsieur|mademoiselle|doctor|professor|(?<![\w])(?:Mme|Mlle|Me|Dr|Pr|Mr|Mrs|Ms|Mᵉ)\.?)[ \n\t]{1,2})$")
_BEFORE_KIN = re.compile(r"(?<![\w])(?:(?:[MTSmts](?:on|a)|[Nn]otre|[Vv]otre|[Ll]eur|[Ll][ae]|[Mm]y|[Oo]ur|[Hh]is|[Hh]er|[Tt]heir|[Yy]our|[Tt]he) (?:\w+ )?(?:voisine?|sœur|soeur|frère|fille|fils|mère|père|oncle|tante|cousine?|nièce|neveu|collègue|amie?|petite?|copine?|neighbour|neighbor|sister|brother|daughter|son|mother|father|uncle|aunt|cousin|niece|nephew|colleague|friend)|[Ll]ittle|[Yy]oung|[Cc]ousin|[Uu]ncle|[Aa]unt) $")
_BEFORE_FULL = re.compile(r"(?:(?<![\w])(?:[Ss]ignée?(?: par)?|[Rr]apportée? par|[Rr]eported by|[Ss]igned(?: by)?|[Aa]ccording to|[Ss]elon|[Mm]erci à|[Tt]hanks to|attention d[eu]|attention of|[Aa]ttn\.?|dossier de|file of|titulaire|holder|demander|ask for|cède à|sold to|sells? to|écrit|writes|wrote|c['’]est|C['’]est|[Ii]t is|présents?|present|sieur|@author|[Ss]igned-off-by|[Rr]eviewed-by|[Cc]o-authored-by)[ :]{1,3}|(?<![\w])(?:[Cc]ontact|[Nn]om(?: complet)?|[Nn]ame|[Aa]uthor|[Aa]uteure?|[Ss]igné|[Pp]résents?|[Pp]resent) ?: ?|dossier d['’])$")
_BEFORE_ACT = re.compile(r"(?:\d ?: |\d{4}, |-\d\d, |\] )$")
_AFTER_ACT = re.compile(rf",? (?:de|of|[{_LOW}])|:")
_AFTER_HOME = re.compile(r", (?:of \d|domiciliée?|demeurant|résidant|residing|living at|née? )")
_AFTER_MAIL = re.compile(r" <[^<>\n]{1,80}(?:@|\bat\b|arobase)[^<>\n]{1,60}>")
_NOT_A_NAME = frozenset(
    "le la les un une des du de en sur sous dans par pour avec sans selon entre vers devant derrière après avant depuis malgré contre chez et ou mais donc or ni car the a an one two of in on at by for with from to and but near under over above below behind beyond around across inside outside towards during before after despite against into upon about "
    "monsieur madame mademoiselle maître docteur mme mlle mr mrs dr tous toutes all dear compagnie société ateliers manufacture fonderie établissements maison groupe cabinet cedex version release order commande acte article référence adresse numéro permis passeport carte merci bonjour contact nom signé tél objet présents compte né née born".split()
)

# --- other kinds -----------------------------------------------------------------------------------------------------
_AT_SIGN = re.compile(r" ?@ ?")
_AT_BOXED = re.compile(r" ?[\[({<] ?(?:at|arobase|AT|At|@) ?[\])}>] ?")
_AT_WORD = re.compile(r" (?:at|AT|arobase|chez) (?=[\w-]+ (?:dot|DOT|point) )")
_LOCAL = re.compile(r"(?<![\w.%+-])[\w%+-]+(?:\.[\w%+-]+)*$")
_DOT = r"(?:\.| ?[\[({] ?(?:dot|point|DOT|\.) ?[\])}] ?| (?:dot|point|DOT) )"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*{_DOT}[A-Za-z]{{2,}}")
_NUMBER_END = r"(?![\w]|[.,:/-]\d|%)"
# Country codes taken after 00, where no plus sign tells a number from other digits.
_CODES = r"(?:1|30|31|32|33|34|351|352|353|358|36|377|39|4[0135-9]|44|420|421|61|81|86|91|212|213|216)"
_PHONE_START = re.compile(r"(?:\+\d|00\d|\(?0[1-9]|\(\d{3}\)|\d{3}[ .-]\d{3}[ .-]\d{4}|1[ .-]\(?\d{3})")
_PHONES = (
    re.compile(rf"(?:(?:\+33|0033)[ .-]?(?:\(0\)[ .-]?)?|\(?0)[1-9](?:[ .-]?\d{{2}}){{4}}{_NUMBER_END}"),
    re.compile(rf"(?:(?:\+44|0044)[ -]?(?:\(0\)[ -]?)?|\(?0)7\d{{3}}\)?[ -]?\d{{3}}[ -]?\d{{3}}{_NUMBER_END}"),
    re.compile(rf"(?:(?:\+|00)?1[ .-]?)?(?:\(\d{{3}}\) ?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}{_NUMBER_END}"),
    re.compile(rf"(?:\+[1-9]\d{{0,2}}|00{_CODES})(?:[ .-]?\(0\))?(?:[ ./-]?\d{{1,5}}){{2,6}}{_NUMBER_END}"),
    re.compile(rf"\(?0[1-9]\d{{1,3}}\)? \d{{3,4}}[ -]\d{{3,4}}{_NUMBER_END}"),
)
_PHONE_WORDS = re.compile(r"(?i)t[ée]l|phone|appel|call|ring|joindre|fax|mobile|portable|numéro|ligne|☎|reach")
_REFERENCE_WORDS = re.compile(r"(?i)(?:commande|order|référence|reference|dossier|relevé|facture|invoice|version|release|n°|ref|IP)[ :]*$")
_LABEL = re.compile(
    r"(?i:s[ée]curit[ée] sociale|de s[ée]cu(?![\w])|(?<!\w)NIR(?!\w)|fiscale?(?!\w)|(?<!\w)SPI(?!\w)|imp[ôo]ts?(?!\w)|tax (?:number|id|reference)|(?<!\w)(?:NIF|TIN|UTR|INSEE)(?!\w)|passe?port(?:nummer)?|reisepass\w*|identit[ée](?!\w)|(?<!\w)CNI(?!\w)|(?:identity|id) card|personalausweis\w*|permis(?: de conduire)?(?!\w)|driv(?:ing|er'?s?) licen[cs]e|führerschein\w*|(?<!\w)SSN(?!\w)|social security|national insurance|(?<!\w)NINO(?!\w)|steuer-?(?:id|nummer)\w*)"
    r"(?i:[ \t]?(?:number|num[ée]ro|nummer))?[ \t]?(?i:n°|nº|no\.?|num\.?|#)?[ \t]?[:=#]?[ \t]?(?i:n°|nº)?[ \t]?\"?"
)
_ID = re.compile(r"(?<!\w)[A-Z]{0,3}\d[A-Z0-9]*(?:[ .-](?=[A-Z0-9]*\d)[A-Z0-9]+(?![a-zà-ÿ]))*(?!\w)|(?<!\w)[A-Z][A-Z0-9]*\d[A-Z0-9]*(?!\w)")
_NIR = re.compile(r"[12][ .]?\d{2}[ .]?\d{2}[ .]?(?:\d{2}|2[AB])[ .]?\d{3}[ .]?\d{3}[ .-]?\d{2}(?!\w)")

_STREETS = r"(?:rue|avenue|av\.|boulevard|bd|bld|allées?|chemin|route|impasse|place|quai|passage|cours|square|voie|sentier|ruelle|villa|cité|faubourg|esplanade|promenade|rond-point|lotissement|résidence|hameau|montée|venelle|traverse|côte)"
_LINK = r"(?:(?:de la|de l['’]|de|du|des|d['’]|la|le|les|l['’]|à la|au|aux) ?)"
_STREET_NAME = rf"(?:{_LINK}{{0,2}}(?:{_CAP}(?:-[\w]+)*|\d{{1,2}}(?=[ -][{_LOW}{_UP}]))(?:[ -](?:{_LINK}{{0,2}})?{_CAP}(?:-[\w]+)*){{0,3}})"
_TOWN = rf"(?:(?:Le|La|Les|Saint|Sainte|St|Ste) )?{_CAP}(?:[-'’][\w]+)*(?: CEDEX(?: \d{{1,2}})?)?"
_FR_ADDRESS = re.compile(rf"\d{{1,4}}+(?=[ ,A-D]) ?(?:(?:bis|ter|quater|[A-D])(?!\w))?,? ?(?i:{_STREETS}) (?P<name>{_STREET_NAME})(?P<town>(?:,? ?\n|, | - | – |,? )(?:\d{{5}}|[A-Z]-?\d{{4,5}}) {_TOWN})?")
_EN_STREETS = r"(?:Street|St\.?|Road|Rd\.?|Lane|Avenue|Ave\.?|Close|Way|Drive|Court|Place|Square|Terrace|Gardens|Crescent|Hill|Row|Walk|Mews|Grove|Park|Green|Yard|Boulevard|Parade|Quay|Wharf|View|Rise)"
_POSTCODE = r"(?:[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}|\d{5}(?:-\d{4})?)"
_EN_ADDRESS = re.compile(rf"\d{{1,4}}+[A-Da-d]?,? (?:{_CAP}(?:-{_CAP})? ){{1,3}}{_EN_STREETS}(?!\w)(?:(?:, |,?\n| - ){_CAP}(?:[- ](?:{_CAP}|on|upon|under))*)?(?:(?:, |,?\n| ){_POSTCODE}(?: {_CAP})?)?")
_DE_ADDRESS = re.compile(rf"(?<!\w){_CAP}(?:straße|strasse|weg|platz|allee|gasse) \d{{1,4}}[a-d]?(?!\w)(?:(?:, |,?\n)\d{{5}} {_CAP})?")
_GERMAN = ("straße", "strasse", "weg ", "platz ", "allee ", "gasse ")
# Literal words that every label holds, in lower case and, for short ones, as they are written.
_LABEL_WORDS = tuple("curité sociale|curite sociale|de sécu|de secu|fiscal|impôt|impot|tax number|tax id|tax ref|passeport|passport|reisepass|identit|identity card|id card|personalausweis|permis|licence|license|führerschein|social security|national insurance|steuer".split("|"))
_LABEL_SIGNS = ("NIR", "SPI", "NIF", "TIN", "UTR", "INSEE", "CNI", "SSN", "NINO")
_LABEL_START = {"curité sociale": 2, "curite sociale": 2}


def nir_valid(value: str) -> bool:
    """French social security number: its key is 97 minus the body modulo 97 (2A counts as 19, 2B as 18)."""
    v = re.sub(r"[ .-]", "", value)
    if not re.fullmatch(r"[1-478]\d{4}(?:\d{2}|2[AB])\d{8}", v):
        return False
    return 97 - int(v[:13].replace("2A", "19").replace("2B", "18")) % 97 == int(v[13:])


def tax_valid(value: str) -> bool:
    """French tax number: the last three of 13 digits are the first ten modulo 511."""
    v = re.sub(r"[ .-]", "", value)
    return len(v) == 13 and v.isdigit() and int(v[:10]) % 511 == int(v[10:])


def emails(text: str) -> Iterator[Proposal]:
    rules = [_AT_SIGN] if "@" in text else []
    if "at" in text and any(x in text for x in ("(at", "[at", "{at", "<at", "( at", "[ at", "(AT", "[AT")) or "arobase" in text:
        rules.append(_AT_BOXED)
    if " dot " in text or " DOT " in text or " point " in text:
        rules.append(_AT_WORD)
    for rule in rules:
        for m in rule.finditer(text):
            at, end = m.span()
            left = _LOCAL.search(text, max(0, at - 70), at)
            right = _DOMAIN.match(text, end)
            if not left or not right:
                continue
            s, e = left.start(), right.end()
            run = re.search(r"\S*$", text[max(0, s - 120) : s]).group()
            address = "://" in run or run.endswith("/") or re.search(r":[^:\s]*:$", run) and "mailto:" not in run
            path = re.match(r":[\w/~]", text[e : e + 2]) and m.group() == "@" and not text[e + 1 : e + 2].isdigit()
            yield "email", s, e, 0.0 if address or path or left.group().lower() in ("git", "hg", "svn") else 0.9


def phones(text: str) -> Iterator[Proposal]:
    done = 0
    for start in _PHONE_START.finditer(text):
        s = start.start()
        if s < done or s and (text[s - 1].isalnum() or text[s - 1] in "_+./,:-"):
            if s < done or not (s > 1 and text[s - 1] in ".,:" and text[s - 2] in "lL:"):
                continue
        for i, rule in enumerate(_PHONES):
            m = rule.match(text, s)
            if not m or not 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                continue
            before = text[max(0, s - 24) : s]
            score = 0.6 if i < 4 else 0.3
            score += 0.3 * bool(_PHONE_WORDS.search(before)) - 0.4 * bool(_REFERENCE_WORDS.search(before))
            done = m.end()
            yield "phone", s, m.end(), score
            break


def _labels(text: str) -> Iterator[int]:
    """Where labels of identity numbers may start."""
    low = text.lower()
    for words, among in ((_LABEL_WORDS, low), (_LABEL_SIGNS, text)):
        for word in words:
            at = among.find(word)
            while at >= 0:
                yield at - _LABEL_START.get(word, 0)
                at = among.find(word, at + 1)


def id_numbers(text: str) -> Iterator[Proposal]:
    for at in _labels(text):
        m = _LABEL.match(text, at)
        v = _ID.match(text, m.end()) if m else None
        if v:
            value = re.sub(r"[ .-]", "", v.group())
            digits = sum(c.isdigit() for c in value)
            if 7 <= len(value) <= 18 and (digits >= 2 or len(value) in (9, 12)):
                yield "id_number", v.start(), v.end(), 0.7 + 0.2 * (nir_valid(value) or tax_valid(value))
    for m in _NIR.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_.")):
            yield "id_number", m.start(), m.end(), 0.2 + 0.4 * nir_valid(m.group())


Loose = tuple[str, list[tuple[str, int, int]]]  # kind and, best first, (key to look up, start, end)


def addresses(text: str) -> tuple[list[Proposal], list[Loose], list[str]]:
    """Proposals; those whose street name has no clear end, with its possible ends; street names with a clear end."""
    sure: list[Proposal] = []
    loose: list[Loose] = []
    streets: list[str] = []
    for m in _FR_ADDRESS.finditer(text):
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_/.,-"):
            continue
        name, at = m.group("name"), m.start("name")
        if m.group("town") or re.match(r"[,.;:)\n]|$| - | et | qui |[ ]?[!?]", text[m.end() : m.end() + 5]) or " " not in name.strip():
            sure.append(("postal_address", m.start(), m.end(), 0.8))
            streets.append(name)
        else:
            words = [w.end() for w in re.finditer(r"\S+", name)]
            ends = [e for e in reversed(words) if re.search(rf"[{_UP}]\S*$", name[:e])]
            loose.append(("postal_address", [(f"street {name[:e].lower()}", m.start(), at + e) for e in ends]))
    for m in _EN_ADDRESS.finditer(text):
        if not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_/.,-")):
            sure.append(("postal_address", m.start(), m.end(), 0.8))
    if any(x in text for x in _GERMAN):
        sure += [("postal_address", m.start(), m.end(), 0.8) for m in _DE_ADDRESS.finditer(text)]
    return sure, loose, streets


_HEADER = re.compile(r"(?im)^[^\n]*?(?:\||\t|;|,|^)[ ]*(?:full[ _]?name|name|nom(?:[ _]complet)?|titulaire|client|holder|contact|prénom nom|customer|owner|kunde)[ ]*(?:\||\t|;|,)[^\n]*$")
_NAME_COLUMNS = frozenset("full name,fullname,full_name,name,nom,nom complet,nom_complet,titulaire,client,holder,contact,prénom nom,customer,owner,kunde".split(","))
_CELL = re.compile(_NAME)


def _table_names(text: str) -> Iterator[tuple[int, int]]:
    """Cells of the name column of tables written into the text."""
    for header in _HEADER.finditer(text):
        for mark in ("|", "\t", ";", ","):
            cells = [c.strip().lower() for c in header.group().split(mark)]
            column = next((i for i, c in enumerate(cells) if c in _NAME_COLUMNS), -1)
            if column >= 0 and len(cells) >= 3 and all(len(c) <= 30 for c in cells):
                break
        else:
            continue
        at = header.end() + 1
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            row = text[at:end].split(mark)
            if len(row) != len(cells):
                break
            cell = row[column]
            if _CELL.fullmatch(cell.strip()):
                s = at + sum(len(c) + 1 for c in row[:column]) + len(cell) - len(cell.lstrip())
                yield s, s + len(cell.strip())
            at = end + 1


def _split(words: list[tuple[str, int, int, int]]) -> int:
    """How many of the words make one name: two, or three with an initial between them; else one."""
    if len(words) == 1:
        return 1
    return 3 if len(words) > 2 and words[1][0].endswith(".") and not words[0][0].endswith(".") else 2


def names(text: str) -> tuple[list[Proposal], list[Loose], list[tuple[str, int]]]:
    """Proposals; runs of capitalised words that the corpus must judge; (word, 1 if given else 2) of full names."""
    cells = set(_table_names(text))
    sure: list[Proposal] = [("person_name", s, e, 0.9) for s, e in cells]
    loose: list[Loose] = []
    full: list[tuple[int, int]] = [x for x in cells if " " in text[slice(*x)]]
    held = Taken(cells)
    for run in _RUN.finditer(text):
        s0, e0 = run.span()
        if " " not in run.group() and run.group().lower() in _NOT_A_NAME:
            continue
        if held.inside(s0, e0):
            continue
        # word, its start, its end, the start of the particle before it
        words = [(m.group(2), m.start(2) + s0, m.end() + s0, m.start() + s0) for m in _PIECES.finditer(run.group())]
        at, score, title = 0, 0.0, False
        before = text[max(0, s0 - 40) : s0]
        while at < len(words):
            w = words[at][0]
            if w in _TITLES and not (w == "M." and _initial(text, words, at, before)):
                score, title = 0.9, True
            elif w in _OPENERS:
                score = max(score, 0.8)
            elif w.lower() in _NOT_A_NAME or w.endswith(".") and at + 1 == len(words):
                score, title = 0.0, False
            else:
                n = _split(words[at:])
                s, e = words[at][1], words[at + n - 1][2]
                if at == 0:
                    if _BEFORE_TITLE.search(before):
                        score, title = 0.9, True
                    elif n > 1 and (_BEFORE_FULL.search(before) or _BEFORE_ACT.search(before) and _AFTER_ACT.match(text, e)):
                        score = 0.8
                    elif _BEFORE_KIN.search(before):
                        score = 0.4
                if n > 1 and w.endswith(".") and not score:
                    score = 0.6  # an initial and a family name
                if n > 1 and words[at + n - 1][0].lower() in _NOT_A_NAME:
                    n, e = 1, words[at][2]
                    score = score if title else 0.0
                if score >= LEAST and (n > 1 or title):
                    sure.append(("person_name", s, e, score))
                    if n == 2 and not w.endswith("."):
                        full.append((s, e))
                    at += n - 1
                else:
                    block = 1
                    while at + block < len(words) and not _ends_block(words[at + block][0]):
                        block += 1
                    plain = words[at : at + block]
                    if block > 1 and (_AFTER_HOME.match(text, plain[-1][2]) or _AFTER_MAIL.match(text, plain[-1][2])):
                        sure.append(("person_name", plain[-2][1], plain[-1][2], 0.8))
                        full.append((plain[-2][1], plain[-1][2]))
                        plain = plain[:-2]
                    loose += _loose_names(plain)
                    at += block - 1
                score, title = 0.0, False
            at += 1
    evidence: list[tuple[str, int]] = []
    for s, e in full:
        words_ = [w for w in text[s:e].split(" ") if w[:1].isupper()]
        if len(words_) == 2 and "." not in text[s:e]:
            given, family = (words_[1], words_[0]) if words_[0].isupper() and not words_[1].isupper() else (words_[0], words_[1])
            evidence += [(given.split("-")[0].lower(), 1), (family.split("-")[0].lower(), 2)]
    return sure, loose, evidence


def _ends_block(word: str) -> bool:
    return word in _TITLES or word in _OPENERS or word.endswith(".") or word.lower() in _NOT_A_NAME


def _initial(text: str, words: list[tuple[str, int, int, int]], at: int, before: str) -> bool:
    """Whether ``M.`` is a given name's initial: one word follows it, in a place where a full name stands."""
    follows = len(words) - at - 1
    if follows < 1 or follows > 1 and not _ends_block(words[at + 2][0]):
        return False
    if at:
        return words[at - 1][0] in _OPENERS or words[at - 1][0] in _TITLES
    return bool(_BEFORE_FULL.search(before) or _BEFORE_ACT.search(before) or _AFTER_HOME.match(text, words[at + 1][2]))


def _loose_names(words: list[tuple[str, int, int, int]]) -> list[Loose]:
    """The readings of a run of capitalised words without context, best first: two words, in either order, then one."""
    pairs: list[tuple[str, int, int]] = []
    singles: list[tuple[str, int, int]] = []

    def key(w: str) -> str:
        return f"given {w.split('-')[0].lower()}"

    for first, second in zip(words, words[1:], strict=False):
        if first[0].isupper() and not second[0].isupper():
            pairs.append((key(second[0]), first[1], second[2]))
        pairs.append((key(first[0]), first[1], second[2]))
    for w, s, e, _ in words:
        if len(w) > 2:
            singles.append((key(w), s, e))
    return [("person_name", pairs + singles)] if singles else []


class Taken:
    """Spans that do not overlap, asked by bisection: texts may hold very many."""

    def __init__(self, spans: Iterable[tuple[int, int]] = ()) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, e in sorted(spans):
            self.add(s, e)

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return (i == 0 or self.ends[i - 1] <= start) and (i == len(self.starts) or end <= self.starts[i])

    def inside(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.starts, start)
        return i > 0 and end <= self.ends[i - 1]

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def settled(found: list[Proposal]) -> list[Proposal]:
    """Findings without overlaps: of overlapping ones the better score stays, then the longer, then the earlier."""
    out: list[Proposal] = []
    taken = Taken()
    for p in sorted((p for p in found if p[3] >= LEAST), key=lambda p: (-p[3], p[1] - p[2], p[1])):
        if taken.free(p[1], p[2]):
            taken.add(p[1], p[2])
            out.append(p)
    return sorted(out, key=lambda p: p[1])


def original(offset: int, edits: list[tuple[int, int, str]], end: bool) -> int:
    """Where an offset of the repaired text lies in the text as it is stored."""
    shift = 0
    for s, e, new in edits:
        at = s + shift
        if offset <= at and not (offset == at and not new and not end):
            break
        if offset < at + len(new):
            return e if end else s
        shift += len(new) - (e - s)
    return offset - shift


class Found:
    """What one text holds: settled findings, loose runs and evidence about words, all in stored offsets."""

    def __init__(self, text: str) -> None:
        edits = character_edits(text) if _ODD.search(text) else []
        plain = applied(text, edits) if edits else text
        if _ODD.search(plain):
            plain = applied(plain, [(s, e, w) for s, e, w, k in look_alikes(plain) if k == "latin"])
        sure_addresses, loose_addresses, self.streets = addresses(plain)
        sure_names, loose_names, self.words = names(plain)
        found = [*emails(plain), *phones(plain), *id_numbers(plain), *sure_addresses]
        taken = settled(found)
        self.sure = settled([*((k, s, e, v + 1) for k, s, e, v in taken), *sure_names])
        free = Taken((s, e) for _, s, e, _ in self.sure).free
        self.loose = [(k, [x for x in options if k == "postal_address" or free(x[1], x[2])]) for k, options in [*loose_addresses, *loose_names]]
        self.loose = [x for x in self.loose if x[1]]
        if edits:
            back = lambda s, e: (original(s, edits, False), original(e, edits, True))
            self.sure = [(k, *back(s, e), v) for k, s, e, v in self.sure]
            self.loose = [(k, [(key, *back(s, e)) for key, s, e in options]) for k, options in self.loose]


ROWS = "table_name string, record_key string, version long, leaf int, place int, rank int, kind string, found_value string, start int, end int, key string, weight int"
SALTS = 16  # copies of the confirmed words, so that the places of one frequent name are spread over so many tasks


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[t]) for n, t in (c.split(" ") for c in ROWS.split(", "))])
    for batch in sliced(batches):
        out: list[tuple] = []
        for name, key, text, is_json, version in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            place = 0
            for number, leaf in enumerate(leaves(_parsed(text)) if is_json else [text or ""]):
                if len(leaf) < 5:
                    continue
                f, at = Found(leaf), (name, key, version, number)
                out += [(*at, None, None, k, leaf[s:e], s, e, None, None) for k, s, e, _ in f.sure]
                for kind, options in f.loose:
                    place += 1
                    out += [(*at, place, i, kind, leaf[s:e], s, e, w, None) for i, (w, s, e) in enumerate(options)]
                nowhere = (None,) * 6
                out += [(*nowhere, "evidence", None, None, None, f"given {w}", role) for w, role in f.words]
                out += [(*nowhere, "evidence", None, None, None, f"street {w.lower()}", 1) for w in f.streets]
        columns = zip(*out, strict=True) if out else [[]] * len(schema)
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def personal_spans(texts: DataFrame) -> DataFrame:
    """``table_name``, ``record_key``, ``version`` (a hash of the text), ``leaf`` (number of the string leaf), ``kind``,
    ``found_value``, ``start``, ``end`` of the personal data in texts, as ``personal_data`` takes them."""
    shared_folder(texts.sparkSession)
    rows = texts.select("table_name", "record_key", "text", "is_json", F.xxhash64("text").alias("version")).mapInArrow(_found, ROWS).checkpoint()
    given = F.sum(F.when(F.col("weight") == 1, 1).otherwise(0))
    known = rows.where("kind = 'evidence'").groupBy("key").agg(given.alias("yes"), F.count("*").alias("all")).where("yes >= 2 and yes >= 0.75 * all")
    known = known.select("key", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    where = ["table_name", "record_key", "version", "leaf", "kind"]
    found = rows.where("kind <> 'evidence'")
    sure = found.where("key is null").select(*where, "found_value", "start", "end")
    loose = found.where("key is not null").withColumn("salt", F.pmod(F.xxhash64("record_key", "version", "place"), F.lit(SALTS)).cast("int")).join(known, ["key", "salt"])
    best = loose.groupBy(*where, "place").agg(F.min_by(F.struct("found_value", "start", "end"), "rank").alias("b"))
    return sure.unionByName(best.select(*where, "b.*"))


def personal_data(texts: DataFrame) -> DataFrame:
    """``table_name``, ``record_key``, ``kind``, ``found_value`` of the personal data in texts, each once per record.

    ``texts``: ``table_name``, ``record_key``, ``text`` and ``is_json`` (the text is JSON, whose string leaves are
    read; broken JSON holds nothing). Null and empty texts hold nothing, very long ones are read whole; of overlapping
    proposals with equal scores the longer, then the earlier one stays; null keys are kept. Repeated rows add nothing.
    An empty table gives no rows. Other columns are ignored. Annotations are not read.
    """
    return personal_spans(texts).select("table_name", "record_key", "kind", "found_value").distinct()


PLACEHOLDERS = {"person_name": "⟦PERSON⟧", "email": "⟦EMAIL⟧", "phone": "⟦PHONE⟧", "id_number": "⟦ID⟧", "postal_address": "⟦ADDRESS⟧"}


Marks = dict[int, list[tuple[int, int, str]]]  # of each leaf: start, end and kind of its findings


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with each span replaced by the placeholder of its kind; all else stays."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[kind]]
            at = end
    return "".join(out) + text[at:]


def masked_json(raw: str, marks: Marks) -> str:
    """JSON with the spans of its string leaves, which are numbered in order, replaced; all else stays as it is written."""
    number = itertools.count()
    now: dict[tuple[int, int], str] = {}

    def spans(_: str) -> list[tuple[int, int]]:
        now.clear()
        at = 0
        for start, end, kind in sorted(marks.get(next(number), ()), key=lambda x: (x[0], -x[1])):
            if start >= at:
                now[start, end] = kind
                at = end
        return list(now)

    # the replacements of a leaf are asked in the order of its spans
    return redacted_json(raw, spans, lambda _: PLACEHOLDERS[now.pop(next(iter(now)))])


def _texts(spark: SparkSession, directory: str, empty: bool = False) -> DataFrame:
    quality = table(spark, directory, "quality", "id", "text").select(F.lit("quality").alias("table_name"), F.col("id").alias("record_key"), "text", F.lit(False).alias("is_json"))
    events = table(spark, directory, "tool_events", "event_id", "tool_response")
    events = events if empty else events.where("tool_response is not null")
    events = events.select(F.lit("tool_events").alias("table_name"), F.col("event_id").cast("string").alias("record_key"), F.col("tool_response").alias("text"), F.lit(True).alias("is_json"))
    return quality.unionByName(events)


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Personal data of quality and of tool responses."""
    return personal_data(_texts(spark, directory))


def p5_masked(spark: SparkSession, directory: str) -> DataFrame:
    """``table_name``, ``id`` and ``text`` of every quality record and tool response, its personal data replaced by typed placeholders."""
    texts = _texts(spark, directory, empty=True)
    where = ["table_name", "record_key", "version"]
    spans = personal_spans(texts).groupBy(*where).agg(F.collect_set(F.struct("leaf", "start", "end", "kind")).alias("found")).alias("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for text, is_json, found in zip(*(batch.column(n).to_pylist() for n in ("text", "is_json", "found")), strict=True):
                marks: Marks = {}
                for x in found or ():
                    marks.setdefault(x["leaf"], []).append((x["start"], x["end"], x["kind"]))
                out.append(text if not marks else masked_json(text, marks) if is_json else masked(text, marks.get(0, [])))
            yield pa.record_batch([batch.column("table_name"), batch.column("record_key"), pa.array(out, pa.string())], names=["table_name", "id", "text"])

    # of a record that comes several times, the first text in order
    rows = texts.groupBy("table_name", "record_key", "is_json").agg(F.min("text").alias("text")).withColumn("version", F.xxhash64("text")).alias("r")
    same = (F.col("r.table_name") == F.col("p.table_name")) & F.col("r.record_key").eqNullSafe(F.col("p.record_key")) & (F.col("r.version") == F.col("p.version"))
    return rows.join(spans, same, "left").select("r.*", "p.found").mapInArrow(run, "table_name string, id string, text string")


QUERIES = {"p5_found": p5_found, "p5_masked": p5_masked}
