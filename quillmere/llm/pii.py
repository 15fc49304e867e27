"""Personal information in free text: found by weak supervision, replaced by typed placeholders.

Candidate spans of five types are proposed by wide patterns. Labelers (patterns, gazetteers learned from the corpus,
context words) vote +1, 0 or -1 on each. Expectation-maximisation over the counts of distinct vote patterns estimates,
for each type, the share of true spans and how every labeler votes on true and false ones; the resulting soft labels
train a logistic classifier per type on votes and shape features. That classifier decides on spans.

Labelers are general: number plans, formats, dates, book numbers, kinds of words in the clause around a span, casing, and
names learned. Candidates are wide on purpose (any two capitalised words may be a name, any six digits a phone number), so
that most of them are false and the labelers have something to settle.

The texts are read twice, for the gazetteers and for the candidates; those with candidates are kept. Corpus-wide work is
one grouping by (type, features), which combines on the map side; the number of patterns is bounded by the number of
labelers and features, not by the corpus. The gazetteers hold every name learned: up to ``HELD_NAMES``
of them go to the tasks whole, more stay a table, of which each text gets the names among its own words by a join.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmere.session import keep, skew_safe_lookup

TYPES = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")
_GAP = r"[   ​\t]"
_STREET = r"(?:lane|street|row|road|avenue|crescent|terrace|drive|close|walk|place|square|court|way|hill|mews|gardens|boulevard|alley|st|rd|ave|dr|blvd|ln|ct)"

PATTERNS: dict[str, list[str]] = {
    "EMAIL": [
        r"(?:(?<![a-z0-9])|(?<=[a-z])(?=[0-9]))[a-z0-9][a-z0-9._%+\-]*+@[a-z0-9][a-z0-9\-]*(?:\.[a-z0-9\-]+)*\.[a-z]{2,}",
        rf"[a-z0-9][a-z0-9._%+\-]*{_GAP}*[\[({{]{_GAP}*at{_GAP}*[\])}}]{_GAP}*[a-z0-9\-]+(?:{_GAP}*(?:[\[({{]{_GAP}*(?:dot|\.){_GAP}*[\])}}]|{_GAP}dot{_GAP}|\.){_GAP}*[a-z0-9\-]+)+",
        rf"[a-z0-9][a-z0-9._%+\-]*{_GAP}+at{_GAP}+[a-z0-9\-]+(?:{_GAP}+dot{_GAP}+[a-z0-9\-]+)+",
    ],
    "PHONE": [
        rf"(?<![\w.,/\-+])(?:\+|00)?\(?\d{{1,4}}\)?(?:(?:[.\-/]|{_GAP})?\(?\d{{1,5}}\)?){{1,6}}(?![\w/])(?!-\w)(?!\.\d)",
    ],
    "ID_NUMBER": [
        r"(?<![\w\-])[A-Z]{2}[  ]?\d{2}[  ]?\d{2}[  ]?\d{2}[  ]?[A-Z](?!\w)",
        r"(?<![\w\-])\d{6}[\-+]\d{3}[0-9A-Z](?!\w)",
        r"(?<![\w\-])[A-Z]{1,2}\d{6,9}(?!\w)",
        r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
        r"(?<![\w\-+.])\d{3}[  ]\d{3}[  ]\d{3}(?![  ]?\w*\d)",
        r"(?<![\w\-+.])\d{9,12}(?!\w)",
    ],
    "ADDRESS": [
        rf"(?:(?:flat|apt|apartment|unit){_GAP}+\d+[a-z]?,{_GAP}*)?(?<![\w.,])\d{{1,5}}[a-z]?{_GAP}+[\w'’\-]+{_GAP}+(?:[\w'’\-]+{_GAP}+)?{_STREET}\b(?:,?{_GAP}+(?:apt|flat|unit)\.?{_GAP}+\d+[a-z]?)?",
        rf"(?<![\w'’\-])[\w'’\-]++{_GAP}+{_STREET}\b\.?,?{_GAP}+(?:no\.?|nr\.?|number|№){_GAP}*\d{{1,5}}[a-z]?",
        rf"(?<![\w.,])\d{{1,5}}(?:{_GAP}?(?:bis|ter))?,?{_GAP}+(?:rue|avenue|boulevard|chemin|impasse|allée|quai|place){_GAP}+(?:(?:de|du|des|la|le|les|l['’])[  ]*)*[\w'’\-]+",
        rf"(?<![\w\-])[\w\-]+(?:stra(?:ss|ß)e|str\.|weg|allee|gasse|platz|ufer){_GAP}+\d{{1,5}}[a-z]?\b(?:,{_GAP}*\d{{4,5}}{_GAP}+[\w\-]+)?",
        rf"(?:calle|via|rua|avenida|plaza){_GAP}+(?:de(?:l|{_GAP}la)?{_GAP}+)?[\w'’\-]+,?{_GAP}+(?:n[.º°]?{_GAP}*)?\d{{1,5}}\b",
    ],
}
_COMPILED = {t: [re.compile(p, re.I if t in ("EMAIL", "ADDRESS") else 0) for p in ps] for t, ps in PATTERNS.items()}
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\.?", re.U)
_NAME_GAP = re.compile(r"[   ​]{1,3}\Z")

# Context: words of a kind, wherever they come from. A cue counts in the clause before the span or right behind it.
_CLAUSE = r"[^.!?;\n]{0,45}$"
_PHONE_BEFORE = re.compile(r"(?i)\b(?:call(?:ed|ing)?|ring|rang|phone|telephone|tel|mobile|cell|landline|whatsapp|signal|fax|sms|text|dial|hotline|helpline|voicemail|reach|number|contact)\b(?:\.(?!\s*[A-Z]\w))?" + _CLAUSE)
_ID_BEFORE = re.compile(r"(?i)\b(?:identity|identification|id|ids|passport|tax|taxpayer|social|security|insurance|insured|national|citizen|resident|licen[cs]e|driver'?s?|pension|ssn|nino|sin|vat|nif|dni|personal number|card)\b(?:\.(?!\s*[A-Z]\w))?" + _CLAUSE)
_ID_AFTER = re.compile(r"(?i)^[^.!?;\n]{0,24}\b(?:forms?|desk|office|counter|clerk|officer|official|letters?|documents?|papers?|certificate|application|card|passport|licen[cs]e|register|border|authorit(?:y|ies))\b")
_OTHER_NUMBER = re.compile(
    r"(?i)(?:\b(?:isbn|issn|doi|order|invoice|receipt|booking|reservation|ticket|tracking|parcel|shipment|item|product|part|serial|model|version|edition|release|build|score|result|coordinates?|latitude|longitude|room|gate|seat|bus|train|flight|"
    r"line|platform|page|chapter|recipe|lot|paid|price|costs?|worth|bib|race|shirt|locker|ref(?:erence)? (?:of|for)|sun(?:set|rise)|born|since|dated?)\b[^.!?;\n]{0,14}|[£$€#]\s*)$"
)
_OTHER_AFTER = re.compile(r"(?i)^\s*(?:g|kg|km|mi|mm|cm|ml|eggs|degrees|people|steps|pages|words|points|votes|miles|met(?:er|re)s|euros?|dollars?|pounds?|pence|percent|has|have|shipped|arrived)\b|^\s*[%°]")
_MAIL_BEFORE = re.compile(r"(?i)\b(?:e-?mails?|mail(?:ed|ing)?|write|writing|wrote|rsvp|contact|address|reach|reply|replies|send|sent|message|inbox|ask|via|cc|to)\b" + _CLAUSE)
_PLACE_BEFORE = re.compile(r"(?i)\b(?:address|deliver(?:y|ed)?|send|sent|ship|post|parcels?|letters?|lives?|lived|living|moved?|home|house|flat|office|shop|party|sale|collect|pick(?: it)? up|meet|visit|come|drop|took|drove|walk(?:ed)? to|find (?:us|me)|at|to|from|near|in)\b[^.!?;\n\d]{0,12}$")
_NOT_HOUSE = re.compile(r"(?i)^\W*\d+\w?\s+(?:\w+\s+)?(?:minutes?|mins?|hours?|days?|weeks?|months?|years?|miles?|met(?:re|er)s?|feet|steps?|times?|people|of|in|on|at|the|and|or|to|by|with|for|an?|from|more|long|per)\b")
_TRANSPORT = re.compile(r"(?i)\b(?:bus|line|route|train|tram|number|no\.?|coach)\W*$")
_NAME_BEFORE = re.compile(r"(?:\b(?i:by|with|to|of|and|from|for|dear|hi|hello|thanks|met|meet|saw|ask|told|named|called|friend|aunt|uncle|cousin|doctor|captain|sir|madam)|[.!?:]|\b(?:Dr|Mr|Mrs|Ms|Prof|St|Rev)\.?)[\s,:]*$")
_NAME_AFTER = re.compile(r"^(?:['’]s\b)?[\s​]*(?:(?:is|was|has|had|will|would|and|who|said|says|with|for|from|to|in|on|at|the|today|again|then|[a-z]+ed|[a-z]+s|[a-z]+ly)\b|[.,?!;:)]|$)")
_PLACE_NAME_BEFORE = re.compile(r"(?i)\b(?:at|in|near|over|around|through|across|outside|behind|towards?|the)\s*$")
#: Common nouns of places and bodies: what ends with one, or goes on with one, is seldom a person.
_NOT_PERSON = frozenset(
    "abbey academy agency alley airport association avenue bakery band bank bar bay beach books boulevard bridge brewery brewing brook cafe café castle centre center chapel choir church circle city close "
    "club coast college common company cooperative corner council county court crescent cross cycling department drive estate farm ferry field fields ford forest foundation garden gardens gate green grove hall "
    "harbor harbour hardware heath heights hill hills hollow hospital hotel house inn institute island junction kitchen lake landing lane library market marsh meadow mews mill moor mountain museum office orchestra "
    "park path pharmacy pier place plaza point pond pool port pottery pub quay railway ranch reach rescue restaurant ridge river road rock row salon sands school sea shop shore society spring square station "
    "store street studio team terrace theater theatre tower town trail union university vale valley view village walk water way wharf wood woods works yard".split()
)
_FUNCTION = frozenset(
    "a an and are as at be been but by can could did do does for from had has have he her his how i if in is it its just my no not of on or our she so some that the their them then there these they this "
    "those to too up was we were what when where which who why will with without would you your after before between during every everyone everybody nobody someone anyone has half one two three four five six "
    "seven eight nine ten first last next new old today tomorrow yesterday photo photos post video update diary memo dear hello thanks monday tuesday wednesday thursday friday saturday sunday".split()
)
_TOP_LEVEL = re.compile(r"(?i)\b(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|app|dev|online|site|shop|mail|email|example|test|invalid|localhost)$")
_PHONE_FORM = re.compile(
    r"(?:\+|00)[1-9]\d{0,2}[\s ().\-/]{0,2}(?:\(0\))?[\d\s ().\-/]{6,}"  # international
    r"|(?:1[\-. ])?\(?[2-9]\d{2}\)?[\-.  ]?[2-9]\d{2}[\-. ]?\d{4}"  # area code and seven digits
    r"|[2-9]\d{2}[\-.  ]\d{4}"  # seven digits
    r"|\(?0[1-9]\d{0,4}\)?[  .\-/]\d[\d  .\-/]{4,}"  # trunk zero and area code
    r"|0[1-9](?:[  .\-]?\d\d){4}"  # trunk zero and pairs
    r"|001[.\- ]\d{3}[.\- ]\d{3}[.\- ]\d{4}"
)
_DATED = re.compile(r"(?:19|20)\d\d([-./])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-./])(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d")
_BOOK = re.compile(r"(?:97[89]|\d)[\- ](?:\d+[\- ]){2,3}[\dX]")


@dataclass(frozen=True)
class Gazetteer:
    """Given and family names, in lower case."""

    given: frozenset[str]
    family: frozenset[str]


#: Names that are gathered; beyond, they stay a table.
HELD_NAMES = 200_000


@dataclass(frozen=True)
class NameTable:
    """Names as a table: name, is_given (a name that is both has two rows)."""

    names: DataFrame


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    features: tuple[int, ...]


def _sign(condition: bool) -> int:
    return 1 if condition else 0


def _around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - 60) : start], text[end : end + 30]


def _trimmed(kind: str, text: str, start: int, end: int) -> tuple[int, int]:
    """A phone number without brackets around the whole, and without a number that counts what follows it."""
    if kind != "PHONE":
        return start, end
    counted = re.match(r"\s(?:people|eggs|g|kg|km|degrees|and|or|more)\b", text[end : end + 9])
    shorter = re.search(r"\s\d{1,3}$", text[start:end])
    if counted and shorter:
        end = start + shorter.start()
    value = text[start:end]
    if text[start] == "(" and (value.count("(") > value.count(")") or value.find(")") == len(value) - 1):
        start += 1
    if text[end - 1] == ")" and text[start:end].count(")") > text[start:end].count("("):
        end -= 1
    return start, end


def _name_spans(text: str, names: Gazetteer, lower_known: bool) -> Iterator[Span]:
    """Pairs that may be a name: a known given name or an initial with what follows, and any two capitalised words.

    ``lower_known``: whether the text may hold a known given name, in whatever case.
    """
    words = list(_WORD.finditer(text))
    spans = [m.span() for m in words]

    def is_initial(w: str) -> bool:
        return len(w) == 2 and w[1] == "." and w[0].isupper()

    i, n = 0, len(words)
    while i < n - 1:
        start, end = spans[i]
        capital = text[start].isupper()
        if not capital and not lower_known:
            i += 1
            continue
        first = text[start:end]
        known = first.rstrip(".").lower() in names.given
        if not (known or capital):
            i += 1
            continue
        given_initial = is_initial(first)
        j = i + 1
        if spans[j][1] - spans[j][0] == 2 and is_initial(text[slice(*spans[j])]) and j + 1 < n and _NAME_GAP.match(text, spans[j][1], spans[j + 1][0]) and _NAME_GAP.match(text, end, spans[j][0]):
            j += 1
        if j > i + 1 and known and text[slice(*spans[j])].rstrip(".").lower() not in names.family:
            j = i + 1  # the initial may be the family name
        last_start, last_end = spans[j]
        if not (known or text[last_start].isupper()) or not _NAME_GAP.match(text, spans[j - 1][1], last_start):
            i += 1
            continue
        last = text[last_start:last_end]
        if last.endswith(".") and not is_initial(last):
            last, last_end = last[:-1], last_end - 1
        if first.endswith(".") and not given_initial:
            i += 1
            continue
        family_initial, in_family = is_initial(last), last.lower() in names.family
        shaped = capital and last[:1].isupper() and ((first.isupper() and last.isupper()) or (first[1:].islower() or given_initial) and (last[1:].islower() or family_initial))
        if (given_initial and family_initial) or (not known and not in_family and len(last) < 3) or not (shaped or (known and (in_family or last[:1].isupper()))):
            i += 1
            continue
        if not known and not given_initial and (not in_family and (first.lower() in _FUNCTION or first.isupper()) or last.lower() in _FUNCTION):
            i += 1
            continue
        before, after = text[max(0, start - 16) : start], text[last_end : last_end + 24]
        if before.endswith(("@", "#", "/")) or before[-1:].isalnum() or after[:1] in ("@", "+"):
            i += 1
            continue
        following = re.match(r"\s*([^\W\d_]+)", after)
        body = last.lower().rstrip(".") in _NOT_PERSON or bool(following and following[1][:1].isupper() and not last.isupper() and following[1].lower() in _NOT_PERSON)
        votes = (
            1 if shaped else -1,
            1 if known else (0 if given_initial else -1),
            1 if in_family else (0 if family_initial else -1),
            _sign(bool(_NAME_BEFORE.search(before)) or not before.strip()),
            _sign(bool(_NAME_AFTER.match(after))),
            -1 if body else 0,
            -1 if _PLACE_NAME_BEFORE.search(before) and not known else 0,
            -1 if first.lower() in _FUNCTION or last.lower() in _FUNCTION else 0,
        )
        shape = (_sign(given_initial or family_initial), _sign(first.isupper() and last.isupper()), _sign(j > i + 1))
        yield Span(start, last_end, "NAME", votes + shape)
        # What isn't known may begin with its second word as well.
        i = j + 1 if known or given_initial else i + 1


_STREET_WORD = re.compile(r"\b(?:lane|st|street|row|road|rd|ave|avenue|crescent|terrace|drive|dr|close|walk|place|square|court|ct|way|hill|mews|gardens|boulevard|blvd|alley|ln|rue|chemin|impasse|allée|quai|calle|via|rua|avenida|plaza)\b|stra(?:ss|ß)e\b|str\.|(?:weg|allee|gasse|platz|ufer)\b")
_SEVEN, _SIX, _DIGIT = re.compile(r"(?:\d\D{0,4}){7}"), re.compile(r"(?:\d\D{0,4}){6}"), re.compile(r"\d")
_AT = re.compile(rf"[\[({{]{_GAP}*at{_GAP}*[\])}}]|\bdot\b")


def _kinds_in(text: str) -> list[str]:
    """Types of which the text can hold a candidate at all, by the characters and words that each needs."""
    lower = text.lower()
    kinds = ["EMAIL"] if "@" in text or _AT.search(lower) else []
    if _DIGIT.search(text):
        if _SIX.search(text):
            kinds += ["PHONE", "ID_NUMBER"] if _SEVEN.search(text) else ["ID_NUMBER"]
        if _STREET_WORD.search(lower):
            kinds.append("ADDRESS")
    return kinds


_PAIR = re.compile(r"(?<![^\W_])[A-Z][^\W\d_]*['’\-]?[^\W\d_]*[   ​]{1,3}[A-Z][^\W\d_]")
_LETTERS = re.compile(r"[^\W\d_]+")
_INITIAL = re.compile(r"(?<![^\W\d_])[^\W\d_]\.")


def candidates(text: str, names: Gazetteer) -> list[Span]:
    """All candidate spans of a text with votes and shape features; spans of one type don't overlap."""
    found: list[Span] = []
    for kind in _kinds_in(text):
        patterns = _COMPILED[kind]
        taken: list[tuple[int, int]] = []
        for k, pattern in enumerate(patterns):
            for m in pattern.finditer(text):
                start, end = _trimmed(kind, text, *m.span())
                value = text[start:end]
                if any(a < end and start < b for a, b in taken):
                    continue
                before, after = _around(text, start, end)
                digits = sum(c.isdigit() for c in value)
                if kind == "EMAIL":
                    votes = (
                        1 if k == 0 else 0,
                        _sign(k > 0),
                        1 if _TOP_LEVEL.search(value) else -1,
                        _sign(bool(_MAIL_BEFORE.search(before))),
                        -1 if k == 2 and not re.search(r"(?i)\bdot\b", value) else 0,
                    )
                    shape = (_sign(k > 0), _sign(value.isupper()), _sign("+" in value))
                elif kind == "PHONE":
                    if digits < 6:
                        continue
                    groups = re.findall(r"\d+", value)
                    like_id = any(p.fullmatch(value) for p in _COMPILED["ID_NUMBER"][:5])
                    spoken_id = _ID_BEFORE.search(before) or _ID_AFTER.match(after)
                    votes = (
                        1 if _PHONE_FORM.fullmatch(value) else -1,
                        _sign(bool(_PHONE_BEFORE.search(before)) and not spoken_id),
                        -1 if spoken_id else 0,
                        -1 if _OTHER_NUMBER.search(before) or _OTHER_AFTER.match(after) else 0,
                        -1 if _DATED.fullmatch(value) or _BOOK.fullmatch(value) else 0,
                        -1 if like_id else 0,
                        -1 if not 7 <= digits <= 15 else 0,
                    )
                    shape = (_sign(value[0] in "+0("), _sign(digits >= 10), _sign(len(groups) > 2))
                elif kind == "ID_NUMBER":
                    before_id, after_id = bool(_ID_BEFORE.search(before)), bool(_ID_AFTER.match(after))
                    votes = (
                        1 if k < 4 else 0,
                        _sign(before_id),
                        _sign(after_id),
                        -1 if _PHONE_BEFORE.search(before) and not before_id else 0,
                        -1 if _OTHER_NUMBER.search(before) and not before_id or _OTHER_AFTER.match(after) else 0,
                        -1 if k > 3 and _PHONE_FORM.fullmatch(value) else 0,
                        -1 if k > 3 and not before_id and not after_id else 0,
                    )
                    shape = (_sign(k in (4, 5)), _sign(any(c.isalpha() for c in value)), _sign(k == 5))
                else:
                    votes = (
                        1 if re.search(r"[^\W\d_]", value) and re.search(r"(?:^|\s)[A-Z]", value) or value.isupper() else 0,
                        _sign(bool(_PLACE_BEFORE.search(before))),
                        _sign(bool(re.search(r"(?i)\b(?:apt|apartment|flat|unit|no|nr)\b|№|\d{5}", value)) or bool(re.match(r",? (?:[A-Z]|\d{4,5}\b)", after))),
                        -1 if _TRANSPORT.search(before) else 0,
                        1 if re.search(rf"(?i)\b{_STREET}\b|stra(?:ss|ß)e\b|(?:weg|allee|gasse|platz|ufer)\b|\b(?:rue|calle|via|rua|avenida|plaza|chemin|impasse|allée|quai)\b", value) else -1,
                        -1 if _NOT_HOUSE.match(value) else 0,
                        -1 if re.match(r"(?i)\s*(?:from|away|long|home|along|up|down|back)\b", after) and value.islower() else 0,
                    )
                    shape = (_sign(k == 0), _sign(value.islower()), _sign(digits > 3))
                taken.append((start, end))
                found.append(Span(start, end, kind, votes + shape))
    lower_known = not names.given.isdisjoint(_LETTERS.findall(text.lower()))
    if lower_known or _PAIR.search(text) or _INITIAL.search(text):
        found += _name_spans(text, names, lower_known)
    return found


#: Labelers per type; the features behind them are shape features.
N_VOTES = {"EMAIL": 5, "PHONE": 7, "ID_NUMBER": 7, "ADDRESS": 7, "NAME": 8}


def estimate(patterns: dict[tuple[int, ...], float], n_votes: int, rounds: int = 30) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns: share of true spans, P(vote | true), P(vote | false) as labeler x {-1, 0, 1}.

    Smoothed by a prior that labelers vote rather right than wrong, which also settles which class is which.
    """
    votes = np.array([p[:n_votes] for p in patterns], dtype=int).reshape(-1, n_votes) + 1
    weight = np.array(list(patterns.values()), dtype=float)
    prior_true, prior_false = np.tile([0.5, 2.0, 4.0], (n_votes, 1)), np.tile([4.0, 2.0, 0.5], (n_votes, 1))
    share, p_true, p_false = 0.5, prior_true / prior_true.sum(1, keepdims=True), prior_false / prior_false.sum(1, keepdims=True)
    scale = max(1.0, weight.sum() * 0.02)
    for _ in range(rounds):
        posterior = soft_labels(votes - 1, share, p_true, p_false)
        share = (float((posterior * weight).sum()) + 1) / (float(weight.sum()) + 2)
        for table, prior, w in ((p_true, prior_true, posterior * weight), (p_false, prior_false, (1 - posterior) * weight)):
            for j in range(n_votes):
                counts = np.bincount(votes[:, j], weights=w, minlength=3) + prior[j] * scale / 6.5
                table[j] = counts / counts.sum()
    return share, p_true, p_false


def soft_labels(votes: np.ndarray, share: float, p_true: np.ndarray, p_false: np.ndarray) -> np.ndarray:
    """Probability that each span is true, from its votes."""
    j = np.arange(votes.shape[1])
    yes = np.log(share) + np.log(p_true[j, votes + 1]).sum(1)
    no = np.log(1 - share) + np.log(p_false[j, votes + 1]).sum(1)
    return 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))


def _design(features: np.ndarray, n_votes: int) -> np.ndarray:
    """For and against of every vote, the shape features, and one."""
    votes, shape = features[:, :n_votes], features[:, n_votes:]
    return np.hstack([votes == 1, votes == -1, shape, np.ones((len(features), 1))]).astype(float)


class SpanModel:
    """One logistic classifier per type."""

    def __init__(self, weights: dict[str, np.ndarray], reliability: dict[str, tuple[float, np.ndarray, np.ndarray]]):
        self.weights, self.reliability = weights, reliability

    @classmethod
    def train(cls, counts: dict[str, dict[tuple[int, ...], float]], steps: int = 400) -> SpanModel:
        weights, reliability = {}, {}
        for kind in TYPES:
            patterns, n = counts.get(kind) or {}, N_VOTES[kind]
            if not patterns:
                continue
            reliability[kind] = estimate(patterns, n)
            features = np.array(list(patterns), dtype=int)
            y = soft_labels(features[:, :n], *reliability[kind])
            # Rare patterns count more than in proportion, else the common ones decide alone.
            w = np.sqrt(np.array(list(patterns.values()), dtype=float))
            x, b = _design(features, n), np.zeros(2 * n + features.shape[1] - n + 1)
            w /= w.sum()
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
                grad = x.T @ (w * (p - y)) + 1e-4 * b
                hess = (x * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-4 * np.eye(len(b))
                step = np.linalg.solve(hess, grad)
                b = b - 0.5 * step
                if np.abs(step).max() < 1e-4:
                    break
            weights[kind] = b
        return cls(weights, reliability)

    def probability(self, span: Span) -> float:
        b = self.weights.get(span.kind)
        if b is None:
            return 0.0
        z = float((_design(np.array([span.features]), N_VOTES[span.kind]) @ b)[0])
        return 1 / (1 + np.exp(-max(-30.0, min(30.0, z))))

    def spans(self, text: str, names: Gazetteer) -> list[Span]:
        """The true spans of a text."""
        return self.choose(candidates(text, names), {})

    def choose(self, proposed: list[Span], cache: dict) -> list[Span]:
        """The true ones of the proposed spans, without overlaps: the surer and then the longer one stands."""
        scored = []
        for s in proposed:
            key = (s.kind, s.features)
            if key not in cache:
                cache[key] = self.probability(s)
            if cache[key] >= 0.5:
                scored.append((round(cache[key], 2), s.end - s.start, s))
        kept: list[Span] = []
        for _, _, s in sorted(scored, key=lambda x: (-x[0], -x[1], x[2].start)):
            if all(s.end <= k.start or k.end <= s.start for k in kept):
                kept.append(s)
        return sorted(kept, key=lambda s: s.start)


def learn_names(fields: DataFrame, held: int = HELD_NAMES) -> Gazetteer | NameTable:
    """Names in the places where the corpus names people: ``given.family@`` and "by|with|dear|thanks to|Dr. Given Family".

    All of them count; where they are more than ``held``, they come as a table.
    """
    mail = F.when(F.instr("text", "@") > 0, F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\w.+])([a-z]{2,}\.[a-z]{3,})@"), 1)).otherwise(F.array().cast("array<string>"))
    cue = F.regexp_extract_all("text", F.lit(r"(?:\b[Bb]y|\b[Ww]ith|\b[Dd]ear|\b[Tt]hanks to|\b(?:Dr|Mr|Mrs|Ms|Prof)\.) (\p{Lu}\p{L}+ (?:\p{Lu}\. )?\p{Lu}\p{L}{2,})\b"), 1)
    pairs = fields.where("text IS NOT NULL").select(F.explode(F.concat(F.transform(mail, lambda m: F.translate(m, ".", " ")), F.transform(cue, F.lower))).alias("name"))
    pairs = keep(pairs.select(F.regexp_extract("name", r"^(\S+)", 1).alias("given"), F.regexp_extract("name", r"(\S+)$", 1).alias("family")))
    # Function words and nouns of places are no names; a given name goes with several family names, what is said of things seldom does.
    common = ", ".join(repr(w) for w in sorted(_NOT_PERSON | _FUNCTION))
    pairs = pairs.where(f"given NOT IN ({common}) AND family NOT IN ({common})")
    given = keep(pairs.groupBy("given").agg(F.approx_count_distinct("family").alias("n")).where("n >= 3").select("given"))
    family = pairs.join(given, "given", "left_semi").select("family").distinct()
    table = keep(given.select(F.col("given").alias("name"), F.lit(True).alias("is_given")).unionByName(family.select(F.col("family").alias("name"), F.lit(False).alias("is_given"))))
    rows = table.limit(held + 1).collect()
    if len(rows) > held:
        return NameTable(table)
    return Gazetteer(frozenset(r.name for r in rows if r.is_given), frozenset(r.name for r in rows if not r.is_given))


def _own_names(texts: DataFrame, table: NameTable) -> DataFrame:
    """Texts with those names of the table that are words of theirs: the columns of texts, given, family (arrays or null)."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["key"], batch["text"]):
                rows += [(key, w) for w in {w.lower() for w in _LETTERS.findall(text)} | set(_LETTERS.findall(text.lower())) if len(w) > 1]
            yield pd.DataFrame(rows, columns=["key", "name"])

    keyed = texts.withColumn("key", F.sha2("text", 256))
    words = keep(keyed.select("key", "text").dropDuplicates(["key"]).mapInPandas(split, "key string, name string"))
    sizes = words.join(table.names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("size"))
    kinds = table.names.groupBy("name").agg(F.bool_or("is_given").alias("is_given"), F.bool_or(~F.col("is_given")).alias("is_family"))
    known = skew_safe_lookup(words, kinds.join(sizes, "name"), ["name"], "size", "key")
    own = known.groupBy("key").agg(F.collect_list(F.when(F.col("is_given"), F.col("name"))).alias("given"), F.collect_list(F.when(F.col("is_family"), F.col("name"))).alias("family"))
    return keyed.join(own, "key", "left").drop("key")


#: Texts of which a task remembers what it found, and how long they may be.
REMEMBERED, REMEMBERED_LENGTH = 5_000, 2_000


def remembering(function: Callable) -> Callable:
    """The function of a text (and other hashable arguments), which isn't asked again for texts it saw of late."""
    cached = functools.lru_cache(REMEMBERED)(function)
    return lambda text, *more: (cached if len(text) <= REMEMBERED_LENGTH else function)(text, *more)


def propose(fields: DataFrame, names: Gazetteer | NameTable) -> DataFrame:
    """Texts with candidate spans: record, field, position, text, spans (start, end, kind, features as text).

    ``fields``: record, field, text, and position where a field of a record holds several texts (else 0).

    The one pass over all texts (one more, and a join, where names are a table); null and empty ones have no candidates.
    """
    held = names if isinstance(names, Gazetteer) else None

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        written: dict[tuple[int, ...], str] = {}  # there are far fewer patterns than spans

        def spans_of(text: str, known: Gazetteer) -> list[dict]:
            spans = candidates(text, known)
            for s in spans:
                if s.features not in written:
                    written[s.features] = " ".join(map(str, s.features))
            return [{"start": s.start, "end": s.end, "kind": s.kind, "features": written[s.features]} for s in spans]

        again = remembering(spans_of)
        for batch in batches:
            rows = []
            own = [held] * len(batch) if held is not None else [Gazetteer(frozenset(() if g is None else g), frozenset(() if f is None else f)) for g, f in zip(batch["given"], batch["family"])]
            for record, name, place, text, known in zip(batch["record"], batch["field"], batch["position"], batch["text"], own):
                spans = again(text, known)
                if spans:
                    rows.append((record, name, place, text, spans))
            if rows:
                yield pd.DataFrame(rows, columns=["record", "field", "position", "text", "spans"])

    schema = "record long, field string, position int, text string, spans array<struct<start:int,end:int,kind:string,features:string>>"
    place = F.col("position").cast("int") if "position" in fields.columns else F.lit(0)
    texts = fields.where("text <> ''").select("record", "field", place.alias("position"), "text")
    return (texts if held is not None else _own_names(texts, names)).mapInPandas(scan, schema)


def learn(proposed: DataFrame) -> SpanModel:
    """Span model trained on the vote patterns of the whole corpus."""
    rows = proposed.select(F.inline("spans")).groupBy("kind", "features").count().collect()
    counts: dict[str, dict[tuple[int, ...], float]] = {}
    for r in rows:
        counts.setdefault(r.kind, {})[tuple(map(int, r.features.split()))] = float(r["count"])
    return SpanModel.train(counts)


def find(proposed: DataFrame, model: SpanModel) -> DataFrame:
    """Texts in which something was found: record, field, position, kinds (distinct types), masked (text with ``[TYPE]`` in place of spans).

    Rows repeated under one record, field and position come out once (of different texts, one). Whole texts are read.
    """

    def mask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        read: dict[str, tuple[int, ...]] = {}

        def masked(text: str, proposals: tuple[tuple[int, int, str, str], ...]) -> tuple[list[str], str] | None:
            for _, _, _, features in proposals:
                if features not in read:
                    read[features] = tuple(map(int, features.split()))
            spans = model.choose([Span(start, end, kind, read[features]) for start, end, kind, features in proposals], cache)
            if not spans:
                return None
            parts, at = [], 0
            for s in spans:
                parts += [text[at : s.start], f"[{s.kind}]"]
                at = s.end
            return sorted({s.kind for s in spans}), "".join(parts) + text[at:]

        again = remembering(masked)
        for batch in batches:
            out = []
            for record, name, place, text, proposals in zip(batch["record"], batch["field"], batch["position"], batch["text"], batch["spans"]):
                found = again(text, tuple((p["start"], p["end"], p["kind"], p["features"]) for p in proposals))
                if found:
                    out.append((record, name, place, *found))
            if out:
                yield pd.DataFrame(out, columns=["record", "field", "position", "kinds", "masked"])

    found = proposed.mapInPandas(mask, "record long, field string, position int, kinds array<string>, masked string")
    return found.groupBy("record", "field", "position").agg(F.min(F.struct("kinds", "masked")).alias("m")).select("record", "field", "position", "m.kinds", "m.masked")
