"""Personal information inside free text.

Regular expressions propose spans; a proposal's score starts from how telling its form is, rises with words nearby
that announce such a thing or with a place apart from the sentence, and is raised or lowered by a checksum where the
number has one: a bare number needs it, a number announced by its own name stands without. Spans that score enough are
replaced by typed placeholders; where spans overlap the better one stands.

Every rule names what any match of it must hold (its need); rules whose need a text lacks are not tried on it. Needs
follow from the rules' forms, so they lose nothing.

Defined results
* null and empty texts stay as they are and hold nothing;
* the text outside the spans is unchanged, character by character;
* any white space, also a line end or a no-break space, may stand where a plain space would;
* rows delivered twice give equal rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.batches import chunks

KINDS = ("email", "phone", "identity_number", "address", "person")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "address": "[ADDRESS]", "person": "[PERSON]"}
#: Score from which a proposal stands, and characters before it that are searched for words of context.
ENOUGH, NEAR = 1.0, 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """International bank account numbers: letters count from 10, the first four characters go last."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def tax_number(digits: str) -> bool:
    """Twelve-digit personal tax number with two check digits."""
    check = lambda weights: sum(w * int(d) for w, d in zip(weights, digits)) % 11 % 10
    return check((7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == int(digits[10]) and check((3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8)) == int(digits[11])


def insurance_number(digits: str) -> bool:
    """Eleven-digit insurance number; its last two digits check the first nine."""
    rest = sum((9 - i) * int(d) for i, d in enumerate(digits[:9])) % 101 % 100
    return rest == int(digits[9:])


@dataclass(frozen=True)
class Rule:
    kind: str
    form: re.Pattern
    score: float
    #: What every match holds; a key of NEEDS.
    need: str
    #: Words that raise the score by the weight if they stand shortly before the span, or behind it.
    context: re.Pattern | None = None
    after: re.Pattern | None = None
    weight: float = 1.0
    #: Says of the span's letters and digits whether its checksum holds; that adds one, a failure takes half away.
    valid: object = None
    #: Signs before or behind the span that set it apart; they raise a score that isn't enough by a fifth.
    apart: tuple[re.Pattern | None, re.Pattern | None] = (None, None)
    #: Is a span that begins with a word of _NO_NAME no proposal?
    named: bool = False


def _c(pattern: str, flags: int = 0) -> re.Pattern:
    return re.compile(pattern.replace(" ", r"\s"), flags)


_CALL = _c(r"(?:\bтел|телефон|связь|номеру|диспетчер|доб|моб|факс|\btel\b|\bcall\b|phone|answers on|enquiries|ring|fax|nummer|rückfragen|leitstelle|telefon|mobil|anruf)\W*(?:[\w ]{0,14}:? ?)$", re.I)
_ASIDE = _c(r"(?:[—–(,:] ?|\) )$")
_EXT = r"(?:,? ?(?:доб\.?|ext\.?|DW) ?\d{1,5})?"
_DIGIT_END = r"(?![\w]|[.,]\d|-\d)"
_DIGIT_START = r"(?<![\w.,/№-])(?<!№ )"
_RU = r"[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
_SURNAME = r"[А-ЯЁ][а-яё]{2,}(?:[оеё]в|[иы]н|ск(?:ий|ая|ого|ому|ой|им)|ко|[иы]х)(?:а|у|ым|ой|е|ы)?"
_PATRONYMIC = r"[А-ЯЁ][а-яё]+(?:(?:ов|ев|ёв)ич(?:а|у|ем|е)?|(?:ов|ев|ич|инич)н(?:а|ы|е|у|ой))"
_UP = r"[А-ЯЁ]{4,}(?:-[А-ЯЁ]{3,})?"
_INITIALS = r"[А-ЯЁ]\. ?[А-ЯЁ]\."
_LAT = r"[A-ZÄÖÜ][a-zäöüßéè]{2,}(?:-[A-ZÄÖÜ][a-zäöüß]+)?"
_TITLE = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Herrn|Dipl|Ing)\.? )+"
_SIGNED = _c(r"(?:prepared by|checked:?|returned to|signed by|approved by|geprüft:?|erstellt von|von|исполнитель:?|проверил\(а\)|составил\(а\)|согласования,?|утвердил\(?а?\)?) ?$", re.I)
_SIGNS = _c(r"^ ?(?:signs the|for comment|zeichnet|подписывает|по замерам)", re.I)
_END = _c(r"^(?:[.,;)]| ?\Z)")
_OPENING = _c(r"(?:[—–(,:] ?|\) |[.:;] *|\A *)$")
_HOUSE_RU = r"(?:,? (?:д\.|дом) ?\d+[а-я]?(?:[/-]\d+)?|, \d+[а-я]?(?:[/-]\d+)?)(?:,? (?:корп|стр|к)\.? ?\d+)?(?:,? (?:кв|оф)\.? ?\d+)?"
_TOWN_RU = rf"(?:(?<!номер )(?<!№ )\d{{6}}, )?(?:(?:г|гор|пос|с|дер|п)\.? ?{_RU}(?: {_RU})?, )?"
_NAME_RU = rf"{_RU}(?: [а-яё]+| {_RU})?"
_KIND_RU = r"(?:ул\.|улица|улице|улицы|пер\.|переулок|просп\.|проспект|пр-т|пр\.|ш\.|шоссе|наб\.|набережная|б-р|бульвар|пл\.|площадь|проезд|туп\.|тупик|аллея)"
_WAY_EN = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Close|Way|Drive|Court|Square|Place|Terrace|Crescent|Gardens|Row|Boulevard|Blvd\.?)"
_WAY_DE = r"(?:[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|pfad|platz|allee|gasse|ring|damm|ufer|steig|graben|hof)|(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Hinter der|Alte|Neue) [A-ZÄÖÜ][a-zäöüß]+)"

RULES = (
    Rule("email", _c(r"(?:<?mailto:)?[\w.+-]*\w ?@ ?\w[\w-]*(?:\.\w[\w-]*)*\.[A-Za-zА-Яа-я]{2,}>?", re.I), 1.0, "at"),
    Rule("email", _c(r"[\w.+-]*\w ?[(\[] ?(?:at|ät|собака) ?[)\]] ?\w[\w-]*(?: ?[(\[] ?(?:dot|punkt|точка) ?[)\]] ?\w[\w-]*)+", re.I), 1.0, "bracket_at"),
    Rule("phone", _c(_DIGIT_START + r"\+7[ -]?(?:\(\d{3}\)|\d{3})[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"8(?:[ -]?\(\d{3}\)[ -]?\d{3}[ -]?\d{2}[ -]?\d{2}|-\d{3}-\d{3}-\d{2}-\d{2}| \d{3} \d{3} \d{2} \d{2})" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(r"(?<![\w)])\(\d{3,5}\) ?\d{2,3}[ -]\d{2}[ -]\d{2}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"(?:\+|00)(?:[1-69]\d{0,2}|7\d)[ .-]?(?:\(0\) ?)?(?:\(\d{2,5}\)|\d{2,5})(?:[ ./-]?\d{2,8}){1,4}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(r"(?<![\w)])(?:1[ -])?\(\d{3}\) \d{3}-\d{4}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"1[-.]\d{3}[-.]\d{3}[-.]\d{4}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"\d{3}[-.]\d{3}[-.]\d{4}" + _EXT + _DIGIT_END), 0.8, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"555-\d{4}" + _EXT + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"\d{3}-\d{4}" + _EXT + _DIGIT_END), 0.4, "digits", _CALL),
    Rule("phone", _c(r"(?<![\w)])\(0\d{1,4}\) ?\d{4,8}(?:-\d{1,4})?" + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"0\d{1,4}/ ?\d{4,8}(?:-\d{1,4})?" + _DIGIT_END), 1.0, "digits", _CALL),
    Rule("phone", _c(_DIGIT_START + r"0\d{2,4} \d{3} \d{3,5}" + _DIGIT_END), 0.9, "digits", _CALL, apart=(_ASIDE, None)),
    Rule("phone", _c(_DIGIT_START + r"0\d{3,4} \d{6}" + _DIGIT_END), 0.9, "digits", _CALL, apart=(_ASIDE, None)),
    Rule("identity_number", _c(r"паспорт[а-я]*(?: РФ)?:?(?: серии| серия)? \d{2} ?\d{2},?(?: номер| №| N)? ?\d{6}" + _DIGIT_END, re.I), 1.0, "digits"),
    Rule("identity_number", _c(r"ИНН(?: физ\.? ?лица| физлица)?:? ?№? ?(\d{12})(?!\d)", re.I), 1.5, "digits", valid=tax_number),
    Rule("identity_number", _c(_DIGIT_START + r"(\d{12})" + _DIGIT_END), 0.2, "digits", valid=tax_number),
    Rule("identity_number", _c(r"СНИЛС:? ?№? ?(\d{3}-\d{3}-\d{3}[ -]\d{2}|\d{11})(?!\d)", re.I), 1.5, "digits", valid=insurance_number),
    Rule("identity_number", _c(r"страхов(?:ой|ого|ому) номер[а-я]*:? ?№? ?(\d{11}|\d{3}-\d{3}-\d{3}[ -]\d{2})(?!\d)", re.I), 1.5, "digits", valid=insurance_number),
    Rule("identity_number", _c(_DIGIT_START + r"(\d{3}-\d{3}-\d{3} \d{2})" + _DIGIT_END), 0.6, "digits", valid=insurance_number),
    Rule("identity_number", _c(r"(?:SSN|social security (?:number|no\.?)):? ?\d{3}[ -]?\d{2}[ -]?\d{4}" + _DIGIT_END, re.I), 1.0, "digits"),
    Rule("identity_number", _c(_DIGIT_START + r"\d{3}-\d{2}-\d{4}" + _DIGIT_END), 0.4, "digits", _c(r"(?:security|SSN|identity|presented|card shows)[\w ,.:]{0,20}$", re.I)),
    Rule("identity_number", _c(r"national insurance (?:number|no\.?):? ?[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b", re.I), 1.0, "digits"),
    Rule("identity_number", _c(r"\b[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPQR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]\b"), 1.0, "digits"),
    Rule("identity_number", _c(r"(?:passport|identity card|id card|driving licence|Personalausweis|Reisepass|Führerschein|Ausweis)(?:-?(?:nummer|Nr\.?)| (?:no|number|nr|nummer)\b\.?)?:? ?[A-Z]{1,3}-?\d{5,9}\b", re.I), 1.0, "digits"),
    Rule("identity_number", _c(r"(?:Steuer-?ID(?:entifikationsnummer|-?Nr\.?)?|Steuernummer|tax (?:id|number)):? ?\d{2} ?\d{3} ?\d{3} ?\d{3}" + _DIGIT_END, re.I), 1.0, "digits"),
    Rule("identity_number", _c(r"(?:(?:Sozial|Renten)versicherungs(?:nummer|-?Nr\.?)):? ?\d{2} ?\d{6} ?[A-Z] ?\d{3}" + _DIGIT_END, re.I), 1.0, "digits"),
    Rule("identity_number", _c(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"), 0.4, "iban", _c(r"(?:IBAN)[\w ,.:]{0,10}$", re.I), valid=mod97),
    Rule("identity_number", _c(_DIGIT_START + r"(\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4})" + _DIGIT_END), 0.2, "digits", _c(r"(?:карт[аыу]|card|Karte)[\w ,.:№]{0,14}$", re.I), valid=luhn),
    Rule("address", _c(rf"{_TOWN_RU}{_KIND_RU} ?{_NAME_RU}{_HOUSE_RU}"), 1.0, "kind_ru"),
    Rule("address", _c(rf"{_TOWN_RU}{_NAME_RU} (?:ул\.|улица|пер\.|переулок|просп\.|пр-т|ш\.|шоссе|наб\.|б-р|пл\.|проезд){_HOUSE_RU}"), 1.0, "kind_ru"),
    Rule("address", _c(rf"(?:(?:Flat|Unit|Apt\.?|Suite|Room) \d+[A-Za-z]?, ?)?\d{{1,4}}(?:-?[A-Z])?,? (?:[A-Z][a-z]+(?:'s|’s)? ){{1,3}}{_WAY_EN}(?!\w)(?:,? (?:Apt|Unit|Flat|Suite)\.? ?\d+[A-Za-z]?)?(?:, [A-Z][a-z]+(?: [A-Z][a-z]+)? [A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}|, [A-Z][a-z]+(?!,? [A-Z]|[a-z]))?"), 1.0, "way_en"),
    Rule("address", _c(rf"(?:\d{{5}} [A-ZÄÖÜ][a-zäöüß]+, )?(?<![\w-]){_WAY_DE},? (?:Nr\.? ?)?\d{{1,4}} ?[a-z]?(?!\w|[.,]\d)(?:, \d+\. OG)?(?:, \d{{5}} [A-ZÄÖÜ][a-zäöüß]+)?"), 1.0, "way_de"),
    Rule("person", _c(rf"(?<![\w.]){_INITIALS} ?(?:{_RU}|{_UP})(?!\w)"), 1.0, "initials_ru"),
    Rule("person", _c(rf"(?<!\w)(?:{_RU}|(?<![А-ЯЁ] ){_UP}),? {_INITIALS}(?!\w)"), 1.0, "initials_ru"),
    Rule("person", _c(rf"(?<!\w)(?:{_RU} ){{0,2}}{_PATRONYMIC}(?: {_RU})?(?!\w)"), 1.0, "patronymic"),
    Rule("person", _c(rf"(?<!\w){_RU} {_SURNAME}(?!\w)"), 0.9, "names_ru", _SIGNED, _SIGNS, named=True, apart=(_ASIDE, _END)),
    Rule("person", _c(rf"(?<!\w){_SURNAME} {_RU}(?!\w)"), 0.5, "names_ru", _SIGNED, _SIGNS, named=True),
    Rule("person", _c(rf"(?<!\w){_UP} {_UP}(?!\w)"), 0.0, "upper_ru", _SIGNED, _SIGNS, named=True),
    Rule("person", _c(rf"(?<!\w){_TITLE}(?:[A-Z]\. ?)*(?:{_LAT}|[A-ZÄÖÜ]{{4,}})(?: (?:[A-Z]\. ?)*{_LAT})?(?!\w)"), 1.0, "title"),
    Rule("person", _c(rf"(?<![\w.])(?:[A-ZÄÖÜ]\. ?){{1,2}}(?:{_LAT}|[A-ZÄÖÜ]{{4,}}(?:-[A-ZÄÖÜ]{{3,}})?)(?!\w)"), 0.8, "initials", _SIGNED, _SIGNS, named=True, apart=(_OPENING, None)),
    Rule("person", _c(rf"(?<!\w){_LAT} [A-ZÄÖÜ]\. {_LAT}(?!\w)"), 1.0, "middle"),
    Rule("person", _c(rf"(?<!\w){_LAT}, {_LAT}(?: [A-ZÄÖÜ]\.)(?!\w)"), 1.0, "comma"),
    Rule("person", _c(rf"(?<!\w){_LAT} {_LAT}(?!\w)"), 0.0, "names", _SIGNED, _SIGNS, named=True),
    Rule("person", _c(rf"(?<!\w){_LAT} {_LAT}(?!\w)"), 0.0, "names", _c(r"[a-zäöüß0-9.] ?(?:—|–|,|\() ?$"), _c(r"^(?:[.,)]|$)"), weight=0.5, named=True),
)
#: Words that begin sentences or headings and are no names, in front of a capitalised word.
_NO_NAME = re.compile(r"^(?:Die|Der|Das|Den|Dem|Des|Ein|Eine|The|In|At|By|As|Under|Nach|Zu|Bei|Hinweis|Ergänzend|Zeile|Formblatt|Ziffer|Position|Fassung|Preisen|Port|Street|Abbildung|Tabelle|Figure|Table|Рисунок|Таблица|Раздел|Графа|Лист|Малая|Большая|Новая|Старая|Для|При|По|На|В|Ведомость|Смету|Исполнитель|Замечания|Материалы|Замеры|Контакт|Копию|Телефон|Связь|Тел)\s")

_KINDS_RU = re.compile(r"ул\.|улиц|пер\.|переул|просп|пр-т|пр\.|ш\.|шоссе|наб|б-р|бульвар|пл\.|площадь|проезд|туп|алле")
_BRACKET_AT = _c(r"[(\[] ?(?:at|ät|собака)", re.I)
#: What every match of a rule holds.
NEEDS = {
    "at": lambda t: "@" in t,
    "bracket_at": lambda t: ("(" in t or "[" in t) and _BRACKET_AT.search(t),
    "digits": _c(r"\d(?:[ ()./-]{0,3}\d){4}").search,
    "iban": re.compile(r"[A-Z]{2}\d{2}").search,
    "kind_ru": _KINDS_RU.search,
    "way_en": _c(r"\d(?:-?[A-Z])?,? [A-Z][a-z]").search,
    "way_de": _c(r"[a-zäöüß.],? (?:Nr\.? ?)?\d").search,
    "initials_ru": _c(r"[А-ЯЁ]\. ?[А-ЯЁ]\.").search,
    "patronymic": re.compile(r"[ое]вич|ёвич|[оеи][вч]н[аыеуо]").search,
    "names_ru": _c(r"[а-яё] [А-ЯЁ][а-яё]").search,
    "upper_ru": _c(r"[А-ЯЁ]{3} [А-ЯЁ]{4}").search,
    "title": _c(r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herrn?|Frau|Dipl|Ing)\.? ").search,
    "initials": _c(r"[A-ZÄÖÜ]\. ?[A-ZÄÖÜ]").search,
    "middle": _c(r" [A-ZÄÖÜ]\. [A-ZÄÖÜ]").search,
    "comma": _c(r"[a-zäöüßéè], [A-ZÄÖÜ]").search,
    "names": _c(r"[a-zäöüßéè] [A-ZÄÖÜ][a-zäöüßéè]{2}").search,
}
_BY_NEED = [(NEEDS[n], [r for r in RULES if r.need == n]) for n in dict.fromkeys(r.need for r in RULES)]
_RANK = {k: i for i, k in enumerate(("email", "identity_number", "phone", "address", "person"))}


def _score(rule: Rule, m: re.Match, text: str) -> float:
    before, behind = text[max(0, m.start() - NEAR) : m.start()], text[m.end() : m.end() + NEAR]
    score = rule.score
    for words, place in ((rule.context, before), (rule.after, behind)):
        if words is not None and words.search(place):
            score += rule.weight
    if rule.valid is not None:
        score += 1.0 if rule.valid(re.sub(r"\W", "", m.group(1))) else -0.5
    if score < ENOUGH and any(sign is not None and sign.search(place) for sign, place in zip(rule.apart, (before, behind))):
        score += 0.2
    return score


def spans(text: str) -> list[tuple[int, int, str, float]]:
    """(begin, end, kind, score) of what stands, in order and without overlaps."""
    found = []
    for need, rules in _BY_NEED:
        if not need(text):
            continue
        for rule in rules:
            for m in rule.form.finditer(text):
                if rule.named and _NO_NAME.match(m.group()):
                    continue
                score = _score(rule, m, text)
                if score >= ENOUGH:
                    found.append((-score, m.start() - m.end(), m.start(), m.end(), rule.kind))
    taken: list[tuple[int, int, str, float]] = []
    for negative, _, a, b, kind in sorted(found, key=lambda x: (_RANK[x[4]], x[1], x[0], x[2])):
        if all(b <= c or a >= d for c, d, _, _ in taken):
            taken.append((a, b, kind, -negative))
    return sorted(taken)


def replace(text: str) -> tuple[str, list[str]]:
    parts, kinds, at = [], [], 0
    for a, b, kind, _ in spans(text):
        parts += [text[at:a], PLACEHOLDERS[kind]]
        kinds.append(kind)
        at = b
    return "".join(parts) + text[at:], kinds


def detect(units: DataFrame, keys: tuple[str, ...] = ("document_id", "unit_id")) -> DataFrame:
    """The keys, text, redacted and kinds (array, one for each span) of every row that holds personal information."""
    schema = ", ".join(f"`{k}` {units.schema[k].dataType.simpleString()}" for k in keys) + ", text string, redacted string, kinds array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                hit = [(i, *r) for i, r in enumerate(map(replace, texts)) if r[1]]
                of = pa.array([h[0] for h in hit], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(of) for k in keys], part.column("text").take(of), pa.array([h[1] for h in hit], pa.string()), pa.array([h[2] for h in hit], pa.list_(pa.string()))], [*keys, "text", "redacted", "kinds"])

    return units.select(*keys, "text").where(F.length("text") > 0).mapInArrow(run, schema)


def redact(units: DataFrame, keys: tuple[str, ...] = ("document_id", "unit_id")) -> DataFrame:
    """The keys and text of every row, personal information replaced by placeholders; null and empty texts stay in the JVM."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], pa.array([replace(t)[0] for t in texts], pa.string())], [*keys, "text"])

    rows = units.select(*keys, "text")
    some = F.coalesce(F.length("text") > 0, F.lit(False))
    return rows.where(~some).unionByName(rows.where(some).mapInArrow(run, rows.schema))


def found(units: DataFrame) -> DataFrame:
    """document_id, unit_id, kind: each kind once for a unit."""
    return detect(units).select("document_id", "unit_id", F.explode("kinds").alias("kind")).distinct()
