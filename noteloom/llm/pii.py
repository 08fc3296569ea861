"""Personal data replaced by keyed surrogates.

1. One pattern finds mentions: addresses, numbers, secrets, and names after a title, of any number of words, with
   particles. Each is cut into parts (an address into local part and domain, a name into its words).
2. Distinct parts of the whole corpus form a table. A part's surrogate is drawn by a keyed hash from
   the space of its kind: digits for digits with valid check digits where cards and accounts have them, country codes, private networks
   and the prefixes of secrets kept, letters for letters of the same script, hex for hex, given names of the same gender, surnames of the
   same script with the ending of their gender. The draw hangs on key, kind and the normalised part only, and a given name's gender is told by
   the titles of all its mentions together, so all mentions of one entity agree (coreference).
3. Collisions are checked: a part whose surrogate another part has too, or that is itself a part found in
   the corpus, draws again, until none is left. So distinct entities stay distinct, and no surrogate is
   someone else's data. Every kind's space grows with the draws, so this ends.
4. Surrogates take each mention's format: punctuation and case stay.

DataFrame functions only. Texts without mentions pass by; the others are staged once, and only (row,
position, part) triples meet the surrogate table, by a join that skew handling can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.llm.common import checkpointed, staged

#: Draws after which the spaces of fixed size (digits, network addresses) grow by a character with each draw; the others grow
#: from their second or third draw on.
FIXED_DRAWS = 24

# Titles by gender, given names by gender, particles of names (those that may follow a title first), and syllables for surnames.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н", "г-н", "Господин", "Κύριος", "السيد", "MR", "HERR", "MONSIEUR"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "Г-жа", "г-жа", "Госпожа", "Κυρία", "السيدة", "MRS", "MISS", "FRAU", "MADAME"]
NEUTRAL_TITLES = ["Dr", "Prof", "Mx", "DR", "PROF"]
# what may follow a name and is no part of it
SUFFIXES = ["Jr", "Sr", "II", "III", "IV", "PhD", "MD", "Esq"]
HAN_SURNAMES = list("王李张刘陈杨赵黄周吴徐孙胡朱高林")
HAN_GIVEN = list("伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰文斌建国志海")
ARABIC_LINKS = "بن ابن بنت أبو ابو آل عبد".split()
MALE_GIVEN = ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Noel", "Oscar", "Paul"]
FEMALE_GIVEN = ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"]
MALE_GIVEN_CYRILLIC = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"]
FEMALE_GIVEN_CYRILLIC = ["Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина"]
PARTICLES = "von van vom de del della di da do dos du zu zum zur af av bin ibn der den dem das des la las los le ten ter al el".split()
#: By script: how its letters are recognised, syllables, and the endings of surnames by what the real one ends with (else the last).
SCRIPTS = {
    "cyrillic": ("[а-яёіїєґ]", ["ба", "дел", "фор", "ган", "хол", "кер", "лин", "мор", "нал", "пер", "рос", "сел", "тан", "вер", "вил", "зан"], [("[ая]$", "ова"), ("", "ов")]),
    "greek": ("[α-ωά-ώ]", ["βα", "δελ", "φορ", "γαν", "χολ", "κερ", "λιν", "μορ", "ναλ", "περ", "ροσ", "σελ", "ταν", "βερ", "βιλ", "ζαν"], [("(ου|[αηάή])$", "ου"), ("", "ος")]),
    "arabic": (r"\\p{IsArabic}", ["با", "دل", "فر", "غن", "حل", "كر", "لن", "مر", "نل", "بر", "رس", "سل", "تن", "ور", "ول", "زن"], [("", "")]),
    "latin": ("", ["ba", "del", "for", "gan", "hol", "ker", "lin", "mor", "nal", "per", "ros", "sel", "tan", "ver", "wil", "zan"], [("", "")]),
}
#: Given names of other scripts than Latin by gender; for scripts without, syllables with these endings.
GIVEN_ENDINGS = {"cyrillic": ("ор", "а"), "greek": ("ος", "α"), "arabic": ("", "ة"), "latin": ("o", "a")}

# Each alternative begins with a cheap look at one character, so most places fail at once.
_L, _W = r"\p{L}", r"[\p{L}\p{N}_]"
_EMAIL = rf"(?<![\p{{L}}\p{{N}}_.%+-])[\p{{L}}\p{{N}}_%+-][\p{{L}}\p{{N}}_.%+-]*+@[\p{{L}}\p{{N}}_-]++(?:\.[\p{{L}}\p{{N}}_-]++)*\.[A-Za-z]{{2,}}+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_.]){_OCTET}(?:\.{_OCTET}){{3}}(?!{_W}|\.[0-9])"
_H = "[0-9A-Fa-f]{1,4}"
# eight groups, or fewer with one gap; words such as fade::bead need a digit
_IP6_BODY = rf"(?:(?:{_H}:){{7}}{_H}|(?=[0-9A-Fa-f:]*[0-9])(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?=[0-9A-Fa-f:]*[0-9])(?:{_H}:){{2,7}}:)"
_IP6 = rf"(?=[0-9A-Fa-f])(?<![\p{{L}}\p{{N}}_:.]){_IP6_BODY}(?![\p{{L}}\p{{N}}_:])"
# Secrets have no upper length: a run is one mention, to its end. A keyword's value without letters or digits isn't one.
_KEYWORD = r"(?i:token|secret|password|passwd|api[_-]?key)"
_SECRET = (
    r"(?=[0-9A-Fa-f])(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])"
    r"|(?=[Ags])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"
    rf"|(?<=[=:]|[=:][ \"']|[=:] [\"'])(?<={_KEYWORD}[ ]{{0,1}}[=:][ ]{{0,1}}[\"']{{0,1}})(?=[^\s\"',;\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^\s\"',;]{{6,}}+"
)
_SSN = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\p{{L}}\p{{N}}_-])"
_PHONE = (
    rf"(?=\+)(?<!{_W})\+[0-9]{{1,3}}[ .-]?\(?[0-9]{{1,4}}\)?(?:[ .-]?[0-9]{{2,4}}){{2,4}}(?!{_W})"
    rf"|(?=[(0-9])(?<!{_W})(?:\([0-9]{{3}}\) ?|[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}(?!{_W})"
)
#: Lengths of account numbers by country, which may hold letters and five digits at least; of other countries all-digit ones are found.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
_BY_COUNTRY = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?=(?:[A-Z ]{{0,8}}[0-9]){{5}})(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_IBAN_BODY = rf"(?:(?:{_BY_COUNTRY})(?!{_W})|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{3,6}}(?: ?[0-9]{{1,3}})?(?!{_W}))"
_IBAN = rf"(?=[A-Z])(?<!{_W}){_IBAN_BODY}"
_CARD = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}_.])[0-9](?:[ -]?[0-9]){{12,18}}(?!{_W})"
_TITLES = MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES
_TITLE = "|".join(_TITLES)
_FIRST = "".join(sorted({t[0] for t in _TITLES}))
# a word of a name: an initial, or a capital and more; Arabic has no capitals, so there a name is two words, and on by links and by words with an article
_WORD = rf"(?!(?:{_TITLE}|{'|'.join(SUFFIXES)})\b)\p{{Lu}}(?:[\p{{L}}\p{{M}}'’-]+|\.)"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)}) )*+"
# right after a title an article is no part of a name
_AT_FIRST = rf"(?:(?:{'|'.join(PARTICLES[:18])}) {_PARTICLES})?"
_PIECE = rf"{_PARTICLES}(?:{_WORD}|\p{{IsArabic}}{{2,}}+)"
_AR = r"\p{IsArabic}{2,}+"
_ARABIC = rf"{_AR}(?: {_AR})?(?: (?:{'|'.join(ARABIC_LINKS)}) {_AR}| ال{_AR})*+"
_NAME = rf"(?=[{_FIRST}])(?<!{_W})(?:{_TITLE})\.? (?:{_AT_FIRST}{_WORD}(?: {_PARTICLES}{_WORD})*+|{_ARABIC})"
_LAST_WORD = "([^ ]+?)(['’]s)?$"
_HAN_NAME = r"(?=\p{IsHan})\p{IsHan}{2,3}(?=先生|女士|小姐)"
#: The pattern of all mentions.
PATTERN = "|".join([_IP, _IP6, _SECRET, _SSN, _PHONE, _IBAN, _CARD, _NAME, _HAN_NAME, _EMAIL])
#: Secrets that hold neither a digit nor a keyword.
_LETTERS_ONLY = r"AKIA[A-Z]|gh[pousr]_[A-Za-z]|sk-[A-Za-z_-]{20}|[a-f]{32}|[A-F]{32}"
_TITLED = rf"[{_FIRST}](?<=(?<!{_W})[{_FIRST}])(?:{'|'.join(t[1:] for t in _TITLES)})\.? (?:\p{{Lu}}|\p{{IsArabic}}|{_AT_FIRST}\p{{Lu}})"


def may_hold_mentions(text: Column) -> Column:
    """A cheaper scan than the pattern: texts that fail it hold no mention."""
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    return text.rlike("[0-9@]") | (assigned & text.rlike(_KEYWORD)) | text.rlike(_TITLED) | text.rlike(_LETTERS_ONLY) | text.rlike("[先女小][生士姐]")


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _gender(title: str) -> str:
    male, female = (", ".join(f"'{t}'" for t in ts) for ts in (MALE_TITLES, FEMALE_TITLES))
    return f"CASE WHEN {title} IN ({male}) THEN 'm' WHEN {title} IN ({female}) THEN 'f' ELSE 'n' END"


def parts_sql(m: str) -> str:
    """SQL: the parts (lead, kind, norm, raw, tail, gender) of a mention; lead and tail are literal text about the part.

    Kinds are told in the order of the pattern's alternatives, the address last, so a secret with an @ is one secret.
    """
    part = lambda lead, kind, norm, raw, tail="''", gender="'n'": f"named_struct('lead', {lead}, 'kind', {kind}, 'norm', {norm}, 'raw', {raw}, 'tail', {tail}, 'gender', {gender})"
    like = lambda pattern: f"{m} RLIKE {_quote(f'^(?:{pattern})$')}"
    digits = f"regexp_replace(replace({m}, '(0)', ''), '[^0-9]', '')"  # a trunk digit is format
    title = f"regexp_extract({m}, {_quote('(?U)^([^. ]+)[.]? ')}, 1)"
    front = f"regexp_extract({m}, {_quote('^[^ ]+ ')}, 0)"
    pieces = f"regexp_extract_all(substring({m}, length({front}) + 1), {_quote(_PIECE)}, 0)"
    # the last word without a genitive, which stays
    word, tail = (f"regexp_extract(w, {_quote(_LAST_WORD)}, {i})" for i in (1, 2))
    lead = f"concat(if(i = 0, {front}, ' '), substring(w, 1, length(w) - length({word}) - length({tail})))"
    name = part(lead, "if(i = size(ws) - 1, 'surname', 'given')", f"lower({word})", word, tail, _gender(title))
    return f"""CASE
      WHEN {like(f"{_OCTET}(?:[.]{_OCTET}){{3}}")} THEN array({part("''", "'ip'", m, m)})
      WHEN {like(_IP6_BODY)} THEN array({part("''", "'ip6'", f"lower({m})", m)})
      WHEN {like("[0-9a-f]{32,}|[0-9A-F]{32,}")} THEN array({part("''", "'hex'", f"lower({m})", m)})
      WHEN {like(_IBAN_BODY)} THEN array({part("''", "'iban'", f"replace({m}, ' ', '')", m)})
      WHEN {like("[0-9]{3}-[0-9]{2}-[0-9]{4}")} THEN array({part("''", "'ssn'", digits, m)})
      WHEN {m} RLIKE {_quote(r"^[+(]|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")} AND {like("[-+(). 0-9]+")} AND length({digits}) >= 6
        THEN array({part("''", "'phone'", f"concat(if({m} LIKE '+%', '+', ''), {digits})", m)})
      WHEN {like("[0-9][ 0-9-]+")} AND length({digits}) >= 13 THEN array({part("''", "'card'", digits, m)})
      WHEN {like(r"\p{IsHan}+")} THEN array({part("''", "'han'", m, m)})
      WHEN {like(_NAME)} THEN transform({pieces}, (w, i) -> {name.replace("size(ws)", f"size({pieces})")})
      WHEN {like(_EMAIL)} THEN array(
        {part("''", "'email'", f"lower({m})", f"substring_index({m}, '@', 1)")},
        {part("'@'", "'domain'", f"lower(substring_index({m}, '@', -1))", f"substring_index({m}, '@', -1)")})
      ELSE array({part("''", "'secret'", m, m)}) END"""


def _bytes(n: int | str, label: str = "") -> str:
    """SQL: hex digits of a keyed hash of the part and its draw."""
    return f"sha2(concat(__secret, '|{label}{n}|', kind, '|', norm, '|', cast(draw as string)), 512)"


#: SQL: enough hex digits of keyed hashes for every position of a part's surrogate; made once, so that expressions stay small.
_HEX = "array_join(transform(sequence(0, (length(norm) + draw + 80) div 32), b -> sha2(concat(__secret, '|c', cast(b as string), '|', kind, '|', norm, '|', cast(draw as string)), 512)), '')"


def _at(i: str) -> str:
    """SQL: a number 0 to 65535 for position i (from 0) of the part."""
    return f"cast(conv(substring(__hex, 4 * ({i}) + 1, 4), 16, 10) as int)"


def _array(items: list[str]) -> str:
    return f"array({', '.join(repr(x) for x in items)})"


def _pick(items: list[str], i: int) -> str:
    return f"{_array(items)}[{_at(str(i))} % {len(items)}]"


def _syllables(script: str) -> str:
    items = SCRIPTS[script][1]
    return f"array_join(transform(sequence(1, 2 + draw), k -> {_array(items)}[{_at('k')} % {len(items)}]), '')"


def _by_script(made: dict[str, str]) -> str:
    """SQL: the case of the script that norm is written in."""
    return "CASE " + " ".join(f"WHEN norm RLIKE '{SCRIPTS[k][0]}' THEN {v}" for k, v in made.items() if k != "latin") + f" ELSE {made['latin']} END"


def _surname(script: str) -> str:
    *others, (_, last) = SCRIPTS[script][2]
    ending = "CASE " + " ".join(f"WHEN norm RLIKE '{p}' THEN '{e}'" for p, e in others) + f" ELSE '{last}' END" if others else f"'{last}'"
    return f"concat({_syllables(script)}, {ending})"


def _given(gender: int) -> str:
    names = {"latin": (MALE_GIVEN, FEMALE_GIVEN), "cyrillic": (MALE_GIVEN_CYRILLIC, FEMALE_GIVEN_CYRILLIC)}
    made = {k: f"concat({_syllables(k)}, '{ends[gender]}')" for k, ends in GIVEN_ENDINGS.items()}
    made |= {k: f"if(draw < 2, lower({_pick(n[gender], 0)}), {made[k]})" for k, n in names.items()}
    return _by_script(made)


#: Country codes of one and of two digits; all others have three.
_COUNTRY = "if(norm RLIKE '^[+][17]', 1, if(norm RLIKE '^[+](20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])', 2, 3))"
#: Scripts of letters that a masked text keeps: class, first letter and how many follow one another.
_LETTERS = [
    ("[0-9]", 48, 10), ("[A-Z]", 65, 26), ("[a-z]", 97, 26), ("[а-яё]", 0x430, 32), ("[А-ЯЁ]", 0x410, 32), ("[α-ωά-ώ]", 0x3B1, 25), ("[Α-ΩΆ-Ώ]", 0x391, 17), ("\\\\p{IsHan}", 0x4E00, 20000),
    ("\\\\p{IsArabic}", 0x641, 10), ("\\\\p{IsHebrew}", 0x5D0, 27), ("\\\\p{IsDevanagari}", 0x915, 37), ("\\\\p{IsHangul}", 0xAC00, 11172), ("\\\\p{IsHiragana}", 0x3041, 86), ("\\\\p{IsKatakana}", 0x30A1, 90),
]


def _luhn(digits: str) -> str:
    """SQL: the check digit after a string of digits."""
    twice = f"if((length({digits}) - i) % 2 = 1, 2, 1) * cast(c as int)"
    return f"cast((10 - aggregate(transform(split({digits}, ''), (c, i) -> {twice}), 0L, (a, x) -> a + x div 10 + x % 10) % 10) % 10 as string)"


def _mod97(text: str) -> str:
    """SQL: an account number in checking order, letters as 10 to 35, modulo 97."""
    return f"aggregate(split({text}, ''), 0, (a, c) -> if(c RLIKE '[0-9]', (a * 10 + cast(c as int)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def surrogate_sql() -> str:
    """SQL: the surrogate of (kind, norm, gender, draw) under the key __secret, with its hex digits __hex, in normal form."""
    letters = lambda first, n: f"char({first} + {_at('k')} % {n})"
    wide = lambda a, n: f"decode(unhex(lpad(hex({a} + {_at('k')} % {n}), 4, '0')), 'UTF-16BE')"
    local = "substring_index(norm, '@', 1)"
    known = " ".join(f"WHEN c RLIKE '{p}' THEN {letters(a, n) if a < 128 else wide(a, n)}" for p, a, n in _LETTERS)
    masked = f"CASE {known} WHEN c RLIKE '\\\\p{{L}}' THEN {letters(97, 26)} WHEN c RLIKE '\\\\p{{N}}' THEN {letters(48, 10)} ELSE c END"
    mask = lambda text: f"array_join(transform(split({text}, ''), (c, k) -> {masked}), '')"
    # spaces of fixed size grow after some draws, by what stands beyond the mention's own digits
    longer = f"greatest(0, draw - {FIXED_DRAWS})"
    digits = lambda n: f"array_join(transform(sequence(1, {n}), k -> {letters(48, 10)}), '')"
    bare = "if(norm LIKE '+%', substring(norm, 2), norm)"
    phone = f"if(norm LIKE '+%', concat(substring(norm, 2, {_COUNTRY}), {digits(f'length(norm) - 1 - {_COUNTRY} + {longer}')}), {digits(f'length({bare}) + {longer}')})"
    card = f"transform(array({digits(f'length(norm) - 1 + {longer}')}), d -> concat(d, {_luhn('d')}))[0]"
    account = f"""transform(array(concat({mask('substring(norm, 5)')}, if(draw > {FIXED_DRAWS}, {digits(longer)}, ''))),
        b -> concat(substring(norm, 1, 2), lpad(cast(98 - {_mod97("concat(b, substring(norm, 1, 2), '00')")} as string), 2, '0'), b))[0]"""
    # a local part or secret of one or two letters has a small space, so later draws grow by a letter each
    grow = f"if(draw = 0, '', array_join(transform(sequence(64, 63 + draw), k -> {letters(97, 26)}), ''))"
    nameless = f"array_join(transform(split({local}, ''), (c, k) -> {letters(97, 26)}), '')"
    tail = "translate(substring(" + _bytes(0, "d") + ", 1, 10), '0123456789', 'ghijkmnpqr')"
    octets = lambda a: f"array_join(transform(sequence({a}, 3), k -> cast({_at('k')} % 256 as string)), '.')"
    # private networks stay private, until their few addresses are drawn out; then any, then longer ones
    address = f"""CASE WHEN draw > {2 * FIXED_DRAWS} THEN concat({octets(0)}, '.', {digits(f'draw - {2 * FIXED_DRAWS}')}) WHEN draw > {FIXED_DRAWS} THEN {octets(0)}
        WHEN norm LIKE '10.%' OR norm LIKE '127.%' THEN concat(substring_index(norm, '.', 1), '.', {octets(1)}) WHEN norm LIKE '192.168.%' THEN concat('192.168.', {octets(2)})
        WHEN norm RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN concat('172.', cast(16 + {_at('0')} % 16 as string), '.', {octets(2)}) ELSE {octets(0)} END"""
    han = f"concat({_pick(HAN_SURNAMES, 0)}, array_join(transform(sequence(1, length(norm) - 1 + draw div 3), k -> {_array(HAN_GIVEN)}[{_at('k')} % {len(HAN_GIVEN)}]), ''))"
    prefix = "regexp_extract(norm, '^(AKIA|gh[pousr]_|sk-(proj-|live-|test-)?|)', 1)"
    groups = f"array_join(transform(sequence(0, length(replace(norm, ':', '')) - 1 + {longer}), k -> lower(hex({_at('k')} % 16))), '')"
    return f"""CASE kind
      WHEN 'email' THEN concat(if({local} RLIKE '[\\\\p{{L}}\\\\p{{N}}]', {mask(local)}, {nameless}), {grow})
      WHEN 'domain' THEN concat({tail}, '.example')
      WHEN 'ip' THEN {address}
      WHEN 'ip6' THEN {groups}
      WHEN 'hex' THEN substring(array_join(transform(sequence(0, (length(norm) - 1) div 128), b -> {_bytes("' || b || '")}), ''), 1, length(norm))
      WHEN 'phone' THEN {phone} WHEN 'card' THEN {card} WHEN 'ssn' THEN {digits(f'length(norm) + {longer}')}
      WHEN 'iban' THEN {account}
      WHEN 'surname' THEN {_by_script({k: _surname(k) for k in SCRIPTS})}
      WHEN 'given' THEN CASE gender WHEN 'm' THEN {_given(0)} WHEN 'f' THEN {_given(1)}
        ELSE {_by_script({k: f"concat({_syllables(k)}, '{'i' if k == 'latin' else ''}')" for k in SCRIPTS})} END
      WHEN 'han' THEN {han}
      ELSE concat({prefix}, {mask(f'substring(norm, length({prefix}) + 1)')}, {grow}) END"""


def rendered_sql() -> str:
    """SQL: surrogate ``sur`` in the format of the mention's part ``raw``; what is longer goes to the end."""

    def fill(chars: str, raw: str = "raw") -> str:
        return f"""aggregate(split({raw}, ''), named_struct('i', 1, 'out', ''),
        (a, c) -> if(c RLIKE '{chars}', named_struct('i', a.i + 1, 'out', concat(a.out, substring(sur, a.i, 1))),
                     named_struct('i', a.i, 'out', concat(a.out, c))), a -> concat(a.out, substring(sur, a.i)))"""

    return f"""CASE WHEN kind = 'phone' THEN replace({fill('[0-9]', "replace(raw, '(0)', '(~)')")}, '(~)', '(0)')
      WHEN kind IN ('card', 'ssn', 'iban') THEN {fill('[0-9A-Z]')}
      WHEN kind = 'ip6' THEN if(raw = lower(raw), {fill('[0-9A-Fa-f]')}, upper({fill('[0-9A-Fa-f]')}))
      WHEN kind IN ('email', 'domain', 'hex') AND raw = upper(raw) AND raw <> lower(raw) THEN upper(sur)
      WHEN kind IN ('surname', 'given') THEN if(raw = upper(raw) AND length(raw) > 2, upper(sur), initcap(sur))
      ELSE sur END"""


def _in_its_space() -> str:
    """SQL: a real part as the surrogates of its kind are written."""
    return "CASE kind WHEN 'email' THEN substring_index(norm, '@', 1) WHEN 'phone' THEN if(norm LIKE '+%', substring(norm, 2), norm) WHEN 'ip6' THEN replace(norm, ':', '') ELSE norm END"


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, sur) for distinct (kind, norm): injective within a kind, never a part itself.

    A given name that comes with titles of one gender more often than of the other has that gender, whatever titles it also has.
    """
    lean = F.sum(F.when(F.col("gender") == "m", 1).when(F.col("gender") == "f", -1).otherwise(0))
    told = F.when(lean > 0, "m").when(lean < 0, "f").otherwise("n")
    found = checkpointed(parts.groupBy("kind", "norm").agg(told.alias("gender")))
    draw = staged(_drawn(found.withColumn("draw", F.lit(0)), key), "drawn")
    taken = found.select("kind", F.expr(_in_its_space()).alias("sur")).distinct().withColumn("real", F.lit(True))
    while True:
        owners = draw.groupBy("kind", "sur").agg(F.min("norm").alias("owner"), F.count("*").alias("n")).where("n > 1")
        judged = draw.join(owners, ["kind", "sur"], "left").join(taken, ["kind", "sur"], "left")
        again = F.coalesce(F.col("real"), F.lit(False)) | (F.coalesce(F.col("n"), F.lit(1)) > 1) & (F.col("owner") != F.col("norm"))
        # written, not checkpointed: a checkpoint hands on estimated sizes, which multiply from draw to draw
        judged = staged(judged.select("kind", "norm", "gender", "draw", "sur", again.alias("again")), "judged")
        if not judged.where("again").limit(1).count():
            return draw.select("kind", "norm", "sur")
        redrawn = _drawn(judged.where("again").select("kind", "norm", "gender", (F.col("draw") + 1).alias("draw")), key)
        draw = staged(judged.where("NOT again").select("kind", "norm", "gender", "draw", "sur").unionByName(redrawn), "drawn")


def _drawn(parts: DataFrame, key: str) -> DataFrame:
    keyed = parts.withColumn("__secret", F.lit(key)).withColumn("__hex", F.expr(_HEX))
    return keyed.withColumn("sur", F.expr(surrogate_sql())).select("kind", "norm", "gender", "draw", "sur")


def pseudonymise(docs: DataFrame, key: str, entities: str | None = None) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; other columns and all rows stay.

    Null and empty texts stay as they are. Row order isn't kept. ``entities`` names an added column with
    the number of mentions replaced. Repeated rows are replaced alike. The same key gives the same
    surrogates for the same set of parts; a part redrawn after a collision may differ between corpora. An empty table gives
    an empty result; columns of any names, also of those used here, and texts of any length are taken as they are. Names are
    found after a title only.
    """
    struct = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    text = F.col("text").cast("string")
    found = F.when(may_hold_mentions(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(struct, text.alias("__text"), found.alias("__found"))
    clean = rows.where("coalesce(size(__found), 0) <= 0").select("__row", F.lit(0).cast("long").alias("__n"))
    hits = staged(rows.where("size(__found) > 0").withColumn("__uid", F.monotonically_increasing_id()), "mentions")
    parts = checkpointed(
        hits.select("__uid", F.posexplode("__found").alias("pos", "m"))
        .select("__uid", "pos", F.posexplode(F.expr(parts_sql("m"))).alias("sub", "p"))
        .select("__uid", "pos", "sub", "p.*")
    )
    sur = surrogate_table(parts, key)
    made = parts.join(sur, ["kind", "norm"]).select("__uid", "pos", "sub", F.expr(f"concat(lead, {rendered_sql()}, tail)").alias("out"))
    # the parts of one text, of which it already holds the mentions
    lists = made.groupBy("__uid").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "out"))).alias("outs"))
    by_mention = F.expr("transform(sequence(0, size(__found) - 1), i -> array_join(transform(filter(outs, o -> o.pos = i), o -> o.out), ''))")
    gaps = F.split("__text", PATTERN, -1)
    text_out = F.expr("concat(array_join(zip_with(slice(gaps, 1, size(news)), news, (g, s) -> concat(g, s)), ''), element_at(gaps, -1))")
    rebuilt = (
        hits.join(lists, "__uid")
        .select("__row", "__text", by_mention.alias("news"), gaps.alias("gaps"))
        .select(F.col("__row").withField("text", text_out).alias("__row"), F.size("news").cast("long").alias("__n"))
    )
    out = clean.union(rebuilt)
    return out.select("__row.*", F.col("__n").alias(entities)) if entities else out.select("__row.*")
