"""String formats and patterns, as Columns and, for the interpreter, as Python functions of one text.

Each format is a conjunction of regular expressions and of bounds on lengths, so both sides are made from one table.
Dates are checked against the calendar by arithmetic on their parts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.types import ContractError

LONGEST_SUBJECT = 10_000
LONGEST_PATTERN = 1024

# Grammar fragments from the standards each format is named after.
_LABEL = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)"
_U = r"[\p{L}\p{N}]"
_ULABEL = rf"(?:{_U}(?:(?:{_U}|-){{0,61}}{_U})?)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_DAY = r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])"
_CLOCK = r"(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:[Zz]|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
_BLANK = r"\t\n\x0b\f\r\u0020\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_BREAK = r"\n\r\u2028\u2029"
_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
_DELIMITERS = r"<>\"{}|\\^`"
_VARIABLE = r"(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2})(?:\.?(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2}))*(?::[1-9][0-9]{0,3}|\*)?"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Schemes that a URL cannot consist of alone, since they need a host.
_HOSTED = ["http:", "https:", "ws:", "wss:", "ftp:"]
# What comes after the slashes of a reference that names a host: user, host, port.
_PORT = r"(?::(?:6553[0-5]|655[0-2][0-9]|65[0-4][0-9]{2}|6[0-4][0-9]{3}|[1-5]?[0-9]{0,4}|0+[0-9]{1,4}))?"
_HOST = r"(?:(?:[^\x00-\x20#/:<>?@\[\\\]^|%\x7f]|%[2-7][0-9A-Fa-f]|%[89A-Fa-f][0-9A-Fa-f])+|\[[0-9A-Fa-f:.]+\])"
_AUTHORITY = rf"[/\\]{{2,}}(?:[^/\\?#]*@)?{_HOST}{_PORT}(?:[/\\?#].*)?"

#: Whole-text expressions; all of a format's have to match. Possessive or look-around forms are left out, so both engines agree.
FORMATS: dict[str, list[str]] = {
    "email": [r"[^@]{1,64}@[^@]+", r"[^.@](?:[^@]*[^.@])?@.*", r"(?:[^.@]|\.[^.])+@.*", r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@.*", rf"[^@]+@(?:{_LABEL}\.)+[A-Za-z]{{2,63}}", r"(?s).{1,254}"],
    "idn-email": [r"[^@]{1,64}@[^@]+", r"[^.@](?:[^@]*[^.@])?@.*", r"(?:[^.@]|\.[^.])+@.*", r"[\p{L}\p{N}.!#$%&'*+/=?^_`{|}~-]+@.*", rf"[^@]+@(?:{_ULABEL}\.)+\p{{L}}{{2,63}}", r"(?s).{1,254}"],
    "uuid": [r"(?:[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[1-8][0-9A-Fa-f]{3}-[89ABab][0-9A-Fa-f]{3}-[0-9A-Fa-f]{12}|0{8}-0{4}-0{4}-0{4}-0{12})"],
    # A scheme, two characters of which only the second may be blank, and no blank behind them.
    "url": [r"(?is)(?:https?|ftp)://.+", rf"(?s)[^:]+:[^:]{{2}}[^{_BLANK}/$.?#].*", rf"(?s)[^:]+:[^:]{{2}}.[^{_BREAK}][^{_BLANK}]*"],
    "ipv4": [_V4],
    "date": [_DAY],
    "date-time": [rf"{_DAY}[Tt]{_CLOCK}"],
    "byte": [r"(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?"],
    "password": [r"(?s).*"],
    "hostname": [rf"(?i:localhost)|(?:{_LABEL}\.)+[A-Za-z]{{2,63}}", r".{1,253}"],
    "idn-hostname": [rf"(?i:localhost)|(?:{_ULABEL}\.)+\p{{L}}{{2,63}}", r".{1,253}"],
    "uri": [rf"{_SCHEME}[^{_BLANK}{_DELIMITERS}]*", r"(?s)(?!(?i:https?|wss?|ftp):\z).*"],
    "iri": [rf"(?s){_SCHEME}[^{_BLANK}]+", r"[^\x00-\x1f\x7f]*"],
    "uri-template": [rf"(?:[^{{}}{_BLANK}]|\{{[+#./;?&=,!@|]?{_VARIABLE}(?:,{_VARIABLE})*\}})+"],
    "time": [_CLOCK],
    "duration": [r"P(?:[0-9]+[YMWD]|T[0-9]+[HMS]).*", r"P(?:[0-9]+Y)?(?:[0-9]+M)?(?:[0-9]+W)?(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?", r".*[A-Z]", r".*[^T]"],
    "objectId": [r"[0-9A-Fa-f]{24}"],
}
#: Formats of which one of several expressions has to match.
_CHOICES: dict[str, list[str]] = {
    # Empty, a URI, or relative: no delimiters and, where it names a host, a host that can be one.
    "uri-reference": ["", rf"{_SCHEME}[^{_BLANK}{_DELIMITERS}]+", rf"(?!(?i:https|wss?|ftp):\z)(?!//)[^{_BLANK}{_DELIMITERS}]*", rf"(?!.*[{_BLANK}{_DELIMITERS}]){_AUTHORITY}"],
    "iri-reference": ["", rf"[^{_BLANK}{_DELIMITERS}\x00-\x1f\x7f]+", rf"(?![/\\][/\\])[^{_BLANK}\x00-\x1f\x7f]+", rf"(?!.*[{_BLANK}\x00-\x1f\x7f]){_AUTHORITY}"],
    # An IPv4 tail behind at most four groups, or a zone behind link-local ones.
    "ipv6": [rf"(?:{_HEX}:){{1,4}}:{{V4}}", r"::(?:ffff:(?:0{1,4}:)?)?{V4}", "fe80:(?::[0-9A-Fa-f]{0,4}){0,4}%[0-9A-Za-z]+"],
}
_CHOICES["ipv6"] = [x.replace("{V4}", r"(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?!\z)|\z)){4}") for x in _CHOICES["ipv6"]]


def _groups_column(c: Column) -> Column:
    """IPv6 in groups: eight, or at most seven on the two sides of one '::'."""
    groups = lambda side: F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))
    sides = F.split(c, "::")
    right = lambda xs: F.forall(xs, lambda x: x.rlike(rf"\A{_HEX}\z"))
    count = F.size(groups(sides[0])) + F.when(F.size(sides) == 2, F.size(groups(F.get(sides, F.lit(1))))).otherwise(0)
    whole = (F.size(sides) == 1) & (count == 8) & right(groups(sides[0]))
    split = (F.size(sides) == 2) & (count <= 7) & right(groups(sides[0])) & right(groups(F.get(sides, F.lit(1))))
    return F.coalesce(whole, F.lit(False)) | F.coalesce(split, F.lit(False))


def _has_groups(text: str) -> bool:
    sides = [side.split(":") if side else [] for side in text.split("::")]
    count = sum(map(len, sides))
    return (len(sides) == 1 and count == 8 or len(sides) == 2 and count <= 7) and all(re.fullmatch(_HEX, g) for side in sides for g in side)


def _whole(source: str) -> str:
    return r"\A(?:" + source + r")\z"


def known(name: str) -> bool:
    return name in FORMATS or name in _CHOICES or name == "regex"


def format_column(name: str, c: Column) -> Column:
    """Whether a text has the format; of an unknown format none has it."""
    if name == "regex":
        return _regex_udf()(c)
    if name in _CHOICES:
        ok = F.lit(False)
        for source in _CHOICES[name]:
            ok = ok | (c.rlike(_whole(source)) if source else c == "")
        return ok | _groups_column(c) if name == "ipv6" else ok
    if name not in FORMATS:
        return F.lit(False)
    ok = F.lit(True)
    for source in FORMATS[name]:
        ok = ok & c.rlike(_whole(source))
    if name in ("date", "date-time"):
        ok = ok & (F.substring(c, 9, 2).try_cast("int") <= _last_day(F.substring(c, 1, 4).try_cast("int"), F.substring(c, 6, 2).try_cast("int")))
    return ok


def _last_day(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def has_format(name: str, text: str) -> bool:
    if name == "regex":
        return safe_pattern(text)
    import calendar

    import regex

    matches = lambda source: regex.match(_whole(source).replace(r"\z", r"\Z"), text) is not None
    if name in _CHOICES:
        return any(map(matches, _CHOICES[name])) or (name == "ipv6" and _has_groups(text))
    if name not in FORMATS or not all(map(matches, FORMATS[name])):
        return False
    return name not in ("date", "date-time") or int(text[8:10]) <= (calendar.monthrange(int(text[:4]), int(text[5:7]))[1] if int(text[:4]) else (29 if text[5:7] == "02" else 31 - (text[5:7] in ("04", "06", "09", "11"))))


def _regex_udf():
    @F.pandas_udf("boolean")
    def compiles(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else safe_pattern(t))

    return compiles


@dataclass
class _Group:
    """A group of a pattern: what stands in it, groups within groups not counted, and whether it is repeated."""

    parts: list[_Group] = field(default_factory=list)
    repeats: bool = False
    chooses: bool = False
    repeated: bool = False

    def all(self):
        yield self
        for part in self.parts:
            yield from part.all()


def _tree(source: str) -> _Group:
    """The groups of a pattern; escapes and classes are passed over, braces count as repetitions."""
    top = _Group()
    inside, closed = [top], None
    for token in re.findall(r"\\.?|\[(?:\\.|[^\]\\])*\]?|.", source, re.S):
        if token in ("*", "+", "{"):
            inside[-1].repeats = True
            if closed:
                closed.repeated = True
        elif token == "|":
            inside[-1].chooses = True
        elif token == "(":
            inside[-1].parts.append(_Group())
            inside.append(inside[-1].parts[-1])
        closed = inside.pop() if token == ")" and len(inside) > 1 else None
    return top


def safe_pattern(source: str) -> bool:
    """Whether a pattern compiles and has no form that can take exponential time: not over LONGEST_PATTERN
    characters, no numbered back-reference, no repeated group that holds a repetition or a choice of its own."""
    if len(source) > LONGEST_PATTERN or re.search(r"\\[1-9]", source):
        return False
    if any(g.repeated and (g.repeats or g.chooses) for g in _tree(source).all()):
        return False
    try:
        re.compile(python_pattern(source))
    except re.error:
        return False
    return True


def java_pattern(source: str) -> str:
    """A JavaScript pattern for Java: $ is the very end, \\s knows Unicode blanks, named groups are the same."""
    if not safe_pattern(source):
        raise ContractError(f"unsafe pattern {source!r}")
    return _translate(source, r"\z")


def python_pattern(source: str) -> str:
    return _translate(source, r"\Z").replace("(?<", "(?P<").replace("(?P<=", "(?<=").replace("(?P<!", "(?<!")


def _translate(source: str, end: str) -> str:
    blanks = _BLANK
    out, k, in_class = [], 0, False
    while k < len(source):
        c, pair = source[k], source[k : k + 2]
        if c == "\\":
            out.append((blanks if in_class else f"[{blanks}]") if pair == r"\s" else f"[^{blanks}]" if pair == r"\S" and not in_class else "/" if pair == r"\/" else "[0-9]" if pair == r"\d" and not in_class else "0-9" if pair == r"\d" else pair)
            k += 2
            continue
        if in_class and c == "[":
            out.append(r"\[")
        elif not in_class and c == "$":
            out.append(end)
        else:
            out.append(c)
        in_class = (c == "[") or (in_class and c != "]")
        k += 1
    return "".join(out)
