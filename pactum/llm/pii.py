"""PII by candidate gradient boosting, in DataFrame functions only.

Base spans are those of four fixed patterns that pass their check (octets, Luhn, number of digits); they always count.
Generators of high recall propose more spans, which may overlap: written-out e-mail addresses, whole and compressed IPv6
addresses, card-like runs of digits in groups of any kind, phone-like ones in groups or unbroken. Each has features of its format and of the text around it; boosted trees, fitted here and
compiled to CASE expressions, score it, and a threshold for its kind, calibrated on examples the trees did not see, decides.

The trees are fitted on examples made by rule with a fixed seed, not on the corpus, so the model is the same for every
input; their features come from the same expressions. Rows never meet: there is no shuffle, and no UDF. The work on a
text grows with its length and, but for a logarithm, with the number of its spans.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
# The base patterns, written so that a failed start is not tried again inside the same run (Java syntax; the matches are the same).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_V6 = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
GENERATORS = {
    "email": [r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]\x20?(?:at|AT|@)\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]\x20?(?:dot|DOT|\.)\x20?[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++"],
    "ip": [r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Za-z:])", rf"(?<![0-9A-Za-z:.])(?:{_V6})?::(?:{_V6})?(?![0-9A-Za-z:])"],
    "card": [r"(?<![0-9])[0-9]{4}(?:[\x20._-]{1,3}[0-9]{4}){3}(?![0-9])", r"(?<![0-9])[0-9]{2,6}(?:[\x20._-]{1,3}[0-9]{2,6}){2,5}(?![0-9])"],
    "phone": [
        r"(?<![0-9A-Za-z+])(?:\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,4}){1,3}|00[1-9][0-9]{8,12})(?![0-9])",
        r"(?<![0-9A-Za-z+.,/-])\(?[0-9]{2,5}\)?(?:[\x20/-][0-9]{2,8}){1,4}(?![0-9A-Za-z/-])",
        r"(?<![0-9A-Za-z+.,/-])[0-9]{7,15}(?![0-9A-Za-z/-])",
    ],
}
NEAR = 28
#: Words whose presence just before or after a span is a feature.
CUES = {
    "cue_email": "mail|contact|write|kontakt|courriel|correo",
    "cue_phone": "phone|tel|call|mobil|fax|ruf|appel|llam|whatsapp|dial",
    "cue_card": "card|visa|master|amex|credit|karte|carte|tarjeta|payment|iban",
    "cue_ip": "ip|host|server|address|ping|login|addr",
    "cue_other": "isbn|order|invoice|version|part|page|ticket|score|chapter|date|figure|total|serial|ref|no\\.|item|ratio",
}
FEATURES = ["kind", "chars", "digits", "seps", "groups", "longest", "letters", "bracket", "paren", "plain_dot", "luhn", "tld", "zeros", "distinct", "before", "after", *CUES]
TREES, DEPTH, SHRINK, LEAST_LEAF = 30, 3, 0.3, 5
PRECISION = 0.99


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


_BLOCK = 256
#: Code points in a piece of a text.
PIECE = 1024


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, so that a place in it costs the same wherever it is."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, size: Column) -> Column:
    """At most PIECE code points of a text in pieces."""
    k = F.floor(start / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(parts, k), F.lit("")), F.coalesce(F.get(parts, k + 1), F.lit("")))
    return F.substring(both, (start - k * PIECE + 1).cast("int"), size.cast("int"))


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of a pattern, leftmost and without overlap, in code points.

    Spark gives the matches and the pieces between them, not places; places are running sums of the lengths, taken in
    blocks so that many matches stay cheap.
    """
    kind = "array<struct<start:int,end:int,match:string>>"
    none = F.array().cast(kind)

    def place(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda m, b: F.struct(m.alias("m"), F.length(b).alias("gap"), F.length(m).alias("size")))
        sums = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)), F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
        # What lies before each block.
        ahead = lambda blocks: F.aggregate(blocks, F.array(F.lit(0)), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y)))
        return let(pairs, lambda p: let(ahead(sums(p)), lambda blocks: F.transform(p, lambda x, i: at(p, blocks, x, i))))

    def at(p: Column, blocks: Column, x: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        ahead = F.get(blocks, block) + F.aggregate(F.slice(p, block * _BLOCK + 1, i - block * _BLOCK), F.lit(0), lambda s, y: s + y["gap"] + y["size"])
        return let(ahead + x["gap"], lambda start: F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["m"].alias("match")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, place(found)).otherwise(none))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    def doubled(d: Column) -> Column:
        return F.when(d > 4, 2 * d - 9).otherwise(2 * d)

    def total(digits: Column) -> Column:
        values = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(i.alias("i"), F.substring(F.reverse(digits), i, F.lit(1)).cast("int").alias("d")))
        return F.aggregate(values, F.lit(0), lambda s, x: s + F.when(x["i"] % 2 == 0, doubled(x["d"])).otherwise(x["d"]))

    return let(_digits(match), lambda d: (F.length(d) > 0) & (total(d) % 10 == 0))


def _octets(match: Column) -> Column:
    small = lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255")))
    return F.forall(F.split(match, r"\."), small)


VALID = {
    "email": lambda m: F.lit(True),
    "ip": _octets,
    "card": lambda m: let(F.length(_digits(m)), lambda n: n.between(13, 19)) & luhn(m),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind]), lambda s: VALID[kind](s["match"]))


def features(parts: Column, kind: int, span: Column) -> Column:
    """A struct of the features of a span of a text in pieces; the text around it is NEAR characters on each side, less
    at the ends."""
    m = span["match"]
    size = lambda pattern: F.length(F.regexp_replace(m, pattern, ""))
    low = F.greatest(span["start"] - NEAR, F.lit(0))
    before, after = F.lower(cut(parts, low, span["start"] - low)), F.lower(cut(parts, span["end"], F.lit(NEAR)))
    flag = lambda c: c.cast("int")
    groups = F.split(F.regexp_replace(m, "^[^0-9]+|[^0-9]+$", ""), "[^0-9]+")
    return let(F.struct(before.alias("b"), after.alias("a")), lambda near: F.struct(
        F.lit(kind).alias("kind"), F.length(m).alias("chars"), size("[^0-9]").alias("digits"), size("[0-9A-Za-z]").alias("seps"), F.size(groups).alias("groups"),
        F.array_max(F.transform(groups, lambda g: F.length(g))).alias("longest"), size("[^A-Za-z]").alias("letters"), flag(m.rlike(r"[\[(] ?(?:at|AT|@|dot|DOT|\.)")).alias("bracket"), flag(m.rlike(r"\(")).alias("paren"),
        flag(m.rlike(r" at [^ ]*\.")).alias("plain_dot"), flag(luhn(m)).alias("luhn"), flag(m.rlike(r"(?i)(?:com|org|net|edu|gov|info|example|de|fr|es|io|co|uk)$")).alias("tld"), flag(m.rlike("^0")).alias("zeros"),
        F.size(F.array_distinct(F.split(_digits(m), ""))).alias("distinct"), flag(near["b"].rlike(r"[0-9A-Za-z#$%/=.,_-]$")).alias("before"), flag(near["a"].rlike(r"^[0-9A-Za-z%/=_-]")).alias("after"),
        *(flag(near["b"].rlike(rf"(?:{p})\.?[^.!?]*$")).alias(c) for c, p in CUES.items()),
    ))


# --- the examples, the trees and their thresholds -------------------------------------------------------------------


def _luhn_ended(digits: str) -> str:
    """The digits and the one that makes them pass."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def _examples(seed: int = 11, each: int = 160) -> list[tuple[str, str, int]]:
    """(kind, text with the span between two \x02 marks, label): formats of personal data, and their look-alikes."""
    rnd = random.Random(seed)
    pick, num = rnd.choice, lambda n: "".join(rnd.choice("0123456789") for _ in range(n))
    names, hosts, ends = ["anna", "j.smith", "maria_k", "info", "p-meyer", "luis99", "office"], ["mail", "example", "my-firm", "uni", "web4"], ["com", "org", "net", "de", "fr", "es"]
    filler = ["the report of", "we then saw", "on the way", "und das ist", "pour le reste", "como siempre", "it was said that", "meeting", ""]

    def card(valid: bool) -> str:
        while True:
            d = pick("3456") + num(15)
            ok = sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
            if ok == valid:
                return pick([". ", " - ", "_", "."]).join(d[k : k + 4] for k in range(0, 16, 4))

    out = []
    for _ in range(each):
        f, n = pick(filler), pick(filler)
        at, dot = pick([" (at) ", " [at] ", "(at)", "[at]", " at "]), pick([" (dot) ", " [dot] ", "[dot]", " dot "])
        out.append(("email", f"{f} {pick(['', 'mail: ', 'contact ', 'write to '])}\x02{pick(names)}{at}{pick(hosts)}{dot}{pick(ends)}\x02 {n}", 1))
        out.append(("email", f"{f} {pick(['contact ', 'mail '])}\x02{pick(names)}{pick([' (at) ', '[at]'])}{pick(hosts)}.{pick(ends)}\x02 {n}", 1))
        out.append(("email", f"{f} \x02{pick(['look', 'met', 'arrived', 'was', 'held', 'sat'])} at {pick(['home', 'noon', 'work', 'night', 'last', '10', 'school'])}.{pick(['The', 'Then', '30', 'We', 'And', 'It'])}\x02 {n}", 0))
        hexes = ":".join("%x" % rnd.randrange(65536) for _ in range(8))
        out.append(("ip", f"{f} {pick(['ip ', 'host ', 'server ', 'address '])}\x02{hexes}\x02 {n}", 1))
        short = pick(["::1", f"fe80::{rnd.randrange(1, 65536):x}", f"2001:db8::{rnd.randrange(65536):x}:{rnd.randrange(65536):x}", f"2001:db8:{rnd.randrange(65536):x}::{rnd.randrange(1, 65536):x}"])
        out.append(("ip", f"{f} {pick(['ip ', 'host ', 'server ', 'address ', 'ping '])}\x02{short}\x02 {n}", 1))
        out.append(("ip", f"{f} {pick(['std', 'use ', 'call ', 'a ', 'see '])}\x02{pick(['::', 'a::b', 'de::ad', 'c::d', 'bad::f'])}\x02{pick(['', ' '])}{n}", 0))
        out.append(("ip", f"{f} {pick(['', 'ratio ', 'score ', 'at ', 'date '])}\x02{':'.join(num(pick([1, 2])) for _ in range(4))}\x02 {n}", 0))
        out.append(("card", f"{f} {pick(['card ', 'visa ', 'credit card: ', 'payment by ', ''])}\x02{card(True)}\x02 {n}", 1))
        out.append(("card", f"{f} {pick(['serial ', 'order ', 'ref ', 'part ', 'item ', ''])}\x02{card(False)}\x02 {n}", 0))
        amex = _luhn_ended("3" + pick("47") + num(12))
        out.append(("card", f"{f} {pick(['card ', 'amex ', 'credit card: ', 'payment by '])}\x02{pick(['.', ' - ', '_', '. ']).join((amex[:4], amex[4:10], amex[10:]))}\x02 {n}", 1))
        out.append(("card", f"{f} {pick(['serial ', 'order ', 'total ', 'date ', 'pages ', ''])}\x02{pick([' ', '.', '-']).join(num(pick([2, 3, 4])) for _ in range(pick([3, 4])))}\x02 {n}", 0))
        a, b, c = num(3), num(3), num(4)
        lead = pick(["call ", "phone: ", "tel. ", "fax ", "mobile ", "dial "])
        out.append(("phone", f"{f} {lead}\x02{pick([f'({a}) {b}-{c}', f'{a}-{b}-{c}', f'{a}.{b}.{c}', f'0{num(2)} {num(4)} {num(4)}', f'00{pick("1234")}{num(10)}'])}\x02 {n}", 1))
        out.append(("phone", f"{f} \x02({a}) {b}-{c}\x02 {n}", 1))
        out.append(("phone", f"{f} {lead}\x02{pick([f'0{num(2)} {num(7)}', f'0{num(3)}-{num(7)}', f'0049 {num(2)} {num(7)}', num(10), f'0{num(9)}', f'0{num(3)}/{num(6)}'])}\x02 {n}", 1))
        out.append(("phone", f"{f} {pick(['', 'isbn ', 'order ', 'total ', 'ticket ', 'ref ', 'serial ', 'page '])}\x02{pick([num(8), num(10), num(13), f'{num(4)} {num(4)}', f'{num(2)} {num(5)}', f'20{num(2)} {num(3)}', f'{num(3)}-{num(5)}'])}\x02 {n}", 0))
        out.append(("phone", f"{f} {pick(['', 'isbn ', 'order ', 'date ', 'total ', 'version ', 'ticket ', 'pages '])}\x02{pick([f'20{num(2)}-{num(2)}-{num(2)}', f'{num(2)}.{num(2)}.20{num(2)}', f'{num(3)}-{num(2)}-{num(3)}-{num(2)}', f'{num(2)} {num(3)} {num(3)}', f'{num(2)}/{num(2)}/{num(4)}', f'{a}-{b}-{c}', f'{a} {b} {c}'])}\x02 {n}", 0))
    return out


def _tree(x: np.ndarray, bins: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    """A node: a leaf's value, or (feature, threshold, node where the value is at most it, node where it is above)."""
    value = lambda r: float(-grad[r].sum() / (hess[r].sum() + 1.0))
    gain = lambda r: grad[r].sum() ** 2 / (hess[r].sum() + 1.0)
    best = (1e-6, None, None)
    if depth:
        for f, cuts in enumerate(bins):
            for cut in cuts:
                left = x[rows, f] <= cut
                n = int(left.sum())
                if min(n, len(rows) - n) >= LEAST_LEAF:
                    more = gain(rows[left]) + gain(rows[~left]) - gain(rows)
                    if more > best[0]:
                        best = (more, f, cut)
    if best[1] is None:
        return value(rows)
    left = x[rows, best[1]] <= best[2]
    return best[1], float(best[2]), _tree(x, bins, grad, hess, rows[left], depth - 1), _tree(x, bins, grad, hess, rows[~left], depth - 1)


def _apply(node, x: np.ndarray) -> np.ndarray:
    if not isinstance(node, tuple):
        return np.full(len(x), node)
    f, cut, low, high = node
    return np.where(x[:, f] <= cut, _apply(low, x), _apply(high, x))


def boost(x: np.ndarray, y: np.ndarray) -> list:
    bins = [np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")) for f in range(x.shape[1])]
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, bins, p - y, p * (1 - p), np.arange(len(y)), DEPTH)
        trees.append(tree)
        score += SHRINK * _apply(tree, x)
    return trees


def calibrate(scores: np.ndarray, labels: np.ndarray, precision: float = PRECISION) -> float:
    """The smallest threshold from which on that share of the accepted is right; above all scores if there is none."""
    order = np.argsort(-scores, kind="stable")
    right = np.cumsum(labels[order]) / np.arange(1, len(order) + 1)
    last = np.append(scores[order][1:] != scores[order][:-1], True)
    good = np.flatnonzero((right >= precision) & last)
    return float(scores[order][good[-1]]) if len(good) else float("inf")


@functools.cache
def _fitted(app: str) -> tuple[list, list[float]]:
    spark = SparkSession.getActiveSession()
    rows = []
    for kind, text, label in _examples():
        before, match, after = text.split("\x02")
        rows.append({"kind": KINDS.index(kind), "text": before + match + after, "start": len(before), "end": len(before) + len(match), "match": match, "label": label})
    table = spark.sql("SELECT inline(from_json(:rows, 'array<struct<kind:int,text:string,start:int,end:int,match:string,label:int>>'))", args={"rows": json.dumps(rows)})
    span = F.struct("start", "end", "match")
    made = table.select(features(pieces(F.col("text")), 0, span).alias("f"), "kind", "label").select("kind", "label", *(F.col(f"f.{c}").alias(f"f_{c}") for c in FEATURES)).collect()
    x = np.array([[r.kind, *(r[f"f_{c}"] for c in FEATURES[1:])] for r in made], np.float64)
    y = np.array([r.label for r in made], np.float64)
    seen = np.arange(len(y)) // 16 % 4 != 3
    trees = boost(x[seen], y[seen])
    rest = SHRINK * sum(_apply(t, x[~seen]) for t in trees)
    return trees, [calibrate(rest[x[~seen, 0] == k], y[~seen][x[~seen, 0] == k]) for k in range(len(KINDS))]


def model(spark: SparkSession) -> tuple[list, list[float]]:
    """Trees and a threshold for each kind; the same for every input."""
    return _fitted(spark.sparkContext.applicationId)


def _case(node, f: Column) -> Column:
    if not isinstance(node, tuple):
        return F.lit(node)
    return F.when(f[FEATURES[node[0]]] <= node[1], _case(node[2], f)).otherwise(_case(node[3], f))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text and for each kind two arrays of (start, end, match): base_<kind> and more_<kind>.

    Starts and ends count code points of the whole text, ends are exclusive. Null and empty texts have no spans. An
    added span never overlaps a base span. Repeated rows give a row each; other columns are not read.
    """
    trees, least = model(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    text = F.col("_text")
    rows = rows.select("_id", "_text", *(base_spans(text, k).alias(f"base_{k}") for k in KINDS))
    base = {k: F.col(f"base_{k}") for k in KINDS}
    more = []
    for number, kind in enumerate(KINDS):
        free = _free(_once(F.concat(*(matches(text, p) for p in GENERATORS[kind]))), list(base.values()))
        more.append(_accepted(free, text, number, trees, least[number]).alias(f"more_{kind}"))
    return rows.select("*", *more).withColumnsRenamed({"_id": id_col, "_text": "text"})


def _once(found: Column) -> Column:
    """Candidates in order, those of several generators once."""
    return let(F.array_sort(found), lambda a: F.filter(a, lambda s, i: (i == 0) | (F.get(a, i - 1) != s)))


def _free(found: Column, bases: list[Column]) -> Column:
    """Candidates that overlap no base span. Those of a kind are in order and apart from each other, so only the last
    that begins before a candidate ends can reach into it; it is found by halving."""

    def last(base: Column, s: Column) -> Column:
        def half(acc: Column, _: Column) -> Column:
            middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            before = F.coalesce(F.get(base, middle)["start"] < s["end"], F.lit(False))
            return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(before, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(before, acc["hi"]).otherwise(middle).alias("hi")))

        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int"))
        return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), half, lambda acc: acc["lo"] - 1)

    reach = lambda base, s: (F.size(base) > 0) & F.coalesce(F.get(base, last(base, s))["end"] > s["start"], F.lit(False))
    return F.filter(found, lambda s: ~functools.reduce(lambda x, y: x | y, [reach(base, s) for base in bases]))


def _accepted(found: Column, text: Column, kind: int, trees: list, least: float) -> Column:
    if least == float("inf"):
        return F.array().cast("array<struct<start:int,end:int,match:string>>")
    score = lambda f: sum((F.lit(SHRINK) * _case(t, f) for t in trees), F.lit(0.0))
    chosen = lambda found: let(pieces(text), lambda parts: F.filter(found, lambda s: let(features(parts, kind, s), lambda f: score(f) >= least)))
    return let(found, lambda found: F.when(F.size(found) == 0, found).otherwise(chosen(found)))


def _named(kind: str) -> Column:
    return F.transform(F.concat(f"base_{kind}", f"more_{kind}"), lambda s: F.struct(s["start"], s["end"], F.lit(f"[{kind}]").alias("name")))


def _listed(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    base = F.array_join(F.concat(*(_listed(k, F.col(f"base_{k}")) for k in KINDS)), ",")
    every = F.array_join(F.concat(*(_listed(k, F.array_sort(F.concat(f"base_{k}", f"more_{k}"))) for k in KINDS)), ",")
    return found.select(id_col, *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with each span replaced by its kind in brackets; of overlapping spans the first gives the name."""
    found = spans(docs, id_col, text_col)
    tagged = F.array_sort(F.concat(*map(_named, KINDS)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        new = F.struct(s["end"].alias("at"), F.concat(acc["parts"], F.array(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["name"])).alias("parts"))
        return F.when(s["start"] >= acc["at"], new).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["parts"].alias("parts")))

    text = F.aggregate(tagged, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return found.select(id_col, F.when(F.size(tagged) > 0, text).otherwise(F.col("text")).alias("text"))
