"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import defaultdict


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def jaccard(rows, size, percent):
    """rows: (id, text) -> sorted (id, n, component)."""
    sets = [(i, shingles(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].add(k)
    for k, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for x in s:
            for other in by[x]:
                if other < k:
                    common[other] += 1
        for other, both in common.items():
            j, o = sets[other]
            if 100 * both >= percent * (len(s) + len(o) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, s in sets)


def decontaminate(rows, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for name, text in items:
        words = word.findall(lower(text))
        length = min(size, len(words))
        for k in range(len(words) - length + 1 if words else 0):
            windows[tuple(words[k : k + length])].add(str(name))
    lengths = sorted({len(w) for w in windows})
    out = []
    for i, text in rows:
        words = word.findall(lower(text))
        hit, names = set(), set()
        for length in lengths:
            for k in range(len(words) - length + 1):
                found = windows.get(tuple(words[k : k + length]))
                if found:
                    hit.update(range(k, k + length))
                    names |= found
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(words), len(hit), len(names), sha, bool(hit)))
    return sorted(out)


def exact(rows, keep=max):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    return sorted((i, keep(by[t or ""]), len(by[t or ""]), i == keep(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def clean(text, items, size=10):
    """The text without the words that windows of the items hit and what lies between them; None where nothing is left."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lower(text)
    found = [(m.start(), m.end(), m[0]) for m in word.finditer(low)]
    hit = [False] * len(found)
    for _, item in items:
        words = word.findall(lower(item))
        length = min(size, len(words))
        for k in range(len(words) - length + 1 if words else 0):
            for at in range(len(found) - length + 1):
                if [w for _, _, w in found[at : at + length]] == words[k : k + length]:
                    hit[at : at + length] = [True] * length
    if found and all(hit):
        return None
    out, at, k = [], 0, 0
    while k < len(found):
        if hit[k]:
            last = k
            while last + 1 < len(found) and hit[last + 1]:
                last += 1
            out.append((text or "")[at : found[k][0]])
            at, k = found[last][1], last
        k += 1
    return text if not any(hit) else "".join(out) + text[at:]


CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".", b",;:", b"!?", b"|", b"'\"()", b"-_/"]


def _class(byte):
    return 12 if byte >= 128 else next((k for k, members in enumerate(CLASSES) if byte in members), 11)


def passages(text, size=64):
    """The features of each passage of a text, one at a time."""
    data = (text or "").encode()
    words = [(m.start(), m.end(), lower(m[0].decode("latin-1"))) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not words:
        return [[0.0] * 23]
    out, before, runs = [], set(), set()
    for lo in range(0, len(words), size):
        part = words[lo : lo + size]
        stop = words[lo + size][0] if lo + size < len(words) else len(data)
        counts = [0] * 13
        for byte in data[part[0][0] : stop]:
            counts[_class(byte)] += 1
        lengths, here = [b - a for a, b, _ in part], set()
        again = again_here = again_run = 0
        for k, (_, _, w) in enumerate(part, lo):
            again_here += w in here
            again += w in before
            here.add(w)
            before.add(w)
            if k + 4 <= len(words):
                run = tuple(x for _, _, x in words[k : k + 4])
                again_run += run in runs
                runs.add(run)
        n, mean = len(part), sum(lengths) / len(part)
        starts, ends = [_class(data[a]) for a, _, _ in part], [_class(data[b - 1]) for _, b, _ in part]
        out.append(
            [c / sum(counts) for c in counts]
            + [math.log1p(n) / 5, mean / 10, math.sqrt(max(0, sum(x * x for x in lengths) / n - mean * mean)) / 10, again_here / n, again / n, again_run / n]
            + [starts.count(1) / n, sum(e >= 5 for e in ends) / n, lengths.count(1) / n, starts.count(11) / n]
        )
    return out


def attention(model, bag):
    """The score of a bag of passages by the model's weights, number by number."""
    w = {k: v.tolist() for k, v in model.weights.items()}
    dot = lambda x, m: [sum(a * row[j] for a, row in zip(x, m)) for j in range(len(m[0]))]
    hidden, weight = [], []
    for x in bag:
        x = [(a - s) / c for a, s, c in zip(x, model.shift.tolist(), model.scale.tolist())]
        h = [math.tanh(a + b) for a, b in zip(dot(x, w["E"]), w["e"])]
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(dot(h, w["V"]), dot(h, w["U"]))]
        hidden.append(h)
        weight.append(sum(a * b for a, b in zip(gate, w["w"])))
    share = [math.exp(a - max(weight)) for a in weight]
    mixed = [sum(a * h[j] for a, h in zip(share, hidden)) / sum(share) for j in range(len(hidden[0]))]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(mixed, w["c"])) + w["b"])))


def page(node):
    """Lines of a page of nested (tag, children) and texts: div, p, b, ul, ol and table of one-line cells. Between two
    lines there is a blank one if a border between them asks for it."""
    events, line = [], []

    def end(gap):
        text = re.sub(" +", " ", "".join(line)).strip()
        line.clear()
        if text:
            events.append(text)
        events.append(gap)

    def walk(x):
        if isinstance(x, str):
            line.append(x)
            return
        tag, children = x
        gap = 0 if tag in ("div", "page") else 1
        if tag == "b":
            for c in children:
                walk(c)
            return
        end(gap)
        if tag in ("ul", "ol"):
            events.extend(("- " if tag == "ul" else f"{k}. ") + c for k, c in enumerate(children, 1))
        elif tag == "table":
            width = [max(len(row[j]) for row in children) for j in range(len(children[0]))]
            events.extend("  ".join(c.ljust(n) for c, n in zip(row, width)).rstrip() for row in children)
        else:
            for c in children:
                walk(c)
        end(gap)

    walk(node)
    lines, gap = [], 0
    for e in events:
        if isinstance(e, int):
            gap = max(gap, e)
        else:
            lines += [""] * (gap if lines else 0) + [e]
            gap = 0
    return lines
