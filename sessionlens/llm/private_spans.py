"""Personal data (addresses, cards, phones) by fixed patterns and a semi-Markov random field.

The patterns give the base spans. The field finds what they miss: numbers written without
a plus or with other separators, numbers that run into each other, spelled-out addresses.
It scores candidate segments as wholes (groups of digits, separators, check digit, what
stands before and behind) and pairs of successive types; bounded-entity dynamic
programming over segments of at most ``GROUPS`` groups of digits or ``LABELS`` labels
chooses boundaries and types jointly. Text outside of candidates has one labelling only,
so the work follows the candidates; those that can't be on the best path are dropped by an exact bound.

The field is trained by maximum likelihood on at most ``FIT_DOCS`` documents, with their
base spans as labels, and on ``MADE`` made-up lines: words of these documents around base
values and random ones, written in ways that the patterns miss, and look-alikes (dates,
prices, versions, numbers with a wrong check digit).

Base spans stay as they are; an added span never overlaps one. Null and empty texts have
no spans. Texts of any length are read whole, candidates are a window that moves over them.
Equal scores: the segmentation with fewer spans, then the first one found. Repeated rows
are judged each, an empty table gives no rows, columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict, deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, read_table

KINDS = ("email", "ip", "card", "phone")
#: Documents and characters of one that the field is fitted on, at most; made-up lines.
FIT_DOCS, FIT_CHARS, MADE = 600, 20_000, 2_400
#: Groups of digits, and labels of a host name, of a segment at most; gap between candidates whose types see each other.
GROUPS, LABELS, REACH = 8, 5, 24
ROUNDS, RATE, SHRINK = 80, 0.15, 2e-4

_EMAIL = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does: later starts in the run would have matched from its start.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by kind, then start."""
    out, after = [], 0
    for m in _EMAIL.finditer(text):
        at = m.start()
        if at < after:
            continue
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append(("email", start, m.end()))
            after = m.end()
    # No part of more than 255: at most three digits without leading zeros.
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for kind, pattern, least, most in (("card", _CARD, 16, 19), ("phone", _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= least and least <= len(d := _digits(m.group())) <= most and (kind == "phone" or luhn(d)):
                out.append((kind, *m.span()))
    return out


@dataclass(slots=True)
class Segment:
    start: int
    end: int
    kind: int
    features: list[str]
    score: float = 0.0


#: Fixed words: what may stand before a number, and last labels of host names.
CUES = {
    "phone": frozenset("tel phone call fax mobile cell telephone telefon handy tél téléphone teléfono móvil".split()),
    "card": frozenset("card visa mastercard amex credit debit karte kreditkarte carte tarjeta".split()),
    "ip": frozenset("ip host server address adresse dirección".split()),
    "email": frozenset("mail email e-mail contact write reach courriel correo".split()),
}
DOMAINS = frozenset("com org net edu gov info io biz int mil co de fr es it uk us eu nl ch at be pl ru jp cn in br ca au mx".split())

_RUN = re.compile(r"(?<![0-9A-Za-z])[0-9]+(?![0-9A-Za-z])")
_GAP = re.compile(r"[\s()./_,\-‐-―·]{1,5}|\s{0,2}[\[({]\s?(?:\.|dot)\s?[\])}]\s{0,2}|\sdot\s", re.I)
_AT = re.compile(r"[@＠]|(?<=[\s\[({<])[aA][tT](?=[\s\])}>])")
_OPEN, _CLOSE = re.compile(r"(?:\s{0,2}[\[({<]\s{0,2}|\s{0,2})$"), re.compile(r"\s{0,2}[\])}>]\s{0,2}|\s{0,2}")
_DOT = re.compile(r"\.|\s{0,2}[\[({<]\s{0,2}(?:\.|dot)\s{0,2}[\])}>]\s{0,2}|\s{1,2}(?:dot|\.)\s{1,2}", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}$")
_NAME_DOT = re.compile(r"(?:\s{0,2}[\[({<]\s{0,2}dot\s{0,2}[\])}>]\s{0,2}|\sdot\s)$", re.I)
_WORD = re.compile(r"([^\W\d_][\w-]*)[\s:.#]{0,4}$")


def _side(c: str) -> str:
    return "end" if not c else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c if c in "@.-_/:+,;()'\"" else "other"


def _around(text: str, start: int, end: int, kind: str) -> list[str]:
    word = _WORD.search(text, max(0, start - 24), start)
    return [f"left={_side(text[start - 1 : start])}", f"right={_side(text[end : end + 1])}", f"cue={bool(word) and word[1].lower() in CUES[kind]}"]


def _gap_kind(gap: str) -> str:
    core = gap.strip()
    if "[" in gap or "{" in gap or "dot" in gap.lower() or core in ("(.)",):
        return "dotmark"
    if "\n" in gap or "\r" in gap:
        return "line"
    if not core:
        return "space" if gap == " " else "wide"
    if "(" in core or ")" in core:
        return "paren"
    name = {"-": "dash", ".": "dot", "/": "slash", ",": "comma", "_": "under"}.get(core, "other")
    return name if len(gap) == len(core) else "spaced " + name


def _numbers(text: str) -> Iterator[Segment]:
    """Candidate segments made of groups of digits."""
    window: deque[tuple[int, int]] = deque()
    runs = _RUN.finditer(text)
    before = (0, 0)
    while True:
        while len(window) <= GROUPS and (m := next(runs, None)):
            window.append(m.span())
        if not window:
            return
        first = window[0][0]
        joined_left = before[1] > 0 and first - before[1] <= 9 and _GAP.fullmatch(text, before[1], first) is not None
        groups, gaps, n = [], [], 0
        for i in range(min(GROUPS, len(window))):
            start, end = window[i]
            if i:
                last = window[i - 1][1]
                if start - last > 9 or not _GAP.fullmatch(text, last, start):
                    break
                gaps.append(_gap_kind(text[last:start]))
            groups.append(end - start)
            n += end - start
            if n > 19:
                break
            if n < 7 and i != 3:
                continue
            follows = i + 1 < len(window) and window[i + 1][0] - end <= 9 and _GAP.fullmatch(text, end, window[i + 1][0]) is not None
            yield from _number(text, first, end, groups, gaps, n, joined_left, follows)
        before = window.popleft()


def _number(text: str, first: int, end: int, groups: list[int], gaps: list[str], n: int, joined_left: bool, follows: bool) -> Iterator[Segment]:
    digits = _digits(text[first:end])
    shape = "-".join(map(str, groups)) if len(groups) <= 6 else "many"
    kinds = sorted(set(gaps))
    common = [f"shape={shape}", f"n={n}", f"gaps={'+'.join(kinds)}", f"one gap={len(kinds) < 2}", f"joined={joined_left}", f"follows={follows}", f"same={len(set(digits)) == 1}"]
    common += [f"gap={k}" for k in kinds]
    if len(groups) == 3 and (1900 <= int(digits[:4]) <= 2100 or 1900 <= int(digits[-4:]) <= 2100):
        common.append("year")
    if len(groups) == 4 and max(groups) <= 3:
        parts = [int(x) for x in re.findall("[0-9]+", text[first:end])]
        if max(parts) <= 255:
            yield Segment(first, end, 1, ["bias", *common[2:], f"all small={max(parts) < 32}", f"padded={any(g > len(str(p)) for g, p in zip(groups, parts))}", *_around(text, first, end, "ip")])
    if 13 <= n <= 19:
        check = luhn(digits)
        lead = digits[:2] if digits[0] in "35" else digits[0]
        yield Segment(first, end, 2, ["bias", *common, f"luhn={check}", f"luhn {n}={check}", f"luhn lead={check} {lead}", *_around(text, first, end, "card")])
    if 7 <= n <= 15:
        start = first
        if text[start - 1 : start] == "(" and ")" in text[first:end]:
            start -= 1
        if text[start - 1 : start] == "+":
            start -= 1
        opened = text[start:first]
        zeros = "00" if digits.startswith("00") else "0" if digits[0] == "0" else "no"
        closed = text[start:end].count("(") == text[start:end].count(")")
        yield Segment(start, end, 3, ["bias", *common, f"opened={opened}", f"opened shape={opened} {shape}", f"zeros={zeros}", f"zeros n={zeros} {n}", f"closed={closed}", *_around(text, start, end, "phone")])


def _addresses(text: str) -> Iterator[Segment]:
    """Candidate segments around a sign or word for "at"."""
    for m in _AT.finditer(text):
        opening = _OPEN.search(text, max(0, m.start() - 5), m.start())
        left_end, right = (opening.start() if opening else m.start()), _CLOSE.match(text, m.end()).end()
        bracket = any(c in "[({<" for c in text[left_end : m.start()])
        mark = "sign" if m.group() in "@＠" else "bracket" if bracket else "word"
        if mark == "bracket" and not any(c in "])}>" for c in text[m.end() : right]):
            continue
        starts, at = [], left_end
        while len(starts) < 3 and (name := _NAME.search(text, max(0, at - 65), at)):
            starts.append(name.start())
            dot = _NAME_DOT.search(text, max(0, name.start() - 11), name.start())
            if not dot:
                break
            at = dot.start()
        label = _LABEL.match(text, right)
        if not starts or not label:
            continue
        ends, dots, at = [], [], label.end()
        while len(ends) < LABELS and (dot := _DOT.match(text, at)) and (label := _LABEL.match(text, dot.end())):
            at = label.end()
            dots.append("dot" if dot.group() == "." else "mark" if any(c in "[({<" for c in dot.group()) else "word" if "dot" in dot.group().lower() else "spaced")
            ends.append((at, label.group()))
        spaced = left_end < m.start() or right > m.end()
        for i, start in enumerate(starts):
            for j, (end, last) in enumerate(ends):
                used = sorted(set(dots[: j + 1]))
                known = last.lower() in DOMAINS
                yield Segment(start, end, 0, [
                    "bias", f"mark={mark}", f"mark dots={mark} {'+'.join(used)}", f"mark known={mark} {known}", f"known={known}", f"spaced={spaced} {mark}", f"labels={j + 2}", f"names={i + 1}", f"more names={i + 1 < len(starts)}",
                    f"more={j + 1 < len(ends)}", f"next={dots[j + 1] if j + 1 < len(dots) else ''} {ends[j + 1][1].lower() in DOMAINS if j + 1 < len(ends) else ''}", f"alpha={last.isalpha()}", f"lower={last.islower()}", f"size={min(len(last), 5)}",
                    *_around(text, start, end, "email"),
                ])


def candidates(text: str) -> Iterator[Segment]:
    """Candidate segments by start."""
    numbers, addresses = _numbers(text), _addresses(text)
    a, b = next(numbers, None), next(addresses, None)
    while a or b:
        if b is None or (a is not None and a.start <= b.start):
            yield a
            a = next(numbers, None)
        else:
            yield b
            b = next(addresses, None)


NONE = len(KINDS)


class Field:
    """Weights of features by kind, and of successive kinds (the last row: no kind before)."""

    def __init__(self) -> None:
        self.weights: dict[tuple[int, str], float] = {}
        self.turns = [[0.0] * NONE for _ in range(NONE + 1)]

    def score(self, s: Segment) -> float:
        get = self.weights.get
        return sum(get((s.kind, f), 0.0) for f in s.features)

    def gain(self, kind: int) -> float:
        """What a segment's turns can add to a path, at most, against leaving it out."""
        after = max(max(x - min(row[i] for row in self.turns) for i, x in enumerate(self.turns[kind])), 0.0)
        return max(row[kind] for row in self.turns) + after

    def best(self, group: list[Segment]) -> list[Segment]:
        """The segmentation of the highest score; segments in order of their ends."""
        group = sorted(group, key=lambda s: (s.end, s.start, s.kind))
        # By last kind: the end of its last segment, score, and the path as (segment, path before).
        lines: list[list[tuple[int, float, tuple | None]]] = [[] for _ in range(NONE)] + [[(0, 0.0, None)]]
        for s in group:
            top = None
            for before in range(NONE + 1):
                for end, score, path in reversed(lines[before]):
                    if end <= s.start:
                        value = score + s.score + self.turns[before][s.kind]
                        if top is None or value > top[0]:
                            top = (value, path)
                        break
            if top and (not lines[s.kind] or top[0] > lines[s.kind][-1][1]):
                lines[s.kind].append((s.end, top[0], (s, top[1])))
        score, path = 0.0, None
        for line in lines[:NONE]:
            if line and line[-1][1] > score:
                score, path = line[-1][1], line[-1][2]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return out[::-1]

    def find(self, text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans of the best segmentation of the text outside of taken ones."""
        spans = sorted((s, e) for _, s, e in taken)
        gains = [self.gain(k) for k in range(NONE)]
        out: list[tuple[str, int, int]] = []
        group: list[Segment] = []
        reach = at = 0

        def settle() -> None:
            out.extend((KINDS[s.kind], s.start, s.end) for s in self.best(group))

        longest = 0  # the furthest end of taken spans passed so far
        for s in candidates(text):
            while at < len(spans) and spans[at][0] < s.start:
                longest = max(longest, spans[at][1])
                at += 1
            if longest > s.start or (at < len(spans) and spans[at][0] < s.end):
                continue
            if s.start > reach + REACH:
                settle()
                group, reach = [], 0
            reach = max(reach, s.end)
            s.score = self.score(s)
            if s.score + gains[s.kind] > 0:
                s.features = []
                group.append(s)
        settle()
        return out

    def learn(self, groups: list[tuple[list[Segment], list[bool]]], rounds: int = ROUNDS, rate: float = RATE) -> None:
        """Maximum likelihood with a little shrinkage; groups: candidates and whether each is a true span."""
        names = {f: i for i, f in enumerate(sorted({(s.kind, f) for g, _ in groups for s in g for f in s.features}))}
        ids = [[np.array([names[s.kind, f] for f in s.features]) for s in g] for g, _ in groups]
        flat = np.concatenate([x for g in ids for x in g]) if groups else np.zeros(0, int)
        sizes = np.array([len(x) for g in ids for x in g], int)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        truth = np.array([t for _, ts in groups for t in ts], float)
        w = np.zeros(len(names) + (NONE + 1) * NONE)
        seen = np.zeros_like(w)
        np.add.at(seen, flat, truth[owner])
        kinds = len(names)
        for g, ts in groups:
            last = NONE
            for s in sorted((s for s, t in zip(g, ts) if t), key=lambda s: s.end):
                seen[kinds + last * NONE + s.kind] += 1
                last = s.kind
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            scores = np.zeros(len(sizes))
            np.add.at(scores, owner, w[flat])
            turns = w[kinds:].reshape(NONE + 1, NONE)
            marginal, expected, at = np.zeros(len(sizes)), np.zeros_like(turns), 0
            for g, _ in groups:
                marginal[at : at + len(g)] = _marginals(g, scores[at : at + len(g)], turns, expected)
                at += len(g)
            want = np.zeros_like(w)
            np.add.at(want, flat, marginal[owner])
            want[kinds:] = expected.ravel()
            slope = (seen - want) / max(1, len(groups)) - SHRINK * w
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope * slope
            w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.weights = {f: float(w[i]) for f, i in names.items()}
        self.turns = w[kinds:].reshape(NONE + 1, NONE).tolist()


def _marginals(group: list[Segment], scores: np.ndarray, turns: np.ndarray, expected: np.ndarray) -> list[float]:
    """Probability of each candidate over all segmentations, by forward and backward sums; adds expected turns."""
    order = sorted(range(len(group)), key=lambda i: (group[i].end, group[i].start, group[i].kind))
    up = np.exp(turns).tolist()
    grow = np.exp(np.minimum(scores, 60)).tolist()
    # forward[i]: paths whose last segment is i; a path before it ends with j, or with nothing.
    before: dict[int, list[int]] = {}
    forward, backward = [0.0] * len(group), [1.0] * len(group)
    for n, i in enumerate(order):
        before[i] = [j for j in order[:n] if group[j].end <= group[i].start]
        k = group[i].kind
        forward[i] = grow[i] * (up[NONE][k] + sum(forward[j] * up[group[j].kind][k] for j in before[i]))
    for i in reversed(order):
        for j in before[i]:
            backward[j] += up[group[j].kind][group[i].kind] * grow[i] * backward[i]
    total = 1.0 + sum(forward)
    for i in order:
        k = group[i].kind
        expected[NONE, k] += grow[i] * up[NONE][k] * backward[i] / total
        for j in before[i]:
            expected[group[j].kind, k] += forward[j] * up[group[j].kind][k] * grow[i] * backward[i] / total
    return [forward[i] * backward[i] / total for i in range(len(group))]


def _grouped(text: str, true: set[tuple[str, int, int]], doubtful: Callable[[Segment], bool] | None = None) -> Iterator[tuple[list[Segment], list[bool]]]:
    """Candidates in groups with their truth; groups with a doubtful candidate, or of which a true span is none, are left out."""
    group: list[Segment] = []
    reach = 0

    def settled() -> Iterator[tuple[list[Segment], list[bool]]]:
        if group and len(group) <= 64 and not (doubtful and any(map(doubtful, group))):
            yield list(group), [(KINDS[s.kind], s.start, s.end) in true for s in group]

    for s in candidates(text):
        if group and s.start > reach + REACH:
            yield from settled()
            group, reach = [], 0
        group.append(s)
        reach = max(reach, s.end)
    yield from settled()


def _learned_from(text: str) -> Iterator[tuple[list[Segment], list[bool]]]:
    """Groups of a document with its base spans as labels; numbers that a pattern matched but didn't accept are doubtful."""
    true = base_spans(text)
    spans = [(s, e) for _, s, e in true]
    matched = [m.span() for p, least in ((_CARD, 16), (_PHONE, 8)) for m in p.finditer(text) if len(_digits(m.group())) >= least]
    unsure = [x for x in matched if x not in spans]
    marks = [m.span() for m in _AT.finditer(text)]
    unsure += [x for x in marks if not any(s <= x[0] and x[1] <= e for s, e in spans)]
    yield from _grouped(text, set(true), lambda s: any(a < s.end and s.start < b for a, b in unsure) and (KINDS[s.kind], s.start, s.end) not in true)


class _Maker:
    """Made-up lines with known spans."""

    def __init__(self, words: list[str], values: dict[str, list[str]], seed: int = 11):
        self.r, self.words, self.values = random.Random(seed), words or ["and", "of"], values

    def digits(self, n: int, first: str = "123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def with_check(self, n: int, lead: str, right: bool = True) -> str:
        body = lead + "".join(self.r.choice("0123456789") for _ in range(n - 1 - len(lead)))
        good = next(c for c in "0123456789" if luhn(body + c))
        return body + (good if right else str((int(good) + self.r.randint(1, 9)) % 10))

    def cut(self, digits: str, sizes: list[int], gap: str) -> str:
        out, at = [], 0
        for n in sizes:
            out.append(digits[at : at + n])
            at += n
        return gap.join(out)

    def card(self, right: bool = True) -> str:
        r, known = self.r, self.values.get("card")
        if r.random() < 0.12:
            return self.cut(self.with_check(15, r.choice(["34", "37"]), right), [4, 6, 5], r.choice(["", " ", "-", ".", " "]))
        digits = _digits(r.choice(known)) if right and known and r.random() < 0.4 else self.with_check(16, r.choice("23456789"), right)
        return self.cut(digits, [4, 4, 4, len(digits) - 12], r.choice(["", "", "", " ", "-", ".", "_", "/", "  ", " - ", " ", "–"]))

    def phone(self) -> str:
        r, known = self.r, self.values.get("phone")
        if known and r.random() < 0.3:
            value = r.choice(known)
            short = re.sub(r"^\+[0-9]{1,3}[ .-]", "", value)
            return short if len(_digits(short)) >= 7 and r.random() < 0.5 and short[0] in "(0123456789" else value
        a, e, n, c = self.digits(3, "023456789"), self.digits(3), self.digits(4, "0123456789"), self.digits(r.choice([1, 2, 2, 3]))
        g = r.choice([" ", "-", ".", " "])
        return r.choice([
            f"({a}) {e}-{n}", f"({a}) {e}-{n}", f"({a}){e}-{n}", f"({a}) {e} {n}", f"{a}-{e}-{n}", f"{a}-{e}-{n}", f"{a}.{e}.{n}", f"1-{a}-{e}-{n}", f"1 ({a}) {e}-{n}", f"+{c}{g}{a}{g}{e}{g}{n}", f"+{c} ({a}) {e}-{n}", f"+{c}{a}{e}{n}",
            f"+{c} {a}/{e}{n}", f"00{c}{g}{a}{g}{e}{g}{n}", "0" + self.cut(self.digits(9), [1, 2, 2, 2, 2], g), f"0{self.digits(3)}/{self.digits(6)}", f"0{self.digits(3)} {self.digits(7)}", f"+{c}‑{a}‑{e}‑{n}", f"{a}/{e}-{n}",
        ])

    def ip(self) -> str:
        parts = [str(self.r.randint(0, 255)) for _ in range(4)]
        return self.r.choice([".", "[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] "]).join(parts)

    def email(self) -> str:
        r, known = self.r, self.values.get("email")
        if known and r.random() < 0.4:
            local, host = r.choice(known).rsplit("@", 1)
        else:
            local = r.choice(["", f"{r.choice(['j', 'anna', 'max', 'info'])}."]) + (re.sub(r"[^a-z]", "", r.choice(self.words).lower()) or "me") + r.choice(["", str(r.randint(1, 99))])
            host = ".".join([re.sub(r"[^a-z]", "", r.choice(self.words).lower()) or "host" for _ in range(r.choice([1, 1, 2]))] + [r.choice(sorted(DOMAINS))])
        at = r.choice(["@", " @ ", "(at)", " (at) ", "[at]", " [at] ", " at ", " at ", " AT ", "＠", "{at}"])
        dot = r.choice([".", " dot ", " dot ", "[.]", "(dot)", " [dot] ", "(.)", " . ", " DOT "] if at.strip() != "@" or at == " @ " else ["[.]", " dot ", "(dot)", "[dot]"])
        return local.replace(".", dot if "dot" in dot.lower() and r.random() < 0.5 else ".") + at + host.replace(".", dot)

    def lookalike(self) -> str:
        r, d = self.r, self.digits
        y, mo, day = str(r.randint(1900, 2099)), f"{r.randint(1, 12):02}", f"{r.randint(1, 28):02}"
        return r.choice([
            lambda: r.choice("-./ ").join([y, mo, day]), lambda: r.choice("-./ ").join([day, mo, y]), lambda: f"{y}-{mo}-{day} {d(2)}:{d(2)}:{d(2)}", lambda: f"{d(r.randint(1, 4))}.{d(r.randint(1, 6))}", lambda: d(r.randint(1, 14)), lambda: d(r.randint(7, 12)), lambda: d(r.randint(20, 40)),
            lambda: r.choice(",. ").join([d(r.randint(1, 3)), d(3, "0123456789"), d(3, "0123456789")]), lambda: ".".join(d(r.choice([1, 1, 2])) for _ in range(3)), lambda: ".".join([d(2), d(1), "0", d(4)]), lambda: ".".join(str(r.randint(256, 999)) for _ in range(4)),
            lambda: f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", lambda: f"{r.randint(1900, 2020)}-{r.randint(1900, 2020)}", lambda: f"{d(3)}-{d(3)}", lambda: " ".join(d(r.choice([1, 2, 3])) for _ in range(r.randint(3, 7))), lambda: ", ".join(d(r.choice([1, 2, 3, 4])) for _ in range(r.randint(3, 7))),
            lambda: self.card(False), lambda: self.card(False), lambda: self.with_check(r.choice([13, 14, 17, 18, 19]), "1"), lambda: f"arrived at {r.choice(self.words)}. {r.choice(self.words)}", lambda: f"look at {r.choice(self.words)}, {r.choice(self.words)}",
            lambda: f"{r.choice(self.words)} @ {r.choice(self.words)} . {r.choice(self.words)}", lambda: f"{d(5)}-{d(4)}", lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(2)}/{d(2)} {d(4)} {d(4)}", lambda: f"{d(1)}-{d(1)} {d(1)}-{d(1)} {d(1)}-{d(1)} {d(2)}-{d(2)}",
        ])()

    def line(self) -> tuple[str, set[tuple[str, int, int]]]:
        r, text, true = self.r, "", set()
        for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
            text += " ".join(r.choice(self.words) for _ in range(r.choice([0, 0, 1, 3, 6])))
            if text and not text.endswith((" ", "\n")):
                text += r.choice([" ", " ", " ", " ", "\n", ": ", " (", ' "', ", "])
            kind = r.choice([*KINDS, "phone", "card", "other", "other", "other"])
            if kind in CUES and r.random() < 0.15:
                text += r.choice(sorted(CUES[kind])) + r.choice([" ", ": ", " "])
            made = self.lookalike() if kind == "other" else getattr(self, kind)()
            if kind != "other":
                true.add((kind, len(text), len(text) + len(made)))
            text += made + r.choice([" ", " ", " ", " ", ". ", ", ", "\n", ") ", '" ', "!! ", "### "])
        return text + " ".join(r.choice(self.words) for _ in range(r.choice([0, 2, 4]))), true


def fit(docs: DataFrame, most_docs: int = FIT_DOCS, most_chars: int = FIT_CHARS, made: int = MADE) -> Field:
    """A field fitted on a bounded sample of docs (doc_id, text) and made-up lines; the same rows give the same field."""
    # Different texts by their hashes: only hashes are shuffled, then the chosen texts are read.
    known = docs.where(F.length("text").between(1, most_chars)).select("text", F.xxhash64("text").alias("h"), F.col("text").rlike(r"@|\+[0-9]|[0-9]{4}|[0-9]\.[0-9]").alias("numbered"))
    chosen = []
    for numbered, most in ((True, most_docs // 2), (False, most_docs - most_docs // 2)):
        chosen += [r["h"] for r in known.where(F.col("numbered") == numbered).select("h").distinct().orderBy("h").limit(most).collect()]
    texts = [r["text"] for r in known.where(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()] if chosen else []
    values: dict[str, list[str]] = defaultdict(list)
    words: list[str] = []
    groups = []
    for text in texts:
        for kind, start, end in base_spans(text):
            values[kind].append(text[start:end])
        words += [w for w in text.split() if w.isalpha()]
        groups += list(_learned_from(text))
    maker = _Maker(words, values)
    for _ in range(made):
        text, true = maker.line()
        groups += [(g, ts) for g, ts in _grouped(text, true)]
    field = Field()
    field.learn(groups)
    return field


def personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, spans (kind, start, end, text, base) by kind and start, for each row of docs (doc_id, text). Places are code points."""
    place = {k: i for i, k in enumerate(KINDS)}

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                base = base_spans(text) if text else []
                added = field.find(text, base) if text else []
                spans = sorted([(*s, True) for s in base] + [(*s, False) for s in added], key=lambda s: (place[s[0]], s[1]))
                out.append([{"kind": k, "start": s, "end": e, "text": text[s:e], "base": f} for k, s, e, f in spans])
            yield pd.DataFrame({"doc_id": b["doc_id"], "spans": out})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(lean(each), f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,text:string,base:boolean>>")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans as one, named by the first."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["text"]:
                base = base_spans(text) if text else []
                parts, at = [], 0
                for kind, start, end in sorted(base + (field.find(text, base) if text else []), key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        parts += [text[at:start], f"[{kind.upper()}]"]
                    at = max(at, end)
                out.append("".join([*parts, text[at:]]) if text else text)
            yield b.assign(text=out)

    return docs.mapInPandas(lean(each), docs.schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_ columns count base spans; n_added those of the field."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data(docs, fit(docs))
    listed = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), added)
