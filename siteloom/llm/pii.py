"""Personal data: base rules, and candidates that gradient boosted trees select.

Loose generators propose spans, many of which overlap or are nothing: obfuscated addresses, runs of digit groups in every
cut, colon groups. Each gets format and context features, and boosted trees score it. Spans of the base rules always stay;
selected candidates that overlap none of them are added, the best of overlapping ones.

The trees must find what the rules can't, so their labels go beyond the rules. Each span that the rules find in a bounded
sample is rewritten in its own surroundings: into forms that the rules don't know or lose (an address with [at] and
[dot], a number without its plus sign or run together with the next number, other separators, IPv6), which are positive,
and into decoys (order numbers, versions, dates, numbers with wrong check digits), which are negative, as are real
candidates that can't be right. Two families of forms and decoys share nothing: FITTED, put into two thirds of the
documents, fits the trees; HELD, put into the others, calibrates a threshold per kind. Calibration runs the whole choice
among overlapping candidates, so a span with wrong ends counts as wrong.
"""

from __future__ import annotations

import hashlib
import heapq
import ipaddress
import random
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_sample

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Not starting inside a number finds the same matches as trying each digit, in linear time.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]|::|[(\[{<]\x20?at\x20?[)\]}>]|\x20at\x20", re.I)
_LABEL, _LOCAL = "[A-Za-z0-9-]{1,63}", "[A-Za-z0-9._%+-]{1,64}"
_AT = r"(?:\x20?[(\[{<]\x20?(?:at|@)\x20?[)\]}>]\x20?|\x20at\x20|\x20?@\x20?)"
_SPELLED = r"(?:\x20?[(\[{<]\x20?(?:dot|\.)\x20?[)\]}>]\x20?|\x20dot\x20)"
#: Generators by pattern: (kind, pattern). Runs of digit groups are proposed in every cut besides, as cards and as phones.
PATTERNS = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:{_SPELLED}{_LOCAL}){{0,3}}{_AT}{_LABEL}(?:(?:\.|{_SPELLED}){_LABEL}){{1,6}}", re.I)),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,4}(?:(?:\.|,|\x20?[(\[{]\.[)\]}]\x20?|\x20\.\x20)[0-9]{1,4}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")),
)
RUN = re.compile(r"[+(]{0,2}[0-9](?:[0-9()\x20./+-]*[0-9])?")
GROUP = re.compile(r"\+?[(]?[0-9]+[)]?")
MOST_GROUPS, MOST_CHARS = 6, 32
NEAR = re.compile("tel|phone|call|fax|mobile|sms|mail|contact|write|card|visa|pay|credit|address|host|server|login", re.I)
OTHER = re.compile("order|invoice|item|ref|sku|isbn|version|page|total|qty|part|serial|art", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Local part, @ and domain with a dot, found from each @, so that a long run without one costs nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = [(0, i, j) for i, j in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 40 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def marked(length: int, spans: list[tuple[int, int, int]]) -> bytearray:
    """A byte per character, 1 within a span."""
    taken = bytearray(length)
    for _, i, j in spans:
        taken[i:j] = b"\x01" * (j - i)
    return taken


def is_free(taken: bytearray, span: tuple[int, int, int]) -> bool:
    return taken.find(1, span[1], span[2]) < 0


def is_ipv6(s: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span, then what surrounds it."""
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits = re.sub("[^0-9]", "", s)
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    last, first = before[-1:] or " ", after[:1] or " "
    return [
        float(x)
        for x in (
            kind, len(s), len(digits), sum(map(str.isalpha, s)), len(sizes), max(sizes), min(sizes), sizes[0], sizes[-1], sizes[1] if len(sizes) > 1 else 0,
            s.count("."), s.count(" "), s.count("-"), s.count("/"), s.count("("), s.count(")"), s.count(":"), s.count("@"), s.startswith("+"), sum(s.count(c) for c in "[{<"),
            bool(re.search(r"\bat\b", s, re.I)), len(re.findall(rf"{_SPELLED}", s, re.I)) if kind == 0 else -1, len(set(s)), len(re.findall("[0-9A-Fa-f]+", s)) if kind == 1 else -1, is_ipv6(s) if kind == 1 else -1,
            max((min(int(g), 9999) for g in groups), default=-1) if kind == 1 else -1, luhn(digits) if 13 <= len(digits) <= 19 else -1, int(digits[:2] or -1), digits.startswith("0"),
            last.isspace(), last.isalnum(), last in "+(.-/:", first.isspace(), first.isalnum(), first in ".-/:)", bool(re.search(r"[0-9][\x20().,/:+-]{0,3}$", before)), bool(re.match(r"[\x20().,/:+-]{0,3}[0-9]", after)),
            "+" in before[-6:], bool(NEAR.search(before)), bool(OTHER.search(before)),
        )
    ]


def candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end), each once; they overlap each other freely. Linear in the text, and nothing is gathered."""
    for kind, pattern in PATTERNS:
        for m in pattern.finditer(text):
            yield kind, *m.span()
    for run in RUN.finditer(text):
        if run.end() - run.start() < 7:
            continue
        last: deque[tuple[int, int]] = deque(maxlen=MOST_GROUPS)
        for m in GROUP.finditer(text, run.start(), run.end()):
            last.append((m.start(), sum(map(str.isdigit, m[0]))))
            digits = 0
            for start, n in reversed(last):
                digits += n
                if digits > 19 or m.end() - start > MOST_CHARS:
                    break
                if 7 <= digits <= 15:
                    yield 3, start, m.end()
                if digits >= 13:
                    yield 2, start, m.end()


def best_first(scored: list[tuple[float, int, int, int]], length: int) -> list[tuple[float, int, int, int]]:
    """Of (score, kind, start, end), those that overlap no better one; of equal scores the longer, then the earlier is better."""
    taken, out = bytearray(length), []
    for c in sorted(scored, key=lambda c: (-c[0], c[2] - c[3], c[2], c[1])):
        if is_free(taken, c[1:]):
            taken[c[2] : c[3]] = b"\x01" * (c[3] - c[2])
            out.append(c)
    return out


@dataclass
class Trees:
    """Boosted trees of a fixed depth for the logistic loss, on features cut into quantile bins."""

    depth: int = 4
    rounds: int = 60
    rate: float = 0.3
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        b, rate = self.binned(x), np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            score += self.grow(b, p - y, np.maximum(p * (1 - p), 1e-6))
        return self

    def grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Add one tree in a heap layout; returns what it adds to each row. All nodes of a level share one histogram."""
        size, n_features = 2**self.depth - 1, b.shape[1]
        which, cut, node = np.zeros(size, np.int64), np.full(size, 99, np.int64), np.zeros(len(g), np.int64)
        cells, rows = b + 34 * np.arange(n_features), np.arange(len(g))
        wide_g, wide_h = np.repeat(g, n_features), np.repeat(h, n_features)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            at = (cells + (node - first)[:, None] * (34 * n_features)).ravel()
            gs, hs = (np.bincount(at, w, width * n_features * 34).reshape(width, n_features, 34).cumsum(2) for w in (wide_g, wide_h))
            all_g, all_h = gs[:, :, -1:], hs[:, :, -1:]
            gain = (gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)).reshape(width, -1)
            best = gain.argmax(1)
            split = gain[np.arange(width), best] > 1e-6
            which[first : first + width] = np.where(split, best // 34, 0)
            cut[first : first + width] = np.where(split, best % 34, 99)
            node = 2 * node + 1 + (b[rows, which[node]] > cut[node])
        leaf = node - size
        value = -self.rate * np.bincount(leaf, g, size + 1) / (np.bincount(leaf, h, size + 1) + 1)
        self.trees.append((which, cut, value))
        return value[leaf]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, score, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for which, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, which[node]] > cut[node])
            score += value[node - len(which)]
        return 1 / (1 + np.exp(-score))


#: Candidates that are scored together; a text with more of them goes through in several blocks.
BLOCK = 4096


@dataclass
class Model:
    """Trees and the least score for each kind that has enough examples."""

    trees: dict[int, Trees]
    thresholds: dict[int, float]

    def scores(self, kinds: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Score of each row; 0 for kinds without trees."""
        p = np.zeros(len(x))
        for kind, trees in self.trees.items():
            if (own := kinds == kind).any():
                p[own] = trees.predict(x[own])
        return p

    def select(self, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        """Per text, the candidates over their kind's threshold that overlap no base span nor a better candidate."""
        over: list[list[tuple[float, int, int, int]]] = [[] for _ in texts]
        block: list[tuple[int, tuple[int, int, int], list[float]]] = []

        def score() -> None:
            if block:
                p = self.scores(np.array([c[0] for _, c, _ in block]), np.array([x for *_, x in block]))
                for (i, c, _), q in zip(block, p.tolist()):
                    if q >= self.thresholds[c[0]]:
                        over[i].append((q, *c))
                block.clear()

        for i, (text, base) in enumerate(zip(texts, bases)):
            if self.trees and HINT.search(text):
                taken = marked(len(text), base)
                for c in candidates(text):
                    if c[0] in self.trees and is_free(taken, c):
                        block.append((i, c, features(text, *c)))
                        if len(block) == BLOCK:
                            score()
        score()
        return [[c[1:] for c in best_first(o, len(t))] if o else [] for o, t in zip(over, texts)]


def with_check_digit(digits: str) -> str:
    return next(digits[:-1] + str(d) for d in range(10) if luhn(digits[:-1] + str(d)))


def no_card(rng: random.Random) -> str:
    """Sixteen digits with a wrong check digit."""
    digits = "".join(rng.choices("0123456789", k=16))
    return digits[:-1] + str((int(with_check_digit(digits)[-1]) + rng.randint(1, 9)) % 10)


def rewritten(kind: int, value: str, rng: random.Random) -> tuple[str, str, str]:
    """A form of a base span that the rules don't know or lose: (before, form, after), of which form is personal data."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    digits = re.sub("[^0-9]", "", value)
    follow = rng.choice(["", "", f" {number(rng.randint(1, 6))}", f" {number(3)}.{number(2)}.{number(3)}.{number(2)}", f" {no_card(rng)}"])
    if kind == 0:
        local, domain = rng.choice([value, value, re.sub("[0-9]+", "", value)]).rsplit("@", 1)
        local = local.strip(".") or "info"
        at = rng.choice([" [at] ", " (at) ", "[at]", "(at)", " at ", " @ ", " at "])
        dot = rng.choice([" [dot] ", " (dot) ", "[dot]", " dot ", "."]) if at.strip() != "at" else rng.choice([" dot ", " dot ", " [dot] "])
        if "[" not in at and "." in local and rng.random() < 0.5:
            local = local.replace(".", " dot ")
        return "", local + at + domain.replace(".", dot), ""
    if kind == 1:
        if rng.random() < 0.4:
            other = rng.choice([value, value, f"10.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}", f"192.168.{rng.randrange(256)}.{rng.randrange(256)}", ".".join(str(rng.randrange(256)) for _ in range(4))])
            return "", rng.choice(["[.]", " . "]).join(other.split(".")), ""
        parts = [f"{rng.randrange(1 << rng.choice([8, 16, 16])):x}" for _ in range(8)]
        return "", ":".join(parts) if rng.random() < 0.6 else ":".join(parts[: rng.randint(2, 4)]) + "::" + ":".join(parts[: rng.randint(1, 2)]), ""
    if kind == 2:
        if rng.random() < 0.25:
            short = with_check_digit(rng.choice(["34", "37"]) + number(13))
            return "", rng.choice([short, f"{short[:4]} {short[4:10]} {short[10:]}", f"{short[:4]}-{short[4:10]}-{short[10:]}"]), follow
        digits = rng.choice([digits, with_check_digit(number(16))])
        fours, sep = [digits[i : i + 4] for i in range(0, len(digits), 4)], rng.choice([".", "/", " ", "-", "", "", ""])
        if sep in (".", "/"):
            return "", sep.join(fours), follow
        ahead = rng.choice(["", f"{number(rng.randint(1, 6))} ", f"{no_card(rng)} "])
        return ahead, sep.join(fours), follow if ahead else rng.choice([f" {number(rng.choice([2, 4]))}", f" {no_card(rng)}"])
    own = digits[-10:]
    form = rng.choice([f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}", f"{own[:3]}.{own[3:6]}.{own[6:]}", f"{own[:3]} {own[3:6]} {own[6:]}", f"00{digits[: len(digits) - 10]} {own[:3]} {own[3:6]} {own[6:]}", f"0{own[:3]} {own[3:6]} {own[6:]}", f"0{own[:4]} {own[4:7]} {own[7:]}", f"0{own[:4]}-{own[4:]}", value, value])
    return "", form, f" {number(3)}.{number(2)}.{number(3)}.{number(2)}" if form == value else rng.choice(["", "", f" {number(2)}"])


def decoy(rng: random.Random) -> str:
    """What looks like personal data and isn't."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    wrong = no_card(rng)
    cue = rng.choice(["", "", "order ", "invoice no ", "ref ", "isbn ", "version ", "item ", "serial "])
    return cue + rng.choice([
        wrong, wrong, " ".join(wrong[i : i + 4] for i in range(0, 16, 4)), number(13), number(rng.randint(20, 30)), f"{number(2)}:{number(2)}:{number(2)}", f"20{number(2)}-0{rng.randint(1, 9)}-{number(2)} {number(2)}:{number(2)}",
        f"{number(2)}/{number(2)}/20{number(2)} {number(4)}", f"{rng.randint(1, 30)}.{rng.randint(0, 40)}.{rng.randint(0, 9)}.{rng.randint(300, 9999)}", f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"ORD-{number(5)}-{number(4)}",
        " ".join(number(rng.randint(2, 4)) for _ in range(6)), f"{number(1)}.{number(9)}", f"{number(3)},{number(3)},{number(3)}.{number(2)}", f"{rng.getrandbits(128):032x}", f"x{number(10)}y", ":".join(f"{rng.getrandbits(8):02x}" for _ in range(6)),
        f"{number(1)}:{number(1)}:{number(1)}:{number(1)}", "meet at noon. then", "look at page.two", f"stay at {number(2)}.{number(2)} h", f"file{number(1)} @ v{number(1)}.{number(1)}", "all at once", f"part {number(5)} - {number(5)}", f"{number(8)}", f"#{number(7)}", f"{number(6)}-{number(6)}", f"{number(4)}-{number(4)}",
    ])


def held_form(kind: int, value: str, rng: random.Random) -> tuple[str, str, str]:
    """As `rewritten`, in forms that share no separator, grouping or bracket with those."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    if kind == 0:
        local, domain = value.rsplit("@", 1)
        local = local.strip(".") or "office"
        at, dot = rng.choice([("<at>", "<dot>"), (" <at> ", "."), ("[@]", "[.]"), ("(@)", "(.)"), (" AT ", " DOT "), ("{at}", "{dot}"), (" {at} ", ".")])
        return "", (local.replace(".", dot) if rng.random() < 0.5 else local) + at + domain.replace(".", dot), ""
    if kind == 1:
        four, parts = [str(rng.randrange(256)) for _ in range(4)], [f"{rng.getrandbits(16):x}" for _ in range(4)]
        six = ["fe80::" + ":".join(parts), "2001:db8::" + ":".join(parts[:3]), ("2001:db8:" + ":".join(parts[:3]) + "::1").upper(), "::ffff:" + ":".join(parts[:2])]
        return "", rng.choice([rng.choice(["(.)", "{.}", " [.] "]).join(four), rng.choice(six)]), ""
    if kind == 2:
        digits = with_check_digit(rng.choice("3456") + number(15))
        if rng.random() < 0.3:
            short = with_check_digit(rng.choice(["34", "37"]) + number(13))
            return "", rng.choice([".", "/", " - "]).join((short[:4], short[4:10], short[10:])), ""
        if rng.random() < 0.5:
            return "", rng.choice([" - ", " / ", " . "]).join(digits[i : i + 4] for i in range(0, 16, 4)), ""
        return f"{number(5)} ", digits[:8] + " " + digits[8:], f" {number(3)}"
    d = rng.choice("123789") + number(9)
    return "", rng.choice([f"0{d[:2]} {d[2:6]} {d[6:]}", f"0{d[:4]} {d[4:]}", f"00{rng.choice(['44', '49', '33'])} {d[:2]} {d[2:8]}", f"(0{d[:3]}) {d[3:9]}", f"+{rng.choice(['44', '49', '33'])}/{d[:3]}/{d[3:]}", f"({d[:3]}) {d[3:6]}.{d[6:]}"]), ""


def held_decoy(rng: random.Random) -> str:
    """As `decoy`, of other things."""
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    wrong = no_card(rng)
    return rng.choice([
        f"tracking 1Z{number(10)}", f"EAN {number(13)}", f"{number(2)}.{number(5)}, -{number(1)}.{number(5)}", f"19{number(2)}-19{number(2)}, 20{number(2)}-20{number(2)}", f"{number(1)} {number(3)} {number(3)},{number(2)}", f"batch 20{number(6)} {number(4)}",
        f"lot {number(4)}-{number(4)}-{number(2)}", wrong[:8] + " " + wrong[8:], " - ".join(wrong[i : i + 4] for i in range(0, 16, 4)), ".".join(wrong[i : i + 4] for i in range(0, 16, 4)), f"{number(2)}:{number(2)}:{number(2)}.{number(3)}", "-".join(f"{rng.getrandbits(16):04x}" for _ in range(5)),
        f"3 . 2 . {rng.randint(256, 999)} . 14", ":".join(f"{rng.getrandbits(8):02X}" for _ in range(6)), "come and see us at shop.north", "sold at 3.50 each", f"v{number(1)}.{number(2)}.{rng.randint(256, 999)}.{number(4)}", f"pages {number(3)}-{number(3)}", f"{number(4)} / {number(4)}", "score 3 @ 4.5 each", f"{number(17)}.{number(2)}",
    ])


def impossible(text: str, kind: int, start: int, end: int) -> bool:
    """Whether a candidate of a real text can't be what its kind says: part of a longer word, or a wrong number."""
    s = text[start:end]
    digits = re.sub("[^0-9]", "", s)
    inside = text[start - 1 : start].isalnum() or text[end : end + 1].isalnum()
    wrong = kind == 1 and (not is_ipv6(s) if ":" in s else any(int(g) > 255 for g in re.findall("[0-9]+", s)))
    return inside or wrong or (kind == 2 and not luhn(digits))


#: Base spans and impossible candidates of one text that training takes at most, by a hash of their places.
SPANS_OF_A_TEXT, WRONG_OF_A_TEXT = 16, 64


def examples(text: str, copies: int, held: bool) -> Iterator[tuple[int, list[float], bool, int, int, int]]:
    """(kind, features, label, shown, start, end) from one text: rewritten base spans and decoys in their places, and
    impossible candidates. shown tells apart the texts that candidates overlap in."""
    rng, base, shown = random.Random(zlib.crc32(text.encode("utf-8", "replace"))), base_spans(text), 0
    form_of, decoy_of = (held_form, held_decoy) if held else (rewritten, decoy)
    few = lambda n, spans: heapq.nsmallest(n, spans, key=lambda c: (zlib.crc32(f"{c[0]}:{c[1]}:{c[2]}".encode()), c))

    def all_of(line: str, good: tuple[int, int, int] | None) -> Iterator[tuple[int, list[float], bool, int, int, int]]:
        taken = marked(len(line), base_spans(line))
        for c in candidates(line):
            if is_free(taken, c):
                yield c[0], features(line, *c), c == good, shown, c[1], c[2]

    taken = marked(len(text), base)
    for c in few(WRONG_OF_A_TEXT, (c for c in candidates(text) if is_free(taken, c) and impossible(text, *c))):
        yield c[0], features(text, *c), False, shown, c[1], c[2]
    for kind, i, j in few(SPANS_OF_A_TEXT, base):
        before, after = re.sub("[0-9@+]", "", text[max(0, i - 60) : i]), re.sub("[0-9@+]", "", text[j : j + 40])
        for _ in range(copies):
            ahead, form, follow = form_of(kind, text[i:j], rng)
            cue = rng.choice(["", "", "tel ", "mail ", "card ", "call ", "host "])
            start, shown = len(before) + len(cue) + len(ahead), shown + 1
            yield from all_of(before + cue + ahead + form + follow + after, (kind, start, start + len(form)))
            shown += 1
            yield from all_of(before + decoy_of(rng) + after, None)


def is_held(doc_id: int | None) -> bool:
    """One in three documents calibrates, the others fit."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 0


EXAMPLE = "doc_id bigint, kind bigint, x array<double>, y boolean, shown bigint, start bigint, end bigint, held boolean"


def labelled(docs: DataFrame, rows: int, copies: int) -> DataFrame:
    """EXAMPLE: labelled candidates from a sample of about so many documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), *[pa.int64()] * 3, pa.bool_())
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if HINT.search(text):
                    out += [(doc, *x, is_held(doc)) for x in examples(text, copies, is_held(doc))]
            columns = list(zip(*out)) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in EXAMPLE.split(", ")])

    some = bounded_sample(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")), rows)
    return some.mapInArrow(run, EXAMPLE)


def calibrated(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which so large a share is right, halfway to the next lower one; above 1, which nothing reaches, if there is none."""
    order = np.argsort(-p, kind="stable")
    right = y[order].cumsum() / np.arange(1, len(p) + 1)
    good = np.flatnonzero((right >= precision) & (p[order] >= 0.5))
    if not len(good):
        return 2.0
    last = good[-1]
    below = p[order][last + 1] if last + 1 < len(p) else 0.0
    return max(0.5, float(p[order][last] + below) / 2)


#: Held-out positive examples that a kind needs; of others nothing is added.
LEAST_HELD = 10


def train(docs: DataFrame, rows: int = 20_000, candidates_at_most: int = 40_000, precision: float = 0.97, copies: int = 6) -> Model:
    """Fit on about `rows` documents and at most `candidates_at_most` labelled candidates, chosen by a hash of the text that they stand in.

    Each kind has trees of its own. The threshold is the lowest score from which `precision` of the spans that come out of
    held-out texts, after overlapping ones are decided, are right in kind and both ends.
    """
    hashed = labelled(docs, rows, copies).withColumn("h", F.xxhash64("doc_id", "shown"))
    got = hashed.orderBy("h", "doc_id", "shown", "kind", "start", "end", "x").limit(candidates_at_most).collect()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    held, kinds = np.array([r.held for r in got], bool), np.array([r.kind for r in got])
    model = Model({}, {})
    for k in range(len(KINDS)):
        fit = (kinds == k) & ~held
        if 0 < y[fit].sum() < fit.sum() and y[(kinds == k) & held].sum() >= LEAST_HELD:
            model.trees[k] = Trees().fit(x[fit], y[fit])
    texts: dict[tuple, list[tuple[float, int, int, int]]] = {}
    right = set()
    for r, p in zip(got, model.scores(kinds, x).tolist() if got else []):
        if r.held:
            span = (p, r.kind, r.start, r.end)
            if p >= 0.5:
                texts.setdefault((r.doc_id, r.shown), []).append(span)
            if r.y:
                right.add((r.doc_id, r.shown, *span[1:]))
    out = [(c[1], c[0], (*key, *c[1:]) in right) for key, found in texts.items() for c in best_first(found, max(c[3] for c in found))]
    for k in model.trees:
        own = [(p, y) for kind, p, y in out if kind == k]
        model.thresholds[k] = calibrated(np.array([p for p, _ in own]), np.array([y for _, y in own], float), precision) if own else 2.0
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{i}:{j}" for k, i, j in sorted(spans))


def find_personal_data(docs: DataFrame, rows: int = 20_000, model: Model | None = None) -> DataFrame:
    """Per row of docs: doc_id, counts of base spans by kind, base_sha256, all spans, and n_added.

    Spans are kind:start:end in code points, end exclusive, by kind, then start. A null text counts as empty.
    Repeated rows are scanned each, extra columns are ignored, an empty table gives no rows.
    """
    model = model or train(docs, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            bases = [base_spans(t) if HINT.search(t) else [] for t in texts]
            out: list[list] = [[] for _ in range(8)]
            for doc, base, added in zip(batch.column(0).to_pylist(), bases, model.select(texts, bases)):
                kinds = [b[0] for b in base]
                row = [doc, *[kinds.count(k) for k in range(4)], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added)]
                for column, value in zip(out, row):
                    column.append(value)
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)
