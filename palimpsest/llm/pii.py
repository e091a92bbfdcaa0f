"""Personal data by base rules and a semi-Markov conditional random field.

The base rules find emails, IP addresses, card and phone numbers of fixed forms. The field adds spans
of other forms (numbers without a plus, addresses with words for their signs, cards with other
separators). It scores whole candidate segments by features of the span as a whole (digit groups,
checksum, separators, cue words before it), and bounded-entity dynamic programming chooses
boundaries and types of a window together. It is trained here, by conditional likelihood, on a
bounded sample of windows around base matches: some as they are, some rewritten into such other forms,
some spoiled into look-alikes that are none.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.shared import slices

KINDS = ("email", "ip", "card", "phone")
LONGEST = 24  # tokens of an entity
AROUND = 4  # tokens of a window beside its digits and signs
CUT = 400  # tokens after which a run ends at the next plain word
LABELLED = 300  # documents that the field is trained on, at most
KNOWN = 100_000  # shapes of candidates whose scores are remembered
SPANS, TOKENS, EXAMPLES = 2, 80, 600  # of each of them at most so many base matches, windows of so many tokens, and so many windows in all

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
# an at-sign or what stands for one, and the domain after it, with dots or what stands for them
_AT = r"(?:@|[\[({<]\s?at\s?[\])}>]|\bat\b(?=[^\n]{1,70}\bdot\b))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s{1,3}dot\s{1,3})"
_MARK = re.compile(f"[0-9]+|(?P<sign>{_AT})", re.I)
_TAIL = re.compile(rf"{_AT}\s{{0,3}}[\w-]+(?:{_DOT}[\w-]+)*", re.I)
_ADDRESS = re.compile(rf"[\w.%+-]+\s?(?:@|[\[({{<]\s?at\s?[\])}}>]|(?<=\s)at(?=\s))\s?[\w-]+(?:{_DOT}[\w-]+)+", re.I)

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base rules, by start, then kind: leftmost and without overlap for each kind."""
    found: list[Span] = []
    if not _ANY.search(text):
        return found
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) < 4 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def windows(text: str) -> Iterator[list[tuple[int, int, str]]]:
    """The tokens (start, end, text) around digits and signs, in runs; tokens of a run follow each other in the text.

    A run holds the whole of what it touches: what is written together before a mark, the domain after a
    sign, and all marks that have few tokens between them. It begins with tokens of the 60 characters before a mark's word, and goes on to tokens
    that begin within 80 characters of one: a form with a longer gap in it is no candidate.
    """
    last = 0
    run: list = []
    for m in _MARK.finditer(text):
        mark = m.start()
        if mark < last:
            continue
        head = mark
        while m["sign"] and head > last and text[head - 1].isspace():
            head -= 1
        while head > last and (text[head - 1] in _LOCAL or text[head - 1].isalnum()):
            head -= 1
        low = max(last, head - 60)
        before = [(t.start(), t.end(), t[0]) for t in _TOKEN.finditer(text, low, mark)]
        kept = before[-AROUND - sum(t[0] >= head for t in before) :]
        if run and (low > last or len(kept) < len(before) or (len(run) > CUT and run[-1][2].isalpha() and run[-1][2].lower() not in ("at", "dot"))):
            yield run
            run = []
        run += kept
        tail = mark
        for t in _TOKEN.finditer(text, mark):
            if t.start() >= max(mark + 80, tail):
                break
            run.append((t.start(), t.end(), t[0]))
            last = t.end()
            if whole := _TAIL.match(text, t.start()):
                tail = whole.end()
            if last > tail and not any(c.isdigit() or c in "@.+()-/[]" for c in t[0]) and t[0].lower() not in ("at", "dot"):
                break
    if run:
        yield run


#: Words that stand before personal data.
CUES = {"phone": "tel telefon telefono phone call mobile cell fax fon appelez llame".split(), "email": "mail email write contact kontakt correo courriel".split(), "card": "card visa mastercard carte karte kreditkarte tarjeta".split(), "ip": "ip host server address addr".split()}
#: Small words that no name or host is.
SMALL = frozenset("the a an of to on by this that my your our and or der die das ein eine le les un une el los una".split())
_CUE = {w: k for k, ws in CUES.items() for w in ws}


def span_features(tokens: list[tuple[int, int, str]], i: int, j: int) -> list[str] | None:
    """Features of tokens i to j as a whole; None if they can't be an entity."""
    first, last = tokens[i][2], tokens[j - 1][2]
    words = [t[2].lower() for t in tokens[i:j]]
    joined = "".join(words)
    digits = "".join(c for c in joined if c.isascii() and c.isdigit())
    sign = "@" in joined or ("at" in words[1:-1])
    if not (len(digits) >= 4 or sign) or not (last[-1].isalnum()) or not (first[0].isalnum() or first in "+(" or first == "."):
        return None
    gaps = sum(a[1] < b[0] for a, b in zip(tokens[i : j - 1], tokens[i + 1 : j], strict=True))
    marks = "".join(sorted({w for w in words if not w.isalnum()}))
    alphas = sum(w.isalpha() and w not in ("at", "dot") for w in words)
    if alphas and not sign:
        return None
    groups = [len(w) for w in words if w.isdigit()]
    out = ["address" if sign else "number", f"digits={min(len(digits), 20)}", f"groups={'-'.join(map(str, groups[:6]))}", f"n_groups={min(len(groups), 6)}", f"marks={marks}", f"alphas={min(alphas, 3)}", f"gaps={min(gaps, 4)}", f"plus={first == '+'}", f"paren={first == '('}"]
    if not alphas and 12 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if not alphas and not sign:
        out.append(f"number={'phone' if 9 <= len(digits) <= 15 else 'card' if 15 < len(digits) <= 19 else 'other'},gaps={min(gaps, 4)},groups={min(len(groups), 5)}")
    if len(groups) == 4 and words[1::2] == ["."] * 3:
        out.append(f"octets={all(int(w[-4:]) <= 255 for w in words[::2] if w.isdigit())}")
    if sign:
        at = words.index("@") if "@" in words else words.index("at", 1)
        out.append(f"address={any(w in ('.', 'dot') for w in words[at:])},{words[at]},{alphas > 1},{last.isalpha()}")
        plain = "".join(f" {t[2]}" if n and tokens[i + n - 1][1] < t[0] else t[2] for n, t in enumerate(tokens[i:j]))
        form = bool(_ADDRESS.fullmatch(plain))
        more = [t[2].lower() if k[1] == t[0] else f" {t[2].lower()}" for k, t in zip(tokens[j - 1 : j + 3], tokens[j : j + 4])]
        more = bool(re.match(_DOT + "[^ ]|-[^ ]", "".join(more)))
        joins = i > 0 and tokens[i - 1][1] == tokens[i][0] and tokens[i - 1][2][-1] in _LOCAL
        out += [f"form={form}", f"more={more}", f"form={form},more={more},joins={joins}", f"form={form},more={more},{words[at]},{words[at - 1] == '['}"]
        out.append(f"small={any(w in SMALL for w in words)},form={form}")
        out += [f"inside={form}"] * (j - i)  # each token, as each token outside counts too
    before, after = tokens[max(0, i - 3) : i], tokens[j : j + 1]
    out += [f"cue={k}" for k in {_CUE[t[2].lower()] for t in before if t[2].lower() in _CUE}]
    out.append(f"left={bool(before) and before[-1][1] == tokens[i][0] and (before[-1][2].isalnum() or before[-1][2] in '@+-_%=/')}")
    out.append(f"right={bool(after) and after[0][0] == tokens[j - 1][1] and (after[0][2].isalnum() or after[0][2] in '@-_%=/')}")
    return out


#: Added to the scores of a segment: only an address can be an email, only a number anything else.
_ONLY = {"address": np.array([0.0, -1e6, -1e6, -1e6]), "number": np.array([-1e6, 0.0, 0.0, 0.0])}


class Field:
    """A semi-Markov conditional random field over the kinds and single outside tokens (label 0)."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, len(KINDS)))
        self.outside = np.zeros(3)
        self.moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        self.known: dict[tuple, np.ndarray | None] = {}

    def candidates(self, tokens: list) -> Iterator[tuple[int, int]]:
        """The stretches of tokens that may be an entity by what they hold: four ASCII digits and no plain word, or a sign."""
        low = [t[2].lower() for t in tokens]
        total = lambda of: [0, *accumulate(of(t[2], w) for t, w in zip(tokens, low, strict=True))]
        digits, words, signs = total(lambda t, w: len(t) * (t.isascii() and t.isdigit())), total(lambda t, w: w.isalpha() and w not in ("at", "dot")), total(lambda t, w: w in ("at", "@"))
        for i in range(len(tokens)):
            if tokens[i][2][0].isalnum() or tokens[i][2] in "+(.":
                last = min(len(tokens), i + LONGEST)
                for j in range(i + 1, last + 1):
                    if signs[j] > signs[i] or words[j] == words[i] and digits[j] - digits[i] >= 4:
                        yield i, j
                    elif words[j] > words[i] and signs[last] == signs[i]:
                        break

    def segments(self, tokens: list) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end the candidates: start, feature numbers (new features are numbered), and what bars kinds."""
        out: list[list] = [[] for _ in range(len(tokens) + 1)]
        for i, j in self.candidates(tokens):
            names = span_features(tokens, i, j)
            if names is not None:
                for n in names:
                    self.index.setdefault(n, len(self.index))
                out[j].append((i, np.array([self.index[n] for n in names], np.int64), _ONLY[names[0]]))
        return out

    def _value(self, tokens: list, i: int, j: int) -> np.ndarray | None:
        names = span_features(tokens, i, j)
        return None if names is None else self.w[[self.index[n] for n in names if n in self.index]].sum(0) + _ONLY[names[0]]

    def scored(self, tokens: list) -> list[tuple[list[int], list[np.ndarray]]]:
        """For each end the starts of the candidates, and their scores for each kind.

        Features see of a number its length, its check digit and whether parts are octets, so candidates of one shape, with
        the same neighbours, have one score, which is remembered (in a bounded table).
        """
        out: list[tuple] = [([], []) for _ in range(len(tokens) + 1)]
        shape = ["0" * len(t[2]) if t[2].isascii() and t[2].isdigit() else t[2].lower() for t in tokens]
        gaps = [a[1] < b[0] for a, b in zip(tokens, tokens[1:], strict=False)]
        octet = [w[-4:].isdigit() and int(w[-4:]) <= 255 for _, _, w in tokens]
        for i, j in self.candidates(tokens):
            low, high = max(0, i - 3), j + 4
            number = "".join([t[2] for t in tokens[i:j] if t[2].isascii() and t[2].isdigit()])
            key = (i - low, j - low, tuple(shape[low:high]), tuple(gaps[low : high - 1]), 12 <= len(number) <= 19 and luhn(number), j - i == 7 and all(octet[i:j:2]))
            if key not in self.known:
                if len(self.known) > KNOWN:
                    self.known.clear()
                self.known[key] = self._value(tokens, i, j)
            if (value := self.known[key]) is not None:
                out[j][0].append(i)
                out[j][1].append(value)
        return out

    @staticmethod
    def _plain(token: tuple) -> int:
        return 0 if token[2].isalpha() else 1 if token[2].isdigit() else 2

    def best(self, tokens: list) -> list[tuple[int, int, int]]:
        """The entities (first token, end token, kind) of the best segmentation."""
        segments, n, k = self.scored(tokens), len(tokens), len(KINDS)
        score, back = np.full((n + 1, k + 1), -np.inf), {}
        score[0, 0] = 0.0
        for e in range(1, n + 1):
            into = score[e - 1] + self.moves[:, 0]
            y = int(into.argmax())
            score[e, 0], back[e, 0] = into[y] + self.outside[self._plain(tokens[e - 1])], (e - 1, y)
            starts, values = segments[e]
            if starts:
                into = score[starts][:, :, None] + self.moves[None, :, 1:]
                ys, best = into.argmax(1), into.max(1) + values
                for kind, at in enumerate(best.argmax(0).tolist()):
                    if best[at, kind] > score[e, kind + 1]:
                        score[e, kind + 1], back[e, kind + 1] = best[at, kind], (starts[at], int(ys[at, kind]))
        e, y, out = n, int(score[n].argmax()), []
        while e:
            s, before = back[e, y]
            if y:
                out.append((s, e, y - 1))
            e, y = s, before
        return out[::-1]

    def fit(self, examples: list[tuple[list, list[tuple[int, int, int]]]], rounds: int = 10, rate: float = 0.3, l2: float = 1e-3) -> None:
        """Raise the conditional likelihood of the given segmentations by AdaGrad; gradients come from forward and backward sums."""
        made = [(tokens, self.segments(tokens), gold) for tokens, gold in examples]
        k = len(KINDS)
        self.w = np.zeros((len(self.index), k))
        seen_w, seen_o, seen_m = np.full_like(self.w, 1e-6), np.full(3, 1e-6), np.full_like(self.moves, 1e-6)
        for _ in range(rounds):
            for tokens, segments, gold in made:
                n = len(tokens)
                values = [[self.w[f].sum(0) + only for _, f, only in segments[e]] for e in range(n + 1)]
                plain = [self._plain(t) for t in tokens]
                a, b = np.full((n + 1, k + 1), -np.inf), np.full((n + 1, k + 1), -np.inf)
                a[0, 0] = 0.0
                for e in range(1, n + 1):
                    a[e, 0] = np.logaddexp.reduce(a[e - 1] + self.moves[:, 0]) + self.outside[plain[e - 1]]
                    for (s, *_), v in zip(segments[e], values[e], strict=True):
                        a[e, 1:] = np.logaddexp(a[e, 1:], np.logaddexp.reduce(a[s][:, None] + self.moves[:, 1:], 0) + v)
                total = np.logaddexp.reduce(a[n])
                g_o, g_m, g_w = np.zeros(3), np.zeros_like(self.moves), {}
                b[n] = 0.0
                for e in range(n, 0, -1):
                    into = self.moves[:, 0] + self.outside[plain[e - 1]] + b[e, 0]
                    p = np.exp(a[e - 1] + into - total)
                    g_o[plain[e - 1]] -= p.sum()
                    g_m[:, 0] -= p
                    b[e - 1] = np.logaddexp(b[e - 1], into)
                    for (s, feats, _), v in zip(segments[e], values[e], strict=True):
                        into = self.moves[:, 1:] + v + b[e, 1:]
                        p = np.exp(a[s][:, None] + into - total)
                        g_m[:, 1:] -= p
                        share = p.sum(0)
                        if share.max() > 1e-6:
                            for f in feats:
                                g_w[f] = g_w.get(f, 0.0) - share
                        b[s] = np.logaddexp(b[s], np.logaddexp.reduce(into, 1))
                e, y = 0, 0
                by_start = {s: (end, kind) for s, end, kind in gold}
                where = {(s, end): feats for end in range(n + 1) for s, feats, _ in segments[end]}
                while e < n:
                    if e in by_start and (e, by_start[e][0]) in where:
                        end, kind = by_start[e]
                        g_m[y, kind + 1] += 1
                        for f in where[e, end]:
                            g_w[f] = g_w.get(f, np.zeros(k)) + np.eye(k)[kind]
                        e, y = end, kind + 1
                    else:
                        g_m[y, 0] += 1
                        g_o[plain[e]] += 1
                        e, y = e + 1, 0
                for f, g in g_w.items():
                    g = g - l2 * self.w[f]
                    seen_w[f] += g * g
                    self.w[f] += rate * g / np.sqrt(seen_w[f])
                seen_o += g_o * g_o
                self.outside += rate * g_o / np.sqrt(seen_o)
                seen_m += g_m * g_m
                self.moves += rate * g_m / np.sqrt(seen_m)


def _number_row(rng: random.Random) -> str:
    """Numbers that are nobody's: dates with times, identifiers, bank and article numbers, rows of a table."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    return rng.choice([
        f"{rng.randint(1900, 2099)} {rng.randint(1, 12):02d} {rng.randint(1, 31):02d} {rng.randint(0, 23):02d} {rng.randint(0, 59):02d}", f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02d}-{rng.randint(1, 31):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{n(2)}",
        f"10.{n(4)} {n(3)} {n(4)} {n(2)} {n(2)}", f"10.{n(4)}/{n(6)}.{n(4)}", f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", f"978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"{n(1)} {n(5)} {n(5)} {n(1)}", f"{n(12)}", " ".join(n(rng.randint(1, 3)) for _ in range(rng.randint(6, 14))), " ".join(f"{n(1)}.{n(2)}" for _ in range(rng.randint(4, 8))),
    ])


def _variants(kind: str, text: str, rng: random.Random) -> Iterator[tuple[str, bool]]:
    """Other ways to write an entity (True) and look-alikes that are none (False)."""
    digits = "".join(c for c in text if c.isdigit())
    yield text, True
    if kind == "phone":
        d = "".join(rng.choice("0123456789") for _ in range(10))
        for form in rng.sample([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"({d[:3]}) {d[3:6]} {d[6:]}", f"{d[:3]} {d[3:6]} {d[6:]}"], 3):
            yield form, True
        yield rng.choice([f"{d[:4]}-{d[4:6]}-{d[6:8]}", f"{d[:4]}.{d[4:6]}", f"{d[:2]}:{d[2:4]}", f"{d[:5]}", f"{d[:8]}", f"{d[:3]} {d[3:6]}"]), False
    elif kind == "card":
        yield rng.choice([".", "  ", "/"]).join(digits[i : i + 4] for i in range(0, len(digits), 4)), True
        yield digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10), False
        yield _number_row(rng), False
    elif kind == "ip":
        yield text.replace(".", "-"), False
        yield ".".join(str(rng.randint(256, 999)) for _ in range(4)), False
        yield ".".join(text.split(".")[:3]), False
    elif kind == "email":
        letters = lambda low, high: "".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(low, high)))
        # names and hosts of any form, not only those that the texts happen to have
        spoken = lambda t: t.upper() if rng.random() < 0.3 else t
        for _ in range(3):
            local = rng.choice([text.partition("@")[0], letters(3, 9), f"{letters(2, 6)}.{letters(3, 8)}", f"{letters(1, 3)}_{letters(3, 6)}", f"{letters(3, 7)}{rng.randint(1, 99)}"])
            domain = rng.choice([text.partition("@")[2], f"{letters(3, 9)}.{letters(2, 3)}", f"{letters(3, 6)}{rng.randint(1, 9)}.{letters(3, 8)}.{letters(2, 3)}", f"{letters(2, 5)}-{letters(2, 5)}.{letters(2, 4)}"])
            yield spoken(f"{local} at {domain.replace('.', ' dot ')}"), True
            yield spoken(f"{local} {rng.choice(['[at]', '(at)', '{at}'])} {domain.replace('.', rng.choice(['.', ' dot ', ' [dot] ', ' (dot) ']))}"), True
        yield rng.choice([f"@{local}", f"{local} at {local} dot", domain, f"{letters(3, 7)} at {letters(4, 8)}", f"{letters(3, 6)} at the dot {letters(3, 6)}"]), False
        yield f"{letters(3, 6)} at the dot {letters(3, 6)}", False


def train(texts: list[str], seed: int = 7) -> Field:
    """A field trained on windows around base matches of the texts: SPANS of each at most, EXAMPLES windows of up to TOKENS tokens in all."""
    rng, examples = random.Random(seed), []
    for text in texts:
        for start, end, kind in base_spans(text)[:SPANS]:
            left, right = text[max(0, start - 50) : start], text[end : end + 40]
            for written_as, real in _variants(kind, text[start:end], rng):
                lead = left if rng.random() < 0.7 else f"{left} {rng.choice(CUES[kind])}: " if real else left
                made = lead + written_as + right
                s, e = len(lead), len(lead) + len(written_as)
                for tokens in windows(made):
                    gold, broken = [], False
                    spans = [(s, e, kind)] * real + base_spans(made)
                    for bs, be, bk in spans:
                        inner = [i for i, t in enumerate(tokens) if bs < t[1] and t[0] < be]
                        if inner and not any(a < inner[-1] + 1 and inner[0] < b for a, b, _ in gold):
                            broken |= tokens[inner[0]][0] != bs or tokens[inner[-1]][1] != be
                            gold.append((inner[0], inner[-1] + 1, KINDS.index(bk)))
                    if broken:  # a span that starts or ends inside a token
                        continue
                    if len(tokens) <= TOKENS:
                        examples.append((tokens, gold))
    rng.shuffle(examples)
    field = Field()
    field.fit(examples[:EXAMPLES])
    return field


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: base ones and those that the field adds beside them."""
    base = base_spans(text)
    added = []
    for tokens in windows(text):
        for i, j, kind in field.best(tokens):
            s, e = tokens[i][0], tokens[j - 1][1]
            if not any(s < b[1] and b[0] < e for b in base):
                added.append((s, e, KINDS[kind]))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def _find(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    write = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
    for batch in slices(batches, 1000):
        rows = []
        for text in batch.column(1).to_pylist():
            base, spans = all_spans(text, field) if text else ([], [])
            rows.append((*(sum(k == kind for *_, k in base) for kind in KINDS), hashlib.sha256(write(base).encode()).hexdigest(), write(spans)))
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4]), pa.array(columns[5])], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def fit_field(docs: DataFrame, labelled: int = LABELLED) -> Field:
    """A field trained on at most ``labelled`` distinct texts (those first by their hash) with a digit and an at-sign or plus, or a long number.

    Hashes are chosen first and alone; the driver gets only the chosen texts, of under 20,000 characters each.
    """
    hashed = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    fits = (F.length("text") < 20_000) & F.col("text").rlike(r"[0-9]@|@[a-z]|\+[0-9]|[0-9]{12}|[0-9]\.[0-9]+\.[0-9]")
    chosen = hashed.where(fits).select("h").distinct().orderBy("h").limit(labelled).collect()
    if not chosen:
        return train([])
    texts = hashed.where(F.col("h") <= chosen[-1]["h"]).where(fits).groupBy("h").agg(F.min("text").alias("text"))
    return train([r["text"] for r in texts.orderBy("h").collect()])


def find_personal_data(docs: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans.

    Spans are written kind:start:end, in code points, end exclusive, by start and then kind, joined by
    commas. A null or empty text has none; repeated rows are rows of their own; a null doc_id stays null;
    an empty table gives an empty result; other columns are not read.
    """
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs, labelled))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _find(it, field.value), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def _redact(batches: Iterator[pa.RecordBatch], field: Field, at: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1000):
        out = []
        for text in batch.column(at).to_pylist():
            if text:
                parts, low = [], 0
                for s, e, kind in all_spans(text, field)[1]:
                    if e > low:
                        parts += [text[low : max(low, s)], f"[{kind.upper()}]"] if s >= low else []
                        low = e
                text = "".join(parts) + text[low:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([pa.array(out, batch.column(i).type) if i == at else batch.column(i) for i in range(batch.num_columns)], schema=batch.schema)


def redact(docs: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets; other columns stay."""
    field = docs.sparkSession.sparkContext.broadcast(fit_field(docs, labelled))
    at = docs.columns.index("text")
    return docs.mapInArrow(lambda it: _redact(it, field.value, at), docs.schema)
