"""Personal data: base patterns and a character-level bidirectional LSTM with CRF transitions.

Base spans (e-mail addresses, IP addresses, card and phone numbers) come from fixed patterns, found in linear time. The
tagger adds spans that the patterns miss, such as phone numbers without a country code in the forms of the United
States, Germany, France, Spain and Britain. It is trained in numpy from labelled spans (by default a generated, seeded set
of MAX_EXAMPLES texts), then whole texts are cut into overlapping windows, each window is decoded by Viterbi under the
transitions, and the windows' spans are reconciled over the whole text: of two windows that see a span whole, the one
whose middle is nearer to it decides; pieces that windows' edges have cut off are put together where they overlap.

Every kind contains a trigger, a digit or an @. The automaton of the decoding holds that rule: its states tell whether the
open span has had a trigger, and only spans that have may end. A window without a trigger has one path, that of no span, so
such windows are not run; run or not, the result is the same, and the tests compare both.

What a decoded span must hold besides, whatever the tagger says (see plausible()): an e-mail address an @ between other
characters and a dot; an IP address three dots and four digits; a card number 13 to 19 digits that pass Luhn; a phone number 9
to 15 digits, one separator at least, and nothing but digits and separators. So runs of digits without a separator are no
phone numbers. Added spans never overlap base spans, which all stay; a French number with dots (06.12.34.56.78) begins with
what the pattern of IP addresses takes, so only that part is found.

Defined results: null and empty texts have no span; texts shorter than a window are one window; repeated rows give
repeated results; an empty table gives an empty result; redact() lets further columns through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copse.llm.common import read, ship

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
#: Generated training texts, and passes over them.
MAX_EXAMPLES, EPOCHS = 1200, 14
HIDDEN, EMBED = 12, 8
#: Windows that go through the network together.
BATCH = 256

Span = tuple[str, int, int]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost matches of the e-mail pattern: for each @, the longest run of local characters before it that is still free."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(int(p[-4:] if len(p) < 4 or not p[:-4].strip("0") else "999") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# The tagger -----------------------------------------------------------------------------------------------------

#: Tags: 0 outside; 1 + 2k begins kind k, 2 + 2k goes on in it.
TAGS = 1 + 2 * len(KINDS)
_PLAIN = "@.-+()_%:/,;# \n'\"=*"
#: Classes of characters: lower-case letters one by one, capitals, digits, other letters, marks one by one, others.
CLASSES = 26 + 4 + len(_PLAIN)


def _class_table() -> np.ndarray:
    t = np.full(256, 29, np.uint8)
    t[97:123] = np.arange(26)
    t[65:91], t[48:58], t[192:256] = 26, 27, 28
    for i, c in enumerate(_PLAIN):
        t[ord(c)] = 30 + i
    return t


_TABLE = _class_table()
#: Classes of the characters without which no kind can be: digits and @.
TRIGGERS = (27, 30 + _PLAIN.index("@"))


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(codes < 256, _TABLE[np.minimum(codes, 255)], np.where(codes < 0x2000, 28, 29)).astype(np.uint8)


def allowed() -> tuple[np.ndarray, np.ndarray]:
    """Transitions and first tags that make sense: a kind only goes on after its beginning or itself."""
    step, first = np.ones((TAGS, TAGS), bool), np.ones(TAGS, bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        step[:, inside] = False
        step[[inside - 1, inside], inside] = True
        first[inside] = False
    return step, first


class Automaton:
    """States of the decoding: outside, and five for each kind, which tell whether its span has had a trigger.

    begun without, begun with, goes on without, goes on at a trigger, goes on after one. A span that has had none can only go on.
    """

    def __init__(self) -> None:
        n = 1 + 5 * len(KINDS)
        self.tag = np.zeros(n, np.intp)
        self.at_trigger = np.ones(n, bool)  # states that a trigger can be in
        self.elsewhere = np.ones(n, bool)
        self.step = np.zeros((n, n), bool)
        self.first, self.last = np.zeros(n, bool), np.zeros(n, bool)
        ends, begins = [0], [0]
        for k in range(len(KINDS)):
            begun, begun_with, bare, hit, after = range(1 + 5 * k, 6 + 5 * k)
            self.tag[[begun, begun_with]], self.tag[[bare, hit, after]] = 1 + 2 * k, 2 + 2 * k
            self.at_trigger[[begun, bare, after]] = False
            self.elsewhere[[begun_with, hit]] = False
            for a, b in ((begun, bare), (bare, bare), (begun, hit), (bare, hit), (begun_with, hit), (hit, hit), (after, hit), (begun_with, after), (hit, after), (after, after)):
                self.step[a, b] = True
            ends += [begun_with, hit, after]
            begins += [begun, begun_with]
        self.step[np.ix_(ends, begins)] = True
        self.first[begins] = self.last[ends] = True


class Tagger:
    """Bidirectional LSTM, one output layer, CRF. Arrays are (time, batch, ...)."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        h, e = HIDDEN, EMBED
        r = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"embed": r(CLASSES, e), "out": r(2 * h, TAGS), "bias": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {"x" + d: r(e, 4 * h), "h" + d: r(h, 4 * h), "b" + d: np.concatenate([np.ones(h), np.zeros(3 * h)]).astype(np.float32)}
        self.step_ok, self.first_ok = allowed()
        self.automaton = Automaton()

    def _lstm(self, x: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """x: classes (time, batch); gates forget, input, output, cell. The input part is one table row a class."""
        table, wh, n = self.p["embed"] @ self.p["x" + d] + self.p["b" + d], self.p["h" + d], HIDDEN
        h = c = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((x.shape[0], x.shape[1], n), np.float32)
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            z = table[x[t]] + h @ wh
            z[:, : 3 * n] *= 0.5
            a = np.tanh(z)
            s = 0.5 * a[:, : 3 * n] + 0.5
            c_new = s[:, :n] * c + s[:, n : 2 * n] * a[:, 3 * n :]
            tc = np.tanh(c_new)
            h_new = s[:, 2 * n :] * tc
            if keep is not None:
                keep.append((t, h, c, s, a[:, 3 * n :], tc))
            h, c = h_new, c_new
            out[t] = h
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._lstm(x, "f", None), self._lstm(x, "b", None)], 2)
        return both @ self.p["out"] + self.p["bias"]

    def _masked(self) -> np.ndarray:
        return np.where(self.step_ok, self.p["step"], -1e4).astype(np.float32)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Viterbi over the automaton's states: the best tags (time, batch)."""
        m, no = self.automaton, np.float32(-1e4)
        trigger = np.isin(x, TRIGGERS)[:, :, None]
        u = np.where(np.where(trigger, m.at_trigger, m.elsewhere), self.scores(x)[:, :, m.tag], no)
        step = np.where(m.step, self.p["step"][np.ix_(m.tag, m.tag)], no).astype(np.float32)
        best = np.where(m.first, u[0], no)
        back = np.empty(u.shape, np.uint8)
        for t in range(1, len(u)):
            s = best[:, :, None] + step
            back[t] = s.argmax(1)
            best = np.take_along_axis(s, back[t][:, None, :].astype(np.intp), 1)[:, 0] + u[t]
        states = np.empty(x.shape, np.uint8)
        states[-1] = np.where(m.last, best, 4 * len(u) * no).argmax(1)
        rows = np.arange(x.shape[1])
        for t in range(len(u) - 1, 0, -1):
            states[t - 1] = back[t][rows, states[t]]
        return m.tag[states].astype(np.uint8)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Of the mean negative log-likelihood of tags y."""
        n, kf, kb = HIDDEN, [], []
        both = np.concatenate([self._lstm(x, "f", kf), self._lstm(x, "b", kb)], 2)
        u, step = both @ self.p["out"] + self.p["bias"], self._masked()
        steps, batch = x.shape
        log = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty(u.shape, np.float32), np.zeros(u.shape, np.float32)
        alpha[0] = np.where(self.first_ok, u[0], -1e4)
        for t in range(1, steps):
            alpha[t] = log(alpha[t - 1][:, :, None] + step, 1) + u[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = log(step + (u[t + 1] + beta[t + 1])[:, None, :], 2)
        whole = log(alpha[-1], 1)
        du = np.exp(alpha + beta - whole[None, :, None])
        dstep = np.zeros_like(step)
        for t in range(1, steps):
            dstep += np.exp(alpha[t - 1][:, :, None] + step + (u[t] + beta[t])[:, None, :] - whole[:, None, None]).sum(0)
        rows = np.arange(batch)
        gold = sum(u[t, rows, y[t]] for t in range(steps)) + sum(step[y[t - 1], y[t]] for t in range(1, steps))
        for t in range(steps):
            du[t, rows, y[t]] -= 1
        np.add.at(dstep, (y[:-1].ravel(), y[1:].ravel()), -1)
        du /= batch
        g = {"step": dstep / batch * self.step_ok, "bias": du.sum((0, 1)), "out": both.reshape(-1, 2 * n).T @ du.reshape(-1, TAGS), "embed": np.zeros_like(self.p["embed"])}
        dboth = du @ self.p["out"].T
        for d, keep, dout in (("f", kf, dboth[:, :, :n]), ("b", kb, dboth[:, :, n:])):
            dtable, dwh = np.zeros((CLASSES, 4 * n), np.float32), np.zeros_like(self.p["h" + d])
            dh = dc = np.zeros((batch, n), np.float32)
            for t, h, c, s, a, tc in reversed(keep):
                dh = dh + dout[t]
                dc = dc + dh * s[:, 2 * n :] * (1 - tc * tc)
                dz = np.concatenate([dc * c, dc * a, dh * tc], 1) * s * (1 - s)
                dz = np.concatenate([dz, dc * s[:, n : 2 * n] * (1 - a * a)], 1)
                np.add.at(dtable, x[t], dz)
                dwh += h.T @ dz
                dc, dh = dc * s[:, :n], dz @ self.p["h" + d].T
            g |= {"x" + d: self.p["embed"].T @ dtable, "h" + d: dwh, "b" + d: dtable.sum(0)}
            g["embed"] += dtable @ self.p["x" + d].T
        return float((whole - gold).mean()), g


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a], y[a + 1 : b] = 1 + 2 * k, 2 + 2 * k
    return y


def train(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = 5) -> Tagger:
    """Fits a tagger to texts with labelled spans; each text is cut or filled up to one window."""
    rng, tagger = np.random.default_rng(seed), Tagger(seed)
    x, y = np.full((WINDOW, len(examples)), 30 + _PLAIN.index("\n"), np.uint8), np.zeros((WINDOW, len(examples)), np.int64)
    for i, (text, spans) in enumerate(examples):
        n = min(len(text), WINDOW)
        x[:n, i] = classes(text)[:n]
        y[:n, i] = tags_of(len(text), [s for s in spans if s[2] <= WINDOW])[:n]
    m, v, t = {k: np.zeros_like(p) for k, p in tagger.p.items()}, {k: np.zeros_like(p) for k, p in tagger.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        rate = 0.02 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            _, g = tagger.gradients(x[:, pick], y[:, pick])
            norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
            t += 1
            for k, d in g.items():
                d = d * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.99 * v[k] + 0.01 * d * d
                tagger.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return tagger


def generated(n: int = MAX_EXAMPLES, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Labelled texts: invented words with personal data in common forms, and with numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    letters = lambda a, b: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(a, b)))

    def word() -> str:
        w = "".join(pick("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "é", "sch", "ung", "eau", "ción", "ñ", "ü") for _ in range(rng.integers(1, 5)))
        return pick(w, w, w, w.capitalize(), w.upper(), w + pick(".", ",", "."), "a", "the")

    def email() -> str:
        name = pick(letters(3, 9), letters(2, 8) + "." + digits(2), letters(3, 7) + "_" + letters(3, 7), letters(3, 7) + "." + letters(3, 8), letters(3, 7) + digits(3))
        return name + "@" + pick("mail" + digits(1), letters(3, 9), letters(3, 8) + "." + letters(2, 6)) + "." + pick("com", "org", "net", "de", "fr", "co.uk", "example.com")

    def card() -> str:
        body = pick("4", "5", "37", "6011")
        body += digits(15 - len(body))
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        s, sep = body + last, pick("", "", " ", "-")
        return sep.join(s[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        if rng.random() < 0.4:
            return pick(f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {a} {b}{c}", f"1-{a}-{b}-{c}")
        return pick(german, french, spanish, british)()

    def german() -> str:
        area, rest = "0" + pick("30", "40", "89", "171", "151", "176", "221", "6221", digits(2), digits(3), digits(4)), digits(rng.integers(6, 9))
        half = len(rest) // 2
        return pick(f"{area} {rest}", f"{area}/{rest}", f"{area}-{rest}", f"{area}/{rest}", f"({area}) {rest}", f"{area} / {rest}", f"{area} {rest[:half]} {rest[half:]}", f"{area}/{rest[:half]} {rest[half:]}", f"{area} {rest[:-2]}-{rest[-2:]}")

    def french() -> str:
        sep = pick(" ", " ", "-")
        return sep.join(["0" + str(rng.integers(1, 10)), *(digits(2) for _ in range(4))])

    def spanish() -> str:
        d, sep = pick("6", "7", "9") + digits(8), pick(" ", " ", "-")
        return sep.join(pick([d[:3], d[3:6], d[6:]], [d[:2], d[2:5], d[5:7], d[7:]], [d[:3], d[3:5], d[5:7], d[7:]]))

    def british() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"020 {c} {digits(4)}", f"(020) {c} {digits(4)}", f"07{digits(3)} {digits(6)}", f"07{digits(3)} {a} {b}", f"01{digits(3)} {digits(6)}", f"01{digits(2)} {a} {c}", f"(01{digits(3)}) {digits(6)}", f"0{digits(3)}-{a}-{c}")

    ip = lambda: ".".join(str(x) for x in rng.integers(1, 256, 4))

    def none() -> str:
        return pick(digits(rng.integers(1, 5)), "19" + digits(2), digits(2) + ".", f"{digits(1)}.{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"20{digits(2)}-0{digits(1)}-1{digits(1)}", f"#{digits(5)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(1)},{digits(3)},{digits(3)}", "CC BY-NC 4.0.", "id " + digits(9), digits(12), letters(5, 9) + digits(3), f"{digits(2)} %", "sk_" + letters(8, 14) + digits(6), "AKIA" + letters(8, 12).upper() + digits(4), letters(6, 9) + digits(5) + letters(5, 9), f"(c) 20{digits(2)}", f"p. {digits(3)}-{digits(3)}", f"{1 + int(digits(1))} {digits(3)} {digits(3)}", f"{digits(1)}.{digits(3)}.{digits(3)}", f"{digits(2)}.{digits(2)}.20{digits(2)}", f"19{digits(2)}-20{digits(2)}", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(5)} {word()}", "@" + letters(4, 9), letters(3, 6) + " @ " + letters(3, 6))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0
        start = " ".join(word() for _ in range(rng.integers(0, 7)))
        items: list[tuple[str | None, str]] = [(None, start)] if start else []
        for _ in range(rng.integers(1, 4)):
            kind = pick(None, *KINDS)
            items.append((kind, make[kind]() if kind else none()))
            items += [(None, word()) for _ in range(rng.integers(0, 4))]
        for kind, s in items:
            if parts:
                sep = pick(" ", " ", " ", " ", "\n", ", ", ": ")
                parts.append(sep)
                at += len(sep)
            if kind:
                spans.append((kind, at, at + len(s)))
            parts.append(s)
            at += len(s)
        out.append(("".join(parts), spans))
    return out


@lru_cache(maxsize=1)
def default_tagger() -> Tagger:
    return train(generated())


def found(tags: list[int]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the spans that tags of a window name."""
    out, open_ = [], None
    for i, t in enumerate([*tags, 0]):
        if open_ and t != 2 + 2 * open_[0]:
            out.append((*open_, i))
            open_ = None
        if t and t & 1:
            open_ = ((t - 1) // 2, i)
    return out


def plausible(kind: str, s: str) -> bool:
    """What a span of each kind must hold."""
    n = sum(c in "0123456789" for c in s)
    if kind == "email":
        return "@" in s[1:-1] and "." in s
    if kind == "ip":
        return s.count(".") == 3 and n >= 4
    if s[0] not in "(+0123456789" or s[-1] not in "0123456789":
        return False
    if kind == "card":
        return 13 <= n <= 19 and luhn("".join(c for c in s if c in "0123456789"))
    # dates and spans of years have eight digits at most
    return 9 <= n <= 15 and len(s) > n and not re.search(r"[^-0-9+()./\x20\u00a0]", s)


def starts_of(length: int) -> range:
    """Where windows begin: on a grid, so that a text's windows don't depend on what they hold."""
    return range(0, max(1, length - WINDOW + STRIDE), STRIDE)


_TRIGGER = re.compile(r"[0-9@]")


def with_trigger(text: str) -> list[int]:
    """Beginnings of the windows that have a trigger; in the others the automaton has no path but that of no span."""
    wanted: dict[int, None] = {}
    for m in _TRIGGER.finditer(text):
        last = m.start() // STRIDE
        for w in range(max(0, (m.start() - WINDOW) // STRIDE + 1), last + 1):
            if w * STRIDE in starts_of(len(text)):
                wanted[w * STRIDE] = None
    return list(wanted)


def tagged_spans(texts: list[str], tagger: Tagger, every: bool = False) -> list[list[Span]]:
    """The tagger's spans of whole texts: overlapping windows, reconciled. every: windows without a trigger are run, too."""
    jobs = [(i, s) for i, t in enumerate(texts) for s in (starts_of(len(t)) if every else with_trigger(t))]
    seen: list[list[tuple[float, str, int, int]]] = [[] for _ in texts]
    pieces: list[list[tuple[str, int, int, bool, bool]]] = [[] for _ in texts]
    for at in range(0, len(jobs), BATCH):
        part = jobs[at : at + BATCH]
        x = np.full((WINDOW, len(part)), 30 + _PLAIN.index("\n"), np.uint8)
        for j, (i, s) in enumerate(part):
            c = classes(texts[i][s : s + WINDOW])
            x[: len(c), j] = c
        tags = tagger.decode(x)
        for j in np.flatnonzero(tags.any(0)).tolist():
            i, s = part[j]
            for k, a, b in found(tags[:, j].tolist()):
                a, b = s + a, min(s + b, len(texts[i]))
                # a span that touches a window's edge, unless the text ends there, may go on in the neighbour
                left, right = a == s and s > 0, b == s + WINDOW and b < len(texts[i])
                if left or right:
                    pieces[i].append((KINDS[k], a, b, left, right))
                elif a < b:
                    seen[i].append((abs((a + b) / 2 - s - WINDOW / 2), KINDS[k], a, b))
    return [reconciled(spans, cut) for spans, cut in zip(seen, pieces, strict=True)]


def reconciled(spans: list[tuple[float, str, int, int]], cut: list[tuple[str, int, int, bool, bool]]) -> list[Span]:
    """Whole spans by how near they lie to their window's middle; then pieces that overlap, put together, if both ends are there."""
    taken: list[Span] = []
    for _, kind, a, b in sorted(spans, key=lambda x: (x[0], x[2], x[3], x[1])):
        if all(b <= c or d <= a for _, c, d in taken):
            taken.append((kind, a, b))
    longer: list[list] = []
    for kind, a, b, left, right in sorted(cut):
        if not all(b <= c or d <= a for _, c, d in taken):
            continue
        if longer and longer[-1][0] == kind and a < longer[-1][2]:
            if b > longer[-1][2]:
                longer[-1][2], longer[-1][4] = b, right
        else:
            longer.append([kind, a, b, left, right])
    for kind, a, b, left, right in longer:
        if not left and not right and all(b <= c or d <= a for _, c, d in taken):
            taken.append((kind, a, b))
    return taken


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind, then start."""
    out = []
    for text, tagged in zip(texts, tagged_spans(texts, tagger), strict=True):
        base = base_spans(text)
        held = sorted((a, b) for _, a, b in base)
        at, added = [a for a, _ in held], []
        ends = list(np.maximum.accumulate([b for _, b in held])) if held else []
        for kind, a, b in tagged:
            k = int(np.searchsorted(at, b))  # base spans that begin before b
            if (k == 0 or ends[k - 1] <= a) and plausible(kind, text[a:b]):
                added.append((kind, a, b))
        out.append((base, sorted([*base, *added], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end), code points, end exclusive."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((tagger or default_tagger()).p)
    rows = docs.select(docs[doc_id].alias("doc_id"), docs[text].cast("string").alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.pii import Tagger, all_spans

        model = Tagger()
        model.p = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                pairs = all_spans([t or "" for t in b.column(1).to_pylist()], model)
                listed = [pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in p[side]] for p in pairs], arrow) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0), *listed], ["doc_id", "base", "spans"])

    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", tagger: Tagger | None = None) -> DataFrame:
    """docs with every span of personal data replaced by its kind; null texts stay null, other columns as they are."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((tagger or default_tagger()).p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from copse.llm.pii import Tagger, all_spans, masked

        model = Tagger()
        model.p = shared.value
        for whole in batches:
            at = whole.schema.get_field_index(text)
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                texts = b.column(at).to_pylist()
                clean = [t if t is None or not s else masked(t, s) for t, (_, s) in zip(texts, all_spans([t or "" for t in texts], model), strict=True)]
                columns = list(b.columns)
                columns[at] = pa.array(clean, b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base_sha256 are of the base spans, which the contract fixes; the column spans has the tagger's, too."""
    found_ = find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found_.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"))
