"""Personal data spans: fixed patterns, and a character BiLSTM-CRF that adds to them.

The base patterns (email, ip, card, phone) give the spans that always stay.  A
character-level bidirectional LSTM with CRF transitions, trained in numpy from
labelled spans, reads overlapping windows; each window is decoded by Viterbi,
every character takes the label of the window in which it lies deepest, and
spans are read from that one label sequence of the whole text.  What it reads
besides the base spans is added: national phone numbers, cards with a wrong digit
or in groups that the patterns do not know, written-out addresses such as
``jane at example dot org`` and addresses with ``[.]``.  An added span is a whole
token (no letter or digit beside it), does not touch a base span and has the least
a thing of its kind must have (7 digits of a phone number, 12 of a card, 4 numbers
of an address, an @ or an "at"); all else is the network's decision.

Every span of these kinds has a digit, an @, a bracketed "at" or the word "dot", so
texts and windows without any are "outside" and are not sent through the network.
Whole texts are read: windows cover every place within ``REACH`` characters of one.

Training data are generated (``labelled_examples``): entities in many formats
among words of the corpus at hand (``filler``: words of about ``SAMPLE`` documents
that have no digit and no @) and look-alikes that are not personal data.  Whole
formats can be held out; tests do so, and use sentences labelled by hand.
Weights are the same for the same seed and filler; training takes some seconds on
the driver, and the weights (some 40 kB) are broadcast.

Defined cases: null counts as empty; a text without spans has zero counts, the
hash of the empty string and empty ``spans``; offsets are code points, end
exclusive; repeated rows are scanned each; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import textnp as tx

KINDS = ("email", "ip", "card", "phone")
#: Window length and step in characters, and how far from a digit or @ windows reach.
WINDOW, STEP, REACH = 64, 32, 32
HIDDEN = 16
#: Documents whose words stand around the entities of the training data, in expectation, and distinct words taken of them at most.
SAMPLE, FILLER = 200, 20_000
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind

# ---------------------------------------------------------------- base patterns

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _card_ok(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(text: str) -> bool:
    return 9 <= len(_digits(text)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), leftmost and not overlapping within each kind; failing matches are passed over."""
    out = []
    if "@" in text:
        free = 0  # the next match may start here
        for m in _DOMAIN.finditer(text):
            if m.start() < free:
                continue
            start = m.start()
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append(("email", start, m.end()))
                free = m.end()
    # A match of the address pattern starts where a run of digits does: what precedes it, or the last match, is no digit.
    out += [("ip", *m.span()) for m in _IP.finditer(text) if _ip_ok(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if _phone_ok(m[0])]
    return out


# ---------------------------------------------------------------- characters

_ASCII = np.zeros(128, dtype=np.int64)
_PLAIN = "@.-_+() \n:/,#*$%&=\"'|;!?<>[]{}"
for _i, _c in enumerate(_PLAIN):
    _ASCII[ord(_c)] = 3 + _i
_ASCII[0x30:0x3A] = 1
_ASCII[0x61:0x7B] = _ASCII[0x41:0x5B] = 3 + len(_PLAIN) + np.arange(26)
CLASSES = 3 + len(_PLAIN) + 26  # 0: other ASCII, 1: digit, 2: beyond ASCII


def char_classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(code < 128, _ASCII[np.minimum(code, 127)], 2)


# ---------------------------------------------------------------- labelled spans


def _word(rng) -> str:
    parts = ("th", "er", "on", "an", "re", "ha", "in", "ed", "nd", "ou", "ea", "sch", "ung", "eux", "ción", "ñ", "é", "ver", "lich", "oi", "tz", "ll", "ar", "os")
    word = "".join(rng.choice(parts) for _ in range(rng.integers(1, 5)))
    return word.capitalize() if rng.random() < 0.15 else word


def _number(rng, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _name(rng) -> str:
    return re.sub(r"[^a-z]", "", _word(rng).lower()) or "mail"


def _email(at: str, dot: str):
    def make(rng) -> str:
        local = _name(rng) + str(rng.choice(["", ".", "_", "-", "+"])) + (_number(rng, int(rng.integers(1, 4))) if rng.random() < 0.4 else _name(rng))
        host = str(rng.choice(["", "mail.", "m1."])) + _name(rng) + str(rng.choice(["", _number(rng, 1)])) + "." + str(rng.choice(["com", "org", "example.com", "co.uk", "de", "net", "fr", "es"]))
        return local + at + host.replace(".", dot)

    return make


def _card(sep: str, groups=(4, 4, 4, 4), valid=True):
    def make(rng) -> str:
        body = str(rng.choice([4, 5, 3, 6])) + _number(rng, sum(groups) - 2)
        digits = body + next(str(d) for d in (range(10) if valid else rng.permutation(10)) if luhn(body + str(d)) == valid)
        cuts = np.cumsum((0, *groups))
        return sep.join(digits[a:b] for a, b in zip(cuts[:-1], cuts[1:]))

    return make


def _phone(form: str):
    """Each n is a digit, each z one from 2 to 9."""
    return lambda rng: "".join(_number(rng, 1) if c == "n" else str(rng.integers(2, 10)) if c == "z" else c for c in form)


def _ip(dot: str):
    return lambda rng: dot.join(str(x) for x in rng.integers(0, 256, 4))


#: Formats by kind and name.  The base patterns know those of the first line of each kind.
FORMATS = {
    "email": {
        "plain": _email("@", "."),
        "spaced": _email(" @ ", "."), "square": _email(" [at] ", " [dot] "), "round": _email("(at)", "(dot)"), "words": _email(" at ", " dot "), "mixed": _email(" [at] ", "."), "loose": _email(" (at) ", " dot "), "curly": _email(" {at} ", " {dot} "),
    },
    "ip": {
        "plain": _ip("."),
        "square": _ip("[.]"), "round": _ip("(.)"), "dot": _ip("[dot]"),
    },
    "card": {
        "solid": _card(""), "spaces": _card(" "), "dashes": _card("-"), "short": _card(" ", (4, 6, 5)),
        "wrong": _card("", valid=False), "wrong spaces": _card(" ", valid=False), "wrong dashes": _card("-", valid=False), "dots": _card("."), "slashes": _card("/"), "wrong dots": _card(".", valid=False), "wrong short": _card(" ", (4, 6, 5), valid=False),
    },
    "phone": {
        "world": _phone("+1 (znn) nnn-nnnn"), "plus": _phone("+zn nnn nnn nnnn"), "plus dashes": _phone("+1-znn-nnn-nnnn"), "plus solid": _phone("+zznnnnnnnnnn"),
        "area": _phone("(znn) nnn-nnnn"), "dashes": _phone("znn-nnn-nnnn"), "dots": _phone("znn.nnn.nnnn"), "spaces": _phone("znn nnn nnnn"), "zero": _phone("0zn nnnnnnn"), "slash": _phone("0znn/nnnnnn"), "pairs": _phone("0z nn nn nn nn"), "double zero": _phone("00zn zn nnn nnnn"), "area space": _phone("(0zn) nnn nnnn"),
    },
}


def _lookalike(rng) -> str:
    n, r = lambda k: _number(rng, k), rng.integers
    forms = (
        lambda: "".join(rng.choice(list("0123456789abcdef"), int(r(16, 65)))),
        lambda: "".join(rng.choice(list("0123456789ABCDEFGHJKLMNPQRSTUVWXYZ"), int(r(8, 24)))),
        lambda: f"version {r(1, 9)}.{r(0, 20)}",
        lambda: f"{r(1990, 2030)}-{r(1, 13):02d}-{r(1, 29):02d}",
        lambda: f"{r(1, 29):02d}.{r(1, 13):02d}.{r(1990, 2030)}",
        lambda: f"{r(1, 29):02d}/{r(1, 13):02d}/{r(1990, 2030)}",
        lambda: f"{r(1990, 2030)}-{r(1, 13):02d}-{r(1, 29):02d}T{r(0, 24):02d}:{r(0, 60):02d}:{r(0, 60):02d}",
        lambda: f"{r(0, 24):02d}:{r(0, 60):02d}:{r(0, 60):02d}",
        lambda: n(int(r(1, 8))),
        lambda: n(int(r(20, 30))),
        lambda: f"1{r(5, 8)}{n(11)}",
        lambda: f"20{r(10, 30)}{r(1, 13):02d}{r(1, 29):02d}{n(6)}",
        lambda: f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        lambda: f"{r(1, 999)},{n(3)},{n(3)}",
        lambda: f"{r(1, 99)}.{n(3)}.{n(3)}",
        lambda: f"{r(1, 99)} {n(3)} {n(3)}",
        lambda: f"{n(3)}.{n(2)}",
        lambda: f"${r(1, 999)},{n(3)}.{n(2)}",
        lambda: f"{r(-90, 90)}.{n(5)}, {r(-180, 180)}.{n(5)}",
        lambda: f"CC BY-NC {r(1, 5)}.0.",
        lambda: f"@{_word(rng)}",
        lambda: f"{_word(rng)} at {_word(rng)}",
        lambda: f"the dot {_word(rng)}",
        lambda: f"C+{r(1, 30)}",
        lambda: f"{r(1, 100)}%",
        lambda: f"#{n(int(r(3, 9)))}",
        lambda: f"{r(1, 400)}-{r(1, 400)}",
        lambda: f"{r(1900, 2000)}-{r(2000, 2030)}",
        lambda: f"{_name(rng).upper()[:3]}-{n(5)}-{n(2)}",
        lambda: f"{r(1, 99)} + {r(1, 99)} = {r(1, 199)}",
        lambda: f"1.{r(1, 9)}.{r(1, 9)}",
    )
    return str(forms[r(0, len(forms))]())


def labelled_examples(n: int, seed: int, filler: list[str] | None = None, formats: dict | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts of filler words (invented ones by default), entities in ``formats`` and look-alikes, with their labelled spans."""
    rng = np.random.default_rng(seed)
    formats = formats or FORMATS
    makers = {k: list(v.values()) for k, v in formats.items() if v}
    kinds = list(makers)
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW + 40:
            roll = rng.random()
            if roll < 0.16:
                kind = kinds[rng.integers(0, len(kinds))]
                thing = makers[kind][rng.integers(0, len(makers[kind]))](rng)
                spans.append((kind, len(text), len(text) + len(thing)))
                if rng.random() < 0.1:  # the same twice, side by side
                    text += thing + " "
                    spans.append((kind, len(text), len(text) + len(thing)))
            elif roll < 0.3:
                thing = _lookalike(rng)
            else:
                thing = filler[rng.integers(0, len(filler))] if filler and roll < 0.8 else _word(rng)
            text += thing + str(rng.choice([" ", " ", " ", ", ", ". ", ".\n", "\n", " | ", ": ", "$$$ ", "### ", ")"]))
        out.append((text, spans))
    return out


def filler_words(docs: DataFrame, sample: int = SAMPLE) -> list[str]:
    """Distinct words without digit and @ of about ``sample`` whole documents, at most ``FILLER``, in the order of their hash."""
    n = docs.select("doc_id").count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    some = docs.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("filler")), F.lit(1 << 20)) < share)
    words = some.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+")).alias("w")).filter("w rlike '^[^0-9@]{1,24}$'").distinct()
    return [r.w for r in words.orderBy(F.xxhash64("w"), "w").limit(FILLER).collect()]


def _targets(text: str, spans) -> np.ndarray:
    y = np.zeros(len(text), dtype=np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 + 2 * k
        y[a] = 1 + 2 * k
    return y


# ---------------------------------------------------------------- the network


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


#: Transitions that a label sequence cannot have: inside a kind after anything but that kind.
_BARRED = np.zeros((LABELS, LABELS), dtype=np.float32)
for _k in range(len(KINDS)):
    _BARRED[:, 2 + 2 * _k] = -1e4
    _BARRED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
_FIRST = np.zeros(LABELS, dtype=np.float32)  # a window may start inside a span


class Network:
    """Parameters of the BiLSTM-CRF; arrays are time x batch."""

    NAMES = ("xf", "hf", "bf", "xb", "hb", "bb", "out", "bias", "trans")

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        shape = {"xf": (CLASSES, 4 * h), "hf": (h, 4 * h), "bf": (4 * h,), "xb": (CLASSES, 4 * h), "hb": (h, 4 * h), "bb": (4 * h,), "out": (2 * h, LABELS), "bias": (LABELS,), "trans": (LABELS, LABELS)}
        self.p = {k: (rng.normal(0, 0.3, s) if len(s) == 2 and k != "trans" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for b in ("bf", "bb"):
            self.p[b][h : 2 * h] = 1  # remember at first

    def _both(self, name: str) -> np.ndarray:
        """A parameter of both directions."""
        return np.stack((self.p[f"{name}f"], self.p[f"{name}b"]))

    def _run(self, x, keep: bool):
        """Outputs of both directions side by side: direction, time, batch; the second one reads backwards."""
        t, n = x.shape
        wx, wh, b = self._both("x"), self._both("h"), self._both("b")
        given = np.stack((wx[0][x], wx[1][x[::-1]]), axis=1) + b[:, None]
        h = c = np.zeros((2, n, HIDDEN), dtype=wh.dtype)
        out, kept = np.empty((t, 2, n, HIDDEN), dtype=wh.dtype), []
        for i in range(t):
            z = given[i] + h @ wh
            gates = _sigmoid(z[..., : 3 * HIDDEN])
            g = np.tanh(z[..., 3 * HIDDEN :])
            before = c
            c = gates[..., HIDDEN : 2 * HIDDEN] * before + gates[..., :HIDDEN] * g
            tc = np.tanh(c)
            if keep:
                kept.append((h, before, gates, g, tc))
            h = gates[..., 2 * HIDDEN :] * tc
            out[i] = h
        return out, kept

    def _back(self, x, kept, dout) -> dict:
        t, n = x.shape
        wh = self._both("h")
        back = wh.transpose(0, 2, 1)
        every = np.empty((t, 2, n, 4 * HIDDEN), dtype=wh.dtype)
        dh = dc = np.zeros((2, n, HIDDEN), dtype=wh.dtype)
        for i in range(t - 1, -1, -1):
            _, before, gates, g, tc = kept[i]
            i_, f, o = gates[..., :HIDDEN], gates[..., HIDDEN : 2 * HIDDEN], gates[..., 2 * HIDDEN :]
            d = dout[i] + dh
            dc = dc + d * o * (1 - tc * tc)
            dz = every[i]
            dz[..., :HIDDEN], dz[..., HIDDEN : 2 * HIDDEN] = dc * g * i_, dc * before * f
            dz[..., 2 * HIDDEN : 3 * HIDDEN], dz[..., 3 * HIDDEN :] = d * tc * o, dc * i_ * (1 - g * g)
            dz[..., : 3 * HIDDEN] *= 1 - gates
            dh, dc = dz @ back, dc * f
        grads = {}
        for k, (name, read) in enumerate((("f", x), ("b", x[::-1]))):
            flat = every[:, k].reshape(t * n, -1)
            kind = (read.reshape(-1, 1) == np.arange(CLASSES)).astype(wh.dtype)
            grads |= {f"x{name}": kind.T @ flat, f"h{name}": np.concatenate([step[0][k] for step in kept]).T @ flat, f"b{name}": flat.sum(axis=0)}
        return grads

    def emissions(self, x, keep=False):
        out, kept = self._run(x, keep)
        both = np.concatenate((out[:, 0], out[::-1, 1]), axis=2)
        return both @ self.p["out"] + self.p["bias"], both, kept

    def gradients(self, x, y):
        """Loss of label sequences and gradients of all parameters."""
        p = self.p
        e, both, kept = self.emissions(x, keep=True)
        t, n, _ = e.shape
        # forward and backward sums, scaled to one at every step
        step, top = np.exp(p["trans"] + _BARRED).astype(e.dtype), e.max(axis=2, keepdims=True)
        here = np.exp(e - top)
        alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((t, n, 1), dtype=e.dtype)
        alpha[0] = here[0] * np.exp(_FIRST)
        for i in range(t):
            if i:
                alpha[i] = (alpha[i - 1] @ step) * here[i]
            scale[i] = alpha[i].sum(axis=1, keepdims=True)
            alpha[i] /= scale[i]
        here /= scale
        for i in range(t - 2, -1, -1):
            beta[i] = (here[i + 1] * beta[i + 1]) @ step.T
        gold = np.take_along_axis(e, y[:, :, None], axis=2).sum() + (p["trans"] + _BARRED)[y[:-1], y[1:]].sum()
        loss = float(np.log(scale).sum() + top.sum() - gold) / (n * t)
        de = alpha * beta
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], axis=2) - 1, axis=2)
        gt = step * (alpha[:-1].reshape(-1, LABELS).T @ (here[1:] * beta[1:]).reshape(-1, LABELS))
        gt = gt - np.bincount((y[:-1] * LABELS + y[1:]).ravel(), minlength=LABELS * LABELS).reshape(LABELS, LABELS)
        de /= n * t
        dboth = de @ p["out"].T
        dout = np.stack((dboth[:, :, :HIDDEN], dboth[::-1, :, HIDDEN:]), axis=1)
        return loss, {**self._back(x, kept, dout), "out": both.reshape(t * n, -1).T @ de.reshape(t * n, -1), "bias": de.sum(axis=(0, 1)), "trans": gt / (n * t)}

    def decode(self, x) -> np.ndarray:
        """Likeliest labels of every window, time x batch."""
        e = self.emissions(x)[0]
        t, n, _ = e.shape
        trans = self.p["trans"] + _BARRED
        score, back = e[0] + _FIRST, np.empty((t, n, LABELS), dtype=np.int8)
        for i in range(1, t):
            s = score[:, :, None] + trans
            back[i] = s.argmax(axis=1)
            score = s.max(axis=1) + e[i]
        out = np.empty((t, n), dtype=np.int64)
        out[-1] = score.argmax(axis=1)
        for i in range(t - 1, 0, -1):
            out[i - 1] = back[i][np.arange(n), out[i]]
        return out


def train(examples=None, seed: int = 7, steps: int = 1000, batch: int = 64, rate: float = 0.02) -> Network:
    """Adam on windows cut at random from labelled texts."""
    examples = examples or labelled_examples(6000, seed)
    rng = np.random.default_rng(seed)
    data = [(char_classes(t), _targets(t, s)) for t, s in examples if len(t) >= WINDOW]
    net = Network(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        xs, ys = [], []
        for i in rng.integers(0, len(data), batch):
            x, y = data[i]
            at = int(rng.integers(0, len(x) - WINDOW + 1))
            xs.append(x[at : at + WINDOW]), ys.append(y[at : at + WINDOW])
        _, grads = net.gradients(np.stack(xs, axis=1), np.stack(ys, axis=1))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.p[k] = (net.p[k] - lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


@lru_cache(maxsize=4)
def network(filler: tuple[str, ...] = ()) -> Network:
    """A network trained among ``filler`` words."""
    return train(labelled_examples(6000, 7, list(filler)))


# ---------------------------------------------------------------- whole texts

_NEAR = re.compile(r"[0-9@]|(?i:[\[({] ?at ?[\])}]|(?<![a-z])dot(?![a-z]))", re.ASCII)
#: The same for RE2, over a column.
_NEAR_COLUMN = r"[0-9@]|(?i:[\[({] ?at ?[\])}]|\bdot\b)"


def _starts(text: str) -> np.ndarray:
    """Starts of the windows of a text: overlapping, over every place near a digit, an @, a bracketed "at" or a "dot"."""
    near = np.array([m.start() for m in _NEAR.finditer(text)], dtype=np.int64)
    if not len(near):
        return near
    lo, hi = np.maximum(near - REACH, 0), np.minimum(near + REACH, len(text))
    new = np.ones(len(near), dtype=bool)
    new[1:] = lo[1:] > np.maximum.accumulate(hi)[:-1]
    first = np.flatnonzero(new)
    a, b = lo[first], np.maximum.reduceat(hi, first)
    n = np.maximum(-(-(b - a - WINDOW) // STEP), 0) + 1
    return np.repeat(a, n) + STEP * (tx.ragged(np.zeros(len(n), np.int64), n))


def model_spans(texts: list[str], net: Network) -> list[list[tuple[str, int, int]]]:
    """Spans that the network reads in each text, before any check."""
    classes = [char_classes(t) for t in texts]
    starts = [_starts(t) for t in texts]
    who = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    at = np.concatenate(starts) if len(who) else np.zeros(0, np.int64)
    labels = [np.zeros(len(x), dtype=np.int8) for x in classes]
    depth = [np.full(len(x), -1, dtype=np.int16) for x in classes]
    deep = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for a in range(0, len(who), 2048):
        some = range(a, min(a + 2048, len(who)))
        x = np.full((WINDOW, len(some)), 3 + _PLAIN.index(" "), dtype=np.int64)
        for j, i in enumerate(some):
            piece = classes[who[i]][at[i] : at[i] + WINDOW]
            x[: len(piece), j] = piece
        got = net.decode(x)
        for j, i in enumerate(some):
            t, s = who[i], at[i]
            n = min(WINDOW, len(classes[t]) - s)
            better = deep[:n] > depth[t][s : s + n]
            labels[t][s : s + n][better] = got[:n, j][better]
            depth[t][s : s + n][better] = deep[:n][better]
    return [_read_labels(y) for y in labels]


def _read_labels(y: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a label sequence; inside without a begin starts a span as well."""
    kind = np.where(y > 0, (y.astype(np.int64) + 1) // 2, 0)
    cut = np.ones(len(y) + 1, dtype=bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (y[1:] % 2 == 1)
    edges = np.flatnonzero(cut)
    return [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(edges[:-1], edges[1:]) if kind[a]]


def _possible(kind: str, text: str) -> bool:
    """Whether a text has the least that a thing of its kind must have."""
    digits = len(_digits(text))
    if kind == "email":
        return "@" in text[1:-1] or re.search(r"(?i)[^a-z]at[^a-z]", text) is not None
    if kind == "ip":
        numbers = re.findall(r"[0-9]+", text)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    return 12 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


_AT = re.compile(r"(?i)(?:\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)")


def _trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """A span without white space at its ends, and a written-out address from its own name on: that has no white space."""
    thing = text[a:b]
    a, b = a + len(thing) - len(thing.lstrip()), b - (len(thing) - len(thing.rstrip()))
    at = _AT.search(text, a, b) if kind == "email" and "@" not in text[a:b] else None
    return (a + len(re.match(r"(?s)(?:.*\s)?", text[a : at.start()])[0]) if at else a), b


class _Reach:
    """Spans by start, and how far those up to each one reach, so that an overlap is found by one search."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        taken = sorted((a, b) for _, a, b in spans)
        self.start = [a for a, _ in taken]
        self.end = list(accumulate((b for _, b in taken), max))

    def meets(self, a: int, b: int) -> bool:
        i = bisect_left(self.start, b)
        return i > 0 and self.end[i - 1] > a


def all_spans(texts: list[str], net: Network) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, by kind, then start."""
    out = []
    order = {k: i for i, k in enumerate(KINDS)}
    for text, read in zip(texts, model_spans(texts, net)):
        base = base_spans(text)
        reach = _Reach(base)
        more = []
        for kind, a, b in read:
            a, b = _trimmed(kind, text, a, b)
            whole = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
            if whole and _possible(kind, text[a:b]) and not reach.meets(a, b):
                more.append((kind, a, b))
        key = lambda s: (order[s[0]], s[1])
        out.append((sorted(base, key=key), sorted(base + more, key=key)))
    return out


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(net or network(tuple(filler_words(docs))))
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in batches:
            for part in tx.slices(batch, "text"):
                near = pc.match_substring_regex(pc.fill_null(part.column("text"), ""), _NEAR_COLUMN)
                some = np.flatnonzero(np.asarray(near))
                found = all_spans(part.column("text").take(pa.array(some)).to_pylist(), shared.value)
                n = part.num_rows
                counts = np.zeros((4, n), dtype=np.int64)
                spans, added = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                sha, text = [empty] * n, [""] * n
                for i, (base, every) in zip(some.tolist(), found):
                    for kind, _, _ in base:
                        counts[KINDS.index(kind), i] += 1
                    spans[i], added[i] = len(every), len(every) - len(base)
                    sha[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                    text[i] = _joined(every)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c) for c in counts), pa.array(sha), pa.array(text), pa.array(spans), pa.array(added)],
                    names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")
