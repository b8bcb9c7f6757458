"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and decoding of windows.

Training text is made: prose of syllables with labelled spans of the four kinds in many spellings, and with look-alikes (hashes, versions,
dates, prices, handles) that carry no label. The number of windows is a parameter, and a seed makes the model the same everywhere.
"""

from __future__ import annotations

import inspect
import random

import numpy as np
import xxhash
from pyspark.errors import AnalysisException

from seabright.llm.common import shared_dir

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
MARKS = "@.+-_%()[] \n/:,=\"'#$*|!?;<>&"
OTHER, UPPER, DIGIT = 0, 27, 28
CLASSES = 29 + len(MARKS)


def _table() -> np.ndarray:
    table = np.zeros(128, np.uint8)
    for code in range(128):
        c = chr(code)
        if "a" <= c <= "z":
            table[code] = 1 + code - ord("a")
        elif "A" <= c <= "Z":
            table[code] = UPPER
        elif "0" <= c <= "9":
            table[code] = DIGIT
        elif c in MARKS:
            table[code] = 29 + MARKS.index(c)
    return table


TABLE = _table()


def classes_of(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 128, TABLE[np.where(codes < 128, codes, 0)], OTHER).astype(np.uint8)


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


class Examples:
    """Labelled text from a seeded generator."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(n))

    def word(self) -> str:
        return "".join(self.rng.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ou", "at", "en", "es", "ti", "le", "que", "ung", "sch", "ción", "ment")) for _ in range(self.rng.randint(1, 4)))

    def email(self) -> str:
        r = self.rng
        user = r.choice((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}.{self.digits(2)}", f"{self.word()}_{self.digits(1)}"))
        at, dot = r.choice((("@", "."),) * 3 + ((" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" at ", " dot ")))
        return user + at + r.choice((f"mail{self.digits(1)}", self.word())) + r.choice(("", dot + self.word())) + dot + r.choice(("com", "org", "net", "de", "fr"))

    def ip(self) -> str:
        parts = [str(self.rng.randint(1, 255)) for _ in range(4)]
        dots = self.rng.choice(([".", ".", "."],) * 2 + ([".", ".", "[.]"], ["[.]"] * 3))
        return parts[0] + "".join(d + p for d, p in zip(dots, parts[1:], strict=True))

    def card(self) -> str:
        body = self.rng.choice("3456") + self.digits(14)
        last = next(d for d in "0123456789" if luhn(body + d))
        number, gap = body + last, self.rng.choice(("", "", " ", "-", ".", "/"))
        return gap.join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        a, b, c = self.digits(3), self.digits(3), self.digits(4)
        return self.rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{self.digits(2)} {self.digits(2)} {self.digits(7)}", f"+{self.digits(2)} {self.digits(3)} {b} {c}", f"00{self.digits(2)} {a} {b}{c}"))

    def lookalike(self) -> str:
        r = self.rng
        hexa = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 18, 32, 40))))
        return r.choice((
            f'"{hexa}"', hexa, f"password={hexa}", f"v{self.digits(1)}.{self.digits(1)}.{self.digits(1)}", f"{self.digits(1)}.0.", f"{self.digits(2)}.{self.digits(2)}",
            f"20{self.digits(2)}", f"20{self.digits(2)}-0{self.digits(1)}-1{self.digits(1)}", f"${self.digits(3)}.{self.digits(2)}", f"@{self.word()}", f"#{self.digits(5)}", "AKIA" + hexa.upper(),
            f"{self.digits(2)}:{self.digits(2)}:{self.digits(2)}", f"{self.digits(4)}-{self.digits(4)}", self.digits(r.choice((3, 5, 6, 8, 20, 24))), f"({self.digits(2)})", f"{self.digits(3)}/{self.digits(3)}",
        ))

    def window(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes and tags of a stretch that may cut spans at its ends."""
        text, spans = "", []
        while len(text) < 2 * width:
            draw = self.rng.random()
            if draw < 0.16:
                kind = self.rng.randrange(4)
                made = getattr(self, KINDS[kind])()
                spans.append((kind, len(text), len(text) + len(made)))
            elif draw < 0.3:
                made = self.lookalike()
            else:
                made = self.word()
                made = made.capitalize() if self.rng.random() < 0.1 else made
            text += made + self.rng.choice((" ",) * 8 + (". ", ", ", "\n", ".\n", ": ", "; "))
        tags = np.zeros(len(text), np.int64)
        for kind, a, b in spans:
            tags[a:b] = 2 + 2 * kind
            tags[a] = 1 + 2 * kind
        cut = self.rng.randrange(width)
        return classes_of(text)[cut : cut + width], tags[cut : cut + width]


def _gate(x: np.ndarray) -> np.ndarray:
    """A straight line for the logistic curve, held at 0 and 1: the gates of the cells, in training and decoding alike."""
    return np.clip(0.2 * x + 0.5, 0, 1)


def _slope(gate: np.ndarray) -> np.ndarray:
    return 0.2 * ((gate > 0) & (gate < 1))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Tagger:
    """Parameters: input, recurrent and bias weights of both directions; emission weights; CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 10):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        draw = lambda *shape: rng.normal(0, 0.2, shape)
        self.p = {
            "x": draw(2, CLASSES, 4 * hidden), "h": draw(2, hidden, 4 * hidden), "b": np.zeros((2, 1, 4 * hidden)),
            "o": draw(2 * hidden, TAGS), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0  # forget gates begin open

    def _run(self, x: np.ndarray, keep: bool = False):
        """Hidden states of both directions, each in its own order of time; and what backward() needs."""
        batch, width = x.shape
        both = np.stack([x, x[:, ::-1]])
        H, p = self.hidden, self.p
        dtype = p["h"].dtype
        h, c = np.zeros((2, batch, H), dtype), np.zeros((2, batch, H), dtype)
        out, kept = np.empty((width, 2, batch, H), dtype), []
        side = np.arange(2)[:, None]
        for t in range(width):
            z = p["x"][side, both[:, :, t]] + h @ p["h"] + p["b"]
            gates = _gate(z[:, :, : 3 * H])
            i, f, o, g = gates[:, :, :H], gates[:, :, H : 2 * H], gates[:, :, 2 * H :], np.tanh(z[:, :, 3 * H :])
            before, c = c, f * c + i * g
            tc = np.tanh(c)
            if keep:
                kept.append((h, before, i, f, o, g, tc))
            out[t] = h = o * tc
        return both, out, kept

    def _features(self, out: np.ndarray) -> np.ndarray:
        return np.concatenate([out[:, 0], out[::-1, 1]], axis=2)  # time, batch, both states

    def ready(self) -> None:
        """Lay the weights out for decoding, in single precision: by gate, and the characters of both directions in one row, so that one copy fetches a character's share of all cells of a gate; the gates' sums are scaled already."""
        H = self.hidden
        scale, shift = np.ones(4 * H), np.zeros(4 * H)
        scale[: 3 * H], shift[: 3 * H] = 0.2, 0.5
        single = lambda a: np.ascontiguousarray(a, np.float32)
        by_gate = lambda a: single(a.reshape(2, -1, 4, H).transpose(2, 0, 1, 3))
        self.fast = {
            "x": by_gate((self.p["x"] + self.p["b"]) * scale + shift).reshape(4, -1, H), "h": by_gate(self.p["h"] * scale),
            "o": single(self.p["o"].T), "ob": single(self.p["ob"]), "t": single(self.p["t"]),
        }

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Scores (time, tag, window)."""
        if not hasattr(self, "fast"):
            self.ready()
        p, H, (batch, width) = self.fast, self.hidden, x.shape
        steps = np.stack([x.T, x.T[::-1] + np.uint8(CLASSES)], axis=1).astype(np.intp)
        out = np.empty((width, 2, batch, H), np.float32)
        h, c, tc = (np.zeros((2, batch, H), np.float32) for _ in range(3))
        z, own = (np.empty((4, 2, batch, H), np.float32) for _ in range(2))
        gates, (i, f, o, g) = z[:3], z
        for t in range(width):
            p["x"].take(steps[t], axis=1, out=own, mode="clip")
            np.matmul(h, p["h"], out=z)
            z += own
            np.clip(gates, 0, 1, out=gates)
            np.tanh(g, out=g)
            c *= f
            i *= g
            c += i
            np.tanh(c, out=tc)
            h = np.multiply(o, tc, out=out[t])
        ahead, back = out[:, 0].transpose(0, 2, 1), out[::-1, 1].transpose(0, 2, 1)
        scores = np.empty((width, TAGS, batch), np.float32)
        for t in range(0, width, 8):  # few enough to stay in the processor's cache
            some = np.matmul(p["o"][:, :H], ahead[t : t + 8], out=scores[t : t + 8])
            some += p["o"][:, H:] @ back[t : t + 8]
            some += p["ob"][:, None]
        return scores

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window (Viterbi): best scores forward, and steps back only where the path that stays outside is not the best."""
        best, step = self.emissions(x), self.fast["t"]
        tags = np.zeros(x.shape, np.int8)
        outside = best[0, 0].copy()
        ways, most = np.empty((TAGS, *best.shape[1:]), np.float32), np.empty(best.shape[1:], np.float32)
        for t in range(1, len(best)):
            outside += step[0, 0]
            outside += best[t, 0]
            np.add(best[t - 1][:, None], step[:, :, None], out=ways)
            best[t] += ways.max(axis=0, out=most)
        some = np.flatnonzero(best[-1].max(axis=0) > outside)
        if not len(some):
            return tags
        best = best[:, :, some]
        now = best[-1].argmax(axis=0)
        tags[some, -1] = now
        for t in range(len(best) - 2, -1, -1):
            now = (best[t] + step[:, now]).argmax(axis=0)
            tags[some, t] = now
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags and its gradients."""
        both, out, kept = self._run(x, keep=True)
        p, H = self.p, self.hidden
        batch, width = x.shape
        features = self._features(out)
        e, step = features @ p["o"] + p["ob"], p["t"]
        forward, backward = np.empty_like(e), np.zeros_like(e)
        forward[0] = e[0]
        for t in range(1, width):
            forward[t] = _logsumexp(forward[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(width - 2, -1, -1):
            backward[t] = _logsumexp(step + (e[t + 1] + backward[t + 1])[:, None, :], 2)
        total = _logsumexp(forward[-1], 1)
        de = np.exp(forward + backward - total[None, :, None])
        pair = np.exp(forward[:-1, :, :, None] + step + (e[1:] + backward[1:])[:, :, None, :] - total[None, :, None, None])
        dt = pair.sum(axis=(0, 1))
        yt = y.T
        rows, times = np.arange(batch)[None, :], np.arange(width)[:, None]
        gold = e[times, rows, yt].sum() + step[yt[:-1], yt[1:]].sum()
        de[times, rows, yt] -= 1
        np.subtract.at(dt, (yt[:-1], yt[1:]), 1)
        scale = 1 / (batch * width)
        de *= scale
        grads = {"o": np.einsum("tbf,tbk->fk", features, de), "ob": de.sum(axis=(0, 1)), "t": dt * scale}
        df = de @ p["o"].T
        dout = np.stack([df[:, :, :H], df[::-1, :, H:]], axis=1)
        gx, gh, gb = np.zeros_like(p["x"]), np.zeros_like(p["h"]), np.zeros_like(p["b"])
        dh, dc = np.zeros((2, batch, H)), np.zeros((2, batch, H))
        for t in range(width - 1, -1, -1):
            h0, c0, i, f, o, g, tc = kept[t]
            dh = dh + dout[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * _slope(i), dc * c0 * _slope(f), dh * tc * _slope(o), dc * i * (1 - g * g)], axis=2)
            for side in (0, 1):
                np.add.at(gx[side], both[side, :, t], dz[side])
            gh += h0.transpose(0, 2, 1) @ dz
            gb += dz.sum(axis=1, keepdims=True)
            dh, dc = dz @ p["h"].transpose(0, 2, 1), dc * f
        grads |= {"x": gx, "h": gh, "b": gb}
        return float((total.sum() - gold) * scale), grads

    def fit(self, windows: int = 25600, width: int = 64, batch: int = 64, rate: float = 0.02, seed: int = 10) -> list[float]:
        """Adam over made examples, ``windows`` of them; the losses."""
        examples, losses = Examples(seed), []
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        steps = windows // batch
        for n in range(1, steps + 1):
            x, y = zip(*(examples.window(width) for _ in range(batch)), strict=True)
            loss, grads = self.gradients(np.stack(x), np.stack(y))
            losses.append(loss)
            now = rate * min(1.0, 2 * (1 - n / (steps + 1)))
            for k, g in grads.items():
                g = np.clip(g, -0.5, 0.5)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= now * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)
        return losses


_FITTED: dict[tuple, Tagger] = {}


def fitted(windows: int = 25600, hidden: int = 8, seed: int = 10) -> Tagger:
    """A trained tagger, one a process and setting."""
    key = (windows, hidden, seed)
    if key not in _FITTED:
        tagger = Tagger(hidden, seed)
        tagger.fit(windows, seed=seed)
        tagger.ready()
        _FITTED[key] = tagger
    return _FITTED[key]


def kept(spark, windows: int = 25600, hidden: int = 8, seed: int = 10) -> Tagger:
    """A trained tagger from the shared folder, where it is put when first asked for; this module's text is part of its name."""
    key = (windows, hidden, seed)
    if key in _FITTED:
        return _FITTED[key]
    path = f"{shared_dir(spark)}/seabright/tagger-{xxhash.xxh64_hexdigest(inspect.getsource(inspect.getmodule(kept)))}-{windows}-{hidden}-{seed}"
    shape = "name string, shape array<int>, weights array<double>"
    try:
        rows = spark.read.schema(shape).parquet(path).collect()
    except AnalysisException:  # not there yet
        rows = []
    tagger = Tagger(hidden, seed)
    if {r.name for r in rows} == tagger.p.keys():
        tagger.p = {r.name: np.array(r.weights).reshape(r.shape) for r in rows}
        tagger.ready()
        _FITTED[key] = tagger
        return tagger
    tagger = fitted(windows, hidden, seed)
    weights = [(name, list(a.shape), a.ravel().tolist()) for name, a in tagger.p.items()]
    spark.createDataFrame(weights, shape).coalesce(1).write.mode("overwrite").parquet(path)
    return tagger
