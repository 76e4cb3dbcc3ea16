"""Personal data: patterns, and a character BiLSTM-CRF that adds what patterns miss.

*Base spans* are the matches of four patterns that pass their checks.

*Model.* Characters are embedded and read by a bidirectional LSTM; a linear-chain CRF over
begin/inside labels of the four kinds scores label sequences. It is trained here, in numpy,
on labelled windows: base spans of a bounded sample of windows (the ``max_fit_windows`` of
smallest hash), each also rewritten, several times, into forms that the patterns do not know (a phone
without a plus sign, spelt-out at signs, bracketed dots, other card separators), and digit
strings that are no personal data.

*Decoding.* Every kind holds a digit or an at sign, or spells one; windows of ``WIDTH``
characters, half overlapping, cover every character within ``REACH`` of such a trigger, in
the whole text. Each is decoded; where windows overlap, a character takes the marginals of
the window whose middle is nearest, and one pass joins the likeliest labels to spans over
the whole text. A span is added if its mean marginal is at least ``min_confidence``, it has the
form of its kind and it touches no base span, so base spans always stay.

Defined cases: a null or empty text has no spans; with too few windows to fit there are only
base spans; repeated rows give repeated results; null ids are kept; an empty table gives an
empty result. Other columns do not matter. Of a very long text only windows
around triggers are decoded; where two windows are as near, the earlier one counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import bounded_batches, materialize, slices, with_fields

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, REACH = 64, 32, 24
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match takes all digits it can, so a later start in the same digits cannot do better.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|(?:\(at\)|\[at\]| at )(?=[A-Za-z0-9-]+(?: dot |\(dot\)|\[dot\]|\[\.\]|\.))")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        else:
            done = max(done, at)  # a failed run of name characters ends before its at sign
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches that pass their checks, by start, then kind."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(a, b, "email") for a, b in _emails(text)]
    for m in _CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((*m.span(), "ip"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def windows_of(text: str) -> list[int]:
    """Starts of the windows that cover every character near a trigger."""
    starts: list[int] = []
    reached = -1
    for m in _TRIGGER.finditer(text):
        a, b = max(m.start() - REACH, 0), min(m.end() + REACH, len(text))
        first = max(a, reached) // STRIDE * STRIDE if reached > a else a // STRIDE * STRIDE
        for start in range(max(first - STRIDE, 0), b, STRIDE):
            if start > (starts[-1] if starts else -1):
                starts.append(start)
        reached = max(reached, b)
    return starts


def encode_chars(texts: list[str]) -> np.ndarray:
    """(n, WIDTH) symbols: printable ASCII is itself, a newline 96, other characters 97, padding 0."""
    joined = "".join(t[:WIDTH].ljust(WIDTH, "\0") for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, WIDTH)
    out = np.where((code >= 32) & (code < 127), code.astype(np.int64) - 31, 97)
    return np.where(code == 10, 96, np.where(code == 0, 0, out)).astype(np.int64)


SYMBOLS, LABELS = 98, 1 + 2 * len(KINDS)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Embedding, two LSTMs, linear layer and CRF; gradients are written out."""

    def __init__(self, hidden: int = 24, embed: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.h = hidden

        def weights(a, b):
            return (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)

        self.p = {
            "E": weights(SYMBOLS, embed), "U": weights(2 * hidden, LABELS), "c": np.zeros(LABELS, np.float32),
            "A": np.zeros((LABELS, LABELS), np.float32), "s": np.zeros(LABELS, np.float32),
        }
        for d in "fb":
            self.p[f"W{d}"] = weights(embed + hidden, 4 * hidden)
            self.p[f"k{d}"] = np.zeros(4 * hidden, np.float32)
            self.p[f"k{d}"][hidden : 2 * hidden] = 1
        # Inside follows begin or inside of its kind only.
        self.banned = np.zeros((LABELS, LABELS), bool)
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            self.banned[:, inside] = True
            self.banned[[inside - 1, inside], inside] = False
        self.first_banned = np.array([i > 0 and i % 2 == 0 for i in range(LABELS)])

    def _lstm(self, x, d, keep):
        t, n, e = x.shape
        h = self.h
        w, k = self.p[f"W{d}"], self.p[f"k{d}"]
        inputs = (x.reshape(t * n, e) @ w[:e] + k).reshape(t, n, 4 * h)
        hs, cs = np.zeros((t + 1, n, h), np.float32), np.zeros((t + 1, n, h), np.float32)
        gates = np.zeros((t, n, 4 * h), np.float32) if keep else None
        for i in range(t):
            z = inputs[i] + hs[i] @ w[e:]
            z[:, : 3 * h] = _sigmoid(z[:, : 3 * h])
            z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
            cs[i + 1] = z[:, h : 2 * h] * cs[i] + z[:, :h] * z[:, 3 * h :]
            hs[i + 1] = z[:, 2 * h : 3 * h] * np.tanh(cs[i + 1])
            if keep:
                gates[i] = z
        return hs, cs, gates

    def _lstm_back(self, x, d, state, grad):
        hs, cs, gates = state
        t, n, e = x.shape
        h = self.h
        w = self.p[f"W{d}"]
        dx, dw, dk = np.zeros_like(x), np.zeros_like(w), np.zeros(4 * h, np.float32)
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for i in range(t - 1, -1, -1):
            dh = dh + grad[i]
            g_in, g_forget, g_out, g_new = (gates[i][:, j * h : (j + 1) * h] for j in range(4))
            tc = np.tanh(cs[i + 1])
            dc = dc + dh * g_out * (1 - tc**2)
            dz = np.concatenate([
                dc * g_new * g_in * (1 - g_in), dc * cs[i] * g_forget * (1 - g_forget),
                dh * tc * g_out * (1 - g_out), dc * g_in * (1 - g_new**2),
            ], axis=1)
            dw[:e] += x[i].T @ dz
            dw[e:] += hs[i].T @ dz
            dk += dz.sum(axis=0)
            dx[i] = dz @ w[:e].T
            dh = dz @ w[e:].T
            dc = dc * g_forget
        return dx, dw, dk

    def emissions(self, codes, keep=False):
        x = self.p["E"][codes.T]
        forward = self._lstm(x, "f", keep)
        backward = self._lstm(x[::-1], "b", keep)
        both = np.concatenate([forward[0][1:], backward[0][1:][::-1]], axis=2)
        return both @ self.p["U"] + self.p["c"], (x, forward, backward, both)

    def _chain(self, z):
        """Marginals of labels and label pairs, and the log partition, of emissions (t, n, labels)."""
        a = np.where(self.banned, -1e4, self.p["A"]).astype(np.float64)
        z = z.astype(np.float64)
        t, n, k = z.shape
        alpha, beta = np.zeros((t, n, k)), np.zeros((t, n, k))
        alpha[0] = z[0] + np.where(self.first_banned, -1e4, self.p["s"])
        for i in range(1, t):
            alpha[i] = _log_sum(alpha[i - 1][:, :, None] + a, 1) + z[i]
        for i in range(t - 2, -1, -1):
            beta[i] = _log_sum(a[None] + (z[i + 1] + beta[i + 1])[:, None, :], 2)
        whole = _log_sum(alpha[-1], 1)
        return alpha, beta, whole, a, z

    def marginals(self, codes):
        z, _ = self.emissions(codes)
        alpha, beta, whole, _, _ = self._chain(z)
        return np.exp(alpha + beta - whole[None, :, None]).transpose(1, 0, 2)

    def gradients(self, codes, labels):
        z, (x, forward, backward, both) = self.emissions(codes, keep=True)
        alpha, beta, whole, a, zd = self._chain(z)
        t, n, k = z.shape
        gold = labels.T
        dz = np.exp(alpha + beta - whole[None, :, None])
        np.subtract.at(dz, (np.arange(t)[:, None], np.arange(n)[None, :], gold), 1)
        ds = dz[0].sum(axis=0)
        da = np.zeros((k, k))
        for i in range(1, t):
            pair = alpha[i - 1][:, :, None] + a + (zd[i] + beta[i])[:, None, :] - whole[:, None, None]
            da += np.exp(pair).sum(axis=0)
            np.subtract.at(da, (gold[i - 1], gold[i]), 1)
        dz = (dz / n).astype(np.float32)
        g = {"s": ds / n, "A": np.where(self.banned, 0, da / n), "c": dz.sum(axis=(0, 1))}
        g["U"] = both.reshape(t * n, -1).T @ dz.reshape(t * n, k)
        dboth = dz @ self.p["U"].T
        dx, g["Wf"], g["kf"] = self._lstm_back(x, "f", forward, dboth[:, :, : self.h])
        dxb, g["Wb"], g["kb"] = self._lstm_back(x[::-1], "b", backward, dboth[:, :, self.h :][::-1])
        dx = dx + dxb[::-1]
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], codes.T, dx)
        score = np.take_along_axis(zd, gold[:, :, None], 2).sum() + self.p["s"][gold[0]].sum() + a[gold[:-1], gold[1:]].sum()
        return g, float((whole.sum() - score) / n)

    def fit(self, codes, labels, steps=300, batch=64, rate=0.01, seed=9):
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        loss = 0.0
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(codes), batch)
            g, loss = self.gradients(codes[pick], labels[pick])
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            for k, v in g.items():
                v = v.astype(np.float32) * min(1.0, 5.0 / max(norm, 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v**2
                fit_rate = rate * (1 - 0.9 * step / steps)
                self.p[k] -= fit_rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return loss


def labels_of(spans: list[tuple[int, int, str]], width: int = WIDTH) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for a, b, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        if 0 <= a < width:
            out[a] = k
        out[max(a + 1, 0) : max(min(b, width), 0)] = k + 1
        if a < 0 < b:
            out[0] = k
    return out


def rewritten(kind: str, value: str, rng) -> str:
    """A form of ``value`` that the patterns do not know."""
    digits = re.sub("[^0-9]", "", value)
    if kind == "email":
        name, _, host = value.partition("@")
        at, dot = [(" at ", " dot "), ("(at)", "."), ("[at]", "[dot]"), (" at ", ".")][rng.integers(4)]
        return name + at + host.replace(".", dot)
    if kind == "ip":
        return value.replace(".", ["[.]", "(.)", " . "][rng.integers(3)])
    if kind == "card":
        return ["/", ".", "  ", "_"][rng.integers(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return ["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "00{} {} {}"][rng.integers(4)].format(local[:3], local[3:6], local[6:])


def _noise(rng) -> str:
    n = rng.integers
    return [
        f"{n(1900, 2030)}", f"{n(1, 99)}.{n(0, 10)}", f"{n(1, 10**6)}", f"{n(0, 24)}:{n(10, 60)}",
        f"{n(1, 32)}.{n(1, 13)}.{n(1990, 2030)}", "".join(f"{x:x}" for x in n(0, 16, 32)), f"v{n(1, 9)}.{n(0, 20)}.{n(0, 20)}",
        "".join(str(x) for x in n(0, 10, 6)), f"{n(1990, 2030)}-{n(10, 13)}-{n(10, 29)}",
    ][n(9)]


def training_windows(rows: list[str], seed: int = 3, variants: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and labels of windows: as they are, rewritten in ``variants`` ways and places, and with noise."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []

    def add(text, spans):
        texts.append(text[:WIDTH])
        labels.append(labels_of(spans, WIDTH))

    for text in rows:
        spans = [s for s in base_spans(text)]
        clear = [s for i, s in enumerate(spans) if all(s[1] <= o[0] or o[1] <= s[0] for j, o in enumerate(spans) if j != i)]
        add(text, clear)
        for _ in range(variants if clear else 0):
            out, made, at = "", [], 0
            for a, b, kind in clear:
                new = rewritten(kind, text[a:b], rng)
                out += text[at:a]
                made.append((len(out), len(out) + len(new), kind))
                out += new
                at = b
            # Cut off some of what stands before, so that spans occur at every place of a window.
            cut = min(int(rng.integers(0, 40)), made[0][0])
            add((out + text[at:])[cut:], [(a - cut, b - cut, kind) for a, b, kind in made])
        place = int(rng.integers(0, 32))
        plain = re.sub(r"[0-9@+]+", "", text) or " "
        noise = _noise(rng)
        add(plain[:place] + " " + noise + " " + plain[place:], [])
    return encode_chars(texts), np.array(labels)


def _shape(kind: str, value: str) -> bool:
    digits = sum(c.isdigit() for c in value)
    letters = sum(c.isalpha() for c in value)
    if kind == "email":
        return letters >= 3 and bool(re.search(r"@|\bat\b", value)) and bool(re.search(r"\.|\bdot\b", value))
    if letters:
        return False
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        only = re.sub("[^0-9]", "", value)
        return 12 <= digits <= 19 and luhn(only)
    return 9 <= digits <= 15 and bool(re.search("[^0-9]", value))


def added_spans(text: str, starts: list[int], chances: np.ndarray, base, min_confidence: float):
    """Reconcile the marginals (window, WIDTH, label) of one text and give the spans to add."""
    own: dict[int, tuple[int, np.ndarray]] = {}
    for start, rows in zip(starts, chances):
        for j in range(min(WIDTH, len(text) - start)):
            far = abs(2 * j - WIDTH)
            if start + j not in own or far < own[start + j][0]:
                own[start + j] = far, rows[j]
    out, at, places = [], 0, sorted(own)
    while at < len(places):
        i = places[at]
        label = int(own[i][1].argmax())
        at += 1
        if label == 0:
            continue
        kind = (label - 1) // 2
        pair = [1 + 2 * kind, 2 + 2 * kind]
        sure, end = [own[i][1][pair].sum()], i + 1
        while at < len(places) and places[at] == end and int(own[end][1].argmax()) == pair[1]:
            sure.append(own[end][1][pair].sum())
            end += 1
            at += 1
        a, b = i, end
        while b > a and text[b - 1].isspace():
            b -= 1
        free = all(b <= s or e <= a for s, e, _ in base)
        if b > a and free and np.mean(sure) >= min_confidence and _shape(KINDS[kind], text[a:b]):
            out.append((a, b, KINDS[kind]))
    return out


def train(docs: DataFrame, max_fit_windows: int = 4000, steps: int = 700, text_col: str = "text") -> dict | None:
    """Parameters fitted on the windows of smallest hash, a third of them at most without base spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "body"):
                found = [t[s : s + WIDTH] for t in part.column("body").to_pylist() for s in windows_of(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([bool(base_spans(w)) for w in found], pa.bool_())],
                    names=["window", "holds"],
                )

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    windows = rows.mapInArrow(run, "window string, holds boolean").distinct().withColumn("h", F.xxhash64("window"))
    take = lambda holds, n: [
        r["window"] for r in windows.filter(F.col("holds") == holds).orderBy("h").limit(n).select("window").collect()
    ]
    windows = materialize(windows, "pii-windows")
    sample = take(True, max_fit_windows * 2 // 3) + take(False, max_fit_windows // 3)
    if len(sample) < 20:
        return None
    codes, labels = training_windows(sample)
    tagger = Tagger()
    tagger.fit(codes, labels, steps)
    return tagger.p


def find(docs: DataFrame, params: dict | None, min_confidence: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``base`` and ``spans`` (array of start, end, kind) of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    shared = docs.sparkSession.sparkContext.broadcast(params)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None
        if shared.value is not None:
            tagger = Tagger()
            tagger.p = shared.value
        asked: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "body"):
                texts = part.column("body").to_pylist()
                base = [base_spans(t) for t in texts]
                spans = [list(b) for b in base]
                if tagger is not None:
                    where = [windows_of(t) for t in texts]
                    pieces = [[t[s : s + WIDTH] for s in starts] for t, starts in zip(texts, where)]
                    new = sorted({w for own in pieces for w in own if w not in asked})
                    if len(asked) + len(new) > 20_000:
                        asked, new = {}, sorted({w for own in pieces for w in own})
                    for i in range(0, len(new), 512):
                        some = new[i : i + 512]
                        asked.update(zip(some, tagger.marginals(encode_chars(some)).astype(np.float32)))
                    for i, (t, starts, own) in enumerate(zip(texts, where, pieces)):
                        if starts:
                            spans[i] += added_spans(t, starts, np.array([asked[w] for w in own]), base[i], min_confidence)
                as_rows = lambda lists: pa.array(
                    [
                        [{"start": a, "end": b, "kind": k} for a, b, k in sorted(s, key=lambda s: (s[0], KINDS.index(s[2])))]
                        for s in lists
                    ],
                    kind,
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), as_rows(base), as_rows(spans)], names=[id_col, "base", "spans"]
                )

    span = "array<struct<start:bigint,end:bigint,kind:string>>"
    return rows.mapInArrow(run, with_fields(rows, [id_col], f"base {span}, spans {span}"))
