"""Secret scans: rule spans, and a character convolutional network over every candidate and its context.

Candidates are the rule matches and every long run of token characters, whatever it is made of, or what rule matches leave of
it. The network scores windows over the candidate's whole length with the characters around them. It is trained on labelled
findings: windows of such candidates from a bounded sample of documents (rule matches are secrets; runs of words, short numbers
and long digit strings are not; runs of other kinds have no label and teach nothing), and findings of common secret formats and of harmless
look-alikes written by a seeded generator. On findings kept from training its output is calibrated, and the threshold never
exceeds the highest that keeps the wanted recall, whatever precision that leaves.
Rule spans always stay; the network adds spans of kind ``model`` where no rule matched.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_frames, text_rows

# Fixed values of the rules.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "model")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9+/_=-]")
#: A word, a word with a short number, or digits alone; runs of nothing else are known to be harmless.
PLAIN_PARTS = re.compile(r"(?:[+/_.=-]*(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]+))+[+/_.=-]*|[+/_.=-]+").fullmatch
ALPHABET = string.ascii_letters + string.digits + "+/_.=-:\"' \n,;(){}<>@#$%&*!?|"
BEFORE, INSIDE, AFTER = 24, 48, 8
LENGTH, CODES = BEFORE + INSIDE + AFTER, len(ALPHABET) + 2
SHORTEST, STRIDE = 16, 12
F32 = np.float32


def rule_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the rules, leftmost and non-overlapping within a kind, by start and then kind."""
    out = []
    low = text.lower() if text.isascii() else "".join(c.lower() if c < "\x80" else c for c in text)
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def stretch(text: str, start: int, end: int, low: int, high: int) -> tuple[int, int]:
    """The span widened, within low and high, to where its first and last words end."""
    while start > low and text[start - 1] not in "/+=":
        start -= 1
    while end < high and text[end] not in "/+=":
        end += 1
    return start, end


def outside(start: int, end: int, rules: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What of the span no rule span covers."""
    parts = []
    for _, a, b in rules:
        if b <= start or a >= end:
            continue
        if a > start:
            parts.append((start, a))
        start = b
    return [*parts, (start, end)] if start < end else parts


def candidates(text: str, rules: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Spans to score: runs of token characters, or their long parts outside rule spans, and words that a rule span covers a part of."""
    found, k = set(), 0
    upto = [0]  # the furthest end of the rule spans so far
    for _, _, b in rules:
        upto.append(max(upto[-1], b))
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(rules) and upto[k + 1] <= a:
            k += 1
        near = []
        for i in range(k, len(rules)):
            if rules[i][1] >= b:
                break
            if rules[i][2] > a:
                near.append(rules[i])
        for x, y in outside(a, b, near):
            if y - x >= SHORTEST:
                found.add((x, y))
            elif y in {s[1] for s in near} or x in {s[2] for s in near}:  # a short rest counts as part of its word
                word = stretch(text, y - 1 if y < b else x, y if y < b else x + 1, a, b)
                if word[1] - word[0] >= SHORTEST:
                    found.add(word)
    return sorted(found)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping windows over the whole span that the network can see whole."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(a, a + INSIDE) for a in [*range(start, end - INSIDE, STRIDE), end - INSIDE]]


def codes(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of context, candidate and context; longer candidates come as ``windows``."""
    return coded(line_of(text, start, end))


def line_of(text: str, start: int, end: int) -> str:
    """A window with its context, padded to LENGTH."""
    end = min(end, start + INSIDE)
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(INSIDE, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def coded(line: str) -> np.ndarray:
    number = NUMBER
    return np.fromiter((number.get(c, 1) for c in line), np.int64, LENGTH)


NUMBER = {c: i + 2 for i, c in enumerate(ALPHABET)} | {"\0": 0}


class Network:
    """Character vectors, two convolution widths, greatest and mean over the candidate, one hidden layer."""

    def __init__(self, dim: int = 12, filters: int = 24, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        r = lambda *s: rng.normal(0, 1 / math.sqrt(s[0]), s).astype(F32)
        self.widths = (3, 5)
        self.p = {"e": (rng.normal(0, 0.3, (CODES, dim))).astype(F32), "h": r(4 * filters, hidden), "hb": np.zeros(hidden, F32), "o": r(hidden, 1), "ob": np.zeros(1, F32)}
        for w in self.widths:
            self.p |= {f"k{w}": r(w * dim, filters), f"c{w}": np.zeros(filters, F32)}
        self.slope, self.shift, self.threshold = 1.0, 0.0, 0.5

    def forward(self, x: np.ndarray):
        e, parts, saved = self.p["e"][x], [], []
        for w in self.widths:
            win = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(len(x), LENGTH - w + 1, -1)
            a = np.maximum(win @ self.p[f"k{w}"] + self.p[f"c{w}"], 0)
            top = a.argmax(1)
            parts += [np.take_along_axis(a, top[:, None], 1)[:, 0], a.mean(1)]
            saved.append((win, a, top))
        pooled = np.hstack(parts)
        hid = np.maximum(pooled @ self.p["h"] + self.p["hb"], 0)
        return (hid @ self.p["o"])[:, 0] + self.p["ob"][0], (e, saved, pooled, hid)

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        z, (e, saved, pooled, hid) = self.forward(x)
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(F32)[:, None]
        g = {"o": hid.T @ d, "ob": d.sum(0)}
        dh = (d @ self.p["o"].T) * (hid > 0)
        g |= {"h": pooled.T @ dh, "hb": dh.sum(0)}
        dp, de, f = dh @ self.p["h"].T, np.zeros_like(e), self.p["c3"].shape[0]
        for k, (w, (win, a, top)) in enumerate(zip(self.widths, saved)):
            da = np.repeat(dp[:, None, (2 * k + 1) * f : (2 * k + 2) * f] / a.shape[1], a.shape[1], axis=1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, 2 * k * f : (2 * k + 1) * f], 1)
            da = da * (a > 0)
            g |= {f"k{w}": np.einsum("nld,nlf->df", win, da), f"c{w}": da.sum((0, 1))}
            back = (da @ self.p[f"k{w}"].T).reshape(len(x), a.shape[1], w, -1)
            for j in range(w):
                de[:, j : j + a.shape[1]] += back[:, :, j]
        g["e"] = np.zeros_like(self.p["e"])
        np.add.at(g["e"], x, de)
        return g

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[i : i + 1024])[0] for i in range(0, len(x), 1024)]).astype(float)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def written_findings(n: int, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of common secret formats and of look-alikes that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda s, k: "".join(rng.choice(list(s), int(k)))
    low, up, dig = string.ascii_lowercase, string.ascii_uppercase, string.digits
    one = lambda *x: x[int(rng.integers(len(x)))]
    say = lambda k: " ".join(pick("aeinorstdhlu", rng.integers(2, 9)) for _ in range(k))
    name = lambda: pick("aeinorstdhlu", rng.integers(3, 9))
    yes = [lambda: "ghp_" + pick(low + up + dig, 36), lambda: "xoxb-" + pick(dig, 11) + "-" + pick(low + up + dig, 24), lambda: "sk-" + pick(low + up + dig, rng.integers(32, 48)), lambda: "AIza" + pick(low + up + dig + "-_", 35), lambda: "eyJ" + pick(low + up + dig + "-_", rng.integers(30, 90)), lambda: ".".join(["eyJ" + pick(low + up + dig, rng.integers(12, 30)), "eyJ" + pick(low + up + dig + "-_", rng.integers(20, 60)), pick(low + up + dig + "-_", 43)]), lambda: pick(low + up + dig + "+/", rng.integers(28, 64)) + "=" * int(rng.integers(0, 3)), lambda: pick(up + dig, rng.integers(20, 32)), lambda: "AKIA" + pick(up + dig, 16), lambda: pick("0123456789abcdef", rng.integers(24, 65))]
    no = [lambda: "-".join(name() for _ in range(int(rng.integers(3, 7)))) + "-" + pick(dig, 2), lambda: "/".join([name(), name(), pick(dig, 4), pick(dig, 2), name()]), lambda: name() + "_" + name() + "_" + name() + pick(dig, 1), lambda: pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "T" + pick(dig, 6), lambda: name() + name() + name() + pick(dig, rng.integers(1, 4)), lambda: "+" + pick(dig, 11) + "x" + pick(dig, 5), lambda: "=" * 9 + name() + pick(dig, 2) + "=" * 9, lambda: name().upper() + "-" + pick(dig, 4) + "-" + pick(dig, 4) + "-" + pick(dig, 4), lambda: pick(dig, rng.integers(16, 20)), lambda: name() + name() + name() + name(), lambda: (name() + name() + name()).capitalize() + "." + name().capitalize(), lambda: ".".join([name() + pick(dig, rng.integers(0, 3)) for _ in range(int(rng.integers(3, 6)))]), lambda: one("-", "=", "_", ".") * int(rng.integers(16, 60)), lambda: (name() + name() + name() + name()).upper()]
    near = ["key ", "auth: ", "Bearer ", "credential ", "export KEY=", "login ", "", ""]
    far = ["see ", "url ", "file ", "ref ", "order ", "", "", ""]
    out = []
    for k in range(n):
        label = k % 2
        body = (yes if label else no)[int(rng.integers(len(yes if label else no)))]()
        lead = say(int(rng.integers(1, 6))) + " " + (near if label else far)[int(rng.integers(8))]
        out.append((lead + body + " " + say(3), len(lead), len(lead) + len(body), label))
    return out


def written_runs(n: int, seed: int = 12) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of windows of long paths and settings, half of them with a written secret within."""
    rng, found = np.random.default_rng(seed), written_findings(2 * n, seed)
    body = [[t[a:b] for t, a, b, y in found if y == label and b - a <= 64] for label in (0, 1)]
    some = lambda label: body[label][int(rng.integers(len(body[label])))]
    out = []
    for k in range(n):
        sep = "/=-_"[int(rng.choice(4, p=[0.6, 0.2, 0.1, 0.1]))]
        parts = [some(0) for _ in range(int(rng.integers(3, 6)))]
        at = int(rng.integers(1, len(parts)))
        if k % 2:
            parts[at] = some(1)
        text = sep + sep.join(parts)
        a = len(sep.join(["", *parts[:at]])) + 1
        b = a + len(parts[at])
        seen = [(x, y) for x, y in windows(0, len(text)) if not k % 2 or min(y, b) - max(x, a) >= min(b - a, 32)]
        x, y = seen[int(rng.integers(len(seen)))]
        out.append(("see " + text + " end", x + 4, y + 4, k % 2))
    return out


def labelled_lines(text: str) -> list[tuple[str, int]]:
    """(window with context, label) of the rule matches (1) and the harmless candidates (0) of a text; other candidates have no label."""
    rules = rule_spans(text)
    found = [(a, b, 1) for _, a, b in rules] + [(a, b, 0) for a, b in candidates(text, rules) if PLAIN_PARTS(text, a, b)]
    return [(line_of(text, x, y), label) for a, b, label in found for x, y in windows(a, b)]


def sample_findings(docs: DataFrame, most: int = 4000, most_lines: int = 12_000) -> list[tuple[str, int]]:
    """``labelled_lines`` of about ``most`` documents, picked by a hash of their ids; of more than ``most_lines`` those with the smallest hashes."""
    rows = text_rows(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(x.replace("\0", "\x01"), y) for t in pdf["text"] for x, y in labelled_lines(t)], columns=["line", "y"])

    n = rows.count()
    some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("secrets")), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, most / max(1, n))))
    got = some.mapInPandas(run, "line string, y int").distinct().orderBy(F.xxhash64("line"), "line", "y").limit(most_lines).collect()  # lines of LENGTH characters
    return sorted((r["line"].replace("\x01", "\0"), r["y"]) for r in got)


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.98, epochs: int = 6, seed: int = 5, lines: list[tuple[str, int]] = ()) -> Network:
    """Adam on four fifths of the findings' windows and the lines; the rest calibrates and sets the threshold: the highest that keeps the wanted recall there."""
    findings = [(line_of(t, x, y), label) for t, a, b, label in findings for x, y in windows(a, b)] + list(lines)
    net, rng = Network(seed=seed), np.random.default_rng(seed)
    x = np.stack([coded(line) for line, _ in findings])
    y = np.array([label for _, label in findings], F32)
    fold = rng.permutation(len(y)) % 5
    learn, kept_out = np.flatnonzero(fold > 0), np.flatnonzero(fold == 0)
    moment, n = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(learn)
        for i in range(0, len(order), 64):
            g = net.step(x[order[i : i + 64]], y[order[i : i + 64]])
            n += 1
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (0.004 * 0.7**epoch * (m / (1 - 0.9**n)) / (np.sqrt(s / (1 - 0.999**n)) + 1e-7)).astype(F32)
    from corpusmill.llm.toxicity import platt

    z = np.concatenate([net.forward(x[kept_out[i : i + 1024]])[0] for i in range(0, len(kept_out), 1024)])
    net.slope, net.shift = platt(z, y[kept_out])
    score, truth = net.scores(x[kept_out]), y[kept_out] > 0
    net.threshold = threshold(score[truth], score[~truth], recall)
    return net


def threshold(secret: np.ndarray, harmless: np.ndarray, recall: float) -> float:
    """At most the score that the wanted share of the secrets reaches; where nearly all harmless findings stay below that, halfway between (in logits), which only adds recall."""
    if not len(secret):
        return 0.5
    limit = float(np.quantile(secret, 1 - recall, method="lower"))
    clear = float(np.quantile(harmless, 0.998, method="higher")) if len(harmless) else 0.5
    if clear >= limit:
        return limit
    a, b = np.log(np.clip([clear, limit], 1e-9, 1 - 1e-9) / (1 - np.clip([clear, limit], 1e-9, 1 - 1e-9)))
    return float(1 / (1 + np.exp(-(a + b) / 2)))


def fit(docs: DataFrame, most: int = 4000, written: int = 4000) -> Network:
    """The network, from about ``most`` documents and two sets of ``written`` findings; a table without candidates leaves the written ones."""
    return train(written_findings(written) + written_runs(written), lines=sample_findings(docs, most))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find(texts: list[str], net: Network) -> tuple[list[list], list[list]]:
    """Rule spans, and all spans, of each text. Every candidate and rule span goes through the network, in windows over its whole
    length; rule spans stay whatever their score, and of candidates the windows that reach the threshold, up to the ends of their words."""
    rules = [rule_spans(t) for t in texts]
    seen = []
    for k, (t, r) in enumerate(zip(texts, rules)):
        seen += [(k, None, w) for _, a, b in r for w in windows(a, b)]
        seen += [(k, c, w) for c in candidates(t, r) for w in windows(*c)]
    score, more = [], [[] for _ in texts]
    for i in range(0, len(seen), 4096):  # a long text has many windows
        score += net.scores(np.stack([codes(texts[k], *w) for k, _, w in seen[i : i + 4096]])).tolist()
    for (k, c, w), p in zip(seen, score):
        if c is None or p < net.threshold:
            continue
        for a, b in outside(*stretch(texts[k], *w, *c), rules[k]):
            if more[k] and a <= more[k][-1][2]:  # windows overlap
                more[k][-1] = ("model", more[k][-1][1], max(b, more[k][-1][2]))
            else:
                more[k].append(("model", a, b))
    return rules, [sorted(r + m, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) for r, m in zip(rules, more)]


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, counts of rule spans, digest of the rule spans, and all spans of every row, over the whole text.

    Null text is empty: no spans, the digest of the empty string. Offsets are code points. Repeated rows each give a
    row; null ids pass through; extra columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rules, found = find(pdf["text"].tolist(), net)
            counts = {f"n_{k}": [sum(s[0] == k for s in r) for r in rules] for k in KINDS[:3]}
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64")} | counts | {"base_sha256": [hashlib.sha256(joined(r).encode()).hexdigest() for r in rules], "spans": list(map(joined, found))})

    return map_frames(text_rows(docs), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, found: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for _, a, b in found:
        if b <= at:
            continue
        if a > at or not out:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with every found secret masked; no row goes, null text stays null, other columns as they were."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        whole = [t or "" for t in texts]
        return pd.Series([None if t is None else mask(w, f) for t, w, f in zip(texts, whole, find(whole, net)[1])], dtype=object)

    return docs.withColumn(text_col, clean(F.col(text_col)))
