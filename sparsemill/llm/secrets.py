"""Secret scans: patterns propose candidates, a character convolutional network scores each with its context.

The network is written in numpy: characters are embedded, a convolution runs over the candidate and
the text around it, and maxima and means over the candidate and over its context lead to one
probability. Of a candidate that is longer than what it sees at once, windows cover the whole, and
the highest probability counts. It is trained on labelled findings: a seeded rule writes snippets
with secrets of many shapes, and with look-alikes such as checksums, paths, identifiers and
placeholders, and what the patterns propose there is labelled by whether it holds a secret. It is
scaled on a part that it wasn't trained on, and the threshold is the highest that keeps the recall
asked for on that part.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_slices

#: Characters that the network sees before, in and after a candidate.
BEFORE, INSIDE, AFTER = 32, 40, 8
#: Characters from one window of a long candidate to the next, and windows that are scored at once.
WINDOW_STEP, WINDOWS_AT_ONCE = 10, 1024
EMBEDDED, FILTERS, WIDTH = 10, 32, 5
FINDINGS, HELD_BACK, EPOCHS, BATCH, STEP = 10_000, 0.3, 5, 64, 0.005
RECALL = 0.98
#: How strongly calibration holds the scale to 1 and the shift to 0: findings that are told apart wholly would make both infinite.
HELD_TO_UNIT = 20.0
MASK = "[secret]"

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "token", "login", "pem", "value")

_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_LOGIN = re.compile(r"://[^\s:/@]+:([^\s/@]{4,})@")
_KEY_MARK = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
#: What follows a name and a sign, what is quoted, and what a request carries to say who makes it.
_VALUES = (
    re.compile(r"""(?<![A-Za-z0-9_./-])[A-Za-z_][A-Za-z0-9_.-]*+["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*["']?(?!//)([^\s"'<>,;]{8,})"""),
    re.compile(r"""["']([^\s"'<>]{12,})["']"""),
    re.compile(r"(?<![A-Za-z])(?i:bearer|basic)\x20+([A-Za-z0-9._~+/=-]{8,})"),
)
_TELLING = re.compile(r"[^a-z.,:;!?()]")

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, in code points. A failing match still takes its characters."""
    found: list[Span] = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    return found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


def private_keys(text: str) -> Iterator[Span]:
    """From the mark of each key's beginning to the mark of its end, or as far as what may be a key goes if that is missing."""
    begun = None
    for m in [*_KEY_MARK.finditer(text), None]:
        if begun and (m is None or m[1] == "BEGIN"):
            yield begun.start(), 5, _KEY_BODY.match(text, begun.end(), m.start() if m else len(text)).end()
        elif begun:
            yield begun.start(), 5, m.end()
        begun = m if m and m[1] == "BEGIN" else None


def added_candidates(text: str, base: list[Span]) -> list[Span]:
    """Further places that may hold a secret, clear of the base spans. They may overlap each other."""
    holds = lambda found, letters: not letters.isdisjoint(found)
    found = {(m.start(), m.end()): 3 for m in _TOKEN.finditer(text) if holds(m[0], _DIGITS) and holds(m[0], _LETTERS)}
    if ":" in text or "=" in text or '"' in text or "'" in text or "earer" in text or "asic" in text:
        found |= {(m.start(1), m.end(1)): 6 for p in _VALUES for m in p.finditer(text) if _TELLING.search(m[1])}
    if "://" in text:
        found |= {(m.start(1), m.end(1)): 4 for m in _LOGIN.finditer(text)}
    if "-----BEGIN" in text:
        found |= {(s, e): k for s, k, e in private_keys(text)}
    starts, ends = [], []  # the places that base spans take, as runs apart from each other
    for s, _, e in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    at = lambda e: bisect_right(starts, e - 1) - 1  # noqa: E731  the last run that begins before e
    return sorted((s, kind, e) for (s, e), kind in found.items() if at(e) < 0 or ends[at(e)] <= s)


def apart(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Of spans that overlap, the one that begins first, and of these the longest."""
    found, end = [], 0
    for span in sorted(spans, key=lambda x: (x[0], -x[2])):
        if span[0] >= end:
            found.append(span)
            end = span[2]
    return found


_DIGITS, _LETTERS = frozenset(string.digits), frozenset(string.ascii_letters)
#: A small alphabet: printable ASCII stands for itself, 1 is white space, 2 any other letter, 3 the rest; 0 is nothing.
ALPHABET = ord("~") - 29 + 1
_CODE = np.array([k - 29 if 33 <= k <= 126 else 1 if chr(k).isspace() else 3 for k in range(128)], np.uint8)


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _CODE[np.minimum(points, 127)]
    if not text.isascii():
        for p in np.unique(points[points > 127]).tolist():
            codes[points == p] = 1 if chr(p).isspace() else 2 if chr(p).isalpha() else 3
    return codes


LENGTH = BEFORE + INSIDE + AFTER
_IN = np.zeros(LENGTH, bool)
_IN[BEFORE : BEFORE + INSIDE] = True


def encode(codes: np.ndarray, start: int, end: int, window: int | None = None) -> np.ndarray:
    """The codes of the context before, of the candidate and of the context after. Of a long candidate, both ends, or what is seen from `window` on."""
    out = np.zeros(LENGTH, np.uint8)
    before, after = codes[max(0, start - BEFORE) : start], codes[end : end + AFTER]
    out[BEFORE - len(before) : BEFORE] = before
    if window is not None:
        inside = codes[window : min(window + INSIDE, end)]
    else:
        inside = codes[start:end] if end - start <= INSIDE else np.concatenate((codes[start : start + INSIDE // 2], codes[end - INSIDE // 2 : end]))
    out[BEFORE : BEFORE + len(inside)] = inside
    out[BEFORE + INSIDE : BEFORE + INSIDE + len(after)] = after
    return out


def views(codes: np.ndarray, start: int, end: int) -> Iterator[np.ndarray]:
    """All that the network sees of a candidate: its codes, and of a long one those of windows that cover it."""
    yield encode(codes, start, end)
    if end - start > INSIDE:
        for window in [*range(start, end - INSIDE, WINDOW_STEP), end - INSIDE]:
            yield encode(codes, start, end, window)


class Network:
    """Embedding, convolution, rectifier, maximum and mean over the candidate and maximum over its context, logistic unit."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.3, (ALPHABET, EMBEDDED)),
            "kernel": rng.normal(0, (WIDTH * EMBEDDED) ** -0.5, (WIDTH * EMBEDDED, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": rng.normal(0, (3 * FILTERS) ** -0.5, 3 * FILTERS),
            "bias": np.zeros(1),
        }
        self.scale, self.offset, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, codes: np.ndarray):
        wide = np.pad(codes, ((0, 0), (WIDTH // 2, WIDTH // 2)))
        at = np.lib.stride_tricks.sliding_window_view(wide, WIDTH, axis=1)
        seen = self.p["embed"][at].reshape(*codes.shape, WIDTH * EMBEDDED)
        raised = seen @ self.p["kernel"] + self.p["shift"]
        there = np.where((codes > 0)[..., None], np.maximum(raised, 0), 0)
        inside, around = there[:, _IN], there[:, ~_IN]
        count = np.maximum((codes[:, _IN] > 0).sum(axis=1, keepdims=True), 1)
        pooled = np.concatenate((inside.max(axis=1), inside.sum(axis=1) / count, around.max(axis=1)), axis=1)
        return pooled @ self.p["out"] + self.p["bias"], (at, seen, raised, inside, around, count, pooled, codes)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return self._forward(codes)[0]

    def _gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        z, (at, seen, raised, inside, around, count, pooled, _) = self._forward(codes)
        err = (1 / (1 + np.exp(-z)) - labels) / len(labels)
        back = err[:, None] * self.p["out"]
        d = np.zeros_like(raised)
        rows, own = np.arange(len(codes))[:, None], np.arange(FILTERS)
        part_in, part_out = np.flatnonzero(_IN), np.flatnonzero(~_IN)
        d[rows, part_in[inside.argmax(axis=1)], own] += back[:, :FILTERS]
        d[:, _IN] += (back[:, FILTERS : 2 * FILTERS] / count)[:, None]
        d[rows, part_out[around.argmax(axis=1)], own] += back[:, 2 * FILTERS :]
        d *= (raised > 0) & (codes > 0)[..., None]
        flat = d.reshape(-1, FILTERS)
        to_seen = (flat @ self.p["kernel"].T).reshape(*at.shape, EMBEDDED)
        embed = np.zeros_like(self.p["embed"])
        for k in range(EMBEDDED):
            embed[:, k] = np.bincount(at.ravel(), to_seen[..., k].ravel(), ALPHABET)
        return {"embed": embed, "kernel": seen.reshape(-1, WIDTH * EMBEDDED).T @ flat, "shift": flat.sum(axis=0), "out": pooled.T @ err, "bias": err.sum(keepdims=True)}

    def train(self, codes: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 42) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(codes))
            for k in range(0, len(order), BATCH):
                t += 1
                for name, g in self._gradients(codes[order[k : k + BATCH]], labels[order[k : k + BATCH]]).items():
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g * g
                    self.p[name] = self.p[name] - STEP * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)

    def highest(self, candidates: Iterable[Iterable[np.ndarray]]) -> np.ndarray:
        """The highest logit over the views of each candidate. Views are made as they are scored, so that memory doesn't follow the longest candidate."""
        every = ((k, codes) for k, seen in enumerate(candidates) for codes in seen)
        found: list[float] = []
        while part := list(islice(every, WINDOWS_AT_ONCE)):
            for (k, _), z in zip(part, self.logits(np.stack([codes for _, codes in part])).tolist(), strict=True):
                if k == len(found):
                    found.append(z)
                else:
                    found[k] = max(found[k], z)
        return np.array(found)

    def calibrate(self, codes: np.ndarray, labels: np.ndarray, recall: float = RECALL) -> None:
        """Scale and shift the logits to likelihood on findings that weren't trained on; then the highest threshold with that recall."""
        z = self.logits(codes)
        for _ in range(200):
            p = 1 / (1 + np.exp(-(self.scale * z + self.offset)))
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * z * z).sum(), (w * z).sum()], [(w * z).sum(), w.sum()]]) + HELD_TO_UNIT * np.eye(2)
            slope = [((p - labels) * z).sum() + HELD_TO_UNIT * (self.scale - 1), (p - labels).sum() + HELD_TO_UNIT * self.offset]
            self.scale, self.offset = np.array([self.scale, self.offset]) - np.linalg.solve(h, slope)
        of_secrets = np.sort(self.probability(codes[labels == 1]))
        self.threshold = float(of_secrets[int((1 - recall) * len(of_secrets))])

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -500, 500)))

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(codes))


@dataclass
class Finding:
    """A candidate that the patterns propose in a snippet, and whether it holds a secret."""

    text: str
    start: int
    end: int
    secret: bool


SYLLABLES = ("the", "an", "re", "ti", "on", "ver", "la", "que", "sch", "mo", "er", "en", "ha", "st", "de", "í", "é", "ü", "con", "per", "ment", "ing", "al", "us", "com", "tor", "wa", "low", "ly", "fo", "bri", "dun", "kel", "pos", "ten", "gra", "mi")
SECRET_NAMES = ("password", "passwd", "pwd", "pass", "secret", "token", "api_key", "apikey", "api-key", "client_secret", "auth", "auth_token", "access_key", "private_key", "credentials", "secret_access_key", "passphrase", "signing_key", "x-api-key", "db_password", "accountkey")
PLAIN_NAMES = ("version", "path", "file", "date", "color", "title", "url", "host", "id", "uuid", "checksum", "commit", "license", "author", "size", "phone", "mail", "name", "level", "mode", "status", "type", "time", "address", "sha1", "md5", "etag", "revision", "digest", "request", "session", "order", "ref", "build", "image", "class", "key", "label", "note")
LEADS = ("ghp_", "gho_", "sk_live_", "sk-", "rk_test_", "xoxb-", "xoxp-", "glpat-", "npm_", "pypi-", "AIza", "AKIA", "shpat_", "SG.")


class Snippets:
    """A seeded rule for snippets of prose and settings with one secret, or one look-alike, each."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def any_of(self, letters: str, low: int, high: int) -> str:
        return "".join(self.r.choice(letters) for _ in range(self.r.randint(low, high)))

    def word(self, low: int = 1, high: int = 4) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(low, high)))

    def plain(self, low: int = 1, high: int = 4) -> str:
        return self.word(low, high).replace("í", "i").replace("é", "e").replace("ü", "u")

    def prose(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 8)))

    def strong(self) -> str:
        """What looks like a secret of itself."""
        mixed = string.ascii_letters + string.digits
        return self.r.choice([lambda: self.any_of(mixed, 24, 64), lambda: self.any_of(mixed + "+/", 28, 60) + "=" * self.r.randint(0, 2), lambda: self.any_of(mixed + "_-", 24, 48), lambda: "eyJ" + self.any_of(mixed + "_-", 24, 60), lambda: self.r.choice(LEADS) + self.any_of(mixed, 16, 40), lambda: self.any_of(string.ascii_lowercase, 2, 5) + self.r.choice("_-.") + self.any_of(mixed, 24, 44)])()

    def weak(self) -> str:
        """What is a secret for its name or its place."""
        mixed = string.ascii_letters + string.digits
        return self.r.choice(
            [
                lambda: self.any_of(mixed, 10, 24), lambda: self.any_of("0123456789abcdef", 12, 64), lambda: self.any_of(mixed + "!#$%&*+-_", 9, 24),
                *[lambda: self.plain(2, 3).capitalize() + self.any_of(string.digits, 2, 4) + self.r.choice("!#$%&*?")] * 2, lambda: "-".join(self.plain(1, 2) for _ in range(4)) + self.any_of(string.digits, 1, 3),
            ]
        )()

    def named(self, name: str, value: str) -> tuple[str, str, str]:
        """What comes before, the value, and what comes after."""
        name = self.r.choice([name, name.upper(), name.capitalize(), f"{self.plain(1, 2)}_{name}", f"{self.plain(1, 2)}.{name}"])
        return self.r.choice([(f"{name} = ", value, ""), (f"{name}: ", value, ""), (f"{name}=", value, ""), (f'{name}="', value, '"'), (f'"{name}": "', value, '",'), (f"export {name}='", value, "'"), (f"{name} := '", value, "';"), (f"{name} => \"", value, '"')])

    def secret(self) -> tuple[str, str, str]:
        r, any_value = self.r, lambda: self.strong() if self.r.random() < 0.5 else self.weak()
        key = "\n".join(self.any_of(string.ascii_letters + string.digits + "+/", 64, 64) for _ in range(r.randint(1, 4)))
        kind = r.choice(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "])
        header = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123\n\n" if r.random() < 0.2 else ""
        return r.choice(
            [
                *[lambda: self.named(r.choice(SECRET_NAMES), any_value())] * 4, lambda: self.named(self.plain(), self.strong()), lambda: (r.choice(["Authorization: Bearer ", "curl -H 'Authorization: Bearer ", "bearer "]), self.strong(), ""),
                lambda: (f"{r.choice(['https', 'ftp', 'postgres', 'redis', 'amqp'])}://{self.plain()}:", any_value().replace("/", "-"), f"@{self.plain()}.example/{self.plain()}"), lambda: (r.choice(["", "use ", "key is ", '"', "("]), self.strong(), ""),
                lambda: ("", f"-----BEGIN {kind}PRIVATE KEY-----\n{header}{key}\n-----END {kind}PRIVATE KEY-----", ""),
            ]
        )()

    def other(self) -> tuple[str, str, str]:
        r, hexa = self.r, "0123456789abcdef"
        path = lambda: "/".join(self.plain() for _ in range(r.randint(3, 6)))
        uuid = lambda: "-".join(self.any_of(hexa, k, k) for k in (8, 4, 4, 4, 12))
        values = [
            lambda: self.any_of(hexa, 20, 64), uuid, lambda: f"{path()}/{r.randint(1, 2030)}", *[lambda: f"http{r.choice(['', 's'])}://{r.choice(['', 'www.'])}{self.plain()}.{r.choice(['org', 'com', 'example', 'net'])}/{path()}{r.choice(['', '-' + self.plain(), '-' + str(r.randint(1900, 2030))])}{r.choice(['', '/', '.html', '/index.html', f'?{self.plain()}={r.randint(1, 99)}', f'/{r.randint(1, 2030)}'])}"] * 3, lambda: "_".join(self.plain() for _ in range(r.randint(3, 6))) + f"_{r.randint(0, 99)}",
            lambda: "-".join(self.plain() for _ in range(r.randint(3, 6))) + f"-{r.randint(0, 2030)}", lambda: r.choice("ABCDEFR") + self.any_of(string.digits, 12, 24), lambda: r.choice("=-_") * r.randint(16, 60) + r.choice(["1", "a1", "v2"]),
            lambda: "".join(self.plain() for _ in range(r.randint(4, 9))) + str(r.randint(0, 9)), lambda: f"20{r.randint(10, 30)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}Z", lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + f":{r.randint(80, 9999)}",
            lambda: f"{self.plain()}.{self.plain()}{r.randint(0, 99)}@{self.plain()}.example.com", lambda: f"+{r.randint(1, 99)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}-{r.randint(10, 99)}", lambda: "".join(self.plain().capitalize() for _ in range(r.randint(2, 4))) + r.choice(["", "", "(", "()", "Id", "Name", "2"]), lambda: self.plain(3, 5).capitalize(), lambda: f"{self.plain(2, 3)}.{self.plain(2, 3)}.{self.plain(2, 3)}{r.randint(0, 9)}",
        ]
        holders = ["your_password_here_123", "xxxxxxxxxxxxxxxxxxxxxxx1", "changeme-changeme-2020", "example_token_value_01", "insert-your-api-key-here-1", "${DB_PASSWORD_1}", "{{secrets.TOKEN_2}}", "<YOUR_TOKEN_HERE>", "os.environ['TOKEN_1']", "REDACTED_REDACTED_1", "************1", "process.env.API_KEY", "getpass.getpass()", "Must_be_set_by_you"]
        holders += [a + "-".join(self.plain() for _ in range(3)) + str(r.randint(1, 9)) + b for a, b in (("<", ">"), ("${", "}"), ("[", "]"))]
        return r.choice(
            [
                *[lambda: self.named(r.choice(PLAIN_NAMES), r.choice(values)())] * 4, *[lambda: ("", r.choice(values)(), "")] * 3, lambda: self.named(self.word(), r.choice(values)()), lambda: self.named(r.choice(SECRET_NAMES), r.choice(holders)), lambda: (f"{self.word()}: ", self.word(4, 6).capitalize(), ""),
                lambda: ("data:image/png;base64,", self.any_of(string.ascii_letters + string.digits + "+/", 24, 60), ""), lambda: (f"{r.choice(['commit', 'sha256', 'checksum', 'merge of'])} ", self.any_of(hexa, 20, 64), ""), lambda: (f'{self.word()} "', r.choice(values)(), '" '), lambda: (f"https://{self.plain()}.example:{r.randint(80, 9999)}/", f"{path()}@{self.plain()}", ""),
            ]
        )()

    def snippet(self, secret: bool) -> tuple[str, int, int]:
        """A text, and where its secret or look-alike is."""
        lead, value, tail = self.secret() if secret else self.other()
        before = self.r.choice(["", self.prose() + " ", self.prose() + "\n", self.prose() + ", "]) + lead
        return before + value + tail + self.r.choice(["", " ", "\n", ". ", ", ", ") "]) + self.prose(), len(before), len(before) + len(value)


def findings(n: int = FINDINGS, seed: int = 42) -> list[Finding]:
    """About n labelled findings in snippets, half of which have a secret. A finding holds a secret if it has half of one, or lies in one by half."""
    made, source, k = [], Snippets(seed), 0
    while len(made) < n:
        text, start, end = source.snippet(k % 2 == 1)
        base = base_spans(text)
        for s, _, e in base + added_candidates(text, base):
            made.append(Finding(text, s, e, k % 2 == 1 and 2 * (min(e, end) - max(s, start)) >= min(end - start, e - s)))
        k += 1
    source.r.shuffle(made)
    return made


_trained: dict[tuple[int, int, float], Network] = {}


def trained(n: int = FINDINGS, seed: int = 42, recall: float = RECALL) -> Network:
    """The network, trained once a process."""
    if (n, seed, recall) not in _trained:
        found = findings(n, seed)
        codes = np.stack([encode(codes_of(f.text), f.start, f.end) for f in found])
        labels = np.array([f.secret for f in found], np.float64)
        back = int(len(found) * HELD_BACK)
        net = Network(seed)
        net.train(codes[back:], labels[back:], seed=seed)
        net.calibrate(codes[:back], labels[:back], recall)
        _trained[n, seed, recall] = net
    return _trained[n, seed, recall]


def scan(texts: list[str], net: Network) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, probability) of the secrets in each text, by start, kind and end. Base spans stay, whatever their score."""
    base = [base_spans(t) for t in texts]
    every = [b + added_candidates(t, b) for t, b in zip(texts, base, strict=True)]
    seen = (views(codes, s, e) for t, spans in zip(texts, every, strict=True) if spans for codes in [codes_of(t)] for s, _, e in spans)
    scored = iter(net.scaled(net.highest(seen)).tolist())
    found = [[(*span, next(scored)) for span in spans] for spans in every]
    return [sorted([x for x in spans if x[1] < len(BASE)] + apart([x for x in spans if x[1] >= len(BASE) and x[3] >= net.threshold])) for spans in found]


def masked(text: str, spans: list[tuple[int, int, int, float]], mask: str = MASK) -> str:
    """The text with each secret replaced; overlapping spans count as one."""
    out, at = [], 0
    for start, _, end, _ in spans:
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """doc_id, counts, digest and list of the spans, and their scores."""
    net = net or trained()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scan([t or "" for t in batch.column(1).to_pylist()], net)
        listed = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans)
        base = [[x for x in spans if x[1] < len(BASE)] for spans in found]
        counts = [pa.array([sum(x[1] == k for x in spans) for spans in base], pa.int64()) for k in range(len(BASE))]
        sha = [hashlib.sha256(listed(spans).encode()).hexdigest() for spans in base]
        scores = [",".join(f"{p:.3f}" for *_, p in spans) for spans in found]
        return pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array(map(listed, found), pa.string()), pa.array(scores, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(map_slices(run), schema)


def mask(docs: DataFrame, net: Network | None = None, length: str | None = None) -> DataFrame:
    """The documents with their secrets masked in `text`, all other columns as they are; `length`, if named, follows the new text."""
    net, names = net or trained(), docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index("text")
        texts = batch.column(at).to_pylist()
        found = scan([t or "" for t in texts], net)
        if not any(found):
            return batch
        new = [masked(t, spans) if spans else t for t, spans in zip(texts, found, strict=True)]
        cols = list(batch.columns)
        cols[at] = pa.array(new, batch.schema.field(at).type)
        if length in names:
            k = names.index(length)
            held = cols[k].to_pylist()
            cols[k] = pa.array([len(t) if spans else h for t, spans, h in zip(new, found, held, strict=True)], batch.schema.field(k).type)
        return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(map_slices(run), docs.schema)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document.

    A null or empty text has none; a very long text is scanned whole, in time that follows its
    length and its candidates, and a long candidate by windows that cover it; a candidate just at
    the threshold is a secret, and of added ones that overlap the first stays; repeated rows each
    have their row; an empty table gives none; other columns of the input are not read.
    """
    return find(documents(spark, sf_dir))
