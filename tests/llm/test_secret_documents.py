"""Labelled documents that another rule than the training one writes: what is found of secrets beyond the base kinds, and what else is taken for one."""

from __future__ import annotations

import random
import string

import pytest

from sparsemill.llm import secrets

ALNUM = string.ascii_letters + string.digits
NEWS = "the committee met on tuesday to discuss the new harbour and its cost for the town while a storm was on its way".split()


class Writer:
    def __init__(self, seed):
        self.r = random.Random(seed)

    def some(self, letters, n):
        return "".join(self.r.choice(letters) for _ in range(n))

    def prose(self, n=12):
        return " ".join(self.r.choice(NEWS) for _ in range(n)).capitalize() + "."

    def secret(self):
        """(text, secret) of a kind that the base rules don't know."""
        r = self.r
        strong, word = self.some(ALNUM, r.randint(26, 44)), r.choice(["Dragon", "Sunset", "Winter", "Rocket", "Falcon"]) + self.some(string.digits, 4) + r.choice("!$#&")
        return r.choice(
            [
                lambda: (f"STRIPE_LIVE={(v := 'rk_live_' + strong)}", v), lambda: (f"hub login with {(v := 'hf_' + strong)} done", v), lambda: (f"auth:\n  user: root\n  credentials: {(v := strong)}\n", v), lambda: (f"db.pass={(v := word)}\ndb.user=app", v),
                lambda: (f'{{"user": "ann", "pwd": "{(v := word)}"}}', v), lambda: (f"mysql://shop:{(v := strong)}@db.internal:3306/shop", v), lambda: (f"git clone https://ann:{(v := 'ghp_' + self.some(ALNUM, 36))}@github.com/a/b.git", v),
                lambda: (f"curl -H 'Authorization: Bearer {(v := 'eyJhbGciOi' + self.some(ALNUM, 40))}' https://api.example.com", v), lambda: (f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n{(v := self.some(ALNUM + '+/', 64))}\n-----END RSA PRIVATE KEY-----", v),
                lambda: (f"export SLACK_AUTH='{(v := 'xoxb-' + self.some(string.digits, 12) + '-' + self.some(ALNUM, 24))}'", v), lambda: (f"passphrase => \"{(v := self.some(ALNUM + '!#%&*', 18))}\"", v), lambda: (f"the new key {(v := 'AIza' + self.some(ALNUM + '_-', 35))} works", v),
            ]
        )()

    def other(self):
        r, hexa = self.r, "0123456789abcdef"
        word = lambda: r.choice(NEWS)
        return r.choice(
            [
                lambda: f"see https://www.{word()}.example/{word()}/{word()}-{word()}-{r.randint(1990, 2024)}/index.html", lambda: f"package {word()}-{word()}-{r.randint(1, 9)}.{r.randint(1, 9)}.{r.randint(1, 9)}.tar.gz", lambda: f"trace id {self.some(hexa, 8)}-{self.some(hexa, 4)}-4{self.some(hexa, 3)}-a{self.some(hexa, 3)}-{self.some(hexa, 12)}",
                lambda: f"published: {r.randint(2000, 2024)}-05-17T08:30:00Z, author: {word().capitalize()} {word().capitalize()}son", lambda: f"def {word()}_{word()}(self): return {word()}.{word()}_{word()}2", lambda: f"call +44-20-{self.some(string.digits, 4)}-{self.some(string.digits, 4)} or mail {word()}.{word()}7@example.org",
                lambda: f"class: {word().capitalize()}{word().capitalize()}Controller, level: Intermediate", lambda: f"isbn {self.some(string.digits, 13)} invoice INV{self.some(string.digits, 12)}", lambda: "=" * 30 + "1" + "-" * 30, lambda: f'title = "{word().capitalize()}_{word()}_{word()}_{r.randint(1, 99)}"',
                lambda: f"blob {self.some(hexa, 24)} {word()}/{word()}/{word()}/{word()}2.txt", lambda: f"password: {r.choice(['<ask-your-admin-1>', '${ADMIN_PASSWORD_2}', '****'])}",
            ]
        )()


@pytest.fixture(scope="module")
def results():
    w = Writer(2024)
    made = [w.secret() for _ in range(600)]
    texts = [f"{w.prose()}\n{t}\n{w.prose()}" for t, _ in made]
    found = secrets.scan(texts, secrets.trained())
    gone = [v not in secrets.masked(t, spans) for t, spans, (_, v) in zip(texts, found, made, strict=True)]
    clean = [f"{w.prose()} {w.other()} {w.prose()}" for _ in range(600)]
    alarms = [(t, spans) for t, spans in zip(clean, secrets.scan(clean, secrets.trained()), strict=True) if any(x[1] >= 3 for x in spans)]
    return made, found, gone, alarms


def test_recall_and_alarms(results):
    made, found, gone, alarms = results
    by_network = sum(any(x[1] >= 3 for x in spans) for spans in found)
    print(f"secrets found: {sum(gone)} of {len(made)}, {by_network} by the network's verdict; clean documents with an alarm: {len(alarms)} of 600")
    assert sum(gone) >= 0.9 * len(made) and by_network >= 0.7 * len(made)
    assert len(alarms) <= 30, alarms[:10]


def test_every_kind_is_found(results):
    _, found, _, _ = results
    assert {secrets.KINDS[x[1]] for spans in found for x in spans} >= {"token", "login", "pem", "value"}


def test_long_names_and_headers():
    login = "x" * 100
    key = Writer(1).some(ALNUM, 90)
    texts = [f"https://{login}:{key}@host", "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00FF\n\n" + key * 20 + "\n-----END RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----\n" + key]
    for text, spans in zip(texts, secrets.scan(texts, secrets.trained()), strict=True):
        assert key not in secrets.masked(text, spans), text
