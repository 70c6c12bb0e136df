"""Rates by form, on forms that no labelled finding has word for word."""

import random

import pytest

from quarrystat.llm import secrets

LOW, UP, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
WORDS = "river market summer winter garden mountain orange silver window coffee people school bridge castle forest dragon".split()
SECRET = ["password", "token", "API_KEY", "DB_PASS", "client_secret"]


def forms(seed):
    r = random.Random(seed)
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, pick = lambda k: some("0123456789abcdef", k), lambda: r.choice(WORDS)
    every = LOW + UP + DIGITS
    return {
        "password": lambda: f"password: {pick()}{some(DIGITS, 2)}{pick()}{some(DIGITS, 2)}",
        "token": lambda: f"token: {some(LOW + DIGITS, 18)}",
        "API_KEY": lambda: f"API_KEY={some(every, 24)}",
        "DB_PASS": lambda: f'DB_PASS="{some(every, 16)}"',
        "client_secret": lambda: f"client_secret {some(every, 32)}",
        "checkout": lambda: f"git checkout {hexa(40)}",
        "integrity": lambda: f'"integrity": "sha512-{some(every + "+/", 86)}=="',
        "photo": lambda: f"IMG_2024{some(DIGITS, 4)}_{some(DIGITS, 6)}.jpg",
        "class": lambda: f"com.acme.window.{pick().title()}{pick().title()}ServiceImpl",
        "data": lambda: f"data:image/png;base64,{some(every + '+/', 80)}",
        "video": lambda: f"https://video.example.com/watch?v={some(every + '_-', 11)}",
        "asset": lambda: f"/static/main.{hexa(8)}.js",
    }


@pytest.fixture(scope="module")
def rates(spark):
    rows = [(name, f"we then saw this {form()} and went on") for name, form in forms(5).items() for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    hit = {r["doc_id"]: r["n_secrets"] > 0 for r in secrets.digest(df).collect()}
    return {name: sum(hit[i] for i, (n, _) in enumerate(rows) if n == name) / 60 for name in forms(5)}


@pytest.mark.parametrize("name", list(forms(0)))
def test_rate(rates, name):
    assert rates[name] >= 0.9 if name in SECRET else rates[name] <= 0.1


def test_plain_words_are_no_secrets(spark):
    df = spark.createDataFrame([(1, "Several ordinary sentences, considered plainly. DOCUMENTATION everywhere"), (2, "my secret is considerable")], "doc_id long, text string")
    rows = {r["doc_id"]: r["c"] for r in df.select("doc_id", secrets.candidates(df["text"]).alias("c")).collect()}
    assert len(rows[1]) >= 5 and all(x["length"] is None for x in rows[1])
    assert any(x["length"] is not None for x in rows[2])
