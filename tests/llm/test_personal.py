"""Personal data: base kinds against plain patterns, the field against enumeration and on lines it has not seen."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrystat.llm import crf, personal_data
from quarrystat.llm.personal_data import BASE, FOUND, Finder

#: The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(text):
    out = []
    for n, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),  # noqa: B023
                "card": lambda: 14 <= len(d) <= 19 and luhn(d),  # noqa: B023
                "phone": lambda: 10 <= len(d) <= 15,  # noqa: B023
            }[kind]
            if good():
                out.append((m.start(), n, m.end()))
    return sorted(out)


def shown(spans):
    return ",".join(f"{BASE[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def field():
    return crf.train(sorted(personal_data.labelled_lines()), (crf.OUTSIDE, *FOUND), steps=Finder().steps)


@pytest.mark.parametrize("seed", range(4))
def test_base_spans(seed):
    r = random.Random(seed)
    parts = ["a@b.c", "a@b@c.d", "x.y+z@m-n.o.p", "@", "@@", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "000255.0.0.1", "4111 1111 1111 1111", "4111-1111-1111-1112"]
    parts += ["+1 (555) 010-9999", "+49.30.1234567", "+1", "+12(", " ", "é", "😀", ".", "-", "\n", "7", "12345678901234567890", "٣.٣.٣.٣", "%", "a" * 30, "0" * 15]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert personal_data.base_spans(text) == plain(text), text


def test_base_spans_of_long_runs():
    """Time grows with the text, not with its square."""
    n = 300_000
    for text in ("a" * n, "1" * n, "1." * n, "+1" + "(" * n, "a@" * n, "1 " * n, "a.b" * n + "@"):
        personal_data.base_spans(text)


def test_digest(docs, rows, odd, odd_rows):
    for df, known in ((docs, rows), (odd, odd_rows)):
        got = {r["doc_id"]: r for r in personal_data.digest(df, Finder(batch_bytes=50_000)).collect()}
        assert got.keys() == {i for i, _ in known}
        for i, t in known:
            want = plain(t)
            assert got[i]["base_sha256"] == hashlib.sha256(shown(want).encode()).hexdigest()
            assert [got[i][f"n_{k}"] for k in BASE] == [sum(x[1] == n for x in want) for n in range(4)]
            spans = got[i]["spans"].split(",") if got[i]["spans"] else []
            assert [s for s in spans if s.split(":")[0] in BASE] == (shown(want).split(",") if want else [])
            assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), personal_data.KINDS.index(s.split(":")[0])))


def test_digest_of_nothing(none, nulls):
    assert personal_data.digest(none).count() == 0
    assert [r["spans"] for r in personal_data.digest(nulls).collect()] == [""] * 4


def test_few_spans_in_clean_documents(docs, rows):
    extra = sum(s.split(":")[0] in FOUND for r in personal_data.digest(docs).collect() for s in r["spans"].split(",") if s)
    assert extra <= len(rows) / 100


def test_best_paths_are_exact():
    """Decoding runs between certain words gives a path as good as any."""
    r = np.random.default_rng(3)
    for trial in range(30):
        k = 3
        field = crf.Crf(("O", "a", "b"), {}, np.zeros((0, k)), r.normal(size=(k, k)).astype(np.float32) * (1 + trial % 3), ())
        sizes = r.integers(1, 6, 12)
        first = np.zeros(sizes.sum(), dtype=bool)
        first[np.append(0, np.cumsum(sizes)[:-1])] = True
        scores = r.normal(size=(len(first), k)).astype(np.float32) * 4
        scores[:, 0] += 3
        got = field.decode(scores, first)
        at = 0
        value = lambda y, s: sum(s[i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023
        for n in sizes:
            s = scores[at : at + n]
            best = max(value(y, s) for y in itertools.product(range(k), repeat=n))
            assert abs(value(tuple(got[at : at + n]), s) - best) < 1e-3
            at += n


def test_training_slopes():
    """The trained field scores its labelled lines' own labels above others: likelihood by enumeration."""
    lines = [[("call", "O"), ("Ann", "x")], [("Ann", "x"), ("calls", "O")], [("call", "O"), ("me", "O"), ("Bob", "x")], [("it", "O")]]
    field = crf.train(lines, ("O", "x"), steps=120, penalty=0.01)
    for line in lines:
        first = np.arange(len(line)) == 0
        s = field.scores(pa.array([w for w, _ in line]), np.arange(len(line)), first)
        value = lambda y: sum(s[i, v] for i, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))  # noqa: B023
        every = {y: np.exp(value(y)) for y in itertools.product(range(2), repeat=len(line))}
        own = tuple(("O", "x").index(label) for _, label in line)
        assert every[own] / sum(every.values()) > 0.9
        assert tuple(field.decode(s, first)) == own


def _find(field, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    return [x for b in personal_data._run(Finder(), field)([batch]) for x in b.column(1).to_pylist()]


def test_lines_of_other_names(field):
    """Words right on the table's lines, filled in with other names and values than those trained on."""
    before = personal_data.FIRST, personal_data.LAST, personal_data.PLACES
    personal_data.FIRST, personal_data.LAST, personal_data.PLACES = ["Ursula", "Igor", "Fatima", "Björn"], ["Vandenberg", "Kowalski", "Nguyen", "Ibarra"], ["Denver", "Graz", "Lille", "Oviedo"]
    try:
        lines = personal_data.labelled_lines(Finder(seed=77, variants=3, prose=100))
    finally:
        personal_data.FIRST, personal_data.LAST, personal_data.PLACES = before
    right = total = 0
    for line in lines:
        s = field.scores(pa.array([w for w, _ in line]), np.arange(len(line)), np.arange(len(line)) == 0)
        got = field.decode(s, np.arange(len(line)) == 0)
        right += sum(field.labels[y] == label for y, (_, label) in zip(got, line))
        total += len(line)
    assert right / total > 0.98


@pytest.mark.parametrize("text, want", [
    ("Hi, my name is Ursula Vandenberg and you can call me at 212-555-7788.", {"name": "Ursula Vandenberg", "tel": "212-555-7788"}),
    ("Patient Name: Karl Wimmer, DOB: 03/04/1977", {"name": "Karl Wimmer", "birth": "03/04/1977"}),
    ("Frau Ingrid Bauer wohnt Lindenweg 7, 80331 München", {"name": "Ingrid Bauer", "address": "Lindenweg 7, 80331 München"}),
    ("😀 Contact Maria Lopez, 12 Elm Street, Denver 80201", {"name": "Maria Lopez", "address": "12 Elm Street, Denver 80201"}),
    ("SSN: 123-45-6789", {"number": "123-45-6789"}),
    ("In 2019 the Roman Empire sold 12 units.", {}),
    ("Error 404 at line 12. See http://x.y/z?a=1", {}),
])
def test_unseen_texts(field, text, want):
    assert {s["kind"]: text[s["start"] : s["end"]] for s in _find(field, [text])[0]} == want


def test_redact(spark, field):
    rows = [(1, "Name: Karl Wimmer\nwrite to a@b.com or 1.2.3.4", "q"), (2, None, "q"), (3, "nothing here", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = personal_data.redact(df, field)
    assert got.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: "Name: [name]\nwrite to [email] or [ip]", 2: None, 3: "nothing here"}


def test_fit_from_table(spark):
    cfg = Finder(variants=1, prose=20, steps=60)
    field = personal_data.fit(personal_data.labelled_table(spark, cfg), cfg)
    assert field.labels == ("O", *FOUND)
    with pytest.raises(ValueError):
        personal_data.fit(personal_data.labelled_table(spark, cfg), Finder(most_lines=5))
