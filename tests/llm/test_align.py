"""Token alignment against a two-pointer merge of single texts."""

import hashlib
from collections import Counter, defaultdict

import pytest

from quarrystat.llm import token_align
from quarrystat.llm.queries import align_config

NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def plain(texts):
    """For each text n_a, n_b, the groups, their string and links by pair; the tokens are those of the libraries on whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    cfg = align_config()
    a_model, b_model = Tokenizer.from_file(cfg.a), sentencepiece.SentencePieceProcessor(model_file=cfg.b)
    a_model.encode_special_tokens = True
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    assert ByteLevel().decode(["Ġa"]) == " a" and back["Ġ"] == 32
    for t in texts:
        links, groups, part = Counter(), [], ([], [])
        if t:
            a = a_model.encode(" " + t, add_special_tokens=False)
            b = b_model.encode(t)
            spell_b = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_model.id_to_piece(i)]]
            spell_a = [bytes(back[c] for c in s) for s in a.tokens]
            a = a.ids
            if b"".join(spell_a) != (" " + t).encode() or b"".join(spell_b) != (" " + t).encode():
                a = b = []
        else:
            a = b = []
        i = j = end_a = end_b = 0
        while i < len(a):
            links[a[i], b[j]] += 1
            x, y = end_a + len(spell_a[i]), end_b + len(spell_b[j])
            if x <= y:
                part[0].append(a[i])
                i, end_a = i + 1, x
            if y <= x:
                part[1].append(b[j])
                j, end_b = j + 1, y
            if x == y:
                groups.append(part)
                part = ([], [])
        yield len(a), len(b), len(groups), ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups), links


def wanted(rows):
    per = list(plain(t for _, t in rows))
    docs = Counter(k for *_, links in per for k in links)
    top = defaultdict(int)
    for (a, _), n in docs.items():
        top[a] = max(top[a], n)
    out = []
    for (i, _), (n_a, n_b, n_groups, s, links) in zip(rows, per):
        best = sum(n for k, n in links.items() if docs[k] == top[k[0]])
        total = sum(n * docs[k] for k, n in links.items())
        out.append((i, n_a, n_b, n_groups, sum(links.values()), best, total, hashlib.sha256(s.encode()).hexdigest() if s else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [500_000, 300, 0])
@pytest.mark.parametrize("name", ["docs", "odd"])
def test_alignment(request, name, hot):
    """All pairs broadcast, some, none: the same rows. Long, empty, null and repeated texts, extra columns."""
    df = request.getfixturevalue(name)
    rows = request.getfixturevalue("rows" if name == "docs" else "odd_rows")
    got = token_align.digest(df, align_config(hot_pairs=hot, cached=2000, batch_bytes=20_000))
    assert sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in got.collect()), key=str) == wanted(rows)


def test_alignment_of_odd_characters(spark):
    """Marks of either tokenizer, control characters, runs of spaces, bytes without a piece, special tokens as text, ties."""
    texts = ["a▁b", "<s> </s> <|endoftext|> <0x41>", "  x   y ", "\x00\x01\t\r\n", "é e\u0301 日本 \u200b😀😀", "Ġ Ċ", " ", "x", "x", None, "", "▁", "a\xa0b", "don't  we'll\n\n '"]
    rows = [(None if i % 5 == 4 else i // 2, t) for i, t in enumerate(texts)]
    got = token_align.digest(spark.createDataFrame(rows, "doc_id long, text string"), align_config()).collect()
    assert sorted(((r["doc_id"], *[r[n] for n in NAMES]) for r in got), key=str) == wanted(rows)


def test_groups_and_counts(spark):
    df = spark.createDataFrame([(1, "unbelievable things"), (2, "things"), (3, "unbelievable")], "doc_id long, text string")
    cfg = align_config()
    got = {r["doc_id"]: r for r in token_align.align(df, cfg, groups=True).collect()}
    assert {i: r["groups"] for i, r in got.items()} == {i: s for i, (*_, s, _) in zip((1, 2, 3), plain(["unbelievable things", "things", "unbelievable"]))}
    counts = token_align.pair_counts(token_align.align(df, cfg)).collect()
    want = Counter(k for *_, links in plain(["unbelievable things", "things", "unbelievable"]) for k in links)
    assert {(r["a"], r["b"]): r["docs"] for r in counts} == want
    for side in "ab":
        for r in counts:
            assert r[f"best_{side}"] == (r["docs"] == max(x["docs"] for x in counts if x[side] == r[side]))


def test_alignment_empty(none, nulls):
    cfg = align_config()
    assert token_align.digest(none, cfg).columns == ["doc_id", *NAMES] and token_align.digest(none, cfg).count() == 0
    assert sorted(r["n_a"] for r in token_align.digest(nulls, cfg).collect()) == [0, *sorted(x[1] for x in wanted([(1, "a b c d"), (4, "k l m n o p"), (4, "k l m n o p")]))]
