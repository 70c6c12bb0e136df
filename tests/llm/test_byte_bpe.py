"""The batch encoder against the library's own encode, text by text."""

import random

import pyarrow as pa
import pytest

from quarrystat.llm import token_output
from quarrystat.llm.byte_bpe import ByteBpe
from quarrystat.llm.queries import tokenizer_path
from quarrystat.llm.wavelet import WaveletMatrix

PARTS = ["'", "''", "'s", "'re", "'ll", "'ve", "'d", "'t", "'T", " ", "  ", "\n", "\t", "\r\n", "a", "b", "Z", "é", "ß", "1", "٣", "²", "Ⅷ", "!", "?"]
PARTS += ["...", "—", "…", "\xa0", " ", "​", "日", "本", "😀", "👍🏽", "\x00", "\x1c", "\x85", "s", "re", "ll", "<|endoftext|>", "<|", "ー", "़", "क"]


@pytest.mark.parametrize("special_as_text", [False, True])
def test_hostile_texts(special_as_text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.encode_special_tokens = special_as_text
    enc = ByteBpe(tokenizer_path(), 300, special_as_text)
    r = random.Random(5)
    for _ in range(40):
        texts = [None if r.random() < 0.03 else "".join(r.choice(PARTS) for _ in range(r.choice([0, 1, 2, 3, 5, 9, 30]))) for _ in range(100)]
        ids, counts = enc.encode(pa.array(texts, pa.string()).slice(3), 7)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts[3:]]
        assert counts.tolist() == list(map(len, want))
        assert ids.tolist() == sum(want, [])


def test_no_texts():
    ids, counts = ByteBpe(tokenizer_path(), 10).encode(pa.array([], pa.string()), 0)
    assert len(ids) == len(counts) == 0


def test_find_token(odd):
    shards = token_output.write_shards(odd, token_output.Output(tokenizer_path(), shard_tokens=3000))
    found = {(r["part"], r["shard"]): (r["n"], r["first"]) for r in token_output.find_token(shards, 82).collect()}
    for r in shards.collect():
        at = [i for i, t in enumerate(WaveletMatrix(r["blob"]).tokens().tolist()) if t == 82]
        assert found.get((r["part"], r["shard"])) == ((len(at), at[0]) if at else None)
