import base64
import random

import pytest

from tensorloom.llm.bpe import ByteBPE, bpe_roundtrip, tokenizer_files

FILE, PATTERN = tokenizer_files()


@pytest.fixture(scope="module")
def known():
    import tiktoken

    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(known):
    rng = random.Random(3)
    letters = "aaabbe htionérs  \n\t.,'01😀ßñ \x1c\x85 中"
    texts = ["", " ", "a", "the end", "aaaaaaaaaaaaaaaaaaaaaa" * 40, "don't we'll", "x" * 5000, "tion" * 900 + "é" * 300]
    texts += ["".join(rng.choices(letters, k=rng.randrange(200))) for _ in range(300)]
    bpe = ByteBPE(FILE, PATTERN)
    for t, ids in zip(texts, bpe.encode(texts)):
        assert ids == known.encode_ordinary(t), t
        assert bpe.decode(ids).decode() == t


def test_edge_rows(spark, known):
    rows = [(1, None, 5), (1, None, 5), (None, "", 5), (2, "a" * 100_000, 1), (3, "the cat", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = bpe_roundtrip(docs, FILE, PATTERN, with_ids=True).collect()
    assert len(out) == 5 and sorted(r.n_tokens for r in out)[:3] == [0, 0, 0]
    assert next(r for r in out if r.doc_id == 3).ids == known.encode_ordinary("the cat")
    assert all((r.decoded or "") == ({2: "a" * 100_000, 3: "the cat"}.get(r.doc_id, "")) for r in out)
    assert bpe_roundtrip(docs.limit(0), FILE, PATTERN).count() == 0


def test_every_token_encodes_to_itself():
    """What merging all places of a long row at once rests on."""
    bpe = ByteBPE(FILE, PATTERN)
    tokens = [t for t in bpe.token if t]
    ids = bpe.encode_pieces(tokens)
    assert [bpe.token[i[0]] if len(i) == 1 else i for i in ids] == tokens
