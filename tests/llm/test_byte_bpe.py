"""The sentencepiece form of a rank file against the library whose file it is."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from photoflow.llm import byte_bpe, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
EVERY = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.ByteBPE(RANKS, PATTERN)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def odd_texts() -> list[str]:
    rng = random.Random(5)
    letters = "aZ'stve  \n\t\r\x1c\x85 é中文字дя1２٣½…“”😀‍́\xa0 　ͅ'll're"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*made, "", " ", "\n", "<|endoftext|> 's 'S", EVERY, "".join(rng.sample(EVERY, 5000)), "a" * 50_000, " " * 9000 + "x", "中文" * 30_000, "don't " * 250_000]


def test_ids_are_the_librarys(bpe, library):
    texts = odd_texts()
    got = bpe.encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert bpe.decode(ids.tolist()) == text.encode()


def test_every_piece_is_reached_and_inverted(bpe):
    assert [byte_bpe.as_bytes(byte_bpe.as_characters(t)) for t in bpe.tokens] == bpe.tokens
    merged = bpe.model.encode([byte_bpe.as_characters(t) for t in bpe.tokens])
    assert [bpe.rank[x].tolist() for x in merged] == [[bpe.ranks[t]] for t in bpe.tokens]


def test_a_small_cache_and_short_pieces_give_the_same(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "LONG", 100)
    monkeypatch.setattr(byte_bpe, "PIECE", 7)
    monkeypatch.setattr(byte_bpe, "LONG_MATCH", 5)
    texts = [t for t in odd_texts() if len(t) < 20_000] + ["internationalisation " * 30]
    other = byte_bpe.ByteBPE(RANKS, PATTERN)
    assert [x.tolist() for x in other.encode(texts)] == [library.encode_ordinary(t) for t in texts]
    assert len(other.words) <= 50 + max(len(set(t.split())) * 4 for t in texts)


def test_ranks_with_gaps(tmp_path):
    lines = [f"{__import__('base64').b64encode(bytes([b])).decode()} {b * 3}" for b in range(256)] + [f"{__import__('base64').b64encode(b'ab').decode()} 900", f"{__import__('base64').b64encode(b'abc').decode()} 1000"]
    (tmp_path / "own").write_text("\n".join(lines))
    own = byte_bpe.ByteBPE(str(tmp_path / "own"), PATTERN)
    assert own.encode(["abc abd"])[0].tolist() == [1000, 96, 900, 300]
    assert own.decode([1000, 96, 900, 300]) == b"abc abd"


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (None, "same text", None), (3, "same text", "x"), (3, "same text", "x"), (4, "word " * 300_000, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    coded = byte_bpe.encode(docs, RANKS, PATTERN)
    assert coded.columns == ["doc_id", "decoded", "ids"]
    with pytest.raises(ValueError):
        byte_bpe.decode(coded, RANKS, PATTERN)
    with pytest.raises(ValueError):
        byte_bpe.encode(docs.withColumn("ids", docs["doc_id"]), RANKS, PATTERN)
    back = byte_bpe.decode(coded, RANKS, PATTERN, bytes_col="raw").collect()
    assert sorted(((r.doc_id or 0), r.decoded or "", r.ids) for r in back) == sorted(((a or 0), c or "", library.encode_ordinary(b or "")) for a, b, c in rows)
    assert all(bytes(r.raw) == bytes(library.decode_bytes(r.ids)) for r in back)
    lost = byte_bpe.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS, PATTERN).collect()
    assert [r.decoded for r in lost] == [None, b""]
    assert byte_bpe.digest(docs.limit(0), RANKS, PATTERN).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.queries()["op13_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
