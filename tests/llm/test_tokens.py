import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from photoflow.llm import encoding, packing, token_files
from photoflow.llm.encoding import Encoder

ODD = ["", "  two  spaces ", "tab\tand\n\nlines \n x", "it's 'quoted' they'll don''t", "ÀÉ naïve İstanbul ΣΑΣ é", "12345 3.14 <|endoftext|>", " nbsp em", "a" * 5000, " lead", "trail ", "日本 語 text", "x\r\ny", " ", "\n", "it'S 'RE 'sing", "\x1c sep \x1f"]


def plain(name, texts, as_text=False):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    if as_text:
        t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(spark, name):
    texts = ODD + [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(public_tokenizers.path(name)).encode(texts)]
    for t, a, b in zip(texts, got, plain(name, texts), strict=True):
        assert a == b, t[:80]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_strings_of_special_tokens(name, monkeypatch):
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "x<|startoftext|>y <|ENDOFTEXT|>", "日本 <|endoftext|>  é", "plain words", "plain words again"]
    for as_text in (False, True):
        got = [np.frombuffer(x, "<u2").tolist() for x in Encoder(public_tokenizers.path(name), as_text).encode(texts)]
        assert got == plain(name, texts, as_text)
    monkeypatch.setattr(encoding, "MAX_WORDS", 4)
    monkeypatch.setattr(encoding, "MAX_LETTERS", 3)
    small = Encoder(public_tokenizers.path(name))
    for t in [*texts, *texts, "one two three four five six seven plain"]:
        assert np.frombuffer(small.encode([t])[0], "<u2").tolist() == plain(name, [t])[0]
    assert len(small.words) <= 8


def rows(spark):
    data = [(k, t, "x") for k, t in enumerate(ODD)] + [(None, "no id", "x"), (99, None, "y"), (3, "repeated id", "z"), (3, "repeated id", "z"), (200, "word " * 9000, "w")]
    return spark.createDataFrame(data, "doc_id long, text string, start string")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_round_trip(spark):
    docs = rows(spark)
    got = sorted(map(tuple, token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()), key=lambda r: (r[1]))
    inp = sorted([(r.doc_id, r.text or "") for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at, want = 0, []
    for (i, _), ids in zip(inp, plain("byte_bpe_50k.json", [t for _, t in inp]), strict=True):
        ids = [*ids, 2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert token_files.round_trip(docs.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_packing(spark):
    docs = rows(spark)
    got = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    for i, ts in texts.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: (r.sequence_id, r.offset))
        ids = sorted(tuple([*x, 2]) for x in plain("word_bpe_49k.json", ts))
        if len(ts) == 1:
            assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == list(ids[0])
            at = 0
            for r in own:
                assert r.start == at and r.doc_tokens == len(ids[0]) and r.ids_crc32 == crc(ids[0][at : at + r.length])
                at += r.length
        assert sum(r.length for r in own) == sum(map(len, ids))
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert all(v == 4096 or v & (v - 1) == 0 for v in fill.values())
    assert packing.pack(docs.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_hilbert_keys_are_a_curve():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()
