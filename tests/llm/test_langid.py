import random
import re
import unicodedata
import zlib

import numpy as np

from photoflow.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, keep=["doc_id", "lang"]).toPandas()
    assert len(got) == docs.count()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id] == list(got.held_out)
    own = got[got.held_out & got.lang.notna() & (got.lang_pred != "und")]
    assert len(own) > 100 and (own.lang == own.lang_pred).mean() >= 0.97
    assert got.score.between(0, 1).all()


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !!", "de"), (None, "the cat and the dog", "en"), (5, "der Hund und die Katze", "de"), (5, "der Hund und die Katze", "de"), (6, "İ" * 50, None), (7, "the dog " * 300_000, None)]
    rows += [(k, "the house and the tree", "en") for k in range(10, 20)] + [(k, "das Haus und der Baum", "de") for k in range(20, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "2 as held_out")
    got = {(r.doc_id, r.lang_pred) for r in langid.identify(docs).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en"), (5, "de"), (7, "en")} <= got
    assert langid.identify(docs).count() == len(rows)
    assert langid.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} <= {"und", ""}


def grams(text):
    """The set of 1-, 2- and 3-grams by the docstring."""
    low = [c if unicodedata.category(c)[0] in "LM" else " " if c.isspace() else "\x01" for c in text.lower() + " "]
    return {"".join(low[i : i + n]) for n in (1, 2, 3) for i in range(len(low) - n + 1)}


def test_scores_are_those_of_plain_kernel_ridge(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sample = langid.labelled_sample(docs)
    m = langid.fit(sample)
    marks = [grams(t) for t in langid.landmarks_of(sample)]
    held = set().union(*marks)
    assert len(held) == len(m.columns.grams)

    def kernel(texts, of):
        own = [grams(t) & held for t in texts]
        return np.array([[len(a & b) / np.sqrt(max(1, len(a)) * len(b)) for b in of] for a in own])

    mm = kernel(langid.landmarks_of(sample), marks)
    w, v = np.linalg.eigh(mm)
    root = v[:, w > 1e-6 * w.max()] / np.sqrt(w[w > 1e-6 * w.max()])
    phi = kernel(sample["text"], marks) @ root
    y = np.where(sample["lang"].to_numpy()[:, None] == np.array(m.langs)[None], 1.0, -1.0)
    dual = root @ np.linalg.solve(phi.T @ phi + langid.RIDGE * len(sample) * np.eye(phi.shape[1]), phi.T @ y)
    texts = [r.text for r in docs.collect() if r.text and re.search(r"[^\W\d_]", r.text)]
    want = kernel(texts, marks) @ dual
    got = np.concatenate([langid.decision(texts[s:e], m) for s, e in langid.batches_of(texts, len(held))])
    assert len(texts) > 100 and np.abs(got - want).max() < 2e-3
    by_id = {r.doc_id: r for r in langid.identify(docs).collect()}
    clear = {r.doc_id: m.langs[f.argmax()] for r, f in zip([r for r in docs.collect() if r.text in set(texts)], want, strict=True) if np.sort(f)[-1] - np.sort(f)[-2] > 0.01}
    assert len(clear) > 100 and all(by_id[i].lang_pred == lang for i, lang in clear.items())


SCRIPTS = {
    "en": (97, 26), "ru": (0x430, 32), "el": (0x3B1, 25), "he": (0x5D0, 27), "ar": (0x627, 36), "hi": (0x904, 60), "th": (0xE01, 58), "ko": (0xAC00, 2000), "ja": (0x3041, 86), "zh": (0x4E00, 6000), "hy": (0x561, 38), "ka": (0x10D0, 33)
}


def test_a_dozen_scripts(spark, monkeypatch):
    """Every script is told apart, though the rarer letters are far beyond any small alphabet; so are two languages of one script."""
    rng = random.Random(3)
    words = {lang: ["".join(chr(first + min(int(rng.paretovariate(0.7)) - 1, n - 1)) for _ in range(rng.randint(2, 7))) for _ in range(600)] for lang, (first, n) in SCRIPTS.items()}
    words |= {"xx": ["".join(rng.choice("bcdfgaou") for _ in range(5)) for _ in range(300)], "yy": ["".join(rng.choice("klmnprei") for _ in range(5)) for _ in range(300)]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(40)), lang) for i, lang in enumerate(lang for lang in sorted(words) for _ in range(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    def accuracy():
        got = langid.identify(docs, keep=["doc_id", "lang"]).where("held_out").toPandas()
        return (got.lang == got.lang_pred).groupby(got.lang).mean()

    assert len(accuracy()) == 14 and accuracy().min() >= 0.9
    monkeypatch.setattr(langid, "MAX_TEXTS", 70)
    monkeypatch.setattr(langid, "MAX_LANDMARKS", 20)
    monkeypatch.setattr(langid, "MAX_SAMPLE_CHARS", 14 * 900)
    sample = langid.labelled_sample(docs)
    assert sample.groupby("lang").size().between(1, 5).all() and sample.lang.nunique() == 14 and sample.text.str.len().sum() <= 14 * 900
    assert accuracy().mean() >= 0.9


def test_columns():
    rng = np.random.default_rng(2)
    held = np.unique(rng.integers(1, 1 << 62, 5000))
    cols = langid.Columns(held)
    assert (cols.of(held) == np.arange(len(held))).all() and len(cols.tables) > 1
    assert (cols.of(held + 1)[~np.isin(held + 1, held)] == -1).all()


def test_pieces_of_a_long_text(monkeypatch):
    text = "Der Hund und die Katze, 12 Häuser " * 5
    held = np.unique(np.concatenate([g for g, _ in langid.ngrams([text, "xunds"])]))
    cols = langid.Columns(held)
    whole = langid.presence([text, ""], cols)[:1]
    monkeypatch.setattr(langid, "BATCH_CHARS", 7)
    assert (langid.presence([text], cols) == whole).all() and whole.sum() == len(grams(text)) < len(held)
