import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from photoflow.llm import langid, lines
from photoflow.scratch import materialize
from tokenizers import Tokenizer

from .test_jaccard import brute as components
from .test_mixing import levels


def dedup(rows, min_sites):
    """rows (id, text, site) -> {id: text} by the rules of drop_boilerplate; ids are distinct."""
    sites, first = defaultdict(set), {}
    for i, t, s in sorted(rows):
        for pos, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                sites[line.strip(" ")].add(s)
                first.setdefault(line.strip(" "), (i, pos))
    out = {}
    for i, t, _ in rows:
        cut = (t or "").split("\n")
        keep = [x for pos, x in enumerate(cut) if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites or first[x.strip(" ")] == (i, pos)]
        out[i] = None if t is None else "\n".join(keep)
    return out


def test_lines(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(docs, min_sites=4).collect()}
    assert got == dedup([(r.doc_id, r.text, r.source) for r in docs.collect()], 4)
    odd = spark.createDataFrame([(1, "a\nb" + "x" * 50, "s1"), (2, "a \n" + "y" * 60, None), (3, None, "s2"), (4, "", "s3"), (5, "a\n" + "z" * 70, "s2"), (5, "a\n" + "z" * 70, "s2"), (None, "a\n" + "w" * 80, "s4")], "doc_id long, text string, source string").selectExpr("*", "1 as h", "2 as id")
    got = sorted(((r.doc_id, r.text) for r in lines.drop_boilerplate(odd, min_sites=3).collect()), key=str)
    assert got == sorted([(1, "a\nb" + "x" * 50), (2, "y" * 60), (3, None), (4, ""), (5, "z" * 70), (5, "z" * 70), (None, "w" * 80)], key=str)
    assert lines.drop_boilerplate(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "3 as n_lines", "4 as n_dropped", "5 as _drop", "6 as _id", "7 as pos", "8 as gone", "9 as th", "10 as doc", "11 as own_id", "12 as cut")
    out = lines.drop_boilerplate(clash, min_sites=3)
    assert sorted(out.columns) == sorted(clash.columns)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == got
    assert {(r["_drop"], r["gone"], r["doc"], r["th"], r["h"]) for r in out.collect()} == {(5, 8, 10, 9, 1)}
    assert {(r.doc_id, r.n_lines, r.n_dropped) for r in out.collect()} == {(1, 2, 0), (2, 2, 1), (3, 0, 0), (4, 0, 0), (5, 2, 1), (None, 2, 1)}
    only = spark.createDataFrame([(i, "same line", f"s{i}") for i in range(5)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in lines.drop_boilerplate(only, min_sites=3).collect()) == [(0, "same line"), (1, ""), (2, ""), (3, ""), (4, "")]


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = materialize(stage(spark, docs, ""), "test-stage")
        assert docs.columns == columns, name
        after = docs.collect()
        if name == "language ID":
            model = langid.fit(langid.labelled_sample(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))
            own = [r for r in before if r.text and re.search(r"[^\W\d_]", r.text)]
            score = [langid.predict([r.text], model)[1][0] for r in own]
            assert {r.doc_id for r in after} == {r.doc_id for r, x in zip(own, score, strict=True) if x >= corpus_pipeline.MIN_SCORE}
        if name == "line dedup":
            want = dedup([(r.doc_id, r.text, r.source) for r in before], lines.MIN_SITES)
            assert {r.doc_id: r.text for r in after} == {i: t for i, t in want.items() if t and t.strip()}
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "n-gram Jaccard join":
            kept = {d for d, _, c in components([(r.doc_id, r.text) for r in before], 5, 80) if d == c}
            assert {r.doc_id for r in after} == kept
        if name == "mixing sources":
            assert {r.doc_id for r in after} <= {r.doc_id for r in before}
            size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text)) for r in before}
            words, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
            for r in before:
                words[r.source] += size[r.doc_id]
                most[r.source] = max(most[r.source], size[r.doc_id])
            for r in after:
                taken[r.source] += size[r.doc_id]
            assert all(abs(taken[x] - t) <= most[x] / 2 + 1 for x, t in levels(words).items())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.collect()}
    fill = defaultdict(int)
    for r in pieces:
        fill[r.sequence_id] += r.length
    assert all(v == 4096 or v & (v - 1) == 0 for v in fill.values())

    fixed = {r.doc_id: r.text for r in docs.collect()}
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in pieces:
        ids = [*tok.encode(fixed[r.doc_id], add_special_tokens=False).ids, 2]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_run_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, one more column."""
    prose = "the house and the tree by the river were old and the people of the town knew every stone of it well"
    rows = [(i, f"{prose} number {i} of {i * 7}", "en", f"s{i % 3}", 1) for i in range(40)]
    rows += [(None, prose, None, None, 2), (1, None, "en", "s1", 1), (2, "", None, None, None), (3, "123 456", "en", "s1", 1), (4, "word " * 60_000, "en", "s2", 1), (5, rows[5][1], "en", "s1", 1), (5, rows[5][1], "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, rows[:1], []):
        at = str(tmp_path / f"n{len(data)}")
        spark.createDataFrame(data, schema).write.parquet(f"{at}/documents.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        assert all(0 < r.length <= 4096 for r in out) and bool(out) == bool(data)
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as _row", "2 as sig", "3 as component_id", "4 as n_lines", "5 as gone", "6 as slot", "7 as score")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), "odd")
        assert docs.columns == [*schema.replace(" long", "").replace(" string", "").split(", "), "_row", "sig", "component_id", "n_lines", "gone", "slot", "score"], name
    assert docs.where("sig = 2 and slot = 6 and score = 7 and gone = 5").count() == docs.count() > 0


def kept_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(map(tuple, out.collect()), key=str)


def test_near_duplicates_of_five_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {d for d, _, c in components(rows, 5, 80) if d == c}
    assert kept < {d for d, _, c in components(rows, 4, 85) if d == c}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(got) == sorted(kept)


def test_near_duplicates_by_row(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one, "s"), (2, one, "s"), (2, two, "s"), (3, three, "s"), (3, three, "s"), (None, three, "s"), (None, "some other words", "s"), (4, "", "s"), (4, "", "s"), (4, None, "s")]
    want = [(1, one, "s"), (2, two, "s"), (3, three, "s"), (None, "some other words", "s"), (4, "", "s"), (4, "", "s"), (4, None, "s")]
    assert kept_of(spark, rows) == sorted(want, key=str)
    assert kept_of(spark, []) == []


def test_stage_drops_every_later_place(spark):
    shared = "a line on many sites"
    rows = [(i, f"{shared}\n{'own' * 20} {i}", f"s{i}") for i in range(8)]
    rows += [(20, f"{shared}\nx", "s1"), (21, shared, "s2"), (22, f"{shared}\n{shared}\n", "s3"), (23, "", "s4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "length(text) as n_chars")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    want = {0: rows[0][1], **{i: f"{'own' * 20} {i}" for i in range(1, 8)}, 20: "x", 23: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}
