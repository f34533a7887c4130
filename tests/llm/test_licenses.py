import re

from photoflow.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute(text):
    w = WORD.findall(lower(text or ""))
    hits = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert {"mit", "apache-2", "cc-by-nc", "gpl-3", "all-rights-reserved"} <= {x for r in got for x in r.labels.split(",")}
    clean = [r for r in got if not re.search("licen|rights|cc by", texts[r.doc_id] or "", re.I)]
    assert clean and not any(r.labels for r in clean)


def test_edges_and_edits(spark):
    rows = [(1, None), (2, ""), (3, "Under the MIT License, under the MIT license"), (4, "Relesed undr the MIT License"), (5, "all right reserved"), (None, "CC-BY-NC"), (7, "x " * 200_000 + "GNU General Publik License, version 3"),
            (8, "under the mit licenses"), (9, "é CC BY NC é"), (9, "é CC BY NC é"), (10, "gnu generous republic library virgin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as labels", "2 as id2")
    got = licenses.scan(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    texts = dict(rows)
    for i, r in by.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[i]), i
    assert by[3].n_base == 2 and (by[3].first_word, by[3].last_word) == (0, 4)
    assert by[4].labels == "mit" and by[4].base_labels == "" and by[4].spans[0].edits == 2 and by[4].spans[0].first_word == 0
    assert by[5].labels == "all-rights-reserved" and by[7].labels == "gpl-3" and by[7].spans[0].first_word == 200_000
    assert by[1].score == 0 and by[10].labels == ""
    for r in got:
        for s in r.spans:
            assert min(distance(s.text.strip(), n) for label, n, _ in licenses.NOTICES if label == s.label) <= 5
    assert licenses.scan(docs.limit(0)).count() == 0


def test_every_edit_is_found():
    scanner = licenses.Scanner(licenses.NOTICES, licenses.PHRASES)
    for label, notice, k in licenses.NOTICES:
        for place in range(1, len(notice) - 1, 3):
            changed = list(notice)
            for j in range(k):
                changed[1 + (place + j * 5) % (len(notice) - 2)] = "#"
            _, spans = scanner.scan(f" some words {''.join(changed)} more words ")
            assert label in {s[2] for s in spans}, (notice, "".join(changed))


def test_word_numbers_of_a_text_full_of_notices(spark):
    text = "All rights reserved. é under the MIT License, CC-BY-NC; " * 20_000
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text)
    words = WORD.findall(lower(text))
    assert len(r.spans) >= 20_000
    for s in r.spans[::97]:
        assert WORD.findall(s.text) == words[s.first_word : s.last_word + 1]
