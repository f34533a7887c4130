"""The prefix trie against a plain dictionary of prefixes, and its parts."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from photoflow.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, pos string, total int"


def plain(rows: list[tuple]) -> set[tuple]:
    """Nodes of (conv_id, turn, role, text) rows, by a dictionary from every prefix to its members."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    members = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        path = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append((c, len(path)))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    sha = lambda p: hashlib.sha256(",".join(str(c) for c, n in sorted(members[p]) if n == len(p)).encode()).hexdigest()
    return {(low[p], len(p), low[p[:-1]] if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items()}


def found(spark, rows: list[tuple], **options) -> set[tuple]:
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    out = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.ordered_turns(table)), **options)
    assert out.columns == prefix_trie.NODE
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def made(seed: int, convs: int, words: int, turns: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(3 * convs), convs):
        for i in range(rng.randint(1, turns)):
            rows.append((c, rng.choice([i, i, i, None, 3]), rng.choice(["user", "user", None]), rng.choice([*(f"text {k}é" for k in range(words)), None, ""])))
    return rows


@pytest.mark.parametrize("seed,convs,words,turns", [(1, 150, 2, 6), (2, 200, 40, 12)])
def test_nodes(spark, seed, convs, words, turns):
    rows = made(seed, convs, words, turns)
    rows += rows[:20]  # repeated rows
    assert found(spark, rows) == plain(rows)


def test_a_sketch_far_too_small_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LEAST_BITS", 4)
    rows = made(3, 120, 3, 7)
    assert found(spark, rows, most_bits=4) == plain(rows)


def test_one_long_conversation_and_many_equal_ones(spark):
    rows = [(7, i, "user", f"turn {i % 50}") for i in range(700)]
    rows += [(c, i, "user", f"same {i}") for c in range(100, 400) for i in range(12)]
    rows += [(c, 1, "user", "only") for c in range(1000, 1100)]
    assert found(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (-7, 1, "user", "a"), (-5, 1, "user", "a"), (-5, None, None, None), (4, 5, "b", "x"), (4, 5, "a", "y"), (4, 5, "a", "x"), (4, 5, None, "é" * 300_000), (3, 1, "", "")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == set()
    assert found(spark, [(None, 1, "user", "lost")]) == set()
    # every conversation turnless: the root is the only node
    alone = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1)
    assert found(spark, [(alone, 0, "user", "gone")]) == plain([(alone, 0, "user", "gone")])


def test_sketch_never_counts_too_few(spark):
    keys = spark.range(3000).selectExpr("xxhash64(id % 2000, 1) AS k1", "xxhash64(id % 2000, 2) AS k2")
    rows = keys.selectExpr("k1", "k2", "k1 AS p1", "k2 AS p2")
    ones, bits = prefix_trie.sketch(keys, 3000)
    seen = prefix_trie.screened(rows, ones, bits).groupBy("k1").agg({"alone": "max", "*": "count"}).collect()
    assert not any(r["max(alone)"] for r in seen if r["count(1)"] > 1)
    single = [r["max(alone)"] for r in seen if r["count(1)"] == 1]
    assert sum(single) > 0.95 * len(single) == 950


def test_chunks_of_a_long_list(spark):
    ends = spark.range(1000).selectExpr("id % 3 AS k1", "0L AS k2", "(id * 7919) % 1000 - 500 AS conv_id")
    want = {k: hashlib.sha256(",".join(map(str, sorted((i * 7919) % 1000 - 500 for i in range(1000) if i % 3 == k))).encode()).hexdigest() for k in range(3)}
    assert {r.k1: r.ends_sha256 for r in prefix_trie.lists_sha256(ends, chunk=7).collect()} == want


def test_query_and_sql(spark):
    got = {tuple(r) for r in queries.queries()["op12_prefix_trie"](spark, "/root/testdata/sf0.001").collect()}
    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    assert got == set(con.sql(queries.oracle_sql()["op12_prefix_trie"]).fetchall())
