"""Operator 12 against SQL and a plain trie."""

import hashlib
import zlib

import duckdb
import pytest

from compare import TABLES, rows
from gridloom.llm import queries, trie

SF = "/root/testdata/sf0.01"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, part int, n1 string, i long"


def test_matches_sql(spark):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES["op12_prefix_trie"](spark, SF).toArrow(), con.sql(queries.ORACLE_SQL["op12_prefix_trie"]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def plain(data, key=lambda t: (t[0] is not None, t[0] or 0)):
    """The contract by nested prefixes; ``data`` is (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    members = {}
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def sums(p):
        below = [sums(k) for k in kids.get(p, [])]
        mine = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        return (sum(b[0] for b in below) or 1, mine + sum(b[1] for b in below))

    out = set()
    for p, m in members.items():
        leaves, saved = sums(p)
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out, len(members), {(min(m), len(p)): p[-1] if p else (None, None) for p, m in members.items()}


@pytest.fixture(scope="module")
def data():
    """Shared first turns, whole copies, short conversations that end without turns, nulls, a long one, ids with and without donor."""
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(250, 270), 7_000_001]:
        for t in range(c % 4 + (c % 7 == 0)):
            out.append((c, t, "user" if t % 2 == 0 else None, None if (c + t) % 9 == 0 else f"text {t * (c % 3)} ü"))
    out += [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]
    out += [(5000, t, "r", f"line {t % 5}") for t in range(700)]
    out += [(5001, t, "r", f"line {t % 5}") for t in range(600)]
    out += [(6000, None, "a", "first"), (6000, -3, "a", "second"), (6001, 1, None, None)]
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_plain_trie(spark, data, partitions):
    """Conversations that span partitions, merges of two tables at a time, and text of the last turns."""
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        table = spark.createDataFrame([(*r, 1, "x", 2) for r in data + [(None, 1, "r", "t")]], SCHEMA)
        nodes = trie.prefix_trie(table, fan=2)
        got = nodes.select(NAMES).collect()
        want, n, turns = plain(data)
        assert len(got) == n and set(map(tuple, got)) == want
        if partitions == 7:
            told = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in trie.node_turns(nodes, table).collect()}
            assert told == turns
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_ties_and_repeated_rows(spark):
    """Rows of one turn are all there, in an order that input order doesn't change; an empty table has no node."""
    data = [(1, 0, "a", "x"), (1, 0, "b", "y"), (1, 0, "a", "x"), (2, 0, "b", "y"), (2, 0, "a", "x"), (2, 0, "a", "x")]
    make = lambda d: spark.createDataFrame([(*r, 1, "x", 2) for r in d], SCHEMA)
    a, b = (sorted(map(tuple, trie.prefix_trie(make(d)).select(NAMES).collect())) for d in (data, data[::-1]))
    assert a == b and max(r[1] for r in a) <= 3
    assert trie.prefix_trie(make([])).count() == 0


def test_runs_of_end_lists(spark):
    """A node's list is hashed over several runs as over the whole."""
    ends = spark.createDataFrame([(1, 1, c) for c in range(95)] + [(1, 2, 5), (0, 0, 12)], "n1 long, n2 long, conv_id long").repartition(5)
    got = {(r["n1"], r["n2"]): r["ends_sha256"] for r in trie._end_lists(ends, step=10).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {(1, 1): sha(range(95)), (1, 2): sha([5]), (0, 0): sha([12])}
