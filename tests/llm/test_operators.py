"""The ten operators against brute force on small tables, and on awkward rows."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import TABLES, rows
from gridloom.llm import hnsw, hostrules, jaccard, lines, mixing, packing, queries, toxicity, urllist, warc, wavelet

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, size long, rank int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty, blank and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, ""), (4, " \t\n"), (5, long), (6, long), (None, "x y"), (None, None), (7, "A B c d E f")]
    return spark.createDataFrame([(i, t, None, None if i in (2, None) else "s", None, "x", 1, 2) for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toArrow(), con.sql(queries.ORACLE_SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows(got) == rows(want)


def encoded(texts, end):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4") for x in texts]


def test_op2_against_the_tokenizer(spark, docs):
    table = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want, at = [], 0
    for (i, _), ids in zip(table, encoded([t for _, t in table], 1)):
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op2_wavelet_shards"](spark, SF).collect())) == want


def test_op2_rank_select_access():
    ids = np.random.default_rng(1).integers(0, 50, 3000)
    m = wavelet.WaveletMatrix(wavelet.build(ids, [5], [0], 16))
    assert (m.decode() == ids).all() and all(m.access(i) == ids[i] for i in range(0, 3000, 37))
    for token in (0, 7, 49):
        where = np.nonzero(ids == token)[0]
        assert m.count(token) == len(where) and [m.select(token, k) for k in range(len(where))] == where.tolist()
        assert m.rank(token, 1234) == (where < 1234).sum()
    assert m.count(60) == 0 and m.count(70_000) == 0


def test_op4_cuts_are_whole_and_gapless(spark, docs):
    table = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    ids = dict(zip(table, encoded(table.values(), 2)))
    got = queries.QUERIES["op4_concat_and_cut"](spark, SF).collect()
    seq, at = {}, dict.fromkeys(ids, 0)
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        d = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(d)
        assert zlib.crc32(d[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] += r["length"]
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert at == {k: len(v) for k, v in ids.items()}
    for k, pieces in seq.items():
        total = 0
        for offset, n in sorted(pieces):
            assert offset == total
            total += n
        assert total == 4096 or k == max(seq)


def test_op3_figures(spark, docs):
    want = {}
    for r in docs.select("doc_id", "text").collect():
        t = r["text"] or ""
        w = WORDS(t)
        win = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = {x for x in win if win.count(x) > 1} if len(set(win)) < len(win) else set()
        hit = {i + k for i, x in enumerate(win) if x in often for k in range(8)}
        full = [x for x in t.split("\n") if WORDS(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want[r["doc_id"]] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(full) - len(set(full)), len(hit), failed)
    got = queries.QUERIES["op3_host_rules"](spark, SF).collect()
    assert {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in got} == want
    assert not any(r["kept"] and r["base_failed"] for r in got)


def test_op3_rejects_a_failing_host(spark):
    good = " ".join(f"word{k}" for k in range(40))
    data = [(i, good, "fine") for i in range(60)] + [(100 + i, "short", "bad") for i in range(55)] + [(200 + i, good, "bad") for i in range(5)]
    got = hostrules.host_rules(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] == (r["doc_id"] < 100) for r in got)


def test_op5_takes_its_targets(spark):
    """Targets by plain water-filling; taken words within the size of a typical document."""
    size, n = {}, {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect():
        n[r["doc_id"]] = len(WORDS(r["text"] or ""))
        size[r["source"]] = size.get(r["source"], 0) + n[r["doc_id"]]
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight, goal, full = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {}, set()
    while True:
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        goal = {s: 2 * size[s] if s in full else left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order}
        over = {s for s in order if goal[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source").collect()}
    taken = {}
    for r in queries.QUERIES["op5_entropy_balancing"](spark, SF).collect():
        s = source[r["doc_id"]]
        assert r["size"] == n[r["doc_id"]] and r["source_size"] == size[s] and abs(r["target"] - goal[s]) < 1e-6 * (1 + goal[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= max(0.01 * goal[s], 20) for s in size)


def test_op5_rates_solve_the_dual(spark):
    """Two sources, two groups: sources are met exactly, the group's multiplier against a plain root search."""
    s = {("a", 0): 1000.0, ("a", 1): 3000.0, ("b", 0): 4000.0, ("b", 1): 500.0}
    sums = spark.createDataFrame([(x, k, int(v)) for (x, k), v in s.items()], "source string, k int, s long")
    targets = spark.createDataFrame([("a", 4000, 4000.0), ("b", 4500, 3000.0)], "source string, source_size long, target double")
    goal, shares = {"a": 4000.0, "b": 3000.0}, [3700.0, 3300.0]
    got = {(r["source"], r["k"]): r["rate"] for r in mixing.entropy_rates(sums, targets, shares, cap=2.0, ridge=0.1).collect()}
    for x, g in goal.items():
        assert abs(sum(s[x, k] * got[x, k] for k in (0, 1)) - g) < 1e-6 * g
    # exponential tilting: the ratio of the two groups' rates is the same in both sources, and the dual's gradient is 0
    tilt = [np.log(got[x, 0] / got[x, 1]) for x in goal]
    assert abs(tilt[0] - tilt[1]) < 1e-6 and max(got.values()) < 2
    off = [shares[k] - sum(s[x, k] * got[x, k] for x in goal) for k in (0, 1)]
    assert abs(off[0] / (0.1 * shares[0]) - off[1] / (0.1 * shares[1]) - tilt[0]) < 1e-4


def test_op5_awkward_rows(spark, awkward):
    got = mixing.planned(awkward).collect()
    per = {}
    for r in got:
        per.setdefault((r["source_size"], r["target"]), []).append(r)
        assert 0 <= r["copies"] <= 2 and (r["size"] > 0 or r["doc_id"] in (None, 2, 3, 4))
    assert sorted(per) == [(2, 4.0), (120018, 180026.0)]


def test_op6_against_all_pairs(spark, docs):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = WORDS((r["text"] or "").translate(low))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = queries.QUERIES["op6_rtree_jaccard"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), find(i)) for i in ids}


def links_of(sets):
    """component of each index by all pairs of sets."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("cap", [7, 1000])
def test_op6_chained_copies_and_a_shared_passage(spark, cap):
    """A group of chained near copies and texts that share a passage, in chunks of any size."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(90)]
    shared = [f"s{i}" for i in range(40)]
    texts = []
    for k in range(60):  # each copy changes 0 to 8 words of the base: many pairs link only through others
        w = list(base)
        for i in rng.choice(90, rng.integers(0, 9), replace=False):
            w[i] = f"c{k}x{i}"
        texts.append(w)
    texts += [shared + [f"u{k}x{i}" for i in range(int(rng.integers(1, 60)))] for k in range(60)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = jaccard.components(docs, cap=cap, cap_shingles=2000).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(x), c) for (i, x), c in zip(enumerate(sets), links_of(sets))}


def test_keep_one_of_repeated_ids(spark):
    """Unlinked texts of one id stay, rows that repeat id and text become one, wordless and nameless rows stay."""
    near = [f"n{i}" for i in range(60)]
    data = [(1, " ".join(near)), (2, " ".join(near[:58] + ["x", "y"])), (2, None), (2, None), (4, "one text of its own"), (4, "and quite another one"),
            (5, "twice the same row here"), (5, "twice the same row here"), (None, "no id"), (None, "no id"), (6, "")]
    got = jaccard.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = [x for k, x in enumerate(data) if k not in (1, 7)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_op9_against_all_pairs(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    v = np.array([r["embedding"] for r in table], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r["label"] for r in table])
    hit = (v @ v.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r["n_links"] for r in queries.QUERIES["op9_hnsw_near_dedup"](spark, SF).collect()}
    want = {r["vec_id"]: int(n) for r, n in zip(table, hit.sum(axis=1))}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.9 * sum(want.values())


def test_op9_odd_vectors_link_with_nothing(spark):
    data = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (8, [1.0, 0.0], None)]
    got = hnsw.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1)} | {k: (0, k) for k in range(3, 9)}


def test_op1_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_toxicity_trees"](spark, sf).collect()}
    y = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    toxic = [got[i]["score"] for i, v in y.items() if v == 1 and i in got and got[i]["held_out"]]
    clean = [got[i]["score"] for i, v in y.items() if v == 0 and i in got and got[i]["held_out"]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in toxic for b in clean]) > 0.85


def test_op8_reads_what_it_wrote(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://c/\r\nd", None), (4, "http://d/", "é\r\n\r\nz")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.captures(spark, warc.write_archives(pages)).collect()}
    assert got == {1: (1500, "revisit", 2), 2: (1500, "response", None), 3: (0, "response", None), 4: (7, "response", None)}


def test_op8_repeats_nulls_and_a_large_page(spark):
    """Every row is a capture of its own; a 50 MB payload passes; an empty table gives none."""
    big, huge = "y" * 1200, "z" * 50_000_000
    data = [(1, "http://a/", big), (1, "http://b/", big), (1, "http://b/", big), (None, "u", "n"), (None, "u", "n"), (None, None, big), (3, "http://c/", big), (4, "h", huge)]
    schema = "page_id long, url string, html string"
    got = warc.captures(spark, warc.write_archives(spark.createDataFrame(data, schema).coalesce(1))).collect()
    want = [(1, 1200, "revisit", 3)] * 3 + [(None, 1, "response", None)] * 2 + [(None, 1200, "revisit", 3), (3, 1200, "response", None), (4, 50_000_000, "response", None)]
    assert sorted(map(str, [(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got])) == sorted(map(str, want))
    assert warc.captures(spark, warc.write_archives(spark.createDataFrame([], schema))).count() == 0


def test_op8_parses_any_chunks():
    """Records come whole however the bytes are cut."""
    blob = b"".join(b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"\r\n" * (n // 2)) for n in (0, 2, 10))
    for step in (1, 3, 7, 1000):
        got = list(warc.parse_archive(blob[i : i + step] for i in range(0, len(blob), step)))
        assert [len(b) for _, b in got] == [0, 2, 10]
    with pytest.raises(ValueError):
        list(warc.parse_archive([blob[:-8]]))


def test_op9_planted_clusters_within_and_across_shards(spark):
    """Small shards and blocks, so that clusters span them: links and components against all pairs."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1200, 24))
    near = [base[k] + 0.18 * rng.normal(size=24) for k in range(0, 300) for _ in range(int(rng.integers(1, 6)))]
    x = np.vstack([base, near, base[:50]]).astype(np.float32)
    label = np.concatenate([np.arange(1200) % 3, np.zeros(len(x) - 1200, int)])
    label[1200 : 1200 + len(near)] = rng.integers(0, 2, len(near))
    data = [(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label))]
    docs = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(6)
    got = {r["vec_id"]: r for r in hnsw.near_duplicates(docs, shard_size=256, block_size=64, group=3).collect()}
    u = hnsw._unit(x)
    hit = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(hit, False)
    n = hit.sum(axis=1)
    assert n.sum() > 600 and len(got) == len(x)
    assert all(got[i]["n_links"] <= n[i] for i in range(len(x)))
    assert sum(r["n_links"] for r in got.values()) >= 0.99 * n.sum()
    a, b = np.nonzero(hit)
    root = jaccard._roots(len(x), a, b)
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) >= 0.99
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_op9_empty_repeated_and_clashing(spark):
    schema = "vec_id long, embedding array<float>, label int, e string, id int, n long"
    assert hnsw.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    data = [(5, [1.0, 0.0], 1, "a", 1, 1)] * 3 + [(2, [0.0, 1.0], 1, "b", 2, 2), (None, [1.0, 0.0], 1, None, None, None)]
    got = sorted(map(str, map(tuple, hnsw.near_duplicates(spark.createDataFrame(data, schema)).collect())))
    assert got == sorted(map(str, [(5, 2, 5, True)] * 3 + [(2, 0, 2, True), (None, 0, None, True)]))


def test_op10_batches_meet_the_runs(spark):
    """Known lines go on counting, new ones are told apart; a line becomes frequent in its tenth document."""
    runs = lines.LineRuns(spark, 2)
    batch = lambda *keys: spark.createDataFrame([(k, -k) for k in keys], "h1 long, h2 long")
    assert sorted(map(tuple, runs.add(batch(1, 1, 2)).collect())) == [(1, -1, 2), (2, -2, 1)]
    assert [r["h1"] for r in runs.seen(batch(1, 2, 3)).collect()] == [3]
    assert sorted(map(tuple, runs.add(batch(1, 3)).collect())) == [(1, -1, 3), (3, -3, 1)]
    assert sorted(map(tuple, runs.add(batch(3, 3)).collect())) == [(3, -3, 3)]
    assert sorted(map(tuple, runs.all().collect())) == [(1, -1, 3), (2, -2, 1), (3, -3, 3)]


def test_clashing_names_stay(spark):
    d = spark.createDataFrame([(1, "a", 7, "x")], "doc_id long, text string, n_lines int, n_dropped string")
    assert lines.drop_repeated_lines(d).select("n_lines", "n_dropped", "__gridloom_n_lines").first() == (7, "x", 1)
    c = spark.createDataFrame([("http://a.b/", 1, "mine", 5)], "url string, fetched int, host string, entry int")
    e = spark.createDataFrame([], "key string, action string, at int")
    r = urllist.evaluate(c, e).first()
    assert (r["host"], r["entry"], r["__gridloom_host"], r["blocked"]) == ("mine", 5, "a.b", False)
    assert urllist.evaluate(c.limit(0), e).count() == 0


def test_op2_ids_beyond_the_planes_raise():
    with pytest.raises(ValueError):
        wavelet.build(np.array([70_000]), [1], [0], 16)


def test_op4_packs_awkward_and_empty_tables(spark, awkward, empty):
    got = packing.pack(packing.encode_documents(awkward)).collect()
    assert sum(r["start"] == 0 for r in got) == awkward.count() and all(r["length"] > 0 for r in got)
    assert packing.pack(packing.encode_documents(empty)).count() == 0


def test_op10_levels_keep_counts(spark):
    data = [(i, f"Shared line\nown {i}") for i in range(12)] + [(99, None), (None, " shared LINE ")]
    got = lines.drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string"), batches=5, fanout=2).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == {i: (f"own {i}", 2, 1) for i in range(12)} | {99: ("", 1, 0), None: ("", 1, 1)}


def test_op7_intervals(spark):
    e = spark.createDataFrame([("b.c", "add", 10), ("b.c", "remove", 20), ("c", "add", 30), (None, "add", 1), ("c", "odd", 1)], "key string, action string, at int")
    c = spark.createDataFrame([("http://a.b.c/x", t) for t in (9, 10, 19, 20, 30, None)] + [(None, 40)], "url string, fetched int")
    got = sorted(((r["fetched"] or 0), r["entry"]) for r in urllist.evaluate(c, e).collect())
    assert got == [(0, None), (9, None), (10, "b.c"), (19, "b.c"), (20, None), (30, "c"), (40, None)]


RUNS = {
    "wavelet": lambda s, d: wavelet.read_shards(s, wavelet.write_shards(d)),
    "rules": lambda s, d: hostrules.host_rules(d),
    "packing": lambda s, d: packing.encode_documents(d),
    "mixing": lambda s, d: mixing.planned(d),
    "jaccard": lambda s, d: jaccard.components(d),
    "lines": lambda s, d: lines.drop_repeated_lines(d),
    "toxicity": lambda s, d: toxicity.score(d, s.createDataFrame([], "doc_id long, toxic int")),
}


@pytest.mark.parametrize("name", RUNS)
def test_awkward_rows_all_stay(spark, awkward, name):
    assert RUNS[name](spark, awkward).count() == awkward.count()


@pytest.mark.parametrize("name", RUNS)
def test_empty_tables(spark, empty, name):
    assert RUNS[name](spark, empty).count() == 0


def test_near_duplicates_of_awkward_rows(spark, awkward):
    ids = [r["doc_id"] for r in jaccard.keep_one(awkward).select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5] and ids.count(None) == 2


def test_pipeline_stages_keep_clean_documents(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]
    kept = corpus_pipeline.toxicity_stage(spark, docs, SF)
    y = spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 0").select("doc_id")
    assert kept.columns == docs.columns
    assert kept.join(y, "doc_id", "left_semi").count() >= 0.97 * docs.join(y, "doc_id", "left_semi").count()
    assert corpus_pipeline.line_stage(spark, docs, SF).count() == docs.count()


def _cut_off(x, lone):
    """A graph over ``x`` whose links never lead to the rows ``lone``: what a poor graph does to a beam."""
    g = hnsw.Graph.fit(x)
    for layer in g.layers:
        layer[np.isin(layer, lone)] = -1
    g.members = [np.setdiff1d(m, lone).astype(np.int32) for m in g.members]
    return g


def test_op9_audit_sees_the_few_links_beside_a_hot_group():
    """Pairs that the beam can't reach, in a shard larger than the beam; the hot group's links outnumber them."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 32))
    hot = rng.normal(size=32) + 0.01 * rng.normal(size=(300, 32))
    x = hnsw._unit(np.vstack([base, base[:40] + 0.01 * rng.normal(size=(40, 32)), hot]))
    a, b, _ = hnsw.linked_pairs(_cut_off(x, np.arange(400, 440)), x, 0.93, 32, 64, 0.99, own=np.arange(len(x)))
    want = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    got = np.zeros_like(want)
    got[a, b] = a != b
    recall = ((got & want).sum(axis=1) / np.maximum(want.sum(axis=1), 1))[want.any(axis=1)]
    assert not (got & ~want).any() and recall.mean() >= 0.99 and recall[:40].mean() >= 0.99


def test_op9_audit_without_evidence_accepts_no_beam():
    """Three pairs between a block and a shard, none of them among 64 evenly spaced queries."""
    rng = np.random.default_rng(6)
    q = hnsw._unit(rng.normal(size=(400, 32)))
    x = hnsw._unit(np.vstack([rng.normal(size=(500, 32)), q[1:4] + 0.001 * rng.normal(size=(3, 32))]))
    a, b, _ = hnsw.linked_pairs(_cut_off(x, np.arange(500, 503)), q, 0.93, 32, 64, 0.99)
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 500), (2, 501), (3, 502)]


def test_op6_of_doubled_rows_and_of_ids_with_several_texts(spark):
    """Blocks {1, 5} and {1, 9} of rows that occur twice are two blocks, whichever holds the link."""
    words = lambda k, n: [f"w{k}x{i}" for i in range(n)]
    data = []
    for k in range(80):  # the second document is a near copy of the first, the third holds the first one's end
        one = words(k, 60)
        data += [(10 * k, one), (10 * k + 1, one[:56] + words(f"{k}b", 3)), (10 * k + 2, one[52:] + words(f"{k}c", 40))]
    single = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    several = single.union(single.select("doc_id", F.concat("text", F.lit(" and an end"))))
    parts = lambda t: {(r["doc_id"], r["component_id"]) for r in jaccard.components(t).collect()}
    want = {(i, i - 1 if i % 10 == 1 else i) for i, _ in data}
    assert len(want - parts(single.union(single))) == 0
    assert len(want - parts(several)) == 0


def test_pipeline_end_to_end(spark, docs):
    """Each stage, given what its predecessor kept, against plain Python."""
    import collections

    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    of = lambda df: {r["doc_id"]: r for r in df.collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\f\r").translate(low)

    kept = stages["toxicity"](spark, docs, SF).cache()
    bad = {r["doc_id"] for r in queries.QUERIES["op1_toxicity_trees"](spark, SF).collect() if r["predicted"]}
    assert set(of(kept)) == set(of(docs)) - bad

    lined = stages["line dedup"](spark, kept, SF).cache()
    texts = {i: (r["text"] or "").split("\n") for i, r in of(kept).items()}
    often = collections.Counter(k for t in texts.values() for k in {key(x) for x in t} if k)
    want = {i: "\n".join(x for x in t if not often[key(x)] >= 10) for i, t in texts.items()}
    assert {i: r["text"] for i, r in of(lined).items()} == want

    single = stages["n-gram Jaccard join"](spark, lined, SF).cache()
    ids = sorted(want)
    words = [WORDS(want[i].translate(low)) for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()) for w in words]
    assert set(of(single)) == {ids[k] for k, c in enumerate(links_of(sets)) if k == c}

    mixed = stages["mixing"](spark, single, SF).cache()
    times = collections.Counter(r["doc_id"] for r in mixed.collect())
    planned = {r["doc_id"]: r["copies"] for r in mixing.planned(single).collect()}
    assert dict(times) == {i: n for i, n in planned.items() if n} and max(planned.values()) <= 2
    assert mixed.columns == docs.columns

    pieces = stages["packing"](spark, mixed, SF).collect()
    length = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert dict(total) == {i: length[i] * n for i, n in times.items()}
    assert sum(total.values()) == sum(r["length"] for r in pieces) <= 4096 * (1 + max(r["sequence_id"] for r in pieces))
