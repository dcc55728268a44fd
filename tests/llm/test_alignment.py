"""Operator 11 against the libraries on whole texts and offsets compared as sets."""

import hashlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import alignment, queries

SF = "/root/testdata/sf0.001"


def files():
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(P.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = files()
    t = Tokenizer.from_str(a)
    t.encode_special_tokens = True
    chars = {}
    k = 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255:
            chars[chr(x)] = x
        else:
            chars[chr(256 + k)] = x
            k += 1
    return t, sentencepiece.SentencePieceProcessor(model_proto=b), chars


def plain(libraries, text):
    """Groups of a text as [(ids of A, ids of B)], from the offsets at which both sides end; [] without tokens."""
    t, sp, chars = libraries
    if not text:
        return []
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    ab = [bytes(chars[c] for c in t.id_to_token(i)) for i in a]
    bb = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(ab) != (" " + text).encode() or b"".join(bb) != (" " + text).encode():
        return []

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    ea, eb = ends(ab), ends(bb)
    out, i, j = [], 0, 0
    for cut in sorted(set(ea) & set(eb)):
        i2, j2 = ea.index(cut, i) + 1, eb.index(cut, j) + 1
        out.append((a[i:i2], b[j:j2]))
        i, j = i2, j2
    return out


def expected(libraries, docs):
    groups = [(i, plain(libraries, t)) for i, t in docs]
    counts = Counter((x[-1], y[-1]) for _, g in groups for x, y in g)
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for i, g in groups:
        told = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
        links = [(x[-1], y[-1]) for x, y in g]
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return Counter(out)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_query_against_the_libraries(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.QUERIES["op11_suffix_transducer"](spark, SF).select(NAMES).collect()
    assert Counter(map(tuple, got)) == expected(libraries, docs)


AWKWARD = [
    "", None, " ", "\n", "a", "x\ny", "x \n y\n", "  two  spaces", "tail ", "tab\tand\r\nbreaks\x0b\x0c", " nb  sp", "naïve café 東京 🙂🙂 ‍", "▁ mark", "a▁b c",
    "<|endoftext|> plain </s> <s> <0x0A>", "it's we'll 123456 ...!!", "\x1c \x1d x\x85y", "é combining", "\x00 nul \x00", "don't\nstop\n\n\nnow", "ab" * 5000, " ".join(f"w{k}" for k in range(3000)),
]


@pytest.mark.parametrize("chunk", [1, 40, 1_000_000])
def test_awkward_and_empty_tables(spark, libraries, chunk):
    """White space of all kinds, texts one side can't keep, long ones, nulls, repeats and clashing columns; any chunks."""
    data = [(k % 9 if k % 5 else None, t) for k, t in enumerate(AWKWARD + AWKWARD[:8])]
    docs = spark.createDataFrame([(i, t, 1, "x", [1]) for i, t in data], "doc_id long, text string, chunk int, pair string, pairs array<int>").repartition(3)
    aligned = alignment.align_documents(docs, chunk_pairs=chunk)
    got = alignment.linked(aligned, alignment.link_counts(aligned)).select(NAMES).collect()
    assert Counter(map(tuple, got)) == expected(libraries, data)
    none = alignment.align_documents(docs.limit(0))
    assert alignment.linked(none, alignment.link_counts(none)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "word", "'s", " ", "  ", "\n", "\t", " ", "1", "é", "東", "!", "▁", "\x85", "the", "ing", "\r\n", "🙂", ".", ",", "'", "(", "x²", "d\u0301", "_", "n't"]), max_size=25).map("".join))
def test_cut_texts_align_as_whole_ones(text):
    if "it" not in _one:
        a, b = files()
        _one["it"] = alignment.Aligner(a, b), alignment.Aligner(a, b)
        assert _one["it"][0].cuts
        _one["it"][1].cuts = False
    cut, whole = _one["it"]
    assert cut.align(text) == whole.align(text)


_one: dict = {}


def test_transducer_states():
    """The side that leads changes; unequal bytes raise; a full memo is emptied without effect."""
    words = {1: b"ab", 2: b"c", 3: b"abc", 4: b"a", 5: b"bc", 6: b"x"}
    for most in (0, 100):
        m = alignment.Transducer(words.__getitem__, words.__getitem__, most)
        assert m.groups([1, 2, 4], [4, 5, 4]) == [([1, 2], [4, 5]), ([4], [4])]
        assert m.groups([3, 1, 2], [1, 2, 3]) == [([3], [1, 2]), ([1, 2], [3])]
        for a, b in (([1], [6]), ([1], [4]), ([4], [1]), ([], [4])):
            with pytest.raises(ValueError):
                m.groups(a, b)
        assert m.groups([], []) == []
