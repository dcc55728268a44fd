"""Operator 11: alignment of two tokenizers by a dangling-suffix transducer.

The transducer's state is which side leads and the bytes by which it leads (the
residual).  A token of the other side shortens the residual, closes the group by
emptying it, or makes the other side lead by what is left of the token.  States
and tokens are numbers and transitions are memoised by (state, token); so are
whole runs between two empty residuals, by the stretch of text they cover, where
both tokenizers are known to cut (:class:`Aligner`).

Links are counted corpus-wide without shuffling one row per link: documents are
written in chunks, a chunk's distinct pairs are summed by id pair, and the totals
of a chunk's pairs come back to that chunk.
"""

from __future__ import annotations

import hashlib
import re
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship

#: A pair of ids in one number.
SHIFT = 32


def byte_level_table() -> dict[str, int]:
    """Characters of byte-level vocabularies: printable bytes stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Walks the tokens of side A and side B of the same bytes and closes a group wherever both end.

    ``a`` and ``b`` give the bytes of an id.  A state is a number of (side, residual);
    memo[state][token] is the next state, 0 being the empty residual.  ``most`` bounds
    the memo: a full one is emptied, which changes no result.
    """

    def __init__(self, a, b, most: int = 500_000):
        self.bytes, self.most = (a, b), most
        self.clear()

    def clear(self):
        self.states: list[tuple[int, bytes]] = [(0, b"")]
        self.known: dict[tuple[int, bytes], int] = {(0, b""): 0}
        self.memo: list[dict[int, int]] = [{}]
        self.a_leads = [False]
        self.size = 0

    def step(self, state: int, token: int) -> int:
        """The state after ``token``, which is of side A in the empty state, else of the side that lags."""
        side, residual = self.states[state]
        if state == 0:
            new = (0, self.bytes[0](token))
        else:
            piece = self.bytes[1 - side](token)
            if residual.startswith(piece):
                new = (side, residual[len(piece) :])
            elif piece.startswith(residual):
                new = (1 - side, piece[len(residual) :])
            else:
                raise ValueError("the sides differ in their bytes")
        if not new[1]:
            new = (0, b"")
        at = self.known.setdefault(new, len(self.states))
        if at == len(self.states):
            self.states.append(new)
            self.memo.append({})
            self.a_leads.append(new[0] == 0)
        self.memo[state][token] = at
        self.size += 1
        return at

    def ends(self, a: list[int], b: list[int]) -> list[tuple[int, int]]:
        """(tokens of A, tokens of B) up to the end of every group; sides of unequal bytes raise ValueError."""
        if self.size > self.most:
            self.clear()
        out, i, j = [], 0, 0
        memo, a_leads, step = self.memo, self.a_leads, self.step
        try:
            while i < len(a):
                token, state, i = a[i], 0, i + 1
                while True:
                    after = memo[state].get(token)
                    state = step(state, token) if after is None else after
                    if state == 0:
                        break
                    if a_leads[state]:
                        token, j = b[j], j + 1
                    else:
                        token, i = a[i], i + 1
                out.append((i, j))
        except IndexError:
            raise ValueError("one side ends first") from None
        if j < len(b):
            raise ValueError("one side ends first")
        return out

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]]:
        """[(ids of A, ids of B)] of every group."""
        ends = self.ends(a, b)
        return [(a[i:k], b[j:m]) for (i, j), (k, m) in zip([(0, 0), *ends], ends)]


class Aligner:
    """text -> tokens, groups and links of a document.

    Side A is a byte-level BPE file of the tokenizers library, side B a
    sentencepiece model; both read space + text.  Where the files allow it (A
    has no normalizer and the usual byte-level pattern; no piece of B holds a
    space after another character, a line feed, or punctuation after a letter),
    text is cut before a single space or line feed between two other characters and
    between a word's letters and punctuation: neither tokenizer has a token across,
    so a stretch's run is looked up.  Other files are encoded as wholes.  ``most``
    bounds the table of runs (some 400 bytes each).
    """

    #: Letters and punctuation that both tokenizers surely take for such.
    LETTERS, PUNCTUATION = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"

    #: The stretches that a cut may separate; white space of any other kind is never cut at.
    CUT = re.compile(rf"[ \n][{LETTERS}]+(?=[{PUNCTUATION}])|[{PUNCTUATION}][^ \n]*|[ \n][^ \n]*")

    def __init__(self, a_content: str, b_content: bytes, most: int = 400_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_content)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_content)
        table = byte_level_table()
        self.a_bytes = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.a.get_vocab(True).items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.machine = Transducer(self.a_bytes.__getitem__, self.b_bytes.__getitem__)
        rules = json.loads(a_content)
        level = rules.get("pre_tokenizer") or {}
        plain = rules.get("normalizer") is None and level.get("type") == "ByteLevel" and level.get("use_regex", True) and not level.get("add_prefix_space")
        across = re.compile(f"[^▁]▁|\n|[{self.LETTERS}][{self.PUNCTUATION}]")
        usual = not any(across.search(p) for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        self.cuts = plain and usual and self._feeds()
        self.most, self.runs = most, {}

    def _feeds(self) -> bool:
        """Whether B keeps spaces, puts one in front, and makes a line feed a token of its own."""
        spaces, feed = self.b.encode("  x "), self.b.encode("\nx")
        whole = b"".join(self.b_bytes[i] for i in spaces) == b"   x "
        return whole and len(feed) == 3 and [self.b_bytes[i] for i in feed[:2]] == [b" ", b"\n"]

    def runs_of(self, parts: list[str]) -> list:
        """(number of ids of A, of B, of groups, groups as text, links) of every stretch; None where a side's bytes aren't its own."""
        # B puts a space in front: stretches without one follow a line feed, which is a token of its own
        lead = [0 if p[0] == " " else 1 if p[0] == "\n" else 2 for p in parts]
        a = [e.ids for e in self.a.encode_batch_fast(parts, add_special_tokens=False)]
        b = self.b.encode([p[1:] if k == 0 else p if k == 1 else "\n" + p for p, k in zip(parts, lead)], num_threads=1)
        out, a_bytes, b_bytes = [], self.a_bytes, self.b_bytes
        for p, k, x, y in zip(parts, lead, a, b):
            y, want = y[k:] if k else y, p.encode("utf-8", "surrogatepass")
            if b"".join([a_bytes[i] for i in x]) != want or b"".join([b_bytes[i] for i in y]) != want:
                out.append(None)
                continue
            told, links, i, j, sx, sy = [], [], 0, 0, list(map(str, x)), list(map(str, y))
            for m, n in self.machine.ends(x, y):
                told.append(f"{','.join(sx[i:m])}|{','.join(sy[j:n])}")
                links.append(x[m - 1] << SHIFT | y[n - 1])
                i, j = m, n
            out.append((len(x), len(y), len(told), ";".join(told), struct.pack(f"<{len(links)}q", *links)))
        return out

    def stretches(self, s: str) -> list[str]:
        """``s`` cut where neither tokenizer can have a token across; it begins with a space."""
        out: list[str] = []
        whole = False  # whether the last stretch may end here
        for piece in self.CUT.findall(s):
            starts = piece[0] not in " \n" or len(piece) > 1 and not piece[1].isspace()
            if out and not (whole and starts):
                out[-1] += piece
            else:
                out.append(piece)
            whole = not out[-1][-1].isspace()
        return out

    def align(self, text: str | None):
        """(n_a, n_b, n_groups, digest, links) of a text, links as little-endian 64-bit pairs; zeros without tokens."""
        none = (0, 0, 0, "", b"")
        if not text:
            return none
        s, runs = " " + text, self.runs
        pieces = self.stretches(s) if self.cuts else [s]
        new = [p for p in dict.fromkeys(pieces) if p not in runs]
        here = dict(zip(new, self.runs_of(new)))
        if None in here.values():
            pieces = [s]
            here = {s: self.runs_of([s])[0]}
        elif len(runs) + len(new) > self.most:
            here |= {p: runs[p] for p in pieces if p in runs}
            runs.clear()
        parts = [here.get(p) or runs.get(p) for p in pieces]
        if None not in parts:
            runs.update((p, r) for p, r in here.items() if len(p) <= 64)
        if parts[0] is None:
            return none
        a, b, groups, told, links = zip(*parts)
        return sum(a), sum(b), sum(groups), hashlib.sha256(";".join(told).encode()).hexdigest(), b"".join(links)


_aligners: dict[tuple, Aligner] = {}


def aligner(a_content: str, b_content: bytes) -> Aligner:
    """One per Python worker and pair of files."""
    key = (hash(a_content), hash(b_content))
    if key not in _aligners:
        _aligners[key] = Aligner(a_content, b_content)
    return _aligners[key]


ALIGNED = "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, counts array<long>"


def align_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None, chunk_pairs: int = 1_000_000
) -> DataFrame:
    """One row per document with its distinct linked id pairs and how often each is linked, written in chunks.

    A chunk is closed at ``chunk_pairs`` pairs (a longer document is one of its own)
    and summed up in a row without groups_sha256.  Texts that are null, empty or not
    kept by both tokenizers have no tokens; null and repeated ids stay, one row each.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    ship(spark)
    if not (a_path and b_path):
        import public_tokenizers

        a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))

    def rows(batches):
        import numpy as np
        from pyspark import TaskContext

        enc, part = aligner(*files.value), TaskContext.get().partitionId()
        kinds = (pa.int64(),) * 5 + (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        number, got, held = part << 32, [], 0

        def lists(arrays, kind):
            at = np.cumsum([0] + [len(x) for x in arrays])
            flat = np.concatenate(arrays) if arrays else np.array([], np.int64)
            return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, kind.value_type))

        def close():
            pairs, inverse = np.unique(np.concatenate([r[5] for r in got]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([r[6] for r in got]), len(pairs)).astype(np.int64)
            chunk = [(None, 0, 0, 0, None, pairs, sums)]
            for some in (got, chunk):
                ids, a, b, n, told, p, c = zip(*some)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(some), pa.int64()), *(pa.array(v, pa.int64()) for v in (ids, a, b, n)), pa.array(told, pa.string()), lists(p, kinds[6]), lists(c, kinds[7])],
                    names=[c.split()[0] for c in ALIGNED.split(", ")],
                )

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                a, b, n, told, links = enc.align(text.as_py())
                pairs, counts = np.unique(np.frombuffer(links, "<i8"), return_counts=True)
                got.append((doc_id.as_py(), a, b, n, told, pairs, counts))
                held += len(pairs) + 8
                if held > chunk_pairs:
                    yield from close()
                    number, got, held = number + 1, [], 0
        if got:
            yield from close()

    return materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, ALIGNED))


def link_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, count, best) of every id pair: its links in the corpus, and whether no pair of its b has more."""
    c = aligned.filter("groups_sha256 is null").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    c = c.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("count"))
    c = materialise(c.select("pair", F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND(F.lit(2**SHIFT - 1)).alias("b"), "count"))
    top = c.groupBy("b").agg(F.max("count").alias("top"))
    return c.join(top, "b").select("pair", "a", "b", "count", (F.col("count") == F.col("top")).alias("best"))


def linked(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """The documents of ``aligned`` with n_links, n_best and count_sum.

    Every chunk meets the totals of its own distinct pairs: a lookup is as large as
    a chunk, whatever the corpus, and nothing is broadcast.
    """
    import pyarrow as pa

    here = aligned.filter("groups_sha256 is null").select("chunk", F.explode("pairs").alias("pair"))
    totals = here.join(counts, "pair").select(F.col("chunk").alias("of"), "pair", "count", "best")
    docs = aligned.filter("groups_sha256 is not null")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def meet(_, docs, totals):
        import numpy as np

        pair = totals.column("pair").to_numpy()
        order = np.argsort(pair)
        pair = pair[order]
        count, best = (totals.column(c).to_numpy(zero_copy_only=False)[order].astype(np.int64) for c in ("count", "best"))
        p, n = (docs.column(c).combine_chunks() for c in ("pairs", "counts"))
        sizes = np.diff(p.offsets.to_numpy())
        flat, n = p.flatten().to_numpy(), n.flatten().to_numpy()
        at = np.searchsorted(pair, flat)
        where = np.concatenate([[0], np.cumsum(sizes)])

        def total(v):
            s = np.concatenate([[0], np.cumsum(v)])
            return pa.array(s[where[1:]] - s[where[:-1]], pa.int64())

        sums = [total(n), total(n * best[at]), total(n * count[at])]
        told = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")]
        return pa.table([*told, *sums, docs.column("groups_sha256")], names=[c.split()[0] for c in out.split(", ")])

    return docs.groupBy("chunk").cogroup(totals.groupBy("of")).applyInArrow(meet, out)


def op11_suffix_transducer(spark, sf_dir: str) -> DataFrame:
    aligned = align_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return linked(aligned, link_counts(aligned))
