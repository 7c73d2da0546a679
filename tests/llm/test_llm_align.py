"""Alignment of two tokenizers: the merge against plain sets, the operator against the libraries."""
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest

from runlens.llm import align as A, queries as Q
from conftest import SF_SMALL

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " "), (4, "  a  b \n"), (5, "<|endoftext|> hi </s>"), (6, "a ▁ b"), (7, "漢字 тест x\0y"),
       (7, "漢字 тест x\0y"), (None, "no id"), (8, "word, " * 20_000), (9, "x")]
NAMES = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute(rows):
    """The contract's columns by the libraries and plain Python."""
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    byte = A._byte_of_char()
    a_bytes = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if all(c in byte for c in t)}

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    docs, counts = [], Counter()
    for d, t in rows:
        own = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if t and not all(b"".join(map(of, ids)) == b" " + t.encode() for of, ids in zip((a_bytes.__getitem__, b_bytes), own)):
            own = ([], [])
        ends = [np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in zip((a_bytes.__getitem__, b_bytes), own)]
        both = sorted(set(ends[0]) & set(ends[1]))
        links = [(own[0][ends[0].index(e)] if len(both) < 50 else None, own[1][ends[1].index(e)] if len(both) < 50 else None) for e in both]
        if len(both) >= 50:
            at = [dict(zip(e, ids)) for e, ids in zip(ends, own)]
            links = [(at[0][e], at[1][e]) for e in both]
        counts.update(links)
        cut = [0, *both]
        said = ";".join("|".join(",".join(str(i) for i, e in zip(ids, es) if x < e <= y) for ids, es in zip(own, ends))
                        for x, y in zip(cut, both)) if len(both) < 300 else None
        docs.append((d, own, links, said))
    top = Counter()
    for (_, j), n in counts.items():
        top[j] = max(top[j], n)
    for d, own, links, said in docs:
        digest = None if said is None else hashlib.sha256(said.encode()).hexdigest() if links else ""
        yield (d, len(own[0]), len(own[1]), len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)


def compared(got, want):
    got, want = sorted((tuple(r[n] for n in NAMES) for r in got), key=repr), sorted(want, key=repr)
    assert [g[:7] for g in got] == [w[:7] for w in want]
    assert all(w[7] is None or g[7] == w[7] for g, w in zip(got, want))


@pytest.mark.parametrize("work", [1, 2, 3, 7, 64])
def test_pieces_of_the_merge(work):
    random = np.random.default_rng(work)
    for _ in range(60):
        n = int(random.integers(1, 60))
        a, b = (np.unique(np.append(random.integers(1, n + 1, int(random.integers(0, n))), n)) for _ in "ab")
        i, j = A.diagonals(a, b, work)
        assert (np.diff(i + j)[:-1] == work).all() and i[-1] == len(a) and j[-1] == len(b)
        in_a, in_b = A.common_ends(a, b, work)
        assert a[in_a].tolist() == b[in_b].tolist() == np.intersect1d(a, b).tolist()
        starts = [np.concatenate(([0], x[:-1])) for x in (a, b)]
        want = [(x, y, int(min(a[x], b[y]) - max(starts[0][x], starts[1][y]))) for x in range(len(a)) for y in range(len(b))]
        assert list(zip(*map(np.ndarray.tolist, A.overlaps(a, b, work)))) == [w for w in want if w[2] > 0]
    none = np.empty(0, dtype=np.int64)
    assert [len(x) for x in (*A.common_ends(none, none, work), *A.overlaps(none, none, work))] == [0] * 5


def test_alignment_equals_the_libraries(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    compared(Q.QUERIES["op12_alignment"](spark, SF_SMALL).collect(), brute(rows))


def test_alignment_edges(spark, monkeypatch):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").selectExpr("*", "1 AS chunk", "'x' AS pairs", "2 AS n_a").repartition(3)
    monkeypatch.setattr(A, "PIECE_WORK", 5)
    compared(A.alignment_counts(docs, A_PATH, B_PATH).collect(), brute(ODD))
    rows = {r.doc_id: r for r in A.align(docs, A_PATH, B_PATH).collect()}
    assert rows[6].a_ids == rows[1].a_ends == rows[2].b_ends == []
    assert rows[4].a_ends[-1] == len(rows[4].a_ids) and rows[4].b_ends[-1] == len(rows[4].b_ids)
    assert A.alignment_counts(docs.where("1 = 0"), A_PATH, B_PATH).count() == 0


def test_library_way(monkeypatch):
    """A vocabulary whose pieces join blanks goes through the library whole."""
    tokens, texts = A._tokens(A.TokensB, B_PATH), ["a b  c\n", " ▁x", "é 12"]
    own = tokens.encode_all(texts)
    monkeypatch.setattr(tokens, "sliced", False)
    assert [x.tolist() for x in tokens.encode_all(texts)] == [x.tolist() for x in own]
