"""Alignment against one pair of tokens at a time."""

import bisect
import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from emberlog.llm import alignment, bpe, text

from .test_operators import corpus, make

A, B = alignment.default_paths()
ODD = [None, "", " ", "\n", "\n\n a", "a\n", "  two  blanks  ", "tab\tx \t y\t\n z", "\r\nx\r\n", "▁x", "a ▁", "<|endoftext|> </s> <s> <unk> <0x0A>", "日本語 テスト　全角", "é ﬁ ½  nb em", "😀 👨‍👩‍👧 x", "nul\x00 \x1c \x1f \x7f x", "don't 'll we've 12345 !!! ...", " " * 300 + "x", "a" + " " * 50 + "b\n" * 40, " a  b\u0085c   d", "I'm​ zero ﻿ bom �", "x" * 5000]


@pytest.fixture(scope="module")
def plain():
    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(bpe.byte_letters())}

    def rows(x):
        """(A tokens, B tokens, groups, links, digest), and the links' pairs."""
        none = (0, 0, 0, 0, ""), collections.Counter()
        if not x:
            return none
        a, b = one.encode(" " + x, add_special_tokens=False).ids, two.encode(x)
        a_raw = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        b_raw = [bytes([int(two.id_to_piece(i)[1:-1], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(a_raw) != (" " + x).encode() or b"".join(b_raw) != (" " + x).encode():
            return none
        a_end, b_end = (np.cumsum([len(t) for t in raw]).tolist() for raw in (a_raw, b_raw))
        groups, links, i, j = [], collections.Counter(), 0, 0
        for cut in sorted(set(a_end) & set(b_end)):
            i2, j2 = bisect.bisect_right(a_end, cut), bisect.bisect_right(b_end, cut)
            groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
            for p in range(i, i2):
                for q in range(j, j2):
                    if a_end[p] - len(a_raw[p]) < b_end[q] and b_end[q] - len(b_raw[q]) < a_end[p]:
                        links[a[p], b[q]] += 1
            i, j = i2, j2
        return (len(a), len(b), len(groups), sum(links.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()), links

    return rows


def test_rows(plain):
    found = alignment.aligner(A, B)
    for x, got in zip(ODD, found.rows(*text.buffers(pa.array(ODD, pa.large_string()))), strict=True):
        want, links = plain(x)
        assert got[:5] == want, x
        k, n = found.unpacked(got[5]) if got[5] is not None else ([], [])
        assert {divmod(int(a), found.b.size): int(b) for a, b in zip(k, n, strict=True)} == links, x


def test_a_stretch_is_the_same_alone_and_among_others(plain):
    found = alignment.Aligner(A, B)
    words = ["one", "two.", "(three)", "fünf", "7th", "e.g.", "a\tb", "x\r", "…", "don't"]
    texts = [" ".join(words[i:] + words[:i]) + "\n" + "\n".join(words[::-1][i:]) for i in range(10)]
    for x in texts:  # one by one, so that later ones come from the cache
        assert found.rows(*text.buffers(pa.array([x], pa.large_string())))[0][:5] == plain(x)[0]


def expected(rows, plain):
    each = [plain(x) for _, x in rows]
    total = sum((links for _, links in each), collections.Counter())
    most = collections.defaultdict(int)
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (head, links) in zip(rows, each, strict=True):
        out.append((doc_id, *head[:4], sum(n for p, n in links.items() if total[p] == most[p[1]]), sum(n * total[p] for p, n in links.items()), head[4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [alignment.FREQUENT, 50, 0])
def test_align(spark, plain, most, monkeypatch):
    """Whether pairs are broadcast or joined, every link counts; nulls, repeats and long texts included."""
    monkeypatch.setattr(alignment.frequent, "__defaults__", (most,))
    rows = corpus()[:30] + corpus()[-24:] + [(400 + i, x) for i, x in enumerate(ODD)]
    got = alignment.align(make(spark, rows))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, plain)


def test_tasks_send_pairs_in_parts(spark, plain, monkeypatch):
    rows = corpus()[:12]
    found, _ = alignment.store.save(alignment.aligned(make(spark, rows), A, B))
    want = sorted(alignment.totals(found, A, B).collect())
    monkeypatch.setattr(alignment, "HELD", 64)
    assert sorted(alignment.totals(found, A, B).collect()) == want


def test_empty_table(spark):
    assert alignment.align(make(spark, [(1, "x")]).where("false")).collect() == []
    assert [tuple(r) for r in alignment.align(make(spark, [(None, None)])).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]
