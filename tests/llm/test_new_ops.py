from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, codes, windows
from tidemark.llm import text as T

from .test_ops import SCHEMA, frame, messy, rows, vocabulary

# repeated windows


def without_windows(texts, size):
    words = [re.findall("[^\x20\x09-\x0d]+", t or "") for t in texts]
    places = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {p for k in range(len(w) - size + 1) if places[tuple(w[k : k + size])] > 1 for p in range(k, k + size)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def repeated_texts(seed):
    """Passages of 33 to 60 words inside other texts, twice in one text, cut at either end, and in many texts."""
    rng = random.Random(seed)
    v = vocabulary(rng, 200)
    some = lambda n: [rng.choice(v) for _ in range(n)]
    passages = [some(n) for n in (33, 34, 35, 36, 53, 60)]
    texts = [" ".join(some(rng.randint(0, 30)) + rng.choice(passages)[rng.randint(0, 3) :] + some(rng.randint(0, 90))) for _ in range(60)]
    texts += [" ".join(passages[4] + some(1) + passages[4]), "\n".join(passages[5]), "  ".join(passages[5][:40]) + "\t", " ".join(["same"] * 80), " ".join(["a", "b"] * 40)]
    return [*texts, *messy(seed)]


@pytest.mark.parametrize("cells,hot", [(1 << 20, 64), (1 << 16, 3), (1 << 16, 1 << 40)])
def test_windows_are_those_of_brute_force(spark, monkeypatch, cells, hot):
    """With room in the sketch and nearly without, and with frequent anchors dealt by window or not."""
    monkeypatch.setattr(windows, "HOT", hot)
    monkeypatch.setattr(windows, "HOT_LOAD", 0)
    texts = repeated_texts(1)
    ids = [k if k % 7 else None for k in range(len(texts))]
    got = windows.remove_windows(frame(spark, texts, ids=ids), cells=cells).collect()
    want = without_windows(texts, 35)
    assert Counter(tuple(r) for r in got) == Counter((i, *w) for i, w in zip(ids, want, strict=True))
    assert sum(w[1] for w in want) > 1000


def test_windows_of_other_sizes_chunks_and_shares(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(windows, "FLUSH", 100)
    monkeypatch.setattr(windows, "SEEN", 5)
    monkeypatch.setattr(windows, "HOT", 3)
    texts = repeated_texts(2)
    got = windows.remove_windows(frame(spark, texts), size=12, cells=1 << 16).collect()
    want = without_windows(texts, 12)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_window_estimates_are_never_too_low():
    """A window's estimate is that of its anchor, of a sketch that is much too small."""
    rng = np.random.default_rng(0)
    hashes = rng.integers(1, 40, 3000).astype(np.uint64)
    grams = windows.sequences(hashes, 2, 0)
    cells = 1 << 10
    total = np.zeros(windows.ROWS * cells, np.int64)
    for at in windows.cells_of(grams, cells):
        np.add.at(total, at, 1)
    kind = (total >= 2).astype(np.uint8).reshape(-1, 4)
    bits = kind[:, 0] | kind[:, 1] << 2 | kind[:, 2] << 4 | kind[:, 3] << 6
    counts = Counter(grams.tolist())
    low = windows.estimates(bits, grams, cells)
    assert all(low[k] for k, g in enumerate(grams.tolist()) if counts[g] > 1)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    v = vocabulary(rng, 30)
    passage = " ".join(rng.choice(v) for _ in range(50))
    texts = ["x y " + passage, passage + " z", " ".join(rng.choice(v) for _ in range(9)) + "\n" + passage]
    raw, offs = T.flatten(pa.array(texts))
    doc, word, place, grams, whole = windows.anchored(raw, offs, 35, 18)
    by = {}
    for d, w, p, g, h in zip(doc.tolist(), word.tolist(), place.tolist(), grams.tolist(), whole.tolist(), strict=True):
        by.setdefault(h, set()).add((p - (w + int(np.searchsorted(T.words(raw, offs, T.NONSPACE)[2], d))), g))
    assert max(map(len, by.values())) == 1 and len(doc) > len(by)


def test_windows_of_an_empty_table(spark):
    assert windows.remove_windows(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_refuse_anchors_that_do_not_fit(spark):
    with pytest.raises(ValueError):
        windows.remove_windows(frame(spark, ["a"]), size=60, gram=10)


# vector codes


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    x = np.floor(np.array([v for _, v in vectors], float) * 4096).astype(np.int64)
    width = x.shape[1] // parts
    books = [x[:entries, p * width : (p + 1) * width].copy() for p in range(parts)]
    for step in range(rounds + 1):
        code, error = [], 0
        for p, book in enumerate(books):
            part = x[:, p * width : (p + 1) * width]
            d = ((part[:, None] - book[None]) ** 2).sum(2)
            c = d.argmin(1)
            code.append(c)
            error = error + d[np.arange(len(c)), c]
            if step < rounds:
                books[p] = np.array([part[c == e].sum(0) // (c == e).sum() if (c == e).any() else book[e] for e in range(len(book))])
    return np.array(code).T, error, books


def embedded(n, length, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.2, (n, length)) if not ties else rng.integers(-2, 3, (n, length)) / 4096
    return [(int(k), v.astype(float).tolist()) for k, v in enumerate(x)]


@pytest.mark.parametrize("n,length,ties", [(200, 64, False), (120, 24, True), (9, 16, False), (60, 8, True)])
def test_codes_are_those_of_full_search(spark, n, length, ties):
    vectors = embedded(n, length, n, ties)
    bad = [(1000, None, 1), (1001, [1.0] * (length - 1) + [float("nan")], 1), (1002, [1.0] * (length - 1) + [float("inf")], 2), (1003, [1.0] * (length - 1) + [None], 2)]
    data = [(k, v, None if k % 3 == 0 else k % 2) for k, v in vectors] + bad
    df = spark.createDataFrame([(*r, 0, "z") for r in data], "vec_id long, embedding array<double>, label int, error int, code string").repartition(3)
    out, books = codes.compress(df)
    code, error, want = brute_codes(vectors)
    assert all((a == b).all() for a, b in zip(books, want, strict=True))
    got = {r["vec_id"]: r for r in out.collect()}
    assert set(got) == set(range(n))
    by_label = Counter()
    for k in range(n):
        assert got[k]["code"] == bytes(code[k].tolist()) and got[k]["error"] == error[k] == sum(got[k]["errors"])
        by_label[got[k]["label"]] += int(error[k])
    assert all(got[k]["label_error"] == by_label[got[k]["label"]] for k in range(n))
    assert codes.digest(books) == hashlib.sha256(",".join(str(int(v)) for b in want for v in b.ravel()).encode()).hexdigest()


def test_bounds_leave_no_nearest_entry_out():
    rng = np.random.default_rng(5)
    for scale in (1, 3, 1000, 1 << 26):
        for width in (1, 3, 8, 10):
            x, book = rng.integers(-scale, scale + 1, (300, width)), rng.integers(-scale, scale + 1, (16, width))
            best, far, tried = codes.nearest(x, book)
            d = ((x[:, None] - book[None]) ** 2).sum(2)
            assert (best == d.argmin(1)).all() and (far == d.min(1)).all() and tried <= x.shape[0] * 17
    book = rng.integers(-1000, 1001, (16, 8))
    near = book[rng.integers(0, 16, 300)] + rng.integers(-50, 51, (300, 8))
    assert codes.nearest(near, book)[2] < 300 * 4  # of 16: others are left out


def test_codes_of_repeated_ids_other_lengths_and_no_rows(spark):
    rows_ = [(1, [0.0] * 8, 1), (1, [0.5] * 8, 1), (None, [1.0] * 8, None), (3, [1.0] * 16, 1), (1, [0.0] * 8, 1)]
    df = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")
    out, books = codes.compress(df)
    assert Counter(r["vec_id"] for r in out.collect()) == Counter({1: 3, None: 1}) and len(books[0]) == 4
    assert [b[0, 0] for b in books] == [0] * 8 and books[0][3, 0] == 4096  # ordered by vector among equal ids, null ids last
    assert codes.compress(df.limit(0))[0].count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1)], df.schema))[0].count() == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [0.0] * 9, 1)], df.schema))
    with pytest.raises(Exception, match="not covered"):
        codes.compress(spark.createDataFrame([(1, [1e9] * 8, 1)], df.schema))[0].collect()


# alignment of tokenizers


def loaded():
    return alignment.Pair.load(alignment.FOLDER, "byte_bpe_50k.json", "piece_bpe_32k.model")


def brute_alignment(texts):
    """By whole texts, byte ranges of each token, and every pair of them."""
    pair = loaded()
    docs, counts = [], Counter()
    for t in texts:
        a = pair.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        whole = (" " + t).encode() if t else b""
        if b"".join(pair.a_bytes[k] for k in a) != whole or b"".join(pair.b_bytes[k] for k in b) != whole:
            a, b = [], []
        ends = [np.cumsum([len(table[k]) for k in ids]).astype(int).tolist() for table, ids in ((pair.a_bytes, a), (pair.b_bytes, b))]
        groups, links, low = [], [], 0
        for high in sorted(set(ends[0]) & set(ends[1])):
            inside = [[k for k, e in zip(ids, es, strict=True) if low < e <= high] for ids, es in zip((a, b), ends, strict=True)]
            groups.append("|".join(",".join(map(str, g)) for g in inside))
            low = high
        spans = [list(zip([0, *es[:-1]], es, strict=True)) if es else [] for es in ends]
        j = 0
        for x, (s, e) in zip(a, spans[0], strict=True):
            while j and spans[1][j - 1][1] > s:
                j -= 1
            for k in range(j, len(b)):
                if spans[1][k][0] >= e:
                    break
                if spans[1][k][1] > s:
                    links.append((x, b[k]))
                    j = k
        counts.update(links)
        docs.append((a, b, ";".join(groups), links))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest() if s else ""
    return [(len(a), len(b), g.count("|"), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), digest(g), g) for a, b, g, x in docs], counts


def odd_texts(seed):
    rng = random.Random(seed)
    alphabet = "abcdeé  \n\t.,'0123ßжñ中文　  \u0085▁🙂\x00‍́ABC"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    return [*texts, " ", "  ", "a ", " a", "a  b   c", "it's  <|endoftext|> <s> </s> <unk> <0x41>", "▁", "x▁ y", "﻿ a", "a" * 5000, "word " * 3000, "\r\n \r\n", "naïve café 中文 русский", "  x   y"]


def test_alignment_is_that_of_brute_force(spark, monkeypatch):
    """Batches of a few texts, several batches a set, and a short memory; two sets of copies."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    monkeypatch.setattr(alignment, "CALL_BYTES", 200)
    texts = [*odd_texts(0), *messy(4), *odd_texts(0)[:9]]
    out, counts = alignment.align(frame(spark, texts, ids=[k if k != 5 else None for k in range(len(texts))]), groups=True)
    want, links = brute_alignment(texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in out.collect()}
    assert [got[k if k != 5 else None] for k in range(len(texts))] == want
    assert {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): r["n"] for r in counts.collect()} == links
    assert any(not w[0] for k, w in enumerate(want) if texts[k])  # a text that the tokens don't give back


def test_texts_are_encoded_in_pieces_as_they_are_whole():
    pair = loaded()
    assert pair.cut
    for t in [*odd_texts(1), *odd_texts(2), *(x for x in messy(2) if x)]:
        if not t:
            continue
        raw = np.frombuffer((" " + t).encode(), np.uint8)
        edges = [0, *alignment.cuts(raw).tolist(), len(raw)]
        edges = sorted(set(edges))
        pieces = [raw[x:y].tobytes().decode() for x, y in zip(edges, edges[1:], strict=False)]
        assert [k for a in pair.encode_a(pieces) for k in a] == pair.a.encode(" " + t, add_special_tokens=False).ids
        if "▁" not in t:
            assert [k for b in pair.encode_b(pieces) for k in b] == pair.b.encode(t)


def test_alignment_of_no_rows(spark):
    out, counts = alignment.align(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and counts.count() == 0
    out, _ = alignment.align(spark.createDataFrame(rows([None, ""]), SCHEMA))
    assert [tuple(r)[1:] for r in out.collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_digests_of_the_queries_name_what_the_operators_return(spark, tmp_path):
    from tidemark.llm import queries

    texts = repeated_texts(5)
    frame(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op11_windows(spark, str(tmp_path)).collect()}
    for k, (n, gone, kept) in enumerate(without_windows(texts, 35)):
        assert (got[k]["n_words"], got[k]["n_removed"], got[k]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
    spark.createDataFrame([(k, v, k % 3) for k, v in embedded(40, 64, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    code, error, _ = brute_codes([(k, np.float32(v).astype(float)) for k, v in embedded(40, 64, 1)])
    out = queries.op12_codes(spark, str(tmp_path)).orderBy("vec_id").collect()
    assert [r["code"] for r in out] == [bytes(c).hex() for c in code.astype(np.uint8).tolist()] and [r["error"] for r in out] == error.tolist()
    assert out[0].asDict().keys() == {"vec_id", "code", "error", "label_error", "codebooks_sha256"}
    assert queries.op13_alignment(spark, str(tmp_path)).filter(F.col("n_a") > 0).count() > 60
