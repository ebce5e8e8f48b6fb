"""Ranked search, nearest vectors and token alignment against brute force, and their edge rows."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from locusforge.llm import ranked, tokenalign, vectors

WORDS = [a + b for a in "bad cor dim fen gol hut ña 한국".split() for b in "ar en is ot um".split()]
CLASHES = "rank int, score int, block int, term string, id string, bundle int"


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_ranking(docs, items, best):
    rows = [(key, terms(text)) for key, text in docs]
    n_all, l_all = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    df = {w: sum(w in set(t) for _, t in rows) for w in {w for _, t in rows for w in t}}
    out = []
    for item in {i for i, _ in items}:
        asked = {w for i, text in items if i == item for w in terms(text)} & set(df)
        scored = []
        for key, own in rows:
            score = 0
            for w in asked & set(own):
                m = 100 - 90 + (90 * len(own) * n_all) // l_all
                tf = own.count(w)
                score += math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[w] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scored.append((-score, key is None, key or 0))
        out += [(item, rank + 1, None if missing else key, -s) for rank, (s, missing, key) in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [3, 4096])
def test_ranking_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(ranked, "BLOCK_ROWS", rows)
    docs = [(i, prose(i, 5 + i % 40)) for i in range(150)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # copies: equal scores
    docs += [(2000, None), (2001, ""), (2002, "... !?"), (2003, prose(3, 4000)), (None, prose(7, 12)), (5, docs[5][1]), (2004, "CORAR corar\x00corar")]
    items = [(i, prose(900 + i, 6)) for i in range(12)] + [(3, "corar"), (50, None), (51, ""), (52, "nowhere"), (None, "badar dimis")]
    frame = spark.createDataFrame([(*d, 1, 2, 3, "t", "i", 4) for d in docs], f"doc_id long, text string, {CLASHES}").repartition(4)
    asked = spark.createDataFrame([(*i, 1, 2, 3, "t", "i", 4) for i in items], f"item_id long, text string, {CLASHES}")
    got = ranked.search(frame, asked)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, 10)


def test_many_items_take_several_bundles(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BUNDLE", 4)
    docs = [(i, prose(i, 20)) for i in range(60)]
    items = [(i, prose(500 + i, 3)) for i in range(11)]
    got = ranked.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), best=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain_ranking(docs, items, 3)


def test_search_in_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(docs.limit(0), items).count() == 0
    assert ranked.search(docs, items.limit(0)).count() == 0


def true_neighbours(rows, best=20):
    ids = np.array([i for i, _ in rows])
    table = np.array([v for _, v in rows], float)
    out = {}
    for i in sorted({i for i in ids.tolist() if i % 20 == 0}):
        own = table[ids == i][0]
        scores = (table * own).sum(axis=1)
        order = [k for k in np.lexsort((ids, -scores)).tolist() if ids[k] != i][:best]
        out[i] = [(int(ids[k]), float(scores[k])) for k in order]
    return out


def found_neighbours(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("spread", [1.0, 0.3])
def test_recall_of_neighbours(spark, monkeypatch, spread):
    """Many small lists; vectors of unequal norm, loose and in clusters; a third of the rows are one vector."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 25)
    rnd = np.random.default_rng(3)
    middles = rnd.normal(size=(30, 16))
    table = middles[rnd.integers(0, 30, 2000)] * (1 - spread) + rnd.normal(size=(2000, 16)) * rnd.uniform(0.5, 2, (2000, 1))
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(table)]
    rows += [(2000 + i, rows[40][1]) for i in range(1000)]
    got = found_neighbours(vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)))
    true = true_neighbours(rows)
    assert set(got) == set(true) and all(len(x) == 20 for x in got.values())
    hits = 0
    for q, near in got.items():
        last = true[q][-1][1]
        hits += sum(s >= last - 1e-9 for _, s in near)
        scores = dict(near)
        own = np.array(dict(rows)[q])
        for i, s in near[:3]:
            assert s == pytest.approx(float(np.dot(np.array(rows[i][1]), own)), abs=1e-12) and i != q
        assert near == sorted(near, key=lambda x: (-x[1], x[0])) and len(scores) == 20
    assert hits / (20 * len(got)) >= 0.93


def test_few_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (20, [-1.0, 0.5]), (20, [-1.0, 0.5]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]),
        (100, [1.0, None]), (120, [inf, 1.0]), (None, [1.0, 1.0]), (140, [1.0, 1.0, 1.0]), (160, []),
    ]
    frame = spark.createDataFrame([(*r, 1, 2, 3, "t", "i", 4) for r in rows], f"vec_id long, embedding array<float>, {CLASHES}")
    got = found_neighbours(vectors.nearest(frame))
    assert got == {0: [(2, 1.0), (1, 0.0), (20, -1.0)], 20: [(1, 0.5), (0, -1.0), (2, -1.0)]}
    assert vectors.nearest(frame.limit(0)).count() == 0
    assert vectors.nearest(frame.where("vec_id = 1")).count() == 0
    assert vectors.nearest(frame.where("vec_id = 0")).count() == 0


def token_ends(tokens, ids):
    ends = np.cumsum([len(tokens[i]) for i in ids]).tolist()
    return list(zip([0, *ends[:-1]], ends))


def plain_alignment(text, engines):
    """(a, b, groups, links) by comparing all pairs."""
    byte_level, pieces = engines
    spaced = " " + text
    a = byte_level.encode(spaced, add_special_tokens=False).ids
    both = tokenalign.tokenizers_of(tokenalign.TOKENIZERS)
    b = pieces.encode(text)
    if b"".join(both.b.bytes[i] for i in b) != spaced.encode():
        return [], [], [], []
    in_a, in_b = token_ends(both.a.bytes, a), token_ends(both.b.bytes, b)
    cuts = sorted({e for _, e in in_a} & {e for _, e in in_b})
    groups = []
    for low, high in zip([0, *cuts], cuts):
        groups.append(([i for i, (s, e) in zip(a, in_a) if low <= s and e <= high], [i for i, (s, e) in zip(b, in_b) if low <= s and e <= high]))
    links = [(a[i], b[j]) for i, (s, e) in enumerate(in_a) for j, (t, f) in enumerate(in_b) if max(s, t) < min(e, f)]
    return a, b, groups, links


def test_alignment_against_all_pairs(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    byte_level = Tokenizer.from_file(f"{tokenalign.TOKENIZERS}/{tokenalign.BYTE_FILE}")
    byte_level.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{tokenalign.TOKENIZERS}/{tokenalign.PIECE_FILE}")
    rnd = random.Random(5)
    odd = [" ", "  ", "\n", "\t", "it's", "Hello", "ñandú", "한국어", "🙂", " ", "123", "...", "<|endoftext|>", "</s>", "\x1c", "ﬁ", "\r\n", "‍", "x" * 80]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 25))) for _ in range(60)]
    texts += [prose(i, 30) for i in range(30)] + [None, "", " ", "a▁b", texts[0], prose(1, 30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a text without a key"), (3, "another of a key")]
    plain = [(k, plain_alignment(t, (byte_level, pieces)) if t else ([], [], [], [])) for k, t in rows]
    counts = {}
    for _, (_, _, _, links) in plain:
        for pair in set(links):
            counts[pair] = counts.get(pair, 0) + 1
    most = {}
    for (x, _), n in counts.items():
        most[x] = max(most.get(x, 0), n)
    want = []
    for key, (a, b, groups, links) in plain:
        digest = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(digest.encode()).hexdigest() if digest else ""
        best = sum(counts[p] == most[p[0]] for p in links)
        want.append((key, len(a), len(b), len(groups), len(links), best, sum(counts[p] for p in links), sha))
    frame = spark.createDataFrame([(*r, 1, 2, 3, "t", "i", 4) for r in rows], f"doc_id long, text string, {CLASHES}").repartition(5)
    got = tokenalign.alignments(frame)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tokenalign.alignments(frame.limit(0)).count() == 0


def test_whole_texts_and_remembered_parts_give_the_same_pieces():
    both = tokenalign.tokenizers_of(tokenalign.TOKENIZERS)
    assert both.a.by_rank and both.b.apart
    texts = [prose(9, 20_000), "a  b \n c" * 50, "y" * 120_000, "end \n ", " \n  start"]
    for text, (a, b) in zip(texts, both.encode(texts)):
        assert b == both.b.ids(text) and a == both.a.plain.encode(" " + text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_shared_ends_of_random_runs(seed):
    """Intervals with many, few and no common ends, and one long run whose only cuts lie at one side."""
    rnd = np.random.default_rng(seed)
    a, b, limits, total = [], [], [0], 0
    for n in [1, 2, 0, 50, 3000, 7]:
        x = np.flatnonzero(rnd.random(n * 3) < 0.4)
        y = np.flatnonzero(rnd.random(n * 3) < rnd.choice([0.05, 0.4]))
        if seed == 5 and n == 3000:
            x, y = np.arange(0, 9000, 2), np.concatenate([np.arange(0, 200, 2), np.arange(201, 9000, 2)])
        if n:
            a += [*(total + x + 1).tolist(), total + 3 * n + 2]
            b += [*(total + y + 1).tolist(), total + 3 * n + 2]
            total += 3 * n + 2
        limits.append(len(a))
    got = tokenalign.shared_ends(np.array(a), np.array(b), np.array(limits))
    assert got.tolist() == np.isin(a, b).tolist()
