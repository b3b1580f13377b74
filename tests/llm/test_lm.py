"""Importance resampling, language-model scores and token alignment against brute force."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactory.llm import align, hmm, lexicon, resample
from redactory.llm.common import table
from redactory.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
TEXTS = [
    "line one\nline two\n\npara. three\r\nfour\n", "\nfirst", 
    "the cat sat on the mat", "The CAT sat; on the mat!", "", None, "a", "Straße äöü ß CAT 42", "x" * 30_000, "one two " * 400, "the cat sat on the mat",
    "tab\tand\nline  two spaces ", " leading", "日本語 テキスト です", "emoji 😀 end", "NUL\x00inside", "<|endoftext|> <s> </s>", "a▁b", "don't we'll   stop...", "  ", " hard space",
]
SCHEMA = "rank string, doc_id long, text string, row int, score string, learn int, pair string"


def _docs(spark, texts=TEXTS, ids=None):
    rows = [("r", i if ids is None else ids[i], t, 7, "s", 3, "p") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# importance resampling


def _features(text, width):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)], len(words)


def _resampled(docs, target, width, buckets, percent, least, seed):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    own, goal = Counter(), Counter()
    for _, t in docs:
        own.update(map(place, _features(t, width)[0]))
    for t in target:
        goal.update(map(place, _features(t, width)[0]))
    s_all, t_all = sum(own.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((own[b] + 1) * (t_all + buckets))))
    out, able = [], []
    for i, t in docs:
        found, n = _features(t, width)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(f)) for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize(("width", "words", "pairs"), [(1, 3, 3), (2, 4, 2), (3, 100, 100), (2, 0, 0)])
def test_resample_equals_brute_force(spark, width, words, pairs):
    target = ["the mat sat", None, "cat 42 äöü"]
    got = resample.resample(_docs(spark), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int"), width, 50, 50, 4, 7, words, pairs)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == _resampled(list(enumerate(TEXTS)), target, width, 50, 50, 4, 7)


def test_resample_odd_rows(spark):
    ids = [None, None, 5, 5, 5] + list(range(10, 10 + len(TEXTS) - 5))
    target = spark.createDataFrame([], "text string")
    got = resample.resample(_docs(spark, ids=ids), target, 1, 50, 100, 1)
    want = _resampled(list(zip(ids, TEXTS)), [], 1, 50, 100, 1, 2024)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in got.collect() if r.doc_id) == sorted(r[:4] for r in want if r[0])
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, sum(1 for r in want if r[4]) + 1))
    assert resample.resample(_docs(spark, []), target).count() == 0


def test_frequent_takes_whole_levels(spark):
    counts = spark.createDataFrame([("a", 100), ("b", 50), ("c", 50), ("d", 1)], "word string, n long")
    named = lambda most: {r.word for r in lexicon.frequent(counts, most).collect()}
    assert named(0) == set() and named(1) == {"a"} and named(2) == {"a"} and named(3) == {"a", "b", "c"} and named(9) == {"a", "b", "c", "d"}


# hidden Markov model


def _model(rng, states, symbols):
    own = lambda *shape: rng.dirichlet(np.ones(shape[-1]), shape[0])
    return hmm.Model(own(1, states)[0], own(states, states), own(states, symbols).T.copy())


def _paths(m, text):
    """(probability, path) of every path of states through a text."""
    for path in itertools.product(range(len(m.first)), repeat=len(text)):
        p = m.first[path[0]] * m.show[text[0], path[0]]
        for a, b, x in zip(path, path[1:], text[1:]):
            p *= m.move[a, b] * m.show[x, b]
        yield p, path


def test_forward_and_expected_counts_equal_all_paths(monkeypatch):
    rng = np.random.default_rng(1)
    m = _model(rng, 3, 5)
    texts = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 6, 4, 7, 2, 7)]
    totals = [sum(p for p, _ in _paths(m, t)) for t in texts]
    want = hmm.empty(3, 5)
    for t, total in zip(texts, totals):
        for p, path in _paths(m, t):
            want.first[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                want.move[a, b] += p / total
            for x, s in zip(t, path):
                want.show[x, s] += p / total
    for span, lanes in ((256, 1024), (2, 1024), (3, 2), (1, 1)):
        monkeypatch.setattr(hmm, "SPAN", span)
        monkeypatch.setattr(hmm, "LANES", lanes)
        assert np.allclose(hmm.log10_likelihoods(m, texts), np.log10(totals), atol=1e-12)
        got = hmm.empty(3, 5)
        hmm.gather(m, texts, got)
        for a, b in zip(got, want):
            assert np.allclose(a, b, atol=1e-5)


def _fold(i, parts):
    return None if i is None else zlib.crc32(str(i).encode()) % parts


def _lm(docs, states, rounds, symbol_words):
    """The same scores by plain loops over one text at a time."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    learn = [t for i, t in docs if _fold(i, 7) != 2]
    c, every = Counter(w for t in learn for w in words(t)), Counter(w for _, t in docs for w in words(t))
    n, v = sum(c.values()) + len(learn), len(c) + bool(learn)
    by = sorted(c, key=lambda w: (-c[w], w.encode()))[:symbol_words]
    symbol = {w: i for i, w in enumerate(by)}
    group = lambda w: zlib.crc32(w.encode()[-2:]) % hmm.ENDINGS
    sums = [[0, 0] for _ in range(hmm.ENDINGS)]
    for w in c:
        if w not in symbol:
            sums[group(w)][0] += c[w]
            sums[group(w)][1] += 1
    size = len(by) + hmm.ENDINGS + 1
    code = lambda t: np.array([*(symbol.get(w, len(by) + group(w)) for w in words(t)), size - 1], np.uint16)
    plain = np.array([c[w] + 1.0 for w in by] + [1.0 + t for t, _ in sums] + [1.0 + len(learn)])
    plain /= plain.sum()
    m = hmm.seeded([], plain, states)
    for _ in range(rounds):
        g = hmm.empty(states, size)
        for t in learn:
            hmm.gather(m, [code(t)], g)
        m = hmm.improved(g, plain)
    for i, t in docs:
        own = words(t)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) + math.log10((len(learn) + 1) / (n + v + 1))
        inner = sum(math.log10((c[w] + 1) / (sum(sums[group(w)]) + 1)) for w in own if w not in symbol)
        yield i, _fold(i, 7) == 2, len(own) + 1, sum(c[w] > 0 for w in own) + bool(learn), n, round(base, 6), round(float(hmm.log10_likelihoods(m, [code(t)])[0]) + inner, 6)
    assert every


@pytest.mark.parametrize(("symbols", "head"), [(3, 6), (100, 1000), (2, 0)])
def test_scores_equal_plain_loops(spark, monkeypatch, symbols, head):
    # without texts of twenty words to start from, both begin at the plain start
    texts = [t if t is None or len(t) < 3000 and len(t.split()) < 19 else t[:60] for t in TEXTS] + ["held words only here", "unseen zzz qq", "b c"] * 4
    docs = list(enumerate(texts)) + [(None, "no id here"), (3, "twice"), (3, "twice")]
    got = hmm.lm_scores(_docs(spark, [t for _, t in docs], [i for i, _ in docs]), states=3, rounds=2, symbol_words=symbols if head else 0, head_words=head)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    made = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got.collect()), key=str)
    # symbols come from the head alone, so the brute version takes them from there too
    want = sorted(_lm(docs, 3, 2, min(symbols if head else 0, len(made) * 100)), key=str)
    if symbols == 3:
        every = Counter(w for _, t in docs for w in (t or "").encode().lower().split())
        chosen = {r[0] for r in lexicon.frequent(spark.createDataFrame([(bytes(w), n) for w, n in every.items()], "word binary, n long"), head).collect()}
        if len(chosen) < 3:
            pytest.skip("the head holds fewer words than the brute version's symbols")
    for a, b in zip(made, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-3


def test_no_documents_and_no_training_rows(spark):
    assert hmm.lm_scores(_docs(spark, []), states=2, rounds=1).count() == 0
    held = next(i for i in range(1000) if _fold(i, 7) == 2)
    row = hmm.lm_scores(_docs(spark, ["some words"], [held]), states=2, rounds=1).first()
    assert row.held_out and row.n_tokens == 3 and row.n_known == 0 and row.train_tokens == 0 and row.base_score == 0.0 and row.score < 0


def test_states_help_held_out_texts(spark):
    got = hmm.lm_scores(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert got[0] > got[1]


# token alignment


def _aligned(texts, a_path, b_path):
    """Rows by the libraries on whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a, b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    table = {c: i for i, c in enumerate(align.byte_alphabet())}
    assert decoders.ByteLevel().decode(["Ġx"]) == " x"
    b_bytes = lambda p: bytes.fromhex(p[3:5]) if re.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()
    rows, held, links = [], Counter(), []
    for t in texts:
        own = [], []
        if t:
            x, y = a.encode(" " + t, add_special_tokens=False), b.encode(t)
            sides = [bytes(table[c] for c in a.id_to_token(i)) for i in x.ids], [b_bytes(b.id_to_piece(i)) for i in y]
            if b"".join(sides[0]) == b"".join(sides[1]) == (" " + t).encode():
                own = x.ids, y
        found, groups = [], []
        if own[0]:
            at = [list(itertools.accumulate(map(len, s), initial=0)) for s in sides]
            for i in range(len(own[0])):
                for j in range(max(0, np.searchsorted(at[1], at[0][i], "right") - 1), len(own[1])):
                    if at[1][j] >= at[0][i + 1]:
                        break
                    if at[1][j + 1] > at[0][i]:
                        found.append((own[0][i], own[1][j]))
            common = sorted(set(at[0]) & set(at[1]))
            for lo, hi in zip(common, common[1:]):
                cut = [",".join(str(k) for k, e in zip(ids, ends[1:]) if lo < e <= hi) for ids, ends in zip(own, at)]
                groups.append("|".join(cut))
        rows.append([len(own[0]), len(own[1]), len(groups), len(found), 0, 0, hashlib.sha256(";".join(groups).encode()).hexdigest() if own[0] else ""])
        links.append(found)
        held.update(set(found))
    best = {}
    for (x, _), n in held.items():
        best[x] = max(n, best.get(x, 0))
    for r, found in zip(rows, links):
        r[4], r[5] = sum(held[p] == best[p[0]] for p in found), sum(held[p] for p in found)
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 40, 0])
def test_alignment_equals_the_libraries(spark, monkeypatch, most):
    monkeypatch.setattr(align, "PORTION", 3000 if most else 1 << 20)
    monkeypatch.setattr(align, "HELD_PAIRS", 2_000_000 if most else 50)
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    given_ = [r.text for r in table(spark, SF, "documents").where("length(text) < 3000").orderBy("doc_id").limit(60).collect()]
    texts = TEXTS + given_
    docs = _docs(spark, texts, [None if i == 2 else i // 2 for i in range(len(texts))])
    got = align.align_documents(docs, a, b, most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(_aligned(texts, a, b))
    assert align.align_documents(_docs(spark, []), a, b, most).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n  abAB'.▁<0x>é日  \x1c"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_in_a_row_are_the_whole_text(text):
    a, b = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    own = align.aligner(a, b)
    own.forget(len(own.words) // 2)
    x = own.align([text, "x", None, text])
    (n_a, n_b, n_groups, n_links, *_, sha), = _aligned([text], a, b)
    assert x.sizes[0].tolist() == x.sizes[3].tolist() == [n_a, n_b, n_groups, n_links]
    assert [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.groups(x)][::3] == [sha, sha]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**31 - 1), min_size=1, max_size=400))
def test_perfect_hash_numbers_every_key_once(keys):
    own = np.array(sorted(keys), np.int64)
    slices = 3
    parts = {s: tuple(x.astype(k).tobytes() for x, k in zip(align.perfect_slice(own[own % slices == s]), (np.uint32, np.uint8, np.int32))) for s in range(slices) if (own % slices == s).any()}
    found = align.PairHash(slices, parts)
    assert sorted(found(own).tolist()) == list(range(len(own)))
    others = np.array([k for k in range(500) if k not in keys], np.int64)
    assert (found(others) == -1).all()
