import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from letterworks.llm import gru, language_id, lm_scoring, textvec

SF = "/root/testdata/sf0.01"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds == 0


def test_ngrams_are_those_of_the_text():
    texts = ["", None, "Été 12 à", "aß", "a", "中文 x", "!!!", "ab"]
    ((_, raw, offs),) = textvec.pieces(pa.array(texts))
    c, begin = language_id.characters(raw, offs)
    plain = ["".join(chr(x) if x else " " for x in c[a:b]) for a, b in zip(begin[:-1], begin[1:], strict=True)]
    assert [p.strip() for p in plain] == ["", "", "été à", "aß", "a", "中文 x", "", "ab"]
    grams = language_id.ngrams(c, begin)
    assert ((grams != language_id.BUCKETS).sum(axis=0) > 0).any()
    owner, _, count = language_id.counted(grams, begin)
    # "a" between blanks: a; " a", "a "; " a "
    assert count[owner == 4].sum() == 4 and not (owner == 6).any() and not (owner == 0).any()
    same = language_id.counted(*(lambda x: (language_id.ngrams(*x), x[1]))(language_id.characters(np.frombuffer(b"aAa", np.uint8), np.array([0, 1, 3]))))
    assert same[1][0] in same[1][1:]


def test_language_of_held_out_documents(spark):
    out = language_id.op2_language_id(spark, SF).join(docs(spark).select("doc_id", "lang"), "doc_id").collect()
    assert len(out) == docs(spark).count()
    assert all(r.held_out == held(r.doc_id, 5) for r in out)
    tests = [r for r in out if r.held_out]
    right = [r.lang == r.lang_pred for r in tests]
    assert np.mean(right) >= 0.98
    assert abs(np.mean([r.score for r in tests]) - np.mean(right)) < 0.03  # calibrated


def test_language_odd_rows(spark):
    train = docs(spark).limit(300)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the of and in the"), (5, "der die das " * 20_000), (5, "a"), (5, "a")], "doc_id long, text string")
    model = language_id.train(language_id.labelled_rows(train))
    got = language_id.predict(odd.selectExpr("*", "'x' as lang_pred", "1 as score"), model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == 3
    assert {r.lang_pred for r in got if r.doc_id is None} == {"en"} and language_id.predict(odd.limit(0), model).count() == 0
    nothing = language_id.train(language_id.labelled_rows(train.limit(0)))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_language_of_one_labelled_row(spark):
    """Whether the row falls to the fit or to the temperature."""
    falls = {r.id: r.c for r in spark.range(1, 60).selectExpr("id", "pmod(hash(id, 1), 1000) < 250 c").collect()}
    for want in (True, False):
        i = next(i for i, c in falls.items() if c == want)
        df = spark.createDataFrame([(i, "the cat", "en")], "id long, text string, lang string")
        model = language_id.train(df)
        out = language_id.predict(df.selectExpr("id doc_id", "text", "1 as logits", "2 as has", "3 as _row"), model)
        assert out.columns == ["doc_id", "logits", "has", "_row", "lang_pred", "score"] and [r.lang_pred for r in out.collect()] == ["en"]


def test_the_sample_is_bounded_however_often_rows_repeat(spark, monkeypatch):
    kept = []
    inner = language_id.stage
    monkeypatch.setattr(language_id, "stage", lambda df, name: kept.append(inner(df, name)) or kept[-1])
    same = spark.range(20_000).selectExpr("cast(7 as long) as id", "'the same text' as text", "'en' as lang")
    language_id.train(same, sample_docs=100)
    assert max(df.count() for df in kept if "calibrate" in df.columns) <= 100
    kept.clear()
    many = spark.range(60).selectExpr("id", "concat('text ', id) as text", "concat('l', id % 30) as lang")
    model = language_id.train(many, sample_docs=10)
    assert max(df.count() for df in kept if "calibrate" in df.columns) <= 10 and len(model.langs) == 30


def test_elastic_net_makes_sparse_weights():
    rng = np.random.default_rng(0)
    samples = [(np.array([label, 2 + int(rng.integers(0, 500))]), np.array([1.0, 0.01]), label) for label in rng.integers(0, 2, 400).tolist()]
    w, bias = language_id.fit(samples, 2)
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[600:] == 0).all()
    assert (w != 0).sum() < 2 * 502


def fold(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x)


def test_lm_base_is_brute_force_and_the_model_beats_it(spark):
    out = lm_scoring.op8_lm_scoring(spark, SF).collect()
    tok = {r.doc_id: [fold(x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] + ["\n"] for r in docs(spark).collect()}
    c = Counter(x for d, ts in tok.items() if not held(d, 10) for x in ts)
    total = sum(c.values())
    log_all = math.log10(total + 0.1 * (len(c) + 1))
    assert len(out) == len(tok)
    for r in out:
        ts = tok[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), len(ts), sum(c[x] > 0 for x in ts), total)
        assert r.base_score == pytest.approx(sum(math.log10(c[x] + 0.1) - log_all for x in ts), rel=1e-9)
    tests = [r for r in out if r.held_out]
    gain = sum(r.score - r.base_score for r in tests) / sum(r.n_tokens for r in tests)
    assert gain > 0.15  # log10 for each held-out word


def test_tail_words_are_joined(spark, monkeypatch):
    """With a tiny head most words take the way through the join, with equal results."""
    df = docs(spark).limit(60).select("doc_id", "text")
    learn = lm_scoring.in_training(df.doc_id)
    want = {r.doc_id: r for r in lm_scoring.score(df, learn).collect()}
    monkeypatch.setattr(lm_scoring, "HEAD", 50)
    monkeypatch.setattr(lm_scoring, "VOCABULARY", 20)
    for r in lm_scoring.score(df, learn).collect():
        assert r.base_score == pytest.approx(want[r.doc_id].base_score, rel=1e-9) and r.n_known == want[r.doc_id].n_known


def test_lm_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a " * 50_000), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as row", "1 as n", "2 as n_tokens", "3 as key", "4 as ids", "5 as _row", "6 as tail_log")
    out = lm_scoring.score(df, lm_scoring.in_training(df.doc_id))
    assert out.columns == ["doc_id", "row", "n", "key", "ids", "_row", "tail_log", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out = out.collect()
    assert {(r.row, r.n, r.key, r.ids) for r in out} == {(7, 1, 3, 4)}
    assert sorted(r.n_tokens for r in out) == [1, 1, 2, 2, 3, 50_001] and all(r.score <= 0 and math.isfinite(r.score) for r in out)
    assert lm_scoring.score(df.limit(0), lm_scoring.in_training(df.doc_id)).count() == 0
    none = lm_scoring.score(df, lm_scoring.F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in none)


def test_same_model_for_any_layout_and_all_documents_are_learned_from(spark, monkeypatch):
    """Trainers of few words, so that parameters are averaged in a tree of several levels."""
    monkeypatch.setattr(lm_scoring, "FAN", 3)
    df = docs(spark).where("doc_id < 400").select("doc_id", "text")
    seen = []
    learn = gru.Gru.learn
    score = lm_scoring.train
    for layout in (df.repartition(1), df.repartition(7, "text")):
        counts = lm_scoring.word_counts(layout.select("text"))
        lex = lm_scoring.lexicon(counts)
        rows = lm_scoring.coded_rows(layout.select(lm_scoring.F.xxhash64("doc_id", "text").alias("key"), "text"), lex)
        assert rows.agg({"n_tokens": "sum"}).first()[0] == lex.total
        seen.append(score(rows.select("key", "ids"), lex, trainer_tokens=20_000).flat())
    assert np.array_equal(*seen) and learn is gru.Gru.learn
    assert sorted(x for r in lm_scoring.ROUNDS for x in r) == list(range(16))  # every document is in one round


def model(n=100):
    rng = np.random.default_rng(2)
    return gru.Gru.start(np.sort(rng.integers(1, 50, n))[::-1].astype(float), 20.0)


def test_probabilities_sum_to_one():
    m = model()
    h = np.random.default_rng(1).normal(0, 0.5, (1, gru.HIDDEN + 1)).astype(np.float32)
    h[:, gru.HIDDEN] = 1
    targets = np.arange(101)  # the last stands for all other words
    total = np.exp(m.log_probs(np.repeat(h, 101, axis=0), targets)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_state_is_carried_through_whole_texts():
    m = model()
    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 32, 33, 200, 700]
    ids = rng.integers(0, 101, sum(sizes))
    bounds = np.append(0, np.cumsum(sizes))
    want = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h, total, last = np.zeros((1, gru.HIDDEN), np.float32), 0.0, m.size + 1
        for word in ids[a:b]:
            h = m.advance(h, m.p["inputs"][[last]])[0]
            total += m.log_probs(np.append(h, [[np.float32(1)]], axis=1), np.array([word]))[0]
            last = word
        want.append(total)
    assert m.score(ids, bounds) == pytest.approx(want, abs=1e-2)


def test_gradients_are_those_of_the_loss(monkeypatch):
    """Every gradient that a window yields against differences of the loss, and words in a fixed order are learned."""
    m = model(100)
    for k in ("classes", "words"):  # larger weights than at the start, so that states matter
        m.p[k][..., : gru.HIDDEN, :] *= 20
    rng = np.random.default_rng(5)
    ids = rng.integers(0, 101, 60)
    bounds = np.array([0, 25, 25, 60])  # windows of 25 and 32 words, and one of 3 behind
    grads = {}
    monkeypatch.setattr(m, "_move", lambda name, at, g, memory: grads.setdefault(name, []).append((at, g.copy())))
    m._learn_window(ids, np.array([25, 0]), np.array([57, 25]), np.array([25, 0]), np.zeros((2, gru.HIDDEN), np.float32), m.memory())
    whole = {k: np.zeros(v.shape) for k, v in m.p.items()}
    for k, parts in grads.items():
        for at, g in parts:
            whole[k][at] += g
    loss = lambda: -m.score(ids[:57], np.array([0, 25, 57])).sum() / 57
    for k, v in m.p.items():
        flat, g = v.reshape(-1), whole[k].reshape(-1)
        for i in [*np.argsort(-np.abs(g))[:6], *rng.integers(0, len(flat), 4)]:
            was, step = flat[i], np.float32(2e-2)
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert g[i] == pytest.approx((up - down) / (2 * step), abs=1e-4, rel=0.02), (k, i)
    m = model(20)
    ids = np.tile(np.arange(10), 200)
    bounds, memory = np.array([0, len(ids)]), m.memory()
    before = m.score(ids, bounds)[0]
    for _ in range(60):
        assert m.learn(ids, bounds, memory) == len(ids)
    assert m.score(ids, bounds)[0] > 0.2 * before
