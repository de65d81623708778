"""The language model: counts and base by force, probabilities that add up, gradients, carried state, odd rows."""

import math
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from figcorpus.llm import recurrent_lm as lm
from figcorpus.llm.common import QUERIES, table

MID = "/root/testdata/sf0.01"
SMALL = lm.Settings(own_words=30, endings=8, listed=50, lanes=8, warm_lanes=8, warm_rows=50, every=1)


def small_net(k=23, seed=1):
    net = lm.Net.fresh(np.arange(k, 0, -1).astype(float) * 10, lm.Settings(embedding=5, hidden=6, seed=seed))
    rng = np.random.default_rng(seed)
    return net.filled(net.flat() + rng.normal(0, 0.3, net.flat().size))


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def by_force(net, ids):
    """One document, one token at a time, in double precision; all classes and all their outputs are summed."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    h, state, before, total = net.h, np.zeros(net.h), 0, 0.0
    for target in ids:
        a, s = w["e"][before] @ w["x"] + w["b"], state @ w["u"]
        z, r = sigmoid(a[:h] + s[:h]), sigmoid(a[h : 2 * h] + s[h : 2 * h])
        new = np.tanh(a[2 * h :] + r * s[2 * h :])
        state = (1 - z) * new + z * state
        p = np.zeros(len(w["e"]))
        of_class = np.exp(state @ w["c"] + w["cb"])
        of_class /= of_class.sum()
        for k in range(len(of_class)):
            lo, hi = net.starts[k], net.starts[k + 1]
            inside = np.exp(w["o"][lo:hi] @ state + w["ob"][lo:hi])
            p[lo:hi] = of_class[k] * inside / inside.sum()
        assert p.sum() == pytest.approx(1)
        total, before = total + math.log(p[target]), target
    return total


def test_documents_score_as_by_force_whatever_the_lanes():
    net, rng = small_net(), np.random.default_rng(3)
    docs = [np.append(rng.integers(1, 23, n), 0) for n in (0, 1, 5, 40, 200, 7, 0, 90)]
    want = [by_force(net, d) for d in docs]
    for lanes, window in ((1, 64), (3, 4), (64, 16)):
        assert np.allclose(lm.doc_log_probs(net, docs, lanes, window), want, rtol=1e-4)


def test_gradients_are_those_of_the_loss():
    net, rng = small_net(), np.random.default_rng(4)
    docs = [np.append(rng.integers(1, 23, n), 0) for n in (9, 4, 3)]
    ids, targets, keep, active, _, _ = next(lm.windows(docs, 2, 16))
    state = np.zeros((ids.shape[1], net.h), np.float32)
    _, grads, _ = net.gradients(ids, targets, keep, active, state)
    flat = net.flat().astype(float)

    def loss(x):
        return net.filled(x).gradients(ids, targets, keep, active, state)[0]

    at = 0
    for k in sorted(net.w):
        g = grads[k]
        full = np.zeros(net.w[k].shape)
        if isinstance(g, tuple):
            full[g[0]] = g[1]
        else:
            full = g
        for i in rng.choice(full.size, min(8, full.size), replace=False):
            step = np.zeros_like(flat)
            step[at + i] = 1e-2
            measured = (loss(flat + step) - loss(flat - step)) / 2e-2
            assert measured == pytest.approx(full.ravel()[i], abs=3e-3)
        at += full.size


def test_learning_lowers_the_loss():
    net, rng = small_net(), np.random.default_rng(5)
    docs = [np.append(np.tile([3, 7, 11], 20), 0) for _ in range(40)] + [np.append(rng.integers(1, 5, 30), 0)]
    trainer = lm.Trainer(net, 0.1)
    first = trainer.learn(docs, 8, 16)
    for _ in range(10):
        last = trainer.learn(docs, 8, 16, every=2)
    assert last < 0.3 * first and trainer.seen == 11 * sum(map(len, docs))


def odd_docs(spark):
    rows = [
        (1, "", "a"), (2, None, None), (3, " \n\t ", "a"), (3, " \n\t ", "a"), (None, "Some words HERE", "b"), (4, "word " * 3000, "c"),
        (5, "The cat sat. " * 9, "a"), (6, "THE CAT sat. " * 9, "a"), (6, "THE CAT sat. " * 9, "a"), (7, "12345 \x85 x \U0001f600 é É", "z"),
        (8, "rare1 rare2 rare3", "z"), (9, "never seen before", "q"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string")


def base_by_force(rows, held):
    """(n_tokens, n_known, train_tokens, base_score) of every row, counting the rows that are not held out."""
    words = [(t or "").encode().lower().split() + [None] for t in rows]
    counts = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for ws in words]


@pytest.mark.parametrize("listed, own", [(50, 30), (0, 0), (3, 3)])
def test_base_scores_and_counts_of_odd_rows(spark, listed, own):
    docs = odd_docs(spark).withColumn("held_out", F.coalesce(F.col("doc_id") == 9, F.lit(False)))
    settings = lm.Settings(**{**SMALL.__dict__, "listed": listed, "own_words": own})
    got = lm.score(docs, lm.fit(docs.where("not held_out"), settings)).collect()
    rows = docs.collect()
    want = base_by_force([r.text for r in rows], [r.held_out for r in rows])

    def key(r):
        return (r[0] is not None, r[0] or 0, r[1:3], r[3])

    have = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got), key=key)
    for a, b in zip(have, sorted(((r.doc_id, w[0], w[1], w[3]) for r, w in zip(rows, want)), key=key)):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert {r.train_tokens for r in got} == {want[0][2]}
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_model_of_nothing_and_scores_of_nothing(spark):
    docs = odd_docs(spark).withColumn("held_out", F.lit(True))
    none = lm.fit(docs.where("false"), SMALL)
    got = lm.score(docs, none).collect()
    assert len(got) == docs.count() and all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm.score(docs.where("false"), none).count() == 0


def test_words_within_an_ending_share_its_probability():
    """Over all words that training has seen, and one unseen of each ending, probabilities add up to one."""
    counts = {b"aa": 5, b"baa": 2, b"caa": 1, b"dd": 3, b"edd": 1}
    own = [b"aa", b"dd"]
    shared = Counter()
    for w, n in counts.items():
        if w not in own:
            shared[lm.ending(w, 4)] += n + 1
    for k, total in shared.items():
        seen = sum((n + 1) / (total + 1) for w, n in counts.items() if w not in own and lm.ending(w, 4) == k)
        assert seen + 1 / (total + 1) == pytest.approx(1)


def test_frequent_words_stay_within_their_number(spark):
    counts = spark.createDataFrame([(f"w{i}", 1 + i // 10) for i in range(1000)], "word string, n bigint")
    got = lm.most_frequent(counts, 100)
    assert 50 < len(got) <= 100 and got == sorted(got, key=lambda x: (-x[1], x[0])) and got[0][1] == 100
    assert lm.most_frequent(counts.where("false"), 10) == []


def test_the_model_beats_the_base_on_held_out_documents(spark):
    got = QUERIES["op11_lm_scoring"](spark, MID).toPandas()
    docs = table(spark, MID, "documents").toPandas()
    assert len(got) == len(docs) and set(got.doc_id) == set(docs.doc_id)
    held = got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    assert (held == got.held_out).all()
    want = base_by_force(docs.text.tolist(), docs.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 7 == 2).tolist())
    by_id = dict(zip(docs.doc_id, want))
    for r in got.itertuples():
        n, known, total, base = by_id[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and r.base_score == pytest.approx(base, rel=1e-9)
    out = got[got.held_out]
    assert out.score.sum() / out.n_tokens.sum() > out.base_score.sum() / out.n_tokens.sum() + 0.2


def test_every_place_is_learned_from(monkeypatch):
    """With the settings of the query no window of a document is passed by."""
    s = lm.Settings()
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 20, n) for n in (1, 5, 700, 1300, 40)]
    taken = []
    gradients = lm.Net.gradients
    monkeypatch.setattr(lm.Net, "gradients", lambda self, ids, targets, keep, active, state: (taken.append(active.sum()), gradients(self, ids, targets, keep, active, state))[1])
    trainer = lm.Trainer(lm.Net.fresh(np.ones(20), s), s.rate)
    trainer.learn(docs, s.lanes, s.window, s.every)
    assert sum(taken) == sum(map(len, docs)) == trainer.seen


def test_tasks_hold_little_besides_the_text():
    """Counting, learning's ids and lanes, and scoring stay within a few times a batch's text."""
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 40_000, 1500)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "held_out": [False] * 500, "text": texts})
    size = sum(map(len, texts))
    s = lm.Settings()
    net = lm.Net.fresh(np.ones(21), s)
    model = lm.Model(s, net, {b"w1": 1}, np.zeros(21), [b"w1"], np.zeros(1), np.zeros(s.endings), np.arange(s.endings) % 20 + 1, 9, 9, 9)

    def lanes():
        for w in lm.windows(lm._encoded(batch, lm._Outputs(model)), 8, 16):
            yield w
            return

    def peak(made):
        tracemalloc.start()
        for _ in made:
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most / size

    with pytest.MonkeyPatch.context() as m:
        m.setattr(lm, "HELD", 5000)
        m.setattr(lm, "PIECE", 200_000)
        m.setattr(lm, "doc_log_probs", lambda net, docs, lanes: np.zeros(len(docs)))
        assert peak(lm._counts(iter([batch]))) < 0.8
        assert peak(lanes()) < 3.5
        assert peak(lm._scored(SimpleNamespace(value=model))(iter([batch]))) < 4


def test_pieces_of_a_batch_score_as_the_whole(spark, monkeypatch):
    docs = odd_docs(spark).withColumn("held_out", F.coalesce(F.col("doc_id") == 9, F.lit(False)))
    model = lm.fit(docs.where("not held_out"), lm.Settings(**{**SMALL.__dict__, "listed": 3, "own_words": 3})).local()
    rows = docs.select("doc_id", "held_out", "text").toPandas()
    batch = pa.RecordBatch.from_arrays(
        [pa.array(rows.doc_id, pa.int64(), from_pandas=True), pa.array(rows.held_out.tolist()), pa.array(rows.text.tolist(), pa.string(), from_pandas=True)],
        ["doc_id", "held_out", "text"],
    )

    def scored():
        return pa.Table.from_batches(lm._scored(SimpleNamespace(value=model))(iter([batch]))).to_pylist()

    whole = scored()
    monkeypatch.setattr(lm, "PIECE", 20)
    assert len(list(lm._pieces(batch.column("text")))) > 3 and scored() == whole and len(whole) == len(rows)
    monkeypatch.setattr(lm, "HELD", 2)
    outputs = lm._Outputs(model)
    assert len(lm._encoded(batch, outputs)) == len(rows) and len(outputs) <= len(model.ids) + 2 + 3


def test_words_and_endings_are_those_of_the_bytes():
    texts = ["", None, " ", "\n\t", " a  B a ", "\x0bA\x0c\x1c b\x85c", "İ É 　x " + "".join(map(chr, range(1, 256))), "a b c a"]
    column = pa.array(["cut off", *texts], pa.string())[1:]
    codes, lengths, words = lm.coded(column)
    want = [(t or "").encode().lower().split() for t in texts]
    assert [words[c].as_py() for c in codes.tolist()] == sum(want, []) and lengths.tolist() == list(map(len, want))
    assert lm.endings_of(words, 97).tolist() == [lm.ending(w, 97) for w in words.to_pylist()]
    assert [x.tolist() for x in lm.with_ends(codes + 1, lengths)] == [[1 + words.to_pylist().index(w) for w in ws] + [0] for ws in want]


def test_counts_of_a_task_add_up_however_few_are_held(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [" ".join(f"W{n}" for n in rng.integers(0, 300, 60)) + " " for _ in range(50)] + [None, " "]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    want = Counter(w for t in texts for w in (t or "").lower().split())
    for held, piece in ((100_000, 4_000_000), (20, 500), (1, 1)):
        monkeypatch.setattr(lm, "HELD", held)
        monkeypatch.setattr(lm, "PIECE", piece)
        told, times = Counter(), 0
        for out in lm._counts(iter([batch, batch])):
            times += 1
            told.update(dict(zip(out["word"].to_pylist(), out["n"].to_pylist())))
        assert told == {w: 2 * n for w, n in want.items()} and (times > 1) == (held < 100)


def test_the_work_of_a_window_is_not_done_class_by_class(monkeypatch):
    """Exponentials are taken of all classes' logits at once, in learning and in scoring."""
    net, rng, calls = small_net(400), np.random.default_rng(7), []
    docs = [np.append(rng.integers(1, 400, 300), 0) for _ in range(8)]
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **b: (calls.append(1), exp(*a, **b))[1])
    ids, targets, keep, active, _, _ = next(lm.windows(docs, 8, 4))
    net.gradients(ids, targets, keep, active, np.zeros((8, net.h), np.float32))
    assert len(net.starts) > 15 and len(calls) <= 2 + 4
    calls.clear()
    lm.doc_log_probs(net, docs, 8, 301)
    assert len(calls) <= 301 + 1 + math.ceil(8 * 301 / lm.BLOCK)


def test_large_logits_stay_finite():
    net, rng = small_net(), np.random.default_rng(8)
    net = net.filled(net.flat() * 60)
    docs = [np.append(rng.integers(1, 23, n), 0) for n in (9, 40, 0)]
    assert not net.small()
    ids, targets, keep, active, _, _ = next(lm.windows(docs, 2, 64))
    loss, grads, state = net.gradients(ids, targets, keep, active, np.zeros((2, net.h), np.float32))
    parts = [g[1] if isinstance(g, tuple) else g for g in grads.values()]
    assert math.isfinite(loss) and all(np.isfinite(x).all() for x in [state, *parts])
    hidden = rng.uniform(-1, 1, (20, net.h)).astype(np.float32)
    every = [net.log_probs(hidden, np.full(20, k)) for k in range(23)]
    assert np.exp(np.array(every, float)).sum(axis=0) == pytest.approx(np.ones(20), rel=1e-3)
