import random
import time
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallywise.llm import langid, learn, quality, toxicity
from tests.llm.helpers import documents

BODY = ("you stupid idiot pathetic loser scum trash and more words of plain text the cat sat on the mat " * 40).encode()


@pytest.fixture(scope="module")
def model():
    counts = np.zeros(toxicity.SYMBOLS ** 3)
    s = toxicity.BYTE_SYMBOL[np.frombuffer(BODY, np.uint8)]
    np.add.at(counts, s[:-2] * 784 + s[1:-1] * 28 + s[2:], 1)
    return toxicity.language_model(counts)


def all_paths(text, model, longest):
    """Every reading with its score, by walking the whole lattice."""
    out = [(0.0, "")]
    for options in toxicity.steps(text, longest):
        wide = []
        for part, gain in options:
            parts = [""]
            for c in part:
                parts = [p + x for p in parts for x in (toxicity.LETTERS if c == toxicity.MASK else c)]
            wide += [(p, gain) for p in parts]
        out = [(cost + gain, clean + p) for cost, clean in out for p, gain in wide]
    done = []
    for cost, clean in out:
        codes = [0, 0, *(0 if c == " " else toxicity.symbol(c) for c in clean), 0]
        done.append((cost + sum(model.logs[(a * 28 + b) * 28 + c] for (a, b), c in zip(pairwise(codes), codes[2:])), clean))
    return sorted(done, reverse=True)


@pytest.mark.parametrize("block", [2, 256])
def test_decoder_by_all_paths(model, monkeypatch, block):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = random.Random(4)
    for k in range(150):
        text = "".join(r.choice("abst1$0!.-@é") for _ in range(r.randint(1, 7)))
        at = r.randint(0, len(text))
        text = text[:at] + "*" * r.choice((0, 0, 1, 2)) + text[at:]
        every = all_paths(text, model, 1000)
        want = [(s, t) for s, t in every[:8] if s >= every[0][0] - toxicity.GAP]
        got = toxicity.decode(text, model, 8)
        score = {}
        for s, t in every:
            score[t] = max(s, score.get(t, -1e9))
        assert len(got) == len(want), text
        assert abs(score[got[0]] - want[0][0]) < 1e-6 and set(got) <= set(score), text
        best = [t for s, t in want if s > want[-1][0] + 1e-6]
        assert set(best) <= set(got), (text, got, want)


def test_long_runs_of_marks_never_mask_letters(model):
    for run in (3, model.longest, model.longest + 1, model.longest + 4):
        for text in ("scu" + "*" * run, "*" * run + "ab", "a" + "*" * run + "b"):
            wide = toxicity.Language(model.logs, model.table, 10 ** 6)
            if run > model.longest:
                assert toxicity.decode(text, model, 8) == toxicity.decode(text, wide, 8)
            assert toxicity.decode(text, model, 8)


def test_tokens_of_many_marks_take_no_time(model):
    start = time.perf_counter()
    for token in ("a" + "*" * 10000 + "b", "*" * 10000 + "a", "a*-1" * 500, "a" + "-" * 10000 + "b", "a" + "$" * 10000, "=" * 10000, "*" * 10000):
        toxicity.restored(token, model)
    assert time.perf_counter() - start < 2


def test_marks_at_the_ends_are_read(model):
    for typed, clean in (("scu*", "scum"), ("+rash", "trash"), ("+ra$h!!", "trash"), ("(at", "cat"), ("#more", "more"), ("cat.", "cat"),
                         ("stupid!!!", "stupid"), ("$$$tupid", "stupid"), ("m4+", "mat")):
        assert clean in toxicity.restored(typed, model), (typed, toxicity.restored(typed, model))
    assert "mat" not in toxicity.restored("12345", model) and toxicity.restored("$@+", model)
    assert toxicity.restored("***", model) == toxicity.restored("...", model) == toxicity.restored("1234", model) == []


def test_samples_hold_rare_labels_and_no_copies(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2000 == 7, "rare").otherwise("common").alias("label"),
                                     F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("text_hash"))
    got = learn.labelled_sample(rows, 500, 20).collect()
    assert len({r.doc_id for r in got}) == len(got) and 500 <= len(got) <= 530
    want = {r.doc_id for r in rows.where("label = 'rare' and text_hash >= 0").collect()}
    assert {r.doc_id for r in got if r.label == "rare"} == want and sum(r.doc_id % 3 == 0 for r in got) <= 1
    assert learn.labelled_sample(rows.limit(0), 500).count() == 0


def test_ftrl_is_the_plain_update():
    r = np.random.default_rng(3)
    rows = [(int(r.integers(3)), np.sort(r.choice(12, 4, replace=False)), r.integers(1, 4, 4)) for _ in range(60)]
    got, bias = learn.ftrl(rows, 12, 3, 2, alpha=0.2, beta=1.0, l1=0.1, l2=0.05)
    z, n, b, steps = np.zeros((12, 3)), np.zeros((12, 3)), np.zeros(3), np.ones(3)

    def weight(i, k):
        return 0.0 if abs(z[i, k]) <= 0.1 else -(z[i, k] - np.copysign(0.1, z[i, k])) / ((1 + n[i, k] ** 0.5) / 0.2 + 0.05)

    for _ in range(2):
        for label, at, x in rows:
            w = {(i, k): weight(i, k) for i in at for k in range(3)}
            e = np.exp([b[k] + sum(w[i, k] * v for i, v in zip(at, x)) for k in range(3)])
            p = e / e.sum() - (np.arange(3) == label)
            for i, v in zip(at, x):
                for k in range(3):
                    g = v * p[k]
                    z[i, k] += g - ((n[i, k] + g * g) ** 0.5 - n[i, k] ** 0.5) / 0.2 * w[i, k]
                    n[i, k] += g * g
            steps += p * p
            b -= 0.1 * p / np.sqrt(steps)
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(12)], atol=1e-4) and np.allclose(bias, b, atol=1e-4)


def test_temperature_is_the_best_of_its_steps():
    r = np.random.default_rng(5)
    labels = r.integers(0, 3, 200)
    logits = 6 * (np.eye(3)[labels] + r.normal(0, 0.8, (200, 3)))

    def loss(t):
        return -sum(v[k] / t - np.log(np.exp(v / t).sum()) for v, k in zip(logits, labels))

    got = learn.temperature(logits, labels)
    assert loss(got) <= min(loss(got * 1.2), loss(got / 1.2)) and learn.temperature(logits[:0], labels[:0]) == 1.0


def test_sgd_is_the_plain_update(monkeypatch):
    monkeypatch.setattr(quality, "BUCKETS", 30)
    r = np.random.default_rng(8)
    rows = [(int(r.integers(2)), np.sort(r.choice(30, 5, replace=False)), r.integers(1, 5, 5)) for _ in range(40)]
    got, const = quality.train(rows, seed=2)
    random_ = np.random.default_rng(2)
    v = random_.uniform(-1 / 16, 1 / 16, (30, 16)).astype(np.float32).astype(float)
    u, b, step = np.zeros((16, 2)), np.zeros(2), 0
    for _ in range(quality.EPOCHS):
        for i in random_.permutation(40):
            label, at, x = rows[i]
            rate = quality.RATE * (1 - step / (quality.EPOCHS * 40))
            step += 1
            mean = sum(v[f] * c for f, c in zip(at, x)) / x.sum()
            e = np.exp(mean @ u + b)
            g = e / e.sum() - (np.arange(2) == label)
            back = u @ g
            u -= rate * np.outer(mean, g)
            b -= 0.1 * rate * g
            for f, c in zip(at, x):
                v[f] -= rate * c / x.sum() * back * 5 ** 0.5
    assert np.allclose(got, v @ (u[:, 1] - u[:, 0]), atol=1e-4) and np.isclose(const, b[1] - b[0], atol=1e-4)


def test_scorers_beat_the_commonest_answer(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id", "left_semi").repartition(16, "doc_id")
    rows = toxicity.score_toxicity(spark, docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    caught, toxic = sum(r.predicted and r.toxic for r in rows), sum(r.toxic for r in rows)
    false = sum(r.predicted and not r.toxic for r in rows)
    print("toxicity", caught, toxic, false, len(rows))
    assert caught >= 0.75 * toxic and false <= 0.03 * len(rows)
    rows = quality.score_quality(spark, docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "quality").collect()
    poor = [r.predicted for r in rows if r.quality == 0]
    print("quality", sum(r.predicted == r.quality for r in rows), len(rows), poor.count(0), len(poor))
    assert poor.count(0) >= 0.9 * len(poor) and sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)


def test_a_rare_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(learn, "FLOOR", 300)
    rows = [(k, f"plain words number {k} and the cat sat on the mat {k % 7}", "en") for k in range(3000)]
    rows += [(3000 + k, f"žluťoučký kůň úpěl ďábelské ódy {k} příliš", "cs") for k in range(12)]
    docs = documents(spark, [(i, t) for i, t, _ in rows]).drop("lang").join(
        spark.createDataFrame([(i, lang) for i, _, lang in rows], "doc_id long, lang string"), "doc_id")
    got = {r.doc_id: r.lang_pred for r in langid.identify(spark, docs, sample=50).collect()}
    assert all(got[3000 + k] == "cs" for k in range(12)) and all(got[k] == "en" for k in range(3000))


def test_the_searches_agree(monkeypatch):
    """Few-state, remembered and whole backward searches find equally likely forms, whatever is masked where."""
    rnd = random.Random(11)
    model = toxicity.language_model(np.array([rnd.choice([0, 0, 1, 5, 90]) for _ in range(toxicity.SYMBOLS ** 3)], float))
    tokens = ["".join(rnd.choice("abcs013$!|+.-_,é4ae*") for _ in range(rnd.randint(1, 12))) + "*" * rnd.randint(0, 4) for _ in range(400)]

    def gains(ways):
        return sorted((gain + model.logs[(a * toxicity.SYMBOLS + b) * toxicity.SYMBOLS] for gain, a, b, _ in ways), reverse=True)[:8]

    for token in tokens:
        lattice, start = list(toxicity.steps(token, model.longest)), [(0.0, 0, 0, None)]
        whole = gains(toxicity.searched(start, lattice, model, 8))
        assert gains(toxicity.ended(start, lattice, model, 8)) == pytest.approx(whole)
        if not any(options[-1][0][:1] == toxicity.MASK for options in lattice):
            assert gains(toxicity.unmasked(lattice, model, 8)) == pytest.approx(whole)
    assert len(model.ends) <= toxicity.ENDS
    found = [toxicity.decode(token, model, 8) for token in tokens]
    monkeypatch.setattr(toxicity, "SHORT", 0)
    assert [sorted(f) for f in found] == [sorted(toxicity.decode(token, model, 8)) for token in tokens]
