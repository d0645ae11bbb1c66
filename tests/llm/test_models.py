import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from conftest import lowered, words_of

from millrace.llm import gru, langid, lm


def test_language_on_held_out_documents(documents):
    rows = langid.identify(documents).collect()
    truth = {row["doc_id"]: (row["lang"], row["text"]) for row in documents.collect()}
    held = [row for row in rows if row["held_out"]]
    assert {row["doc_id"] for row in held} == {d for d in truth if crc32(str(d).encode()) % 5 == 0}
    judged = [row for row in held if any(c.isalpha() for c in truth[row["doc_id"]][1] or "")]
    assert np.mean([row["lang_pred"] == truth[row["doc_id"]][0] for row in judged]) > 0.9
    assert all(0 <= row["score"] <= 1 for row in rows)


def test_language_of_odd_rows(spark, odd, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    for row in rows:
        if row["doc_id"] in (1, 2, 5, 8):
            assert (row["lang_pred"], row["score"]) == ("und", 0.0)
    assert langid.identify(nothing).count() == 0
    unlabelled = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    assert tuple(langid.identify(unlabelled).first())[2:] == ("und", 0.0)


def test_a_small_language_beside_a_large_one_is_learned(spark, monkeypatch):
    rows = [(i, f"the river and the stone {i} walks over the house", "en") for i in range(20_000)]
    rows += [(50_000 + i, "żółć gęślą jaźń chrząszcz brzmi w trzcinie", "pl") for i in range(16)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.identify(frame, 20).filter("doc_id >= 50000").collect()
    assert len(found) == 16 and {row["lang_pred"] for row in found} == {"pl"}
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="more than 1 language"):
        langid.train(frame)


def test_prediction_reads_the_text_only(documents):
    model = langid.train(documents)
    shifted = documents.selectExpr("doc_id + 100000 as doc_id", "text", "'xx' as lang")
    one = {row["doc_id"]: row["lang_pred"] for row in langid.predict(documents, model).collect()}
    two = {row["doc_id"] - 100000: row["lang_pred"] for row in langid.predict(shifted, model).collect()}
    assert one == two


def test_elastic_net_keeps_weights_sparse(documents):
    model = langid.train(documents)
    used = np.count_nonzero(model.weights[:, :-1])
    assert 0 < used < 0.5 * model.weights.size


def test_temperature_lowers_the_loss():
    rows = [(int(i % 4 == 0), np.array([0]), np.array([1.0])) for i in range(40)]
    model = langid.Model(["a", "b"], np.ones(1), np.array([[4.0], [0.0]]))
    fitted = langid.fit_temperature(model, rows)
    assert fitted == pytest.approx(4 / math.log(3), rel=0.1)


def base_scores(texts):
    tokens = {doc: [*words_of(lowered(text)), None] for doc, text in texts.items()}
    counts = Counter()
    for doc, own in tokens.items():
        if crc32(str(doc).encode()) % 7 != 2:
            counts.update(own)
    total = sum(counts.values())
    return total, {
        doc: (len(own), sum(counts[t] > 0 for t in own), sum(math.log10((counts[t] + 1) / (total + len(counts) + 1)) for t in own))
        for doc, own in tokens.items()
    }


def test_scores_against_brute_force(documents, texts, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 2000)
    total, wanted = base_scores(texts)
    rows = lm.score_documents(documents).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert (row["n_tokens"], row["n_known"]) == wanted[row["doc_id"]][:2] and row["train_tokens"] == total
        assert row["base_score"] == pytest.approx(wanted[row["doc_id"]][2], rel=1e-9)
        assert row["held_out"] == (crc32(str(row["doc_id"]).encode()) % 7 == 2)
        assert row["score"] < 0


def test_score_odd_rows_and_empty(odd, nothing):
    rows = lm.score_documents(odd).collect()
    assert len(rows) == odd.count()
    assert all(row["n_tokens"] == 1 for row in rows if row["doc_id"] in (1, 2, 5))
    same = [tuple(row) for row in rows if row["doc_id"] == 3]
    assert same[0][:6] == same[1][:6] and same[0][6] == pytest.approx(same[1][6], rel=1e-5)
    assert lm.score_documents(nothing).count() == 0


def test_every_training_document_reaches_the_recurrent_model(spark, monkeypatch):
    trained, learned = lm._trained, []

    def spy(*arguments):
        learned.append(trained(*arguments))
        return learned[-1]

    monkeypatch.setattr(lm, "_trained", spy)
    ids = [None, *[i for i in range(1, 8) if crc32(str(i).encode()) % 7 != 2][:4]]
    for doc_id in ids:
        lm.score_documents(spark.createDataFrame([(doc_id, "one two " * 50)], "doc_id long, text string"))
    assert len(learned) == len(ids) and all(weights is not None for weights in learned)


def stream(seed, texts=60, words=50):
    """Texts in which every word tells the next."""
    draw = np.random.default_rng(seed)
    return [((draw.integers(1, 9) + np.arange(draw.integers(2, words))) % 8 + 1).astype(np.int32) for _ in range(texts)]


def test_untrained_model_is_the_unigram_model():
    counts = np.array([3.0, 5, 2, 7, 1, 4, 9, 6, 3])
    texts = stream(1, 5)
    found = gru.Model(counts, 4, 3).log_probabilities(texts, 2)
    assert found == pytest.approx([np.log(counts / counts.sum())[t].sum() for t in texts], rel=1e-5)


def test_lanes_and_windows_do_not_change_a_score():
    model = gru.Model(np.ones(9), 6, 4)
    gru.Trainer(model).read(stream(2))
    texts = stream(3) + [np.zeros(0, np.int32)]
    whole = model.log_probabilities(texts, 1, 1)
    for lanes, tokens in ((7, 13), (64, 16384)):
        assert model.log_probabilities(texts, lanes, tokens) == pytest.approx(whole, rel=1e-4)


def test_training_learns_what_follows_what():
    texts, held = stream(4, 400), stream(5)
    model = gru.Model(np.ones(9), 12, 4)
    before = model.log_probabilities(held).sum()
    trainer = gru.Trainer(model)
    for _ in range(6):
        trainer.read(texts, 8)
    assert model.log_probabilities(held).sum() > 0.4 * before


def test_probabilities_sum_to_one():
    model = gru.Model(np.ones(9), 6, 4)
    gru.Trainer(model).read(stream(6))
    start = np.array([3, 5], np.int32)
    chances = model.log_probabilities([np.append(start, np.int32(w)) for w in range(9)])
    assert np.exp(chances - model.log_probabilities([start])[0]).sum() == pytest.approx(1, rel=1e-4)


def test_gradients_against_differences():
    texts = stream(7, 4, 12)
    model = gru.Model(np.arange(1.0, 10), 5, 4)
    draw = np.random.default_rng(8)
    for name in model.SHAPES:
        value = model.parameters[name]
        model.parameters[name] = np.where(value > -1e8, value + draw.normal(0, 0.3, value.shape), value)
    dealt = gru.deal(texts, 2)
    width = dealt.tokens.shape[1]

    def run():
        return model._window(dealt, 0, len(dealt.tokens), np.zeros((width, 5)), np.zeros(width, np.int32), True)

    states, _, _, trail = run()
    words = [dealt.tokens[i, : len(s)] for i, s in enumerate(states)]
    gradients = {name: np.zeros(value.shape) for name, value in model.parameters.items()}
    _, back = model._scores(np.concatenate(states), np.concatenate(words), gradients)
    gru.Trainer(model)._backward(trail, states, back, gradients)

    def loss():
        return -model._scores(np.concatenate(run()[0]), np.concatenate(words), None)[0].sum()

    for name, gradient in gradients.items():
        flat = model.parameters[name].reshape(-1)
        for at in draw.choice(flat.size, min(6, flat.size), replace=False):
            if flat[at] > -1e8:
                held = flat[at]
                flat[at] = held + 1e-5
                up = loss()
                flat[at] = held - 1e-5
                down = loss()
                flat[at] = held
                assert gradient.reshape(-1)[at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-5)
