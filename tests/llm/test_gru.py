"""The recurrent model works on all words of a window at once, and its scores are a plain softmax's."""

import sys

import numpy as np
import pyarrow as pa

from millrace.llm import gru, lm


def test_softmax_runs_do_not_grow_with_the_classes(monkeypatch):
    calls = []
    plain = gru._log_softmax_at
    monkeypatch.setattr(gru, "_log_softmax_at", lambda x, at: calls.append(len(at)) or plain(x, at))
    model = gru.Model(np.ones(60), 4, 3)
    words = np.arange(60, dtype=np.int32)
    model._scores(np.ones((60, 4), np.float32), words, None)
    assert calls == [60, 60]


def test_scores_and_gradients_are_those_of_one_class_after_another():
    draw = np.random.default_rng(3)
    model = gru.Model(draw.integers(1, 50, 14), 5, 4)
    p = model.parameters
    for name in p:
        p[name] = (p[name] + np.where(p[name] > -1e8, draw.normal(0, 0.3, p[name].shape), 0)).astype(np.float32)
    words = draw.choice([0, 1, 2, 8, 9, 13], 40).astype(np.int32)
    hidden = draw.normal(0, 1, (40, 5)).astype(np.float32)
    gradients = {name: np.zeros_like(value) for name, value in p.items()}
    found, back = model._scores(hidden, words, gradients)
    wanted = {name: np.zeros(value.shape) for name, value in p.items()}
    for at, word in enumerate(words):
        group, inside, own = word // 4, word % 4, np.zeros(5)
        score = 0.0
        for weights, bias, place, name, part in (
            (p["class_weights"], p["class_bias"], group, "class", ...),
            (p["word_weights"][group], p["word_bias"][group], inside, "word", group),
        ):
            logits = hidden[at].astype(float) @ weights + bias
            chances = np.exp(logits - logits.max())
            chances /= chances.sum()
            score += np.log(chances[place])
            chances[place] -= 1
            wanted[f"{name}_weights"][part] += np.outer(hidden[at], chances)
            wanted[f"{name}_bias"][part] += chances
            own += weights @ chances
        assert abs(found[at] - score) < 1e-5 and np.allclose(back[at], own, atol=1e-5)
    for name in wanted:
        assert np.allclose(gradients[name], wanted[name], atol=1e-4), name


def test_tokens_are_split_and_hashed_as_columns():
    odd = ["Two  words\x0band\ttwo\r\nWORDS", None, "", " \n\x0c ", "\x1c żółć Ż\x00 ż", "Ab" * 40, "ab" * 40 + " " + "ab" * 39, "a a\x00 aaaaaaaa aaaaaaaab"]
    texts = [*odd, *(" ".join(f"{size * 'x'}{i}" for i in range(50)) for size in range(70))]
    tokens, numbers = lm.tokens_of(pa.array(["cut off", *texts]).slice(1))
    wanted = [[*(text or "").encode().lower().split(), b"\n"] for text in texts]
    assert numbers.tolist() == list(map(len, wanted))
    flat = [word for own in wanted for word in own]
    assert len(set(tokens.tolist())) == len(set(flat)) == len(set(zip(tokens.tolist(), flat, strict=True)))
    assert tokens[np.cumsum(numbers) - 1].tolist() == [lm.END] * len(texts)


def test_calls_do_not_grow_with_the_words():
    def calls(words):
        texts, seen = pa.array([" ".join(f"w{i}" for i in range(words))]), []
        sys.setprofile(lambda frame, event, _: seen.append(event) if "call" in event else None)
        try:
            tokens, _ = lm.tokens_of(texts)
            lexicon.places_of(tokens), lexicon.ids_of(tokens)
        finally:
            sys.setprofile(None)
        return len(seen)

    lexicon = lm.Lexicon([(lm.END, 5), (7, 3)], 9, 3)
    assert calls(20_000) == calls(200)
