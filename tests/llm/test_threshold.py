import numpy as np

from docweave.llm import repetition


def test_threshold_covers_rows_outside_the_sample():
    """No row with the rule's share of echoes scores below the threshold, whatever the sample held."""
    rng = np.random.default_rng(1)
    for seed in range(5):
        sample = rng.beta(1, 6, (400, 3))
        for columns, _ in repetition.FORESTS:
            forest = repetition.IsolationForest(sample[:, columns], seed=seed)
            other = rng.uniform(0, 1, (2000, len(columns)))
            other[:, 0] = 1 / 3 + other[:, 0] * 2 / 3
            assert forest.score(other).min() >= forest.least(0, 1 / 3) - 1e-9


def test_labels_choose_the_forest():
    rng = np.random.default_rng(2)
    rows = np.vstack([rng.beta(1, 9, (500, 3)), rng.uniform(0.6, 1, (20, 3))])
    labels = np.arange(520) >= 500
    marker = repetition.train(rows, labels)
    assert (marker.score(rows)[labels] >= marker.threshold).all()
    assert repetition.train(rows[:1], labels[:1]) is None


def test_echoes_hold_all_copies():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abcdefghijklmnopqrst"), n)) for n in range(1, 150)]
    texts += ["x y z " * 5, "one two three four five six seven eight nine " * 2, "a a b b c c", None, ""]
    w = repetition.words_of(texts)
    echo = repetition.statistics(w)[:, 0] * np.maximum(w.counts, 1)
    assert (repetition.copied(w) <= np.round(echo)).all()
