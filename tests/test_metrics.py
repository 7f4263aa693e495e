"""Metrics against direct Python computations (scikit-learn rules)."""

import math
from collections import Counter

from lexiflow.operators import metrics


def py_scores(y, p, k=3):
    present = sorted(set(y) | set(p))
    f1s, out = [], {}
    for c in range(k):
        tp = sum(1 for a, b in zip(y, p) if a == c and b == c)
        sup = sum(1 for a in y if a == c)
        pred = sum(1 for b in p if b == c)
        prec = tp / pred if pred else 0.0
        rec = tp / sup if sup else 0.0
        f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
        out[c] = (prec, rec, f1, sup)
        if c in present:
            f1s.append(f1)
    acc = sum(1 for a, b in zip(y, p) if a == b) / len(y)
    return acc, sum(f1s) / len(f1s), out


CASES = {
    "a": ([0, 0, 1, 1, 2, 2, 2, 1], [0, 1, 1, 1, 2, 0, 2, 2]),
    "b": ([0, 1, 2, 2, 2, 1], [1, 1, 2, 2, 1, 2]),  # never predicts class 0
    "c": ([1, 2, 2, 1], [1, 2, 2, 2]),  # class 0 absent everywhere
}


def _df(spark):
    rows = [(run, y, p) for run, (ys, ps) in CASES.items() for y, p in zip(ys, ps)]
    return spark.createDataFrame(rows, "run string, label int, pred int")


def test_accuracy_f1_report(spark):
    df = _df(spark)
    acc = {r.run: r.accuracy for r in metrics.accuracy(df).collect()}
    f1 = {r.run: r.f1_macro for r in metrics.f1_macro(df).collect()}
    rep = {(r.run, r.row): r for r in metrics.classification_report(df).collect()}
    for run, (y, p) in CASES.items():
        a, f, per = py_scores(y, p)
        assert abs(acc[run] - a) < 1e-6 and abs(f1[run] - f) < 1e-6
        assert abs(rep[(run, "macro avg")].f1 - f) < 1e-6
        assert rep[(run, "accuracy")].support == len(y)
        assert rep[(run, "부정")].support == per[0][3]


def test_confusion_matrix_dense(spark):
    df = _df(spark)
    cm = {(r.run, r.true_label): (r.pred_0, r.pred_1, r.pred_2) for r in metrics.confusion_matrix(df).collect()}
    for run, (y, p) in CASES.items():
        c = Counter(zip(y, p))
        for t in range(3):
            assert cm[(run, t)] == tuple(c.get((t, q), 0) for q in range(3))


def test_class_weights_and_loss(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (1,)], "label int")
    w = {r.label: r.weight for r in metrics.class_weights(df).collect()}
    assert w[0] == 4 / 3 and w[1] == 4 / 9 and math.isinf(w[2])
    sc = spark.createDataFrame([([2.0, 0.0, 0.0], 0), ([0.0, 1.0, 0.0], 1)], "scores array<double>, label int")
    ww = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 1.0)], "label int, weight double")
    got = metrics.weighted_log_loss(sc, weights=ww).first()

    def nll(s, y):
        m = max(s)
        return m + math.log(sum(math.exp(x - m) for x in s)) - s[y]

    l0, l1 = nll([2.0, 0.0, 0.0], 0), nll([0.0, 1.0, 0.0], 1)
    assert abs(got.weighted_log_loss - (2 * l0 + l1) / 3) < 1e-6
    assert abs(got.log_loss - (l0 + l1) / 2) < 1e-6


def test_select_best(spark):
    best = metrics.select_best(_df(spark)).first()
    scores = {run: py_scores(y, p)[1] for run, (y, p) in CASES.items()}
    assert best.best == max(sorted(scores), key=lambda r: scores[r])
