import numpy as np
import pytest
from imgframe.llm.queries import op9_toxicity
from imgframe.llm.toxicity import PLACES, counterfactuals, fit_on_documents, fit_toxicity, fit_weights, objective, score_toxicity, words_of

from tests.conftest import DATA

SF01 = str(DATA).replace("sf0.001", "sf0.1")


def auc(y, s):
    rank = s.argsort().argsort()
    return (rank[y == 1].sum() - y.sum() * (y.sum() - 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    """Labels of held-out rows are not learnt from; scores order them well."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = [r for r in op9_toxicity(spark, SF01).collect() if r.held_out and labels.get(r.doc_id) is not None]
    y, s = np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows])
    assert len(rows) > 500 and auc(y, s) > 0.95
    assert np.mean([(r.score >= 0.5) == bool(r.predicted) for r in rows]) == 1
    assert np.mean((s >= 0.5) == y) > 0.95


def texts(n):
    """Insults are toxic; neutral mentions of one group happen to stand in more toxic texts."""
    for i in range(n):
        toxic = i % 2
        group = "muslim" if i % 20 < 13 and toxic else "christian" if i % 3 == 0 else ""
        yield f"the {group} neighbour number{i % 17} said {'idiot' if toxic and i % 4 == 1 else 'thing' + str(i % 5)} today", toxic


def test_swapped_terms_move_scores_less(spark):
    rows = spark.createDataFrame(list(texts(600)), "text string, toxic int")
    pair = ["my muslim friend came", "my christian friend came"]
    gap = {}
    for fairness in (0.0, 10.0):
        s = fit_toxicity(rows, fairness=fairness).scores(pair)
        gap[fairness] = abs(s[0] - s[1])
    assert gap[10.0] < gap[0.0] / 2


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "", 5), (None, "an idiot", 5), (4, "word " * 200_000, 5)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    out = score_toxicity(docs, fit_on_documents(docs, labels))
    assert out.columns == ["doc_id", "text", "score", "predicted"]
    assert out.count() == 5 and all(0 <= r.score <= 1 for r in out.collect())
    empty = fit_on_documents(docs.limit(0), labels.limit(0))
    assert score_toxicity(docs.limit(0), empty).count() == 0
    assert empty.scores(["x"])[0] == pytest.approx(0.5)


def test_counterfactuals_in_the_registered_fit(spark):
    """Every labelled document gives pairs, though none names a group; the penalty moves the weights of terms."""
    docs, labels = (spark.read.parquet(f"{SF01}/{n}.parquet") for n in ("documents", "labels"))
    fair, unfair = (fit_on_documents(docs, labels, sample_rows=1_500, fairness=f) for f in (1.0, 0.0))
    assert fair.pairs == unfair.pairs >= 1_500
    terms = [f"she met a {t} today" for t in PLACES]
    spread = lambda model: np.ptp(model.scores(terms))
    assert 0 < spread(fair) < spread(unfair) / 2


def test_counterfactual_sentences():
    pairs, plus, minus = counterfactuals("A muslim came. It rained! Two jews, one muslim")
    assert len(pairs) == 2 and all(len(a) == len(b) and a != b and (a ^ b) <= set(PLACES) for a, b in pairs)
    assert minus == {"muslim", "jews"} and len(plus) == 2
    (a, b), = counterfactuals("It rained. The sun was not seen there")[0]
    assert a - b and b - a and (a ^ b) <= set(PLACES) and a & b == words_of("The sun was not seen there")
    assert counterfactuals(None) == counterfactuals("") and len(counterfactuals("")[0]) == 1


@pytest.mark.parametrize("fairness", [0.0, 0.5, 20.0])
def test_the_optimiser_against_newton_steps(fairness):
    """On small problems the weights are those that Newton's method on the definition gives."""
    rng = np.random.default_rng(2)
    n, m = 80, 12
    x = (rng.random((n, m)) < 0.3).astype(float)
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=m))))).astype(float)
    change = lambda: ([int(i) for i in rng.choice(m // 2, 2, replace=False)], [int(i) for i in m // 2 + rng.choice(m // 2, 1)])
    variants, pairs = [change() for _ in range(n)], [change() for _ in range(n)]
    dense = lambda changes: np.array([[(i in a) * 1.0 - (i in b) for i in range(m)] for a, b in changes])
    both, d = np.hstack([np.vstack([x, x + dense(variants)]), np.ones((2 * n, 1))]), np.hstack([dense(pairs), np.zeros((n, 1))])
    ridge = np.diag([1.0] * m + [0.0]) / n
    theta = np.zeros(m + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-both @ theta))
        slope = both.T @ (p - np.tile(y, 2)) / (2 * n) + ridge @ theta + 2 * fairness / n * d.T @ (d @ theta)
        theta -= np.linalg.solve((both.T * (p * (1 - p))) @ both / (2 * n) + ridge + 2 * fairness / n * d.T @ d, slope)
    own = [[int(i) for i in np.flatnonzero(r)] for r in x]
    w, b = fit_weights(own, variants, pairs, y, m, 1.0, fairness, 5_000)
    assert np.allclose([*w, b], theta, atol=1e-3)
    assert objective(own, variants, pairs, y, m, 1.0, fairness)[0](w, b)[0] == pytest.approx(objective(own, variants, pairs, y, m, 1.0, fairness)[0](theta[:-1], theta[-1])[0], abs=1e-7)
