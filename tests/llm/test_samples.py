import pytest

from loomspark.llm import op3, op8


@pytest.fixture(scope="module")
def frames(spark):
    """Forty labelled documents, one of which repeats with 400 different texts."""
    texts = [(i, " ".join(f"{chr(97 + i % 26)}{chr(97 + j)}x {'plain' if i % 2 else 'vile'} {'kind' if i % 2 else 'horrid'} {'garden' if i % 2 else 'awful'}" for j in range(10))) for i in range(40)]
    texts += [(7, "a" * (1 + i % 9) + f" {i}") for i in range(400)]
    labels = [(i, i % 2) for i in range(40)]
    return spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int")


def test_quality_learns_from_every_sampled_key(frames, monkeypatch):
    seen, train = [], op8.train
    monkeypatch.setattr(op8, "train", lambda x, count, label, **more: seen.append(sorted(label)) or train(x, count, label, **more))
    assert op8.fit(*frames, sample=40) is not None
    assert seen == [[0.0] * 20 + [1.0] * 20]


def test_toxicity_curve_learns_from_every_sampled_key(frames, monkeypatch):
    seen, logistic = [], op3.logistic
    monkeypatch.setattr(op3, "logistic", lambda x, y: seen.append(len(y)) or logistic(x, y))
    docs, labels = frames
    side = labels.selectExpr("sum(pmod(xxhash64(doc_id, 1), 2)) as n").first().n
    assert op3.fit(docs, labels, sample=10) is not None
    assert seen == [side]
