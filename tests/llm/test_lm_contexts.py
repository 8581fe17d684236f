import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidewright.llm import lm_score
from tidewright.llm.common import utf8


def code_of(word):
    """The code of a word, or of the end (None)."""
    codes = lm_score.Tokens(*utf8(pa.array([word or ""]))).codes()
    return int(codes[0])


@pytest.mark.parametrize("bucket", [50, lm_score.BUCKET_KEYS])
def test_every_context_of_the_training_texts_counts(spark, monkeypatch, bucket):
    monkeypatch.setattr(lm_score, "BUCKET_KEYS", bucket)  # keys in many buckets, and in one
    monkeypatch.setattr(lm_score, "FREQUENT", 3)  # most words' counts come from buckets
    rng = random.Random(5)
    kinds = [f"w{i}" for i in range(12)]
    texts = [(i, " ".join(rng.choice(kinds) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    texts += [(1, texts[1][1]), (200, texts[7][1]), (201, None), (202, "w1")]
    training = lambda i: i < 60
    follow, words = defaultdict(Counter), Counter()
    rows = [(i, (t or "").split()) for i, t in texts]

    def contexts(own):
        return [(tuple(own[max(0, k - 3) : k]), own[k] if k < len(own) else None) for k in range(1, len(own) + 1)]

    for i, own in rows:
        if training(i):
            words.update(own)
            for c, x in contexts(own):
                follow[c][x] += 1
    codes = {x: code_of(x) for x in [*kinds, None]}
    expected = Counter()
    for i, own in rows:
        hits = 0
        for c, x in contexts(own):
            n = follow.get(c, {})
            if sum(n.values()) > training(i):
                hits += x == min(n, key=lambda y: (-n[y], codes[y]))
        expected[i, len(own) + 1, hits, sum(w in words for w in own) + 1] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = lm_score.score(df, training=lm_score.F.col("doc_id") < 60).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_matched"], r["n_known"]) for r in found) == expected
    assert sum(hits for _, _, hits, _ in expected) > 300
