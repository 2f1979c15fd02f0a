"""Free-text ranking by whole benchmark texts, held against brute force."""

from __future__ import annotations

import math
from collections import Counter

from sieveline import catalog


def test_terms_after_the_twelfth_count(spark, tmp_path):
    texts = ["one two three", "late words here", "late late one", "other things", "more other things", "nothing at all"]
    asked = " ".join(f"x{i}" for i in range(12)) + " late words one"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, asked)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tf = [Counter(t.split()) for t in texts]
    df = Counter(w for t in tf for w in t)
    raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    mean = sum(map(lambda t: t.total(), tf)) / len(tf)
    score = [sum(idf[w] * t[w] * 2.5 / (t[w] + 1.5 * (0.25 + 0.75 * t.total() / mean)) for w in asked.split() if w in t) for t in tf]
    want = [(str(7), d, round(score[d], 6), k + 1) for k, d in enumerate(sorted(range(len(texts)), key=lambda d: (-round(score[d], 9), d)))]
    got = catalog.queries()["free_text_topk"](spark, str(tmp_path)).collect()
    assert sorted(((r.qid, r.ordinal, round(r.score, 6), r.rank) for r in got), key=lambda r: r[3]) == want
