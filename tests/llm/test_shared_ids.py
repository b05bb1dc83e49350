import random

import corpus_pipeline

from .helpers import DOCS, frame, prose


def test_rows_without_or_with_one_id_go_only_for_near_copies(spark):
    rng = random.Random(3)
    texts = [prose(rng, 80) for _ in range(10)]
    rows = [(None, t, "en", "s", 1) for t in texts[:4]] + [(7, t, "en", "s", 1) for t in texts[4:7]]
    rows += [(k, t, "en", "s", 1) for k, t in enumerate(texts[7:], 20)]
    copies = [(None, texts[4], "en", "s", 1), (None, texts[0], "en", "s", 1), (7, texts[5], "en", "s", 1), (8, texts[6], "en", "s", 1), (3, texts[9], "en", "s", 1), (None, texts[1], "de", "s", 1)]
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, rows + copies, DOCS), "").collect()
    assert sorted(r["text"] for r in got) == sorted(texts)
    ids = {r["text"]: r["doc_id"] for r in got}
    assert [ids[t] for t in texts] == [None] * 4 + [7] * 3 + [20, 21, 3]
