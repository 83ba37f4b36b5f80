"""Problem 8: passages that lie amid words of other items are candidates too."""

import random

from tallyard.llm import leak


def test_passages_between_other_items(spark):
    rng = random.Random(4)
    names = ["".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(4)) for _ in range(2000)]
    items = [rng.sample(names, 60) for _ in range(250)]
    docs, want = [], set()
    for n in range(400):
        k, at = n % 250, rng.randrange(41)
        p = items[k][at : at + 20]
        for j in rng.sample(range(20), 2):
            p[j] = "zzz"
        others = [w for _ in range(3) for w in items[(k + rng.randrange(1, 250)) % 250]]
        cut = rng.randrange(40, 80)
        docs.append((n, " ".join(others[:cut] + p + others[cut : cut + 60])))
        want.add((n, k))
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    i = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    found = {tuple(r) for r in leak.leaked_items(d, i).collect()}
    assert want <= found
