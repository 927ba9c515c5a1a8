"""What may not be built on the driver."""

import itertools
import random
import re

from galleyspark.llm import near_dups


def test_wide_and_exploded_sides_are_never_broadcast(spark, monkeypatch):
    """Spark takes them for small however large they are: no table of lists, and nothing that an explode makes without a shuffle behind it, is built on the driver."""
    rng, plans = random.Random(3), []
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    texts = []
    for i in range(60):
        words = list(base) if i % 2 else [f"v{rng.randrange(900)}" for _ in range(60)]
        for _ in range(i // 2 % 9):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        texts.append((i, " ".join(words)))
    kept = near_dups.settle
    monkeypatch.setattr(near_dups, "settle", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, *a))
    assert near_dups.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 2).count() == 60
    lists, wide = ("sig#", "s#", "d#", "e#", "near_list#", "token#"), []
    for plan in plans:
        lines = plan.splitlines()
        for k, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = line.index("BroadcastExchange")
                below = list(itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-")) > depth - 2 and "Exchange" not in x, lines[k + 1 :]))
                wide += [x for x in below if "Generate" in x or "FileScan" in x and any(re.search(rf"[\[,]{name}", x.split("Batched")[0]) for name in lists)]
    assert len(plans) > 10 and not wide
