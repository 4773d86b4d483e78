"""The similarity join on very many sets just below the limit, and on sets of all sizes around it against brute force."""

import random

from pyspark.sql import functions as F

from contactloom.llm import jaccard


def test_many_sets_just_below_the_limit(spark):
    base = " ".join(f"w{k}" for k in range(89))
    own = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda k: F.concat(F.lit("u"), "id", F.lit("x"), k)), " ")
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(base + " "), own).alias("text")).repartition(4)
    # 85 shingles of 107 in common: none of the 200 million pairs links
    assert jaccard.similar_groups(docs).where("doc_id <> component_id OR n_shingles <> 96").count() == 0


def test_sets_around_the_limit(spark):
    rng = random.Random(3)
    bases = [[f"b{j}w{k}" for k in range(n)] for j, n in enumerate((20, 45, 90, 160))]
    texts = []
    for _ in range(260):
        words = list(rng.choice(bases))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"r{rng.randrange(40)}"
        for _ in range(rng.choice((0, 0, 1, 3, 8, 15))):
            words.append(f"t{rng.randrange(6)}")
        texts.append(" ".join(words[rng.randrange(0, 6) :]))
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(docs).collect()}
    assert found == {k: (len(sets[k]), find(k)) for k in range(len(sets))}
    assert 10 < len(set(map(find, root))) < 200
