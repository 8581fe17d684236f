import random
import re

from tidewright.llm import minhash_dedup
from tidewright.llm.components import components

OFF = "spark.sql.adaptive.coalescePartitions.enabled"


def test_components_in_few_tasks(spark):
    """The labels, and that small tables don't make a task, and its files, for each of many shuffle partitions."""
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(200, -i) for i in range(1, 30)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    expected = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    sc, kept = spark.sparkContext, {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", OFF)}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set(OFF, "false")
        sc.setJobGroup("components", "")
        found = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        jobs = sc.statusTracker().getJobIdsForGroup("components")
        stages = {s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds}
        done = sum(info.numCompletedTasks for s in stages if (info := sc.statusTracker().getStageInfo(s)))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for c, v in kept.items():
            spark.conf.set(c, v)
    print("tasks", done, "jobs", len(jobs))
    assert found == expected
    assert done < 2_400


def test_estimates_stay_small(spark):
    """Estimated sizes do not multiply from round to round; their digits filled the driver's memory."""
    found = components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"))
    found.createOrReplaceTempView("found_components")
    plan = spark.sql("EXPLAIN COST SELECT * FROM found_components").first()[0]
    assert {r["label"] for r in found.collect()} == {0}
    sizes = re.findall(r"sizeInBytes=([\d.E+]+) (\w+)", plan)
    assert sizes and all(unit in ("B", "KiB", "MiB") and "E" not in size for size, unit in sizes), sizes


def test_near_dedup_estimates_stay_small(spark):
    """The same over near-dedup, whose second graph comes from the first one's components: a chain of near texts takes some rounds in both."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    texts = []
    for i in range(12):
        words = words[:]
        words[i * 15 + 3] = f"new{i}"
        texts.append((i, " ".join(words)))
    out = minhash_dedup.stage(spark, spark.createDataFrame(texts, "doc_id long, text string"), "")
    out.createOrReplaceTempView("near_dedup_kept")
    plan = spark.sql("EXPLAIN COST SELECT * FROM near_dedup_kept").first()[0]
    assert [r["doc_id"] for r in out.collect()] == [0]
    digits = [int(x) for x in re.findall(r"sizeInBytes=[\d.]+E\+(\d+) B", plan)]
    assert max(digits, default=0) < 1_000, digits
