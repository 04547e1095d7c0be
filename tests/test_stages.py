import math
import random

from pyspark.sql import functions as F

from tonearm.operators import stages


def test_stages_add_up(spark):
    rng = random.Random(1)
    marks = [stages.REQUEST, *stages.STAGES.values()]
    rows = [(rng.randrange(4), i, i * 3 + rng.randrange(2), rng.choice([*marks, *marks[1:], *marks[1:], "other"])) for i in range(400)]
    got = {(r["k"], r["i"]): r for r in stages.first_packets(spark.createDataFrame(rows, "k long, i long, at long, mark string"), "k", ["i"], "at", "mark", buckets=5).collect()}
    assert len(got) == sum(r[3] == stages.REQUEST for r in rows)
    whole = 0
    for (k, i), r in got.items():
        own = [x for x in rows if x[0] == k and x[1] > i]
        cut = next((j for j, x in enumerate(own) if x[3] == stages.REQUEST), len(own))
        now, want = r["at"], []
        for end in stages.STAGES.values():
            now = None if now is None else min((x[2] for x in own[:cut] if x[3] == end and x[2] >= now), default=None)
            want.append(now)
        ends = [r["at"], *want]
        assert [r[f"{s}_ms"] for s in stages.STAGES] == [None if b is None else b - a for a, b in zip(ends, want, strict=False)]
        if want[-1] is not None:
            whole += 1
            assert r["total_ms"] == sum(r[f"{s}_ms"] for s in stages.STAGES)
    assert whole > 5


def test_sketches(spark):
    rng = random.Random(2)
    values = [(i % 3, rng.choice([0, 1, 2, rng.randrange(1, 100), int(math.exp(rng.uniform(0, 40)))])) for i in range(3000)]
    df = spark.createDataFrame([*values, (0, None)], "day long, ms long")
    by_day, whole = stages.sketch(df.withColumn("g", F.lit(1)), ["day", "g"], "ms"), stages.sketch(df.withColumn("g", F.lit(1)), ["g"], "ms")
    assert sorted(map(str, stages.merged(by_day, ["g"]).collect())) == sorted(map(str, whole.select("g", "bucket", "n").collect()))
    shares = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 95, 99, 100)}
    r = stages.quantiles(stages.merged(by_day, ["g"]), ["g"], shares).first()
    ordered = sorted(v for _, v in values)
    assert r["count"] == 3000
    for name, p in shares.items():
        true = ordered[max(1, math.ceil(3000 * p)) - 1]
        assert abs(r[name] - true) <= stages.ERROR * true * (1 + 1e-9)
