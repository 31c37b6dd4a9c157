import random

from winnowlane.operators import ranking, staged


def test_seed_slots():
    assert ranking.seed_slots(8) == [1, 8, 4, 5, 2, 7, 3, 6]
    assert all(a + b == 17 for a, b in zip(*[iter(ranking.seed_slots(16))] * 2))


def test_judge_finds_the_true_order():
    rng = random.Random(3)
    for n in [2, 3, 5, 8, 13, 31, 48]:
        pool = [f"p{i:03d}" for i in range(n)]
        score = {p: rng.random() for p in pool}
        for target in {1, n // 2 or 1, n}:
            r, log = ranking.judge(pool, target, rng.randrange(2**32), lambda a, b: max(a, b, key=score.get))
            assert r.places == sorted(pool, key=score.get, reverse=True)[:target]
            assert len(log) == r.asked


def test_published_counts_on_average():
    rng = random.Random(11)
    for n, target, want in [(16, 8, 35), (64, 5, 87), (30, 1, 29), (60, 60, 290)]:
        asked = []
        for _ in range(12):
            pool = list(range(n))
            score = rng.sample(pool, n)
            asked.append(ranking.judge(pool, target, rng.randrange(2**32), lambda a, b: a if score[a] > score[b] else b)[0].asked)
        assert abs(sum(asked) / len(asked) - want) <= 0.1 * want


def test_replay_and_its_faults():
    pool = list("abcdef")
    r, log = ranking.judge(pool, 3, 5, min)
    again = ranking.replay(pool, 3, 5, log)
    assert again.places == r.places == ["a", "b", "c"] and again.pending is None and again.broke is None
    half = ranking.replay(pool, 3, 5, log[:2])
    assert half.pending[0] == log[2]["m"]
    assert "past completion" in ranking.replay(pool, 3, 5, [*log, log[0]]).broke
    assert ranking.replay(pool, 3, 5, [{"t": "pick", "m": "x", "w": "a"}]).broke
    assert ranking.replay(pool, 3, 5, [{"t": "pick", "m": None, "w": "zz"}]).broke
    deferred = ranking.replay(pool, 3, 5, [{"t": "defer"}])
    assert deferred.deferred == 1 and deferred.pending[0] != log[0]["m"]


def test_shuffle_is_a_permutation_and_native_fold_agrees(spark):
    from pyspark.sql import functions as F

    items = list(range(9))
    assert sorted(staged.shuffled(items, 77)) == items
    for seed in (0, 1, 42, 2**32 - 1):
        got = spark.range(1).select(staged.shuffle_expr(F.lit(items), F.lit(seed).cast("long")).alias("a")).head().a
        assert got == staged.shuffled(items, seed)


def test_schedule_and_price(spark):
    from pyspark.sql import functions as F

    s = staged.schedule(742, 16)
    assert [p[2] for p in s["passes"]] == [83, 37, 17, 8] and s["field"] == 29
    rows = staged.schedule_frame(spark.createDataFrame([("u", 742, 16)], "unit string, n long, target int")).orderBy("pass_no").collect()
    assert [(r.before, r.after, r.screens) for r in rows] == s["passes"]
    assert staged.schedule(742, 16, mode="unlimited")["passes"] == [] and staged.schedule(5, None) is None
    # the published field sizes, depths and measured comparisons
    points = [(30, 1, 29), (60, 60, 290), (100, 16, 195), (742, 16, 920)]
    f = spark.createDataFrame(points, "n long, d long, want long").select("want", staged.rank_price(F.col("n"), F.col("d")).alias("p"))
    assert all(abs(r.p - r.want) <= 0.1 * r.want for r in f.collect())


def test_log_replay_frame(spark):
    _, log = ranking.judge(["a", "b", "c", "d"], 2, 9, min)
    pool = spark.createDataFrame([("u", x) for x in "abcd"], "unit string, id string")
    ops = spark.createDataFrame([("u", i, o["t"], o["m"], o["w"]) for i, o in enumerate(log)], "unit string, seq long, type string, mid string, winner string")
    out = {r.id: r.place for r in ranking.rank_from_log(pool, ops, 2, 9).collect()}
    assert out["a"] == 1 and out["b"] == 2
    assert ranking.undo(ops).count() == len(log) - 1
