"""As-of totals per row's own time, and scores of closed deals that cannot see their own outcome."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quotaloom.functions.ordered import totals_before
from quotaloom.operators import models
from quotaloom.plans.registry import Tables

SF = "/root/testdata/sf0.01"


def test_totals_before_equal_brute_force_with_a_hot_key(spark):
    r = random.Random(4)
    start = dt.date(2001, 1, 1)
    keys = ["hot"] * 30 + ["a", "b", "c", None]
    events = [(r.choice(keys), start + dt.timedelta(r.randrange(120)), r.randint(0, 1), r.choice([None, 10.0, 2.5])) for _ in range(2000)]
    events += [("c", None, 1, 1.0)]
    queries = [(i, r.choice(keys + ["never"]), r.choice([None, start + dt.timedelta(r.randrange(-20, 160))])) for i in range(400)]
    queries += [(1000, "hot", start), (1001, "hot", start + dt.timedelta(59)), (1002, "hot", start + dt.timedelta(59))]
    e = spark.createDataFrame(events, "k string, day date, won int, amount double").repartition(7)
    q = spark.createDataFrame(queries, "id long, k string, day date")
    got = {row.id: (row.n, row.wins, row.amount) for row in totals_before(q, e, "k", "day", "day", {"n": F.lit(1), "wins": F.col("won"), "amount": F.col("amount")}).collect()}
    assert len(got) == len(queries)
    for i, k, day in queries:
        prior = [x for x in events if k is not None and day is not None and x[0] == k and x[1] is not None and x[1] < day]
        want = (len(prior), sum(x[2] for x in prior), sum(x[3] for x in prior if x[3] is not None) if any(x[3] is not None for x in prior) else None) if prior else (None, None, None)
        assert got[i] == want, (i, k, day)


def closed_scores(spark, wins_flipped=()):
    t = Tables(spark, SF)
    flip = lambda df: df.withColumn("is_won", F.when(F.col("opportunity_id").isin(*wins_flipped), ~F.col("is_won")).otherwise(F.col("is_won"))) if wins_flipped else df
    opportunities, history = flip(t["opportunities"]), flip(t["win_loss_details"])
    recent = opportunities.filter(F.col("is_closed") & (F.col("close_date") >= F.date_sub(F.lit(t.as_of), 30)))
    features = models._features(recent, t["activities"], t["stage_benchmarks"], history, t.as_of, point_in_time=True)
    scores = models.closed_deal_scores(opportunities, t["activities"], t["stage_benchmarks"], history, t["model_weights"], as_of=t.as_of)
    return {r.opportunity_id: r for r in features.collect()}, {r.opportunity_id: r.win_probability for r in scores.collect()}


def test_a_closed_deal_never_sees_its_own_outcome(spark):
    features, scores = closed_scores(spark)
    assert scores
    later = {d: [o for o, f in features.items() if f.owner_id == mine.owner_id and f.close_date > mine.close_date] for d, mine in features.items()}
    deal = max(features, key=lambda d: len(later[d]))
    flipped_features, flipped_scores = closed_scores(spark, [deal])
    assert flipped_scores[deal] == scores[deal]
    mine, again = features[deal], flipped_features[deal]
    assert (again.owner_win_rate, again.account_previous_wins, again.segment_win_rate) == (mine.owner_win_rate, mine.account_previous_wins, mine.segment_win_rate)
    for o in later[deal]:  # a later deal of the same owner does see it
        assert flipped_features[o].owner_win_rate != features[o].owner_win_rate
