"""The mean before a transition must not hang on the order in which its samples are added."""

import math
import random

import numpy as np

from welltide.operators import knowledge as K


def test_sums_are_correctly_rounded_in_any_order():
    rnd = np.random.default_rng(1)
    x = np.round(rnd.normal(50, 20, (40, 11, 50)), 2)
    want = np.array([math.fsum(v) for v in x.reshape(-1, 50)]).reshape(40, 11)
    assert (K.compensated(x) == want).all() and (K.compensated(x[..., ::-1]) == want).all()
    assert K.compensated(np.array([[1.0, np.inf], [np.inf, -np.inf]])).tolist()[0] == np.inf
    assert np.isnan(K.compensated(np.array([np.inf, -np.inf, 1.0])))


def test_order_before_transition_does_not_change_response(spark):
    rnd = random.Random(3)
    before, after = [round(rnd.uniform(0, 90), 2) for _ in range(50)], [round(rnd.uniform(0, 90), 2) for _ in range(60)]
    data = [(w, p, 5000.0 + p, v) for w in range(6) for p, v in enumerate(rnd.sample(before, 50) + after)]
    wide = spark.createDataFrame(data, "well_id int, pos long, depth_md double, a double")
    moves = spark.createDataFrame([(w, 50, "x", "y") for w in range(6)], "well_id int, pos long, from_state string, to_state string")
    got = K.transition_responses(moves, wide, ["a"]).select("peak", "settle_ft", "settle_samples", "shape").collect()
    assert len(got) == 6 and len(set(got)) == 1
