import numpy as np
import pandas as pd
import pytest

from kinelake.operators import alerts, review
from kinelake.operators.alerts import SmootherConfig

COLUMNS = ["p_non_fall", "p_pre_impact", "p_fall"]


def loop_states(probs, c=SmootherConfig()):
    """The rules row by row, with a latch counter."""
    ema, state, latch, out = None, "calm", 0, []
    for row in probs:
        ema = row if ema is None else c.ema_alpha * row + (1 - c.ema_alpha) * ema
        _, pre, fall = ema
        if latch > 0:
            latch, state = latch - 1, "fall"
        elif fall >= c.fall_enter:
            latch, state = c.fall_latch, "fall"
        elif state == "fall":
            state = "fall" if fall >= c.fall_exit else "pre_impact" if pre >= c.pre_impact_exit else "calm"
        elif state == "pre_impact":
            state = "calm" if pre < c.pre_impact_exit else "pre_impact"
        elif pre >= c.pre_impact_enter:
            state = "pre_impact"
        out.append(state)
    return out


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(12)
    data = {}
    for k, n in enumerate([1, 19, 20, 64, 65, 700, 333]):
        level = np.repeat(rng.dirichlet([0.5, 0.5, 0.3], size=n // 8 + 1), 8, axis=0)[:n]
        data[k] = 0.8 * level + 0.2 * rng.dirichlet([1, 1, 1], size=n)
    pdf = pd.concat([pd.DataFrame(p, columns=COLUMNS).assign(k=k, window_index=np.arange(len(p))) for k, p in data.items()])
    return data, spark.createDataFrame(pdf).repartition(3)


@pytest.mark.parametrize("size", [16, 64, 65_536])
def test_states_match_loop(series, size):
    data, df = series
    got = alerts.smooth_alerts(df, ["k"], size=size).toPandas().sort_values(["k", "window_index"])
    seen = set()
    for k, probs in data.items():
        states = list(got.loc[got["k"] == k, "state"])
        assert states == loop_states(probs)
        seen |= set(states)
    assert seen == {"calm", "pre_impact", "fall"}


def test_latch_holds_twenty_rows(spark):
    probs = [(0.0, 0.0, 1.0)] + [(1.0, 0.0, 0.0)] * 40
    df = spark.createDataFrame([(0, i, *p) for i, p in enumerate(probs)], ["k", "window_index", *COLUMNS])
    states = [r["state"] for r in alerts.smooth_alerts(df, ["k"]).orderBy("window_index").collect()]
    assert states[:21] == ["fall"] * 21 and states[21] == "calm"


def test_state_changes(series):
    data, df = series
    got = review.state_changes(alerts.smooth_alerts(df, ["k"]), ["k"], size=32).toPandas()
    for k, probs in data.items():
        states = loop_states(probs)
        want = [i for i, s in enumerate(states) if i == 0 or s != states[i - 1]]
        assert sorted(got.loc[got["k"] == k, "window_index"]) == want


def test_latest_states(series):
    data, df = series
    got = alerts.latest_states(alerts.smooth_alerts(df, ["k"]), ["k"], "window_index").collect()
    assert {r["k"]: r["window_index"] for r in got} == {k: len(p) - 1 for k, p in data.items()}
