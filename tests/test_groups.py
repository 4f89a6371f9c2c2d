import math

import numpy as np
import pandas as pd
import pytest

from luxframe.functions.clustering import cluster
from luxframe.operators import grouping


def dense_clustering(n, t, total_s, photons):
    """All pairs compared and full responsibility matrices: the definition, without shortcuts."""
    n, t = np.array(n, float), np.array(t, float)
    logfact = np.array([math.lgamma(x + 1) for x in n])
    groups, steps = [[i] for i in range(len(n))], []
    while len(groups) > 1:
        gn, gt = (np.array([x[g].sum() for g in groups]) for x in (n, t))
        merit = lambda j, m: (
            (gn[m] + gn[j]) * math.log((gn[m] + gn[j]) / (gt[m] + gt[j]))
            - gn[m] * math.log(gn[m] / gt[m])
            - gn[j] * math.log(gn[j] / gt[j])
        )
        j, m = max(((j, m) for j in range(len(groups)) for m in range(j + 1, len(groups))), key=lambda p: merit(*p))
        groups[j] = groups[j] + groups.pop(m)
        weight = np.array([[float(i in g) for i in range(len(n))] for g in groups])
        for _ in range(50):
            time, seen = weight @ t, weight @ n
            rate = seen / time
            alpha = np.log(time / total_s)[:, None] + n * np.log(rate[:, None] * t) - rate[:, None] * t - logfact
            fresh = np.exp(alpha - alpha.max(0))
            fresh /= fresh.sum(0)
            moved, weight = np.abs(fresh - weight).sum(), fresh
            if moved <= 1e-5:
                break
        chosen = weight.argmax(0)
        best = alpha[chosen, range(len(n))]
        groups = [np.flatnonzero(chosen == g).tolist() for g in range(len(groups))]
        groups = sorted((g for g in groups if g), key=lambda g: n[g].sum() / t[g].sum())
        like = best[best > math.log(1e-200)].sum()
        changes = len(n) - 1
        steps.append((len(groups), like, 2 * like - (2 * len(groups) - 1) * math.log(changes) - changes * math.log(photons), list(groups)))
    return steps


@pytest.mark.parametrize("seed", range(12))
def test_shortcuts_change_nothing(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 26))
    t = rng.exponential(size=size) + 0.05
    n = np.maximum(rng.poisson(rng.choice([200, 800, 3000], size) * t), 1)
    want = dense_clustering(n, t, t.sum(), n.sum())
    got = list(cluster(n, t, t.sum(), n.sum()))
    assert [g[0] for g in got] == [w[0] for w in want]
    for (_, like, bic, member), (_, wlike, wbic, groups) in zip(got, want):
        assert like == pytest.approx(wlike) and bic == pytest.approx(wbic)
        assert [np.flatnonzero(member == g).tolist() for g in range(len(groups))] == groups


def two_state(seed=0, count=30):
    rng = np.random.default_rng(seed)
    dwell = rng.uniform(0.2, 1.0, count)
    rate = np.where(np.arange(count) % 2, 9000.0, 1500.0)
    return pd.DataFrame({"particle": "p", "level_ind": range(count), "dwell_s": dwell, "num_photons": rng.poisson(rate * dwell)})


def test_two_states_are_recognised(spark):
    frame = two_state()
    single = pd.DataFrame({"particle": "one", "level_ind": [0], "dwell_s": [2.0], "num_photons": [500]})
    steps = grouping.run_grouping(spark.createDataFrame(pd.concat([frame, single])))
    best = {r.particle: r for r in steps.where("is_best").collect()}
    assert best["p"].num_groups == 2 and best["one"].num_groups == 1 and best["one"].bic is None
    assert [g.group_ind for g in best["p"].level_groups] == [i % 2 for i in range(30)]
    assert steps.where("particle = 'p' and level_groups is null").count() == 0


def grouped(spark, ints, groups):
    n = len(ints)
    return spark.createDataFrame(
        pd.DataFrame(
            {
                "particle": "p",
                "level_ind": range(n),
                "group_ind": groups,
                "first_ind": [i * 10 for i in range(n)],
                "last_ind": [i * 10 + 9 for i in range(n)],
                "start_ns": [i * 1_000_000_000 for i in range(n)],
                "end_ns": [(i + 1) * 1_000_000_000 for i in range(n)],
                "num_photons": 10,
                "dwell_s": 1.0,
                "int_p_s": np.array(ints, float),
            }
        )
    )


def test_adjacent_levels_of_a_group_merge(spark):
    df = grouped(spark, [5, 6, 1, 5], [1, 1, 0, 1])
    rows = grouping.merge_group_levels(df, grouping.group_stats(df)).orderBy("gl_ind").collect()
    assert [(r.first_ind, r.last_ind, r.group_ind, r.num_photons) for r in rows] == [(0, 19, 1, 20), (20, 29, 0, 10), (30, 39, 1, 10)]
    assert rows[0].int_p_s == 10 and rows[0].dwell_s == 2.0


def test_merged_levels_carry_their_begin_and_end(spark):
    """The export needs no second look at the levels for the times."""
    df = grouped(spark, [5, 6, 1, 5], [1, 1, 0, 1])
    rows = grouping.merge_group_levels(df, grouping.group_stats(df)).orderBy("gl_ind").collect()
    assert [(r.begin_ns / 1e9, r.stop_ns / 1e9) for r in rows] == [(0, 2), (2, 3), (3, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_rounds_in_a_table_agree_with_near_pairs(seed, monkeypatch):
    from luxframe.functions import clustering

    rng = np.random.default_rng(seed)
    size = int(rng.integers(2, 160))
    t = rng.integers(1, 110, size) / 1000
    n = rng.integers(1, 51, size) * 20
    taken = []
    whole = clustering.Mixture.refine_table
    monkeypatch.setattr(clustering.Mixture, "refine_table", lambda *a: taken.append(1) or whole(*a))
    got = list(cluster(n, t, t.sum(), n.sum()))
    assert taken
    monkeypatch.setattr(clustering, "TABLE", 0)
    want = list(cluster(n, t, t.sum(), n.sum()))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1] == pytest.approx(w[1], rel=1e-12, abs=1e-6) and g[2] == pytest.approx(w[2], rel=1e-12, abs=1e-6)
        assert (g[3] == w[3]).all()


def test_bounds_and_lookup(spark):
    df = spark.createDataFrame([("p", 0, 10.0), ("p", 1, 30.0), ("p", 2, 90.0)], "particle string, group_ind int, int_p_s double")
    down = grouping.group_bounds(df).orderBy("position").collect()
    assert [(r.group_ind, r.low, r.high) for r in down] == [(2, 60.0, float("inf")), (1, 20.0, 60.0), (0, 0.0, 20.0)]
    assert [r.group_ind for r in grouping.group_bounds(df, descending=False).orderBy("position").collect()] == [0, 1, 2]
    probes = spark.createDataFrame([("p", 20.0), ("p", 19.9), ("p", 500.0)], "particle string, value double")
    found = {r.value: r.group_ind for r in grouping.group_at_intensity(grouping.group_bounds(df), probes).collect()}
    assert found == {20.0: 1, 19.9: 0, 500.0: 2}


def test_best_merge_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    frame = two_state(3, 12).assign(int_p_s=lambda d: d.num_photons / d.dwell_s)
    row = grouping.best_merge(spark.createDataFrame(frame)).first()
    n, t = frame.num_photons.to_numpy(), frame.dwell_s.to_numpy()
    merit = lambda a, b: (n[a] + n[b]) * np.log((n[a] + n[b]) / (t[a] + t[b])) - n[a] * np.log(n[a] / t[a]) - n[b] * np.log(n[b] / t[b])
    pairs = [(a, b) for a in range(12) for b in range(a + 1, 12)]
    assert (row.first_level, row.second_level) == max(pairs, key=lambda p: merit(*p))


def test_toggle(spark):
    df = spark.createDataFrame([(1, True, True, True), (2, True, True, False), (3, False, True, True)], "id int, selected boolean, has_groups boolean, using_groups boolean")
    on = grouping.toggle_groups(df)
    assert [r.using_groups for r in on.orderBy("id").collect()] == [True, True, True]
    assert [r.using_groups for r in grouping.toggle_groups(on).orderBy("id").collect()] == [False, False, True]


def test_groups_do_not_depend_on_the_partitions(spark):
    frames = [two_state(1, 120).assign(particle="big"), two_state(2, 40).assign(particle="small")]
    df = spark.createDataFrame(pd.concat(frames))
    found = [grouping.group_levels(df.repartition(n)) for n in (1, 7)]
    steps = [sorted((r.particle, r.step, r.num_groups, round(r.log_l, 6), round(r.bic, 6)) for r in s.collect()) for s, _ in found]
    assigned = [sorted((r.particle, r.level_ind, r.group_ind) for r in a.collect()) for _, a in found]
    assert steps[0] == steps[1] and assigned[0] == assigned[1]


def test_total_time_is_that_of_the_trace(spark):
    frame = two_state(3, 30).assign(particle="p")
    frame["start_ns"] = (frame["dwell_s"].cumsum() - frame["dwell_s"]) * 2e9
    frame["end_ns"] = frame["start_ns"] + frame["dwell_s"] * 1e9
    whole = (frame["end_ns"].max() - frame["start_ns"].min()) / 1e9
    df = spark.createDataFrame(frame)
    totals = spark.createDataFrame([("p", float(whole), int(frame["num_photons"].sum()))], "particle string, total_s double, total_photons long")
    key = lambda d: sorted((r.step, r.num_groups, r.bic) for r in d.collect())
    given, derived = grouping.group_levels(df, totals)[0], grouping.group_levels(df)[0]
    summed = grouping.group_levels(df.drop("start_ns", "end_ns"))[0]
    assert key(given) == key(derived) != key(summed)
