"""Hand-worked series for every branch of detection and matching."""

import datetime as dt

import pytest

from rillflow.operators import events as ev

N = None
CASES = [
    ([-1.2, -1.2, 0], []),
    ([-1.2, -1.3, -1.1, 0, 0], [(0, 2, -3.6, 0)]),
    ([-1.2, -1.2, -1.2, -0.7, -1.2, 0, 0], [(0, 4, -5.5, 1)]),
    ([-1.2, -1.2, -1.2, -0.7, -0.7, -1.2, 0, 0], [(0, 5, -6.2, 2)]),
    ([-1.2, -1.2, -1.2, -0.7, 0, -1.2, -1.2], [(0, 2, -3.6, 0)]),
    ([-1.2, -1.2, -1.2, 0, -1.2, 0, 0], [(0, 4, -4.8, 1)]),
    ([-1.2, -1.2, -1.2, 0], [(0, 3, -3.6, 1)]),
    ([-1.2, -1.2, -1.2, N, -1.2, 0, 0], [(0, 4, -4.8, 0)]),
    ([-1.2, N, -1.2, -1.2], []),
    ([-1.2, -1.2, -1.2, 0, 0, -1.2, -1.2, -1.2, 0, 0], [(0, 2, -3.6, 0), (5, 7, -3.6, 0)]),
    ([-1.0, -1.0, -1.0, -0.5, -1.0, 0, 0], [(0, 4, -4.5, 1)]),
    ([-1.1, -1.1, -1.1, 2.0, -0.6, -1.1, 0, 0], [(0, 5, -3.0, 2)]),
]


def month(i):
    return dt.date(2000 + i // 12, i % 12 + 1, 1)


def test_detection(spark):
    rows = [(g, month(i), None if v is None else float(v)) for g, (values, _) in enumerate(CASES) for i, v in enumerate(values)]
    got = ev.detect(spark.createDataFrame(rows, "gauge int, period date, index double")).collect()
    found = {g: [] for g in range(len(CASES))}
    for r in sorted(got, key=lambda r: (r.gauge, r.onset_idx)):
        found[r.gauge].append((r.onset_idx, r.term_idx, r.severity, r.false_recoveries))
        assert r.duration == r.term_idx - r.onset_idx + 1
    assert [found[g] for g in range(len(CASES))] == [want for _, want in CASES]


def events(spark, rows):
    full = [(g, a, b, month(a), month(b), b - a + 1, s, -2.0, a, 0) for g, a, b, s in rows]
    return spark.createDataFrame(full, "gauge int, onset_idx int, term_idx int, onset_date date, term_date date, duration int, severity double, peak double, peak_idx int, false_recoveries int")


def test_matching(spark):
    driver = events(spark, [(0, 3, 5, -4.0), (0, 4, 12, -5.0), (1, 8, 9, -4.0), (1, 2, 4, -4.0), (2, 5, 12, -2.5), (3, 11, 15, -5.0)])
    response = events(spark, [(g, 10, 14, -4.0) for g in range(4)])
    pairs = ev.match(driver, response)
    got = {r.gauge: (r.d_onset_idx, r.overlap, r.propagation_lag, r.event_recovery_lag) for r in pairs.collect()}
    assert got == {0: (4, 3, 6, 2), 1: (8, 0, 2, 5)}
    unused, alone = ev.buffered(driver, pairs), ev.independent(response, pairs)
    assert {(r.gauge, r.onset_idx, r.reason) for r in unused.collect()} == {
        (0, 3, "no_matching_response"), (1, 2, "no_matching_response"), (2, 5, "severity_below_threshold"), (3, 11, "no_matching_response"),
    }
    assert {r.gauge for r in alone.collect()} == {2, 3}
    assert ev.leads(pairs).count() == 0
    for r in ev.classify(driver, response, pairs, unused, alone).collect():
        assert r.unique_drivers + r.buffered == r.drivers
        assert r.matched + r.leads + r.independent == r.responses


def test_empty(spark):
    none = spark.createDataFrame([], "gauge int, period date, index double")
    assert ev.detect(none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_detection_against_a_scan(spark, seed):
    import random

    rng = random.Random(seed)
    values = {g: [None if rng.random() < 0.05 else round(rng.gauss(-0.9, 0.7), 2) for _ in range(60)] for g in range(12)}
    rows = [(g, month(i), v) for g, x in values.items() for i, v in enumerate(x)]
    got = {}
    for r in ev.detect(spark.createDataFrame(rows, "gauge int, period date, index double")).collect():
        got.setdefault(r.gauge, []).append((r.onset_idx, r.term_idx))
    for g, x in values.items():
        want, i = [], 0
        low = lambda k: k < len(x) and x[k] is not None and x[k] <= -1  # noqa: E731, B023
        while i < len(x):
            if low(i) and low(i + 1) and low(i + 2):
                j = i + 3
                while j < len(x) and not (x[j] is not None and x[j] > -1 and j + 1 < len(x) and x[j + 1] is not None and x[j + 1] > -0.5):
                    j += 1
                want.append((i, min(j, len(x)) - 1))
                i = j
            i += 1
        assert sorted(got.get(g, [])) == want
