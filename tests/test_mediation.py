"""Mediation with a known causal path."""

import numpy as np
import pytest

from uttermark.keys import cell_columns
from uttermark.operators import models as M


def planted(rng, n, through, direct):
    t = np.repeat([0, 1], n)
    w = np.clip(0.2 + 0.3 * t + rng.normal(0, 0.1, 2 * n), 0, 1)
    p = 1 / (1 + np.exp(-(1.0 - through * w - direct * t)))
    return t, w, (rng.random(2 * n) < p).astype(int)


@pytest.mark.parametrize(("through", "direct"), [(5.0, 0.0), (0.0, 1.0), (3.0, 0.5)])
def test_planted_paths(spark, through, direct):
    t, w, y = planted(np.random.default_rng(4), 4000, through, direct)
    data = [(i % 4000, "a", "l", "cascade", "noise" if k else "clean", 0 if k else None, float(a), int(b)) for i, (k, a, b) in enumerate(zip(t, w, y, strict=True))]
    rows = cell_columns(spark.createDataFrame(data, "slurp_id long, asr_model string, llm_model string, pathway string, degradation string, snr_db int, wer double, ees int"))
    got = M.mediation_table(rows).first()
    assert got["refused"] is None and got["total"] == pytest.approx(got["acme"] + got["ade"])
    assert got["total"] == pytest.approx(y[t == 1].mean() - y[t == 0].mean(), abs=0.03)
    assert (abs(got["acme"]) < 0.06) == (through == 0) and (abs(got["ade"]) < 0.06) == (direct == 0)
    band = M.mediation_bootstrap(rows, replicates=60).first()
    assert band["acme_lo"] < got["acme"] < band["acme_hi"] and band["n_refused"] == 0


def test_refusals():
    one = np.ones(4)
    assert M.mediate(one, one, one, one * 0.5) == "one arm is empty"
    t = np.array([0.0, 0, 1, 1])
    assert "outcome" in M.mediate(t, np.arange(4.0), one, one)
    assert "mediator" in M.mediate(t, one, one, one * 0.5)


def test_intervals_of_the_fits_cover_what_was_planted():
    """300 samples of one truth: the 95 % intervals hold it about as often as they say, and aren't too wide."""
    rng = np.random.default_rng(8)
    t, w, y = planted(rng, 400_000, 3.0, 0.5)
    one = np.ones(len(t))
    truth = M.mediate(t.astype(float), w, one, y.astype(float))
    held, wide = np.zeros(3), []
    for _ in range(300):
        t, w, y = planted(rng, 300, 3.0, 0.5)
        got = M.mediate(t.astype(float), w, np.ones(len(t)), y.astype(float), errors=True)
        value, se = np.array(got[:3]), np.array(got[3:])
        held += np.abs(value - truth) <= M.Z95 * se
        wide.append(np.concatenate([value, se]))
    assert ((held / 300 > 0.91) & (held / 300 < 0.985)).all(), held / 300
    wide = np.array(wide)
    assert np.allclose(wide[:, 3:].mean(0), wide[:, :3].std(0), rtol=0.15)


def test_share_needs_both_intervals(spark):
    t, w, y = planted(np.random.default_rng(4), 1500, 5.0, 0.5)
    none = planted(np.random.default_rng(5), 60, 5.0, 0.5)  # its clean arm, as another degradation
    data = [(i, "a", "l", "cascade", "noise" if k else "clean", 0 if k else None, float(a), int(b)) for i, (k, a, b) in enumerate(zip(t, w, y, strict=True))]
    data += [(9000 + i, "a", "l", "cascade", "babble", 0, float(a), int(b)) for i, (k, a, b) in enumerate(zip(*none, strict=True)) if not k]
    rows = cell_columns(spark.createDataFrame(data, "slurp_id long, asr_model string, llm_model string, pathway string, degradation string, snr_db int, wer double, ees int"))
    bands = lambda lo, hi: spark.createDataFrame([(d, lo, hi) for d in ("noise", "babble")], "degradation string, total_lo double, total_hi double")
    got = {r["degradation"]: r for r in M.mediation_table(rows).collect()}
    assert got["noise"]["total_fit_lo"] < got["noise"]["total"] < got["noise"]["total_fit_hi"] < 0
    assert got["noise"]["share"] == pytest.approx(got["noise"]["acme"] / got["noise"]["total"]) and got["noise"]["share_refused"] is None
    for lo, hi, who in ((-0.5, -0.1, None), (-0.1, 0.1, "bootstrap"), (None, None, "bootstrap")):
        one = {r["degradation"]: r for r in M.mediation_table(rows, bands=bands(lo, hi)).collect()}
        assert (one["noise"]["share"] is None) == (who is not None) and (who is None or who in one["noise"]["share_refused"])
        assert one["babble"]["share"] is None and "fits" in one["babble"]["share_refused"]
    assert got["babble"]["total_fit_lo"] < 0 < got["babble"]["total_fit_hi"]
