import numpy as np
import pandas as pd

from seabright.operators import mosaic


def test_points_are_summed_a_few_at_a_time(monkeypatch):
    """what a painting task holds does not follow the number of strokes."""
    across, rng = np.linspace(-200.0, 200.0, 1001), np.random.default_rng(6)
    frame = pd.DataFrame([(1, 0, k, True, True, 1.0, 2.0, across, across + 0.1, np.full(1001, float(k)), rng.random(1001), np.ones(1001)) for k in range(600)], columns=["dataset", "chunk", "stroke", "own", "usable", "port_gain", "stbd_gain", "across", *mosaic.FIELDS])
    add = lambda parts: pd.concat(parts).groupby(["gx", "gy"]).sum()
    sizes, sums = [], mosaic.cell_sums
    monkeypatch.setattr(mosaic, "cell_sums", lambda points: sizes.append(points.shape[1]) or sums(points))
    got = add(mosaic.painted([frame[:250], frame[250:]]))
    assert sum(sizes) > 1_000_000 and max(sizes) < 250_000
    monkeypatch.setattr(mosaic, "MOST_POINTS", 10**9)
    pd.testing.assert_frame_equal(got, add(mosaic.painted([frame])))
    assert len(sizes) > 6
