import numpy as np

from collatrix.operators import raster as R


def plot(shift=0, block=False, red=False):
    image = np.full((160, 240, 4), 255, np.uint8)
    colour = (255, 0, 0) if red else (0, 0, 0)
    for x in range(20, 220):
        y = int(80 + 50 * np.sin(x / 18))
        image[y - 1 : y + 2, x + shift, :3] = colour
    image[20:23, 20:220, :3] = 0
    image[20:140, 20:23, :3] = 0
    if block:
        image[100:120, 150:180, :3] = 40
    return image


def difference(a, b):
    return R.panel_difference(*(R.planes(x.tobytes(), x.shape[1], x.shape[0]) for x in (a, b)))


def test_equal_and_shifted_plots_agree():
    assert difference(plot(), plot()) == (0.0, False)
    moved = np.full_like(plot(), 255)
    moved[3:, 4:] = plot()[:-3, :-4]
    assert difference(plot(), moved)[0] < R.CHANGED


def test_real_changes_show():
    assert difference(plot(), plot(block=True))[0] > R.CHANGED
    assert difference(plot(), plot(red=True))[0] > R.CHANGED
    assert difference(plot(), plot()[:, :200])[0] == 1


def test_scaled_plots_agree():
    from_scale = R.magnified(R.luminance(R.planes(plot().tobytes(), 240, 160)), 1.05)
    lies = R.Registration(R.blurred(R.luminance(R.planes(plot().tobytes(), 240, 160))), R.blurred(from_scale))
    assert 0.9 < lies.scale < 1


def test_tables(spark):
    rows = [("same", plot().tobytes(), 240, 160, plot().tobytes(), 240, 160), ("block", plot().tobytes(), 240, 160, plot(block=True).tobytes(), 240, 160), ("bad", b"x", 240, 160, None, 1, 1)]
    frame = spark.createDataFrame(rows, "key string, a_rgba binary, a_width int, a_height int, b_rgba binary, b_width int, b_height int")
    got = {r.key: r for r in R.two_looks(frame, frame).collect()}
    assert got["same"].score == 0 and got["block"].score > R.CHANGED and got["bad"].score is None and got["bad"].error
    verdicts = R.figure_verdicts(spark.createDataFrame([("f", 0.0, False), ("g", 0.5, False), ("h", 0.0, True)], "figure string, score double, resized boolean"))
    assert {r.figure: r.changed for r in verdicts.collect()} == {"f": False, "g": True, "h": True}
