import numpy as np
import pytest

from tesseral.functions import research as r

EVERY = np.arange(65536, dtype=np.uint16)


def words(seed, n):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=n).cumsum() * 0.01).astype(np.float16).view(np.uint16)


def test_order_and_zigzag():
    assert (r.unordered(r.ordered(EVERY)) == EVERY).all() and (r.unzigzag(r.zigzag(EVERY)) == EVERY).all()
    x = EVERY.view(np.float16)
    real = np.isfinite(x) & (EVERY != 0x8000)
    assert (np.diff(r.ordered(EVERY[real])[np.argsort(x[real], kind="stable")].astype(int)) > 0).all()
    assert r.zigzag(np.array([0, 65535, 1, 65534], np.uint16)).tolist() == [0, 1, 2, 3]


@pytest.mark.parametrize("second", [False, True])
@pytest.mark.parametrize("stride", [1, 8, 100])
def test_ordered_differences(stride, second):
    for w in (words(1, 4 * 96), EVERY[: 4 * 96] * np.uint16(7)):
        assert (r.ulp_restored(r.ulp_residuals(w, 96, stride, second), 96, stride, second) == w).all()


def test_lifting():
    k, v = words(1, 2 * 3 * 256), words(2, 2 * 3 * 256)
    for name, steps in r.lifting_steps(256).items():
        a, b = r.lifted(k, v, steps, 3, 256)
        back = r.lifted(a, b, steps, 3, 256, back=True)
        assert (back[0] == k).all() and (back[1] == v).all(), name
    assert len(r.lifting_steps(256)) == 11 and len(r.lifting_steps(64)) == 9 and len(r.lifting_steps(100)) == 7


def test_gauges():
    q = words(3, 40).reshape(-1, 4)
    for g in range(8):
        assert (r.turn(r.turn(q, g), r.BACK[g]) == q).all()
    for n in (0, 3, 4097):
        w = words(4, n)
        gauges, residuals = r.gauge_residuals(w)
        assert (r.gauge_restored(gauges, residuals, n) == w).all()


    turned = np.tile(q[:1], (64, 1))
    turned[1::2] ^= np.uint16(0x8000)
    assert r.gauge_pays(turned.reshape(-1)) and not r.gauge_pays(np.tile(q[:1], (64, 1)).reshape(-1)[:4])


@pytest.mark.parametrize("layout", ["identity", "adjacent", "neox"])
def test_rotary_predictor(layout):
    w = words(5, 2 * 5 * 128)
    assert (r.rope_restored(r.rope_residuals(w, 5, 128, 64, layout), 5, 128, 64, layout) == w).all()


@pytest.mark.parametrize("coding", ["raw-fields", "lane0-reference", "mode-reference"])
@pytest.mark.parametrize("dtype", ["f16", "bf16"])
def test_shared_exponents(dtype, coding):
    for w in (words(6, 1003), EVERY[::37].copy(), words(7, 0)):
        assert (r.shared_restored(r.shared_exponents(w, dtype, coding), len(w), dtype, coding) == w).all()


def test_sizes():
    found = r.sizes(words(8, 4096), "f16", 4096, 64)
    assert found["codec"] > 0 and set(found) >= {"ulp-adjacent", "gauge-xor", "mode-reference"}
