"""Arrays against NumPy: values, types and shapes."""

import numpy as np
import pytest

import tesserae as ts

RNG = np.random.default_rng(7)
INTS = ["i1", "i2", "i4", "i8", "u1", "u2", "u4", "u8"]


@pytest.fixture(scope="module", autouse=True)
def _session(spark):
    return spark


def same(got, want, rtol=1e-6):
    got, want = got.numpy(), np.asarray(want)
    assert got.shape == want.shape
    assert got.dtype == want.dtype
    if want.dtype.kind in "fc":
        np.testing.assert_allclose(got, want, rtol=rtol, atol=1e-12 if want.dtype.itemsize > 4 else 1e-6)
    else:
        np.testing.assert_array_equal(got, want)


def ints(kind, n=40):
    t = np.dtype(kind)
    return RNG.integers(np.iinfo(t).min, np.iinfo(t).max, n, dtype=t, endpoint=True)


@pytest.mark.parametrize("kind", INTS)
def test_integers_wrap(kind):
    x, y = ints(kind), ints(kind)
    a, b = ts.asarray(x), ts.asarray(y)
    with np.errstate(over="ignore"):
        same(ts.stack([a + b, a - b, a * b, ts.square(a)]), np.stack([x + y, x - y, x * y, x * x]))


@pytest.mark.parametrize("kind", INTS)
def test_integer_division(kind):
    x, y = ints(kind), ints(kind)
    y[y == 0] = 3
    y[:10] = 7
    x[0], y[0] = np.iinfo(kind).min, (-1 if kind[0] == "i" else 1)
    a, b = ts.asarray(x), ts.asarray(y)
    with np.errstate(over="ignore"):
        r = np.remainder(x, y)
        eu = np.where(r < 0, r - y, r) if kind[0] == "i" else r
        trunc = np.fmod(x, y)
        same(ts.stack([a // b, a % b, ts.remainder(a, b, rounding_mode="trunc"), ts.remainder(a, b, rounding_mode="euclid")]), np.stack([x // y, r, trunc, eu]))
        same(ts.divide(a, b, rounding_mode="trunc"), _wrapped(x.astype(object) - trunc.astype(object), y.astype(object), kind))


def _wrapped(num, den, kind):
    bits, out = 8 * np.dtype(kind).itemsize, []
    for n, d in zip(num, den):
        q = (n // d) % (1 << bits)
        out.append(q - (1 << bits) if kind[0] == "i" and q >> (bits - 1) else q)
    return np.array(out, kind)


def test_division_errors_only_for_cells_that_are_read():
    x, y = np.arange(1000, dtype="i4") % 100, np.arange(1000, dtype="i4") % 7 + 1
    y[300] = y[-1] = 0
    q = ts.asarray(x) // ts.asarray(y)
    with pytest.raises(ArithmeticError):
        q.numpy()
    same(ts.slice(q, slice(0, 300)), x[:300] // y[:300])
    with pytest.raises(ArithmeticError):
        q.sum().numpy()
    with pytest.raises(ArithmeticError):
        ts.where(ts.asarray(y) > 0, q, 0).numpy()


def test_float_division_is_ieee():
    x, y = np.array([1.0, -1, 0, np.nan, 5, np.inf, -7.5]), np.array([0.0, 0, 0, 1, -0.0, 2, 2])
    with np.errstate(all="ignore"):
        same(ts.asarray(x) / ts.asarray(y), x / y)
        same(ts.asarray(x) % ts.asarray(y), np.remainder(x, y))
        same(ts.asarray([1.0, -1.0, 7.5]) // ts.asarray([0.1, 0.1, -2.0]), np.array([1.0, -1.0, 7.5]) // np.array([0.1, 0.1, -2.0]))


def test_power():
    x = np.array([[0, 1, 2, 3], [-2, 5, -7, 10]], "i8")
    e = np.array([0, 1, 5, 20], "i8")
    with np.errstate(over="ignore"):
        same(ts.asarray(x) ** ts.asarray(e), x**e)
    with pytest.raises(ArithmeticError):
        (ts.asarray(x) ** ts.asarray(-e)).numpy()
    f = np.array([0.5, 2.0, 4.0])
    same(ts.stack([ts.asarray(f) ** 0.5, ts.asarray(f) ** 2, ts.asarray(f) ** 1.7]), np.stack([f**0.5, f**2, f**1.7]))


def test_signs():
    for kind in ("i1", "i8"):
        x = np.array([np.iinfo(kind).min, -3, 0, 5], kind)
        with np.errstate(over="ignore"):
            same(-ts.asarray(x), -x)
            same(abs(ts.asarray(x)), np.abs(x))
        same(ts.sign(ts.asarray(x)), np.sign(x))
    u = np.array([0, 1, 200], "u1")
    same(-ts.asarray(u), (-(u.astype("i2"))).astype("i1"))


def test_floats():
    x = np.array([-2.5, -0.5, 0.49999999999999994, 0.5, 1.5, 2.5, 1e300, -1e300, np.nan, np.inf])
    a = ts.asarray(x)
    away = np.where(np.abs(x) < 2**52, np.sign(x) * np.floor(np.abs(x) + 0.5), x)
    away[2] = 0.0
    same(ts.round(a), away)
    same(ts.stack([ts.floor(a), ts.ceil(a)]), np.stack([np.floor(x), np.ceil(x)]))
    same(ts.stack([ts.isnan(a), ts.isinf(a), ts.isfinite(a)]), np.stack([np.isnan(x), np.isinf(x), np.isfinite(x)]))
    y = np.array([0.0, -1.0, 2.0, np.nan, np.inf, 0.3])
    with np.errstate(all="ignore"):
        b = ts.asarray(y)
        same(ts.stack([ts.log(b), ts.log2(b), ts.log10(b), ts.sqrt(b), ts.asin(b), ts.sin(b)]), np.stack([np.log(y), np.log2(y), np.log10(y), np.sqrt(y), np.arcsin(y), np.sin(y)]))
        h = y.astype("f4")
        same(ts.exp(ts.log(ts.asarray(h)) * 0.5), np.exp(np.log(h) * np.float32(0.5)), 1e-5)
    same(ts.log(ts.asarray([8.0, 64.0]), base=2), [3.0, 6.0])
    with pytest.raises(ValueError):
        ts.log(b, base=1)
    with pytest.raises(TypeError):
        ts.isnan(ts.asarray([1, 2]))


def test_half_precision():
    x = (RNG.normal(size=60) * 10.0 ** RNG.integers(-8, 6, 60)).astype("f2")
    y = RNG.normal(size=60).astype("f2")
    with np.errstate(all="ignore"):
        same(ts.asarray(x) + ts.asarray(y), x + y)
        same(ts.asarray(x) * ts.asarray(y), x * y)
    v = np.array([65519.0, 65520.0, 6e-8, 2.9e-8, 0.1, -1e-5])
    same(ts.cast(ts.asarray(v), "f2"), v.astype("f2"))


def test_comparisons():
    x, y = np.array([0.0, 1, 2.4, np.nan]), np.array([0.0, 2, np.nan, np.nan])
    a, b = ts.asarray(x), ts.asarray(y)
    same(ts.stack([a == b, a != b, a < b, a <= b, a > b, a >= b]), np.stack([x == y, x != y, x < y, x <= y, x > y, x >= y]))
    u, i = np.array([2**63, 5, 2**64 - 1], "u8"), np.array([-1, 5, 3], "i8")
    same(ts.asarray(u) > ts.asarray(i), [True, False, True])
    same(ts.asarray(u) == ts.asarray(i), [False, True, False])
    z = np.array([1 + 2j, 1, np.nan])
    same(ts.asarray(z) == ts.asarray(z), [True, True, False])


def test_isclose():
    inf, nan = np.inf, np.nan
    a, b = ts.asarray([1.0, inf, inf, nan, 100.0, 0.0]), ts.asarray([1.05, inf, -inf, nan, 109.0, 1e-9])
    same(ts.isclose(a, b, 0.1, 1e-12), [True, True, False, False, True, False])


def test_selection():
    x, y = np.array([1.0, np.nan, 3.0]), np.array([2.0, 1.0, np.nan])
    a, b = ts.asarray(x), ts.asarray(y)
    same(ts.stack([ts.maximum(a, b), ts.minimum(a, b), ts.clamp(a, 2, 1)]), np.stack([np.maximum(x, y), np.minimum(x, y), np.minimum(np.maximum(x, 2), 1)]))
    u = np.array([2**63 + 1, 3], "u8")
    same(ts.maximum(ts.asarray(u), ts.asarray(u[::-1].copy())), np.maximum(u, u[::-1]))
    same(ts.where(ts.asarray([True, False]), ts.asarray(np.array([1, 2], "i1")), ts.asarray(np.array([300, 400], "u2"))), np.array([1, 400], "i4"))
    with pytest.raises(TypeError):
        ts.where(ts.asarray([1, 0]), 1, 2)


@pytest.mark.parametrize("kind", INTS)
def test_bits(kind):
    x, w = ints(kind), 8 * np.dtype(kind).itemsize
    a, raw = ts.asarray(x), [int(v) % (1 << w) for v in x]
    same(ts.stack([ts.count_ones(a), ts.count_zeros(a), ts.leading_zeros(a), ts.trailing_zeros(a)]), np.array([[f(v) for v in raw] for f in (lambda v: v.bit_count(), lambda v: w - v.bit_count(), lambda v: w - v.bit_length(), lambda v: (v & -v).bit_length() - 1 if v else w)], "u4"))
    rev = np.array([int(f"{v:0{w}b}"[::-1], 2) for v in raw], f"u{w // 8}").view(kind)
    rot = np.array([((v << 3) | (v >> (w - 3))) % (1 << w) for v in raw], f"u{w // 8}").view(kind)
    same(ts.stack([ts.reverse_bits(a), ts.byteswap(a), ~a, ts.bitwise_rotate_left(a, 3), ts.bitwise_rotate_right(a, w - 3)]), np.stack([rev, x.byteswap(), ~x, rot, rot]))
    n = np.array([0, 1, w - 1, 3] * 10, kind)
    same(ts.stack([a << ts.asarray(n), a >> ts.asarray(n), a & ts.asarray(n), a | ts.asarray(n), a ^ ts.asarray(n)]), np.stack([x << n, x >> n, x & n, x | n, x ^ n]))


def test_shifts_out_of_range():
    x = np.array([-8, 8], "i4")
    same(ts.asarray(x) << 40, np.zeros(2, "i4"))
    same(ts.asarray(x) >> 40, np.array([-1, 0], "i4"))
    same(ts.asarray(x) >> ts.asarray(np.array([-1, -1], "i4")), np.array([-1, 0], "i4"))


def test_logic():
    x, y = np.array([0, 1, 2]), np.array([0.0, 0.0, 5.0])
    a, b = ts.asarray(x), ts.asarray(y)
    same(ts.stack([ts.logical_and(a, b), ts.logical_or(a, b), ts.logical_xor(a, b), ts.logical_not(a)]), np.stack([np.logical_and(x, y), np.logical_or(x, y), np.logical_xor(x, y), np.logical_not(x)]))


@pytest.mark.parametrize("dst", ["i1", "i4", "i8", "u1", "u4", "u8"])
def test_float_to_integer_saturates(dst):
    x = np.array([np.nan, 1e30, -1e30, -1.7, 3.9, np.inf, 2.0**63, 255.5])
    lo, hi = np.iinfo(dst).min, np.iinfo(dst).max
    want = [0 if np.isnan(v) else lo if v < lo else hi if v >= hi else int(v) for v in x]
    same(ts.cast(ts.asarray(x), dst), np.array(want, dst))


def test_casts():
    x = ints("u8")
    same(ts.cast(ts.asarray(x), "f8"), x.astype("f8"))
    same(ts.cast(ts.asarray(x), "f4"), x.astype("f4"))
    same(ts.cast(ts.asarray(x), "i2"), x.astype("i2"))
    same(ts.cast(ts.asarray(np.array([0, 2], "i2")), "bool"), [False, True])
    same(ts.cast(ts.asarray([1 + 2j, 0]), "bool"), [True, False])
    with pytest.raises(TypeError):
        ts.cast(ts.asarray([1j]), "f8")
    with pytest.raises(OverflowError):
        ts.asarray(np.array([1], "i1")) + 300


def test_complex():
    z, w = RNG.normal(size=5) + 1j * RNG.normal(size=5), RNG.normal(size=5) + 1j * RNG.normal(size=5)
    a, b = ts.asarray(z), ts.asarray(w)
    same(ts.stack([a + b, a - b, a * b, a / b, -a]), np.stack([z + w, z - w, z * w, z / w, -z]))
    same(ts.stack([ts.real(a), ts.imag(a), abs(a)]), np.stack([z.real, z.imag, np.abs(z)]))
    same(ts.stack([a.sum(), a.mean(), a.prod()]), np.stack([z.sum(), z.mean(), z.prod()]), 1e-9)
    same(a.std(), z.std())
    c = z.astype("c8")
    same(ts.asarray(c) * 2, c * np.complex64(2), 1e-5)


def test_struct_and_inner_types():
    s = np.array([(1, 2.5, [1, 2]), (200, -1.5, [3, 4])], dtype=[("a", "u1"), ("b", "f4"), ("c", "i2", (2,))])
    a = ts.asarray(s)
    same(ts.dtype_sub_field(a, "a"), s["a"])
    got = a.numpy()
    assert got.dtype == s.dtype
    assert (got["c"] == s["c"]).all()
    with pytest.raises(ValueError):
        ts.dtype_sub_field(a, "z")
    with pytest.raises(TypeError):
        ts.dtype_sub_field(ts.asarray([1]), "a")


def test_transmute():
    x = np.array([1.0, -2.5], "f4")
    same(ts.transmute(ts.asarray(x), "u4"), x.view("u4"))
    with pytest.raises(TypeError):
        ts.transmute(ts.asarray(x), "i8")


X = RNG.integers(0, 99, (3, 4, 5))


@pytest.mark.parametrize(("f", "want"), [
    (lambda a: a.T, X.T), (lambda a: ts.permute_dims(a, (1, 2, 0)), X.transpose(1, 2, 0)), (lambda a: a.swapdims(0, -1), X.swapaxes(0, -1)),
    (lambda a: a.reshape((4, -1)), X.reshape(4, -1)), (lambda a: a.T.reshape((6, 10)), X.T.reshape(6, 10)), (lambda a: a.flatten(), X.ravel()),
    (lambda a: a.insert_dim(1), X[:, None]), (lambda a: a.insert_dim(0).squeeze(), X), (lambda a: a.flip(), X[::-1, ::-1, ::-1]),
    (lambda a: a.flip(1), X[:, ::-1]), (lambda a: a.roll(-2, 2), np.roll(X, -2, 2)), (lambda a: a.repeat(2, 1), np.repeat(X, 2, 1)),
    (lambda a: a.tile(2, 0), np.tile(X, (2, 1, 1))), (lambda a: ts.slice(a, (slice(1, 3), ..., 2)), X[1:3, ..., 2]),
    (lambda a: ts.slice(a.T, (1, slice(-3, -1))), X.T[1, -3:-1]), (lambda a: a.broadcast((2, -1, 4, -1)), np.broadcast_to(X, (2, 3, 4, 5))),
    (lambda a: ts.concatenate([a, a + 1], 1), np.concatenate([X, X + 1], 1)), (lambda a: ts.stack([a, a], -1), np.stack([X, X], -1)),
    (lambda a: a.repeat(0, 1), np.repeat(X, 0, 1)), (lambda a: ts.slice(a.roll(1, 0).flip(2), 0), np.roll(X, 1, 0)[:, :, ::-1][0]),
    (lambda a: a + a.T.T, X + X), (lambda a: a - ts.slice(a, (slice(0, 1),)), X - X[:1])])
def test_shape_operators(f, want):
    same(f(ts.asarray(X)), want)


def test_shape_errors():
    a = ts.asarray(X)
    for f, err in (
        (lambda: a.reshape((7, -1)), ValueError), (lambda: a.remove_dim(0), ValueError), (lambda: a.permute_dims((0, 0, 1)), ValueError), (lambda: a.repeat(2), ValueError),
        (lambda: a.roll(1), ValueError), (lambda: ts.concatenate([a, a.T]), RuntimeError), (lambda: ts.stack([a, a.T]), RuntimeError), (lambda: a.sum(3), ValueError),
        (lambda: a + ts.asarray(np.zeros(7)), RuntimeError), (lambda: a.broadcast((3, 4, 7)), RuntimeError), (lambda: a.item(), ValueError), (lambda: bool(a), ValueError),
        (lambda: iter(a), TypeError), (lambda: 1 in a, TypeError), (lambda: a + "x", TypeError), (lambda: a.argmax(), ValueError)):
        with pytest.raises(err):
            f()


@pytest.mark.parametrize("kind", ["i1", "u1", "i8", "u8", "f4", "f8", "?"])
def test_reductions(kind):
    x = RNG.integers(-9 if kind[0] in "if" else 0, 9, (4, 6)).astype(kind)
    a = ts.asarray(x)
    total = {"i": "i8", "u": "u8", "?": "u8", "f": kind}[kind[0]]
    same(a.sum(1), x.sum(1, dtype=total))
    same(a.sum((0, 1), keepdim=True), x.sum(keepdims=True, dtype=total))
    same(a.mean(0), x.mean(0, dtype="f8" if kind[0] != "f" else kind), 1e-5)
    same(a.var(1, ddof=1), x.astype("f8").var(1, ddof=1).astype(kind if kind[0] == "f" else "f8"), 1e-5)
    same(a.std(), x.astype("f8").std().astype(kind if kind[0] == "f" else "f8"), 1e-5)
    same(ts.stack([a.max(0), a.min(0)]), np.stack([x.max(0), x.min(0)]))
    same(ts.stack([a.argmax(1), a.argmin(1)]), np.stack([x.argmax(1), x.argmin(1)]).astype("u8"))
    same(ts.stack([a.all(0), a.any(0)]), np.stack([x.all(0), x.any(0)]))
    if kind != "?":
        same(a.prod(1), x.prod(1, dtype=total), 1e-5)


def test_products_wrap():
    for kind in ("i8", "u8"):
        x = ints(kind, 30).reshape(5, 6)
        x[0, 0], x[1, :3] = 0, [2, 4, 1 << 60]
        with np.errstate(over="ignore"):
            same(ts.asarray(x).prod(1), x.prod(1, dtype=kind))


def test_nan_in_reductions():
    x = np.array([[1.0, np.nan, 3.0, np.nan], [4.0, 2.0, 8.0, 2.0]])
    a = ts.asarray(x)
    same(ts.stack([a.max(1), a.min(1)]), np.stack([x.max(1), x.min(1)]))
    same(ts.stack([a.argmax(1), a.argmin(1)]), np.array([[1, 2], [1, 1]], "u8"))


def test_empty_reductions():
    a = ts.asarray(np.zeros((3, 0), "i4"))
    same(a.sum(1), np.zeros(3, "i8"))
    same(a.prod(1), np.ones(3, "i8"))
    same(a.all(1), np.ones(3, bool))
    same(a.any(1), np.zeros(3, bool))
    same(a.sum(0), np.zeros(0, "i8"))
    assert np.isnan(a.var(1).numpy()).all()
    for f in (a.max, a.min, a.mean):
        with pytest.raises(RuntimeError):
            f(1)
    with pytest.raises(RuntimeError):
        a.argmax(1)


def test_broadcast_reduction():
    x = np.arange(4.0)
    same(ts.broadcast(ts.asarray(x), (3, 4)).sum(0), np.broadcast_to(x, (3, 4)).sum(0))
    same(ts.broadcast(ts.asarray(x), (3, 4)).sum(), np.array(18.0))


def test_zero_dimensional():
    a = ts.asarray(5) * 3
    assert a.item() == 15
    assert a.shape == ()
    same(ts.scalar(2.5, ts.dtype("f8"), (2, 3)), np.full((2, 3), 2.5))


def test_user_functions():
    from pyspark.sql import functions as F

    x = RNG.integers(0, 50, (3, 500))
    a = ts.asarray(x)
    same(ts.map(a, lambda c: c * 2 + 1, "i8"), x * 2 + 1)
    same(ts.map2(a, a, lambda c, d: c * d, "i8"), x * x)
    same(a.reduce_unordered(lambda c, d: F.greatest(c, d), 1), x.max(1))
    same(a.reduce_unordered(lambda c, d: c + d, chunk=16, keepdim=True), x.sum(keepdims=True))


def test_reflected_and_numpy_operands():
    x = np.arange(4.0)
    a = ts.asarray(x)
    same(10 - a, 10 - x)
    same(x + a, x + x)
    same(np.float32(2) * ts.asarray(x.astype("f4")), np.float32(2) * x.astype("f4"))
    with pytest.raises(TypeError):
        a + None


def test_same_source_needs_no_join():
    a = ts.asarray(np.arange(12.0).reshape(3, 4))
    plan = ((a + 1) * a - a).cells()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_large_reductions_meet_their_source_in_a_window(monkeypatch):
    from tesserae.plans import layout

    monkeypatch.setattr(layout, "BROADCAST_CELLS", 2)
    x = RNG.normal(size=(6, 5))
    a = ts.asarray(x)
    for got, want in (
        (a / a.std(1, keepdim=True), x / x.std(1, keepdims=True)), (a - a.mean(0), x - x.mean(0)), (a.T - a.T.max(1, keepdim=True), x.T - x.T.max(1, keepdims=True)),
        ((a + 1) * a.sum(0, keepdim=True), (x + 1) * x.sum(0, keepdims=True)), (ts.exp(a) - ts.exp(a).min(1, keepdim=True), np.exp(x) - np.exp(x).min(1, keepdims=True))):
        same(got, want)
        plan = got.cells()._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan
        assert "Join" not in plan
    same(a.T - a.mean(0, keepdim=True).T, x.T - x.mean(0)[:, None])


def test_types_compare_with_numpy():
    a = ts.asarray(np.zeros(2, "f4"))
    assert a.dtype == np.float32
    assert a.dtype == "float32"
    assert a.dtype != "f8"
    same(a.slice(slice(0, 1)), np.zeros(1, "f4"))


def test_complex_products_of_whole_numbers_are_exact():
    x = np.array([[1 + 1j, 1 - 1j, 3, 2j], [2, 1j, -1j, 5 + 2j]])
    assert ts.asarray(x).prod().item() == np.prod(x)
    np.testing.assert_array_equal(ts.asarray(x).prod(1).numpy(), [12j, 10 + 4j])
    np.testing.assert_array_equal(ts.asarray(x[:, :0]).prod(1).numpy(), [1, 1])
    assert ts.asarray(x.astype("c8")).prod(0, keepdim=True).numpy().dtype == np.complex64
