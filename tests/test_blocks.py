import numpy as np
import pytest

import tesserae as ts
from tesserae.sources.blocks import is_stored

X = np.arange(10 * 13, dtype="f4").reshape(10, 13)


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    p = f"{tmp_path_factory.mktemp('a')}/x"
    ts.write_array(ts.asarray(X), p, params={"block_shape": (4, 5), "compression_level": 3})
    return p


def test_round_trip(path):
    a = ts.read_array(path, validation="strict")
    assert (a.shape, a.dtype.name) == ((10, 13), "f32")
    np.testing.assert_array_equal(a.numpy(), X)
    np.testing.assert_array_equal(a[3:9, 11], X[3:9, 11])


def test_region_reaches_the_scan(path):
    a = ts.read_array(path)
    r = ts.slice((a.exp() * 2).T, (slice(6, 8), slice(1, 3)))
    plan = r.cells()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(b1,1)" in plan
    assert "LessThanOrEqual(b0,0)" in plan
    np.testing.assert_allclose(r.numpy(), (np.exp(X) * 2).T[6:8, 1:3], rtol=1e-5)


def test_existing_paths(path):
    a = ts.asarray(X)
    with pytest.raises(FileExistsError):
        ts.write_array(a, path)
    ts.write_array(a + 1, path, append=True, name="more")
    np.testing.assert_array_equal(ts.read_array(path, name="more").numpy(), X + 1)
    with pytest.raises(FileExistsError):
        ts.write_array(a, path, append=True, name="more")
    with pytest.raises(FileNotFoundError):
        ts.read_array(path, name="none")


def test_parameters():
    a = ts.asarray(X)
    with pytest.raises(TypeError):
        a.compact({"blocks": 3})
    with pytest.raises(ValueError):
        a.compact({"codec": "lz4"})
    with pytest.raises(ValueError):
        a.compact({"filters": ["x"]})


def test_compact(path):
    a = ts.read_array(path)
    assert is_stored(a)
    assert ts.compact(a) is a
    assert not is_stored(a + 1)
    b = (a + 1).compact({"block_shape": (3, 3)})
    np.testing.assert_array_equal((b - a).numpy(), np.ones_like(X))


@pytest.mark.parametrize("x", [np.array(3.5), np.zeros((0, 3), "i2"), np.array([1 + 2j, 3]), np.array([2**63, 1], "u8"), np.array([(1, [2, 3])], dtype=[("a", "i4"), ("b", "f4", (2,))])])
def test_kinds(x):
    got = ts.asarray(x).compact().numpy()
    assert got.dtype == x.dtype
    assert got.shape == x.shape
    assert got.tobytes() == x.tobytes()


def test_strict_validation_finds_missing_blocks(spark, tmp_path):
    p = str(tmp_path / "y")
    ts.write_array(ts.asarray(X), p, params={"block_shape": (4, 5)})
    df = spark.read.parquet(f"{p}/array/blocks").where("b0 <> 1")
    df.write.parquet(f"{p}/part")
    import shutil

    shutil.rmtree(f"{p}/array/blocks")
    shutil.move(f"{p}/part", f"{p}/array/blocks")
    with pytest.raises(RuntimeError):
        ts.read_array(p, validation="strict")


def test_elementwise_work_stays_inside_the_blocks(path):
    from tesserae.sources.blocks import to_blocks

    a = ts.read_array(path)
    b = ts.where(a > 5, ts.exp(a / 100) * 2 + 1, a.cast("f8"))
    plan = to_blocks(b, (4, 5))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Generate" not in plan
    want = np.where(X > 5, np.exp(X / np.float32(100)) * np.float32(2) + np.float32(1), X.astype("f8"))
    np.testing.assert_allclose(b.compact().numpy(), want, rtol=1e-5)
    np.testing.assert_allclose((b.T + 0).compact().numpy(), want.T, rtol=1e-5)
    with pytest.raises(ArithmeticError):
        (ts.cast(a, "int32") // (ts.cast(a, "int32") - 7)).compact().numpy()


def _stored(x, block, tmp_path, name):
    ts.write_array(ts.asarray(x), str(tmp_path / name), params={"block_shape": block})
    return ts.read_array(str(tmp_path / name))


def test_stored_arrays_of_one_grid_meet_block_by_block(tmp_path):
    y = np.cos(X).astype("f4")
    a, b, c = _stored(X, (4, 5), tmp_path, "a"), _stored(y, (4, 5), tmp_path, "b"), _stored(y * 3, (4, 5), tmp_path, "c")
    both = (a + b) * a - c / 2
    from tesserae.sources.blocks import to_blocks

    plan = to_blocks(both, (4, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
    assert "Generate" not in plan  # no cell is taken out of its block
    assert both.cells()._jdf.queryExecution().optimizedPlan().toString().count("Join") == 2
    want = (X + y) * X - y * 3 / 2
    np.testing.assert_allclose(both.numpy(), want, rtol=1e-5)
    np.testing.assert_allclose(both[2:9, 3:4], want[2:9, 3:4], rtol=1e-5)
    np.testing.assert_allclose(both.compact().numpy(), want, rtol=1e-5)
    np.testing.assert_allclose((both.T + 1).numpy(), want.T + 1, rtol=1e-5)
    pruned = ts.slice(a + b, (slice(8, 10), slice(0, 2))).cells()._jdf.queryExecution().executedPlan().toString()
    assert pruned.count("GreaterThanOrEqual(b0,2)") == 2  # both scans


def test_stored_arrays_of_other_grids_meet_by_cells(tmp_path):
    a, b = _stored(X, (4, 5), tmp_path, "a"), _stored(X * 2, (3, 6), tmp_path, "b")
    np.testing.assert_array_equal((a + b).numpy(), X * 3)
    with np.errstate(divide="ignore"):
        i, j = _stored(np.arange(6), (2,), tmp_path, "i"), _stored(np.arange(6) - 3, (2,), tmp_path, "j")
    with pytest.raises(ArithmeticError):
        (i // j).compact()


def test_writing_cells_takes_one_exchange():
    from tesserae.sources.blocks import to_blocks

    df = to_blocks(ts.asarray(X).spread() + 1, (4, 5)).sortWithinPartitions("b0", "b1")
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange") == 1


def test_a_failed_write_leaves_nothing_behind(path, tmp_path):
    import os

    bad = ts.asarray(np.arange(4)) // ts.asarray(np.array([1, 2, 0, 1]))
    with pytest.raises(ArithmeticError):
        ts.write_array(bad, str(tmp_path / "new"))
    assert not os.path.exists(tmp_path / "new")
    with pytest.raises(ArithmeticError):
        ts.write_array(bad, path, append=True, name="bad")
    assert not os.path.exists(f"{path}/bad")
    np.testing.assert_array_equal(ts.read_array(path).numpy(), X)
    ts.write_array(ts.asarray(X), str(tmp_path / "new"))
    np.testing.assert_array_equal(ts.read_array(str(tmp_path / "new")).numpy(), X)
