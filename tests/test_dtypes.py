import numpy as np
import pytest

from tesserae.plans import dtypes as D
from tesserae.plans import shapes as S

ARITH = [*D.REALS, *D.COMPLEXES]


def pick(a, b, table=ARITH, **kw):
    return D.resolve("op", [a, b], table, **kw)[0].name


def typed(name):
    t = D.SCALARS[name]
    return t.rank, t.size


@pytest.mark.parametrize(("a", "b", "want"), [
    ("u8", "i8", "i16"), ("u64", "i64", "f64"), ("i32", "f32", "f64"), ("i16", "f32", "f32"), ("bool", "bool", "u8"), ("u16", "u8", "u16"),
    ("f16", "f16", "f16"), ("f16", "i8", "f16"), ("f16", "i16", "f32"), ("c64", "f32", "c64"), ("c64", "f64", "c128"), ("i64", "f32", "f64"), ("u32", "i32", "i64")])
def test_pairs(a, b, want):
    assert pick(typed(a), typed(b)) == want


def test_plain_numbers_take_the_arrays_type():
    assert pick(typed("i8"), (D.INT, None)) == "i8"
    assert pick(typed("u16"), (D.INT, None)) == "u16"
    assert pick(typed("f32"), (D.FLOAT, None)) == "f32"
    assert pick((D.INT, None), (D.INT, None)) == "u64" or pick((D.INT, None), (D.INT, None)) == "i64"
    assert pick(typed("i32"), (D.FLOAT, None)) == "f64"


def test_comparisons_keep_mixed_64_bit_pairs_exact():
    row = D.resolve("lt", [typed("u64"), typed("i64")], [D.u64, D.i64, (D.u64, D.i64), D.f64])
    assert [t.name for t in row] == ["u64", "i64"]


def test_half_rows_need_a_half_operand():
    assert D.resolve("exp", [typed("i8")], D.FLOATS)[0] == D.f32
    assert D.resolve("exp", [typed("i32")], D.FLOATS)[0] == D.f64


def test_unsupported():
    with pytest.raises(TypeError):
        D.resolve("isnan", [typed("i32")], D.FLOATS, D.NONE)
    with pytest.raises(TypeError):
        D.dtype(">i4")
    with pytest.raises(TypeError):
        D.dtype("U3")


def test_struct_and_inner_types():
    t = D.dtype([("p", "f4", (3,)), ("id", "u4")])
    assert t.spark == "struct<p:array<float>,id:bigint>"
    assert t.numpy == np.dtype([("p", "f4", (3,)), ("id", "u4")])


def test_index_parsing():
    assert S.parse_index((slice(1, 3), -1), (4, 5)) == [(1, 3, True), (4, 5, False)]
    assert S.parse_index(..., (2, 3)) == [(0, 2, True), (0, 3, True)]
    for bad, err in ((slice(0, 9), IndexError), (7, IndexError), (True, TypeError), (slice(0, 2, 2), ValueError), ((0, 0, 0), IndexError), ("x", TypeError)):
        with pytest.raises(err):
            S.parse_index(bad, (4, 5))


def test_shapes():
    assert S.broadcast([(3, 1), (4,)]) == (3, 4)
    assert S.reshaped((2, 6), (3, -1)) == (3, 4)
    with pytest.raises(RuntimeError):
        S.broadcast([(3,), (4,)])
    with pytest.raises(ValueError):
        S.reshaped((2, 6), (5, -1))
    with pytest.raises(ValueError):
        S.dim(2, 2)
