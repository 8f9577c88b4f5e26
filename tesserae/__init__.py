"""N-dimensional arrays as Spark DataFrames."""

from .operators.array import NDArray, asarray, from_dataframe, from_function, scalar
from .operators.elementwise import (
    abs, absolute, acos, add, asin, atan, bitwise_and, bitwise_left_shift, bitwise_not, bitwise_or, bitwise_right_shift, bitwise_rotate_left,
    bitwise_rotate_right, bitwise_xor, byteswap, cast, ceil, clamp, clip, cos, count_ones, count_zeros, div, divide, dtype_sub_field, equal, exp,
    floor, greater, greater_equal, imag, isclose, isfinite, isinf, isnan, leading_zeros, less, less_equal, log, log2, log10, logical_and,
    logical_not, logical_or, logical_xor, map, map2, map_multiple, maximum, minimum, mul, multiply, neg, negative, not_equal, pow, power, real,
    remainder, reverse_bits, round, sign, sin, sqrt, square, sub, subtract, tan, trailing_zeros, transmute, where,
)
from .operators.reductions import all, any, argmax, argmin, max, mean, min, prod, product, reduce_unordered, std, sum, var
from .operators.shape_ops import (
    broadcast, concat, concatenate, flatten, flip, insert_dim, permute_dims, remove_dim, repeat, reshape, roll, slice_, squeeze, stack, swapdims, tile, unsqueeze,
)
from .operators import methods as _methods  # noqa: F401  (adds the method and operator forms)
from .plans.dtypes import DType, dtype
from .session import engine_session
from .sources.blocks import compact, read_array, write_array

slice = slice_

__all__ = [n for n in dir() if not n.startswith("_")]
