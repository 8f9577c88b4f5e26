"""Method and operator forms of the functions on NDArray."""

from __future__ import annotations

from . import elementwise as E
from . import reductions as R
from . import shape_ops as S
from .array import NDArray
from .elementwise import Untyped, operand

_METHODS = {
    E: "abs absolute acos add asin atan cast ceil clamp clip cos div divide exp floor imag isfinite isinf isnan log log2 log10 map mul multiply neg negative pow power real remainder round sign sin sqrt square sub subtract tan".split(),
    R: "all any argmax argmin max mean min prod product reduce_unordered std sum var".split(),
    S: "broadcast flatten flip insert_dim permute_dims remove_dim repeat reshape roll squeeze swapdims tile unsqueeze".split(),
}


def _method(f):
    def method(self, *args, **kw):
        return f(self, *args, **kw)

    method.__name__, method.__doc__ = f.__name__, f.__doc__
    return method


for _module, _names in _METHODS.items():
    for _name in _names:
        setattr(NDArray, _name, _method(getattr(_module, _name)))


def _dunder(f, reflected: bool = False):
    def method(self, other):
        if other is None or isinstance(other, (str, bytes)) or (getattr(type(other), "__array_ufunc__", ...) is None and not isinstance(other, NDArray)):
            return NotImplemented
        return f(other, self) if reflected else f(self, other)

    return method


_floor_div = lambda a, b: E.divide(a, b, rounding_mode="floor")
_BINARY = {
    "add": E.add, "sub": E.subtract, "mul": E.multiply, "truediv": E.divide, "floordiv": _floor_div, "mod": E.remainder, "pow": E.power,
    "and": E.bitwise_and, "or": E.bitwise_or, "xor": E.bitwise_xor, "lshift": E.bitwise_left_shift, "rshift": E.bitwise_right_shift}
for _name, _f in _BINARY.items():
    setattr(NDArray, f"__{_name}__", _dunder(_f))
    setattr(NDArray, f"__r{_name}__", _dunder(_f, True))
for _name, _f in {"eq": E.equal, "ne": E.not_equal, "lt": E.less, "le": E.less_equal, "gt": E.greater, "ge": E.greater_equal}.items():
    setattr(NDArray, f"__{_name}__", _dunder(_f))
NDArray.slice = _method(S.slice_)
NDArray.__neg__ = lambda self: E.negative(self)
NDArray.__pos__ = lambda self: self
NDArray.__abs__ = lambda self: E.absolute(self)
NDArray.__invert__ = lambda self: E.bitwise_not(self)
NDArray.__hash__ = None

__all__ = ["Untyped", "operand"]
