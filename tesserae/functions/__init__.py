"""Column kernels: one element in, one element out, all of them inside whole-stage codegen."""
