"""Column builders and vector kernels shared by the operators."""
