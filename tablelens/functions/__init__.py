"""Column-expression helpers and distributed building blocks shared by operators."""
