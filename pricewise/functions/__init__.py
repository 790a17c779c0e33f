"""Column-expression builders (JVM-side, codegen-friendly): null-safe predicates,
scalar functions H1-H11, the inverse normal CDF, and exact quantiles."""
