"""Inverse of the standard normal CDF as a Column expression.

Wichura's algorithm AS 241 (PPND16, Applied Statistics 37(3), 1988), accurate
to about 1e-16; the same rational approximations Python's
``statistics.NormalDist.inv_cdf`` uses. Evaluated in the JVM, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published AS 241 coefficients, lowest power first.
CENTRAL_NUM = [3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3,
               1.3731693765509461125e+4, 4.5921953931549871457e+4, 6.7265770927008700853e+4,
               3.3430575583588128105e+4, 2.5090809287301226727e+3]
CENTRAL_DEN = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
               2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4,
               5.2264952788528545610e+3]
INTER_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
             3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
             2.27238449892691845833e-2, 7.74545014278341407640e-4]
INTER_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
             1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
             1.05075007164441684324e-9]
TAIL_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
            2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
            2.71155556874348757815e-5, 2.01033439929228813265e-7]
TAIL_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
            2.04426310338993978564e-15]


def horner(coefs: list[float], r: Column) -> Column:
    acc = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        acc = acc * r + F.lit(c)
    return acc


def norm_ppf(p) -> Column:
    """Quantile of the standard normal distribution at probability ``p`` (0<p<1)."""
    p = F.col(p) if isinstance(p, str) else p
    q = p - 0.5
    r_c = F.lit(0.180625) - q * q
    central = q * horner(CENTRAL_NUM, r_c) / horner(CENTRAL_DEN, r_c)
    r_t = F.sqrt(-F.log(F.least(p, 1 - p)))
    inter = horner(INTER_NUM, r_t - 1.6) / horner(INTER_DEN, r_t - 1.6)
    tail = horner(TAIL_NUM, r_t - 5.0) / horner(TAIL_DEN, r_t - 5.0)
    outer = F.when(r_t <= 5.0, inter).otherwise(tail)
    outer = F.when(q < 0, -outer).otherwise(outer)
    return F.when(F.abs(q) <= 0.425, central).otherwise(outer)


def with_norm_ppf(df, p: str, out: str):
    """``df`` plus ``out`` = norm_ppf(``p``), evaluated in two projections so the
    shared sub-expressions are computed once (and generated code stays small)."""
    q = F.col(p) - 0.5
    staged = df.select("*", q.alias("_q"), (F.lit(0.180625) - q * q).alias("_rc"),
                       F.sqrt(-F.log(F.least(F.col(p), 1 - F.col(p)))).alias("_rt"))
    qc, rc, rt = F.col("_q"), F.col("_rc"), F.col("_rt")
    central = qc * horner(CENTRAL_NUM, rc) / horner(CENTRAL_DEN, rc)
    inter = horner(INTER_NUM, rt - 1.6) / horner(INTER_DEN, rt - 1.6)
    tail = horner(TAIL_NUM, rt - 5.0) / horner(TAIL_DEN, rt - 5.0)
    outer = F.when(rt <= 5.0, inter).otherwise(tail)
    outer = F.when(qc < 0, -outer).otherwise(outer)
    return staged.withColumn(out, F.when(F.abs(qc) <= 0.425, central).otherwise(outer)).drop(
        "_q", "_rc", "_rt")


def sql_norm_ppf(p: str) -> str:
    """The same expression as SQL text (for the oracle)."""
    def h(coefs, r):
        acc = repr(coefs[-1])
        for c in reversed(coefs[:-1]):
            acc = f"({acc}) * ({r}) + {c!r}"
        return acc
    q = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {q} * {q})"
    rt = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    central = f"{q} * ({h(CENTRAL_NUM, rc)}) / ({h(CENTRAL_DEN, rc)})"
    inter = f"({h(INTER_NUM, rt + ' - 1.6')}) / ({h(INTER_DEN, rt + ' - 1.6')})"
    tail = f"({h(TAIL_NUM, rt + ' - 5.0')}) / ({h(TAIL_DEN, rt + ' - 5.0')})"
    outer = f"(CASE WHEN {rt} <= 5.0 THEN {inter} ELSE {tail} END)"
    return (f"(CASE WHEN abs({q}) <= 0.425 THEN {central} "
            f"WHEN {q} < 0 THEN -{outer} ELSE {outer} END)")
