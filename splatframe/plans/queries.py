"""Queries over the driver's tables, one or more for each operator, with oracles in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splatframe.functions import activation, color, covariance, quaternion, sh, text
from splatframe.operators import densify, mesh, ranks, reconstruct, render, scene, spatial, validate
from splatframe.operators.cut import cut
from splatframe.plans import views
from splatframe.plans.views import BIG_SQL, CANON_SQL, DEPTH_SQL, FRAMES_SQL, LOSSES_SQL, TRAIN_SQL, VERTICES_SQL, rnd, sql_rnd, table
from splatframe.sources import files
from splatframe.streaming import frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return keep


def _scalar(name: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], view: str = "train") -> None:
    """A projection of a cloud: rounded doubles by name, and the same in SQL."""
    make, cte, short = {
        "train": (views.cloud_train, TRAIN_SQL, "t"), "canon": (views.cloud_canonical, CANON_SQL, "c"),
        "vertices": (views.vertices, VERTICES_SQL, "v"), "depth": (views.depth_views, DEPTH_SQL, "d"),
    }[view]
    key = ["splat_id"] if view != "depth" else ["view", "u", "v", "s"]
    body = ", ".join(f"{sql_rnd(x)} AS {n}" for n, x in sql.items())
    QUERIES[name] = lambda spark, d: make(spark, d).select(*key, *(rnd(c).alias(n) for n, c in columns().items()))
    ORACLE[name] = f"WITH {cte} SELECT {', '.join(key)}, {body} FROM {short}"


c = F.col
Q = lambda: tuple(c(n) for n in ("qx", "qy", "qz", "qw"))
S = lambda: tuple(c(n) for n in ("sx", "sy", "sz"))
RAW = lambda: tuple(c(f"rot_{k}") for k in (1, 2, 3, 0))

# Activations and colour.
_scalar("rgb_to_sh_dc", lambda: {"dc": color.rgb_to_sh_dc(c("x"))}, {"dc": "(x-0.5)/0.28209479177387814"})
_scalar("sh_dc_to_rgb", lambda: {"rgb": color.sh_dc_to_rgb(c("x"))}, {"rgb": "x*0.28209479177387814+0.5"})
_scalar("srgb_to_linear", lambda: {"v": color.srgb_to_linear(F.abs(c("x")))}, {"v": "CASE WHEN abs(x)<=0.04045 THEN abs(x)/12.92 ELSE pow((abs(x)+0.055)/1.055, 2.4) END"})
_scalar("linear_to_srgb", lambda: {"v": color.linear_to_srgb(F.abs(c("x")))}, {"v": "CASE WHEN abs(x)<=0.0031308 THEN abs(x)*12.92 ELSE 1.055*pow(abs(x), 1/2.4)-0.055 END"})
_scalar("sigmoid", lambda: {"p": activation.sigmoid(c("opacity") * 10)}, {"p": "1/(1+exp(-(opacity*10)))"})
_scalar("logit", lambda: {"v": activation.logit(c("x") * 3)}, {"v": "CASE WHEN x*3>0 AND x*3<1 THEN ln((x*3)/(1-x*3)) END"})
_scalar("logit_clamped", lambda: {"v": activation.logit_clamped(c("x") * 3)}, {"v": "ln(greatest(least(x*3,1-1e-6),1e-6)/(1-greatest(least(x*3,1-1e-6),1e-6)))"})
_scalar("exp_scale", lambda: {"s": activation.linear_scale_from_log(c("scale_0") * 20)}, {"s": "exp(scale_0*20)"})
_scalar("log_scale", lambda: {"v": activation.log_scale_from_linear(c("scale_0"))}, {"v": "CASE WHEN scale_0>0 THEN ln(CASE WHEN scale_0>0 THEN scale_0 END) END"})
_scalar("scale_to_log_gpu", lambda: {"v": activation.scale_to_log_floor(c("scale_0"))}, {"v": "ln(greatest(scale_0,1e-7))"})


@_query("activation_codes", f"WITH {TRAIN_SQL} SELECT splat_id, CASE WHEN abs(scale_0*400)>80 THEN 'MK1105' END AS exp_code, CASE WHEN x*3<=0 OR x*3>=1 THEN 'MK1103' END AS logit_code, CASE WHEN scale_1<=0 THEN 'MK1107' END AS log_code FROM t")
def activation_codes(spark, d):
    a = activation.code
    return views.cloud_train(spark, d).select("splat_id", a("exp", c("scale_0") * 400).alias("exp_code"), a("logit", c("x") * 3).alias("logit_code"), a("log", c("scale_1")).alias("log_code"))


# Quaternions.
_M = {
    "m0": "1-2*(qy*qy+qz*qz)", "m1": "2*(qx*qy-qz*qw)", "m2": "2*(qx*qz+qy*qw)", "m3": "2*(qx*qy+qz*qw)", "m4": "1-2*(qx*qx+qz*qz)",
    "m5": "2*(qy*qz-qx*qw)", "m6": "2*(qx*qz-qy*qw)", "m7": "2*(qy*qz+qx*qw)", "m8": "1-2*(qx*qx+qy*qy)",
}
_NAMES = ("qx", "qy", "qz", "qw")
_norm = "sqrt(rot_1*rot_1+rot_2*rot_2+rot_3*rot_3+rot_0*rot_0)"
_scalar("quat_norm", lambda: {"n": quaternion.norm(*RAW())}, {"n": _norm})
_scalar("quat_normalize", lambda: dict(zip(_NAMES, quaternion.normalize(*RAW()))), {n: f"rot_{k}/{_norm}" for n, k in zip(_NAMES, (1, 2, 3, 0))})
_scalar("quat_normalize_compat", lambda: dict(zip(_NAMES, quaternion.normalize_compat(*RAW()))), {n: f"(CASE WHEN rot_0<0 THEN -1 ELSE 1 END)*rot_{k}/{_norm}" for n, k in zip(_NAMES, (1, 2, 3, 0))})
_scalar("quat_to_matrix", lambda: {f"m{k}": v for k, v in enumerate(quaternion.to_matrix(*Q()))}, _M, "canon")
_scalar("matrix_to_quat", lambda: dict(zip(("a", "b", "g", "w"), quaternion.from_matrix(quaternion.to_matrix(*Q())))), {n: f"(CASE WHEN qw<0 THEN -1 ELSE 1 END)*{q}" for n, q in zip(("a", "b", "g", "w"), _NAMES)}, "canon")
_scalar("frame_to_quat", lambda: dict(zip(("a", "b", "g", "w"), quaternion.from_frame(quaternion.to_matrix(*Q())))), {n: f"(CASE WHEN qw<0 THEN -1 ELSE 1 END)*{q}" for n, q in zip(("a", "b", "g", "w"), _NAMES)}, "canon")
_SECOND = lambda: quaternion.normalize(c("x"), c("y"), c("z"), F.lit(0.5))
_n2 = "sqrt(x*x+y*y+z*z+0.25)"
_b = [f"(x/{_n2})", f"(y/{_n2})", f"(z/{_n2})", f"(0.5/{_n2})"]
_scalar("quat_angular_distance", lambda: {"a": quaternion.angular_distance(Q(), _SECOND())}, {"a": f"2*acos(least(1.0, abs(qx*{_b[0]}+qy*{_b[1]}+qz*{_b[2]}+qw*{_b[3]})))"}, "canon")
_scalar(
    "quat_multiply", lambda: dict(zip(("a", "b", "g", "w"), quaternion.multiply(Q(), _SECOND()))),
    {
        "a": f"qw*{_b[0]}+qx*{_b[3]}+qy*{_b[2]}-qz*{_b[1]}", "b": f"qw*{_b[1]}-qx*{_b[2]}+qy*{_b[3]}+qz*{_b[0]}",
        "g": f"qw*{_b[2]}+qx*{_b[1]}-qy*{_b[0]}+qz*{_b[3]}", "w": f"qw*{_b[3]}-qx*{_b[0]}-qy*{_b[1]}-qz*{_b[2]}",
    }, "canon",
)


@_query("quat_is_unit", f"WITH {CANON_SQL} SELECT c.splat_id, c.splat_id % 4 < 2 AS unit, abs({_norm}-1) <= 1e-3 AS raw_unit FROM c JOIN t USING (splat_id)")
def quat_is_unit(spark, d):
    """Rows are stretched by 0, 5, 20 or 35 ten thousandths."""
    t = views.cloud_train(spark, d)
    k = c("splat_id") % 4
    stretch = F.when(k == 0, F.lit(1.0)).when(k == 1, F.lit(1.0005)).when(k == 2, F.lit(1.002)).otherwise(F.lit(1.0035))
    near = [v * stretch for v in quaternion.normalize(*RAW())]
    return t.select("splat_id", quaternion.is_unit(*near).alias("unit"), quaternion.is_unit(*RAW()).alias("raw_unit"))


_scalar(
    "normal_to_quat", lambda: dict(zip(_NAMES, quaternion.from_normal(c("nx"), c("ny"), c("nz")))),
    {
        "qx": "CASE WHEN nz>0.9999 THEN 0 WHEN nz<-0.9999 THEN 1 ELSE -ny/sqrt(2*greatest(1+nz,1e-12)) END", "qy": "CASE WHEN nz>0.9999 OR nz<-0.9999 THEN 0 ELSE nx/sqrt(2*(1+nz)) END",
        "qz": "CASE WHEN nz IS NOT NULL OR nz IS NULL THEN 0.0 END", "qw": "CASE WHEN nz>0.9999 THEN 1 WHEN nz<-0.9999 THEN 0 ELSE sqrt(2*(1+nz))/2 END",
    }, "vertices",
)
_scalar(
    "surface_frame", lambda: {f"{n}{k}": v for n, w in zip("tb", quaternion.surface_frame(c("qx"), c("qy"), c("qz"))) for k, v in enumerate(w)},
    {
        "t0": "CASE WHEN abs(qx)<0.9 THEN 0.0 ELSE -qz END/h", "t1": "CASE WHEN abs(qx)<0.9 THEN qz ELSE 0.0 END/h", "t2": "CASE WHEN abs(qx)<0.9 THEN -qy ELSE qx END/h",
        "b0": "CASE WHEN abs(qx)<0.9 THEN -qy*qy-qz*qz ELSE qy*qx END/h", "b1": "CASE WHEN abs(qx)<0.9 THEN qx*qy ELSE -qz*qz-qx*qx END/h", "b2": "CASE WHEN abs(qx)<0.9 THEN qx*qz ELSE qy*qz END/h",
    }, "canon",
)
ORACLE["surface_frame"] = ORACLE["surface_frame"].replace("FROM c", "FROM (SELECT *, CASE WHEN abs(qx)<0.9 THEN sqrt(qz*qz+qy*qy) ELSE sqrt(qz*qz+qx*qx) END AS h FROM c)")
_scalar("major_axis", lambda: dict(zip(("ux", "uy", "uz"), quaternion.major_axis(Q(), S()))), {n: f"CASE WHEN sx>=sy AND sx>=sz THEN {_M[f'm{3 * k}']} WHEN sy>=sz THEN {_M[f'm{3 * k + 1}']} ELSE {_M[f'm{3 * k + 2}']} END" for k, n in enumerate(("ux", "uy", "uz"))}, "canon")

# Covariances.
_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _sigma_sql(s: tuple[str, str, str]) -> dict[str, str]:
    m = [f"({_M[f'm{k}']})" for k in range(9)]
    return {n: "+".join(f"{m[3 * i + k]}*{m[3 * j + k]}*({s[k]})*({s[k]})" for k in range(3)) for n, (i, j) in zip(covariance.NAMES, _PAIRS)}


_SIGMA = _sigma_sql(("sx", "sy", "sz"))
A = [1.0, 0.5, 0.0, -0.25, 2.0, 0.125, 0.0, 0.75, 1.5]
_scalar("covariance", lambda: dict(zip(covariance.NAMES, covariance.covariance(Q(), S()))), _SIGMA, "canon")
_scalar("c_matrix", lambda: {f"k{k}": v for k, v in enumerate(covariance.c_matrix(Q(), S()))}, {f"k{k}": f"({_M[f'm{k}']})*{('sx', 'sy', 'sz')[k % 3]}" for k in range(9)}, "canon")


@_query("covariance_compat", f"WITH {TRAIN_SQL}, c AS (SELECT *, rot_1 AS qx, rot_2 AS qy, rot_3 AS qz, rot_0 AS qw FROM t) SELECT splat_id, " + ", ".join(f"{sql_rnd(x)} AS {n}" for n, x in _sigma_sql(("exp(scale_0)", "exp(scale_1)", "exp(scale_2)")).items()) + " FROM c")
def covariance_compat(spark, d):
    s = covariance.covariance_compat(RAW(), tuple(c(f"scale_{k}") for k in range(3)))
    return views.cloud_train(spark, d).select("splat_id", *(rnd(v).alias(n) for v, n in zip(s, covariance.NAMES)))


_full = {(i, j): f"s.{covariance.NAMES[_PAIRS.index((min(i, j), max(i, j)))]}" for i in range(3) for j in range(3)}
_affine = {n: "+".join(f"({A[3 * i + p]})*({A[3 * j + q]})*{_full[p, q]}" for p in range(3) for q in range(3)) for n, (i, j) in zip(covariance.NAMES, _PAIRS)}
_WITH_SIGMA = f"WITH {CANON_SQL}, s AS (SELECT splat_id, " + ", ".join(f"{x} AS {n}" for n, x in _SIGMA.items()) + " FROM c)"


@_query("affine_gaussian", _WITH_SIGMA + " SELECT splat_id, " + ", ".join(f"{sql_rnd(x)} AS {n}" for n, x in _affine.items()) + " FROM s")
def affine_gaussian(spark, d):
    s = covariance.affine(covariance.covariance(Q(), S()), A)
    return views.cloud_canonical(spark, d).select("splat_id", *(rnd(v).alias(n) for v, n in zip(s, covariance.NAMES)))


@_query("cov_to_rot_scale", _WITH_SIGMA + " SELECT splat_id, true AS valid, " + ", ".join(f"{sql_rnd('s.' + n)} AS {n}" for n in covariance.NAMES) + " FROM s")
def cov_to_rot_scale(spark, d):
    """The covariance that the decomposition's rotation and scales make again: unique, as they are not."""
    rows = views.cloud_canonical(spark, d).select("splat_id", *(v.alias(n) for v, n in zip(covariance.covariance(Q(), S()), covariance.NAMES)))
    out = covariance.decompose(rows)
    return out.select("splat_id", "valid", *(rnd(v).alias(n) for v, n in zip(covariance.covariance(Q(), S()), covariance.NAMES)))


@_query("eigen3_jacobi", _WITH_SIGMA + f" SELECT splat_id, {sql_rnd('greatest(sx,sy,sz)*greatest(sx,sy,sz)')} AS v0, {sql_rnd('sx*sx+sy*sy+sz*sz-greatest(sx,sy,sz)*greatest(sx,sy,sz)-least(sx,sy,sz)*least(sx,sy,sz)')} AS v1, {sql_rnd('least(sx,sy,sz)*least(sx,sy,sz)')} AS v2 FROM c")
def eigen3_jacobi(spark, d):
    """Eigenvalues by batches, descending."""
    rows = views.cloud_canonical(spark, d).select("splat_id", *(v.alias(n) for v, n in zip(covariance.covariance(Q(), S()), covariance.NAMES)))
    return covariance.decompose(rows).select("splat_id", *(rnd(c(n) * c(n)).alias(f"v{k}") for k, n in enumerate(("sx", "sy", "sz"))))


@_query("eigen3_closed", _WITH_SIGMA + f" SELECT splat_id, {sql_rnd('least(sx,sy,sz)*least(sx,sy,sz)')} AS v0, {sql_rnd('greatest(sx,sy,sz)*greatest(sx,sy,sz)')} AS v2 FROM c")
def eigen3_closed(spark, d):
    rows = views.cloud_canonical(spark, d).select("splat_id", *(v.alias(n) for v, n in zip(covariance.covariance(Q(), S()), covariance.NAMES)))
    return covariance.with_eigenvalues(rows).select("splat_id", rnd(c("v0")).alias("v0"), rnd(c("v2")).alias("v2"))


# Harmonics.
_dx, _dy, _dz = (f"({a}/sqrt(x*x+y*y+z*z))" for a in "xyz")
_DIR = lambda: tuple(c(a) / F.sqrt(c("x") * c("x") + c("y") * c("y") + c("z") * c("z")) for a in "xyz")


class _Sql(str):
    """SQL text with arithmetic, so one definition of the basis gives both."""

    def _op(self, o, sign, back=False):
        return _Sql(f"({o}{sign}{self})" if back else f"({self}{sign}{o})")

    def __add__(self, o):
        return self._op(o, "+")

    def __radd__(self, o):
        return self._op(o, "+", True)

    def __sub__(self, o):
        return self._op(o, "-")

    def __rsub__(self, o):
        return self._op(o, "-", True)

    def __mul__(self, o):
        return self._op(o, "*")

    def __rmul__(self, o):
        return self._op(o, "*", True)


_BASIS = sh._polynomials(_Sql(_dx), _Sql(_dy), _Sql(_dz))
_scalar("sh_basis", lambda: {f"b{k}": v for k, v in enumerate(sh.basis(*_DIR()))}, {f"b{k}": v for k, v in enumerate(_BASIS)})
_scalar("sh_evaluate", lambda: {n: v for n, v in zip("rgb", sh.evaluate(c("sh"), 3, _DIR()))}, {n: "+".join(f"{_BASIS[k]}*sh[{3 * k + i + 1}]" for k in range(16)) for i, n in enumerate("rgb")})
_ENERGY = lambda v, l, i: sum((v[3 * k + i] * v[3 * k + i] for k in range(l * l + 1, (l + 1) ** 2)), v[3 * l * l + i] * v[3 * l * l + i])  # noqa: E731, E741
TURN = [0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6]
_BACK = sh._polynomials(_Sql("hx"), _Sql("hy"), _Sql("hz"))


@_query("sh_rotate", f"WITH {TRAIN_SQL} SELECT splat_id, " + ", ".join(f"{sql_rnd('+'.join(f'sh[{3 * k + i + 1}]*sh[{3 * k + i + 1}]' for k in range(l * l, (l + 1) ** 2)))} AS e{l}_{i}" for l in range(4) for i in range(3)) + ", " + ", ".join(f"{sql_rnd('+'.join(f'{_BACK[k]}*sh[{3 * k + i + 1}]' for k in range(16)))} AS {n}" for i, n in enumerate("rgb")) + f" FROM (SELECT *, " + ", ".join(f"{TURN[j]}*{_dx}+{TURN[3 + j]}*{_dy}+{TURN[6 + j]}*{_dz} AS h{a}" for j, a in enumerate("xyz")) + " FROM t)")
def sh_rotate(spark, d):
    """A turn keeps the energy of each band and channel; turned harmonics seen along a direction have the colour of the
    old ones along the direction turned back."""
    turned = views.cloud_train(spark, d).withColumn("w", sh.rotate(c("sh"), TURN, 3))
    seen = zip("rgb", sh.evaluate(c("w"), 3, _DIR()))
    return turned.select("splat_id", *(rnd(_ENERGY(c("w"), l, i)).alias(f"e{l}_{i}") for l in range(4) for i in range(3)), *(rnd(v).alias(n) for n, v in seen))


@_query("sh_address", "SELECT CAST(k AS BIGINT) AS k, CAST(floor(sqrt(k)) AS INTEGER) AS l, CAST(k-floor(sqrt(k))*floor(sqrt(k)) AS INTEGER) AS n, CAST(k AS BIGINT) AS back FROM range(25) r(k)")
def sh_address(spark, d):
    l, n = sh.address_of(c("id"))  # noqa: E741
    return spark.range(25).select(c("id").alias("k"), l.alias("l"), n.alias("n"), sh.flat_of(l, n).cast("long").alias("back"))


@_query("sh_attribute", "SELECT CAST(k AS BIGINT) AS k, 'KHR_gaussian_splatting:SH_DEGREE_'||CAST(floor(sqrt(k)) AS INTEGER)||'_COEF_'||CAST(k-floor(sqrt(k))*floor(sqrt(k)) AS INTEGER) AS name, CAST(floor(sqrt(k)) AS INTEGER) AS l, CAST(k-floor(sqrt(k))*floor(sqrt(k)) AS INTEGER) AS n FROM range(25) r(k)")
def sh_attribute(spark, d):
    name = sh.attribute(*sh.address_of(c("id")))
    rows = spark.range(25).withColumn("name", name)
    l, n = sh.parse_attribute(c("name"))  # noqa: E741
    return rows.select(c("id").alias("k"), "name", l.alias("l"), n.alias("n"))


@_query("sh_transpose_ply", f"WITH {TRAIN_SQL} SELECT splat_id, i AS k, {sql_rnd('sh[3*((i % 15)+1)+(i//15)+1]')} AS v FROM t, range(45) r(i)")
def sh_transpose_ply(spark, d):
    t = views.cloud_train(spark, d)
    return t.select("splat_id", F.posexplode(sh.to_channel_major(c("sh"), 3)).alias("p", "w")).select("splat_id", c("p").cast("long").alias("k"), rnd(c("w")).alias("v"))


@_query("sh_pad_truncate", f"WITH {TRAIN_SQL} SELECT splat_id, CAST(75 AS BIGINT) AS padded, CAST(12 AS BIGINT) AS cut, {sql_rnd('list_sum(sh[1:12])')} AS total FROM t")
def sh_pad_truncate(spark, d):
    cut = sh.truncate(c("sh"), 1)
    total = F.aggregate(cut, F.lit(0.0), lambda a, v: a + v)
    return views.cloud_train(spark, d).select("splat_id", F.size(sh.pad(c("sh"), 4)).cast("long").alias("padded"), F.size(cut).cast("long").alias("cut"), rnd(total).alias("total"))


# Geometry.
M16 = [1.0, 0.5, 0.0, 0.125, 0.0, 2.0, 0.25, 0.0, -0.5, 0.0, 1.0, 0.0, 10.0, 20.0, 30.0, 1.0]
_P = lambda: [c(a) for a in "xyz"]
_rows = [f"({M16[i]})*x+({M16[4 + i]})*y+({M16[8 + i]})*z+({M16[12 + i]})" for i in range(4)]
_scalar("transform_coordinates", lambda: dict(zip(("tx", "ty", "tz"), scene.transform_coordinates(_P(), M16))), dict(zip(("tx", "ty", "tz"), _rows)))
_scalar("transform_point", lambda: dict(zip(("tx", "ty", "tz"), scene.transform_point(_P(), M16))), {n: f"({_rows[i]})/({_rows[3]})" for i, n in enumerate(("tx", "ty", "tz"))})
_scalar("scale_positions", lambda: {f"s{a}": c(a) * 2.5 for a in "xyz"}, {f"s{a}": f"{a}*2.5" for a in "xyz"})
_scalar("y_up_to_z_up", lambda: dict(zip(("a", "b", "g"), scene.y_up_to_z_up(_P()))), {"a": "x", "b": "-z", "g": "y"})
_scalar("coord_frame", lambda: dict(zip(("a", "b", "g"), scene.position_to_frame(_P(), [0, 0, 1, 1, 0, 0, 0, 1, 0], 0.01))), {"a": "0.01*z", "b": "0.01*x", "g": "0.01*y"})
# Cofactors of M16's upper part, by hand: rows of the adjugate's transpose.
_a = [[M16[4 * j + i] for j in range(3)] for i in range(3)]
_cof = [[_a[(i + 1) % 3][(j + 1) % 3] * _a[(i + 2) % 3][(j + 2) % 3] - _a[(i + 1) % 3][(j + 2) % 3] * _a[(i + 2) % 3][(j + 1) % 3] for j in range(3)] for i in range(3)]
_nn = [f"(({_cof[i][0]})*x+({_cof[i][1]})*y+({_cof[i][2]})*z)" for i in range(3)]
_scalar("transform_normal", lambda: dict(zip(("tx", "ty", "tz"), scene.transform_normal(_P(), M16))), {n: f"{_nn[i]}/sqrt({_nn[0]}*{_nn[0]}+{_nn[1]}*{_nn[1]}+{_nn[2]}*{_nn[2]})" for i, n in enumerate(("tx", "ty", "tz"))})


@_query("process_cloud", f"WITH {TRAIN_SQL} SELECT splat_id, {sql_rnd('x*2.0')} AS x, {sql_rnd('-(z*2.0)')} AS y, {sql_rnd('y*2.0')} AS z, {sql_rnd('(e60-0.5)/0.28209479177387814')} AS r, {sql_rnd(f'abs(rot_0)/{_norm}')} AS rot_0, {sql_rnd('ln(greatest(least(opacity,1-1e-6),1e-6)/(1-greatest(least(opacity,1-1e-6),1e-6)))')} AS opacity FROM t")
def process_cloud(spark, d):
    rows = views.cloud_train(spark, d).withColumns({"r": c("e60"), "g": c("e61"), "b": c("e62")})
    return mesh.process_cloud(rows, scale=2.0).select("splat_id", *(rnd(c(n)).alias(n) for n in ("x", "y", "z", "r", "rot_0", "opacity")))


@_query("pack_unpack", f"WITH {TRAIN_SQL} SELECT splat_id, {sql_rnd('x')} AS x, {sql_rnd('opacity')} AS opacity, {sql_rnd('scale_2')} AS scale_2, {sql_rnd('rot_3')} AS rot_3, {sql_rnd('sh[3]')} AS blue FROM t")
def pack_unpack(spark, d):
    out = mesh.unpack(mesh.pack(views.cloud_train(spark, d)))
    return out.select("splat_id", *(rnd(c(n)).alias(n) for n in ("x", "opacity", "scale_2", "rot_3")), rnd(c("sh")[2]).alias("blue"))


# Validation and inspection.
_BROKEN = f"{CANON_SQL}, w AS (SELECT splat_id, CASE WHEN splat_id % 11 = 0 THEN CAST('inf' AS DOUBLE) ELSE x END AS x, y, z, CASE WHEN splat_id % 7 = 0 THEN -sx ELSE sx END AS sx, sy, sz, opacity*CASE WHEN splat_id % 13 = 0 THEN 3 ELSE 1 END AS opacity, qx, qy, qz, qw, CASE WHEN splat_id % 17 = 0 THEN 2 ELSE 3 END AS sh_degree FROM c), k AS (SELECT splat_id, CASE WHEN sh_degree <> 3 THEN 'MK1501' WHEN NOT isfinite(x) THEN 'MK1504' WHEN sx <= 0 THEN 'MK1505' WHEN opacity > 1 THEN 'MK1506' END AS code FROM w)"


def _broken(spark, d):
    k = c("splat_id")
    return views.cloud_canonical(spark, d).withColumns({
        "x": F.when(k % 11 == 0, F.lit(float("inf"))).otherwise(c("x")), "sx": F.when(k % 7 == 0, -c("sx")).otherwise(c("sx")),
        "opacity": c("opacity") * F.when(k % 13 == 0, F.lit(3)).otherwise(F.lit(1)), "sh_degree": F.when(k % 17 == 0, F.lit(2)).otherwise(F.lit(3)),
    })


@_query("validate_splats", f"WITH {_BROKEN} SELECT splat_id, code FROM k")
def validate_splats(spark, d):
    return validate.validate(_broken(spark, d)).select("splat_id", "code")


@_query("first_offender", f"WITH {_BROKEN} SELECT code, count(*) AS n, min(splat_id) AS first_index FROM k WHERE code IS NOT NULL GROUP BY code")
def first_offender(spark, d):
    return validate.first_offenders(validate.validate(_broken(spark, d)))


@_query("finite_filter", f"WITH {_BROKEN} SELECT splat_id FROM w WHERE isfinite(x) AND isfinite(y) AND isfinite(z)")
def finite_filter(spark, d):
    return spatial.finite(_broken(spark, d)).select("splat_id")


_SCALED = "CASE splat_id % 5 WHEN 0 THEN 1e20 WHEN 1 THEN 1e-30 WHEN 2 THEN 1e-20 ELSE 0.5 END"


def _scaled(spark, d):
    k = c("splat_id") % 5
    s = F.when(k == 0, F.lit(1e20)).when(k == 1, F.lit(1e-30)).when(k == 2, F.lit(1e-20)).otherwise(F.lit(0.5))
    return views.cloud_canonical(spark, d).withColumn("sx", s)


@_query("scale_class", f"WITH {CANON_SQL}, w AS (SELECT splat_id, CAST({_SCALED} AS FLOAT)*CAST({_SCALED} AS FLOAT) AS q FROM c) SELECT splat_id, CASE WHEN isinf(q) THEN 'overflow' WHEN q=0 THEN 'underflow' WHEN CAST(q AS DOUBLE)<1.1754943508222875e-38 THEN 'subnormal' END AS class FROM w")
def scale_class(spark, d):
    return _scaled(spark, d).select("splat_id", validate.scale_class(c("sx")).alias("class"))


_INSPECT = (
    f"WITH {CANON_SQL}, w AS (SELECT *, CAST({_SCALED} AS FLOAT)*CAST({_SCALED} AS FLOAT) AS q FROM c), i AS (SELECT count(*) AS splats, max(sh_degree) AS sh_degree, "
    + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz")
    + ", count(*) FILTER (WHERE false) AS n_invalid, CAST(NULL AS BIGINT) AS first_invalid, count(*) FILTER (WHERE isinf(q)) AS n_overflow, min(splat_id) FILTER (WHERE isinf(q)) AS first_overflow, "
    "count(*) FILTER (WHERE q=0) AS n_underflow, min(splat_id) FILTER (WHERE q=0) AS first_underflow, count(*) FILTER (WHERE q>0 AND CAST(q AS DOUBLE)<1.1754943508222875e-38) AS n_subnormal, "
    "min(splat_id) FILTER (WHERE q>0 AND CAST(q AS DOUBLE)<1.1754943508222875e-38) AS first_subnormal FROM w)"
)


@_query("inspect_cloud", _INSPECT + " SELECT * FROM i")
def inspect_cloud(spark, d):
    return validate.inspect_cloud(_scaled(spark, d))


@_query("issues", _INSPECT + " SELECT * FROM (SELECT 2 AS place, 'scale_covariance_overflow' AS code, 'error' AS severity, n_overflow AS n, first_overflow AS first_index FROM i UNION ALL SELECT 3, 'scale_covariance_underflow', 'error', n_underflow, first_underflow FROM i UNION ALL SELECT 4, 'scale_covariance_subnormal', 'warning', n_subnormal, first_subnormal FROM i) WHERE n > 0")
def issues(spark, d):
    return validate.issues(validate.inspect_cloud(_scaled(spark, d)))


@_query("issue_counts", _INSPECT + " SELECT n_overflow+n_underflow AS errors, n_subnormal AS warnings, n_overflow+n_underflow=0 AS valid FROM i")
def issue_counts(spark, d):
    return validate.issue_counts(validate.issues(validate.inspect_cloud(_scaled(spark, d))))


@_query("inspect_text", _INSPECT + " SELECT 'splats: '||splats||chr(10)||'sh degree: '||sh_degree||chr(10)||'invalid rows: '||n_invalid AS report FROM i")
def inspect_text(spark, d):
    return validate.inspect_text(validate.inspect_cloud(_scaled(spark, d)))


@_query("inspect_json")
def inspect_json(spark, d):
    return validate.inspect_json(validate.inspect_cloud(_scaled(spark, d)))


@_query("bounds", f"WITH {TRAIN_SQL} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM t")
def bounds(spark, d):
    return spatial.bounds(views.cloud_train(spark, d))


@_query("max_degree", "SELECT 3 AS degree, count(*) AS n FROM embeddings")
def max_degree(spark, d):
    return views.cloud_train(spark, d).agg(F.max("sh_degree").alias("degree"), F.count("*").alias("n"))


@_query("loss_policy", f"WITH {LOSSES_SQL} SELECT CASE WHEN severity='fatal' THEN 'MK1601' ELSE 'MK1602' END AS error, code, place FROM o WHERE severity='fatal' OR (severity='severe' AND code <> 'click') ORDER BY place LIMIT 1")
def loss_policy(spark, d):
    return validate.loss_policy(views.losses(spark, d), ["click"])


@_query("loss_summary", f"WITH {LOSSES_SQL} SELECT bool_or(severity IN ('severe','fatal')) AS has_blocking, CAST(sum(affected_splats) AS BIGINT) AS affected_splats, count(*) AS n FROM o")
def loss_summary(spark, d):
    return validate.loss_summary(views.losses(spark, d))


_NAMED = "u AS (SELECT DISTINCT c_mktsegment AS name FROM customer), r AS (SELECT DISTINCT c_mktsegment AS name FROM customer WHERE c_mktsegment < 'F'), p AS (SELECT 'BUILDING' AS name)"


@_query("ext_gate", f"WITH {_NAMED} SELECT name, 'blocking' AS verdict FROM r WHERE name NOT IN (SELECT name FROM p) UNION ALL SELECT name, 'ignored' FROM u WHERE name NOT IN (SELECT name FROM r) AND name NOT IN (SELECT name FROM p)")
def ext_gate(spark, d):
    used = table(spark, d, "customer").select(c("c_mktsegment").alias("name"))
    return validate.extension_gate(used, used.filter("name < 'F'").distinct(), spark.createDataFrame([("BUILDING",)], "name string"))


@_query("roundtrip_error", f"WITH {CANON_SQL} SELECT {sql_rnd('sqrt(avg(0.0001))')} AS position_rmse, {sql_rnd('ln(1.1)')} AS log_scale_rmse, 0.0 AS max_quat_angle, {sql_rnd('max(opacity)*0.5')} AS max_opacity_error, {sql_rnd('sqrt(sum(list_sum(list_transform(sh, lambda v: v*v)))*0.01/(count(*)*48))')} AS sh_rmse FROM c")
def roundtrip_error(spark, d):
    a = views.cloud_canonical(spark, d)
    b = a.withColumns({"x": c("x") + 0.01, "sx": c("sx") * 1.1, "sy": c("sy") * 1.1, "sz": c("sz") * 1.1, "opacity": c("opacity") * 0.5, "sh": F.transform("sh", lambda v: v * 0.9)})
    out = validate.roundtrip_error(a, b)
    return out.select(*(rnd(F.floor(c(n) * 1e5 + 0.5) / 1e5 if n == "max_quat_angle" else c(n)).alias(n) for n in out.columns))


_PROV = "p AS (SELECT event_id, CASE WHEN event_id % 3=0 THEN '' ELSE '1' END AS sv, CASE WHEN event_id % 5=0 THEN '' ELSE 'm' END AS ms, CASE WHEN event_id % 7=0 THEN 'zz' END AS sha, event_type AS op, CASE WHEN event_id % 11=0 THEN '/abs' ELSE 'rel' END AS par FROM events)"


@_query("provenance_validate", f"WITH {_PROV} SELECT event_id, CASE WHEN sv='' THEN 'MK1520' WHEN ms='' THEN 'MK1521' WHEN sha IS NOT NULL THEN 'MK1523' WHEN par='/abs' THEN 'MK1527' END AS code FROM p")
def provenance_validate(spark, d):
    return _provenance(spark, d).select("event_id", validate.provenance_code().alias("code"))


def _provenance(spark, d):
    k = c("event_id")
    op = F.struct(c("event_type").alias("name"), F.lit("1").alias("tool_version"), F.create_map(F.lit("p"), F.when(k % 11 == 0, F.lit("/abs")).otherwise(F.lit("rel"))).alias("parameters"), F.lit(None).cast("string").alias("timestamp"))
    return table(spark, d, "events").select("event_id", F.struct(
        F.when(k % 3 == 0, F.lit("")).otherwise(F.lit("1")).alias("schema_version"), F.when(k % 5 == 0, F.lit("")).otherwise(F.lit("m")).alias("model_schema"),
        F.lit("ply").alias("source_format"), F.when(k % 7 == 0, F.lit("zz")).alias("source_sha256"), F.array(op).alias("operations"),
    ).alias("provenance"))


@_query("sink_provenance", f"WITH {_PROV} SELECT CAST(to_json({{'schema_version': sv, 'model_schema': ms, 'source_format': 'ply', 'source_sha256': sha, 'operations': [{{'name': op, 'tool_version': '1', 'parameters': MAP {{'p': par}}, 'timestamp': CAST(NULL AS VARCHAR)}}]}}) AS VARCHAR) AS document FROM p")
def sink_provenance(spark, d):
    return validate.provenance_json(_provenance(spark, d))


@_query("primitive_validate", f"WITH {TRAIN_SQL} SELECT splat_id, CASE WHEN splat_id % 4=0 THEN 'MK1524' WHEN splat_id % 4=1 THEN 'MK1530' END AS code FROM t")
def primitive_validate(spark, d):
    k = c("splat_id") % 4
    m = F.struct(F.when(k == 0, F.lit(1)).otherwise(F.lit(3)).alias("sh_degree"), F.lit("linear").alias("scale_domain"), F.lit("linear").alias("opacity_domain"), (k == 1).alias("reflected"), F.lit("gltf-luf").alias("frame"))
    return views.cloud_train(spark, d).withColumn("metadata", m).select("splat_id", validate.primitive_code().alias("code"))


# Neighbours and grids.
_NEAR = f"WITH {TRAIN_SQL}, pairs AS (SELECT a.splat_id, b.splat_id AS other, b.x AS ox, b.y AS oy, b.z AS oz, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d FROM t a JOIN t b ON a.splat_id <> b.splat_id), near AS (SELECT *, row_number() OVER (PARTITION BY splat_id ORDER BY d, other) AS rank FROM pairs QUALIFY rank <= 8), stats AS (SELECT t.splat_id, avg(d) AS mean_d, any_value(x)-avg(ox) AS gx, any_value(y)-avg(oy) AS gy, any_value(z)-avg(oz) AS gz FROM t JOIN near USING (splat_id) GROUP BY t.splat_id)"


@_query("knn_topk", _NEAR + f" SELECT splat_id, other, {sql_rnd('d')} AS d, CAST(rank AS INTEGER) AS rank FROM near")
def knn_topk(spark, d):
    return spatial.knn(views.cloud_train(spark, d), 8).select("splat_id", "other", rnd(c("d")).alias("d"), c("rank").cast("int").alias("rank"))


@_query("knn_brute", _NEAR + f" SELECT splat_id, other, {sql_rnd('d')} AS d, CAST(rank AS INTEGER) AS rank FROM near")
def knn_brute(spark, d):
    return spatial.knn_brute(views.cloud_train(spark, d), 8).select("splat_id", "other", rnd(c("d")).alias("d"), c("rank").cast("int").alias("rank"))


@_query("knn_stats", _NEAR + f" SELECT splat_id, {sql_rnd('mean_d')} AS mean_d, {sql_rnd('gx')} AS gx, {sql_rnd('gy')} AS gy, {sql_rnd('gz')} AS gz FROM stats")
def knn_stats(spark, d):
    return spatial.knn_stats(views.cloud_train(spark, d), 8).select("splat_id", *(rnd(c(n)).alias(n) for n in ("mean_d", "gx", "gy", "gz")))


@_query("knn_mean_hash", _NEAR + f" SELECT splat_id, {sql_rnd('greatest(0.001, least(0.1, 0.5*mean_d*0.5))')} AS scale FROM stats")
def knn_mean_hash(spark, d):
    return spatial.adaptive_scales(views.cloud_train(spark, d), 8).select("splat_id", rnd(c("scale")).alias("scale"))


@_query("avg_scale", _NEAR + f" SELECT {sql_rnd('avg(greatest(0.001, least(0.1, 0.5*mean_d*0.5)))')} AS avg_scale FROM stats")
def avg_scale(spark, d):
    return spatial.adaptive_scales(views.cloud_train(spark, d), 8).agg(rnd(F.avg("scale")).alias("avg_scale"))


@_query("median_spacing", _NEAR + f", r AS (SELECT mean_d, row_number() OVER (ORDER BY mean_d) AS k, count(*) OVER () AS n FROM stats WHERE mean_d > 0) SELECT {sql_rnd('mean_d')} AS median FROM r WHERE k = n//2+1")
def median_spacing(spark, d):
    return spark.createDataFrame([(spatial.upper_median(spatial.knn_stats(views.cloud_train(spark, d), 8), "mean_d"),)], "m double").select(rnd(c("m")).alias("median"))


@_query("knn_big")
def knn_big(spark, d):
    """k-NN at scale; rows only, as all pairs are out of reach."""
    return spatial.knn_stats(views.cloud_big(spark, d), 8)


_GRID = BIG_SQL + ", e AS (SELECT min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x)-min(x) AS ex, max(y)-min(y) AS ey, max(z)-min(z) AS ez, count(*) AS n FROM b), g AS (SELECT *, greatest(ex,ey,ez)/pow(n, 1/CAST(3 AS DOUBLE))*2.0 AS cell FROM e), h AS (SELECT *, greatest(1, CAST(ceil(ex/cell) AS BIGINT)) AS dx, greatest(1, CAST(ceil(ey/cell) AS BIGINT)) AS dy, greatest(1, CAST(ceil(ez/cell) AS BIGINT)) AS dz FROM g), q AS (SELECT splat_id, greatest(0, least(CAST(floor((x-lx)/cell) AS BIGINT), dx-1)) AS cx, greatest(0, least(CAST(floor((y-ly)/cell) AS BIGINT), dy-1)) AS cy, greatest(0, least(CAST(floor((z-lz)/cell) AS BIGINT), dz-1)) AS cz, dy, dz FROM b, h), w AS (SELECT splat_id, cx, cy, cz, (cx*dy+cy)*dz+cz AS cell FROM q), k AS (SELECT cell, count(*) AS n FROM w GROUP BY cell)"


@_query("grid_build", f"WITH {_GRID} SELECT splat_id, CAST(cx AS INTEGER) AS cx, CAST(cy AS INTEGER) AS cy, CAST(cz AS INTEGER) AS cz FROM w")
def grid_build(spark, d):
    b = views.cloud_big(spark, d)
    return spatial.with_cells(b, spatial.grid_parameters(b)).select("splat_id", "cx", "cy", "cz")


@_query("cell_histogram", f"WITH {_GRID} SELECT cell, n FROM k")
def cell_histogram(spark, d):
    b = views.cloud_big(spark, d)
    return spatial.cell_histogram(b, spatial.grid_parameters(b))


@_query("cell_starts", f"WITH {_GRID} SELECT cell, n, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM k")
def cell_starts(spark, d):
    b = views.cloud_big(spark, d)
    return spatial.cell_starts(spatial.cell_histogram(b, spatial.grid_parameters(b)))


@_query("cell_rank", f"WITH {_GRID} SELECT splat_id, cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY splat_id)-1 AS INTEGER) AS slot FROM w")
def cell_rank(spark, d):
    b = views.cloud_big(spark, d)
    return spatial.cell_rank(b, spatial.grid_parameters(b)).select("splat_id", "cell", "slot")


_CANDS = "q AS (SELECT splat_id AS candidate_id, x+0.05 AS x, y-0.05 AS y, z AS z, CASE WHEN splat_id % 3=0 THEN 0.0 ELSE e60 END AS dirx, CASE WHEN splat_id % 3=0 THEN 0.0 ELSE e61 END AS diry, CASE WHEN splat_id % 3=0 THEN 0.0 ELSE e62 END AS dirz FROM t)"


def _offered(spark, d):
    t = views.cloud_train(spark, d)
    z = lambda n: F.when(c("splat_id") % 3 == 0, F.lit(0.0)).otherwise(c(n))
    return t.select(c("splat_id").alias("candidate_id"), (c("x") + 0.05).alias("x"), (c("y") - 0.05).alias("y"), "z", z("e60").alias("dirx"), z("e61").alias("diry"), z("e62").alias("dirz"))


_MET = f"WITH {TRAIN_SQL}, {_CANDS}, m AS (SELECT q.candidate_id, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z))) AS d, bool_or((t.x-q.x)*q.dirx+(t.y-q.y)*q.diry+(t.z-q.z)*q.dirz > 1e-6) AS ahead FROM q JOIN t ON sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.z-t.z)*(q.z-t.z)) <= 0.2 GROUP BY ALL)"


@_query("nearest_dist", _MET + f" SELECT candidate_id, {sql_rnd('coalesce(d, 99)')} AS min_dist FROM q LEFT JOIN m USING (candidate_id)")
def nearest_dist(spark, d):
    out = spatial.nearest_and_support(_offered(spark, d), views.cloud_train(spark, d), 0.2)
    return out.select("candidate_id", rnd(F.when(c("min_dist") == float("inf"), F.lit(99.0)).otherwise(c("min_dist"))).alias("min_dist"))


@_query("support_semi", _MET + " SELECT candidate_id, (dirx=0 AND diry=0 AND dirz=0) OR coalesce(ahead, false) AS supported FROM q LEFT JOIN m USING (candidate_id)")
def support_semi(spark, d):
    return spatial.nearest_and_support(_offered(spark, d), views.cloud_train(spark, d), 0.2).select("candidate_id", "supported")


@_query("greedy_separation")
def greedy_separation(spark, d):
    return densify.greedy_separation(_offered(spark, d), 0.15)


@_query("pca_normals")
def pca_normals(spark, d):
    return spatial.pca_normals(views.cloud_train(spark, d), 8)


@_query("sort_by_distance", f"WITH {BIG_SQL} SELECT splat_id, CAST(row_number() OVER (ORDER BY (x-10.0)*(x-10.0)+(y-50.0)*(y-50.0)+(z-500.0)*(z-500.0), splat_id) AS INTEGER) AS distance_rank FROM b")
def sort_by_distance(spark, d):
    return spatial.by_distance(views.cloud_big(spark, d), (10.0, 50.0, 500.0)).select("splat_id", "distance_rank")


@_query("voxel_fuse", f"WITH {BIG_SQL} SELECT min(splat_id) AS splat_id, count(*) AS n_fused FROM b GROUP BY floor(x/5), floor(y/5), floor(z/5)")
def voxel_fuse(spark, d):
    return spatial.voxel_fuse(views.cloud_big(spark, d), 5.0).select("splat_id", "n_fused")


# Densification.
_UNIT = ", ".join(f"(CASE WHEN rot_0<0 THEN -1 ELSE 1 END)*rot_{k}/{_norm} AS {n}" for n, k in zip(_NAMES, (1, 2, 3, 0)))
_LONG = ", ".join(f"CASE WHEN scale_0>=scale_1 AND scale_0>=scale_2 THEN {_M[f'm{3 * k}']} WHEN scale_1>=scale_2 THEN {_M[f'm{3 * k + 1}']} ELSE {_M[f'm{3 * k + 2}']} END AS u{a}" for k, a in enumerate("xyz"))
_CELLS = _NEAR + f", ordered AS (SELECT mean_d, row_number() OVER (ORDER BY mean_d) AS k, count(*) OVER () AS n FROM stats WHERE mean_d > 0), m AS (SELECT mean_d AS med FROM ordered WHERE k = n//2+1), g AS (SELECT t.*, mean_d, gx, gy, gz, sqrt(gx*gx+gy*gy+gz*gz) AS gap, med, {_UNIT} FROM t JOIN stats USING (splat_id), m), h AS (SELECT *, {_LONG}, gap > 0.3*mean_d AS rim FROM g)"


@_query("fill_candidates", _CELLS + f" SELECT splat_id AS source, 0 AS side, {sql_rnd('x+gx/gap*med')} AS x, {sql_rnd('y+gy/gap*med')} AS y, {sql_rnd('z+gz/gap*med')} AS z, {sql_rnd('gx/gap')} AS dirx FROM h WHERE rim AND gap > 0 UNION ALL SELECT splat_id, side, {sql_rnd('x+side*0.5*mean_d*ux')}, {sql_rnd('y+side*0.5*mean_d*uy')}, {sql_rnd('z+side*0.5*mean_d*uz')}, 0.0 FROM h, (VALUES (-1), (1)) s(side) WHERE NOT rim AND mean_d > 1.05*med")
def fill_candidates(spark, d):
    """All candidates, of rims and of sparse places, by the cloud's own median spacing."""
    t = views.cloud_train(spark, d)
    stats = cut(spatial.knn_stats(t, 8))
    out = densify.candidates(t, stats, spatial.upper_median(stats, "mean_d"), densify.Config(sparse=1.05))
    return out.select("source", (c("candidate_id") - c("source") * 4 - 1).cast("int").alias("side"), *(rnd(c(a)).alias(a) for a in ("x", "y", "z", "dirx")))


@_query("rim_filter", _NEAR + " SELECT splat_id FROM stats WHERE sqrt(gx*gx+gy*gy+gz*gz) > 0.3*mean_d")
def rim_filter(spark, d):
    return spatial.knn_stats(views.cloud_train(spark, d), 8).filter("sqrt(gx*gx+gy*gy+gz*gz) > 0.3*mean_d").select("splat_id")


@_query("sparse_filter", _NEAR + " SELECT splat_id FROM stats WHERE NOT sqrt(gx*gx+gy*gy+gz*gz) > 0.3*mean_d AND mean_d > 2.5*0.05")
def sparse_filter(spark, d):
    return spatial.knn_stats(views.cloud_train(spark, d), 8).filter("not sqrt(gx*gx+gy*gy+gz*gz) > 0.3*mean_d and mean_d > 2.5*0.05").select("splat_id")


@_query("fill_holes")
def fill_holes(spark, d):
    return densify.fill_holes(views.cloud_train(spark, d))[0]


# Scene graphs.
_GRAPH = "n AS (SELECT CAST(r_regionkey AS BIGINT) AS node, CAST(r_regionkey AS BIGINT) AS k FROM region UNION ALL SELECT n_nationkey+1000, n_nationkey FROM nation UNION ALL SELECT s_suppkey+2000, s_suppkey FROM supplier), l AS (SELECT node, k, CAST(k % 3+1 AS DOUBLE) AS a, CAST(k % 2+1 AS DOUBLE) AS b, CAST(k AS DOUBLE) AS tx, CAST(k % 5 AS DOUBLE) AS ty FROM n)"
_FLAT = f"WITH {_GRAPH}, f0 AS (SELECT l.* FROM l JOIN region ON node=r_regionkey), f1 AS (SELECT c.node, p.a*c.a AS a, p.b*c.b AS b, p.a*c.tx+p.tx AS tx, p.b*c.ty+p.ty AS ty FROM nation JOIN f0 p ON p.node=n_regionkey JOIN l c ON c.node=n_nationkey+1000), f2 AS (SELECT c.node, p.a*c.a AS a, p.b*c.b AS b, p.a*c.tx+p.tx AS tx, p.b*c.ty+p.ty AS ty FROM supplier JOIN f1 p ON p.node=s_nationkey+1000 JOIN l c ON c.node=s_suppkey+2000)"


@_query("scene_flatten", _FLAT + " SELECT node, a, b, tx, ty, 1.0 AS tz, 0 AS depth FROM f0 UNION ALL SELECT node, a, b, tx, ty, 2.0, 1 FROM f1 UNION ALL SELECT node, a, b, tx, ty, 3.0, 2 FROM f2")
def scene_flatten(spark, d):
    t = c("transform")
    return scene.flatten(*views.graph(spark, d)).select("node", t["linear"][0].alias("a"), t["linear"][4].alias("b"), *(t["translation"][k].alias(n) for k, n in enumerate(("tx", "ty", "tz"))), "depth")


_BAD = "e AS (SELECT DISTINCT CAST(l_suppkey % 60 AS BIGINT) AS parent, CAST(l_partkey % 97 AS BIGINT) AS child FROM lineitem WHERE l_quantity = 1), n AS (SELECT DISTINCT CAST(p_partkey % 97 AS BIGINT) AS node FROM part WHERE p_partkey % 97 % 8 <> 3), o AS (SELECT CAST(r_regionkey AS BIGINT) AS node FROM region), ends AS (SELECT parent AS node FROM e UNION SELECT child FROM e UNION SELECT node FROM o), t AS (SELECT DISTINCT parent, child FROM e), reach AS (SELECT parent AS a, child AS b FROM t UNION SELECT a, child FROM reach JOIN t ON b=parent)"


@_query("mesh_instances", f"WITH RECURSIVE {_BAD} SELECT 'several_parents' AS problem, child AS node FROM e GROUP BY child HAVING count(*) > 1 UNION ALL SELECT 'missing_node', node FROM ends WHERE node NOT IN (SELECT node FROM n) UNION ALL SELECT 'root_has_parent', node FROM o WHERE node IN (SELECT child FROM e) UNION ALL SELECT DISTINCT 'cycle', r.b FROM reach r JOIN reach s ON s.a=r.a AND s.b=r.a")
def mesh_instances(spark, d):
    """A graph with all kinds of faults; what stands behind a cycle is reported with it."""
    li = table(spark, d, "lineitem").filter("l_quantity = 1")
    edges = li.select((c("l_suppkey") % 60).cast("long").alias("parent"), (c("l_partkey") % 97).cast("long").alias("child"))
    nodes = table(spark, d, "part").select((c("p_partkey") % 97).cast("long").alias("node")).distinct().filter("node % 8 <> 3")
    return scene.graph_problems(nodes, edges, table(spark, d, "region").select(c("r_regionkey").cast("long").alias("node")))


_CHAIN = "l AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT r_regionkey+25 FROM region), w AS (SELECT k, CAST(k % 2+1 AS DOUBLE) AS a, CAST(k % 3 AS DOUBLE) AS t FROM l), f AS (SELECT k, a, t FROM w WHERE k=0 UNION ALL SELECT w.k, f.a*w.a, f.t+f.a*w.t FROM f JOIN w ON w.k=f.k+1)"


@_query("scene_flatten_deep", f"WITH RECURSIVE {_CHAIN} SELECT k AS node, a, t, CAST(k AS INTEGER) AS depth FROM f")
def scene_flatten_deep(spark, d):
    """A chain of 30 nodes."""
    k = table(spark, d, "nation").select(c("n_nationkey").cast("long").alias("node")).unionByName(table(spark, d, "region").select((c("r_regionkey") + 25).cast("long").alias("node")))
    a, t, zero = (c("node") % 2 + 1).cast("double"), (c("node") % 3).cast("double"), F.lit(0.0)
    linear = F.array(a, zero, zero, zero, a, zero, zero, zero, a)
    nodes = k.select("node", F.struct(linear.alias("linear"), F.array(t, t, t).alias("translation")).alias("transform"))
    edges = k.filter("node > 0").select((c("node") - 1).alias("parent"), c("node").alias("child"))
    out = scene.flatten(nodes, edges, k.filter("node = 0"))
    return out.select("node", c("transform")["linear"][0].alias("a"), c("transform")["translation"][2].alias("t"), "depth")


@_query("ref_integrity", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey % 1000 NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0)")
def ref_integrity(spark, d):
    rows = table(spark, d, "lineitem").withColumn("ref", c("l_partkey") % 1000)
    return scene.broken_references(rows, "ref", table(spark, d, "part").filter("p_partkey % 7 <> 0"), "p_partkey").select("l_orderkey", "l_partkey").distinct()


_ACC = "a AS (SELECT p_partkey AS id, p_partkey % 100 AS view, CAST(p_size AS BIGINT) AS off, CAST(p_size % 9 AS BIGINT) AS cnt FROM part), w AS (SELECT s_suppkey AS id, s_nationkey % 5 AS buffer, s_suppkey*10 AS off, CAST(150 AS BIGINT) AS len, CASE WHEN s_suppkey % 3=0 THEN 16 ELSE 0 END AS stride FROM supplier), b AS (SELECT CAST(r_regionkey AS INTEGER) AS id, CAST(800 AS BIGINT) AS len FROM region)"


@_query("gltf_resolve", f"WITH {_ACC}, j AS (SELECT a.id AS accessor, w.buffer, w.off+a.off AS first_byte, CASE WHEN stride>0 THEN stride ELSE 12 END AS stride, a.cnt, w.len, w.off AS woff, a.off AS aoff, b.len AS blen FROM a JOIN w ON a.view=w.id JOIN b ON w.buffer=b.id), k AS (SELECT *, CASE WHEN cnt>0 THEN (cnt-1)*stride+12 ELSE 0 END AS used FROM j) SELECT accessor, buffer, CAST(first_byte AS BIGINT) AS first_byte, CAST(stride AS BIGINT) AS stride, CAST(first_byte+used AS BIGINT) AS end_byte, aoff+used<=len AND woff+len<=blen AS ok FROM k")
def gltf_resolve(spark, d):
    a = table(spark, d, "part").select(c("p_partkey").alias("id"), (c("p_partkey") % 100).alias("view"), c("p_size").cast("long").alias("offset"), (c("p_size") % 9).cast("long").alias("count"), F.lit(12).cast("long").alias("size"))
    w = table(spark, d, "supplier").select(c("s_suppkey").alias("id"), (c("s_nationkey") % 5).alias("buffer"), (c("s_suppkey") * 10).alias("offset"), F.lit(150).cast("long").alias("length"), F.when(c("s_suppkey") % 3 == 0, F.lit(16)).otherwise(F.lit(0)).cast("long").alias("stride"))
    b = table(spark, d, "region").select(c("r_regionkey").alias("id"), F.lit(800).cast("long").alias("length"))
    return scene.resolve_accessors(a, w, b)


@_query("attr_zip", "SELECT p_partkey AS row, CAST(0 AS INTEGER) AS prim, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size FROM part")
def attr_zip(spark, d):
    p = table(spark, d, "part").select(F.lit(0).alias("prim"), c("p_partkey").alias("row"), "p_retailprice", "p_size")
    return scene.attribute_zip({"price": p.withColumn("value", c("p_retailprice")), "size": p.withColumn("value", c("p_size").cast("double"))})


@_query("sh_degree_scan", "WITH s AS (SELECT DISTINCT n_regionkey AS prim, CAST(n_nationkey % 2 AS INTEGER) AS l, CAST(n_nationkey % 3 AS INTEGER) AS n FROM nation WHERE n_nationkey % 3 <= 2*(n_nationkey % 2)), g AS (SELECT prim, l, count(*) AS c FROM s GROUP BY ALL) SELECT prim, max(l) AS degree, bool_and(c=2*l+1) AND count(*)=max(l)+1 AS ok FROM g GROUP BY prim")
def sh_degree_scan(spark, d):
    k = c("n_nationkey")
    return scene.degree_scan(table(spark, d, "nation").filter("n_nationkey % 3 <= 2*(n_nationkey % 2)").select(c("n_regionkey").alias("prim"), (k % 2).cast("int").alias("l"), (k % 3).cast("int").alias("n")))


@_query("transform_primitive", f"WITH {CANON_SQL}, s AS (SELECT c.splat_id, c.x, c.y, c.z, " + ", ".join(f"{x} AS {n}" for n, x in _SIGMA.items()) + " FROM c) SELECT s.splat_id, " + f"floor(({A[0]}*x+{A[1]}*y+1)*1e4+0.5)/1e4+0.0 AS px, " + ", ".join(f"floor(({x})*1e3+0.5)/1e3+0.0 AS {n}" for n, x in _affine.items()) + " FROM s")
def transform_primitive(spark, d):
    """An affine map of whole splats: the covariance that comes out, in single precision."""
    out, _ = scene.transform_primitive(views.cloud_canonical(spark, d), A, [1.0, 0.0, 0.0], 3)
    s = covariance.covariance(tuple(v.cast("double") for v in Q()), tuple(v.cast("double") for v in S()))
    return out.select("splat_id", (F.floor(c("x").cast("double") * 1e4 + 0.5) / 1e4 + 0.0).alias("px"), *((F.floor(v * 1e3 + 0.5) / 1e3 + 0.0).alias(n) for v, n in zip(s, covariance.NAMES)))


del ORACLE["transform_primitive"]  # single precision near a half: held by tests with a tolerance


@_query("union_batches", f"WITH {TRAIN_SQL} SELECT splat_id, 3 AS sh_degree, CAST(48 AS BIGINT) AS n, {sql_rnd('CASE WHEN splat_id % 2=0 THEN list_sum(sh) ELSE list_sum(sh[1:12]) END')} AS total FROM t")
def union_batches(spark, d):
    t = views.cloud_train(spark, d).withColumn("sh", c("sh").cast("array<double>"))
    a, b = t.filter("splat_id % 2 = 0"), t.filter("splat_id % 2 = 1").withColumns({"sh": sh.truncate(c("sh"), 1), "sh_degree": F.lit(1)})
    out = scene.union_batches([(a, 3), (b, 1)])
    return out.select("splat_id", "sh_degree", F.size("sh").cast("long").alias("n"), rnd(F.aggregate("sh", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@_query("drop_singular", "SELECT CAST(0 AS BIGINT) AS kept, count(*) AS dropped FROM embeddings")
def drop_singular(spark, d):
    t = views.cloud_canonical(spark, d)
    out, _ = scene.transform_primitive(t, [1.0, 0, 0, 0, 1.0, 0, 0, 0, 0], [0.0, 0, 0], 0)
    return t.agg(F.count("*").alias("n")).crossJoin(out.agg(F.count("*").alias("kept"))).select("kept", (c("n") - c("kept")).alias("dropped"))


# Meshes.
_zn = {"nx": "nx", "ny": "-nz", "nz": "ny"}


@_query("mesh_to_splats_basic", f"WITH {VERTICES_SQL}, w AS (SELECT splat_id, x, -z AS y, y AS z, nx, -nz AS ny, ny AS nz, coalesce(r,0.5) AS r FROM v) SELECT splat_id, {sql_rnd('x')} AS x, {sql_rnd('y')} AS y, {sql_rnd('z')} AS z, {sql_rnd('CASE WHEN nx IS NULL THEN 0 WHEN nz>0.9999 THEN 0 WHEN nz<-0.9999 THEN 1 ELSE -ny/sqrt(2*(1+nz)) END')} AS qx, {sql_rnd('CASE WHEN nx IS NULL THEN 1 WHEN nz>0.9999 THEN 1 WHEN nz<-0.9999 THEN 0 ELSE sqrt(2*(1+nz))/2 END')} AS qw, {sql_rnd('(greatest(0,least(1,r))-0.5)/0.28209479177387814')} AS dc FROM w")
def mesh_to_splats_basic(spark, d):
    out = mesh.basic(views.vertices(spark, d))
    return out.select("splat_id", *(rnd(c(n)).alias(n) for n in ("x", "y", "z", "qx", "qw")), rnd(c("sh")[0]).alias("dc"))


@_query("mesh_to_splats_enhanced")
def mesh_to_splats_enhanced(spark, d):
    return mesh.enhanced(views.vertices(spark, d))


@_query("reject_positions", f"WITH {_BROKEN} SELECT count(*) FILTER (WHERE isfinite(x)) AS good, count(*) FILTER (WHERE NOT isfinite(x)) AS bad FROM w")
def reject_positions(spark, d):
    good, bad = mesh.reject_positions(_broken(spark, d))
    return good.agg(F.count("*").alias("good")).withColumn("bad", F.lit(bad).cast("long"))


# Depth views.
_MASK = f"WITH {DEPTH_SQL}, p AS (SELECT view, quantile_cont(conf, 0.4) AS lc FROM d GROUP BY view), m AS (SELECT d.* FROM d JOIN p USING (view) WHERE depth BETWEEN 5.0 AND 45.0 AND sky < 0.5 AND conf >= lc)"


@_query("depth_mask", _MASK + " SELECT view, u, v, s FROM m")
def depth_mask(spark, d):
    return reconstruct.depth_mask(views.depth_views(spark, d), 5.0, 45.0).select("view", "u", "v", "s")


@_query("depth_scale", _MASK + f", k AS (SELECT view, median(depth) AS med FROM m GROUP BY view) SELECT view, u, v, s, {sql_rnd('greatest(0.001, least(100.0, 0.01*depth/med))')} AS scale FROM m JOIN k USING (view)")
def depth_scale(spark, d):
    out = reconstruct.depth_scales(reconstruct.depth_mask(views.depth_views(spark, d), 5.0, 45.0))
    return out.select("view", "u", "v", "s", rnd(c("scale")).alias("scale"))


@_query("view_percentile", f"WITH {DEPTH_SQL} SELECT view, {sql_rnd('quantile_cont(depth, 0.9)')} AS q90, {sql_rnd('median(depth)')} AS q50 FROM d GROUP BY view")
def view_percentile(spark, d):
    v = views.depth_views(spark, d)
    out = reconstruct.view_percentile(v, "depth", 90, "q90").join(reconstruct.view_percentile(v, "depth", 50, "q50"), "view")
    return out.select("view", rnd(c("q90")).alias("q90"), rnd(c("q50")).alias("q50"))


@_query("border_trim", f"WITH {DEPTH_SQL}, q AS (SELECT view, quantile_cont(depth, 0.9) AS far FROM d GROUP BY view) SELECT view, u, v, s FROM d JOIN q USING (view) WHERE u BETWEEN 2 AND 61 AND v BETWEEN 1 AND 30 AND depth <= far")
def border_trim(spark, d):
    return reconstruct.border_trim(views.depth_views(spark, d), 64, 32).select("view", "u", "v", "s")


@_query("gaussians_from_prediction", f"WITH {DEPTH_SQL}, q AS (SELECT view, quantile_cont(depth, 0.9) AS far FROM d GROUP BY view) SELECT view, u, v, s FROM d JOIN q USING (view) WHERE u BETWEEN 2 AND 61 AND v BETWEEN 1 AND 30 AND depth <= far AND u % 2=0 AND v % 2=0")
def gaussians_from_prediction(spark, d):
    return reconstruct.from_prediction(views.depth_views(spark, d), 64, 32, 2).select("view", "u", "v", "s")


@_query("subsample", f"WITH {DEPTH_SQL} SELECT view, u, v, s FROM d WHERE u % 3=0 AND v % 3=0")
def subsample(spark, d):
    return reconstruct.subsample(views.depth_views(spark, d), 3).select("view", "u", "v", "s")


_scalar("intensity_depth", lambda: {"depth": reconstruct.intensity_depth(c("r"), c("g"), c("b"))}, {"depth": "5*(1-(0.299*r+0.587*g+0.114*b))+0.5"}, "depth")
_f = "(64/CAST(2 AS DOUBLE)/tan(radians(60.0)/2))"
_scalar("fov_rays", lambda: dict(zip(("rx", "ry", "rz"), reconstruct.rays_by_fov(c("u"), c("v"), 64, 32))), {n: f"({v})/sqrt(((u-32.0)/{_f})*((u-32.0)/{_f})+((v-16.0)/{_f})*((v-16.0)/{_f})+1)" for n, v in (("rx", f"(u-32.0)/{_f}"), ("ry", f"(v-16.0)/{_f}"), ("rz", "1"))}, "depth")
_CAM = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def _cameras(spark):
    rows = [(k, 50.0, 60.0, 32.0, 16.0, _CAM, [float(k), 2.0, 3.0]) for k in range(4)]
    return spark.createDataFrame(rows, "view long, fx double, fy double, cx double, cy double, rotation array<double>, origin array<double>")


@_query("unproject", f"WITH {DEPTH_SQL} SELECT view, u, v, s, {sql_rnd('view+depth*(-((v-16.0)/60.0))')} AS x, {sql_rnd('2.0+depth*((u-32.0)/50.0)')} AS y, {sql_rnd('3.0+depth')} AS z FROM d")
def unproject(spark, d):
    out = reconstruct.unproject(views.depth_views(spark, d), _cameras(spark))
    return out.select("view", "u", "v", "s", *(rnd(c(a)).alias(a) for a in "xyz"))


@_query("depth_to_splats", _MASK.replace("FROM d GROUP BY view", "FROM (SELECT * FROM d WHERE u % 2=0 AND v % 2=0) GROUP BY view").replace("FROM d JOIN p USING (view) WHERE", "FROM d JOIN p USING (view) WHERE u % 2=0 AND v % 2=0 AND") + f", k AS (SELECT view, median(depth) AS med FROM m GROUP BY view) SELECT view, {sql_rnd('ln(greatest(0.001, least(100.0, 0.01*depth/med)))')} AS log_scale, {sql_rnd('3.0+depth')} AS z FROM m JOIN k USING (view)")
def depth_to_splats(spark, d):
    out = reconstruct.depth_to_splats(views.depth_views(spark, d), _cameras(spark), 2, 0.01, 5.0, 45.0)
    return out.select(c("key.view").alias("view"), rnd(c("scale_0")).alias("log_scale"), rnd(c("z")).alias("z"))


# Rendering.
CAMERA = render.perspective(1.0, 48, 32, 0.1, 100.0, 3.0)


@_query("frustum_cull", f"WITH {TRAIN_SQL} SELECT splat_id FROM t WHERE z+3.0>0 AND abs({CAMERA.view_proj[0]}*x) <= (z+3.0)*1.3 AND abs({CAMERA.view_proj[5]}*y) <= (z+3.0)*1.3 AND {CAMERA.view_proj[10]}*z+{CAMERA.view_proj[14]} BETWEEN 0 AND z+3.0")
def frustum_cull(spark, d):
    return views.cloud_train(spark, d).filter(render.in_frustum(_P(), CAMERA)).select("splat_id")


_SCREEN = f"WITH {TRAIN_SQL} SELECT splat_id, {sql_rnd(f'(({CAMERA.view_proj[0]}*x)/(z+3.0)*0.5+0.5)*48')} AS px, {sql_rnd(f'(({CAMERA.view_proj[5]}*y)/(z+3.0)*0.5+0.5)*32')} AS py, {sql_rnd('z+3.0')} AS depth, {sql_rnd('1/(1+exp(-opacity))')} AS alpha FROM t"


@_query("project_splat", _SCREEN)
def project_splat(spark, d):
    return render.project(views.cloud_train(spark, d), CAMERA).select("splat_id", *(rnd(c(n)).alias(n) for n in ("px", "py", "depth", "alpha")))


@_query("visible_count", "SELECT count(*) AS n FROM embeddings")
def visible_count(spark, d):
    return render.project(views.cloud_train(spark, d), CAMERA).agg(F.count("*").alias("n"))


_DISCS = "p AS (SELECT splat_id, (x+0.5)*48 AS px, (y+0.5)*32 AS py, z+3 AS depth, 2 AS radius, 0.5*abs(e60)+0.1 AS alpha, abs(e61) AS r, abs(e62) AS g, abs(e63) AS b FROM t), j AS (SELECT p.*, u, v, u+0.5-px AS dx, v+0.5-py AS dy FROM p JOIN range(48) a(u) ON abs(u+0.5-px) <= radius JOIN range(32) q(v) ON abs(v+0.5-py) <= radius), w AS (SELECT *, exp(-0.5*(0.5*dx*dx+0.5*dy*dy)) AS weight FROM j), y AS (SELECT *, least(0.99, alpha*weight) AS a FROM w WHERE least(0.99, alpha*weight) >= 1/CAST(255 AS DOUBLE))"


def _discs(spark, d):
    t = views.cloud_train(spark, d)
    out = t.select("splat_id", ((c("x") + 0.5) * 48).alias("px"), ((c("y") + 0.5) * 32).alias("py"), (c("z") + 3).alias("depth"), F.lit(2).alias("radius"), (0.5 * F.abs("e60") + 0.1).alias("alpha"), F.abs("e61").alias("r"), F.abs("e62").alias("g"), F.abs("e63").alias("b"), F.lit(0.5).alias("conic_xx"), F.lit(0.0).alias("conic_xy"), F.lit(0.5).alias("conic_yy"))
    return render.splat_pixels(out, 48, 32)


@_query("splat_pixel_join", f"WITH {TRAIN_SQL}, {_DISCS} SELECT splat_id, CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, {sql_rnd('a')} AS a FROM y")
def splat_pixel_join(spark, d):
    return _discs(spark, d).select("splat_id", "u", "v", rnd(c("a")).alias("a"))


_COMP = f"WITH {TRAIN_SQL}, {_DISCS}, l AS (SELECT *, exp(coalesce(sum(ln(1-a)) OVER (PARTITION BY u, v ORDER BY depth, splat_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS light FROM y), o AS (SELECT u, v, sum(light*a*r) AS r, sum(light*a*g) AS g, sum(light*a*b) AS b, exp(sum(ln(1-a))) AS rest FROM l WHERE light >= 1e-4 GROUP BY u, v)"


@_query("alpha_composite", _COMP + f" SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, {sql_rnd('r')} AS r, {sql_rnd('g')} AS g, {sql_rnd('b')} AS b, {sql_rnd('1-rest')} AS opacity FROM o")
def alpha_composite(spark, d):
    return render.composite(_discs(spark, d)).select("u", "v", *(rnd(c(n)).alias(n) for n in ("r", "g", "b", "opacity")))


def _loss(spark, d):
    image = render.composite(_discs(spark, d))
    return render.l1_loss(image, image.select("u", "v", *((c(n) * 0 + 0.25).alias(n) for n in "rgb")))


@_query("l1_loss", _COMP + f" SELECT CAST(u AS INTEGER) AS u, CAST(v AS INTEGER) AS v, {sql_rnd('(abs(r-0.25)+abs(g-0.25)+abs(b-0.25))/3')} AS loss, {sql_rnd('sign(r-0.25)/3.0')} AS gr FROM o")
def l1_loss(spark, d):
    return _loss(spark, d).select("u", "v", rnd(c("loss")).alias("loss"), rnd(c("gr")).alias("gr"))


@_query("raster_backward", _COMP + f", k AS (SELECT u, v, sign(r-0.25)/3.0 AS gr, sign(g-0.25)/3.0 AS gg, sign(b-0.25)/3.0 AS gb FROM o) SELECT splat_id, {sql_rnd('sum(gr*a)')} AS d_r, {sql_rnd('sum((gr*r+gg*g+gb*b)*weight*alpha*(1-alpha))')} AS d_logit FROM y JOIN k USING (u, v) GROUP BY splat_id")
def raster_backward(spark, d):
    return render.backward(_discs(spark, d), _loss(spark, d)).select("splat_id", rnd(c("d_r")).alias("d_r"), rnd(c("d_logit")).alias("d_logit"))


_m, _v = "(0.9*e61+(1-0.9)*e60)", "(0.999*(e62*e62)+(1-0.999)*e60*e60)"
_scalar("adam_step", lambda: {}, {"param": f"x-0.001*({_m}/(1-pow(0.9,3)))/(sqrt({_v}/(1-pow(0.999,3)))+1e-8)", "m": _m, "v": _v})


def _adam(spark, d):
    rows = views.cloud_train(spark, d).select("splat_id", c("x").alias("param"), c("e60").alias("grad"), c("e61").alias("m"), (c("e62") * c("e62")).alias("v"))
    return render.adam(rows, 3).select("splat_id", *(rnd(c(n)).alias(n) for n in ("param", "m", "v")))


QUERIES["adam_step"] = _adam

# Frames and streams.


@_query("frame_window", f"WITH {FRAMES_SQL} SELECT event_id, min(frame) OVER w AS first_resident, max(frame) OVER w AS last_resident, count(*) OVER w AS n_resident FROM f WINDOW w AS (PARTITION BY sequence ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 6 FOLLOWING)")
def frame_window(spark, d):
    return frames.frame_window(views.frames(spark, d)).select("event_id", "first_resident", "last_resident", "n_resident")


@_query("stream_tumbling", f"WITH {FRAMES_SQL} SELECT epoch_us(time_bucket(INTERVAL 1 DAY, event_time))//1000000 AS start, count(*) AS n, {sql_rnd('sum(value)')} AS total FROM f GROUP BY ALL")
def stream_tumbling(spark, d):
    out = frames.windowed(views.frames(spark, d), "1 day")
    return out.select(F.unix_seconds("start").alias("start"), "n", rnd(c("total")).alias("total"))


@_query("stream_sessions", f"WITH {FRAMES_SQL}, g AS (SELECT *, CASE WHEN event_time >= lag(event_time) OVER (PARTITION BY sequence ORDER BY event_time)+INTERVAL 6 HOUR OR lag(event_time) OVER (PARTITION BY sequence ORDER BY event_time) IS NULL THEN 1 ELSE 0 END AS fresh FROM f), h AS (SELECT *, sum(fresh) OVER (PARTITION BY sequence ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT sequence, epoch_us(min(event_time)) AS start, count(*) AS n FROM h GROUP BY sequence, k")
def stream_sessions(spark, d):
    return frames.sessions(views.frames(spark, d), "6 hours").select("sequence", F.unix_micros("start").alias("start"), "n")


@_query("latest_seek", f"WITH {FRAMES_SQL}, r AS (SELECT sequence, frame AS token, event_id, row_number() OVER (PARTITION BY sequence ORDER BY frame DESC, event_id DESC) AS k FROM f) SELECT sequence, token, event_id FROM r WHERE k=1")
def latest_seek(spark, d):
    return frames.latest(views.frames(spark, d).withColumn("token", c("frame")))


@_query("distinct_seeks", f"WITH {FRAMES_SQL} SELECT DISTINCT frame AS token FROM f")
def distinct_seeks(spark, d):
    return frames.once(views.frames(spark, d).withColumn("token", c("frame"))).select("token")


@_query("preview_limit", f"WITH {BIG_SQL} SELECT splat_id FROM b ORDER BY splat_id LIMIT 1000")
def preview_limit(spark, d):
    return reconstruct.preview(views.cloud_big(spark, d), ["splat_id"], 1000)[0].select("splat_id")


@_query("budget_totals", "SELECT p_partkey, sum(p_size) OVER (ORDER BY p_partkey) > 20000 AS over FROM part")
def budget_totals(spark, d):
    """The running total of a resource against its limit."""
    used = ranks.running(table(spark, d, "part").select("p_partkey", "p_size"), ["p_partkey"], c("p_size").cast("long"), "used")
    return used.select("p_partkey", (c("used") > 20000).alias("over"))


# Strings and files.
_NAME = "concat('/data/', p_type, '/', replace(p_name, ' ', '_'), '_', p_partkey, '.', CASE p_partkey % 4 WHEN 0 THEN 'PLY' WHEN 1 THEN 'glb' WHEN 2 THEN 'jpg' ELSE 'spz' END)"
_PATHS = f"p AS (SELECT p_partkey, {_NAME} AS path FROM part)"


def _paths(spark, d):
    k = c("p_partkey") % 4
    end = F.when(k == 0, "PLY").when(k == 1, "glb").when(k == 2, "jpg").otherwise("spz")
    return table(spark, d, "part").select("p_partkey", F.concat(F.lit("/data/"), "p_type", F.lit("/"), F.translate("p_name", " ", "_"), F.lit("_"), c("p_partkey").cast("string"), F.lit("."), end).alias("path"))


@_query("ext_of", f"WITH {_PATHS} SELECT p_partkey, lower(regexp_extract(path, '[^/]*(\\.[^./]*)$', 1)) AS ext FROM p")
def ext_of(spark, d):
    return _paths(spark, d).select("p_partkey", text.extension(c("path")).alias("ext"))


@_query("redact_path", f"WITH {_PATHS} SELECT p_partkey, regexp_extract(path, '([^/]*)$', 1) AS base, CASE WHEN path LIKE '/data/SMALL/%' THEN substr(path, 13) ELSE regexp_extract(path, '([^/]*)$', 1) END AS inside FROM p")
def redact_path(spark, d):
    return _paths(spark, d).select("p_partkey", text.redact_path(c("path"), "basename").alias("base"), text.redact_path(c("path"), "relative", "/data/SMALL").alias("inside"))


@_query("is_abs_path", f"WITH {_PATHS} SELECT p_partkey, p_partkey % 6 < 4 AS absolute FROM p")
def is_abs_path(spark, d):
    """From a root, a share, or a drive with either slash; a name, or a drive without a slash."""
    k, bare = c("p_partkey") % 6, F.substring(c("path"), F.lit(2), F.length("path"))
    made = F.when(k == 0, c("path")).when(k == 1, F.concat(F.lit("\\\\host\\"), bare)).when(k == 2, F.concat(F.lit("C:\\"), bare))
    made = made.when(k == 3, F.concat(F.lit("d:/"), bare)).when(k == 4, bare).otherwise(F.concat(F.lit("c:"), bare))
    return _paths(spark, d).select("p_partkey", text.is_absolute(made).alias("absolute"))


@_query("scan_frames", f"WITH {_PATHS} SELECT p_partkey, CAST(regexp_extract(path, '(\\d+)\\.[^./]+$', 1) AS BIGINT) AS frame_number FROM p")
def scan_frames(spark, d):
    return files.frames(_paths(spark, d)).select("p_partkey", "frame_number")


@_query("frame_order", f"WITH {_PATHS}, n AS (SELECT p_partkey, path, CAST(regexp_extract(path, '(\\d+)\\.[^./]+$', 1) AS BIGINT) AS k FROM p) SELECT p_partkey, CAST(row_number() OVER (ORDER BY k, path) AS INTEGER) AS place FROM n")
def frame_order(spark, d):
    numbered = ranks.numbered(_paths(spark, d).withColumn("k", files.frame_number(c("path"))), ["k", "path"], "place")
    return numbered.select("p_partkey", c("place").cast("int").alias("place"))


@_query("scan_project", f"WITH {_PATHS} SELECT 'images' AS kind, count(*) FILTER (WHERE path LIKE '%.jpg') AS n_images, count(*) FILTER (WHERE path LIKE '%.jpg') < 20 AS few FROM p")
def scan_project(spark, d):
    return files.project_kind(_paths(spark, d))


@_query("probe_format", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ply' WHEN 1 THEN 'glb' WHEN 2 THEN 'gltf' ELSE 'unknown' END AS format, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'none' END AS confidence FROM part")
def probe_format(spark, d):
    k = c("p_partkey") % 4
    body = F.when(k == 0, F.lit("ply\nformat")).when(k == 1, F.lit("glTF....")).when(k == 2, F.lit('{"asset"')).otherwise(F.lit("nothing"))
    kind, sure = files.probe(body.cast("binary"))
    return table(spark, d, "part").select("p_partkey", kind.alias("format"), sure.alias("confidence"))


@_query("suffix_match", f"WITH {_PATHS} SELECT p_partkey, p_partkey % 4 = 1 AS same FROM p")
def suffix_match(spark, d):
    return _paths(spark, d).select("p_partkey", files.suffix_matches(F.lit("glb"), text.extension(c("path"))).alias("same"))


@_query("display_escape", "SELECT conv_id, turn, md5(replace(replace(text, chr(10), '\\n'), chr(9), '\\t')) AS shown FROM conversations")
def display_escape(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(text.display_escape(c("text")).cast("binary")).alias("shown"))


@_query("json_escape", "SELECT conv_id, turn, CAST(to_json(text) AS VARCHAR) AS j FROM conversations")
def json_escape(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.json_string(c("text")).alias("j"))


@_query("float_fmt", f"WITH {BIG_SQL} SELECT splat_id, format('{{:.9g}}', z) AS shown FROM b")
def float_fmt(spark, d):
    return views.cloud_big(spark, d).select("splat_id", text.float_text(c("z")).alias("shown"))


@_query("strict_numbers", "SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS whole, CAST(NULL AS BIGINT) AS bad, CAST(CAST(o_custkey AS VARCHAR)||'.5' AS DOUBLE) AS real FROM orders")
def strict_numbers(spark, d):
    k = c("o_custkey").cast("string")
    return table(spark, d, "orders").select("o_orderkey", text.strict_int(k).alias("whole"), text.strict_int(F.concat(k, F.lit("x"))).alias("bad"), text.strict_float(F.concat(k, F.lit(".5"))).alias("real"))


@_query("is_sha256", "SELECT page_id, page_id % 5 = 0 AS good FROM pages")
def is_sha256(spark, d):
    """A digest as it is, in capitals, cut, with one digit more, or with a letter that is no digit."""
    h, k = F.sha2("url", 256), c("page_id") % 5
    made = F.when(k == 0, h).when(k == 1, F.upper(F.concat(F.lit("a"), F.substring(h, 2, 63)))).when(k == 2, F.substring(h, 1, 63))
    made = made.when(k == 3, F.concat(h, F.lit("0"))).otherwise(F.concat(F.substring(h, 1, 63), F.lit("g")))
    return table(spark, d, "pages").select("page_id", text.is_sha256(made).alias("good"))


@_query("utf8_len", "SELECT doc_id, doc_id % 5 = 0 AS good FROM documents")
def utf8_len(spark, d):
    """Texts as they are, or followed by an overlong form, a surrogate, a value beyond Unicode or half a character."""
    k = c("doc_id") % 5
    end = F.when(k == 0, F.lit("")).when(k == 1, F.lit("C080")).when(k == 2, F.lit("EDA080")).when(k == 3, F.lit("F4908080")).otherwise(F.lit("E282"))
    return table(spark, d, "documents").select("doc_id", text.is_utf8(F.concat(c("text").cast("binary"), F.unhex(end))).alias("good"))


@_query("color_space_parse", "SELECT c_custkey, 'srgb_rec709_display' AS space, c_custkey % 2 = 1 AS assumed FROM customer")
def color_space_parse(spark, d):
    space, assumed = color.color_space(F.when(c("c_custkey") % 2 == 0, F.lit("srgb_rec709_display")).otherwise(c("c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", space.alias("space"), assumed.alias("assumed"))


@_query("ply_color_norm", "SELECT p_partkey, p_size/CASE p_partkey % 3 WHEN 0 THEN CAST(255 AS DOUBLE) WHEN 1 THEN 65535 ELSE 1 END AS v FROM part")
def ply_color_norm(spark, d):
    kind = F.element_at(F.array(F.lit("uchar"), F.lit("uint16"), F.lit("float")), (c("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", color.channel(c("p_size"), kind).alias("v"))


@_query("ply_declared_fields", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'explicit' WHEN 1 THEN 'converted_rgb' ELSE 'defaulted' END AS label FROM part")
def ply_declared_fields(spark, d):
    k = c("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", text.field_label(k == 0, k == 1).alias("label"))


@_query("concat_views", f"WITH {DEPTH_SQL} SELECT view, count(*) AS n FROM d GROUP BY view")
def concat_views(spark, d):
    v = views.depth_views(spark, d)
    parts = [v.filter(c("view") == k) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("view").agg(F.count("*").alias("n"))


_T = "CASE WHEN opacity >= 0 THEN 1/(1+exp(-abs(opacity))) ELSE exp(-abs(opacity))/(1+exp(-abs(opacity))) END"
_scalar("ply_decode_splat", lambda: {n: c(n) for n in ("sx", "qx", "qw", "opacity")}, {"sx": "sx", "qx": "qx", "qw": "qw", "opacity": "opacity"}, "canon")
_scalar("ply_encode_row", lambda: {"scale_0": activation.log_scale_from_linear(c("sx")), "opacity_logit": activation.logit_clamped(c("opacity")), "rot_0": c("qw")}, {"scale_0": "ln(sx)", "opacity_logit": "ln(greatest(least(opacity,1-1e-6),1e-6)/(1-greatest(least(opacity,1-1e-6),1e-6)))", "rot_0": "qw"}, "canon")


@_query("spz_validate", f"WITH {BIG_SQL} SELECT count(*) FILTER (WHERE abs(x) >= 2048 OR abs(y) >= 2048 OR abs(z) >= 2048) AS n_out, count(*) <= 10000000 AS fits FROM b")
def spz_validate(spark, d):
    most = (1 << 23) / 4096
    out = (F.abs("x") >= most) | (F.abs("y") >= most) | (F.abs("z") >= most)
    return views.cloud_big(spark, d).agg(F.count_if(out).alias("n_out"), (F.count("*") <= 10_000_000).alias("fits"))
