"""Map operators; an embedding read as an 8 x 8 grid, p = 1 / (1 + exp(-4 x)), its second view mirrored."""

from __future__ import annotations

from pyspark.sql import functions as F

from thicketry.functions import scores
from thicketry.functions import vectors as V
from thicketry.operators import maps as M
from thicketry.operators import selection as S
from thicketry.plans.catalogue import query
from thicketry.session import table

H = W = 8
_MAPS = "WITH m AS (SELECT vec_id, list_transform(embedding, lambda x: 1/(1+exp(-4*CAST(x AS DOUBLE)))) AS p FROM embeddings), g AS (SELECT vec_id, p, list_transform(range(64), lambda i: p[(i//8)*8+(7-i%8)+1]) AS v FROM m)"
_PIX = _MAPS + ", x AS (SELECT vec_id, i::INT AS cell, (i//8)::INT AS y, (i%8)::INT AS x, p[i+1] AS p, v[i+1] AS v, (p[i+1]>0.5)::INT AS m FROM g, (SELECT unnest(range(64)) i))"


def _maps(s, d):
    p = F.transform("embedding", lambda x: 1 / (1 + F.exp(-4 * x.cast("double"))))
    m = table(s, d, "embeddings").select("vec_id", p.alias("p"))
    return m.withColumn("view", V.flip_rows("p", H, W))


def _at(a: str, dy: int, dx: int) -> str:
    """The replicated neighbour of cell i in SQL."""
    return f"{a}[greatest(0,least(7,i//8+({dy})))*8+greatest(0,least(7,i%8+({dx})))+1]"


def _sobel_sql(a: str, scale: str, clear: bool) -> str:
    gx = f"({_at(a, -1, 1)}+2*{_at(a, 0, 1)}+{_at(a, 1, 1)}-{_at(a, -1, -1)}-2*{_at(a, 0, -1)}-{_at(a, 1, -1)})*{scale}"
    gy = f"({_at(a, 1, -1)}+2*{_at(a, 1, 0)}+{_at(a, 1, 1)}-{_at(a, -1, -1)}-2*{_at(a, -1, 0)}-{_at(a, -1, 1)})*{scale}"
    g = f"sqrt(({gx})*({gx})+({gy})*({gy}))"
    return f"CASE WHEN i//8 IN (0,7) OR i%8 IN (0,7) THEN 0.0 ELSE {g} END" if clear else g


#: The three published forms of the boundary score (scale, cleared border, added eps, value).
FORMS = {"band": (1 / 8, "0.125", False, False, "b*(1-w)"), "gap": (1.0, "1.0", True, True, "greatest(0,b-w)*(1-w)"), "smooth": (1 / 8, "0.125", True, False, "b*(1-w)")}


def _boundary_sql(scale: str, clear: bool, add: bool, value: str) -> str:
    low = "(mass+1e-6)" if add else "greatest(mass,1e-6)"
    return f"""{_MAPS}, a AS (SELECT vec_id, p, v, list_transform(range(1,65), lambda i: (p[i]+v[i])/2) AS a FROM g), s AS (SELECT vec_id, list_transform(range(64), lambda i: {_sobel_sql('a', scale, clear)}) AS g, list_transform(range(1,65), lambda i: abs(p[i]-v[i])) AS dd FROM a),
    t AS (SELECT vec_id, list_sum(g) AS mass, list_sum(list_transform(range(1,65), lambda i: g[i]*dd[i])) AS num, list_sum(dd)/64 AS w FROM s), b AS (SELECT vec_id, mass, num/{low} AS b, w FROM t)
    SELECT vec_id, round(b,6) AS boundary, round(w,6) AS whole, round(mass,6) AS mass, round(greatest(0,least(1,{value})),6) AS value FROM b"""


def _boundary(scale, clear, add, mode):
    def run(s, d):
        m = _maps(s, d).select("vec_id", M.boundary_scores("p", "view", H, W, scale, clear, add).alias("c"))
        m = m.select("vec_id", F.col("c.boundary").alias("b"), F.col("c.whole").alias("w"), F.col("c.mass").alias("mass"))
        return m.select("vec_id", F.round("b", 6).alias("boundary"), F.round("w", 6).alias("whole"), F.round("mass", 6).alias("mass"), F.round(scores.value("b", "w", mode), 6).alias("value"))

    return run


for _n, (_s, _t, _c, _a, _e) in FORMS.items():
    query(f"boundary_score_{_n}", _boundary_sql(_t, _c, _a, _e))(_boundary(_s, _c, _a, "hard_gap" if _n == "gap" else "smooth"))

_ER = "least(" + ",".join(_at("m", dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"
_DI = "greatest(" + ",".join(_at("m", dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)) + ")"
#: Whether cell i of mask m is at the boundary, on either side.
_AT_EDGE = f"CASE WHEN m[i+1]>0 THEN {_ER}=0 ELSE {_DI}>0 END"
_REGION = f"{_MAPS}, k AS (SELECT vec_id, p, list_transform(p, lambda x: CASE WHEN x>0.5 THEN 1 ELSE 0 END) AS m FROM g), rr AS (SELECT vec_id, p, list_transform(range(64), lambda i: CASE WHEN m[i+1]>0 THEN CASE WHEN {_ER}>0 THEN 0 ELSE 2 END WHEN {_DI}>0 THEN 3 ELSE 1 END) AS r FROM k), z AS (SELECT vec_id, i::INT AS cell, r[i+1]::INT AS region, abs(2*p[i+1]-1) AS reliability FROM rr, (SELECT unnest(range(64)) i))"


def _regions(s, d):
    m = _maps(s, d).withColumn("m", F.transform("p", lambda x: (x > 0.5).cast("int")))
    r = m.select("vec_id", F.posexplode(F.arrays_zip(M.regions("m", H, W).alias("r"), F.transform("p", lambda x: F.abs(2 * x - 1)).alias("q"))).alias("cell", "c"))
    return r.select("vec_id", "cell", F.col("c.r").cast("int").alias("region"), F.col("c.q").alias("reliability"))


@query("region_partition", f"{_REGION} SELECT vec_id, region, count(*) AS n FROM z GROUP BY 1,2")
def region_partition(s, d):
    return _regions(s, d).groupBy("vec_id", "region").agg(F.count(F.lit(1)).alias("n"))


@query("region_quota_sample", f"{_REGION}, q AS (SELECT *, count(*) OVER (PARTITION BY vec_id, region) n, row_number() OVER (PARTITION BY vec_id, region ORDER BY reliability DESC, cell) AS rank FROM z) SELECT vec_id, region, cell, rank FROM q WHERE rank <= least(n, 6, greatest(2, round_even(n*0.2,0)))")
def region_quota_sample(s, d):
    return S.region_sample(_regions(s, d), ["vec_id", "region"], "reliability", "cell", 0.2, 2, 6).select("vec_id", "region", "cell", "rank")


@query("forward_differences", f"{_PIX}, f AS (SELECT vec_id, y, x, coalesce(lead(p) OVER (PARTITION BY vec_id, y ORDER BY x)-p,0) dx, coalesce(lead(p) OVER (PARTITION BY vec_id, x ORDER BY y)-p,0) dy, p FROM x) SELECT vec_id, round(sum(abs(dx)+abs(dy)),6) AS strength, round(sum(abs(p))/64+sum(abs(dx)+abs(dy))/64,6) AS variation FROM f GROUP BY 1")
def forward_differences(s, d):
    return _maps(s, d).select("vec_id", F.round(V.total(V.forward_difference("p", H, W)), 6).alias("strength"), F.round(M.total_variation("p", H, W), 6).alias("variation"))


@query("lead_differences", f"{_PIX} SELECT vec_id, y, x, round(coalesce(lead(p) OVER (PARTITION BY vec_id, y ORDER BY x)-p,0),6)+0.0 AS dx, round(coalesce(lead(p) OVER (PARTITION BY vec_id, x ORDER BY y)-p,0),6)+0.0 AS dy FROM x")
def lead_differences(s, d):
    x = _maps(s, d).select("vec_id", F.posexplode("p").alias("cell", "p"))
    x = x.select("vec_id", F.floor(F.col("cell") / W).cast("int").alias("y"), F.expr(f"cell % {W}").alias("x"), "p")
    return M.lead_difference(x, "vec_id", "y", "x", "p").select("vec_id", "y", "x", (F.round("dx", 6) + 0.0).alias("dx"), (F.round("dy", 6) + 0.0).alias("dy"))


_CELLS = "(SELECT unnest(range(64)) i)"
_BOX = "list_sum(list_transform(range(64), lambda j: CASE WHEN abs(j//8-i//8)<=2 AND abs(j%8-i%8)<=2 THEN p[j+1] ELSE 0 END))/25.0"


def _exploded(df, digits=6, **arrays):
    """(vec_id, cell, one value an array), rounded, of whole arrays of equal length."""
    x = df.select("vec_id", F.posexplode(F.arrays_zip(*(a.alias(n) for n, a in arrays.items()))).alias("cell", "c"))
    return x.select("vec_id", "cell", *((F.round(F.col(f"c.{n}"), digits) + 0.0).alias(n) for n in arrays))


@query("box_average", f"{_MAPS} SELECT vec_id, i::INT AS cell, round({_BOX},6)+0.0 AS mean FROM g, {_CELLS}")
def box_average(s, d):
    return _exploded(_maps(s, d), mean=V.box_average("p", H, W, 2))


@query("boundary_prototype", f"{_PIX}, w AS (SELECT vec_id%20 AS grp, vec_id, abs(p-v) AS wt FROM x WHERE cell=0), u AS (SELECT vec_id, generate_subscripts(embedding,1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings), l AS (SELECT vec_id, sqrt(sum(e*e)) n FROM u GROUP BY 1), t AS (SELECT grp, pos, sum(wt*e/n) sm, sum(wt) ms FROM w JOIN u USING (vec_id) JOIN l USING (vec_id) GROUP BY 1,2), n AS (SELECT grp, sqrt(sum(sm*sm)) n, max(ms)>1e-6 AS ok FROM t GROUP BY 1) SELECT grp, (pos-1)::INT AS pos, round(CASE WHEN ok THEN sm/n ELSE 0 END,6)+0.0 AS value, ok AS valid FROM t JOIN n USING (grp)")
def boundary_prototype(s, d):
    weight = F.abs(F.col("p")[0] - F.col("view")[0])
    points = _maps(s, d).select("vec_id", weight.alias("weight")).join(table(s, d, "embeddings"), "vec_id").select(F.expr("vec_id % 20").alias("grp"), "embedding", "weight")
    p = M.weighted_prototype(points, "grp", "embedding", "weight")
    return p.select("grp", F.posexplode("prototype").alias("pos", "v"), "valid").select("grp", "pos", (F.round("v", 6) + 0.0).alias("value"), "valid")


@query("grid_gather", f"{_PIX}, c AS (SELECT vec_id, (vec_id%64)::INT AS cell FROM embeddings), o AS (SELECT vec_id, cell, cell//8+dy AS yy, cell%8+dx AS xx, dy, dx FROM c, (SELECT unnest([-1,0,1]) dy), (SELECT unnest([-1,0,1]) dx)) SELECT o.vec_id, dy::INT AS dy, dx::INT AS dx, (yy BETWEEN 0 AND 7 AND xx BETWEEN 0 AND 7) AS inside, round(x.p,6) AS value FROM o LEFT JOIN x ON x.vec_id=o.vec_id AND x.y=yy AND x.x=xx")
def grid_gather(s, d):
    cells = table(s, d, "embeddings").select("vec_id", F.expr("cast(vec_id % 64 as int)").alias("cell"))
    near = M.window_cells(cells, "cell", H, W)
    return M.gather(near, "vec_id", "near", _maps(s, d), "p").select("vec_id", "dy", "dx", "inside", F.round("value", 6).alias("value"))


@query("scatter_cells", f"{_PIX}, c AS (SELECT vec_id, (y//2)*4+x//2 AS cell, p, cell AS o FROM x) SELECT vec_id, cell::INT AS cell, round(avg(p),6) AS mean, round(sum(p),6) AS total, round(max_by(p, o),6) AS last FROM c GROUP BY 1,2")
def scatter_cells(s, d):
    x = _maps(s, d).select("vec_id", F.posexplode("p").alias("o", "p")).select("vec_id", "o", "p", V.scale_index("o", H, W, 4, 4).alias("cell"))
    mean, add, last = (M.scatter(x, "vec_id", "cell", "p", how, "o").withColumnRenamed("p", how) for how in ("mean", "add", "replace"))
    out = mean.join(add, ["vec_id", "cell"]).join(last, ["vec_id", "cell"])
    return out.select("vec_id", "cell", F.round("mean", 6).alias("mean"), F.round("add", 6).alias("total"), F.round("replace", 6).alias("last"))


@query("resized_maps", f"{_MAPS} SELECT vec_id, i::INT AS cell, round((p[(i//4)*16+(i%4)*2+1]+p[(i//4)*16+(i%4)*2+2]+p[(i//4)*16+(i%4)*2+9]+p[(i//4)*16+(i%4)*2+10])/4,6)+0.0 AS value, 'area' AS how FROM g, (SELECT unnest(range(16)) i) UNION ALL SELECT vec_id, i::INT, round(p[(i//32)*8+(i%16)//2+1],6)+0.0, 'nearest' FROM g, (SELECT unnest(range(256)) i)")
def resized_maps(s, d):
    m = _maps(s, d)
    area, near = (_exploded(m, value=x).withColumn("how", F.lit(n)) for n, x in (("area", V.resize_area("p", H, W, 2, 2)), ("nearest", V.resize_nearest("p", H, W, 16, 16))))
    return area.unionByName(near)


@query("resized_bilinear", f"{_MAPS}, a AS (SELECT i, greatest(0,least(7,(i//16+0.5)/2-0.5)) AS y, greatest(0,least(7,(i%16+0.5)/2-0.5)) AS x FROM (SELECT unnest(range(256)) i)), k AS (SELECT i, floor(y)::INT y0, least(7,floor(y)+1)::INT y1, y-floor(y) fy, floor(x)::INT x0, least(7,floor(x)+1)::INT x1, x-floor(x) fx FROM a) SELECT vec_id, i::INT AS cell, round((1-fy)*((1-fx)*p[y0*8+x0+1]+fx*p[y0*8+x1+1])+fy*((1-fx)*p[y1*8+x0+1]+fx*p[y1*8+x1+1]),6)+0.0 AS value FROM g, k")
def resized_bilinear(s, d):
    return _exploded(M.resize_bilinear(_maps(s, d), "vec_id", "p", H, W, 16, 16), value=F.col("p"))


@query("map_geometry", f"{_PIX}, f AS (SELECT vec_id, cell, p, coalesce(lead(p) OVER (PARTITION BY vec_id, y ORDER BY x)-p,0) dx, coalesce(lead(p) OVER (PARTITION BY vec_id, x ORDER BY y)-p,0) dy FROM x), n AS (SELECT *, greatest(sqrt(dx*dx+dy*dy),1e-6) AS l FROM f) SELECT vec_id, cell, round(2*p-1,6)+0.0 AS sdf, round(dx/l,6)+0.0 AS nx, round(dy/l,6)+0.0 AS ny, round((1-2*p)/2,6)+0.0 AS \"offset\", round(abs(2*p-1),6)+0.0 AS reliability FROM n")
def map_geometry(s, d):
    return _exploded(_maps(s, d), **M.geometry("p", H, W))


_WB = "(1+5*abs(wb-g))"


@query("structure_loss", f"{_MAPS}, k AS (SELECT vec_id, p, list_transform(v, lambda x: CASE WHEN x>0.5 THEN 1.0 ELSE 0.0 END) AS t FROM g), b AS (SELECT vec_id, unnest(list_transform(range(64), lambda i: {{'p': greatest(1e-6,least(1-1e-6,p[i+1])), 'g': t[i+1], 'wb': list_sum(list_transform(range(64), lambda j: CASE WHEN abs(j//8-i//8)<=15 AND abs(j%8-i%8)<=15 THEN t[j+1] ELSE 0 END))/961.0}})) AS c FROM k), e AS (SELECT vec_id, c.p AS p, c.g AS g, c.wb AS wb FROM b), s AS (SELECT vec_id, sum({_WB}*-(g*ln(p)+(1-g)*ln(1-p)))/sum({_WB}) AS wbce, sum({_WB}*p*g) AS inter, sum({_WB}*(p+g)) AS uni FROM e GROUP BY 1) SELECT vec_id, round(wbce+1-(inter+1)/(uni-inter+1),6) AS loss FROM s")
def structure_loss(s, d):
    m = _maps(s, d).withColumn("g", F.transform("view", lambda x: F.when(x > 0.5, 1.0).otherwise(0.0)))
    return m.select("vec_id", F.round(M.structure_loss("p", "g", H, W), 6).alias("loss"))


_SDF = f"{_PIX}, o AS (SELECT a.vec_id, a.cell, a.y, a.x, a.m, min(sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) AS d FROM x a LEFT JOIN x b ON b.vec_id=a.vec_id AND b.m<>a.m GROUP BY 1,2,3,4,5), sd AS (SELECT vec_id, cell, y, x, CASE WHEN m=1 THEN coalesce(d,16) ELSE -coalesce(d,16) END AS sdf FROM o)"


@query("signed_distances", f"{_SDF} SELECT vec_id, cell, round(sdf,6)+0.0 AS sdf FROM sd")
def signed_distances(s, d):
    m = _maps(s, d).select("vec_id", F.transform("p", lambda x: (x > 0.5).cast("int")).alias("m"))
    return _exploded(M.signed_distance(m, "vec_id", "m", H, W), sdf=F.col("sdf"))


_SCALED = "greatest(-1,least(1,sdf/8.0))"
_DIFF = "(coalesce(lead({c}) OVER ({w}),{c})-coalesce(lag({c}) OVER ({w}),{c}))/CASE WHEN {k} IN (0,7) THEN 1 ELSE 2 END"


@query(
    "mask_geometry",
    f"""{_SDF}, t AS (SELECT vec_id, cell, y, x, {_SCALED} AS f FROM sd), r AS (SELECT *, {_DIFF.format(c='f', w='PARTITION BY vec_id, x ORDER BY y', k='y')} AS dy, {_DIFF.format(c='f', w='PARTITION BY vec_id, y ORDER BY x', k='x')} AS dx FROM t),
    n AS (SELECT *, sqrt(dx*dx+dy*dy+1e-6) AS l FROM r) SELECT vec_id, cell, round(f,5)+0.0 AS sdf, round(dx/l,5)+0.0 AS nx, round(dy/l,5)+0.0 AS ny, round(-f*dx/l,5)+0.0 AS ox, round(-f*dy/l,5)+0.0 AS oy, round(exp(-abs(f)/0.25),5)+0.0 AS reliability FROM n""",
)
def mask_geometry(s, d):
    """Distance field of a mask with normals, offsets to the edge and reliability."""
    m = _maps(s, d).select("vec_id", F.transform("p", lambda x: (x > 0.5).cast("int")).alias("m"))
    return _exploded(M.mask_geometry(m, "vec_id", "m", H, W, 0.25), 5, **{c: F.col(c) for c in ("sdf", "nx", "ny", "ox", "oy", "reliability")})


@query("token_grid", f"{_PIX} SELECT vec_id, y::INT AS y, [round(v,6)+0.0 FOR v IN list(p ORDER BY x)] AS row FROM x GROUP BY 1,2")
def token_grid(s, d):
    """A flat run of cells as rows of a grid, and flat again before it is cut once more."""
    rows = V.to_grid(V.from_grid(V.to_grid("p", H, W)), H, W)
    x = _maps(s, d).select("vec_id", F.posexplode(rows).alias("y", "row"))
    return x.select("vec_id", "y", F.transform("row", lambda v: F.round(v, 6) + 0.0).alias("row"))
