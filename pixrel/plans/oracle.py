"""DuckDB SQL that states the same results as the queries, from the same tables."""

from __future__ import annotations

from pixrel.functions.color import TO_XYZ, WHITE
from pixrel.operators.regions import grid_shape

W, H, TARGET, ROWS, COLS = 64, 50, 160, 11, 15
HW = "window rw as (partition by image_id, y order by x)"
VW = "window cw as (partition by image_id, x order by y)"

PIX = """with v as (select (vec_id // 50)::bigint image_id, (vec_id % 50)::int y, unnest(generate_series(0, len(embedding) - 1))::int x, unnest(embedding)::double v from embeddings),
v0 as (select image_id, y, x, least(greatest(floor((v + 1.0) * 127.5)::int, 0), 255) r from v),
p as (select image_id, y, x, r, (r * 3 + x) % 256 g, (r * 7 + y) % 256 b from v0)"""


def lin(c: str) -> str:
    return f"(case when {c} / 255.0 > 0.04045 then pow(({c} / 255.0 + 0.055) / 1.055, 2.4) else {c} / 255.0 / 12.92 end)"


def lab() -> str:
    xyz = ", ".join(f"({r[0]} * lr + {r[1]} * lg + {r[2]} * lb) / {w} t{i}" for i, (r, w) in enumerate(zip(TO_XYZ, WHITE, strict=True)))
    f = ", ".join(f"case when t{i} > 0.008856 then cbrt(t{i}) else 7.787 * t{i} + 16.0 / 116.0 end f{i}" for i in range(3))
    clip = "least(greatest(floor({} + 0.5)::int, 0), 255)"
    return f"""{PIX},
c1 as (select *, {lin('r')} lr, {lin('g')} lg, {lin('b')} lb from p),
c2 as (select *, {xyz} from c1), c3 as (select *, {f} from c2),
f as (select image_id, y, x, r, g, b, (4899 * r + 9617 * g + 1868 * b + 8192) >> 14 gray,
  {clip.format('(case when t1 > 0.008856 then 116.0 * f1 - 16.0 else 903.3 * t1 end) * 2.55')} * (100.0 / 255.0) lab_l,
  {clip.format('500.0 * (f0 - f1) + 128.0')} - 128.0 lab_a, {clip.format('200.0 * (f1 - f2) + 128.0')} - 128.0 lab_b from c3)"""


LAB = lab()
EDGES = f"""{LAB},
s1 as (select *, coalesce(lead(gray) over rw, lag(gray) over rw) - coalesce(lag(gray) over rw, lead(gray) over rw) d,
  coalesce(lag(gray) over rw, lead(gray) over rw) + 2 * gray + coalesce(lead(gray) over rw, lag(gray) over rw) s from f {HW}),
s2 as (select *, coalesce(lag(d) over cw, lead(d) over cw) + 2 * d + coalesce(lead(d) over cw, lag(d) over cw) gx,
  coalesce(lead(s) over cw, lag(s) over cw) - coalesce(lag(s) over cw, lead(s) over cw) gy from s1 {VW}),
m as (select *, sqrt((gx * gx + gy * gy)::double) / 255.0 magnitude from s2),
tt as (select image_id, greatest(quantile_cont(magnitude, 0.99), 1e-6) top from m group by image_id),
ed as (select m.*, least(magnitude / top, 1.0) edge_strength from m join tt using (image_id))"""


def box(v: str, w: str) -> str:
    return f"(coalesce(lag({v}, 2) over {w}, lag({v}) over {w}, lead({v}) over {w}, {v}) + coalesce(lag({v}) over {w}, {v}) + {v} + coalesce(lead({v}) over {w}, {v}) + coalesce(lead({v}, 2) over {w}, lead({v}) over {w}, lag({v}) over {w}, {v}))"


LEVELS = range(16)
VAR = f"""{EDGES},
b1 as (select *, gray * gray gg, gray * 15 // 255 lev from ed),
b2 as (select *, {box('gray', 'rw')} h1, {box('gg', 'rw')} h2 from b1 {HW}),
lv as (select *, greatest((25 * {box('h2', 'cw')} - {box('h1', 'cw')} * {box('h1', 'cw')}) / (625.0 * 255.0 * 255.0), 0.0) local_variance from b2 {VW}),
n0 as (select *, {', '.join(f'(lev = {k})::int i{k}' for k in LEVELS)} from lv),
n1 as (select *, {', '.join(f'{box(f"i{k}", "rw")} j{k}' for k in LEVELS)} from n0 {HW}),
n2 as (select image_id, y, x, r, g, b, gray, lab_l, lab_a, lab_b, gx, gy, magnitude, edge_strength, local_variance, {', '.join(f'{box(f"j{k}", "cw")} k{k}' for k in LEVELS)} from n1 {VW}),
en as (select image_id, y, x, r, g, b, gray, lab_l, lab_a, lab_b, gx, gy, magnitude, edge_strength, local_variance,
  -({' + '.join(f'case when k{k} > 0 then k{k} / 25.0 * log2(k{k} / 25.0) else 0 end' for k in LEVELS)}) / 4.0 local_entropy from n2)"""

ROBUST_FIELDS = ("gx", "gy", "magnitude", "local_variance")
FEATURES = f"""{VAR},
md as (select image_id, {', '.join(f'median({c}) m_{c}' for c in ROBUST_FIELDS)} from en group by image_id),
m2 as (select * from en join md using (image_id)),
ma as (select image_id, {', '.join(f'median(abs({c} - m_{c})) d_{c}' for c in ROBUST_FIELDS)} from m2 group by image_id),
ro as (select *, {', '.join(f'greatest(-3.0, least(3.0, ({c} - m_{c}) / greatest(1.4826 * d_{c}, 1e-6))) / 3.0 robust_{c}' for c in ROBUST_FIELDS)} from m2 join ma using (image_id)),
un as (select *, min(robust_magnitude) over iw lo1, max(robust_magnitude) over iw hi1, min(robust_local_variance) over iw lo2, max(robust_local_variance) over iw hi2 from ro window iw as (partition by image_id)),
ft as (select *, least(greatest(0.35 * (case when hi1 - lo1 <= 1e-9 then 0 else (robust_magnitude - lo1) / (hi1 - lo1) end)
  + 0.20 * (case when hi2 - lo2 <= 1e-9 then 0 else (robust_local_variance - lo2) / (hi2 - lo2) end) + 0.25 * edge_strength + 0.20 * local_entropy, 0.0), 1.0) complexity from un)"""

CELL = f"(least(y * {ROWS} // {H}, {ROWS - 1}) * {COLS} + least(x * {COLS} // {W}, {COLS - 1}) + 1)::int label"
LABELS = f"{PIX}, l as (select *, {CELL} from p)"


def geometry(src: str) -> str:
    return f"""g0 as (select image_id, label, count(*) area, min(x) min_x, min(y) min_y, max(x) max_x, max(y) max_y, sum(x)::bigint sx, sum(y)::bigint sy, sum(x * x)::bigint sxx, sum(x * y)::bigint sxy, sum(y * y)::bigint syy from {src} group by image_id, label),
ge as (select image_id, label, area, min_x, min_y, max_x, max_y, sx / area cx, sy / area cy,
  case when area < 2 then 0 else ((degrees(0.5 * atan2((2 * (area * sxy - sx * sy))::double, ((area * sxx - sx * sx) - (area * syy - sy * sy))::double)) % 180.0) + 180.0) % 180.0 end orientation from g0)"""


def perimeter(src: str) -> str:
    return f"""q0 as (select image_id, y, x, label, coalesce(lag(label) over rw <> label, true) or coalesce(lead(label) over rw <> label, true) or coalesce(lag(label) over cw <> label, true) or coalesce(lead(label) over cw <> label, true) bd
  from {src} window rw as (partition by image_id, y order by x), cw as (partition by image_id, x order by y)),
q1 as (select * from q0 where bd),
q2 as (select a.image_id, a.label, a.y, a.x, 1 + coalesce(sum(case when b.y is null then 0 when a.y <> b.y and a.x <> b.x then 10 else 2 end), 0) code
  from q1 a left join q1 b on a.image_id = b.image_id and a.label = b.label and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 and (a.y <> b.y or a.x <> b.x) group by all),
pe as (select image_id, label, sum(case when code in (5, 7, 15, 17, 25, 27) then 1.0 when code in (21, 33) then sqrt(2) when code in (13, 23) then (1 + sqrt(2)) / 2 else 0 end) perimeter from q2 group by image_id, label)"""


def hu(src: str) -> str:
    mom = [(i, j) for i in range(4) for j in range(4) if 2 <= i + j <= 3]
    term = lambda i, j: " * ".join(["1.0", *["(x - mx)"] * i, *["(y - my)"] * j])
    e = ", ".join(f"sum({term(i, j)}) / pow(count(*)::double, {1 + (i + j) / 2}) e{i}{j}" for i, j in mom)
    a, b, p, q = "(e30 + e12)", "(e21 + e03)", "(e30 - 3 * e12)", "(3 * e21 - e03)"
    h = ["e20 + e02", "(e20 - e02) * (e20 - e02) + 4 * e11 * e11", f"{p} * {p} + {q} * {q}", f"{a} * {a} + {b} * {b}",
         f"{p} * {a} * ({a} * {a} - 3 * {b} * {b}) + {q} * {b} * (3 * {a} * {a} - {b} * {b})", f"(e20 - e02) * ({a} * {a} - {b} * {b}) + 4 * e11 * {a} * {b}",
         f"{q} * {a} * ({a} * {a} - 3 * {b} * {b}) - {p} * {b} * (3 * {a} * {a} - {b} * {b})"]
    signed = ", ".join(f"-(case when {v} <= -1e-15 then -1.0 else 1.0 end) * log10(case when abs({v}) < 1e-15 then 1e-30 else abs({v}) end) hu{i}" for i, v in enumerate(h, 1))
    return f"""u0 as (select image_id, label, avg(x) mx, avg(y) my from {src} group by image_id, label),
u1 as (select image_id, label, {e} from {src} join u0 using (image_id, label) group by image_id, label), hh as (select image_id, label, {signed} from u1)"""


def contacts(src: str, field: str | None = None) -> str:
    f = lambda w: f", {field} f1, lead({field}) over {w} f2" if field else ""
    return f"""k0 as (select image_id, label a0, lead(label) over rw b0{f('rw')} from {src} {HW} union all select image_id, label, lead(label) over cw{f('cw')} from {src} {VW}),
ct as (select *, least(a0, b0) a, greatest(a0, b0) b from k0 where b0 <> a0)"""


#: Entities of the grid regions with all that relationships need.
ENTITIES = f"""{FEATURES}, l as (select *, {CELL} from ft), {geometry('l')}, {perimeter('l')}, {hu('l')},
st as (select image_id, label, avg(lab_l) lab_l, avg(lab_a) lab_a, avg(lab_b) lab_b, avg(gray / 255.0) brightness, avg(robust_local_variance) texture, avg(edge_strength) gradient, avg(edge_strength) edge_density, avg(complexity) complexity from l group by image_id, label),
en2 as (select ge.image_id, ge.label, ge.cx, ge.cy, ge.area, ge.orientation, perimeter, 4 * pi() * ge.area / greatest(perimeter * perimeter, 1e-9) compactness, hu1, hu2, hu3, hu4, hu5, hu6, hu7, lab_l, lab_a, lab_b, brightness, texture, gradient, edge_density, complexity
  from ge join pe using (image_id, label) join hh using (image_id, label) join st using (image_id, label))"""


def knn(src: str, axes: tuple[str, ...], name: str, k: int = 3) -> str:
    d2 = " + ".join(f"(s.{c} - t.{c}) * (s.{c} - t.{c})" for c in axes)
    return f"""{name} as (select * from (select s.image_id, s.label s, t.label t, round({d2}, 9) d2, row_number() over (partition by s.image_id, s.label order by round({d2}, 9), t.label) rank from {src} s join {src} t on s.image_id = t.image_id and s.label <> t.label) where rank <= {k})"""


CANDIDATES = f"""{ENTITIES}, {contacts('l')}, sb as (select image_id, a, b, count(*) contacts from ct group by image_id, a, b), {knn('en2', ('cx', 'cy'), 'ks')}, {knn('en2', ('lab_l', 'lab_a', 'lab_b'), 'ka')},
cd as (select image_id, a, b, list_sort(list(distinct why)) sources from (select image_id, a, b, 'adjacent' why from sb union all select image_id, least(s, t), greatest(s, t), 'spatial_knn' from ks union all select image_id, least(s, t), greatest(s, t), 'appearance_knn' from ka) group by image_id, a, b)"""

RELATIONS = f"""{CANDIDATES},
r0 as (select cd.image_id, cd.a, cd.b, sources, coalesce(contacts, 0) contacts, list_contains(sources, 'adjacent') adjacent, t.cx - s.cx dx, t.cy - s.cy dy,
  sqrt((s.lab_l - t.lab_l) * (s.lab_l - t.lab_l) + (s.lab_a - t.lab_a) * (s.lab_a - t.lab_a) + (s.lab_b - t.lab_b) * (s.lab_b - t.lab_b)) cdist,
  sqrt({' + '.join(f'(s.hu{i} - t.hu{i}) * (s.hu{i} - t.hu{i})' for i in range(1, 8))}) hud, abs(s.compactness - t.compactness) cd0, abs(radians(s.orientation) - radians(t.orientation)) % pi() od,
  abs(s.brightness - t.brightness) bd, exp(-abs(s.texture - t.texture) / 0.20) ts, exp(-abs(s.gradient - t.gradient) / 0.30) gs, (s.edge_density + t.edge_density) / 2 ed,
  (s.complexity * s.area + t.complexity * t.area) / (s.area + t.area) load, s.area sa, t.area ta, s.brightness sbr, t.brightness tbr, least(s.perimeter, t.perimeter) pm
  from cd left join sb using (image_id, a, b) join en2 s on s.image_id = cd.image_id and s.label = cd.a join en2 t on t.image_id = cd.image_id and t.label = cd.b),
r1 as (select *, sqrt(dx * dx + dy * dy) dist, sqrt(dx * dx + dy * dy) / {(W * W + H * H) ** 0.5} nd, exp(-cdist * cdist / (2 * 22.0 * 22.0)) cs,
  greatest(0.0, least(1.0, exp(-(0.25 * cd0 + 0.20 * (least(od, pi() - od) / pi()) + 0.55 * least(hud / 25.0, 1.0))))) ss from r0),
r2 as (select *, 0.16 * exp(-nd * nd / (2 * 0.20 * 0.20)) + 0.25 * cs + 0.12 * exp(-bd / 0.20) + 0.13 * ts + 0.12 * gs + 0.12 * ss - 0.10 * ed aff from r1),
r3 as (select *, greatest(0.0, least(1.0, aff * (1.0 - 0.35 * load))) ma from r2),
r4 as (select *, greatest(0.0, least(1.0, 0.35 * ma + 0.30 * adjacent::int + 0.20 * cs + 0.15 * ss)) conf,
  list_filter([case when adjacent then 'adjacent' end, case when nd <= 0.22 then 'near' end, case when cs >= 0.82 then 'similar_color' end, case when ss >= 0.80 then 'similar_shape' end], lambda z: z is not null) kk from r3),
rel as (select *, case when len(kk) = 0 then ['related'] else kk end kinds from r4)"""



def levels(factors: tuple[int, ...] = (2, 4, 8)) -> str:
    """Grid regions l of the images and lc of each coarse level, and what they share as lp; factor tells the level."""
    out = [f"{PIX}, l as (select *, {CELL} from p), im as (select distinct image_id from p)"]
    for k in factors:
        w, h = max(2, W // k), max(2, H // k)
        rows, cols = grid_shape(w, h, max(8, TARGET // (k * k)))
        cell = f"(least(y * {rows} // {h}, {rows - 1}) * {cols} + least(x * {cols} // {w}, {cols - 1}) + 1)::int label"
        out.append(f"lc{k} as (select {k}::int factor, image_id, y, x, {cell} from im, range({h}) a(y), range({w}) b(x))")
        out.append(f"lf{k} as (select {k}::int factor, f.image_id, f.label source, c.label target, count(*) common from l f join lc{k} c on f.image_id = c.image_id and c.x = f.x * {w} // {W} and c.y = f.y * {h} // {H} group by all)")
    every = lambda name: " union all ".join(f"select * from {name}{k}" for k in factors)
    out += [f"lc as ({every('lc')})", f"lf as ({every('lf')})", "lp as (select *, sum(common) over (partition by factor, image_id, source)::bigint source_area, sum(common) over (partition by factor, image_id, target)::bigint target_area from lf)"]
    out.append("fs as (select image_id, label, count(*) area, avg(x) cx, avg(y) cy from l group by image_id, label), cs as (select factor, image_id, label, count(*) area, avg(x) cx, avg(y) cy from lc group by factor, image_id, label)")
    return ", ".join(out)


LEVELS_SQL = levels()

RECON = f"""{LABELS}, mn as (select image_id, label, round_even(avg(r), 0)::int rr, round_even(avg(g), 0)::int rg, round_even(avg(b), 0)::int rb from l group by image_id, label),
rc as (select *, abs(r - rr) + abs(g - rg) + abs(b - rb) error from l join mn using (image_id, label))"""

JOBS = """with pr as (select user_id job, event_id seq, event_type stage, least(99, floor(value / 5)::int) percent, epoch_us(ts) // 1000 now_ms, props message from events)"""
ISLANDS = f"""{JOBS}, i0 as (select *, case when lag(stage) over w = stage then 0 else 1 end nw from pr window w as (partition by job order by now_ms, seq)),
i1 as (select *, sum(nw) over (partition by job order by now_ms, seq rows unbounded preceding)::bigint island from i0),
i2 as (select job, island, min(stage) stage, min(now_ms) started, max(now_ms) ended, count(*) reports from i1 group by job, island),
isl as (select *, coalesce(lead(started) over (partition by job order by island), ended) - started duration from i2)"""
