"""The projections of ``checks.views`` and shared intermediate results as SQL common table expressions."""
from __future__ import annotations

import re

BASE = ("CASE WHEN ({r}*31+{c}*17+{d}*13)%23=0 THEN 255 WHEN ({r}%64-50)*({r}%64-50)+({c}-22)*({c}-22) < 40+90*(5-abs({d}-5)) "
        "AND ({r}*5+{c}*3+{d})%11<>0 THEN 1 ELSE 0 END")


def base(d="d", r="r", c="c"):
    return BASE.format(d=d, r=r, c=c)


def rint(e: str, digits: int = 0) -> str:
    """Scale, round half to even, unscale."""
    p = f"{float(10 ** digits)}::DOUBLE"
    s = f"(({e})*{p})"
    return f"((CASE WHEN abs({s}-floor({s}))=0.5 THEN 2*round({s}/2) ELSE round({s}) END)/{p})"


CTES = {
    "c": "SELECT count(*) AS n, greatest(64, CAST(ceil((count(*)//50)*200/160.0) AS BIGINT)+1) AS h FROM part",
    "nodes": "SELECT p_partkey AS node_id, ((p_partkey%50)*200+(p_size%5)*10)::DOUBLE AS x, ((p_partkey//50)*200+(p_size%7)*10)::DOUBLE AS y FROM part",
    "links": """SELECT p_partkey AS u, p_partkey+1 AS v FROM part, c WHERE p_partkey%50<49 AND (p_partkey*7+p_size)%10<8 AND p_partkey+1<n
        UNION ALL SELECT p_partkey, p_partkey+50 FROM part, c WHERE (p_partkey*3+p_size)%10<8 AND p_partkey+50<n""",
    "edges": """SELECT l.u||'-'||l.v||'-0' AS edge_id, l.u, l.v, CASE WHEN l.u%3=0 THEN b.x ELSE a.x END AS x0, CASE WHEN l.u%3=0 THEN b.y ELSE a.y END AS y0, CASE WHEN l.u%3=0 THEN a.x ELSE b.x END AS x1, CASE WHEN l.u%3=0 THEN a.y ELSE b.y END AS y1, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS len,
        floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*1000)::BIGINT AS mm, floor(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))*1000)/1000.0 AS length_m
        FROM links l JOIN nodes a ON a.node_id=l.u JOIN nodes b ON b.node_id=l.v""",
    "lattice": f"SELECT d, r, c, {base()} AS b FROM (SELECT i//(h*64) AS d, (i//64)%h AS r, i%64 AS c FROM (SELECT unnest(range(10*h*64)) AS i, h FROM c))",
    "hits0": f"""SELECT d, source, r, c, l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag='A' OR b=255 THEN 255
        WHEN (source='modis' AND (r+c)%7=0) OR (source='unosat' AND (r+2*c)%9=0) THEN 1-b ELSE b END AS value FROM (
        SELECT *, {base()} AS b FROM (SELECT l_orderkey%10 AS d, CASE l_linenumber%3 WHEN 0 THEN 'sentinel1' WHEN 1 THEN 'unosat' ELSE 'modis' END AS source,
        l_partkey%h AS r, (l_suppkey*7+l_linenumber)%64 AS c, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM lineitem, c))""",
    "hits": "SELECT d, source, r, c, arg_max(value, (l_orderkey,l_linenumber,value)) AS value FROM hits0 GROUP BY ALL",
    "cells": """SELECT DATE '2022-06-01'+d::INT AS date, source, r::INT AS row, c::INT AS col, value::INT AS value FROM (
        SELECT * FROM hits UNION ALL SELECT d, 'dem_estimate', r, c, b FROM lattice WHERE (r+c)%5<>0
        UNION ALL SELECT DISTINCT 10, unnest(['sentinel1','unosat']), p_partkey%h, p_size%64, 255 FROM part, c)""",
    "merged": """SELECT date, row, col, arg_min(value, k) AS value, min(k)::INT AS source_rank FROM (
        SELECT *, CASE source WHEN 'sentinel1' THEN 0 WHEN 'unosat' THEN 1 WHEN 'dem_estimate' THEN 2 ELSE 3 END AS k FROM cells WHERE value<>255) GROUP BY ALL""",
    "summary": f"""SELECT date, coalesce(string_agg(DISTINCT s, '+' ORDER BY s), '') AS src, {rint("100.0::DOUBLE*coalesce(sum((value=1)::INT), 0)/(64*h)", 2)} AS flooded_pct,
        {rint("100.0::DOUBLE*coalesce(sum((value=0)::INT), 0)/(64*h)", 2)} AS dry_pct, {rint("100.0::DOUBLE*(64*h-count(value))/(64*h)", 2)} AS unknown_pct
        FROM dates LEFT JOIN (SELECT *, source_rank::VARCHAR AS s FROM merged) USING (date), c GROUP BY date, h""",
    "coverage": """SELECT date, replace(replace(replace(replace(src,'0','sentinel1'),'1+','unosat+'),'2','dem_estimate'),'3','modis') AS s0, flooded_pct, dry_pct, unknown_pct FROM summary""",
    "points": """SELECT edge_id, k, x0+(x1-x0)*t AS x, y0+(y1-y0)*t AS y, m FROM (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (len*k/(m-1))/len)) AS t FROM (
        SELECT *, unnest(range(m))::INT AS k FROM (SELECT *, greatest(2, ceil(len/20.0::DOUBLE)::INT+1) AS m FROM edges)))""",
    "pcells": "SELECT edge_id, k, x, y, m, floor((h*160.0::DOUBLE-y)/160.0::DOUBLE)::INT AS row, floor(x/160.0::DOUBLE)::INT AS col FROM points, c",
    "dates": "SELECT DISTINCT date FROM cells",
    "frac": """SELECT date, edge_id, sum((value=1)::INT)::DOUBLE/count(*) AS ff, sum((value=255)::INT)::DOUBLE/count(*) AS fu FROM (
        SELECT d.date, p.edge_id, coalesce(g.value, 255) AS value FROM pcells p CROSS JOIN dates d LEFT JOIN merged g ON g.date=d.date AND g.row=p.row AND g.col=p.col) GROUP BY ALL""",
    "road_status": f"""SELECT threshold, date, edge_id, {rint("ff", 3)} AS frac_flooded, {rint("fu", 3)} AS frac_unknown,
        CASE WHEN ff>threshold THEN 'cut' WHEN fu>0.5::DOUBLE THEN 'unknown' ELSE 'open' END AS status FROM frac, (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE]) AS threshold)""",
    "villages": """SELECT printf('v%06d', c_custkey) AS village_id, c_name AS name, CASE WHEN c_custkey%17<>0 THEN floor(abs(c_acctbal))::BIGINT END AS population,
        CASE WHEN c_custkey%10=0 THEN -(100+(c_custkey%13)*100)::DOUBLE ELSE x+30 END AS x, y+40 AS y FROM (SELECT *, (c_custkey*37)%n AS node_id FROM customer, c) JOIN nodes USING (node_id)""",
    "shelters": """SELECT printf('s%05d', s_suppkey) AS shelter_id, s_name AS name, CASE WHEN s_suppkey%20=0 THEN -(100+(s_suppkey%13)*100)::DOUBLE ELSE x+30 END AS x, y+40 AS y
        FROM (SELECT *, (s_suppkey*113+n//2)%n AS node_id FROM supplier, c) JOIN nodes USING (node_id)""",
    "vsnap": """SELECT village_id, any_value(name) AS name, any_value(population) AS population, arg_min(node_id, (d, node_id)) AS node_id, min(d) AS snap_dist_m FROM (
        SELECT v.*, m.node_id, sqrt((v.x-m.x)*(v.x-m.x)+(v.y-m.y)*(v.y-m.y)) AS d FROM villages v, nodes m) GROUP BY village_id""",
    "ssnap": """SELECT shelter_id, any_value(name) AS name, arg_min(node_id, (d, node_id)) AS node_id, min(d) AS snap_dist_m FROM (
        SELECT v.*, m.node_id, sqrt((v.x-m.x)*(v.x-m.x)+(v.y-m.y)*(v.y-m.y)) AS d FROM shelters v, nodes m) GROUP BY shelter_id""",
    "sjunction": "SELECT node_id, min(shelter_id) AS shelter_id FROM ssnap WHERE snap_dist_m<=1000 GROUP BY node_id",
    "graph": """SELECT s.threshold, s.date, m.mode, e.u, e.v, greatest(1, e.mm) AS w, e.edge_id FROM road_status s JOIN edges e USING (edge_id),
        (SELECT unnest(['pessimistic','optimistic']) AS mode) m WHERE e.u<>e.v AND (s.status='open' OR (m.mode='optimistic' AND s.status<>'cut'))""",
    "arcs": "SELECT threshold, date, mode, u AS a, v AS b, w FROM graph UNION ALL SELECT threshold, date, mode, v, u, w FROM graph",
    "seeds": """SELECT k.threshold, k.date, m.mode, j.node_id AS node FROM (SELECT DISTINCT threshold, date FROM road_status) k, (SELECT unnest(['pessimistic','optimistic']) AS mode) m,
        (SELECT node_id FROM sjunction WHERE node_id IN (SELECT u FROM edges UNION SELECT v FROM edges)) j""",
    "solved(threshold, date, mode, node, dist, src) USING KEY (threshold, date, mode, node)": """SELECT threshold, date, mode, node, 0::BIGINT, node FROM seeds UNION
        SELECT threshold, date, mode, node, dist, src FROM (SELECT x.threshold, x.date, x.mode, x.node, min(x.d) AS dist, arg_min(x.src, (x.d, x.src)) AS src FROM (
        SELECT e.threshold, e.date, e.mode, e.b AS node, t.dist+e.w AS d, t.src FROM solved t JOIN arcs e ON e.threshold=t.threshold AND e.date=t.date AND e.mode=t.mode AND e.a=t.node) x
        GROUP BY x.threshold, x.date, x.mode, x.node) y WHERE NOT EXISTS (SELECT 1 FROM recurring.solved o WHERE o.threshold=y.threshold AND o.date=y.date AND o.mode=y.mode AND o.node=y.node
        AND (o.dist<y.dist OR (o.dist=y.dist AND o.src<=y.src)))""",
    "vstatus": f"""SELECT k.threshold, k.date, v.village_id, CASE WHEN v.snap_dist_m>500 THEN 'boat_dependent' WHEN p.dist IS NOT NULL THEN 'connected' WHEN o.dist IS NULL THEN 'isolated' ELSE 'uncertain' END AS status,
        {rint("p.dist/1000.0::DOUBLE", 1)} AS dist_to_shelter_m, j.shelter_id AS nearest_shelter_id FROM vsnap v CROSS JOIN (SELECT DISTINCT threshold, date FROM road_status) k
        LEFT JOIN (SELECT * FROM solved WHERE mode='pessimistic') p ON p.threshold=k.threshold AND p.date=k.date AND p.node=v.node_id
        LEFT JOIN (SELECT * FROM solved WHERE mode='optimistic') o ON o.threshold=k.threshold AND o.date=k.date AND o.node=v.node_id LEFT JOIN sjunction j ON j.node_id=p.src""",
    "status": """SELECT printf('v%06d', user_id) AS village_id, date, CASE WHEN user_id%13=0 THEN 'boat_dependent' WHEN event_type='error' THEN 'isolated' WHEN event_type IN ('click','view','signup') THEN 'connected' ELSE 'uncertain' END AS status
        FROM (SELECT user_id, ts::DATE AS date, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY ALL)""",
    "rain": "SELECT ts, CASE WHEN user_id%2=0 THEN 'sunamganj' ELSE 'meghalaya_upstream' END AS box, user_id%5 AS cell, value AS mm_per_h FROM events",
    "backscatter": f"""SELECT DATE '2022-06-01'+d::INT AS date, row, col, relative_orbit, t, CASE WHEN cents%37<>0 THEN (CASE WHEN {base('d', 'row', 'col')}=1 THEN -22.0::DOUBLE ELSE -10.0::DOUBLE END)+cents/100.0::DOUBLE END AS vv_db,
        -9.0::DOUBLE+cents/200.0::DOUBLE AS dry_db, ((row*3+col)%8)::DOUBLE AS slope_deg, cents AS qa FROM (SELECT l_orderkey%10 AS d, (l_partkey%h)::INT AS row, ((l_suppkey*7+l_linenumber)%64)::INT AS col, (l_linenumber%4)::INT AS relative_orbit,
        l_shipdate AS t, round(l_extendedprice*100)::BIGINT%400 AS cents FROM lineitem, c)""",
    "dem": "SELECT row::INT AS row, col::INT AS col, (abs(row%64-50)+abs(col-22))/8.0::DOUBLE+(p_size%16)/16.0::DOUBLE AS elevation FROM (SELECT i//64 AS row, i%64 AS col, i%n AS k FROM (SELECT unnest(range(h*64)) AS i, n FROM c)) JOIN part ON p_partkey=k WHERE (row*7+col)%29<>0",
    "reports": """SELECT o_orderkey, CASE WHEN c_custkey%3=0 THEN substr(c_name,1,9+(c_custkey%9)::INT)||substr(c_name,11+(c_custkey%9)::INT) ELSE c_name END AS place_name, strftime(DATE '2024-01-01'+(day(o_orderdate)-1)::INT, '%Y-%m-%d') AS date_reported,
        CASE o_orderkey%4 WHEN 0 THEN 'no' WHEN 1 THEN '' ELSE 'yes' END AS reported_isolated, CASE WHEN o_orderkey%7=0 THEN printf('v%06d', c_custkey) ELSE '' END AS village_id
        FROM orders JOIN customer ON o_custkey=c_custkey""",
    "polys": "SELECT node_id AS polygon_id, x, y, (303+(node_id%7)*150)::DOUBLE AS size FROM nodes",
    "burned": """SELECT polygon_id, row, col FROM (SELECT polygon_id, r AS row, q AS col, x, y, size, h*160.0::DOUBLE-(r+0.5::DOUBLE)*160.0::DOUBLE AS cy, (q+0.5::DOUBLE)*160.0::DOUBLE AS cx FROM polys, (SELECT unnest(range(h))::INT AS r, h FROM c), (SELECT unnest(range(64))::INT AS q))
        WHERE abs(cx-x)+abs(cy-y)<size AND NOT (abs(cx-x)<93 AND abs(cy-y)<93)""",
    # timelines keyed by threshold; the events status is threshold 0
    "tin": "SELECT 0.0::DOUBLE AS threshold, * FROM status",
    "vin": "SELECT threshold, village_id, date, status FROM vstatus",
}

# for ``sql``: of the copies of a cell the one of the last order, line, part and supplier counts, which the two evaluations of maps read
BY_ROW = {"hits": CTES["hits"].replace("l_linenumber,value", "l_linenumber,l_partkey,l_suppkey,value")}


def fold(source: str) -> str:
    return f"""SELECT threshold, village_id, CASE WHEN boat THEN 'boat_dependent' WHEN f IS NOT NULL THEN 'isolated' WHEN unc THEN 'uncertain' ELSE 'never_isolated' END AS outcome,
        CASE WHEN NOT boat THEN lc END AS last_connected, CASE WHEN NOT boat THEN f END AS first_isolated, CASE WHEN NOT boat THEN coalesce(lc+1, f) END AS isolated_from_earliest,
        CASE WHEN NOT boat THEN rc END AS reconnected, CASE WHEN NOT boat THEN lc END AS safe_exit_date, n_dates_isolated FROM (
        SELECT a.threshold, a.village_id, any_value(boat) AS boat, any_value(unc) AS unc, any_value(f) AS f, any_value(ni)::INT AS n_dates_isolated,
        max(CASE WHEN s.status='connected' AND s.date<f THEN s.date END) AS lc, min(CASE WHEN s.status='connected' AND s.date>f THEN s.date END) AS rc FROM (
        SELECT threshold, village_id, bool_or(status='boat_dependent') AS boat, bool_or(status='uncertain') AS unc, min(CASE WHEN status='isolated' THEN date END) AS f, sum((status='isolated')::INT) AS ni
        FROM {source} GROUP BY ALL) a JOIN {source} s ON s.threshold=a.threshold AND s.village_id=a.village_id GROUP BY a.threshold, a.village_id)"""


CTES["tfold"] = fold("tin")
CTES["vfold"] = fold("vin")
CTES["tsum"] = """SELECT f.village_id, v.name, v.population, outcome, last_connected, first_isolated, isolated_from_earliest, reconnected, safe_exit_date, n_dates_isolated, isolated_from_earliest+7 AS aid_deadline,
    CASE WHEN outcome='isolated' THEN (row_number() OVER (PARTITION BY outcome ORDER BY isolated_from_earliest+7 NULLS LAST, population DESC NULLS LAST, f.village_id))::BIGINT END AS urgency_rank,
    CASE WHEN outcome<>'isolated' THEN '' WHEN last_connected IS NULL THEN 'isolated on or before '||strftime(first_isolated,'%d %b') ELSE 'isolated between '||strftime(isolated_from_earliest,'%d %b')||' and '||strftime(first_isolated,'%d %b') END AS isolation_range
    FROM tfold f LEFT JOIN villages v USING (village_id)"""


CTES["ain"] = "SELECT 0.0::DOUBLE AS threshold, v.village_id, s.date, s.status FROM villages v JOIN status s ON s.village_id=printf('v%06d', substr(v.village_id,2)::INT%15)"
CTES["afold"] = fold("ain")
CTES["asum"] = CTES["tsum"].replace("FROM tfold f", "FROM afold f")
CTES["esum"] = CTES["tsum"].replace("FROM tfold f", "FROM (SELECT * FROM vfold WHERE threshold=0.2) f")
CTES["xroutes"] = f"""SELECT f.village_id, f.safe_exit_date AS date, s.nearest_shelter_id AS shelter_id, sh.name AS shelter_name, {rint('p.dist/1000.0::DOUBLE')}::BIGINT AS length_m, v.node_id FROM vfold f JOIN vsnap v USING (village_id)
    JOIN solved p ON p.threshold=0.2 AND p.mode='pessimistic' AND p.date=f.safe_exit_date AND p.node=v.node_id JOIN vstatus s ON s.threshold=0.2 AND s.date=f.safe_exit_date AND s.village_id=f.village_id
    JOIN shelters sh ON sh.shelter_id=s.nearest_shelter_id WHERE f.threshold=0.2 AND f.safe_exit_date IS NOT NULL"""
# the way from each junction: of all tight links to the same source, the smallest (junction, edge)
CTES["parc"] = "SELECT date, u AS a, v AS b, w, edge_id FROM graph WHERE threshold=0.2 AND mode='pessimistic' UNION ALL SELECT date, v, u, w, edge_id FROM graph WHERE threshold=0.2 AND mode='pessimistic'"
CTES["psol"] = "SELECT date, node, dist, src FROM solved WHERE threshold=0.2 AND mode='pessimistic'"
CTES["pick"] = """SELECT p.date, p.a AS node, arg_min(p.b, (p.b, p.edge_id)) AS next FROM parc p JOIN psol h ON h.date=p.date AND h.node=p.a JOIN psol t ON t.date=p.date AND t.node=p.b
    WHERE h.dist=t.dist+p.w AND h.src=t.src GROUP BY ALL"""
CTES["walk(village_id, date, k, node)"] = "SELECT village_id, date, 0, node_id FROM xroutes UNION ALL SELECT w.village_id, w.date, w.k+1, p.next FROM walk w JOIN pick p ON p.date=w.date AND p.node=w.node"
CTES["waytext"] = "SELECT village_id, string_agg(x::BIGINT||' '||y::BIGINT, ',' ORDER BY k) AS way, count(*) AS n FROM walk JOIN nodes ON node_id=node GROUP BY village_id"


def _name(key: str) -> str:
    return re.split(r"[ (]", key)[0]


def sql(body: str, **extra: str) -> str:
    """Complete query: ``body`` preceded by every expression it reaches, in dependency order."""
    full = {**CTES, **{k: v for k, v in extra.items()}}
    names = {_name(k): k for k in full}
    order: list[str] = []

    def need(text: str, own: str = ""):
        for word in dict.fromkeys(re.findall(r"[a-z_]\w*", text)):
            if word in names and word != own and word not in order and re.search(rf"(?:\bFROM\b|\bJOIN\b|,)\s+{word}\b", text):
                need(full[names[word]], word)
                if word not in order:
                    order.append(word)

    need(body)
    if not order:
        return body
    return "WITH RECURSIVE " + ",\n".join(f"{names[o]} AS ({full[names[o]]})" for o in order) + "\n" + body
