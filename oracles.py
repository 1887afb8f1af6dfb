"""SQL equivalents of the queries, for an independent engine to check.

They take the direct way: windows over whole users and trajectories, all point-edge pairs, all simple paths,
one decoding pass over whole trajectories.  Each query is one statement built from named parts.
"""

from __future__ import annotations

import math
import re

PI4 = repr(math.pi / 4)
PI2 = repr(math.pi / 2)
R = "6378137.0::double"


def hav_m(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(sin(radians({a}-({c}))/2)*sin(radians({a}-({c}))/2) + cos(radians({a}))*cos(radians({c}))"
        f"*sin(radians({b}-({d}))/2)*sin(radians({b}-({d}))/2))"
    )
    return f"(6371*(2*atan2(sqrt({h}), sqrt(1-{h})))*1000)"


def hav_km(a: str, b: str, c: str, d: str) -> str:
    h = (
        f"(sin(radians({c}-{a})/2)*sin(radians({c}-{a})/2) + sin(radians({d}-{b})/2)*sin(radians({d}-{b})/2)"
        f"*cos(radians({a}))*cos(radians({c})))"
    )
    return f"(6372.8::double*(2*asin(sqrt({h}))))"


def snap(x: str, digits: int) -> str:
    return f"(floor(({x})*1e{digits}+0.5::double)/1e{digits})"


def cut6(x: str) -> str:
    return f"(floor(({x})*1e6)/1e6)"


def east(deg: str) -> str:
    return f"({R}*radians({deg}))"


def north(deg: str) -> str:
    return f"({R}*ln(tan({PI4}::double+radians({deg})/2)))"


def edge_share(px: str, py: str, e: str) -> str:
    sq = f"(({e}x2-{e}x1)*({e}x2-{e}x1)+({e}y2-{e}y1)*({e}y2-{e}y1))"
    return (
        f"greatest(0.0::double, least(1.0::double, case when {sq}>0 then (({px}-{e}x1)*({e}x2-{e}x1)"
        f"+({py}-{e}y1)*({e}y2-{e}y1))/{sq} else 0.0::double end))"
    )


def edge_distance(px: str, py: str, e: str) -> str:
    u = edge_share(px, py, e)
    dx, dy = f"({px}-({e}x1+{u}*({e}x2-{e}x1)))", f"({py}-({e}y1+{u}*({e}y2-{e}y1)))"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


PARTS: dict[str, tuple[list[str], str]] = {}


def part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (needs.split(), body)


def statement(needs: str, body: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in PARTS[name][0]:
            visit(other)
        order.append(name)

    for name in needs.split():
        visit(name)
    recursive = recursive or any("recursion" in n for n in order)
    ctes = ",\n".join(
        f"{n}(customid, trajid, n, rank, score, way) AS ({PARTS[n][1]})" if "recursion" in n
        else f"{n} AS MATERIALIZED ({PARTS[n][1]})"
        for n in order
    )
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


part("node", "", """
SELECT 'N'||p_partkey AS id, 45.44::double + 0.0005::double*(p_partkey//40) AS latitude,
  9.14::double + 0.0007::double*(p_partkey%40) AS longitude FROM part""")

part("way", "", """
SELECT 'WH'||k AS id, k, 1 AS step FROM (SELECT p_partkey k FROM part) WHERE (k%40)%2=0 AND k%40<=37
UNION ALL
SELECT 'WV'||k, k, 40 FROM (SELECT p_partkey k FROM part)
WHERE (k%40)%2=0 AND (k//40)%2=0 AND k+80 <= (SELECT max(p_partkey) FROM part)""")

part("tagged", "way", """
SELECT *, CASE WHEN k%45=1 THEN 'service' ELSE usual END AS highway FROM (SELECT *, ['motorway','trunk','primary','secondary','tertiary','unclassified','residential','residential','service']
  [k%9+1] AS usual FROM way)""")

part("way_node", "tagged", """
SELECT id AS road_id, highway, pos, 'N'||(k+pos*step) AS node_id FROM tagged, (SELECT unnest([0,1,2]) AS pos)
WHERE highway <> 'service'""")

part("placed", "way_node node", """
SELECT road_id, highway, pos, node_id, latitude AS lat, longitude AS lon FROM way_node JOIN node ON node_id = id""")

part("road", "placed", f"""
SELECT *, {hav_m('lat0', 'lon0', 'lat1', 'lon1')} AS length FROM (
  SELECT road_id, any_value(highway) AS highway, count(*) AS n_points, arg_min(lat,pos) AS lat0, arg_min(lon,pos) AS lon0,
    arg_max(lat,pos) AS lat1, arg_max(lon,pos) AS lon1,
    string_agg(floor(lon*1e7+0.5)::bigint || ' ' || floor(lat*1e7+0.5)::bigint, ',' ORDER BY pos) AS shape
  FROM placed GROUP BY road_id HAVING count(*) >= 2)""")

part("adj", "road way_node", """
SELECT DISTINCT a.road_id, ra.length, b.road_id AS neighbour_id, rb.length AS neighbour_length
FROM way_node a JOIN way_node b ON a.node_id=b.node_id AND a.road_id<>b.road_id
JOIN road ra ON ra.road_id=a.road_id JOIN road rb ON rb.road_id=b.road_id""")

part("edge", "placed road adj", f"""
SELECT road_id, {east('lon')} x1, {north('lat')} y1, {east('lon2')} x2, {north('lat2')} y2 FROM (
  SELECT road_id, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM placed
  WINDOW w AS (PARTITION BY road_id ORDER BY pos))
WHERE lat2 IS NOT NULL AND road_id IN (SELECT road_id FROM adj)""")

part("ping", "", """
SELECT 'u'||user_id AS customid, (1504300000 + CASE WHEN user_id%6=0
    THEN 10*(k - CASE WHEN event_id%50=0 AND k>0 THEN 1 ELSE 0 END)
    ELSE 5*(k - CASE WHEN event_id%50=0 AND k>0 THEN 1 ELSE 0 END) + 3600*(k//40) END)::int AS timestamp,
  45.44::double + 0.0005::double*(user_id % (SELECT max(p_partkey)//40+1 FROM part)) + 0.00002::double*(event_id%7-3)
    + (CASE WHEN event_id%37=0 THEN 1 ELSE 0 END)*0.003::double AS latitude,
  9.1402::double + (CASE WHEN user_id%6=0 THEN 0.001::double*least(k%48, 48-k%48) ELSE 0.0006::double*(k%40) END) + 0.00002::double*(event_id%5-2) AS longitude,
  (event_id%110)::int AS accuracy
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS k FROM events)""")

part("valid", "ping", """
SELECT * FROM ping WHERE timestamp BETWEEN 1504224000 AND 1514764800 AND latitude BETWEEN 45.38673 AND 45.53586
  AND longitude BETWEEN 9.04088 AND 9.27812 AND accuracy < 100
  AND customid IS NOT NULL AND timestamp IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL
  AND accuracy IS NOT NULL""")

part("clean", "valid", """
SELECT customid, timestamp AS timest, latitude, longitude, accuracy FROM (
  SELECT *, count(*) OVER (PARTITION BY customid) AS total,
    row_number() OVER (PARTITION BY customid, timestamp ORDER BY accuracy, latitude, longitude) AS rn FROM valid)
WHERE total > 50 AND rn = 1""")

part("motion", "clean", f"""
SELECT *, spacediff/timediff*3.6::double AS speed FROM (
  SELECT *, timest - lag(timest) OVER w AS timediff,
    {hav_m('latitude', 'longitude', 'lag(latitude) OVER w', 'lag(longitude) OVER w')} AS spacediff
  FROM clean WINDOW w AS (PARTITION BY customid ORDER BY timest))""")

part("tracked", "motion", """
SELECT *, sum(CASE WHEN timediff >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY customid ORDER BY timest)::int AS trajid
FROM motion""")

part("framed", "tracked", """
SELECT *, row_number() OVER t - 1 AS pos, count(*) OVER (PARTITION BY customid, trajid) AS n,
  lag(speed,1) OVER t AS v1, lag(speed,2) OVER t AS v2, lead(speed,1) OVER t AS w1, lead(speed,2) OVER t AS w2
FROM tracked WINDOW t AS (PARTITION BY customid, trajid ORDER BY timest)""")

part("seg", "framed", f"""
SELECT customid, timest, {cut6('latitude')} AS latitude, {cut6('longitude')} AS longitude, accuracy, timediff,
  {cut6('spacediff')} AS spacediff, {cut6('speed')} AS speed, {cut6('speed - v1')} AS speeddiff, trajid
FROM framed WHERE pos >= 3 AND n-1-pos >= 2
  AND NOT (abs(speed-(v1+v2)/2) > speed/3+2 AND abs(speed-(w1+w2)/2) > speed/3+2)""")

part("good", "seg", """
SELECT * FROM (SELECT *, avg(spacediff) OVER t AS sa, avg(speed) OVER t AS va, count(*) OVER t AS np
  FROM seg WHERE speed > 0 WINDOW t AS (PARTITION BY customid, trajid)) WHERE sa > 0.01 AND va > 25 AND np > 25""")

part("hit", "good edge", f"""
SELECT customid, trajid, timest, latitude, longitude, road_id, {snap('greatest(min(d), 5.0::double)', 6)} AS distance FROM (
  SELECT p.*, e.road_id, {edge_distance('px', 'py', 'e.')} AS d
  FROM (SELECT *, {east('longitude')} AS px, {north('latitude')} AS py FROM good) p JOIN edge e
  ON greatest(e.x1,e.x2) >= px-100 AND least(e.x1,e.x2) <= px+100 AND greatest(e.y1,e.y2) >= py-100
    AND least(e.y1,e.y2) <= py+100)
WHERE d <= 100 GROUP BY ALL""")

part("cand", "hit", """
SELECT *, 1/distance/total AS prob FROM (
  SELECT *, row_number() OVER (PARTITION BY customid, trajid, timest ORDER BY distance, road_id) AS rank,
    sum(1/distance) OVER (PARTITION BY customid, trajid, timest) AS total FROM hit) WHERE rank <= 4""")

# Foot of the perpendicular on the chord of the road, axes exchanged.
part("chorded", "cand road", f"""
SELECT *, (CASE WHEN ax=bx AND ay=by2 THEN ax-0.00001::double ELSE ax END) AS sx FROM (
  SELECT c.*, r.lat0, r.lon0, r.lat1, r.lon1, {east('c.latitude')} AS px, {north('c.longitude')} AS py,
    {east('lat0')} AS ax, {north('lon0')} AS ay, {east('lat1')} AS bx, {north('lon1')} AS by2
  FROM cand c JOIN road r USING (road_id))""")

part("dropped", "chorded", """
SELECT *, sx + u*(bx-sx) AS fx, ay + u*(by2-ay) AS fy FROM (
  SELECT *, ((px-sx)*(bx-sx)+(py-ay)*(by2-ay))/((bx-sx)*(bx-sx)+(by2-ay)*(by2-ay)) AS u FROM chorded)""")

part("footed", "dropped", f"""
SELECT *, {hav_m('foot_lat', 'foot_lon', 'lat0', 'lon0')} AS to0, {hav_m('foot_lat', 'foot_lon', 'lat1', 'lon1')} AS to1,
  {hav_m('latitude', 'longitude', 'lat0', 'lon0')} < {hav_m('latitude', 'longitude', 'lat1', 'lon1')} AS near0 FROM (
  SELECT *, CASE WHEN inside THEN degrees(fx/{R}) END AS foot_lat,
    CASE WHEN inside THEN degrees(2*atan(exp(fy/{R}))-{PI2}::double) END AS foot_lon FROM (
    SELECT *, fx BETWEEN least(sx,bx) AND greatest(sx,bx) AND fy BETWEEN least(ay,by2) AND greatest(ay,by2) AS inside
    FROM dropped))""")


def hop_parts(prefix: str, starts: str, needs: str, theta: int, gamma: int) -> None:
    """All simple paths, hop by hop, then the cheapest per (start, end)."""
    part(f"{prefix}0", f"road adj {needs}", f"""
SELECT road_id AS s, road_id AS e, floor(length*1e6+0.5)::bigint AS micro, [road_id] AS ids, [length] AS lens
FROM road WHERE road_id IN (SELECT road_id FROM adj) AND road_id IN ({starts})""")
    for hop in range(1, theta + 1):
        guard = f"AND micro < {gamma}000000" if hop < theta else ""
        part(f"{prefix}{hop}", f"{prefix}{hop - 1} adj", f"""
SELECT s, a.neighbour_id AS e, micro + floor(a.neighbour_length*1e6+0.5)::bigint AS micro,
  list_append(ids, a.neighbour_id) AS ids, list_append(lens, a.neighbour_length) AS lens
FROM {prefix}{hop - 1} p JOIN adj a ON a.road_id = p.e WHERE NOT list_contains(ids, a.neighbour_id) {guard}""")
    union = " UNION ALL ".join(f"SELECT * FROM {prefix}{h}" for h in range(theta + 1))
    part(f"{prefix}s", " ".join(f"{prefix}{h}" for h in range(theta + 1)), f"""
SELECT s AS start_id, e AS end_id, w.micro AS micro, w.ids AS ids, w.lens AS lens, len(w.ids) AS roads FROM (
  SELECT s, e, min({{'micro': micro, 'n': len(ids), 'ids': ids, 'lens': lens}}) AS w FROM ({union}) GROUP BY s, e)""")


hop_parts("path", "SELECT road_id FROM cand", "cand", 4, 200)
hop_parts("deep", "SELECT road_id FROM road", "road", 4, 400)
hop_parts("six", "SELECT road_id FROM cand", "cand", 6, 600)

# The same search as outer joins of the pair table: four rows wide, with the neighbour of the last row.
part("wide", "adj", """
SELECT a.road_id AS r0, a.length AS l0, b.road_id AS r1, b.length AS l1, c.road_id AS r2, c.length AS l2,
  d.road_id AS r3, d.length AS l3, d.neighbour_id AS r4, d.neighbour_length AS l4
FROM adj a
LEFT JOIN adj b ON a.neighbour_id=b.road_id AND b.road_id<>a.road_id AND a.length < 400
LEFT JOIN adj c ON b.neighbour_id=c.road_id AND c.road_id NOT IN (a.road_id, b.road_id) AND a.length+b.length < 400
LEFT JOIN adj d ON c.neighbour_id=d.road_id AND d.road_id NOT IN (a.road_id, b.road_id, c.road_id)
  AND d.neighbour_id NOT IN (a.road_id, b.road_id, c.road_id) AND a.length+b.length+c.length < 400""")

part("prefix", "wide", """
SELECT s, e, min({'micro': micro, 'n': len(ids), 'ids': ids}) AS w FROM (
  SELECT ids[1] AS s, ids[len(ids)] AS e, ids, list_sum(list_transform(lens, lambda x: floor(x*1e6+0.5)::bigint))::bigint AS micro FROM (
    SELECT [r0] AS ids, [l0] AS lens FROM wide
    UNION ALL SELECT [r0,r1], [l0,l1] FROM wide WHERE r1 IS NOT NULL
    UNION ALL SELECT [r0,r1,r2], [l0,l1,l2] FROM wide WHERE r2 IS NOT NULL
    UNION ALL SELECT [r0,r1,r2,r3], [l0,l1,l2,l3] FROM wide WHERE r3 IS NOT NULL
    UNION ALL SELECT [r0,r1,r2,r3,r4], [l0,l1,l2,l3,l4] FROM wide WHERE r4 IS NOT NULL)) GROUP BY s, e""")

part("fact", "paths road", """
SELECT p.start_id, p.end_id, p.ids, p.roads, list_sum(p.lens) AS whole,
  CASE WHEN p.roads > 2 THEN list_sum(p.lens[2:p.roads-1]) ELSE 0.0::double END AS inside, p.lens[1] AS first_length,
  p.lens[p.roads] AS last_length,
  CASE WHEN p.roads > 1 THEN (s.lat0=n.lat0 AND s.lon0=n.lon0) OR (s.lat0=n.lat1 AND s.lon0=n.lon1) END AS first_at0,
  CASE WHEN p.roads > 1 THEN (t.lat0=v.lat0 AND t.lon0=v.lon0) OR (t.lat0=v.lat1 AND t.lon0=v.lon1) END AS last_at0
FROM paths p JOIN road s ON s.road_id=p.start_id JOIN road t ON t.road_id=p.end_id
LEFT JOIN road n ON n.road_id = CASE WHEN p.roads>1 THEN p.ids[2] END
LEFT JOIN road v ON v.road_id = CASE WHEN p.roads>1 THEN p.ids[p.roads-1] END""")

part("point", "cand", """
SELECT *, row_number() OVER t AS n, lag(timest) OVER t AS prev_timest, lag(latitude) OVER t AS prev_lat,
  lag(longitude) OVER t AS prev_lon, count(*) OVER (PARTITION BY customid, trajid) AS total FROM (
  SELECT DISTINCT customid, trajid, timest, latitude, longitude FROM cand)
WINDOW t AS (PARTITION BY customid, trajid ORDER BY timest, latitude, longitude)""")

part("numbered", "footed point", """
SELECT f.*, p.n, p.total AS n_points, p.prev_timest, p.prev_lat, p.prev_lon
FROM footed f JOIN point p USING (customid, trajid, timest, latitude, longitude)""")

part("move", "numbered fact", f"""
SELECT customid, trajid, n, n_points, timest, prev_timest, i, road_id, prob, k, prev_id, route,
  CASE WHEN route IS NOT NULL THEN -abs(gap-route)/10 - {math.log(10)!r}::double END AS log_move FROM (
  SELECT i.customid, i.trajid, i.n, i.n_points, i.timest, i.prev_timest, i.rank AS i, i.road_id, i.prob, k.rank AS k,
    k.road_id AS prev_id, {hav_m('i.latitude', 'i.longitude', 'i.prev_lat', 'i.prev_lon')} AS gap,
    CASE WHEN f.roads IS NULL THEN NULL
      WHEN k.foot_lat IS NULL AND i.foot_lat IS NULL THEN f.whole
      WHEN f.roads = 1 THEN
        CASE WHEN k.foot_lat IS NOT NULL AND i.foot_lat IS NOT NULL
            THEN {hav_m('k.foot_lat', 'k.foot_lon', 'i.foot_lat', 'i.foot_lon')}
          WHEN k.foot_lat IS NOT NULL THEN CASE WHEN i.near0 THEN k.to0 ELSE k.to1 END
          ELSE CASE WHEN k.near0 THEN i.to0 ELSE i.to1 END END
      ELSE (CASE WHEN k.foot_lat IS NULL THEN f.first_length WHEN f.first_at0 THEN k.to0 ELSE k.to1 END) + f.inside
        + (CASE WHEN i.foot_lat IS NULL THEN f.last_length WHEN f.last_at0 THEN i.to0 ELSE i.to1 END) END AS route
  FROM numbered i LEFT JOIN numbered k ON k.customid=i.customid AND k.trajid=i.trajid AND k.n=i.n-1
  LEFT JOIN fact f ON f.start_id=k.road_id AND f.end_id=i.road_id)""")

part("score", "move", """
SELECT *, floor(ln(prob)*1e9+0.5::double)::bigint AS emit, floor(log_move*1e9+0.5::double)::bigint AS step FROM move""")

part("recursion", "score", """
SELECT customid, trajid, n, i, emit, [i] FROM score WHERE n = 1
UNION ALL
SELECT customid, trajid, n, i, w.s + emit, list_append(w.w, i) FROM (
  SELECT s.customid, s.trajid, s.n, s.i, any_value(s.emit) AS emit,
    max({'s': r.score + s.step, 'mk': -s.k, 'w': r.way}) AS w
  FROM recursion r JOIN score s ON s.customid=r.customid AND s.trajid=r.trajid AND s.n=r.n+1 AND s.k=r.rank
  WHERE s.step IS NOT NULL GROUP BY s.customid, s.trajid, s.n, s.i)""")

part("best", "recursion", """
SELECT customid, trajid, w.way AS way FROM (
  SELECT customid, trajid, max({'n': n, 's': score, 'mr': -rank, 'way': way}) AS w FROM recursion
  GROUP BY customid, trajid)""")

part("dec", "best numbered", """
SELECT b.customid, b.trajid, i.timest, i.latitude, i.longitude, i.road_id, i.prev_timest, k.road_id AS prev_id, i.n = i.n_points AS is_last
FROM (SELECT customid, trajid, way, unnest(range(1, len(way)+1)) AS n FROM best) b
JOIN numbered i ON i.customid=b.customid AND i.trajid=b.trajid AND i.n=b.n AND i.rank=b.way[b.n]
LEFT JOIN numbered k ON k.customid=b.customid AND k.trajid=b.trajid AND k.n=b.n-1 AND k.rank=b.way[b.n-1]""")

# The same with a new chain after every break.  A way marks the first candidate of a later chain by a minus sign.
part("restart_recursion", "score", """
SELECT customid, trajid, n, i, emit, [i] FROM score WHERE n = 1
UNION ALL
SELECT customid, trajid, n, i, CASE WHEN alive THEN w.s + emit ELSE emit END,
  CASE WHEN alive THEN list_append(w.w, i) ELSE list_append(ended.w, -i) END FROM (
  SELECT s.customid, s.trajid, s.n, s.i, any_value(s.emit) AS emit,
    max({'s': r.score + s.step, 'mk': -s.k, 'w': r.way}) FILTER (WHERE s.step IS NOT NULL) AS w,
    max({'s': r.score, 'mr': -r.rank, 'w': r.way}) AS ended,
    bool_or(bool_or(s.step IS NOT NULL)) OVER (PARTITION BY s.customid, s.trajid, s.n) AS alive
  FROM restart_recursion r JOIN score s ON s.customid=r.customid AND s.trajid=r.trajid AND s.n=r.n+1 AND s.k=r.rank
  GROUP BY s.customid, s.trajid, s.n, s.i)
WHERE NOT alive OR w IS NOT NULL""")

part("restart_dec", "restart_recursion numbered", """
SELECT b.customid, b.trajid, i.timest, i.latitude, i.longitude, i.road_id, i.prev_timest,
  CASE WHEN b.way[b.n] > 0 THEN k.road_id END AS prev_id, i.n = i.n_points OR coalesce(b.way[b.n+1] < 0, false) AS is_last
FROM (SELECT customid, trajid, w.way AS way, unnest(range(1, len(w.way)+1)) AS n FROM (
  SELECT customid, trajid, max({'n': n, 's': score, 'mr': -rank, 'way': way}) AS w FROM restart_recursion
  GROUP BY customid, trajid)) b
JOIN numbered i ON i.customid=b.customid AND i.trajid=b.trajid AND i.n=b.n AND i.rank=abs(b.way[b.n])
LEFT JOIN numbered k ON k.customid=b.customid AND k.trajid=b.trajid AND k.n=b.n-1 AND k.rank=abs(b.way[b.n-1])""")

# The same with a search radius of 500 and the normal density, under names that begin with far_.
FAR = ("hit", "cand", "chorded", "dropped", "footed", "point", "numbered", "move", "score", "recursion", "best", "dec", "fact",
       "paths", "path0", "path1", "path2", "path3", "path4")


def far(text: str) -> str:
    text = re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(FAR)})\b", r"\1\2far_\3", text)
    return text.replace("px-100", "px-500").replace("px+100", "px+500").replace("py-100", "py-500").replace(
        "py+100", "py+500").replace("d <= 100", "d <= 500")


for _name in FAR:
    _needs, _body = PARTS[_name]
    part(f"far_{_name}", " ".join(f"far_{n}" if n in FAR else n for n in _needs), far(_body))
_density = "-0.5::double*(distance/10)*(distance/10)"
part("far_cand", "far_hit", f"""
SELECT *, {1 / (math.sqrt(2 * math.pi) * 10)!r}::double*exp({_density}) AS prob,
  {_density} - {math.log(math.sqrt(2 * math.pi) * 10)!r}::double AS log_prob FROM (
  SELECT *, row_number() OVER (PARTITION BY customid, trajid, timest ORDER BY distance, road_id) AS rank FROM far_hit)
WHERE rank <= 4""")
part("far_score", "far_move", f"""
SELECT m.*, floor((-0.5::double*(c.distance/10)*(c.distance/10) - {math.log(math.sqrt(2 * math.pi) * 10)!r}::double)*1e9+0.5::double)::bigint
  AS emit, floor(log_move*1e9+0.5::double)::bigint AS step
FROM far_move m JOIN far_cand c USING (customid, trajid, timest, road_id)""")

ROUTES = """
SELECT customid, trajid, timest, "roadID", seq FROM (
  SELECT d.customid, d.trajid, d.prev_timest AS timest, unnest(p.ids[1:p.roads-1]) AS "roadID",
    unnest(range(0, p.roads-1)) AS seq
  FROM dec d JOIN paths p ON p.start_id=d.prev_id AND p.end_id=d.road_id WHERE d.prev_id <> d.road_id
  UNION ALL SELECT customid, trajid, timest, road_id, 0 FROM dec WHERE is_last)"""

# Roads measured along their pieces, on bent roads, under names that begin with bent_.
BENT = ("node", "placed", "mark", "road", "adj", "edge", "hit", "cand", "point", "numbered", "joint", "met", "fact", "move", "score",
        "recursion", "best", "dec", "paths", "path0", "path1", "path2", "path3", "path4")


def bent(text: str) -> str:
    return re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(BENT)})\b", r"\1\2bent_\3", text)


def bent_part(name: str, needs: str, body: str) -> None:
    part(f"bent_{name}", " ".join(f"bent_{n}" if n in BENT else n for n in needs.split()), bent(body))


for _name in BENT:
    if _name in PARTS:
        bent_part(_name, " ".join(PARTS[_name][0]), PARTS[_name][1])
part("bent_node", "node", """
SELECT id, latitude + 0.00011::double*(id[2:]::bigint % 3) AS latitude, longitude FROM node""")
bent_part("mark", "placed", f"""
SELECT *, coalesce(sum(step) OVER (PARTITION BY road_id ORDER BY pos), 0.0::double) AS place FROM (
  SELECT *, {hav_m('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS step FROM placed
  WINDOW w AS (PARTITION BY road_id ORDER BY pos))""")
bent_part("road", "mark", """
SELECT road_id, max(place) AS length FROM mark GROUP BY road_id HAVING count(*) >= 2""")
bent_part("edge", "mark road adj", f"""
SELECT road_id, {east('lon')} x1, {north('lat')} y1, {east('lon2')} x2, {north('lat2')} y2, place, place2 FROM (
  SELECT road_id, lat, lon, place, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(place) OVER w AS place2 FROM mark
  WINDOW w AS (PARTITION BY road_id ORDER BY pos))
WHERE lat2 IS NOT NULL AND road_id IN (SELECT road_id FROM adj)""")
bent_part("hit", "good edge", f"""
SELECT customid, trajid, timest, latitude, longitude, road_id, {snap('greatest(min(d), 5.0::double)', 6)} AS distance,
  min({{'d': {snap('d', 6)}, 'place': place + u*(place2-place)}}).place AS place FROM (
  SELECT p.customid, p.trajid, p.timest, p.latitude, p.longitude, e.road_id, e.place, e.place2,
    {edge_distance('px', 'py', 'e.')} AS d, {edge_share('px', 'py', 'e.')} AS u
  FROM (SELECT *, {east('longitude')} AS px, {north('latitude')} AS py FROM good) p JOIN edge e
  ON greatest(e.x1,e.x2) >= px-100 AND least(e.x1,e.x2) <= px+100 AND greatest(e.y1,e.y2) >= py-100
    AND least(e.y1,e.y2) <= py+100)
WHERE d <= 100 GROUP BY customid, trajid, timest, latitude, longitude, road_id""")
bent_part("numbered", "cand point", """
SELECT f.*, p.n, p.total AS n_points, p.prev_timest, p.prev_lat, p.prev_lon
FROM cand f JOIN point p USING (customid, trajid, timest, latitude, longitude)""")
bent_part("joint", "mark", """
SELECT a.road_id, b.road_id AS then_id, min({'node': a.node_id, 'out_at': a.place, 'in_at': b.place}) AS w
FROM mark a JOIN mark b ON a.node_id = b.node_id AND a.road_id <> b.road_id GROUP BY a.road_id, b.road_id""")
bent_part("met", "paths joint", """
SELECT start_id, end_id, h, j.w.out_at AS out_at, j.w.in_at AS in_at FROM (
  SELECT start_id, end_id, h, ids[h] AS road_id, ids[h+1] AS then_id FROM (
    SELECT *, unnest(range(1, roads)) AS h FROM paths WHERE roads > 1))
JOIN joint j USING (road_id, then_id)""")
bent_part("fact", "paths met", """
SELECT p.start_id, p.end_id, p.roads, f.exit_at, f.enter_at, f.inside FROM paths p LEFT JOIN (
  SELECT start_id, end_id, arg_min(out_at, h) AS exit_at, arg_max(in_at, h) AS enter_at,
    coalesce(sum(abs(out_at - came)), 0.0::double) AS inside FROM (
    SELECT *, lag(in_at) OVER (PARTITION BY start_id, end_id ORDER BY h) AS came FROM met) GROUP BY start_id, end_id) f
USING (start_id, end_id)""")
bent_part("move", "numbered fact", f"""
SELECT customid, trajid, n, n_points, timest, prev_timest, i, road_id, prob, k, prev_id, route,
  CASE WHEN route IS NOT NULL THEN -abs(gap-route)/10 - {math.log(10)!r}::double END AS log_move FROM (
  SELECT i.customid, i.trajid, i.n, i.n_points, i.timest, i.prev_timest, i.rank AS i, i.road_id, i.prob, k.rank AS k,
    k.road_id AS prev_id, {hav_m('i.latitude', 'i.longitude', 'i.prev_lat', 'i.prev_lon')} AS gap,
    CASE WHEN f.roads IS NULL THEN NULL WHEN f.roads = 1 THEN abs(i.place - k.place)
      ELSE abs(f.exit_at - k.place) + f.inside + abs(i.place - f.enter_at) END AS route
  FROM numbered i LEFT JOIN numbered k ON k.customid=i.customid AND k.trajid=i.trajid AND k.n=i.n-1
  LEFT JOIN fact f ON f.start_id=k.road_id AND f.end_id=i.road_id)""")

SEG_COLUMNS = "customid, timest, latitude, longitude, accuracy, timediff, spacediff, speed, speeddiff, trajid"


def all_statements() -> dict[str, str]:
    utc = "timest + CASE WHEN timest < 1509238800 THEN 7200 ELSE 3600 END"
    found = {
        "pings_clean": statement("clean", "SELECT * FROM clean"),
        "segments": statement("seg", f"SELECT {SEG_COLUMNS}, 'in' AS status FROM seg"),
        "segment_tag": statement("seg", """
SELECT customid, timest, ('0x'||md5(customid||'|'||timest)[1:5])::int / 1048576.0::double AS rnd FROM seg"""),
        "segment_calendar": statement("seg", f"""
SELECT customid, timest, (({utc})//86400 + 4) % 7 + 1 AS weekday, ({utc}) % 86400 // 3600 AS dayhour,
  '{{"type":"Point","coordinates":[' || longitude || ',' || latitude || ']}}' AS geojson FROM seg"""),
        "quality_trajectories": statement(
            "good", "SELECT customid, trajid, timest, latitude, longitude, timediff, spacediff, speed FROM good"
        ),
        "top_trajectories": statement("good", """
SELECT customid, trajid, timest, latitude, longitude, timediff, spacediff, speed FROM good
WHERE (customid, trajid) IN (SELECT (customid, trajid) FROM (
  SELECT customid, trajid, count(*) AS c FROM good WHERE latitude BETWEEN 45.4370 AND 45.5020
    AND longitude BETWEEN 9.1344 AND 9.2344 GROUP BY ALL ORDER BY c DESC, customid, trajid LIMIT 50))"""),
        "roads": statement("road", f"""
SELECT road_id, highway, n_points, lat0, lon0, lat1, lon1, shape, {snap('length', 3)} AS length FROM road"""),
        "adjacency": statement("adj", f"""
SELECT road_id, neighbour_id, {snap('length', 3)} AS length, {snap('neighbour_length', 3)} AS neighbour_length FROM adj"""),
        "neighbour_lists": statement("adj", f"""
SELECT road_id, {snap('any_value(length)', 3)} AS length, count(*) AS n,
  string_agg(neighbour_id, ',' ORDER BY neighbour_id) AS neighbours FROM adj GROUP BY road_id"""),
        "road_features": statement("road adj", f"""
SELECT road_id, CASE WHEN k%4=0 THEN 'Via '||k ELSE 'noName' END AS name, highway,
  CASE WHEN k%3=0 THEN 'no' ELSE 'yes' END AS oneway, n_points, {snap('length', 3)} AS length, lon0 AS first_lon,
  lat0 AS first_lat FROM (SELECT *, road_id[3:]::bigint AS k FROM road) WHERE road_id IN (SELECT road_id FROM adj)"""),
        "projected_points": statement("good", f"""
SELECT customid, trajid, timest, {snap(east('longitude'), 3)} AS x, {snap(north('latitude'), 3)} AS y,
  {snap(east('latitude'), 3)} AS swapped_x, {snap(north('longitude'), 3)} AS swapped_y, {snap('latitude', 6)} AS back_lat,
  {snap('longitude', 6)} AS back_lon FROM good"""),
        "projection_feet": statement("footed", f"""
SELECT customid, trajid, timest, road_id, {snap('foot_lat', 7)} AS foot_lat, {snap('foot_lon', 7)} AS foot_lon,
  {snap('to0', 3)} AS to0, {snap('to1', 3)} AS to1, near0 FROM footed"""),
        "distances": statement("chorded", f"""
SELECT customid, trajid, timest, road_id, {snap(hav_m('latitude', 'longitude', 'lat0', 'lon0'), 3)} AS metres,
  {snap(hav_km('latitude', 'longitude', 'lat0', 'lon0'), 6)} AS kilometres,
  {snap('110.25::double*sqrt((latitude-lat0)*(latitude-lat0)+((longitude-lon0)*cos(lat0))*((longitude-lon0)*cos(lat0)))', 6)} AS flat,
  {snap(hav_m('lat0', 'lon0', 'lat1', 'lon1'), 3)} AS chord FROM chorded"""),
        "candidates": statement("cand", f"""
SELECT road_id AS roadID, customid, trajid, timest, latitude, longitude, rank, {snap('distance', 3)} AS distance, {snap('prob', 9)} AS prob,
  {snap(f'{1 / (math.sqrt(2 * math.pi) * 10)!r}::double*exp(-0.5::double*(distance/10)*(distance/10))', 9)} AS gaussian FROM cand"""),
        "candidate_roads": statement("cand adj", f"""
SELECT road_id, neighbour_id, {snap('neighbour_length', 3)} AS neighbour_length FROM adj
WHERE road_id IN (SELECT road_id FROM cand)"""),
        "neighbor_paths": statement("paths", """
SELECT start_id, end_id, array_to_string(ids, '>') AS path, micro/1e6 AS cost, roads FROM paths"""),
        "neighbor_paths_deep": statement("deeps", """
SELECT start_id, end_id, array_to_string(ids, '>') AS path, micro/1e6 AS cost, roads FROM deeps"""),
        "neighbor_paths_six_hops": statement("sixs", """
SELECT start_id, end_id, array_to_string(ids, '>') AS path, micro/1e6 AS cost, roads FROM sixs"""),
        "neighbor_paths_no_dead_ends": statement("prefix", """
SELECT s AS start_id, e AS end_id, array_to_string(w.ids, '>') AS path, w.micro/1e6 AS cost, len(w.ids) AS roads FROM prefix"""),
        "transition_pairs": statement("numbered paths", f"""
SELECT k.customid, k.trajid, k.timest, k.latitude, k.longitude, k.road_id AS roadID, {snap('k.prob', 9)} AS prob,
  i.road_id AS "succID", array_to_string(p.ids, '>') AS path
FROM numbered k LEFT JOIN numbered i ON k.customid=i.customid AND k.trajid=i.trajid AND k.n=i.n-1
LEFT JOIN paths p ON p.start_id=k.road_id AND p.end_id=i.road_id"""),
        "transitions": statement("move", f"""
SELECT customid, trajid, prev_timest, timest, prev_id, road_id, {snap('route', 3)} AS route,
  {snap('coalesce(exp(log_move), 0)', 6)} AS prob FROM move WHERE k IS NOT NULL"""),
        "transitions_polyline": statement("bent_move", f"""
SELECT customid, trajid, prev_timest, timest, prev_id, road_id, {snap('route', 3)} AS route,
  {snap('coalesce(exp(log_move), 0)', 6)} AS prob FROM bent_move WHERE k IS NOT NULL"""),
        "decoded": statement("dec", "SELECT * FROM dec"),
        "decoded_polyline": statement("bent_dec", "SELECT * FROM bent_dec"),
        "decoded_gaussian": statement("far_dec", "SELECT * FROM far_dec"),
        "decoded_long": statement("dec", "SELECT * FROM dec"),
        "decoded_restart": statement("restart_dec", "SELECT * FROM restart_dec"),
        "routes": statement("dec paths", ROUTES),
        "routes_restart": statement("restart_dec paths", ROUTES.replace("FROM dec", "FROM restart_dec")),
        "load_ways": statement("tagged", """
SELECT id, version, CASE WHEN version=2 THEN highway WHEN k%45=1 THEN 'residential' ELSE 'service' END AS highway,
  CASE WHEN k%3=0 THEN 'no' ELSE 'yes' END AS oneway, 'N'||k||','||'N'||(k+step)||','||'N'||(k+2*step) AS nodes
FROM tagged, (SELECT unnest([1,2]) AS version)
WHERE version=2 OR k%45=1 OR k%35=2"""),
        "load_damaged_ways": statement("tagged", """
SELECT id, CASE WHEN k%17=6 THEN 'timestamp,isvisible,version,changesetid,tags,nodes'
  WHEN k%11=4 AND k%13=5 THEN 'version,tags,nodes' WHEN k%11=4 THEN 'version' WHEN k%13=5 THEN 'tags,nodes' END AS faults
FROM tagged, (SELECT unnest([1,2]) AS version)
WHERE version=2 OR k%45=1 OR k%35=2"""),
        "load_nodes": statement("node", "SELECT id, 1 AS version, 0 AS n_tags, latitude, longitude FROM node"),
        "load_trajectories": statement("good", f"""
SELECT customid, trajid, timest, latitude, longitude, timediff, spacediff, speed, longitude AS json_lon, latitude AS json_lat
FROM good"""),
    }
    found["neighbor_paths_hubs"] = found["neighbor_paths_deep"]
    found["candidates_crowded"] = found["candidates"]
    found["sink_matches"] = found["routes"]
    found["sink_segments"] = found["segments"]
    found["sink_daily"] = statement("good", """
SELECT customid, trajid, (timest + 86400*(customid[2:]::int % 3))::int AS timest, latitude, longitude, timediff, spacediff, speed
FROM good""")
    found["sink_csv"] = statement("road tagged", """
SELECT road_id, 'N'||k||','||'N'||(k+step)||','||'N'||(k+2*step) AS nodes, t.highway
FROM road JOIN tagged t ON road_id = t.id""")
    return found
