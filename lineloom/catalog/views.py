"""The same views as ANSI SQL common table expressions, for checking results."""

from lineloom.sources import tables as T


def _mjd(c: str) -> str:
    return f"(epoch_us({c})/86400000000.0 + 40587.0)"


def _list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, key, mod) -> str:
    return f"({_list(values)})[({key} % {mod})::INT + 1]"


OBS = f"""obs AS (SELECT 'U'||user_id AS star_name, event_id AS row_id, {_mjd('ts')} AS mjd, value AS ew, event_type AS cls,
  CASE WHEN event_id % 17 <> 0 THEN value END AS snr, user_id*0.25::DOUBLE AS ra, user_id*0.125::DOUBLE - 30 AS dec,
  CASE user_id % 4 WHEN 0 THEN 'amateur' WHEN 1 THEN 'professional' WHEN 2 THEN 'other' END AS observer_type,
  CASE WHEN event_id % 23 <> 0 THEN event_type = 'error' END AS is_echelle_order FROM events)"""

META = f"""meta0 AS (SELECT *, CASE WHEN o_orderkey % 19 <> 0 THEN CASE WHEN o_orderkey % 29 = 0 THEN 0.0::DOUBLE ELSE o_totalprice/10 END END AS exptime,
  {_mjd('o_orderdate')} AS m,
  {_pick(T.TELESCOPE_TEXT, 'o_orderkey', 17)} AS t1, {_pick(T.SPECTROGRAPH_TEXT, 'o_orderkey', 13)} AS t2, {_pick(T.DETECTOR_TEXT, 'o_orderkey', 9)} AS t3
  FROM orders),
meta AS (SELECT o_orderkey AS id, 'S'||o_custkey AS star_name, CASE WHEN o_orderkey % 41 <> 0 THEN m END AS mjd,
  CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice/1000 END AS snr, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice/20 END AS spectral_resolution,
  exptime, (o_orderkey % 3600)/10.0::DOUBLE AS lon, (o_orderkey % 1800)/10.0::DOUBLE - 90 AS lat, (o_orderkey % 4000)*1.0::DOUBLE AS elev,
  nullif(concat_ws(' ', t1, t2, t3), '') AS raw, {_pick(T.SPECTROGRAPH_NAME, 'o_orderkey', 13)} AS spectrograph,
  {_pick(T.TELESCOPE_NAME, 'o_orderkey', 17)} AS telescope_expected, {_pick(T.DETECTOR_NAME, 'o_orderkey', 9)} AS detector_expected,
  CASE WHEN o_orderkey % 7 = 0 THEN 'IUE '||o_orderstatus ELSE o_orderpriority END AS instrument,
  CASE WHEN o_orderkey % 37 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_obs,
  m + exptime/86400.0::DOUBLE/2 + (o_orderkey % 5)*0.4::DOUBLE/86400.0::DOUBLE AS mjd_mid, o_orderpriority AS priority, o_orderstatus AS status,
  o_orderkey % 3 AS n_points, 4000.0::DOUBLE + o_totalprice/1000 AS lambda_start FROM meta0)"""

COVERAGE = f"""coverage AS (SELECT 'S'||l_suppkey AS star_name, CASE WHEN l_orderkey % 43 <> 0 THEN {_mjd('l_shipdate')} END AS mjd,
  CASE WHEN l_orderkey % 31 <> 0 THEN 4000.0::DOUBLE + l_extendedprice/30 END AS lambda_min,
  CASE WHEN l_orderkey % 31 <> 0 THEN 4000.0::DOUBLE + l_extendedprice/30 + l_quantity*20 END AS lambda_max, l_returnflag = 'R' AS is_echelle_order,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_linestatus END AS observer_type, CASE WHEN l_orderkey % 6 <> 0 THEN l_extendedprice/8 END AS spectral_resolution,
  CASE WHEN l_orderkey % 9 <> 0 THEN l_extendedprice/300 END AS snr FROM lineitem)"""


def _form(key: str, text: str) -> str:
    return (f"CASE {key} % 6 WHEN 0 THEN upper({text}) WHEN 1 THEN replace({text}, ' ', '_') WHEN 2 THEN 'hd  '||({key} % 500) "
            f"WHEN 3 THEN 'V0'||({key} % 400 + 1)||' Cas' WHEN 4 THEN 'gamma-'||substr({text},1,3)||'+' ELSE ({key} % 90 + 1)||'Cyg' END")


NAMES = f"""names0 AS (SELECT 'p'||p_partkey AS id, {_form('p_partkey', 'p_name')} AS raw, CASE WHEN p_partkey % 37 <> 0 THEN p_size/50.0::DOUBLE END AS ra,
  CASE WHEN p_partkey % 37 <> 0 THEN p_retailprice/1000 END AS dec FROM part
  UNION ALL SELECT 'c'||c_custkey, {_form('c_custkey', 'c_name')}, (c_custkey % 200)/100.0::DOUBLE, 1.0::DOUBLE + (c_custkey % 77)/100.0::DOUBLE FROM customer),
names1 AS (SELECT *, upper(trim(regexp_replace(trim(raw), '[\\s_\\-]+', ' ', 'g'))) AS s1 FROM names0),
names2 AS (SELECT *, CASE WHEN s1 LIKE 'GAMMA %' THEN 'GAM'||substr(s1, 6) ELSE s1 END AS s2 FROM names1),
names AS (SELECT id, raw, ra, dec, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s2,
  '^(HD|HR|SAO|HIP|MWC|ADS|TYC|NSV|NGC|BD|CD|CPD)\\s+', '\\1'), '^V\\s+(\\d)', 'V\\1'), '^V0+(\\d{{1,4}}\\s)', 'V\\1'),
  '^V0+(\\d{{1,4}})$', 'V\\1'), '^(\\d+)([A-Z]{{3}})$', '\\1 \\2'), '[\\-\\+\\*]+$', '')) AS name FROM names2)"""

CENT = "cent AS (SELECT name, median(ra) AS x, median(dec) AS y, count(*) AS n FROM names GROUP BY name HAVING count(ra) > 0 AND count(dec) > 0)"
PAIRS = """pairs AS (SELECT a.name AS a, b.name AS b FROM cent a JOIN cent b ON a.name < b.name AND abs(a.x-b.x) <= 0.01 AND abs(a.y-b.y) <= 0.01
  AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 0.01*0.01::DOUBLE)"""
COMP = """sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(name, c) AS (SELECT name, name FROM cent UNION SELECT sym.b, reach.c FROM reach JOIN sym ON reach.name = sym.a),
comp AS (SELECT name, min(c) AS component FROM reach GROUP BY name)"""
CANON = """ranked AS (SELECT cent.name, n, component, row_number() OVER (PARTITION BY component ORDER BY n DESC, cent.name) AS r FROM cent JOIN comp USING (name)),
canon AS (SELECT a.name, a.component, b.name AS canonical, a.n, t.total, t.n_members FROM ranked a JOIN ranked b ON a.component = b.component AND b.r = 1
  JOIN (SELECT component, sum(n)::BIGINT AS total, count(*) AS n_members FROM ranked GROUP BY component) t ON a.component = t.component)"""

ARRAYS_EV = """ev0 AS (SELECT *, row_number() OVER (PARTITION BY star_name ORDER BY mjd, row_id) AS rn FROM obs),
ev1 AS (SELECT star_name, (rn-1)//128 AS seg, list(1 + ew/100 ORDER BY rn) AS flux, min(mjd) AS mjd FROM ev0 GROUP BY ALL),
arrays_ev AS (SELECT star_name||':'||seg AS spectrum_id, star_name, mjd, flux,
  list_transform(range(len(flux)), lambda i: 6462.8::DOUBLE + 200.0::DOUBLE*i/greatest(len(flux)-1, 1)) AS wavelength, len(flux) AS n FROM ev1)"""

ARRAYS_LI = """li0 AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem),
arrays_li AS (SELECT 'S'||l_suppkey||':'||((rn-1)//640) AS spectrum_id, list(l_extendedprice/50000 ORDER BY rn) AS flux FROM li0 GROUP BY l_suppkey, (rn-1)//640)"""

VEC = """vec AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS z, label, 'E'||label AS star_name, (vec_id % 3)::INT AS cls, ((vec_id*37) % 400)::DOUBLE AS snr,
  list_sum(list_transform(range(len(embedding)), lambda i: CASE WHEN i % 2 = 0 THEN embedding[i+1]::DOUBLE ELSE -embedding[i+1]::DOUBLE END)) AS y, vec_id*0.5::DOUBLE AS mjd FROM embeddings)"""

RESULTS = """results AS (SELECT 'f'||(l_partkey % 6) AS feature, 'rep'||(l_suppkey % 4) AS representation, (l_linenumber % 3)::INT AS seed, l_returnflag AS variant,
  round(avg(l_discount)*10, 9) AS value, round(stddev_samp(l_discount), 6) AS r2_std FROM lineitem GROUP BY ALL)"""

PRED = """pred0 AS (SELECT *, row_number() OVER w AS rn, lag(ew) OVER w AS y_persist, mjd - lag(mjd) OVER w AS dt_days,
  lag(ew,1) OVER w + lag(ew,2) OVER w + lag(ew,3) OVER w + lag(ew,4) OVER w + lag(ew,5) OVER w AS s5 FROM obs WINDOW w AS (PARTITION BY star_name ORDER BY mjd, row_id)),
pred AS (SELECT cls AS config, star_name, mjd, row_id, dt_days, ew AS y_true, s5/5 AS y_pred, y_persist FROM pred0 WHERE rn > 5)"""

TEXT = {"obs": OBS, "meta": META, "coverage": COVERAGE, "names": NAMES, "cent": CENT, "pairs": PAIRS, "comp": COMP, "canon": CANON,
        "arrays_ev": ARRAYS_EV, "arrays_li": ARRAYS_LI, "vec": VEC, "results": RESULTS, "pred": PRED}
NEEDS = {"cent": ["names"], "pairs": ["names", "cent"], "comp": ["names", "cent", "pairs"], "canon": ["names", "cent", "pairs", "comp"],
         "arrays_ev": ["obs"], "pred": ["obs"]}


def with_views(body: str, *views: str) -> str:
    """``body`` behind the views it reads; ``body`` may open with its own ``name AS (...)`` list."""
    body = body.replace("count_if(", "count(*) FILTER (")  # BIGINT, as in Spark
    order: list[str] = []
    for v in views:
        for w in [*NEEDS.get(v, []), v]:
            if w not in order:
                order.append(w)
    if not order:
        return body
    ctes = ",\n".join(TEXT[v] for v in order)
    head = "WITH RECURSIVE " if "comp" in order else "WITH "
    return head + ctes + ("\n" if body.lstrip().upper().startswith("SELECT") else ",\n") + body
